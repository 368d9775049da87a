"""N-gram Jaccard join on token-combination prefixes.

Tokens are the distinct word shingles of a text. All texts with one set of shingles are one node.

Order and classes. Every task counts the shingles of its texts; those that are frequent in all are
put last in the order of tokens, the most frequent at the very end, and form the *frequent* class.
Any order and any classes give the same result; they decide only how much is compared.

Prefixes. For a similarity of t and a set of n tokens, linked sets share at least ceil(t n) tokens,
and so at least l of their first n - ceil(t n) + l ones. The prefix is extended by
l = min(extend, ceil(t n)). Rare tokens of the prefix are indexed singly. Linked sets that share
none of these share at least two frequent tokens of their prefixes for l = 2, which are indexed as
k-combinations (k = 2) of one another. Sets above ``combine_below`` tokens index their frequent tokens singly, and sets about
that size do both, so that any two of similar size meet.

Candidates. Two nodes are compared if they share as many index keys as the prefixes demand. So that
large groups of near copies aren't expanded into pairs, each key first offers only its smallest
node to the others; the links found so are contracted to components, and then only nodes that are
still in different components are paired, over all keys. Every candidate is verified on the whole
sets.

Passes. Keys are grouped, and paired, slice by slice of their hashes, so that the shuffle files of one
slice at a time are on disk; what pairs share is summed over the slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.components import components
from weftwork.llm.textbatch import chunks, mix, relieve, set_id, shingle_sets
from weftwork.session import discard, materialize, sweep

#: Shingles held by a task before it counts them.
_HOLD = 2_000_000
#: So many ids of texts to compare are sent to all tasks at most (8 MB); more are joined by a shuffle.
_BROADCAST_IDS = 1_000_000
#: Rows of the index that one pass takes, about, and passes at most: each has a dozen stages of its own.
PASS_ROWS, PASSES = 4_000_000, 4


def _names(width: int):
    """Rows (doc_id, node, n) for the texts, and (null, shingle, count) for what a task has seen repeatedly."""

    def rows(doc_id: pa.Array, node: pa.Array, n: pa.Array, counted: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_id, node, n, pa.array(np.full(len(n), counted))], ["doc_id", "node", "n", "counted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def count() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
            n = np.diff(edge)
            many = n > 1
            token = s[edge[:-1][many]].view(np.int64)
            return rows(pa.nulls(len(token), pa.int64()), pa.array(token), pa.array(n[many].astype(np.int64)), True)

        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), width)
                yield rows(part.column("doc_id"), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), False)
                held += sets
                size += sum(map(len, sets))
                if size > _HOLD:
                    yield count()
                    held, size = [], 0
        yield count()
        held = []
        relieve()

    return run


def _overlap(n: int, num: int, den: int) -> int:
    """The tokens that a set of n shares at least with any set linked to it."""
    return -(-num * n // den)


def _keys(width: int, num: int, den: int, extend: int, combine_below: int, frequent: np.ndarray, rank: np.ndarray):
    """Rows (key, node, n, f, rare): f is the number of frequent tokens in the prefix, rare tells whether the key is a rare token."""

    def index(s: np.ndarray) -> tuple[np.ndarray, int, int]:
        n = len(s)
        need = _overlap(n, num, den)
        p = min(n, n - need + min(extend, need))
        at = np.searchsorted(frequent, s)
        at[at == len(frequent)] = 0
        often = frequent[at] == s if len(frequent) else np.zeros(n, bool)
        keys = [s[~often][:p]]
        rest, near = p - len(keys[0]), min(p, n - need + 2) - len(keys[0])
        if near <= 0:
            return keys[0], max(0, rest), len(keys[0])
        last = s[often][np.argsort(rank[at[often]], kind="stable")][:near]
        with np.errstate(over="ignore"):
            if n <= combine_below * den // num + 1:
                i, j = np.triu_indices(len(last), 1)
                low, high = np.minimum(last[i], last[j]), np.maximum(last[i], last[j])
                keys.append(mix(low * np.uint64(0xE7037ED1A0B428DB) + high))
            if n >= combine_below * num // den or n < 2:
                keys.append(mix(last + np.uint64(0x1D8E4E27C47D124F)))
        return np.concatenate(keys), rest, len(keys[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                done: set[int] = set()
                keys, nodes, sizes, many, rows, rare = [], [], [], [], [], []
                for s in shingle_sets(part.column("text"), width):
                    if len(s) and (node := set_id(s)) not in done:
                        done.add(node)
                        k, f, r = index(s)
                        keys.append(k)
                        nodes.append(node)
                        sizes.append(len(s))
                        many.append(f)
                        rows.append(len(k))
                        rare.append(np.arange(len(k)) < r)
                if keys:
                    each = lambda x, t: pa.array(np.repeat(np.array(x, t), rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), each(nodes, np.int64), each(sizes, np.int32), each(many, np.int32), pa.array(np.concatenate(rare))], ["key", "node", "n", "f", "rare"])
        relieve()

    return run


def _compare(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_a", 1_000_000):
                left, right = shingle_sets(part.column("text_a"), width), shingle_sets(part.column("text_b"), width)
                both = [len(x) + len(y) - len(np.union1d(x, y)) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(both, pa.int64()), pa.array([len(x) + len(y) - z for x, y, z in zip(left, right, both, strict=True)], pa.int64())], ["a", "b", "shared", "united"])
        relieve()

    return run


def _slices(table: DataFrame, passes: int) -> Iterator[DataFrame]:
    """``table`` by the remainders of its keys, which are hashes."""
    for k in range(passes):
        yield table.where(F.pmod("key", F.lit(passes)) == k) if passes > 1 else table


def _stored(parts: Iterator[DataFrame], name: str) -> list[DataFrame]:
    """Each part written, and its shuffle files deleted, before the next is begun."""
    out = []
    for part in parts:
        out.append(materialize(part, name))
        sweep(part.sparkSession)
    return out


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of nodes whose whole sets are linked."""
    names = reps.select("node", "rep")
    pairs = materialize(pairs.join(names.toDF("a", "ra"), "a").join(names.toDF("b", "rb"), "b"), "ngram-pairs")
    sweep(docs.sparkSession)
    wanted = materialize(pairs.select(F.explode(F.array("ra", "rb")).alias("doc_id")).distinct(), "ngram-wanted")
    few = wanted.count() <= _BROADCAST_IDS
    texts = materialize(docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text"), "ngram-texts")
    full = pairs.join(texts.toDF("ra", "text_a"), "ra").join(texts.toDF("rb", "text_b"), "rb").select("a", "b", "text_a", "text_b")
    both = full.mapInArrow(_compare(width), "a long, b long, shared long, united long")
    out = materialize(both.where(f"{den} * shared >= {num} * united").select("a", "b"), "ngram-linked")
    discard(pairs, wanted, texts)
    return out


def jaccard_components(
    docs: DataFrame,
    width: int = 5,
    num: int = 4,
    den: int = 5,
    extend: int = 16,
    combine_below: int = 300,
    frequent_from: int = 64,
    frequent_most: int = 1 << 18,
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id)``, one row for each row.

    Two documents are linked when ``den * shared >= num * united`` over their sets of distinct
    ``width``-word shingles; ``component_id`` is the smallest doc_id that links reach. A null or
    wordless text has an empty set and is linked with nothing. ``doc_id`` names one text: repeated
    rows come back repeated, with one component. A row without doc_id keeps its row; its component
    is that of equal sets, or null. Extra columns are ignored, whatever their names; empty tables
    give empty results.

    ``frequent_from``: shingles that tasks have counted so often are of the frequent class, the
    ``frequent_most`` most frequent of them at most; this bounds what is sent to the tasks (4 MB).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.select("doc_id", "text", F.lit(False).alias("counted")).mapInArrow(_names(width), "doc_id long, node long, n long, counted boolean")
    named = materialize(named, "ngram-names")
    sets = named.where("not counted").select("doc_id", "node", "n")
    often = (
        named.where("counted").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent_from)
        .orderBy(F.desc("n"), "node").limit(frequent_most).collect()
    )
    token = np.array([r.node for r in often], np.int64).view(np.uint64)
    order = np.argsort(token)
    frequent, rank = token[order], np.argsort(np.argsort(np.array([r.n for r in often], np.int64)[order], kind="stable"))
    reps = materialize(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "ngram-nodes")

    run = _keys(width, num, den, extend, combine_below, frequent, rank)
    entries = materialize(docs.select("doc_id", "text").mapInArrow(run, "key long, node long, n int, f int, rare boolean"), "ngram-index")
    # r: the rare tokens of the prefix. Of the nodes of a key the one with the fewest is in the middle.
    need = f"ceil(n * {num} / {den})"
    stored = entries
    entries = entries.withColumn("r", F.expr(f"cast(n - {need} + least({extend}, {need}) - f as int)"))
    passes = min(PASSES, max(1, -(-stored.count() // PASS_ROWS)))
    # Few nodes have one rare token, so these keys are dealt out whole; other keys may have very many
    # nodes: the middle one is found by a partial aggregate and joined back, which skew can't hurt.
    middle = [F.min(F.struct("r", "node", "n", "f")).alias("p"), F.min("node").alias("low"), F.max("node").alias("high")]
    of_key = Window.partitionBy("key")

    def grouped(entries: DataFrame) -> DataFrame:
        """Keys that several nodes have, with the middle one of these."""
        rare = entries.where("rare").select("key", "node", "n", "f", "r", "rare", *[c.over(of_key).alias(x) for c, x in ((F.min(F.struct("r", "node", "n", "f")), "p"), (F.min("node"), "low"), (F.max("node"), "high"))])
        often = entries.where("not rare").select("key", "node", "n", "f", "r", "rare")
        often = often.join(often.groupBy("key").agg(*middle).where("low <> high"), "key")
        shared = rare.where("low <> high").unionByName(often).select("key", "node", "n", "f", "r", "rare", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.f").alias("pf"), F.col("p.r").alias("pr"))
        return shared.dropDuplicates(["key", "node"])

    parts = _stored(map(grouped, _slices(entries, passes)), "ngram-shared")
    shared = reduce(DataFrame.unionByName, parts)
    discard(stored)

    like = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    demand = f"least(least({extend}, ceil(na * {num} / {den})), least({extend}, ceil(nb * {num} / {den}))) - least(fa, fb)"
    # If a prefix reaches the frequent class, all rare tokens of its set are in it: what the other has besides isn't shared.
    most = "least(if(fb > 0, na - (ra - c), na), if(fa > 0, nb - (rb - c), nb))"
    enough = f"(fa > 0 and fb > 0 and c = 0 or c >= greatest(1, {demand})) and {den} * {most} >= {num} * (na + nb - {most})"

    of_pair = ["a", "b", "na", "nb", "fa", "fb", "ra", "rb"]

    def counted(pairs: DataFrame) -> DataFrame:
        """Rare tokens that pairs share; an order of ends that is the same for all keys."""
        ends = pairs.select(*[F.when(F.col("a") < F.col("b"), F.col(f"{x}a")).otherwise(F.col(f"{x}b")).alias(f"{x}a") for x in ("n", "f", "r")], *[F.when(F.col("a") < F.col("b"), F.col(f"{x}b")).otherwise(F.col(f"{x}a")).alias(f"{x}b") for x in ("n", "f", "r")], F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rare")
        return ends.where(like).groupBy(*of_pair).agg(F.count_if("rare").alias("c"))

    star = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("pn").alias("na"), F.col("n").alias("nb"), F.col("pf").alias("fa"), F.col("f").alias("fb"), F.col("pr").alias("ra"), F.col("r").alias("rb"), "rare")
    first = _verified(docs, reps, counted(star).where(enough).select("a", "b"), width, num, den)
    label = components(first)

    # Keys whose nodes are all in one component by now have nothing more to say.
    placed = shared.select("key", "node", "n", "f", "r", "rare").join(label.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(placed, "ngram-placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    open_ = materialize(placed.join(mixed, "key"), "ngram-open")
    discard(*parts, placed)
    # Components of a key are paired unless no pair of their nodes can be linked: by a frequent key, which
    # matters only to sets without a shared rare token, at most the frequent part of either is shared.
    fit = f"rare or {den} * least(na - ra, nb - rb) >= {num} * (na + nb - least(na - ra, nb - rb))"

    def met(open_: DataFrame) -> DataFrame:
        groups = open_.groupBy("key", "comp", "rare").agg(F.max(F.col("n") - F.when(F.col("rare"), 0).otherwise(F.col("r"))).alias("most"), F.min("n").alias("least"))
        one, two = (groups.select("key", "rare", F.col("comp").alias(f"c{x}"), F.col("most").alias(f"m{x}"), F.col("least").alias(f"l{x}")) for x in "ab")
        across = one.join(two, ["key", "rare"]).where(f"ca < cb and {den} * least(ma, mb) >= {num} * (la + lb - least(ma, mb))").select("key", "ca", "cb")
        left = open_.select("key", F.col("comp").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"), F.col("r").alias("ra"), "rare")
        right = open_.select("key", F.col("comp").alias("cb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"), F.col("r").alias("rb"))
        return counted(across.join(left, ["key", "ca"]).join(right, ["key", "cb"]).where(fit))

    parts = _stored(map(met, _slices(open_, passes)), "ngram-met")
    discard(open_)
    rest = reduce(DataFrame.unionByName, parts).groupBy(*of_pair).agg(F.sum("c").alias("c")).where(enough).select("a", "b")
    second = _verified(docs, reps, rest.join(first, ["a", "b"], "left_anti"), width, num, den)
    discard(*parts)

    names = reps.select("node", "rep")
    linked = first.union(second)
    edges = linked.join(names.toDF("a", "ra"), "a").join(names.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    found = components(edges)
    whole = names.join(found, names.rep == found.node, "left").select(names.node.alias("id"), F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(whole, sets.node == whole.id, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
