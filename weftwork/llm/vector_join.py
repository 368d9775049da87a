"""Embedding near-duplicates over a robust-pruned flat graph.

Regions. Centroids are fitted on a bounded sample; each vector is a query in the region of its
nearest centroid, and a member of that and of all others whose border to the nearest is within a
margin of it. A margin of the sine of half the angle of the threshold leaves no pair without a
region that has the one as a query and the other as a member, as the point between them is on this
side of the border for one. Below it the margin grows until that holds for a share ``HELD`` of the
true pairs of a sample of vectors, which is held against all vectors. A region too large for a task
is divided again by centroids of its own, level by level. One that cannot be divided, as its vectors
are all within the margin of one another, is cut into blocks: queries of a block meet the members
of every block. Nothing is left out.

Graph. A region is divided into overlapping shards, each vector being in those of its two nearest
centroids. In each shard every vector gets its nearest neighbours, robust-pruned: a neighbour is
left out if it is nearer, by the factor ``alpha``, to one that is kept. The adjacency lists that a
vector has from its shards, and the lists that it is in, are united.

Search. Greedy searches with a beam begin at the medoids of the shards and at the query's own list;
distances are evaluated along the lists only. From where a search ends the range is expanded: the
lists of all vectors found within the range, and a margin, are followed until nothing new is in
range. A distance is a product in double precision, which verifies the pair. ``audit`` measures
recall against brute force.

Equal vectors are one node with a multiplicity, and only counts and a spanning forest of a region's
links leave the region, so that large groups of copies cost no more rows than they have members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.components import components
from weftwork.session import discard, materialize

#: Vectors of the sample for centroids, at most; centroids of one level, at most.
SAMPLE, CENTROIDS = 20_000, 512
#: Members of a region, at most, and bytes of their vectors; members per centroid that are aimed at, as a share of that.
REGION, REGION_BYTES, AIM = 12_000, 48 << 20, 0.3
#: Bytes of centroids that one pass sends to its tasks.
CENTROID_BYTES = 32 << 20
#: Cells whose sizes are sent to every task, at most; more are joined by a shuffle.
SENT = 1_000_000
#: Levels of regions; members of a shard that are aimed at.
LEVELS, SHARD = 8, 600
_NEAR, _DEGREE, _BEAM, _OPEN, _CHUNK = 48, 24, 32, 4, 512
#: The share of true pairs that regions of one level hold, at least; vectors sampled for them, pairs of these at most, steps of the margin.
HELD, QUERIES, PAIRS, STEPS = 0.995, 2000, 5000, 16


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large values would be infinite, those of small ones zero
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; ties and starts are fixed by the order of rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def _joined(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centroid of each vector, which centroids' regions it is a member of)."""
    s = x @ c.T
    row, first = np.arange(len(x)), np.argmax(s, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[first] @ c.T)))
    joined = s[row, first][:, None] - s <= margin * apart + 1e-9
    return first, joined


def _pairs(some: DataFrame, sample: pd.DataFrame, dim: int, threshold: float) -> list[np.ndarray]:
    """The true pairs of a sample, each from either end: [vectors, others, the cell of each vector]."""
    sample = sample.iloc[np.linspace(0, len(sample) - 1, min(len(sample), QUERIES, max(200, 2_000_000 // dim))).astype(int)]
    q, ids = _unit(sample["v"]), sample["rep"].to_numpy()

    def near(frames):
        for f in frames:
            x, rep = _unit(f["v"]), f["rep"].to_numpy()
            for a in range(0, len(x), 1024):
                i, k = np.nonzero((x[a : a + 1024] @ q.T >= threshold) & (rep[a : a + 1024, None] != ids[None, :]))
                yield pd.DataFrame({"k": k, "rep": rep[a + i]})

    # Only names are ordered, as a vector of the sample may have very many pairs; those taken get their vectors after.
    pairs = some.select("rep", "v").mapInPandas(near, "k long, rep long")
    pairs = pairs.orderBy(F.xxhash64("k", "rep"), "k", "rep").limit(min(PAIRS, max(200, 2_000_000 // dim)))
    pairs = some.select("rep", "v").join(F.broadcast(pairs), "rep").toPandas().sort_values(["k", "rep"])
    if len(pairs) < 100:
        # Too few to measure by: pairs are made at the threshold, each towards another vector of the sample.
        other = np.roll(q, 1, axis=0)
        other = other - (other * q).sum(1, keepdims=True) * q
        size = np.linalg.norm(other, axis=1)
        a = q[size > 1e-9]
        b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * other[size > 1e-9] / size[size > 1e-9, None]
        if len(pairs):
            a, b = np.concatenate([a, q[pairs["k"]]]), np.concatenate([b, _unit(pairs["v"])])
    else:
        a, b = q[pairs["k"]], _unit(pairs["v"])
    return [np.concatenate([a, b]), np.concatenate([b, a]), np.zeros(2 * len(a), np.int64)]


def _margin(cells: dict[int, np.ndarray], base: dict[int, int], pairs: list[np.ndarray], least: float, threshold: float) -> float:
    """The smallest margin from ``least`` on at which the parts of cells hold enough of the pairs in them, which go to their parts."""
    whole = float(np.sqrt(max(0.0, (1 - threshold) / 2)))
    inside = {c: np.flatnonzero(pairs[2] == c) for c in cells}
    total = sum(map(len, inside.values()))
    steps = [x for x in whole * np.arange(STEPS + 1) / STEPS if x >= least] or [whole]
    for margin in steps:
        held = {}
        for cell, at in inside.items():
            kept = [np.zeros(0, bool)]
            for i in range(0, len(at), 1024):
                part = at[i : i + 1024]
                first = _joined(pairs[0][part], cells[cell], 0.0)[0]
                kept.append(_joined(pairs[1][part], cells[cell], margin)[1][np.arange(len(part)), first])
            held[cell] = np.concatenate(kept)
        if sum(x.sum() for x in held.values()) >= HELD * total or margin == steps[-1]:
            break
    for cell, at in inside.items():
        if len(at):
            pairs[2][at] = np.where(held[cell], base[cell] + np.argmax(pairs[0][at] @ cells[cell].T, axis=1), -1)
    return float(margin)


def _pruned(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, neighbour) of the robust-pruned neighbours of each row of a shard."""
    n = len(x)
    m = min(_NEAR, n - 1)
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n if m else 0, _CHUNK):
        s = x[a : a + _CHUNK] @ x.T
        k = len(s)
        row = np.arange(k)
        s[row, a + row] = -2
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, near, 1)))
        y = x[near]
        between = np.sqrt(np.maximum(0, 2 - 2 * (y @ y.transpose(0, 2, 1))))
        alive, chosen = np.ones((k, m), bool), np.zeros((k, m), bool)
        for _ in range(_DEGREE):
            ok = alive.any(1)
            if not ok.any():
                break
            p = np.argmax(alive, axis=1)
            chosen[row[ok], p[ok]] = True
            alive &= alpha * between[row, p] > far
            alive[row, p] = False
        i, j = np.nonzero(chosen)
        rows.append(i + a)
        cols.append(near[i, j])
    return np.concatenate(rows), np.concatenate(cols)


def _graph(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each vector's list, the lists, a medoid of each shard)."""
    n = len(x)
    k = max(1, -(-n // SHARD))
    c = _centroids(x[np.linspace(0, n - 1, min(n, 20 * k + 200)).astype(int)], k, 4) if k > 1 else x.mean(0, keepdims=True)
    s = x @ c.T
    in_shard = np.zeros((n, k), bool)
    for _ in range(min(2, k)):
        best = np.argmax(s, axis=1)
        in_shard[np.arange(n), best] = True
        s[np.arange(n), best] = -np.inf
    codes, medoids = [], []
    for j in range(k):
        members = np.flatnonzero(in_shard[:, j])
        if not len(members):
            continue
        y = x[members]
        medoids.append(members[int(np.argmax(y @ y.sum(0)))])
        a, b = _pruned(y, alpha)
        codes += [members[a] * n + members[b], members[b] * n + members[a]]
    code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    return np.searchsorted(code, np.arange(n + 1) * n), code % n, np.unique(medoids)


def _lists(at: np.ndarray, to: np.ndarray, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) for all neighbours of ``node``."""
    size = at[node + 1] - at[node]
    place = np.repeat(at[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.repeat(query, size), to[place]


def _search(x: np.ndarray, queries: np.ndarray, graph: tuple, threshold: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, other) of all pairs that the searches find within the range."""
    at, to, medoids = graph
    n = len(x)
    out = []
    for begin in range(0, len(queries), _CHUNK):
        who = queries[begin : begin + _CHUNK]
        k = len(who)
        seen, opened = np.zeros((k, n), bool), np.zeros((k, n), bool)
        inside: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The pairs not seen before, and their distances."""
            new = ~seen[q, node]
            code = np.unique(q[new] * n + node[new])
            q, node = code // n, code % n
            seen[q, node] = True
            s = np.einsum("ij,ij->i", x[who[q]], x[node])
            near = s >= threshold - margin
            inside.append((q[near], node[near], s[near]))
            return q, node, s

        row = np.arange(k)
        seen[row, who] = True
        beam = np.full((k, _BEAM), -1)
        score = np.full((k, _BEAM), -np.inf)
        beam[:, 0], score[:, 0] = who, 1.0
        fresh = look(np.repeat(row, len(medoids)), np.tile(medoids, k))
        while True:
            q, node, s = fresh
            if len(q):
                # The new ones beside the beam: the best of both are the beam.
                order = np.lexsort((-s, q))
                q, node, s = q[order], node[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                top = rank < _BEAM
                more, more_score = np.full((k, _BEAM), -1), np.full((k, _BEAM), -np.inf)
                more[q[top], rank[top]], more_score[q[top], rank[top]] = node[top], s[top]
                beam, score = np.concatenate([beam, more], 1), np.concatenate([score, more_score], 1)
                best = np.argsort(-score, axis=1, kind="stable")[:, :_BEAM]
                beam, score = np.take_along_axis(beam, best, 1), np.take_along_axis(score, best, 1)
            shut = (beam < 0) | opened[row[:, None], np.maximum(beam, 0)]
            first = np.cumsum(~shut, axis=1)
            q, place = np.nonzero(~shut & (first <= _OPEN))
            if not len(q):
                break
            node = beam[q, place]
            opened[q, node] = True
            fresh = look(*_lists(at, to, q, node))
        done = 0
        while done < len(inside):
            some = inside[done:]
            done = len(inside)
            q, node = np.concatenate([p[0] for p in some]), np.concatenate([p[1] for p in some])
            new = ~opened[q, node]
            q, node = q[new], node[new]
            opened[q, node] = True
            if len(q):
                look(*_lists(at, to, q, node))
        q, node, s = (np.concatenate([p[i] for p in inside]) for i in range(3))
        hit = s >= threshold
        out.append((who[q[hit]], node[hit]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n reaches by links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links(threshold: float, margin: float, alpha: float):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[2]), int(key[3])
        f = f.sort_values("rep", ignore_index=True)
        ids, copies, block = f["rep"].to_numpy(), f["copies"].to_numpy(), f["block"].to_numpy()
        n = len(ids)
        x = _unit(f["v"])
        asks = f["query"].to_numpy(bool)
        a, b = _search(x, np.flatnonzero(asks), _graph(x, alpha), threshold, margin)
        # A link that only one of two queries has found is both's.
        code = np.concatenate([a * n + b, (b * n + a)[asks[b]]])
        code = np.unique(code)
        a, b = code // n, code % n
        if i != j:
            a, b = a[block[a] != block[b]], b[block[a] != block[b]]
        count = np.bincount(a, weights=copies[b], minlength=n).astype(np.int64)
        root = _roots(n, a, b)
        some = asks | (root != np.arange(n))
        return pd.DataFrame({"rep": ids[some], "n": count[some], "root": ids[root[some]]})

    return run


def _deal(centroids: dict[int, np.ndarray], base: dict[int, int], margin: float):
    """Rows of the cells in ``centroids`` -> rows of their parts, which are numbered from ``base``."""

    def run(frames):
        for f in frames:
            for cell, some in f.groupby("cell", sort=True):
                c = centroids[int(cell)]
                for at in range(0, len(some), 1024):
                    part = some.iloc[at : at + 1024]
                    near, joined = _joined(_unit(part["v"]), c, margin)
                    row, k = np.nonzero(joined)
                    new = part.iloc[row]
                    yield new.assign(parent=np.int64(cell), cell=base[int(cell)] + k.astype(np.int64), query=new["query"].to_numpy(bool) & (near[row] == k))[list(_COLUMNS)]

    return run


_COLUMNS = {"cell": "long", "parent": "long", "rep": "long", "copies": "long", "query": "boolean", "v": "array<double>"}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())


def _fit(aim: float):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep")
        k = int(min(CENTROIDS, len(f), max(2, -(-int(f["m"].iloc[0]) // aim))))
        return pd.DataFrame({"cell": [int(key[0])], "c": [_centroids(_unit(f["v"]), k).reshape(-1).tolist()]})

    return run


def _regions(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``nodes(rep, copies, v)`` -> ``(cell, rep, copies, query, v, blocks)``, cells being regions; those that
    can't be divided are to be cut into ``blocks``."""
    most = max(100, min(REGION, REGION_BYTES // (8 * dim)))
    aim = max(1.0, AIM * most)
    cap = max(1000, min(SAMPLE, 2_000_000 // dim))
    rows = nodes.select(F.lit(0).cast("long").alias("cell"), F.lit(-1).cast("long").alias("parent"), "rep", "copies", F.lit(True).alias("query"), "v")
    spark = nodes.sparkSession
    done: list[DataFrame] = []
    margin, first, parents, pairs = 0.0, 1, {}, None
    for level in range(LEVELS + 1):
        sizes = {r["cell"]: (r["m"], r["parent"]) for r in rows.groupBy("cell", "parent").agg(F.count("*").alias("m")).where(F.col("m") > most).collect()}
        # A part nearly as large as the whole it comes from is not divided further.
        stuck = [c for c, (m, p) in sizes.items() if level == LEVELS or parents.get(p) and m > 0.7 * parents[p]]
        large = [c for c in sizes if c not in set(stuck)]
        # One row for each cell that is too large: its size, whether it is divided, by which step it is sampled, into how many blocks it is cut.
        shut = set(stuck)
        facts = [(c, m, c not in shut, -(-m // cap), int(-(-2 * m // most)) if c in shut else 1) for c, (m, _) in sizes.items()]
        facts_ = spark.createDataFrame(facts, "cell long, m long, divided boolean, step long, blocks int")
        known = rows.join(F.broadcast(facts_) if len(facts) <= SENT else facts_, "cell", "left")
        known = known.withColumns({"divided": F.coalesce("divided", F.lit(False)), "blocks": F.coalesce("blocks", F.lit(1))})
        done.append(known.where("not divided").select(*_COLUMNS, "blocks"))
        if not large:
            break
        parents = {c: sizes[c][0] for c in large}
        some = known.where("divided and pmod(xxhash64(rep), step) = 0").select(*_COLUMNS, "m")
        fitted = materialize(some.select("cell", "rep", "m", "v").groupBy("cell").applyInPandas(_fit(aim), "cell long, c array<double>"), "vector-centroids")
        dealt: list[DataFrame] = []
        batch = max(1, CENTROID_BYTES // (8 * dim * CENTROIDS))
        for at in range(0, len(large), batch):
            part = sorted(large)[at : at + batch]
            c = {r["cell"]: np.array(r["c"]).reshape(-1, dim) for r in fitted.where(F.col("cell").isin(part)).orderBy("cell").collect()}
            if pairs is None:
                sample = some.select("rep", "v").orderBy(F.xxhash64("rep")).limit(cap).toPandas().sort_values("rep")
                pairs = _pairs(nodes, sample, dim, threshold)
            base = {}
            for cell, x in c.items():
                base[cell] = first
                first += len(x)
            margin = _margin(c, base, pairs, margin, threshold)
            dealt.append(rows.where(F.col("cell").isin(part)).mapInPandas(_deal(c, base, margin), _SCHEMA))
        rows = dealt[0]
        for x in dealt[1:]:
            rows = rows.unionByName(x)
        rows = materialize(rows, "vector-cells")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def vector_links(vectors: DataFrame, threshold: float = 0.95, alpha: float = 1.2, margin: float = 0.05) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(vec_id, n_links, component_id, kept)``, one row for each row.

    Pairs of a cosine of ``threshold`` or more that the search finds are linked; ``n_links`` counts
    the other vec_ids linked directly, ``component_id`` is the smallest vec_id that links reach, and
    ``kept`` tells whether it is the row's own. A vector that is null, empty, zero, or holds a null
    or a value that isn't finite is linked with nothing, and so is one without vec_id, whose
    component is null. Large and small finite values count like any other. Vectors of different lengths aren't linked. Rows repeated under one vec_id
    are one vector. An empty table gives an empty result; extra columns don't matter.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.size("v") > 0
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = materialize(v.where("vec_id is not null and v is not null").where(fine).distinct(), "vectors")
    nodes = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("dim", F.size("v")), "vector-nodes")
    regions = []
    for r in nodes.groupBy("dim").count().collect():  # usually one length
        some = _regions(nodes.where(F.col("dim") == r["dim"]).drop("dim"), r["dim"], threshold)
        regions.append(some.withColumn("dim", F.lit(r["dim"])))
    if not regions:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    dealt = regions[0]
    for p in regions[1:]:
        dealt = dealt.unionByName(p)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = dealt.select("dim", "cell", "i", "j", "rep", "copies", "query", "block", "v").groupBy("dim", "cell", "i", "j")
    found = materialize(found.applyInPandas(_links(threshold, margin, alpha), "rep long, n long, root long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    whole = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = nodes.join(counts, "rep").join(whole, nodes["rep"] == whole["node"], "left").select(nodes["v"].alias("is"), (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = good.join(named, good["v"] == named["is"]).select(F.col("vec_id").alias("id"), "n_links", "component_id")
    known = known.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, links: DataFrame, threshold: float = 0.95, sample: int = 200) -> float:
    """The share of true links that ``links`` has, for ``sample`` vectors held against all by brute force."""
    v = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    some = v.join(links.where("n_links > 0").select("vec_id"), "vec_id").unionByName(v).dropDuplicates(["vec_id"])
    some = some.join(links.select("vec_id", "n_links"), "vec_id").orderBy((F.col("n_links") == 0).cast("int"), F.xxhash64("vec_id")).limit(sample).toPandas()
    q = _unit(some["v"])

    def count(frames):
        for f in frames:
            yield pd.DataFrame({"k": np.arange(len(q)), "m": ((_unit(f["v"]) @ q.T) >= threshold).sum(0)})

    true = v.mapInPandas(count, "k long, m long").groupBy("k").agg(F.sum("m").alias("m")).toPandas().set_index("k")["m"].reindex(range(len(q))).to_numpy() - 1
    return float(np.minimum(some["n_links"], true).sum() / max(1, true.sum()))
