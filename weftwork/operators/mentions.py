"""Entity mentions in three tiers, with an audit of what was rejected.

Aliases always count. An ambiguous word counts in the right context, unless it begins in an alias or
in an exclusion of its entity. Exclusions vouch for nothing, so they are blank where context is read.

All texts of an Arrow batch are one text with marks between them. Each pattern runs over it once,
and what is left is arithmetic on arrays of spans: what begins in an alias or an exclusion is found
by a binary search in spans sorted by start with the running maximum of their ends. Texts without
anything that a pattern could match don't leave the JVM.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from weftwork.functions.rules import Rules
from weftwork.session import reach, spread

_FOUND = "mentions array<struct<entity:string,mention_count:int,first_char_offset:int>>, rejections array<struct<entity:string,term:string,reason:string,snippet:string>>"
#: Stands between two texts; a pattern must not match NUL.
_MARK = "\n\x00\n"
_AROUND = 60


class _Spans:
    """Spans by start, and whether a place is in one of them."""

    def __init__(self, start: np.ndarray, end: np.ndarray) -> None:
        order = np.argsort(start, kind="stable")
        self.start = start[order]
        self.reach = np.maximum.accumulate(end[order]) if len(end) else end

    def hold(self, place: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(place), bool)
        k = np.searchsorted(self.start, place, "right") - 1
        return (k >= 0) & (self.reach[k] > place)


#: Letters whose lower case isn't the whole of what they are taken for without regard to case.
_OTHER_CASE = re.compile("[ſıİKÅẞϑϕϖϰϱϴϵ]")
_LITERAL = re.compile(r"(\\b)?([a-z0-9][a-z0-9 ]*[a-z0-9]|[a-z0-9])(\\b)?")


class _Text:
    """A text and its lower case, if that tells the same as matching without regard to case."""

    def __init__(self, text: str) -> None:
        self.text = text
        lower = text.lower()
        self.lower = lower if text.isascii() or len(lower) == len(text) and not _OTHER_CASE.search(text) else None


class _Pattern:
    """A pattern without regard to case. Plain words, which most patterns are, are looked for as such."""

    def __init__(self, pattern: str) -> None:
        self.regex = re.compile(pattern, re.I)
        m = _LITERAL.fullmatch(pattern)
        self.word, self.edges = (m[2], (bool(m[1]), bool(m[3]))) if m else (None, (False, False))

    def spans(self, t: _Text) -> np.ndarray:
        if self.word is None or t.lower is None:
            return np.array([m.span() for m in self.regex.finditer(t.text)], np.int64).reshape(-1, 2)
        at, end = [], 0
        word, n, text, (before, after) = self.word, len(self.word), t.lower, self.edges
        find = text.find
        i = find(word)
        while i >= 0:
            end = i + n
            x, y = text[i - 1 : i], text[end : end + 1]
            if before and (x.isalnum() or x == "_") or after and (y.isalnum() or y == "_"):
                end = i + 1
            else:
                at.append(i)
            i = find(word, end)
        start = np.array(at, np.int64)
        return np.stack([start, start + n], axis=1)


class Sweep:
    """A rule set made ready for batches of texts."""

    def __init__(self, rules: Rules) -> None:
        names = dict.fromkeys([*rules.aliases, *(a.entity for a in rules.ambiguous), *(e for e, _ in rules.excluded)])
        self.names = list(names)
        of = {e: k for k, e in enumerate(names)}
        self.aliases = [(of[e], _Pattern(p)) for e, ps in rules.aliases.items() for p in ps]
        self.words = [(of[a.entity], a, _Pattern(a.term), re.compile("|".join(f"(?:{c})" for c in a.context) or "(?!)", re.I), re.compile(a.cased or "(?!)")) for a in rules.ambiguous]
        self.excluded = [(of[e], p, _Pattern(p)) for e, p in rules.excluded]

    def _blanked(self, t: _Text, aliased: _Spans) -> str:
        """The text with exclusions outside of aliases blank, one pattern after another."""
        text = t.text
        for _, _, pattern in self.excluded:
            t = t if text is t.text else _Text(text)
            cut = pattern.spans(t)
            cut = cut[~aliased.hold(cut[:, 0])]
            if len(cut):
                edges = [0, *cut.reshape(-1).tolist(), len(text)]
                text = "".join(" " * (b - a) if k % 2 else text[a:b] for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
        return text

    def __call__(self, texts: list[str], beside: list[str | None]) -> tuple[np.ndarray, list[tuple]]:
        """(rows (text, entity, offset) of mentions, sorted and distinct; (text, order, entity, term, reason, snippet) of rejections).

        ``beside``: more text that the context of a text may be in.
        """
        whole = _Text(_MARK.join(texts))
        blob = whole.text
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + len(_MARK)) - size - len(_MARK)
        text_of = lambda place: np.searchsorted(begin, place, "right") - 1
        hits: list[tuple[int, np.ndarray]] = []
        rejected: list[tuple] = []

        def reject(order: int, entity: int, term: str, reason: str, spans: np.ndarray) -> None:
            for k, (s, e) in zip(text_of(spans[:, 0]).tolist(), spans.tolist(), strict=True):
                lo, hi = int(begin[k]), int(begin[k] + size[k])
                rejected.append((k, order, s, self.names[entity], term, reason, " ".join(blob[max(lo, s - _AROUND) : min(hi, e + _AROUND)].split())))

        spans = [p.spans(whole) for _, p in self.aliases]
        hits += [(e, x[:, 0]) for (e, _), x in zip(self.aliases, spans, strict=True)]
        every = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
        aliased = _Spans(every[:, 0], every[:, 1])
        outside = [p.spans(whole) for _, _, p in self.excluded]
        shut: dict[int, _Spans] = {}
        for e in {e for e, _, _ in self.excluded}:
            own = np.concatenate([x for (k, _, _), x in zip(self.excluded, outside, strict=True) if k == e])
            shut[e] = _Spans(own[:, 0], own[:, 1])
        blank: str | None = None
        vouched: dict[tuple[int, int], bool] = {}
        for order, (entity, rule, term, context, cased) in enumerate(self.words):
            open_ = term.spans(whole)
            open_ = open_[~aliased.hold(open_[:, 0])]
            if entity in shut:
                open_ = open_[~shut[entity].hold(open_[:, 0])]
            if not len(open_):
                continue
            counts = np.zeros(len(open_), bool)
            for i, (k, (s, e)) in enumerate(zip(text_of(open_[:, 0]).tolist(), open_.tolist(), strict=True)):
                if rule.cased and cased.match(blob, s):
                    counts[i] = True
                    continue
                if blank is None:
                    blank = self._blanked(whole, aliased)
                lo, hi = int(begin[k]), int(begin[k] + size[k])
                counts[i] = context.search(blank[max(lo, s - rule.window) : min(hi, e + rule.window)]) is not None
                if not counts[i] and beside[k]:
                    if (order, k) not in vouched:
                        vouched[order, k] = context.search(beside[k]) is not None
                    counts[i] = vouched[order, k]
            hits.append((entity, open_[counts, 0]))
            reject(order, entity, rule.term, "no_context", open_[~counts])
        for order, ((entity, pattern, _), x) in enumerate(zip(self.excluded, outside, strict=True), len(self.words)):
            reject(order, entity, pattern, "excluded", x[~aliased.hold(x[:, 0])])
        place = np.concatenate([x for _, x in hits]) if hits else np.zeros(0, np.int64)
        entity = np.repeat([e for e, _ in hits], [len(x) for _, x in hits]).astype(np.int64)
        where = text_of(place)
        found = np.unique(np.stack([where, entity, place - begin[where]], axis=1), axis=0) if len(place) else np.zeros((0, 3), np.int64)
        return found, [(k, *rest) for k, _, _, *rest in sorted(rejected, key=lambda r: r[:3])]

    def batch(self, bodies: list[str | None], titles: list[str | None]) -> pa.StructArray:
        """Mentions and rejections of each row. A title counts besides the body if it is another text."""
        n = len(bodies)
        texts = [b or "" for b in bodies]
        also = [k for k in range(n) if titles[k] and titles[k] != texts[k]]
        found, rejected = self([*texts, *(titles[k] or "" for k in also)], [*([None] * n), *(texts[k] for k in also)])
        row = np.concatenate([np.arange(n), np.array(also, np.int64)])[found[:, 0]].astype(np.int64)
        # One mention for each row and entity, with the number of its places and the first one in the body.
        key, which, count = np.unique(row * len(self.names) + found[:, 1], return_inverse=True, return_counts=True) if len(row) else (row, row, row)
        far = np.iinfo(np.int32).max
        first = np.full(len(key), far, np.int64)
        np.minimum.at(first, which, np.where(found[:, 0] < n, found[:, 2], far))
        entity = pa.array(self.names, pa.string()).take(pa.array(key % max(1, len(self.names))))
        mention = pa.StructArray.from_arrays([entity, pa.array(count.astype(np.int32)), pa.array(first.astype(np.int32), mask=first == far)], ["entity", "mention_count", "first_char_offset"])
        mentions = pa.ListArray.from_arrays(pa.array(np.searchsorted(key // max(1, len(self.names)), np.arange(n + 1)).astype(np.int32)), mention)
        of = [r[0] if r[0] < n else also[r[0] - n] for r in rejected]
        order = np.argsort(np.array(of, np.int64), kind="stable")
        columns = [pa.array([rejected[k][i] for k in order], pa.string()) for i in range(1, 5)]
        at = np.searchsorted(np.array(of, np.int64)[order], np.arange(n + 1)).astype(np.int32)
        rejections = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(columns, ["entity", "term", "reason", "snippet"]))
        return pa.StructArray.from_arrays([mentions, rejections], ["mentions", "rejections"])

    def find(self, body: str | None, title: str | None = None) -> tuple[list[tuple], list[tuple]]:
        """Mentions as (entity, count, first offset in the body or None), in the order of the rules, and rejections of one row."""
        r = self.batch([body], [title])[0].as_py()
        return [tuple(m.values()) for m in r["mentions"]], [tuple(x.values()) for x in r["rejections"]]


@lru_cache(maxsize=8)
def _sweep(key: bytes) -> Sweep:
    return Sweep(pickle.loads(key))


try:  # private to the interpreter: without it nothing is known of what a pattern needs
    from re import _parser as parser
except ImportError:
    parser = None

#: Characters of texts that are one text at a time.
_AT_ONCE = 4_000_000


def _parts(sizes: list[int]) -> Iterator[slice]:
    a = total = 0
    for b, n in enumerate(sizes):
        if total and total + n > _AT_ONCE:
            yield slice(a, b)
            a, total = b, 0
        total += n
    yield slice(a, len(sizes))


def needs(pattern: str) -> set[str] | None:
    """Lower-case strings one of which is in every match of a pattern; None if there are none, or none are known."""
    if parser is None:
        return None

    def of(nodes) -> set[str] | None:
        best: set[str] | None = None
        run = ""
        for kind, value in [*nodes, (None, None)]:
            if kind is parser.LITERAL:
                run += chr(value)
                continue
            found: list[set[str] | None] = [{run.lower()} if run else None]
            run = ""
            if kind is parser.SUBPATTERN:
                found.append(of(value[3]))
            elif kind is parser.BRANCH:
                each = [of(x) for x in value[1]]
                found.append(None if None in each else set().union(*each))
            elif kind is parser.MAX_REPEAT and value[0] > 0:
                found.append(of(value[2]))
            for x in found:
                if x and (best is None or min(map(len, x)) > min(map(len, best))):
                    best = x
        return best

    return of(parser.parse(pattern, re.I))


def maybe(text: Column, rules: Rules) -> Column:
    """Whether anything of the rules could be in a text: whether it holds a string that one of their patterns needs."""
    patterns = [*(p for ps in rules.aliases.values() for p in ps), *(a.term for a in rules.ambiguous), *(p for _, p in rules.excluded)]
    found = [needs(p) for p in patterns]
    if None in found:
        return text.isNotNull()
    words = sorted(set().union(*found), key=len)
    words = [w for i, w in enumerate(words) if not any(x in w for x in words[:i])]
    # Letters that are taken for i, k and s without regard to case.
    lower = F.translate(F.lower(text), "ıſ", "is")
    return reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in words], F.lit(False))


def with_mentions(docs: DataFrame, rules: Rules, body: str = "body", title: str | None = "title") -> DataFrame:
    """``docs`` with ``mentions`` and ``rejections``, arrays of structs, empty where there is nothing.

    The term of a rejection is the pattern of its rule. A null body or title is empty.
    """
    key = pickle.dumps(rules)

    @F.arrow_udf(f"struct<{_FOUND.replace('mentions array', 'mentions:array', 1).replace(' rejections array', 'rejections:array')}>")
    def run(b: pa.Array, t: pa.Array) -> pa.Array:
        bodies, titles = b.to_pylist(), t.to_pylist()
        parts = _parts([len(x or "") + len(y or "") for x, y in zip(bodies, titles, strict=True)])
        return pa.concat_arrays([_sweep(key).batch(bodies[p], titles[p]) for p in parts])

    # Spark would otherwise run it once more for a filter that it infers from a later explode.
    run = run.asNondeterministic()
    b, t = F.col(body).cast("string"), F.col(title).cast("string") if title else F.lit(None).cast("string")
    some = F.coalesce(maybe(b, rules), F.lit(False)) | F.coalesce(maybe(t, rules), F.lit(False))
    found = spread(docs).withColumn("_found", run(F.when(some, b), F.when(some, t)))
    return found.withColumns({"mentions": F.col("_found.mentions"), "rejections": F.col("_found.rejections")}).drop("_found")


def register_mentions(spark: SparkSession, rules: Rules, name: str = "mentions") -> None:
    """A table function for SQL: ``SELECT id, m.* FROM docs, LATERAL mentions(body, title) m`` gives the rows of ``mention_rows``.

    The title may be left out. Arguments must be strings or null; a null one is empty. A query over many texts
    that hold nothing is faster with the condition ``maybe`` before it.
    """
    key = pickle.dumps(rules)
    columns = StructType().add("entity", StringType()).add("mention_count", IntegerType()).add("first_char_offset", IntegerType())

    class Mentions:
        @staticmethod
        def analyze(body: AnalyzeArgument, title: AnalyzeArgument | None = None) -> AnalyzeResult:
            for n, x in (("body", body), ("title", title)):
                if x is not None and x.dataType.typeName() not in ("string", "void"):
                    raise ValueError(f"{n} must be a string, not {x.dataType.simpleString()}")
            return AnalyzeResult(columns)

        def eval(self, body: str | None, title: str | None = None) -> Iterator[tuple]:
            yield from _sweep(key).find(body, title)[0]

    spark = reach(spark)
    spark.udtf.register(name, F.udtf(Mentions))


def mention_rows(found: DataFrame, id_col: str = "id") -> DataFrame:
    """A row for each document and entity."""
    return found.select(F.col(id_col).alias("document_id"), F.explode("mentions").alias("m")).select("document_id", "m.*")


def rejection_rows(found: DataFrame, id_col: str = "id") -> DataFrame:
    return found.select(F.col(id_col).alias("document_id"), F.explode("rejections").alias("r")).select("document_id", "r.*")


def rejection_counts(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("entity", "term", "reason").agg(F.count("*").alias("n"))


def not_counted(docs: DataFrame, mentions: DataFrame, rejections: DataFrame, entity: str, substring: str, per_doc: int = 2) -> DataFrame:
    """Documents that hold a substring but no mention of the entity, with ``per_doc`` of its rejections at most,
    or the reason ``substring_only`` where there is none."""
    some = docs.where(F.col("body").contains(substring) | F.lower("body").contains(substring.lower()))
    some = some.join(mentions.where(F.col("entity") == entity).select(F.col("document_id").alias("id")), "id", "left_anti")
    own = rejections.where(F.col("entity") == entity).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("reason", "snippet"))).alias("all"))
    own = own.select(F.col("document_id").alias("id"), F.explode(F.slice("all", 1, per_doc)).alias("r"))
    return some.select("id").join(own, "id", "left").select("id", F.coalesce("r.reason", F.lit("substring_only")).alias("reason"), "r.snippet")
