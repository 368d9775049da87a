"""Benchmark decontamination by spaced-seed hashing.

A mask over some tokens keeps some positions and ignores the others. The hashes of the kept
tokens at every position of the test items are joined with those of all documents, for each mask;
a hit gives a diagonal on which item and document are laid over one another. Along the diagonal the
longest stretch that is equal enough is looked for: it may hold substitutions anywhere, and it
counts if it is long enough. Every stretch of ``LEAST`` words or more, ``SHARE`` of them equal, has
a hit, wherever its substitutions are.

A benchmark of up to ``PROBE_WORDS`` words is sent to the tasks, which probe into its sorted hashes,
so that documents are never shuffled. A larger one is joined by a shuffle: a bitmap of bounded size
leaves out most hashes of documents that no item has, the others meet those of the items, and only
the texts of documents with hits follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.textbatch import chunks, mix, words
from weftwork.session import materialize

#: 1: the token counts. No row of 13 to 25 tokens with 80 % equal, so no longer one either, is without a hit.
MASKS = ("1111111", "11101111", "111110011", "11010010111", "1100100010111", "1110101001001")
#: The shortest and the least equal stretches that the masks are complete for.
LEAST, SHARE = 13, 0.8
#: Words of items that are sent to the tasks, at most; with all masks below 100 MB in a task.
PROBE_WORDS = 500_000
#: The words of the shortest items that count: they are too short for substitutions, and must be there whole.
SHORT = 7
_FILTER_BITS = 22
#: Bits of the bitmap for larger benchmarks, at most: 32 MB.
_BITMAP_BITS = 28


def _hashes(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    x = np.full(max(n, 0), np.uint64(int(mask, 2)))
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                x = x * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(x)


class _Items:
    """The test items of a block, and the positions of their spaced hashes, in order of hashes."""

    def __init__(self, rows: list) -> None:
        self.ids = [r[0] for r in rows]
        h, _, _, self.at = words(pa.array([r[1] for r in rows], pa.string()))
        self.words = h
        keys, places = [], []
        for mask in MASKS:
            room = np.zeros(len(h), bool)
            for a, b in zip(self.at[:-1], self.at[1:], strict=True):
                room[a : max(a, b - len(mask) + 1)] = True
            place = np.flatnonzero(room)
            keys.append(_hashes(h, mask)[place] if len(place) else np.zeros(0, np.uint64))
            places.append(place)
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.key >> np.uint64(64 - _FILTER_BITS)] = True
        self.item = np.searchsorted(self.at, np.arange(len(h)), "right") - 1


def _longest(same: np.ndarray, share: Fraction) -> tuple[int, int]:
    """The longest stretch of which ``share`` is equal; of several the one with more equal words, then the first."""
    total = np.concatenate([[0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))])
    equal = np.concatenate([[0], np.cumsum(same)])
    # The first place from which the sum up to each end isn't negative.
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    length = np.arange(len(total)) - start
    ends = np.flatnonzero(length == length.max())
    b = int(ends[np.argmax(equal[ends] - equal[start[ends]])])
    return int(start[b]), b


def _lane(h: np.ndarray, item: np.ndarray, shift: int, least: int, share: Fraction) -> tuple[int, int, int, int] | None:
    """(words, equal ones, and the negative of their first places in the document and in the item) of the overlap on
    one diagonal: the item's word k is laid over the document's k + shift."""
    lo, hi = max(0, -shift), min(len(item), len(h) - shift)
    same = h[lo + shift : hi + shift] == item[lo:hi]
    if len(item) < least:
        return (len(item), len(item), -shift, 0) if hi - lo == len(item) and same.all() else None
    if hi - lo < least:
        return None
    s, e = _longest(same, share)
    return (e - s, int(same[s:e].sum()), -(lo + s + shift), -(lo + s)) if e - s >= least else None


_NAMES = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal"]
_SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_equal long"


def _search(items: _Items, least: int, share: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, _, _, at = words(part.column("text"))
                if len(h) < SHORT or not len(items.key):
                    continue
                found = []
                for mask in MASKS:
                    x = _hashes(h, mask)
                    maybe = np.flatnonzero(items.filter[x >> np.uint64(64 - _FILTER_BITS)])
                    lo, hi = np.searchsorted(items.key, x[maybe], "left"), np.searchsorted(items.key, x[maybe], "right")
                    n = hi - lo
                    where = np.repeat(maybe, n)
                    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    doc = np.searchsorted(at, where, "right") - 1
                    found.append(np.stack([where, items.place[k], doc])[:, where + len(mask) <= at[doc + 1]])
                where, place, doc = np.concatenate(found, axis=1)
                if not len(where):
                    continue
                # One diagonal of a document and an item is verified once, whatever its hits.
                lanes = np.unique(np.stack([doc, items.item[place], where - at[doc] - (place - items.at[items.item[place]])]), axis=1)
                out: dict[tuple[int, int], tuple] = {}
                for d, i, shift in lanes.T.tolist():
                    row = _lane(h[at[d] : at[d + 1]], items.words[items.at[i] : items.at[i + 1]], shift, least, share)
                    if row:
                        out[d, i] = max(out.get((d, i), row), row)
                if out:
                    ids = part.column("doc_id")
                    rows = [(ids[d].as_py(), items.ids[i], -x[2], -x[3], x[0], x[1]) for (d, i), x in out.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)

    return run


def _keys(bitmap: np.ndarray | None = None):
    """Rows (key, row, place) for the spaced hashes of texts, those only whose upper bits are in ``bitmap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, _, _, at = words(part.column("text"))
                row = part.column("row").to_numpy(zero_copy_only=False)
                for mask in MASKS:
                    x = _hashes(h, mask)
                    if bitmap is None:
                        where = np.arange(len(x))
                    else:
                        high = x >> np.uint64(64 - _BITMAP_BITS)
                        where = np.flatnonzero(bitmap[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8) & 1)
                    doc = np.searchsorted(at, where, "right") - 1
                    inside = where + len(mask) <= at[doc + 1]
                    where, doc = where[inside], doc[inside]
                    if len(where):
                        yield pa.RecordBatch.from_arrays([pa.array(x[where].view(np.int64)), pa.array(row[doc].astype(np.int64)), pa.array((where - at[doc]).astype(np.int32))], ["key", "row", "place"])

    return run


def _verified(least: int, share: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, _, _, at = words(part.column("text"))
                rows = []
                for d, (doc_id, lanes) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("lanes").to_pylist(), strict=True)):
                    _, _, _, place = found = words(pa.array([x["item_text"] for x in lanes], pa.string()))
                    best: dict[tuple, tuple] = {}
                    for k, x in enumerate(lanes):
                        row = _lane(h[at[d] : at[d + 1]], found[0][place[k] : place[k + 1]], x["shift"], least, share)
                        if row:
                            best[x["item"]] = max(best.get(x["item"], (row, x["item_id"])), (row, x["item_id"]), key=lambda y: y[0])
                    rows += [(doc_id, i, -r[2], -r[3], r[0], r[1]) for r, i in best.values()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)

    return run


def _joined(d: DataFrame, t: DataFrame, least: int, share: Fraction) -> DataFrame:
    """The overlaps by a join of the hashes of documents and items."""
    key = "key long, row long, place int"
    d = materialize(d.withColumn("row", F.monotonically_increasing_id()), "decontaminate-documents")
    t = materialize(t.withColumn("row", F.monotonically_increasing_id()), "decontaminate-items")
    items = materialize(t.select("text", "row").mapInArrow(_keys(), key), "decontaminate-hashes")
    bit = F.shiftrightunsigned("key", 64 - _BITMAP_BITS) + 1
    parts = items.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bitmap = np.zeros(1 << (_BITMAP_BITS - 3), np.uint8)
    for r in parts.toLocalIterator():  # 4 KB of the bitmap each
        bitmap[(r.k - 1) << 12 : r.k << 12] = np.frombuffer(r.bits, np.uint8)
    some = d.select("text", "row").mapInArrow(_keys(bitmap), key)
    items = items.select("key", F.col("row").alias("item"), F.col("place").alias("at"))
    lanes = some.join(items, "key").select("row", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    texts = t.select(F.col("row").alias("item"), "item_id", F.col("text").alias("item_text"))
    lanes = lanes.join(texts, "item").groupBy("row").agg(F.collect_list(F.struct("item", "item_id", "item_text", "shift")).alias("lanes"))
    return d.join(lanes, "row").select("doc_id", "text", "lanes").mapInArrow(_verified(least, share), _SCHEMA)


def contaminated(docs: DataFrame, tests: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``tests(item_id, text, ...)`` -> one row for each document and item
    that overlap: ``(doc_id, item_id, doc_word, item_word, n_words, n_equal)``.

    The overlap is the longest verified one: ``n_words`` words from the word ``doc_word`` of the
    document, laid over the item's from ``item_word``, of which ``n_equal`` are equal. It has
    ``least`` words or more, of which a share of ``share`` or more are equal, those at its ends or
    not. An item of fewer words than ``least`` overlaps where all of it is found; one of fewer than
    ``SHORT`` words, which any text may hold, and an empty or null text, overlaps with nothing. Less than ``LEAST`` words or ``SHARE`` is refused, as hits would be missing. Of equally long overlaps
    the one with more equal words counts, and then the first. Repeated documents give repeated rows;
    repeated items count once for each id and text. Rows without id keep a null in the pair. Extra
    columns don't matter; empty tables give empty results.
    """
    if least < LEAST or share < SHARE:
        raise ValueError(f"the masks find stretches of {LEAST} words or more, {SHARE} of them equal")
    exact = Fraction(share).limit_denominator(10_000)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    spaces = F.length("text") - F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) + 1
    if (t.agg(F.sum(spaces)).first()[0] or 0) > PROBE_WORDS:
        return _joined(d, t, least, exact)
    items = _Items(sorted(((r.item_id, r.text) for r in t.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
    return d.mapInArrow(_search(items, least, exact), _SCHEMA)
