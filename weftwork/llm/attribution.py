"""Token counts of fields and sections from one encoding of each whole document.

A document is encoded once, and every token has a span of characters. Sections are spans of
characters too; tokens and sections are joined by their intervals. A token that crosses the edge of
a section goes by an explicit rule: ``first``, to the section of its first character; ``last``, of
its last one; ``most``, to the one that has most of its characters, the earlier of equals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.textbatch import chunks
from weftwork.llm.tokens import load

RULES = ("first", "last", "most")


def lines(text: str) -> list[tuple[str, int, int]]:
    """The sections of plain text: its lines, each with the line feed that ends it."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        to = min(len(text), at + len(line) + 1)
        if to > at or i == 0:
            out.append(("line", at, to))
        at = to
    return out


def allocate(starts: np.ndarray, length: int, edges: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section of one text. ``edges``: the first character of each section, ascending, from 0.

    A character whose bytes several tokens share belongs to all of them; a token ends where the
    next one with another first character begins.
    """
    return _allocate(starts, edges, np.full(len(edges), length), rule)


def _allocate(starts: np.ndarray, edges: np.ndarray, stops: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section of texts laid behind one another, with a place between them.

    ``stops``: where the text of each section ends. Both ``starts`` and ``edges`` ascend, so that an
    interval join of the few edges with the tokens is enough: a section has the tokens that begin
    in it, and those right before an edge are dealt anew if they reach beyond it.
    """
    at = np.searchsorted(starts, edges)
    n = np.diff(np.append(at, len(starts)))
    if rule == "first" or not len(starts):
        return n
    after = np.append(starts, np.iinfo(np.int64).max)[at[1:]]
    ends = np.minimum(after, stops[:-1])
    over = np.flatnonzero((at[1:] > 0) & (ends > edges[1:]) & (starts[at[1:] - 1] < edges[1:])) + 1
    if not len(over):
        return n
    # Edges between the same two tokens are crossed by the same tokens: those of one first character.
    new = np.append(True, at[over][1:] != at[over][:-1])
    first, last = over[new], over[np.append(new[1:], True)]
    begin, end = starts[at[first] - 1], ends[last - 1]
    moved = at[first] - np.searchsorted(starts, begin)
    to = last.copy()
    if rule == "most":
        to = np.where(end - edges[first] > edges[first] - begin, first, first - 1)
        for i in np.flatnonzero(last > first):
            cut = np.concatenate([[begin[i]], edges[first[i] : last[i] + 1], [end[i]]])
            to[i] = first[i] - 1 + int(np.argmax(np.diff(cut)))
    np.subtract.at(n, np.searchsorted(edges, begin, "right") - 1, moved)
    np.add.at(n, to, moved)
    return n


def _cut(texts: list[str], sections: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(sections of each text, first character and size of each section, kind of each)."""
    if sections is lines:
        found = [[len(x) + 1 for x in t.split("\n")] for t in texts]
        for t, f in zip(texts, found, strict=True):
            f[-1] -= 1
            if not f[-1] and t:
                f.pop()
        size = np.array(list(chain.from_iterable(found)), np.int64)
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = np.cumsum(size) - size
        head = np.repeat(at[np.cumsum(count) - count], count) if len(at) else at
        return count, at - head, size, pa.repeat("line", len(size))
    rows = [sections(t) for t in texts]
    flat = [x for r in rows for x in r]
    at, end = (np.fromiter((x[k] for x in flat), np.int64, len(flat)) for k in (1, 2))
    return np.fromiter(map(len, rows), np.int64, len(rows)), at, end - at, pa.array([x[0] for x in flat], pa.string())


def _run(path: str, sections: Callable[[str], list[tuple[str, int, int]]], rule: str):
    names = ["doc_id", "section", "kind", "first_char", "n_chars", "n_tokens", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, offsets=True)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                spans = encoder.spans(texts)
                tokens = np.fromiter(map(len, spans), np.int64, len(spans))
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                base = np.cumsum(size + 1) - size - 1
                count, first, width, kind = _cut(texts, sections)
                starts = np.concatenate(spans) + np.repeat(base, tokens)
                n = _allocate(starts, first + np.repeat(base, count), np.repeat(base + size, count), rule)
                row = np.repeat(np.arange(len(texts)), count)
                number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                cols = [part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)), kind, *map(pa.array, (first, width, n, tokens[row]))]
                yield pa.RecordBatch.from_arrays(cols, names)
        encoder.forget()

    return run


def section_tokens(docs: DataFrame, tokenizer: str, sections: Callable[[str], list[tuple[str, int, int]]] = lines, rule: str = "most") -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each section: ``(doc_id, section, kind, first_char,
    n_chars, n_tokens, doc_tokens)``.

    ``sections(text)`` gives ``(kind, first character, end)`` of sections that follow one another
    from 0 to the end of the text; every token is allocated to one of them, so that ``n_tokens`` of
    a document's sections sum to ``doc_tokens``. A null or empty text has one empty section without
    tokens. Repeated rows are counted alike, each by itself; extra columns don't matter; an empty
    table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_run(tokenizer, sections, rule), "doc_id long, section int, kind string, first_char long, n_chars long, n_tokens long, doc_tokens long")


def field_tokens(rows: DataFrame, tokenizer: str, fields: list[str], id_col: str = "doc_id", between: str = "\n", rule: str = "first") -> DataFrame:
    """Tokens of each of several text fields of a row, encoded as one text with ``between`` after each field.

    ``(doc_id, section, kind, first_char, n_chars, n_tokens, doc_tokens)``, ``kind`` being the field's
    name and ``n_chars`` including what is between. Null fields are empty and keep their row.
    """
    sizes = [F.coalesce(F.length(F.col(f).cast("string")), F.lit(0)) for f in fields]
    head = F.concat_ws(",", *[s.cast("string") for s in sizes])
    body = F.concat(*[F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(between)) for f in fields])
    whole = rows.select(F.col(id_col).alias("doc_id"), F.concat(head, F.lit("\x00"), body).alias("text"))
    return whole.select("doc_id", "text").mapInArrow(_fields(tokenizer, fields, len(between), rule), "doc_id long, section int, kind string, first_char long, n_chars long, n_tokens long, doc_tokens long")


def _fields(tokenizer: str, fields: list[str], gap: int, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies = zip(*[t.split("\x00", 1) for t in batch.column("text").to_pylist()], strict=True) if batch.num_rows else ((), ())
            spans = load(tokenizer, offsets=True).spans(list(bodies))
            rows: list[tuple] = []
            for doc_id, head, body, starts in zip(batch.column("doc_id").to_pylist(), heads, bodies, spans, strict=True):
                size = np.array([int(n) + gap for n in head.split(",")], np.int64)
                edges = np.cumsum(size) - size
                # Fields of no width can't hold a token; their edge is that of the next one.
                n = np.zeros(len(size), np.int64)
                wide = size > 0
                n[wide] = allocate(starts, len(body), edges[wide], rule) if wide.any() else 0
                rows += [(doc_id, i, f, int(edges[i]), int(size[i]), int(n[i]), len(starts)) for i, f in enumerate(fields)]
            names = ["doc_id", "section", "kind", "first_char", "n_chars", "n_tokens", "doc_tokens"]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return run
