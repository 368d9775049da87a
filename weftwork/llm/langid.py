"""Language identification by Bayesian fusion of text, declared language and place.

Text. Byte trigrams of A-Z-lowered letters and spaces in 2^14 hash classes; their frequencies in each language are
counted over all rows that declare one of the languages. Neighbouring trigrams share letters, so
that the log-likelihood of a text counts a third.

Place. The prior of a row's languages is that of its host, smoothed with that of the address
suffix, which is smoothed with that of all rows. The counts are those of the languages that the
texts alone suggest, summed by host and by suffix; a row doesn't count for itself.

Declaration. The chance that a row in a language declares what it declares, from the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.textbatch import buffers, chunks
from weftwork.session import materialize

LANGUAGES = ("de", "en", "es", "fr")
_BITS = 14
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


_NONE = 1 << _BITS  # the class of trigrams with anything but letters and spaces


def _grams(texts: pa.Array) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """(trigram classes, those of each text, letters of each text)."""
    data, offs = buffers(texts)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    letters = letters[offs[1:]] - letters[offs[:-1]]
    if len(data) < 3:
        return np.zeros(0, np.uint32), [slice(0, 0)] * len(letters), letters
    c = _FOLD[data]
    plain = _LETTER[data] | (c == 0x20)
    code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - _BITS)
    code[~(plain[:-2] & plain[1:-1] & plain[2:])] = _NONE
    return code, [slice(a, max(a, b - 2)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], letters


def _count(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), _NONE + 1), np.int64)
        for batch in batches:
            for part in chunks(batch):
                code, at, _ = _grams(part.column("text"))
                for where, declared in zip(at, part.column("declared").to_pylist(), strict=True):
                    if declared in languages:
                        total[languages.index(declared)] += np.bincount(code[where], minlength=_NONE + 1)
        total = total[:, :_NONE].reshape(-1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    return run


def _likelihood(tables: np.ndarray):
    """tables: the log-frequency of each trigram class (rows) in each language (columns)."""
    tables = np.vstack([tables, np.zeros((1, tables.shape[1]), tables.dtype)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                code, at, letters = _grams(part.column("text"))
                sums = np.array([tables[code[w]].sum(0, dtype=np.float64) for w in at]).reshape(len(at), -1)
                n = np.array([np.count_nonzero(code[w] != _NONE) for w in at], np.int64)
                cols = [part.column(c) for c in ("id", "declared", "host", "suffix")]
                cols += [pa.array(n), pa.array(letters.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1)), tables.shape[1]).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "declared", "host", "suffix", "n", "letters", "ll"])

    return run


#: Rows of a side that is broadcast, at most; beyond, the keys that have more than a share of 1 / HOT of all rows are.
BROADCAST_ROWS, HOT = 100_000, 1000


def _beside(rows: DataFrame, key: str, side: DataFrame, of: str, counts: str | None) -> DataFrame:
    """``rows`` with the row of ``side`` that has ``of`` equal to ``key``, or nulls. A side that is too large to be
    broadcast is joined by a shuffle, but for its frequent keys, whose rows, like those without a key, stay where they are."""
    n = side.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), F.col(key) == F.col(of), "left")
    size = F.col(counts) if counts else sum((F.col(c) for c in side.columns if c != of), F.lit(0.0))
    share = side.agg(F.sum(size)).first()[0] / HOT
    hot = side.where(size > share)
    stay = rows.join(F.broadcast(hot), F.col(key) == F.col(of), "left")
    rare = rows.join(F.broadcast(hot.select(of)), F.col(key) == F.col(of), "left_anti").where(F.col(key).isNotNull())
    return stay.where(F.col(key).isNull() | F.col(of).isNotNull()).unionByName(rare.join(side.where(size <= share), F.col(key) == F.col(of), "left"))


def identify(
    rows: DataFrame,
    id_col: str = "doc_id",
    text: Column | str = "text",
    declared: Column | str | None = "lang",
    host: Column | str | None = "source",
    suffix: Column | str | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    smoothing: float = 20.0,
    least: float = 0.5,
    strays: float = 3.0,
) -> DataFrame:
    """``rows`` -> ``(<id_col>, language, posterior, declared, reason, kept)``, one row for each row.

    A row is rejected, with ``language`` null, for one of three reasons: ``empty``, no letter in its
    text, or none at all; ``unknown``, in every language its trigrams of letters and spaces are on
    average less likely than if all classes were equally frequent, and further below that language's
    own average than ``strays`` deviations of a text of that length, a margin that narrows as texts
    get longer; ``undecided``, no language has a posterior of ``least``. Of equal posteriors the language that is first in ``languages`` counts. A declaration, host or suffix
    that is null, or a column that isn't given, says nothing. Repeated rows are judged alike, each
    by itself; extra columns don't matter; an empty table gives an empty result.

    ``smoothing``: the rows of its parent that a host or a suffix is given besides its own.
    """
    part = lambda c: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast("string")
    d = rows.select(F.col(id_col).cast("long").alias("id"), part(text).alias("text"), part(declared).alias("declared"), part(host).alias("host"), part(suffix).alias("suffix"))
    counts = d.select("text", "declared").where(F.col("declared").isin(*languages)).mapInArrow(_count(languages), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    total = np.zeros(len(languages) << _BITS)
    for r in counts.collect():  # a row for each language and class at most
        total[r.place] = r.n
    total = total.reshape(len(languages), -1) + 0.5
    share = total / total.sum(1, keepdims=True)
    mean = (share * np.log(share)).sum(1)
    spread = np.sqrt((share * np.log(share) ** 2).sum(1) - mean**2)
    tables = np.ascontiguousarray(np.log(share).T.astype(np.float32))

    s = d.mapInArrow(_likelihood(tables), "id long, declared string, host string, suffix string, n long, letters long, ll array<double>")
    best = F.array_position("ll", F.array_max("ll")).cast("int")
    s = materialize(s.withColumn("says", F.when((F.col("n") > 0) & (F.col("letters") > 0), best)), "language-likelihoods")

    k = range(1, len(languages) + 1)
    counted = lambda name: [F.count_if(F.col("says") == i).cast("double").alias(f"{name}{i}") for i in k]
    whole = s.agg(*counted("g")).first()
    all_rows = sum(whole)
    top = [(x + 1.0) / (all_rows + len(languages)) for x in whole]
    by_host = s.where("host is not null").groupBy(F.col("host").alias("h")).agg(*counted("h"), F.count("says").cast("double").alias("hn"))
    by_suffix = s.where("suffix is not null").groupBy(F.col("suffix").alias("x")).agg(*counted("x"), F.count("says").cast("double").alias("xn"))
    by_word = s.where("declared is not null").groupBy(F.col("declared").alias("w")).agg(*counted("w"))
    f = s
    for key, side, counts, of in (("host", by_host, "hn", "h"), ("suffix", by_suffix, "xn", "x"), ("declared", by_word, None, "w")):
        f = _beside(f, key, materialize(side, f"language-by-{key}"), of, counts)

    own = lambda i: F.when(F.col("says") == i, 1.0).otherwise(0.0)
    some = F.when(F.col("says").isNotNull(), 1.0).otherwise(0.0)
    score = []
    for i in k:
        at_suffix = F.when(F.col("xn").isNull(), F.lit(top[i - 1])).otherwise((F.col(f"x{i}") - own(i) + smoothing * top[i - 1]) / (F.col("xn") - some + smoothing))
        at_host = F.when(F.col("hn").isNull(), at_suffix).otherwise((F.col(f"h{i}") - own(i) + smoothing * at_suffix) / (F.col("hn") - some + smoothing))
        word = F.when(F.col(f"w{i}").isNull(), F.lit(1.0)).otherwise((F.col(f"w{i}") - own(i) + 1.0) / (whole[i - 1] + len(languages)))
        score.append(F.element_at("ll", i) / 3 + F.log(at_host) + F.log(word))
    f = f.withColumn("score", F.array(*score))
    f = f.withColumn("mass", F.aggregate("score", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("score"))))
    f = f.withColumn("posterior", 1.0 / F.col("mass")).withColumn("language", F.element_at(F.array(*map(F.lit, languages)), F.array_position("score", F.array_max("score")).cast("int")))
    # The log-likelihood below which a text is none of language i; neighbouring trigrams share letters.
    floor = lambda i: F.least(F.col("n") * float(-np.log(1 << _BITS)), F.col("n") * float(mean[i - 1]) - strays * float(spread[i - 1]) * F.sqrt(3.0 * F.col("n")))
    reason = (
        F.when(F.col("letters") == 0, "empty")
        .when(F.greatest(*[F.element_at("ll", i) - floor(i) for i in k]) < 0, "unknown")
        .when(F.col("posterior") < least, "undecided")
    )
    f = f.withColumn("reason", reason)
    return f.select(F.col("id").alias(id_col), F.when(F.col("reason").isNull(), F.col("language")).alias("language"), "posterior", "declared", "reason", F.col("reason").isNull().alias("kept"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, text, declared, host, suffix)`` for ``identify``."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), blank(declared).alias("declared"), blank(host).alias("host"), blank(F.element_at(F.split(host, r"\."), -1)).alias("suffix"))
