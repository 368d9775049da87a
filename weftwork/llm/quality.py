"""Quality grades by ordinal cumulative-link regression on hashed text.

A document's features are the distinct hashed words of its whole text, and hashed classes of a few
of its shape: repetition, letters, capitals, marks, word lengths. All grades share one weight for
each feature; ordered thresholds cut the score into grades: P(grade > k) = 1 / (1 + exp(t_k - score)).
The model is fitted on a bounded sample of rated documents, and every document gets its expected
grade and the probability of the grades that are good enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.textbatch import buffers, chunks, mix, words

BITS = 18
STEM = 5
#: Rated documents that the model is fitted on, at most: those with the lowest hashes of their ids.
SAMPLE = 8_000
#: Steps of the fit, at least.
STEPS = 1_500


_KINDS = np.zeros((4, 256), bool)
_KINDS[0, 0x41:0x5B] = True  # capitals
_KINDS[1, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # letters
_KINDS[2, 0x30:0x3A] = True  # digits
_KINDS[3, [0x20, *range(0x09, 0x0E)]] = True  # white space


def _features(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct features, ascending."""
    data, offs = buffers(texts)
    h, starts, ends, at = words(texts)
    # Words count without the marks around them, so that their hash is of what is left.
    sums = [np.concatenate([[0], np.cumsum(k[data], dtype=np.int64)]) for k in _KINDS]
    letters = np.concatenate([[0], np.cumsum(_KINDS[1][data] | _KINDS[2][data], dtype=np.int64)])
    bare = letters[ends] - letters[starts] == ends - starts
    trimmed = _trimmed(data, starts, ends, ~bare, h)
    key = (mix(trimmed) >> np.uint64(64 - BITS)).astype(np.int64)
    stem = _stems(data, starts, ends)
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        size, n = int(offs[i + 1] - offs[i]), b - a
        capital, letter, digit, space = (int(s[offs[i + 1]] - s[offs[i]]) for s in sums)
        w = np.unique(key[a:b])
        shape = []
        if n:
            same = int(np.count_nonzero(h[a + 1 : b] == h[a : b - 1]))
            marks = size - letter - digit - space
            shape = [
                ("words", int(np.log2(n))),
                ("again", int(20 * same / n)),
                ("distinct", int(10 * len(np.unique(h[a:b])) / n ** 0.9)),
                ("capitals", int(20 * capital / max(1, letter))),
                ("marks", int(20 * marks / size)),
                ("digits", int(20 * digit / size)),
                ("length", int((size - space) / n)),
                ("marked", int(10 * (n - np.count_nonzero(bare[a:b])) / n)),
            ]
        else:
            shape = [("words", -1)]
        w = np.concatenate([w, stem[a:b]])
        own = np.array([_NAMES.setdefault(x, _name(x)) for x in shape], np.int64)
        out.append(np.unique(np.concatenate([w, own])))
    return out


def _stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The features of the first STEM bytes of each word, marks before it left out."""
    a = starts.copy()
    inner = _KINDS[1] | _KINDS[2]
    while len(go := np.flatnonzero((a < ends) & ~inner[data[np.minimum(a, max(0, len(data) - 1))]])):
        a[go] += 1
    x = np.zeros(len(a), np.uint64)
    for j in range(STEM):
        at = a + j
        byte = np.where(at < ends, data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint64)
        byte = np.where((byte >= 0x41) & (byte <= 0x5A), byte + np.uint64(32), byte)
        x = (x << np.uint64(8)) | byte
    return (mix(x ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(64 - BITS)).astype(np.int64)


_NAMES: dict[tuple, int] = {}


def _name(x: tuple) -> int:
    v = np.uint64(int.from_bytes(hashlib.blake2b(f"{x[0]}={min(x[1], 60)}".encode(), digest_size=8).digest(), "little"))
    return int(mix(np.array([v ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))[0] >> np.uint64(64 - BITS))


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of the words without marks at their ends; only ``which`` have any."""
    some = np.flatnonzero(which)
    out = h.copy()
    if not len(some):
        return out
    inner = _KINDS[1] | _KINDS[2]
    a, b = starts[some].copy(), ends[some].copy()
    while len(go := np.flatnonzero((a < b) & ~inner[data[np.minimum(a, len(data) - 1)]])):
        a[go] += 1
    while len(go := np.flatnonzero((a < b) & ~inner[data[b - 1]])):
        b[go] -= 1
    # Rehash what is left as a text of its own: the words, one after another, with spaces between.
    keep = b > a
    size = np.where(keep, b - a, 0) + 1
    to = np.cumsum(size)
    flat = np.full(int(to[-1]), 0x20, np.uint8)
    begin = to - size
    n = np.where(keep, b - a, 0)
    src = np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    dst = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    flat[dst] = data[src]
    text = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(flat)], np.int32)), pa.py_buffer(flat)])
    new, _, _, _ = words(text)
    out[some[keep]] = new
    return out


class Model:
    """Weights of all features and the thresholds between grades, ascending."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def above(self, features: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) of each document, a column for each k."""
        score = np.array([self.weights[f].sum() for f in features])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _telling(features: list[np.ndarray], grades: np.ndarray, n_grades: int, least: float) -> np.ndarray:
    """Features whose chi-square over the grades is above ``least``: others would only add noise to long texts."""
    n = np.array([np.count_nonzero(grades == k) for k in range(n_grades)], float)[:, None]
    seen = np.array([np.bincount(np.concatenate([np.zeros(0, np.int64), *(f for f, g in zip(features, grades, strict=True) if g == k)]).astype(np.int64), minlength=1 << BITS) for k in range(n_grades)], float)
    share = seen.sum(0) / len(grades)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = ((seen - n * share) ** 2 / (n * share) + (seen - n * share) ** 2 / (n * (1 - share))).sum(0)
    return np.nan_to_num(chi, nan=0.0, posinf=0.0) > least


def fit_model(features: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 20, step: float = 0.1, decay: float = 1e-3, batch: int = 64) -> Model:
    """Maximum likelihood by adaptive gradient steps over shuffled small batches. Thresholds stay in order.

    Texts with equal features count once. A feature's value falls with its frequency. Small samples
    get more rounds, ``STEPS`` steps at least.
    """
    first = list({f.tobytes(): i for i, f in reversed(list(enumerate(features)))}.values())[::-1]
    features, grades = [features[i] for i in first], grades[first]
    telling = _telling(features, grades, n_grades, max(15.0, len(grades) / 80))
    features = [f[telling[f]] for f in features]
    rng = np.random.Generator(np.random.PCG64(7))
    w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    frequency = np.bincount(np.concatenate([np.zeros(0, np.int64), *features]).astype(np.int64), minlength=1 << BITS)
    value = np.sqrt(np.minimum(1, len(grades) * 0.1 / np.maximum(frequency, 1))) * telling
    share = np.array([(np.count_nonzero(grades > k) + 1) / (len(grades) + 2) for k in range(n_grades - 1)])
    t = np.maximum.accumulate(np.log((1 - share) / share))
    gt = np.full(n_grades - 1, 1.0)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(max(rounds, -(-STEPS * batch // max(1, len(grades))))):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            flat = np.concatenate([features[i] for i in rows]).astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), [len(features[i]) for i in rows])
            x = value[flat]
            score = np.bincount(owner, w[flat] * x, len(rows))
            g = grades[rows]
            # P(g) = F(t_g - s) - F(t_(g-1) - s); slopes of its logarithm by both thresholds.
            up = np.where(g < n_grades - 1, sigmoid(np.append(t, 0)[np.minimum(g, n_grades - 2)] - score), 1.0)
            low = np.where(g > 0, sigmoid(t[np.maximum(g - 1, 0)] - score), 0.0)
            p = np.maximum(up - low, 1e-9)
            du, dl = up * (1 - up) / p, low * (1 - low) / p
            push = np.bincount(flat, (du - dl)[owner] * x, 1 << BITS)
            used = np.unique(flat)
            push[used] += decay * w[used]
            gw[used] += push[used] ** 2
            w[used] -= step * push[used] / np.sqrt(gw[used])
            dt = np.bincount(np.minimum(g, n_grades - 2), -du * (g < n_grades - 1), n_grades - 1) + np.bincount(np.maximum(g - 1, 0), dl * (g > 0), n_grades - 1)
            gt += dt**2
            t = np.maximum.accumulate(t - step * dt / np.sqrt(gt))
    return Model(w * value, t)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE) -> Model:
    """The model of ``docs(doc_id, text)`` and ``ratings(doc_id, grade)``, from ``sample`` rated documents at most."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")  # of ``sample`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                f = [x.astype(np.int32).tobytes() for x in _features(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(f, pa.binary())], ["doc_id", "grade", "features"])

    found = sorted(rows.select("doc_id", F.col("grade").cast("long").alias("grade"), "text").mapInArrow(run, "doc_id long, grade long, features binary").collect(), key=lambda r: (r.doc_id, bytes(r.features)))
    if not found:
        return Model(np.zeros(1 << BITS), np.linspace(-1, 1, n_grades - 1))
    return fit_model([np.frombuffer(r.features, np.int32) for r in found], np.array([r.grade for r in found]), n_grades)


def grade(docs: DataFrame, model: Model, good: int, least: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, expected_grade, tail_probability, kept)``, one row for each row.

    ``tail_probability`` is that of the grade ``good`` or a better one, and a document is kept if it
    is ``least`` or more. A null, empty or wordless text is graded by its lack of words. Repeated
    rows are graded alike; extra columns don't matter; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                above = model.above(_features(part.column("text")))
                tail = above[:, good - 1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(above.sum(1)), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def rating(quality: Column, toxic: Column) -> Column:
    """The grade of two marks of 0 or 1: 0 poor, 1 fair but toxic, 2 good. An unknown mark gives no grade."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)
