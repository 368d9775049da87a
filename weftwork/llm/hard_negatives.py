"""Hard negatives for anchors, by product quantisation with stored residual norms.

Index. A vector is cut into parts; each part is stored as the number of its nearest codeword and the
norm of what the codeword leaves. Codewords are fitted on a bounded sample, but every row is indexed.

Bounds. An anchor's product with a codeword is looked up in a table, and its product with what is
left of a part is, by Cauchy and Schwarz, no larger than the product of their norms. So each score
lies between the sum of looked-up products minus and plus a bound, whatever the codewords are: poor
ones cost time, never a row.

Search. All rows are held against blocks of anchors. A task keeps the best exact scores that it has
seen for each anchor; a row is a candidate only while its upper bound reaches the last of these, and
candidates are scored again in integers. The first pass finds positives. The second one knows their
scores and so the window of each negative: rows whose bounds miss every window are out, the others
are scored again, and each window is completed from exact scores alone. Only a few rows for each
anchor and task are shuffled, and ranks are pruned before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import materialize

#: Rows, and numbers, of the sample on which codewords are fitted, at most; parts of a vector and codewords of a part.
SAMPLE, SAMPLE_NUMBERS, PARTS, CODEWORDS = 20_000, 2_000_000, 16, 256
#: Bytes of the anchors of one pass; rows of the index in one file, about; anchors and rows of a block.
ANCHOR_BYTES, FILE_ROWS, ANCHORS, ROWS = 16 << 20, 50_000, 1024, 512
_LONG = 2**63 - 1

Codebook = list[tuple[int, int, np.ndarray]]


def fit_codebook(x: np.ndarray, parts: int = PARTS, codewords: int = CODEWORDS, rounds: int = 8) -> Codebook:
    """``[(first, end, codewords)]`` of each part, by k-means; without rows the one codeword is zero."""
    out = []
    dim = x.shape[1]
    edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        p = x[:, a:b]
        distinct = np.unique(p, axis=0)
        if not len(distinct):
            distinct = np.zeros((1, b - a))
        c = distinct[np.linspace(0, len(distinct) - 1, min(codewords, len(distinct))).astype(int)].astype(np.float64)
        for _ in range(rounds if len(distinct) > len(c) else 0):
            near = _nearest(p, c)
            sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
            np.add.at(sums, near, p)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append((int(a), int(b), c))
    return out


def _nearest(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    norm = (c * c).sum(1)
    return np.concatenate([np.argmin(norm - 2 * (p[i : i + 4096] @ c.T), axis=1) for i in range(0, len(p), 4096)] or [np.zeros(0, int)])


def encode(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of what they leave, rounded up), a column for each part."""
    codes, left = np.zeros((len(x), len(book)), np.uint8), np.zeros((len(x), len(book)))
    for m, (a, b, c) in enumerate(book):
        codes[:, m] = _nearest(x[:, a:b], c)
        left[:, m] = np.linalg.norm(x[:, a:b] - c[codes[:, m]], axis=1)
    return codes, np.nextafter(left.astype(np.float32), np.float32(np.inf))


class Tables:
    """The products of anchors with all codewords; sums of them are looked up for rows."""

    def __init__(self, anchors: np.ndarray, book: Codebook) -> None:
        # Single precision holds sums of moderate products to a share of 2e-6 of the largest, which is added to the bound.
        small = max(np.abs(anchors).max(initial=0), max(np.abs(c).max(initial=0) for _, _, c in book)) < 1e9
        kind, share = (np.float32, 2e-6) if small else (np.float64, 1e-13)
        self.of = [np.ascontiguousarray((c @ anchors[:, a:b].T).astype(kind)) for a, b, c in book]
        self.norms = np.stack([np.linalg.norm(anchors[:, a:b], axis=1) for a, b, _ in book]).astype(kind)
        self.more = share * max(4, len(book)) * sum(np.abs(t).max(0).astype(np.float64) for t in self.of)
        self.share = 1 + 4 * share * len(book)

    def bounds(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of looked-up products, bounds of their error), a row for each indexed row, a column for each anchor."""
        total = self.of[0][codes[:, 0]]
        for m in range(1, len(self.of)):
            total += self.of[m][codes[:, m]]
        error = left.astype(self.norms.dtype) @ self.norms
        error *= self.norms.dtype.type(self.share)
        error += (self.more * (1 + 1e-6)).astype(self.norms.dtype)
        return total, error


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products of pairs of integer vectors; those beyond 64 bits are the nearest of 64 bits."""
    out = np.zeros(len(anchors), np.int64)
    for i in range(0, len(anchors), 1 << 16):
        a, b = anchors[i : i + (1 << 16)], rows[i : i + (1 << 16)]
        largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
        if largest < 2.0**62:
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", a, b)
        else:
            out[i : i + (1 << 16)] = [max(-_LONG, min(_LONG, sum(x * y for x, y in zip(p, q, strict=True)))) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    return out


class _Best:
    """The first ``k`` of the pairs of each of ``n`` groups: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: Of groups that have ``k``, the last score; of others the least there is.
        self.last = np.full(n, -np.inf)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.zeros(self.n, bool)
        touched[group] = True
        again = touched[self.group]
        g = np.concatenate([self.group[again], group])
        s = np.concatenate([self.score[again], score])
        i = np.concatenate([self.id[again], ids])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
        full = rank == self.k - 1
        # A double may lie above the integer it stands for, by less than this.
        self.last[g[full]] = s[full] - 1 - np.abs(s[full].astype(np.float64)) * 1e-15
        top = rank < self.k
        self.group = np.concatenate([self.group[~again], g[top]])
        self.score = np.concatenate([self.score[~again], s[top]])
        self.id = np.concatenate([self.id[~again], i[top]])


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of each column; minus infinity where there are fewer."""
    return np.partition(x, len(x) - k, axis=0)[len(x) - k] if len(x) >= k else np.full(x.shape[1], -np.inf)


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(frames: Iterator[pd.DataFrame], anchors: dict, books: dict[int, Codebook]) -> Iterator[tuple[int, int, int, Block]]:
    """(dim, the first and the end of some anchors, (ids, labels, vectors, sums, errors) of some rows)."""
    for f in frames:
        for dim, part in f.groupby("dim"):
            if dim not in anchors:
                continue
            n = len(part)
            codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(n, -1)
            left = np.frombuffer(b"".join(part["norms"]), np.float32).reshape(n, -1)
            v = np.frombuffer(b"".join(part["v"]), np.int64).reshape(n, -1)
            ids, labels = part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
            a = anchors[dim][2]
            for at in range(0, len(a), ANCHORS):
                tables = Tables(a[at : at + ANCHORS].astype(np.float64), books[int(dim)])
                for i in range(0, n, ROWS):
                    j = slice(i, i + ROWS)
                    yield int(dim), at, min(len(a), at + ANCHORS), (ids[j], labels[j], v[j], *tables.bounds(codes[j], left[j]))


def _positives(sent, books: dict[int, Codebook], k: int) -> Callable:
    """``sent``: a broadcast of {dim: (ids, labels, vectors)}."""

    def run(frames):
        anchors = sent.value
        best = {d: _Best(len(a[0]), k) for d, a in anchors.items()}
        for d, at, to, (ids, labels, v, total, error) in _blocks(frames, anchors, books):
            a_ids, a_labels, a = (x[at:to] for x in anchors[d])
            same = (labels[:, None] == a_labels) & (ids[:, None] != a_ids)
            least = best[d].last[at:to].copy()
            new = np.flatnonzero(np.isinf(least))
            if len(new):
                least[new] = _kth(np.where(same[:, new], total[:, new] - error[:, new], -np.inf), k)
            total += error
            j, i = np.nonzero(same & (total >= least))
            best[d].add(at + i, scores(a[i], v[j]), ids[j])
        for d, b in best.items():
            yield pd.DataFrame({"anchor_id": anchors[d][0][b.group], "positive_id": b.id, "positive_score": b.score})

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The integers ``s`` with ``low * score <= 100 * s <= high * score``, as the first and the last."""
    return -((-low * score) // 100), (high * score) // 100


def _negatives(sent, sent_windows, books: dict[int, Codebook], k: int) -> Callable:
    """``sent_windows``: a broadcast of {dim: (anchor's place, number of its window, positive, its score, first, last)}."""

    def run(frames):
        windows = sent_windows.value
        anchors = {d: a for d, a in sent.value.items() if d in windows}
        best = {d: _Best(len(w[0]), k) for d, w in windows.items()}
        for d, at, to, (ids, labels, v, total, error) in _blocks(frames, anchors, books):
            _, a_labels, a = (x[at:to] for x in anchors[d])
            of, nth, _, _, low, high = windows[d]
            inside = np.flatnonzero((of >= at) & (of < to))
            # Of each anchor, what the least demanding of its windows asks for; doubles of integers lie within a share of 1e-15.
            reach = np.maximum(low.astype(np.float64) - np.abs(low) * 1e-15 - 1, best[d].last)
            least, most = np.full(to - at, np.inf), np.full(to - at, -np.inf)
            np.minimum.at(least, of[inside] - at, reach[inside])
            np.maximum.at(most, of[inside] - at, high[inside] + np.abs(high[inside]) * 1e-15 + 1)
            j, i = np.nonzero((labels[:, None] != a_labels) & (total + error >= least) & (total - error <= most))
            s = scores(a[i], v[j])
            for slot in range(int(nth[inside].max(initial=-1)) + 1):
                w = inside[nth[inside] == slot]
                place = np.full(to - at, -1)
                place[of[w] - at] = w
                g = place[i]
                fits = g >= 0
                fits[fits] = (s[fits] >= low[g[fits]]) & (s[fits] <= high[g[fits]]) & (s[fits] >= best[d].last[g[fits]])
                best[d].add(g[fits], s[fits], ids[j[fits]])
        for d, b in best.items():
            of, _, positive, score, _, _ = windows[d]
            yield pd.DataFrame({"anchor_id": anchors[d][0][of[b.group]], "positive_id": positive[b.group], "positive_score": score[b.group], "negative_id": b.id, "negative_score": b.score})

    return run


def _first(df: DataFrame, by: list[str], score: str, ids: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(ids))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def index(vectors: DataFrame, scale: int = 256) -> tuple[DataFrame, dict[int, Codebook]]:
    """``vectors(vec_id, label, embedding)`` -> the rows that take part, as ``(vec_id, label, dim, codes, norms, v)``
    with ``v`` the integers ``floor(scale * x)``, and the codebook of each length. Of rows with one vec_id the one with
    the smallest label, then vector, takes part."""
    x = F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where("vec_id is not null and label is not null and x is not null").where((F.size("x") > 0) & fine)
    files = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // FILE_ROWS))
    v = v.repartition(files, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    v = materialize(v.select("vec_id", "r.label", F.size("r.x").alias("dim"), F.transform("r.x", lambda c: F.floor(c * scale)).alias("x")), "negative-rows")
    books = {}
    for r in v.groupBy("dim").count().collect():
        some = v.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // r["dim"])))
        books[r["dim"]] = fit_codebook(np.array(some.select("x").toPandas()["x"].tolist(), np.float64))

    def write(frames):
        for f in frames:
            for dim, part in f.groupby("dim"):
                rows = np.array(part["x"].tolist(), np.int64)
                codes, left = encode(rows.astype(np.float64), books[int(dim)])
                yield part[["vec_id", "label", "dim"]].assign(codes=[c.tobytes() for c in codes], norms=[n.tobytes() for n in left], v=[r.tobytes() for r in rows])

    return materialize(v.mapInPandas(write, "vec_id long, label long, dim int, codes binary, norms binary, v binary"), "negative-index"), books


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``vectors(vec_id, label, embedding, ...)`` -> ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A score is the product of two rows' integers ``floor(scale * x)``; higher ones come first, then smaller ids. Anchors
    are the rows whose vec_id ``every`` divides. An anchor's positives are its first ``positives`` other rows of its
    label. For each, the first ``negatives`` rows of another label are returned with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``, ranked from 1; fewer if there are fewer.

    Rows whose vec_id, label or vector is null, or whose vector is empty or has a null or a value that isn't finite, take
    no part. Of rows with one vec_id the one with the smallest label, then vector, takes part. Rows whose vectors
    differ in length aren't compared. Integers and scores beyond 64 bits are the nearest of 64 bits. An empty table
    gives an empty result; extra columns don't matter.

    Anchors go to the tasks in passes of ``ANCHOR_BYTES``, so that neither they nor the driver hold more of them.
    """
    spark = vectors.sparkSession
    rows, books = index(vectors, scale)
    anchors = rows.where(F.col("vec_id") % every == 0)
    size = anchors.agg(F.coalesce(F.sum(F.length("v")), F.lit(0))).first()[0]
    passes = max(1, -(-size // ANCHOR_BYTES))
    found = None
    for n in range(passes):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n).select("vec_id", "label", "dim", "v").orderBy("vec_id").toPandas()
        known = {int(d): (p["vec_id"].to_numpy(np.int64), p["label"].to_numpy(np.int64), np.frombuffer(b"".join(p["v"]), np.int64).reshape(len(p), -1)) for d, p in mine.groupby("dim")}
        sent = spark.sparkContext.broadcast(known)
        near = rows.mapInPandas(_positives(sent, books, positives), "anchor_id long, positive_id long, positive_score long")
        near = materialize(_first(near, ["anchor_id"], "positive_score", "positive_id", positives, "nth"), "negative-positives")
        pos = near.orderBy("anchor_id", "nth").toPandas()
        windows = {}
        for d, (ids, _, _) in known.items():
            p = pos[np.isin(pos["anchor_id"], ids)]
            if len(p):
                ends = np.array([window(s, low, high) for s in p["positive_score"].tolist()], np.int64).reshape(-1, 2)
                windows[d] = (np.searchsorted(ids, p["anchor_id"]), p["nth"].to_numpy(np.int64) - 1, p["positive_id"].to_numpy(np.int64), p["positive_score"].to_numpy(np.int64), ends[:, 0], ends[:, 1])
        hard = rows.mapInPandas(_negatives(sent, spark.sparkContext.broadcast(windows), books, negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        hard = materialize(_first(hard, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives, "rank"), "negatives")
        found = hard if found is None else found.unionByName(hard)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
