"""The operators on pairs, against brute force."""

import collections
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import ngram_join, vector_join
from weftwork.llm.components import components
from weftwork.llm.decontaminate import contaminated
from weftwork.llm.ngram_join import jaccard_components
from weftwork.llm.textbatch import shingle_sets
from weftwork.llm.vector_join import audit, vector_links


def word_sets(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, width, num, den):
    s = word_sets(rows, width)
    ids = list(s)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    r = roots(ids, edges)
    return {i: (len(s[i]), r[i]) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [text(rng.randint(1, 120)) for _ in range(80)]
    for base in list(rows[:25]) + [text(60)] * 60:
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    passage = text(50)
    rows += [f"{text(rng.randint(2, 30))} {passage}" for _ in range(40)]
    rows += ["", None, " \n\t", "one", "ONE", "one two", "One  Two\n", "a b c", "c b a", "x " * 500, "x " * 501, "É é", "é é"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 9, 10)])
def test_jaccard_equals_brute_force(spark, width, num, den):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, node string, n long")
    for options in ({}, {"frequent_from": 5, "combine_below": 20}, {"frequent_from": 3, "extend": 2}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(d, width, num, den, **options).collect()}
        assert got == brute(rows, width, num, den), options


def test_jaccard_in_passes_by_slices_of_keys(spark, monkeypatch):
    rows = corpus(2)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    written = collections.defaultdict(list)

    def noted(df, name, *by):
        written[name].append(materialize(df, name, *by))
        if name in ("ngram-shared", "ngram-met"):
            written[f"{name}-rows"].append(written[name][-1].collect())
        return written[name][-1]

    materialize = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", noted)
    monkeypatch.setattr(ngram_join, "PASS_ROWS", 1000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(d, 3, 9, 10, frequent_from=3, combine_below=20).collect()}
    assert got == brute(rows, 3, 9, 10)
    assert len(written["ngram-shared"]) == len(written["ngram-met"]) == ngram_join.PASSES
    assert [{r.key % ngram_join.PASSES for r in part} for part in written["ngram-shared-rows"]] == [{k} for k in range(ngram_join.PASSES)]
    for name in ("ngram-index", "ngram-shared", "ngram-open", "ngram-met"):
        assert not any(os.path.exists(x.stored_at.removeprefix("file://")) for x in written[name]), name


def test_jaccard_of_repeated_and_null_rows(spark):
    d = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None)], "doc_id long, text string")
    got = sorted(jaccard_components(d, 3, 9, 10).collect(), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2)], key=str)
    assert jaccard_components(d.limit(0), 3, 9, 10).count() == 0


def test_shingles_of_batches():
    import pyarrow as pa

    texts = ["A b c", "a B  c\nd", "", None, "é x"]
    a, b, c, d, e = shingle_sets(pa.array(texts), 3)
    assert len(a) == 1 and len(b) == 2 and a[0] in b and len(c) == len(d) == 0 and len(e) == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    want = roots({n for e in edges for n in e}, edges)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(3000)]
    item = [rng.choice(words) for _ in range(40)]
    swapped = [w if i % 5 else "other" for i, w in enumerate(item)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    docs = [
        (1, " ".join(noise(50) + item + noise(9))), (2, " ".join(noise(20) + swapped + noise(20))), (3, " ".join(noise(500))), (4, " ".join(item[10:30]).upper()), (5, " ".join(noise(9) + item[:8] + noise(9))),
        (6, ""), (7, None), (8, " ".join(noise(20_000) + item)), (1, " ".join(item)),
    ]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    t = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, "too short"), (12, None), (13, "")], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in contaminated(d, t).collect())
    assert got == {(1, 10): 2, (2, 10): 1, (4, 10): 1, (8, 10): 1}
    whole = next(r for r in contaminated(d, t).collect() if r.doc_id == 8)
    assert (whole.doc_word, whole.item_word, whole.n_words, whole.n_equal) == (20_000, 0, 40, 40)
    assert contaminated(d.limit(0), t).count() == 0 and contaminated(d, t.limit(0)).count() == 0


def test_decontamination_by_a_join_gives_the_same(spark, monkeypatch):
    from weftwork.llm import decontaminate

    rng = random.Random(6)
    noise = lambda n: [f"n{rng.randrange(300)}" for _ in range(n)]
    items = [[f"u{rng.randrange(60)}" for _ in range(rng.choice([3, 7, 9, 12, 13, 20, 60]))] for _ in range(60)]
    docs = []
    for w in items + items[:20]:
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "x"
        docs.append(" ".join(noise(rng.randint(0, 9)) + w + noise(rng.randint(0, 9))))
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*docs, "", None, docs[0]])] + [(None, docs[30]), (5, docs[5])], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(None, " ".join(items[3])), (4, " ".join(items[4])), (4, " ".join(items[9])), (70, None)], "item_id long, text string")
    one = sorted(map(str, contaminated(d, t).collect()))
    monkeypatch.setattr(decontaminate, "PROBE_WORDS", 0)
    assert sorted(map(str, contaminated(d, t).collect())) == one and len(one) > 40
    assert contaminated(d.limit(0), t).count() == 0

    # Against every diagonal of every pair, for items long enough for the masks.
    want = set()
    for i, text in enumerate(docs):
        h = text.split()
        for k, w in enumerate(items):
            if len(w) < 7:
                continue
            for shift in range(-len(w), len(h)):
                same = [h[shift + j] == w[j] for j in range(len(w)) if 0 <= shift + j < len(h)]
                if len(w) < 13:
                    hit = len(same) == len(w) and all(same)
                else:
                    hit = any(5 * sum(same[a:b]) >= 4 * (b - a) for a in range(len(same)) for b in range(a + 13, len(same) + 1))
                if hit:
                    want.add((i, k))
    assert {(r.doc_id, r.item_id) for r in contaminated(d.where(f"doc_id < {len(docs)}"), t.where("item_id is not null and item_id < 60").dropDuplicates(["item_id"]).where("item_id <> 4")).collect()} == {x for x in want if x[1] != 4}


def test_decontamination_wherever_words_are_replaced(spark):
    rng = random.Random(7)
    items, docs = [], []
    for n, replaced in [(13, 1), (13, 2), (15, 2), (15, 3), (20, 4), (25, 5), (41, 8)]:
        for _ in range(40):
            k = len(items)
            item = [f"i{k}-{j}" for j in range(n)]
            bad = rng.sample(range(n), replaced)
            items.append((k, " ".join(item)))
            docs.append((k, " ".join(["before"] * rng.randint(0, 3) + [f"x{j}" if j in bad else w for j, w in enumerate(item)] + ["after"] * rng.randint(0, 3))))
    items += [(1000, " ".join(f"m{j}" for j in range(13))), (1001, " ".join(f"t{j}" for j in range(13)))]
    docs += [(1000, " ".join(f"m{j}" if j not in (2, 6, 10) else "other" for j in range(13))), (1001, " ".join(f"t{j}" for j in range(12)))]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in contaminated(d, t).collect()}
    want = {(k, k): (n, n - m) for i, (n, m) in enumerate([(13, 1), (13, 2), (15, 2), (15, 3), (20, 4), (25, 5), (41, 8)]) for k in range(40 * i, 40 * i + 40)}
    assert got == want
    with pytest.raises(ValueError, match="masks"):
        contaminated(d, t, least=12)


def vectors(n=900, dim=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 9):
        x[i + 1] = x[i] + 0.01 * rng.normal(size=dim)
        x[i + 2] = x[i]
    x[700:760] = x[700] + 0.05 * rng.normal(size=(60, dim))
    return x.astype(np.float32)


def test_vectors_against_brute_force(spark, monkeypatch):
    from weftwork.llm import ngram_join, vector_join

    x = vectors()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    rows = [(i, v.tolist(), "no label") for i, v in enumerate(x)]
    odd = [(2000, None, ""), (2001, [0.0] * 16, ""), (2002, [float("nan")] * 16, ""), (2003, [1.0] * 15 + [None], ""), (2004, [], ""), (None, x[0].tolist(), ""), (2005, [float("inf")] * 16, ""), (0, x[0].tolist(), "")]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rep string")
    edges = list(zip(*map(np.ndarray.tolist, np.nonzero(s)), strict=True))
    root = roots(range(len(x)), edges)
    for region, shard, centroids in ((12_000, 600, 512), (12_000, 100, 512), (200, 60, 512), (200, 60, 3)):
        monkeypatch.setattr(vector_join, "REGION", region)
        monkeypatch.setattr(vector_join, "SHARD", shard)
        monkeypatch.setattr(vector_join, "CENTROIDS", centroids)
        links = vector_links(d)
        got = links.collect()
        assert len(got) == len(rows) + len(odd)
        n = {r.vec_id: r.n_links for r in got}
        found = sum(min(n[i], int(s[i].sum())) for i in range(len(x)))
        assert found >= 0.97 * s.sum() and all(n[i] <= s[i].sum() for i in range(len(x)))
        assert np.mean([next(r.component_id for r in got if r.vec_id == i) == root[i] for i in range(0, 300, 3)]) >= 0.95
        assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id is None or r.vec_id >= 2000)
    assert audit(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string"), links.where("vec_id < 2000").dropDuplicates(["vec_id"])) >= 0.9
    assert vector_links(d.limit(0)).count() == 0


def test_vectors_that_cannot_be_divided(spark, monkeypatch):
    from weftwork.llm import ngram_join, vector_join

    monkeypatch.setattr(vector_join, "REGION", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1, 16)) + 0.02 * rng.normal(size=(350, 16))
    x[:50] = 10 * rng.normal(size=(50, 16))
    x[50] *= 1e200  # a direction like any other
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    got = vector_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    n = {r.vec_id: r.n_links for r in got}
    assert all(n[i] <= s[i].sum() - 1 for i in n) and sum(n.values()) >= 0.97 * (s.sum() - len(x)) and s.sum() > 80_000
    assert {r.component_id for r in got if r.vec_id >= 50} == {50}


@pytest.mark.parametrize("centroids", [512, 8])
@pytest.mark.parametrize("clusters", [10, 0])
def test_vectors_in_hundreds_of_regions(spark, monkeypatch, clusters, centroids):
    from weftwork.llm import ngram_join, vector_join

    monkeypatch.setattr(vector_join, "REGION", 100)
    monkeypatch.setattr(vector_join, "AIM", 0.2)
    monkeypatch.setattr(vector_join, "CENTROIDS", centroids)
    monkeypatch.setattr(vector_join, "SHARD", 40)
    rng = np.random.default_rng(5)
    n, dim = 4000, 32
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # A pair of a cosine a little over 0.95 for each two vectors.
    side = rng.normal(size=(n // 2, dim))
    side -= (side * x[::2]).sum(1, keepdims=True) * x[::2]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.96, (n // 2, 1))
    x[1::2] = cosine * x[::2] + np.sqrt(1 - cosine**2) * side
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    got = {r.vec_id: r.n_links for r in vector_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= s[i].sum() for i in range(n)) and sum(got.values()) >= 0.985 * s.sum()


def test_two_thousand_regions_plan(spark, monkeypatch):
    """Cells too large, by the thousand, are one join: expressions over them would not plan."""
    monkeypatch.setattr(vector_join, "REGION", 100)
    monkeypatch.setattr(vector_join, "AIM", 0.01)
    n, dim, cells = 4000, 3, {}
    rng = np.random.default_rng(0)
    nodes = spark.createDataFrame([(int(i), 1, x.tolist()) for i, x in enumerate(rng.normal(size=(n, dim)))], "rep long, copies long, v array<double>")

    def no_cells(*_):  # every vector is in its nearest cell, and each of 2,000 cells is as large as its parent: all are cut into blocks
        def run(frames):
            for f in frames:
                yield f.loc[f.index.repeat(110)].assign(parent=0, cell=1 + f["rep"].repeat(110) % 2000, query=True)[list(vector_join._COLUMNS)]

        return run

    monkeypatch.setattr(vector_join, "_deal", no_cells)
    monkeypatch.setattr(vector_join, "_margin", lambda *_: 0.0)
    monkeypatch.setattr(vector_join, "LEVELS", 1)
    for r in vector_join._regions(nodes, dim, 0.95).groupBy("cell", "blocks").count().collect():
        cells[r["cell"]] = (r["blocks"], r["count"])
    assert len(cells) == 2000 and set(cells.values()) == {(5, 220)}


def test_sampled_vectors_without_pairs_in_a_batch(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x[1] = x[0] + 1e-3  # one pair, in the first of two chunks
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, v array<double>").coalesce(1)
    sample = nodes.where("rep < 200").toPandas()
    a, b, cell = vector_join._pairs(nodes, sample, 64, 0.95)
    assert len(a) == len(b) == len(cell) and len(a) >= 2 * 200
    assert (np.einsum("ij,ij->i", a, b) >= 0.95 - 1e-9).all()
