import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork.operators import corpus, crm, export, labels, market, merge, ordering, sampling, signals
from weftwork.operators.dedupe import dedupe, exact_dedupe, near_dedupe, survivors, with_content_hash
from weftwork.plans import findings
from weftwork.sources import raw

LONG = " ".join(f"word{i} stays in place" for i in range(11))


def docs(spark, rows):
    base = dt.datetime(2024, 1, 1)
    rows = [(s, e, b, base + dt.timedelta(days=n)) for s, e, b, n in rows]
    d = spark.createDataFrame(rows, "source string, external_id string, body string, posted_at timestamp").withColumn("fetched_at", F.col("posted_at"))
    return with_content_hash(d)


def test_exact_keeps_the_earliest(spark):
    kept, drops = exact_dedupe(docs(spark, [("s", "b", "same text", 2), ("s", "a", "Same  text", 1), ("s", "c", "other", 3)]))
    assert {r.external_id for r in kept.collect()} == {"a", "c"}
    assert [(r.dropped_id, r.kept_key, r.reason) for r in drops.collect()] == [("b", "a", "exact")]


def test_stored_hash_is_kept_without_a_drop(spark):
    d = docs(spark, [("s", "a", "same", 1), ("s", "b", "same", 2)])
    kept, drops = exact_dedupe(d, d.select("content_hash").limit(1))
    assert kept.count() == 1 and drops.count() == 0


def test_near(spark):
    d = docs(spark, [("s", "a", LONG, 1), ("s", "b", LONG + " edit: typo", 2), ("s", "c", "short text", 3), ("s", "d", "short text!", 4), ("s", "e", " ".join(reversed(LONG.split())), 5)])
    kept, drops = dedupe(d)
    assert {r.external_id for r in kept.collect()} == {"a", "c", "d", "e"}
    (x,) = drops.collect()
    assert (x.dropped_id, x.kept_key, x.reason) == ("b", "a", "near") and x.similarity >= 0.9


def test_near_against_stored(spark):
    stored = docs(spark, [("s", "x", LONG, 0)]).select("content_hash", "body")
    kept, drops = near_dedupe(docs(spark, [("s", "a", LONG + " thanks", 1)]), stored)
    assert kept.count() == 0 and drops.first().kept_key.startswith("db:")


def test_survivors_equal_the_sequential_scan(spark):
    rng = random.Random(3)
    n = 40
    edges = {(a, b): rng.choice([0.9, 0.95, 0.99]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}
    fixed = {i for i in range(n) if rng.random() < 0.1}
    kept = set()
    for v in range(n):
        if v in fixed or not any((u, v) in edges for u in kept):
            kept.add(v)
    nodes = spark.createDataFrame([(i, i, i in fixed) for i in range(n)], "id long, pos long, fixed boolean")
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, similarity double")
    k, drops = survivors(nodes, pairs)
    assert {r.id for r in k.collect()} == kept
    for r in drops.collect():
        assert r.kept_id in kept and r.similarity == max(edges[u, r.id] for u in kept if (u, r.id) in edges)


def test_merge_and_diff(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, text string, score int")
    new = spark.createDataFrame([(2, "changed", 5), (2, "changed", 7), (3, "c", 1)], "k int, text string, score int")
    m = {r.k: (r.text, r.score) for r in merge.merge(old, new, ["k"], ["score"], [F.col("score")]).collect()}
    assert m == {1: ("a", 1), 2: ("b", 7), 3: ("c", 1)}
    assert {(r.k, r.change) for r in merge.diff(old, new, ["k"]).collect()} == {(1, "removed"), (3, "added")}
    assert merge.equal(old, old) and not merge.equal(old, new)
    assert {r.k for r in merge.replace_scope(old, new, ["k"]).collect()} == {1, 2, 3}


def test_series_is_filled(spark):
    e = spark.createDataFrame([("r", dt.datetime(2024, 1, 3)), ("r", dt.datetime(2024, 1, 9)), ("r", dt.datetime(2024, 3, 1))], "repo string, ts timestamp")
    got = [(r.new, r.cumulative) for r in signals.filled_series(e, ["repo"], F.col("ts")).orderBy("period_start").collect()]
    assert got == [(2, 2), (0, 2), (1, 3)]


def test_velocity_floor(spark):
    e = spark.createDataFrame([("r", dt.datetime(2023, 12, 3), dt.datetime(2024, 2, 9))], "repo string, a timestamp, b timestamp")
    got = signals.velocity(e, ["repo"], F.col("a"), F.col("b"), F.lit("2024-01-15").cast("date")).collect()
    assert [(r.metric, r.value) for r in got] == [("closed", 1.0)]


def _population(spark, n=800):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hn", "se", "dev"]), rng.randint(25, 200), sorted(rng.sample(["x", "y", "z"], rng.randint(1, 2))), rng.random() < 0.4, rng.randint(0, 2)) for i in range(n)]
    return spark.createDataFrame([*rows, (9999, "hn", 3, ["x"], True, 2)], "id long, source string, words int, entities array<string>, flag boolean, prio int")


def test_draw(spark):
    quotas = {"hn": 60, "se": 45, "dev": 45}
    p = _population(spark)
    a = sampling.draw(p, quotas, 150, 110, {"x": 12, "y": 10}).toPandas()
    b = sampling.draw(p.repartition(7), quotas, 150, 110, {"x": 12, "y": 10}).toPandas()
    assert len(a) == 150 and a.groupby("source").size().to_dict() == quotas and a.flag.sum() >= 110 and 9999 not in set(a.id)
    assert sorted(a.id) == sorted(b.id)
    rest = sampling.draw(p, quotas, 150, 50, exclude=spark.createDataFrame(a[["id"]])).toPandas()
    assert not set(rest.id) & set(a.id)


def test_draw_with_a_short_source(spark):
    p = _population(spark).where("source <> 'dev' or id % 10 = 0")
    a = sampling.draw(p, {"hn": 60, "se": 45, "dev": 45}, 150, 50).toPandas()
    assert len(a) == 150 and (a.source == "dev").sum() < 45 and "shortfall_fill" in set(a.picked_for)


def test_labels(spark):
    sheet = spark.createDataFrame([(1, "a", ""), (2, "a", "b"), (3, "c", "d")], "doc_id long, draft_label string, my_label string")
    f = labels.final_labels(sheet, {"label": "label"}, {"d": "c"})
    assert {(r.doc_id, r.draft_label, r.label) for r in f.collect()} == {(1, "a", "a"), (2, "a", "b"), (3, "c", "c")}
    assert labels.agreement(f, ["label"]).first().agree == 2
    same = spark.createDataFrame([("x", "x"), ("x", "y")], "a string, b string")
    assert labels.kappa(same, "a", "b").first().kappa is None
    assert labels.kappa(same.limit(0), "a", "b").first().n in (0, None)


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "document_id long, entity string, mention_count int")
    assert corpus.entity_pairs(empty).count() == 0
    none = spark.createDataFrame([], "id long, source string, switching boolean, reason_v2 boolean")
    assert corpus.share_of_voice(none, empty, ["x"], ["s"]).count() == 0


def test_market_anchors(spark):
    p = market.assumptions(spark)
    s = market.segments(p)
    t = s.agg(F.sum("size_2025"), F.sum("size_2030")).first()
    assert s.count() == 120 and t[0] == pytest.approx(54_375_000_000) and t[1] == pytest.approx(121_329_995_074.91)
    d = {(r.input, r.direction): r.delta for r in market.sensitivity(p).collect()}
    assert d["spend_large", "low"] == pytest.approx(-20.082e9, rel=1e-3) and d["cagr_ai", "high"] == pytest.approx(3.806e9, rel=1e-3)


def test_simulation(spark):
    t = crm.generate(spark)
    assert {k: v.count() for k, v in t.items() if k != "stage_history"} == {"accounts": 1500, "opportunities": 4000, "usage_monthly": 144_000, "renewals": 1500, "releases": 192}
    assert t["opportunities"].where("(outcome = 'Won') <> (loss_reason is null)").count() == 0
    assert t["opportunities"].agg(F.avg((F.col("outcome") == "Won").cast("int"))).first()[0] == pytest.approx(0.35, abs=0.04)
    assert t["stage_history"].where("exited_at <= entered_at").count() == 0


def test_numbers_and_tiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(50), i) for i in range(400)]
    d = spark.createDataFrame(rows, "g string, x int, id int")
    got = {r.id: (r.n, r.of) for r in ordering.numbered(d, ["x", "id"], ["g"], total="of", pieces=5).collect()}
    for g in ("a", "b", None):
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    for n in (3, 10, 403):
        t = spark.range(n).select("id", ordering.tile(F.col("id"), F.lit(n), 10).alias("tile"), F.ntile(10).over(Window.orderBy("id")).alias("want"))
        assert t.where("tile <> want").isEmpty()
    assert [r.x for r in ordering.tiered(d.where("id < 30"), [F.col("x") > 40, F.col("x") < 10], "x").select("x").collect()] == sorted((x for _, x, i in rows if i < 30), key=lambda x: (0 if x > 40 else 1 if x < 10 else 2, x))
    assert [(r.g, r.x) for r in ordering.listed(d.where("id = 0").withColumn("g", F.lit("q")), "g", ["z", "q"]).collect()] == [("z", None), ("q", rows[0][1])]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, t string")
    export.write_csv(d, str(tmp_path / "c"))
    assert [(r.id, r.t) for r in raw.read_csv(spark, str(tmp_path / "c"), "id int, t string").orderBy("id").collect()] == [(1, 'a "b", c'), (2, "")]
    export.write_json(d, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"t":"a \\"b\\", c"}', '{"id":2,"t":null}']
    export.replace_tables({"x": d}, str(tmp_path / "t"))
    export.replace_tables({"x": d.limit(1)}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/x")).count() == 1
    text = export.report("R", {"part": d.orderBy("id")})
    assert text.startswith("# R\n\n## part\n\n| id | t |") and '| 2 |  |' in text and "first 1 rows" in export.to_markdown(d, 1)


def test_sources_are_touched(spark):
    old = spark.createDataFrame([("a", "x", "2024-01-01"), ("b", "y", "2024-01-01")], "name string, note string, last_run string")
    got = merge.touch_sources(old, spark.createDataFrame([("b", "z"), ("c", "w")], "name string, note string"), F.lit("2024-02-02"))
    assert sorted(map(tuple, got.collect())) == [("a", "x", "2024-01-01"), ("b", "z", "2024-02-02"), ("c", "w", "2024-02-02")]


def test_agreement_of_subsets_and_gates(spark):
    f = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "b", "b")], "doc_id int, draft_x string, x string")
    got = {(r.subset, r.field): (r.n, r.agree) for r in labels.agreement(f, ["x"], {"all": F.lit(True), "late": F.col("doc_id") > 2}).collect()}
    assert got == {("all", "x"): (4, 3), ("late", "x"): (2, 2)}
    one = spark.createDataFrame([(1, "c")], "document_id int, code string")
    assert findings.checked(one, findings.gates(one, one, ["document_id", "code"])) is one
    with pytest.raises(ValueError, match="stored"):
        findings.checked(one, findings.gates(one, one.limit(0), ["document_id", "code"]))
    assert {r.value for r in market.scenario(spark.createDataFrame([("k", 1.0, 0.5, None)], "key string, value double, low double, high double"), "low").collect()} == {0.5}


def test_market_cells_are_those_of_plain_arithmetic(spark):
    b = market.BASE
    for r in market.segments(market.assumptions(spark)).collect():
        w, d, t = (next(k for k, n in table if n == x) for table, x in ((market.WORKLOADS, r.workload), (market.DEPLOYMENTS, r.deployment), (market.TIERS, r.tier)))
        size = b[f"firms_{t}"] * b[f"adoption_{t}"] * b[f"spend_{t}"] * b[f"share_{w}"] * b[f"deploy_{d}"] * dict(market.REGIONS)[r.region]
        growth = (b[f"cagr_{w}"] + b[f"cagr_deploy_{d}"]) / 2
        assert [r[f"size_{2025 + n}"] for n in range(6)] == [round(size * (1 + growth) ** n, 2) for n in range(6)]


def test_near_pairs_in_passes_leave_little_on_disk(spark, monkeypatch, tmp_path):
    from collections import Counter

    from weftwork.operators import dedupe as module

    rng = random.Random(8)
    rows = []
    for i in range(60):
        w = [f"word{rng.randrange(300)}" for _ in range(60)]
        rows += [(4 * i + k, " ".join(w[: 60 - (k > 1)] + ["x" + str(k)] * (k == 3))) for k in range(4)]
    d = spark.createDataFrame(rows, "id long, body string")
    counts = {i: Counter(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for i, t in rows}
    dot = lambda a, b: sum(n * counts[b][g] for g, n in counts[a].items())
    want = sorted((a, b) for a in counts for b in counts if a < b and dot(a, b) >= 0.9 * (dot(a, a) * dot(b, b)) ** 0.5 - 1e-12)
    monkeypatch.setattr(module, "PASS_ROWS", 500)
    monkeypatch.setattr("weftwork.session.shared_dir", lambda _: f"file://{tmp_path}")
    got = sorted((r["a"], r["b"]) for r in module.near_pairs(d).collect())
    assert got == want and len(want) > 100
    # Shingles, and what was made of them, are gone.
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet"))}
    assert left == {"near-members", "near-firsts", "near-norm", "near-found"}


def test_near_dedupe_keeps_one_copy_of_the_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("weftwork.session.shared_dir", lambda _: f"file://{tmp_path}")
    d = docs(spark, [("s", "a", LONG, 1), ("s", "b", LONG + " thanks", 2), ("s", "c", "short", 3)])
    kept, drops = near_dedupe(d)
    assert sorted(r["external_id"] for r in kept.collect()) == ["a", "c"] and [(r["dropped_id"], r["kept_key"]) for r in drops.collect()] == [("b", "a")]
    texts = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if any(p.rglob("*.parquet")) and "body" in spark.read.parquet(str(p)).columns}
    assert texts == {"near-docs"}


def test_near_pairs_write_no_row_for_each_shingle(spark, monkeypatch):
    from weftwork.operators import dedupe as module

    rng = random.Random(9)
    rows = [(i, " ".join(f"word{rng.randrange(10**6)}" for _ in range(100))) for i in range(50)]
    rows += [(100 + i, t + " more") for i, t in rows[:7]]
    written, store = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, *a: written.append(store(df, *a)) or written[-1])
    counted = []
    monkeypatch.setattr(module, "discard", lambda *tables: counted.extend(t.count() for t in tables))
    got = module.near_pairs(spark.createDataFrame(rows, "id long, body string").repartition(3))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(i, 100 + i) for i in range(7)]
    # 57 documents of 98 shingles or more.
    assert counted and max([*counted, *(t.count() for t in written)]) < 57 * 98 / 2


def test_near_pairs_have_the_words_of_the_jvm(spark):
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from weftwork.functions.text import shingles, word_count
    from weftwork.operators import dedupe as module
    from weftwork.operators import shingle_vectors as vectors

    rng = random.Random(4)
    pool = [*"aZ_'-7", "\xe9", "\xdf", "İ", "Σ", "ς", "日", "本", "़", "क", "́", "‍", "‌", "‿", "\xb2", "\xbd", "٣", "\U0001d4b3", "\U0001f600", "K", "…"]
    pool += [*"   \t\n\x1c\x85\xa0", " ", "　", "​", "\U000e0100"]
    texts = ["", " ", "ab cd ef gh", *("".join(rng.choices(pool, k=rng.randint(1, 120))) for _ in range(400))]
    d = spark.createDataFrame([(i, True, i, t) for i, t in enumerate(texts)], "id long, new boolean, node long, text string")
    want = [(sorted(Counter(r["g"]).values()), r["n"]) for r in d.select("id", shingles(F.col("text")).alias("g"), word_count(F.col("text")).alias("n")).orderBy("id").collect()]
    table, given = vectors.classes(spark), module._prepared(d).orderBy("id").toArrow().combine_chunks().to_batches()[0]
    of, h, tf = vectors.counts(given.column("text"), 3, table)
    assert [sorted(tf[of == i].tolist()) for i in range(len(texts))] == [w for w, _ in want] and sum(len(w) for w, _ in want) > 1000
    assert len(np.unique(h)) == d.select(F.explode(shingles(F.col("text"))).alias("g")).distinct().count()
    for least in (1, 5, 12):
        some = pa.concat_tables([pa.Table.from_batches([b]) for b in vectors._long(iter([given]), least, table)])
        assert some["id"].to_pylist() == [i for i, (_, n) in enumerate(want) if n >= least]
