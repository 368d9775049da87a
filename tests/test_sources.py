import datetime as dt
import json

from weftwork.functions.rules import PLATFORMS
from pyspark.sql import functions as F

from weftwork.sources import adapters, raw
from weftwork.sources.recorded import Recorded, with_retries
from weftwork.streaming import wrappers


def items(spark, rows):
    return spark.createDataFrame([(s, k, e, "2024-05-01 00:00:00", "q", json.dumps(r)) for s, k, e, r in rows], "source string, kind string, external_id string, fetched_at string, query string, raw string").selectExpr("source", "kind", "external_id", "timestamp(fetched_at) as fetched_at", "query", "raw")


def test_documents(spark):
    d = raw.to_documents(
        items(
            spark,
            [
                ("hackernews", "comment", "1", {"objectID": "1", "comment_text": "a &amp; b<p>c", "author": "x", "created_at_i": 1700000000, "points": 3}),
                ("hackernews", "story", "2", {"objectID": "2", "title": "Link only", "story_text": None, "author": "x", "created_at_i": 1700000000, "points": 1, "num_comments": 4}),
                ("reddit", "comment", "3", {"body": "[deleted]", "permalink": "u", "author": "y", "created_utc": 1.7e9}),
                ("reddit", "submission", "4", {"selftext": "[removed]", "title": "T", "permalink": "u", "author": "[deleted]", "created_utc": 1.7e9, "score": 2, "num_comments": 0}),
                ("stackexchange", "question", "5", {"link": "l", "title": "A &lt;b&gt;", "body": "<p>x</p>", "owner": {"display_name": "o"}, "creation_date": 1700000000, "score": 1, "answer_count": 2}),
                ("github_threads", "issue", "6", {"title": "only title", "body": "", "url": "g", "author": "z", "created_at": "2024-01-02T03:04:05Z", "comments": 1, "reactions": 2}),
                ("devto", "article", "7", {"title": "t", "body_markdown": "b\u0000c", "url": "d", "author": "w", "published_at": "2024-01-02T03:04:05Z"}),
                ("stackexchange", "tag_count", "8", {"vendor": "v", "tag": "t", "month": "2024-01-01", "total": 9}),
            ],
        ),
        "salt",
    )
    r = {x.external_id: x for x in d.collect()}
    assert set(r) == {"1", "2", "4", "5", "6", "7"}
    assert r["1"].body == "a & b\nc" and r["2"].body == "Link only" and r["4"].body == "T" and r["4"].author_hash is None
    assert r["5"].title == "A <b>" and r["6"].body == "only title" and r["7"].body == "bc" and len(r["7"].author_hash) == 24


def test_signals(spark):
    s = raw.to_signals(
        items(
            spark,
            [
                ("stackexchange", "tag_count", "1", {"vendor": "v", "tag": "t", "month": "2024-01-01", "total": 9}),
                *[("github", "repo_stars", str(i), {"repo": "r", "starred_at": f"2024-0{m}-05T00:00:00Z"}) for i, m in enumerate((1, 1, 3))],
                ("github", "repo_issue", "9", {"repo": "r", "since": "2024-01-01T00:00:00Z", "number": 1, "created_at": "2023-12-01T00:00:00Z", "closed_at": "2024-02-01T00:00:00Z"}),
            ],
        )
    )
    got = sorted((r.metric, str(r.period_start)[:7], r.value) for r in s.collect())
    assert got == [
        ("cumulative_stars", "2024-01", 2.0), ("cumulative_stars", "2024-02", 2.0), ("cumulative_stars", "2024-03", 3.0), ("issues_closed", "2024-02", 1.0),
        ("new_stars", "2024-01", 2.0), ("new_stars", "2024-02", 0.0), ("new_stars", "2024-03", 1.0), ("questions:t", "2024-01", 9.0),
    ]


def test_files_and_queries(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source": "s", "kind": "k", "external_id": "1", "fetched_at": "2024-01-01T00:00:00Z", "query": "q", "raw": {"a": [1]}}\n\n')
    (r,) = raw.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert r.external_id == "1" and json.loads(r.raw) == {"a": [1]}
    (tmp_path / "b.csv").write_text('id,span\n1,"a, ""b"""\n2,\n')
    assert [(x.id, x.span, x.file) for x in raw.read_csv(spark, str(tmp_path / "*.csv"), "id int, span string", "file").orderBy("id").collect()] == [(1, 'a, "b"', "b.csv"), (2, "", "b.csv")]
    assert {x.query for x in raw.search_queries(spark, {"v": ["x"]}, ["moved to"]).collect()} == {"x", 'x "moved to"'}


def test_recorded_source(spark, tmp_path):
    line = lambda i, t: json.dumps({"source": "s", "kind": "k", "external_id": i, "fetched_at": t, "raw": {}})
    (tmp_path / "0.jsonl").write_text("\n".join([line("1", "2024-02"), line("1", "2024-02"), line("0", "2023-01"), line("2", "2024-03")]))
    spark.dataSource.register(Recorded)
    got = spark.read.format("recorded").options(path=str(tmp_path), queries=json.dumps(["a", "b"]), since="2024").load().collect()
    assert sorted((r.query, r.external_id) for r in got if r.error is None) == [("a", "1"), ("a", "2")]
    assert [r.query for r in got if r.error] == ["b"]
    waits, left = [], [1, 1]

    def call():
        if left:
            left.pop()
            raise OSError
        return "ok"

    assert with_retries(call, sleep=waits.append) == "ok" and len(waits) == 2


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, "we use databricks", "2024-01-01 00:00:00"), (2, "We  use databricks", "2024-01-02 00:00:00")], "id long, body string, t string").selectExpr("id", "body", "timestamp(t) as fetched_at")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    seen = []
    wrappers.in_batches(wrappers.unique_documents(stream), lambda b, _: seen.extend(b.collect()), str(tmp_path / "c1")).awaitTermination()
    assert len(seen) == 1
    found = []
    wrappers.in_batches(wrappers.mentioned(stream, PLATFORMS), lambda b, _: found.extend(b.collect()), str(tmp_path / "c2")).awaitTermination()
    assert sorted((r.document_id, r.entity) for r in found) == [(1, "databricks"), (2, "databricks")]


SINCE = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def replies(found):
    """A ``get`` over a function of address and parameters; what it doesn't know is missing."""
    asked = []

    def get(url, **p):
        asked.append((url, p))
        r = found(url, p)
        return r if isinstance(r, adapters.Reply) else adapters.Reply([], 404) if r is None else adapters.Reply(r)

    return get, asked


def test_windows_go_past_the_cap_of_hits():
    items = [{"objectID": str(i), "created_at_i": 1_800_000_000 - i // 2} for i in range(25)]

    def search(url, p):
        until = [int(x.split("<=")[1]) for x in p["numericFilters"].split(",") if "<" in x]
        return {"hits": [h for h in items if not until or h["created_at_i"] <= until[0]][:10]} if p["tags"] == "story" else {"hits": []}

    get, asked = replies(search)
    got = [x["external_id"] for x in adapters.hackernews("q", SINCE, 0, get, cap=10)]
    assert got == [str(i) for i in range(25)] and len(asked) == 4 and len(list(adapters.hackernews("q", SINCE, 7, get, cap=10))) == 7


def test_budget_and_months():
    def api(url, p):
        return {"total": 5} if "todate" in p else {"items": [{"question_id": p["page"]}], "has_more": p["page"] < 9}

    now = dt.datetime(2024, 3, 2, tzinfo=dt.UTC)
    get, _ = replies(api)
    got = list(adapters.stackexchange("tag:v/t", SINCE, 4, get, now=now))
    assert [x["external_id"] for x in got] == ["t:2024-01-01", "t:2024-02-01", "t:2024-03-01", *[f"stackoverflow:{i}" for i in (1, 2, 3, 4)]]
    state = {"d": 1}
    assert len(list(adapters.stackexchange("tag:v/t", SINCE, 0, get, adapters.Budget(state, 6, "d"), now))) == 5 and state == {"d": 6}
    assert len(list(adapters.stackexchange("dba: moved to", SINCE, 0, get))) == 9


def test_bodies_are_asked_for_last():
    items = [{"id": i, "title": t, "published_at": d, "tag_list": "a, b"} for i, t, d in [(1, "about snowflake", "2024-02-01T00:00:00Z"), (2, "cats", "2024-02-01T00:00:00Z"), (3, "snowflake", "2023-02-01T00:00:00Z"), (4, "snowflake gone", "2024-03-01T00:00:00Z"), (1, "about snowflake", "2024-02-01T00:00:00Z")]]
    whole = lambda i: {"title": "t", "body_markdown": "b", "url": "u", "user": {"username": "n"}, "published_at": "2024-02-01T00:00:00Z", "tags": ["a"]}
    get, asked = replies(lambda url, p: (items if p["page"] == 1 else []) if "page" in p else whole(1) if url.endswith("/1") else None)
    got = list(adapters.devto("data", SINCE, 0, get, frozenset(["data"]), "snowflake"))
    assert [x["external_id"] for x in got] == ["1"] and [u[-2:] for u, p in asked if "page" not in p] == ["/1", "/4"]


def test_threads_and_series():
    issue = {"html_url": "https://github.com/o/r/issues/7", "number": 7, "title": "t", "user": {"login": "u"}, "created_at": "2024-01-02T00:00:00Z", "comments": 1}
    talk = {"url": "https://github.com/o/r/discussions/8", "number": 8, "title": "d", "createdAt": "2024-01-03T00:00:00Z", "comments": {"totalCount": 2}, "reactions": {"totalCount": 3}, "repository": {"nameWithOwner": "o/r"}, "author": None}

    def api(url, p):
        if url.endswith("graphql"):
            return {"data": {"search": {"nodes": [talk, talk], "pageInfo": {"hasNextPage": p["after"] == "", "endCursor": "c"}}}}
        if url.endswith("/contributors"):
            return adapters.Reply([{}], headers={"Link": '<https://x?page=2>; rel="next", <https://x?anon=true&page=42>; rel="last"', "Date": "2024-05-01"})
        if url.endswith("/stargazers"):
            raise OSError("down")
        if url.endswith("/issues") and "repos" in url:
            return [issue | {"state": "open"}, issue | {"state": "open", "pull_request": {}}] if p["page"] == 1 else []
        return {"items": [issue, issue] if p["page"] == 1 else []}

    get, _ = replies(api)
    assert [x["external_id"] for x in adapters.github_threads("moved to", SINCE, 0, get)] == ["o/r#7", "o/r#8"] and len(list(adapters.github_threads("x", SINCE, 1, get))) == 1
    got = list(adapters.github("o/r", SINCE, 1, get))
    assert [x["kind"] for x in got] == ["repo_contributors", "repo_issue"] and got[0]["raw"]["contributors_incl_anon"] == 42 and adapters.last_page(None) is None


def test_pages_and_trees():
    robots = "User-agent: *\nDisallow: /no\n"
    page = lambda n: f"<title>T</title><body><main><p>{'word ' * n}</main>"
    get, _ = replies(lambda url, p: robots if url.endswith("robots.txt") else page(90) if "rendered" in p or url.endswith("/long") else page(3))
    one = lambda path: list(adapters.vendor_docs(f"v https://s.example/{path}", SINCE, 0, get))
    assert one("no/x") == [] and [x["raw"]["method"] for x in one("long") + one("short")] == ["plain", "rendered"]
    tree = {"id": "p", "created_utc": 1.8e9, "replies": [{"id": "a", "replies": [{"id": "b"}]}, {"id": "c"}]}
    get, _ = replies(lambda url, p: [tree, {"id": "old", "created_utc": 1.0}] if p["page"] == 1 else [])
    got = list(adapters.reddit("q", SINCE, 0, get))
    assert [(x["external_id"], x["raw"].get("num_replies")) for x in got] == [("p", None), ("a", 1), ("b", 0), ("c", 0)]


def test_adapter_source(spark, tmp_path):
    key = adapters.request_key("https://hn.algolia.com/api/v1/search_by_date", {"query": "q", "tags": "story", "hitsPerPage": 1000, "numericFilters": "created_at_i>0"})
    lines = [{"request": key, "body": {"hits": [{"objectID": "5", "created_at_i": 9, "title": "T"}]}}, {"request": key.replace("tags=story", "tags=comment"), "body": {"hits": []}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    spark.dataSource.register(adapters.Adapted)
    got = spark.read.format("adapter").options(adapter="hackernews", path=str(tmp_path / "r.jsonl"), queries=json.dumps(["q", "unknown"])).load().collect()
    assert [(r.external_id, json.loads(r.raw)["title"]) for r in got if r.error is None] == [("5", "T")] and [r.query for r in got if r.error] == ["unknown"]


def test_broken_payloads_are_told_apart(spark):
    d = items(spark, [("reddit", "comment", "1", {"body": "b"}), ("nowhere", "x", "2", {})]).selectExpr("source", "kind", "external_id", "fetched_at", "query", "raw")
    d = d.unionByName(d.limit(1).withColumn("raw", F.lit("{broken")).withColumn("external_id", F.lit("3")))
    assert [r.external_id for r in raw.to_documents(d, "salt").collect()] == ["1"] and raw.to_signals(d).count() == 0
    assert sorted((r.external_id, r.reason) for r in raw.rejected_items(d).collect()) == [("2", "unknown source"), ("3", "not JSON")]


def test_documents_and_parameters(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"id": 1, "body": "a"}, {"id": 2, "body": "b"}]')
    assert raw.read_documents(spark, str(tmp_path / "d.json"), "id long, body string").count() == 2
    (tmp_path / "p.yaml").write_text("seed: 42\nregions: {a: 0.5}\n")
    assert raw.read_parameters(str(tmp_path / "p.yaml")) == {"seed": 42, "regions": {"a": 0.5}}


def test_stream_merges_bear_a_repeated_batch(spark, tmp_path):
    row = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, t long")
    path = str(tmp_path / "snapshot")
    put = wrappers.merged(path, ["k"], ["v"], [F.col("t")])
    put(row((1, "a", 1), (2, "b", 1)), 0)
    put(row((2, "c", 2), (3, "d", 1), (3, "e", 2)), 1)
    put(row((2, "c", 2), (3, "d", 1), (3, "e", 2)), 1)
    assert sorted((r.k, r.v, r.t) for r in wrappers.snapshot(spark, path).collect()) == [(1, "a", 1), (2, "c", 1), (3, "e", 2)] and wrappers.versions(spark, path) == [0, 1]
    row((1, "x", 5), (2, "y", 5)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string, t long").parquet(str(tmp_path / "in"))
    keep = wrappers.latest_by_key(str(tmp_path / "last"), ["k"], [F.col("t")])
    wrappers.in_batches(stream, keep, str(tmp_path / "c")).awaitTermination()
    row((1, "late", 4), (2, "z", 6)).write.mode("append").parquet(str(tmp_path / "in"))
    wrappers.in_batches(stream, keep, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.k, r.v) for r in wrappers.snapshot(spark, str(tmp_path / "last")).collect()) == [(1, "x"), (2, "z")]


def test_months_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-31 23:00:00"), ("a", "2024-02-01 00:00:00"), ("a", "2024-01-01 00:00:00")], "g string, t string").selectExpr("g", "timestamp(t) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    q = wrappers.month_counts(stream, ["g"]).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.period_start), r.new) for r in seen) == [("2024-01-01", 2), ("2024-02-01", 1)]
