"""Queries of the mappers of all sources, over payloads that are made of the tables' own columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.operators import labels, matrix
from weftwork.plans.queries import _FEATURES, _features, _t, query
from weftwork.plans.reported import _CODED, _coded
from weftwork.sources import raw

_KINDS = (("reddit", "submission"), ("reddit", "comment"), ("hackernews", "story"), ("hackernews", "comment"), ("stackexchange", "question"), ("vendor_docs", "page"), ("devto", "article"), ("github_threads", "issue"))


def _payloads() -> list[Column]:
    c, n, text = F.col, F.col("doc_id"), F.col("text")
    html = F.concat(F.lit("<p>in "), c("lang"), F.lit(" &amp; "), c("source"), F.lit("</p>"))
    title = F.concat(F.lit("t"), n.cast("string"))
    when = F.lit("2023-11-14T22:13:20Z")
    fields = [
        {"permalink": F.concat(F.lit("/r/"), n), "title": title, "selftext": F.when(n % 16 == 0, "[removed]").otherwise(text), "author": c("source"), "created_utc": F.lit(1.7e9), "score": c("n_chars"), "num_comments": n % 5},
        {"permalink": F.concat(F.lit("/r/"), n), "body": text, "author": F.lit("[deleted]"), "created_utc": F.lit(1.7e9), "score": -c("n_chars"), "num_replies": n % 3},
        {"objectID": n.cast("string"), "title": title, "story_text": F.when(n % 16 == 2, html), "author": c("source"), "created_at_i": F.lit(1700000000), "points": n % 100, "num_comments": n % 7},
        {"objectID": n.cast("string"), "comment_text": html, "author": c("source"), "created_at_i": F.lit(1700000000)},
        {"link": F.concat(F.lit("/q/"), n), "title": F.concat(title, F.lit(" &lt;3")), "body": html, "owner": F.struct(c("source").alias("display_name")), "creation_date": F.lit(1700000000), "score": n % 11, "answer_count": n % 4},
        {"url": F.concat(F.lit("/d/"), n), "title": title, "text": text, "last_modified": F.lit("Tue, 14 Nov 2023 22:13:20 GMT")},
        {"url": F.concat(F.lit("/a/"), n), "title": title, "body_markdown": text, "author": c("source"), "published_at": when, "reactions": n % 9, "comments_count": n % 2},
        {"url": F.concat(F.lit("/g/"), n), "title": title, "body": F.when(n % 16 == 7, " ").otherwise(text), "author": c("source"), "created_at": when, "reactions": n % 8, "comments": n % 6},
    ]
    return [F.to_json(F.struct(*[x.alias(k) for k, x in f.items()])) for f in fields]


@query(r"""WITH t AS (SELECT doc_id AS n, doc_id % 8 AS k, 't' || doc_id AS t, lang, source AS s, n_chars, regexp_replace(regexp_replace(text, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '') AS text FROM documents),
 r AS (SELECT n, k, ['reddit', 'reddit', 'hackernews', 'hackernews', 'stackexchange', 'vendor_docs', 'devto', 'github_threads'][k + 1] AS source,
  CASE WHEN k < 2 THEN '/r/' || n WHEN k < 4 THEN 'https://news.ycombinator.com/item?id=' || n ELSE ['/q/', '/d/', '/a/', '/g/'][k - 3] || n END AS url,
  CASE WHEN k IN (1, 3) THEN NULL WHEN k = 4 THEN t || ' <3' ELSE t END AS title,
  CASE WHEN k = 0 AND n % 16 = 0 OR k = 2 AND n % 16 <> 2 OR k = 7 AND n % 16 = 7 THEN t WHEN k IN (2, 3, 4) THEN 'in ' || lang || ' & ' || s ELSE CASE WHEN k IN (0, 7) AND text IN ('', '[deleted]', '[removed]') THEN t ELSE text END END AS body,
  CASE k WHEN 0 THEN n_chars WHEN 1 THEN -n_chars WHEN 2 THEN n % 100 WHEN 4 THEN n % 11 WHEN 6 THEN n % 9 WHEN 7 THEN n % 8 END AS score,
  CASE k WHEN 0 THEN n % 5 WHEN 1 THEN n % 3 WHEN 2 THEN n % 7 WHEN 4 THEN n % 4 WHEN 6 THEN n % 2 WHEN 7 THEN n % 6 END AS n_comments, k NOT IN (1, 5) AS signed FROM t)
 SELECT n::VARCHAR AS external_id, source, url, title, sha256(body) AS body_hash, score::INTEGER AS score, n_comments::INTEGER AS n_comments, 1700000000::BIGINT AS posted, signed FROM r WHERE body NOT IN ('', '[deleted]', '[removed]')""")
def ingested_sources(spark, d):
    """Documents as payloads of all sources and kinds, mapped."""
    docs = _t(spark, d, "documents")
    pick = lambda values: F.element_at(F.array(*values), (F.col("doc_id") % len(_KINDS) + 1).cast("int"))
    items = docs.select(pick([F.lit(s) for s, _ in _KINDS]).alias("source"), pick([F.lit(k) for _, k in _KINDS]).alias("kind"), F.col("doc_id").cast("string").alias("external_id"), F.lit("2024-05-01").cast("timestamp").alias("fetched_at"), F.lit("q").alias("query"), pick(_payloads()).alias("raw"))
    out = raw.to_documents(items, "salt")
    return out.select("external_id", "source", "url", "title", F.sha2("body", 256).alias("body_hash"), "score", "n_comments", F.unix_timestamp("posted_at").alias("posted"), F.col("author_hash").isNotNull().alias("signed"))


@query("""WITH v AS (SELECT o_orderpriority AS entity, date_trunc('month', made)::DATE AS period_start, 'issues_' || m AS metric, count(*)::DOUBLE AS value, 'issues' AS unit
  FROM (SELECT o_orderpriority, unnest([o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 40 DAY END]) AS made, unnest(['opened', 'closed']) AS m FROM orders) WHERE made >= TIMESTAMP '1996-03-01' GROUP BY ALL)
 SELECT * FROM v UNION ALL SELECT n_name, make_date(2020 + n_nationkey % 5, 1 + n_nationkey % 12, 1), 'questions:' || n_regionkey, n_nationkey::DOUBLE, 'questions' FROM nation
 UNION ALL SELECT c_name, DATE '2024-03-01', 'contributors_incl_anon_snapshot', c_custkey::DOUBLE, 'contributors' FROM customer""")
def ingested_metrics(spark, d):
    """Tag counts, contributors and issues, from nations, customers and orders."""
    nations, customers, orders = _t(spark, d, "nation", "customer", "orders")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = lambda df, source, kind, **f: df.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit("x").alias("external_id"), F.lit("2024-05-01").cast("timestamp").alias("fetched_at"), F.lit("q").alias("query"), F.to_json(F.struct(*[x.alias(k) for k, x in f.items()])).alias("raw"))
    k = F.col("n_nationkey")
    month = F.format_string("%d-%02d-01", (2020 + k % 5).cast("int"), (1 + k % 12).cast("int"))
    items = item(nations, "stackexchange", "tag_count", vendor=F.col("n_name"), month=month, tag=F.col("n_regionkey").cast("string"), total=k)
    items = items.unionByName(item(customers, "github", "repo_contributors", repo=F.col("c_name"), as_of=F.lit("2024-03-17T00:00:00Z"), contributors_incl_anon=F.col("c_custkey")))
    closed = F.when(F.col("o_orderstatus") == "F", iso(F.expr("o_orderdate + interval 40 days")))
    items = items.unionByName(item(orders, "github", "repo_issue", repo=F.col("o_orderpriority"), since=F.lit("1996-03-15T00:00:00Z"), created_at=iso(F.col("o_orderdate")), closed_at=closed))
    return raw.to_signals(items).where("metric not like '%stars'").select("entity", "period_start", "metric", "value", "unit")


@query(f"""WITH r AS ({_CODED}), c AS (SELECT taxonomy_code AS category, promotional, count(*) AS n
  FROM (SELECT taxonomy_code, unnest([true, false]) AS promotional, doc_id FROM r WHERE taxonomy_code <> 'none' AND source IN ('src0', 'src1', 'src2')) WHERE promotional OR doc_id % 4 <> 0 GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY promotional ORDER BY n DESC, category)::INTEGER AS rank FROM c""")
def filtered_categories(spark, d):
    """Categories of some sources, with and without promotional documents, as a page shows them."""
    return labels.filtered_categories(_coded(spark, d), F.col("source").isin("src0", "src1", "src2"), F.col("doc_id") % 4 == 0)


@query(f"""WITH p AS (SELECT vendor, round(avg(score) FILTER ("group" = 'PROMO'), 6) AS deploy_flex, round(avg(score) FILTER ("group" = 'SMALL'), 6) AS openness FROM ({_FEATURES}) GROUP BY 1)
 SELECT *, row_number() OVER (ORDER BY deploy_flex + openness DESC NULLS LAST, vendor)::INTEGER AS place FROM p""")
def positioning_order(spark, d):
    """Vendors by flexibility and openness together, as a panel lists them."""
    f = _features(spark, d).withColumn("capability", F.col("group"))
    return matrix.position_order(matrix.positions(f, ("PROMO",), ("SMALL",), 6))
