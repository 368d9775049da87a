"""Raw envelopes to typed rows: documents and signals; JSONL, CSV and recorded-query readers.

An envelope is ``(source, kind, external_id, fetched_at, query, raw)``, ``raw`` being the payload as
a JSON string: its shape depends on source and kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.html import html_to_text, unescape
from weftwork.functions.text import author_hash, content_hash
from weftwork.operators.signals import filled_series, velocity
from weftwork.sources.recorded import open_text

METRIC_KINDS = ("tag_count", "repo_stars", "repo_issue", "repo_contributors")
PLACEHOLDERS = ("", "[deleted]", "[removed]")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from JSON lines; blank lines are skipped, ``raw`` stays as it is."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    v = F.try_parse_json("value")
    names = ("source", "kind", "external_id", "query")
    return lines.select(*[F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in names], F.try_to_timestamp(F.try_variant_get(v, "$.fetched_at", "string")).alias("fetched_at"), F.try_variant_get(v, "$.raw", "string").alias("raw"))


def rejected_items(items: DataFrame) -> DataFrame:
    """Envelopes whose payload isn't JSON, or whose source has no mapper: ``(source, kind, external_id, reason)``."""
    bad = F.when(F.try_parse_json("raw").isNull(), "not JSON").when(~F.col("source").isin(*MAPPERS) & ~F.col("kind").isin(*METRIC_KINDS), "unknown source")
    return items.withColumn("reason", bad).where("reason is not null").select("source", "kind", "external_id", "reason")


def write_jsonl(items: DataFrame, path: str) -> None:
    items.write.mode("append").partitionBy("source").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, tag: str | None = None) -> DataFrame:
    """A CSV file, or a glob of them; blank strings stay empty, not null, and ``tag`` names a column for the file's name."""
    df = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, emptyValue="").na.fill("")
    return df if tag is None else df.withColumn(tag, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export of documents: a file with one JSON array, or one object for each line."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_parameters(path: str) -> dict:
    """A small YAML or JSON file of parameters, read by the driver."""
    import json

    with open_text(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def search_queries(spark: SparkSession, base: dict[str, list[str]], phrases: list[str]) -> DataFrame:
    """Each base query of an entity by itself and with each phrase in quotes."""
    rows = spark.createDataFrame([(e, q) for e, qs in base.items() for q in qs], "entity string, base string")
    words = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    paired = rows.crossJoin(F.broadcast(words)).select("entity", F.format_string('%s "%s"', "base", "phrase").alias("query"))
    return rows.select("entity", F.col("base").alias("query")).unionByName(paired)


def _get(path: str, kind: str = "string") -> Column:
    """A field of the payload, null if it isn't there or isn't of the kind."""
    return F.try_variant_get(F.col("_raw"), f"$.{path}", kind)


def _epoch(path: str) -> Column:
    return F.timestamp_seconds(_get(path, "double"))


def _iso(path: str) -> Column:
    return F.try_to_timestamp(_get(path))


def _filled(body: Column, title: Column, placeholders: tuple[str, ...] = ("",)) -> Column:
    return F.when(F.trim(F.coalesce(body, F.lit(""))).isin(*placeholders), title).otherwise(body)


def _null() -> Column:
    return F.lit(None).cast("string")


# What a document takes from each source's payload.
MAPPERS: dict[str, Callable[[], dict[str, Column]]] = {
    "reddit": lambda: {
        "url": _get("permalink"), "title": F.when(F.col("kind") == "submission", _get("title")),
        "body": F.when(F.col("kind") == "submission", _filled(_get("selftext"), _get("title"), PLACEHOLDERS)).otherwise(_get("body")),
        "author": _get("author"), "posted_at": _epoch("created_utc"), "score": _get("score", "int"),
        "n_comments": F.when(F.col("kind") == "submission", _get("num_comments", "int")).otherwise(_get("num_replies", "int")),
    },
    "hackernews": lambda: {
        "url": F.concat(F.lit("https://news.ycombinator.com/item?id="), _get("objectID")), "title": F.when(F.col("kind") == "story", _get("title")),
        "body": F.when(F.col("kind") == "story", _filled(html_to_text(_get("story_text")), _get("title"))).otherwise(html_to_text(_get("comment_text"))),
        "author": _get("author"), "posted_at": _epoch("created_at_i"), "score": _get("points", "int"), "n_comments": F.when(F.col("kind") == "story", _get("num_comments", "int")),
    },
    "stackexchange": lambda: {
        "url": _get("link"), "title": F.nullif(unescape(F.coalesce(_get("title"), F.lit(""))), F.lit("")), "body": html_to_text(_get("body")),
        "author": _get("owner.display_name"), "posted_at": _epoch("creation_date"), "score": _get("score", "int"), "n_comments": _get("answer_count", "int"),
    },
    "vendor_docs": lambda: {
        "url": _get("url"), "title": _get("title"), "body": _get("text"), "author": _null(),
        "posted_at": F.try_to_timestamp(F.regexp_replace(_get("last_modified"), r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")),
        "score": F.lit(None).cast("int"), "n_comments": F.lit(None).cast("int"),
    },
    "devto": lambda: {
        "url": _get("url"), "title": _get("title"), "body": _get("body_markdown"), "author": _get("author"),
        "posted_at": _iso("published_at"), "score": _get("reactions", "int"), "n_comments": _get("comments_count", "int"),
    },
    "github_threads": lambda: {
        "url": _get("url"), "title": _get("title"), "body": _filled(_get("body"), _get("title")), "author": _get("author"),
        "posted_at": _iso("created_at"), "score": _get("reactions", "int"), "n_comments": _get("comments", "int"),
    },
}


def to_documents(items: DataFrame, salt: str) -> DataFrame:
    """Typed documents of all sources; metric kinds and placeholder bodies are left out, NULs removed."""
    text = items.where(~F.col("kind").isin(*METRIC_KINDS)).withColumn("_raw", F.try_parse_json("raw")).where("_raw is not null")
    # One pass: each field is that of the row's source.
    fields = {source: mapper() for source, mapper in MAPPERS.items()}

    def pick(name: str) -> Column:
        found = F.lit(None)
        for source, f in fields.items():
            found = F.when(F.col("source") == source, f[name]).otherwise(found)
        return found.alias(name)

    names = ("url", "title", "body", "author", "posted_at", "score", "n_comments")
    out = text.where(F.col("source").isin(*MAPPERS)).select("source", "external_id", "fetched_at", *[pick(n) for n in names])
    clean = lambda c: F.regexp_replace(c, r"\x00", "")
    body = F.regexp_replace(clean(F.coalesce("body", F.lit(""))), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    out = out.withColumns({"body": body, "title": clean(F.col("title")), "author_hash": author_hash(salt, F.col("source"), F.col("author"))})
    out = out.where(~F.col("body").isin(*PLACEHOLDERS)).withColumn("content_hash", content_hash(F.col("body")))
    return out.select("source", "external_id", "url", "title", "body", "author_hash", "posted_at", "score", "n_comments", "fetched_at", "content_hash")


def to_signals(items: DataFrame) -> DataFrame:
    """Long monthly series: tag counts, contributor snapshots, stars (zero-filled), issues (from ``since`` on)."""
    m = items.where(F.col("kind").isin(*METRIC_KINDS)).withColumn("_raw", F.try_parse_json("raw")).where("_raw is not null")
    cols = ["source", "signal_type", "entity", "period_start", "granularity", "metric", "value", "unit", "fetched_at"]
    row = lambda df, **x: df.select(*[(x[c] if isinstance(x[c], Column) else F.lit(x[c])).alias(c) for c in cols])
    month = lambda c: F.to_date(F.date_trunc("month", F.to_timestamp(c)))
    fetched = m.agg(F.max("fetched_at").alias("fetched_at"))
    tags = row(m.where("kind = 'tag_count'"), source=F.col("source"), signal_type="so_tag_count", entity=_get("vendor"), period_start=F.to_date(_get("month")), granularity="month", metric=F.concat(F.lit("questions:"), _get("tag")), value=_get("total", "double"), unit="questions", fetched_at=F.col("fetched_at"))
    people = row(m.where("kind = 'repo_contributors'"), source=F.col("source"), signal_type="gh_contributors", entity=_get("repo"), period_start=month(_get("as_of")), granularity="month", metric="contributors_incl_anon_snapshot", value=_get("contributors_incl_anon", "double"), unit="contributors", fetched_at=F.col("fetched_at"))
    stars = filled_series(m.where("kind = 'repo_stars'").select(_get("repo").alias("repo"), F.to_timestamp(_get("starred_at")).alias("at")), ["repo"], F.col("at"))
    stars = stars.select("repo", "period_start", F.explode(F.array(F.struct(F.lit("new_stars").alias("metric"), F.col("new").alias("n")), F.struct(F.lit("cumulative_stars").alias("metric"), F.col("cumulative").alias("n")))).alias("x")).crossJoin(F.broadcast(fetched))
    stars = row(stars, source="github", signal_type="gh_stars", entity=F.col("repo"), period_start=F.col("period_start"), granularity="month", metric=F.col("x.metric"), value=F.col("x.n").cast("double"), unit="stars", fetched_at=F.col("fetched_at"))
    issues = m.where("kind = 'repo_issue'").select(_get("repo").alias("repo"), *[F.to_timestamp(_get(n)).alias(n) for n in ("since", "created_at", "closed_at")])
    issues = velocity(issues, ["repo"], F.col("created_at"), F.col("closed_at"), F.col("since")).crossJoin(F.broadcast(fetched))
    issues = row(issues, source="github", signal_type="gh_issue_velocity", entity=F.col("repo"), period_start=F.col("period_start"), granularity="month", metric=F.concat(F.lit("issues_"), "metric"), value=F.col("value"), unit="issues", fetched_at=F.col("fetched_at"))
    return tags.unionByName(people).unionByName(stars).unionByName(issues)
