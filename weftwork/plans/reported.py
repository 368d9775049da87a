"""Queries of the findings document: its nested parts as flat rows, its gates, reasons as maps of maps, and mentions without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.operators import labels
from weftwork.operators.buckets import Buckets
from weftwork.operators.mention_spans import find_mentions, rebuild_mentions
from weftwork.operators.mentions import rejection_counts
from weftwork.plans import findings
from weftwork.plans.incremental import _place
from weftwork.plans.queries import _LOWER_WORDS, _REASONS, _SOV_SOURCES, _VOICES, ORACLES, RULES, _lens, _t, query

_CODED = f"SELECT *, 's' || (doc_id % 3) AS sample FROM ({_REASONS})"


def _coded(spark, d) -> DataFrame:
    lb, docs = _t(spark, d, "labels", "documents")
    code = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "none").when(F.col("toxic") == 1, "toxic").otherwise("poor")
    return lb.join(docs, "doc_id").select("doc_id", "source", "text", code.alias("taxonomy_code"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("sample"))


@query(f"""WITH r AS ({_CODED}), k AS (SELECT DISTINCT taxonomy_code AS code FROM r WHERE taxonomy_code <> 'none'), b AS (SELECT DISTINCT source FROM r), s AS (SELECT DISTINCT sample FROM r),
 a AS (SELECT taxonomy_code AS code, source, sample, 1 AS one FROM r WHERE taxonomy_code <> 'none' UNION ALL SELECT code, source, sample, 0 FROM k, b, s)
 SELECT code, source, sample, CAST(sum(one) AS BIGINT) AS n FROM a GROUP BY GROUPING SETS ((code, source, sample), (code, source), (code), ())""")
def reason_map_levels(spark, d):
    """The nested maps, level by level; a level has nulls for what it sums over."""
    m = labels.reason_maps(_coded(spark, d))
    none = F.lit(None).cast("string")
    codes = m.select("n", F.explode("reasons").alias("code", "c"))
    sources = codes.select("code", "c.n", F.explode("c.sources").alias("source", "s"))
    samples = sources.select("code", "source", F.explode("s.samples").alias("sample", "n"))
    out = samples.unionByName(sources.select("code", "source", none.alias("sample"), F.col("s.n").alias("n")))
    out = out.unionByName(codes.select("code", none.alias("source"), none.alias("sample"), F.col("c.n").alias("n")))
    return out.unionByName(m.select(none.alias("code"), none.alias("source"), none.alias("sample"), "n")).select("code", "source", "sample", "n")


_WORDS_OF = {"english": "the", "french": "le", "spanish": "el"}
_NAMED = " UNION ALL ".join(f"SELECT doc_id, source, n, '{e}' AS entity, len(list_filter(w, lambda x: x = '{w}')) AS m FROM t" for e, w in _WORDS_OF.items())


@query(rf"""WITH t AS (SELECT doc_id, source, length(text) AS n, {_LOWER_WORDS} AS w FROM documents WHERE source IN ({", ".join(f"'{s}'" for s in _SOV_SOURCES)})),
 v AS (SELECT * FROM ({_NAMED}) WHERE m > 0), r AS ({_REASONS}),
 c AS (SELECT taxonomy_code AS k, count(*) AS a, count(*) FILTER (doc_id NOT IN (1, 2, 3)) AS b FROM r WHERE taxonomy_code <> 'none' GROUP BY 1)
 SELECT part, k1, k2, v FROM (
  SELECT 'share_of_voice' AS part, entity AS k1, unnest(['documents', 'mentions', 'switching', 'reason_v2']) AS k2, unnest([count(*)::DOUBLE, sum(m)::DOUBLE, count(*) FILTER (n > 2000)::DOUBLE, count(*) FILTER (n > 4000)::DOUBLE]) AS v FROM v GROUP BY entity
  UNION ALL SELECT 'reasons', k, s, coalesce(count(r.doc_id), 0)::DOUBLE FROM (SELECT k FROM c) CROSS JOIN (SELECT DISTINCT source AS s FROM r) LEFT JOIN r ON taxonomy_code = k AND source = s GROUP BY ALL
  UNION ALL SELECT 'sensitivity', k, unnest(['with_all', 'without', 'rank_with', 'rank_without']), unnest([a::DOUBLE, b::DOUBLE, row_number() OVER (ORDER BY a DESC, k)::DOUBLE, row_number() OVER (ORDER BY b DESC, k)::DOUBLE]) FROM c
  UNION ALL SELECT 'agreement', unnest(['n', 'agree', 'kappa']), NULL, unnest([count(*)::DOUBLE, count(*)::DOUBLE, CASE WHEN count(DISTINCT taxonomy_code) > 1 THEN 1.0::DOUBLE END]) FROM r
  UNION ALL SELECT 'by_year', year(TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (1600000000 + (doc_id % 1000) * 86400))::VARCHAR, NULL, count(*)::DOUBLE FROM documents WHERE doc_id % 7 > 0 GROUP BY 2
  UNION ALL SELECT 'documents', NULL, NULL, count(*)::DOUBLE FROM documents)""")
def findings_parts(spark, d):
    """The findings document with each of its parts as rows ``(part, k1, k2, v)``."""
    docs, found, codes = _lens(spark, d)
    docs = docs.withColumns({"switching": F.length("body") > 2000, "reason_v2": F.length("body") > 4000})
    sets = codes.withColumn("labeled_by", F.lit("review")).unionByName(codes.withColumn("labeled_by", F.lit("model_draft")))
    row = findings.findings(docs, found, sets, _VOICES, _SOV_SOURCES, [1, 2, 3])
    none = F.lit(None).cast("string")

    def flat(name, k1, fields, k2=None):
        x = row.select(F.explode(name).alias("x"))
        cells = F.array(*[F.struct((F.lit(label) if k2 is None else F.col(f"x.{k2}")).alias("k2"), F.col(f"x.{f}").cast("double").alias("v")) for label, f in fields.items()])
        return x.select(F.lit(name).alias("part"), F.col(f"x.{k1}").cast("string").alias("k1"), F.explode(cells).alias("c")).select("part", "k1", "c.k2", "c.v")

    out = flat("share_of_voice", "entity", {"documents": "documents", "mentions": "mentions", "switching": "switching_documents", "reason_v2": "reason_v2_documents"})
    out = out.unionByName(flat("reasons", "taxonomy_code", {"n": "n"}, "source"))
    out = out.unionByName(flat("sensitivity", "category", {n: n for n in ("with_all", "without", "rank_with", "rank_without")}))
    agree = row.select(F.explode("agreement").alias("x")).select(F.lit("agreement").alias("part"), F.explode(F.array(*[F.struct(F.lit(n).alias("k1"), F.col(f"x.{n}").cast("double").alias("v")) for n in ("n", "agree", "kappa")])).alias("c"))
    out = out.unionByName(agree.select("part", "c.k1", none.alias("k2"), "c.v"))
    out = out.unionByName(flat("by_year", "year", {"n": "documents"}).withColumn("k2", none))
    return out.unionByName(row.select(F.lit("documents").alias("part"), none.alias("k1"), none.alias("k2"), F.col("documents").cast("double").alias("v")))


@query("""SELECT count(*) AS labels, count(*) FILTER (trim(substr(text, 1, 40)) <> '') AS quotes FROM labels JOIN documents USING (doc_id)""")
def findings_gates(spark, d):
    """What the gates of the findings have seen: all labels are the committed ones, and all evidence is in its text."""
    rows = _coded(spark, d).select(F.col("doc_id").alias("document_id"), "taxonomy_code", F.substring("text", 1, 40).alias("evidence_span"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    stored, seen = findings.passed(rows, rows.orderBy("document_id"), docs, ["document_id", "taxonomy_code"])
    return stored.limit(1).select(F.lit(seen["labels"]).cast("long").alias("labels"), F.lit(seen["quotes"]).cast("long").alias("quotes"))


@query(ORACLES["mention_counts"])
def mention_counts_native(spark, d):
    """``mention_counts`` with DataFrame operations only."""
    return find_mentions(_t(spark, d, "documents"), RULES, "doc_id", "text")[0]


@query(ORACLES["mention_rejections"])
def mention_rejections_native(spark, d):
    return rejection_counts(find_mentions(_t(spark, d, "documents"), RULES, "doc_id", "text")[1])


@query(ORACLES["mention_counts"])
def mentions_rebuilt(spark, d):
    """Mentions written anew over some that were stored, and read back."""
    docs = _t(spark, d, "documents")
    table = Buckets(_place(spark, "mentions"), ("document_id",), 16)
    rebuild_mentions(docs.where("doc_id % 3 = 0"), RULES, table, id_col="doc_id", body="text")
    rebuild_mentions(docs, RULES, table, id_col="doc_id", body="text")
    return table.read(spark)


@query("""SELECT p_partkey, replace(CASE WHEN p_brand LIKE 'Brand#%' THEN substr(p_brand, 7) ELSE p_brand END, '1', 'I') AS brand, CASE WHEN p_type LIKE '%STEEL' THEN substr(p_type, 1, length(p_type) - 5) ELSE p_type END AS base,
 array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS heading, lpad(p_size::VARCHAR, 4, '0') || '/' || upper(p_brand) AS code FROM part""")
def part_names(spark, d):
    """Names taken apart and put together."""
    p = _t(spark, d, "part")
    name = F.col("p_type")
    return p.select("p_partkey", F.replace(T.without_prefix(F.col("p_brand"), "Brand#"), F.lit("1"), F.lit("I")).alias("brand"), T.without_suffix(name, "STEEL").alias("base"), T.titled(F.translate(F.lower(name), " ", "_")).alias("heading"), F.format_string("%04d/%s", F.col("p_size").cast("int"), F.upper("p_brand")).alias("code"))
