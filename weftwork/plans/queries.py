"""Every operator applied to the star-schema and text tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.functions.html import extract_text, html_to_text
from weftwork.functions.rules import Ambiguous, Rules
from weftwork.operators import corpus, crm, dedupe, labels, market, matrix, mentions, merge, ordering, sampling, signals, spans
from weftwork.operators.export import to_json
from weftwork.plans import findings as findings_
from weftwork.session import table
from weftwork.sources import raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules over words that occur in the synthetic prose.
RULES = Rules(
    aliases={
        "license": (r"\blicensed? under\b", r"\breleased under the \w+ license\b"),
        "rights": (r"\ball rights reserved\b",),
        "english": (r"\bthe\b",), "german": (r"\bder\b", r"\bdie\b"), "french": (r"\ble\b",), "spanish": (r"\bel\b",),
    },
    ambiguous=(Ambiguous("secret", r"\btoken\b", 60, (r"=", r"\bpassword\b")), Ambiguous("secret", r"\bpassword\b", 20, (r"=",)), Ambiguous("article", r"\bto\b", 12, (r"\bof\b",), r"To\b")),
    excluded=(("english", r"\bof the\b"), ("article", r"\bto the\b")),
    phrases=("all rights reserved", "of the", "et la", "der und", "el que"),
    platforms=(r"\bthe\b", r"\bund\b"), moves=(r"\bto\b", r"\bmit\b"), cues={"place": (r"in", r"at"), "cause": (r"for", r"by")},
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, *names: str):
    found = [table(spark, d, n) for n in names]
    return found[0] if len(found) == 1 else found


# --- relational reports -------------------------------------------------------


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS total_opps, count(*) FILTER (o_orderstatus = 'F') AS wins,
 round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 3) AS win_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def win_rate(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    return crm.win_rate(o.join(c, F.col("o_custkey") == F.col("c_custkey")), ["c_mktsegment", "o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""SELECT o_orderpriority, o_orderstatus, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY o_orderpriority), 3) AS share
 FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)""")
def loss_reason_share(spark, d):
    return crm.mix_share(_t(spark, d, "orders").where("o_orderstatus <> 'F'"), "o_orderpriority", "o_orderstatus")


@query("""SELECT event_type AS stage, count(*) AS entries, round(avg(x), 4) AS avg_days, round(median(x), 4) AS median_days, count(DISTINCT user_id) AS unique_keys FROM (
 SELECT event_type, user_id, date_diff('day', (lag(ts) OVER w)::DATE, ts::DATE) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY ALL""")
def stage_conversion(spark, d):
    from pyspark.sql import Window

    e = _t(spark, d, "events")
    e = e.withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumnRenamed("event_type", "stage")
    return crm.stage_durations(e, "stage", F.col("before"), F.col("ts"), "user_id")


@query("""SELECT r_name, l_returnflag, count(DISTINCT o_custkey) AS accounts, round(avg(l_quantity), 4) AS avg_quantity, round(avg(l_extendedprice), 4) AS avg_price
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def regional_adoption(spark, d):
    li, o, c, n, r = _t(spark, d, "lineitem", "orders", "customer", "nation", "region")
    place = c.join(F.broadcast(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")  # 25 nations
    owner = o.join(place, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "r_name")
    rows = li.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    return crm.adoption(rows, ["r_name", "l_returnflag"], "o_custkey", {"avg_quantity": "l_quantity", "avg_price": "l_extendedprice"})


@query("""SELECT decile, count(*) AS accounts, count(*) FILTER (c_acctbal < 0) AS churned, round(avg(c_acctbal), 6) AS avg_contraction, round(count(*) FILTER (c_acctbal < 0)::DOUBLE / count(*), 3) AS churn_rate
 FROM (SELECT c_acctbal, ntile(10) OVER (ORDER BY total, o_custkey) AS decile FROM (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS total FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def usage_decile_churn(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    o = o.withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return crm.churn_by_decile(o, "o_custkey", "amount", c.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), F.col("c_acctbal") < 0, F.col("c_acctbal"))


@query("""SELECT n_name, c_mktsegment, count(*) AS accounts, count(*) FILTER (c_acctbal > 0) AS expanded, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS avg_expansion,
 round(count(*) FILTER (c_acctbal > 0)::DOUBLE / count(*), 3) AS expansion_rate FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def expansion_drivers(spark, d):
    c, n = _t(spark, d, "customer", "nation")
    return crm.expansion(c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")), ["n_name", "c_mktsegment"], F.col("c_acctbal"))  # 25 nations


@query("""SELECT o_orderpriority, count(*) AS total_sprints, round(avg(l_quantity), 4) AS avg_planned, round(avg(l_quantity * (1 - l_discount)), 4) AS avg_delivered,
 round(avg(l_quantity * (1 - l_discount)) / avg(l_quantity), 4) AS delivery_ratio, round(count(*) FILTER (date_diff('day', o_orderdate::DATE, l_shipdate::DATE) <= 60)::DOUBLE / count(*), 4) AS on_time_pct,
 round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 4) AS avg_slip_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def delivery_velocity(spark, d):
    li, o = _t(spark, d, "lineitem", "orders")
    days = F.datediff("l_shipdate", "o_orderdate")
    return crm.delivery(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "o_orderpriority", F.col("l_quantity"), F.col("l_quantity") * (1 - F.col("l_discount")), days <= 60, days)


# --- text -----------------------------------------------------------------------

# Python's white space for an engine whose \s is that of ASCII.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COLLAPSED = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"
_WORDS = f"CASE WHEN {_COLLAPSED} = '' THEN 0 ELSE len(string_split({_COLLAPSED}, ' ')) END"


@query(f"SELECT doc_id, sha256(lower({_COLLAPSED})) AS content_hash, length(text) AS chars, {_WORDS} AS words FROM documents")
def content_hash(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", T.content_hash(t).alias("content_hash"), F.length(t).cast("long").alias("chars"), T.word_count(t).cast("long").alias("words"))


_PHRASE = r"regexp_matches(text, '(?i)(^|[^\p{L}\p{N}\p{M}_])(all rights reserved|of the|et la|der und|el que)($|[^\p{L}\p{N}\p{M}_])')"


@query(f"SELECT doc_id, {_PHRASE} AS has_phrase FROM documents")
def phrase_detector(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.has_phrase(F.col("text"), RULES.phrases).alias("has_phrase"))


_SENTENCES = r"""SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS s FROM documents"""
_MARKED = rf"""SELECT doc_id, regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(the|und)($|[^\p{{L}}\p{{N}}\p{{M}}_])') AND regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(to|mit)($|[^\p{{L}}\p{{N}}\p{{M}}_])') AS move, regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(the|und)($|[^\p{{L}}\p{{N}}\p{{M}}_])') AND regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(in|at|for|by)($|[^\p{{L}}\p{{N}}\p{{M}}_])') AS reason FROM ({_SENTENCES})"""


@query(f"""SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(score, 0) AS score, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN b THEN 2 ELSE 1 END AS tier FROM documents d LEFT JOIN (
 SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN move AND reason THEN 2 ELSE 1 END) AS BIGINT) AS score, bool_or(move AND reason) AS b FROM ({_MARKED}) WHERE move OR reason GROUP BY 1) x USING (doc_id)""")
def sentence_detector(spark, d):
    m = T.marked_sentences(F.col("text"), RULES.platform, RULES.move, RULES.reason)
    s = _t(spark, d, "documents").select("doc_id", m.alias("m"))
    return s.select("doc_id", F.size("m").cast("long").alias("n_sentences"), T.reason_score(F.col("m")).cast("long").alias("score"), T.reason_tier(F.col("m")).alias("tier"))


@query(rf"""SELECT cue, count(*) AS sentences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, s, 'place' AS cue FROM ({_SENTENCES}) WHERE regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(in|at)($|[^\p{{L}}\p{{N}}\p{{M}}_])')
 UNION ALL SELECT doc_id, s, 'cause' FROM ({_SENTENCES}) WHERE regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(for|by)($|[^\p{{L}}\p{{N}}\p{{M}}_])')) WHERE regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(the|und)($|[^\p{{L}}\p{{N}}\p{{M}}_])') AND regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])(to|mit)($|[^\p{{L}}\p{{N}}\p{{M}}_])') GROUP BY 1""")
def category_probe(spark, d):
    docs = _t(spark, d, "documents")
    cues = F.array(*[F.struct(F.lit(c).alias("cue"), T.strict_sentences(F.col("text"), T.any_of(p, whole_words=True), RULES.platform, RULES.move).alias("s")) for c, p in RULES.cues.items()])
    long = docs.select("doc_id", F.explode(cues).alias("x")).select("doc_id", "x.cue", F.explode("x.s").alias("s"))
    return long.groupBy("cue").agg(F.count("*").alias("sentences"), F.countDistinct("doc_id").alias("documents"))


def _benchmark_pairs(spark, d):
    """Documents and the items that they hold."""
    return spans.contained(*_t(spark, d, "documents", "benchmark"), "doc_id", "item_id")


@query(f"""WITH d AS (SELECT doc_id, {_COLLAPSED} AS t FROM documents), b AS (SELECT item_id, {_COLLAPSED} AS t FROM benchmark)
 SELECT doc_id, item_id, CAST(strpos(d.t, b.t) - 1 AS BIGINT) AS at FROM d JOIN b ON contains(d.t, b.t)""")
def evidence_locate(spark, d):
    p = _benchmark_pairs(spark, d).withColumn("at", T.locate(F.col("text"), F.col("item")))
    return p.where("at is not null").select("doc_id", "item_id", F.col("at").cast("long").alias("at"))


@query(rf"""WITH d AS (SELECT doc_id, {_COLLAPSED} AS t FROM documents), b AS (SELECT item_id, {_COLLAPSED} AS s FROM benchmark),
 p AS (SELECT doc_id, item_id, string_split(t, ' ') AS w, len(string_split(t, ' ')) AS n, len(list_filter(string_split(substr(t, 1, strpos(t, s) - 1), ' '), lambda x: x <> '')) + len(string_split(s, ' ')) // 2 - 30 AS mid FROM d JOIN b ON contains(t, s)),
 q AS (SELECT *, greatest(0, least(mid, n - 60)) AS f FROM p)
 SELECT doc_id, item_id, CASE WHEN f > 0 THEN '… ' ELSE '' END || array_to_string(w[f + 1 : f + 60], ' ') || CASE WHEN f + 60 < n THEN ' …' ELSE '' END AS excerpt FROM q""")
def evidence_excerpt(spark, d):
    p = _benchmark_pairs(spark, d).withColumn("excerpt", T.excerpt(F.col("text"), F.col("item")))
    return p.where("excerpt is not null").select("doc_id", "item_id", "excerpt")


@query()
def html_flat_text(spark, d):
    return _t(spark, d, "pages").select("page_id", html_to_text("html").alias("text"))


@query()
def html_page_text(spark, d):
    return _t(spark, d, "pages").select("page_id", extract_text("html").alias("x")).select("page_id", "x.title", "x.text")


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(value AS DOUBLE) AS value FROM events WHERE (props->>'$.k') IS NOT NULL""")
def json_props(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return _t(spark, d, "events").select("event_id", k.alias("k"), F.col("value").cast("double").alias("value")).where("k is not null")


@query("""SELECT t.conv_id, t.turn, t.role, r.role AS opened_by, length(t.text) AS chars FROM conversations t JOIN (SELECT conv_id, role FROM conversations WHERE turn = 0) r USING (conv_id) WHERE t.turn > 0""")
def thread_flatten(spark, d):
    c = _t(spark, d, "conversations")
    root = c.where("turn = 0").select("conv_id", F.col("role").alias("opened_by"))
    return c.where("turn > 0").join(root, "conv_id").select("conv_id", "turn", "role", "opened_by", F.length("text").cast("long").alias("chars"))


# --- mentions and corpus ----------------------------------------------------------


def _found(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "source")
    return mentions.with_mentions(docs, RULES, title=None)


#: The tiers of ``RULES`` word by word: words and what is between them with their places, then what follows what.
_TIERS = rf"""WITH w AS (SELECT doc_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+') AS t FROM documents)),
 p AS (SELECT *, lower(tok) AS x, CAST(coalesce(sum(length(tok)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, lead(tok, 1) OVER o AS g1, lower(lead(tok, 2) OVER o) AS x2, lead(tok, 3) OVER o AS g3, lower(lead(tok, 4) OVER o) AS x4,
   lead(tok, 5) OVER o AS g5, lead(tok, 7) OVER o AS g7, lower(lead(tok, 8) OVER o) AS x8, lower(lag(tok, 1) OVER o) AS b1, lower(lag(tok, 2) OVER o) AS b2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 -- The text with exclusions blank, where context is read.
 t AS (SELECT doc_id, string_agg(CASE WHEN x IN ('of', 'to') AND g1 = ' ' AND x2 = 'the' OR x = ' ' AND b1 IN ('of', 'to') AND lower(g1) = 'the' OR x = 'the' AND b1 = ' ' AND b2 IN ('of', 'to') THEN repeat(' ', length(tok)) ELSE tok END, '' ORDER BY i) AS blank FROM p GROUP BY 1),
 a AS (SELECT doc_id, s, CASE WHEN x = 'the' THEN 'english' WHEN x IN ('der', 'die') THEN 'german' WHEN x = 'le' THEN 'french' WHEN x = 'el' THEN 'spanish' WHEN x = 'all' AND g1 = ' ' AND x2 = 'rights' AND g3 = ' ' AND x4 = 'reserved' THEN 'rights'
   WHEN x IN ('license', 'licensed') AND g1 = ' ' AND x2 = 'under' OR x = 'released' AND g1 = ' ' AND x2 = 'under' AND g3 = ' ' AND x4 = 'the' AND g5 = ' ' AND g7 = ' ' AND x8 = 'license' THEN 'license' END AS entity FROM p),
 o AS (SELECT doc_id, s, s + length(tok) AS e, tok, CASE x WHEN 'to' THEN 'article' ELSE 'secret' END AS entity, '\b' || x || '\b' AS term, CASE x WHEN 'token' THEN 60 WHEN 'password' THEN 20 ELSE 12 END AS r FROM p
   WHERE x IN ('token', 'password') OR x = 'to' AND NOT coalesce(g1 = ' ' AND x2 = 'the', false)),
 c AS (SELECT o.*, substr(blank, greatest(0, s - r) + 1, e + r - greatest(0, s - r)) AS around FROM o JOIN t USING (doc_id)),
 k AS (SELECT *, CASE WHEN entity = 'article' THEN tok = 'To' OR regexp_matches(around, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])of($|[^\p{{L}}\p{{N}}\p{{M}}_])')
   ELSE contains(around, '=') OR r = 60 AND regexp_matches(around, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_])password($|[^\p{{L}}\p{{N}}\p{{M}}_])') END AS counts FROM c),
 m AS (SELECT doc_id, entity, s FROM a WHERE entity IS NOT NULL UNION SELECT doc_id, entity, s FROM k WHERE counts),
 j AS (SELECT doc_id, s, e, entity, term, 'no_context' AS reason FROM k WHERE NOT counts
   UNION ALL SELECT doc_id, s, s + 6, CASE x WHEN 'of' THEN 'english' ELSE 'article' END, '\b' || x || ' the\b', 'excluded' FROM p WHERE x IN ('of', 'to') AND g1 = ' ' AND x2 = 'the')"""


@query(_TIERS + " SELECT doc_id AS document_id, entity, count(*)::INTEGER AS mention_count, min(s)::INTEGER AS first_char_offset FROM m GROUP BY ALL")
def mention_counts(spark, d):
    return mentions.mention_rows(_found(spark, d))


@query(_TIERS + " SELECT entity, term, reason, count(*) AS n FROM j GROUP BY ALL")
def mention_rejections(spark, d):
    return mentions.rejection_counts(mentions.rejection_rows(_found(spark, d)))


_LOWER_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"


@query(rf"""SELECT doc_id AS document_id, entity, CAST(n AS INTEGER) AS mention_count FROM (
 SELECT doc_id, unnest(['english', 'french', 'rights', 'spanish']) AS entity, unnest([len(list_filter(w, lambda x: x = 'the')), len(list_filter(w, lambda x: x = 'le')), len(regexp_extract_all(text, '(?i)\ball rights reserved\b')), len(list_filter(w, lambda x: x = 'el'))]) AS n FROM (SELECT *, {_LOWER_WORDS} AS w FROM documents)) WHERE n > 0""")
def alias_counts(spark, d):
    one = Rules(aliases={e: RULES.aliases[e] for e in ("english", "french", "rights", "spanish")})
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return mentions.mention_rows(mentions.with_mentions(docs, one, title=None)).select("document_id", "entity", "mention_count")


@query(rf"""SELECT doc_id AS id, 'substring_only' AS reason, CAST(NULL AS VARCHAR) AS snippet FROM (SELECT *, {_LOWER_WORDS} AS w FROM documents) WHERE contains(lower(text), 'die') AND NOT list_contains(w, 'die') AND NOT list_contains(w, 'der')""")
def mention_audit(spark, d):
    f = _found(spark, d)
    return mentions.not_counted(f, mentions.mention_rows(f), mentions.rejection_rows(f), "german", "die")


@query(_TIERS + rf""", z AS (SELECT doc_id, reason, {_COLLAPSED.replace('text', 'cut')} AS snippet FROM (SELECT j.*, substr(text, greatest(0, s - 60) + 1, e + 60 - greatest(0, s - 60)) AS cut FROM j JOIN documents USING (doc_id) WHERE entity = 'article'))
 SELECT d.doc_id AS id, coalesce(reason, 'substring_only') AS reason, snippet FROM documents d LEFT JOIN (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY reason, snippet) <= 2) z USING (doc_id)
 WHERE contains(lower(text), 'to') AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = d.doc_id AND entity = 'article')""")
def mention_audit_rejected(spark, d):
    f = _found(spark, d)
    return mentions.not_counted(f, mentions.mention_rows(f), mentions.rejection_rows(f), "article", "to")


@query(r"""WITH m AS (SELECT DISTINCT o_custkey AS id, p_brand AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
 SELECT x.e AS a, y.e AS b, count(*) AS documents FROM m x JOIN m y ON x.id = y.id AND x.e < y.e GROUP BY ALL ORDER BY documents DESC, a, b LIMIT 10""")
def entity_pairs_top10(spark, d):
    o, li, p = _t(spark, d, "orders", "lineitem", "part")
    m = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("document_id"), F.col("p_brand").alias("entity")).distinct()
    return corpus.entity_pairs(m)


_SOV_SOURCES = ["src0", "src1", "src2"]


@query(rf"""WITH m AS (SELECT doc_id, source, unnest(['english', 'french', 'spanish']) AS entity, unnest([len(list_filter(w, lambda x: x = 'the')), len(list_filter(w, lambda x: x = 'le')), len(list_filter(w, lambda x: x = 'el'))]) AS n,
  length(text) > 2000 AS switching, length(text) > 4000 AS reason_v2 FROM (SELECT *, {_LOWER_WORDS} AS w FROM documents) WHERE source IN ('src0', 'src1', 'src2')), k AS (SELECT * FROM m WHERE n > 0)
 SELECT entity, count(*) AS documents, CAST(sum(n) AS BIGINT) AS mentions, count(*) FILTER (switching) AS switching_documents, count(*) FILTER (reason_v2) AS reason_v2_documents, count(*) FILTER (source = 'src0') AS docs_src0,
  count(*) FILTER (source = 'src1') AS docs_src1, count(*) FILTER (source = 'src2') AS docs_src2, count(*)::DOUBLE / greatest((SELECT count(DISTINCT doc_id) FROM k), 1) AS share FROM k GROUP BY entity""")
def share_of_voice(spark, d):
    docs = _t(spark, d, "documents").where(F.col("source").isin(_SOV_SOURCES)).select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "source")
    f = mentions.with_mentions(docs, RULES.of(["english", "french", "spanish"]), title=None).withColumns({"switching": F.length("body") > 2000, "reason_v2": F.length("body") > 4000})
    return corpus.share_of_voice(f, mentions.mention_rows(f), ["english", "french", "spanish"], _SOV_SOURCES)


@query(f"""SELECT source, count(*) AS documents, median({_WORDS})::DOUBLE AS median_words, median(length(text))::DOUBLE AS median_chars, avg(CASE WHEN {_WORDS} < 20 THEN 1 ELSE 0 END)::DOUBLE AS share_under_20_words,
 count(*) FILTER ({_PHRASE}) AS switching FROM documents GROUP BY 1""")
def corpus_report_by_source(spark, d):
    t = F.col("text")
    return corpus.source_report(_t(spark, d, "documents").select("source", T.word_count(t).alias("words"), F.length(t).alias("chars"), T.has_phrase(t, RULES.phrases).alias("switching")))


@query(f"""WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lower({_COLLAPSED}) ORDER BY doc_id) AS n FROM documents)
 SELECT source, count(*) FILTER (n = 1) AS kept, count(*) FILTER (n > 1) AS dropped, count(*) FILTER (n > 1)::DOUBLE / count(*) AS duplicate_rate FROM h GROUP BY 1""")
def duplicate_rates(spark, d):
    docs = dedupe.with_content_hash(_t(spark, d, "documents"), "text")
    kept, drops = dedupe.exact_dedupe(docs, order=[F.col("doc_id")], id_col="doc_id")
    gone = drops.join(docs.select(F.col("doc_id").alias("dropped_id"), "source"), "dropped_id")
    return corpus.duplicate_rates(kept, gone)


@query("""SELECT CASE WHEN grouping(source) = 1 THEN 'total' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN 'total' ELSE lang END AS lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)""")
def source_crosstab_margins(spark, d):
    return corpus.margins(_t(spark, d, "documents"), "source", "lang")


@query("""SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS low, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.25), 6) AS p25,
 round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS high FROM documents""")
def describe_lengths(spark, d):
    return corpus.describe(_t(spark, d, "documents"), "n_chars")


@query("""WITH c AS (SELECT quantile_cont(n_chars, 0.99) AS cap, min(n_chars) AS low FROM documents)
 SELECT CAST(least(floor((least(n_chars::DOUBLE, cap) - low) / (cap - low) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM documents, c GROUP BY 1""")
def length_histogram(spark, d):
    return corpus.histogram(_t(spark, d, "documents"), "n_chars")


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24""")
def month_volume(spark, d):
    m = _t(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return m.orderBy(F.desc("month")).limit(24)


@query("""SELECT n_name, coalesce(s, 0) AS n, CASE WHEN c IS NULL THEN 'never run' WHEN coalesce(s, 0) = 0 THEN 'ran, 0 rows' ELSE 'ok' END AS status
 FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey AS k, true AS c FROM customer) ON k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k2, count(*) AS s FROM supplier GROUP BY 1) ON k2 = n_nationkey""")
def coverage_status(spark, d):
    n, c, s = _t(spark, d, "nation", "customer", "supplier")
    named = n.select("n_name", F.col("n_nationkey").alias("k"))
    ran = c.select(F.col("c_nationkey").alias("k")).distinct().join(named, "k")
    rows = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).join(named, "k")
    return corpus.coverage(named, ran, rows, "n_name")


# --- duplicates -------------------------------------------------------------------

_RANKED = f"SELECT doc_id, row_number() OVER w AS n, first_value(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY lower({_COLLAPSED}) ORDER BY doc_id)"


@query(f"SELECT doc_id FROM ({_RANKED}) WHERE n = 1")
def exact_dedupe(spark, d):
    docs = dedupe.with_content_hash(_t(spark, d, "documents"), "text")
    return dedupe.exact_dedupe(docs, order=[F.col("doc_id")], id_col="doc_id")[0].select("doc_id")


@query(f"SELECT doc_id AS dropped_id, first AS kept_key, 'exact' AS reason, 1.0::DOUBLE AS similarity FROM ({_RANKED}) WHERE n > 1")
def exact_drops(spark, d):
    docs = dedupe.with_content_hash(_t(spark, d, "documents"), "text")
    return dedupe.exact_dedupe(docs, order=[F.col("doc_id")], id_col="doc_id")[1]


_TF = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}') AS w FROM documents WHERE {_WORDS} >= 30),
 g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
 tf AS (SELECT doc_id, g, count(*)::DOUBLE AS tf FROM g GROUP BY ALL), nm AS (SELECT doc_id, sum(tf * tf) AS sq FROM tf GROUP BY 1),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.tf * y.tf) AS dot FROM tf x JOIN tf y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)"""


@query(_TF + " SELECT a, b, round(dot / sqrt(na.sq * nb.sq), 6) AS similarity FROM p JOIN nm na ON na.doc_id = a JOIN nm nb ON nb.doc_id = b WHERE dot / sqrt(na.sq * nb.sq) >= 0.9 - 1e-12")
def near_dup_pairs(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return dedupe.near_pairs(docs).withColumn("similarity", F.round("similarity", 6))


@query(_TF.replace("WITH w AS", "WITH RECURSIVE w AS", 1) + """, e AS (SELECT a, b, dot / sqrt(na.sq * nb.sq) AS sim FROM p JOIN nm na ON na.doc_id = a JOIN nm nb ON nb.doc_id = b WHERE dot / sqrt(na.sq * nb.sq) >= 0.9 - 1e-12),
 nd AS (SELECT id, prev, row_number() OVER (ORDER BY id) AS i FROM (SELECT DISTINCT unnest([a, b]) AS id FROM e) LEFT JOIN (SELECT b AS id, list(a) AS prev FROM e GROUP BY 1) USING (id)),
 -- One document after another: it stays if no earlier one that stays is its pair.
 k(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nd.i, CASE WHEN prev IS NOT NULL AND list_has_any(kept, prev) THEN kept ELSE list_append(kept, id) END FROM k JOIN nd ON nd.i = k.i + 1),
 s AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM k ORDER BY i DESC LIMIT 1))
 SELECT b::VARCHAR AS dropped_id, a::VARCHAR AS kept_key, 'near' AS reason, round(sim, 4) AS similarity FROM e JOIN s ON s.id = a WHERE b NOT IN (SELECT id FROM s) QUALIFY row_number() OVER (PARTITION BY b ORDER BY sim DESC, a) = 1""")
def near_dup_survivors(spark, d):
    docs = dedupe.with_content_hash(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("external_id"), "doc_id", "source", F.col("text").alias("body")))
    kept, drops = dedupe.near_dedupe(docs, order=[F.col("doc_id")])
    return drops


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
 SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS similarity FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.5""")
def embedding_radius_pairs(spark, d):
    """All pairs within a radius, in blocks of rows: a product for each pair of blocks."""
    import numpy as np
    import pandas as pd

    v = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # Vectors that have no direction, or can't be compared, are in no pair; those of one length meet.
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    blocks = max(1, -(-v.count() // 2000))
    v = v.withColumn("k", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    v = v.withColumns({"i": F.least("k", "o"), "j": F.greatest("k", "o")})

    def run(key, f):
        x = np.array(f["v"].tolist(), np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        k, ids = f["k"].to_numpy(), f["vec_id"].to_numpy()
        a, b = np.nonzero((s >= 0.5) & (ids[:, None] < ids[None, :]) & ((k[:, None] != k[None, :]) | (key[1] == key[2])))
        return pd.DataFrame({"a": ids[a], "b": ids[b], "similarity": s[a, b].round(6)})

    return v.groupBy("dim", "i", "j").applyInPandas(run, "a long, b long, similarity double")


# --- signals, merges, samples -------------------------------------------------------


@query("""WITH n AS (SELECT event_type, date_trunc('day', ts)::DATE AS p, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT event_type, unnest(generate_series(min(p), max(p), interval 1 day))::DATE AS p FROM n GROUP BY 1)
 SELECT event_type, p AS period_start, coalesce(n, 0) AS new, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY event_type ORDER BY p) AS BIGINT) AS cumulative FROM r LEFT JOIN n USING (event_type, p)""")
def signals_daily(spark, d):
    return signals.filled_series(_t(spark, d, "events"), ["event_type"], F.col("ts"), "day")


@query("""WITH n AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS p, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_orderpriority, unnest(generate_series(min(p), max(p), interval 1 month))::DATE AS p FROM n GROUP BY 1)
 SELECT o_orderpriority, p AS period_start, coalesce(n, 0) AS new, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY o_orderpriority ORDER BY p) AS BIGINT) AS cumulative FROM r LEFT JOIN n USING (o_orderpriority, p)""")
def signals_monthly(spark, d):
    return signals.filled_series(_t(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderdate"))


@query("""WITH s AS (SELECT o_orderpriority, o_orderdate AS a, max(l_shipdate) AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, 1, 2)
 SELECT o_orderpriority, date_trunc('month', t)::DATE AS period_start, metric, count(*)::DOUBLE AS value FROM (SELECT o_orderpriority, a AS t, 'opened' AS metric FROM s UNION ALL SELECT o_orderpriority, b, 'closed' FROM s WHERE b IS NOT NULL)
 WHERE date_trunc('month', t) >= DATE '1996-03-01' GROUP BY ALL""")
def issue_velocity(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    done = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    rows = o.join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return signals.velocity(rows, ["o_orderpriority"], F.col("o_orderdate"), F.col("shipped"), F.lit("1996-03-15").cast("date"))


def _snapshots(spark, d):
    """Orders as of the end of 1998, and those since 1997: together all of them."""
    o, keep = _t(spark, d, "orders"), ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderdate < timestamp'1999-01-01'").select(*keep).withColumn("o_orderstatus", F.lit("?"))
    new = o.where("o_orderdate >= timestamp'1997-01-01'").select(*keep).withColumn("o_custkey", -F.col("o_custkey"))
    return old, new


_OLD = "SELECT o_orderkey, o_custkey, '?' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'"
_NEW = "SELECT o_orderkey, -o_custkey AS o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"


@query(f"""SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice
 FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.o_orderkey = n.o_orderkey""")
def keyed_merge(spark, d):
    old, new = _snapshots(spark, d)
    return merge.merge(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], order=[F.col("o_totalprice")])


@query(f"SELECT o_orderkey, 'removed' AS change FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW})) UNION ALL SELECT o_orderkey, 'added' FROM ({_NEW}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_OLD}))")
def snapshot_diff(spark, d):
    return merge.diff(*_snapshots(spark, d), ["o_orderkey"])


@query(f"SELECT * FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})")
def child_replace(spark, d):
    old, new = _snapshots(spark, d)
    return merge.replace_children(old, new, new, "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def anti_audit(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.where("o_orderpriority = '1-URGENT' and o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents ORDER BY substr(sha256('42:' || doc_id::VARCHAR), 1, 16), doc_id LIMIT 50")
def uniform_sample(spark, d):
    return sampling.uniform(_t(spark, d, "documents").select("doc_id"), 50, 42, "doc_id")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY source) // 5) AS k FROM documents) WHERE i % k = 0 AND i / k < 5""")
def systematic_sample(spark, d):
    return sampling.systematic(_t(spark, d, "documents").select("source", "doc_id"), 5, ["source"], ["doc_id"])


def _drawn(spark, d):
    f = _found(spark, d)
    t = F.col("body")
    marked = T.marked_sentences(t, RULES.platform, RULES.move, RULES.reason)
    rows = f.select("id", "source", T.word_count(t).alias("words"), F.array_sort(F.transform("mentions", lambda m: m["entity"])).alias("entities"), T.has_phrase(t, RULES.phrases).alias("flag"), T.reason_tier(marked).alias("prio"))
    return sampling.draw(rows, {"src0": 20, "src1": 15, "src2": 15}, 50, 30, {"spanish": 5, "french": 5, "secret": 3})


@query()
def stratified_draw(spark, d):
    return _drawn(spark, d)


@query()
def draw_coverage(spark, d):
    return sampling.coverage(_drawn(spark, d), ["english", "french", "spanish", "german"])


# --- labels -----------------------------------------------------------------------


@query("""WITH l AS (SELECT quality::VARCHAR AS x, toxic::VARCHAR AS y FROM labels), c AS (SELECT x, y, count(*)::DOUBLE AS n FROM l GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n) FILTER (x = y) AS a FROM c),
 e AS (SELECT sum(r.n * k.n) AS e FROM (SELECT x AS v, sum(n) AS n FROM c GROUP BY 1) r JOIN (SELECT y AS v, sum(n) AS n FROM c GROUP BY 1) k USING (v))
 SELECT n::BIGINT AS n, coalesce(a, 0)::BIGINT AS agree, round(a / n, 9) AS pct_agree, round((a / n - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM t, e""")
def kappa(spark, d):
    k = labels.kappa(_t(spark, d, "labels"), "quality", "toxic")
    return k.select("n", "agree", F.round("pct_agree", 9).alias("pct_agree"), F.round("kappa", 9).alias("kappa"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, d):
    return labels.confusion(_t(spark, d, "labels"), "quality", "toxic")


_SHEET = "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS draft_label, CASE WHEN doc_id % 5 = 0 THEN CASE toxic WHEN 1 THEN 'bad' ELSE 'good' END ELSE ' ' END AS my_label, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS draft_direction, '' AS my_direction FROM labels"


def _final(spark, d):
    s = _t(spark, d, "labels")
    word = lambda c, a, b: F.when(F.col(c) == 1, a).otherwise(b)
    s = s.select("doc_id", word("quality", "good", "poor").alias("draft_label"), F.when(F.col("doc_id") % 5 == 0, word("toxic", "bad", "good")).otherwise(" ").alias("my_label"), word("toxic", "yes", "no").alias("draft_direction"), F.lit("").alias("my_direction"))
    return labels.final_labels(s, {"label": "label", "direction": "direction"}, {"bad": "poor"})


@query(f"""SELECT doc_id, draft_label, CASE WHEN trim(my_label) = '' THEN draft_label WHEN my_label = 'bad' THEN 'poor' ELSE my_label END AS label, draft_direction, draft_direction AS direction FROM ({_SHEET})""")
def final_labels(spark, d):
    return _final(spark, d)


_AGREED = f"SELECT doc_id, draft_label AS a1, CASE WHEN trim(my_label) = '' THEN draft_label WHEN my_label = 'bad' THEN 'poor' ELSE my_label END AS b1, draft_direction AS a2, draft_direction AS b2 FROM ({_SHEET})"


@query(f"""WITH l AS (SELECT 'label' AS field, a1 AS a, b1 AS b FROM ({_AGREED}) UNION ALL SELECT 'direction', a2, b2 FROM ({_AGREED})), c AS (SELECT field, a, b, count(*)::DOUBLE AS n FROM l GROUP BY ALL),
 t AS (SELECT field, sum(n) AS n, coalesce(sum(n) FILTER (a = b), 0) AS agree, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c GROUP BY 1),
 e AS (SELECT field, sum(x.n * y.n) AS e FROM (SELECT field, a AS v, sum(n) AS n FROM c GROUP BY ALL) x JOIN (SELECT field, b AS v, sum(n) AS n FROM c GROUP BY ALL) y USING (field, v) GROUP BY 1)
 SELECT field, n::BIGINT AS n, agree::BIGINT AS agree, round(agree / n, 9) AS pct_agree, CASE WHEN ka > 1 AND kb > 1 THEN round((agree / n - e / (n * n)) / (1 - e / (n * n)), 9) END AS kappa FROM t JOIN e USING (field)""")
def label_agreement(spark, d):
    k = labels.agreement(_final(spark, d), ["label", "direction"])
    return k.withColumns({"pct_agree": F.round("pct_agree", 9), "kappa": F.round("kappa", 9)})


@query(f"""SELECT draft_label AS code, count(*) AS n, count(*) FILTER (draft_label = label) AS kept, count(*) FILTER (draft_label = label)::DOUBLE / count(*) AS share FROM (
 SELECT draft_label, CASE WHEN trim(my_label) = '' THEN draft_label WHEN my_label = 'bad' THEN 'poor' ELSE my_label END AS label FROM ({_SHEET})) GROUP BY 1""")
def label_kept_share(spark, d):
    return labels.kept_share(_final(spark, d), "label")


@query("""SELECT CASE WHEN grouping(q) = 1 THEN 'total' ELSE q END AS quality, CASE WHEN grouping(source) = 1 THEN 'total' ELSE source END AS source, count(*) AS n FROM (SELECT quality::VARCHAR AS q, source FROM labels JOIN documents USING (doc_id)) GROUP BY CUBE (q, source)""")
def pooled_labels(spark, d):
    lb, docs = _t(spark, d, "labels", "documents")
    return labels.pooled(lb.join(docs.select("doc_id", "source"), "doc_id").withColumn("quality", F.col("quality").cast("string")), "quality", "source")


@query("""WITH r AS (SELECT doc_id, toxic = 1 AS yes, length(text) > 3000 AS long, regexp_matches(text, '(?i)\\b(idiot|moron|clown|loser|trash)\\b') AS words FROM labels JOIN documents USING (doc_id)),
 e AS (SELECT 'long' AS detector, doc_id, yes, long AS f FROM r UNION ALL SELECT 'words', doc_id, yes, words FROM r)
 SELECT detector, count(*) FILTER (f) AS flagged, count(*) FILTER (f AND yes) AS tp, count(*) FILTER (f AND yes)::DOUBLE / nullif(count(*) FILTER (f), 0) AS precision, count(*) FILTER (f AND yes)::DOUBLE / nullif(count(*) FILTER (yes), 0) AS recall,
  coalesce(string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) FILTER (yes AND NOT f), '') AS missed FROM e GROUP BY 1""")
def detector_eval(spark, d):
    lb, docs = _t(spark, d, "labels", "documents")
    t = F.col("text")
    found = {"long": F.length(t) > 3000, "words": T.has_phrase(t, ["idiot", "moron", "clown", "loser", "trash"])}
    return labels.evaluate(lb.join(docs, "doc_id"), F.col("toxic") == 1, found)


@query("""SELECT detector, doc_id AS id FROM (SELECT doc_id, unnest(['long', 'words']) AS detector, unnest([length(text) > 3000, regexp_matches(text, '(?i)\\b(idiot|moron|clown|loser|trash)\\b')]) AS f FROM labels JOIN documents USING (doc_id) WHERE toxic = 1) WHERE f IS NOT TRUE""")
def detector_missed(spark, d):
    lb, docs = _t(spark, d, "labels", "documents")
    t = F.col("text")
    found = {"long": F.length(t) > 3000, "words": T.has_phrase(t, ["idiot", "moron", "clown", "loser", "trash"])}
    return labels.missed(lb.join(docs, "doc_id"), F.col("toxic") == 1, found)


_REASONS = "SELECT doc_id, source, CASE WHEN quality = 1 AND toxic = 0 THEN 'none' WHEN toxic = 1 THEN 'toxic' ELSE 'poor' END AS taxonomy_code FROM labels JOIN documents USING (doc_id)"


def _reasons(spark, d):
    lb, docs = _t(spark, d, "labels", "documents")
    code = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "none").when(F.col("toxic") == 1, "toxic").otherwise("poor")
    return lb.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "source", code.alias("taxonomy_code"))


@query(f"""WITH r AS ({_REASONS}) SELECT taxonomy_code, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT taxonomy_code FROM r WHERE taxonomy_code <> 'none') CROSS JOIN (SELECT DISTINCT source FROM r)
 LEFT JOIN (SELECT taxonomy_code, source, count(*) AS n FROM r GROUP BY ALL) USING (taxonomy_code, source)""")
def reason_tables(spark, d):
    return labels.reason_tables(_reasons(spark, d))


@query(f"""WITH c AS (SELECT taxonomy_code AS category, count(*) AS with_all, count(*) FILTER (source <> 'src0') AS without FROM ({_REASONS}) WHERE taxonomy_code <> 'none' GROUP BY 1)
 SELECT *, row_number() OVER (ORDER BY with_all DESC, category)::INTEGER AS rank_with, row_number() OVER (ORDER BY without DESC, category)::INTEGER AS rank_without FROM c""")
def reason_sensitivity(spark, d):
    return labels.sensitivity(_reasons(spark, d), F.col("source") == "src0")


@query("""WITH l AS (SELECT doc_id, 'mit' AS span FROM labels) SELECT doc_id AS document_id, 'no label' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT doc_id, 'quality: 0' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'evidence is not in the text' FROM labels JOIN documents USING (doc_id) WHERE NOT contains(text, 'mit')""")
def label_violations(spark, d):
    lb, docs = _t(spark, d, "labels", "documents")
    rows = lb.select(F.col("doc_id").alias("document_id"), F.col("quality").cast("string").alias("quality"), F.lit("mit").alias("evidence_span"))
    return labels.violations(rows, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")), {"quality": ["1"]})


# --- market, matrix, simulation ------------------------------------------------------

_VALUES = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in market.BASE.items())
_DIMENSIONS = (
    f"p AS (SELECT * FROM (VALUES {_VALUES}) t(key, value)), w AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in market.WORKLOADS) + ") t(w, workload)), d AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in market.DEPLOYMENTS)
    + ") t(d, deployment)), t AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in market.TIERS) + ") t(t, tier)), r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s!r}::DOUBLE)" for n, s in market.REGIONS) + ") t(region, share))"
)
_SEGMENTS = f"""WITH {_DIMENSIONS}, x AS (SELECT workload, deployment, tier, region, f.value * a.value * s.value * ws.value * ds.value * r.share AS size, (cw.value + cd.value) / 2 AS g FROM w, d, t, r, p f, p a, p s, p ws, p ds, p cw, p cd
 WHERE f.key = 'firms_' || t AND a.key = 'adoption_' || t AND s.key = 'spend_' || t AND ws.key = 'share_' || w AND ds.key = 'deploy_' || d AND cw.key = 'cagr_' || w AND cd.key = 'cagr_deploy_' || d),
 seg AS (SELECT workload, deployment, tier, region, {", ".join(f"round(size * pow(1 + g, {n}), 2) AS size_{2025 + n}" for n in range(6))}, round(g, 4) AS cagr FROM x)"""


def _whole(df, *columns):
    """Sums of cents are compared in thousands: SQL rounds some cells to another cent."""
    return df.withColumns({c: F.round(F.col(c) / 1000, 0) for c in columns})


@query(_SEGMENTS + " SELECT workload, deployment, tier, region, " + ", ".join(f"round(size_{y} / 1000, 0) AS size_{y}" for y in range(2025, 2031)) + ", cagr FROM seg")
def market_segments(spark, d):
    return _whole(market.segments(market.assumptions(spark)), *[f"size_{y}" for y in range(2025, 2031)])


@query(_SEGMENTS + " SELECT workload, deployment, round(sum(size_2025) / 1000, 0) AS size_2025, round(sum(size_2030) / 1000, 0) AS size_2030, round(pow(round(sum(size_2030), 2) / round(sum(size_2025), 2), 0.2) - 1, 4) AS cagr FROM seg GROUP BY ALL")
def market_totals(spark, d):
    return _whole(market.totals(market.segments(market.assumptions(spark)), ["workload", "deployment"]), "size_2025", "size_2030")


@query(_SEGMENTS + " SELECT (SELECT sum(value) FROM p WHERE key LIKE 'top_down_%') AS top_down, (SELECT count(*) FROM p WHERE key LIKE 'top_down_%') AS n_references, round(sum(size_2025) / 1000, 0) AS bottom_up, round((sum(size_2025) - (SELECT sum(value) FROM p WHERE key LIKE 'top_down_%')) / 1000, 0) AS gap FROM seg")
def market_top_down(spark, d):
    p = market.assumptions(spark)
    return _whole(market.top_down(p, market.segments(p)), "bottom_up", "gap")


_CASES = " UNION ALL ".join(f"SELECT '{k}' AS input, '{n}' AS direction, {by!r}::DOUBLE AS factor" for k in market.DRIVERS for n, by in (("low", 0.8), ("high", 1.2)))
_GRID = "f.value * a.value * s.value * ws.value * ds.value * r.share * pow(1 + (cw.value + cd.value) / 2, 5)"


@query(f"""WITH {_DIMENSIONS}, c AS ({_CASES} UNION ALL SELECT 'base', '', 1.0::DOUBLE), q AS (SELECT c.input, c.direction, key, CASE WHEN key = c.input THEN value * factor ELSE value END AS value FROM p, c),
 x AS (SELECT f.input, f.direction, sum({_GRID}) AS total FROM w, d, t, r, q f, q a, q s, q ws, q ds, q cw, q cd WHERE f.key = 'firms_' || t AND a.key = 'adoption_' || t AND s.key = 'spend_' || t AND ws.key = 'share_' || w AND ds.key = 'deploy_' || d AND cw.key = 'cagr_' || w AND cd.key = 'cagr_deploy_' || d
  AND {" AND ".join(f"f.input = {k}.input AND f.direction = {k}.direction" for k in ("a", "s", "ws", "ds", "cw", "cd"))} GROUP BY ALL)
 SELECT input, direction, round((total - (SELECT total FROM x WHERE input = 'base')) / 1000, 0) AS delta FROM x WHERE input <> 'base'""")
def market_sensitivity(spark, d):
    return _whole(market.sensitivity(market.assumptions(spark)), "delta")


@query(_SEGMENTS + " SELECT DISTINCT workload, deployment, cagr FROM seg ORDER BY cagr DESC, workload, deployment LIMIT 5")
def market_fastest(spark, d):
    return market.fastest(market.segments(market.assumptions(spark)))


@query(_SEGMENTS + " SELECT workload, deployment, tier, region, round(size_2030 / 1000, 0) AS size_2030, row_number() OVER (ORDER BY size_2030 DESC, workload, deployment, tier, region)::INTEGER AS rank FROM seg")
def market_ranked(spark, d):
    return _whole(market.ranked(market.segments(market.assumptions(spark))), "size_2030").select("workload", "deployment", "tier", "region", "size_2030", "rank")


_BRANDS = ["Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15"]
_FEATURES = "SELECT p_brand AS vendor, p_type AS capability, split_part(p_type, ' ', 1) AS \"group\", p_size AS score FROM part"


def _features(spark, d):
    return _t(spark, d, "part").select(F.col("p_brand").alias("vendor"), F.col("p_type").alias("capability"), F.split("p_type", " ")[0].alias("group"), F.col("p_size").alias("score"))


@query(f"SELECT capability, " + ", ".join(f"avg(score) FILTER (vendor = '{b}') AS \"{b}\"" for b in _BRANDS) + f" FROM ({_FEATURES}) GROUP BY 1")
def feature_matrix(spark, d):
    return matrix.feature_matrix(_features(spark, d), _BRANDS)


@query("SELECT \"group\", " + ", ".join(f"round(avg(score) FILTER (vendor = '{b}'), 6) AS \"{b}\"" for b in _BRANDS) + f" FROM ({_FEATURES}) GROUP BY 1")
def group_scores(spark, d):
    return matrix.group_scores(_features(spark, d), _BRANDS, 6)


@query(f"SELECT vendor, round(avg(score) FILTER (\"group\" = 'PROMO'), 6) AS deploy_flex, round(avg(score) FILTER (\"group\" = 'SMALL'), 6) AS openness FROM ({_FEATURES}) GROUP BY 1")
def positioning(spark, d):
    f = _features(spark, d).withColumn("capability", F.col("group"))
    return matrix.positions(f, ("PROMO",), ("SMALL",), 6)


@query()
def crm_simulated_win_rate(spark, d):
    t = crm.generate(spark)
    return crm.win_rate(t["opportunities"].join(t["accounts"], "account_id"), ["competitor", "tier", "deployment"], F.col("outcome") == "Won")


@query()
def crm_simulated_usage_deciles(spark, d):
    t = crm.generate(spark)
    return crm.churn_by_decile(t["usage_monthly"], "account_id", "consumption_units", t["renewals"], F.col("churn"), F.col("contraction"))


@query()
def crm_simulated_delivery(spark, d):
    r = crm.generate(spark)["releases"]
    return crm.delivery(r, "pm_team", F.col("planned_points"), F.col("delivered_points"), F.col("on_time"), F.datediff("actual_release_date", "planned_release_date"))


# --- ingestion, label sets, findings -------------------------------------------------


def _envelopes(spark, d):
    """Documents as the raw comments of a source."""
    raw_ = F.to_json(F.struct(F.col("text").alias("body"), F.col("source").alias("author"), F.concat(F.lit("/d/"), "doc_id").alias("permalink"), F.lit(1700000000.0).alias("created_utc"), F.col("n_chars").alias("score")))
    return _t(spark, d, "documents").select(F.lit("reddit").alias("source"), F.lit("comment").alias("kind"), F.col("doc_id").cast("string").alias("external_id"), F.lit("2024-05-01").cast("timestamp").alias("fetched_at"), F.lit("q").alias("query"), raw_.alias("raw"))


@query(rf"""WITH t AS (SELECT *, regexp_replace(regexp_replace(text, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '') AS body FROM documents)
 SELECT doc_id::VARCHAR AS external_id, '/d/' || doc_id AS url, n_chars::INTEGER AS score, length(body)::INTEGER AS chars, epoch(TIMESTAMP '2023-11-14 22:13:20')::BIGINT AS posted FROM t WHERE body NOT IN ('', '[deleted]', '[removed]')""")
def ingested_documents(spark, d):
    docs = raw.to_documents(_envelopes(spark, d), "salt")
    return docs.select("external_id", "url", "score", F.length("body").alias("chars"), F.unix_timestamp("posted_at").alias("posted"))


@query("""WITH e AS (SELECT event_type AS entity, date_trunc('month', ts)::DATE AS period_start, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY entity ORDER BY period_start) AS total FROM e)
 SELECT entity, period_start, 'new_stars' AS metric, n::DOUBLE AS value, 'stars' AS unit FROM c UNION ALL SELECT entity, period_start, 'cumulative_stars', total::DOUBLE, 'stars' FROM c""")
def ingested_signals(spark, d):
    raw_ = F.to_json(F.struct(F.col("event_type").alias("repo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("starred_at")))
    items = _t(spark, d, "events").select(F.lit("github").alias("source"), F.lit("repo_stars").alias("kind"), F.col("event_id").cast("string").alias("external_id"), F.lit("2024-05-01").cast("timestamp").alias("fetched_at"), F.lit("q").alias("query"), raw_.alias("raw"))
    return raw.to_signals(items).select("entity", "period_start", "metric", "value", "unit")


@query("SELECT event_type AS signal_type, count(*) AS n_rows, count(DISTINCT user_id) AS entities, min(ts)::DATE AS first, max(ts)::DATE AS last FROM events GROUP BY 1")
def signal_summary(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("signal_type"), F.col("user_id").alias("entity"), F.to_date("ts").alias("period_start"))
    return signals.summary(e)


_SETS = "SELECT doc_id AS document_id, source AS sample, CASE WHEN toxic = 1 THEN 'review' ELSE 'draft' END AS labeled_by FROM labels JOIN documents USING (doc_id)"


@query(f"SELECT s.* FROM ({_SETS}) s JOIN (SELECT sample, max(labeled_by) AS best FROM ({_SETS}) GROUP BY 1) b ON s.sample = b.sample AND s.labeled_by = b.best")
def preferred_labels(spark, d):
    lb, docs = _t(spark, d, "labels", "documents")
    rows = lb.join(docs.select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("document_id"), F.col("source").alias("sample"), F.when(F.col("toxic") == 1, "review").otherwise("draft").alias("labeled_by"))
    return labels.preferred(rows, ["review", "draft"])


def _lens(spark, d):
    """Documents with a made time of posting, mentions of aliases, labels as codes."""
    docs, lb = _t(spark, d, "documents", "labels")
    docs = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "source", F.timestamp_seconds(F.when(F.col("doc_id") % 7 > 0, 1600000000 + (F.col("doc_id") % 1000) * 86400)).alias("posted_at"))
    found = mentions.mention_rows(mentions.with_mentions(docs.select("id", "body"), RULES.of(_VOICES), title=None))
    codes = lb.select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "none").otherwise("poor").alias("taxonomy_code"))
    return docs, found, codes


_VOICES = ["english", "french", "spanish"]
_LENS = rf"""WITH t AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 7 > 0 THEN TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (1600000000 + (doc_id % 1000) * 86400) END AS posted, {_LOWER_WORDS} AS w FROM documents),
 f AS (SELECT *, list_concat(CASE WHEN list_contains(w, 'le') THEN ['french'] ELSE []::VARCHAR[] END, CASE WHEN list_contains(w, 'el') THEN ['spanish'] ELSE []::VARCHAR[] END) AS others FROM t WHERE list_contains(w, 'the')),
 l AS (SELECT f.*, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'none' WHEN quality IS NOT NULL THEN 'poor' END AS code FROM f LEFT JOIN labels ON doc_id = id)"""


@query(_LENS + " SELECT id, source, strftime(posted, '%Y-%m-%dT%H:%M:%S') AS posted_at, array_to_string(others, ' ') AS others, code AS taxonomy_code FROM l")
def entity_lens_documents(spark, d):
    docs, found, codes = _lens(spark, d)
    return findings_.lens_documents(docs, found, codes, "english", _VOICES).withColumn("others", F.array_join("others", " "))


@query(_LENS + " SELECT source, coalesce(year(posted), 0)::INTEGER AS year, count(*) AS documents, count(code) AS labelled, count(*) FILTER (len(others) > 0) AS with_others FROM l GROUP BY ALL")
def entity_lens(spark, d):
    docs, found, codes = _lens(spark, d)
    return findings_.lens(findings_.lens_documents(docs, found, codes, "english", _VOICES)).na.fill(0, ["year"])


@query()
def findings(spark, d):
    docs, found, codes = _lens(spark, d)
    docs = docs.withColumns({"switching": F.length("body") > 2000, "reason_v2": F.length("body") > 4000})
    sets = codes.withColumn("labeled_by", F.lit("review")).unionByName(codes.withColumn("labeled_by", F.lit("model_draft")))
    return to_json(findings_.findings(docs, found, sets, _VOICES, _SOV_SOURCES, [1, 2, 3]))


@query("SELECT doc_id, quality, toxic FROM labels ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, doc_id")
def review_order(spark, d):
    return ordering.tiered(_t(spark, d, "labels"), [F.col("toxic") == 1, F.col("quality") == 0], "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT r_name, coalesce(r_regionkey, -1) AS r_regionkey FROM (VALUES (0, 'ASIA'), (1, 'ATLANTIS'), (2, 'AFRICA')) v(k, r_name) LEFT JOIN region USING (r_name) ORDER BY k")
def listed_regions(spark, d):
    return ordering.listed(_t(spark, d, "region").select("r_name", "r_regionkey"), "r_name", ["ASIA", "ATLANTIS", "AFRICA"]).na.fill(-1)


@query(_SEGMENTS.replace("seg AS", "unused AS") + f" SELECT input || '' AS scenario, total FROM (SELECT 'low' AS input, round(sum(size * pow(1 + g, 5)) * 0.8 / 1000, 0) AS total FROM x UNION ALL SELECT 'high', round(sum(size * pow(1 + g, 5)) * 1.2 / 1000, 0) FROM x UNION ALL SELECT 'base', round(sum(size * pow(1 + g, 5)) / 1000, 0) FROM x)")
def market_scenarios(spark, d):
    a = market.assumptions(spark)
    spend = F.col("key").startswith("spend_")
    a = a.select("key", "value", *[F.when(spend, F.col("value") * by).alias(n) for n, by in (("low", 0.8), ("base", 1.0), ("high", 1.2))])
    total = lambda n: market.segments(market.scenario(a, n)).agg(F.round(F.sum("size_2030") / 1000, 0).alias("total")).select(F.lit(n).alias("scenario"), "total")
    return total("low").union(total("base")).union(total("high"))
