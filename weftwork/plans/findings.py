"""The findings document: one nested row put together from the corpus, the labels and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftwork.functions.text import locate
from weftwork.operators.corpus import share_of_voice
from weftwork.operators.labels import kappa, reason_tables, sensitivity
from weftwork.operators.merge import fingerprint
from weftwork.session import materialize


def _list(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One row with all rows of a small frame as an array of structs in order."""
    keys = [F.col(c) for c in order]
    rest = [c for c in df.columns if c not in order]
    return df.agg(F.array_sort(F.collect_list(F.struct(*keys, *rest))).alias(name))


def findings(docs: DataFrame, mentions: DataFrame, labels: DataFrame, entities: list[str], sources: list[str], promotional: list[int], label_set: str = "review") -> DataFrame:
    """``docs(id, source, posted_at, switching, reason_v2)``, ``labels(document_id, labeled_by, taxonomy_code, ...)``
    -> a row: share of voice, reasons by category and source, with and without promotional documents,
    agreement of label sets, documents by year. Each part is an aggregate of a few rows."""
    voice = _list(share_of_voice(docs, mentions, entities, sources).withColumn("rank", -F.col("documents")), "share_of_voice", ["rank", "entity"])
    own = labels.where(F.col("labeled_by") == label_set).join(docs.select(F.col("id").alias("document_id"), "source"), "document_id")
    reasons = _list(reason_tables(own), "reasons", ["taxonomy_code", "source"])
    ranks = _list(sensitivity(own, F.col("document_id").isin(promotional)), "sensitivity", ["rank_with"])
    a = labels.where("labeled_by = 'model_draft'").select("document_id", F.col("taxonomy_code").alias("a"))
    agree = _list(kappa(a.join(own.select("document_id", F.col("taxonomy_code").alias("b")), "document_id"), "a", "b"), "agreement", ["n"])
    years = _list(docs.where("posted_at is not null").groupBy(F.year("posted_at").alias("year")).agg(F.count("*").alias("documents")), "by_year", ["year"])
    head = docs.agg(F.count("*").alias("documents"))
    for part in (voice, reasons, ranks, agree, years):
        head = head.crossJoin(part)  # one row each
    return head


def lens_documents(docs: DataFrame, mentions: DataFrame, labels: DataFrame, entity: str, entities: list[str]) -> DataFrame:
    """The documents that mention an entity, oldest first: ``(id, source, posted_at, others, taxonomy_code)``, the time
    in ISO form, null where it is missing, and ``others`` the other entities that they mention."""
    m = mentions.where(F.col("entity").isin([*entities, entity])).groupBy("document_id").agg(F.array_sort(F.collect_set("entity")).alias("all"))
    m = m.where(F.array_contains("all", entity)).select(F.col("document_id").alias("id"), F.array_except("all", F.array(F.lit(entity))).alias("others"))
    code = labels.groupBy(F.col("document_id").alias("id")).agg(F.min("taxonomy_code").alias("taxonomy_code"))
    d = docs.join(m, "id").join(code, "id", "left").orderBy(F.col("posted_at").asc_nulls_last(), "id")
    return d.select("id", "source", F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"), "others", "taxonomy_code")


def lens(found: DataFrame) -> DataFrame:
    """Counts of ``lens_documents`` by source and year: ``(source, year, documents, labelled, with_others)``."""
    year = F.substring("posted_at", 1, 4).cast("int")
    return found.groupBy("source", year.alias("year")).agg(F.count("*").alias("documents"), F.count("taxonomy_code").alias("labelled"), F.count_if(F.size("others") > 0).alias("with_others"))


def checked(findings: DataFrame, *problems: DataFrame) -> DataFrame:
    """The findings, if no gate has a row: stored labels that aren't the committed ones, or evidence that isn't in the text."""
    for p in problems:
        bad = p.limit(5).collect()
        if bad:
            raise ValueError(f"findings don't hold: {[r.asDict() for r in bad]}")
    return findings


def gates(labels: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are in only one of the stored and the committed labels: must be empty."""
    a, b = labels.select(*keys), committed.select(*keys)
    return a.exceptAll(b).withColumn("only_in", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("committed")))


def passed(labels: DataFrame, committed: DataFrame, docs: DataFrame, keys: list[str], evidence: str = "evidence_span") -> tuple[DataFrame, dict[str, int]]:
    """``labels``, written once, if their rows are the committed ones in ``keys`` and every piece of evidence is in its document,
    word for word; and ``{"labels": n, "quotes": n}``. Else an error names some of what is wrong.

    Both gates are metrics observed while the labels are written: they cost no pass of their own, and no shuffle but that
    of the quoted documents. ``labels(document_id, evidence..., ...)``, ``docs(id, body)``; blank evidence is none.
    """
    rows, quotes = Observation(), Observation()
    stored = materialize(labels.observe(rows, *fingerprint(labels.select(*keys))), "findings-labels")
    if rows.get != committed.agg(*fingerprint(committed.select(*keys))).first().asDict():
        checked(labels, gates(stored, committed, keys))
    said = stored.where(F.trim(F.coalesce(evidence, F.lit(""))) != "").select("document_id", evidence)
    said = said.join(docs.select(F.col("id").alias("document_id"), "body"), "document_id", "left")
    wrong = locate(F.col("body"), F.col(evidence)).isNull()
    said = said.withColumn("wrong", wrong).observe(quotes, F.count(F.lit(1)).alias("quotes"), F.count_if("wrong").alias("wrong"))
    bad = materialize(said.where("wrong").select("document_id", evidence), "findings-quotes")
    if quotes.get["wrong"]:
        checked(labels, bad)
    return stored, {"labels": rows.get["n"], "quotes": quotes.get["quotes"]}
