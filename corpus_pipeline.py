"""A corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token output.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
reread as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import token_store
from weftwork.llm.decontaminate import contaminated
from weftwork.llm.langid import identify
from weftwork.llm.mixing import mix
from weftwork.llm.ngram_join import jaccard_components
from weftwork.llm.tokens import public_file
from weftwork.session import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _named(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose doc_id is, or isn't, one of ``ids``. A null is an id like any other."""
    ids = ids.select(F.col("doc_id").alias("named")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["named"]), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; rejected ones go. ``doc_id`` names a document, so that
    rows of one id, and rows without id, share a verdict: they go if one of them is rejected."""
    return _named(docs, identify(docs).where("not kept"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8: the one with the smallest doc_id.
    Documents without words, or without id, are linked with nothing and stay."""
    found = jaccard_components(docs, width=5, num=4, den=5)
    return _named(docs, found.where("doc_id <> component_id"), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item; all rows of an id, or without id, go if one has an overlap."""
    return _named(docs, contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. One without words costs nothing of its source's target and isn't taken;
    rows of one id have one hash, and each is taken as often as the longest of them."""
    times = mix(docs).where("taken > 0").groupBy("doc_id").agg(F.max(F.expr("taken div size")).cast("int").alias("times"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    times = times.withColumnRenamed("doc_id", "named")
    both = rows.join(times, rows["row.doc_id"].eqNullSafe(times["named"]))
    return both.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id files of what is left, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return token_store.digest(spark, token_store.write(docs, public_file("byte_bpe_50k.json"), 2))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("source_mix", mixed),
    ("token_output", tokens),
]

#: SQL has no language model, no tokenizer and no range coder: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
