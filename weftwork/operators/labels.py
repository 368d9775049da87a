"""Label review: drafts and reviews, agreement, pooling, detector evaluation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import locate, ratio


def final_labels(sheet: DataFrame, fields: dict[str, str], codes: dict[str, str] | None = None) -> DataFrame:
    """A blank reviewer's cell keeps the draft. ``fields``: name -> suffix of ``draft_`` and ``my_`` columns;
    ``codes`` renames codes on both sides, so that a merge of two codes isn't a disagreement."""
    remap = F.create_map(*[F.lit(x) for kv in (codes or {"": ""}).items() for x in kv])
    code = lambda c: F.coalesce(F.element_at(remap, c), c)
    out = {}
    for name, suffix in fields.items():
        draft = F.coalesce(F.trim(f"draft_{suffix}"), F.lit(""))
        mine = F.coalesce(F.nullif(F.trim(f"my_{suffix}"), F.lit("")), draft)
        out |= {f"draft_{name}": code(draft), name: code(mine)}
    return sheet.select("doc_id", *[c.alias(n) for n, c in out.items()])


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """``(by..., n, agree, pct_agree, kappa)``; kappa is null without rows, or if a rater has one value only."""
    by = by or []
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
    cell = d.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    total = cell.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("agree"), F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"))
    row = cell.groupBy(*by, F.col("x").alias("v")).agg(F.sum("n").alias("nx"))
    col = cell.groupBy(*by, F.col("y").alias("v")).agg(F.sum("n").alias("ny"))
    pe = row.join(col, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("e"))
    t = total.join(pe, by, "left") if by else total.crossJoin(pe)
    po, e = F.col("agree") / F.col("n").cast("double"), F.coalesce("e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    k = F.when((F.col("kx") > 1) & (F.col("ky") > 1), F.try_divide(po - e, 1 - e))
    return t.select(*by, F.col("n").cast("long").alias("n"), F.col("agree").cast("long").alias("agree"), po.alias("pct_agree"), k.alias("kappa"))


def agreement(final: DataFrame, fields: list[str], subsets: dict[str, Column] | None = None) -> DataFrame:
    """Agreement of draft and final labels for each field, and for each of ``subsets``, conditions by name, if they are given."""
    pairs = ", ".join(f"'{f}', draft_{f}, {f}" for f in fields)
    if not subsets:
        return kappa(final.selectExpr(f"stack({len(fields)}, {pairs}) as (field, a, b)"), "a", "b", ["field"])
    inside = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    each = final.withColumn("subset", F.explode(inside))
    return kappa(each.selectExpr("subset", f"stack({len(fields)}, {pairs}) as (field, a, b)"), "a", "b", ["subset", "field"])


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def kept_share(final: DataFrame, field: str) -> DataFrame:
    """Of the drafts of each code, how many the reviewer kept."""
    k = final.groupBy(F.col(f"draft_{field}").alias("code")).agg(F.count("*").alias("n"), F.count_if(F.col(f"draft_{field}") == F.col(field)).alias("kept"))
    return k.withColumn("share", ratio(F.col("kept"), F.col("n")))


def preferred(labels: DataFrame, order: list[str]) -> DataFrame:
    """The rows of the label set that comes first in ``order``, for each sample."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("labeled_by"))
    best = labels.where(rank > 0).groupBy("sample").agg(F.min(rank).alias("best"))
    return labels.join(best, "sample").where(rank == F.col("best")).drop("best")


def pooled(labels: DataFrame, codes: str = "taxonomy_code", group: str = "source") -> DataFrame:
    """Codes by group, with totals; documents without a reason (``none``) count as a code."""
    c = labels.cube(codes, group).agg(F.count("*").alias("n"), F.grouping(codes).alias("gc"), F.grouping(group).alias("gg"))
    return c.select(F.when(F.col("gc") == 1, "total").otherwise(F.col(codes)).alias(codes), F.when(F.col("gg") == 1, "total").otherwise(F.col(group)).alias(group), "n")


def evaluate(rows: DataFrame, positive: Column, detectors: dict[str, Column], id_col: str = "doc_id", listed: bool = True) -> DataFrame:
    """Flagged, true positives, precision, recall and the missed ids of each detector; null where a denominator is 0.

    Made for samples that people have labelled: the missed ids are one cell. Of more than these, ``listed=False`` leaves
    them out, and ``missed`` gives them as rows."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.coalesce(c, F.lit(False)).alias("flag")) for n, c in detectors.items()]))
    d = rows.select(F.col(id_col).alias("id"), positive.alias("yes"), each.alias("x")).select("id", "yes", "x.*")
    counts = [F.count_if("flag").alias("flagged"), F.count_if(F.col("flag") & F.col("yes")).alias("tp"), F.count_if("yes").alias("positives")]
    ids = F.array_sort(F.collect_list(F.when(F.col("yes") & ~F.col("flag"), F.col("id"))))
    names = F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("missed")
    e = d.groupBy("detector").agg(*counts, *([names] if listed else []))
    return e.select("detector", "flagged", "tp", ratio(F.col("tp"), F.col("flagged")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall"), *(["missed"] if listed else []))


def missed(rows: DataFrame, positive: Column, detectors: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``(detector, id)``: a row for each positive that a detector doesn't flag; of any number, where a cell of ``evaluate`` holds few."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.coalesce(c, F.lit(False)).alias("flag")) for n, c in detectors.items()]))
    return rows.where(positive).select(F.col(id_col).alias("id"), each.alias("x")).where("not x.flag").select("x.detector", "id")


def violations(labels: DataFrame, docs: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """``(document_id, problem)``: every problem of a label set, all at once.

    Labels for unknown documents, documents without label, repeated labels, values that aren't
    allowed, and evidence that isn't in the text, word for word.
    """
    bad = [labels.join(docs, labels["document_id"] == docs["id"], "left_anti").select("document_id", F.lit("unknown document").alias("problem"))]
    bad.append(docs.join(labels, labels["document_id"] == docs["id"], "left_anti").select(F.col("id").alias("document_id"), F.lit("no label").alias("problem")))
    bad.append(labels.groupBy("document_id").count().where("count > 1").select("document_id", F.lit("repeated label").alias("problem")))
    for field, values in allowed.items():
        bad.append(labels.where(F.col(field).isNull() | ~F.col(field).isin(values)).select("document_id", F.concat(F.lit(f"{field}: "), F.coalesce(field, F.lit("null"))).alias("problem")))
    quoted = labels.where(F.trim(F.coalesce("evidence_span", F.lit(""))) != "").join(docs, labels["document_id"] == docs["id"])
    bad.append(quoted.where(locate(F.col("body"), F.col("evidence_span")).isNull()).select("document_id", F.lit("evidence is not in the text").alias("problem")))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def reason_tables(rows: DataFrame, code: str = "taxonomy_code", by: str = "source", none: str = "none") -> DataFrame:
    """Reasons of each category and group, over the whole grid of both, zeros included."""
    r = rows.where(F.col(code) != none)
    grid = r.select(code).distinct().crossJoin(rows.select(by).distinct())
    return grid.join(r.groupBy(code, by).agg(F.count("*").alias("n")), [code, by], "left").select(code, by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reason_maps(rows: DataFrame, code: str = "taxonomy_code", by: str = "source", sample: str = "sample", none: str = "none") -> DataFrame:
    """One row with ``reasons``, a map of maps: code -> (n, source -> (n, sample -> n)), zeros included, and ``n`` over all.

    One pass by grouping sets counts all levels. Every code has every source, and every source every sample, that the rows
    have with any code, ``none`` included; ``none`` itself and null codes are no reasons. A null source or sample is called ``null``,
    and no real one may be. Without reasons the map is empty.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    r = rows.select(F.col(code).alias("code"), name(by).alias("by"), name(sample).alias("sample"))
    # Of each code all sources and samples, with no rows: they make the zeros. All three are short lists.
    places = r.select("by", "sample").distinct()
    grid = r.where(F.col("code") != none).select("code").distinct()
    grid = grid.join(F.broadcast(places.select("by").distinct())).join(F.broadcast(places.select("sample").distinct()))
    all_of = r.where(F.col("code") != none).withColumn("one", F.lit(1)).unionByName(grid.withColumn("one", F.lit(0)))
    sets = [[F.col("code"), F.col("by"), F.col("sample")], [F.col("code"), F.col("by")], [F.col("code")], []]
    c = all_of.groupingSets(sets, F.col("code"), F.col("by"), F.col("sample")).agg(F.sum("one").alias("n"), F.grouping_id().alias("level"))
    level = lambda k, *cols: c.where(F.col("level") == k).select(*cols, F.coalesce("n", F.lit(0)).alias("n"))
    as_map = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k), v))))
    inner = level(0, "code", "by", "sample").groupBy("code", "by").agg(as_map("sample", F.col("n")).alias("samples"))
    middle = level(1, "code", "by").join(inner, ["code", "by"])
    # A map has no order, by which entries could be sorted: its keys come first.
    middle = middle.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("by", F.struct("n", "samples")))).alias("sources"))
    outer = level(3, "code").join(middle, "code").agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("n", "sources")))).alias("reasons"))
    return level(7).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).crossJoin(outer)  # one row each


def filtered_categories(rows: DataFrame, shown: Column, promotional: Column, code: str = "taxonomy_code", none: str = "none") -> DataFrame:
    """``(category, promotional, n, rank)``: categories of the rows that are ``shown``, once with promotional ones and once
    without, so that a page can switch between the two. Ranks go by ``n``, ties by name."""
    r = rows.where(shown & (F.col(code) != none)).select(F.col(code).alias("category"), F.coalesce(promotional, F.lit(False)).alias("p"))
    both = r.withColumn("promotional", F.explode(F.when(F.col("p"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
    c = both.groupBy("category", "promotional").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("promotional").orderBy(F.desc("n"), "category")))


def sensitivity(rows: DataFrame, flagged: Column, code: str = "taxonomy_code", none: str = "none") -> DataFrame:
    """Counts and ranks of categories with and without the flagged rows, ties by name."""
    c = rows.where(F.col(code) != none).groupBy(F.col(code).alias("category")).agg(F.count("*").alias("with_all"), F.count_if(~flagged).alias("without"))
    rank = lambda x: F.row_number().over(Window.orderBy(F.desc(x), "category"))
    return c.select("category", "with_all", "without", rank("with_all").alias("rank_with"), rank("without").alias("rank_without"))
