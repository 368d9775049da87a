"""Entity mentions in three tiers with DataFrame operations only: no Python worker sees a text.

The places of a pattern are the running lengths of what it splits a text into and of what it matches,
which a window sums up. Whether a place lies in an alias, or in an exclusion of its entity, is the
running maximum of their ends in a range frame over places. The exclusions about an ambiguous word
come to it in another range frame, and are made blank in the few characters where its context is
read. Texts are shuffled once, by row; all windows find their rows in place.

The rules are those of ``mentions``; where exclusions of two patterns overlap, both are blank here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.rules import Rules
from weftwork.functions.text import collapsed
from weftwork.operators.buckets import Buckets
from weftwork.operators.mentions import maybe
from weftwork.session import materialize, spread

_ALIAS, _WORD, _EXCLUDED, _AROUND = 0, 1, 2, 60


def _java(pattern: str) -> str:
    return f"(?iU)(?:{pattern})"


def _of(values: list) -> Column:
    """The value for a rule's number ``k``."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)


def _places(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """``texts(row, field, text)`` -> ``(row, field, k, s, e)``, where pattern ``k`` matches."""
    each = [F.struct(F.lit(k).alias("k"), F.arrays_zip(F.split("text", _java(p), -1), F.regexp_extract_all("text", F.lit(_java(p)), F.lit(0))).alias("z")) for k, p in enumerate(patterns)]
    z = texts.select("row", "field", F.inline(F.filter(F.array(*each), lambda x: F.size(x["z"]) > 1))).select("row", "field", "k", F.posexplode("z").alias("i", "x"))
    z = z.select("row", "field", "k", "i", F.length(F.col("x")["0"]).alias("apart"), F.length(F.col("x")["1"]).alias("size"))
    before = Window.partitionBy("row", "field", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    z = z.withColumn("s", (F.coalesce(F.sum(F.col("apart") + F.coalesce("size", F.lit(0))).over(before), F.lit(0)) + F.col("apart")).cast("int"))
    return z.where("size > 0").select("row", "field", "k", "s", (F.col("s") + F.col("size")).alias("e"))


def _blank(text: Column, lo: Column, hi: Column, cuts: Column) -> Column:
    """The characters from ``lo`` to ``hi``, with what of the spans ``cuts`` is among them blank."""

    def cut(acc: Column, x: Column) -> Column:
        a, b = F.greatest(lo, x["s"]) - lo, F.least(hi, x["e"]) - lo
        return F.concat(F.substring(acc, F.lit(1), a), F.repeat(F.lit(" "), b - a), F.substring(acc, b + 1, F.length(acc)))

    inside = F.filter(cuts, lambda x: (x["s"] < hi) & (x["e"] > lo))
    return F.aggregate(inside, F.substring(text, lo + 1, hi - lo), cut)


def find_mentions(docs: DataFrame, rules: Rules, id_col: str = "id", body: str = "body", title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``(document_id, entity, mention_count, first_char_offset)``, ``(document_id, entity, term, reason, snippet)``).

    A title counts besides the body if it is another text, and what the body says is context for it. Null texts are
    empty. Rows of one id are rows of their own; extra columns don't matter.
    """
    b, t = F.col(body).cast("string"), F.col(title).cast("string") if title else F.lit(None).cast("string")
    some = F.coalesce(maybe(b, rules), F.lit(False)) | F.coalesce(maybe(t, rules), F.lit(False))
    rows = spread(docs).where(some).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("document_id"), F.coalesce(b, F.lit("")).alias("body"), F.coalesce(t, F.lit("")).alias("title"))
    rows = materialize(rows, "mention-texts")
    fields = F.array(F.struct(F.lit(0).alias("field"), F.col("body").alias("text"), F.lit(None).cast("string").alias("beside")), F.struct(F.lit(1).alias("field"), F.when(F.col("title") != F.col("body"), F.col("title")).otherwise("").alias("text"), F.col("body").alias("beside")))
    texts = rows.select("row", F.inline(fields)).where("text <> ''").repartition("row", "field")

    table = [(_ALIAS, e, p, 0) for e, ps in rules.aliases.items() for p in ps]
    table += [(_WORD, a.entity, a.term, a.window) for a in rules.ambiguous] + [(_EXCLUDED, e, p, 0) for e, p in rules.excluded]
    first_word = sum(kind == _ALIAS for kind, *_ in table)
    kind, entity, term, reach = (_of([x[i] for x in table]) for i in range(4))
    spans = _places(texts, [p for _, _, p, _ in table]).withColumn("kind", kind)
    up_to = Window.partitionBy("row", "field").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    aliased = F.coalesce(F.max(F.when(F.col("kind") == _ALIAS, F.col("e"))).over(up_to) > F.col("s"), F.lit(False))
    spans = spans.withColumn("aliased", aliased).where(f"kind = {_ALIAS} or not aliased").withColumn("entity", entity)
    spans = materialize(spans.drop("aliased"), "mention-spans")

    size = spans.where(f"kind <> {_ALIAS}").agg(F.coalesce(F.max(F.col("e") - F.col("s")), F.lit(0))).first()[0]
    around = max((a.window for a in rules.ambiguous), default=0) + size
    own = Window.partitionBy("row", "field", "entity").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("row", "field").orderBy("s").rangeBetween(-around, around)
    cut = F.col("kind") == _EXCLUDED
    words = spans.where(f"kind <> {_ALIAS}").withColumn("shut", F.coalesce(F.max(F.when(cut, F.col("e"))).over(own) > F.col("s"), F.lit(False)))
    words = words.withColumn("cuts", F.collect_list(F.when(cut, F.struct("s", "e"))).over(near)).where(cut | ~F.col("shut"))
    words = words.join(texts, ["row", "field"])
    lo, hi = F.greatest(F.lit(0), F.col("s") - reach), F.least(F.length("text"), F.col("e") + reach)
    words = words.withColumns({"lo": lo, "hi": hi}).withColumn("context", F.when(~cut, _blank(F.col("text"), F.col("lo"), F.col("hi"), F.col("cuts"))))
    vouched = F.lit(False)
    for n, a in enumerate(rules.ambiguous):
        found = F.lit(False)
        if a.context:
            pattern = _java("|".join(f"(?:{c})" for c in a.context))
            found = F.col("context").rlike(pattern) | F.coalesce(F.col("beside").rlike(pattern), F.lit(False))
        if a.cased:  # with the character before, which a pattern may look at
            head = F.substring("text", F.greatest(F.col("s"), F.lit(1)), F.length("text"))
            found = F.when(F.col("s") > 0, head.rlike(f"(?sU)^.(?:{a.cased})")).otherwise(head.rlike(f"(?U)^(?:{a.cased})")) | found
        vouched = F.when(F.col("k") == first_word + n, found).otherwise(vouched)
    snippet = collapsed(F.substring("text", F.greatest(F.lit(0), F.col("s") - _AROUND) + 1, F.least(F.length("text"), F.col("e") + _AROUND) - F.greatest(F.lit(0), F.col("s") - _AROUND)))
    words = words.select("row", "field", "entity", "s", term.alias("term"), cut.alias("cut"), (~cut & vouched).alias("counts"), snippet.alias("snippet"))
    words = materialize(words, "mention-words")

    hits = spans.where(f"kind = {_ALIAS}").select("row", "field", "entity", "s").unionByName(words.where("counts").select("row", "field", "entity", "s")).distinct()
    each = hits.groupBy("row", "entity").agg(F.count("*").cast("int").alias("mention_count"), F.min(F.when(F.col("field") == 0, F.col("s"))).alias("first_char_offset"))
    names = rows.select("row", "document_id")
    mentions = each.join(names, "row").select("document_id", "entity", "mention_count", "first_char_offset")
    reason = F.when(F.col("cut"), "excluded").otherwise("no_context").alias("reason")
    return mentions, words.where("not counts").join(names, "row").select("document_id", "entity", "term", reason, "snippet")


def rebuild_mentions(docs: DataFrame, rules: Rules, into: Buckets, rejected: Buckets | None = None, **columns: str) -> None:
    """All mentions anew, and all rejections, if they have a table: what was stored is overwritten once the new rows are found."""
    mentions, rejections = find_mentions(docs, rules, **columns)
    into.create(mentions)
    if rejected is not None:
        rejected.create(rejections)
