import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.functions.html import flat_text, page_text
from weftwork.functions.rules import PLATFORMS
from weftwork.operators.mentions import Sweep, _Pattern, _Text, needs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "  a \t b c\n", "É  x y", "one"])
def test_words_and_hash_are_pythons(spark, text):
    assert one(spark, T.word_count(F.col("t")), t=text) == len(text.split())
    assert one(spark, T.content_hash(F.col("t")), t=text) == hashlib.sha256(" ".join(text.split()).lower().encode()).hexdigest()


def test_author_hash(spark):
    want = hmac.new(b"salt", b"src:Ann", hashlib.sha256).hexdigest()[:24]
    assert one(spark, T.author_hash("salt", F.lit("src"), F.col("a")), a="Ann") == want
    assert one(spark, T.author_hash("salt", F.lit("src"), F.col("a")), a="[deleted]") is None
    with pytest.raises(ValueError):
        T.author_hash("", F.lit("src"), F.lit("a"))


def test_phrases_need_word_edges(spark):
    has = lambda t: one(spark, T.has_phrase(F.col("t"), PLATFORMS.phrases), t=t)
    assert has("We did a POC.") and not has("an epoch in my pocket") and has("Switched TO it")


def test_marked_sentences(spark):
    m = T.marked_sentences(F.col("t"), PLATFORMS.platform, PLATFORMS.move, PLATFORMS.reason)
    t = "We moved from Snowflake to BigQuery because of cost. Nice day! Snowflake is cheaper\nhello"
    assert one(spark, T.reason_tier(m), t=t) == 2
    assert one(spark, T.reason_score(m), t=t) == 3
    assert one(spark, F.size(m), t="") == 0


def test_locate_and_excerpt(spark):
    body = " ".join(f"w{i}" for i in range(100)) + "  the   quoted span " + " ".join(f"v{i}" for i in range(100))
    assert one(spark, T.locate(F.col("b"), F.col("s")), b=body, s="the quoted\nspan") == body.index("  the") + 1
    assert one(spark, T.locate(F.col("b"), F.col("s")), b=body, s="a paraphrase") is None
    cut = one(spark, T.excerpt(F.col("b"), F.col("s")), b=body, s="the quoted span")
    assert len(cut.split()) == 62 and "the quoted span" in cut and cut.startswith("… ") and cut.endswith(" …")
    assert one(spark, T.excerpt(F.col("b"), F.col("s")), b="a b c", s="b") == "a b c"


def test_shingles(spark):
    s = lambda t: one(spark, T.shingles(F.col("t")), t=t)
    assert s("One two three four") == ["one two three", "two three four"] and s("a bb") == [] and s("") == []


def test_html():
    assert flat_text("<p>a &amp;amp; b</p><script>x</script><li>c") == "a & b\nc"
    assert flat_text(None) == ""
    assert page_text("<title>T</title><body><nav>n</nav><main><h1>H</h1> p <script>var t='</p>';</script></main>out") == ("T", "H\np")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("we use databricks and BigQuery", {"databricks", "google"}),
        ("a special snowflake", set()),
        ("Snowflake account", {"snowflake"}),
        ("snowflake warehouse costs", {"snowflake"}),
        ("snowflake schemas in our warehouse", set()),
        ("the redshift of distant galaxies", set()),
        ("redshift cluster on aws", {"aws"}),
        ("the fabric of society", set()),
        ("microsoft fabric capacity", {"microsoft"}),
    ],
)
def test_mentions(text, found):
    assert {e for e, *_ in Sweep(PLATFORMS).find(text, None)[0]} == found


def test_rejections_and_titles():
    m = Sweep(PLATFORMS)
    assert [(e, t, r) for e, t, r, _ in m.find("snowflake schema and the redshift of galaxies", None)[1]] == [("aws", r"\bredshift\b", "no_context"), ("snowflake", PLATFORMS.excluded[0][1], "excluded")]
    assert m.find("nothing", "Leaving Databricks")[0] == [("databricks", 1, None)]
    assert m.find("aws redshift serverless", None)[0] == [("aws", 2, 0)]


def test_plain_words_are_found_as_by_the_pattern():
    rng = random.Random(3)
    alphabet = ["the", "The", "THE", " ", "of", "_", "-", "é", "ı", "ſ", "0", "\n", "to", "x", "İ", "日", "'"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet[: rng.choice([9, len(alphabet)])]) for _ in range(40))
        for p in (r"\bthe\b", r"\bof the\b", r"to", r"\bto", r"the\b", r"\bto the\b", r"\bs3\b"):
            assert _Pattern(p).spans(_Text(t)).tolist() == [list(m.span()) for m in re.finditer(p, t, re.I)]


def test_mentions_of_a_batch_are_those_of_each_row():
    rng = random.Random(5)
    words = ["snowflake", "Snowflake", "schema", "warehouse", "redshift", "aws", "amazon redshift", "a", "special", "synapse", "azure", "glue", "fabric", "delta", "lake", "\n", "databricks", "spark", "sql", "x" * 150]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) or None, rng.choice([None, "", "redshift", "Snowflake", "spark news"])) for _ in range(300)]
    s = Sweep(PLATFORMS)
    both = s.batch([b for b, _ in rows], [t for _, t in rows])
    for (b, t), r in zip(rows, both.to_pylist(), strict=True):
        assert s.find(b, t) == ([tuple(m.values()) for m in r["mentions"]], [tuple(x.values()) for x in r["rejections"]])
    assert s.batch([], []).to_pylist() == [] and s.find("the redshift", "redshift on aws")[0] == [("aws", 1, None)]
    # Context is read within the row only, and an exclusion vouches for nothing.
    assert [x["mentions"] for x in s.batch(["redshift", "aws"], [None, None]).to_pylist()] == [[], []]
    assert s.find("snowflake schema redshift")[0] == [] and s.find("redshift", "redshift")[1][1:] == []


def test_rules_of_some_entities():
    of = PLATFORMS.of(["databricks"])
    assert list(of.aliases) == ["databricks"] and not of.ambiguous and not of.excluded and PLATFORMS.of(["aws"]).excluded


def test_strings_that_a_match_needs():
    assert needs(r"\b(?:amazon|aws) redshift\b") == {" redshift"} and needs(r"(?:ab|cde)x?") == {"ab", "cde"} and needs(r"\w+") is None and needs(r"a?") is None and needs(r"(?:Foo)+") == {"foo"}
    rng = random.Random(1)
    words = "a special Snowflake snowflakes schema its own snowflake koch snowflake proxy snowflake (slang) twitter's".split(" ")
    for _ in range(500):
        t = " ".join(rng.choice(words) for _ in range(6))
        for _, p in PLATFORMS.excluded:
            assert not re.search(p, t, re.I) or any(w in t.lower() for w in needs(p))
