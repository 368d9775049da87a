"""Text expressions: Column in, Column out, all evaluated by the JVM.

White space is Python's: Java's Unicode class and the four separators U+001C to U+001F.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, although it may be used at every element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def normalised(text: Column) -> Column:
    return F.lower(collapsed(text))


def content_hash(text: Column) -> Column:
    """SHA-256, in hexadecimal, of the normalised text."""
    return F.sha2(normalised(text), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal from two nested hashes. The padded key is part of the plan: keep plans private."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def author_hash(salt: str, source: Column, author: Column) -> Column:
    """24 hexadecimal digits that name an author within a source; null for nobody, the empty and the deleted."""
    if not salt:
        raise ValueError("a salt is needed: without one, names are found again by trying them")
    known = author.isNotNull() & ~author.isin("", "[deleted]", "deleted")
    return F.when(known, F.substring(hmac_sha256(salt.encode(), F.concat(source, F.lit(":"), author)), 1, 24))


def tokens(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def any_of(patterns: list[str] | tuple[str, ...], whole_words: bool = False) -> str:
    """One case-insensitive Unicode pattern for several."""
    body = "|".join(f"(?:{p})" for p in patterns)
    return rf"(?iU)\b(?:{body})\b" if whole_words else f"(?iU)(?:{body})"


def has_phrase(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    """Whether one of the literal phrases occurs as whole words."""
    return F.coalesce(text.rlike(any_of([re.escape(p) for p in phrases], whole_words=True)), F.lit(False))


def sentences(text: Column) -> Column:
    """Parts between line feeds and after sentence marks, trimmed; blank ones are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def marked_sentences(text: Column, platform: str, move: str, reason: str) -> Column:
    """Array of (sentence, move, reason) of the sentences that name a platform and move or give a reason."""
    marked = F.transform(
        sentences(text),
        lambda s: F.struct(s.alias("sentence"), (s.rlike(platform) & s.rlike(move)).alias("move"), (s.rlike(platform) & s.rlike(reason)).alias("reason")),
    )
    return F.filter(marked, lambda s: s["move"] | s["reason"])


def reason_score(marked: Column) -> Column:
    """Two for a sentence with both, one for the others."""
    return F.aggregate(marked, F.lit(0), lambda acc, s: acc + F.when(s["move"] & s["reason"], 2).otherwise(1))


def reason_tier(marked: Column) -> Column:
    """0 without marked sentences, 2 if one has both, else 1."""
    return F.when(F.size(marked) == 0, 0).when(F.exists(marked, lambda s: s["move"] & s["reason"]), 2).otherwise(1)


def strict_sentences(text: Column, cue: str, platform: str, move: str) -> Column:
    return F.filter(sentences(text), lambda s: s.rlike(cue) & s.rlike(platform) & s.rlike(move))


def locate(body: Column, span: Column) -> Column:
    """0-based place of a span in a body, white space collapsed in both; null unless it is there and not blank."""
    b, s = collapsed(body), collapsed(span)
    at = F.instr(b, s)
    return F.when((s != "") & (at > 0), at - 1)


def excerpt(body: Column, span: Column, n_words: int = 60) -> Column:
    """``n_words`` words of a body around a span's middle, with marks where words are left out; null if the span isn't there."""
    at = locate(body, span)

    def cut(words: Column) -> Column:
        before = F.size(tokens(F.substr(collapsed(body), F.lit(1), at)))
        total = F.size(words)
        first = F.greatest(F.lit(0), F.least(before + F.floor(word_count(span) / 2).cast("int") - n_words // 2, total - n_words))
        text = F.array_join(F.slice(words, first + 1, F.lit(n_words)), " ")
        return F.concat(F.when(first > 0, F.lit("… ")).otherwise(""), text, F.when(first + n_words < total, F.lit(" …")).otherwise(""))

    return F.when(at.isNotNull(), let(F.split(collapsed(body), " "), cut))


def shingles(text: Column, n: int = 3, pattern: str = r"(?U)\b\w\w+\b") -> Column:
    """All ``n``-word shingles, repeats included, of the lower-cased words of two characters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>")))


def ratio(a: Column, b: Column, places: int | None = None) -> Column:
    """a / b in double precision, null where b is 0."""
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return x if places is None else F.round(x, places)


def tags_array(value: Column) -> Column:
    """A comma-separated string of tags, or a JSON list of them, as an array."""
    is_list = F.trim(value).startswith("[")
    parts = F.when(is_list, F.from_json(value, "array<string>")).otherwise(F.split(value, ","))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def titled(name: Column) -> Column:
    """An identifier as a heading: ``self_managed-onprem`` becomes ``Self Managed Onprem``."""
    return F.initcap(collapsed(F.translate(name, "_-", "  ")))
