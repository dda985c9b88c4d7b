"""Normalization, tokenization and sentence splitting as column functions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import profile as P

def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(P.WHITE))


def transliterate(text: Column) -> Column:
    return F.translate(F.lower(text), P.LATIN, P.SCRIPT)


def map_chars(text: Column, preserve_zwnj: bool = True, remove_diacritics: bool = False) -> Column:
    """Letter and digit variants to their standard forms; tatweel, zero-width and optionally diacritic characters go."""
    gone = P.TATWEEL + P.ZERO_WIDTH + ("" if preserve_zwnj else P.ZWNJ) + (P.DIACRITICS if remove_diacritics else "")
    return F.translate(text, "".join(P.CHAR_MAP) + gone, "".join(P.CHAR_MAP.values()))


def fold_heh(text: Column) -> Column:
    """Heh after an Arabic-script letter becomes a vowel; word-initial heh stays. Context is the text before any change."""
    return F.regexp_replace(text, f"(?<=[{P.HEH_CONTEXT}])ه", "ە")


def whitespace(text: Column) -> Column:
    for pattern, to in ((r"[ \t]+", " "), (r"\r\n?", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def normalize(text: Column, preserve_zwnj: bool = True, remove_diacritics: bool = False, chars: bool = True) -> Column:
    """All normalization steps for text in NFC; see operators.unicode for NFC itself."""
    out = fold_heh(map_chars(text, preserve_zwnj, remove_diacritics)) if chars else text
    return whitespace(out)


def strip_parentheticals(text: Column) -> Column:
    """Parentheses that no letter follows go, again for those that become free, until none is left: that frees runs of them that
    follow each other, and what such a run leaves."""
    one = lambda t: F.regexp_replace(t, r"(?:\([^)]+\))+(?=[\s.،؟!۔:;]|$)", "")
    # A round is bounded by the text: each that changes it takes three characters at least.
    rounds = F.sequence(F.lit(1), F.greatest(F.size(F.split(text, r"\)")), F.lit(1)))
    done = F.aggregate(rounds, text, lambda t, _: F.when(t.contains("("), one(t)).otherwise(t))
    return strip(F.regexp_replace(done, " {2,}", " "))


def punctuation(text: Column) -> Column:
    """Commas, spacing around punctuation and runs of periods, in fixed order."""
    text = F.regexp_replace(F.replace(text, F.lit(","), F.lit("،")), r"(?U)\s+([.،؟!۔:;])", "$1")
    text = F.regexp_replace(text, "،{2,}", "،")
    for mark in "،:":
        text = F.regexp_replace(text, f"{mark}(?=[؀-ۿ])", f"{mark} ")
    text = F.regexp_replace(F.replace(text, F.lit("..."), F.lit("…")), r"\.{2,}", ".")
    text = F.regexp_replace(text, r"([؟!])\.", "$1")
    return F.regexp_replace(text, "…(?=[؀-ۿ])", "… ")


def wiki_markup(text: Column) -> Column:
    """Links to their labels; templates, quotes, tags and headings go; white space is collapsed."""
    # Patterns and their order.
    steps = ((r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"\{\{[^}]*\}\}", ""), (r"\[https?://[^\]]*\]", ""), (r"<ref[^>]*>.*?</ref>", ""), (r"<ref[^/]*/>", ""), (r"'{2,}", ""), (r"<[^>]+>", ""), (r"==+[^=]+=+", ""), (r"(?U)\s+", " "))
    return strip(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text))


def sentences(text: Column) -> Column:
    """array<string>: split after terminal punctuation and white space, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"(?<=[.!?؟۔])\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def words(text: Column) -> Column:
    """array<string>: split at white space, joiners removed; an empty text has none."""
    return F.filter(F.split(F.replace(text, F.lit(P.ZWJ), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """array<string>: the conjunction waw split off; runs of letters, digits or Latin letters, and single other characters."""
    text = F.regexp_replace(F.replace(text, F.lit(P.ZWJ), F.lit("")), f"(?U)((?<=\\s)|^)و(?=[{P.WAW_BEFORE}])", "و ")
    return F.regexp_extract_all(text, F.lit(f"(?U)[{P.TOKEN_LETTERS}]+|[۰-۹0-9]+|[a-zA-Z]+|[^\\s]"), F.lit(0))


def join_tokens(tokens_: Column) -> Column:
    """Tokens with spaces between, but none before closing punctuation."""
    closing = F.array(*map(F.lit, P.NO_SPACE_BEFORE))
    return F.aggregate(tokens_, F.lit(None).cast("string"), lambda acc, t: F.when(acc.isNull(), t).when(F.array_contains(closing, t), F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t)), lambda acc: F.coalesce(acc, F.lit("")))


def count_tokens(text: Column) -> Column:
    """White-space tokens, with the non-joiner as a boundary."""
    return F.size(F.filter(F.split(F.replace(text, F.lit(P.ZWNJ), F.lit(" ")), r"(?U)\s+"), lambda w: w != ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use() refers to it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def trigrams(text: Column) -> Column:
    """array<string>: distinct 3-character substrings of the text with white space collapsed."""
    chars = F.split(strip(F.regexp_replace(text, r"(?U)\s+", " ")), "")
    three = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2]))
    return let(F.filter(chars, lambda c: c != ""), lambda c: F.when(F.size(c) >= 3, F.array_distinct(three(c))).otherwise(F.array().cast("array<string>")))
