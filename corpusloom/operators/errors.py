"""Synthetic errors as column functions: a generator maps a word to its possible wrong forms; md5 chooses words and forms.

A generator is a function from a word column to array<string>. inject() replaces chosen words and returns the corrupted text and
the annotations of what was changed, with code-point positions in the text given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import verb_profile as V
from corpusloom.functions.text import let

# Swap tables.
PREPOSITIONS = {"لەلایەن": ["بە", "بۆ"], "بە": ["لەلایەن", "بۆ", "لەگەڵ"], "بۆ": ["بە", "لە"], "لە": ["لەسەر", "بە"], "لەسەر": ["لە", "بە"], "لەگەڵ": ["بە", "بۆ"], "بەبێ": ["بە", "بۆ"], "بەبی": ["بە", "بۆ"]}
FUSED = {"پێم": ["بە من"], "پێت": ["بە تۆ"], "پێی": ["بە ئەو"], "پێمان": ["بە ئێمە"], "پێتان": ["بە ئیوە"], "پێیان": ["بە ئەوان"], "لێم": ["لە من"], "لێت": ["لە تۆ"], "لێی": ["لە ئەو"], "لێمان": ["لە ئێمە"], "لێتان": ["لە ئیوە"], "لێیان": ["لە ئەوان"], "تێم": ["تە من"], "تێت": ["تە تۆ"], "تێی": ["تە ئەو"], "تێمان": ["تە ئێمە"], "تێتان": ["تە ئیوە"], "تێیان": ["تە ئەوان"]}
CONTRACTED = {"بەم": ["بە ئەم"], "بەو": ["بە ئەو"], "بەمە": ["بە ئەمە"], "بەمانە": ["بە ئەمانە"], "بەوە": ["بە ئەوە"], "بەوانە": ["بە ئەوانە"], "لەم": ["لە ئەم"], "لەو": ["لە ئەو"], "لەمە": ["لە ئەمە"], "لەمانە": ["لە ئەمانە"], "لەوە": ["لە ئەوە"], "لەوانە": ["لە ئەوانە"]}
PARTICIPLES = {"نووسەر": "نووسراو", "بکەر": "کراو", "کوژەر": "کوژراو", "سووتێنەر": "سووتێنراو", "بیسەر": "بیستراو", "بینەر": "بینراو", "خوێنەر": "خوێندراو", "تێکدەر": "تێکدراو", "فرۆشەر": "فرۆشراو", "دروستکەر": "دروستکراو", "چاپکەر": "چاپکراو", "داهێنەر": "داهێنراو", "ناردەر": "ناردراو", "وەرگێڕەر": "وەرگێڕدراو", "ئامادەکەر": "ئامادەکراو"}
ORTHOGRAPHY = (("ح", "ه"), ("غ", "خ"), ("ع", "ئ"), ("ڵ", "ل"), ("ڕ", "ر"), ("ێ", "ی"), ("ۆ", "و"), ("ژ", "ز"), ("ڤ", "ف"))
MARKS = {"،": [",", ""], ",": ["،", ""], "؛": [";", "،"], ";": ["؛", ","], "؟": ["?", ""], "?": ["؟", ""], ".": ["،", ""]}
NOT_PARTICIPLES = ("ئە", "ئێ", "لێ", "پێ", "پیا")
POSSESSIVES = {"م": ["ت", "ی", "مان"], "ت": ["م", "ی", "تان"], "ی": ["م", "ت", "یان"], "مان": ["تان", "یان", "م"], "تان": ["مان", "یان", "ت"], "یان": ["مان", "تان", "ی"]}
PREFIX_ORDER = {"نادە": "دەنا", "نەدە": "دەنە", "نەب": "بنە", "ناب": "بنا"}
PARTICLES = {"دەچمەوە": ["دەوەچم"], "دەگەڕێتەوە": ["دەوەگەڕێت"], "دەنێرێتەوە": ["دەوەنێرێت"]}
VOWELS, COMPLETIVE = "اەئێۆوی", "ەوە"
VERB_PREFIXES = ("دە", "ب", "نا", "نە", "مە")

Generator = Callable[[Column], Column]


def _none() -> Column:
    return F.array().cast("array<string>")


def table(forms: dict[str, list[str]]) -> Generator:
    """A generator that looks words up."""

    def run(word: Column) -> Column:
        lookup = F.create_map(*(x for k, v in forms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        return F.coalesce(F.try_element_at(lookup, word), _none())

    return run


def _first(word: Column, a: str, b: str) -> Column:
    i = F.instr(word, a)
    return F.when(i > 0, F.concat(F.substring(word, F.lit(1), i - 1), F.lit(b), F.substring(word, i + len(a), F.length(word))))


def _spelling(word: Column) -> Column:
    """The first occurrence of a letter becomes the other of its pair. A form stands as often as twice its pair's weight."""
    forms = [_first(word, x, y) for (a, b), n in V.CONFUSED_WEIGHTS.items() for x, y in ((a, b), (b, a)) for _ in range(int(2 * n))]
    return F.filter(F.array(*forms), lambda f: f.isNotNull())


def _orthography(word: Column) -> Column:
    """All places of the first two pairs change, of the others the first one; a doubled waw and a word's first letter have rules. A form
    that several rules give stands as often."""
    first, rest = F.substring(word, 1, 1), F.substring(word, 2, 1 << 30)
    every = [F.when(word.contains(x) & (~word.endswith("ە") if x == "ه" else F.lit(True)), F.replace(word, F.lit(x), F.lit(y))) for a, b in ORTHOGRAPHY[:2] for x, y in ((a, b), (b, a))]
    waw = F.when(word.contains("وو"), _first(word, "وو", "و")).otherwise(_first(word, "و", "وو"))
    initial = F.when(first == "ئ", F.concat(F.lit("ی"), rest)).when(first == "ی", F.concat(F.lit("ئ"), rest))
    free = {"ئ": first != "ئ", "ی": first != "ی", "و": ~word.contains("وو") & ~word.contains("ۆ")}
    once = [F.when(free.get(x, F.lit(True)), _first(word, x, y)) for a, b in ORTHOGRAPHY[2:] for x, y in ((a, b), (b, a))]
    return F.filter(F.array(*every, waw, initial, *once), lambda f: f.isNotNull())


def _participle(word: Column) -> Column:
    stem = F.regexp_extract(word, "^(.+?)(ووە|وە)$", 1)
    return F.when((stem != "") & ~stem.isin(*NOT_PARTICIPLES), F.array(F.concat(stem, F.lit("یە")), F.concat(stem, F.lit("گە")))).otherwise(_none())


def _possessive(word: Column) -> Column:
    out = _none()
    for end in sorted(POSSESSIVES, key=len):
        stem = F.substring(word, F.lit(1), F.length(word) - len(end))
        own = word.endswith(end) & stem.rlike("^[؀-ۿ]{3,}$") & ~stem.rlike("^(" + "|".join(VERB_PREFIXES) + ")")
        out = F.when(own, F.array(*(F.concat(stem, F.lit(c)) for c in POSSESSIVES[end]))).otherwise(out)
    return out


def _morphemes(word: Column) -> Column:
    """Prefixes in the wrong order, a particle out of place, and the completive ending moved behind the first vowels (behind the third
    letter, where no consonant follows them or they are one letter in all)."""
    prefixes = F.coalesce(*(F.when(word.startswith(a), F.concat(F.lit(b), F.substring(word, len(a) + 1, 1 << 30))) for a, b in PREFIX_ORDER.items()))
    stem = F.substring(word, F.lit(1), F.length(word) - len(COMPLETIVE))
    at = F.length(F.regexp_extract(stem, f"^([^{VOWELS}]*[{VOWELS}]+)[^{VOWELS}]", 1))
    at = F.when(at < 2, F.least(F.lit(3), F.length(stem))).otherwise(at)
    moved = F.concat(F.substring(stem, F.lit(1), at), F.lit(COMPLETIVE), F.substring(stem, at + 1, F.length(stem)))
    moved = F.when(word.endswith(COMPLETIVE) & (F.length(word) > 5) & (moved != word), moved)
    return F.concat(F.filter(F.array(prefixes, moved), lambda f: f.isNotNull()), table(PARTICLES)(word))


GENERATORS: dict[str, Generator] = {
    "case_role_preposition": table(PREPOSITIONS), "preposition_fusion": table(FUSED), "demonstrative_contraction": table(CONTRACTED), "participle_voice_swap": table({k: [v] for k, v in PARTICIPLES.items()} | {v: [k] for k, v in PARTICIPLES.items()}),
    "spelling_confusion": _spelling, "orthography": _orthography, "dialectal_participle": _participle, "punctuation": table(MARKS), "possessive_clitic": _possessive, "morpheme_order": _morphemes,
}


def _draw(seed: str, key: Column, i: Column) -> Column:
    """A number below 2 ** 32 from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, i.cast("string"))), 1, 8), 16, 10).cast("long")


def tidied(text: Column) -> Column:
    """As a sentence is left after errors: runs of spaces and spaces before marks go."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, " +", " "), " ([,.،؛])", "$1"))


def starts(lengths: Column) -> Column:
    """array<int>: what comes before each of the lengths in all. One pass: a sum for each place of its own grows with the square of a text."""
    none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))
    return F.aggregate(lengths, none, lambda s, n: F.struct(F.array_append(s["at"], s["n"]).alias("at"), (s["n"] + n).alias("n")), lambda s: s["at"])


def inject(text: Column, key: Column, kind: str, rate: float = 0.15, seed: int = 42) -> Column:
    """struct<corrupted, errors>: each eligible word of text is replaced with probability rate by one of its wrong forms, and what is left
    is tidied if any was. key: tells rows apart. Single spaces separate words; marks are words of their own where they are what changes."""
    marks = "[" + "".join(MARKS) + "]"
    words, joint = (F.regexp_extract_all(text, F.lit(f"{marks}|[^{marks[1:]}+"), F.lit(0)), "") if kind == "punctuation" else (F.split(text, " "), " ")

    def build(w: Column) -> Column:
        items = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"), GENERATORS[kind](x).alias("f")))

        def pick(x: Column) -> Column:
            chosen = (F.size(x["f"]) > 0) & (_draw(f"{seed}:{kind}", key, x["i"]) < int(rate * (1 << 32)))
            return F.struct(x["w"].alias("w"), x["i"].alias("i"), F.when(chosen, F.get(x["f"], (_draw(f"{seed}:{kind}:form", key, x["i"]) % F.greatest(F.size(x["f"]), F.lit(1))).cast("int"))).alias("new"))

        def finish(v: Column) -> Column:
            """v: struct<x, at> of picked words and where each begins."""
            x = v["x"]
            corrupted = F.array_join(F.transform(x, lambda y: F.coalesce(y["new"], y["w"])), joint)
            start = lambda y: F.get(v["at"], y["i"])
            errors = F.transform(F.filter(x, lambda y: y["new"].isNotNull()), lambda y: F.struct(F.lit(kind).alias("type"), y["w"].alias("original"), y["new"].alias("error"), start(y).alias("start"), (start(y) + F.length(y["w"])).alias("end")))
            return F.struct(F.when(F.size(errors) > 0, tidied(corrupted)).otherwise(corrupted).alias("corrupted"), errors.alias("errors"))

        at = starts(F.transform(w, lambda x: F.length(x) + len(joint)))
        return let(F.struct(F.transform(items, pick).alias("x"), at.alias("at")), finish)

    return let(words, build)
