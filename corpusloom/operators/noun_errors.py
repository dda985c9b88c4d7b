"""Synthetic errors of noun phrases and of clitics as column functions: what a word becomes depends on its neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import graph_profile as G
from corpusloom.functions import morph_profile as P
from corpusloom.functions.text import let
from corpusloom.operators.errors import _draw, starts, tidied
from corpusloom.operators.sentence_errors import _below, _error, _result

# Adjectives that do not agree, what demonstratives and proper nouns do not bear, endings.
ADJECTIVES = "گەورە بچووک باش خراپ نوێ کۆن جوان درێژ کورت گرنگ ئاسان سەخت تازە زۆر کەم ڕەش سپی سوور زەرد شین خۆش بەرز نزم".split()
NOT_SHOWN, NOT_PROPER = ("ەکە", "ێک", "یەکە"), ("ەکە", "ەکان", "ێک", "ان", "ین", "یەکە", "انێک")
SHOWING, LINK, PLURALS, SINGULAR, PLURAL = ("ئەم", "ئەو"), "ی", ("ان", "ەکان"), "ەکە", "ەکان"
KIND = "noun_adjective_agreement"


def _starts(words: Column) -> Column:
    return starts(F.transform(words, lambda t: F.length(t) + 1))


def noun_adjective(text: Column, key: Column, rate: float = 0.15, seed: int = 42) -> Column:
    """struct<corrupted, errors> as of errors.inject(); single spaces separate words.

    Sites, the first kind that a word is in: a noun with a link and the word behind it (a known adjective, or three letters or more; read
    from the left, without overlap) loses the link, doubles it or gets a definite one, and a known adjective may become plural (35 %);
    a definite noun changes its number (mass nouns only to the plural); a noun behind a demonstrative, with its vowel, gets an ending
    that demonstratives forbid; a plural loses the vowel's link; mass nouns become plural; proper nouns get an ending.
    """

    def build(w: Column) -> Column:
        n = F.size(w)
        at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        links = lambda i: at(i).endswith(LINK) & (F.length(at(i)) >= 2) & (at(i + 1) != "")
        pairs = F.aggregate(places, F.lit(""), lambda s, i: F.concat(s, F.when(links(i) & ~s.endswith("1"), "1").otherwise("0")))

        def finish(x: Column) -> Column:
            known = lambda i: at(i + 1).isin(*ADJECTIVES)
            linked = lambda i: F.coalesce(F.get(x["pairs"], i) == "1", F.lit(False)) & (known(i) | (F.length(at(i + 1)) >= 3))
            covered = lambda i: linked(i) | ((i > 0) & linked(i - 1))
            definite = lambda i: ~covered(i) & at(i).rlike(f"^.{{2,}}(?:{SINGULAR}|{PLURAL})$")
            shown = lambda i: at(i).isin(*SHOWING) & at(i + 1).rlike("^.{2,}ە$") & ~covered(i) & ~covered(i + 1) & ~definite(i + 1)
            alone = lambda i: ~covered(i) & ~shown(i) & ~((i > 0) & shown(i - 1)) & ~definite(i)
            cut = lambda t, k: F.substring(t, F.lit(1), F.length(t) - k)
            one_of = lambda forms, d: F.get(F.array(*map(F.lit, forms)), (d % len(forms)).cast("int"))

            def new(i: Column) -> Column:
                d, t = _draw(f"{seed}:{KIND}:form", key, i), at(i)
                noun, adjective = cut(t, 1), F.concat(F.lit(" "), at(i + 1))
                share = (d / 1000).cast("long") % 10
                broken = F.when(share < 4, F.concat(noun, adjective)).when(share < 7, F.concat(noun, F.lit("ەکەی"), adjective)).otherwise(F.concat(noun, F.lit("یی"), adjective))
                broken = F.when(known(i) & (d % 100 < 35), F.concat(t, adjective, F.lit("ان"))).otherwise(broken)
                number = F.when(t.endswith(SINGULAR), F.concat(cut(t, len(SINGULAR)), F.lit(PLURAL))).when(~cut(t, len(PLURAL)).isin(*G.MASS_NOUNS), F.concat(cut(t, len(PLURAL)), F.lit(SINGULAR)))
                return (
                    F.when(linked(i), broken).when(definite(i), number).when(shown(i), F.concat(t, F.lit(" "), cut(at(i + 1), 1), one_of(NOT_SHOWN, d)))
                    .when(alone(i) & t.rlike("^.+یان$") & (F.length(t) >= 4), F.concat(cut(t, 3), F.lit("ان")))
                    .when(alone(i) & t.isin(*G.MASS_NOUNS), F.concat(t, one_of(PLURALS, d))).when(alone(i) & t.isin(*G.PROPER_NOUNS), F.concat(t, one_of(NOT_PROPER, d)))
                )

            def site(i: Column) -> Column:
                two = linked(i) | shown(i)
                return F.struct(i.alias("i"), two.alias("two"), F.when(_below(_draw(f"{seed}:{KIND}", key, i), rate), new(i)).alias("new"))

            def join(sites: Column) -> Column:
                used = lambda i: F.coalesce(F.get(sites, i)["new"].isNotNull(), F.lit(False))
                left = F.filter(sites, lambda s: ~((s["i"] > 0) & used(s["i"] - 1) & F.get(sites, s["i"] - 1)["two"]))
                out = F.array_join(F.transform(left, lambda s: F.coalesce(s["new"], at(s["i"]))), " ")
                start = lambda i: F.get(x["starts"], i)
                old = lambda s: F.when(s["two"], F.concat_ws(" ", at(s["i"]), at(s["i"] + 1))).otherwise(at(s["i"]))
                errors = F.transform(F.filter(left, lambda s: s["new"].isNotNull()), lambda s: _error(KIND, old(s), s["new"], start(s["i"])))
                return _result(F.when(F.size(errors) > 0, tidied(out)).otherwise(text), errors)

            return let(F.transform(places, site), join)

        return let(F.struct(F.split(pairs, "").alias("pairs"), _starts(w).alias("starts")), finish)

    return let(F.split(text, " "), build)


# What stands for a clitic, and how often of a hundred; passives, their stems and clitics; words without clitics; what makes
# a last ی a clitic: beginnings of a verb or a mark behind it, or a definite ending before it.
SWAPS = {"م": {"ت": 45, "ی": 35, "مان": 20}, "ت": {"م": 45, "ی": 35, "تان": 20}, "ی": {"م": 35, "ت": 35, "یان": 30}, "مان": {"تان": 45, "یان": 35, "م": 20}, "تان": {"مان": 45, "یان": 35, "ت": 20}, "یان": {"مان": 40, "تان": 40, "ی": 20}}
PASSIVES, REASSIGNED = ("ڕام", "ڕای"), {"ت": "یت", "ی": "ێت", "مان": "ین", "تان": "ن", "یان": "ن"}
PASSIVE_STEMS = (
    "خوارد نووسی کرد بینی گوت برد خست دا کوشت فرۆشت گرت نارد شکاند خوێند گێڕا دۆزی کڕی فێرکرد ڕشت هێنا تاشی پێچا چنی پاراست دیت ویست ناسی زانی توانی بەخشی هاوشت شوشت لایەند بەست بیست کێڵا پێوا سپارد ژمارد بژارد شارد سووتاند "
    "وەستاند خزاند مراند تەقاند ڕژاند کەواند نواند فراند بەزاند پساند وەراند"
).split()
INVARIANT, VERBS_BEHIND, MARKS_BEHIND, DEFINITE_BEFORE = (*P.REFLEXIVES, "یەکتر", "یەکدی"), ("دە", "نا", "نە", "ب"), ".،؛؟!:)", ("ەکە", "ەکان")
WORD = r"[\p{L}\p{N}_]+$"
CLITIC_KIND = "clitic_form"


def clitic_form(text: Column, key: Column, rate: float = 0.15, seed: int = 42) -> Column:
    """struct<corrupted, errors> as of errors.inject(); single spaces separate words. A clitic at a word's end becomes another one, by fixed
    weights; a passive's the one of the other set. A last ی counts where a verb or a mark follows, or nothing, or the noun is definite: else
    it links the noun. The word behind is the next one, also where the same word stood before."""

    def build(w: Column) -> Column:
        at = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))

        def site(i: Column) -> Column:
            tail = F.regexp_extract(at(i), WORD, 0)
            clitic = F.regexp_extract(tail, f"^.+?({'|'.join(P.CLITICS)})$", 1)
            stem = F.substring(tail, F.lit(1), F.length(tail) - F.length(clitic))
            free = (at(i + 1) == "") | at(i + 1).rlike(f"^(?:{'|'.join(VERBS_BEHIND)}|[{MARKS_BEHIND}])") | stem.rlike(f"(?:{'|'.join(DEFINITE_BEFORE)})$")
            fits = (clitic != "") & (F.length(stem) >= 2) & ~tail.isin(*INVARIANT) & ((clitic != "ی") | free)
            d = _draw(f"{seed}:{CLITIC_KIND}:form", key, i) % 100

            def other(forms: dict[str, int]) -> Column:
                out, below = None, 0
                for form, share in forms.items():
                    below += share
                    out = F.when(d < below, form) if out is None else out.when(d < below, form)
                return out

            swapped = F.coalesce(*(F.when(clitic == c, other(forms)) for c, forms in SWAPS.items()))
            passive = F.coalesce(*(F.when(tail.endswith(m) & F.substring(tail, F.lit(1), F.length(tail) - len(m)).isin(*PASSIVE_STEMS), F.lit(True)) for m in PASSIVES), F.lit(False))
            moved = F.coalesce(*(F.when(clitic == c, new) for c, new in REASSIGNED.items()))
            chosen = fits & _below(_draw(f"{seed}:{CLITIC_KIND}", key, i), rate)
            return F.struct(i.alias("i"), tail.alias("tail"), F.when(chosen, F.concat(stem, F.when(passive & moved.isNotNull(), moved).otherwise(swapped))).alias("new"))

        def join(v: Column) -> Column:
            sites = v["sites"]
            head = lambda s: F.substring(at(s["i"]), F.lit(1), F.length(at(s["i"])) - F.length(s["tail"]))
            out = F.array_join(F.transform(sites, lambda s: F.when(s["new"].isNotNull(), F.concat(head(s), s["new"])).otherwise(at(s["i"]))), " ")
            start = lambda s: F.get(v["starts"], s["i"]) + F.length(head(s))
            errors = F.transform(F.filter(sites, lambda s: s["new"].isNotNull()), lambda s: _error(CLITIC_KIND, s["tail"], s["new"], start(s)))
            return _result(F.when(F.size(errors) > 0, tidied(out)).otherwise(text), errors)

        return let(F.struct(F.transform(places, site).alias("sites"), _starts(w).alias("starts")), join)

    return let(F.split(text, " "), build)
