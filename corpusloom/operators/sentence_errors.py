"""Synthetic errors that need more of a sentence than one word: word order and contrastive connectors.

Each function gives struct<corrupted, errors> with the annotations of inject(); md5 makes the choices. Null text gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let, words
from corpusloom.operators.errors import _draw, starts, tidied

# Connectors of the first and second clause, beginnings of verbs, share of connectors that go.
OPENERS = ["ئەگەرچی", "هەرچەندە", "لەگەڵ ئەوەشدا"]
CLOSERS = ["بەڵام", "کەچی"]
VERB_BEGINNINGS = ["دە", "نا", "نە", "ب"]
DELETED = 0.6

_CONNECTOR = "(?<!\\S)(" + "|".join(OPENERS + CLOSERS) + ")(?!\\S)"
_ERROR = "array<struct<type:string,original:string,error:string,start:int,end:int>>"


def _below(draw: Column, share: float) -> Column:
    return draw < int(share * (1 << 32))


def _result(corrupted: Column, errors: Column) -> Column:
    return F.struct(corrupted.alias("corrupted"), errors.cast(_ERROR).alias("errors"))


def _error(kind: str, original: Column, error: Column, start: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), original.alias("original"), error.alias("error"), start.alias("start"), (start + F.length(original)).alias("end"))


def word_order(text: Column, key: Column, rate: float = 0.15, seed: int = 42) -> Column:
    """With probability rate, a verb at the end of three words or more goes to the second place. Else, with probability rate, two
    neighbours of four words or more change places, the last word excepted. Words are joined by one space where they moved."""
    kind = "word_order"

    def build(w: Column) -> Column:
        n, last = F.size(w), F.element_at(w, F.greatest(F.size(w), F.lit(1)))
        verb = F.exists(F.array(*map(F.lit, VERB_BEGINNINGS)), lambda p: F.startswith(last, p))
        moved = F.array_join(F.concat(F.slice(w, 1, 1), F.array(last), F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0)))), " ")
        i = (_draw(f"{seed}:{kind}:at", key, F.lit(0)) % F.greatest(n - 2, F.lit(1))).cast("int")
        before = F.expr("0")
        a, b = F.get(w, i), F.get(w, i + 1)

        def swap(span: Column) -> Column:
            """span: what comes before the two, and the two as the text has them."""
            old, new = span[1], F.concat_ws(" ", b, a)
            rest = F.substring(text, F.length(span[0]) + F.length(old) + 1, F.length(text))
            return F.when((old != "") & (old != new), _result(F.concat(span[0], new, rest), F.array(_error(kind, old, new, before + F.length(span[0])))))

        # Possessive, so that words are passed in a loop: a greedy group is a call of the matcher for each word.
        skip = F.concat(F.lit(r"(?U)^(\s*+(?:\S++\s++){"), i.cast("string"), F.lit(r"}+)(\S+\s+\S+)"))
        span = F.array(F.regexp_extract_all(text, skip, F.lit(1))[0], F.regexp_extract_all(text, skip, F.lit(2))[0])
        first = F.when((n >= 3) & verb & _below(_draw(f"{seed}:{kind}", key, F.lit(0)), rate), _result(moved, F.array(_error(kind, text, moved, before))))
        second = F.when((n >= 4) & _below(_draw(f"{seed}:{kind}", key, F.lit(1)), rate), let(span, swap))
        return F.coalesce(first, second, _result(text, F.array()))

    return let(words(text), build)


def connectors(text: Column, key: Column, rate: float = 0.15, seed: int = 42) -> Column:
    """Connectors of contrastive sentences: each chosen one goes (60 %) or becomes one of the other kind. Where a sentence has both
    kinds, all are chosen, as one that stays would make it right, and runs of spaces become one; else each with probability rate."""
    kind = "missing_adversative_connector"
    opens = lambda c: c.isin(*OPENERS)

    def build(v: Column) -> Column:
        """v: struct<found, parts> of connectors and what is between them."""
        found, parts = v["found"], v["parts"]
        both = F.exists(found, opens) & F.exists(found, lambda c: ~opens(c))

        def replace(c: Column, i: Column) -> Column:
            draw = _draw(f"{seed}:{kind}:form", key, i)
            other = F.when(opens(c), F.get(F.array(*map(F.lit, CLOSERS)), (draw % len(CLOSERS)).cast("int"))).otherwise(F.get(F.array(*map(F.lit, OPENERS)), (draw % len(OPENERS)).cast("int")))
            new = F.when(_below(_draw(f"{seed}:{kind}:gone", key, i), DELETED), F.lit("")).otherwise(other)
            start = F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda s, k: s + F.length(F.get(parts, k)) + F.when(k < i, F.length(F.get(found, k))).otherwise(0))
            return F.struct(c.alias("old"), F.when(both | _below(_draw(f"{seed}:{kind}", key, i), rate), new).alias("new"), start.alias("start"))

        def finish(x: Column) -> Column:
            tail = F.concat(F.transform(x, lambda y: F.coalesce(y["new"], y["old"])), F.array(F.lit("")))
            joined = F.array_join(F.zip_with(parts, tail, lambda p, t: F.concat(p, t)), "")
            corrupted = F.when(both, F.trim(F.regexp_replace(joined, " +", " "))).otherwise(joined)
            return _result(corrupted, F.transform(F.filter(x, lambda y: y["new"].isNotNull()), lambda y: _error(kind, y["old"], y["new"], y["start"])))

        return let(F.transform(found, replace), finish)

    return let(F.struct(F.regexp_extract_all(text, F.lit(_CONNECTOR), F.lit(1)).alias("found"), F.split(text, _CONNECTOR, -1).alias("parts")), build)


def whitespace(text: Column, key: Column, rate: float = 0.15, seed: int = 42, most: int = 12, least: int = 5) -> Column:
    """Two neighbours of `most` letters together become one word, a word of `least` letters or more becomes two; each with probability
    rate. Of two that overlap the one that begins last is used: from the right, a word is cut, or fused with the next one if that was
    left alone."""
    kind = "whitespace"

    def build(v: Column) -> Column:
        """v: struct<w, gaps> of words and what is around them."""
        w, gaps = v["w"], v["gaps"]
        n = F.size(w)
        cut = lambda i: (F.length(F.get(w, i)) >= least) & _below(_draw(f"{seed}:{kind}", key, i), rate)
        fuse = lambda i: (i + 1 < n) & (F.length(F.get(w, i)) + F.length(F.get(w, i + 1)) <= most) & _below(_draw(f"{seed}:{kind}:fuse", key, i), rate)
        act = lambda s, i: F.concat(F.when(cut(i), "c").when(fuse(i) & ~F.substring(s, 1, 1).isin("c", "f"), "f").otherwise("n"), s)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        acts = F.aggregate(F.reverse(places), F.lit(""), act)

        def finish(x: Column) -> Column:
            is_ = lambda i, c: F.get(x["acts"], i) == c
            halves = lambda i: (_draw(f"{seed}:{kind}:form", key, i) % F.greatest(F.length(F.get(w, i)) - 3, F.lit(1)) + 2).cast("int")
            form = lambda i: F.when(is_(i, "c"), F.concat(F.substring(F.get(w, i), F.lit(1), halves(i)), F.lit(" "), F.substring(F.get(w, i), halves(i) + 1, F.length(F.get(w, i))))).otherwise(F.get(w, i))
            gap = lambda i: F.when((i > 0) & is_(i - 1, "f"), "").otherwise(F.get(gaps, i))
            out = F.concat(F.array_join(F.transform(places, lambda i: F.concat(gap(i), form(i))), ""), F.element_at(gaps, -1))
            start = lambda i: F.get(x["starts"], i) + F.length(F.get(gaps, i))
            both = lambda i, mid: F.concat(F.get(w, i), mid, F.get(w, i + 1))
            error = lambda i: F.when(is_(i, "c"), _error(kind, F.get(w, i), form(i), start(i))).otherwise(_error(kind, both(i, F.get(gaps, i + 1)), both(i, F.lit("")), start(i)))
            errors = F.transform(F.filter(places, lambda i: ~is_(i, "n")), error)
            return _result(F.when(F.size(errors) > 0, tidied(out)).otherwise(text), errors)

        lengths = F.zip_with(w, F.slice(gaps, F.lit(1), n), lambda a, b: F.length(a) + F.length(b))
        return let(F.struct(F.split(acts, "").alias("acts"), starts(lengths).alias("starts")), finish)

    return let(F.struct(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)).alias("w"), F.split(text, r"(?U)\S+", -1).alias("gaps")), build)


SENTENCE_GENERATORS = {"word_order": word_order, "missing_adversative_connector": connectors, "whitespace": whitespace}
