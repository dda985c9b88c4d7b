"""Synthetic errors that look at a sentence as a whole, and the generation of corpora from all kinds of errors.

A rule finds the sites of a sentence: spans and what may stand there instead, with weights. Rules run on Arrow batches; from
there on all is relational. All draws depend on the seed, the row's key and the kind alone. Of sites that overlap, the one
that begins last is used.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import verb_profile as V
from corpusloom.operators import errors as E
from corpusloom.operators import sentence_errors as SE
from corpusloom.operators.sampling import numbered, oversample
from corpusloom.operators.statistics import new_tokens
from corpusloom.sources.writers import saved

RESULT = "struct<corrupted:string,errors:array<struct<type:string,original:string,error:string,start:int,end:int>>>"


class Site(NamedTuple):
    start: int
    end: int
    forms: dict[str, float]


Rule = Callable[[str], Iterator[Site]]


def _any(words) -> str:
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


def _whole(pattern: str) -> re.Pattern:
    """A pattern between white space or the ends of the text."""
    return re.compile(rf"(?<!\S){pattern}(?!\S)")


def _even(*forms: str) -> dict[str, float]:
    return dict.fromkeys(forms, 1.0)


@lru_cache(8)
def _spans(text: str) -> list[tuple[int, int, str]]:
    """Words with their places; joiners are no part of a word. Rules ask for the same text in turn."""
    out, end = [], 0
    for word in text.split():
        start = text.find(word, end)
        end = start + len(word)
        out.append((start, end, word.replace("‍", "")))
    return out


def _by_word(forms: Callable[[str], dict[str, float]]) -> Rule:
    """A rule that looks at each word alone; what it makes of frequent words is kept."""
    forms = lru_cache(1 << 15)(forms)

    def rule(text: str) -> Iterator[Site]:
        for start, end, word in _spans(text):
            if found := forms(word):
                yield Site(start, end, found)

    return rule


def _by_table(table: dict[str, list[str]]) -> Rule:
    return _by_word(lambda w: _even(*table.get(w, ())))


def _disjoint(sites: Iterator[Site]) -> Iterator[Site]:
    """Sites whose beginning no earlier one covers."""
    taken: list[Site] = []
    for s in sites:
        if not any(t.start <= s.start < t.end for t in taken):
            taken.append(s)
            yield s


# Patterns of what a rule changes.
_PRE = f"(?:{_any(V.PREVERBS)})?"
_PRESENT = re.compile(rf"((?:نە|نا)?{_PRE}(?:{_any(V.PRESENT_PREFIXES)}))(\w+?)(م|یت|ی|ێت|ێ|ات|ین|ن|ەم|ەن)(?!\S)")
_IMPERATIVE = re.compile(rf"({_PRE}(?:ب|مە))(\w+?)([ەن])(?!\S)")
_TRANSITIVE = _whole(rf"((?:نە)?{_PRE})({_any(V.TRANSITIVE_STEMS)})(مان|تان|یان|م|ت)?")
_BEFORE_STEM = re.compile(f"^(?:نە|{_any(V.PREVERBS)})")
_PAST_ADVERB, _PRESENT_ADVERB = _whole(f"(?:{_any(V.PAST_ADVERBS)})"), _whole(f"(?:{_any(V.PRESENT_ADVERBS)})")
_PAST_VERB = _whole(rf"((?:نە|نا)?{_PRE})({_any(V.ADVERB_STEMS)})({_any(filter(None, V.PAST_TO_PRESENT))})?")
_PRESENT_VERB = _whole(rf"((?:نە|نا)?{_PRE})(?:دە|ئە|نا)(\w+?)(م|یت|ێت|ێ|ات|ین|ن|ەم|ەن)")
_MANY_CALLED = re.compile(rf"\S{V.VOCATIVE_PLURAL}(?!\S)")
_ONE_CALLED = re.compile(rf"\S{{2,}}(?:{_any(V.VOCATIVE_SINGULAR)})(?!\S)|(?<!\S)(?:{_any(V.VOCATIVE_PARTICLES)})(?!\S)")
_ORDER = _whole(rf"({_PRE}(?:ب|مە))(?:(\w+?)([ەن])|({_any(V.VOWEL_STEMS)}))")
_CONDITION = _whole(f"(?:{_any(V.CONDITIONALS)})")
_MOOD = _whole(rf"((?:نە|نا|مە)?{_PRE})(ب|دە|ئە)(\w+?)(م|یت|ێت|ێ|ین|ن|ات|ە)")
_NEGATIVE, _NOTHING, _NEGATED = _whole(r"(?:هیچ\S*|چ)"), _whole(r"هیچ\S*"), _whole(r"(نا|نە)(\S{3,})")
_POLITE = re.compile(rf"(?<!\S)({_any(V.POLITE)})(?:\s*[،,])?\s+")
_POLITE_ORDER = _whole(r"(?:ب|مە)\w{2,}[ەنۆێ]")
_MARK = re.compile(f"[{re.escape(''.join(E.MARKS))}]")
_CONNECTOR = _whole(f"(?:{_any(SE.OPENERS + SE.CLOSERS)})")
_MARKS_AFTER_SPACE = re.compile(" ([,.،؛])")


# Letters, spaces and marks.


def _orthography(word: str) -> dict[str, float]:
    """All places of the first two pairs change, of the others the first one; a doubled waw and a word's first letter have rules."""
    out = [word.replace(a, b) for a, b in (("ح", "ه"), ("ه", "ح"), ("غ", "خ"), ("خ", "غ")) if a in word and not (a == "ه" and word.endswith("ە"))]
    if "و" in word:
        out.append(word.replace("وو", "و", 1) if "وو" in word else word.replace("و", "وو", 1))
    if word[0] in "ئی":
        out.append(("ی" if word[0] == "ئ" else "ئ") + word[1:])
    blocked = {"ئ": word[0] == "ئ", "ی": word[0] == "ی", "و": "وو" in word or "ۆ" in word}
    for a, b in E.ORTHOGRAPHY[2:]:
        out += [word.replace(x, y, 1) for x, y in ((a, b), (b, a)) if x in word and not blocked.get(x)]
    return {w: float(out.count(w)) for w in out}


def _spelling(word: str) -> dict[str, float]:
    out: dict[str, float] = {}
    for (a, b), weight in V.CONFUSED_WEIGHTS.items():
        for x, y in ((a, b), (b, a)):
            if x in word:
                form = word.replace(x, y, 1)
                out[form] = out.get(form, 0.0) + weight
    return out


@lru_cache(1 << 15)
def _parted(word: str) -> dict[str, float]:
    return _even(*(f"{word[:i]} {word[i:]}" for i in range(2, len(word) - 1)))


def _whitespace(text: str, most: int = 12, least: int = 5) -> Iterator[Site]:
    """Two short neighbours become one word; a long word becomes two."""
    spans = _spans(text)
    for (start, _, a), (_, end, b) in zip(spans, spans[1:], strict=False):
        if len(a) + len(b) <= most:
            yield Site(start, end, _even(a + b))
    for start, end, word in spans:
        if len(word) >= least:
            yield Site(start, end, _parted(word))


def _punctuation(text: str) -> Iterator[Site]:
    for m in _MARK.finditer(text):
        yield Site(m.start(), m.end(), _even(*E.MARKS[m[0]]))


# Verbs.



def _flip_present(stem: str, ending: str) -> dict[str, float]:
    """The endings of the other number; a third person singular has the one that its stem takes."""
    person = next(p for p, forms in V.PRESENT_FORMS.items() if ending in forms)
    target = V.NUMBER_FLIP[person]
    wrong = ("ێت" if stem.endswith(V.AT_STEMS) else "ات") if target == "3sg" else None
    return _even(*(e for e in V.PRESENT_FORMS[target] if e not in (wrong, ending)))


def _subject_verb(text: str) -> Iterator[Site]:
    def found() -> Iterator[Site]:
        for m in _PRESENT.finditer(text):
            yield Site(m.start(), m.end(), {m[1] + m[2] + e: w for e, w in _flip_present(m[2], m[3]).items()})
        for m in _IMPERATIVE.finditer(text):
            yield Site(m.start(), m.end(), _even(m[1] + m[2] + ("ن" if m[3] == "ە" else "ە")))
        for m in _TRANSITIVE.finditer(text):
            person = next(p for p, e in V.PAST_ENDINGS.items() if e == (m[3] or ""))
            yield Site(m.start(), m.end(), _even(m[1] + m[2] + V.PAST_ENDINGS[V.NUMBER_FLIP[person]]))

    return _disjoint(found())


def _tense(text: str) -> Iterator[Site]:
    """A past verb keeps its stem and takes an ending of the present."""
    for start, end, word in _spans(text):
        if word.startswith(V.PRESENT_PREFIXES) or word.endswith(("تن", "دن", "نەوە")):
            continue
        bare = _BEFORE_STEM.sub("", word, count=1)
        for stem in sorted((s for s in V.PAST_STEMS if s in word), key=len, reverse=True):
            rest = bare[len(stem) :] if stem in bare else ""
            if len(rest) > 3 and not rest.endswith(tuple(e for e in V.PAST_ENDINGS.values() if e)):
                continue
            kept = word[: word.index(stem) + len(stem)]
            endings = V.PRESENT_ENDINGS | ({"3sg": "ات"} if stem.endswith(V.AT_STEMS) else {})
            forms = [kept + e for e in endings.values() if kept + e != word]
            yield Site(start, end, {f: float(forms.count(f)) for f in forms})
            break


def _adverb_tense(text: str) -> Iterator[Site]:
    """A verb whose tense fits the adverb of time gets the other tense."""
    if _PAST_ADVERB.search(text):
        for m in _PAST_VERB.finditer(text):
            if not m[0].startswith((*V.PRESENT_PREFIXES, "نا")):
                yield Site(m.start(), m.end(), _even(f"{m[1]}دە{m[2]}{V.PAST_TO_PRESENT[m[3] or '']}"))
    elif _PRESENT_ADVERB.search(text):
        for m in _PRESENT_VERB.finditer(text):
            yield Site(m.start(), m.end(), _even(m[1] + m[2] + V.PRESENT_TO_PAST[m[3]]))


def _imperative(text: str) -> Iterator[Site]:
    """An imperative of the number of the one addressed gets the other number."""
    plural = _MANY_CALLED.search(text)
    if not plural and not _ONE_CALLED.search(text):
        return
    for m in _ORDER.finditer(text):
        if (m[3] == "ن") == bool(plural):
            yield Site(m.start(), m.end(), _even(f"{m[1]}{m[2]}ە" if plural else f"{m[1]}{m[2] or m[4]}ن"))



def _conditional(text: str) -> Iterator[Site]:
    """Verbs of the condition change between subjunctive and present. It ends at a mark, or else behind its first verb that is not in a
    relative clause."""
    marker = _CONDITION.search(text)
    if not marker:
        return
    rest, verb = text[marker.end() :], _MOOD
    end = re.search("[،,؛]", rest)
    relative = rest.find(" کە ") if " کە " in rest else len(rest)
    stop = end.start() if end else next((m.end() for m in verb.finditer(rest) if m.start() <= relative), len(rest))
    for m in verb.finditer(rest[:stop]):
        if m[2] == "ب" or m[4] != "ە":  # a present verb has no ending like that
            yield Site(marker.end() + m.start(), marker.end() + m.end(), _even(m[1] + ("دە" if m[2] == "ب" else "ب") + m[3] + m[4]))


# Clauses.


def _concord(text: str) -> Iterator[Site]:
    """With a negative pronoun, a verb of its clause loses its negation, or the pronoun goes."""
    pronoun = _NEGATIVE.search(text)
    if not pronoun:
        return
    for m in _NEGATED.finditer(text):
        between = text[min(pronoun.start(), m.start()) : max(pronoun.start(), m.start())]
        if not re.search(r"[،؛,]|(?<!\S)(?:و|کە)(?!\S)", between):
            yield Site(m.start(), m.end(), _even(("دە" if m[1] == "نا" else "") + m[2]))
    if word := _NOTHING.search(text):
        yield Site(word.start(), word.end(), _even(""))


def _quantifier(text: str) -> Iterator[Site]:
    """A plural verb behind a quantifier becomes singular."""
    spans = _spans(text)
    first = next((i for i, (_, end, w) in enumerate(spans) if w in V.QUANTIFIERS and end < len(text)), len(spans))
    for start, _, word in spans[first + 1 :]:
        for plural, singular in V.PLURAL_TO_SINGULAR.items():
            stem = word[: -len(plural)]
            if word.endswith(plural) and len(stem) >= 2 and (len(stem) >= 3 or stem.startswith(V.VERB_LIKE)):
                yield Site(start, start + len(word), _even(stem + singular))
                break


def _polite(text: str) -> Iterator[Site]:
    """A marker of politeness before an imperative goes (70 %) or becomes another one."""
    for m in _POLITE.finditer(text):
        rest = text[m.end() :]
        word = next((w for _, _, w in _spans(rest)), "")
        if _POLITE_ORDER.search(rest) or (len(word) >= 3 and not word.startswith(("دە", "ئە", "نە", "نا"))):
            others = V.POLITE[m[1]]
            yield Site(m.start(), m.end(), {"": 0.7} | {m[0].replace(m[1], o, 1): 0.3 / len(others) for o in others})


def _cross_clause(text: str) -> Iterator[Site]:
    """Of the three words behind a conjunction, the first that can be a verb gets or loses the prefix of the present."""
    spans = _spans(text)
    for i, (_, _, word) in enumerate(spans):
        for start, _, verb in spans[i + 1 : i + 4] if word in V.CONJUNCTIONS else ():
            if verb.startswith("دە"):
                form = verb[2:] if len(verb) > 3 else None
            else:
                form = None if len(verb) < 3 or (verb.startswith("نە") and not verb.startswith("نەدە")) else f"دە{verb}"
            if form:
                yield Site(start, start + len(verb), _even(form))
                break


def _relative(text: str) -> Iterator[Site]:
    """The noun before a relative clause loses its link, with the particle or without; a reduced clause gets a particle instead of its
    verb."""

    def found() -> Iterator[Site]:
        for m in re.finditer(r"(\S{2,})ی\s+کە(?!\S)", text):
            yield Site(m.start(), m.end(), _even(m[1], f"{m[1]} کە"))
        for m in re.finditer(r"(\S+ەکە)ی\s+((?:دە|نا|نە|ب)\S*)", text):
            yield Site(m.start(), m.start() + len(m[1]) + 2 + len(m[2]), _even(f"{m[1]}ی کە"))

    return _disjoint(found())




def _participle(word: str) -> dict[str, float]:
    m = re.fullmatch("(.+?)(?:ووە|وە)", word)
    return _even(f"{m[1]}یە", f"{m[1]}گە") if m and m[1] not in E.NOT_PARTICIPLES else {}


def _possessive(word: str) -> dict[str, float]:
    for end in sorted(E.POSSESSIVES, key=len, reverse=True):
        stem = word[: -len(end)]
        if word.endswith(end) and re.fullmatch("[؀-ۿ]{3,}", stem) and not stem.startswith(E.VERB_PREFIXES):
            return _even(*(stem + c for c in E.POSSESSIVES[end]))
    return {}


def _morphemes(word: str) -> dict[str, float]:
    """As the column function of that name."""
    out = [b + word[len(a) :] for a, b in E.PREFIX_ORDER.items() if word.startswith(a)][:1] + E.PARTICLES.get(word, [])
    if word.endswith(E.COMPLETIVE) and len(word) > 5:
        stem = word[: -len(E.COMPLETIVE)]
        m = re.match(f"([^{E.VOWELS}]*[{E.VOWELS}]+)[^{E.VOWELS}]", stem)
        at = len(m[1]) if m and len(m[1]) > 1 else min(3, len(stem))
        out.append(stem[:at] + E.COMPLETIVE + stem[at:])
    return _even(*(w for w in out if w != word))


def _word_order(text: str) -> Iterator[Site]:
    """A verb at the end goes to the second place; two neighbours, the last word excepted, change places."""
    spans = _spans(text)
    words = [w for _, _, w in spans]
    if len(words) >= 3 and words[-1].startswith(tuple(SE.VERB_BEGINNINGS)):
        yield Site(0, len(text), _even(" ".join([words[0], words[-1], *words[1:-1]])))
    if len(words) >= 4:
        for (start, _, a), (_, end, b) in zip(spans[:-2], spans[1:-1], strict=True):
            yield Site(start, end, _even(f"{b} {a}"))


def _connectors(text: str) -> Iterator[Site]:
    for m in _CONNECTOR.finditer(text):
        others = SE.CLOSERS if m[0] in SE.OPENERS else SE.OPENERS
        yield Site(m.start(), m.end(), {"": SE.DELETED} | {o: (1 - SE.DELETED) / len(others) for o in others})


RULES: dict[str, Rule] = {
    "subject_verb_number": _subject_verb, "tense_agreement": _tense, "case_role_preposition": _by_table(E.PREPOSITIONS), "dialectal_participle": _by_word(_participle), "relative_clause_ezafe": _relative,
    "missing_adversative_connector": _connectors, "participle_voice_swap": _by_table({k: [v] for k, v in E.PARTICIPLES.items()} | {v: [k] for k, v in E.PARTICIPLES.items()}), "orthography": _by_word(_orthography),
    "negative_concord": _concord, "vocative_imperative": _imperative, "conditional_agreement": _conditional, "adverb_verb_tense": _adverb_tense, "preposition_fusion": _by_table(E.FUSED),
    "demonstrative_contraction": _by_table(E.CONTRACTED), "quantifier_agreement": _quantifier, "possessive_clitic": _by_word(_possessive), "polite_imperative": _polite, "spelling_confusion": _by_word(_spelling),
    "word_order": _word_order, "whitespace": _whitespace, "punctuation": _punctuation, "cross_clause_agreement": _cross_clause, "morpheme_order": _by_word(_morphemes),
}


_KINDS, _WEIGHTS = list(RULES), list(accumulate(V.GENERATOR_WEIGHTS[k] for k in RULES))


def apply_rule(text: str, kind: str, draw: random.Random, rate: float, skip: list[tuple[int, int]] = ()) -> tuple[str, list[tuple]]:
    """The corrupted text and the errors (kind, original, error, start, end; places in the text given). skip: spans to leave alone."""
    rate_ = 1.0 if kind == "missing_adversative_connector" and {w in SE.OPENERS for w in re.findall(SE._CONNECTOR, text)} == {True, False} else rate
    sites = [s for s in RULES[kind](text) if s.forms and not any(s.start < e and s.end > b for b, e in skip)]
    chosen = [s for s in sites if draw.random() < rate_]
    errors, out, left = [], text, len(text) + 1
    for s in sorted(chosen, key=lambda s: (-s.start, s.end)):
        if s.end > left:
            continue
        form = draw.choices(list(s.forms), list(s.forms.values()))[0]
        if form != text[s.start : s.end]:
            out, left = out[: s.start] + form + out[s.end :], s.start
            errors.append((kind, text[s.start : s.end], form.strip(), s.start, s.end))
    if errors:
        out = _MARKS_AFTER_SPACE.sub(r"\1", re.sub(" +", " ", out)).strip()
    return out, errors[::-1]


def corrupt(text: str, key: str, rate: float = 0.15, seed: int = 42, most: int = 2) -> tuple[str, list[tuple]]:
    """One to `most` kinds of errors, drawn by weight, one after the other; words that one of them changed are left alone by the next."""
    draw = random.Random(f"{seed}:{key}")
    n = draw.randint(1, most)
    kinds = list(dict.fromkeys(draw.choices(_KINDS, cum_weights=_WEIGHTS, k=2 * n)))[:n]
    out, errors, changed = text, [], set()
    for more, kind in zip(range(len(kinds) - 1, -1, -1), kinds, strict=True):
        skip = [s[:2] for i, s in enumerate(_spans(out)) if i in changed] if changed else []
        then, found = apply_rule(out, kind, draw, rate, skip)
        if found:
            if more:  # only a kind that follows asks what was changed
                old, new = [w for _, _, w in _spans(out)], [w for _, _, w in _spans(then)]
                changed |= {i for i in range(max(len(old), len(new))) if old[i : i + 1] != new[i : i + 1]}
            out = then
            errors += found
    return out, errors


def _structs(results: list[tuple[str, list[tuple]]]) -> pa.Array:
    """Corrupted texts and their errors as RESULT has them, built column by column."""
    found = list(zip(*(e for _, errors in results for e in errors), strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
    errors = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], ["type", "original", "error", "start", "end"])
    ends = pa.array(accumulate((len(errors) for _, errors in results), initial=0), pa.int32())
    return pa.StructArray.from_arrays([pa.array([text for text, _ in results], pa.string()), pa.ListArray.from_arrays(ends, errors)], ["corrupted", "errors"])


def inject_rule(text: str, key: Column, kind: str, rate: float = 0.15, seed: int = 42) -> Column:
    """struct<corrupted, errors> of one kind of error; a null text counts as empty."""

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _structs([apply_rule(t or "", kind, random.Random(f"{seed}:{kind}:{k}"), rate) for t, k in zip(texts.to_pylist(), keys.to_pylist(), strict=True)])

    return F.arrow_udf(run, RESULT)(text, key)


def corrupt_sentences(text: str, key: Column, rate: float = 0.15, seed: int = 42, most: int = 2) -> Column:
    """struct<corrupted, errors> of one to `most` kinds of errors."""

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return _structs([corrupt(t or "", k, rate, seed, most) for t, k in zip(texts.to_pylist(), keys.to_pylist(), strict=True)])

    return F.arrow_udf(run, RESULT)(text, key)


def with_invalid_words(pairs: DataFrame, known: DataFrame, original: str, corrupted: str, *key: str) -> DataFrame:
    """Pairs without those all of whose new words a table of words (word) has: such errors can't be told from right text."""
    words = pairs.select(*key, F.explode(new_tokens(F.col(original), F.col(corrupted))).alias("word"))
    counts = words.join(known.select("word").distinct().withColumn("_known", F.lit(1)), "word", "left").groupBy(*key).agg(F.count("*").alias("_n"), F.count("_known").alias("_k"))
    return pairs.join(counts.where("_n = _k").select(*key), list(key), "left_anti")


def generate_corpus(sentences: DataFrame, text: str, *key: str, target: int = 50_000, ratio: float = 0.7, rate: float = 0.15, seed: int = 42, known: DataFrame | None = None) -> DataFrame:
    """key, original, corrupted, errors, source_id, and all other columns: int(target x ratio) pairs with errors and the rest without.

    Sentences are repeated or cut to `target`. In the first round every sentence is corrupted; those that got an error (and, with known
    words, an invalid one) fill the quota in shuffled order. Further rounds try those that can get one as often as the quota lacks, until
    it is full. If a round, and one more at rate 1, adds nothing, the pairs that were found are repeated. With none found all pairs are
    clean: their quota is not raised then. Clean pairs are the first in another order. source_id names the sentence.
    """
    known = saved(known.select("word").distinct()) if known is not None else None
    base = saved(oversample(sentences, target, *key).withColumn("source_id", F.concat_ws(":", *key, "copy")))
    want = int(target * ratio)

    def attempt(rows: DataFrame, copies: int, at: float, r: int) -> DataFrame:
        rows = rows.withColumn("_try", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        name = F.when((F.lit(r) == 0), F.concat_ws(":", "source_id", F.lit("0"))).otherwise(F.concat_ws(":", "source_id", F.lit(str(r)), "_try"))
        tried = rows.withColumn("_r", corrupt_sentences(text, name, at, seed)).where(F.expr(f"size(_r.errors) > 0 and _r.corrupted <> `{text}`"))
        tried = tried.select(*base.columns, F.col(text).alias("original"), "_r.*", F.lit(r).alias("_round"), "_try")
        return with_invalid_words(tried, known, "original", "corrupted", "source_id", "_round", "_try") if known is not None else tried

    rows, found, have, copies, at, r = base, [], 0, 1, rate, 0
    while have < want:
        found.append(saved(attempt(rows, copies, at, r)))
        new = found[-1].count()
        have += new
        if not new and at == 1.0:
            break
        at = rate if new else 1.0
        if r == 0 and have < want:  # sentences with an error at rate 1, or found with one already
            can = attempt(base, 1, 1.0, 1).select("source_id").unionByName(found[0].select("source_id")).distinct()
            rows = saved(base.join(can, "source_id", "left_semi").select(*base.columns))
        copies = min(-(-copies * (want - have) // new) + 1, 1000) if new else copies
        r += 1
    order = lambda name, *c: F.md5(F.concat_ws(":", F.lit(f"{seed}:{name}"), *c))
    clean = numbered(base.withColumn("_h", order("clean", "source_id")), ["_h", "source_id"]).where(F.col("_rn") <= target - want)
    clean = clean.select(*base.columns, F.col(text).alias("original"), F.col(text).alias("corrupted"), F.from_json(F.lit("[]"), RESULT.split("errors:")[1][:-1]).alias("errors"))
    if not have:
        return clean
    every = reduce(DataFrame.unionByName, found).withColumn("_h", order("bad", "source_id", "_round", "_try"))
    place = ["_round", "_h", "source_id", "_try"]
    if have >= want:
        bad = numbered(every, place).where(F.col("_rn") <= want)
    else:
        bad = oversample(every.withColumnRenamed("copy", "_copy"), want, *place).drop("copy").withColumnRenamed("_copy", "copy")
    return bad.select(*clean.columns).unionByName(clean)


def generation_statistics(pairs: DataFrame) -> DataFrame:
    """type, n: errors of each type, and rows 'corrupted' and 'clean_pairs' with the pairs' numbers."""
    by_type = pairs.select(F.explode("errors.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    sums = pairs.groupBy(F.when(F.size("errors") > 0, "corrupted").otherwise("clean_pairs").alias("type")).agg(F.count("*").alias("n"))
    return by_type.unionByName(sums)


def byte_labels(text: str, errors: list[tuple[int, int]]) -> list[int]:
    """1 for each UTF-8 byte of text that one of the spans (of characters) covers, else 0."""
    marked = [False] * len(text)
    for start, end in errors:
        marked[start:end] = [True] * (min(end, len(text)) - min(start, len(text)))
    return [int(m) for c, m in zip(text, marked, strict=True) for _ in c.encode("utf-8", "surrogatepass")]
