"""The checks of operators/agreement.py on arrays of a block's tokens, all of them in one pass over a sentence."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.functions import graph_profile as G
from corpusloom.functions import verb_profile as V
from corpusloom.operators import agreement as A
from corpusloom.operators import blocks
from corpusloom.operators.blocks import Sentences, _take

_FRONT = re.compile("^(?:" + "|".join(G.PREFIXES) + ")(.+)$")
_PAST = re.compile("^(?:نە)?(?:" + "|".join(A.TRANSITIVE) + ")")


def _table(pairs: dict, part: int) -> dict[str, int]:
    """Persons as numbers; of numbers, 1 is singular and 2 plural. 0 is none."""
    return {k: int(v[0]) if part == 0 else ("sg", "pl").index(v[1]) + 1 for k, v in pairs.items()}


class Words:
    """What checks ask of a block's distinct tokens alone: arrays by their number."""

    def __init__(self, words: list[str], told: list[str]):
        self.bears, self.misspelt = (np.fromiter((f[n] == "1" for f in told), bool, len(told)) for n in (0, 1))
        flag = lambda test: np.fromiter(map(test, words), bool, len(words))
        among = lambda *some: flag(frozenset(some).__contains__)
        begins = lambda *some: flag(lambda t: t.startswith(some))
        ends = lambda *some: flag(lambda t: t.endswith(some))
        number = lambda of: np.fromiter(map(of, words), np.int8, len(words))
        stems, endings = tuple(G.TRANSITIVE), tuple(A.ENDINGS)
        behind = lambda t: (_FRONT.match(t) or ("", ""))[1]
        first = lambda table: lambda t: next((v for e, v in table.items() if t.endswith(e)), 0)
        self.mark, self.is_and, self.showing, self.ends_phrase = among(*A.MARKS), among(A.AND), among(*A.SHOWING), among(*A.ENDS_PHRASE)
        self.present = begins(*V.PRESENT_PREFIXES)
        self.stem = flag(lambda t: t.startswith(stems) or behind(t).startswith(stems))
        self.verb, self.clause_verb = self.present | begins("نا"), begins(*A.VERB_BEGINNINGS)
        self.transitive, self.indicative, self.no_modifier = begins(*A.TRANSITIVE), begins("دە"), begins(*A.NO_MODIFIER)
        now = self.present | flag(lambda t: t.startswith("نا") and len(t) > 3 and t[2:].endswith(endings)) | flag(lambda t: t.startswith("ب") and len(t) > 1)
        past = flag(lambda t: _PAST.match(t) is not None or (t.endswith(("مان", "تان", "یان")) and len(t) > 4))
        self.tense = np.select([now, past], [1, 2], 0)
        persons, numbers = _table(A.PRONOUNS, 0), _table(A.PRONOUNS, 1)
        self.person, self.number = number(lambda t: persons.get(t, 0)), number(lambda t: numbers.get(t, 0))
        self.vp, self.vn = number(first(_table(A.ENDINGS, 0))), number(first(_table(A.ENDINGS, 1)))
        self.noun = np.select([ends("ەکان"), ends("ەکە")], [2, 1], 0)
        suffixes = lambda some: sum((ends(e).astype(np.int64) for e in some), np.zeros(len(words), np.int64)) > 0
        self.shown = suffixes(A.DEFINITE).astype(np.int64) + suffixes(A.INDEFINITE)
        self.link = flag(lambda t: len(t) > 1 and t[-1] == "ی" and t[-2] in A.FINAL_VOWELS)
        self.quantifier, self.relative, self.conditional, self.vocative = among(*A.QUANTIFIERS), among(*A.RELATIVES), among(*A.CONDITIONALS), among(*A.VOCATIVES)
        self.negative, self.negation, self.bare, self.pointing = among(*A.NEGATIVE), begins("نا", "نە"), among(*A.BARE_NOUNS), among(*A.DEMONSTRATIVES)
        self.command = flag(lambda t: t.startswith("ب") and len(t) > 2)
        self.plural = ends("ن")
        self.past_adverb, self.present_adverb = among(*A.PAST_ADVERBS), among(*A.PRESENT_ADVERBS)


def _clauses(s: Sentences, word, marks: bool) -> np.ndarray:
    """Numbers of clauses within sentences, as agreement._clauses() has them with two words at least. Only `and` and marks are looked at
    one by one."""
    is_and, verb = word("is_and"), word("clause_verb") | (word("transitive") if marks else False)
    mark = word("mark") if marks else np.zeros(s.n, bool)
    counted = np.concatenate([[0], np.cumsum(~is_and if marks else np.ones(s.n, bool))])
    verbs = np.concatenate([[0], np.cumsum(verb & ~is_and if marks else verb)])
    begins, sentence, since = np.zeros(s.n, bool), -1, 0
    for k in np.flatnonzero(is_and | mark).tolist():
        if s.start[k] != sentence:
            sentence = since = int(s.start[k])
        has, n = verbs[k] > verbs[since], counted[k] - counted[since]
        if mark[k] or (is_and[k] and ((k > sentence and (has or n >= 2)) if marks else (has and n >= 2))):
            # What begins a clause is not counted in it.
            begins[k], since = True, k + 1
    return s.running(begins)


def checks(word, s: Sentences) -> dict[str, np.ndarray]:
    """Violations of each of agreement.CHECKS by sentence. word(name): what is known of the tokens."""
    at, total = s.at, s.total
    of = lambda name, index, none=0: _take(word(name), index, none)
    has = lambda where: total(where) > 0
    previous, following, two_before = s.shifted(-1), s.shifted(1), s.shifted(-2)
    clause, mark, is_and, person, number = _clauses(s, word, True), word("mark"), word("is_and"), word("person"), word("number")
    segment = s.running(mark)
    ahead = s.next(word("verb"))
    in_clause, in_segment = (np.where((ahead >= 0) & (_take(c, ahead, -1) == c), ahead, -1) for c in (clause, segment))

    def differs(verb: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a verb's person or number is known and another one."""
        vp, vn = of("vp", verb), of("vn", verb)
        return ((vp > 0) & (p > 0) & (vp != p)) | ((vn > 0) & (n > 0) & (vn != n))

    noun = word("noun")
    object_person, object_number = np.where(person > 0, person, np.where(noun > 0, 3, 0)), np.where(number > 0, number, noun)
    last = s.last(object_person > 0)
    clause_before = _take(clause, previous, 0)
    ergative = ~word("present") & word("stem") & (word("vp") > 0) & (last >= 0) & (_take(clause_before, last, -1) == clause_before)
    ergative &= differs(at, _take(object_person, last, 0), _take(object_number, last, 0))

    shown, phrase_end = s.last(word("showing")), s.last(word("ends_phrase"))
    in_phrase = ~word("showing") & (shown >= 0) & (at - shown <= 3) & (phrase_end <= shown)
    ezafe = np.where(in_phrase, word("shown"), 0) + (word("link") & (following >= 0) & ~of("no_modifier", following, False))

    # A value that one side lacks is not compared.
    before_p, before_n = of("person", previous), of("number", previous)
    ante_p, ante_n = np.where(before_p > 0, before_p, np.where(of("noun", previous) > 0, 3, 0)), np.where(before_n > 0, before_n, of("noun", previous))
    vp, vn = of("vp", in_segment), of("vn", in_segment)
    known = (vp > 0) & (ante_p > 0) & (vn > 0) & (ante_n > 0)
    relative = np.where(word("relative") & (s.i > 0) & known, (vn != ante_n).astype(np.int64) + (vp != ante_p), 0)

    indicative = word("indicative")
    here = lambda x: np.where((x >= 0) & (_take(segment, x, -1) == segment), x, -1)
    conditional = indicative & (here(s.last(word("conditional"))) > here(s.last(indicative)))

    fit, stop = s.next(word("present") & (word("vp") > 0)), s.next(mark | is_and)
    near = (fit >= 0) & (fit - at <= A.NEAR)
    near_stopped = near & ((stop < 0) | (stop > fit))
    fit_person = of("vp", fit)

    def by_sentence(where: np.ndarray, first: bool) -> np.ndarray:
        """Index of each sentence's first or last token that fits."""
        rows, out = np.flatnonzero(where), np.full(len(s.sizes), -1)
        rows = rows[::-1] if first else rows
        out[s.sentence[rows]] = rows
        return out

    pair = (of("is_and", previous, False)) & (person > 0) & (of("person", two_before) > 0)
    least = np.full(len(s.sizes), 9)
    np.minimum.at(least, s.sentence[pair], np.minimum(person, of("person", two_before))[pair])
    last_pair = by_sentence(pair, False)
    pair_person = np.where(_take(near, last_pair, False), _take(fit_person, last_pair, 0), 0)
    bare = word("bare") & ~of("pointing", previous, False) & near_stopped
    first_bare = by_sentence(bare, True)

    called = np.where((s.i >= 1) & (s.i <= 3), np.where(noun > 0, noun, number), 0)
    addressed, command = _take(called, by_sentence(called > 0, True), 0), by_sentence(word("command"), True)
    plural = of("plural", command, False)
    mismatch = ((addressed == 2) & ~plural) | ((addressed == 1) & plural)
    vocative = has((s.i == 0) & word("vocative")) & (command >= 0) & ~of("present", command, False) & mismatch
    tense = word("tense")
    now, past = has(tense == 1), has(tense == 2)

    return {
        "subject_verb": total((person > 0) & differs(in_clause, person, number)),
        "clitic_consistency": (total(word("bears")) >= 2).astype(np.int64),
        "ezafe": total(ezafe),
        "tense_consistency": _tense_sequence(s, word),
        "object_verb_ergative": total(ergative),
        "negative_concord": (has(word("negative")) & ~has(word("negation"))).astype(np.int64),
        "orthography": total(word("misspelt")),
        "conditional": total(conditional),
        "quantifier_noun": total(word("quantifier") & (of("vn", in_clause) == 1)),
        "relative_clause": total(relative),
        "vocative_imperative": vocative.astype(np.int64),
        "adverb_verb_tense": (has(word("past_adverb")) & now).astype(np.int64) + (has(word("present_adverb")) & past & ~now),
        "compound_subject": ((pair_person > 0) & (pair_person != least)).astype(np.int64),
        "bare_noun": np.isin(np.where(first_bare >= 0, _take(fit_person, first_bare, 0), 0), (1, 2)).astype(np.int64),
    }


def _tense_sequence(s: Sentences, word) -> np.ndarray:
    """Coordinated clauses of which a past one follows a present one. Clauses without a verb are passed over, if any has one."""
    if not s.n:
        return np.zeros(len(s.sizes), np.int64)
    part = _clauses(s, word, False)
    begins = np.flatnonzero((s.i == 0) | (np.diff(part, prepend=-1) != 0))
    sentence = s.sentence[begins]
    verb, now, past = (np.logical_or.reduceat(x, begins) for x in (word("clause_verb"), word("tense") == 1, word("tense") == 2))
    any_verb = np.bincount(sentence, weights=verb, minlength=len(s.sizes)) > 0
    kept = verb | ~any_verb[sentence]
    sentence, tense = sentence[kept], np.select([now, past], [1, 2], 0)[kept]
    found = (sentence[1:] == sentence[:-1]) & (tense[:-1] == 1) & (tense[1:] == 2)
    return np.bincount(sentence[1:][found], minlength=len(s.sizes)).astype(np.int64)


class _Run:
    prepare = Words

    def __call__(self, keys: pa.Table, words: Words, s: Sentences) -> pa.Table:
        known: dict[str, np.ndarray] = {}

        def word(name: str) -> np.ndarray:
            if name not in known:
                known[name] = getattr(words, name)[s.code]
            return known[name]

        for name, found in checks(word, s).items():
            keys = keys.append_column(name, pa.array(found.astype(np.int64)))
        return keys


def check_sentences(sentences: DataFrame, text: str, *key: str, known: DataFrame | None = None) -> DataFrame:
    """key, and the violations of each of CHECKS, as agreement.check_sentences() gives them."""

    def flags(distinct: DataFrame) -> DataFrame:
        one = lambda c: F.col(c).cast("int").cast("string")
        return A.word_flags(distinct, known).select("token", F.concat(one("clitic"), one("misspelt")).alias("f"))

    schema = StructType([*(sentences.schema[k] for k in key), *(StructField(c, LongType()) for c in A.CHECKS)])
    return blocks.in_blocks(sentences, text, *key, features=flags, run=_Run(), schema=schema)
