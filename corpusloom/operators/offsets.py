"""Normalization that remembers where each character comes from, on Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import profile as P

SCHEMA = "struct<text:string,offsets:array<int>>"
_HEH = re.compile(f"(?<=[{P.HEH_CONTEXT}])ه")
#: What is replaced, and by what, in this order; what remains of a match has the places of its first characters.
_SPACES = ((re.compile(r"[ \t]+"), " "), (re.compile(r"\r\n?"), "\n"), (re.compile(r"\n{3,}"), "\n\n"))


def _compose(text: str) -> tuple[str, list[int]]:
    """NFC, and for each of its characters the first one that it is composed of. Composition never goes over a character that begins
    anew: one of class 0 that its neighbour to the left does not take in."""
    if unicodedata.is_normalized("NFC", text):
        return text, list(range(len(text)))
    out, places, start = [], [], 0
    while start < len(text):
        end = start + 1
        part = unicodedata.normalize("NFC", text[start:end])
        while end < len(text) and (unicodedata.combining(text[end]) or len(unicodedata.normalize("NFC", text[start : end + 1])) <= len(part)):
            end += 1
            part = unicodedata.normalize("NFC", text[start:end])
        out.append(part)
        places += [start + min(i, end - start - 1) for i in range(len(part))]
        start = end
    return "".join(out), places


def normalize_with_offsets(text: str, preserve_zwnj: bool = True, remove_diacritics: bool = False) -> tuple[str, list[int]]:
    """The normalized text, and for each of its characters its place in the text given."""
    text, places = _compose(text)
    gone = set(P.TATWEEL + P.ZERO_WIDTH + ("" if preserve_zwnj else P.ZWNJ) + (P.DIACRITICS if remove_diacritics else ""))
    kept = [i for i, c in enumerate(text) if c not in gone]
    text, places = "".join([P.CHAR_MAP.get(text[i], text[i]) for i in kept]), [places[i] for i in kept]
    text = _HEH.sub("ە", text)
    for pattern, to in _SPACES:
        cut = [(m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() > len(to)]
        drop = {i for start, end in cut for i in range(start + len(to), end)}
        text, places = pattern.sub(to, text), [x for i, x in enumerate(places) if i not in drop]
    left = len(text) - len(text.lstrip())
    text = text.strip()
    return text, places[left : left + len(text)]


def normalized_with_offsets(text: str | Column) -> Column:
    """struct<text, offsets> of normalize_with_offsets(); a null text gives nulls."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else normalize_with_offsets(t) for t in texts]
        return pd.DataFrame(rows, columns=["text", "offsets"])

    return F.pandas_udf(run, SCHEMA)(text)
