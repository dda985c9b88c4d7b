"""Encoding whole texts with a public tokenizer: chunks that are encoded independently are encoded once and remembered.

The texts of a batch are cut into chunks by Arrow, and only a batch's distinct chunks are looked up; what they stand for goes
back to their places by one take.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.llm import caches

#: Bytes that a generation of remembered chunks may hold, what a chunk counts besides its characters and ids, and the characters of
#: chunks that are remembered at all.
CACHE_BYTES, ENTRY_BYTES, CACHED_LENGTH = 60_000_000, 190, 64
_CUT = re.compile(r"(?<=\S)(?= )")


def _python_chunks(text: str) -> list[str]:
    """For byte-level tokenizers: cuts before each space that follows no white space, where a new pre-token always begins. The first
    chunk is marked by a NUL before it, the others come without their space: see space_text()."""
    if "\0" in text:
        return ["\0" + text]
    first, *rest = _CUT.split(text)
    return ["\0" + first, *(c[1:] for c in rest)]


def space_chunks(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text as _python_chunks() gives them; texts without white space before a space are cut at their spaces."""
    cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", texts.type), texts, pa.scalar("", texts.type)), " ")
    rare = np.flatnonzero(pc.match_substring_regex(texts, r"\x00|^ |[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] ").to_numpy(zero_copy_only=False))
    if not len(rare):
        return cut
    own = pa.array([_python_chunks(t) for t in texts.take(pa.array(rare)).to_pylist()], cut.type)
    order = np.arange(len(texts))
    order[rare] = len(texts) + np.arange(len(rare))
    return pa.concat_arrays([cut, own]).take(pa.array(order))


def word_chunks(texts: pa.Array) -> pa.ListArray:
    """For tokenizers that drop white space: what lies between ASCII white space, which may be empty."""
    return pc.ascii_split_whitespace(texts)


def space_text(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == "\0" else " " + chunk


class CachedEncoder:
    """Ids of texts. encode: from a list of distinct chunks to a list of their ids as bytes (little-endian uint32); cut: the chunks
    of each text; parts: for a list of chunks, the chunks that each is made of (None: of itself alone).

    Chunks are remembered in two generations of bounded size: when the younger is full, it replaces the older, so that
    frequent chunks stay."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cut: Callable[[pa.Array], pa.ListArray], parts: Callable[[list[str]], list[list[str] | None]] | None = None):
        self.encode, self.cut, self.parts = encode, cut, parts
        self.empty()

    def empty(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0

    def _old(self, chunks: list[str]) -> list[str]:
        """Brings chunks of the older generation back; returns those that are new."""
        older, cache = self.older, self.cache
        if not older:
            return chunks
        found = list(map(older.get, chunks))
        cache.update((c, x) for c, x in zip(chunks, found, strict=True) if x is not None)
        return [c for c, x in zip(chunks, found, strict=True) if x is None]

    def _learn(self, chunks: list[str]) -> None:
        cache = self.cache
        chunks = self._old(chunks)
        cut = dict(zip(chunks, self.parts(chunks), strict=True)) if self.parts else dict.fromkeys(chunks)
        new = {c for c, p in cut.items() if p is None}
        pieces = {x for p in cut.values() if p for x in p}
        new.update(self._old([x for x in pieces.difference(new) if x not in cache]))
        new = list(new)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            cache.update(zip(some, self.encode(some), strict=True))
        for c, p in cut.items():
            if p:
                cache[c] = b"".join([cache[x] for x in p])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more at the end)."""
        gc.disable()  # short lists by the million, none of them in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.size > CACHE_BYTES:
            self.older, self.cache, self.size = self.cache, {}, 0
        cache, lists = self.cache, self.cut(texts)
        kinds = lists.flatten().dictionary_encode()
        names, before = kinds.dictionary.to_numpy(zero_copy_only=False).tolist(), len(cache)  # to_pylist() takes ten times as long
        if unknown := [c for c in names if c not in cache]:
            self._learn(unknown)
        found = [cache[c] for c in names]
        if unknown:
            for c in unknown:
                if len(c) > CACHED_LENGTH:
                    del cache[c]
            self.size += sum(len(c) + ENTRY_BYTES for c in unknown) + ENTRY_BYTES * max(len(cache) - before - len(unknown), 0)
        placed = pa.array(found, pa.binary()).take(kinds.indices)
        at = np.frombuffer(placed.buffers()[1], dtype=np.int32, count=len(placed) + 1, offset=4 * placed.offset).astype(np.int64) // 4
        ids = np.frombuffer(placed.buffers()[2], dtype="<u4", count=int(at[-1])) if at[-1] else np.zeros(0, dtype="<u4")
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, at[starts]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id after each text."""
    return np.insert(ids, at[1:], end), at + np.arange(len(at))


def as_binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """The ids of each text as a binary value."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])


_ENCODERS: dict[str, CachedEncoder] = {}
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
_SIMPLE = re.compile(f"[^İɐ-\U0010ffff]*")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The pre-tokenization patterns of the two kinds of tokenizer, for characters below U+0250. U+001D parts chunks.
_WORD = re.compile(rf"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9²³¹¼½¾]|[^\s{_LETTERS}0-9²³¹¼½¾]+|\x1d")
_SPACE = re.compile(rf"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[0-9²³¹¼½¾]+| ?[^\s{_LETTERS}0-9²³¹¼½¾]+|[^\S\x1d]+(?!\S)|[^\S\x1d]+|\x1d")


def _odd(text: str) -> bool:
    """Characters whose classes, composition or lower case are left to the tokenizer, and what may hold special tokens."""
    return not _SIMPLE.fullmatch(text) or "<|" in text or "\0" in text[1:] or bool(_SEPARATORS.search(text))


def _parts(words: bool) -> Callable[[list[str]], list[list[str] | None]]:
    """The pre-tokens of each chunk, as chunks: words in lower case, for byte-level tokenizers marked as those of space_chunks()."""

    def run(chunks: list[str]) -> list[list[str] | None]:
        out: list[list[str] | None] = [None] * len(chunks)
        use = [i for i, c in enumerate(chunks) if len(c) > 1 and not c.isalpha()]
        whole = "".join([chunks[i] for i in use])
        if _odd(whole.replace("\0", "")) or whole.count("\0") != sum(chunks[i][0] == "\0" for i in use):
            use = [i for i in use if not _odd(chunks[i])]
        joined = "\x1d".join([chunks[i].lower() if words else space_text(chunks[i]) for i in use])
        own: list[str] = []
        todo = iter(use)
        for p in (_WORD if words else _SPACE).findall(joined + "\x1d") if use else ():
            if p == "\x1d":
                i = next(todo)
                out[i] = own if own and own != [chunks[i]] else None
                own = []
            elif words:
                own.append(p)
            else:
                own.append(p[1:] if len(p) > 1 and p[0] == " " and not p.isspace() else "\0" + p)
        return out

    return run


def _split(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, at = ids.tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *at], at, strict=False)]


def _library(tok, words: bool) -> Callable[[list[str]], list[bytes]]:
    """Ids of chunks by the tokenizers library. Plain pre-tokens go to it many at a time, as one text: in words, the ids of a
    pre-token end with the suffix of a word; else each begins with its space, or stands on a line of its own. All others are
    encoded alone."""
    marks = np.zeros(tok.get_vocab_size(with_added_tokens=True), dtype=bool)
    marks[[i for t, i in tok.get_vocab(with_added_tokens=True).items() if (t.endswith("</w>") if words else t.startswith("Ġ"))]] = True
    line = None if words else tok.token_to_id("Ċ")

    def together(part: list[str], separator: str) -> list[bytes] | None:
        """None where the marks don't tell the chunks apart."""
        text = separator.join(part) if separator == "\n" else separator.join(["", *part])
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        if words:
            found = _split(ids, np.flatnonzero(marks[ids]) + 1)
        elif separator == " ":
            found = _split(ids, np.append(np.flatnonzero(marks[ids])[1:], len(ids)))
        else:
            found = _split(ids, np.append(np.flatnonzero(ids == line) + 1, len(ids)))
            found = [x[:-4] for x in found[:-1]] + found[-1:]
        return found if len(found) == len(part) else None

    def alone(part: list[str]) -> list[bytes]:
        texts = part if words else list(map(space_text, part))
        return [np.array(x.ids, dtype="<u4").tobytes() for x in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def run(part: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        simple = [c for c in part if (c if words or c[:1] != "\0" else c[1:]).isalpha() and _SIMPLE.fullmatch(c)]
        lines = [] if words else [c for c in simple if c[0] == "\0"]
        for kind, separator in ((simple if words else [c for c in simple if c[0] != "\0"], " "), (lines, "\n")):
            if kind and (found := together([c.lstrip("\0") for c in kind], separator)) is not None:
                out.update(zip(kind, found, strict=True))
        rest = [c for c in part if c not in out]
        out.update(zip(rest, alone(rest), strict=True))
        return [out[c] for c in part]

    return run


def public_encoder(path: str, cut: Callable[[pa.Array], pa.ListArray]) -> CachedEncoder:
    """One encoder a worker and tokenizer file; the tokenizers library encodes the chunks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        words = cut is word_chunks
        _ENCODERS[path] = CachedEncoder(_library(tok, words), cut, _parts(words))
        caches.register(path, _ENCODERS[path].empty)
    caches.only(path)
    return _ENCODERS[path]
