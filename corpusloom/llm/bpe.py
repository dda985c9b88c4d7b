"""Byte-pair encoding and decoding as streaming transducers with constant memory.

Encoding: whether a boundary stays can depend on bytes further right only through a chain of merges of rising rank, each of
which reaches left over one token. The longest such chain of the merge list, in bytes, is its sufficient lookahead: all
boundaries further left than that from the end of what was read are final. So the encoder keeps a buffer of a few times the
lookahead, emits the tokens that are stable and goes on with the rest. Decoding: bytes of the ids pass through an
incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import caches
from corpusloom.llm.common import pieces, text_or_empty
from corpusloom.llm.tokens import CachedEncoder, space_chunks, space_text

#: Fixed value: the pre-tokenization pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class StreamingBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.lookahead = self._lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pattern = regex.compile(PATTERN)

    def _lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        """Bytes by which an unknown right end can change boundaries to its left: ranks downwards, the longest chain of merges
        (u, v) in which v may begin with the left part of the merge before."""
        left, best, longest = {z: x for x, _, z in merges}, {}, 0
        for x, v, z in reversed(merges):
            gain = len(self.bytes[x]) + best.get(x, 0)  # how far a change at this merge goes on to the left, by later merges
            longest = max(longest, len(self.bytes[z]) + gain)
            while v is not None:
                best[v] = max(best.get(v, 0), gain)
                v = left.get(v)
        return longest

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a bounded buffer: lowest rank first, leftmost first."""
        merges = self.merges
        if len(ids) <= 24:
            while len(ids) > 1:
                found = min(((m[0], i, m[1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))), default=None)
                if found is None:
                    break
                ids[found[1] : found[1] + 2] = [found[2]]
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(r, i, z, a, b) for r, z, i, a, b in heap]
        heapq.heapify(heap)
        n = len(ids)
        while heap:
            _, i, z, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((z, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], z, ids[after[i]]))
            if (k := before[i]) >= 0 and (m := merges.get((ids[k], z))):
                heapq.heappush(heap, (m[0], k, m[1], ids[k], z))
        return [x for x in ids if x >= 0]

    def stream(self, data: Iterable[bytes], buffer: int = 0) -> Iterator[int]:
        """Ids of one pre-token that comes in parts. Holds at most buffer bytes (4 times the lookahead by default) and one part."""
        buffer, held = buffer or 4 * self.lookahead, bytearray()
        for part in data:
            held += part
            while len(held) > buffer:
                ids = self.merge([self.first[b] for b in held[:buffer]])
                end, at = buffer - self.lookahead, 0
                for i in ids:
                    if (then := at + len(self.bytes[i])) > end:
                        break
                    yield i
                    at = then
                del held[:at]
        yield from self.merge([self.first[b] for b in held])

    def _pretoken(self, text: str) -> Iterator[int]:
        step = 2 * self.lookahead
        return self.stream(text[i : i + step].encode() for i in range(0, len(text), step))

    def encode(self, text: str) -> Iterator[int]:
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            for t in self.pattern.finditer(text[at : m.start()]):
                yield from self._pretoken(t[0])
            yield self.special[m[0]]
            at = m.end()
        for t in self.pattern.finditer(text[at:] if at else text):
            yield from self._pretoken(t[0])

    def decode(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of ids that come in parts; invalid bytes become U+FFFD."""
        state, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes
        for part in ids:
            yield state.decode(b"".join([table.get(i, b"") for i in part.tolist()]))
        yield state.decode(b"", True)


_WORKER: dict[str, tuple[StreamingBpe, CachedEncoder]] = {}


def worker(path: str) -> tuple[StreamingBpe, CachedEncoder]:
    if path not in _WORKER:
        bpe = StreamingBpe(path)
        encode = CachedEncoder(lambda part: [np.fromiter(bpe.encode(space_text(c)), dtype="<u4").tobytes() for c in part], space_chunks)
        caches.register(f"stream {path}", encode.empty)
        _WORKER[path] = bpe, encode
    caches.only(f"stream {path}")
    return _WORKER[path]


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", part: int = 1 << 16) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256 (little-endian uint32), decoded_sha256 (UTF-8).

    Null counts as empty: no ids. Rows are independent of each other, so repeated rows and ids are all reported; an empty
    table gives no rows; other columns are not read. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = worker(tokenizer)
        for b in pieces(batches):
            cols: list[list] = [[], [], []]
            flat, at = encode(b.column("text"))
            for start, then in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids, text = flat[start:then], hashlib.sha256()
                for s in bpe.decode(ids[i : i + part] for i in range(0, len(ids), part)):
                    text.update(s.encode())
                for c, v in zip(cols, (len(ids), hashlib.sha256(ids).hexdigest(), text.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
