"""Augmentation of sentences: swaps of neighbours and deletions of words, chosen by md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let, words


def _draw(name: str, seed: int, key: Column, i: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(name), F.lit(str(seed)), key, i.cast("string"))), 1, 8), 16, 10).cast("long")


def random_deletion(text: Column, key: Column, p: float = 0.1, seed: int = 42) -> Column:
    """Each word goes with probability p; if all would, the first stays."""
    most = int(p * (1 << 32))

    def cut(w: Column) -> Column:
        kept = F.filter(w, lambda x, i: _draw("delete", seed, key, i) >= most)
        return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.slice(w, 1, 1)), " ")

    return let(words(text), cut)


def random_swap(text: Column, key: Column, seed: int = 42, swaps: int = 1) -> Column:
    """`swaps` times, one after the other, a pair of neighbouring words changes places; a single word stays as it is."""

    def swap(w: Column, k: Column) -> Column:
        i = (_draw("swap", seed, key, k) % F.greatest(F.size(w) - 1, F.lit(1))).cast("int")
        moved = F.transform(w, lambda x, j: F.when(j == i, F.get(w, i + 1)).when(j == i + 1, F.get(w, i)).otherwise(x))
        return F.when(F.size(w) > 1, moved).otherwise(w)

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(max(swaps, 1) - 1)), words(text), swap), " ") if swaps > 0 else F.array_join(words(text), " ")
