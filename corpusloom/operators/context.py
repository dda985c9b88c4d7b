"""Features of tokens as their neighbours make them, on arrays of a block's tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.operators import blocks
from corpusloom.operators import morphology as M
from corpusloom.operators.blocks import Sentences


class Tags:
    """Part of speech, case and number of a block's distinct tokens: their tags as they are, behind a preposition and behind a numeral."""

    def __init__(self, words: list[str], told: list[str]):
        number = {f: n for n, f in enumerate(dict.fromkeys(told))}
        of = np.fromiter((number[f] for f in told), np.int64, len(told))
        parts = [f.split("/") for f in number]
        oblique = [[p, "obl" if p in ("NOUN", "PRON", "ADJ") and not c else c, n] for p, c, n in parts]
        forced = [[p, c, "sg" if p == "NOUN" and n == "pl" else n] for p, c, n in parts]
        self.tags = pa.array(["/".join(p) for some in (parts, oblique, forced) for p in some], pa.string())
        self.tag, self.kinds = of, len(parts)
        self.behind = np.array([{"ADP": 1, "NUM": 2}.get(p, 0) for p, _, _ in parts], np.int64)[of]


class _Run:
    prepare = Tags

    def __call__(self, keys: pa.Table, tags: Tags, s: Sentences) -> pa.Table:
        before = blocks._take(tags.behind[s.code], s.shifted(-1), 0)
        words = tags.tags.take(pa.array(tags.tag[s.code] + before * tags.kinds))
        offsets = pa.array(np.concatenate([[0], np.cumsum(s.sizes)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")
        return keys.append_column("tags", joined).filter(pa.array(s.sizes > 0))


def tags_in_context(sentences: DataFrame, text: str, *key: str) -> DataFrame:
    """key, tags: part of speech/case/number of all tokens of a sentence that has any, as morphology.analyzed() gives them."""
    tag = F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in ("pos", "case", "number"))).alias("f")
    schema = StructType([*(sentences.schema[k] for k in key), StructField("tags", StringType())])
    return blocks.in_blocks(sentences, text, *key, features=lambda d: M.token_features(d).select("token", tag), run=_Run(), schema=schema)
