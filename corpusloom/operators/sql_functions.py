"""Functions for SQL: a table function of sentences, and functions of pairs on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from corpusloom.operators import evaluation as E
from corpusloom.operators import generation as G

_END = re.compile(r"(?<=[.!?؟۔])[ \t\n\x0b\f\r]+")


@udtf(returnType="pos: int, sentence: string")
class SplitSentences:
    """split_sentences(text): the sentences of a text, as functions.text.sentences() has them; none of a null."""

    def eval(self, text: str) -> Iterator[tuple]:
        pos = 0
        for s in _END.split(text or ""):
            if s := s.strip(" \t\n\x0b\f\r\x85\xa0"):
                yield pos, s
                pos += 1


def register(spark: SparkSession) -> None:
    """split_sentences(text) for LATERAL; corrupt_sentence(text, key), m2_edits(source, target), span_edits(source, target)."""

    @pandas_udf("string")
    def corrupt_sentence(text: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([G.corrupt(t or "", str(k))[0] for t, k in zip(text, key, strict=True)])

    spark.udtf.register("split_sentences", SplitSentences)
    spark.udf.register("corrupt_sentence", corrupt_sentence)
    spark.udf.register("m2_edits", pandas_udf(E._m2_edits, "array<struct<start:int,end:int,correction:string>>"))
    spark.udf.register("span_edits", pandas_udf(E._span_edits, E.SPAN))
