"""Streams against tables, restarts, pages behind tokens, affixes on both sides, and the table function."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexicon as L
from corpusloom.operators import sql_functions
from corpusloom.sources import pages as G
from corpusloom.sources import readers as R
from corpusloom.streaming import lines as W

GOOD = "ئەم ڕستەیە بۆ تاقیکردنەوەی پڕۆگرامەکەی من دەچێت ژمارە"


def _lines(i: int) -> str:
    return "\n".join(f"{GOOD}   {'ئابپتجچحخد'[(i + k) % 10]}." for k in range(4)) + f"\nshort\n\n{GOOD} ،ی ."


def test_stream_in_two_runs_is_the_table(spark, tmp_path):
    """Files that come in two runs, one of them cut off before it is done, give what a table of all gives."""
    source = tmp_path / "in"
    source.mkdir()
    for i in range(5):
        (source / f"{i}.txt").write_text(_lines(i), encoding="utf-8")
    arriving = W.arriving_lines(spark, str(source), files=1)
    query = W.write_stream(W.first_lines(W.normalized(arriving)).select("text"), f"{tmp_path}/out", f"{tmp_path}/state")
    while query.lastProgress is None and query.isActive:
        pass
    query.stop()  # cut off: the next run goes on from what is done
    for i in range(5, 9):
        (source / f"{i}.txt").write_text(_lines(i), encoding="utf-8")
    for _ in range(2):  # the second finds nothing new
        W.collect(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/state", files=2)
    got = sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect())
    table = spark.read.text(str(source)).select(F.col("value").alias("text"))
    want = sorted(r.text for r in W.first_lines(W.normalized(table)).select("text").collect())
    assert got == want and len(got) == len(set(got)) == 11


def test_windows_of_streams(spark, tmp_path):
    rows = spark.range(50).select((F.timestamp_seconds(F.col("id") * 5000)).alias("at"), (F.col("id") % 3).cast("string").alias("kind"))
    rows.write.parquet(f"{tmp_path}/events")
    stream = W.counts_by_window(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events"), "at", "kind")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("windows").collect()) == sorted(W.counts_by_window(rows, "at", "kind").collect())


@pytest.fixture()
def recorded(tmp_path):
    """Responses in files that are named by their tokens."""
    tokens = ["first", "b", "c", "d"]
    for k, token in enumerate(tokens):
        found = {"query": {"allpages": [{"pageid": 10 * k + i, "title": f"t{i}"} for i in range(3)] + [{"pageid": 1, "title": "again"}]}}
        if k + 1 < len(tokens):
            found["continue"] = {"apcontinue": tokens[k + 1]}
        (tmp_path / f"{token}.json").write_text(json.dumps(found))
    return f"{tmp_path}/{{token}}.json"


def test_pages(spark, recorded):
    """All pages by following tokens; a part of them, and on from where they end; a page that comes twice counts once."""
    spark.dataSource.register(G.Pages)
    read = lambda **options: spark.read.format("pages").option("path", recorded).options(**options).load()
    rows = read()
    assert [(r.token, r.pageid) for r in rows.where("pos < 2").orderBy("pageid").collect()] == [("first", 0), ("first", 1), ("b", 10), ("b", 11), ("c", 20), ("c", 21), ("d", 30), ("d", 31)]
    assert rows.count() == 16 and rows.dropDuplicates(["pageid"]).count() == 12 and G.resume_token(rows) is None
    some = read(most=2)
    then = G.resume_token(some)
    assert then == "c" and sorted(some.unionByName(read(start=then)).collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        G.resume_token(some.unionByName(some.withColumn("following", F.lit("z"))))
    assert G.PagesReader({"path": "http://host/x?from={token}"}).url("a/b c") == "http://host/x?from=a%2Fb%20c"


def test_backoff():
    waits = []

    def failing(*codes):
        left = list(codes)

        def call():
            if left:
                code = left.pop(0)
                raise urllib.error.HTTPError("u", code, "", {}, io.BytesIO()) if code else urllib.error.URLError("down")
            return b"done"

        return call

    assert G.with_backoff(failing(429, 0, 503), wait=waits.append, draw=lambda: 0.5) == b"done" and waits == [1.5, 2.5, 4.5]
    with pytest.raises(urllib.error.HTTPError):
        G.with_backoff(failing(404), wait=waits.append)
    with pytest.raises(urllib.error.URLError):
        G.with_backoff(failing(0, 0, 0), attempts=3, wait=waits.append)
    assert len(waits) == 3 + 2


AFFIXES = ["SFX A Y 2", "SFX A 0 s .", "SFX A e ing e", "PFX A Y 2", "PFX A 0 re [^x]", "PFX A a un .", "SFX B Y 1", "SFX B 0 ed .", "PFX B N 1", "PFX B 0 un .", "SFX C Y 1", "SFX C 0 ًَ .", "TRY abc", "IGNORE x", "COMPOUNDFLAG Z", "REP 2", "REP ph f", "REP a_b ab"]


def test_affixes_on_both_sides(spark):
    lines = spark.createDataFrame(list(enumerate(AFFIXES)), "line_no long, text string")
    affixes, headers = R.parse_affixes(lines), R.parse_affix_headers(lines)
    dictionary = spark.createDataFrame([("make", "A", ""), ("act", "AB", ""), ("xo", "A", ""), ("age", "B", ""), ("do", "C", ""), ("re", "A", "")], "surface string, flags string, pos string")
    words = spark.createDataFrame([(w,) for w in ("remaking", "remakes", "reacts", "unact", "uncts", "rexos", "unaged", "res", "", "reres", None)], "word string")
    got = {(r.word, r.base, r.prefix, r.suffix) for r in L.decompose_both(words, dictionary, affixes, headers).collect()}
    # "unct" comes from "act" with a prefix that takes the place of its first letter; flag B has no crossing; "xo" is ruled out.
    assert got == {("remaking", "make", "re", "ing"), ("remakes", "make", "re", "s"), ("reacts", "act", "re", "s"), ("uncts", "act", "un", "s"), ("reres", "re", "re", "s")}
    made = {(r.base, r.form) for r in L.forms(dictionary, affixes, headers).collect()}
    assert {f for b, f in made if b == "make"} == {"make", "makes", "making", "remake", "remakes", "remaking"}
    assert {f for b, f in made if b == "do"} == {"do"} and {f for b, f in made if b == "xo"} == {"xo", "xos"} and {f for b, f in made if b == "age"} == {"age", "ageed", "unage"}
    assert {w for w, *_ in got} <= {f for _, f in made}
    assert [(r.option, r["values"]) for r in R.parse_affix_options(lines).orderBy("option").collect()] == [("COMPOUNDFLAG", ["Z"]), ("IGNORE", ["x"]), ("TRY", ["abc"])]
    assert [tuple(r) for r in R.parse_replacements(lines).collect()] == [(0, "ph", "f"), (1, "a_b", "ab".replace("_", " "))]
    assert {(r.kind, r.flag): r.cross for r in headers.collect()} == {("SFX", "A"): True, ("PFX", "A"): True, ("SFX", "B"): True, ("PFX", "B"): False, ("SFX", "C"): True}


def test_sentences_in_sql(spark):
    sql_functions.register(spark)
    docs = spark.createDataFrame([(0, "One. Two!  Three"), (1, None), (2, ""), (3, " .  ؟ x"), (4, "a.b? c\x85")], "id long, text string")
    got = [tuple(r) for r in spark.sql("select d.id, s.pos, s.sentence from {docs} d, lateral split_sentences(d.text) s order by 1, 2", docs=docs).collect()]
    want = [tuple(r) for r in docs.select("id", F.posexplode(T.sentences(F.col("text")))).orderBy("id", "pos").collect()]
    assert got == want
    one = spark.sql("select m2_edits('a b', 'a c') as m, span_edits('a b', 'a c') as s, corrupt_sentence('x', 'k') as c").first()
    assert one.m[0].correction == "c" and one.s[0].tgt == "c" and one.c == "x"
