"""The flow from lines to a corpus, offsets, sources and sinks, scores by type and raters, on small golden examples."""

import json
import random
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import filters as S
from corpusloom.functions import text as T
from corpusloom.operators import dedup as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import flow as W
from corpusloom.operators import sampling as M
from corpusloom.operators.offsets import normalize_with_offsets
from corpusloom.sources import readers as R
from corpusloom.sources import writers

GOOD = "ئەم ڕستەیە بۆ تاقیکردنەوەی پڕۆگرامەکەیە."


def test_flow(spark):
    lines = [f"history\t{GOOD}", f"law\t{GOOD}", f"law\t{GOOD[:-1]} (زیادە).", "law\tکورت.", "only latin words in this line here.", f"media\t{GOOD[:-1]}", None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    got = {r.i: (r.category, r.reason, r.sentence) for r in W.normalization_flow(df, "line", "i", categories=True).collect()}
    assert got[0] == ("history", None, GOOD) and got[1][1] == "duplicate" and got[5][1] == "fragment"
    assert got[3][1] in ("too_short", "short") and got[4][0] is None and got[4][1] and got[7][1] == "empty_after_strip"
    assert sum(r[1] is None for r in got.values()) == sum(r.n for r in W.drop_reasons(W.normalization_flow(df, "line", "i", categories=True)).collect() if r.reason == "kept")


def test_flow_runs_its_steps_once(spark):
    """What comes after the parts reads them as a table: no step is in the plan again, neither for duplicates nor for what is left over."""
    df = spark.createDataFrame([(0, GOOD), (1, GOOD), (2, None), (3, None), (4, "")], "i long, line string")
    rows = W.normalization_flow(df, "line", "i")
    assert "EvalPython" not in rows._jdf.queryExecution().toString()
    got = [(r.i, r.part, r.reason) for r in rows.orderBy("i").collect()]
    assert got[:2] == [(0, 0, None), (1, 0, "duplicate")] and got[-1] == (4, 0, "empty_after_strip")


@pytest.mark.parametrize("characters", ["[؀-ۿﭐ-﷿]", "[a-zA-Z]", r"\p{Nd}", "ە"])
def test_characters_of_a_class_by_runs(spark, characters):
    """Runs are removed at once: there are as many characters as single matches."""
    texts = ["", "abc دەە 12٣ x", "ەەەە", "a1b2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(S.count(F.col("t"), characters).alias("n"), F.regexp_count("t", F.lit(characters)).alias("m")).collect()
    assert all(r.n == r.m for r in got)


def test_near_duplicates_by_file(spark):
    """Within a file the first of near copies stays; the same line in another file is not touched."""
    near = GOOD.replace("بۆ", "بە")
    df = spark.createDataFrame([("a", 0, GOOD), ("a", 1, near), ("b", 0, near), ("b", 1, GOOD + " زۆر جیاوازە لەوەی تر و درێژترە.")], "file string, i long, line string")
    got = {(r.file, r.i): r.reason for r in W.sanitized(df, "line", "file", "i", near=0.7, by="file").collect()}
    assert got == {("a", 0): None, ("a", 1): "near_duplicate", ("b", 0): None, ("b", 1): None}


PLACES = {"": [], "  a \t b\r\n\r\n\r\n\r\nc  ": [2, 3, 6, 7, 9, 15], "e\u0301x": [0, 2], "ه هه\u200bه": [0, 1, 2, 3, 5], "ـabـ ": [1, 2], "\u0301a": [0, 1], "كتاب ة": [0, 1, 2, 3, 4, 5], "a\u0323\u0307 \u1100\u1161\u11a8": [0, 1, 3, 4]}


@pytest.mark.parametrize("text", PLACES)
def test_offsets(spark, text):
    out, places = normalize_with_offsets(text)
    want = spark.createDataFrame([(unicodedata.normalize("NFC", text),)], "t string").select(T.normalize(F.col("t"))).first()[0]
    assert out == want and places == PLACES[text] and len(places) == len(out)


def test_malformed_diacritics(spark):
    cases = {"بَ": False, "aَ": True, "بََ": True, "بَّ": False, "َ": True, "بَّّ": True, "بَُ": False}
    got = {r.t: r.m for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.malformed_diacritics(F.col("t")).alias("m")).collect()}
    assert got == cases


def test_parentheticals(spark):
    one = re.compile(r"\([^)]+\)(?=[\s.،؟!۔:;]|$)")
    texts = ["a (b).", "(a)(b)(c)(d)(e)(f)(g).", "x (a)y (b)", "(((a))) b", "()", "a (b) (c)x", "((a)(b))(c)."]

    def brute(t):
        while (u := one.sub("", t)) != t:
            t = u
        return re.sub(" {2,}", " ", t).strip()

    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(T.strip_parentheticals(F.col("t"))).collect()]
    assert got == list(map(brute, texts))


def test_row_numbers(spark):
    """Numbers are right with many ranges and adaptive execution, whatever the groups' sizes, with ties and nulls."""
    r = random.Random(3)
    rows = [(i, r.choice("aaaaaab"), r.choice([None, *"xyz"])) for i in range(5000)]
    df = spark.createDataFrame(rows, "i long, g string, k string")
    old, M.RANGE_ROWS = M.RANGE_ROWS, 100
    try:
        got = {x.i: x for x in M.numbered(df, ["k", "i"]).collect()}
        grouped = {x.i: x for x in M.numbered(df, ["k", "i"], ["g"]).collect()}
    finally:
        M.RANGE_ROWS = old
    key = lambda x: (x[2] is not None, x[2] or "", x[0])
    for n, x in enumerate(sorted(rows, key=key), 1):
        assert (got[x[0]]._rn, got[x[0]]._n) == (n, 5000)
    for g in "ab":
        own = sorted((x for x in rows if x[1] == g), key=key)
        assert [(grouped[x[0]]._rn, grouped[x[0]]._n) for x in own] == [(n, len(own)) for n in range(1, len(own) + 1)]


def test_sources(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in {"law/b.txt": "﻿x\ny", "law/a.txt": "z", "economy/c.txt": "w", "other/d.txt": "v", "other/_e.txt": "u"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text, encoding="utf-8")
    assert {(Path(r.file).name, r.category, r.text) for r in R.read_categories(spark, str(tree)).collect()} >= {("b.txt", "law", "x\ny"), ("c.txt", "economy", "w")}
    assert {r.directory: r.category for r in R.read_tree(spark, str(tree)).collect()} == {"law": "general", "economy": "economics", "other": "general"}
    lines = {(Path(r.file).name, r.line_no): r.text for r in R.read_lines(spark, str(tree / "law")).collect()}
    assert lines == {("b.txt", 0): "x", ("b.txt", 1): "y", ("a.txt", 0): "z"}
    assert {r.filename: (r.category, r.sentence_count) for r in R.auto_catalog(spark, str(tree / "law")).collect()} == {"a.txt": ("general", 1), "b.txt": ("general", 2)}
    (tmp_path / "catalog.json").write_text(json.dumps({"documents": [{"filename": "a", "category": "law", "title": "t", "sentence_count": 3}, {"filename": "b", "category": "?"}]}))
    assert [(r.filename, r.category, r.sentence_count) for r in R.read_catalog(spark, str(tmp_path / "catalog.json")).orderBy("filename").collect()] == [("a", "law", 3), ("b", "general", None)]
    with pytest.raises(ValueError):
        R.zip_lines(spark.createDataFrame([(0, "a")], "line_no long, text string"), spark.createDataFrame([(0, "a"), (1, "b")], "line_no long, text string"))
    assert R.merged_options({"a": 1, "b": 5}, {"a": 1, "b": 2, "c": 3}, {"a": 7, "b": 8}) == {"a": 7, "b": 5, "c": 3}
    assert [r.text for r in R.from_texts(spark, [" a ", "", "b"]).orderBy("line_no").collect()] == ["a", "b"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i}", f"t{i}", i % 2, "train" if i else "dev") for i in range(6)], "id long, source string, target string, fold int, split string")
    writers.write_folds(rows, f"{tmp_path}/folds", 2)
    assert {r.id for r in spark.read.json(f"{tmp_path}/folds/fold_1/val").collect()} == {1, 3, 5} and spark.read.json(f"{tmp_path}/folds/fold_1/train").count() == 3
    writers.write_pairs(rows, f"{tmp_path}/pairs")
    assert spark.read.json(f"{tmp_path}/pairs/split=dev").count() == 1
    pairs = rows.select("id", F.col("source").alias("corrupted"), F.col("target").alias("original"), F.array(F.struct(F.lit("x").alias("type"))).alias("errors"))
    writers.write_corpus(pairs, rows.limit(1), f"{tmp_path}/corpus", "id")
    read = lambda n: [r.value for f in sorted(Path(f"{tmp_path}/corpus/{n}").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    assert read("src") == [f"s{i}" for i in range(6)] and read("tgt") == [f"t{i}" for i in range(6)] and spark.read.json(f"{tmp_path}/corpus/annotations").count() == 6
    natural = spark.createDataFrame([("1", "a, \"b\"", "c", "", "NEWS", "?", ["x", "y"], ["r1"], "n", "")], "id string, source_text string, target_text string, source_url string, register string, dialect string, error_types array<string>, annotator_ids array<string>, notes string, keep string")
    writers.write_review(natural, f"{tmp_path}/review", "error_types", "annotator_ids")
    (got,) = R.read_review(spark, f"{tmp_path}/review").collect()
    assert (got.id, got.source_text, got.register, got.dialect, got.error_types, got.annotator_ids) == ("1", 'a, "b"', "news", "unknown", ["x", "y"], ["r1"])
    writers.append_records(rows.select("source"), f"{tmp_path}/records")
    writers.append_records(rows.select("source"), f"{tmp_path}/records")
    assert spark.read.json(f"{tmp_path}/records").select("id").distinct().count() == 12
    writers.write_report(rows.limit(2), f"{tmp_path}/report")
    assert writers.markdown(rows.select("id", "source").orderBy("id").limit(1)) == "| id | source |\n| --- | --- |\n| 0 | s0 |"
    with pytest.raises(ValueError):
        writers.markdown(rows, 2)


@pytest.mark.parametrize("parts", [1, 64])
def test_parallel_text(spark, tmp_path, parts):
    """Source and target stay together, in order, however many files they are in; line breaks become spaces, nulls empty lines."""
    r = random.Random(parts)
    rows = [(i // 2, f"s{i} " + "x" * r.randint(0, 40), f"t{i}") for i in range(3000)] + [(9000, "a\nb\r\nc", None)]
    df = spark.createDataFrame(rows, "id long, source string, target string").repartition(13)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):  # again over what is there
            writers.write_parallel(df, f"{tmp_path}/p", "id")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    read = lambda n: R.numbered_lines(spark.read.text(f"{tmp_path}/p/{n}"))
    assert {p.name for p in (tmp_path / "p").iterdir()} == {"src", "tgt"}
    got = sorted((x.line_no, x.source, x.target) for x in R.zip_lines(read("src"), read("tgt")).collect())
    want = sorted(rows, key=lambda x: (x[0], x[1]))
    assert got == [(n, a.replace("\r\n", " ").replace("\n", " "), b or "") for n, (_, a, b) in enumerate(want)]
    writers.write_parallel(df.limit(0), f"{tmp_path}/p", "id")
    assert spark.read.text(f"{tmp_path}/p/src").count() == 0


def test_language_before_near_duplicates(spark):
    """A line in another language makes no later line its near duplicate."""
    own = "ئەم ڕستەیە بۆ تاقیکردنەوەی پڕۆگرامەکەی من دەچێت ژمارە یەک."
    other = own.replace("ڕ", "ر").replace("ێ", "ی").replace("ۆ", "و").replace("ە", "ه")
    lines = spark.createDataFrame([(0, other), (1, own)], "i long, t string")
    got = {r.i: r.reason for r in W.sanitized(lines, "t", "i", near=0.1, language=True).collect()}
    assert got == {0: "not_sorani", 1: None}
    assert {r.i: r.reason for r in W.sanitized(lines, "t", "i", near=0.1).collect()} == {0: None, 1: "near_duplicate"}


def test_seen_state_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad").write_text("x")
    with pytest.raises(Exception, match="No FileSystem|scheme"):
        R.read_seen(spark, "nosuchscheme://host/x")
    assert R.read_seen(spark, f"{tmp_path}/nothing").count() == 0


def test_scores_by_type(spark):
    gold = [[(0, 1, "x", "A"), (3, 3, "n", "B")], []]
    assert E.typed_counts("a b c".split(), "x b c".split(), gold[0]) == [("A", 1, 0, 0), ("B", 0, 0, 1)]
    assert E.typed_counts("a b c".split(), "a b q".split(), gold[0]) == [("A", 0, 0, 1), ("B", 0, 1, 1)]
    assert E.typed_counts("a b".split(), "a q".split(), gold[1]) == [("spurious", 0, 1, 0)]
    assert E.span_counts("a b".split(), "a c".split(), "a c".split()) == [("substitution", 1, 0, 0)]
    assert E.span_counts("walks b".split(), "walked b c".split(), "walking b".split()) == [("insertion", 0, 1, 0), ("morphological", 0, 1, 1)]
    assert E.m2_edits("a b c".split(), "a b c d".split()) == {(0, 0, "d")} and E.m2_edits("a b c".split(), "a b c d".split(), fixed=True) == {(3, 3, "d")}
    pairs = spark.createDataFrame([(0, "a b", "a c", "a c"), (1, "a", "a", "b"), (2, "a", "a", "a"), (3, None, "x", None)], "id long, source string, hypothesis string, reference string")
    rows = {r.id: (r.tp, r.fp, r.fn) for r in E.sentence_scores(pairs, "id").collect()}
    assert rows == {0: (1, 0, 0), 1: (0, 0, 1), 2: (0, 0, 0), 3: (0, 1, 0)}
    assert [r.id for r in E.hardest(E.sentence_scores(pairs, "id"), "id", n=2).collect()] == [1, 2]


def test_raters(spark):
    rows = [("a", f"s{i}", "c", "xy"[i % 2], i) for i in range(4)] + [("b", f"s{i}", "c", "x", i) for i in range(4)] + [("b", "s0", "c", "y", 9), ("c", "z", "c", "x", 0)]
    (got,) = E.rater_pairs(spark.createDataFrame(rows, "rater_id string, source string, corrected string, rating string, line_no long")).collect()
    assert (got.rater_a, got.rater_b, got.n, got.agreement) == ("a", "b", 4, 0.25) and got.kappa == pytest.approx(-0.5)


def test_pages_and_state(spark, tmp_path):
    pages = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, None, "c"), (4, None, "d")], "pos long, page long, t string")
    assert {r.pos for r in W.dedup_pages(pages, "page", "pos").collect()} == {1, 3}
    texts = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("",)], "text string")
    writers.write_seen(R.read_seen(spark, f"{tmp_path}/none"), texts, f"{tmp_path}/seen")
    assert sorted(r.text for r in R.read_seen(spark, f"{tmp_path}/seen").collect()) == ["a", "b"]
    assert {r.t for r in D.unseen(pages.withColumnRenamed("t", "text"), texts, "text").withColumnRenamed("text", "t").collect()} == {"c", "d"}
