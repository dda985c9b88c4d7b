"""Sources: text lines, documents, pair JSONL, parallel text, M2 files, dictionaries, affix files, ratings, dumps, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.filters import detect, infer_category
from corpusloom.functions.profile import CATEGORIES, DIRECTORY_CATEGORY
from corpusloom.functions.text import sentences, strip, wiki_markup

ERRORS = "array<struct<type:string,original:string,error:string,start:int,end:int,description:string>>"
PAIR = f"original string, corrupted string, source string, target string, errors {ERRORS}, source_id string, category string"


def numbered_lines(df: DataFrame) -> DataFrame:
    """file, line_no (from 0 in each file), text of a text scan: lines are numbered within the partitions of a file, whose sizes are
    then summed up, so that no file has to be read by one task."""
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("text"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file", "_b").orderBy("_i")) - 1)
    sizes = rows.groupBy("file", "_b").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return rows.join(sizes, ["file", "_b"]).select("file", (F.col("_n") + F.col("_before")).alias("line_no"), F.regexp_replace("text", "^\\ufeff", "").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, text (stripped) of *.txt files whose names do not begin with . or _."""
    return numbered_lines(spark.read.option("pathGlobFilter", "[!._]*.txt").text(path)).withColumn("text", strip(F.col("text")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, category (name of the folder), text of all *.txt files below path."""
    rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    return rows.select(file.alias("file"), F.element_at(F.split(file, "/"), -2).alias("category"), F.regexp_replace("value", "^\\ufeff", "").alias("text"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """file, category, pos, sentence of all *.txt files below path."""
    return read_documents(spark, path).select("file", "category", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def parse_pairs(lines: DataFrame, column: str = "text") -> DataFrame:
    """PAIR's fields, raw, and bad: true for lines that are not JSON objects with a source and a target."""
    p = F.from_json(column, PAIR)
    rows = lines.select("*", p.alias("_p")).select(*(c for c in lines.columns if c != column), F.col(column).alias("raw"), "_p.*")
    return rows.withColumn("bad", F.col("source").isNull() | F.col("target").isNull())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(numbered_lines(spark.read.text(path))).where(~F.col("bad")).drop("bad")


def across_files(lines: DataFrame) -> DataFrame:
    """numbered_lines() with line_no counted on through the files in the order of their names; without a column file, lines as they are."""
    if "file" not in lines.columns:
        return lines
    sizes = lines.groupBy("file").agg(F.count("*").alias("_c"))  # a row a file
    before = F.coalesce(F.sum("_c").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("file").alias("_f"), before.alias("_before"))
    return lines.join(sizes, F.col("file") == F.col("_f")).withColumn("line_no", F.col("line_no") + F.col("_before")).drop("_f", "_before")


def zip_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """line_no, source, target of the lines of two files or folders, of which there are equally many: the lines of a folder are those of
    its files in the order of their names."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} lines against {m}")
    a, b = across_files(a), across_files(b)
    return a.select("line_no", F.col("text").alias("source")).join(b.select("line_no", F.col("text").alias("target")), "line_no")


def parse_m2(lines: DataFrame, *by: str) -> DataFrame:
    """sent_id (from 1), source, edits of lines (by..., line_no, text): S begins a sentence, A adds an edit of at least three fields."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = lines.withColumn("sent_id", F.count_if(F.col("text").startswith("S ")).over(w.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).where("sent_id > 0")
    f = F.split("text", r"\|\|\|")
    span = F.split(F.element_at(f, 1), " ")
    annotator = F.coalesce(F.try_element_at(f, F.lit(6)).try_cast("int"), F.lit(0))
    edit = F.struct("line_no", span[1].try_cast("int").alias("start"), F.get(span, F.lit(2)).try_cast("int").alias("end"), F.try_element_at(f, F.lit(2)).alias("error_type"), F.try_element_at(f, F.lit(3)).alias("correction"), annotator.alias("annotator"))
    is_edit = F.col("text").startswith("A ") & (F.size(f) >= 3)
    out = rows.groupBy(*by, "sent_id").agg(F.max(F.when(F.col("text").startswith("S "), F.substring("text", 3, 1 << 30))).alias("source"), F.array_sort(F.collect_list(F.when(is_edit, edit))).alias("edits"))
    return out.withColumn("edits", F.transform("edits", lambda e: e.dropFields("line_no")))


def format_m2(rows: DataFrame) -> DataFrame:
    """sent_id, block: the text of each sentence in M2."""
    line = lambda e: F.concat(F.lit("A "), e["start"].cast("string"), F.lit(" "), e["end"].cast("string"), F.lit("|||"), e["error_type"], F.lit("|||"), e["correction"], F.lit("|||REQUIRED|||-NONE-|||"), e["annotator"].cast("string"))
    return rows.select("sent_id", F.concat_ws("\n", F.concat(F.lit("S "), "source"), F.transform("edits", line), F.lit("")).alias("block"))


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """surface, flags, pos, stem, lemma, inflectional of dictionary lines (text); the count line is skipped."""
    parts = F.split("text", r"\s+")
    tag = lambda name: F.substring(F.coalesce(F.get(F.filter(parts, lambda p: p.startswith(f"{name}:")), F.lit(0)), F.lit("")), len(name) + 2, 1 << 30)
    word = F.split(parts[0], "/")
    rows = lines.where(~F.col("text").rlike(r"^\s*\d*\s*$"))
    return rows.select(word[0].alias("surface"), F.coalesce(F.get(word, F.lit(1)), F.lit("")).alias("flags"), tag("po").alias("pos"), tag("st").alias("stem"), tag("lem").alias("lemma"), tag("is").alias("inflectional"))


def parse_affixes(lines: DataFrame) -> DataFrame:
    """kind, flag, strip, add, condition of affix rules (text); headers have four fields, rules five or more; '0' is empty."""
    f = F.split(F.trim("text"), r"\s+")
    rows = lines.where(F.col("text").rlike(r"^(PFX|SFX)\s") & ~F.coalesce(f[3].rlike(r"^\d+$") & f[2].isin("Y", "N"), F.lit(False)))
    empty = lambda c: F.when(c == "0", "").otherwise(c)
    return rows.select(f[0].alias("kind"), f[1].alias("flag"), empty(f[2]).alias("strip"), empty(F.split(f[3], "/")[0]).alias("add"), F.coalesce(F.get(f, F.lit(4)), F.lit(".")).alias("condition"))


def parse_affix_headers(lines: DataFrame) -> DataFrame:
    """kind, flag, cross (whether it goes with affixes of the other kind), rules (number) of the headers of affix files (text)."""
    f = F.split(F.trim("text"), r"\s+")
    rows = lines.where(F.col("text").rlike(r"^(PFX|SFX)\s+\S+\s+[YN]\s+\d+\s*$"))
    return rows.select(f[0].alias("kind"), f[1].alias("flag"), (f[2] == "Y").alias("cross"), f[3].cast("int").alias("rules"))


def parse_affix_options(lines: DataFrame) -> DataFrame:
    """option, values of the other lines of affix files: TRY, IGNORE, COMPOUNDFLAG and the like, but no REP and no comments."""
    f = F.split(F.trim("text"), r"\s+")
    return lines.where(F.col("text").rlike(r"^[A-Z]+\s+\S") & ~F.col("text").rlike(r"^(PFX|SFX|REP)\s")).select(f[0].alias("option"), F.slice(f, F.lit(2), F.size(f) - 1).alias("values"))


def parse_replacements(lines: DataFrame) -> DataFrame:
    """rule_no (from 0, in order), pattern, replacement of REP lines (line_no, text); underscores stand for spaces."""
    f = F.split(F.trim("text"), r"\s+")
    rows = lines.where(F.col("text").rlike(r"^REP\s+\S+\s+\S+\s*$")).select("line_no", f[1].alias("pattern"), F.replace(f[2], F.lit("_"), F.lit(" ")).alias("replacement"))
    return rows.withColumn("rule_no", F.row_number().over(Window.orderBy("line_no")) - 1).select("rule_no", "pattern", "replacement")  # a few dozen rules


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """rater_id, source, corrected, rating of ratings_*.jsonl files."""
    rows = spark.read.schema("source string, corrected string, rating string").option("pathGlobFilter", "ratings_*.jsonl").json(path)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^ratings_(.*)\.jsonl$", 1).alias("rater_id"), "*")


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the pages of a MediaWiki dump (plain or compressed), without markup."""
    rows = spark.read.schema("title string, revision struct<text: struct<_VALUE: string>>").option("rowTag", "page").xml(path)
    return rows.select("title", wiki_markup(F.coalesce("revision.text._VALUE", F.lit(""))).alias("text"))


def wiki_sentences(spark: SparkSession, path: str, least: int = 20, most: int = 500, language: bool = True) -> DataFrame:
    """title, pos, sentence of a MediaWiki dump: of more than least and less than most characters and, with language, in Central Kurdish."""
    rows = read_wiki_dump(spark, path).select("title", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    rows = rows.where((F.length("sentence") > least) & (F.length("sentence") < most))
    return rows.where(detect(F.col("sentence"))["is_sorani"]) if language else rows


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size_bytes of all files below path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.where(~F.col("path").endswith("/.gitkeep")).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, tables and tags go, white space is collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style|table|sup)\b[^>]*>.*?</\1>", " ")
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", " "), r"(?U)\s+", " "))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """file, category (the folder's name), text of *.txt files in the folders of path: sorted by folder and file, they are a catalog."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(f"{path}/*/*", wholetext=True)
    file = F.col("_metadata.file_path")
    return rows.select(file.alias("file"), F.element_at(F.split(file, "/"), -2).alias("category"), F.regexp_replace("value", "^\\ufeff", "").alias("text"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """file, directory, category, text of all *.txt files below path; the category is that of the first folder below path, by a fixed
    table, or general."""
    rows = read_documents(spark, path)
    directory = F.regexp_extract("file", f"{re.escape(path.rstrip('/'))}/([^/]+)/", 1)
    lookup = F.create_map(*(F.lit(x) for kv in DIRECTORY_CATEGORY.items() for x in kv))
    return rows.select("file", directory.alias("directory"), F.coalesce(F.try_element_at(lookup, directory), F.lit("general")).alias("category"), "text")


def recollected(lines: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """Lines of more than `least` characters; of those with a tab, what follows the first one."""
    right = strip(F.when(F.instr(F.col(text), "\t") > 0, F.regexp_replace(text, "^[^\t]*\t", "")).otherwise(F.col(text)))
    return lines.withColumn(text, right).where(F.length(text) > least)


CATALOG = "documents array<struct<filename:string,category:string,title:string,sentence_count:bigint>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """filename, category (general for unknown ones), title, sentence_count of catalog JSON files."""
    rows = spark.read.schema(CATALOG).option("multiLine", True).json(path).select(F.inline("documents"))
    return rows.withColumn("category", F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("general"))


def auto_catalog(spark: SparkSession, path: str) -> DataFrame:
    """filename, category, title, sentence_count, char_count of the *.txt files of a folder; categories come from their names."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    name = F.regexp_replace("_metadata.file_name", r"\.txt$", "")
    lines = F.filter(F.split("value", "\n"), lambda x: strip(x) != "")
    return rows.select(F.col("_metadata.file_name").alias("filename"), infer_category(name).alias("category"), name.alias("title"), F.size(lines).cast("long").alias("sentence_count"), F.length("value").cast("long").alias("char_count"))


# Registers and dialects of natural sentences.
REGISTERS, DIALECTS = ("news", "social_media", "academic", "literary", "formal", "informal", "other"), ("sulaymani", "hawleri", "mukriyani", "garmiyani", "unknown")


def parse_review(rows: DataFrame) -> DataFrame:
    """Natural sentences of a reviewed table: rows with keep = n or an empty source or target go, unknown registers and dialects have
    defaults, and lists are split at semicolons."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim), lambda x: x != "")
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    one_of = lambda c, known, other: F.when(F.lower(F.trim(c)).isin(*known), F.lower(F.trim(c))).otherwise(other)
    kept = rows.where((F.lower(F.trim(F.coalesce("keep", F.lit("")))) != "n") & (text("source_text") != "") & (text("target_text") != ""))
    return kept.select(
        "id", text("source_text").alias("source_text"), text("target_text").alias("target_text"), "source_url", one_of("register", REGISTERS, "other").alias("register"), one_of("dialect", DIALECTS, "unknown").alias("dialect"),
        listed("error_types").alias("error_types"), listed("annotator_ids").alias("annotator_ids"), "notes",
    )


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """parse_review() of CSV files with a header, with a byte order mark or without."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return parse_review(rows.toDF(*(c.lstrip("﻿") for c in rows.columns)))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """line_no, text of given lines without empty ones, as from standard input."""
    return spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts) if t.strip()], "line_no long, text string")


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """text of a state of seen sentences; empty where path does not exist. Any other failure to read is an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "text string")
    return spark.read.text(path).select(F.col("value").alias("text")).where("text <> ''")


def merged_options(given: dict, defaults: dict, config: dict) -> dict:
    """Options of a command: what was given, where it differs from the default; else the configuration's; else the default."""
    return {k: given[k] if k in given and given[k] != d else config.get(k, d) for k, d in defaults.items()}
