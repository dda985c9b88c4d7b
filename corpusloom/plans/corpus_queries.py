"""Queries on deduplication, sets, splits, samples, statistics and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedup as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import sampling as M
from corpusloom.operators import statistics as S
from corpusloom.operators.unicode import nfc
from corpusloom.plans.tables import AR, PAIRS, SENTS, pairs, script_sentences, sentences, table

Q: dict = {}
SQL: dict[str, str] = {}
KEY = ("doc_id", "pos")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query(f"with {SENTS} select doc_id, pos, s from sents qualify row_number() over (partition by lower(s) order by doc_id, pos) = 1")
def dedup_exact(spark, sf):
    return D.dedup_exact(sentences(spark, sf), "s", *KEY).select(*KEY, "s")


@query(r"select doc_id from documents qualify row_number() over (partition by regexp_replace(regexp_replace(text, '[\s\x0B\x{85}\x{A0}]+', ' ', 'g'), '^ | $', '', 'g') order by doc_id) = 1")
def dedup_spaced(spark, sf):
    return D.dedup_spaced(_docs(spark, sf), "text", "doc_id").select("doc_id")


@query(f"with {SENTS}, state as (select distinct s from sents where doc_id % 2 = 0) select doc_id, pos from sents where doc_id % 2 = 1 and s not in (select s from state)")
def dedup_seen(spark, sf):
    s = sentences(spark, sf)
    return D.unseen(s.where("doc_id % 2 = 1"), s.where("doc_id % 2 = 0"), "s").select(*KEY)


@query()
def near_dup_pairs(spark, sf):
    return D.near_pairs(_docs(spark, sf), "doc_id", "text").withColumn("jaccard", F.round("jaccard", 6))


@query()
def near_dup_kept(spark, sf):
    docs = _docs(spark, sf)
    return D.greedy_kept(docs.select("doc_id"), "doc_id", D.near_pairs(docs, "doc_id", "text"))


_SPLIT = """numbered as (select *, row_number() over (order by md5('42:' || doc_id), doc_id) as rn, count(*) over () as n from documents),
  cut as (select *, case when rn <= a then 'train' when rn <= a + b then 'dev' else 'test' end as split from (select *, floor(n * 0.8::double + 1e-9) as a, floor(n * 0.1::double + 1e-9) as b from numbered))"""


@query(f"with {_SPLIT} select doc_id, split from cut")
def split_random(spark, sf):
    return M.split_random(_docs(spark, sf), "doc_id").select("doc_id", "split")


@query("select doc_id, case when rn <= floor(n * 0.8::double + 1e-9) then 'train' when rn <= floor(n * 0.8::double + 1e-9) + floor(n * 0.1::double + 1e-9) then 'dev' else 'test' end as split from (select doc_id, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as rn, count(*) over (partition by lang) as n from documents)")
def split_stratified(spark, sf):
    return M.split_stratified(_docs(spark, sf), "lang", "doc_id").select("doc_id", "split")


@query(
    """with g as (select source, count(*) as c from documents group by 1), o as (select source, coalesce(sum(c) over (order by md5('42:' || source), source rows between unbounded preceding and 1 preceding), 0) as b, sum(c) over () as n from g)
    select doc_id, case when b < floor(n * 0.8::double + 1e-9) then 'train' when b < floor(n * 0.8::double + 1e-9) + floor(n * 0.1::double + 1e-9) then 'dev' else 'test' end as split from documents join o using (source)"""
)
def split_group(spark, sf):
    return M.split_groups(_docs(spark, sf), "source").select("doc_id", "split")


@query("select doc_id, least(floor((rn - 1) / greatest(floor(n / 5.0::double), 1)), 4)::int as fold from (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as rn, count(*) over () as n from documents)")
def kfold(spark, sf):
    return M.kfold(_docs(spark, sf), "doc_id").select("doc_id", "fold")


@query(f"with {_SPLIT}, t as (select distinct split, text from cut) select a.split || '-' || b.split as pair, count(*) as n from t a join t b on a.text = b.text and a.split < b.split group by 1")
def leakage_counts(spark, sf):
    return D.leakage(M.split_random(_docs(spark, sf), "doc_id"), "split", "text")


@query(f"with {_SPLIT}, r as (select *, list_position(['train', 'dev', 'test'], split) as r from cut) select doc_id, split from r qualify r = min(r) over (partition by text)")
def leak_removed(spark, sf):
    return D.without_leaks(M.split_random(_docs(spark, sf), "doc_id"), "split", "text").select("doc_id", "split")


@query(f"with {SENTS} select count(distinct s) as n from sents where s in (select trim(unnest(string_split(text, '. '))) from benchmark) or s in (select text from benchmark)")
def source_overlap(spark, sf):
    b = table(spark, sf, "benchmark")
    both = b.select("text").union(b.select(F.explode(F.transform(F.split("text", r"\. "), F.trim))))
    return sentences(spark, sf).select("s").intersect(both.toDF("s")).agg(F.count("*").alias("n"))


_BALANCED = """c as (select lang, count(*) as n from documents group by 1 having count(*) >= 50), q as (select *, count(*) over () as k, row_number() over (order by lang) as i from c),
  r as (select *, 500 // k + (i <= 500 % k)::int as quota from q), u as (select *, n > quota as large, sum(greatest(quota - n, 0)) over () as lack from r),
  v as (select *, sum(large::int) over () as m, sum(large::int) over (order by lang rows between unbounded preceding and current row) as j from u),
  t as (select lang, least(n, quota + case when large then lack // greatest(m, 1) + (j <= lack % greatest(m, 1))::int else 0 end) as take from v),
  b as (select doc_id, lang, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as round from documents)"""


@query(f"with {_BALANCED} select doc_id, lang, round from b join t using (lang) where round <= take")
def balanced_sample(spark, sf):
    return M.balanced_sample(_docs(spark, sf), "lang", "doc_id", target=500, least=50).select("doc_id", "lang", "round")


@query(f"with {_BALANCED} select doc_id, row_number() over (order by round, lang) as place from b join t using (lang) where round <= take")
def interleave(spark, sf):
    rows = M.balanced_sample(_docs(spark, sf), "lang", "doc_id", target=500, least=50)
    return M.numbered(rows, ["round", "lang"]).select("doc_id", F.col("_rn").alias("place"))


@query("select doc_id, unnest(range(0, ((2500 - rn) // n + 1)::bigint)) as copy from (select doc_id, row_number() over (order by doc_id) as rn, count(*) over () as n from documents) where rn <= 2500")
def oversample(spark, sf):
    return M.oversample(_docs(spark, sf), 2500, "doc_id").select("doc_id", "copy")


@query("select doc_id, unnest(['swap', 'delete', 'synonym']) as strategy from (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as rn, count(*) over () as n from documents) where rn <= floor(n * 0.5::double)")
def augment_ratio(spark, sf):
    return M.augment_ratio(_docs(spark, sf), ["swap", "delete", "synonym"], "doc_id").select("doc_id", "strategy")


@query("select doc_id from (select doc_id, row_number() over (order by n_chars, doc_id) as rn, count(*) over () as n from documents) where rn <= greatest(1, ceil((0.3::double + 0.7::double * (10 / 29.0::double)) * n - 1e-9))")
def curriculum_active(spark, sf):
    return M.curriculum(_docs(spark, sf), "n_chars", "doc_id", epoch=10).select("doc_id")


@query(f"with {PAIRS}, c as (select error_type as name, count(*) as n from pairs group by 1), r as (select *, row_number() over (order by n desc, name) as r from c) select case when r <= 2 then name else 'other' end as name, sum(n)::bigint as n from r group by 1")
def top_types_other(spark, sf):
    return M.top_and_other(pairs(spark, sf), "error_type", 2)


@query(f"with {SENTS} select lang, source, count(*) as sentences, sum(length(s))::bigint as chars from sents group by rollup (lang, source)")
def catalog_stats(spark, sf):
    return sentences(spark, sf).rollup("lang", "source").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


@query(f"with {SENTS} select lang, count(*) as n, min(length(s)) as least, max(length(s)) as most, round(avg(length(s)), 6) as mean from sents group by 1")
def collect_stats(spark, sf):
    n = F.length("s")
    return sentences(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 6).alias("mean"))


@query(f"with {PAIRS} select error_type, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent, count_if(source <> reference)::bigint as active from pairs group by 1")
def error_hist(spark, sf):
    rows = pairs(spark, sf).groupBy("error_type").agg(F.count("*").alias("n"), F.count_if(F.col("source") != F.col("reference")).alias("active"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_SPLITW = r"regexp_split_to_array({}, '[\s\x0B\x{{85}}\x{{A0}}]+')"


@query(
    f"""with {PAIRS}, w as (select {_SPLITW.format('source')} as a, {_SPLITW.format('reference')} as b from pairs)
    select count(*) as n, round(avg(abs(len(a) - len(b)) + (select count(*) from (select unnest(range(1, least(len(a), len(b)) + 1)) as i) where a[i] <> b[i])), 6) as mean from w"""
)
def edit_density(spark, sf):
    a, b = F.split("source", r"(?U)\s+"), F.split("reference", r"(?U)\s+")
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), x != y)), lambda x: x)) + F.abs(F.size(a) - F.size(b))
    return pairs(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(differ), 6).alias("mean"))


#: The code points that an audit counts.
AUDITED = ["U+064A", "U+0643", "U+0647", "U+06D5", "U+FEFF"]


@query(f"""with {AR}, c as (select name, sum(length(s) - length(replace(s, chr(('0x' || substr(name, 3))::int), '')))::bigint as n from ar, (select unnest({AUDITED}) as name) group by 1)
  select * from c union all select 'not NFC', count_if(nfc_normalize(s) <> s)::bigint from ar""")
def char_audit(spark, sf):
    """How often each code point occurs, and how many sentences are not in NFC."""
    rows = script_sentences(spark, sf)
    counts = [F.sum(F.length("s") - F.length(F.replace("s", F.lit(chr(int(c[2:], 16))), F.lit("")))).alias(c) for c in AUDITED]
    sums = rows.select("s", nfc("s").alias("c")).agg(*counts, F.count_if(F.col("s") != F.col("c")).alias("not NFC"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in [*AUDITED, "not NFC"]))).alias("x")).select("x.*")


_GLEU = f"""{PAIRS}, t as (select doc_id, pos, {_SPLITW.format('source')} as s, {_SPLITW.format('hypothesis')} as h, {_SPLITW.format('reference')} as r from pairs),
  u as (select doc_id, pos, 's' as who, s as w from t union all select doc_id, pos, 'h', h from t union all select doc_id, pos, 'r', r from t),
  g as (select doc_id, pos, who, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], chr(1)))) as g from u, (select unnest([1, 2, 3, 4]) as n)),
  c as (select doc_id, pos, n, g, count_if(who = 's') as s, count_if(who = 'h') as h, count_if(who = 'r') as r from g group by all),
  b as (select doc_id, pos, n, sum(least(h, r)) as tp, sum(least(h, greatest(s - r, 0))) as fp, sum(h) as h, sum(r) as r from c group by all having sum(h) > 0),
  m as (select doc_id, pos, exp(avg(ln(least((greatest(tp - fp, 0) + 1) / (h + 1)::double, (tp + 1) / (r + 1)::double)))) as mean from b group by all),
  gleu as (select doc_id, pos, mean * case when len(h) < len(r) then exp(1 - len(r) / greatest(len(h), 1)::double) else 1 end as gleu from t join m using (doc_id, pos))"""


def _tokens(rows):
    return rows.select(*KEY, *(T.words(F.col(c)).alias(c) for c in ("source", "hypothesis", "reference")))


@query(f"with {_GLEU} select doc_id, pos, round(gleu, 6) as gleu from gleu")
def gleu_sentence(spark, sf):
    return E.sentence_gleu(_tokens(pairs(spark, sf)), *KEY).withColumn("gleu", F.round("gleu", 6))


@query(f"with {_GLEU} select round(avg(gleu), 6) as gleu from gleu")
def gleu_corpus(spark, sf):
    return E.sentence_gleu(_tokens(pairs(spark, sf)), *KEY).agg(F.round(F.avg("gleu"), 6).alias("gleu"))


_ASCII = "regexp_full_match(hypothesis || reference, '[ -~]*')"


@query(f"with {PAIRS} select round(sum(levenshtein(hypothesis, reference)) / sum(greatest(length(reference), 1))::double, 6) as cer, round(avg(levenshtein(hypothesis, reference) / length(reference)::double), 6) as mean_cer from pairs where {_ASCII}")
def cer(spark, sf):
    rows = pairs(spark, sf).where(F.concat("hypothesis", "reference").rlike("^[ -~]*$"))
    return E.char_error_rate(rows).select(F.round("cer", 6).alias("cer"), F.round("mean_cer", 6).alias("mean_cer"))


@query()
def cer_all_pairs(spark, sf):
    """cer() of every pair; that one has the ASCII pairs, which DuckDB measures alike."""
    return E.char_error_rate(pairs(spark, sf)).select(F.round("cer", 6).alias("cer"), F.round("mean_cer", 6).alias("mean_cer"))


_KAPPA = """c as (select quality::varchar as a, toxic::varchar as b, count(*) as n from labels group by all), t as (select sum(n)::bigint as n, sum(case when a = b then n end) as same from c),
  e as (select sum(x * y::double) as c from (select a as k, sum(n) as x from c group by 1) join (select b as k, sum(n) as y from c group by 1) using (k))"""


@query(f"with {_KAPPA} select n, round(same / n::double, 6) as agreement, round((same / n::double - c / (n * n::double)) / (1 - c / (n * n::double)), 6) as kappa from t, e")
def kappa(spark, sf):
    return E.kappa(table(spark, sf, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query(f"with {PAIRS}, v as (select doc_id, pos, unnest([source, hypothesis, reference]) as c, unnest([0, 1, 2]) as p from pairs), n as (select doc_id, pos, c, count(*) as n, min(p) as f from v group by all) select doc_id, pos, c as winner from n qualify row_number() over (partition by doc_id, pos order by n desc, f) = 1")
def majority_vote(spark, sf):
    rows = pairs(spark, sf).select(F.struct(*KEY).alias("k"), F.posexplode(F.array("source", "hypothesis", "reference")).alias("p", "c"))
    return E.majority_vote(rows, "k", "c", "p").select("k.*", "winner")


@query(f"with {PAIRS} select doc_id, pos, case when length(source) >= length(hypothesis) then source else hypothesis end as best from pairs")
def best_score(spark, sf):
    rows = pairs(spark, sf).select(F.struct(*KEY).alias("k"), F.posexplode(F.array("source", "hypothesis")).alias("p", "c")).withColumn("score", F.length("c"))
    return E.best_score(rows, "k", "c", "score", "p").select("k.*", "best")


@query(f"with {PAIRS} select doc_id, pos, case when greatest(length(hypothesis), length(reference)) <= 40 or length(hypothesis) >= length(reference) then hypothesis else reference end as best from pairs")
def best_score_or_first(spark, sf):
    """Scores that can be below 0: where none is above, the first candidate counts."""
    rows = pairs(spark, sf).select(F.struct(*KEY).alias("k"), F.posexplode(F.array("hypothesis", "reference")).alias("p", "c")).withColumn("score", F.length("c") - 40)
    return E.best_score(rows, "k", "c", "score", "p").select("k.*", "best")


# Sentences whose only edit is the first word: counts that SQL can give.
_FIRST = f"{PAIRS}, one as (select *, (hypothesis = reference)::int as hit from pairs where substr(md5('42:' || doc_id || ':' || pos), 4, 1) >= '4' and source <> reference)"


def _first(spark, sf):
    return pairs(spark, sf).where((F.substring(F.md5(F.concat_ws(":", F.lit("42"), "doc_id", "pos")), 4, 1) >= "4") & (F.col("source") != F.col("reference")))


def _score_sql(by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return f"with {_FIRST} select {head}sum(hit)::bigint as tp, 0::bigint as fp, sum(1 - hit)::bigint as fn, case when sum(hit) > 0 then 1.0::double else 0 end as precision, round(avg(hit), 6) as recall, round(1.25::double * avg(hit) / (0.25 + avg(hit)), 6) as f05 from one{tail}"


def _rounded(df, *by):
    return df.select(*by, *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f05")))


@query(_score_sql())
def f05_corpus(spark, sf):
    return _rounded(E.edit_scores(_first(spark, sf)))


@query(_score_sql("error_type"))
def f05_by_type(spark, sf):
    return _rounded(E.edit_scores(_first(spark, sf), "error_type"), "error_type")


@query(_score_sql())
def m2_f05(spark, sf):
    return _rounded(E.m2_scores(_first(spark, sf)))


@query()
def f05_span(spark, sf):
    return _rounded(E.span_scores(pairs(spark, sf)), "type")


@query()
def f05_all_pairs(spark, sf):
    return _rounded(E.edit_scores(pairs(spark, sf), "error_type"), "error_type")


@query()
def f05_corpus_all_pairs(spark, sf):
    return _rounded(E.edit_scores(pairs(spark, sf)))


@query()
def m2_f05_all_pairs(spark, sf):
    return _rounded(E.m2_scores(pairs(spark, sf)))


_COUNTS = f"{PAIRS}, c as (select row_number() over (order by doc_id, pos) - 1 as i, (source <> reference and hypothesis = reference)::int as tp, 0 as fp, (source <> reference and hypothesis <> reference)::int as fn from pairs where pos = 0)"


@query(
    f"""with {_COUNTS}, n as (select count(*) as n from c), p as (select b, ('0x' || substr(md5('42:' || b || ':' || k), 1, 8))::bigint % n as i from n, (select unnest(range(100)) as b) , (select unnest(range((select n from n))) as k)),
    s as (select b, sum(tp) as tp, sum(fn) as fn from p join c using (i) group by 1), f as (select case when tp = 0 then 0::double else 1.25::double * (tp / (tp + fn)::double) / (0.25 + tp / (tp + fn)::double) end as f05 from s),
    r as (select f05, row_number() over (order by f05) as rn from f) select round(max(case when rn = 3 then f05 end), 6) as low, round(max(case when rn = 98 then f05 end), 6) as high from r"""
)
def bootstrap_ci(spark, sf):
    rows = pairs(spark, sf).where("pos = 0")
    changed, right = F.col("source") != F.col("reference"), F.col("hypothesis") == F.col("reference")
    counts = M.numbered(rows, [*KEY]).select((F.col("_rn") - 1).alias("i"), (changed & right).cast("int").alias("tp"), F.lit(0).alias("fp"), (changed & ~right).cast("int").alias("fn"))
    return E.bootstrap(counts, 100).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def bootstrap_ci_all_pairs(spark, sf):
    """Interval of the edits of every pair from 1,000 resamples; bootstrap_ci() has a part of them, for SQL."""
    rows = pairs(spark, sf).select(F.xxhash64(*KEY).alias("k"), E.edit_counts_udf("source", "hypothesis", "reference").alias("c"))
    return E.interval(rows.select("k", "c.*"), "k").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""with h as (select sha256(text) as h, count(*) as c from documents group by 1),
  b as (select ('0x' || substr(h, 1, 8))::bigint % 4096 as b, sha256(string_agg(h || ':' || c, ',' order by h)) as h, sum(c) as c from h group by 1)
  select sha256(string_agg(h, '' order by b)) as digest, sum(c)::bigint as n from b""")
def dataset_hash(spark, sf):
    """Order-independent digest of a dataset."""
    return S.dataset_digest(_docs(spark, sf), "text")


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, sf):
    """Extension: tumbling windows over the event table."""
    rows = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour")["start"].alias("start"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
