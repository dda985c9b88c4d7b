"""Queries on scores by sentence and type, raters, statistics of annotated pairs, grids and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import sampling as M
from corpusloom.operators import statistics as S
from corpusloom.plans.tables import PAIRS, SENTS, pairs, sentences, table
from corpusloom.sources.readers import format_m2

Q: dict = {}
SQL: dict[str, str] = {}
KEY = ("doc_id", "pos")
TYPES = ("agreement", "clitic", "order", "spelling")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Pairs with zero to three annotated errors, whose types md5 gives.
RECORDS = PAIRS + f""", records as (select doc_id, pos, source, reference, list_transform(range(('0x' || substr(h, 5, 2))::bigint % 4), lambda i: {list(TYPES)}[('0x' || substr(h, 7 + i, 1))::bigint % 4 + 1]) as types
  from (select *, md5('r:' || doc_id || ':' || pos) as h from pairs))"""


def records(spark, sf):
    h = F.md5(F.concat_ws(":", F.lit("r"), *KEY))
    digit = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    kind = lambda i: F.struct(F.element_at(F.array(*map(F.lit, TYPES)), (digit(F.lit(7) + i, F.lit(1)) % 4 + 1).cast("int")).alias("type"))
    n = (digit(F.lit(5), F.lit(2)) % 4).cast("int")
    return pairs(spark, sf).select(*KEY, "source", "reference", F.slice(F.transform(F.array(*map(F.lit, range(3))), kind), F.lit(1), n).alias("errors"))


@query(f"with {RECORDS} select count(*) as n, round(avg(len(types)), 6) as mean_errors, count_if(len(list_distinct(types)) > 1)::bigint as several from records")
def multi_error(spark, sf):
    return S.error_statistics(records(spark, sf)).withColumn("mean_errors", F.round("mean_errors", 6))


@query(f"with {RECORDS} select coalesce(types[1], 'no_error') as type, count(*) as n from records group by 1")
def primary_type_hist(spark, sf):
    return S.primary_types(records(spark, sf))


@query(f"with {RECORDS} select len(types) as n_errors, count(*) as n from records group by 1")
def errors_per_record(spark, sf):
    return S.error_counts(records(spark, sf))


_W = r"list_filter(regexp_split_to_array({}, '[\s\x0B\x{{85}}\x{{A0}}]+'), lambda x: x <> '')"


@query(f"with {PAIRS}, n as (select doc_id, pos, list_distinct({_W.format('source')}) as a, {_W.format('reference')} as b from pairs) select doc_id, pos, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), '|') as words from n")
def new_tokens(spark, sf):
    return pairs(spark, sf).select(*KEY, F.array_join(F.array_sort(S.new_tokens(F.col("reference"), F.col("source"))), "|").alias("words"))


@query(f"with {PAIRS}, k as (select distinct unnest({_W.format('reference')}) as word from pairs where pos = 0), t as (select doc_id, pos, unnest({_W.format('reference')}) as word from pairs) select doc_id, pos, round(avg((k.word is null)::int), 6) as share, avg((k.word is null)::int) > 0.3::double as dropped from t left join k using (word) group by all")
def spell_filter(spark, sf):
    """Pairs of whose target words more than 30 % are unknown go; known words are those of first sentences."""
    rows = pairs(spark, sf)
    known = rows.where("pos = 0").select(F.explode(S.words(F.col("reference"))).alias("word"))
    return S.invalid_share(rows, "reference", known, *KEY).select(*KEY, F.round("share", 6).alias("share"), (F.col("share") > 0.3).alias("dropped"))


_RATINGS = PAIRS + """, ratings as (select 'r' || k as rater_id, source, reference as corrected, ['good', 'bad', 'unsure'][('0x' || substr(md5(k || ':' || doc_id || ':' || pos), 1, 2))::bigint % 3 + 1] as rating, doc_id * 1000 + pos as line_no
  from pairs, (select unnest(range(3)) as k) where ('0x' || substr(md5(k || ':' || doc_id || ':' || pos), 3, 1))::bigint < 12), one as (select rater_id, source, corrected, max_by(rating, line_no) as rating from ratings group by all)"""


@query(
    f"""with {_RATINGS}, c as (select a.rater_id as rater_a, b.rater_id as rater_b, a.rating as x, b.rating as y, count(*) as c from one a join one b using (source, corrected) where a.rater_id < b.rater_id group by all),
    m as (select *, sum(c) over (partition by rater_a, rater_b, x) as mx, sum(c) over (partition by rater_a, rater_b, y) as my, sum(c) over (partition by rater_a, rater_b) as n from c),
    e as (select a.rater_a, a.rater_b, sum(a.mx::double * b.my) / any_value(a.n::double * a.n) as pe from (select distinct rater_a, rater_b, x as k, mx, n from m) a join (select distinct rater_a, rater_b, y as k, my from m) b using (rater_a, rater_b, k) group by all)
    select rater_a, rater_b, sum(c)::bigint as n, round(sum(case when x = y then c else 0 end) / sum(c)::double, 4) as agreement, round((sum(case when x = y then c else 0 end) / sum(c)::double - any_value(pe)) / (1 - any_value(pe)), 4) as kappa from c join e using (rater_a, rater_b) group by all"""
)
def rater_pairs(spark, sf):
    """Three raters, each with three quarters of all pairs."""
    digit = lambda at, n: F.conv(F.substring(F.md5(F.concat_ws(":", "k", *KEY)), at, n), 16, 10).cast("long")
    rows = pairs(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).where(digit(3, 1) < 12)
    rating = F.element_at(F.array(*map(F.lit, ("good", "bad", "unsure"))), (digit(1, 2) % 3 + 1).cast("int"))
    return E.rater_pairs(rows.select(F.concat(F.lit("r"), "k").alias("rater_id"), "source", F.col("reference").alias("corrected"), rating.alias("rating"), (F.col("doc_id") * 1000 + F.col("pos")).alias("line_no")))


@query()
def sentence_f05(spark, sf):
    return E.sentence_scores(pairs(spark, sf), *KEY).select(*KEY, "tp", "fp", "fn", F.round("f05", 6).alias("f05"))


@query()
def sentence_f05_distribution(spark, sf):
    d = E.score_distribution(E.sentence_scores(pairs(spark, sf), *KEY))
    return d.select("n", "zero", "perfect", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most")))


@query()
def hardest_sentences(spark, sf):
    """The ten with the least F0.5: a report, so the limit is the feature."""
    return E.hardest(E.sentence_scores(pairs(spark, sf), *KEY), *KEY).select(*KEY, F.round("f05", 6).alias("f05"))


def _gold(spark, sf):
    rows = pairs(spark, sf).select(*KEY, "source", F.col("reference").alias("target"), "hypothesis", F.array(F.struct(F.col("error_type").alias("type"))).alias("errors"))
    return E.m2_sentences(rows, F.struct(*KEY), "errors"), rows


@query()
def m2_f05_by_type(spark, sf):
    """M2 scores by the types of a gold file that the pairs make."""
    gold, rows = _gold(spark, sf)
    joined = gold.join(rows.select(F.struct(*KEY).alias("sent_id"), "hypothesis"), "sent_id")
    return E.m2_type_scores(joined).select("type", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f05")))


@query()
def m2_build(spark, sf):
    """The gold file's text of each changed pair."""
    gold, _ = _gold(spark, sf)
    return format_m2(gold).select("sent_id.*", "block")


@query(f"with {PAIRS}, e as (select *, levenshtein(hypothesis, reference) as d from pairs where source <> reference) select error_type, count(*) as n, count_if(hypothesis = reference)::bigint as exact, count_if(hypothesis = source)::bigint as untouched from e group by 1")
def rescore_edited(spark, sf):
    """Of the pairs whose source has an error: how many were corrected, and how many left as they were."""
    edited = pairs(spark, sf).where("source <> reference")
    return edited.groupBy("error_type").agg(F.count("*").alias("n"), F.count_if(F.col("hypothesis") == F.col("reference")).alias("exact"), F.count_if(F.col("hypothesis") == F.col("source")).alias("untouched"))


@query()
def rescore_edited_scores(spark, sf):
    """F0.5, GLEU and error rates of the edited pairs."""
    edited = pairs(spark, sf).where("source <> reference")
    tokens = edited.select(*KEY, *(S.words(F.col(c)).alias(c) for c in ("source", "hypothesis", "reference")))
    gleu = E.sentence_gleu(tokens, *KEY).agg(F.round(F.avg("gleu"), 6).alias("gleu"))
    f05 = E.edit_scores(edited).select(F.round("f05", 6).alias("f05"))
    cer = E.char_error_rate(edited).select(F.round("cer", 6).alias("cer"), F.round("mean_cer", 6).alias("mean_cer"))
    return f05.crossJoin(gleu).crossJoin(cer)  # one row each


@query()
def paired_bootstrap(spark, sf):
    """The hypotheses against a system that changes nothing."""
    c = pairs(spark, sf).select(F.xxhash64(*KEY).alias("k"), E.edit_counts_udf("source", "hypothesis", "reference").alias("a"), E.edit_counts_udf("source", "source", "reference").alias("b"))
    counts = c.select("k", *(F.col(f"{x}.{n}").alias(f"{x}_{n}") for x in "ab" for n in ("tp", "fp", "fn")))
    return E.paired_bootstrap(counts, "k").select(F.round("delta", 6).alias("delta"), "p")


_GRID = "g as (select l.i * 8 + b.i * 4 + e.i * 2 + d.i as trial, l.v as rate, b.v as batch, e.v as epochs, d.v as dropout from (select unnest([0, 1, 2]) as i, unnest([0.1::double, 0.2::double, 0.3::double]) as v) l, (select unnest([0, 1]) as i, unnest([16, 32]) as v) b, (select unnest([0, 1]) as i, unnest([3, 5]) as v) e, (select unnest([0, 1]) as i, unnest(['low', 'high']) as v) d)"
GRID = {"rate": [0.1, 0.2, 0.3], "batch": [16, 32], "epochs": [3, 5], "dropout": ["low", "high"]}


@query(f"with {_GRID} select trial::bigint as trial, rate, batch::bigint as batch, epochs::bigint as epochs, dropout from g")
def parameter_grid(spark, sf):
    return S.grid(spark, GRID)


@query(f"with {_GRID} select trial::bigint as trial from g order by md5('42:' || trial), trial limit 10")
def random_trials(spark, sf):
    return S.random_trials(S.grid(spark, GRID), 10).select("trial")


@query(f"with {_GRID} select trial::bigint as trial, score from (select trial, rate * epochs + batch as score from g) order by score desc, trial limit 5")
def best_trials(spark, sf):
    return S.best_trials(S.grid(spark, GRID).withColumn("score", F.col("rate") * F.col("epochs") + F.col("batch")), "score").select("trial", "score")


@query("with d as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents), p as (select k as draw, ('0x' || substr(md5('42:' || k), 1, 8))::bigint % (select max(n) from d) as i from (select unnest(range(5000)) as k)) select draw, doc_id from p join d using (i)")
def draw_with_replacement(spark, sf):
    rows = M.numbered(table(spark, sf, "documents").select("doc_id"), ["doc_id"]).select("doc_id", (F.col("_rn") - 1).alias("i"))
    return S.draw_with_replacement(rows, 5000, "i").select("draw", "doc_id")


WEIGHTS = {"subject_verb": 3.0, "orthography": 2.0, "whitespace": 1.5, "dialect": 0.5}


@query("select case when p < 3.0 then 'subject_verb' when p < 5.0 then 'orthography' when p < 6.5 then 'whitespace' else 'dialect' end as kind, count(*) as n from (select ('0x' || substr(md5('w:' || doc_id), 1, 8))::bigint / 4294967296.0::double * 7.0::double as p from documents) group by 1")
def weighted_choice(spark, sf):
    return table(spark, sf, "documents").groupBy(S.weighted_choice([F.col("doc_id").cast("string")], WEIGHTS, "w").alias("kind")).agg(F.count("*").alias("n"))


@query("with r as (select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as rn from documents) select size::int as size, doc_id from r, (select unnest([100, 500, 100000000]) as size) where rn <= size")
def sized_samples(spark, sf):
    return S.sized_samples(table(spark, sf, "documents").select("doc_id"), [100, 500, 100_000_000], "doc_id").select("size", "doc_id")


@query("select vec_id, round(least(1, exp((select avg(-abs(x)::double) from (select unnest(embedding) as x)))), 6) as confidence from embeddings")
def sequence_confidence(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.confidence(F.transform("embedding", lambda x: -F.abs(x.cast("double")))), 6).alias("confidence"))


@query("with t as (select vec_id, generate_subscripts(p, 1) - 1 as pos, unnest(p) as s from (select vec_id, [embedding[i:i+3] for i in [1, 5, 9, 13]] as p from embeddings)) select vec_id, pos::int as pos, (list_position(s, list_max(s)) - 1)::int as class, ['a', 'b', 'c'][list_position(s, list_max(s)) - 1] as name from t where list_position(s, list_max(s)) > 1")
def token_classes(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform(F.array(*map(F.lit, (1, 5, 9, 13))), lambda i: F.slice("embedding", i, F.lit(4))).alias("s"))
    return S.token_classes(rows, "s", {1: "a", 2: "b", 3: "c"}, "vec_id")


@query("with s as (select case when rn <= floor(n * 0.8::double + 1e-9) then 'train' when rn <= floor(n * 0.8::double + 1e-9) + floor(n * 0.1::double + 1e-9) then 'dev' else 'test' end as split from (select row_number() over (order by md5('42:' || doc_id), doc_id) as rn, count(*) over () as n from documents)) select split, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from s group by 1")
def split_sizes(spark, sf):
    return S.split_sizes(M.split_random(table(spark, sf, "documents").select("doc_id"), "doc_id"), "split").withColumn("percent", F.round("percent", 6))


@query(f"with {SENTS} select doc_id, pos, len({_W.format('s')}) + 0.5::double * (length(s) - length(replace(s, ',', ''))) as difficulty from sents")
def sentence_difficulty(spark, sf):
    """Words plus half a point for each comma, which stands for an edge of the agreement graph here."""
    return sentences(spark, sf).select(*KEY, S.difficulty(F.col("s"), F.length("s") - F.length(F.replace("s", F.lit(","), F.lit("")))).alias("difficulty"))


@query(f"with {SENTS}, l as (select distinct on (doc_id) doc_id, quality from labels order by doc_id, quality) select s.doc_id, pos, coalesce('q' || quality, 'general') as category from sents s left join l using (doc_id)")
def category_or_default(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.concat(F.lit("q"), F.min("quality")).alias("category"))
    return S.with_default(sentences(spark, sf).select(*KEY), labels, "doc_id", "category", "general").select(*KEY, "category")


@query(f"with {PAIRS} select error_type, count(*) as n, count_if(hypothesis = reference)::bigint as exact from (select *, row_number() over (order by doc_id, pos) as rn from pairs) where rn <= 200 group by 1")
def validation_prefix(spark, sf):
    """The metric on a fixed prefix of the development set: the limit is the feature."""
    rows = pairs(spark, sf).orderBy(*KEY).limit(200)
    return rows.groupBy("error_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("hypothesis", "source") == F.col("reference")).alias("exact"))


@query()
def audit_normalization(spark, sf):
    """What normalization would change in the pairs in Arabic script, with the first five examples."""
    from corpusloom.functions.text import transliterate

    rows = pairs(spark, sf).select(F.concat_ws(":", *KEY).alias("doc_id"), *(F.regexp_replace(transliterate(F.col(c)), "h", "ه").alias(c) for c in ("source", "reference")))
    out = S.audit_normalization(rows, "source", "reference")
    return out.select("field", "n", "changed", F.size("examples").alias("n_examples"))
