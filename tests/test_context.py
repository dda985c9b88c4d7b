"""Tags from arrays of blocks against the relation of analyzed tokens."""

from pyspark.sql import functions as F
from test_graph import sentences

from corpusloom.operators import context as C
from corpusloom.operators import morphology as M


def test_tags_are_those_of_the_relation(spark):
    rows = spark.createDataFrame([*enumerate([*sentences()[:80], "لە کوڕەکان", "دوو کوڕان", "لە دوو کوڕان"]), (9999, None)], "id long, s string").repartition(4)
    tags = F.array_sort(F.collect_list(F.struct("i", F.concat_ws("/", "pos", "case", "number").alias("t"))))
    known = M.analyzed(rows, "s", "id").groupBy("id").agg(F.array_join(F.transform(tags, lambda x: x["t"]), " ").alias("tags"))
    made = C.tags_in_context(rows, "s", "id")
    assert sorted(made.collect()) == sorted(known.collect())
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
