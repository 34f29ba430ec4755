"""Salted joins."""

import pytest
from pyspark.sql import functions as F

from typelore.functions import skew
from typelore.operators import weights as H


def _sides(spark):
    left = [(i, "often") for i in range(300)] + [(300 + i, f"k{i}") for i in range(40)] + [(400 + i, None) for i in range(60)]
    right = [("often", 1), ("k3", 2), ("k4", 3), ("absent", 4), (None, 5)]
    return spark.createDataFrame(left, "id long, key string").repartition(4), spark.createDataFrame(right, "key string, value int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("least", [0, 100, 1000])
def test_same_rows_as_a_plain_join(spark, rows, how, least):
    left, right = _sides(spark)
    plain = left.join(right, ["key"], how)
    found = skew.salted_join(left, right, ["key"], how, 8, ["id"], skew.hot_keys(left, ["key"], least))
    assert found.columns == plain.columns and rows(found) == rows(plain)
    assert rows(skew.salted_join(left, right, ["key"], how, 8, ["id"])) == rows(plain)


def test_only_frequent_keys_are_repeated(spark):
    """A side repeated as a whole would be broadcast at many times the size that Spark expects."""
    counts = spark.range(20_000).select(F.col("id").alias("group"), F.concat(F.lit("t"), F.col("id") % 5_000).alias("term"), F.lit(1).alias("tf"))
    names = counts.select("group")
    idf = H.df_idf(counts.union(counts.select("group", F.lit("every"), "tf")), names).localCheckpoint()

    def generated(weighed):
        weighed.count()
        plan = weighed._jdf.queryExecution().executedPlan()
        found = []

        def walk(node):
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                node = node.executedPlan()
            if node.nodeName().startswith("Generate"):
                found.append(node.metrics().apply("numOutputRows").value())
            below = [node.children().apply(i) for i in range(node.children().size())]
            below += [node.plan()] if "QueryStage" in node.nodeName() else []
            for child in below:
                walk(child)

        walk(plan)
        return sum(found)

    weighed = H.weigh(counts, idf, salts=64, hot_df=10_000)
    weighed.write.format("noop").mode("overwrite").save()
    assert generated(weighed) <= 5_001 + 63
