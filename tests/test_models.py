"""Boosting stopped by the cosine, and repeated fits that read their rows once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import models
from bookflow.schema import KEY, MONTH

NAMES = ["a", "b", "noise"]


def rows_of(spark, n=3000):
    h = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(10007)) / 10007.0 - 0.5)
    out = spark.range(n, numPartitions=4).select(F.col("id").alias(KEY), (F.col("id") % 10).cast("int").alias(MONTH), h(1).alias("a"), h(2).alias("b"), h(3).alias("noise"), h(4).alias("e"))
    return out.withColumn("target", F.col("a") - 2 * F.col("b") * F.col("b") + 3 * F.col("e")).drop("e")


def cosine(x, y):
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


@pytest.fixture
def reads(spark):
    """Counts the rows that a source gives out."""
    count = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(frames):
            for f in frames:
                count.add(len(f))
                yield f

        return df.mapInPandas(run, df.schema)

    return count, counted


def test_round_kept_equals_a_scan_of_all_rounds(spark):
    v = models.assembled(rows_of(spark), NAMES).cache()
    model = models._booster(3, 4, 25).fit(v.filter("month < 6"))
    valid = v.filter("month >= 6")
    got = models.round_cosines(model, valid)
    y = np.array([r.target for r in valid.select("target").collect()])
    total, want = np.zeros(len(y)), []
    for tree, w in zip(model.trees, model.treeWeights):
        total = total + w * np.array([r.prediction for r in tree.setPredictionCol("prediction").transform(valid).select("prediction").collect()])
        want.append(cosine(total, y))
    assert np.allclose(got, want, atol=1e-9)
    whole = np.array([r.prediction for r in model.transform(valid).select("prediction").collect()])
    assert abs(want[-1] - cosine(whole, y)) < 1e-9
    assert models.best_round(got, 100) == int(np.argmax(want)) + 1 < 25  # the target is mostly noise: later rounds overfit
    v.unpersist()


def test_patience():
    assert models.best_round([0.1, 0.3, 0.2, 0.3, 0.5], 10) == 5
    assert models.best_round([0.1, 0.3, 0.2, 0.3, 0.5], 2) == 2  # a tie is no gain
    assert models.best_round([0.0], 1) == 1


def test_stopped_trees_read_their_rows_once(spark, reads):
    count, counted = reads
    df = counted(rows_of(spark, 1200))
    out, kept = models.stopped_trees(df, NAMES, "month < 6", "month IN (6, 7)", "month >= 8", seeds=(1, 2), depth=3, rounds=6, patience=3)
    assert [k[0] for k in kept] == [1, 2] and all(1 <= n <= 6 and -1 <= s <= 1 for _, n, s in kept)
    assert out.count() == 240 and out.filter("prediction IS NULL").count() == 0
    assert count.value == 1200


@pytest.mark.parametrize("names", [NAMES[:2], [*NAMES, "shift"]])
def test_rounds_of_dropping_read_their_rows_once(spark, reads, names):
    count, counted = reads
    df = rows_of(spark, 800).withColumn("shift", F.col("noise") + F.when(F.col(MONTH) >= 5, 2.0).otherwise(0.0))
    df = counted(df)
    kept, history = models.drop_shifted(df.filter("month < 5"), df.filter("month >= 5"), names, keep_auc=0.7, rounds=2)
    assert count.value == 2 * 800  # both tables are filtered from the counted one
    assert "shift" not in kept and history[-1][0] <= 0.7 and len(history) == 1 + ("shift" in names)
    assert "shift" not in names or history[0][0] > 0.95


def test_levels_of_codes_read_their_rows_once(spark, reads):
    count, counted = reads
    out = models.residual_codes(counted(rows_of(spark, 400)), levels=3, size=4)
    assert out.count() == 400 and count.value == 400
    got = out.agg(F.variance("residual").alias("r"), F.variance("target").alias("t")).first()
    assert got.r < 0.05 * got.t
