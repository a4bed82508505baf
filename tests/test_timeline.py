"""Sliced and unsliced timelines must agree, for any slice size, input order and partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from bookflow.operators.quantile import exact_quantiles
from bookflow.operators.timeline import Timeline, lookup
from bookflow.schema import KEY, SEQ, TIME


def rows():
    r = random.Random(5)
    out = []
    for i in range(400):
        key = 0 if i < 300 else r.randrange(1, 6)
        x = None if r.random() < 0.3 else float(r.randrange(20))
        out.append((key, float(r.randrange(0, 60)), i, x, r.choice([-1, 1])))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), f"{KEY} int, {TIME} double, {SEQ} long, x double, g int")


def everything(df):
    line = Timeline.of(df)
    line = line.shifted(["x", "g"], {1: "p1_", 3: "p3_", -1: "n1_", -2: "n2_"})
    line = line.running_sum({"cum": F.col("g")}).running_sum({"cum_before": F.col("g")}, inclusive=False)
    line = line.last_known("known", F.col("x")).last_known("known_next", F.col("x"), forward=False)
    line = line.running_extreme("high", F.col("cum")).position().runs(F.col("g")).key_total("all", F.col("g"))
    return line.rows.drop("_slice")


def expected():
    by_key = {}
    for r in sorted(rows(), key=lambda r: (r[0], -r[1], r[2])):
        by_key.setdefault(r[0], []).append(r)
    out = {}
    for rs in by_key.values():
        cum = run = 0
        high = None
        for i, r in enumerate(rs):
            at = lambda k, j: rs[i + k][j] if 0 <= i + k < len(rs) else None
            cum_before, cum = cum, cum + r[4]
            high = cum if high is None else max(high, cum)
            run += 1 if i == 0 or rs[i - 1][4] != r[4] else 0
            known = next((q[3] for q in reversed(rs[:i]) if q[3] is not None), None)
            known_next = next((q[3] for q in rs[i + 1 :] if q[3] is not None), None)
            out[r[2]] = (
                at(-1, 3), at(-1, 4), at(-3, 3), at(-3, 4), at(1, 3), at(1, 4), at(2, 3), at(2, 4),
                cum, cum_before, known, known_next, high, i + 1, run, sum(q[4] for q in rs),
            )
    return out


NAMES = ("p1_x p1_g p3_x p3_g n1_x n1_g n2_x n2_g cum cum_before known known_next high pos run all").split()


@pytest.mark.parametrize("limit", ["1000000", "100", "7"])
@pytest.mark.parametrize("parts", [1, 5])
def test_timeline_matches_brute_force(spark, limit, parts):
    spark.conf.set("bookflow.rowsPerSlice", limit)
    try:
        df = frame(spark).orderBy(F.rand(3)).repartition(parts)
        got = {r[SEQ]: tuple(r[n] for n in NAMES) for r in everything(df).collect()}
    finally:
        spark.conf.unset("bookflow.rowsPerSlice")
    assert got == expected()


@pytest.mark.parametrize("limit", ["1000000", "9"])
def test_exact_quantiles_match_builtin(spark, limit):
    df = frame(spark)
    want = {r[0]: tuple(r[1:]) for r in df.groupBy(KEY).agg(
        *[F.expr(f"percentile(x, {p})") for p in (0.1, 0.5, 0.95)]).collect()}
    spark.conf.set("bookflow.rowsPerSlice", limit)
    try:
        got = exact_quantiles(df, F.col("x"), {"a": 0.1, "b": 0.5, "c": 0.95}, (KEY,)).collect()
        whole = exact_quantiles(df, F.col("x"), {"a": 0.5}).first()
    finally:
        spark.conf.unset("bookflow.rowsPerSlice")
    assert {r[0] for r in got} == set(want)
    for r in got:
        assert tuple(r[1:]) == pytest.approx(want[r[0]])
    assert whole.a == df.agg(F.expr("percentile(x, 0.5)")).first()[0]


@pytest.mark.parametrize("limit", ["1000000", "20"])
def test_lookup_is_a_left_join(spark, limit):
    df = frame(spark)
    ref = spark.createDataFrame([(0, 1.5), (1, 2.5), (9, 3.5)], f"{KEY} int, m double")
    spark.conf.set("bookflow.rowsPerSlice", limit)
    try:
        got = sorted(map(tuple, lookup(df, ref, [KEY]).select(SEQ, "m").collect()))
    finally:
        spark.conf.unset("bookflow.rowsPerSlice")
    assert got == sorted(map(tuple, df.join(ref, KEY, "left").select(SEQ, "m").collect()))
