"""Slices follow the data, wide correlations, closed-form fits, and streams that end completely."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookflow.operators import blend, contract, drift
from bookflow.operators.linear import ridge_fit
from bookflow.operators.timeline import SLICE, Timeline
from bookflow.schema import KEY, SEQ, TIME
from bookflow.streaming import events as stream


@pytest.fixture
def small_slices(spark):
    spark.conf.set("bookflow.rowsPerSlice", "100")
    yield
    spark.conf.unset("bookflow.rowsPerSlice")


def test_rewritten_path_gives_new_positions(spark, tmp_path, small_slices):
    path = str(tmp_path / "t")
    for start in (0.0, 5000.0):
        rows = [(0, start + i, i) for i in range(1000)]
        spark.createDataFrame(rows, f"{KEY} int, {TIME} double, {SEQ} long").write.mode("overwrite").parquet(path)
        got = Timeline.of(spark.read.parquet(path)).position().rows
        assert sorted(r.pos for r in got.collect()) == list(range(1, 1001))


@pytest.mark.parametrize("times", [lambda i: 7.0, lambda i: 1e9 if i == 0 else float(i % 50)])
def test_one_instant_and_an_outlier_are_split(spark, small_slices, times):
    df = spark.createDataFrame([(0, times(i), i) for i in range(1000)], f"{KEY} int, {TIME} double, {SEQ} long")
    line = Timeline.of(df)
    sizes = [r["count"] for r in line.rows.groupBy(SLICE).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 200
    order = sorted(range(1000), key=lambda i: (-times(i), i))
    got = {r[SEQ]: r.pos for r in line.position().rows.collect()}
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_correlations_with_holes_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 60)) + rng.normal(size=(300, 1)) + 1000.0
    x[:, 7] = 5.0
    x[rng.random(x.shape) < 0.3] = np.nan
    x[2:, 9] = np.nan
    names = [f"f{i}" for i in range(60)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.a, r.b): r["corr"] for r in drift.correlation_pairs(df, names, min_periods=5).collect()}
    assert len(got) == 60 * 59 // 2
    for i in range(60):
        for j in range(i + 1, 60):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[(names[i], names[j])]
            if both.sum() < 5 or 7 in (i, j):
                assert r is None
            else:
                assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_correlated_columns_are_struck_out():
    m = np.eye(4)
    m[0, 1] = m[1, 0] = 0.99
    m[1, 2] = m[2, 1] = -0.995
    m[2, 3] = m[3, 2] = np.nan
    names = ["a", "b", "c", "d"]
    assert drift.prune_correlated(m, names, {"a": 3, "b": 2, "c": 1}, 0.98) == (["a", "c", "d"], [("b", "a", 0.99)])
    assert drift.prune_correlated(m, names, {"b": 2}, 0.98)[1] == [("a", "b", 0.99), ("c", "b", 0.995)]


def test_left_out_errors_match_refits():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6, 30))
    g, s = np.corrcoef(v), rng.normal(size=6)
    ridges = [0.01, 0.1, 1.0]
    errors = []
    for r in ridges:
        rest = lambda k: [i for i in range(6) if i != k]
        errors.append(np.mean([abs(g[k, rest(k)] @ np.linalg.solve(g[np.ix_(rest(k), rest(k))] + r * np.eye(5), s[rest(k)]) - s[k]) for k in range(6)]))
    ridge, coef, mae = blend.geometry_fit(g, s, ridges)
    assert ridge == ridges[int(np.argmin(errors))] and mae == pytest.approx(min(errors))
    assert coef == pytest.approx(np.linalg.solve(g + ridge * np.eye(6), s))


def test_ridge_from_sums_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3)) * [1, 5, 0] + [0, 100, 4]
    y = x @ [1, 0.2, 0] + rng.normal(size=200)
    df = spark.createDataFrame(np.c_[x, y].tolist(), "a double, b double, c double, y double").repartition(3)
    intercept, w = ridge_fit(df, ["a", "b", "c"], "y", 7.0)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    want = np.linalg.solve(z.T @ z + 7 * np.eye(3), z.T @ (y - y.mean())) / np.where(x.std(0) > 0, x.std(0), 1)
    assert w == pytest.approx(want) and intercept == pytest.approx(y.mean() - want @ x.mean(0))


def test_unknown_codes_fail(spark):
    df = spark.createDataFrame([(0, 1), (1, 2)], "side int, order_action int")
    assert contract.coded(df, "side").count() == 2
    for bad in (df.select("side", "order_action"), spark.createDataFrame([(None, 1)], "side int, order_action int")):
        with pytest.raises(Exception, match="unknown side or action"):
            contract.coded(bad, "side", "order_action").collect()


def test_streams_end_completely_and_count_late_rows(spark, tmp_path):
    """Files come one by one; the last one is hours behind the watermark."""
    t0, r = dt.datetime(2024, 1, 1), random.Random(1)
    files = [[(k, t0 + dt.timedelta(hours=10 * f, minutes=r.randrange(300))) for k in (1, 2)] for f in range(3)] + [[(1, t0)]]
    folder = tmp_path / "events.parquet"
    for i, rows in enumerate(files):
        part = tmp_path / f"part{i}"
        spark.createDataFrame([(k, ts, 1.0) for k, ts in rows], "user_id int, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(part))
        folder.mkdir(exist_ok=True)
        (name,) = part.glob("*.parquet")
        target = folder / f"{i}.parquet"
        target.write_bytes(name.read_bytes())
    done, late = stream.drained(spark, str(tmp_path), lambda s: stream.complete_samples(s, "user_id", "2 hours", "1 hour"))
    assert done.count() + late >= 7 and done.where("user_id = 1").agg(F.max("last_ts")).first()[0] is not None
    assert done.agg(F.sum("events")).first()[0] + late == 7


@pytest.mark.parametrize("name", ["stream_look_back", "stream_nested_windows", "stream_complete_samples", "stream_complete_keys"])
def test_streams_read_files_in_any_order(spark, tmp_path, name):
    """Files that each hold rows of the whole time span, against the check SQL on the one file they are from."""
    from bookflow.plans import registry
    from tests.oracle import canon, run_sql

    whole = "/root/testdata/sf0.001"
    for table in ("events", "lineitem"):
        rows = spark.read.parquet(f"{whole}/{table}.parquet")
        rows.repartition(4, F.hash(*rows.columns)).write.parquet(f"{tmp_path}/{table}.parquet")
    run, sql = registry.entries()[name]
    out = run(spark, str(tmp_path))
    assert canon([tuple(r) for r in out.collect()], out.columns)[0] == run_sql(whole, sql)[0]


def test_stored_tables_without_late_rows_only(spark, tmp_path):
    days = [dt.datetime(2024, 1, d) for d in (1, 20, 20)]  # a watermark holds for late rows two batches on
    for ts in reversed(days):
        spark.createDataFrame([(1, ts, 1.0)], "user_id int, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert stream.stored(spark, str(tmp_path), lambda s, delay: stream.look_back(s, ["user_id"], "6 hours", delay=delay)).count() == 2
    with pytest.raises(RuntimeError, match="too late"):
        stream.stored(spark, str(tmp_path), lambda s, delay: stream.look_back(s, ["user_id"], "6 hours"))


def _files(spark, path, parts, schema):
    for rows in parts:  # one after the other, so that their times of writing differ
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _states(df):
    """(rows given out, most rows in the state after a batch, late rows) of a stream that isn't closed."""
    out = []
    query = df.writeStream.outputMode("append").trigger(availableNow=True).foreachBatch(lambda batch, _: out.extend(batch.collect())).start()
    query.awaitTermination()
    states = [o for p in query.recentProgress for o in p["stateOperators"]]
    return out, max(o["numRowsTotal"] for o in states), sum(o["numRowsDroppedByWatermark"] for o in states)


def test_state_holds_open_keys_only(spark, tmp_path):
    """Keys in order of files: all but those of the last files are given out, once, and a row of a finished key is counted."""
    parts = [[(k, 1.0) for k in range(40 * f, 40 * f + 41) for _ in range(3)] for f in range(8)]  # a key spans two files
    _files(spark, f"{tmp_path}/t.parquet", parts, "k long, value double")
    assert stream.disorder(spark, str(tmp_path), "t", "k") == 0
    sums = [F.count(F.lit(1)).alias("n")]
    out, most, late = _states(stream.complete_keys(stream.event_stream(spark, str(tmp_path), "t"), "k", 0, sums))
    want = {k: 6 if k % 40 == 0 and 0 < k < 320 else 3 for k in range(321)}
    assert len({r.k for r in out}) == len(out) and all(want[r.k] == r.n for r in out)
    assert {r.k for r in out} >= set(range(280)) and most <= 90 and late == 0
    got = stream.stored_keys(spark, str(tmp_path), "t", "k", sums).collect()
    assert {r.k: r.n for r in got} == want and len(got) == 321
    _files(spark, f"{tmp_path}/t.parquet", [[(5, 1.0)]], "k long, value double")
    assert stream.disorder(spark, str(tmp_path), "t", "k") == 315
    assert _states(stream.complete_keys(stream.event_stream(spark, str(tmp_path), "t"), "k", 0, sums))[2] == 1
    want[5] += 1
    assert {r.k: r.n for r in stream.stored_keys(spark, str(tmp_path), "t", "k", sums).collect()} == want


def test_state_holds_open_sessions_only(spark, tmp_path):
    """Files in order of time need no delay, and the state holds the sessions of the last files."""
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    parts = [[(u, at(600 * f + 10 * i + u % 7), 1.0) for u in range(20) for i in range(3)] for f in range(5)]
    _files(spark, f"{tmp_path}/events.parquet", parts, "user_id int, ts timestamp_ntz, value double")
    assert stream.disorder(spark, str(tmp_path), "events", stream.MICROS) == 0
    out, most, late = _states(stream.complete_samples(stream.event_stream(spark, str(tmp_path)), "user_id", "2 hours", "1 second"))
    assert len(out) >= 3 * 20 and most <= 60 and late == 0
    done = stream.stored(spark, str(tmp_path), lambda s, delay: stream.complete_samples(s, "user_id", "2 hours", delay))
    assert sorted(r.events for r in done.collect()) == [3] * 100


def test_bucketed_windows_need_no_exchange(spark):
    from bookflow.plans.platform import bucketed_gaps

    plan = bucketed_gaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan


def test_bucketed_families_join_without_exchange(spark):
    from bookflow.plans.platform import joined_families

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = joined_families(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 3


def test_wide_product_sums_do_not_grow_with_splits(spark):
    """450 columns over 64 splits: what is shuffled is one vector per column and summing task."""
    import pyspark.sql.functions as fn

    wide = spark.range(0, 4000, 1, 64).select(*[((fn.col("id") * (7 + 2 * i)) % 1009).cast("double").alias(f"c{i}") for i in range(450)])
    spark.conf.set("bookflow.sumTasks", "8")
    try:
        pairs = drift.pair_moments(wide, wide.columns)
        got = {(r.i, r.j): (r.n, r["corr"]) for r in pairs.where("i < 3 OR j > 447").collect()}
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("bookflow.sumTasks")
    assert "Coalesce 8" in plan
    x = np.array([[(r * (7 + 2 * i)) % 1009 for i in range(450)] for r in range(4000)], float)
    want = np.corrcoef(x.T)
    assert len(got) == 3 * 450 + 2 * 447
    for (i, j), (n, r) in got.items():
        assert n == 4000 and abs(r - want[i, j]) < 1e-9


def test_quantiles_of_small_and_large_keys_agree(spark):
    """Keys above and below the slice limit in one table, with ties and nulls, against numpy."""
    import numpy as np
    from pyspark.sql import functions as F

    from bookflow.operators.quantile import quantiles_of

    rng = np.random.default_rng(3)
    rows = [(int(k), i, float(x) if x > -1.5 else None) for i, (k, x) in enumerate(zip(np.minimum(rng.geometric(0.3, 3000), 9), np.round(rng.normal(size=3000), 1)))]
    df = spark.createDataFrame(rows, "sample_id int, event_seq long, x double")
    values = {"lo": (F.col("x"), 0.1), "mid": (F.col("x"), 0.5), "double": (2 * F.col("x"), 0.9)}
    spark.conf.set("bookflow.rowsPerSlice", "200")
    try:
        got = {r.sample_id: (r.lo, r.mid, r.double) for r in quantiles_of(df, values, ("sample_id",)).collect()}
    finally:
        spark.conf.unset("bookflow.rowsPerSlice")
    for k in {r[0] for r in rows}:
        x = np.array([v for s, _, v in rows if s == k and v is not None])
        assert np.allclose(got[k], (np.quantile(x, 0.1), np.quantile(x, 0.5), 2 * np.quantile(x, 0.9)))


def test_pareto_front_in_blocks(spark):
    """Fronts of many blocks, ties and null metrics, equal the comparison of all pairs; a million rows in one group are no error."""
    import numpy as np
    from pyspark.sql import functions as F

    from bookflow.operators.evaluate import pareto

    rng = np.random.default_rng(5)
    rows = [(f"n{i}", int(g), *[float(v) for v in np.round(x, 1)]) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 900), rng.normal(size=(900, 3))))]
    rows += [("null", 0, None, 9.0, 9.0), ("twin", 1, *rows[1][2:])]
    df = spark.createDataFrame(rows, "name string, group int, a double, b double, c double")
    got = {r.name: r.nondominated for r in pareto(df, ["a", "b", "c"], block=40).collect()}

    def beaten(r):
        return None not in r[2:] and any(o[1] == r[1] and None not in o[2:] and all(y >= x for x, y in zip(r[2:], o[2:])) and o[2:] != r[2:] for o in rows)

    assert got == {r[0]: not beaten(r) for r in rows}
    wide = spark.range(1_000_000).select(F.col("id").alias("name"), F.lit(0).alias("group"), F.rand(1).alias("a"), F.rand(2).alias("b")).where("a + b < 1.9")
    best = pareto(wide, ["a", "b"]).where("nondominated").select("a", "b").collect()
    top = sorted(((r.a, r.b) for r in best), reverse=True)
    assert top and all(x[1] < y[1] for x, y in zip(top, top[1:]))
