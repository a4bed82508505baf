"""Hand-calculated cases on four samples, the last of which has no events."""

import math

import pytest
from pyspark.sql import functions as F

from bookflow.operators import book, evaluate, preprocess, quotes, trades
from bookflow.operators.assemble import duplicate_keys
from bookflow.sources.adapters import Streams


def make_streams(spark, parts=1):
    market = [
        (s, float(t), i, 1.01 + 0.001 * i if i != 5 else 0.0, 0 if i == 5 else 10 + i, 0.99 + 0.001 * i, 10 + 2 * i,
         1.01 + 0.001 * i, 10 + i, 0.99 + 0.001 * i, 10 + 2 * i, 1.0, 3, 1)
        for i, (s, t) in enumerate([(0, 65), (0, 35), (0, 30), (0, 10), (0, 0), (1, 20), (1, 0), (2, 0), (2, 0)])
    ]
    names = (
        "sample_id int, seconds_before_predict double, event_seq long, ask_price_1 double, ask_volume_1 int, bid_price_1 double, "
        "bid_volume_1 int, ask_price_2 double, ask_volume_2 int, bid_price_2 double, bid_volume_2 int, "
        "transaction_avgprice double, transaction_volume int, transaction_count int"
    )
    tx = zip([0, 0, 0, 0, 1, 2, 2], [60, 40, 20, 0, 0, 10, 0], [1, 1.01, 1, 1.03, 1, 1, 1.01], [1, 2, 3, 4, 1, 3, 5], [0, 1, 0, 1, 0, 1, 0])
    od = zip([0, 0, 0, 1, 2, 2], [60, 30, 0, 0, 10, 0], [1, 2, 3, 4, 5, 6], [0, 1, 0, 1, 0, 1], [0, 1, 0, 0, 1, 0])
    tx = [(s, float(t), i, float(p), v, g) for i, (s, t, p, v, g) in enumerate(tx)]
    od = [(s, float(t), i, 1.0, v, g, a) for i, (s, t, v, g, a) in enumerate(od)]
    flow = "sample_id int, seconds_before_predict double, event_seq long, price double, volume int, side int"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).orderBy(F.rand(7)).repartition(parts)
    label = spark.createDataFrame([(i, 65, 0.1) for i in range(4)], "sample_id int, month int, target double")
    return Streams(frame(market, names), frame(tx, flow), frame(od, flow + ", order_action int"), label)


def rows_of(df):
    return {r["sample_id"]: r.asDict() for r in df.collect()}


def test_gap_between_new_orders_skips_the_cancel(spark):
    s = make_streams(spark)
    r = rows_of(quotes.burst_flow(s.market, s.transaction, s.order, s.spine))
    assert r[0]["x31_ord_gap_mean"] == 60
    assert all(math.isfinite(v) for v in r[3].values())


def test_sample_without_events_is_zero(spark):
    s = make_streams(spark)
    for df in (quotes.context(s.market, s.spine), trades.flow_persistence(s.market, s.transaction, s.order, s.spine)):
        values = [v for k, v in rows_of(df)[3].items() if k != "sample_id"]
        assert len(values) in (10, 12) and not any(values)


def test_results_do_not_depend_on_partitioning(spark):
    def run(parts):
        s = make_streams(spark, parts)
        return rows_of(quotes.volatility_flow(s.market, s.transaction, s.order, s.spine))

    one = run(1)
    for parts in (3, 8):
        other = run(parts)
        for k in one:
            assert other[k] == pytest.approx(one[k])


def test_each_family_has_one_row_per_sample(spark):
    s = make_streams(spark)
    out = book.base_features(s.market, s.transaction, s.order, s.spine)
    assert len(out.columns) == 59 and out.count() == 4 and duplicate_keys(out).count() == 0


def quotes_frame(spark, rows):
    schema = (
        "sample_id int, seconds_before_predict double, event_seq long, bid_price_1 double, bid_volume_1 int, "
        "ask_price_1 double, ask_volume_1 int"
    )
    df = spark.createDataFrame(rows, schema)
    twice = {f"{s}_{k}_2": F.col(f"{s}_{k}_1") for s in ("ask", "bid") for k in ("price", "volume")}
    return df.withColumns(
        twice | {"transaction_avgprice": F.lit(1.0), "transaction_volume": F.lit(1), "transaction_count": F.lit(1)}
    )


def test_order_flow_imbalance_by_hand(spark):
    rows = [(0, 3.0, 0, 1.0, 10, 2.0, 10), (0, 2.0, 1, 1.0, 15, 2.0, 10), (0, 1.0, 2, 1.0, 15, 2.0, 13)]
    line = quotes.quote_line(quotes_frame(spark, rows)).rows.withColumn("e", quotes.ofi(1))
    assert [r.e for r in line.orderBy("event_seq").collect()] == [None, 5, -3]
    rows[0] = (0, 3.0, 0, 0.0, 10, 2.0, 10)
    line = quotes.quote_line(quotes_frame(spark, rows)).rows.withColumn("e", quotes.ofi(1))
    assert [r.e for r in line.orderBy("event_seq").collect()] == [None, None, -3]


def test_price_impact_pairs(spark):
    rows = [(0, 2.0, 0, 1.0, 1, 0), (0, 1.0, 1, 2.0, 2, 0), (1, 2.0, 2, 0.0, 100, 0), (1, 1.0, 3, 3.0, 200, 0)]
    tx = spark.createDataFrame(
        rows, "sample_id int, seconds_before_predict double, event_seq long, price double, volume int, side int"
    )
    r = rows_of(quotes.trade_gap_sums(tx))
    assert r[0]["k_num"] == pytest.approx(2 * math.log(2)) and r[0]["k_den"] == 4
    assert r[1]["k_num"] == 0 and r[1]["k_den"] == 0


def frame(spark, pred, target, months):
    rows = [(i, m, float(y), float(p)) for i, (p, y, m) in enumerate(zip(pred, target, months))]
    return spark.createDataFrame(rows, "sample_id int, month int, target double, pred double")


def test_cosine_is_not_shift_invariant(spark):
    m = evaluate.moments(frame(spark, [9, 11], [-1, 1], [1, 1]), ["pred"])
    assert m.select(evaluate.cosine("pred").alias("s")).first().s == pytest.approx(1 / math.sqrt(101))


def test_panels_by_hand(spark):
    df = frame(spark, [1, -1, -1, 1], [1, -1, 1, -1], [65, 65, 66, 66]).withColumn("best", F.col("target"))
    t = {(r.scope, r.month): r for r in evaluate.paired_panel(df, "pred", "best").collect()}
    assert t[("overall", -1)].base == 0 and t[("overall", -1)].delta == 1
    assert t[("without", -1)].base == 1
    assert t[("month", 66)].delta == 2


def test_prediction_mean_and_duplicates(spark):
    rows = [("a", 0, 1.0), ("a", 2, 4.0), ("b", 0, 3.0), ("b", 2, 8.0)]
    long = spark.createDataFrame(rows, "model string, sample_id int, pred double")
    r = rows_of(evaluate.prediction_mean(long, ["model"]))
    assert {k: (v["pred"], v["models"]) for k, v in r.items()} == {0: (2, 2), 2: (6, 2)}
    with pytest.raises(Exception, match="duplicate model"):
        evaluate.prediction_mean(long.union(long), ["model"]).collect()


def test_prediction_mean_sums_before_it_shuffles(spark):
    models = [(a, f, s) for a in "ab" for f in range(34) for s in (1, None)]
    rows = [(a, f, s, i, float(f + i)) for i in range(40) for a, f, s in models if not (a == "b" and i == 3 and f > 1)]
    long = spark.createDataFrame(rows, "arm string, fold int, seed int, sample_id int, pred double").coalesce(2)
    few = long.where("fold < 10")  # 20 models of an arm, then 68
    for part, folds in ((few, 10), (long, 34)):
        mean = evaluate.prediction_mean(part, ["fold", "seed"], ["arm"])
        got = {(r.arm, r.sample_id): (r.pred, r.models) for r in mean.collect()}
        n = lambda a, i: 2 if (a, i) == ("b", 3) else folds
        assert got == {(a, i): ((n(a, i) - 1) / 2 + i, 2 * n(a, i)) for a in "ab" for i in range(40)}
        with pytest.raises(Exception, match="duplicate model"):
            evaluate.prediction_mean(part.union(part.where("sample_id = 7 AND fold = 3 AND seed IS NULL AND arm = 'b'")), ["fold", "seed"], ["arm"]).collect()
    # one exchange, of sums
    plan = evaluate.prediction_mean(few, ["fold", "seed"], ["arm"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("partial_sum")


def test_clip_comes_before_zero(spark):
    df = spark.createDataFrame([(0, 0.0, True), (1, 5.0, False)], "sample_id int, p double, nodata boolean")
    b = spark.createDataFrame([(1.0, 2.0)], "low double, high double")
    assert [r.pred for r in evaluate.postprocess(df, "p", b, "nodata").orderBy("sample_id").collect()] == [0, 2]


def test_recency_needs_every_model(spark):
    rows = [(f, s, 0, float(f)) for f in range(5) for s in (1, 2)]
    long = spark.createDataFrame(rows, "fold int, seed int, sample_id int, pred double")
    folds = spark.createDataFrame([(i, f[0]) for i, f in enumerate(evaluate.FOLDS)], "fold int, train_end int")
    r = evaluate.recency_ensemble(long, folds, 20).first()
    assert r.base == 2 and r.recency > 2
    with pytest.raises(Exception, match="incomplete"):
        evaluate.recency_ensemble(long.filter("NOT (fold = 1 AND seed = 2)"), folds, 20).collect()
    arms = long.withColumn("arm", F.lit("a")).unionByName(long.filter("NOT (fold = 1 AND seed = 2)").withColumn("arm", F.lit("b")))
    got = {x.arm: x for x in evaluate.recency_ensemble(arms, folds, 20, by=("arm",), incomplete="report").collect()}
    assert (got["a"].recency, got["a"].complete, got["a"].models) == (r.recency, 1, 10)
    assert (got["b"].base, got["b"].recency, got["b"].complete, got["b"].models) == (None, None, 0, 9)


def test_partial_overlap_is_refused(spark):
    a = frame(spark, [1, 2], [1, 1], [1, 1]).select("sample_id", "month", "target", F.col("pred").alias("prediction"))
    with pytest.raises(Exception, match="overlap only in part"):
        evaluate.compare_runs(a, a.filter("sample_id = 0")).collect()


def test_score_windows_must_not_overlap(spark):
    with pytest.raises(ValueError):
        evaluate.jobs(spark, ["a"], [1], [(59, 62, 66), (64, 66, 70)])
    late = evaluate.split_counts(frame(spark, range(80), range(80), range(80)), evaluate.jobs(spark, ["a"], [1], [(70, 68, 70)]))
    assert late.filter("valid").count() == 0  # a score window inside the training horizon


def test_robust_scale_is_bounded(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 4.0), (2, 1.0, 6.0)], "sample_id int, flat double, x double")
    out = preprocess.robust_scale(df.union(spark.createDataFrame([(3, 1.0, 1000.0)], df.schema)), ["flat", "x"], df)
    r = rows_of(out)
    assert all(v["flat"] == 0 for v in r.values()) and 2.9 < r[3]["x"] <= 3
