"""Input checks, expressions, set operations, sinks, streaming and models."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import stats
from ..operators import blend, book, contract, drift, flow, joins, linear, models, quotes
from ..operators.assemble import on_bucketed_spine, on_spine
from ..operators.lineage import checkpoint_root, cut
from ..schema import SEQ
from ..sources import ingest, sinks
from ..sources.adapters import predictions, streams
from ..streaming import events as stream
from .book import BASE_JOIN, base_steps
from .modelling import FT, average_rank_sql, features
from .quotes import W
from .registry import entries, present, register
from .sql import cols, query

ONE = ("k",)
one_row = lambda df: present(df.selectExpr("0 AS k", "*"), ONE)
BAD = "count(*) FILTER (WHERE {x} IS NULL)"


def _contract(name, cte, span, numeric, codes, may_miss, pick):
    out = {"rows": "count(*)", "bad_id": "count(*) FILTER (WHERE sample_id IS NULL OR sample_id < 0)",
           "bad_seconds_before_predict": BAD.format(x="t"), "outside_span": f"count(*) FILTER (WHERE t < 0 OR t > {span})"}
    out |= {f"bad_{n}": BAD.format(x=x) for n, x in numeric.items() if n not in may_miss}
    out |= {f"nodata_{n}": BAD.format(x=numeric[n]) for n in may_miss}
    out |= {f"code_{n}": f"count(*) FILTER (WHERE {x} NOT IN (0, 1))" for n, x in codes.items()}

    @register(name, query([cte], f"SELECT 0 AS k, {cols(out)} FROM {cte}", keys=ONE))
    def run(spark, path):
        return one_row(contract.contract_counts(pick(streams(spark, path)), span, tuple(codes), may_miss))


QUOTE_NUMBERS = {
    "transaction_avgprice": "ap", "transaction_volume": "tv", "transaction_count": "tc", "ask_price_1": "a1", "ask_volume_1": "av1",
    "bid_price_1": "b1", "bid_volume_1": "bv1", "ask_price_2": "a2", "ask_volume_2": "av2", "bid_price_2": "b2", "bid_volume_2": "bv2",
}
FLOW_NUMBERS = {"price": "price", "volume": "volume", "side": "side"}
_contract("contract_quotes", "mk", 600, QUOTE_NUMBERS, {}, ("transaction_avgprice",), lambda s: s.market)
_contract("contract_trades", "tx", 60, FLOW_NUMBERS, {"side": "side"}, (), lambda s: s.transaction)
_contract(
    "contract_orders", "od", 60, FLOW_NUMBERS | {"order_action": "act"}, {"side": "side", "order_action": "act"}, (),
    lambda s: contract.checked(s.order, 60, ("side", "order_action")).select(s.order.columns),
)


@register("observed_trades", entries()["contract_trades"][1])
def observed_trades(spark, path):
    """The counts of contract_trades, taken while the rows are written to the shared folder."""
    trades = streams(spark, path).transaction
    rows, seen = contract.observed(trades, 60)
    cut(rows)
    return one_row(spark.createDataFrame([tuple(seen.get.values())], [f"{n}" for n in seen.get]))


@register(
    "level_profile",
    query(
        ["mk"],
        """SELECT 0 AS k, count(*) AS samples, sum(n) AS rows, sum(x1) AS empty_ask_price_1, sum(y1) AS empty_bid_price_1, sum(x2) AS empty_ask_price_2,
        sum(y2) AS empty_bid_price_2, sum(u) AS untraded, sum(e) / sum(n) AS empty_row_share, avg((e > 0)::INT) AS empty_sample_share FROM (SELECT sample_id,
        count(*) AS n, count(*) FILTER (WHERE a1 = 0) AS x1, count(*) FILTER (WHERE b1 = 0) AS y1, count(*) FILTER (WHERE a2 = 0) AS x2,
        count(*) FILTER (WHERE b2 = 0) AS y2, count(*) FILTER (WHERE ap IS NULL) AS u, count(*) FILTER (WHERE a1 = 0 OR b1 = 0) AS e FROM mk GROUP BY sample_id)""",
        keys=ONE,
    ),
)
def level_profile(spark, path):
    return one_row(contract.level_profile(streams(spark, path).market))


@register(
    "stream_profile",
    query(
        ["od"],
        """SELECT 0 AS k, count(*) AS samples, sum(n) AS rows, min(n) AS rows_min, max(n) AS rows_max, avg(n) AS rows_mean, quantile_cont(n, 0.25) AS rows_q25, median(n) AS rows_median, quantile_cont(n, 0.75) AS rows_q75, min(lo) AS time_min,
        max(hi) AS time_max, (SELECT count(DISTINCT side) FROM od) AS values_side, (SELECT count(DISTINCT act) FROM od) AS values_order_action
        FROM (SELECT sample_id, count(*) AS n, min(t) AS lo, max(t) AS hi FROM od GROUP BY sample_id)""",
        keys=ONE,
    ),
)
def stream_profile(spark, path):
    return one_row(contract.stream_profile(streams(spark, path).order, ("side", "order_action")))


@register(
    "order_audit",
    query(
        ["tx"],
        """SELECT 0 AS k, sum(n) AS rows, sum(r) AS rises, count(*) FILTER (WHERE r > 0) AS bad_samples FROM (SELECT sample_id, count(*) AS n,
        count(*) FILTER (WHERE t > pt) AS r FROM (SELECT *, lag(t) OVER (PARTITION BY sample_id ORDER BY seq) AS pt FROM tx) GROUP BY sample_id)""",
        keys=ONE,
    ),
)
def order_audit(spark, path):
    return one_row(contract.order_audit(streams(spark, path).transaction))


@register(
    "label_ids",
    query(
        ["lab"],
        """SELECT 0 AS k, count(*) AS rows, count(DISTINCT sample_id) AS ids, min(sample_id) AS first, max(sample_id) AS last,
        (count(*) = count(DISTINCT sample_id) AND min(sample_id) = 0 AND max(sample_id) = count(*) - 1)::INT AS dense FROM lab""",
        keys=ONE,
    ),
)
def label_ids(spark, path):
    return one_row(contract.dense_ids(streams(spark, path).label))


@register(
    "key_sets",
    query(
        ["mk", "spine"],
        """SELECT 0 AS k, count(*) FILTER (WHERE l = 1 AND r = 1) AS both, count(*) FILTER (WHERE r IS NULL) AS left_only,
        count(*) FILTER (WHERE l IS NULL) AS right_only FROM (SELECT sample_id, 1 AS l FROM spine) FULL JOIN (SELECT DISTINCT sample_id, 1 AS r FROM mk) USING (sample_id)""",
        keys=ONE,
    ),
)
def key_sets(spark, path):
    s = streams(spark, path)
    return one_row(contract.key_sets(s.spine, s.market))


@register("union_slices", query(["pr"], "SELECT sample_id, 1000 * pred_a AS x FROM pr"))
def union_slices(spark, path):
    p = predictions(spark, path).select("sample_id", (F.col("pred_a") * 1000).alias("x"))
    return present(contract.union_disjoint([ingest.id_range(p, None, 300), ingest.id_range(p, 300, 600), ingest.id_range(p, 600)]))


@register(
    "bucketed_activity",
    query(
        ["tx"],
        """SELECT sample_id, count(*) AS n, sum(volume) AS volume, max(gap) AS longest FROM (SELECT sample_id, volume,
        lag(t) OVER (PARTITION BY sample_id ORDER BY t DESC, seq) - t AS gap FROM tx) GROUP BY sample_id""",
    ),
)
def bucketed_activity(spark, path):
    return present(bucketed_gaps(spark, path))


def bucketed_gaps(spark, path, buckets=8):
    """Per-sample window and totals over a bucketed table: no exchange."""
    trades = ingest.bucketed(streams(spark, path).transaction, buckets)
    w = Window.partitionBy("sample_id").orderBy(F.desc("seconds_before_predict"), "event_seq")
    t = F.col("seconds_before_predict")
    rows = trades.withColumn("gap", F.lag(t).over(w) - t)
    return rows.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.max("gap").alias("longest"))


FAMILIES = {"trade_flow": "transaction", "trade_windows": "transaction", "order_flow": "order"}


@register(
    "bucketed_families",
    " JOIN ".join(f"{'SELECT * FROM ' * (k == 0)}({entries()[n][1]}) {'USING (sample_id)' * (k > 0)}" for k, n in enumerate(FAMILIES)),
)
def bucketed_families(spark, path):
    return present(joined_families(spark, path))


def joined_families(spark, path, buckets=8):
    """Three families of events bucketed by sample, joined to a spine bucketed alike: no exchange in families or joins."""
    s = streams(spark, path)
    spine = ingest.bucketed(s.spine, buckets)
    events = {"transaction": ingest.bucketed(s.transaction, buckets), "order": ingest.bucketed(s.order, buckets)}
    return on_bucketed_spine(spine, *[getattr(flow, name)(events[stream], spine) for name, stream in FAMILIES.items()])


ARROW_COLUMNS = ("sample_id", "seconds_before_predict", "price", "volume", "side", "order_action")


@register(
    "arrow_events",
    query(
        ["od"],
        """SELECT sample_id, count(*) AS n, sum(volume) AS volume, sum(price) AS price, sum(side) AS sells, sum(act) AS cancels, max(t) AS first_seen, min(t) AS last_seen,
        count(*) AS places, 0 AS out_of_order FROM od GROUP BY sample_id""",
    ),
)
def arrow_events(spark, path):
    """Orders written as Arrow files of one record batch each in file order of their samples, read back by ranges of rows."""
    orders = streams(spark, path).order.repartitionByRange(3, "sample_id").sortWithinPartitions("sample_id", F.desc("seconds_before_predict"), "event_seq")
    files = sinks.write_arrow(orders.select(*ARROW_COLUMNS), f"{checkpoint_root(spark).rstrip('/')}/arrow-{uuid.uuid4().hex}")
    schema = T.StructType([T.StructField(n, T.DoubleType() if n in ("seconds_before_predict", "price") else T.LongType()) for n in ARROW_COLUMNS])
    back = ingest.convert_arrow_files(spark, files, schema, rows_per_slice=1_000_000)
    t = F.col("seconds_before_predict")
    out = back.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.sum("volume").alias("volume"), F.sum("price").alias("price"), F.sum("side").alias("sells"), F.sum("order_action").alias("cancels"),
        F.max(t).alias("first_seen"), F.min(t).alias("last_seen"), (F.max(SEQ) - F.min(SEQ) + 1).alias("places"),
        (F.max_by(t, F.col(SEQ)) - F.min(t) + F.max(t) - F.min_by(t, F.col(SEQ))).alias("out_of_order"),
    )
    return present(out)


@register("distinct_rows", query(["mk"], "SELECT DISTINCT sample_id, tc, bv1 FROM mk"))
def distinct_rows(spark, path):
    m = streams(spark, path).market
    return present(m.select("sample_id", F.col("transaction_count").alias("tc"), F.col("bid_volume_1").alias("bv1")).dropDuplicates())


@register("keep_ids", query(["tx", "lab"], "SELECT sample_id, seq AS event_seq, volume FROM tx WHERE sample_id IN (SELECT sample_id FROM lab WHERE month <= 5)", keys=("sample_id", "event_seq")))
def keep_ids(spark, path):
    s = streams(spark, path)
    out = ingest.keep_ids(s.transaction, s.label.filter("month <= 5"))
    return present(out.select("sample_id", "event_seq", "volume"), ("sample_id", "event_seq"))


@register(
    "window_filters",
    query(
        ["od"],
        """SELECT sample_id, count(*) FILTER (WHERE t <= 15) AS w15, count(*) FILTER (WHERE t > 15 AND t <= 60) AS w15_60, count(*) FILTER (WHERE t < 20) AS w20,
        sum(volume) FILTER (WHERE t <= 30 AND side = 0 AND act = 1) AS cancelled FROM od GROUP BY sample_id""",
    ),
)
def window_filters(spark, path):
    o = streams(spark, path).order
    t = X.seconds()
    out = o.groupBy("sample_id").agg(
        stats.count_if(flow.within(15)).alias("w15"),
        stats.count_if(flow.within((15, 60))).alias("w15_60"),
        stats.count_if(t < 20).alias("w20"),
        F.sum(F.when(flow.within(30) & X.is_buy & X.is_cancel, X.volume)).alias("cancelled"),
    )
    return present(out)


def _quote_features_sql():
    tie = "l_orderkey, l_linenumber"
    out = {
        "rows": "count(*)", "mid": "avg(mid)", "rel_spread": "avg((a1 - b1) / greatest(mid, 1e-9))", "micro": "avg((a1 * bv1 + b1 * av1) / greatest(av1 + bv1, 1e-12))",
        "imb1": "avg((bv1 - av1) / greatest(bv1 + av1, 1e-12))", "imb2": "avg((bv2 - av2) / greatest(bv2 + av2, 1e-12))",
        "imb_total": "avg((bv1 + bv2 - av1 - av2) / (bv1 + bv2 + av1 + av2 + 1))", "ask_gap": "avg((a2 - a1) / greatest(mid, 1e-9))",
        "bid_gap": "avg((b1 - b2) / greatest(mid, 1e-9))", "ask_slope": "avg(CASE WHEN abs(av2 - av1) > 1e-12 THEN (a2 - a1) / (av2 - av1) END)",
        "bid_slope": "avg(CASE WHEN abs(bv2 - bv1) > 1e-12 THEN (b2 - b1) / (bv2 - bv1) END)",
        "robust": "count(*) FILTER (WHERE ok AND mid >= 0.1 AND a1 >= b1 AND (a1 - b1) / mid <= 0.1)", "depth_max": "max(greatest(av1, bv1, av2, bv2))",
        "depth_min": "min(least(av1, bv1, av2, bv2))", "clipped": "avg(greatest(least(mid, 20), 5))", "log_ratio": "avg(CASE WHEN av2 > 0 THEN ln(1 + bv1 / av2) END)",
        "half_even": "sum(round_even(t, 0))", "bin_sum": "sum(59 - least(floor(t / 10), 59))",
    }
    return query(["mk"], f"SELECT sample_id, {cols(out)} FROM mk GROUP BY sample_id")


@register("quote_features", _quote_features_sql())
def quote_features(spark, path):
    t = X.seconds()
    gap_ask, gap_bid = X.level_gaps()
    slope_ask, slope_bid = X.price_volume_slope()
    volumes = (X.askv1, X.bidv1, X.askv2, X.bidv2)
    out = streams(spark, path).market.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(X.mid).alias("mid"), F.avg(X.spread / X.at_least(X.mid, 1e-9)).alias("rel_spread"),
        F.avg(X.microprice()).alias("micro"), F.avg(X.imbalance(X.bidv1, X.askv1)).alias("imb1"), F.avg(X.imbalance(X.bidv2, X.askv2)).alias("imb2"),
        F.avg(X.smoothed_imbalance(X.bidv1 + X.bidv2, X.askv1 + X.askv2)).alias("imb_total"), F.avg(gap_ask).alias("ask_gap"),
        F.avg(gap_bid).alias("bid_gap"), F.avg(slope_ask).alias("ask_slope"), F.avg(slope_bid).alias("bid_slope"),
        stats.count_if(X.robust_quote()).alias("robust"), F.max(X.row_max(*volumes)).alias("depth_max"), F.min(X.row_min(*volumes)).alias("depth_min"),
        F.avg(X.clip(X.mid, 5, 20)).alias("clipped"), F.avg(X.safe_log_ratio(X.bidv1, X.askv2)).alias("log_ratio"),
        F.sum(F.bround(t, 0)).alias("half_even"), F.sum(X.time_bin(t, 10.0, 60, reverse=True)).alias("bin_sum"),
    )
    return present(out)


@register(
    "nearest_in_time",
    query(
        ["mk"],
        "SELECT sample_id, " + ", ".join(f"first(mid ORDER BY abs(t - {h}), t, seq DESC) AS mid_{h}" for h in (30, 120, 300)) + " FROM mk GROUP BY sample_id",
    ),
)
def nearest_in_time(spark, path):
    return present(joins.nearest_in_time(streams(spark, path).market, X.mid, {f"mid_{h}": h for h in (30, 120, 300)}))


@register(
    "asof_next_quote",
    query(
        ["mk", "od"],
        """SELECT e.sample_id, e.seq AS event_seq, q.t AS match_seconds, q.b1 AS bid_price_1 FROM od e LEFT JOIN LATERAL (SELECT * FROM mk WHERE
        mk.sample_id = e.sample_id AND mk.t <= e.t AND e.t - mk.t <= 3 ORDER BY mk.t DESC, mk.seq LIMIT 1) q ON TRUE""",
        keys=("sample_id", "event_seq"),
    ),
)
def asof_next_quote(spark, path):
    s = streams(spark, path)
    out = joins.asof_join(s.order, s.market, ["bid_price_1"], strict=False, tolerance=3.0, forward=False)
    return present(out.select("sample_id", "event_seq", "match_seconds", "bid_price_1"), ("sample_id", "event_seq"))


@register(
    "frame_alignment",
    query(
        ["pr"],
        """SELECT 0 AS k, count(*) FILTER (WHERE l = 1 AND r = 1) AS both, count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only
        FROM (SELECT sample_id, 1 AS l FROM pr WHERE sample_id % 10 <> 0) FULL JOIN (SELECT sample_id, 1 AS r FROM pr WHERE sample_id % 15 <> 0) USING (sample_id)""",
        keys=ONE,
    ),
)
def frame_alignment(spark, path):
    p = predictions(spark, path)
    return one_row(joins.alignment(p.filter("sample_id % 10 <> 0"), p.filter("sample_id % 15 <> 0"), ["sample_id"]))


@register(
    "rank_auc",
    query(
        ["pr"],
        "SELECT 0 AS k, (sum(r) FILTER (WHERE y) - (count(*) FILTER (WHERE y)) * (count(*) FILTER (WHERE y) + 1) / 2.0::DOUBLE) / ((count(*) FILTER (WHERE y)) * (count(*) FILTER (WHERE NOT y))) AS auc "
        f"FROM (SELECT target > 0 AS y, {average_rank_sql('s')} AS r FROM (SELECT target, round(pred_b * 20) AS s FROM pr))",
        keys=ONE,
    ),
)
def rank_auc(spark, path):
    p = predictions(spark, path).select(
        "sample_id", F.round(F.col("pred_b") * 20).alias("s"), (F.col("target") > 0).cast("int").alias("y")
    )
    return one_row(models.rank_auc(p, "s", "y"))


@register(
    "month_table",
    query(
        ["pr"],
        "SELECT month, avg(target) AS mean_target, avg(pred_b) AS pred_b_mean, avg(gap) AS gap_mean, stddev_pop(pred_b) AS pred_b_std, stddev_pop(gap) AS gap_std FROM ft GROUP BY month",
        keys=("month",),
        steps=[FT],
    ),
)
def month_table(spark, path):
    return present(blend.month_table(features(spark, path), ["pred_b", "gap"]), ("month",))


@register(
    "aggregate_forms",
    query(
        ["mk", "spine"],
        """SELECT sample_id, regr_slope(mid, t) AS slope, sum(mid * (bv1 - av1)) / greatest(sum((bv1 - av1) * (bv1 - av1)), 1e-12) AS origin,
        covar_pop(mid, bv1) / nullif(stddev_pop(mid) * stddev_pop(bv1), 0) AS corr, sum(mid * bv1) / sqrt(sum(mid * mid) * sum(bv1 * bv1)) AS inner_product,
        sum(mid * bv1) / sum(bv1) AS weighted, sum(bv1 * exp(-t / 60)) AS decayed, sum(bv1 * exp(-t / 60)) / sum(exp(-t / 60)) AS decayed_mean,
        first(mid ORDER BY t DESC, seq) AS first_mid, first(ap ORDER BY t, seq DESC) FILTER (WHERE ap IS NOT NULL) AS last_price FROM mk GROUP BY sample_id""",
    ),
)
def aggregate_forms(spark, path):
    t = X.seconds()
    rank = F.struct((-t).alias("t"), F.col(SEQ))
    flow_ = X.bidv1 - X.askv1
    price = X.col("transaction_avgprice")
    out = streams(spark, path).market.groupBy("sample_id").agg(
        stats.ols_slope(X.mid, t).alias("slope"), stats.origin_slope(X.mid, flow_).alias("origin"), stats.correlation(X.mid, X.bidv1).alias("corr"),
        stats.inner_product(X.mid, X.bidv1).alias("inner_product"), stats.weighted_mean(X.mid, X.bidv1).alias("weighted"),
        stats.decayed_sum(X.bidv1, t, 60).alias("decayed"), stats.decayed_mean(X.bidv1, t, 60).alias("decayed_mean"),
        stats.first_value(X.mid, rank).alias("first_mid"), stats.last_value(price, rank).alias("last_price"),
    )
    return present(out)


# sinks -------------------------------------------------------------------------------------------


@register(
    "pack_manifest",
    query(
        ["tx", "spine"],
        "SELECT 0 AS k, count(*) AS rows, count(DISTINCT sample_id) AS ids, 18 AS columns, 0 AS bad_values, 1 AS matches, (count(*) = 0)::INT AS change_unseen FROM spine",
        keys=ONE,
    ),
)
def pack_manifest(spark, path):
    s = streams(spark, path)
    pack = on_spine(s.spine, flow.trade_summary(s.transaction), fill=0.0)
    folder = f"{checkpoint_root(spark).rstrip('/')}/pack-{uuid.uuid4().hex}"
    kept = sinks.write_pack(pack, folder)
    read = sinks.read_pack(spark, folder, verify=False)
    # the kept fingerprint against the one of the rows in another order, and of a pack with one number changed
    now = contract.manifest(read.repartition(7, F.hash("sample_id")))
    last = read.agg(F.max("sample_id").alias("_last"))  # one row
    other = read.crossJoin(F.broadcast(last)).withColumn("tx_n", F.col("tx_n") + (F.col("sample_id") == F.col("_last")).cast("double")).drop("_last")
    other = contract.manifest(other).select(F.col("fingerprint").alias("changed"))
    same = lambda n: F.col(n).eqNullSafe(F.lit(kept.fingerprint).cast("long")).cast("int")
    out = now.crossJoin(F.broadcast(other)).withColumns({"matches": same("fingerprint"), "change_unseen": same("changed")})
    return one_row(out.drop("fingerprint", "changed"))


PREPARED = ("tx_n", "tx_vol", "tx_imb", "mk_nbars", "mk_imb1_mean", "ofi1", "ofi2")


@register(
    "prepared_dataset",
    query(
        ["mk", "tx", "od", "spine", "lab"],
        f"""SELECT sample_id, month, target * 1000 AS target, {', '.join(f'coalesce({n}, 0) AS {n}' for n in PREPARED)},
        (coalesce(tx_n, 0) = 0 AND coalesce(mk_nbars, 0) = 0)::INT AS nodata FROM {BASE_JOIN} JOIN lab USING (sample_id) LEFT JOIN
        (SELECT sample_id, sum(u1) AS ofi1, sum(u2) AS ofi2 FROM l GROUP BY sample_id) USING (sample_id)""",
        steps=base_steps("interval")
        + [f"l0 AS (SELECT *, {', '.join(f'lag({n}) {W} AS p{n}' for n in ('a1', 'b1', 'av1', 'bv1', 'a2', 'b2', 'av2', 'bv2'))} FROM mk)"]
        + [
            "l AS (SELECT *, "
            + ", ".join(
                f"""CASE WHEN pa{n} IS NOT NULL THEN (CASE WHEN b{n} > pb{n} THEN bv{n} WHEN b{n} < pb{n} THEN -pbv{n} ELSE bv{n} - pbv{n} END)
              - (CASE WHEN a{n} < pa{n} THEN av{n} WHEN a{n} > pa{n} THEN -pav{n} ELSE av{n} - pav{n} END) END AS u{n}"""
                for n in (1, 2)
            )
            + " FROM l0)"
        ],
    ),
)
def prepared_dataset(spark, path):
    s = streams(spark, path)
    base = book.base_features(s.market, s.transaction, s.order, s.spine)
    pack = quotes.simple_ofi(s.market, s.transaction, s.spine)
    wide = sinks.prepared(base, [pack], s.label, drop=("kyle_lambda", "ofi1_late"))
    return present(
        wide.select("sample_id", "month", (F.col("target") * 1000).alias("target"), *PREPARED, F.col("nodata").cast("int").alias("nodata"))
    )


@register(
    "submission_rows",
    query(["pr"], "SELECT sample_id, row_number() OVER (ORDER BY sample_id DESC) AS position, 1000 * pred_a AS target FROM pr"),
)
def submission_rows(spark, path):
    p = predictions(spark, path)
    last = p.agg(F.max("sample_id").alias("m"))
    # template in falling id order; ids of the table are 0 .. n-1
    template = p.crossJoin(F.broadcast(last)).select("sample_id", (F.col("m") - F.col("sample_id") + 1).alias("position"))
    out = sinks.submission(template, p.select("sample_id", (F.col("pred_a") * 1000).alias("target")))
    return present(out)


# streaming ---------------------------------------------------------------------------------------


@register(
    "stream_look_back",
    "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, event_type, count(*)::DOUBLE AS events, "
    "round(sum(value) + 1.23e-10, 6) + 0.0 AS value FROM events GROUP BY ALL",
)
def stream_look_back(spark, path):
    out = stream.stored(spark, path, lambda s, delay: stream.look_back(s, ["event_type"], "6 hours", delay=delay))
    return present(out.withColumn("start", F.unix_micros("start")), ("start", "event_type"))


@register(
    "stream_nested_windows",
    "SELECT epoch_us(s) AS start, count(*)::DOUBLE AS events, round(sum(value) + 1.23e-10, 6) + 0.0 AS value FROM "
    "(SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS s, value FROM events, range(4) r(k)) GROUP BY ALL",
)
def stream_nested_windows(spark, path):
    out = stream.stored(spark, path, lambda s, delay: stream.look_back(s, [], "24 hours", "6 hours", delay))
    return present(out.withColumn("start", F.unix_micros("start")), ("start",))


@register(
    "stream_complete_samples",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g),
    s AS (SELECT user_id, run, min(ts) AS start, max(ts) AS last_ts, count(*) AS n, sum(value) AS v FROM r GROUP BY ALL)
    SELECT user_id, epoch_us(start) AS start, epoch_us(last_ts) AS last_ts, n::DOUBLE AS events, round(v + 1.23e-10, 6) + 0.0 AS value FROM s""",
)
def stream_complete_samples(spark, path):
    out = stream.stored(spark, path, lambda s, delay: stream.complete_samples(s, "user_id", "2 hours", delay))
    micros = {n: F.unix_micros(n) for n in ("start", "last_ts")}
    return present(out.withColumns(micros), ("user_id", "start", "last_ts"))


@register(
    "stream_complete_keys",
    "SELECT l_orderkey, count(*)::DOUBLE AS lines, round(sum(l_quantity) + 1.23e-10, 6) + 0.0 AS quantity, epoch_us(max(l_shipdate)) AS last_ship FROM lineitem GROUP BY l_orderkey",
)
def stream_complete_keys(spark, path):
    sums = [F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.max(F.expr(stream.micros("l_shipdate"))).alias("last_ship")]
    return present(stream.stored_keys(spark, path, "lineitem", "l_orderkey", sums), ("l_orderkey", "last_ship"))


# models ------------------------------------------------------------------------------------------

MODEL_FEATURES = ["pred_a", "pred_b", "gap", "holey"]
TRAIN, SCORE = "month < 50", "month >= 50"


@register("model_boosted_trees")
def model_boosted_trees(spark, path):
    return present(models.boosted_trees(features(spark, path), MODEL_FEATURES, TRAIN, SCORE, depth=3, rounds=5))


@register("model_stopped_trees")
def model_stopped_trees(spark, path):
    out, _ = models.stopped_trees(features(spark, path), MODEL_FEATURES, "month < 40", "month >= 40 AND month < 50", SCORE, depth=3, rounds=8, patience=3)
    return present(out)


@register("model_random_forest")
def model_random_forest(spark, path):
    return present(models.random_forest(features(spark, path), MODEL_FEATURES, TRAIN, SCORE, trees=8, depth=4))


@register(
    "model_ridge",
    query(
        ["pr"],
        """SELECT sample_id, y + wa / sa * (pred_a - ma) + wb / sb * (pred_b - mb) AS prediction FROM pr, (SELECT *, ((n + 50) * ta - n * r * tb) / d AS wa,
        ((n + 50) * tb - n * r * ta) / d AS wb FROM (SELECT *, n * corr_a * sy AS ta, n * corr_b * sy AS tb, (n + 50) * (n + 50) - n * r * n * r AS d FROM
        (SELECT count(*)::DOUBLE AS n, avg(target) AS y, avg(pred_a) AS ma, avg(pred_b) AS mb, stddev_pop(pred_a) AS sa, stddev_pop(pred_b) AS sb, stddev_pop(target) AS sy,
        corr(pred_a, pred_b) AS r, corr(pred_a, target) AS corr_a, corr(pred_b, target) AS corr_b FROM pr WHERE month < 50))) WHERE month >= 50""",
    ),
)
def model_ridge(spark, path):
    return present(models.ridge(predictions(spark, path), ["pred_a", "pred_b"], TRAIN, SCORE, alpha=50.0))


@register("model_adversarial")
def model_adversarial(spark, path):
    f = features(spark, path)
    _, auc, gains = models.adversarial(f.filter(TRAIN), f.filter(SCORE), MODEL_FEATURES, rounds=3)
    rows = [("auc", float(auc)), *[(n, float(g)) for n, g in gains.items()]]
    return present(spark.createDataFrame(rows, "name string, value double"), ("name",))


@register("model_drop_shifted")
def model_drop_shifted(spark, path):
    f = features(spark, path)
    kept, history = models.drop_shifted(f.filter(TRAIN), f.filter(SCORE), MODEL_FEATURES, keep_auc=0.5)
    rows = [(n, float(n in kept)) for n in MODEL_FEATURES] + [(f"auc_{i}", float(auc)) for i, (auc, _) in enumerate(history)]
    return present(spark.createDataFrame(rows, "name string, value double"), ("name",))


@register("model_prune_by_gain")
def model_prune_by_gain(spark, path):
    gains = models.feature_gains(features(spark, path), MODEL_FEATURES, TRAIN, rounds=3)
    kept = drift.prune_by_gain(gains, 0.25)
    return present(spark.createDataFrame([(n, float(g), float(n in kept)) for n, g in gains.items()], "name string, gain double, kept double"), ("name",))


GAIN_FEATURES = {"pred_a": "pred_a", "pred_b": "pred_b", "product": "pred_a * pred_b", "distance": "abs(pred_a - pred_b)"}


@register(
    "prune_by_correlation_gain",
    query(
        ["pr"],
        "SELECT name, gain, row_number() OVER (ORDER BY gain, name) > 1 AS kept FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS name, abs(corr({e}, target)) AS gain FROM pr WHERE month < 50" for n, e in GAIN_FEATURES.items())
        + ")",
        keys=("name",),
    ),
)
def prune_by_correlation_gain(spark, path):
    """Pruning by a gain that SQL can state: the absolute correlation with the target on the training months."""
    names = list(GAIN_FEATURES)
    x = predictions(spark, path).filter(TRAIN).select("target", *[F.expr(e).alias(n) for n, e in GAIN_FEATURES.items()])
    _, _, cov = linear.moments(x, [*names, "target"])
    gains = {n: abs(float(cov[i, -1])) / float(cov[i, i] * cov[-1, -1]) ** 0.5 for i, n in enumerate(names)}
    kept = drift.prune_by_gain(gains, 0.25)
    return present(spark.createDataFrame([(n, g, float(n in kept)) for n, g in gains.items()], "name string, gain double, kept double"), ("name",))


@register("residual_codes")
def residual_codes(spark, path):
    out = models.residual_codes(predictions(spark, path), levels=2, size=4)
    return present(out.select("sample_id", "code_0", "code_1", "residual"))


@register(
    "pseudo_labels",
    query(
        ["pr"],
        """SELECT sample_id, 1000 * target AS target, 1 AS weight FROM pr WHERE month < 50 UNION ALL SELECT sample_id, 1000 * pred_a, 0.5 FROM pr
        WHERE month >= 50 AND abs(pred_a) >= (SELECT quantile_cont(abs(pred_a), 0.5) FROM pr WHERE month >= 50)""",
    ),
)
def pseudo_labels(spark, path):
    p = predictions(spark, path)
    scored = p.filter(SCORE).select("sample_id", F.col("pred_a").alias("prediction"))
    out = models.pseudo_labelled(p.filter(TRAIN).select("sample_id", "target"), scored)
    return present(out.select("sample_id", (F.col("target") * 1000).alias("target"), "weight"))
