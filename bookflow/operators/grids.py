"""Uniform time grids and bounded sequences, in long form: one row per (sample, step).

Once events are aggregated to a fixed number of bins a sample has a bounded number of rows, so
windows over a grid are plain per-sample windows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions.lazy import Columns
from ..functions.expr import EPS, at_least, clip, finite_or_zero, null_if_nan, seconds, time_bin
from ..functions.stats import count_if, sum0, sum_if
from ..schema import KEY, SEQ, TIME
from .assemble import derive, on_spine, summarise
from .book import widen
from .contract import coded
from .joins import densify
from .quantile import quantiles_of
from .timeline import Timeline

c = F.col
bar = Columns(
    price=lambda: null_if_nan(X.col("transaction_avgprice")),
    rel_spread=lambda: X.spread / at_least(X.mid, EPS),
)


def as_arrays(long, names, step="step"):
    """Long grid to one ordered array of structs per sample; a grid bounds the array length."""
    packed = F.array_sort(F.collect_list(F.struct(step, *names)))
    return long.groupBy(KEY).agg(packed.alias("sequence"))


# bars by position --------------------------------------------------------------------------------


def _bar_line(market):
    """Bars with predecessor values; the first bar of a sample is its own predecessor."""
    line = Timeline.of(market).select(
        SEQ, TIME, X.mid.alias("mid"), bar.price.alias("ap"), X.col("transaction_volume").alias("tv"),
        X.col("transaction_count").alias("tc"), bar.rel_spread.alias("relspread"),
        X.smoothed_imbalance(X.bidv1, X.askv1).alias("imb1"),
        X.smoothed_imbalance(X.bidv1 + X.bidv2, X.askv1 + X.askv2).alias("imb2"),
        (X.askv1 + X.bidv1).alias("depth"),
    )
    return line.previous(["mid", "ap", "depth"]).position()


def _move(x, prev):
    return F.coalesce(F.when(x.isNotNull() & prev.isNotNull(), F.log(at_least(x, EPS) / at_least(prev, EPS))), F.lit(0.0))


def every_third_bar(market, steps=60):
    """Every third bar from the start: 6 channels, steps 0 .. steps-1."""
    rows = _bar_line(market).rows.filter(((c("pos") - 1) % 3 == 0) & (c("pos") <= 3 * steps))
    return rows.select(
        KEY,
        ((c("pos") - 1) / 3).cast("int").alias("step"),
        _move(c("ap"), c("prev_ap")).alias("price_move"),
        F.log1p(at_least(c("tv"), 0)).alias("log_volume"),
        F.log1p(at_least(c("tc"), 0)).alias("log_count"),
        "relspread",
        "imb1",
        "imb2",
    )


def last_bars(market, steps=120):
    """The last `steps` bars, right-aligned: 8 channels of moves, volume, spread and depth change."""
    rows = _bar_line(market).key_total("n", F.lit(1)).rows
    dd = F.coalesce(c("depth") - c("prev_depth"), F.lit(0.0))
    step = steps - 1 - (c("n") - c("pos"))
    return rows.filter(c("n") - c("pos") < steps).select(
        KEY,
        step.cast("int").alias("step"),
        _move(c("mid"), c("prev_mid")).alias("mid_move"),
        _move(c("ap"), c("prev_ap")).alias("price_move"),
        F.log1p(at_least(c("tv"), 0)).alias("log_volume"),
        F.log1p(at_least(c("tc"), 0)).alias("log_count"),
        "relspread",
        "imb1",
        "imb2",
        (F.log1p(F.abs(dd)) * F.signum(dd)).alias("depth_move"),
    )


RAW_CHANNELS = (
    "transaction_avgprice", "transaction_volume", "transaction_count", "ask_price_1", "ask_volume_1",
    "bid_price_1", "bid_volume_1", "ask_price_2", "ask_volume_2", "bid_price_2", "bid_volume_2",
)


def channel_statistics(df, names=RAW_CHANNELS):
    """One row: mean and population deviation of each channel, ignoring missing values."""
    value = {n: null_if_nan(X.col(n)) for n in names}
    return df.agg(
        *[F.avg(v).alias(f"{n}_mean") for n, v in value.items()],
        *[F.stddev_pop(v).alias(f"{n}_std") for n, v in value.items()],
    )


def raw_sequence(market, fit_ids, steps=200):
    """The last `steps` bars, right-aligned, standardised by the bars of the fitting samples.

    11 value channels (missing becomes 0 after scaling), time share, trade flag and row mask.
    """
    stats = channel_statistics(market.join(fit_ids, KEY, "left_semi"))
    line = Timeline.of(market).position().key_total("n", F.lit(1))
    rows = line.rows.filter(c("n") - c("pos") < steps).crossJoin(F.broadcast(stats))  # one row
    scale = lambda n: F.when(c(f"{n}_std") > 0, c(f"{n}_std")).otherwise(1.0)
    return rows.select(
        KEY,
        (steps - 1 - (c("n") - c("pos"))).cast("int").alias("step"),
        *[
            F.coalesce((null_if_nan(X.col(n)) - c(f"{n}_mean")) / scale(n), F.lit(0.0)).alias(n)
            for n in RAW_CHANNELS
        ],
        (seconds() / 600.0).alias("time_share"),
        (c("transaction_count") > 0).cast("double").alias("has_trades"),
        F.lit(1.0).alias("row_mask"),
    )


def sequence_audit(market, label, steps=200):
    """Per month: sample count, cap rate, distribution of count, time range and trade share."""
    line = Timeline.of(market).position().key_total("n", F.lit(1)).previous([TIME])
    rows = line.rows.filter(c("n") - c("pos") < steps)
    backwards = X.col(TIME) > X.col(f"prev_{TIME}") + 1e-4 * 600.0
    s = summarise(
        rows,
        {
            "raw_count": F.max("n"), "kept_count": F.count(F.lit(1)), "earliest": F.max(seconds()), "latest": F.min(seconds()),
            "activity": F.avg((c("transaction_count") > 0).cast("double")), "backwards": count_if(backwards),
        },
    )
    s = label.select(KEY, "month").join(s, KEY, "left").na.fill(0, ["raw_count", "kept_count", "backwards"])
    s = s.withColumn("coverage", c("earliest") - c("latest"))
    exact = quantiles_of(
        s,
        {
            "kept_q50": (c("kept_count"), 0.5), "coverage_q10": (c("coverage"), 0.1), "coverage_q50": (c("coverage"), 0.5),
            "activity_q50": (c("activity"), 0.5),
        },
        ("month",),
    )
    counts = s.groupBy("month").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg((c("raw_count") >= steps).cast("double")).alias("cap_rate"),
        F.avg((c("raw_count") > steps).cast("double")).alias("truncated_rate"),
        count_if(c("raw_count") == 0).alias("empty"),
        F.sum("backwards").alias("order_violations"),
        F.avg("kept_count").alias("kept_mean"),
        F.stddev_pop("activity").alias("activity_std"),
    )
    return counts.join(exact, "month", "left")


# one-second grid of all three streams ------------------------------------------------------------

STEPS = 120
CHANNELS = (
    "mid_move", "relspread", "imb1", "micro", "ask_gap", "signed_log", "volume", "trades",
    "new_bid", "new_ask", "cancel_bid", "cancel_ask",
)


def second_grid(market, transaction, order, spine, steps=STEPS):
    """12 channels of quotes, trades and orders per second, step 0 oldest; empty steps are 0."""
    step = time_bin(seconds(), 1.0, steps, reverse=True).alias("step")
    recent = lambda df: df.filter(F.floor(seconds()) < steps)
    m = at_least(X.mid, EPS)
    line = Timeline.of(recent(market)).with_columns({"_m": m}).previous(["_m"])
    quotes = line.rows.groupBy(KEY, step).agg(
        sum0(F.log(c("_m") / c("prev__m"))).alias("mid_move"),
        F.avg(X.spread / m).alias("relspread"),
        F.avg(X.smoothed_imbalance(X.bidv1, X.askv1)).alias("imb1"),
        F.avg(X.microprice(1.0) / m - 1).alias("micro"),
        F.avg((X.ask2 - X.ask1) / m).alias("ask_gap"),
    )
    v = X.volume
    trades = recent(transaction).groupBy(KEY, step).agg(
        F.sum(X.side_sign * F.log1p(v)).alias("signed_log"),
        F.log1p(F.sum(v)).alias("volume"),
        F.log1p(F.count(F.lit(1))).alias("trades"),
    )
    orders = recent(order).groupBy(KEY, step).agg(
        F.log1p(sum_if(X.is_new & X.is_buy, v)).alias("new_bid"),
        F.log1p(sum_if(X.is_new & ~X.is_buy, v)).alias("new_ask"),
        F.log1p(sum_if(~X.is_new & X.is_buy, v)).alias("cancel_bid"),
        F.log1p(sum_if(~X.is_new & ~X.is_buy, v)).alias("cancel_ask"),
    )
    return densify(spine, steps, quotes, trades, orders, name="step", fill=0.0)


PAIRS = ((0, 5), (0, 2), (5, 2), (1, 6))
GRID_STATS = ("mean", "std", "min", "max", "q10", "q90", "last", "first", "drift", "last_std", "ac1", "ac5")


def grid_statistics(grid, channels=CHANNELS, steps=STEPS):
    """12 statistics of every channel over the steps and 4 channel correlations: 148 columns."""
    mean = {n: F.avg(n).over(Window.partitionBy(KEY)) for n in channels}
    dev = grid.select(KEY, "step", *channels, *[(c(n) - m).alias(f"d_{n}") for n, m in mean.items()])
    pair = lambda i, j: sum0(c(f"d_{channels[i]}") * c(f"d_{channels[j]}"))
    cross = dev.groupBy(KEY).agg(
        *[
            (pair(i, j) / (F.sqrt(pair(i, i) * pair(j, j)) + 1e-12)).alias(f"x23_corr_{i}_{j}")
            for i, j in PAIRS
        ]
    )
    stacked = dev.select(
        KEY,
        "step",
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("_b"), c(n).alias("x"), c(f"d_{n}").alias("d")) for i, n in enumerate(channels)]
            )
        ).alias("v"),
    ).select(KEY, "step", "v.*")
    w = Window.partitionBy(KEY, "_b").orderBy("step")  # one row per step
    x, d = c("x"), c("d")
    last, first = c("step") >= steps - 30, c("step") < 30
    den = F.sum(d * d) + 1e-12
    t = summarise(
        stacked.withColumns({"d1": F.lag("d", 1).over(w), "d5": F.lag("d", 5).over(w)}),
        {
            "mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x),
            "q10": F.percentile(x, F.lit(0.1)), "q90": F.percentile(x, F.lit(0.9)),
            "last": F.avg(F.when(last, x)), "first": F.avg(F.when(first, x)),
            "drift": F.avg(F.when(last, x)) - F.avg(F.when(first, x)), "last_std": F.stddev_pop(F.when(last, x)),
            "ac1": F.sum(d * c("d1")) / den, "ac5": F.sum(d * c("d5")) / den,
        },
        (KEY, "_b"),
    )
    wide = widen(t, range(len(channels)), lambda i, v: f"x23_{v}_c{i}")
    return wide.join(cross, KEY)


# multi-stream grid -------------------------------------------------------------------------------

GRID_EPS = 1e-6
MARKET_BINS, FLOW_BINS = 200, 60


def _bounded(x):
    """Non-finite to 0 and clipped to +-50, as every value is before it is summed."""
    return clip(finite_or_zero(x), -50, 50)


def market_grid(market, bins=MARKET_BINS):
    """11 quote channels averaged per 3-second bin (bin 0 oldest) with the row count."""
    b = time_bin(seconds(), 600.0 / bins, bins, reverse=True).alias("step")
    depth1 = X.askv1 + X.bidv1
    depth2 = depth1 + X.askv2 + X.bidv2
    m = X.mid + GRID_EPS
    micro = (X.ask1 * X.bidv1 + X.bid1 * X.askv1) / (depth1 + GRID_EPS)
    channels = {
        "mid_rel": X.mid - 1.0,
        "txpx_rel": bar.price - 1.0,
        "rel_spread1": X.spread / m,
        "rel_spread2": (X.ask2 - X.bid2) / m,
        "imb1": (X.bidv1 - X.askv1) / (depth1 + GRID_EPS),
        "imb2": (X.bidv1 + X.bidv2 - X.askv1 - X.askv2) / (depth2 + GRID_EPS),
        "micro_rel": micro / m - 1.0,
        "slope": ((X.ask2 - X.ask1) + (X.bid1 - X.bid2)) / m,
        "log_depth": F.log1p(depth2),
        "log_txv": F.log1p(X.col("transaction_volume")),
        "log_txc": F.log1p(X.col("transaction_count")),
    }
    return market.groupBy(KEY, b).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(_bounded(v)).alias(k) for k, v in channels.items()]
    )


def _price_shape(n):
    mean = c("_p") / n
    return mean - 1.0, F.sqrt(at_least(c("_p2") / n - mean * mean, 0))


def trade_grid(transaction, bins=FLOW_BINS):
    """7 trade channels per second (step 0 oldest) with the row count."""
    b = time_bin(seconds(), 60.0 / bins, bins, reverse=True).alias("step")
    p, v, g = X.price, X.volume, X.side_sign
    s = transaction.groupBy(KEY, b).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(_bounded(v)).alias("_v"), F.sum(_bounded(p * v)).alias("_a"),
        F.sum(_bounded(p)).alias("_p"), F.sum(_bounded(p * p)).alias("_p2"), F.sum(_bounded(g * v)).alias("_s"),
        count_if(X.is_buy).alias("_b"),
    )
    n = c("rows")
    mean, std = _price_shape(n)
    vwap = F.when(c("_v") > 0, c("_a") / (c("_v") + GRID_EPS)).otherwise(0.0)
    return s.select(
        KEY, "step", "rows", _bounded(vwap - 1.0).alias("vwap_rel"), _bounded(mean).alias("price_mean_rel"),
        _bounded(std).alias("price_std"), F.log1p("_v").alias("log_vol"), F.log1p(n).alias("log_count"),
        _bounded(c("_s") / (c("_v") + 1.0)).alias("signed_ratio"), (c("_b") / (n + 1.0)).alias("buy_trade_ratio"),
    )


def order_grid(order, bins=FLOW_BINS):
    """10 order channels per second (step 0 oldest) with the row count."""
    b = time_bin(seconds(), 60.0 / bins, bins, reverse=True).alias("step")
    p, v, g, a = X.price, X.volume, X.side_sign, X.action_sign
    sums = {"_v": v, "_p": p, "_p2": p * p, "_s": g * v, "_a": a * v, "_g": g * a * v}
    parts = {
        "_can": X.is_cancel, "_new": X.is_new, "_nb": X.is_new & X.is_buy, "_ns": X.is_new & X.is_sell,
        "_cb": X.is_cancel & X.is_buy, "_cs": X.is_cancel & X.is_sell,
    }
    s = order.groupBy(KEY, b).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(_bounded(x)).alias(k) for k, x in sums.items()],
        *[sum_if(cond, _bounded(v)).alias(k) for k, cond in parts.items()],
    )
    n, d = c("rows"), c("_v") + 1.0
    mean, std = _price_shape(n)
    return s.select(
        KEY, "step", "rows", _bounded(mean).alias("price_mean_rel"), _bounded(std).alias("price_std"),
        F.log1p("_v").alias("log_vol"), F.log1p(n).alias("log_count"), _bounded(c("_s") / d).alias("signed_ratio"),
        _bounded(c("_a") / d).alias("action_ratio"), _bounded(c("_g") / d).alias("pressure_ratio"),
        _bounded(c("_can") / d).alias("cancel_ratio"),
        _bounded((c("_nb") - c("_ns")) / (c("_new") + 1.0)).alias("new_imb"),
        _bounded((c("_cb") - c("_cs")) / (c("_can") + 1.0)).alias("cancel_imb"),
    )


# coarse fingerprints -----------------------------------------------------------------------------


def fingerprint(market, cells, width):
    """Mean price and volume per cell of `width` seconds; cell 0 holds everything up to 590 s."""
    cell = F.least(F.greatest(F.ceil((590.0 - seconds()) / width), F.lit(0)), F.lit(cells - 1)).cast("int")
    return market.groupBy(KEY, cell.alias("step")).agg(
        F.avg(bar.price).alias("price"), F.avg(X.col("transaction_volume")).alias("volume")
    )


def fingerprint_columns(market, spine, cells=60, width=10.0):
    """59 log-price differences and 60 log volumes per sample; unknown steps are 0."""
    g = densify(spine, cells, fingerprint(market, cells, width), name="step")
    w = Window.partitionBy(KEY).orderBy("step")  # one row per cell
    lp = F.log(at_least(c("price"), 1e-9))
    lp = F.when(c("price").isNotNull(), lp)
    g = g.select(
        KEY, c("step").alias("_b"), F.coalesce(lp - F.lag(lp).over(w), F.lit(0.0)).alias("dlp"),
        F.log1p(F.coalesce(c("volume"), F.lit(0.0))).alias("lv"),
    )
    wide = widen(g, range(cells), lambda i, v: f"fp_{v}_{i}")
    return wide.drop("fp_dlp_0")


# bounded event sequences -------------------------------------------------------------------------


def merged_events(events, is_order=False):
    """Events of one instant merged: volume, count and amount per category (side, then action)."""
    p, v, t = X.price, X.volume, seconds()
    action = F.col("order_action") if is_order else F.lit(0)
    category = (action * 2 + F.col("side")).cast("int")
    ok = (t >= 0) & (t <= 60) & (p > 0) & (v >= 0)
    aggs = {"raw": F.count(F.lit(1))}
    for k in range(4 if is_order else 2):
        aggs |= {f"v{k}": sum_if(category == k, v), f"n{k}": count_if(category == k), f"a{k}": sum_if(category == k, v * p)}
    events = coded(events, "side", "order_action") if is_order else coded(events, "side")
    return summarise(events.filter(ok), aggs, (KEY, TIME))


def event_sequence(events, limit, is_order=False):
    """The last `limit` distinct instants per sample, older ones folded into one prefix row.

    Per category log volume, log count and VWAP - 1; then log time step, time share and a
    prefix flag. Position 0 is the prefix where there is one.
    """
    kinds = range(4 if is_order else 2)
    t = X.col(TIME)
    by = -t
    line = Timeline.of(merged_events(events, is_order), by=by, order=(by,))
    line = line.position().key_total("total", F.lit(1)).previous([TIME])
    older = at_least(c("total") - limit, 0)
    rows = line.rows.withColumn("older", older.cast("long"))
    shift = F.when(c("older") > 0, 1).otherwise(0)

    def encoded(vwap_of):
        out = []
        for k in kinds:
            v = c(f"v{k}")
            vwap = F.when(v > 0, c(f"a{k}") / v).otherwise(1.0) - 1.0
            out += [
                clip(F.log1p(v), -20, 20).alias(f"log_volume_{k}"), clip(F.log1p(c(f"n{k}")), -20, 20).alias(f"log_count_{k}"),
                clip(vwap, -20, 20).alias(f"vwap_rel_{k}"),
            ]
        return out

    step_time = F.coalesce(at_least(X.col(f"prev_{TIME}") - t, 0), F.lit(0.0))
    recent = rows.filter(c("pos") > c("older")).select(
        KEY, (c("pos") - 1 - c("older") + shift).cast("int").alias("step"), *encoded(kinds),
        F.log1p(step_time).alias("log_gap"), (t / 60.0).alias("time_share"), F.lit(0.0).alias("is_prefix"),
    )
    names = [f"{x}{k}" for k in kinds for x in "vna"]
    folded = rows.filter(c("pos") <= c("older")).groupBy(KEY).agg(*[F.sum(n).alias(n) for n in names], F.avg(t).alias("_t"))
    prefix = folded.select(
        KEY, F.lit(0).alias("step"), *encoded(kinds), F.lit(0.0).alias("log_gap"), (c("_t") / 60.0).alias("time_share"),
        F.lit(1.0).alias("is_prefix"),
    )
    return recent.unionByName(prefix)


def event_coverage(events, limit):
    """Per sample: distinct instants, raw events, and what the last `limit` instants keep."""
    t = seconds()
    g = summarise(events.filter((t >= 0) & (t <= 60)), {"v": F.sum(X.volume), "raw": F.count(F.lit(1))}, (KEY, TIME))
    by = -X.col(TIME)
    line = Timeline.of(g, by=by, order=(by,)).position().key_total("total", F.lit(1))
    kept = c("pos") > c("total") - limit
    s = summarise(
        line.rows,
        {
            "unique_timestamps": F.count(F.lit(1)), "raw_events": F.sum("raw"), "v": F.sum("v"), "kv": sum_if(kept, c("v")),
            "hi": F.max(X.col(TIME)), "lo": F.min(X.col(TIME)), "khi": F.max(F.when(kept, X.col(TIME))),
        },
    )
    full, span = c("hi") - c("lo"), c("khi") - c("lo")
    return derive(
        s,
        {
            "unique_timestamps": c("unique_timestamps"),
            "raw_events": c("raw_events"),
            "kept_volume_share": F.when(c("v") > 0, c("kv") / c("v")).otherwise(1.0),
            "kept_span_seconds": span,
            "full_span_seconds": full,
            "span_share": F.when(full > 0, span / full).otherwise(1.0),
            "needs_prefix_summary": (c("unique_timestamps") > limit).cast("int"),
        },
    )


# secondly resampling -----------------------------------------------------------------------------


def resample_seconds(df, max_time=60, skip=(SEQ,)):
    """Every sample with every rounded second: integers summed, floats averaged, others first."""
    second = F.bround(seconds(), 0).cast("int")
    rows = df.withColumn("second", second).filter((c("second") >= 0) & (c("second") <= max_time))
    aggs = []
    for f in df.schema:
        if f.name in (KEY, TIME, *skip):
            continue
        if isinstance(f.dataType, T.IntegralType):
            aggs.append(F.sum(f.name).alias(f.name))
        elif isinstance(f.dataType, T.FractionalType):
            aggs.append(F.avg(f.name).alias(f.name))
        else:
            aggs.append(F.first(f.name).alias(f.name))
    cells = rows.groupBy(KEY, "second").agg(*aggs, F.count(F.lit(1)).alias("row_count"))
    return densify(rows.select(KEY).distinct(), max_time + 1, cells, name="second")


# families on grids -------------------------------------------------------------------------------

LAG_BINS = 20


def stream_lags(market, transaction, order, spine):
    """16 columns: how trade, order and OFI signals line up with returns 0-2 bins later."""
    b = time_bin(seconds(), 3.0, LAG_BINS, reverse=True).alias("bin")
    recent = lambda df: df.filter((seconds() >= 0) & (seconds() < 60))
    last = F.struct((-seconds()).alias("t"), c(SEQ))
    quote = F.struct(X.ask1.alias("a"), X.bid1.alias("b"), X.askv1.alias("av"), X.bidv1.alias("bv"))
    quotes = recent(market).groupBy(KEY, b).agg(F.max_by(quote, last).alias("q"))
    v = X.volume
    trades = recent(transaction).groupBy(KEY, b).agg(F.sum(X.signed_volume).alias("ts"), F.sum(v).alias("tv"))
    orders = recent(order).groupBy(KEY, b).agg(
        F.sum(X.signed_volume * X.action_sign).alias("os"), F.sum(v).alias("ov")
    )
    g = densify(spine, LAG_BINS, quotes, trades, orders).na.fill(0.0, ["ts", "tv", "os", "ov"])
    w = Window.partitionBy(KEY).orderBy("bin")  # LAG_BINS rows per sample
    g = g.withColumn("q", F.last("q", True).over(w))
    g = g.withColumn("p", F.lag("q").over(w))
    valid = lambda q: (c(f"{q}.a") > 0) & (c(f"{q}.b") > 0) & (c(f"{q}.a") >= c(f"{q}.b"))
    mid = lambda q: (c(f"{q}.a") + c(f"{q}.b")) * 0.5
    depth = lambda q: F.when(valid(q), c(f"{q}.av") + c(f"{q}.bv")).otherwise(0.0)
    both = valid("q") & valid("p")
    ret = F.when(both, clip((mid("q") - mid("p")) / at_least(c("p.a") - c("p.b"), 1e-8), -5, 5)).otherwise(0.0)
    zero = F.lit(0.0)
    ofi = (
        F.when(c("q.b") >= c("p.b"), c("q.bv")).otherwise(zero)
        - F.when(c("q.b") <= c("p.b"), c("p.bv")).otherwise(zero)
        - F.when(c("q.a") <= c("p.a"), c("q.av")).otherwise(zero)
        + F.when(c("q.a") >= c("p.a"), c("p.av")).otherwise(zero)
    )
    share = lambda s, gross: clip(s / at_least(depth("q") + gross, 1), -5, 5)
    g = g.select(
        KEY, "bin", ret.alias("r"), share(c("ts"), c("tv")).alias("trade"), share(c("os"), c("ov")).alias("order"),
        F.when(both, clip(ofi / at_least(depth("q") + depth("p"), 1), -5, 5)).otherwise(0.0).alias("ofi"),
    )
    ahead = {f"r{k}": F.lead("r", k).over(w) for k in (1, 2)} | {f"o{k}": F.lead("order", k).over(w) for k in (1, 2)}
    g = g.withColumns(ahead | {"r0": c("r")})

    def inner(x, y):
        used = y.isNotNull()
        xx, yy = F.sum(F.when(used, x * x)), F.sum(y * y)
        den = F.sqrt(xx * yy)
        return F.when(den > 1e-8, F.sum(x * y) / den).otherwise(0.0)

    out = {}
    for s in ("trade", "order", "ofi"):
        for k in (0, 1, 2):
            out[f"lag_{s}_return_{k}bin"] = inner(c(s), c(f"r{k}"))
        xx = F.sum(F.when(c("r1").isNotNull(), c(s) * c(s)))
        out[f"lag_{s}_next_return_slope"] = F.sum(c(s) * c("r1")) / (xx + 0.01)
    pressure = c("trade") + c("order") + c("ofi")
    for name, side, stuck in (("buy_no_rise", 1, c("r1") <= 0), ("sell_no_fall", -1, c("r1") >= 0)):
        push = F.when(c("r1").isNotNull(), at_least(side * pressure, 0))
        out[f"lag_{name}_share"] = sum_if(stuck, push) / at_least(F.sum(push), 1e-8)
    for k in (1, 2):
        out[f"lag_trade_order_replenish_{k}bin"] = inner(c("trade"), -c(f"o{k}"))
    return summarise(g, out)


SPECTRUM = ("low", "middle", "high", "entropy", "dominant", "ratio_2", "ratio_5", "ratio_10")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def path_spectrum(series: pd.Series) -> pd.Series:
    """SPECTRUM values of equal-length return paths, a batch of paths at a time.

    Energy shares of low, middle and high frequencies, entropy and peak of the power spectrum, and
    variance of sums of 2, 5 and 10 returns against as many single ones.
    """
    r = np.stack(series.to_numpy()).astype(float)
    n = r.shape[1]
    single = r.var(axis=1)
    energy = np.square(np.abs(np.fft.rfft(r - r.mean(axis=1, keepdims=True), axis=1)))[:, 1:]
    upto = energy.cumsum(axis=1)
    flat = upto[:, -1] <= 1e-16
    upto /= np.where(flat, np.inf, upto[:, -1])[:, None]  # all zero for a flat path
    share = np.diff(upto, axis=1, prepend=0.0)
    low, both = upto[:, 3], upto[:, 15]
    entropy = -np.sum(share * np.log(share + 1e-20), axis=1) / np.log(share.shape[1])
    columns = [low, both - low, upto[:, -1] - both, entropy, (energy.argmax(axis=1) + 1) / share.shape[1]]
    # sums of h returns are steps of the path, counted back from its end
    path = np.cumsum(np.c_[np.zeros(len(r)), r], axis=1)
    for h in (2, 5, 10):
        steps = np.diff(path[:, n % h :: h], axis=1).var(axis=1)
        columns.append(np.clip(np.divide(steps, h * single, out=np.zeros(len(r)), where=h * single > 1e-16), 0, 10))
    return pd.Series(list(np.column_stack(columns)))


def _lag_corr(x, y):
    used = y.isNotNull() & x.isNotNull()
    xv, yv = F.when(used, x), F.when(used, y)
    n = F.count(yv)
    den = n * F.sqrt(F.var_pop(xv) * F.var_pop(yv))
    return F.when(den > 1e-16, n * F.covar_pop(xv, yv) / den).otherwise(0.0)


def path_shape(market, spine):
    """24 columns: memory, variance ratios, spectrum, efficiency, jumps and drawdown of the mid
    path on the 200-bin grid."""
    g = densify(spine, MARKET_BINS, market_grid(market).select(KEY, "step", "mid_rel"), name="step")
    w = Window.partitionBy(KEY).orderBy("step")  # MARKET_BINS rows per sample
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = F.when(c("mid_rel") > -0.9, c("mid_rel"))
    x = F.coalesce(F.last(x, True).over(w), F.first(x, True).over(rest))
    g = g.select(KEY, "step", F.log1p(clip(x, -0.9, 10)).alias("lm")).filter(c("lm").isNotNull())
    g = g.select(
        KEY, "step", "lm", (c("lm") - F.lag("lm").over(w)).alias("r"), (F.max("lm").over(w) - c("lm")).alias("down"),
        (c("lm") - F.min("lm").over(w)).alias("up"),
    )
    g = g.withColumns({f"r{k}": F.lag("r", k).over(w) for k in (1, 2, 5, 10)})
    last60, last20 = c("step") >= MARKET_BINS - 60, c("step") >= MARKET_BINS - 20
    r = c("r")
    in60 = lambda k: last60 & (c("step") - k >= MARKET_BINS - 60)
    aggs = {f"mid_return_autocorr_{k}_full": _lag_corr(c(f"r{k}"), r) for k in (1, 2, 5, 10)}
    aggs |= {f"mid_return_autocorr_{k}_60": _lag_corr(F.when(in60(k), c(f"r{k}")), r) for k in (1, 2, 5)}
    s, ps = F.signum(r), F.signum(c("r1"))
    pair = (s != 0) & (ps != 0)
    moved, moved1 = sum0(F.abs(r)), sum0(F.when(c("r1").isNotNull(), F.abs(r)))
    sq = lambda cond: F.sqrt(sum_if(cond, r * r))
    safe = lambda n, d: F.when(d > 1e-16, n / d).otherwise(0.0)
    pairs = count_if(pair)
    aggs |= {
        "mid_path_efficiency_full": safe(F.abs(sum0(r)), moved),
        "mid_path_efficiency_60": safe(F.abs(sum_if(last60, r)), sum_if(last60, F.abs(r))),
        "mid_sign_persistence": F.when(pairs > 0, sum_if(pair, s * ps) / pairs).otherwise(0.0),
        "mid_reversal_magnitude_fraction": safe(sum_if(pair & (s * ps < 0), F.abs(r)), moved1),
        "moved": moved,
        "mid_max_drawdown_log": F.max("down"),
        "mid_max_runup_log": F.max("up"),
        "mid_rv_ratio_20_to_60": safe(sq(last20), sq(last60)),
        "mid_rv_ratio_60_to_full": safe(sq(last60), sq(r.isNotNull())),
        "series": F.transform(
            F.array_sort(F.collect_list(F.when(r.isNotNull(), F.struct("step", "r")))), lambda v: v["r"]
        ),
    }
    t = summarise(g, aggs).withColumn("s", path_spectrum("series"))
    at = {n: F.element_at("s", i + 1) for i, n in enumerate(SPECTRUM)}
    largest = F.slice(F.sort_array(F.transform("series", F.abs), asc=False), 1, 5)
    out = {n: c(n) for n in aggs if n not in ("series", "moved")}
    out["mid_jump_concentration_top5"] = safe(F.aggregate(largest, F.lit(0.0), lambda a, v: a + v), c("moved"))
    out |= {f"mid_variance_ratio_{h}": at[f"ratio_{h}"] for h in (2, 5, 10)}
    out |= {
        "mid_spectral_low_fraction": at["low"],
        "mid_spectral_mid_fraction": at["middle"],
        "mid_spectral_high_fraction": at["high"],
        "mid_spectral_entropy": at["entropy"],
        "mid_dominant_frequency": at["dominant"],
    }
    return on_spine(spine, derive(t, out), fill=0.0)
