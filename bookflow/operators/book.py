"""Quote-book families without row order.

Bucketed families aggregate per (sample, bucket) first, derive the per-bucket values once, and
then turn buckets into columns; both steps combine map-side. A missing trade price is ignored.
"""

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.lazy import Columns
from ..functions.expr import at_least, bucket, ratio, seconds
from ..functions.stats import moment_std, ols_slope, sum_if
from ..schema import KEY, SEQ
from .assemble import derive, on_spine, summarise
from .flow import COARSE_EDGES, order_summary, trade_summary
from .quantile import quantiles_of
from .timeline import Timeline

c = F.col
bar = Columns(
    price=lambda: X.null_if_nan(X.col("transaction_avgprice")),
    volume=lambda: X.col("transaction_volume"),
    count=lambda: X.col("transaction_count"),
    rel_spread=lambda: X.spread / at_least(X.mid, 1e-9),
    imb1=lambda: X.smoothed_imbalance(X.bidv1, X.askv1),
    imb2=lambda: X.smoothed_imbalance(X.bidv1 + X.bidv2, X.askv1 + X.askv2),
)

# Bucket edges and look-back horizons in seconds.
FINE_EDGES = (30.0, 90.0, 180.0, 300.0, 450.0)
EARLY_EDGES = (10.0, 30.0)
LEVEL_EDGES = (10.0, 30.0, 60.0, 300.0)
HORIZONS = (30, 60, 120, 300)


def per_bucket(df, b, aggs, values):
    """Aggregate per (sample, bucket), then derive per-bucket values from the aggregates."""
    keys = (KEY, "_b")
    return derive(summarise(df.withColumn("_b", b), aggs, keys), values, keys)


def widen(t, buckets, name):
    """Buckets to columns; name(bucket, value name) gives the column name."""
    values = [n for n in t.columns if n not in (KEY, "_b")]
    return t.groupBy(KEY).agg(
        *[F.max(F.when(c("_b") == b, c(v))).alias(name(i, v)) for i, b in enumerate(buckets) for v in values]
    )


def chronological(seq=SEQ):
    return F.struct((-seconds()).alias("t"), c(seq).alias("s"))


def market_summary(market, volume_reading="interval"):
    """Quote part (29 columns) of the base family.

    volume_reading: bars carry the volume of their interval, or a running total ("cumulative").
    """
    t = seconds()
    now = chronological()
    quote = F.struct(
        bar.price.alias("ap"), bar.volume.alias("tv"), bar.count.alias("tc"), X.mid.alias("mid"),
        bar.rel_spread.alias("rs"), bar.imb1.alias("i1"), bar.imb2.alias("i2"),
    )
    aggs = {
        "last": F.max_by(quote, now),
        "first_ap": F.max_by(bar.price, F.struct(t, c(SEQ))),
        "n": F.count(F.lit(1)).cast("double"),
        "mx_v": F.max(bar.volume),
        "mx_c": F.max(bar.count),
        "sum_v": F.sum(bar.volume),
        "sum_c": F.sum(bar.count),
        "v_60": sum_if(t <= 60, bar.volume),
        "v_300": sum_if((t > 60) & (t <= 300), bar.volume),
        "slope_px": _masked_slope(bar.price, t),
        "n_px": F.count(bar.price),
        "s_px": F.sum(bar.price),
        "s_px2": F.sum(bar.price * bar.price),
        "slope_mid": ols_slope(X.mid, t),
        "m_mid": F.avg(X.mid),
        "m_mid2": F.avg(X.mid * X.mid),
        "m_spread": F.avg(X.spread),
        "m_rel": F.avg(bar.rel_spread),
        "m_i1": F.avg(bar.imb1),
        "m_i2": F.avg(bar.imb2),
    }
    at = {h: F.struct(-F.abs(t - h), -t, c(SEQ)) for h in HORIZONS}
    for h in HORIZONS:
        aggs[f"at{h}"] = F.max_by(quote, at[h])
    back = lambda a, b: F.when(b > 0, a / at_least(b, 1e-9) - 1).otherwise(0.0)
    last = lambda f: c(f"last.{f}")
    if volume_reading == "cumulative":
        v60 = last("tv") - c("at60.tv")
        v300 = c("at60.tv") - c("at300.tv")
        volumes, counts = c("mx_v"), c("mx_c")
    else:
        v60, v300, volumes, counts = c("v_60"), c("v_300"), c("sum_v"), c("sum_c")
    m_px = c("s_px") / c("n_px")
    out = {
        "mk_spread": last("rs"),
        "mk_imb1": last("i1"),
        "mk_imb2": last("i2"),
        "mk_ret10m": back(last("ap"), c("first_ap")),
        "mk_vol": last("tv"),
        "mk_cnt": last("tc"),
        "mk_avgpx_dev": back(last("ap"), last("mid")),
        "mk_vol_last60": v60,
        "mk_vol_60_300": v300,
        "mk_vol_accel": (v60 / 60) / (at_least(v300, 0) / 240 + 1),
        "mk_vol_total": volumes,
        "mk_cnt_total": counts,
        "mk_nbars": c("n"),
        "mk_slope_px": c("slope_px"),
        "mk_px_vol": moment_std(c("s_px"), c("s_px2"), c("n_px")) / at_least(m_px, 1e-9),
        "mk_slope_mid": c("slope_mid"),
        "mk_mid_vol": F.sqrt(at_least(c("m_mid2") - c("m_mid") * c("m_mid"), 0)) / at_least(c("m_mid"), 1e-9),
        "mk_spread_mean": c("m_spread") / at_least(c("m_mid"), 1e-9),
        "mk_relspread_mean": c("m_rel"),
        "mk_imb1_mean": c("m_i1"),
        "mk_imb2_mean": c("m_i2"),
    }
    for h in HORIZONS:
        out[f"mk_ret{h}"] = back(last("ap"), c(f"at{h}.ap"))
        out[f"mk_midret{h}"] = back(last("mid"), c(f"at{h}.mid"))
    return derive(summarise(market, aggs), out)


def _masked_slope(y, x):
    """OLS slope over rows where y is known."""
    xk = F.when(y.isNotNull(), x)
    mx, my = F.avg(xk), F.avg(y)
    return (F.avg(x * y) - mx * my) / at_least(F.avg(xk * xk) - mx * mx, 1e-9)


def base_features(market, transaction, order, spine, volume_reading="interval"):
    """The 58-column base family: 18 trade, 11 order and 29 quote columns."""
    parts = trade_summary(transaction), order_summary(order), market_summary(market, volume_reading)
    return on_spine(spine, *parts, fill=0.0)


def base_interactions(base):
    """20 window differences and cross-stream products of the base family."""
    g = c
    return derive(
        base,
        {
            "d_tx_imb_15_30": g("tx_imb15") - g("tx_imb30"),
            "d_tx_ret_15_30": g("tx_ret15") - g("tx_ret30"),
            "d_ret_30_60": g("mk_ret30") - g("mk_ret60"),
            "d_ret_60_300": g("mk_ret60") - g("mk_ret300"),
            "d_midret_30_60": g("mk_midret30") - g("mk_midret60"),
            "d_midret_60_300": g("mk_midret60") - g("mk_midret300"),
            "d_volfrac_15_30": g("tx_vol15_frac") - g("tx_vol30_frac"),
            "d_ord_new_imb_30": g("ord_new_imb30") - g("ord_new_imb"),
            "d_ord_net_imb_30": g("ord_net_imb30") - g("ord_net_imb"),
            "x_tximb_mimb1": g("tx_imb") * g("mk_imb1"),
            "x_tximb30_mimb1mean": g("tx_imb30") * g("mk_imb1_mean"),
            "x_ordnew_mimb1": g("ord_new_imb") * g("mk_imb1"),
            "x_ordnet_mimb1": g("ord_net_imb") * g("mk_imb1"),
            "x_vwapdev_mimb": g("tx_vwap_dev") * g("mk_imb1"),
            "x_spread_imb": g("mk_spread") * g("mk_imb1"),
            "x_relspread_imbmean": g("mk_relspread_mean") * g("mk_imb1_mean"),
            "x_netflow_pressure": g("tx_imb") + g("ord_net_imb"),
            "x_t_minus_o": g("tx_imb") - g("ord_net_imb"),
            "x_new_minus_cancel": g("ord_new_imb") - g("ord_cancel_ratio"),
            "x_midvol_tximb": g("mk_mid_vol") * g("tx_imb"),
        },
    )


def book_buckets(market, spine, edges=COARSE_EDGES, prefix="b", endpoint_return=False):
    """Price slope and spread, imbalance, microprice and size statistics per time bucket."""
    t = seconds()
    micro = X.microprice(1.0) / at_least(X.mid, 1e-9) - 1
    aggs = {
        "n": F.count(F.lit(1)),
        "slope": _masked_slope(bar.price, t),
        "np": F.count(bar.price),
        "sp": F.sum(bar.price),
        "sp2": F.sum(bar.price * bar.price),
        "spread": F.avg(X.spread),
        "relspread": F.avg(bar.rel_spread),
        "imb1": F.avg(bar.imb1),
        "imb2": F.avg(bar.imb2),
        "micro": F.avg(micro),
        "maxtv": F.max(bar.volume),
        "first_p": F.min_by(bar.price, F.when(bar.price.isNotNull(), F.struct(-t, c(SEQ)))),
        "last_p": F.min_by(bar.price, F.when(bar.price.isNotNull(), F.struct(t, c(SEQ)))),
    }
    values = {k: c(k) for k in ("n", "spread", "relspread", "imb1", "imb2", "micro", "maxtv", "slope")}
    values["pstd"] = moment_std(c("sp"), c("sp2"), c("np")) / at_least(F.abs(c("sp") / c("np")), 1e-9)
    if endpoint_return:
        values["ret"] = (c("last_p") - c("first_p")) / at_least(c("first_p"), 1e-9)
    buckets = range(len(edges) + 1)
    wide = widen(per_bucket(market, bucket(t, edges), aggs, values), buckets, lambda i, v: f"{prefix}{i}_{v}")
    wide = on_spine(spine, wide, fill=0.0)
    n_all = at_least(X.total([c(f"{prefix}{i}_n") for i in buckets]), 1)
    share = {f"{prefix}{i}_barfrac": c(f"{prefix}{i}_n") / n_all for i in buckets}
    return wide.withColumns(share).drop(*[f"{prefix}{i}_n" for i in buckets])


def range_buckets(market, spine, edges=COARSE_EDGES):
    """High-low range, volume range and time span per bucket; last gap and span of the sample."""
    t = seconds()
    aggs = {
        "hi": F.max(bar.price), "lo": F.min(bar.price), "m": F.avg(bar.price),
        "vhi": F.max(bar.volume), "vlo": F.min(bar.volume), "thi": F.max(t), "tlo": F.min(t),
    }
    values = {
        "hlrange": (c("hi") - c("lo")) / at_least(c("m"), 1e-9),
        "tvrange": at_least(c("vhi") - c("vlo"), 0),
        "sbpspan": at_least(c("thi") - c("tlo"), 0),
        "tlo": c("tlo"),
        "thi": c("thi"),
    }
    n = len(edges) + 1
    w = widen(per_bucket(market, bucket(t, edges), aggs, values), range(n), lambda i, v: f"r{i}_{v}")
    near = F.least(*[c(f"r{i}_tlo") for i in range(n)])
    far = F.greatest(*[c(f"r{i}_thi") for i in range(n)])
    w = w.withColumns({"r_gap_to_predict": near, "r_total_span": far - near})
    return on_spine(spine, w.drop(*[f"r{i}_{k}" for i in range(n) for k in ("tlo", "thi")]), fill=0.0)


def level_gap_buckets(market, spine, edges=COARSE_EDGES):
    """Distance and volume share between the two book levels per bucket."""
    gap_ask, gap_bid = X.level_gaps()
    l1, l2 = X.askv1 + X.bidv1, X.askv2 + X.bidv2
    depth = at_least(l1 + l2, 1e-9)
    aggs = {
        "askgap": F.avg(gap_ask), "bidgap": F.avg(gap_bid),
        "l1vshare": F.avg(l1 / depth), "l12volgap": F.avg((l1 - l2) / depth),
    }
    t = per_bucket(market, bucket(seconds(), edges), aggs, {k: c(k) for k in aggs})
    return on_spine(spine, widen(t, range(len(edges) + 1), lambda i, v: f"s{i}_{v}"), fill=0.0)


def _quote_means(masked):
    """Per-bucket quote aggregates; masked drops rows with an empty level from price terms."""
    m = at_least(X.mid, 1e-9)
    keep = (lambda x: F.when(X.has_quote, x)) if masked else (lambda x: x)

    def side_gap(gap, both_levels):
        if not masked:
            return gap / m
        return F.when(both_levels, gap / F.when(X.has_quote, m).otherwise(1.0))

    return {
        "n": F.count(F.lit(1)),
        "nv": F.count(keep(F.lit(1))),
        "micro": F.sum(keep(X.microprice(1e-9))),
        "mid": F.sum(keep(X.mid)),
        "spread": F.avg(keep(X.spread / m)),
        "imb": F.avg(X.imbalance(X.bidv1, X.askv1, 1e-9)),
        "sla": F.avg(side_gap(X.ask2 - X.ask1, (X.ask1 > 0) & (X.ask2 > 0))),
        "slb": F.avg(side_gap(X.bid1 - X.bid2, (X.bid1 > 0) & (X.bid2 > 0))),
    }


def _flow_sums(transaction, order, edges):
    """Signed trade sums and new/cancel volume per side, per (sample, bucket)."""
    b = bucket(seconds(), edges)
    trades = {
        "tsv": F.sum(X.signed_volume), "tamt": F.sum(X.signed_amount), "tv": F.sum(X.volume),
    }
    orders = {
        "nb": sum_if(X.is_new & X.is_buy, X.volume), "ns": sum_if(X.is_new & ~X.is_buy, X.volume),
        "cb": sum_if(~X.is_new & X.is_buy, X.volume), "cs": sum_if(~X.is_new & ~X.is_buy, X.volume),
    }
    keys = (KEY, "_b")
    return (
        summarise(transaction.withColumn("_b", b), trades, keys),
        summarise(order.withColumn("_b", b), orders, keys),
    )


def _bucket_table(market, transaction, order, edges, masked):
    b = bucket(seconds(), edges)
    quotes = summarise(market.withColumn("_b", b), _quote_means(masked), (KEY, "_b"))
    trades, orders = _flow_sums(transaction, order, edges)
    keys = [KEY, "_b"]
    return quotes.join(trades, keys, "full_outer").join(orders, keys, "full_outer").na.fill(0.0)


def early_flow(market, transaction, order, spine, masked=False):
    """30 columns: quote, trade and order pressure in three early buckets.

    The signed amount is in units of the mean mid, and 0 in a bucket without a quote.
    """
    t = _bucket_table(market, transaction, order, EARLY_EDGES, masked)
    mid = c("mid") / at_least(c("nv"), 1)
    values = {
        "m_micro_dev": F.when(c("nv") > 0, c("micro") / at_least(c("mid"), 1e-9) - 1).otherwise(0.0),
        "m_spread": c("spread"),
        "m_imb1": c("imb"),
        "t_signvol": c("tsv"),
        "t_signvol_frac": c("tsv") / at_least(c("tv"), 1e-9),
        "t_signamt": F.when(c("nv") > 0, c("tamt") / at_least(mid, 1e-9)).otherwise(0.0),
        "t_vol": c("tv"),
        "o_newpress": c("nb") - c("ns"),
        "o_canimb": (c("cs") - c("cb")) / at_least(c("cs") + c("cb"), 1e-9),
        "o_netplace": (c("nb") + c("ns")) - (c("cb") + c("cs")),
    }
    wide = widen(
        derive(t, values, (KEY, "_b")), range(3), lambda i, v: f"x21_{v[0]}{i}_{v[2:]}"
    )
    return on_spine(spine, wide, fill=0.0)


def level_flow(market, transaction, order, spine, masked=False):
    """27 columns: level slopes, signed flow and placement in three early buckets, and deltas."""
    t = _bucket_table(market, transaction, order, LEVEL_EDGES, masked)
    values = {
        "sla": c("sla"),
        "slb": c("slb"),
        "sv": c("tsv"),
        "svXimb": c("tsv") * c("imb"),
        "cnrb": c("cb") / at_least(c("nb"), 1e-9),
        "cnrs": c("cs") / at_least(c("ns"), 1e-9),
        "net": (c("nb") - c("cb")) - (c("ns") - c("cs")),
    }
    extra = {
        "imb": c("imb"),
        "spr": c("spread"),
        "mic": F.when(c("nv") > 0, c("micro") / at_least(c("mid"), 1e-9) - 1).otherwise(0.0),
    }
    wide = widen(derive(t, values | extra, (KEY, "_b")), range(5), lambda i, v: f"{v}{i}")
    wide = on_spine(spine, wide, fill=0.0)
    out = {f"x22_{v}{i}": c(f"{v}{i}") for i in range(3) for v in values}
    out |= {
        "x22_d_sv_01": c("sv0") - c("sv1"),
        "x22_d_sv_12": c("sv1") - c("sv2"),
        "x22_d_imb_02": c("imb0") - c("imb2"),
        "x22_d_imb_0L": c("imb0") - c("imb4"),
        "x22_d_spr_0L": c("spr0") - c("spr4"),
        "x22_d_mic_0L": c("mic0") - c("mic4"),
    }
    return derive(wide, out)


# market tables -----------------------------------------------------------------------------------


def _first(x, cond=None):
    rank = F.struct(-seconds(), c(SEQ))
    keep = x.isNotNull() if cond is None else cond & x.isNotNull()
    return F.min_by(x, F.when(keep, rank))


def _last(x, cond=None):
    rank = F.struct(-seconds(), c(SEQ))
    keep = x.isNotNull() if cond is None else cond & x.isNotNull()
    return F.max_by(x, F.when(keep, rank))


def _level_aggs(level, recent):
    out = {}
    for side in ("ask", "bid"):
        p, v = X.col(f"{side}_price_{level}"), X.col(f"{side}_volume_{level}")
        pn, vn = f"{side}_price_{level}", f"{side}_volume_{level}"
        out |= {
            f"{pn}_mean": F.avg(p),
            f"{pn}_std": F.stddev_samp(p),
            f"{pn}_min": F.min(p),
            f"{pn}_max": F.max(p),
            f"{pn}_first": _first(p),
            f"{pn}_last": _last(p),
            f"{vn}_sum": F.sum(v),
            f"{vn}_mean": F.avg(v),
            f"{vn}_max": F.max(v),
            f"last60_{pn}_mean": F.avg(F.when(recent, p)),
            f"last60_{pn}_std": F.stddev_samp(F.when(recent, p)),
            f"last60_{pn}_start": _first(p, recent),
            f"last60_{pn}_end": _last(p, recent),
            f"last60_{vn}_mean": F.avg(F.when(recent, v)),
        }
    return out


def _level_derived(level):
    a, b = f"ask_price_{level}", f"bid_price_{level}"
    av, bv = f"ask_volume_{level}", f"bid_volume_{level}"
    change = lambda p, last, first: (
        c(f"{p}{a}_{last}") + c(f"{p}{b}_{last}") - c(f"{p}{a}_{first}") - c(f"{p}{b}_{first}")
    ) / 2.0
    imbalance = lambda x, y: F.when(x + y != 0, (x - y) / (x + y))
    return {
        f"spread_{level}_mean": c(f"{a}_mean") - c(f"{b}_mean"),
        f"mid_price_{level}_mean": (c(f"{a}_mean") + c(f"{b}_mean")) / 2.0,
        f"mid_price_{level}_change": change("", "last", "first"),
        f"book_volume_imbalance_{level}": imbalance(c(f"{bv}_sum"), c(f"{av}_sum")),
        f"last60_spread_{level}_mean": c(f"last60_{a}_mean") - c(f"last60_{b}_mean"),
        f"last60_mid_price_{level}_change": change("last60_", "end", "start"),
        f"last60_book_volume_imbalance_{level}": imbalance(
            c(f"last60_{bv}_mean"), c(f"last60_{av}_mean")
        ),
    }


def market_tables(market):
    """One row per sample with all columns of the full, last-60 and second-level quote tables."""
    t = seconds()
    recent = t <= 60
    line = Timeline.of(market).previous(["seconds_before_predict"])
    gap = F.abs(t - X.col("prev_seconds_before_predict"))
    aggs = {
        "market_row_count": F.count(F.lit(1)),
        "seconds_max": F.max(t),
        "seconds_min": F.min(t),
        "long_gap_count": F.count_if(gap > 4.5),
        "last60_row_count": F.count_if(recent),
        "transaction_avgprice_std": F.stddev_samp(bar.price),
        "transaction_avgprice_min": F.min(bar.price),
        "transaction_avgprice_max": F.max(bar.price),
        "transaction_avgprice_first_valid": _first(bar.price),
        "last60_transaction_avgprice_std": F.stddev_samp(F.when(recent, bar.price)),
    }
    for p, keep in (("", lambda x: x), ("last60_", lambda x: F.when(recent, x))):
        cond = None if p == "" else recent
        aggs |= {
            f"{p}transaction_count_sum": F.sum(keep(bar.count)),
            f"{p}transaction_count_max": F.max(keep(bar.count)),
            f"{p}has_transaction_ratio": F.avg(keep((bar.count > 0).cast("double"))),
            f"{p}transaction_volume_sum": F.sum(keep(bar.volume)),
            f"{p}transaction_volume_max": F.max(keep(bar.volume)),
            f"{p}transaction_avgprice_mean": F.avg(keep(bar.price)),
            f"{p}transaction_avgprice_last_valid": _last(bar.price, cond),
        }
    aggs |= {
        "transaction_count_mean": F.avg(bar.count),
        "transaction_volume_mean": F.avg(bar.volume),
    }
    aggs |= _level_aggs(1, recent) | _level_aggs(2, recent)
    out = summarise(line.rows, aggs)
    derived = {"seconds_coverage": c("seconds_max") - c("seconds_min")}
    return out.withColumns(derived | _level_derived(1) | _level_derived(2))


def market_full(tables):
    """40 columns over the whole window."""
    names = [n for n in tables.columns if not n.startswith("last60_") and "_2" not in n]
    return tables.select(*names)


def market_last60(tables):
    """22 columns over the last 60 seconds."""
    return tables.select(
        KEY, *[n for n in tables.columns if n.startswith("last60_") and "_2" not in n]
    )


def market_level2(tables):
    """35 columns of the second book level, full and last 60 seconds."""
    return tables.select(KEY, *[n for n in tables.columns if "_2" in n])


def market_relations(tables):
    """22 recent-against-full and second-against-first-level columns."""
    near = lambda n, d: ratio(n, d, "nonzero")
    out = {
        "recent_row_ratio": near(c("last60_row_count"), c("market_row_count")),
        "recent_transaction_count_share": near(c("last60_transaction_count_sum"), c("transaction_count_sum")),
        "recent_transaction_volume_share": near(c("last60_transaction_volume_sum"), c("transaction_volume_sum")),
        "recent_has_transaction_ratio_delta": c("last60_has_transaction_ratio") - c("has_transaction_ratio"),
        "recent_transaction_avgprice_delta": c("last60_transaction_avgprice_mean") - c("transaction_avgprice_mean"),
    }
    for n in (1, 2):
        out |= {
            f"recent_spread_{n}_delta": c(f"last60_spread_{n}_mean") - c(f"spread_{n}_mean"),
            f"recent_mid_price_{n}_change_delta": c(f"last60_mid_price_{n}_change") - c(f"mid_price_{n}_change"),
            f"recent_book_imbalance_{n}_delta": c(f"last60_book_volume_imbalance_{n}")
            - c(f"book_volume_imbalance_{n}"),
        }
    both = lambda p, n, s: c(f"{p}ask_volume_{n}_{s}") + c(f"{p}bid_volume_{n}_{s}")
    return derive(
        tables,
        out
        | {
            "level2_spread_minus_level1_spread": c("spread_2_mean") - c("spread_1_mean"),
            "level2_mid_minus_level1_mid": c("mid_price_2_mean") - c("mid_price_1_mean"),
            "level2_mid_change_minus_level1_mid_change": c("mid_price_2_change") - c("mid_price_1_change"),
            "level2_imbalance_minus_level1_imbalance": c("book_volume_imbalance_2") - c("book_volume_imbalance_1"),
            "ask_volume_2_to_1_sum_ratio": near(c("ask_volume_2_sum"), c("ask_volume_1_sum")),
            "bid_volume_2_to_1_sum_ratio": near(c("bid_volume_2_sum"), c("bid_volume_1_sum")),
            "total_volume_2_to_1_sum_ratio": near(both("", 2, "sum"), both("", 1, "sum")),
            "last60_level2_spread_minus_level1_spread": c("last60_spread_2_mean") - c("last60_spread_1_mean"),
            "last60_level2_mid_change_minus_level1_mid_change": c("last60_mid_price_2_change")
            - c("last60_mid_price_1_change"),
            "last60_level2_imbalance_minus_level1_imbalance": c("last60_book_volume_imbalance_2")
            - c("last60_book_volume_imbalance_1"),
            "last60_total_volume_2_to_1_mean_ratio": near(both("last60_", 2, "mean"), both("last60_", 1, "mean")),
        },
    )


def liquidity_tails(market, transaction, spine):
    """Spread and depth tail ratios from exact quantiles, trade-size concentration, stable tail."""
    depth = X.askv1 + X.bidv1
    q = quantiles_of(
        market,
        {
            "sp90": (X.spread, 0.9), "sp50": (X.spread, 0.5), "d10": (depth, 0.1),
            "d50": (depth, 0.5), "m50": (X.mid, 0.5),
        },
        (KEY,),
    )
    quotes = derive(
        q,
        {
            "spread_tail_ratio_full": ratio(c("sp90"), c("sp50"), "nonzero"),
            "depth_drought_ratio_full": ratio(c("d10"), c("d50"), "nonzero"),
            "spread_tail_excess_relative_full": (c("sp90") - c("sp50")) / (F.abs(c("m50")) + 1e-8),
        },
    )
    trades = derive(
        summarise(transaction, {"mx": F.max(X.volume), "s": F.sum(X.volume)}),
        {"trade_volume_concentration_60": c("mx") / (c("s") + 1.0)},
    )
    return on_spine(spine, quotes, trades).na.fill(0.0, ["trade_volume_concentration_60"])
