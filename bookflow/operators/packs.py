"""Wide packs over nested look-back windows, and the rolling pack of events, seconds and quotes.

Nested windows are sums of disjoint ones: rows are aggregated once per (sample, disjoint window),
and the few resulting rows are added up.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import at_least, bucket, clip, null_if_nan, ratio, seconds
from ..functions.stats import count_if, sum0
from ..schema import KEY, SEQ, TIME
from .assemble import derive, on_spine, summarise
from .joins import densify
from .quantile import exact_quantiles
from .timeline import Timeline

c = F.col
EPS = 1e-6

# Look-back windows in seconds.
MARKET_WINDOWS = (30, 60, 300, 600)
FLOW_WINDOWS = (10, 30, 60)


def nested_sums(df, rows, windows, extremes=()):
    """`<name>` over everything and `<name>_<w>` over t <= w, for row expressions {name: column}.

    extremes: {name: (row expression, max or min)} over everything.
    """
    b = bucket(seconds(), windows)
    extremes = dict(extremes)
    first = summarise(
        df.withColumn("_b", b),
        {k: sum0(v) for k, v in rows.items()} | {k: f(v) for k, (v, f) in extremes.items()},
        (KEY, "_b"),
    )
    aggs = {k: F.sum(k) for k in rows} | {k: f(c(k)) for k, (_, f) in extremes.items()}
    for i, w in enumerate(windows):
        aggs |= {f"{k}_{w}": sum0(F.when(c("_b") <= i, c(k))) for k in rows}
    return summarise(first, aggs)


def _end(x, latest=True):
    rank = F.struct((-seconds()).alias("t"), c(SEQ)) if latest else F.struct(seconds().alias("t"), c(SEQ))
    return F.max_by(x, rank)


def _mean(k, n):
    return F.when(c(n) > 0, c(k) / c(n))


def _std(k, k2, n):
    return F.when(c(n) > 1, F.sqrt(at_least(c(k2) / c(n) - (c(k) / c(n)) * (c(k) / c(n)), 0)))


def _div(a, b):
    return ratio(a, b, "nonzero", EPS)


def _share(a, b):
    """a / (b + 1), the denominator raised by a further 1e-6."""
    return a / (b + 1.0 + EPS)


def _rel(a, b):
    return a / (b + EPS) - 1.0


def _log_return(last, first):
    return F.when((last > EPS) & (first > EPS), F.log(last / first))


def quote_windows(market):
    d1 = X.askv1 + X.bidv1
    d2 = d1 + X.askv2 + X.bidv2
    price = null_if_nan(X.col("transaction_avgprice"))
    tv, tc = X.col("transaction_volume"), X.col("transaction_count")
    m = X.mid + EPS
    values = {
        "mid": X.mid, "spread": X.spread / m, "spread2": (X.ask2 - X.bid2) / m, "imb1": (X.bidv1 - X.askv1) / (d1 + EPS),
        "imb2": (X.bidv1 + X.bidv2 - X.askv1 - X.askv2) / (d2 + EPS),
        "micro1": (X.ask1 * X.bidv1 + X.bid1 * X.askv1) / (d1 + EPS),
        "micro2": (X.ask1 * X.bidv1 + X.ask2 * X.bidv2 + X.bid1 * X.askv1 + X.bid2 * X.askv2) / (d2 + EPS),
        "log_depth": F.log1p(d2), "slope": ((X.ask2 - X.ask1) + (X.bid1 - X.bid2)) / m,
    }
    squares = {f"{k}_sq": values[k] * values[k] for k in ("mid", "spread", "imb1", "imb2", "log_depth")}
    rows = {"n": F.lit(1.0), **values, **squares, "txv": tv, "txc": tc, "amount": price * tv}
    extremes = {"mid_max": (X.mid, F.max), "mid_min": (X.mid, F.min)}
    s = nested_sums(market, rows, MARKET_WINDOWS, extremes)
    ends = summarise(
        market,
        {f"{k}_last": _end(values[k]) for k in ("mid", "micro1", "spread", "imb1", "imb2", "log_depth")}
        | {"mid_first": _end(X.mid, False)},
    )
    t = s.join(ends, KEY)
    last = c("mid_last")
    out = {"m_count": c("n"), "m_mid_last": last, "m_mid_first": c("mid_first"), "m_mid_range": c("mid_max") - c("mid_min")}
    out |= {f"m_{k}_last": c(f"{k}_last") for k in ("micro1", "spread", "imb1", "imb2", "log_depth")}
    out |= {f"m_{k}_mean": _mean(k, "n") for k in ("mid", "micro1", "micro2", "spread", "spread2", "imb1", "imb2", "log_depth", "slope")}
    out |= {f"m_{k}_std": _std(k, f"{k}_sq", "n") for k in ("mid", "spread", "imb1", "imb2", "log_depth")}
    out |= {
        "m_txv_sum": c("txv"), "m_txc_sum": c("txc"), "m_vwap": _div(c("amount"), c("txv")),
        "m_ret_full": _log_return(last, c("mid_first")), "m_micro1_rel_last": _rel(c("micro1_last"), last),
        "m_vwap_rel": _rel(_div(c("amount"), c("txv")), last), "m_mid_mean_rel": _rel(_mean("mid", "n"), last),
    }
    for w in MARKET_WINDOWS:
        n = f"n_{w}"
        vwap = _div(c(f"amount_{w}"), c(f"txv_{w}"))
        out |= {
            f"m_count_{w}": c(n), f"m_mid_std_{w}": _std(f"mid_{w}", f"mid_sq_{w}", n), f"m_txv_sum_{w}": c(f"txv_{w}"),
            f"m_txc_sum_{w}": c(f"txc_{w}"), f"m_vwap_{w}": vwap, f"m_mid_mean_rel_{w}": _rel(_mean(f"mid_{w}", n), last),
            f"m_micro1_rel_{w}": _rel(_mean(f"micro1_{w}", n), last), f"m_vwap_rel_{w}": _rel(vwap, last),
            f"m_txv_share_{w}": _share(c(f"txv_{w}"), c("txv")), f"m_txc_share_{w}": _share(c(f"txc_{w}"), c("txc")),
        }
        out |= {f"m_{k}_mean_{w}": _mean(f"{k}_{w}", n) for k in ("mid", "spread", "imb1", "imb2", "micro1", "log_depth")}
    return derive(t, out)


def trade_windows_pack(transaction):
    p, v, g = X.price, X.volume, X.side_sign
    one = F.lit(1.0)
    rows = {
        "n": one, "vol": v, "vol_sq": v * v, "amount": p * v, "price": p, "price_sq": p * p,
        "buy_vol": F.when(X.is_buy, v), "sell_vol": F.when(X.is_sell, v), "buy_n": F.when(X.is_buy, one),
        "sell_n": F.when(X.is_sell, one), "sv": g * v, "sa": g * p * v, "lv": F.log1p(v),
    }
    s = nested_sums(transaction, rows, FLOW_WINDOWS, {"p_max": (p, F.max), "p_min": (p, F.min)})
    ends = summarise(transaction, {"p_last": _end(p), "p_first": _end(p, False), "g_last": _end(g)})
    t = s.join(ends, KEY)
    out = {
        "t_price_last": c("p_last"), "t_price_first": c("p_first"), "t_price_range": c("p_max") - c("p_min"),
        "t_vol_mean": _mean("vol", "n"), "t_vol_std": _std("vol", "vol_sq", "n"), "t_amount_sum": c("amount"),
        "t_log_vol_mean": _mean("lv", "n"), "t_last_signed_side": c("g_last"),
        "t_ret_full": _log_return(c("p_last"), c("p_first")), "t_signed_amount_per_vol": _share(c("sa"), c("vol")),
    }
    for s_ in ("", *[f"_{w}" for w in FLOW_WINDOWS]):
        k = lambda n: c(n + s_)
        out |= {
            f"t_count{s_}": k("n"), f"t_vol_sum{s_}": k("vol"), f"t_price_mean{s_}": _mean("price" + s_, "n" + s_),
            f"t_price_std{s_}": _std("price" + s_, "price_sq" + s_, "n" + s_), f"t_vwap{s_}": _div(k("amount"), k("vol")),
            f"t_buy_vol{s_}": k("buy_vol"), f"t_sell_vol{s_}": k("sell_vol"), f"t_buy_count{s_}": k("buy_n"),
            f"t_sell_count{s_}": k("sell_n"), f"t_signed_vol{s_}": k("sv"), f"t_signed_amount{s_}": k("sa"),
            f"t_signed_ratio{s_}": _share(k("sv"), k("vol")), f"t_vol_imb{s_}": _share(k("buy_vol") - k("sell_vol"), k("vol")),
            f"t_buy_vol_share{s_}": _share(k("buy_vol"), k("vol")), f"t_buy_trade_ratio{s_}": _share(k("buy_n"), k("n")),
        }
        if s_:
            out |= {f"t_vol_share{s_}": _share(k("vol"), c("vol")), f"t_count_share{s_}": _share(k("n"), c("n"))}
    return derive(t, out)


def order_windows_pack(order):
    p, v, g, a = X.price, X.volume, X.side_sign, X.action_sign
    new, can, buy, sell = X.is_new, X.is_cancel, X.is_buy, X.is_sell
    rows = {
        "n": F.lit(1.0), "vol": v, "vol_sq": v * v, "price": p, "price_sq": p * p, "sv": g * v, "av": a * v, "pv": g * a * v,
        "new": F.when(new, v), "can": F.when(can, v), "bn": F.when(new & buy, v), "sn": F.when(new & sell, v),
        "bc": F.when(can & buy, v), "sc": F.when(can & sell, v), "lv": F.log1p(v),
    }
    t = nested_sums(order, rows, FLOW_WINDOWS)
    t = t.join(summarise(order, {"p_last": _end(p), "g_last": _end(g), "a_last": _end(a)}), KEY)
    out = {
        "o_price_last": c("p_last"), "o_vol_mean": _mean("vol", "n"), "o_vol_std": _std("vol", "vol_sq", "n"),
        "o_buy_new": c("bn"), "o_sell_new": c("sn"), "o_buy_cancel": c("bc"), "o_sell_cancel": c("sc"),
        "o_log_vol_mean": _mean("lv", "n"), "o_last_side": c("g_last"), "o_last_action": c("a_last"),
    }
    for s_ in ("", *[f"_{w}" for w in FLOW_WINDOWS]):
        k = lambda n: c(n + s_)
        out |= {
            f"o_count{s_}": k("n"), f"o_vol_sum{s_}": k("vol"), f"o_price_mean{s_}": _mean("price" + s_, "n" + s_),
            f"o_price_std{s_}": _std("price" + s_, "price_sq" + s_, "n" + s_), f"o_signed_vol{s_}": k("sv"),
            f"o_action_vol{s_}": k("av"), f"o_pressure{s_}": k("pv"), f"o_new_vol{s_}": k("new"), f"o_cancel_vol{s_}": k("can"),
            f"o_signed_ratio{s_}": _share(k("sv"), k("vol")), f"o_action_ratio{s_}": _share(k("av"), k("vol")),
            f"o_pressure_ratio{s_}": _share(k("pv"), k("vol")), f"o_cancel_ratio{s_}": _share(k("can"), k("vol")),
            f"o_new_imb{s_}": _share(k("bn") - k("sn"), k("new")), f"o_cancel_imb{s_}": _share(k("bc") - k("sc"), k("can")),
        }
        if s_:
            out |= {f"o_vol_share{s_}": _share(k("vol"), c("vol")), f"o_count_share{s_}": _share(k("n"), c("n"))}
    return derive(t, out)


def window_pack(market, transaction, order, spine):
    """All columns of the windowed pack; a sample without a stream has null there."""
    return on_spine(spine, quote_windows(market), trade_windows_pack(transaction), order_windows_pack(order))


def window_pairs(windows):
    """Neighbouring windows, and each against the longest."""
    ws = sorted(windows)
    pairs = list(zip(ws, ws[1:])) + [(w, ws[-1]) for w in ws[:-1]]
    return list(dict.fromkeys(pairs))


def window_contrasts(pack):
    """Differences and ratios between windows, and cross-stream columns, of a windowed pack."""
    out = {}
    for a, b in window_pairs(MARKET_WINDOWS):
        for n, k in (("imb1", "imb1_mean"), ("imb2", "imb2_mean"), ("spread", "spread_mean"), ("mid_rel", "mid_mean_rel")):
            out[f"m_{n}_delta_{a}_{b}"] = c(f"m_{k}_{a}") - c(f"m_{k}_{b}")
        out[f"m_txv_ratio_{a}_{b}"] = _share(c(f"m_txv_sum_{a}"), c(f"m_txv_sum_{b}"))
    flows = {
        "t": (("signed", "signed_ratio"), ("buy_trade", "buy_trade_ratio"), ("vol_imb", "vol_imb")),
        "o": (("pressure", "pressure_ratio"), ("cancel", "cancel_ratio"), ("new_imb", "new_imb"), ("cancel_imb", "cancel_imb")),
    }
    for a, b in window_pairs(FLOW_WINDOWS):
        for p, pairs in flows.items():
            for n, k in pairs:
                out[f"{p}_{n}_delta_{a}_{b}"] = c(f"{p}_{k}_{a}") - c(f"{p}_{k}_{b}")
            out[f"{p}_vol_ratio_{a}_{b}"] = _share(c(f"{p}_vol_sum_{a}"), c(f"{p}_vol_sum_{b}"))
    mid, imb = c("m_mid_last"), c("m_imb1_last")
    out |= {
        "x_m_spread_imb_last": c("m_spread_last") * imb, "x_m_spread_imb_mean": c("m_spread_mean") * c("m_imb1_mean"),
        "x_t_last_vs_mid": _rel(c("t_price_last"), mid), "x_t_vol_to_m_txv": _share(c("t_vol_sum"), c("m_txv_sum")),
        "x_o_new_to_m_txv": _share(c("o_new_vol"), c("m_txv_sum")), "x_o_cancel_to_m_txv": _share(c("o_cancel_vol"), c("m_txv_sum")),
    }
    for s in ("", *[f"_{w}" for w in FLOW_WINDOWS]):
        tr, op = c(f"t_signed_ratio{s}"), c(f"o_pressure_ratio{s}")
        out |= {
            f"x_t_vwap_vs_mid{s}": _rel(c(f"t_vwap{s}"), mid), f"x_t_signed_x_mimb{s}": tr * imb, f"x_o_pressure_x_mimb{s}": op * imb,
            f"x_o_new_minus_cancel_imb{s}": c(f"o_new_imb{s}") - c(f"o_cancel_imb{s}"), f"x_net_flow_pressure{s}": tr + op,
            f"x_t_minus_o_pressure{s}": tr - op, f"x_o_cancel_to_t_vol{s}": _share(c(f"o_cancel_vol{s}"), c(f"t_vol_sum{s}")),
            f"x_o_new_to_t_vol{s}": _share(c(f"o_new_vol{s}"), c(f"t_vol_sum{s}")),
        }
    for w in (30, 60):  # windows both packs have
        out |= {
            f"x_t_vwap_vs_m_vwap_{w}": _rel(c(f"t_vwap_{w}"), c(f"m_vwap_{w}")),
            f"x_t_signed_x_mimb_mean_{w}": c(f"t_signed_ratio_{w}") * c(f"m_imb1_mean_{w}"),
            f"x_o_pressure_x_mimb_mean_{w}": c(f"o_pressure_ratio_{w}") * c(f"m_imb1_mean_{w}"),
        }
    return derive(pack, out)


# rolling pack ------------------------------------------------------------------------------------

TINY = 1e-8

# The columns kept of each block.
KEPT = {
    "trades": """t_lv_mean t_px_std t_vwap t_price_volatility t_price_range_ratio t_avg_signed_vol t_px_skew t_buy_sell_vol_ratio
        t_large_buy_90 t_large_sell_95 t_sv_weighted_15 t_price_weighted_15 t_value_weighted_30 t_avg_time_gap t_time_gap_std
        t_max_time_gap t_time_range t_price_first_half_vs_second t_buy_ratio_first_half_vs_second t_vol_first_third_vs_last
        t_price_change_first_to_last t_gap_first_half_vs_second t_sv_45 t_lv_mean_15 t_lv_mean_30 t_buy_ratio_15 t_buy_ratio_45
        t_px_std_15 t_px_std_30 t_avg_signed_vol_30 t_px_skew_15 t_price_range_ratio_15""",
    "orders": """o_av_weighted_30 o_vol_sum o_px_std o_px_skew o_bid_depth o_ask_depth o_market_ratio o_avg_time_gap o_time_gap_std
        o_price_first_half_vs_second o_vol_first_third_vs_last o_vol_15 o_sv_15 o_sv_30 o_av_15 o_buy_ratio_15 o_buy_ratio_30
        o_buy_ratio_45 o_n_45 o_market_ratio_15 o_market_ratio_30 o_market_ratio_45""",
    "trade_seconds": """t_sec_vol_mean t_sec_price_min t_sec_price_max t_sec_lv_mean t_sec_price_trend t_sec_autocorr_lag1
        t_sec_autocorr_lag5 t_sec_sgn_weighted_15 t_sec_vol_15 t_sec_price_mean_15 t_sec_price_mean_45 t_sec_has_data_15
        t_sec_price_near_far_diff_15 t_sec_price_near_far_diff_30 t_sec_price_near_far_diff_60 t_sec_vol_near_far_ratio_30
        t_sec_vol_near_far_ratio_60 t_sec_rowcount_near_far_ratio_15 t_sec_rowcount_near_far_ratio_30
        t_sec_rowcount_near_far_ratio_60""",
    "order_seconds": """o_sec_price_mean o_sec_price_std o_sec_new_count o_sec_cancel_new_ratio o_sec_cancel_volume o_sec_new_volume
        o_sec_sgn_weighted_15 o_sec_price_mean_15 o_sec_price_mean_30 o_sec_row_count_15 o_sec_has_data_15 o_sec_cancel_count_45
        o_sec_cancel_new_ratio_15 o_sec_cancel_new_ratio_30 o_sec_vol_near_far_ratio_15 o_sec_vol_near_far_ratio_30
        o_sec_vol_near_far_ratio_60 o_sec_rowcount_near_far_ratio_15 o_sec_rowcount_near_far_ratio_30
        o_sec_rowcount_near_far_ratio_60 o_sec_cancel_near_far_ratio_15 o_sec_cancel_near_far_ratio_30
        o_sec_cancel_near_far_ratio_60""",
    "quotes": """m_mid_weighted_60 m_vol_weighted_60 m_ofi_weighted_300 m_vol_weighted_300 m_mid_last m_mid_std m_imb_last m_imb_std
        m_rv m_ofi_sum m_ask_slope_mean m_bid_slope_mean m_mid_skew m_mid_std_180 m_sp_mean_60 m_imb_mean_60 m_imb_mean_180 m_rv_60
        m_rv_180 m_ofi_sum_60 m_ofi_sum_180 m_mid_range_60 m_ofi_ewm_120""",
}


def _ranked(events, *names):
    """Events with gap to the previous one, `idx` counted from the newest, and the total `n`."""
    cols = {"t": seconds(), "p": X.price, "v": X.volume, "g": X.side_sign, "sv": X.signed_volume}
    keep = [v.alias(k) for k, v in cols.items()] + list(names)
    rows = Timeline.of(events).select(SEQ, TIME, *keep).previous(["t", "p"]).finished()
    t = c("t")
    return Timeline.of(rows, by=t, order=(t, c(SEQ))).position("idx").key_total("n", F.lit(1)).rows


def _halves(x, agg):
    newer, older = c("idx") <= c("n") * 0.5, c("idx") > c("n") * 0.5
    return agg(F.when(newer, x)), agg(F.when(older, x))


def _thirds(x):
    return sum0(F.when(c("idx") <= c("n") * 0.33, x)), sum0(F.when(c("idx") > c("n") * 0.67, x))


def trade_events(transaction):
    """Event block of trades; thresholds of large trades are quantiles over all of them."""
    rows = _ranked(transaction)
    q = {f"q{k}": k / 100 for k in (90, 95)}
    large = exact_quantiles(transaction, X.volume, q, interpolation="nearest")
    rows = rows.crossJoin(F.broadcast(large))  # one row
    t, p, v, g, sv = (c(k) for k in ("t", "p", "v", "g", "sv"))
    lv, gap = F.log1p(v), F.abs(t - c("prev_t"))
    rank = F.struct((-t).alias("t"), c(SEQ))
    newer_p, older_p = _halves(p, F.avg)
    newer_g, older_g = _halves(g, F.avg)
    newer_gap, older_gap = _halves(gap, F.avg)
    first3, last3 = _thirds(v)
    w = lambda tau: F.exp(-t / float(tau))
    span = lambda x: (F.max(x) - F.min(x)) / (F.avg(x) + TINY)
    aggs = {
        "t_vol_sum": F.sum(v), "t_lv_mean": F.avg(lv), "t_px_std": F.stddev_samp(p), "t_buy_ratio": F.avg((g > 0).cast("double")),
        "t_vwap": F.sum(p * v) / (F.sum(v) + TINY), "t_price_volatility": F.stddev_samp(F.try_divide(p, c("prev_p")) - 1),
        "t_price_range_ratio": span(p), "t_avg_signed_vol": F.avg(sv / (v + TINY)), "t_px_skew": F.skewness(p),
        "t_buy_sell_vol_ratio": sum0(F.when(g > 0, v)) / (sum0(F.when(g < 0, v)) + TINY),
        "t_large_buy_90": count_if((v > c("q90")) & (g > 0)), "t_large_sell_90": count_if((v > c("q90")) & (g < 0)),
        "t_large_sell_95": count_if((v > c("q95")) & (g < 0)), "t_avg_time_gap": F.avg(gap), "t_time_gap_std": F.stddev_samp(gap),
        "t_max_time_gap": F.max(gap), "t_time_range": F.max(t) - F.min(t), "t_count": F.count(F.lit(1)).cast("double"),
        "t_price_first_half_vs_second": newer_p / (older_p + TINY) - 1, "t_buy_ratio_first_half_vs_second": newer_g - older_g,
        "t_vol_first_third_vs_last": first3 / (last3 + TINY), "t_price_change_first_to_last": F.max_by(p, rank) - F.min_by(p, rank),
        "t_gap_first_half_vs_second": newer_gap / (older_gap + TINY), "t_price_weighted_15": F.sum(w(15) * p),
        "t_value_weighted_30": F.sum(w(30) * v * p),
    }
    for tau in (15, 30):
        aggs |= {f"t_vol_weighted_{tau}": F.sum(w(tau) * v), f"t_sv_weighted_{tau}": F.sum(w(tau) * sv)}
    for k in (15, 30, 45):
        near = lambda x: F.when(t <= k, x)
        aggs |= {
            f"t_vol_{k}": sum0(near(v)), f"t_sv_{k}": sum0(near(sv)), f"t_lv_mean_{k}": F.avg(near(lv)),
            f"t_buy_ratio_{k}": F.avg(near((g > 0).cast("double"))), f"t_n_{k}": count_if(t <= k),
            f"t_px_std_{k}": F.stddev_samp(near(p)), f"t_avg_signed_vol_{k}": F.avg(near(sv / (v + TINY))),
            f"t_px_skew_{k}": F.skewness(near(p)), f"t_price_range_ratio_{k}": span(near(p)),
        }
    return summarise(rows, aggs)


def order_events(order):
    rows = _ranked(order, X.action_sign.alias("a"))
    t, p, v, g, sv, a = (c(k) for k in ("t", "p", "v", "g", "sv", "a"))
    gap = F.abs(t - c("prev_t"))
    newer_p, older_p = _halves(p, F.avg)
    first3, last3 = _thirds(v)
    w = lambda tau: F.exp(-t / float(tau))
    new = (a > 0).cast("double")
    aggs = {
        "o_vol_sum": F.sum(v), "o_sv_sum": F.sum(sv), "o_buy_ratio": F.avg((g > 0).cast("double")), "o_px_std": F.stddev_samp(p),
        "o_px_skew": F.skewness(p), "o_bid_depth": sum0(F.when(g > 0, v)), "o_ask_depth": sum0(F.when(g < 0, v)),
        "o_market_ratio": F.avg(new), "o_avg_time_gap": F.avg(gap), "o_time_gap_std": F.stddev_samp(gap),
        "o_price_first_half_vs_second": newer_p / (older_p + TINY) - 1, "o_vol_first_third_vs_last": first3 / (last3 + TINY),
        "o_av_weighted_30": F.sum(w(30) * a * v), "o_count": F.count(F.lit(1)).cast("double"),
    }
    for tau in (15, 30):
        aggs |= {f"o_vol_weighted_{tau}": F.sum(w(tau) * v), f"o_sv_weighted_{tau}": F.sum(w(tau) * sv)}
    for k in (15, 30, 45):
        near = lambda x: F.when(t <= k, x)
        aggs |= {
            f"o_vol_{k}": sum0(near(v)), f"o_sv_{k}": sum0(near(sv)), f"o_av_{k}": sum0(near(a * v)),
            f"o_buy_ratio_{k}": F.avg(near((g > 0).cast("double"))), f"o_n_{k}": count_if(t <= k),
            f"o_market_ratio_{k}": F.avg(near(new)),
        }
    return summarise(rows, aggs)


LAST_SECOND = 60


def _seconds_grid(events, extra):
    second = F.bround(seconds(), 0).cast("int").alias("s")
    cells = events.groupBy(KEY, second).agg(
        F.avg(X.price).alias("p"), F.sum(X.volume).alias("v"), F.count(F.lit(1)).alias("k"),
        F.when(F.min(X.side_sign) > 0, 1.0).otherwise(-1.0).alias("g"), *[x.alias(n) for n, x in extra.items()],
    )
    ids = events.select(KEY).distinct()
    return densify(ids, LAST_SECOND + 1, cells, name="s").na.fill(0, ["k", *extra])


def _near_far(x, w, agg):
    near, far = c("s") <= w / 2, (c("s") <= w) & (c("s") > w / 2)
    return agg(F.when(near, x)), agg(F.when(far, x))


def trade_seconds(transaction):
    """Second block of trades on the 61-second grid. Empty seconds have no price or side."""
    g = _seconds_grid(transaction, {})
    w = Window.partitionBy(KEY).orderBy(F.desc("s"))  # 61 rows per sample
    g = g.withColumns({"l1": F.lag("p", 1).over(w), "l5": F.lag("p", 5).over(w)})
    every = Window.partitionBy(KEY)
    mean = {n: F.avg(n).over(every) for n in ("p", "l1", "l5")}
    g = g.withColumns({f"d_{n}": c(n) - m for n, m in mean.items()})
    p, v, s = c("p"), c("v"), c("s")
    middle = LAST_SECOND / 2.0
    spread = sum((i - middle) ** 2 for i in range(LAST_SECOND + 1))
    den = F.sum(c("d_p") * c("d_p")) + TINY
    aggs = {
        "t_sec_vol_sum": F.sum(v), "t_sec_vol_mean": F.avg(v), "t_sec_price_mean": F.avg(p), "t_sec_price_std": F.stddev_samp(p),
        "t_sec_price_min": F.min(p), "t_sec_price_max": F.max(p), "t_sec_lv_mean": F.avg(F.log1p(v)),
        "t_sec_has_data_ratio": count_if(c("k") > 0) / float(LAST_SECOND + 1),
        "t_sec_price_trend": F.sum(c("d_p") * (s - middle)) / (spread + TINY),
        "t_sec_autocorr_lag1": F.sum(c("d_p") * c("d_l1")) / den, "t_sec_autocorr_lag5": F.sum(c("d_p") * c("d_l5")) / den,
        "t_sec_sgn_weighted_15": F.sum(F.exp(-s / 15.0) * c("g")), "t_sec_vol_15": sum0(F.when(s <= 15, v)),
        "t_sec_price_mean_15": F.avg(F.when(s <= 15, p)), "t_sec_price_mean_45": F.avg(F.when(s <= 45, p)),
        "t_sec_has_data_15": count_if((s <= 15) & (c("k") > 0)),
    }
    for k in (15, 30, 60):
        np_, fp = _near_far(p, k, F.avg)
        nv, fv = _near_far(v, k, sum0)
        nk, fk = _near_far(c("k"), k, sum0)
        aggs |= {
            f"t_sec_price_near_far_diff_{k}": np_ / (fp + TINY) - 1, f"t_sec_vol_near_far_ratio_{k}": nv / (fv + TINY),
            f"t_sec_rowcount_near_far_ratio_{k}": nk / (fk + TINY),
        }
    return summarise(g, aggs)


def order_seconds(order):
    """Second block of orders; new and cancel numbers count events, not seconds."""
    v = X.volume
    extra = {
        "nn": count_if(X.is_new), "nc": count_if(X.is_cancel), "vn": sum0(F.when(X.is_new, v)), "vc": sum0(F.when(X.is_cancel, v)),
    }
    g = _seconds_grid(order, extra)
    p, s = c("p"), c("s")
    upto = lambda n, k: sum0(F.when(s <= k, c(n)))
    aggs = {
        "o_sec_price_mean": F.avg(p), "o_sec_price_std": F.stddev_samp(p), "o_sec_new_count": F.sum("nn"),
        "o_sec_cancel_new_ratio": F.sum("nc") / (F.sum("nn") + TINY), "o_sec_cancel_volume": F.sum("vc"), "o_sec_new_volume": F.sum("vn"),
        "o_sec_has_data_ratio": count_if(c("k") > 0) / float(LAST_SECOND + 1),
        "o_sec_sgn_weighted_15": F.sum(F.exp(-s / 15.0) * c("g")), "o_sec_price_mean_15": F.avg(F.when(s <= 15, p)),
        "o_sec_price_mean_30": F.avg(F.when(s <= 30, p)), "o_sec_row_count_15": upto("k", 15),
        "o_sec_has_data_15": count_if((s <= 15) & (c("k") > 0)), "o_sec_cancel_count_45": upto("nc", 45),
        "o_sec_cancel_new_ratio_15": upto("nc", 15) / (upto("nn", 15) + TINY),
        "o_sec_cancel_new_ratio_30": upto("nc", 30) / (upto("nn", 30) + TINY),
    }
    for k in (15, 30, 60):
        for n, x in (("vol", "v"), ("rowcount", "k"), ("cancel", "nc")):
            near, far = _near_far(c(x), k, sum0)
            aggs[f"o_sec_{n}_near_far_ratio_{k}"] = near / (far + TINY)
    return summarise(g, aggs)


def longest_gap(events):
    """Longest run of empty seconds of the 61-second grid, per sample."""
    g = _seconds_grid(events, {})
    w = Window.partitionBy(KEY).orderBy("s")  # 61 rows per sample
    empty = (c("k") == 0).cast("int")
    g = g.withColumn("empty", empty)
    g = g.withColumn("run", F.sum((F.coalesce(F.lag("empty").over(w), F.lit(-1)) != c("empty")).cast("int")).over(w))
    runs = g.groupBy(KEY, "run").agg(F.sum("empty").alias("len"))
    return runs.groupBy(KEY).agg(F.max("len").alias("longest_gap"))


def quote_events(market):
    """Quote block. Imbalance is (ask - bid) / (ask + bid + 1) and OFI the change of ask minus the
    change of bid volume. The mean of a rolling mean weights each value by the full windows that
    hold it."""
    line = Timeline.of(market).select(
        SEQ, TIME, seconds().alias("t"), X.mid.alias("mid"), X.spread.alias("sp"), X.askv1.alias("av"), X.bidv1.alias("bv"),
        ((X.ask2 - X.ask1) / (X.askv2 - X.askv1 + TINY)).alias("sa"), ((X.bid1 - X.bid2) / (X.bidv1 - X.bidv2 + TINY)).alias("sb"),
        X.col("transaction_volume").alias("tv"),
    )
    rows = line.previous(["mid", "av", "bv"]).position().key_total("n", F.lit(1)).rows
    zero = F.lit(0.0)
    rows = rows.withColumns(
        {
            "imb": (c("av") - c("bv")) / (c("av") + c("bv") + 1.0), "dm": F.coalesce(c("mid") - c("prev_mid"), zero),
            "ofi": F.coalesce(c("av") - c("prev_av"), zero) - F.coalesce(c("bv") - c("prev_bv"), zero),
            "move": F.abs(F.try_divide(c("mid"), c("prev_mid")) - 1),
        }
    )
    t, mid, imb, ofi = c("t"), c("mid"), c("imb"), c("ofi")
    rank = F.struct((-t).alias("t"), c(SEQ))
    w = lambda tau: F.exp(-t / float(tau))

    def rolling_mean_of(k):
        i, m = c("pos") - 1, c("n") - 1  # moves exist from the second row on
        full = F.least(i, F.lit(k), m - k + 1, m - i + 1)
        used = F.max(m - k + 1)
        return F.when(used > 0, F.sum(F.when(i >= 1, c("move") * F.greatest(full, F.lit(0)))) / (k * used))

    aggs = {
        "m_mid_last": F.max_by(mid, rank), "m_imb_last": F.max_by(imb, rank), "m_mid_mean": F.avg(mid), "m_mid_std": F.stddev_samp(mid),
        "m_imb_mean": F.avg(imb), "m_imb_std": F.stddev_samp(imb), "m_sp_mean": F.avg("sp"), "m_rv": F.sqrt(F.sum(c("dm") * c("dm"))),
        "m_ofi_sum": F.sum(ofi), "m_ask_slope_mean": F.avg("sa"), "m_bid_slope_mean": F.avg("sb"), "m_mid_skew": F.skewness(mid),
        "m_vol_short": rolling_mean_of(5), "m_vol_long": rolling_mean_of(20), "m_ofi_ewm_120": F.sum(w(120) * ofi) / (F.sum(w(120)) + TINY),
    }
    for tau in (60, 300):
        aggs |= {
            f"m_mid_weighted_{tau}": F.sum(w(tau) * mid), f"m_imb_weighted_{tau}": F.sum(w(tau) * imb),
            f"m_ofi_weighted_{tau}": F.sum(w(tau) * ofi), f"m_vol_weighted_{tau}": F.sum(w(tau) * c("tv")),
        }
    for k in (60, 180):
        near = lambda x: F.when(t <= k, x)
        aggs |= {
            f"m_mid_std_{k}": F.stddev_samp(near(mid)), f"m_sp_mean_{k}": F.avg(near(c("sp"))), f"m_imb_mean_{k}": F.avg(near(imb)),
            f"m_rv_{k}": F.sqrt(sum0(near(c("dm") * c("dm")))), f"m_ofi_sum_{k}": sum0(near(ofi)),
            f"m_mid_range_{k}": F.max(near(mid)) - F.min(near(mid)),
        }
    return summarise(rows, aggs)


def rolling_pack(market, transaction, order, spine):
    """153 columns: the kept columns of five blocks and 33 cross-block columns."""
    blocks = trade_events(transaction), order_events(order), trade_seconds(transaction), order_seconds(order), quote_events(market)
    t = on_spine(spine, *blocks)
    d = lambda a, b, e=TINY: c(a) / (c(b) + e)
    out = {n: c(n) for names in KEPT.values() for n in names.split()}
    out |= {
        "x_o_signed_ratio": d("o_sv_sum", "o_vol_sum", 1.0), "x_rv_60_over_full": d("m_rv_60", "m_rv"),
        "x_trans_order_vol_ratio": d("t_vol_sum", "o_vol_sum"), "x_vwap_mid_ratio": (c("t_vwap") - c("m_mid_last")) / (c("m_mid_last") + TINY),
        "x_rv_60_180_ratio": d("m_rv_60", "m_rv_180"), "x_trans_order_buy_diff": c("t_buy_ratio") - c("o_buy_ratio"),
        "x_large_trade_imbalance": (c("t_large_buy_90") - c("t_large_sell_90")) / (c("t_n_15") + TINY),
        "x_slope_imbalance": c("m_bid_slope_mean") - c("m_ask_slope_mean"),
        "x_trans_order_buy_diff_15": c("t_buy_ratio_15") - c("o_buy_ratio_15"), "x_t_vol_15_45_ratio": d("t_vol_15", "t_vol_45"),
        "x_mid_zscore": (c("m_mid_last") - c("m_mid_mean")) / (c("m_mid_std") + TINY),
        "x_t_vol_weight_ratio_30": d("t_vol_weighted_30", "t_vol_30"), "x_o_vol_weight_ratio_15": d("o_vol_weighted_15", "o_vol_15"),
        "x_o_vol_weight_ratio_30": d("o_vol_weighted_30", "o_vol_30"), "x_t_vol_trend_15": c("t_sec_vol_near_far_ratio_15") - 1,
        "x_tx_order_rate_ratio": (c("t_count") / 60.0) / (c("o_count") / 60.0 + TINY),
        "x_t_gap_stability": d("t_time_gap_std", "t_avg_time_gap"), "x_o_gap_stability": d("o_time_gap_std", "o_avg_time_gap"),
        "x_m_vol_long_short_ratio": d("m_vol_weighted_60", "m_vol_weighted_300"),
        "x_m_ofi_long_short_diff": c("m_ofi_weighted_60") - c("m_ofi_weighted_300"),
        "x_m_vol_regime_change": d("m_vol_short", "m_vol_long") - 1, "x_t_signed_weighted_15": d("t_sv_weighted_15", "t_vol_weighted_15"),
        "x_o_signed_weighted_15": d("o_sv_weighted_15", "o_vol_weighted_15"),
        "x_t_signed_weight_diff_15": d("t_sv_weighted_15", "t_vol_weighted_15") - d("t_sv_15", "t_vol_15"),
        "x_o_signed_weight_diff_15": d("o_sv_weighted_15", "o_vol_weighted_15") - d("o_sv_15", "o_vol_15"),
        "x_m_imb_trend": c("m_imb_weighted_60") - c("m_imb_weighted_300"), "x_sec_price_mid_diff": c("t_sec_price_mean") - c("m_mid_mean"),
        "x_sec_has_data_imb": c("t_sec_has_data_ratio") * c("m_imb_mean"),
        "x_sec_cancel_spread": c("o_sec_cancel_new_ratio") * c("m_sp_mean"),
        "x_sec_tx_order_data_ratio_diff": c("t_sec_has_data_ratio") - c("o_sec_has_data_ratio"),
        "x_sec_t_max_missing_ratio": 1.0 - c("t_sec_has_data_ratio"),
        "x_sec_price_trend_normalized": d("t_sec_price_trend", "t_sec_price_std"),
        "x_sec_price_trend_acceleration": c("t_sec_price_near_far_diff_15") - c("t_sec_price_near_far_diff_30"),
    }
    return derive(t, out)


# row differences ---------------------------------------------------------------------------------


def event_differences(events, names=("price", "volume"), gaps=(1, 7, 14)):
    """Per event: change and value `gap` rows back, relative change and second difference."""
    far = sorted({g * k for g in gaps for k in (1, 2)})
    line = Timeline.of(events).shifted(list(names), {k: f"_{k}_" for k in far})
    out = {}
    for g in gaps:
        for n in names:
            x, back, twice = c(n), c(f"_{g}_{n}"), c(f"_{2 * g}_{n}")
            out |= {
                f"{n}_diff{g}": x - back, f"{n}_shift{g}": back, f"{n}_diff2_{g}": (x - back) - (back - twice),
                f"{n}_ratio{g}": (x - back) / (back + TINY),
            }
    return line.rows.select(KEY, SEQ, *[v.alias(k) for k, v in out.items()])


# add-ons -----------------------------------------------------------------------------------------


def flow_response(flow, tables, response_clip=5.0):
    """2 columns: trade imbalance times, and damped by, the mid change measured in spreads."""
    t = flow.join(tables.select(KEY, "last60_mid_price_1_change", "last60_spread_1_mean"), KEY, "left")
    f = F.coalesce(c("trade_volume_imbalance_60"), F.lit(0.0))
    move = F.coalesce(ratio(c("last60_mid_price_1_change"), c("last60_spread_1_mean"), "nonzero", 1e-8), F.lit(0.0))
    return derive(
        t,
        {
            "flow_price_alignment_60": f * clip(move, -response_clip, response_clip),
            "flow_without_price_move_60": f / (1.0 + F.abs(move)),
        },
    )


def flow_alignment(trades, orders):
    """Trade and order pressure where they agree in sign, in the last 60 and 20 seconds."""
    t = trades.join(orders, KEY)
    return derive(
        t,
        {
            f"aligned_pressure_{w}": X.aligned_pressure(c(f"trade_volume_imbalance_{w}"), c(f"net_order_pressure_{w}"))
            for w in (60, 20)
        },
    )


def relative_scale(tables):
    """4 columns: recent and peak share of trade count and volume."""
    near = lambda a, b: ratio(c(a), c(b), "nonzero")
    return derive(
        tables,
        {
            "x_recent60_trade_count_share": near("last60_transaction_count_sum", "transaction_count_sum"),
            "x_recent60_trade_volume_share": near("last60_transaction_volume_sum", "transaction_volume_sum"),
            "x_trade_count_peak_share": near("transaction_count_max", "transaction_count_sum"),
            "x_trade_volume_peak_share": near("transaction_volume_max", "transaction_volume_sum"),
        },
    )
