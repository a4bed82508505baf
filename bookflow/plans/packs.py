"""Wide packs and row differences with their check SQL."""

from ..operators import book, flow, packs
from ..sources.adapters import streams
from .book import STEPS as TABLE_STEPS
from .flow import order_sums_sql, order_terms, signed, trade_sums_sql
from .quotes import W
from .registry import present, register
from .sql import cols, query, sum_if

E6 = "1e-6::DOUBLE"
NEAR, FAR = "ORDER BY t, seq DESC", "ORDER BY t DESC, seq DESC"
div = lambda a, b: f"CASE WHEN abs({b}) > {E6} THEN ({a}) / ({b}) END"
share = lambda a, b: f"({a}) / (({b}) + 1 + {E6})"
rel = lambda a, b: f"({a}) / (({b}) + {E6}) - 1"
D1, D2 = "(av1 + bv1)", "(av1 + bv1 + av2 + bv2)"
MV = {
    "mid": "mid", "spread": f"(a1 - b1) / (mid + {E6})", "spread2": f"(a2 - b2) / (mid + {E6})", "imb1": f"(bv1 - av1) / ({D1} + {E6})",
    "imb2": f"(bv1 + bv2 - av1 - av2) / ({D2} + {E6})", "micro1": f"(a1 * bv1 + b1 * av1) / ({D1} + {E6})",
    "micro2": f"(a1 * bv1 + a2 * bv2 + b1 * av1 + b2 * av2) / ({D2} + {E6})", "log_depth": f"ln(1 + {D2})",
    "slope": f"((a2 - a1) + (b1 - b2)) / (mid + {E6})",
}


def std(x, f):
    return f"CASE WHEN count(*) {f} > 1 THEN stddev_pop({x}) {f} END"


def pack_columns():
    f = lambda w: "" if w is None else f"FILTER (WHERE t <= {w})"
    z = lambda x, w: f"coalesce(sum({x}) {f(w)}, 0)"
    m = {"m_mid_first": f"first(mid {FAR})", "m_mid_range": "max(mid) - min(mid)"}
    m |= {f"m_{k}_last": f"first({MV[k]} {NEAR})" for k in ("mid", "micro1", "spread", "imb1", "imb2", "log_depth")}
    m |= {f"m_{k}_mean": f"avg({MV[k]})" for k in MV}
    m |= {f"m_{k}_std": std(MV[k], "") for k in ("mid", "spread", "imb1", "imb2", "log_depth")}
    m |= {"m_count": "count(*)", "m_txv_sum": z("tv", None), "m_txc_sum": z("tc", None), "m_vwap": div(z("ap * tv", None), z("tv", None))}
    last = "m_mid_last"
    m2 = {
        "m_ret_full": f"CASE WHEN {last} > {E6} AND m_mid_first > {E6} THEN ln({last} / m_mid_first) END", "m_micro1_rel_last": rel("m_micro1_last", last),
        "m_vwap_rel": rel("m_vwap", last), "m_mid_mean_rel": rel("m_mid_mean", last),
    }
    for w in packs.MARKET_WINDOWS:
        m |= {
            f"m_count_{w}": f"count(*) {f(w)}", f"m_mid_std_{w}": std("mid", f(w)), f"m_txv_sum_{w}": z("tv", w), f"m_txc_sum_{w}": z("tc", w),
            f"m_vwap_{w}": div(z("ap * tv", w), z("tv", w)),
        }
        m |= {f"m_{k}_mean_{w}": f"avg({MV[k]}) {f(w)}" for k in ("mid", "spread", "imb1", "imb2", "micro1", "log_depth")}
        m2 |= {
            f"m_mid_mean_rel_{w}": rel(f"m_mid_mean_{w}", last), f"m_micro1_rel_{w}": rel(f"m_micro1_mean_{w}", last),
            f"m_vwap_rel_{w}": rel(f"m_vwap_{w}", last), f"m_txv_share_{w}": share(f"m_txv_sum_{w}", "m_txv_sum"),
            f"m_txc_share_{w}": share(f"m_txc_sum_{w}", "m_txc_sum"),
        }
    t = {"t_price_last": f"first(price {NEAR})", "t_price_first": f"first(price {FAR})", "t_price_range": "max(price) - min(price)",
         "t_vol_mean": "avg(volume)", "t_vol_std": std("volume", ""), "t_amount_sum": "sum(price * volume)",
         "t_log_vol_mean": "avg(ln(1 + volume))", "t_last_signed_side": f"first(sgn {NEAR})"}
    o = {"o_price_last": f"first(price {NEAR})", "o_vol_mean": "avg(volume)", "o_vol_std": std("volume", ""),
         "o_log_vol_mean": "avg(ln(1 + volume))", "o_last_side": f"first(sgn {NEAR})", "o_last_action": f"first(1 - 2 * act {NEAR})"}
    for n, cond in (("buy_new", "act = 0 AND side = 0"), ("sell_new", "act = 0 AND side = 1"), ("buy_cancel", "act = 1 AND side = 0"), ("sell_cancel", "act = 1 AND side = 1")):
        o[f"o_{n}"] = sum_if("volume", cond)
    t2 = {"t_ret_full": f"CASE WHEN t_price_last > {E6} AND t_price_first > {E6} THEN ln(t_price_last / t_price_first) END",
          "t_signed_amount_per_vol": share("t_signed_amount", "t_vol_sum")}
    o2 = {}
    for w in (None, *packs.FLOW_WINDOWS):
        s = "" if w is None else f"_{w}"
        g = "TRUE" if w is None else f"t <= {w}"
        t |= {
            f"t_count{s}": f"count(*) {f(w)}", f"t_vol_sum{s}": z("volume", w), f"t_price_mean{s}": f"avg(price) {f(w)}",
            f"t_price_std{s}": std("price", f(w)), f"t_vwap{s}": div(z("price * volume", w), z("volume", w)),
            f"t_buy_vol{s}": sum_if("volume", g + " AND side = 0"), f"t_sell_vol{s}": sum_if("volume", g + " AND side = 1"),
            f"t_buy_count{s}": f"count(*) FILTER (WHERE {g} AND side = 0)", f"t_sell_count{s}": f"count(*) FILTER (WHERE {g} AND side = 1)",
            f"t_signed_vol{s}": z("sgn * volume", w), f"t_signed_amount{s}": z("sgn * price * volume", w),
        }
        t2 |= {
            f"t_signed_ratio{s}": share(f"t_signed_vol{s}", f"t_vol_sum{s}"), f"t_vol_imb{s}": share(f"t_buy_vol{s} - t_sell_vol{s}", f"t_vol_sum{s}"),
            f"t_buy_vol_share{s}": share(f"t_buy_vol{s}", f"t_vol_sum{s}"), f"t_buy_trade_ratio{s}": share(f"t_buy_count{s}", f"t_count{s}"),
        }
        o |= {
            f"o_count{s}": f"count(*) {f(w)}", f"o_vol_sum{s}": z("volume", w), f"o_price_mean{s}": f"avg(price) {f(w)}",
            f"o_price_std{s}": std("price", f(w)), f"o_signed_vol{s}": z("sgn * volume", w), f"o_action_vol{s}": z("(1 - 2 * act) * volume", w),
            f"o_pressure{s}": z("sgn * (1 - 2 * act) * volume", w), f"o_new_vol{s}": sum_if("volume", g + " AND act = 0"),
            f"o_cancel_vol{s}": sum_if("volume", g + " AND act = 1"), f"ni{s}": sum_if("sgn * volume", g + " AND act = 0"),
            f"ci{s}": sum_if("sgn * volume", g + " AND act = 1"),
        }
        o2 |= {
            f"o_signed_ratio{s}": share(f"o_signed_vol{s}", f"o_vol_sum{s}"), f"o_action_ratio{s}": share(f"o_action_vol{s}", f"o_vol_sum{s}"),
            f"o_pressure_ratio{s}": share(f"o_pressure{s}", f"o_vol_sum{s}"), f"o_cancel_ratio{s}": share(f"o_cancel_vol{s}", f"o_vol_sum{s}"),
            f"o_new_imb{s}": share(f"ni{s}", f"o_new_vol{s}"), f"o_cancel_imb{s}": share(f"ci{s}", f"o_cancel_vol{s}"),
        }
        if s:
            t2 |= {f"t_vol_share{s}": share(f"t_vol_sum{s}", "t_vol_sum"), f"t_count_share{s}": share(f"t_count{s}", "t_count")}
            o2 |= {f"o_vol_share{s}": share(f"o_vol_sum{s}", "o_vol_sum"), f"o_count_share{s}": share(f"o_count{s}", "o_count")}
    return (m, m2), (t, t2), (o, o2)


PARTS = pack_columns()
PACK_STEPS = []
for (first, second), src in zip(PARTS, ("mk", "tx", "od")):
    PACK_STEPS.append(f"{src}_a AS (SELECT sample_id, {cols(first)} FROM {src} GROUP BY sample_id)")
    PACK_STEPS.append(f"{src}_b AS (SELECT *, {cols(second)} FROM {src}_a)")
PACK_NAMES = [n for a, b in PARTS for n in [*a, *b] if n[:2] not in ("ni", "ci")]
PACK_JOIN = "spine LEFT JOIN mk_b USING (sample_id) LEFT JOIN tx_b USING (sample_id) LEFT JOIN od_b USING (sample_id)"


@register(
    "window_pack",
    query(["mk", "tx", "od", "spine"], f"SELECT sample_id, {', '.join(PACK_NAMES)} FROM {PACK_JOIN}", steps=PACK_STEPS),
)
def window_pack(spark, path):
    s = streams(spark, path)
    return present(packs.window_pack(s.market, s.transaction, s.order, s.spine))


def _contrasts():
    out = {}
    pairs = lambda ws: list(dict.fromkeys(list(zip(ws, ws[1:])) + [(w, ws[-1]) for w in ws[:-1]]))
    for a, b in pairs((30, 60, 300, 600)):
        for n, k in (("imb1", "imb1_mean"), ("imb2", "imb2_mean"), ("spread", "spread_mean"), ("mid_rel", "mid_mean_rel")):
            out[f"m_{n}_delta_{a}_{b}"] = f"m_{k}_{a} - m_{k}_{b}"
        out[f"m_txv_ratio_{a}_{b}"] = share(f"m_txv_sum_{a}", f"m_txv_sum_{b}")
    for a, b in pairs((10, 30, 60)):
        for p, n, k in (
            ("t", "signed", "signed_ratio"), ("t", "buy_trade", "buy_trade_ratio"), ("t", "vol_imb", "vol_imb"), ("o", "pressure", "pressure_ratio"),
            ("o", "cancel", "cancel_ratio"), ("o", "new_imb", "new_imb"), ("o", "cancel_imb", "cancel_imb"),
        ):
            out[f"{p}_{n}_delta_{a}_{b}"] = f"{p}_{k}_{a} - {p}_{k}_{b}"
        for p in "to":
            out[f"{p}_vol_ratio_{a}_{b}"] = share(f"{p}_vol_sum_{a}", f"{p}_vol_sum_{b}")
    out |= {
        "x_m_spread_imb_last": "m_spread_last * m_imb1_last", "x_m_spread_imb_mean": "m_spread_mean * m_imb1_mean",
        "x_t_last_vs_mid": rel("t_price_last", "m_mid_last"), "x_t_vol_to_m_txv": share("t_vol_sum", "m_txv_sum"),
        "x_o_new_to_m_txv": share("o_new_vol", "m_txv_sum"), "x_o_cancel_to_m_txv": share("o_cancel_vol", "m_txv_sum"),
    }
    for s in ("", "_10", "_30", "_60"):
        out |= {
            f"x_t_vwap_vs_mid{s}": rel(f"t_vwap{s}", "m_mid_last"), f"x_t_signed_x_mimb{s}": f"t_signed_ratio{s} * m_imb1_last",
            f"x_o_pressure_x_mimb{s}": f"o_pressure_ratio{s} * m_imb1_last", f"x_o_new_minus_cancel_imb{s}": f"o_new_imb{s} - o_cancel_imb{s}",
            f"x_net_flow_pressure{s}": f"t_signed_ratio{s} + o_pressure_ratio{s}", f"x_t_minus_o_pressure{s}": f"t_signed_ratio{s} - o_pressure_ratio{s}",
            f"x_o_cancel_to_t_vol{s}": share(f"o_cancel_vol{s}", f"t_vol_sum{s}"), f"x_o_new_to_t_vol{s}": share(f"o_new_vol{s}", f"t_vol_sum{s}"),
        }
    for w in (30, 60):
        out |= {
            f"x_t_vwap_vs_m_vwap_{w}": rel(f"t_vwap_{w}", f"m_vwap_{w}"), f"x_t_signed_x_mimb_mean_{w}": f"t_signed_ratio_{w} * m_imb1_mean_{w}",
            f"x_o_pressure_x_mimb_mean_{w}": f"o_pressure_ratio_{w} * m_imb1_mean_{w}",
        }
    return query(["mk", "tx", "od", "spine"], f"SELECT sample_id, {cols(out)} FROM {PACK_JOIN}", steps=PACK_STEPS)


@register("window_contrasts", _contrasts())
def window_contrasts(spark, path):
    s = streams(spark, path)
    return present(packs.window_contrasts(packs.window_pack(s.market, s.transaction, s.order, s.spine)))


T8 = "1e-8::DOUBLE"


def _rolling_sql():
    w = lambda k: f"exp(-t / {k})"
    halves = lambda x: (f"avg({x}) FILTER (WHERE idx <= n * 0.5)", f"avg({x}) FILTER (WHERE idx > n * 0.5)")
    thirds = lambda x: (f"coalesce(sum({x}) FILTER (WHERE idx <= n * 0.33::DOUBLE), 0)", f"coalesce(sum({x}) FILTER (WHERE idx > n * 0.67::DOUBLE), 0)")
    skew = lambda x, f="": (
        f"(CASE WHEN var_pop({x}) {f} > 0 THEN (avg(pow({x} - 1, 3)) {f} - 3 * (avg({x}) {f} - 1) * avg(pow({x} - 1, 2)) {f} + 2 * pow(avg({x}) {f} - 1, 3)) / pow(var_pop({x}) {f}, 1.5) END)"
    )
    hp, hg, hgap, tv = halves("price"), halves("sgn"), halves("abs(t - pt)"), thirds("volume")
    t = {
        "t_vol_sum": "sum(volume)", "t_lv_mean": "avg(ln(1 + volume))", "t_px_std": "stddev_samp(price)", "t_buy_ratio": "avg((sgn > 0)::INT)",
        "t_vwap": f"sum(price * volume) / (sum(volume) + {T8})", "t_price_volatility": "stddev_samp(price / pp - 1)",
        "t_price_range_ratio": f"(max(price) - min(price)) / (avg(price) + {T8})", "t_avg_signed_vol": f"avg(sgn * volume / (volume + {T8}))",
        "t_px_skew": skew("price"), "t_buy_sell_vol_ratio": f"{sum_if('volume', 'side = 0')} / ({sum_if('volume', 'side = 1')} + {T8})",
        "t_large_buy_90": "count(*) FILTER (WHERE volume > q90 AND side = 0)", "t_large_sell_90": "count(*) FILTER (WHERE volume > q90 AND side = 1)",
        "t_large_sell_95": "count(*) FILTER (WHERE volume > q95 AND side = 1)", "t_avg_time_gap": "avg(abs(t - pt))", "t_time_gap_std": "stddev_samp(abs(t - pt))",
        "t_max_time_gap": "max(abs(t - pt))", "t_time_range": "max(t) - min(t)", "t_n": "count(*)",
        "t_price_first_half_vs_second": f"{hp[0]} / ({hp[1]} + {T8}) - 1", "t_buy_ratio_first_half_vs_second": f"{hg[0]} - {hg[1]}",
        "t_vol_first_third_vs_last": f"{tv[0]} / ({tv[1]} + {T8})", "t_price_change_first_to_last": f"first(price {NEAR}) - first(price ORDER BY t DESC, seq)",
        "t_gap_first_half_vs_second": f"{hgap[0]} / ({hgap[1]} + {T8})", "t_price_weighted_15": f"sum({w(15)} * price)",
        "t_value_weighted_30": f"sum({w(30)} * volume * price)",
    }
    o = {
        "o_vol_sum": "sum(volume)", "o_sv_sum": "sum(sgn * volume)", "o_buy_ratio": "avg((sgn > 0)::INT)", "o_px_std": "stddev_samp(price)",
        "o_px_skew": skew("price"), "o_bid_depth": sum_if("volume", "side = 0"), "o_ask_depth": sum_if("volume", "side = 1"),
        "o_market_ratio": "avg((act = 0)::INT)", "o_avg_time_gap": "avg(abs(t - pt))", "o_time_gap_std": "stddev_samp(abs(t - pt))",
        "o_price_first_half_vs_second": f"{hp[0]} / ({hp[1]} + {T8}) - 1", "o_vol_first_third_vs_last": f"{tv[0]} / ({tv[1]} + {T8})",
        "o_av_weighted_30": f"sum({w(30)} * (1 - 2 * act) * volume)", "o_n": "count(*)",
    }
    for k in (15, 30):
        for p, d in (("t", t), ("o", o)):
            d |= {f"{p}_vol_weighted_{k}": f"sum({w(k)} * volume)", f"{p}_sv_weighted_{k}": f"sum({w(k)} * sgn * volume)"}
    for k in (15, 30, 45):
        f = f"FILTER (WHERE t <= {k})"
        t |= {
            f"t_vol_{k}": f"coalesce(sum(volume) {f}, 0)", f"t_sv_{k}": f"coalesce(sum(sgn * volume) {f}, 0)", f"t_lv_mean_{k}": f"avg(ln(1 + volume)) {f}",
            f"t_buy_ratio_{k}": f"avg((sgn > 0)::INT) {f}", f"t_n_{k}": f"count(*) {f}", f"t_px_std_{k}": f"stddev_samp(price) {f}",
            f"t_avg_signed_vol_{k}": f"avg(sgn * volume / (volume + {T8})) {f}", f"t_px_skew_{k}": skew("price", f),
            f"t_price_range_ratio_{k}": f"(max(price) {f} - min(price) {f}) / (avg(price) {f} + {T8})",
        }
        o |= {
            f"o_vol_{k}": f"coalesce(sum(volume) {f}, 0)", f"o_sv_{k}": f"coalesce(sum(sgn * volume) {f}, 0)",
            f"o_av_{k}": f"coalesce(sum((1 - 2 * act) * volume) {f}, 0)", f"o_buy_ratio_{k}": f"avg((sgn > 0)::INT) {f}", f"o_n_{k}": f"count(*) {f}",
            f"o_market_ratio_{k}": f"avg((act = 0)::INT) {f}",
        }
    z = lambda x, c: f"coalesce(sum({x}) FILTER (WHERE {c}), 0)"
    ts = {
        "t_sec_price_mean": "avg(p)", "t_sec_price_std": "stddev_samp(p)", "t_sec_vol_mean": "avg(v)", "t_sec_price_min": "min(p)", "t_sec_price_max": "max(p)",
        "t_sec_lv_mean": "avg(ln(1 + v))", "t_sec_has_data_ratio": "count(p) / 61", "t_sec_price_trend": f"sum((p - mp) * (s - 30)) / (18910 + {T8})",
        "t_sec_autocorr_lag1": f"sum((p - mp) * (l1 - ml1)) / (sum(pow(p - mp, 2)) + {T8})",
        "t_sec_autocorr_lag5": f"sum((p - mp) * (l5 - ml5)) / (sum(pow(p - mp, 2)) + {T8})", "t_sec_sgn_weighted_15": "sum(exp(-s / 15.0::DOUBLE) * g)",
        "t_sec_vol_15": z("v", "s <= 15"), "t_sec_price_mean_15": "avg(p) FILTER (WHERE s <= 15)", "t_sec_price_mean_45": "avg(p) FILTER (WHERE s <= 45)",
        "t_sec_has_data_15": "count(p) FILTER (WHERE s <= 15)",
    }
    os_ = {
        "o_sec_price_mean": "avg(p)", "o_sec_price_std": "stddev_samp(p)", "o_sec_new_count": "sum(nn)", "o_sec_cancel_new_ratio": f"sum(nc) / (sum(nn) + {T8})",
        "o_sec_cancel_volume": "sum(vc)", "o_sec_new_volume": "sum(vn)", "o_sec_has_data_ratio": "count(p) / 61",
        "o_sec_sgn_weighted_15": "sum(exp(-s / 15.0::DOUBLE) * g)", "o_sec_price_mean_15": "avg(p) FILTER (WHERE s <= 15)",
        "o_sec_price_mean_30": "avg(p) FILTER (WHERE s <= 30)", "o_sec_row_count_15": z("k", "s <= 15"), "o_sec_has_data_15": "count(p) FILTER (WHERE s <= 15)",
        "o_sec_cancel_count_45": z("nc", "s <= 45"), "o_sec_cancel_new_ratio_15": f"{z('nc', 's <= 15')} / ({z('nn', 's <= 15')} + {T8})",
        "o_sec_cancel_new_ratio_30": f"{z('nc', 's <= 30')} / ({z('nn', 's <= 30')} + {T8})",
    }
    for k in (15, 30, 60):
        a, b = f"s <= {k / 2}", f"s <= {k} AND s > {k / 2}"
        ts |= {
            f"t_sec_price_near_far_diff_{k}": f"avg(p) FILTER (WHERE {a}) / (avg(p) FILTER (WHERE {b}) + {T8}) - 1",
            f"t_sec_vol_near_far_ratio_{k}": f"{z('v', a)} / ({z('v', b)} + {T8})", f"t_sec_rowcount_near_far_ratio_{k}": f"{z('k', a)} / ({z('k', b)} + {T8})",
        }
        for n, x in (("vol", "v"), ("rowcount", "k"), ("cancel", "nc")):
            os_[f"o_sec_{n}_near_far_ratio_{k}"] = f"{z(x, a)} / ({z(x, b)} + {T8})"
    m = {
        "m_mid_last": f"first(mid {NEAR})", "m_imb_last": f"first(imb {NEAR})", "m_mid_mean": "avg(mid)", "m_mid_std": "stddev_samp(mid)", "m_imb_mean": "avg(imb)",
        "m_imb_std": "stddev_samp(imb)", "m_sp_mean": "avg(a1 - b1)", "m_rv": "sqrt(sum(dm * dm))", "m_ofi_sum": "sum(ofi)",
        "m_ask_slope_mean": f"avg((a2 - a1) / (av2 - av1 + {T8}))", "m_bid_slope_mean": f"avg((b1 - b2) / (bv1 - bv2 + {T8}))",
        "m_mid_skew": "CASE WHEN var_pop(mid) > 0 THEN avg(pow(mid - mm, 3)) / pow(var_pop(mid), 1.5) END", "m_vol_short": "avg(r5)", "m_vol_long": "avg(r20)",
        "m_ofi_ewm_120": f"sum({w(120)} * ofi) / (sum({w(120)}) + {T8})",
    }
    for k in (60, 300):
        m |= {f"m_{n}_weighted_{k}": f"sum({w(k)} * {x})" for n, x in (("mid", "mid"), ("imb", "imb"), ("ofi", "ofi"), ("vol", "tv"))}
    for k in (60, 180):
        f = f"FILTER (WHERE t <= {k})"
        m |= {
            f"m_mid_std_{k}": f"stddev_samp(mid) {f}", f"m_sp_mean_{k}": f"avg(a1 - b1) {f}", f"m_imb_mean_{k}": f"avg(imb) {f}",
            f"m_rv_{k}": f"sqrt(coalesce(sum(dm * dm) {f}, 0))", f"m_ofi_sum_{k}": f"coalesce(sum(ofi) {f}, 0)", f"m_mid_range_{k}": f"max(mid) {f} - min(mid) {f}",
        }
    d = lambda a, b, e=T8: f"{a} / ({b} + {e})"
    x = {
        "x_o_signed_ratio": d("o_sv_sum", "o_vol_sum", "1"), "x_rv_60_over_full": d("m_rv_60", "m_rv"), "x_trans_order_vol_ratio": d("t_vol_sum", "o_vol_sum"),
        "x_vwap_mid_ratio": d("(t_vwap - m_mid_last)", "m_mid_last"), "x_rv_60_180_ratio": d("m_rv_60", "m_rv_180"), "x_trans_order_buy_diff": "t_buy_ratio - o_buy_ratio",
        "x_large_trade_imbalance": d("(t_large_buy_90 - t_large_sell_90)", "t_n_15"), "x_slope_imbalance": "m_bid_slope_mean - m_ask_slope_mean",
        "x_trans_order_buy_diff_15": "t_buy_ratio_15 - o_buy_ratio_15", "x_t_vol_15_45_ratio": d("t_vol_15", "t_vol_45"),
        "x_mid_zscore": d("(m_mid_last - m_mid_mean)", "m_mid_std"), "x_t_vol_weight_ratio_30": d("t_vol_weighted_30", "t_vol_30"),
        "x_o_vol_weight_ratio_15": d("o_vol_weighted_15", "o_vol_15"), "x_o_vol_weight_ratio_30": d("o_vol_weighted_30", "o_vol_30"),
        "x_t_vol_trend_15": "t_sec_vol_near_far_ratio_15 - 1", "x_tx_order_rate_ratio": d("(t_n / 60)", "o_n / 60"), "x_t_gap_stability": d("t_time_gap_std", "t_avg_time_gap"),
        "x_o_gap_stability": d("o_time_gap_std", "o_avg_time_gap"), "x_m_vol_long_short_ratio": d("m_vol_weighted_60", "m_vol_weighted_300"),
        "x_m_ofi_long_short_diff": "m_ofi_weighted_60 - m_ofi_weighted_300", "x_m_vol_regime_change": d("m_vol_short", "m_vol_long") + " - 1",
        "x_t_signed_weighted_15": d("t_sv_weighted_15", "t_vol_weighted_15"), "x_o_signed_weighted_15": d("o_sv_weighted_15", "o_vol_weighted_15"),
        "x_t_signed_weight_diff_15": f"{d('t_sv_weighted_15', 't_vol_weighted_15')} - {d('t_sv_15', 't_vol_15')}",
        "x_o_signed_weight_diff_15": f"{d('o_sv_weighted_15', 'o_vol_weighted_15')} - {d('o_sv_15', 'o_vol_15')}", "x_m_imb_trend": "m_imb_weighted_60 - m_imb_weighted_300",
        "x_sec_price_mid_diff": "t_sec_price_mean - m_mid_mean", "x_sec_has_data_imb": "t_sec_has_data_ratio * m_imb_mean",
        "x_sec_cancel_spread": "o_sec_cancel_new_ratio * m_sp_mean", "x_sec_tx_order_data_ratio_diff": "t_sec_has_data_ratio - o_sec_has_data_ratio",
        "x_sec_t_max_missing_ratio": "1 - t_sec_has_data_ratio", "x_sec_price_trend_normalized": d("t_sec_price_trend", "t_sec_price_std"),
        "x_sec_price_trend_acceleration": "t_sec_price_near_far_diff_15 - t_sec_price_near_far_diff_30",
    }
    kept = [n for names in packs.KEPT.values() for n in names.split()]
    ev = lambda src: (
        f"(SELECT *, lag(t) {W} AS pt, lag(price) {W} AS pp, row_number() OVER (PARTITION BY sample_id ORDER BY t, seq) AS idx, count(*) OVER (PARTITION BY sample_id) AS n FROM {src})"
    )
    sec = lambda src, extra: (
        f"(SELECT sample_id, round_even(t, 0)::INT AS s, avg(price) AS p, sum(volume) AS v, count(*) AS k, CASE WHEN min(sgn) > 0 THEN 1.0 ELSE -1.0 END AS g{extra} FROM {src} GROUP BY ALL)"
    )
    big = lambda q: f"(SELECT max(volume) FROM (SELECT volume, row_number() OVER (ORDER BY volume) - 1 AS r, count(*) OVER () AS n FROM tx) WHERE r = round((n - 1) * {q}::DOUBLE))"
    oextra = f", count(*) FILTER (WHERE act = 0) AS nn, count(*) FILTER (WHERE act = 1) AS nc, {sum_if('volume', 'act = 0')} AS vn, {sum_if('volume', 'act = 1')} AS vc"
    roll = lambda k: f"CASE WHEN count(mv) OVER x{k} = {k} THEN avg(mv) OVER x{k} END AS r{k}"
    return query(
        ["mk", "tx", "od", "spine"],
        f"SELECT sample_id, {', '.join(kept)}, {cols(x)} FROM spine LEFT JOIN bt USING (sample_id) LEFT JOIN bo USING (sample_id) "
        "LEFT JOIN bts USING (sample_id) LEFT JOIN bos USING (sample_id) LEFT JOIN bm USING (sample_id)",
        steps=[
            f"bt AS (SELECT sample_id, {cols(t)} FROM {ev('tx')}, (SELECT {big(0.9)} AS q90, {big(0.95)} AS q95) GROUP BY sample_id)",
            f"bo AS (SELECT sample_id, {cols(o)} FROM {ev('od')} GROUP BY sample_id)",
            f"""g1 AS (SELECT sample_id, s, p, v, coalesce(k, 0) AS k, g FROM (SELECT DISTINCT sample_id FROM tx) CROSS JOIN (SELECT unnest(range(61))::INT AS s)
              LEFT JOIN {sec('tx', '')} USING (sample_id, s))""",
            "g2 AS (SELECT *, lag(p, 1) OVER (PARTITION BY sample_id ORDER BY s DESC) AS l1, lag(p, 5) OVER (PARTITION BY sample_id ORDER BY s DESC) AS l5 FROM g1)",
            "g3 AS (SELECT *, avg(p) OVER y AS mp, avg(l1) OVER y AS ml1, avg(l5) OVER y AS ml5 FROM g2 WINDOW y AS (PARTITION BY sample_id))",
            f"bts AS (SELECT sample_id, {cols(ts)} FROM g3 GROUP BY sample_id)",
            f"""h1 AS (SELECT sample_id, s, p, v, g, coalesce(k, 0) AS k, coalesce(nn, 0) AS nn, coalesce(nc, 0) AS nc, coalesce(vn, 0) AS vn, coalesce(vc, 0) AS vc
              FROM (SELECT DISTINCT sample_id FROM od) CROSS JOIN (SELECT unnest(range(61))::INT AS s) LEFT JOIN {sec('od', oextra)} USING (sample_id, s))""",
            f"bos AS (SELECT sample_id, {cols(os_)} FROM h1 GROUP BY sample_id)",
            f"""q1 AS (SELECT *, (av1 - bv1) / (av1 + bv1 + 1) AS imb, coalesce(mid - lag(mid) {W}, 0) AS dm, coalesce(av1 - lag(av1) {W}, 0) - coalesce(bv1 - lag(bv1) {W}, 0) AS ofi,
              abs(mid / lag(mid) {W} - 1) AS mv, avg(mid) OVER (PARTITION BY sample_id) AS mm FROM mk)""",
            f"""q2 AS (SELECT *, {roll(5)}, {roll(20)} FROM q1 WINDOW x5 AS (PARTITION BY sample_id ORDER BY t DESC, seq ROWS 4 PRECEDING),
              x20 AS (PARTITION BY sample_id ORDER BY t DESC, seq ROWS 19 PRECEDING))""",
            f"bm AS (SELECT sample_id, {cols(m)} FROM q2 GROUP BY sample_id)",
        ],
    )


@register("rolling_pack", _rolling_sql())
def rolling_pack(spark, path):
    s = streams(spark, path)
    return present(packs.rolling_pack(s.market, s.transaction, s.order, s.spine))


@register(
    "longest_gap",
    query(
        ["tx"],
        """SELECT sample_id, max(len) AS longest_gap FROM (SELECT sample_id, run, sum(e) AS len FROM (SELECT *, sum(CASE WHEN pe = e THEN 0 ELSE 1 END)
        OVER (PARTITION BY sample_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(e) OVER (PARTITION BY sample_id ORDER BY s) AS pe FROM g))
        GROUP BY ALL) GROUP BY sample_id""",
        steps=[
            """g AS (SELECT sample_id, s, (k IS NULL)::INT AS e FROM (SELECT DISTINCT sample_id FROM tx) CROSS JOIN (SELECT unnest(range(61))::INT AS s)
            LEFT JOIN (SELECT sample_id, round_even(t, 0)::INT AS s, count(*) AS k FROM tx GROUP BY ALL) USING (sample_id, s))"""
        ],
    ),
)
def longest_gap(spark, path):
    return present(packs.longest_gap(streams(spark, path).transaction))


def _differences_sql():
    out = {}
    for g in (1, 7, 14):
        for n in ("price", "volume"):
            a, b = f"lag({n}, {g}) {W}", f"lag({n}, {2 * g}) {W}"
            out |= {f"{n}_diff{g}": f"{n} - {a}", f"{n}_shift{g}": a, f"{n}_diff2_{g}": f"({n} - {a}) - ({a} - {b})", f"{n}_ratio{g}": f"({n} - {a}) / ({a} + {T8})"}
    return query(["tx"], f"SELECT sample_id, seq AS event_seq, {cols(out)} FROM tx", keys=("sample_id", "event_seq"))


@register("event_differences", _differences_sql())
def event_differences(spark, path):
    return present(packs.event_differences(streams(spark, path).transaction), ("sample_id", "event_seq"))


@register(
    "flow_response",
    query(
        ["mk", "tx", "spine"],
        f"""SELECT sample_id, f * greatest(least(mv, 5), -5) AS flow_price_alignment_60, f / (1 + abs(mv)) AS flow_without_price_move_60 FROM
        (SELECT sample_id, coalesce({signed('v', '60')}, 0) AS f, coalesce(CASE WHEN abs(last60_spread_1_mean) > 1e-8 THEN last60_mid_price_1_change / last60_spread_1_mean END, 0) AS mv
        FROM spine LEFT JOIN sums USING (sample_id) LEFT JOIN tables USING (sample_id))""",
        steps=[trade_sums_sql(["60"]), *TABLE_STEPS],
    ),
)
def flow_response(spark, path):
    s = streams(spark, path)
    return present(packs.flow_response(flow.trade_flow(s.transaction, s.spine), book.market_tables(s.market)))


def _aligned(w):
    a, b = f"({signed('v', w)})", f"({order_terms(w)['net']})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} * {b} > 0 THEN sign({a} + {b}) * least(abs({a}), abs({b})) ELSE 0 END"


@register(
    "flow_alignment",
    query(
        ["tx", "od", "spine"],
        f"SELECT sample_id, {_aligned('60')} AS aligned_pressure_60, {_aligned('20')} AS aligned_pressure_20 FROM o LEFT JOIN (SELECT sample_id, vb60, vs60, vb20, vs20 FROM sums) USING (sample_id)",
        steps=[trade_sums_sql(["60", "20"]), *order_sums_sql(["60", "20"])],
    ),
)
def flow_alignment(spark, path):
    s = streams(spark, path)
    return present(packs.flow_alignment(flow.trade_flow(s.transaction, s.spine), flow.order_flow(s.order, s.spine)))


_r = lambda a, b: f"CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} END"


@register(
    "relative_scale",
    query(
        ["mk"],
        "SELECT sample_id, "
        + cols(
            {
                "x_recent60_trade_count_share": _r("last60_transaction_count_sum", "transaction_count_sum"),
                "x_recent60_trade_volume_share": _r("last60_transaction_volume_sum", "transaction_volume_sum"),
                "x_trade_count_peak_share": _r("transaction_count_max", "transaction_count_sum"),
                "x_trade_volume_peak_share": _r("transaction_volume_max", "transaction_volume_sum"),
            }
        )
        + " FROM tables",
        steps=TABLE_STEPS,
    ),
)
def relative_scale(spark, path):
    return present(packs.relative_scale(book.market_tables(streams(spark, path).market)))
