"""Trade and order families without row order, with their check SQL."""

from ..operators import flow
from ..sources.adapters import streams
from .registry import present, register
from .sql import clamp_ratio, cols, query, ratio, sum_if

WINDOWS = {"10": "t <= 10", "20": "t <= 20", "30": "t <= 30", "60": "t <= 60",
           "10_30": "t > 10 AND t <= 30", "30_60": "t > 30 AND t <= 60", "prev": "t > 20 AND t <= 60"}


def trade_sums_sql(windows):
    out = {}
    for w in windows:
        for s, code in (("b", 0), ("s", 1)):
            cond = f"{WINDOWS[w]} AND side = {code}"
            out[f"v{s}{w}"] = sum_if("volume", cond)
            out[f"n{s}{w}"] = f"count(*) FILTER (WHERE {cond})"
            out[f"a{s}{w}"] = sum_if("volume * price", cond)
    return f"sums AS (SELECT sample_id, {cols(out)} FROM tx GROUP BY sample_id)"


def signed(kind, w):
    b, s = f"coalesce({kind}b{w}, 0)", f"coalesce({kind}s{w}, 0)"
    return ratio(f"{b} - {s}", f"{b} + {s}")


def both(kind, w):
    return f"(coalesce({kind}b{w}, 0) + coalesce({kind}s{w}, 0))"


SIZE_B, SIZE_S = ratio("vb60", "nb60"), ratio("vs60", "ns60")


@register(
    "trade_flow",
    query(
        ["tx", "spine"],
        "SELECT sample_id, "
        + cols(
            {
                "trade_volume_imbalance_60": signed("v", "60"),
                "trade_volume_imbalance_20": signed("v", "20"),
                "trade_count_imbalance_60": signed("n", "60"),
                "trade_average_size_imbalance_60": ratio(
                    f"({SIZE_B}) - ({SIZE_S})", f"({SIZE_B}) + ({SIZE_S})"
                ),
                "trade_pressure_acceleration_20_vs_40": f"({signed('v', '20')}) - ({signed('v', 'prev')})",
                "log1p_total_trade_volume_60": f"ln(1 + {both('v', '60')})",
                "log1p_total_trade_count_60": f"ln(1 + {both('n', '60')})",
                "last_trade_seconds_before_predict": "last_seen",
            }
        )
        + " FROM spine LEFT JOIN sums USING (sample_id) LEFT JOIN seen USING (sample_id)",
        steps=[
            trade_sums_sql(["60", "20", "prev"]),
            "seen AS (SELECT sample_id, min(t) AS last_seen FROM tx WHERE t <= 60 GROUP BY sample_id)",
        ],
    ),
)
def trade_flow(spark, path):
    s = streams(spark, path)
    return present(flow.trade_flow(s.transaction, s.spine))


def _trade_windows_sql():
    vwap = {w: ratio(both("a", w), both("v", w)) for w in ("10", "30", "60")}
    out = {}
    for w in ("10", "30"):
        out[f"trade_volume_imbalance_{w}"] = signed("v", w)
        out[f"trade_count_imbalance_{w}"] = signed("n", w)
        out[f"trade_vwap_{w}_vs_60"] = ratio(f"({vwap[w]}) - ({vwap['60']})", vwap["60"])
        out[f"trade_volume_share_{w}_of_60"] = ratio(both("v", w), both("v", "60"))
        out[f"trade_count_share_{w}_of_60"] = ratio(both("n", w), both("n", "60"))
    for w in ("10", "30", "60"):
        out[f"trade_signed_amount_ratio_{w}"] = signed("a", w)
    out["trade_pressure_delta_10_vs_10_30"] = f"({signed('v', '10')}) - ({signed('v', '10_30')})"
    out["trade_pressure_delta_30_vs_30_60"] = f"({signed('v', '30')}) - ({signed('v', '30_60')})"
    return query(
        ["tx", "spine"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN sums USING (sample_id)",
        steps=[trade_sums_sql(["10", "30", "60", "10_30", "30_60"])],
    )


@register("trade_windows", _trade_windows_sql())
def trade_windows(spark, path):
    s = streams(spark, path)
    return present(flow.trade_windows(s.transaction, s.spine))


def order_sums_sql(windows):
    out = {}
    for w in windows:
        for s, code in (("b", 0), ("s", 1)):
            for a, act in (("n", 0), ("c", 1)):
                out[f"{a}{s}{w}"] = sum_if("volume", f"{WINDOWS[w]} AND side = {code} AND act = {act}")
        out[f"k{w}"] = f"count(*) FILTER (WHERE {WINDOWS[w]})"
    names = ", ".join(f"coalesce({n}, 0) AS {n}" for n in out)
    return [
        f"osums AS (SELECT sample_id, {cols(out)} FROM od GROUP BY sample_id)",
        f"o AS (SELECT sample_id, {names} FROM spine LEFT JOIN osums USING (sample_id))",
    ]


def order_terms(w):
    nb, ns, cb, cs = (f"{k}{w}" for k in ("nb", "ns", "cb", "cs"))
    total = f"({nb} + {ns} + {cb} + {cs})"
    return {
        "new": ratio(f"{nb} - {ns}", f"{nb} + {ns}"),
        "cancel": ratio(f"{cs} - {cb}", f"{cb} + {cs}"),
        "net": ratio(f"{nb} - {ns} - {cb} + {cs}", total),
        "canratio": ratio(f"{cb} + {cs}", total),
        "total": total,
    }


O60, O20, OPREV = order_terms("60"), order_terms("20"), order_terms("prev")


@register(
    "order_flow",
    query(
        ["od", "spine"],
        "SELECT sample_id, "
        + cols(
            {
                "new_order_volume_imbalance_60": O60["new"],
                "cancel_order_pressure_60": O60["cancel"],
                "net_order_pressure_60": O60["net"],
                "buy_cancel_ratio_60": ratio("cb60", "nb60 + cb60"),
                "sell_cancel_ratio_60": ratio("cs60", "ns60 + cs60"),
                "total_cancel_ratio_60": O60["canratio"],
                "net_order_pressure_20": O20["net"],
                "net_order_pressure_acceleration_20_vs_40": f"({O20['net']}) - ({OPREV['net']})",
            }
        )
        + " FROM o",
        steps=order_sums_sql(["60", "20", "prev"]),
    ),
)
def order_flow(spark, path):
    s = streams(spark, path)
    return present(flow.order_flow(s.order, s.spine))


def _order_windows_sql():
    terms = {w: order_terms(w) for w in ("10", "30", "60", "10_30", "30_60")}
    out = {}
    for w in ("10", "30"):
        out[f"new_order_volume_imbalance_{w}"] = terms[w]["new"]
        out[f"cancel_order_pressure_{w}"] = terms[w]["cancel"]
        out[f"net_order_pressure_{w}"] = terms[w]["net"]
        out[f"total_cancel_ratio_{w}"] = terms[w]["canratio"]
        out[f"order_volume_share_{w}_of_60"] = ratio(terms[w]["total"], terms["60"]["total"])
        out[f"order_count_share_{w}_of_60"] = ratio(f"k{w}", "k60")
    out["net_order_pressure_delta_10_vs_10_30"] = f"({terms['10']['net']}) - ({terms['10_30']['net']})"
    out["net_order_pressure_delta_30_vs_30_60"] = f"({terms['30']['net']}) - ({terms['30_60']['net']})"
    out["cancel_ratio_delta_10_vs_60"] = f"({terms['10']['canratio']}) - ({terms['60']['canratio']})"
    return query(
        ["od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM o",
        steps=order_sums_sql(["10", "30", "60", "10_30", "30_60"]),
    )


@register("order_windows", _order_windows_sql())
def order_windows(spark, path):
    s = streams(spark, path)
    return present(flow.order_windows(s.order, s.spine))


COARSE = {0: "t <= 60", 1: "t > 60 AND t <= 180", 2: "t > 180 AND t <= 300", 3: "t > 300"}


def _trade_buckets_sql():
    out = {}
    for i, w in COARSE.items():
        n = f"count(*) FILTER (WHERE {w})"
        v, p = f"sum(volume) FILTER (WHERE {w})", f"sum(price) FILTER (WHERE {w})"
        pv = f"sum(price * volume) FILTER (WHERE {w})"
        out |= {
            f"t{i}_n": n,
            f"t{i}_vol": v,
            f"t{i}_buyfrac": f"{sum_if('volume', w + ' AND side = 0')} / {v}",
            f"t{i}_maxv": f"max(volume) FILTER (WHERE {w})",
            f"t{i}_vwap_dev": f"({pv} / {v}) / ({p} / {n}) - 1",
            f"t{i}_avgsz": f"{v} / {n}",
        }
    body = f"SELECT * FROM spine LEFT JOIN (SELECT sample_id, {cols(out)} FROM tx GROUP BY sample_id) USING (sample_id)"
    return query(["tx", "spine"], body, fill=True)


@register("trade_buckets", _trade_buckets_sql())
def trade_buckets(spark, path):
    s = streams(spark, path)
    return present(flow.trade_buckets(s.transaction, s.spine), fill=0)


def _order_buckets_sql():
    out = {}
    for i, w in COARSE.items():
        new, can = f"{w} AND act = 0", f"{w} AND act = 1"
        nn, nc = f"count(*) FILTER (WHERE {new})", f"count(*) FILTER (WHERE {can})"
        vn, vc = sum_if("volume", new), sum_if("volume", can)
        values = {
            "nnew": nn,
            "ncan": nc,
            "vnew": vn,
            "vcan": vc,
            "netc": f"{nn} - {nc}",
            "buyfrac_new": f"CASE WHEN {vn} > 0 THEN {sum_if('volume', new + ' AND side = 0')} / {vn} ELSE 0.5 END",
            "buyfrac_can": f"CASE WHEN {vc} > 0 THEN {sum_if('volume', can + ' AND side = 0')} / {vc} ELSE 0.5 END",
            "canratio": f"{nc} / greatest({nn}, 1)",
        }
        seen = f"count(*) FILTER (WHERE {w}) > 0"
        out |= {f"o{i}_{k}": f"CASE WHEN {seen} THEN {x} END" for k, x in values.items()}
    body = f"SELECT * FROM spine LEFT JOIN (SELECT sample_id, {cols(out)} FROM od GROUP BY sample_id) USING (sample_id)"
    return query(["od", "spine"], body, fill=True)


@register("order_buckets", _order_buckets_sql())
def order_buckets(spark, path):
    s = streams(spark, path)
    return present(flow.order_buckets(s.order, s.spine), fill=0)


def _fill_ratio_sql():
    placed, executed, out = {}, {}, {}
    for i, w in COARSE.items():
        for s, code in (("b", 0), ("s", 1)):
            rows = f"{w} AND side = {code}"
            placed[f"p{i}{s}"] = sum_if("volume", rows + " AND act = 0")
            placed[f"x{i}{s}"] = sum_if("volume", rows + " AND act = 1")
            executed[f"e{i}{s}"] = sum_if("volume", rows)
            p, x, e = (f"coalesce({k}{i}{s}, 0)" for k in "pxe")
            values = {
                "fill": f"{e} / greatest({p}, 1)",
                "fillnet": f"{e} / greatest({p} - {x}, 1)",
                "exec_logratio": f"ln(1 + {e}) - ln(1 + {p})",
                "cancelover": f"{x} / greatest({p}, 1)",
            }
            out |= {f"f{i}{s}_{k}": f"CASE WHEN {p} + {e} = 0 THEN 0 ELSE {v} END" for k, v in values.items()}
    return query(
        ["tx", "od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN a USING (sample_id) LEFT JOIN b USING (sample_id)",
        steps=[
            f"a AS (SELECT sample_id, {cols(placed)} FROM od GROUP BY sample_id)",
            f"b AS (SELECT sample_id, {cols(executed)} FROM tx GROUP BY sample_id)",
        ],
    )


@register("fill_ratio", _fill_ratio_sql())
def fill_ratio(spark, path):
    s = streams(spark, path)
    return present(flow.fill_ratio(s.transaction, s.order, s.spine))


def trade_summary_sql():
    back = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} - 1 ELSE 0 END"
    first = {
        "n": "count(*)", "v": "sum(volume)", "bv": sum_if("volume", "side = 0"),
        "sv": sum_if("volume", "side = 1"), "pv": "sum(price * volume)",
        "p2v": "sum(price * price * volume)", "tv": "sum(t * volume)", "mx": "max(volume)",
        "last_p": "first(price ORDER BY t, seq DESC)", "first_p": "first(price ORDER BY t DESC, seq DESC)",
    }
    out = {
        "tx_n": "n", "tx_vol": "v", "tx_imb": "(bv - sv) / (bv + sv + 1)", "tx_vwap": "pv / greatest(v, 1)",
        "tx_lastp": "last_p", "tx_firstp": "first_p", "tx_ret": back("last_p", "first_p"),
        "tx_vwap_dev": back("(pv / greatest(v, 1))", "last_p"), "tx_avg_trade": "v / n", "tx_max_trade": "mx",
        "tx_px_std": "sqrt(greatest(p2v / v - (pv / v) * (pv / v), 0)) / (pv / v)", "tx_recency": "tv / v",
    }
    for w in (15, 30):
        first |= {
            f"near{w}": f"first(price ORDER BY abs(t - {w}), t, seq DESC)",
            f"v{w}": sum_if("volume", f"t <= {w}"),
            f"bv{w}": sum_if("volume", f"t <= {w} AND side = 0"),
            f"sv{w}": sum_if("volume", f"t <= {w} AND side = 1"),
        }
        out[f"tx_ret{w}"] = back("last_p", f"near{w}")
        out[f"tx_vol{w}_frac"] = f"v{w} / greatest(v, 1)"
        out[f"tx_imb{w}"] = f"(bv{w} - sv{w}) / (bv{w} + sv{w} + 1)"
    return [
        f"tx1 AS (SELECT sample_id, {cols(first)} FROM tx GROUP BY sample_id)",
        f"base_tx AS (SELECT sample_id, {cols(out)} FROM tx1)",
    ]


@register(
    "base_trades",
    query(["tx", "spine"], "SELECT * FROM spine LEFT JOIN base_tx USING (sample_id)", fill=True,
          steps=trade_summary_sql()),
)
def base_trades(spark, path):
    s = streams(spark, path)
    return present(flow.on_spine(s.spine, flow.trade_summary(s.transaction)), fill=0)


def order_summary_sql():
    first = {"n_new": "count(*) FILTER (WHERE act = 0)", "n_can": "count(*) FILTER (WHERE act = 1)",
             "pvb": sum_if("price * volume", "side = 0 AND act = 0"),
             "pvs": sum_if("price * volume", "side = 1 AND act = 0")}
    for s, code in (("b", 0), ("s", 1)):
        for a, act in (("n", 0), ("c", 1)):
            first[f"{a}{s}"] = sum_if("volume", f"side = {code} AND act = {act}")
            first[f"{a}{s}30"] = sum_if("volume", f"side = {code} AND act = {act} AND t <= 30")
    bp, sp = "(pvb / greatest(nb, 1))", "(pvs / greatest(ns, 1))"
    out = {
        "ord_nnew": "n_new", "ord_ncan": "n_can", "ord_cancel_ratio": "n_can / greatest(n_new + n_can, 1)",
        "ord_buy_px": bp, "ord_sell_px": sp, "ord_px_spread": clamp_ratio(f"{sp} - {bp}", f"({sp} + {bp}) / 2", "1e-9"),
        "ord_vol30_frac": "(nb30 + ns30 + cb30 + cs30) / greatest(nb + ns + cb + cs, 1)",
    }
    for s in ("", "30"):
        out[f"ord_new_imb{s}"] = f"(nb{s} - ns{s}) / (nb{s} + ns{s} + 1)"
        out[f"ord_net_imb{s}"] = f"((nb{s} - cb{s}) - (ns{s} - cs{s})) / (nb{s} + ns{s} + cb{s} + cs{s} + 1)"
    return [
        f"od1 AS (SELECT sample_id, {cols(first)} FROM od GROUP BY sample_id)",
        f"base_od AS (SELECT sample_id, {cols(out)} FROM od1)",
    ]


@register(
    "base_orders",
    query(["od", "spine"], "SELECT * FROM spine LEFT JOIN base_od USING (sample_id)", fill=True,
          steps=order_summary_sql()),
)
def base_orders(spark, path):
    s = streams(spark, path)
    return present(flow.on_spine(s.spine, flow.order_summary(s.order)), fill=0)
