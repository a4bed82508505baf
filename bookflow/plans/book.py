"""Quote-book families without row order, with their check SQL."""

from ..operators import book
from ..sources.adapters import streams
from .flow import order_summary_sql, trade_summary_sql
from .registry import present, register
from .sql import cols, query, sum_if

REL = "(a1 - b1) / greatest(mid, 1e-9)"
I1 = "(bv1 - av1) / (bv1 + av1 + 1)"
I2 = "(bv1 + bv2 - av1 - av2) / (bv1 + bv2 + av1 + av2 + 1)"
LAST = "ORDER BY t, seq DESC"


def bucket_sql(edges):
    cases = " ".join(f"WHEN t <= {e} THEN {i}" for i, e in enumerate(edges))
    return f"CASE {cases} ELSE {len(edges)} END"


def slope_sql(y, x="t"):
    """Moment slope of y on x over rows where y is known."""
    xk = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    return (
        f"(avg({y} * {x}) - avg({xk}) * avg({y})) / "
        f"greatest(avg(({xk}) * {x}) - avg({xk}) * avg({xk}), 1e-9)"
    )


def pop_std(x):
    return f"sqrt(greatest(avg(({x}) * ({x})) - avg({x}) * avg({x}), 0))"


def market_summary_sql(reading):
    back = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} - 1 ELSE 0 END"
    first = {
        "n": "count(*)", "mxv": "max(tv)", "mxc": "max(tc)", "sv": "sum(tv)", "sc": "sum(tc)",
        "v60": sum_if("tv", "t <= 60"), "v300": sum_if("tv", "t > 60 AND t <= 300"),
        "first_ap": "first(ap ORDER BY t DESC, seq DESC)", "l_ap": f"first(ap {LAST})",
        "l_tv": f"first(tv {LAST})", "l_tc": f"first(tc {LAST})", "l_mid": f"first(mid {LAST})",
        "mk_spread": f"first({REL} {LAST})", "mk_imb1": f"first({I1} {LAST})", "mk_imb2": f"first({I2} {LAST})",
        "mk_slope_px": slope_sql("ap"), "mk_px_vol": f"{pop_std('ap')} / avg(ap)",
        "mk_slope_mid": slope_sql("mid"), "mk_mid_vol": f"{pop_std('mid')} / avg(mid)",
        "mk_spread_mean": "avg(a1 - b1) / avg(mid)", "mk_relspread_mean": f"avg({REL})",
        "mk_imb1_mean": f"avg({I1})", "mk_imb2_mean": f"avg({I2})",
    }
    for h in (30, 60, 120, 300):
        for f in ("ap", "tv", "mid"):
            first[f"{f}_{h}"] = f"first({f} ORDER BY abs(t - {h}), t, seq DESC)"
    kept = [k for k in first if k.startswith("mk_")]
    if reading == "cumulative":
        v60, v300, tot, cnt = "(l_tv - tv_60)", "(tv_60 - tv_300)", "mxv", "mxc"
    else:
        v60, v300, tot, cnt = "v60", "v300", "sv", "sc"
    out = {
        "mk_ret10m": back("l_ap", "first_ap"), "mk_vol": "l_tv", "mk_cnt": "l_tc",
        "mk_avgpx_dev": back("l_ap", "l_mid"), "mk_vol_last60": v60, "mk_vol_60_300": v300,
        "mk_vol_accel": f"({v60} / 60) / (greatest({v300}, 0) / 240 + 1)", "mk_vol_total": tot,
        "mk_cnt_total": cnt, "mk_nbars": "n",
    }
    for h in (30, 60, 120, 300):
        out[f"mk_ret{h}"] = back("l_ap", f"ap_{h}")
        out[f"mk_midret{h}"] = back("l_mid", f"mid_{h}")
    return [
        f"mk1 AS (SELECT sample_id, {cols(first)} FROM mk GROUP BY sample_id)",
        f"base_mk AS (SELECT sample_id, {', '.join(kept)}, {cols(out)} FROM mk1)",
    ]


BASE_JOIN = (
    "spine LEFT JOIN base_tx USING (sample_id) LEFT JOIN base_od USING (sample_id) "
    "LEFT JOIN base_mk USING (sample_id)"
)


def base_steps(reading):
    return trade_summary_sql() + order_summary_sql() + market_summary_sql(reading)


def _base(reading):
    @register(
        f"base_features_{reading}",
        query(["mk", "tx", "od", "spine"], f"SELECT * FROM {BASE_JOIN}", fill=True, steps=base_steps(reading)),
    )
    def run(spark, path):
        s = streams(spark, path)
        return present(book.base_features(s.market, s.transaction, s.order, s.spine, reading))


_base("interval")
_base("cumulative")

G = lambda n: f"coalesce({n}, 0)"
PAIRS = {
    "d_tx_imb_15_30": ("tx_imb15", "-", "tx_imb30"), "d_tx_ret_15_30": ("tx_ret15", "-", "tx_ret30"),
    "d_ret_30_60": ("mk_ret30", "-", "mk_ret60"), "d_ret_60_300": ("mk_ret60", "-", "mk_ret300"),
    "d_midret_30_60": ("mk_midret30", "-", "mk_midret60"), "d_midret_60_300": ("mk_midret60", "-", "mk_midret300"),
    "d_volfrac_15_30": ("tx_vol15_frac", "-", "tx_vol30_frac"),
    "d_ord_new_imb_30": ("ord_new_imb30", "-", "ord_new_imb"), "d_ord_net_imb_30": ("ord_net_imb30", "-", "ord_net_imb"),
    "x_tximb_mimb1": ("tx_imb", "*", "mk_imb1"), "x_tximb30_mimb1mean": ("tx_imb30", "*", "mk_imb1_mean"),
    "x_ordnew_mimb1": ("ord_new_imb", "*", "mk_imb1"), "x_ordnet_mimb1": ("ord_net_imb", "*", "mk_imb1"),
    "x_vwapdev_mimb": ("tx_vwap_dev", "*", "mk_imb1"), "x_spread_imb": ("mk_spread", "*", "mk_imb1"),
    "x_relspread_imbmean": ("mk_relspread_mean", "*", "mk_imb1_mean"),
    "x_netflow_pressure": ("tx_imb", "+", "ord_net_imb"), "x_t_minus_o": ("tx_imb", "-", "ord_net_imb"),
    "x_new_minus_cancel": ("ord_new_imb", "-", "ord_cancel_ratio"), "x_midvol_tximb": ("mk_mid_vol", "*", "tx_imb"),
}


@register(
    "base_interactions",
    query(
        ["mk", "tx", "od", "spine"],
        "SELECT sample_id, "
        + cols({k: f"{G(a)} {op} {G(b)}" for k, (a, op, b) in PAIRS.items()})
        + f" FROM {BASE_JOIN}",
        steps=base_steps("interval"),
    ),
)
def base_interactions(spark, path):
    s = streams(spark, path)
    return present(book.base_interactions(book.base_features(s.market, s.transaction, s.order, s.spine)))


def bucket_query(edges, values, name, streams_=("mk", "spine"), source="mk", final=None, steps=()):
    """Group by (sample, bucket), then one column per bucket and value."""
    wide = {name(i, v): f"max({v}) FILTER (WHERE b = {i})" for i in range(len(edges) + 1) for v in values}
    grouped = f"g AS (SELECT sample_id, {bucket_sql(edges)} AS b, {cols(values)} FROM {source} GROUP BY ALL)"
    w = f"w AS (SELECT sample_id, {cols(wide)} FROM g GROUP BY sample_id)"
    chosen = "*" if final is None else f"sample_id, {cols(final)}"
    return query(
        list(streams_), f"SELECT {chosen} FROM spine LEFT JOIN w USING (sample_id)", fill=True,
        steps=list(steps) + [grouped, w],
    )


BOOK_VALUES = {
    "slope": slope_sql("ap"), "pstd": f"{pop_std('ap')} / abs(avg(ap))", "spread": "avg(a1 - b1)",
    "relspread": f"avg({REL})", "imb1": f"avg({I1})", "imb2": f"avg({I2})",
    "micro": "avg((a1 * bv1 + b1 * av1) / greatest(av1 + bv1, 1) / greatest(mid, 1e-9) - 1)",
    "maxtv": "max(tv)", "n": "count(*)",
    "ret": "(first(ap ORDER BY t, seq) FILTER (WHERE ap IS NOT NULL) / "
           "first(ap ORDER BY t DESC, seq) FILTER (WHERE ap IS NOT NULL)) - 1",
}


def _book_bucket_sql(edges, prefix, ret):
    names = [v for v in BOOK_VALUES if v != "n" and (ret or v != "ret")]
    n = range(len(edges) + 1)
    total = " + ".join(f"coalesce({prefix}{i}_n, 0)" for i in n)
    final = {f"{prefix}{i}_{v}": f"{prefix}{i}_{v}" for i in n for v in names}
    final |= {f"{prefix}{i}_barfrac": f"coalesce({prefix}{i}_n, 0) / greatest({total}, 1)" for i in n}
    return bucket_query(edges, BOOK_VALUES, lambda i, v: f"{prefix}{i}_{v}", final=final)


@register("book_buckets", _book_bucket_sql((60, 180, 300), "b", False))
def book_buckets(spark, path):
    s = streams(spark, path)
    return present(book.book_buckets(s.market, s.spine))


@register("book_buckets_fine", _book_bucket_sql((30, 90, 180, 300, 450), "c", True))
def book_buckets_fine(spark, path):
    s = streams(spark, path)
    return present(book.book_buckets(s.market, s.spine, book.FINE_EDGES, "c", endpoint_return=True))


RANGE_VALUES = {
    "hlrange": "(max(ap) - min(ap)) / greatest(avg(ap), 1e-9)", "tvrange": "max(tv) - min(tv)",
    "sbpspan": "max(t) - min(t)",
}


@register(
    "range_buckets",
    bucket_query(
        (60, 180, 300), RANGE_VALUES, lambda i, v: f"r{i}_{v}",
        final={f"r{i}_{v}": f"r{i}_{v}" for i in range(4) for v in RANGE_VALUES}
        | {"r_gap_to_predict": "(SELECT min(t) FROM mk WHERE mk.sample_id = spine.sample_id)",
           "r_total_span": "(SELECT max(t) - min(t) FROM mk WHERE mk.sample_id = spine.sample_id)"},
    ),
)
def range_buckets(spark, path):
    s = streams(spark, path)
    return present(book.range_buckets(s.market, s.spine))


@register(
    "level_gap_buckets",
    bucket_query(
        (60, 180, 300),
        {
            "askgap": "avg((a2 - a1) / greatest(mid, 1e-9))", "bidgap": "avg((b1 - b2) / greatest(mid, 1e-9))",
            "l1vshare": "avg((av1 + bv1) / greatest(av1 + bv1 + av2 + bv2, 1e-9))",
            "l12volgap": "avg((av1 + bv1 - av2 - bv2) / greatest(av1 + bv1 + av2 + bv2, 1e-9))",
        },
        lambda i, v: f"s{i}_{v}",
    ),
)
def level_gap_buckets(spark, path):
    s = streams(spark, path)
    return present(book.level_gap_buckets(s.market, s.spine))


def _pressure_steps(edges, masked):
    keep = (lambda x: f"CASE WHEN ok THEN {x} END") if masked else (lambda x: x)
    m = "greatest(mid, 1e-9)"
    unit = f"(CASE WHEN ok THEN {m} ELSE 1 END)"
    quote = {
        "nv": f"count({keep('1')})", "micro": f"sum({keep('(a1 * bv1 + b1 * av1) / greatest(av1 + bv1, 1e-9)')})",
        "smid": f"sum({keep('mid')})", "spread": f"avg({keep('(a1 - b1) / ' + m)})",
        "imb": "avg((bv1 - av1) / greatest(av1 + bv1, 1e-9))",
        "sla": f"avg(CASE WHEN a1 > 0 AND a2 > 0 THEN (a2 - a1) / {unit} END)" if masked else f"avg((a2 - a1) / {m})",
        "slb": f"avg(CASE WHEN b1 > 0 AND b2 > 0 THEN (b1 - b2) / {unit} END)" if masked else f"avg((b1 - b2) / {m})",
    }
    trades = {"tsv": "sum(volume * sgn)", "tamt": "sum(price * volume * sgn)", "ttv": "sum(volume)"}
    orders = {
        f"{a}{s}": sum_if("volume", f"act = {act} AND side = {side}")
        for a, act in (("n", 0), ("c", 1))
        for s, side in (("b", 0), ("s", 1))
    }
    b = bucket_sql(edges)
    allc = [*quote, *trades, *orders]
    z = ", ".join(f"coalesce({k}, 0) AS {k}" for k in allc)
    return [
        f"q AS (SELECT sample_id, {b} AS b, {cols(quote)} FROM mk GROUP BY ALL)",
        f"tr AS (SELECT sample_id, {b} AS b, {cols(trades)} FROM tx GROUP BY ALL)",
        f"o AS (SELECT sample_id, {b} AS b, {cols(orders)} FROM od GROUP BY ALL)",
        f"j AS (SELECT sample_id, b, {z} FROM spine CROSS JOIN range({len(edges) + 1}) r(b) LEFT JOIN q USING (sample_id, b) "
        "LEFT JOIN tr USING (sample_id, b) LEFT JOIN o USING (sample_id, b))",
    ]


MICRO_DEV = "CASE WHEN nv > 0 THEN micro / greatest(smid, 1e-9) - 1 ELSE 0 END"


def _early_sql(masked):
    values = {
        "m_micro_dev": MICRO_DEV, "m_spread": "spread", "m_imb1": "imb", "t_signvol": "tsv",
        "t_signvol_frac": "tsv / greatest(ttv, 1e-9)",
        "t_signamt": "CASE WHEN nv > 0 THEN tamt / greatest(smid / nv, 1e-9) ELSE 0 END", "t_vol": "ttv", "o_newpress": "nb - ns",
        "o_canimb": "(cs - cb) / greatest(cs + cb, 1e-9)", "o_netplace": "(nb + ns) - (cb + cs)",
    }
    wide = {f"x21_{v[0]}{i}_{v[2:]}": f"max({x}) FILTER (WHERE b = {i})" for i in range(3) for v, x in values.items()}
    return query(
        ["mk", "tx", "od", "spine"], f"SELECT sample_id, {cols(wide)} FROM j GROUP BY sample_id",
        steps=_pressure_steps((10, 30), masked),
    )


def _level_sql(masked):
    values = {
        "sla": "sla", "slb": "slb", "sv": "tsv", "svXimb": "tsv * imb", "cnrb": "cb / greatest(nb, 1e-9)",
        "cnrs": "cs / greatest(ns, 1e-9)", "net": "(nb - cb) - (ns - cs)",
    }
    at = lambda x, i: f"max({x}) FILTER (WHERE b = {i})"
    wide = {f"x22_{v}{i}": at(x, i) for i in range(3) for v, x in values.items()}
    for name, x, i, k in (
        ("sv_01", "tsv", 0, 1), ("sv_12", "tsv", 1, 2), ("imb_02", "imb", 0, 2), ("imb_0L", "imb", 0, 4),
        ("spr_0L", "spread", 0, 4), ("mic_0L", MICRO_DEV, 0, 4),
    ):
        wide[f"x22_d_{name}"] = f"{at(x, i)} - {at(x, k)}"
    return query(
        ["mk", "tx", "od", "spine"], f"SELECT sample_id, {cols(wide)} FROM j GROUP BY sample_id",
        steps=_pressure_steps((10, 30, 60, 300), masked),
    )


def _pressure(name, fn, sql, masked):
    @register(name, sql(masked))
    def run(spark, path):
        s = streams(spark, path)
        return present(fn(s.market, s.transaction, s.order, s.spine, masked))


_pressure("early_flow", book.early_flow, _early_sql, False)
_pressure("early_flow_masked", book.early_flow, _early_sql, True)
_pressure("level_flow", book.level_flow, _level_sql, False)
_pressure("level_flow_masked", book.level_flow, _level_sql, True)


def market_tables_sql():
    A, R = "", "FILTER (WHERE t <= 60)"
    fst, lst = "ORDER BY t DESC, seq", "ORDER BY t, seq DESC"
    known = lambda r: f"FILTER (WHERE ap IS NOT NULL{' AND t <= 60' if r else ''})"
    out = {
        "market_row_count": "count(*)", "seconds_max": "max(t)", "seconds_min": "min(t)",
        "long_gap_count": "count(*) FILTER (WHERE abs(t - pt) > 4.5)",
        "transaction_count_mean": "avg(tc)", "transaction_volume_mean": "avg(tv)",
        "transaction_avgprice_std": "stddev_samp(ap)", "transaction_avgprice_min": "min(ap)",
        "transaction_avgprice_max": "max(ap)",
        "transaction_avgprice_first_valid": f"first(ap {fst}) {known(False)}",
        "last60_row_count": f"count(*) {R}", "last60_transaction_avgprice_std": f"stddev_samp(ap) {R}",
    }
    for p, f in (("", A), ("last60_", R)):
        out |= {
            f"{p}transaction_count_sum": f"sum(tc) {f}", f"{p}transaction_count_max": f"max(tc) {f}",
            f"{p}has_transaction_ratio": f"avg(CASE WHEN tc > 0 THEN 1.0 ELSE 0.0 END) {f}",
            f"{p}transaction_volume_sum": f"sum(tv) {f}", f"{p}transaction_volume_max": f"max(tv) {f}",
            f"{p}transaction_avgprice_mean": f"avg(ap) {f}",
            f"{p}transaction_avgprice_last_valid": f"first(ap {lst}) {known(p)}",
        }
    for n in (1, 2):
        for side, x in (("ask", "a"), ("bid", "b")):
            p, v, x, y = f"{side}_price_{n}", f"{side}_volume_{n}", f"{x}{n}", f"{x}v{n}"
            out |= {
                f"{p}_mean": f"avg({x})", f"{p}_std": f"stddev_samp({x})", f"{p}_min": f"min({x})",
                f"{p}_max": f"max({x})", f"{p}_first": f"first({x} {fst})", f"{p}_last": f"first({x} {lst})",
                f"{v}_sum": f"sum({y})", f"{v}_mean": f"avg({y})", f"{v}_max": f"max({y})",
                f"last60_{p}_mean": f"avg({x}) {R}", f"last60_{p}_std": f"stddev_samp({x}) {R}",
                f"last60_{p}_start": f"first({x} {fst}) {R}", f"last60_{p}_end": f"first({x} {lst}) {R}",
                f"last60_{v}_mean": f"avg({y}) {R}",
            }
    derived = {"seconds_coverage": "seconds_max - seconds_min"}
    for n in (1, 2):
        a, b, av, bv = f"ask_price_{n}", f"bid_price_{n}", f"ask_volume_{n}", f"bid_volume_{n}"
        imb = lambda x, y: f"CASE WHEN {x} + {y} <> 0 THEN ({x} - {y}) / ({x} + {y}) END"
        derived |= {
            f"spread_{n}_mean": f"{a}_mean - {b}_mean", f"mid_price_{n}_mean": f"({a}_mean + {b}_mean) / 2",
            f"mid_price_{n}_change": f"({a}_last + {b}_last - {a}_first - {b}_first) / 2",
            f"book_volume_imbalance_{n}": imb(f"{bv}_sum", f"{av}_sum"),
            f"last60_spread_{n}_mean": f"last60_{a}_mean - last60_{b}_mean",
            f"last60_mid_price_{n}_change": f"(last60_{a}_end + last60_{b}_end - last60_{a}_start - last60_{b}_start) / 2",
            f"last60_book_volume_imbalance_{n}": imb(f"last60_{bv}_mean", f"last60_{av}_mean"),
        }
    steps = [
        "mkp AS (SELECT *, lag(t) OVER (PARTITION BY sample_id ORDER BY t DESC, seq) AS pt FROM mk)",
        f"t1 AS (SELECT sample_id, {cols(out)} FROM mkp GROUP BY sample_id)",
        f"tables AS (SELECT *, {cols(derived)} FROM t1)",
    ]
    return steps, [*out, *derived]


STEPS, NAMES = market_tables_sql()


def _table(name, fn, keep):
    names = ", ".join(n for n in NAMES if keep(n))

    @register(name, query(["mk"], f"SELECT sample_id, {names} FROM tables", steps=STEPS))
    def run(spark, path):
        return present(fn(book.market_tables(streams(spark, path).market)))


_table("market_full", book.market_full, lambda n: not n.startswith("last60_") and "_2" not in n)
_table("market_last60", book.market_last60, lambda n: n.startswith("last60_") and "_2" not in n)
_table("market_level2", book.market_level2, lambda n: "_2" in n)


def _relations_sql():
    r = lambda n, d: f"CASE WHEN abs({d}) > 1e-12 THEN ({n}) / ({d}) END"
    out = {
        "recent_row_ratio": r("last60_row_count", "market_row_count"),
        "recent_transaction_count_share": r("last60_transaction_count_sum", "transaction_count_sum"),
        "recent_transaction_volume_share": r("last60_transaction_volume_sum", "transaction_volume_sum"),
        "recent_has_transaction_ratio_delta": "last60_has_transaction_ratio - has_transaction_ratio",
        "recent_transaction_avgprice_delta": "last60_transaction_avgprice_mean - transaction_avgprice_mean",
        "level2_spread_minus_level1_spread": "spread_2_mean - spread_1_mean",
        "level2_mid_minus_level1_mid": "mid_price_2_mean - mid_price_1_mean",
        "level2_mid_change_minus_level1_mid_change": "mid_price_2_change - mid_price_1_change",
        "level2_imbalance_minus_level1_imbalance": "book_volume_imbalance_2 - book_volume_imbalance_1",
        "ask_volume_2_to_1_sum_ratio": r("ask_volume_2_sum", "ask_volume_1_sum"),
        "bid_volume_2_to_1_sum_ratio": r("bid_volume_2_sum", "bid_volume_1_sum"),
        "total_volume_2_to_1_sum_ratio": r(
            "ask_volume_2_sum + bid_volume_2_sum", "(ask_volume_1_sum + bid_volume_1_sum)"
        ),
        "last60_level2_spread_minus_level1_spread": "last60_spread_2_mean - last60_spread_1_mean",
        "last60_level2_mid_change_minus_level1_mid_change": "last60_mid_price_2_change - last60_mid_price_1_change",
        "last60_level2_imbalance_minus_level1_imbalance":
            "last60_book_volume_imbalance_2 - last60_book_volume_imbalance_1",
        "last60_total_volume_2_to_1_mean_ratio": r(
            "last60_ask_volume_2_mean + last60_bid_volume_2_mean",
            "(last60_ask_volume_1_mean + last60_bid_volume_1_mean)",
        ),
    }
    for n in (1, 2):
        out |= {
            f"recent_spread_{n}_delta": f"last60_spread_{n}_mean - spread_{n}_mean",
            f"recent_mid_price_{n}_change_delta": f"last60_mid_price_{n}_change - mid_price_{n}_change",
            f"recent_book_imbalance_{n}_delta": f"last60_book_volume_imbalance_{n} - book_volume_imbalance_{n}",
        }
    return query(["mk"], f"SELECT sample_id, {cols(out)} FROM tables", steps=STEPS)


@register("market_relations", _relations_sql())
def market_relations(spark, path):
    return present(book.market_relations(book.market_tables(streams(spark, path).market)))


@register(
    "liquidity_tails",
    query(
        ["mk", "tx", "spine"],
        """SELECT sample_id, spread_tail_ratio_full, depth_drought_ratio_full, spread_tail_excess_relative_full,
        coalesce(trade_volume_concentration_60, 0) AS trade_volume_concentration_60
        FROM spine LEFT JOIN (SELECT sample_id, quantile_cont(a1 - b1, 0.9) / quantile_cont(a1 - b1, 0.5) AS spread_tail_ratio_full,
          quantile_cont(av1 + bv1, 0.1) / quantile_cont(av1 + bv1, 0.5) AS depth_drought_ratio_full,
          (quantile_cont(a1 - b1, 0.9) - quantile_cont(a1 - b1, 0.5)) / (abs(quantile_cont(mid, 0.5)) + 1e-8)
            AS spread_tail_excess_relative_full FROM mk GROUP BY sample_id) USING (sample_id)
        LEFT JOIN (SELECT sample_id, max(volume) / (sum(volume) + 1.0) AS trade_volume_concentration_60 FROM tx
          GROUP BY sample_id) USING (sample_id)""",
    ),
)
def liquidity_tails(spark, path):
    s = streams(spark, path)
    return present(book.liquidity_tails(s.market, s.transaction, s.spine))
