"""Ordered trade and order families with their check SQL."""

from pyspark.sql import functions as F

from ..operators import joins, trades
from ..sources.adapters import streams
from .flow import both, signed, trade_sums_sql
from .quotes import W
from .registry import present, register
from .sql import clip, cols, query, ratio, sum_if

near0 = lambda n, d: f"CASE WHEN abs({d}) > 1e-12 THEN ({n}) / ({d}) END"


def matched(source, name="m"):
    """Brute-force as-of: the latest strictly earlier quote within six seconds."""
    return f"""{name} AS (SELECT e.*, q.t AS qt, q.a1, q.b1, q.av1, q.bv1, q.a2, q.b2, q.mid FROM {source} e
      LEFT JOIN LATERAL (SELECT * FROM mk WHERE mk.sample_id = e.sample_id AND mk.t > e.t AND mk.t <= 66 AND mk.t - e.t <= 6
        ORDER BY mk.t, mk.seq DESC LIMIT 1) q ON TRUE WHERE e.t <= 60)"""


@register(
    "asof_trades",
    query(
        ["mk", "tx"],
        "SELECT sample_id, seq AS event_seq, qt AS match_seconds, a1 AS ask_price_1, b1 AS bid_price_1 FROM m",
        keys=("sample_id", "event_seq"),
        steps=[matched("tx")],
    ),
)
def asof_trades(spark, path):
    s = streams(spark, path)
    t = F.col("seconds_before_predict")
    out = joins.asof_join(
        s.transaction.filter(t <= 60), s.market.filter(t <= 66), ["ask_price_1", "bid_price_1"], tolerance=6.0
    )
    keep = out.select("sample_id", "event_seq", "match_seconds", "ask_price_1", "bid_price_1")
    return present(keep, ("sample_id", "event_seq"))


IMB = near0("bv1 - av1", "bv1 + av1")


def _trade_quote_sql():
    depth = "(CASE WHEN side = 0 THEN av1 ELSE bv1 END)"
    valid = f"(qt IS NOT NULL AND {depth} > 0)"
    priced = f"({valid} AND price > 0 AND mid > 0 AND a1 > 0 AND b1 > 0 AND a1 >= b1)"
    use, bps = f"ln(1 + volume / {depth})", "(10000 * (price - mid) / mid)"
    s, out = {}, {}
    for w in (15, 60):
        ref = f"(CASE WHEN side = 0 THEN ra{w} ELSE rb{w} END)"
        inside = f"t <= {w}"
        f, ok, okp = (f"FILTER (WHERE {inside}{x})" for x in ("", f" AND {valid}", f" AND {priced}"))
        s |= {
            f"n{w}": f"count(*) {f}", f"all{w}": f"sum(volume) {f}", f"v{w}": f"coalesce(sum(volume) {ok}, 0)",
            f"pv{w}": f"coalesce(sum(volume) {okp}, 0)", f"sg{w}": f"coalesce(sum(sgn * {use}) {ok}, 0)",
            f"gr{w}": f"coalesce(sum({use}) {ok}, 0)", f"ex{w}": f"sum(volume * {bps}) {okp}",
            f"co{w}": f"sum(volume * sgn * {bps}) {okp}", f"bk{w}": f"sum(volume * {IMB}) {ok}",
            f"th{w}": f"coalesce(sum(volume * sgn * {ref} / ({ref} + {depth})) {ok}, 0)", f"im{w}": f"max(ri{w})",
        }
        out |= {
            f"tx_depth_signed_rate_{w}": f"CASE WHEN n{w} > 0 THEN sg{w} / {w} END",
            f"tx_depth_gross_rate_{w}": f"CASE WHEN n{w} > 0 THEN gr{w} / {w} END",
            f"tx_exec_mid_bps_{w}": near0(f"ex{w}", f"pv{w}"), f"tx_effective_cost_bps_{w}": near0(f"co{w}", f"pv{w}"),
            f"tx_book_state_shift_{w}": f"({near0(f'bk{w}', f'v{w}')}) - im{w}",
            f"tx_thin_book_signed_share_{w}": near0(f"th{w}", f"v{w}"),
            f"tx_quote_matched_volume_share_{w}": near0(f"v{w}", f"all{w}"),
        }
    old = "t > 15 AND t <= 60"
    s |= {
        "no": f"count(*) FILTER (WHERE {old})", "sgo": f"coalesce(sum(sgn * {use}) FILTER (WHERE {old} AND {valid}), 0)",
        "pvo": f"coalesce(sum(volume) FILTER (WHERE {old} AND {priced}), 0)",
        "exo": f"sum(volume * {bps}) FILTER (WHERE {old} AND {priced})",
    }
    out["tx_depth_signed_accel_15_vs_15_60"] = "CASE WHEN n15 > 0 AND no > 0 THEN sg15 / 15 - sgo / 45 END"
    out["tx_exec_mid_accel_15_vs_15_60"] = f"({near0('ex15', 'pv15')}) - ({near0('exo', 'pvo')})"
    refs = ", ".join(
        f"avg(av1) FILTER (WHERE t <= {w}) AS ra{w}, avg(bv1) FILTER (WHERE t <= {w}) AS rb{w}, avg({IMB}) FILTER (WHERE t <= {w}) AS ri{w}"
        for w in (15, 60)
    )
    return query(
        ["mk", "tx", "spine"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN s USING (sample_id)",
        steps=[
            matched("tx"),
            f"ref AS (SELECT sample_id, {refs} FROM mk GROUP BY sample_id)",
            f"s AS (SELECT sample_id, {cols(s)} FROM m LEFT JOIN ref USING (sample_id) GROUP BY sample_id)",
        ],
    )


@register("trade_quote_state", _trade_quote_sql())
def trade_quote_state(spark, path):
    s = streams(spark, path)
    return present(trades.trade_quote_state(s.transaction, s.market, s.spine))


def _positions_sql(windows, names, extra):
    spans = {15: "t <= 15", 60: "t <= 60", 45: "t > 15 AND t <= 60"}
    s, col = {}, {}
    for w in windows:
        ok = f"{spans[w]} AND valid"
        new, can = f"{ok} AND act = 0", f"{ok} AND act = 1"
        s |= {
            f"all{w}": sum_if("volume", spans[w]), f"v{w}": sum_if("volume", ok), f"new{w}": sum_if("volume", new),
            f"can{w}": sum_if("volume", can),
            f"cr{w}": sum_if("sgn * volume", new + " AND ((side = 0 AND price >= a1) OR (side = 1 AND price <= b1))"),
            f"ins{w}": sum_if("sgn * volume", new + " AND price > b1 AND price < a1"),
            f"nn{w}": sum_if("sgn * volume * near", new), f"nc{w}": sum_if("-sgn * volume * near", can),
            f"net{w}": sum_if("sgn * (1 - 2 * act) * volume * near", ok),
            f"bc{w}": sum_if("volume * near", can + " AND side = 0"), f"sc{w}": sum_if("volume * near", can + " AND side = 1"),
            f"bn{w}": sum_if("volume * near", new + " AND side = 0"), f"sn{w}": sum_if("volume * near", new + " AND side = 1"),
            f"bv{w}": sum_if("volume", new + " AND side = 0"), f"sv{w}": sum_if("volume", new + " AND side = 1"),
            f"us{w}": sum_if("sgn * (1 - 2 * act) * near * ln(1 + volume / depth)", ok),
        }
        col |= {
            f"order_crossable_new_direction_share_{w}": near0(f"cr{w}", f"new{w}"),
            f"order_inside_new_direction_share_{w}": near0(f"ins{w}", f"new{w}"),
            f"order_near_new_pressure_{w}": near0(f"nn{w}", f"new{w}"),
            f"order_near_cancel_pressure_{w}": near0(f"nc{w}", f"can{w}"),
            f"order_near_net_pressure_{w}": near0(f"net{w}", f"v{w}"),
            f"order_cancel_ratio_side_diff_{w}": f"({near0(f'sc{w}', f'(sc{w} + sn{w})')}) - ({near0(f'bc{w}', f'(bc{w} + bn{w})')})",
            f"order_new_closeness_side_diff_{w}": f"({near0(f'bn{w}', f'bv{w}')}) - ({near0(f'sn{w}', f'sv{w}')})",
            f"order_depth_adjusted_net_rate_{w}": f"us{w} / {w}",
            f"order_quote_matched_volume_share_{w}": near0(f"v{w}", f"all{w}"),
        }
    out = {k: v for k, v in col.items() if int(k.rsplit("_", 1)[1]) in names}
    if extra:
        for kind in ("new", "cancel"):
            n = f"order_near_{kind}_pressure"
            out[f"order_near_{kind}_accel_15_vs_15_60"] = f"({col[n + '_15']}) - ({col[n + '_45']})"
    source = "od" if extra else "old"
    return query(
        ["mk", "od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN s USING (sample_id)",
        steps=[
            "old AS (SELECT * FROM od WHERE t > 15 AND t <= 60)",
            matched(source, "m0"),
            """m AS (SELECT *, qt IS NOT NULL AND price > 0 AND a1 > 0 AND b1 > 0 AND a1 >= b1 AND depth > 0 AS valid,
              exp(greatest(-abs(price - own) / greatest(a1 - b1, tick, 1e-8), -30)) AS near FROM (SELECT *,
              CASE WHEN side = 0 THEN b1 ELSE a1 END AS own, CASE WHEN side = 0 THEN b1 - b2 ELSE a2 - a1 END AS tick,
              CASE WHEN side = 0 THEN bv1 ELSE av1 END AS depth FROM m0))""",
            f"s AS (SELECT sample_id, {cols(s)} FROM m GROUP BY sample_id)",
        ],
    )


@register("order_quote_position", _positions_sql((15, 60, 45), (15, 60), True))
def order_quote_position(spark, path):
    s = streams(spark, path)
    return present(trades.order_quote_position(s.order, s.market, s.spine))


@register("order_quote_early", _positions_sql((45,), (45,), False))
def order_quote_early(spark, path):
    s = streams(spark, path)
    return present(trades.order_quote_early(s.order, s.market, s.spine))


LAGGED = f"tl AS (SELECT *, lag(t) {W} AS pt, lag(price) {W} AS pp FROM tx)"


@register(
    "trade_microstructure",
    query(
        ["tx", "spine"],
        """SELECT sample_id, coalesce(n0, 0) AS x25_trades_b0, coalesce(n1, 0) AS x25_trades_b1, coalesce(n2, 0) AS x25_trades_b2,
          g / gn AS x25_gap_mean, sqrt(greatest(g2 / gn - pow(g / gn, 2), 0)) AS x25_gap_sd,
          sqrt(greatest(g2 / gn - pow(g / gn, 2), 0)) / greatest(g / gn, 1e-9) AS x25_gap_cv, ln(1 + gmax) AS x25_gap_max_log,
          kn / greatest(kd, 1e-12) AS x25_kyle, i_n / greatest(i_d, 1e-9) AS x25_impact, mv / n AS x25_move_share,
          m AS x25_size_mean, sd AS x25_size_sd,
          CASE WHEN sd > 0 THEN greatest(least((v3 / n - 3 * m * sd * sd - m * m * m) / greatest(sd * sd * sd, 1e-12), 10), -10) ELSE 0 END
            AS x25_size_skew, vmax / v1 AS x25_max_share, n10 / n AS x25_last10_share, v10 / v1 AS x25_last10_volume,
          coalesce(pv / v1, 0) - 1 AS x25_vwap_dev FROM spine LEFT JOIN s USING (sample_id)""",
        fill=True,
        steps=[
            LAGGED,
            """s0 AS (SELECT sample_id, count(*) AS n, count(*) FILTER (WHERE t <= 20) AS n0, count(*) FILTER (WHERE t > 20 AND t <= 40) AS n1,
              count(*) FILTER (WHERE t > 40) AS n2, coalesce(sum(pt - t), 0) AS g, coalesce(sum((pt - t) * (pt - t)), 0) AS g2,
              greatest(count(pt), 1) AS gn, coalesce(max(pt - t), 0) AS gmax, coalesce(sum((price - pp) * sgn * volume), 0) AS kn,
              sum(volume * volume) AS kd, coalesce(sum(abs(price - pp) * sqrt(volume)), 0) AS i_n, sum(sqrt(volume)) AS i_d,
              count(*) FILTER (WHERE price <> pp) AS mv, sum(volume) AS v1, sum(volume * volume) AS v2, sum(volume * volume * volume) AS v3,
              max(volume) AS vmax, count(*) FILTER (WHERE t < 10) AS n10, coalesce(sum(volume) FILTER (WHERE t < 10), 0) AS v10,
              sum(price * volume) AS pv FROM tl GROUP BY sample_id)""",
            "s AS (SELECT *, v1 / n AS m, sqrt(greatest(v2 / n - pow(v1 / n, 2), 0)) AS sd FROM s0)",
        ],
    ),
)
def trade_microstructure(spark, path):
    s = streams(spark, path)
    return present(trades.trade_microstructure(s.transaction, s.spine))


def _vpin_step(k):
    return [
        f"""b{k} AS (SELECT sample_id, least(floor((cum + volume / 2) / greatest(tot / {k}, 1e-9)), {k}) AS b, sum(sgn * volume) AS net,
          max(tot / {k}) AS size FROM cl GROUP BY ALL)""",
        f"""v{k} AS (SELECT sample_id, coalesce(sum(abs(net)) FILTER (WHERE b < {k}), 0) / {k} / max(size) AS x26_vpin_{k}
          FROM b{k} GROUP BY sample_id)""",
    ]


@register(
    "vpin_clock",
    query(
        ["tx", "spine"],
        "SELECT sample_id, x26_vpin_10, x26_vpin_20 FROM spine LEFT JOIN v10 USING (sample_id) LEFT JOIN v20 USING (sample_id)",
        fill=True,
        steps=[
            """cl AS (SELECT *, coalesce(sum(volume) OVER (PARTITION BY sample_id ORDER BY t DESC, seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(volume) OVER (PARTITION BY sample_id) AS tot FROM tx)""",
            *_vpin_step(10),
            *_vpin_step(20),
        ],
    ),
)
def vpin_clock(spark, path):
    s = streams(spark, path)
    return present(trades.vpin_clock(s.transaction, s.spine))


@register(
    "cvd_path",
    query(
        ["tx", "spine"],
        """SELECT sample_id, (greatest(hi, 0) - least(lo, 0)) / (v + 1) AS cvd_range_norm_60,
          (greatest(hi, 0) - fin) / (v + 1) AS cvd_pullback_from_high_60 FROM spine LEFT JOIN (SELECT sample_id, sum(volume) AS v,
          max(cvd) AS hi, min(cvd) AS lo, first(cvd ORDER BY t, seq DESC) AS fin FROM (SELECT *, sum(sgn * volume)
          OVER (PARTITION BY sample_id ORDER BY t DESC, seq ROWS UNBOUNDED PRECEDING) AS cvd FROM tx) GROUP BY sample_id)
          USING (sample_id)""",
        fill=True,
    ),
)
def cvd_path(spark, path):
    s = streams(spark, path)
    return present(trades.cvd_path(s.transaction, s.spine))


@register(
    "large_trades",
    query(
        ["tx", "spine", "lab"],
        f"""SELECT sample_id, {ratio('bn - sn', 'bn + sn')} AS large_trade_count_imbalance_q90,
          {ratio('bv - sv', 'bv + sv')} AS large_trade_volume_imbalance_q90, {ratio('bn + sn', 'n')} AS large_trade_count_share_q90,
          {ratio('bv + sv', 'v')} AS large_trade_volume_share_q90 FROM spine LEFT JOIN s USING (sample_id)""",
        steps=[
            """fit AS (SELECT volume, row_number() OVER (ORDER BY volume) - 1 AS r, count(*) OVER () AS n FROM tx
              WHERE sample_id IN (SELECT sample_id FROM lab WHERE month <= 8))""",
            "th AS (SELECT max(volume) AS th FROM fit WHERE r = round((n - 1) * 0.9::DOUBLE))",
            f"""s AS (SELECT sample_id, count(*) AS n, sum(volume) AS v, count(*) FILTER (WHERE volume > th AND side = 0) AS bn,
              count(*) FILTER (WHERE volume > th AND side = 1) AS sn, {sum_if('volume', 'volume > th AND side = 0')} AS bv,
              {sum_if('volume', 'volume > th AND side = 1')} AS sv FROM tx, th GROUP BY sample_id)""",
        ],
    ),
)
def large_trades(spark, path):
    s = streams(spark, path)
    fit = s.label.filter("month <= 8").select("sample_id")
    return present(trades.large_trades(s.transaction, s.spine, fit))


def _gaps(name, stream, prefix):
    @register(
        name,
        query(
            [stream, "spine"],
            f"""SELECT * FROM spine LEFT JOIN (SELECT sample_id, avg(gap) AS {prefix}_event_gap_mean,
              stddev_samp(gap) AS {prefix}_event_gap_std, max(gap) AS {prefix}_event_gap_max,
              avg((gap > 0)::INT) AS {prefix}_event_nonzero_gap_share FROM (SELECT *, abs(t - lag(t) {W}) AS gap FROM {stream})
              GROUP BY sample_id) USING (sample_id)""",
        ),
    )
    def run(spark, path):
        s = streams(spark, path)
        return present(trades.event_gaps(s.transaction if stream == "tx" else s.order, s.spine, prefix))


_gaps("trade_gaps", "tx", "trade")
_gaps("order_gaps", "od", "order")


@register(
    "second_activity",
    query(
        ["tx", "spine"],
        """SELECT sample_id, coalesce(n60, 0) / 61 AS trade_active_second_ratio_60, coalesce(n30, 0) / 31 AS trade_active_second_ratio_30,
          coalesce(n10, 0) / 11 AS trade_active_second_ratio_10, coalesce(run / 61, 1) AS trade_max_inactive_run_ratio_60
          FROM spine LEFT JOIN (SELECT sample_id, count(*) AS n60, count(*) FILTER (WHERE s <= 30) AS n30,
            count(*) FILTER (WHERE s <= 10) AS n10, greatest(coalesce(max(gap), 0), min(s), 60 - max(s)) AS run
            FROM (SELECT *, s - lag(s) OVER (PARTITION BY sample_id ORDER BY s) - 1 AS gap FROM
              (SELECT DISTINCT sample_id, CAST(round_even(t, 0) AS INT) AS s FROM tx)) GROUP BY sample_id) USING (sample_id)""",
    ),
)
def second_activity(spark, path):
    s = streams(spark, path)
    return present(trades.second_activity(s.transaction, s.spine))


def _persistence_sql():
    z = lambda x: f"coalesce({x}, 0)"
    corr = lambda x: (
        f"CASE WHEN count(*) * sqrt(var_pop({x}) * var_pop(ret)) > 1e-12 THEN covar_pop({x}, ret) / sqrt(var_pop({x}) * var_pop(ret)) ELSE 0 END"
    )
    out = {
        "x32p_run_len_max": f"ln(1 + {z('lmax')})", "x32p_run_len_mean": f"{z('n')} / greatest({z('nr')}, 1)",
        "x32p_run_vol_max_share": f"least({z('vmax')} / greatest({z('v')}, 1), 1)",
        "x32p_run_imb": f"({z('lb')} - {z('ls')}) / greatest({z('lb')} + {z('ls')}, 1)",
        "x32p_cancel_wave_bid": f"{z('wb')} / greatest({z('cb')}, 1)", "x32p_cancel_wave_ask": f"{z('wa')} / greatest({z('ca')}, 1)",
        "x32p_replenish_bid": clip(f"{z('rb')} / greatest({z('sb')}, 1)", 0, 1000),
        "x32p_replenish_ask": clip(f"{z('ra')} / greatest({z('sa')}, 1)", 0, 1000),
        "x32p_flow_resp": clip(z("fc"), -1, 1), "x32p_qi_resp": clip(z("qc"), -1, 1),
    }
    b2 = "least(floor(t / 2), 29)"
    return query(
        ["mk", "tx", "od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN rs USING (sample_id) LEFT JOIN wv USING (sample_id) LEFT JOIN bs USING (sample_id)",
        steps=[
            f"r0 AS (SELECT *, lag(sgn) {W} AS pg FROM tx)",
            """r1 AS (SELECT *, sum(CASE WHEN pg = sgn THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY t DESC, seq
              ROWS UNBOUNDED PRECEDING) AS run FROM r0)""",
            "r2 AS (SELECT sample_id, run, max(sgn) AS g, count(*) AS len, abs(sum(sgn * volume)) AS vol, sum(volume) AS v FROM r1 GROUP BY ALL)",
            """rs AS (SELECT sample_id, max(len) AS lmax, count(*) AS nr, sum(len) AS n, max(vol) AS vmax, sum(v) AS v,
              max(len) FILTER (WHERE g > 0) AS lb, max(len) FILTER (WHERE g < 0) AS ls FROM r2 GROUP BY sample_id)""",
            f"""wv AS (SELECT sample_id, count(*) FILTER (WHERE act = 1 AND side = 0) AS cb, count(*) FILTER (WHERE act = 1 AND side = 1) AS ca,
              count(*) FILTER (WHERE act = 1 AND pa = 1 AND side = 0 AND ps = 0 AND pt - t <= 1) AS wb,
              count(*) FILTER (WHERE act = 1 AND pa = 1 AND side = 1 AND ps = 1 AND pt - t <= 1) AS wa
              FROM (SELECT *, lag(act) {W} AS pa, lag(side) {W} AS ps, lag(t) {W} AS pt FROM od) GROUP BY sample_id)""",
            f"g1 AS (SELECT sample_id, {b2} AS b, sum(sgn * volume) AS sv FROM tx GROUP BY ALL)",
            f"""g2 AS (SELECT sample_id, {b2} AS b, {sum_if('volume', 'act = 1 AND side = 0')} AS cb, {sum_if('volume', 'act = 1 AND side = 1')} AS ca,
              {sum_if('volume', 'act = 0 AND side = 0')} AS nb, {sum_if('volume', 'act = 0 AND side = 1')} AS na FROM od GROUP BY ALL)""",
            f"""g3 AS (SELECT sample_id, {b2} AS b, ln(avg(mid)) AS lm, avg((bv1 - av1) / (bv1 + av1)) AS qi FROM mk
              WHERE t < 60 AND ok GROUP BY ALL)""",
            """g AS (SELECT sample_id, b, coalesce(sv, 0) AS sv, coalesce(cb, 0) AS cb, coalesce(ca, 0) AS ca, coalesce(nb, 0) AS nb,
              coalesce(na, 0) AS na, coalesce(qi, 0) AS qi, lm FROM spine CROSS JOIN (SELECT unnest(range(30))::DOUBLE AS b) LEFT JOIN g1 USING (sample_id, b)
              LEFT JOIN g2 USING (sample_id, b) LEFT JOIN g3 USING (sample_id, b))""",
            """gf AS (SELECT *, coalesce(last_value(lm IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY b ROWS UNBOUNDED PRECEDING),
              first_value(lm IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS l FROM g)""",
            """gr AS (SELECT *, lead(nb) OVER w AS nnb, lead(na) OVER w AS nna, lead(l, 2) OVER w - lead(l, 1) OVER w AS ret FROM gf
              WINDOW w AS (PARTITION BY sample_id ORDER BY b))""",
            f"""bs AS (SELECT sample_id, rb, ra, sb, sa, fc, qc FROM (SELECT sample_id, sum(nnb) FILTER (WHERE cb > 0) AS rb,
              sum(nna) FILTER (WHERE ca > 0) AS ra, sum(cb) AS sb, sum(ca) AS sa FROM gr GROUP BY sample_id)
              JOIN (SELECT sample_id, {corr('sv')} AS fc, {corr('qi')} AS qc FROM gr WHERE b < 28 GROUP BY sample_id) USING (sample_id))""",
        ],
    )


@register("flow_persistence", _persistence_sql())
def flow_persistence(spark, path):
    s = streams(spark, path)
    return present(trades.flow_persistence(s.market, s.transaction, s.order, s.spine))


def _cross_sql():
    total = both("v", "60")
    imb = f"({signed('v', '60')})"
    buy = f"CASE WHEN a > 0 THEN ln(1 + {total} * (1 + {imb}) / 2 / a) END"
    sell = f"CASE WHEN b > 0 THEN ln(1 + {total} * (1 - {imb}) / 2 / b) END"
    out = {
        "aggressive_buy_to_ask_depth_log1p": buy, "aggressive_sell_to_bid_depth_log1p": sell,
        "aggressive_depth_pressure_difference": f"({buy}) - ({sell})", "trade_minus_book_imbalance_60": f"{imb} - bi",
        "trade_times_book_imbalance_60": f"{imb} * bi",
    }
    return query(
        ["mk", "tx", "spine"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN sums USING (sample_id) LEFT JOIN q USING (sample_id)",
        steps=[
            trade_sums_sql(["60"]),
            """q AS (SELECT sample_id, avg(av1) AS a, avg(bv1) AS b, avg((bv1 - av1) / (av1 + bv1)) FILTER (WHERE av1 > 0 AND bv1 > 0) AS bi
              FROM mk WHERE t <= 60 GROUP BY sample_id)""",
        ],
    )


@register("event_cross", _cross_sql())
def event_cross(spark, path):
    s = streams(spark, path)
    return present(trades.event_cross(s.market, s.transaction, s.spine))
