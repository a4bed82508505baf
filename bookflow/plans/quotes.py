"""Ordered quote families with their check SQL."""

from ..operators import columns, flow
from ..operators import quotes as q
from ..sources.adapters import streams
from .book import bucket_sql
from .registry import present, register
from .sql import clip, cols, query, sum_if

W = "OVER (PARTITION BY sample_id ORDER BY t DESC, seq)"
LAGS = ", ".join(f"lag({n}) {W} AS p{n}" for n in ("a1", "b1", "av1", "bv1", "a2", "b2", "av2", "bv2", "mid", "ok", "t"))
NEAR = "ORDER BY t, seq DESC"


def ofi(n, masked=True):
    bid = f"CASE WHEN b{n} > pb{n} THEN bv{n} WHEN b{n} < pb{n} THEN -pbv{n} ELSE bv{n} - pbv{n} END"
    ask = f"CASE WHEN a{n} < pa{n} THEN av{n} WHEN a{n} > pa{n} THEN -pav{n} ELSE av{n} - pav{n} END"
    cond = f"a{n} > 0 AND b{n} > 0 AND pa{n} > 0 AND pb{n} > 0" if masked else f"pa{n} IS NOT NULL"
    return f"CASE WHEN {cond} THEN ({bid}) - ({ask}) END"


TIGHT = "(mid >= 0.1 AND a1 >= b1 AND (a1 - b1) / mid <= 0.1)"


def depth_ofi(n):
    m, pm = f"((a{n} + b{n}) / 2)", f"((pa{n} + pb{n}) / 2)"
    ok = (
        f"{m} >= 0.1 AND a{n} >= b{n} AND (a{n} - b{n}) / {m} <= 0.1 AND {pm} >= 0.1 AND pa{n} >= pb{n} AND "
        f"(pa{n} - pb{n}) / {pm} <= 0.1 AND bv{n} > 0 AND pbv{n} > 0 AND av{n} > 0 AND pav{n} > 0"
    )
    return (
        f"CASE WHEN {ok} THEN ((b{n} >= pb{n})::INT * bv{n} - (b{n} <= pb{n})::INT * pbv{n} - (a{n} <= pa{n})::INT * av{n}"
        f" + (a{n} >= pa{n})::INT * pav{n}) / (bv{n} + pbv{n} + av{n} + pav{n}) END"
    )


LINE = [
    f"l0 AS (SELECT *, {LAGS} FROM mk)",
    f"""l AS (SELECT *, {ofi(1)} AS e1, {ofi(2)} AS e2, {ofi(1, False)} AS u1, {ofi(2, False)} AS u2,
      CASE WHEN ok AND pok THEN ln(mid / pmid) END AS r, {TIGHT} AS tight FROM l0)""",
]


@register(
    "simple_ofi",
    query(
        ["mk", "tx", "spine"],
        """SELECT sample_id, ofi1, ofi2, ofi1_late, kyle_lambda FROM spine
        LEFT JOIN (SELECT sample_id, sum(u1) AS ofi1, sum(u2) AS ofi2, sum(u1) FILTER (WHERE t <= 120) AS ofi1_late
          FROM l GROUP BY sample_id) USING (sample_id)
        LEFT JOIN (SELECT sample_id, covar_pop(price - pp, sgn * volume) / greatest(var_pop(sgn * volume), 1e-12)
          AS kyle_lambda FROM (SELECT *, lag(price) OVER (PARTITION BY sample_id ORDER BY t DESC, seq) AS pp FROM tx)
          WHERE pp IS NOT NULL GROUP BY sample_id) USING (sample_id)""",
        fill=True,
        steps=LINE,
    ),
)
def simple_ofi(spark, path):
    s = streams(spark, path)
    return present(q.simple_ofi(s.market, s.transaction, s.spine))


def _dispersion_sql(masked):
    keep = (lambda x: f"CASE WHEN ok THEN {x} END") if masked else (lambda x: x)
    m = "greatest(mid, 1e-9)"
    sp, im = f"((a1 - b1) / {m})", "((bv1 - av1) / greatest(av1 + bv1, 1e-9))"
    mic = f"abs((a1 * bv1 + b1 * av1) / greatest(av1 + bv1, 1e-9) / {m} - 1)"
    slope = f"(a2 - a1) / {m}"
    if masked:
        slope = f"CASE WHEN a2 > 0 THEN {slope} ELSE 0 END"
        dm = f"ln({m} / lastmid)"
    else:
        dm = f"ln({m} / greatest(pmid, 1e-12))"
    sd = lambda x: f"sqrt(greatest(avg({keep(f'{x} * {x}')}) - avg({keep(x)}) * avg({keep(x)}), 0))"
    n = f"greatest(count({keep('1')}), 1)"
    values = {
        "spread_sd": sd(sp), "imb_sd": sd(im), "micro_abs": f"avg({keep(mic)})", "ask_slope": f"avg({keep(slope)})",
        "dmid_abs": f"sum({keep(f'abs({dm})')}) / {n}", "dmid_sign": f"sum({keep(f'sign({dm})')}) / {n}",
        "spread": f"avg({keep(sp)})", "imb": f"avg({keep(im)})",
        "void_ask": "avg((a1 = 0)::INT)", "void_bid": "avg((b1 = 0)::INT)",
    }
    trades = {
        "logvol": "avg(ln(1 + volume))", "logvol_sd": "sqrt(greatest(avg(ln(1 + volume) * ln(1 + volume)) - avg(ln(1 + volume)) * avg(ln(1 + volume)), 0))",
        "signed_share": "sum(volume * sgn) / sum(volume)", "signed_sq_share": "sum(volume * volume * sgn) / (sum(volume) * sum(volume))",
        "trades": "count(*)",
    }
    b = bucket_sql((60, 300))
    at = lambda n, i: f"coalesce({n}_b{i}, 0)"
    wide = {f"{v}_b{i}": f"max({v}) FILTER (WHERE b = {i})" for v in values for i in range(3)}
    wide_t = {f"{v}_b{i}": f"max({v}) FILTER (WHERE b = {i})" for v in trades for i in range(3)}
    names = ["spread_sd", "imb_sd", "micro_abs", "ask_slope", "dmid_abs", "dmid_sign", *trades]
    out = {f"x24_{n}_b{i}": at(n, i) for n in names for i in range(3)}
    new, can = "(coalesce(nb, 0) + coalesce(ns, 0))", "(coalesce(cb, 0) + coalesce(cs, 0))"
    out |= {
        "x24_trade_accel": f"ln(1 + {at('trades', 0)}) - ln(1 + {at('trades', 2)})",
        "x24_imb_drift": f"{at('imb', 0)} - {at('imb', 2)}", "x24_spread_drift": f"{at('spread', 0)} - {at('spread', 2)}",
        "x24_flow_drift": f"{at('signed_share', 0)} - {at('signed_share', 2)}",
        "x24_cancel_new": f"{can} / greatest({new}, 1e-9)",
        "x24_new_imb": f"coalesce(nb - ns, 0) / greatest({new}, 1e-9)",
        "x24_cancel_imb": f"coalesce(cb - cs, 0) / greatest({can}, 1e-9)",
        "x24_orders_log": "ln(1 + greatest(coalesce(n_orders, 0), 1))",
    }
    if masked:
        out |= {f"x24_{n}_b{i}": at(n, i) for n in ("void_ask", "void_bid") for i in range(3)}
        out["x24_void_drift"] = f"{at('void_ask', 0)} - {at('void_ask', 2)}"
        out["x24_void_asymmetry"] = f"{at('void_ask', 0)} - {at('void_bid', 0)}"
    orders = {
        f"{a}{s}": sum_if("volume", f"act = {act} AND side = {side}")
        for a, act in (("n", 0), ("c", 1)) for s, side in (("b", 0), ("s", 1))
    } | {"n_orders": "count(*)"}
    return query(
        ["mk", "tx", "od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN w USING (sample_id) LEFT JOIN wt USING (sample_id) "
        "LEFT JOIN o USING (sample_id)",
        steps=LINE
        + [
            f"ll AS (SELECT *, last_value(CASE WHEN ok THEN mid END IGNORE NULLS) OVER (PARTITION BY sample_id "
            "ORDER BY t DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastmid FROM l)",
            f"g AS (SELECT sample_id, {b} AS b, {cols(values)} FROM ll GROUP BY ALL)",
            f"w AS (SELECT sample_id, {cols(wide)} FROM g GROUP BY sample_id)",
            f"gt AS (SELECT sample_id, {b} AS b, {cols(trades)} FROM tx GROUP BY ALL)",
            f"wt AS (SELECT sample_id, {cols(wide_t)} FROM gt GROUP BY sample_id)",
            f"o AS (SELECT sample_id, {cols(orders)} FROM od GROUP BY sample_id)",
        ],
    )


def _dispersion(name, masked):
    @register(name, _dispersion_sql(masked))
    def run(spark, path):
        s = streams(spark, path)
        return present(q.dispersion_drift(s.market, s.transaction, s.order, s.spine, masked))


_dispersion("dispersion_drift", False)
_dispersion("dispersion_drift_masked", True)


@register(
    "liquidity_impact",
    query(
        ["mk", "spine"],
        """SELECT sample_id, ofi / n AS x26_ofi_mean, e300 / n AS x26_ofi_300, e60 / n AS x26_ofi_60, early / n AS x26_ofi_early,
          (early - e300) / n AS x26_ofi_accel, sqrt(greatest(ofi_sq / n - (ofi / n) * (ofi / n), 0)) AS x26_ofi_sd,
          ofi2 / n AS x26_ofi2_mean, sg / n AS x26_ofi_sign,
          2 * sqrt(greatest(-(dd / dn - (d / dn) * (d / dn)), 0)) AS x26_roll, am / dn AS x26_amihud,
          mic AS x26_micro_last, sqrt(mic2 / greatest(mn, 1)) AS x26_micro_rms
        FROM spine LEFT JOIN s USING (sample_id)""",
        fill=True,
        steps=LINE
        + [
            """d0 AS (SELECT *, last_value(CASE WHEN ok THEN mid END IGNORE NULLS) OVER (PARTITION BY sample_id
              ORDER BY t DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastmid,
              (a1 * bv1 + b1 * av1) / greatest(av1 + bv1, 1e-9) / greatest(mid, 1e-9) - 1 AS micro FROM l)""",
            "d1 AS (SELECT *, CASE WHEN ok AND lastmid > 0 THEN ln(mid / lastmid) ELSE 0 END AS dm FROM d0)",
            f"d2 AS (SELECT *, lag(dm) {W} AS pdm FROM d1)",
            """s AS (SELECT sample_id, greatest(count(e1), 1) AS n, sum(e1) AS ofi, sum(e1 * e1) AS ofi_sq, sum(sign(e1)) AS sg,
              coalesce(sum(e1) FILTER (WHERE t < 300), 0) AS e300, coalesce(sum(e1) FILTER (WHERE t < 60), 0) AS e60,
              coalesce(sum(e1) FILTER (WHERE t >= 300), 0) AS early, sum(e2) AS ofi2,
              greatest(count(*) FILTER (WHERE pt IS NOT NULL AND ok), 1) AS dn, sum(dm) AS d, sum(dm * pdm) AS dd,
              sum(abs(dm) / greatest(tv, 1)) AS am, first(micro ORDER BY t, seq DESC) FILTER (WHERE ok AND t <= 1) AS mic,
              sum(micro * micro) FILTER (WHERE ok) AS mic2, count(*) FILTER (WHERE ok) AS mn FROM d2 GROUP BY sample_id)""",
        ],
    ),
)
def liquidity_impact(spark, path):
    s = streams(spark, path)
    return present(q.liquidity_impact(s.market, s.spine))


EPS = "1e-12"
IN = ("t < 10", "t >= 10 AND t < 30", "t >= 30 AND t < 60")
Q1 = f"(CASE WHEN ok THEN (bv1 - av1) / greatest(bv1 + av1, {EPS}) ELSE 0 END)"
Q2 = f"((bv2 - av2) / greatest(bv2 + av2, {EPS}))"
MICRO = f"((a1 * bv1 + b1 * av1) / greatest(av1 + bv1, {EPS}))"


def volatility_steps():
    s = {
        "n_all": "count(*)", "rr_all": "sum(r * r)", "tv": "sum(tv)", "tc": "sum(tc)", "pv": "sum(ap * tv)",
        "mv": "sum(mid * tv) FILTER (WHERE ok)", "w": "sum(1 / (t + 1)) FILTER (WHERE t < 60)",
        "q1w": f"sum({Q1} / (t + 1)) FILTER (WHERE t < 60)", "q2w": f"sum({Q2} / (t + 1)) FILTER (WHERE t < 60)",
        "rr": "sum(r * r) FILTER (WHERE t < 60)", "rdn": "sum(r * r) FILTER (WHERE t < 60 AND r < 0)",
        "rup": "sum(r * r) FILTER (WHERE t < 60 AND r > 0)",
    }
    s |= {x: f"sum({x})" for x in ("bv1", "av1", "bv2", "av2")}
    s |= {f"e{k}w": f"sum(e{k} / (t + 1)) FILTER (WHERE t < 60)" for k in (1, 2)}
    for i, cond in enumerate(IN):
        f, fo = f"FILTER (WHERE {cond})", f"FILTER (WHERE {cond} AND ok)"
        s |= {
            f"e1_{i}": f"sum(e1) {f}", f"e2_{i}": f"sum(e2) {f}", f"n_{i}": f"count(*) {fo}", f"q1_{i}": f"avg({Q1}) {fo}",
            f"q1s_{i}": f"avg({Q1} * {Q1}) {fo}", f"q2_{i}": f"avg({Q2}) {fo}", f"mic_{i}": f"avg({MICRO}) {fo}",
            f"mid_{i}": f"avg(mid) {fo}", f"md_{i}": f"avg(({MICRO} - mid) / mid) {fo}", f"sp_{i}": f"avg(a1 - b1) {fo}",
            f"sp2_{i}": f"avg((a1 - b1) * (a1 - b1)) {fo}",
        }
        s |= {f"{x}_{i}": f"sum({x}) {f}" for x in ("bv1", "av1", "bv2", "av2")}
    for j in range(6):
        f = f"FILTER (WHERE t >= {10 * j} AND t < {10 * j + 10})"
        fo = f.replace(")", " AND ok)")
        s |= {f"e1s{j}": f"sum(e1) {f}", f"e2s{j}": f"sum(e2) {f}", f"rrs{j}": f"sum(r * r) {f}",
              f"hi{j}": f"max(mid) {fo}", f"lo{j}": f"min(mid) {fo}"}
    tail = ("hi", "lo")
    z = ", ".join(n if n[:2] in tail else f"coalesce({n}, 0) AS {n}" for n in s)
    return LINE + [
        f"v0 AS (SELECT sample_id, {cols(s)} FROM l GROUP BY sample_id)",
        f"v AS (SELECT sample_id, {z} FROM spine LEFT JOIN v0 USING (sample_id))",
    ]


def _volatility_parts():
    depth = "((bv1 + av1) / greatest(n_all, 1) + 1)"
    seen = "((n_0 > 0)::INT + (n_1 > 0)::INT + (n_2 > 0)::INT)"
    ref = f"greatest(CASE WHEN {seen} > 0 THEN (mid_0 + mid_1 + mid_2) / {seen} ELSE 1 END, {EPS})"
    big = lambda x: clip(x, "-1e4", "1e4")
    std6 = "sqrt(({sq}) / 6 - pow(({s}) / 6, 2))"
    subs = [f"sqrt(rrs{j})" for j in range(6)]
    mean6 = f"(({' + '.join(subs)}) / 6)"
    pk = " + ".join(f"CASE WHEN hi{j} > lo{j} THEN pow(ln(hi{j} / lo{j}), 2) / (4 * ln(2)) ELSE 0 END" for j in range(6))
    floor = f"(0.01 * rr + {EPS})"
    out = {f"x30_ofi{k}_b{i}": big(f"e{k}_{i} / {depth}") for i in range(3) for k in (1, 2)}
    out |= {f"x30_ofi{k}_all": big(f"(e{k}_0 + e{k}_1 + e{k}_2) / {depth}") for k in (1, 2)}
    z = lambda x: f"coalesce({x}, 0)"
    share = lambda a, b: f"({z(a)} / greatest({z(b)}, {EPS}))"
    out |= {
        "x30_rv_60": "sqrt(rr)", "x30_rv_600": "sqrt(rr_all)",
        "x30_semi_ratio": clip(f"(rdn + {floor}) / (rup + {floor})", 0, 100), "x30_parkinson": f"sqrt({pk})",
        "x30_vol_of_vol": "sqrt((" + " + ".join(f"pow({s} - {mean6}, 2)" for s in subs) + ") / 6)",
        "x30_signvol_60": share("sv", "vol"), "x30_flow_shift": f"{share('sv10', 'v10')} - {share('sv', 'vol')}",
        "x30_ord_add_rate": f"{z('ad')} / 60", "x30_ord_cancel_ratio": f"{z('cn')} / greatest({z('ad')}, 1)",
        "x30_ord_net_bid": f"{z('ab')} - {z('cb')}", "x30_ord_net_ask": f"{z('aa')} - {z('ca')}",
        "x30_qi1_drift": "q1_0 - q1_2", "x30_qi2_drift": "q2_0 - q2_2",
        "x30_qi1_vol": "sqrt(greatest((" + " + ".join(f"q1s_{i} - q1_{i} * q1_{i}" for i in range(3)) + ") / 3, 0))",
        "x30_qi1_tw": f"q1w / greatest(w, {EPS})", "x30_micro_slope": clip(f"(mic_0 - mic_2) / {ref}", -10, 10),
        "x30_mid_slope": clip(f"(mid_0 - mid_2) / {ref}", -10, 10), "x30_micro_mid_dev": "(md_0 + md_1 + md_2) / 3",
        "x30_spread_rms": f"sqrt((sp2_0 + sp2_1 + sp2_2) / 3) / {ref}", "x30_spread_drift": f"(sp_0 - sp_2) / {ref}",
        "x30_vwap_dev_600": clip(f"(pv / greatest(tv, {EPS}) - mv / greatest(tv, {EPS})) / {ref}", -10, 10),
        "x30_tvol_600_log": "ln(1 + tv)", "x30_tcount_600_log": "ln(1 + tc)",
    }
    for k in (1, 2, 3):
        out[f"x30_tsign_ac{k}"] = f"{z(f'ac{k}')} / greatest({z(f'n{k}')}, 1)"
    for s, x in (("bid", "bv"), ("ask", "av")):
        out[f"x30_depth_ratio_{s}"] = f"({x}2 / greatest(n_all, 1)) / greatest({x}1 / greatest(n_all, 1), {EPS})"
    lags = ", ".join(f"lag(sgn, {k}) {W} AS g{k}" for k in (1, 2, 3))
    acs = ", ".join(f"sum(sgn * g{k}) AS ac{k}, count(g{k}) AS n{k}" for k in (1, 2, 3))
    return out, [
        *volatility_steps(),
        f"ts AS (SELECT sample_id, {acs}, sum(volume) AS vol, sum(sgn * volume) AS sv, "
        "sum(sgn * volume) FILTER (WHERE t < 10) AS sv10, sum(volume) FILTER (WHERE t < 10) AS v10 "
        f"FROM (SELECT *, {lags} FROM tx) GROUP BY sample_id)",
        "o AS (SELECT sample_id, count(*) FILTER (WHERE act = 0) AS ad, count(*) FILTER (WHERE act = 1) AS cn, "
        "count(*) FILTER (WHERE act = 0 AND side = 0) AS ab, count(*) FILTER (WHERE act = 1 AND side = 0) AS cb, "
        "count(*) FILTER (WHERE act = 0 AND side = 1) AS aa, count(*) FILTER (WHERE act = 1 AND side = 1) AS ca "
        "FROM od GROUP BY sample_id)",
    ]


VOLATILITY, VOLATILITY_STEPS = _volatility_parts()
VOLATILITY_BODY = f"SELECT sample_id, {cols(VOLATILITY)} FROM v LEFT JOIN ts USING (sample_id) LEFT JOIN o USING (sample_id)"


@register("volatility_flow", query(["mk", "tx", "od", "spine"], VOLATILITY_BODY, steps=VOLATILITY_STEPS))
def volatility_flow(spark, path):
    s = streams(spark, path)
    return present(q.volatility_flow(s.market, s.transaction, s.order, s.spine))


def _burst_sql():
    depth = "((bv1 + av1) / greatest(n_all, 1) + 1)"
    z = lambda x: f"coalesce({x}, 0)"
    out = {}
    for k in (1, 2):
        s = [f"e{k}s{j}" for j in range(6)]
        m = f"(({' + '.join(s)}) / 6)"
        out[f"x31_ofi{k}_vol"] = clip("sqrt((" + " + ".join(f"pow({x} - {m}, 2)" for x in s) + f") / 6) / {depth}", 0, "1e4")
        out[f"x31_ofi{k}_accel"] = clip(f"(({s[0]} + {s[1]}) / 2 - ({s[4]} + {s[5]}) / 2) / {depth}", "-1e4", "1e4")
        out[f"x31_ofi{k}_tw"] = clip(f"e{k}w / {depth}", "-1e4", "1e4")
    drift = lambda x: clip(
        f"{x}2_0 / greatest({x}1_0, {EPS}) - {x}2_2 / greatest({x}1_2, {EPS})", "-1e3", "1e3"
    )
    cv = lambda p: clip(
        f"sqrt(greatest({z(p + '2')} / greatest({z(p + 'n')}, 1) - pow({z(p)} / greatest({z(p + 'n')}, 1), 2), 0))"
        f" / greatest({z(p)} / greatest({z(p + 'n')}, 1), {EPS})", 0, "1e3"
    )
    out |= {
        "x31_qi2_tw": f"q2w / greatest(w, {EPS})",
        "x31_book_imb12": clip(f"(bv1 + bv2 - av1 - av2) / greatest(bv1 + bv2 + av1 + av2, {EPS})", -1, 1),
        "x31_dratio_bid_drift": drift("bv"), "x31_dratio_ask_drift": drift("av"),
        "x31_ord_vnet_new": clip(f"({z('onb')} - {z('ona')}) / greatest({z('vol')}, 1)", "-1e4", "1e4"),
        "x31_ord_vnet_can": clip(f"({z('ocb')} - {z('oca')}) / greatest({z('vol')}, 1)", "-1e4", "1e4"),
        "x31_ord_gap_mean": clip(f"{z('og')} / greatest({z('ogn')}, 1)", 0, 60), "x31_ord_gap_cv": cv("og"),
        "x31_tx_gap_cv": cv("tg"),
        "x31_kyle_lambda": clip(f"{z('kn')} / greatest({z('kd')}, {EPS}) * {z('vol')} / greatest({z('tn')}, 1)", -10, 10),
        "x31_vpin_mean": f"{z('vps')} / 6", "x31_vpin_max": z("vpm"),
    }
    return query(
        ["mk", "tx", "od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM v LEFT JOIN ts USING (sample_id) LEFT JOIN vp USING (sample_id) "
        "LEFT JOIN o USING (sample_id) LEFT JOIN og USING (sample_id)",
        steps=volatility_steps()
        + [
            f"tl AS (SELECT *, lag(t) {W} AS pt, lag(price) {W} AS pp FROM tx)",
            "ts AS (SELECT sample_id, sum(volume) AS vol, count(*) AS tn, sum(abs(t - pt)) AS tg, "
            "sum((t - pt) * (t - pt)) AS tg2, count(pt) AS tgn, sum(ln(price / pp) * sgn * volume) AS kn, "
            "sum(volume * volume) FILTER (WHERE pp IS NOT NULL) AS kd FROM tl GROUP BY sample_id)",
            "vb AS (SELECT sample_id, least(floor(t / 10), 5) AS b, abs(sum(sgn * volume)) / sum(volume) AS x FROM tx GROUP BY ALL)",
            "vp AS (SELECT sample_id, sum(x) AS vps, max(x) AS vpm FROM vb GROUP BY sample_id)",
            "o AS (SELECT sample_id, sum(volume) FILTER (WHERE act = 0 AND side = 0) AS onb, "
            "sum(volume) FILTER (WHERE act = 0 AND side = 1) AS ona, sum(volume) FILTER (WHERE act = 1 AND side = 0) AS ocb, "
            "sum(volume) FILTER (WHERE act = 1 AND side = 1) AS oca FROM od GROUP BY sample_id)",
            f"ol AS (SELECT *, lag(t) {W} AS pt FROM od WHERE act = 0)",
            "og AS (SELECT sample_id, sum(abs(t - pt)) AS og, sum((t - pt) * (t - pt)) AS og2, count(pt) AS ogn "
            "FROM ol GROUP BY sample_id)",
        ],
    )


@register("burst_flow", _burst_sql())
def burst_flow(spark, path):
    s = streams(spark, path)
    return present(q.burst_flow(s.market, s.transaction, s.order, s.spine))


def _context_sql():
    CTX, REC = "t >= 60 AND ok", "t < 60 AND ok"
    q1, q2 = f"((bv1 - av1) / greatest(bv1 + av1, {EPS}))", Q2
    s = {
        "nc": f"count(*) FILTER (WHERE {CTX})", "nr": f"count(*) FILTER (WHERE {REC})",
        "q1c": f"sum({q1}) FILTER (WHERE {CTX})", "q2c": f"sum({q2}) FILTER (WHERE {CTX})",
        "q1r": f"sum({q1}) FILTER (WHERE {REC})", "pos": f"count(*) FILTER (WHERE {CTX} AND {q1} > 0)",
        "neg": f"count(*) FILTER (WHERE {CTX} AND {q1} < 0)", "d1c": f"sum(bv1 + av1) FILTER (WHERE {CTX})",
        "d2c": f"sum(bv2 + av2) FILTER (WHERE {CTX})", "d1r": f"sum(bv1 + av1) FILTER (WHERE {REC})",
        "spc": f"sum((a1 - b1) / greatest(mid, {EPS})) FILTER (WHERE {CTX})", "e1c": "sum(e1) FILTER (WHERE t >= 60)",
        "e2c": "sum(e2) FILTER (WHERE t >= 60)", "e1r": "sum(e1) FILTER (WHERE t < 60)",
        "mf": "first(mid ORDER BY t DESC, seq) FILTER (WHERE ok)", "m60": f"first(mid {NEAR}) FILTER (WHERE {CTX})",
    }
    z = ", ".join(f"coalesce({n}, 0) AS {n}" for n in s)
    nc, nr = "greatest(nc, 1)", "greatest(nr, 1)"
    depth = f"(d1c / {nc} + 1)"
    out = {
        "x32c_ofi1_nrm": clip(f"e1c / {depth}", "-1e4", "1e4"), "x32c_ofi2_nrm": clip(f"e2c / {depth}", "-1e4", "1e4"),
        "x32c_qi1_mean": f"q1c / {nc}", "x32c_qi2_mean": f"q2c / {nc}", "x32c_qi1_persist": f"greatest(pos, neg) / {nc}",
        "x32c_depth1_log": clip(f"ln(d1c / {nc} + 1)", 0, 30), "x32c_depth2_log": clip(f"ln(d2c / {nc} + 1)", 0, 30),
        "x32c_qi1_drift": f"q1r / {nr} - q1c / {nc}",
        "x32c_ofi1_shift": clip(f"e1r / (d1r / {nr} + 1) / 60 - e1c / {depth} / 540", "-1e3", "1e3"),
        "x32c_depth_drift": clip(f"ln(d1r / {nr} + 1) - ln(d1c / {nc} + 1)", -10, 10),
        "x32c_spread_ctx": clip(f"spc / {nc}", 0, 1),
        "x32c_mid_ret_ctx": clip(f"ln(greatest(m60, {EPS}) / greatest(mf, {EPS}))", -1, 1),
    }
    return query(
        ["mk", "spine"],
        f"SELECT sample_id, {cols(out)} FROM (SELECT sample_id, {z} FROM spine LEFT JOIN s USING (sample_id))",
        steps=LINE + [f"s AS (SELECT sample_id, {cols(s)} FROM l GROUP BY sample_id)"],
    )


@register("context", _context_sql())
def context(spark, path):
    s = streams(spark, path)
    return present(q.context(s.market, s.spine))


def _price_paths_sql():
    out = {}
    windows = {"full": "TRUE", "180": "t <= 180", "60": "t <= 60", "20": "t <= 20"}
    for n, w in windows.items():
        f = f"FILTER (WHERE tight AND {w})"
        first, last = f"first(mid ORDER BY t DESC, seq) {f}", f"first(mid {NEAR}) {f}"
        out[f"mid_return_{n}"] = f"CASE WHEN count(*) {f} >= 2 THEN ({last} - {first}) / {first} END"
        out[f"realized_volatility_{n}"] = f"sqrt(sum(tr * tr) FILTER (WHERE {w}))"
    slope = lambda f: (
        f"CASE WHEN var_pop(-t) {f} > 0 THEN covar_pop(-t, ln(mid)) {f} / var_pop(-t) {f} END"
    )
    T = "FILTER (WHERE tight)"
    T60 = "FILTER (WHERE tight AND t <= 60)"
    m3 = "(avg(tr * tr * tr) - 3 * avg(tr) * avg(tr * tr) + 2 * pow(avg(tr), 3))"
    out |= {
        "mid_return_std_full": "stddev_pop(tr)",
        "mid_return_skew_full": f"CASE WHEN var_pop(tr) > 0 THEN avg(pow(tr - mu, 3)) / pow(var_pop(tr), 1.5) END",
        "mid_return_kurtosis_full": "CASE WHEN var_pop(tr) > 0 THEN avg(pow(tr - mu, 4)) / pow(var_pop(tr), 2) - 3 END",
        "mid_momentum_full": slope(T), "mid_momentum_60": slope(T60),
        "mid_last_vs_full_mean": f"first(mid {NEAR}) {T} / avg(mid) {T} - 1",
        "mid_last_vs_60_mean": f"first(mid {NEAR}) {T} / avg(mid) {T60} - 1",
        "relative_spread_mean": f"avg((a1 - b1) / mid) {T}", "relative_spread_std": f"stddev_pop((a1 - b1) / mid) {T}",
        "relative_spread_last": f"first((a1 - b1) / mid {NEAR}) {T}", "relative_spread_60_mean": f"avg((a1 - b1) / mid) {T60}",
        "trade_price_vs_mid_mean": "avg(dev)", "trade_price_vs_mid_last": f"first(dev {NEAR}) FILTER (WHERE dev IS NOT NULL)",
    }
    return query(
        ["mk", "spine"],
        f"SELECT * FROM spine LEFT JOIN (SELECT sample_id, {cols(out)} FROM l3 GROUP BY sample_id) USING (sample_id)",
        steps=LINE
        + [
            f"""l2 AS (SELECT *, CASE WHEN tight AND ptight THEN ln(mid) - ln(pmid) END AS tr,
              CASE WHEN tc > 0 AND tight AND ap >= 0.1 AND abs((ap - mid) / mid) <= 0.1 THEN (ap - mid) / mid END AS dev
              FROM (SELECT *, lag(tight) {W} AS ptight FROM l))""",
            "l3 AS (SELECT *, avg(tr) OVER (PARTITION BY sample_id) AS mu FROM l2)",
        ],
    )


@register("price_paths", _price_paths_sql())
def price_paths(spark, path):
    s = streams(spark, path)
    return present(q.price_paths(s.market, s.spine))


SIGNALS = [
    *LINE,
    f"""sg AS (SELECT *, CASE WHEN ok1 THEN (bv1 - av1) / (av1 + bv1) END AS imb1,
      CASE WHEN ok2 THEN (bv2 - av2) / (av2 + bv2) END AS imb2,
      CASE WHEN ok1 AND ok2 THEN (bv1 + bv2 - av1 - av2) / (av1 + bv1 + av2 + bv2) END AS imb,
      CASE WHEN ok1 AND tight THEN ((a1 * bv1 + b1 * av1) / (av1 + bv1) - mid) / mid END AS micro,
      CASE WHEN tight THEN (a1 - b1) / mid END AS spread,
      CASE WHEN ok1 AND ok2 THEN ln(1 + av1 + bv1 + av2 + bv2) END AS depth,
      o1 AS ofi1, o2 AS ofi2, o1 + o2 AS ofi12
      FROM (SELECT *, {depth_ofi(1)} AS o1, {depth_ofi(2)} AS o2, av1 > 0 AND bv1 > 0 AS ok1, av2 > 0 AND bv2 > 0 AS ok2 FROM l))""",
]


def _book_signals_sql():
    out = {}
    for name, x, stats in (
        ("book_imbalance_1{}_robust", "imb1", "mean std last 60_mean 20_mean"),
        ("book_imbalance_2{}_robust", "imb2", "mean std last 60_mean"),
        ("total_book_imbalance{}", "imb", "mean last 60_mean"),
        ("microprice_displacement{}", "micro", "mean std last 60_mean 20_mean"),
        ("ofi_1{}", "ofi1", "mean std sum last 60_mean 20_mean acceleration"),
        ("ofi_2{}", "ofi2", "mean sum 60_mean"),
        ("multilevel_ofi{}", "ofi12", "mean sum 60_mean acceleration"),
        ("log_total_depth{}", "depth", "mean std last 60_mean"),
    ):
        forms = {
            "mean": f"avg({x})", "std": f"stddev_pop({x})", "sum": f"sum({x})",
            "last": f"first({x} {NEAR}) FILTER (WHERE {x} IS NOT NULL)",
            "60_mean": f"avg({x}) FILTER (WHERE t <= 60)", "20_mean": f"avg({x}) FILTER (WHERE t <= 20)",
            "acceleration": f"avg({x}) FILTER (WHERE t <= 20) - avg({x}) FILTER (WHERE t > 20 AND t <= 60)",
        }
        out |= {name.format("_" + k): forms[k] for k in stats.split()}
    return query(
        ["mk", "spine"],
        f"SELECT * FROM spine LEFT JOIN (SELECT sample_id, {cols(out)} FROM sg GROUP BY sample_id) USING (sample_id)",
        steps=SIGNALS,
    )


@register("book_signals", _book_signals_sql())
def book_signals(spark, path):
    s = streams(spark, path)
    return present(q.book_signals(s.market, s.spine))


def _decayed_sql():
    names = {"book_imbalance_1": "imb1", "total_book_imbalance": "imb", "microprice_displacement": "micro",
             "relative_spread": "spread", "log_total_depth": "depth", "ofi_1": "ofi1", "multilevel_ofi": "ofi12"}
    out = {}
    for n, x in names.items():
        ewm = {k: f"(sum({x} * exp(-t / {k})) / sum(exp(-t / {k})) FILTER (WHERE {x} IS NOT NULL))" for k in (30, 120)}
        out |= {f"{n}_ewm_30": ewm[30], f"{n}_ewm_120": ewm[120], f"{n}_ewm_30_minus_120": f"{ewm[30]} - {ewm[120]}"}
    return query(
        ["mk", "spine"],
        f"SELECT * FROM spine LEFT JOIN (SELECT sample_id, {cols(out)} FROM sg GROUP BY sample_id) USING (sample_id)",
        steps=SIGNALS,
    )


@register("decayed_signals", _decayed_sql())
def decayed_signals(spark, path):
    s = streams(spark, path)
    return present(q.decayed_signals(s.market, s.spine))


@register(
    "last_quarter_minute",
    query(
        ["mk", "spine"],
        """SELECT * FROM spine LEFT JOIN (SELECT sample_id, avg(mid) FILTER (WHERE t <= 15) AS m_mid_mean_15,
          stddev_samp(mid) FILTER (WHERE t <= 15) AS m_mid_std_15, avg(a1 - b1) FILTER (WHERE t <= 15) AS m_sp_mean_15,
          avg((av1 - bv1) / (av1 + bv1 + 1)) FILTER (WHERE t <= 15) AS m_imb_mean_15,
          sqrt(coalesce(sum(pow(mid - pmid, 2)) FILTER (WHERE t <= 15), 0)) AS m_rv_15,
          coalesce(sum(av1 - pav1 - bv1 + pbv1) FILTER (WHERE t <= 15), 0) AS m_ofi_sum_15,
          coalesce(sum(tv) FILTER (WHERE t <= 15), 0) AS m_txv_sum_15,
          sqrt(coalesce(sum(pow(mid - pmid, 2)) FILTER (WHERE t <= 15), 0)) / (sqrt(coalesce(sum(pow(mid - pmid, 2)), 0)) + 1e-8)
            AS x_rv_15_over_full FROM l GROUP BY sample_id) USING (sample_id)""",
        steps=LINE,
    ),
)
def last_quarter_minute(spark, path):
    s = streams(spark, path)
    return present(q.last_quarter_minute(s.market, s.spine))


HELD = "greatest(least(t, {w}) - greatest(coalesce(nt, 0), 0), 0)"


@register(
    "level_shape",
    query(
        ["mk", "spine"],
        """SELECT sample_id, s60 AS near_depth_share_60, gap AS imbalance_gap_l1_l2_60, dis AS imbalance_disagreement_ratio_60,
          s15 - s60 AS near_depth_share_change_15_vs_60 FROM spine LEFT JOIN (SELECT sample_id,
          CASE WHEN sum(w60) > 0 THEN sum(d1 / (d1 + d2) * w60) / sum(w60) END AS s60,
          CASE WHEN sum(w15) > 0 THEN sum(d1 / (d1 + d2) * w15) / sum(w15) END AS s15,
          CASE WHEN sum(w60) > 0 THEN sum((i1 - i2) * w60) / sum(w60) END AS gap,
          CASE WHEN sum(w60) > 0 THEN coalesce(sum(w60) FILTER (WHERE abs(i1) > 0.05 AND abs(i2) > 0.05 AND i1 * i2 < 0), 0)
            / sum(w60) END AS dis FROM h GROUP BY sample_id) USING (sample_id)""",
        steps=[
            f"nx AS (SELECT *, lead(t) {W} AS nt FROM mk)",
            f"""h AS (SELECT *, av1 + bv1 AS d1, av2 + bv2 AS d2, (bv1 - av1) / (av1 + bv1) AS i1, (bv2 - av2) / (av2 + bv2) AS i2,
              {HELD.format(w=60)} AS w60, {HELD.format(w=15)} AS w15 FROM nx WHERE av1 > 0 AND bv1 > 0 AND av2 > 0 AND bv2 > 0)""",
        ],
    ),
)
def level_shape(spark, path):
    s = streams(spark, path)
    return present(q.level_shape(s.market, s.spine))


@register(
    "imbalance_persistence",
    query(
        ["mk", "spine"],
        """SELECT sample_id, signed / nullif(cover, 0) AS imb_signed_occupancy_60, flips / nullif(cover, 0) AS imb_flip_rate_60,
          final / nullif(cover, 0) AS imb_terminal_run_signed_60 FROM spine LEFT JOIN (SELECT sample_id, sum(w) AS cover,
          sum(w * st) AS signed, count(*) FILTER (WHERE st <> 0 AND t <= 60 AND carried <> st) AS flips,
          coalesce(sum(w * st) FILTER (WHERE run = last_run), 0) AS final FROM (SELECT *, max(run) OVER (PARTITION BY sample_id)
          AS last_run FROM rn) GROUP BY sample_id) USING (sample_id)""",
        steps=[
            """st AS (SELECT *, CASE WHEN (bv1 - av1) / (bv1 + av1 + 1) > 0.05 THEN 1 WHEN (bv1 - av1) / (bv1 + av1 + 1) < -0.05
              THEN -1 ELSE 0 END AS st FROM mk)""",
            f"""nx AS (SELECT *, lead(t) {W} AS nt, lag(st) {W} AS pst, last_value(CASE WHEN st <> 0 THEN st END IGNORE NULLS)
              OVER (PARTITION BY sample_id ORDER BY t DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM st)""",
            f"""rn AS (SELECT *, {HELD.format(w=60)} AS w, sum(CASE WHEN pst = st THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id
              ORDER BY t DESC, seq ROWS UNBOUNDED PRECEDING) AS run FROM nx)""",
        ],
    ),
)
def imbalance_persistence(spark, path):
    s = streams(spark, path)
    return present(q.imbalance_persistence(s.market, s.spine))


def _recovery_sql():
    state = f"""st AS (SELECT sample_id, t, seq, CASE WHEN mid > 0 AND (a1 - b1) / mid > 0 THEN ln(greatest((a1 - b1) / mid, 1e-8)) END AS ls,
      CASE WHEN av1 + bv1 + av2 + bv2 > 0 THEN ln(1 + av1 + bv1 + av2 + bv2) END AS ld, CASE WHEN mid > 0 THEN ln(mid) END AS lm FROM mk)"""
    ahead = ", ".join(f"lead({x}, {k}) {W} AS {x}{k}" for x in ("ls", "ld", "lm") for k in (2, 5))
    behind = ", ".join(f"lag({x}) {W} AS p{x}" for x in ("t", "ls", "ld", "lm"))
    ch = f"""ch0 AS (SELECT *, {ahead}, {behind}, row_number() {W} AS pos FROM st)"""
    ch2 = """ch AS (SELECT *, pt IS NOT NULL AND t >= 15 AND t <= 60 AS el, CASE WHEN pt IS NOT NULL AND t >= 15 AND t <= 60 THEN ls - pls END AS xs,
      CASE WHEN pt IS NOT NULL AND t >= 15 AND t <= 60 THEN pld - ld END AS xd,
      CASE WHEN pt IS NOT NULL AND t >= 15 AND t <= 60 THEN lm - plm END AS xp FROM ch0)"""
    thr = """thr AS (SELECT quantile_cont(CASE WHEN xs > 0 THEN xs END, 0.95) AS ts, quantile_cont(CASE WHEN xd > 0 THEN xd END, 0.95) AS td,
      quantile_cont(abs(xp), 0.95) AS tp FROM ch WHERE sample_id IN (SELECT sample_id FROM lab WHERE month <= 7))"""
    at = lambda x, size, f: f"first({f} ORDER BY {size} DESC, pos) FILTER (WHERE {x} IS NOT NULL)"
    s = {"ns": "count(*) FILTER (WHERE xs > ts)", "nd": "count(*) FILTER (WHERE xd > td)", "np": "count(*) FILTER (WHERE abs(xp) > tp)",
         "ne": "count(*) FILTER (WHERE el)"}
    for x, f in (("xs", "ls"), ("xd", "ld")):
        s |= {f"{x}m": at(x, x, x), f"{x}0": at(x, x, f), f"{x}2": at(x, x, f + "2"), f"{x}5": at(x, x, f + "5")}
    s |= {"xpm": at("xp", "abs(xp)", "xp"), "xp0": at("xp", "abs(xp)", "lm"), "xp5": at("xp", "abs(xp)", "lm5")}

    def rec(x, n, a, sign):
        value = clip(f"({x}0 - {x}{a}) * ({sign}) / {x}m", -3, 3)
        return f"CASE WHEN {n} > 0 AND {x}m > 1e-12 AND {x}{a} IS NOT NULL THEN {value} ELSE 0 END"

    out = {
        "spread_shock_count_60": "ns", "spread_recovery_fraction_6": rec("xs", "ns", 2, 1),
        "spread_recovery_fraction_15": rec("xs", "ns", 5, 1), "depth_shock_count_60": "nd",
        "depth_recovery_fraction_6": rec("xd", "nd", 2, -1), "depth_recovery_fraction_15": rec("xd", "nd", 5, -1),
        "price_reversion_fraction_15": "CASE WHEN np > 0 AND abs(xpm) > 1e-12 AND xp5 IS NOT NULL THEN "
        + clip("-sign(xpm) * (xp5 - xp0) / abs(xpm)", -3, 3) + " ELSE 0 END",
        "liquidity_recovery_coverage_60": "CASE WHEN ne > 0 THEN least(ne / 16.0, 1) END",
    }
    return query(
        ["mk", "spine", "lab"],
        f"SELECT sample_id, {cols(out)} FROM spine LEFT JOIN s USING (sample_id)",
        fill=True,
        steps=[state, ch, ch2, thr, f"s AS (SELECT sample_id, {cols(s)} FROM ch, thr GROUP BY sample_id)"],
    )


@register("liquidity_recovery", _recovery_sql())
def liquidity_recovery(spark, path):
    s = streams(spark, path)
    fit = s.label.filter("month <= 7").select("sample_id")
    return present(q.liquidity_recovery(s.market, s.spine, fit))


@register(
    "feature_arm_flow",
    query(
        ["mk", "tx", "od", "spine"],
        "SELECT sample_id, tx_n, "
        + ", ".join(n for n in VOLATILITY if n.startswith(("x30_ord", "x30_qi")) or "ofi" in n or "depth_ratio" in n)
        + f" FROM (SELECT sample_id, coalesce(n, 0) AS tx_n FROM spine LEFT JOIN (SELECT sample_id, count(*) AS n FROM tx GROUP BY sample_id) USING (sample_id)) JOIN ({VOLATILITY_BODY}) USING (sample_id)",
        steps=VOLATILITY_STEPS,
    ),
)
def feature_arm_flow(spark, path):
    s = streams(spark, path)
    base = flow.on_spine(s.spine, flow.trade_summary(s.transaction).select("sample_id", "tx_n"), fill=0.0)
    pack = q.volatility_flow(s.market, s.transaction, s.order, s.spine)
    return present(columns.feature_arm(base, pack, None, "flow"))
