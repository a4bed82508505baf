"""Grids, bounded sequences and the families built on them, with their check SQL."""

from ..operators import book, grids, quotes
from ..operators.assemble import on_spine
from ..sources.adapters import streams
from .book import BASE_JOIN, base_steps
from .quotes import LINE, W
from .registry import present, register
from .sql import cols, query, sum_if

STEP_KEYS = ("sample_id", "step")
E12 = "1e-12::DOUBLE"
I1 = "(bv1 - av1) / (bv1 + av1 + 1)"
I2 = "(bv1 + bv2 - av1 - av2) / (bv1 + bv2 + av1 + av2 + 1)"
BARS = [
    f"""bars AS (SELECT *, lag(ap) {W} AS pap, lag(mid) {W} AS pm, lag(av1 + bv1) {W} AS pd, row_number() {W} AS pos,
      count(*) OVER (PARTITION BY sample_id) AS n FROM mk)"""
]
MOVE_AP = "coalesce(ln(ap / pap), 0) AS price_move"
VOL = "ln(1 + tv) AS log_volume, ln(1 + tc) AS log_count"
SHAPE = f"(a1 - b1) / mid AS relspread, {I1} AS imb1, {I2} AS imb2"


@register(
    "every_third_bar",
    query(
        ["mk"],
        f"SELECT sample_id, (pos - 1) // 3 AS step, {MOVE_AP}, {VOL}, {SHAPE} FROM bars WHERE (pos - 1) % 3 = 0 AND pos <= 180",
        keys=STEP_KEYS,
        steps=BARS,
    ),
)
def every_third_bar(spark, path):
    return present(grids.every_third_bar(streams(spark, path).market), STEP_KEYS)


@register(
    "last_bars",
    query(
        ["mk"],
        f"""SELECT sample_id, 119 - (n - pos) AS step, coalesce(ln(mid / pm), 0) AS mid_move, {MOVE_AP}, {VOL}, {SHAPE},
        coalesce(ln(1 + abs(av1 + bv1 - pd)) * sign(av1 + bv1 - pd), 0) AS depth_move FROM bars WHERE n - pos < 120""",
        keys=STEP_KEYS,
        steps=BARS,
    ),
)
def last_bars(spark, path):
    return present(grids.last_bars(streams(spark, path).market), STEP_KEYS)


RAW = {"transaction_avgprice": "ap", "transaction_volume": "tv", "transaction_count": "tc", "ask_price_1": "a1",
       "ask_volume_1": "av1", "bid_price_1": "b1", "bid_volume_1": "bv1", "ask_price_2": "a2", "ask_volume_2": "av2",
       "bid_price_2": "b2", "bid_volume_2": "bv2"}
FIT = "sample_id IN (SELECT sample_id FROM lab WHERE month <= 7)"


@register(
    "raw_sequence",
    query(
        ["mk", "lab"],
        "SELECT sample_id, 199 - (n - pos) AS step, "
        + cols({k: f"coalesce(({x} - m_{x}) / s_{x}, 0)" for k, x in RAW.items()})
        + ", t AS time_share, (tc > 0)::INT AS has_trades, 1 AS row_mask FROM bars, st WHERE n - pos < 200",
        keys=STEP_KEYS,
        steps=BARS
        + [
            "st AS (SELECT "
            + ", ".join(f"avg({x}) AS m_{x}, coalesce(nullif(stddev_pop({x}), 0), 1) AS s_{x}" for x in RAW.values())
            + f" FROM mk WHERE {FIT})"
        ],
    ),
)
def raw_sequence(spark, path):
    s = streams(spark, path)
    out = grids.raw_sequence(s.market, s.label.filter("month <= 7").select("sample_id"))
    # compared in seconds: shares of the window would sit on rounding edges
    return present(out.withColumn("time_share", out.time_share * 600), STEP_KEYS)


@register(
    "channel_statistics",
    query(
        ["mk"],
        "SELECT 0 AS k, " + cols({f"{k}_mean": f"avg({x})" for k, x in RAW.items()} | {f"{k}_std": f"stddev_pop({x})" for k, x in RAW.items()}) + " FROM mk",
        keys=("k",),
    ),
)
def channel_statistics(spark, path):
    out = grids.channel_statistics(streams(spark, path).market)
    return present(out.selectExpr("0 AS k", "*"), ("k",))


@register(
    "sequence_audit",
    query(
        ["mk", "lab"],
        """SELECT month, count(*) AS samples, avg((n >= 200)::INT) AS cap_rate, avg((n > 200)::INT) AS truncated_rate,
          count(*) FILTER (WHERE n = 0) AS empty, sum(bad) AS order_violations, avg(kept) AS kept_mean,
          quantile_cont(kept, 0.5) AS kept_q50, quantile_cont(cov, 0.1) AS coverage_q10, quantile_cont(cov, 0.5) AS coverage_q50,
          quantile_cont(act, 0.5) AS activity_q50, stddev_pop(act) AS activity_std FROM
          (SELECT month, coalesce(n, 0) AS n, coalesce(kept, 0)::DOUBLE AS kept, coalesce(bad, 0) AS bad, cov, act FROM lab LEFT JOIN
          (SELECT sample_id, max(n) AS n, count(*) AS kept, max(t) - min(t) AS cov, avg((tc > 0)::INT) AS act, 0 AS bad
          FROM bars WHERE n - pos < 200 GROUP BY sample_id) USING (sample_id)) GROUP BY month""",
        keys=("month",),
        steps=BARS,
    ),
)
def sequence_audit(spark, path):
    s = streams(spark, path)
    return present(grids.sequence_audit(s.market, s.label), ("month",))


def second_steps():
    v = "ln(1 + {})"
    orders = {
        "new_bid": sum_if("volume", "act = 0 AND side = 0"), "new_ask": sum_if("volume", "act = 0 AND side = 1"),
        "cancel_bid": sum_if("volume", "act = 1 AND side = 0"), "cancel_ask": sum_if("volume", "act = 1 AND side = 1"),
    }
    m = f"greatest(mid, {E12})"
    names = grids.CHANNELS
    return [
        f"q1 AS (SELECT *, lag({m}) {W} AS pmid FROM mk WHERE floor(t) < 120)",
        f"""gq AS (SELECT sample_id, 119 - floor(t)::INT AS step, coalesce(sum(ln({m} / pmid)), 0) AS mid_move, avg((a1 - b1) / {m}) AS relspread,
          avg({I1}) AS imb1, avg((a1 * bv1 + b1 * av1) / greatest(av1 + bv1, 1) / {m} - 1) AS micro, avg((a2 - a1) / {m}) AS ask_gap
          FROM q1 GROUP BY ALL)""",
        """gt AS (SELECT sample_id, 119 - floor(t)::INT AS step, sum(sgn * ln(1 + volume)) AS signed_log, ln(1 + sum(volume)) AS volume,
          ln(1 + count(*)) AS trades FROM tx WHERE floor(t) < 120 GROUP BY ALL)""",
        f"go AS (SELECT sample_id, 119 - floor(t)::INT AS step, {cols({k: v.format(x) for k, x in orders.items()})} FROM od WHERE floor(t) < 120 GROUP BY ALL)",
        "grid AS (SELECT sample_id, step, "
        + ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
        + """ FROM spine CROSS JOIN (SELECT unnest(range(120))::INT AS step) LEFT JOIN gq USING (sample_id, step)
          LEFT JOIN gt USING (sample_id, step) LEFT JOIN go USING (sample_id, step))""",
    ]


@register("second_grid", query(["mk", "tx", "od", "spine"], "SELECT * FROM grid", keys=STEP_KEYS, steps=second_steps()))
def second_grid(spark, path):
    s = streams(spark, path)
    return present(grids.second_grid(s.market, s.transaction, s.order, s.spine), STEP_KEYS)


def _grid_stats_sql():
    names = grids.CHANNELS
    forms = {
        "mean": "avg({x})", "std": "stddev_pop({x})", "min": "min({x})", "max": "max({x})",
        "q10": "quantile_cont({x}, 0.1)", "q90": "quantile_cont({x}, 0.9)", "last": "avg({x}) FILTER (WHERE step >= 90)",
        "first": "avg({x}) FILTER (WHERE step < 30)",
        "drift": "avg({x}) FILTER (WHERE step >= 90) - avg({x}) FILTER (WHERE step < 30)",
        "last_std": "stddev_pop({x}) FILTER (WHERE step >= 90)",
        "ac1": "sum(({x} - m_{x}) * (l1_{x} - m_{x})) / (sum(pow({x} - m_{x}, 2)) + 1e-12)",
        "ac5": "sum(({x} - m_{x}) * (l5_{x} - m_{x})) / (sum(pow({x} - m_{x}, 2)) + 1e-12)",
    }
    out = {f"x23_{k}_c{i}": f.format(x=n) for i, n in enumerate(names) for k, f in forms.items()}
    d = lambda n: f"({n} - m_{n})"
    for i, j in grids.PAIRS:
        a, b = d(names[i]), d(names[j])
        out[f"x23_corr_{i}_{j}"] = f"sum({a} * {b}) / (sqrt(sum({a} * {a}) * sum({b} * {b})) + 1e-12)"
    pre = ", ".join(
        f"avg({n}) OVER (PARTITION BY sample_id) AS m_{n}, lag({n}, 1) OVER w AS l1_{n}, lag({n}, 5) OVER w AS l5_{n}" for n in names
    )
    return query(
        ["mk", "tx", "od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM gm GROUP BY sample_id",
        steps=second_steps() + [f"gm AS (SELECT *, {pre} FROM grid WINDOW w AS (PARTITION BY sample_id ORDER BY step))"],
    )


@register("grid_statistics", _grid_stats_sql())
def grid_statistics(spark, path):
    s = streams(spark, path)
    return present(grids.grid_statistics(grids.second_grid(s.market, s.transaction, s.order, s.spine)))


B50 = lambda x: f"greatest(least(coalesce({x}, 0), 50), -50)"
E6 = "1e-6::DOUBLE"
D1, D2 = "(av1 + bv1)", "(av1 + bv1 + av2 + bv2)"
MARKET_CHANNELS = {
    "mid_rel": "mid - 1", "txpx_rel": "ap - 1", "rel_spread1": f"(a1 - b1) / (mid + {E6})", "rel_spread2": f"(a2 - b2) / (mid + {E6})",
    "imb1": f"(bv1 - av1) / ({D1} + {E6})", "imb2": f"(bv1 + bv2 - av1 - av2) / ({D2} + {E6})",
    "micro_rel": f"(a1 * bv1 + b1 * av1) / ({D1} + {E6}) / (mid + {E6}) - 1", "slope": f"((a2 - a1) + (b1 - b2)) / (mid + {E6})",
    "log_depth": f"ln(1 + {D2})", "log_txv": "ln(1 + tv)", "log_txc": "ln(1 + tc)",
}
MARKET_GRID = f"""mg AS (SELECT sample_id, 199 - least(floor(t / 3), 199)::INT AS step, count(*) AS rows,
  {cols({k: f'avg({B50(x)})' for k, x in MARKET_CHANNELS.items()})} FROM mk GROUP BY ALL)"""


@register("market_grid", query(["mk"], "SELECT * FROM mg", keys=STEP_KEYS, steps=[MARKET_GRID]))
def market_grid(spark, path):
    return present(grids.market_grid(streams(spark, path).market), STEP_KEYS)


FLOW_STEP = "59 - least(floor(t / 1), 59)::INT AS step"


def _flow_grid(stream, cond):
    return {k: f"coalesce(sum({B50('volume')}) FILTER (WHERE {x}), 0)" for k, x in cond.items()}


@register(
    "trade_grid",
    query(
        ["tx"],
        f"""SELECT sample_id, step, n AS rows, {B50(f'CASE WHEN v > 0 THEN a / (v + {E6}) ELSE 0 END - 1')} AS vwap_rel, p / n - 1 AS price_mean_rel,
        sqrt(greatest(p2 / n - pow(p / n, 2), 0)) AS price_std, ln(1 + v) AS log_vol, ln(1 + n) AS log_count,
        s / (v + 1) AS signed_ratio, b / (n + 1) AS buy_trade_ratio FROM g""",
        keys=STEP_KEYS,
        steps=[
            f"""g AS (SELECT sample_id, {FLOW_STEP}, count(*) AS n, sum({B50('volume')}) AS v, sum({B50('price * volume')}) AS a,
            sum({B50('price')}) AS p, sum({B50('price * price')}) AS p2, sum({B50('sgn * volume')}) AS s,
            count(*) FILTER (WHERE side = 0) AS b FROM tx GROUP BY ALL)"""
        ],
    ),
)
def trade_grid(spark, path):
    return present(grids.trade_grid(streams(spark, path).transaction), STEP_KEYS)


@register(
    "order_grid",
    query(
        ["od"],
        """SELECT sample_id, step, n AS rows, p / n - 1 AS price_mean_rel, sqrt(greatest(p2 / n - pow(p / n, 2), 0)) AS price_std,
        ln(1 + v) AS log_vol, ln(1 + n) AS log_count, s / (v + 1) AS signed_ratio, a / (v + 1) AS action_ratio, g / (v + 1) AS pressure_ratio,
        cn / (v + 1) AS cancel_ratio, (nb - ns) / (nw + 1) AS new_imb, (cb - cs) / (cn + 1) AS cancel_imb FROM g""",
        keys=STEP_KEYS,
        steps=[
            f"""g AS (SELECT sample_id, {FLOW_STEP}, count(*) AS n, sum({B50('volume')}) AS v, sum(price) AS p, sum(price * price) AS p2,
            sum({B50('sgn * volume')}) AS s, sum({B50('(1 - 2 * act) * volume')}) AS a, sum({B50('sgn * (1 - 2 * act) * volume')}) AS g, """
            + cols(
                _flow_grid("od", {"cn": "act = 1", "nw": "act = 0", "nb": "act = 0 AND side = 0", "ns": "act = 0 AND side = 1",
                                  "cb": "act = 1 AND side = 0", "cs": "act = 1 AND side = 1"})
            )
            + " FROM od GROUP BY ALL)"
        ],
    ),
)
def order_grid(spark, path):
    return present(grids.order_grid(streams(spark, path).order), STEP_KEYS)


def _cell(cells, width):
    return f"least(greatest(ceil((590 - t) / {width}), 0), {cells - 1})::INT"


def _fingerprint(cells, width):
    @register(
        f"fingerprint_{cells}",
        query(["mk"], f"SELECT sample_id, {_cell(cells, width)} AS step, avg(ap) AS price, avg(tv) AS volume FROM mk GROUP BY ALL", keys=STEP_KEYS),
    )
    def run(spark, path):
        return present(grids.fingerprint(streams(spark, path).market, cells, float(width)), STEP_KEYS)


_fingerprint(30, 20)
_fingerprint(60, 10)


def _matrix_sql():
    wide = {f"fp_dlp_{i}": f"coalesce(max(dlp) FILTER (WHERE step = {i}), 0)" for i in range(1, 60)}
    wide |= {f"fp_lv_{i}": f"max(lv) FILTER (WHERE step = {i})" for i in range(60)}
    joined = f"SELECT * FROM {BASE_JOIN} LEFT JOIN fpw USING (sample_id) LEFT JOIN o4 USING (sample_id)"
    x = "coalesce(CAST(COLUMNS(* EXCLUDE (sample_id)) AS DOUBLE), 0)"
    mean = "avg(COLUMNS(* EXCLUDE (sample_id, month)))"
    return joined, wide, x, mean


def fingerprint_matrix_steps():
    joined, wide, x, _ = _matrix_sql()
    return (
        base_steps("interval")
        + LINE
        + [
            f"f0 AS (SELECT sample_id, {_cell(60, 10)} AS step, avg(ap) AS price, avg(tv) AS volume FROM mk GROUP BY ALL)",
            "f1 AS (SELECT sample_id, step, ln(price) AS lp, ln(1 + coalesce(volume, 0)) AS lv FROM spine CROSS JOIN (SELECT unnest(range(60))::INT AS step) LEFT JOIN f0 USING (sample_id, step))",
            "f2 AS (SELECT *, lp - lag(lp) OVER (PARTITION BY sample_id ORDER BY step) AS dlp FROM f1)",
            f"fpw AS (SELECT sample_id, {cols(wide)} FROM f2 GROUP BY sample_id)",
            """o4 AS (SELECT sample_id, ofi1, ofi2, ofi1_late, kyle_lambda FROM spine LEFT JOIN (SELECT sample_id, sum(u1) AS ofi1, sum(u2) AS ofi2,
              sum(u1) FILTER (WHERE t <= 120) AS ofi1_late FROM l GROUP BY sample_id) USING (sample_id) LEFT JOIN (SELECT sample_id,
              covar_pop(price - pp, sgn * volume) / greatest(var_pop(sgn * volume), 1e-12) AS kyle_lambda FROM (SELECT *, lag(price)
              OVER (PARTITION BY sample_id ORDER BY t DESC, seq) AS pp FROM tx) WHERE pp IS NOT NULL GROUP BY sample_id) USING (sample_id))""",
            f"m0 AS ({joined})",
            f"m AS (SELECT sample_id, {x} FROM m0)",
        ]
    )


@register(
    "fingerprint_matrix",
    query(
        ["mk", "tx", "od", "spine", "lab"],
        """SELECT sample_id, name, greatest(least((x - mu) / sd, 10), -10) AS x FROM long JOIN st USING (name)""",
        keys=("sample_id", "name"),
        steps=fingerprint_matrix_steps()
        + [
            "long AS (UNPIVOT m ON COLUMNS(* EXCLUDE (sample_id)) INTO NAME name VALUE x)",
            f"st AS (SELECT name, avg(x) AS mu, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) + 1e-6 AS sd FROM long WHERE {FIT} GROUP BY name)",
        ],
    ),
)
def fingerprint_matrix(spark, path):
    from ..operators.preprocess import standardise

    s = streams(spark, path)
    parts = [
        book.base_features(s.market, s.transaction, s.order, s.spine),
        grids.fingerprint_columns(s.market, s.spine),
        quotes.simple_ofi(s.market, s.transaction, s.spine),
    ]
    wide = on_spine(s.spine, *parts, fill=0.0)
    names = [n for n in wide.columns if n != "sample_id"]
    fit = s.label.filter("month <= 7").select("sample_id")
    z = standardise(wide, names, fit, clip_at=10.0)
    return present(z.unpivot("sample_id", names, "name", "x"), ("sample_id", "name"))


def _events_sql(stream, limit, kinds, order):
    cat = "act * 2 + side" if order else "side"
    sums = {}
    for k in range(kinds):
        sums |= {f"v{k}": sum_if("volume", f"{cat} = {k}"), f"n{k}": f"count(*) FILTER (WHERE {cat} = {k})",
                 f"a{k}": sum_if("volume * price", f"{cat} = {k}")}
    enc = {}
    for k in range(kinds):
        enc |= {f"log_volume_{k}": f"ln(1 + v{k})", f"log_count_{k}": f"ln(1 + n{k})",
                f"vwap_rel_{k}": f"CASE WHEN v{k} > 0 THEN a{k} / v{k} ELSE 1 END - 1"}
    names = [f"{x}{k}" for k in range(kinds) for x in "vna"]
    return query(
        [stream],
        f"""SELECT sample_id, (pos - 1 - older + (older > 0)::INT)::INT AS step, {cols(enc)}, ln(1 + coalesce(pt - t, 0)) AS log_gap, t / 60 AS time_share,
        0 AS is_prefix FROM e WHERE pos > older UNION ALL SELECT sample_id, 0, {cols(enc)}, 0, t / 60, 1 FROM
        (SELECT sample_id, {', '.join(f'sum({n}) AS {n}' for n in names)}, avg(t) AS t FROM e WHERE pos <= older GROUP BY sample_id)""",
        keys=STEP_KEYS,
        steps=[
            f"e0 AS (SELECT sample_id, t, {cols(sums)} FROM {stream} WHERE t >= 0 AND t <= 60 GROUP BY ALL)",
            f"""e AS (SELECT *, row_number() OVER w AS pos, lag(t) OVER w AS pt, greatest(count(*) OVER (PARTITION BY sample_id) - {limit}, 0) AS older
            FROM e0 WINDOW w AS (PARTITION BY sample_id ORDER BY t DESC))""",
        ],
    )


@register("trade_sequence", _events_sql("tx", 32, 2, False))
def trade_sequence(spark, path):
    return present(grids.event_sequence(streams(spark, path).transaction, 32), STEP_KEYS)


@register("order_sequence", _events_sql("od", 48, 4, True))
def order_sequence(spark, path):
    return present(grids.event_sequence(streams(spark, path).order, 48, is_order=True), STEP_KEYS)


@register(
    "event_coverage",
    query(
        ["tx"],
        """SELECT sample_id, count(*) AS unique_timestamps, sum(raw) AS raw_events, sum(v) FILTER (WHERE pos > n - 32) / sum(v) AS kept_volume_share,
        max(t) FILTER (WHERE pos > n - 32) - min(t) AS kept_span_seconds, max(t) - min(t) AS full_span_seconds,
        CASE WHEN max(t) > min(t) THEN (max(t) FILTER (WHERE pos > n - 32) - min(t)) / (max(t) - min(t)) ELSE 1 END AS span_share,
        (count(*) > 32)::INT AS needs_prefix_summary FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY t DESC) AS pos,
        count(*) OVER (PARTITION BY sample_id) AS n FROM (SELECT sample_id, t, sum(volume) AS v, count(*) AS raw FROM tx GROUP BY ALL))
        GROUP BY sample_id""",
    ),
)
def event_coverage(spark, path):
    return present(grids.event_coverage(streams(spark, path).transaction, 32))


@register(
    "resample_seconds",
    query(
        ["tx"],
        """SELECT sample_id, second, price, volume, side, row_count FROM (SELECT DISTINCT sample_id FROM tx)
        CROSS JOIN (SELECT unnest(range(61))::INT AS second) LEFT JOIN (SELECT sample_id, round_even(t, 0)::INT AS second, avg(price) AS price,
        sum(volume) AS volume, sum(side) AS side, count(*) AS row_count FROM tx GROUP BY ALL) USING (sample_id, second)""",
        keys=("sample_id", "second"),
    ),
)
def resample_seconds(spark, path):
    return present(grids.resample_seconds(streams(spark, path).transaction), ("sample_id", "second"))


def _lags_sql():
    inner = lambda x, y: (
        f"CASE WHEN sqrt(sum({x} * {x}) FILTER (WHERE {y} IS NOT NULL) * sum({y} * {y})) > 1e-8 THEN sum({x} * {y}) / "
        f"sqrt(sum({x} * {x}) FILTER (WHERE {y} IS NOT NULL) * sum({y} * {y})) ELSE 0 END"
    )
    out = {}
    for s, x in (("trade", "tr"), ("order", "od1"), ("ofi", "ofi")):
        for k, r in enumerate(("r", "r1", "r2")):
            out[f"lag_{s}_return_{k}bin"] = inner(x, r)
        out[f"lag_{s}_next_return_slope"] = f"sum({x} * r1) / (sum({x} * {x}) FILTER (WHERE r1 IS NOT NULL) + 0.01)"
    p = "(tr + od1 + ofi)"
    for n, side, stuck in (("buy_no_rise", "", "r1 <= 0"), ("sell_no_fall", "-", "r1 >= 0")):
        push = f"greatest({side}{p}, 0)"
        out[f"lag_{n}_share"] = (
            f"coalesce(sum({push}) FILTER (WHERE {stuck}), 0) / greatest(sum({push}) FILTER (WHERE r1 IS NOT NULL), 1e-8)"
        )
    for k in (1, 2):
        out[f"lag_trade_order_replenish_{k}bin"] = inner("tr", f"(-o{k})")
    ok = lambda q: f"({q}a > 0 AND {q}b > 0 AND {q}a >= {q}b)"
    depth = lambda q: f"(CASE WHEN {ok(q)} THEN {q}av + {q}bv ELSE 0 END)"
    c5 = lambda x: f"greatest(least({x}, 5), -5)"
    ofi = """((coalesce(b >= pb, FALSE))::INT * coalesce(bv, 0) - (coalesce(b <= pb, FALSE))::INT * coalesce(pbv, 0)
      - (coalesce(a <= pa, FALSE))::INT * coalesce(av, 0) + (coalesce(a >= pa, FALSE))::INT * coalesce(pav, 0))"""
    b = "19 - floor(t / 3)::INT AS bin"
    near = "ORDER BY t, seq DESC"
    return query(
        ["mk", "tx", "od", "spine"],
        f"SELECT sample_id, {cols(out)} FROM s2 GROUP BY sample_id",
        steps=[
            f"gq AS (SELECT sample_id, {b}, first(a1 {near}) AS a, first(b1 {near}) AS b, first(av1 {near}) AS av, first(bv1 {near}) AS bv FROM mk WHERE t < 60 GROUP BY ALL)",
            f"gt AS (SELECT sample_id, {b}, sum(sgn * volume) AS ts, sum(volume) AS tv FROM tx WHERE t < 60 GROUP BY ALL)",
            f"go AS (SELECT sample_id, {b}, sum(sgn * (1 - 2 * act) * volume) AS os, sum(volume) AS ov FROM od WHERE t < 60 GROUP BY ALL)",
            """g0 AS (SELECT sample_id, bin, coalesce(ts, 0) AS ts, coalesce(tv, 0) AS tv, coalesce(os, 0) AS os, coalesce(ov, 0) AS ov, """
            + ", ".join(f"last_value({x} IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS {x}" for x in ("a", "b", "av", "bv"))
            + """ FROM spine CROSS JOIN (SELECT unnest(range(20))::INT AS bin) LEFT JOIN gq USING (sample_id, bin)
              LEFT JOIN gt USING (sample_id, bin) LEFT JOIN go USING (sample_id, bin))""",
            "g1 AS (SELECT *, " + ", ".join(f"lag({x}) OVER w AS p{x}" for x in ("a", "b", "av", "bv")) + " FROM g0 WINDOW w AS (PARTITION BY sample_id ORDER BY bin))",
            f"""s0 AS (SELECT sample_id, bin, CASE WHEN {ok('')} AND {ok('p')} THEN {c5('((a + b) / 2 - (pa + pb) / 2) / greatest(pa - pb, 1e-8)')} ELSE 0 END AS r,
              {c5(f'ts / greatest({depth("")} + tv, 1)')} AS tr, {c5(f'os / greatest({depth("")} + ov, 1)')} AS od1,
              CASE WHEN {ok('')} AND {ok('p')} THEN {c5(f'{ofi} / greatest({depth("")} + {depth("p")}, 1)')} ELSE 0 END AS ofi FROM g1)""",
            """s2 AS (SELECT *, lead(r) OVER w AS r1, lead(r, 2) OVER w AS r2, lead(od1) OVER w AS o1, lead(od1, 2) OVER w AS o2 FROM s0
              WINDOW w AS (PARTITION BY sample_id ORDER BY bin))""",
        ],
    )


@register("stream_lags", _lags_sql())
def stream_lags(spark, path):
    s = streams(spark, path)
    return present(grids.stream_lags(s.market, s.transaction, s.order, s.spine))


def _path_sql():
    corr = lambda x, cond: (
        f"CASE WHEN count(*) FILTER (WHERE {cond}) * sqrt(var_pop({x}) FILTER (WHERE {cond}) * var_pop(r) FILTER (WHERE {cond})) > 1e-16 THEN "
        f"covar_pop({x}, r) FILTER (WHERE {cond}) / sqrt(var_pop({x}) FILTER (WHERE {cond}) * var_pop(r) FILTER (WHERE {cond})) ELSE 0 END"
    )
    safe = lambda n, d: f"CASE WHEN {d} > 1e-16 THEN ({n}) / ({d}) ELSE 0 END"
    out = {f"mid_return_autocorr_{k}_full": corr(f"r{k}", f"r{k} IS NOT NULL") for k in (1, 2, 5, 10)}
    out |= {f"mid_return_autocorr_{k}_60": corr(f"r{k}", f"step >= {140 + k}") for k in (1, 2, 5)}
    rv = lambda c: f"sqrt(coalesce(sum(r * r) FILTER (WHERE {c}), 0))"
    out |= {
        "mid_path_efficiency_full": safe("abs(sum(r))", "sum(abs(r))"),
        "mid_path_efficiency_60": safe("abs(sum(r) FILTER (WHERE step >= 140))", "sum(abs(r)) FILTER (WHERE step >= 140)"),
        "mid_sign_persistence": "CASE WHEN count(*) FILTER (WHERE r * r1 <> 0) > 0 THEN sum(sign(r) * sign(r1)) FILTER (WHERE r * r1 <> 0) / count(*) FILTER (WHERE r * r1 <> 0) ELSE 0 END",
        "mid_reversal_magnitude_fraction": safe("coalesce(sum(abs(r)) FILTER (WHERE sign(r) * sign(r1) < 0), 0)", "sum(abs(r)) FILTER (WHERE r1 IS NOT NULL)"),
        "mid_jump_concentration_top5": safe("sum(abs(r)) FILTER (WHERE rk <= 5)", "sum(abs(r))"),
        "mid_max_drawdown_log": "max(hi - lm)", "mid_max_runup_log": "max(lm - lo)",
        "mid_rv_ratio_20_to_60": safe(rv("step >= 180"), rv("step >= 140")), "mid_rv_ratio_60_to_full": safe(rv("step >= 140"), rv("TRUE")),
    }
    spec = {
        "mid_spectral_low_fraction": safe("coalesce(sum(p) FILTER (WHERE k < 5), 0)", "sum(p)"),
        "mid_spectral_mid_fraction": safe("sum(p) FILTER (WHERE k >= 5 AND k < 17)", "sum(p)"),
        "mid_spectral_high_fraction": safe("sum(p) FILTER (WHERE k >= 17)", "sum(p)"),
        "mid_spectral_entropy": "-sum(CASE WHEN tot > 1e-16 THEN p / tot * ln(p / tot + 1e-20) ELSE 0 END) / ln(99)",
        "mid_dominant_frequency": "first(k ORDER BY p DESC, k) / 99",
    }
    steps = [
        MARKET_GRID,
        "p0 AS (SELECT sample_id, step, CASE WHEN mid_rel > -0.9 THEN mid_rel END AS x FROM spine CROSS JOIN (SELECT unnest(range(200))::INT AS step) LEFT JOIN mg USING (sample_id, step))",
        """p1 AS (SELECT sample_id, step, ln(1 + CASE WHEN x1 > 10 THEN 10 ELSE x1 END) AS lm FROM (SELECT sample_id, step, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY step ROWS UNBOUNDED PRECEDING),
          first_value(x IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x1 FROM p0))""",
        """p2 AS (SELECT *, lm - lag(lm) OVER w AS r, max(lm) OVER (PARTITION BY sample_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS hi,
          min(lm) OVER (PARTITION BY sample_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS lo FROM p1 WHERE lm IS NOT NULL WINDOW w AS (PARTITION BY sample_id ORDER BY step))""",
        "p3 AS (SELECT *, " + ", ".join(f"lag(r, {k}) OVER w AS r{k}" for k in (1, 2, 5, 10))
        + ", row_number() OVER (PARTITION BY sample_id ORDER BY abs(r) DESC NULLS LAST, step) AS rk FROM p2 WINDOW w AS (PARTITION BY sample_id ORDER BY step))",
        f"a AS (SELECT sample_id, {cols(out)}, var_pop(r) AS vr FROM p3 GROUP BY sample_id)",
        """f0 AS (SELECT sample_id, k, pow(sum(r * cos(2 * pi() * k * (step - 1) / 199)), 2) + pow(sum(r * sin(2 * pi() * k * (step - 1) / 199)), 2) AS p
          FROM p3 CROSS JOIN (SELECT unnest(range(1, 100)) AS k) WHERE r IS NOT NULL GROUP BY ALL)""",
        f"f AS (SELECT sample_id, {cols(spec)} FROM (SELECT *, sum(p) OVER (PARTITION BY sample_id) AS tot FROM f0) GROUP BY sample_id)",
    ]
    vrs = []
    for h in (2, 5, 10):
        lo = 200 - 199 // h * h
        steps.append(
            f"v{h} AS (SELECT sample_id, var_pop(x) AS bv{h} FROM (SELECT sample_id, (step - {lo}) // {h} AS b, sum(r) AS x FROM p3 WHERE step >= {lo} GROUP BY ALL) GROUP BY sample_id)"
        )
        vrs.append(f"CASE WHEN {h} * vr > 1e-16 THEN least(bv{h} / ({h} * vr), 10) ELSE 0 END AS mid_variance_ratio_{h}")
    return query(
        ["mk", "spine"],
        f"""SELECT sample_id, {', '.join(list(out) + list(spec))}, {', '.join(vrs)} FROM spine LEFT JOIN a USING (sample_id) LEFT JOIN f USING (sample_id)
        LEFT JOIN v2 USING (sample_id) LEFT JOIN v5 USING (sample_id) LEFT JOIN v10 USING (sample_id)""",
        fill=True,
        steps=steps,
    )


@register("path_shape", _path_sql())
def path_shape(spark, path):
    s = streams(spark, path)
    return present(grids.path_shape(s.market, s.spine), fill=0)
