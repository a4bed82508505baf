"""Trade and order families that need chronological order or a matching quote."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.lazy import Columns
from ..functions.expr import EPS, at_least, bucket, clip, ratio, seconds
from ..functions.stats import count_if, sum0, sum_if
from ..schema import KEY, SEQ, TIME
from .assemble import derive, on_spine, summarise
from .book import market_tables
from .flow import trade_flow
from .joins import asof_join, densify
from .quantile import exact_quantiles
from .quotes import book_signals
from .timeline import Timeline, lookup

c = F.col

TRADE = Columns(
    p=lambda: X.price, v=lambda: X.volume, g=lambda: X.side_sign, sv=lambda: X.signed_volume, t=seconds
)

# A quote older than this many seconds does not match.
TOLERANCE = 6.0
MATCH_SPAN = 66.0


def trade_line(transaction, *names):
    return Timeline.of(transaction).select(SEQ, TIME, *[getattr(TRADE, n).alias(n) for n in names])


# trades and orders against the latest earlier quote ----------------------------------------------

PAYLOAD = ("ask_price_1", "ask_volume_1", "bid_price_1", "bid_volume_1", "ask_price_2", "bid_price_2")


def _matched(events, market):
    recent = market.filter(seconds() <= MATCH_SPAN)
    return asof_join(events.filter(seconds() <= 60), recent, PAYLOAD, tolerance=TOLERANCE)


quote_imbalance = lambda: ratio(X.bidv1 - X.askv1, X.bidv1 + X.askv1, "nonzero")
share = lambda n, d: ratio(n, d, "nonzero")


def trade_quote_state(transaction, market, spine):
    """16 columns: trades relative to the depth, mid and book state just before them."""
    t = seconds()
    reference = summarise(
        market.filter(t <= 60),
        {
            f"ref_{k}_{w}": F.avg(F.when(t <= w, x))
            for w in (15, 60)
            for k, x in (("ask", X.askv1), ("bid", X.bidv1), ("imb", quote_imbalance()))
        },
    )
    rows = lookup(_matched(transaction, market), reference, [KEY])
    depth = F.when(X.is_buy, X.askv1).otherwise(X.bidv1)
    valid = c("match_seconds").isNotNull() & (depth > 0) & (X.volume >= 0)
    priced = valid & (X.price > 0) & (X.mid > 0) & X.has_quote & (X.ask1 >= X.bid1)
    v, g = X.volume, X.side_sign
    use = F.log1p(F.try_divide(v, depth))
    bps = 1.0e4 * (X.price - X.mid) / X.mid
    aggs = {}
    for w in (15, 60):
        inside = t <= w
        ref_depth = F.when(X.is_buy, c(f"ref_ask_{w}")).otherwise(c(f"ref_bid_{w}"))
        thin = F.try_divide(ref_depth, ref_depth + depth)
        ok, okp = inside & valid, inside & priced
        aggs |= {
            f"n{w}": count_if(inside), f"all{w}": sum_if(inside, v), f"v{w}": sum_if(ok, v), f"pv{w}": sum_if(okp, v),
            f"signed{w}": sum_if(ok, g * use), f"gross{w}": sum_if(ok, use), f"exec{w}": sum_if(okp, v * bps),
            f"cost{w}": sum_if(okp, v * g * bps), f"book{w}": sum_if(ok, v * quote_imbalance()),
            f"thin{w}": sum_if(ok, v * g * thin), f"imb{w}": F.max(f"ref_imb_{w}"),
        }
    old = (t > 15) & (t <= 60)
    aggs |= {
        "n_old": count_if(old), "signed_old": sum_if(old & valid, g * use), "pv_old": sum_if(old & priced, v),
        "exec_old": sum_if(old & priced, v * bps),
    }
    s = summarise(rows, aggs)
    out = {}
    for w in (15, 60):
        seen = c(f"n{w}") > 0
        out |= {
            f"tx_depth_signed_rate_{w}": F.when(seen, c(f"signed{w}") / float(w)),
            f"tx_depth_gross_rate_{w}": F.when(seen, c(f"gross{w}") / float(w)),
            f"tx_exec_mid_bps_{w}": share(c(f"exec{w}"), c(f"pv{w}")),
            f"tx_effective_cost_bps_{w}": share(c(f"cost{w}"), c(f"pv{w}")),
            f"tx_book_state_shift_{w}": share(c(f"book{w}"), c(f"v{w}")) - c(f"imb{w}"),
            f"tx_thin_book_signed_share_{w}": share(c(f"thin{w}"), c(f"v{w}")),
            f"tx_quote_matched_volume_share_{w}": share(c(f"v{w}"), c(f"all{w}")),
        }
    rate_old = F.when(c("n_old") > 0, c("signed_old") / 45.0)
    out["tx_depth_signed_accel_15_vs_15_60"] = out["tx_depth_signed_rate_15"] - rate_old
    out["tx_exec_mid_accel_15_vs_15_60"] = out["tx_exec_mid_bps_15"] - share(c("exec_old"), c("pv_old"))
    return on_spine(spine, derive(s, out))


def _order_positions(order, market):
    """Matched orders with validity, closeness to the own best price, and their place in the book."""
    rows = _matched(order, market)
    own = F.when(X.is_buy, X.bid1).otherwise(X.ask1)
    tick = F.when(X.is_buy, X.bid1 - X.bid2).otherwise(X.ask2 - X.ask1)
    depth = F.when(X.is_buy, X.bidv1).otherwise(X.askv1)
    scale = F.greatest(X.spread, tick, F.lit(1e-8))
    p = X.price
    return rows.select(
        KEY,
        seconds().alias("t"),
        X.volume.alias("v"),
        X.side_sign.alias("g"),
        X.action_sign.alias("a"),
        (
            c("match_seconds").isNotNull() & (p > 0) & X.has_quote & (X.ask1 >= X.bid1) & (depth > 0)
            & (X.volume >= 0) & X.side_sign.isNotNull() & X.action_sign.isNotNull()
        ).alias("valid"),
        F.exp(clip(-F.abs(p - own) / scale, -30, 0)).alias("near"),
        ((X.is_buy & (p >= X.ask1)) | (X.is_sell & (p <= X.bid1))).alias("crosses"),
        ((p > X.bid1) & (p < X.ask1)).alias("inside"),
        F.log1p(F.try_divide(X.volume, depth)).alias("use"),
    )


POSITION_WINDOWS = {15: (0, 15), 60: (0, 60), 45: (15, 60)}


def _position_sums(rows, windows):
    aggs = {}
    v, g, a, nv = c("v"), c("g"), c("a"), c("v") * c("near")
    for w in windows:
        lo, hi = POSITION_WINDOWS[w]
        span = (c("t") > lo if lo else F.lit(True)) & (c("t") <= hi)
        ok = span & c("valid")
        new, can, buy = ok & (a > 0), ok & (a < 0), g > 0
        aggs |= {
            f"all{w}": sum_if(span, v), f"v{w}": sum_if(ok, v), f"new{w}": sum_if(new, v), f"can{w}": sum_if(can, v),
            f"cross{w}": sum_if(new & c("crosses"), g * v), f"in{w}": sum_if(new & c("inside"), g * v),
            f"nearnew{w}": sum_if(new, g * nv), f"nearcan{w}": sum_if(can, -g * nv), f"net{w}": sum_if(ok, a * g * nv),
            f"bc{w}": sum_if(can & buy, nv), f"bn{w}": sum_if(new & buy, nv), f"sc{w}": sum_if(can & ~buy, nv),
            f"sn{w}": sum_if(new & ~buy, nv), f"bv{w}": sum_if(new & buy, v), f"svv{w}": sum_if(new & ~buy, v),
            f"use{w}": sum_if(ok, a * g * c("near") * c("use")),
        }
    return summarise(rows, aggs)


def _position_columns(w):
    k = lambda n: c(f"{n}{w}")
    ratio_of = lambda n, d: ratio(n, d, "nonzero")
    return {
        f"order_crossable_new_direction_share_{w}": ratio_of(k("cross"), k("new")),
        f"order_inside_new_direction_share_{w}": ratio_of(k("in"), k("new")),
        f"order_near_new_pressure_{w}": ratio_of(k("nearnew"), k("new")),
        f"order_near_cancel_pressure_{w}": ratio_of(k("nearcan"), k("can")),
        f"order_near_net_pressure_{w}": ratio_of(k("net"), k("v")),
        f"order_cancel_ratio_side_diff_{w}": ratio_of(k("sc"), k("sc") + k("sn")) - ratio_of(k("bc"), k("bc") + k("bn")),
        f"order_new_closeness_side_diff_{w}": ratio_of(k("bn"), k("bv")) - ratio_of(k("sn"), k("svv")),
        f"order_depth_adjusted_net_rate_{w}": k("use") / float(w),
        f"order_quote_matched_volume_share_{w}": ratio_of(k("v"), k("all")),
    }


def order_quote_position(order, market, spine):
    """20 columns: orders relative to the quote just before them, in the last 15 and 60 seconds."""
    s = _position_sums(_order_positions(order, market), (15, 60, 45))
    cols = _position_columns(15) | _position_columns(60)
    old = _position_columns(45)
    for kind in ("new", "cancel"):
        n = f"order_near_{kind}_pressure"
        cols[f"order_near_{kind}_accel_15_vs_15_60"] = cols[f"{n}_15"] - old[f"{n}_45"]
    return on_spine(spine, derive(s, cols))


def order_quote_early(order, market, spine):
    """9 columns: the same for orders 15 to 60 seconds before the end."""
    old = (seconds() > 15) & (seconds() <= 60)
    s = _position_sums(_order_positions(order.filter(old), market), (45,))
    return on_spine(spine, derive(s, _position_columns(45)))


# ordered trades ----------------------------------------------------------------------------------

GAP_EDGES = (20.0, 40.0)


def trade_microstructure(transaction, spine):
    """18 columns: counts, gaps, price impact, size distribution, late share of the trades."""
    rows = trade_line(transaction, "t", "p", "v", "sv").previous(["t", "p"]).rows
    has = c("prev_t").isNotNull()
    gap = F.when(has, at_least(c("prev_t") - c("t"), 0))
    dp = F.coalesce(c("p") - c("prev_p"), F.lit(0.0))
    v, root = c("v"), F.sqrt(c("v"))
    b = bucket(c("t"), GAP_EDGES)
    aggs = {f"n{i}": count_if(b == i) for i in range(3)} | {
        "n": F.count(F.lit(1)), "g": sum0(gap), "g2": sum0(gap * gap), "gn": F.count(gap), "gmax": F.max(gap),
        "k_num": F.sum(dp * c("sv")), "k_den": F.sum(c("sv") * c("sv")), "i_num": F.sum(F.abs(dp) * root),
        "i_den": F.sum(root), "moves": count_if(has & (dp != 0)), "v1": F.sum(v), "v2": F.sum(v * v),
        "v3": F.sum(v * v * v), "vmax": F.max(v), "n10": count_if(c("t") < 10), "v10": sum_if(c("t") < 10, v),
        "pv": F.sum(c("p") * v),
    }
    t = on_spine(spine, summarise(rows, aggs), fill=0.0)
    gn, n = at_least(c("gn"), 1), at_least(c("n"), 1)
    gm = c("g") / gn
    gs = F.sqrt(at_least(c("g2") / gn - gm * gm, 0))
    m = c("v1") / n
    sd = F.sqrt(at_least(c("v2") / n - m * m, 0))
    skew = F.when(sd > 0, (c("v3") / n - 3 * m * sd * sd - m * m * m) / at_least(sd * sd * sd, 1e-12)).otherwise(0.0)
    out = {f"x25_trades_b{i}": c(f"n{i}") for i in range(3)}
    return derive(
        t,
        out
        | {
            "x25_gap_mean": gm,
            "x25_gap_sd": gs,
            "x25_gap_cv": gs / at_least(gm, 1e-9),
            "x25_gap_max_log": F.log1p(c("gmax")),
            "x25_kyle": c("k_num") / at_least(c("k_den"), 1e-12),
            "x25_impact": c("i_num") / at_least(c("i_den"), 1e-9),
            "x25_move_share": c("moves") / n,
            "x25_size_mean": m,
            "x25_size_sd": sd,
            "x25_size_skew": clip(skew, -10, 10),
            "x25_max_share": c("vmax") / at_least(c("v1"), 1e-9),
            "x25_last10_share": c("n10") / n,
            "x25_last10_volume": c("v10") / at_least(c("v1"), 1e-9),
            "x25_vwap_dev": c("pv") / at_least(c("v1"), 1e-9) - 1.0,
        },
    )


def vpin_clock(transaction, spine, clocks=(10, 20)):
    """Mean absolute signed volume per volume-clock bucket, for each number of buckets."""
    line = trade_line(transaction, "v", "sv")
    line = line.running_sum({"cum": c("v")}, inclusive=False).key_total("tot", c("v"))
    tables = []
    for k in clocks:
        size = at_least(c("tot") / float(k), 1e-9)
        b = F.least(F.floor((c("cum") + c("v") / 2.0) / size), F.lit(k))
        per = line.rows.groupBy(KEY, b.alias("b")).agg(F.sum("sv").alias("net"), F.max(size).alias("size"))
        net = sum_if(c("b") < k, F.abs(c("net"))) / float(k)
        tables.append(summarise(per, {f"x26_vpin_{k}": net / F.max("size")}))
    return on_spine(spine, *tables, fill=0.0)


def cvd_path(transaction, spine):
    """2 columns: range of the running signed volume and its fall from the high, per volume."""
    line = trade_line(transaction, "v", "sv").running_sum({"cvd": c("sv")})
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(line.order)])
    s = summarise(
        line.rows,
        {"v": F.sum("v"), "hi": F.max("cvd"), "lo": F.min("cvd"), "end": F.max_by("cvd", rank)},
    )
    hi, lo = at_least(c("hi"), 0), F.least(c("lo"), F.lit(0.0))
    return on_spine(
        spine,
        derive(
            s,
            {
                "cvd_range_norm_60": (hi - lo) / (c("v") + 1.0),
                "cvd_pullback_from_high_60": (hi - c("end")) / (c("v") + 1.0),
            },
        ),
        fill=0.0,
    )


def large_trades(transaction, spine, fit_ids, q=0.9):
    """4 columns of trades above a size threshold fitted on some samples and then frozen."""
    fit = transaction.join(fit_ids, KEY, "left_semi")
    threshold = exact_quantiles(fit, X.volume, {"threshold": q}, interpolation="nearest")
    rows = transaction.crossJoin(F.broadcast(threshold))  # one row
    big, v = X.volume > c("threshold"), X.volume
    s = summarise(
        rows,
        {
            "bn": count_if(big & X.is_buy), "sn": count_if(big & X.is_sell), "bv": sum_if(big & X.is_buy, v),
            "sv": sum_if(big & X.is_sell, v), "n": F.count(F.lit(1)), "v": F.sum(v),
        },
    )
    n, v = c("bn") + c("sn"), c("bv") + c("sv")
    return derive(
        on_spine(spine, s, fill=0.0),
        {
            "large_trade_count_imbalance_q90": ratio(c("bn") - c("sn"), n),
            "large_trade_volume_imbalance_q90": ratio(c("bv") - c("sv"), v),
            "large_trade_count_share_q90": ratio(n, c("n")),
            "large_trade_volume_share_q90": ratio(v, c("v")),
        },
    )


def event_gaps(events, spine, prefix):
    """4 columns: mean, deviation, maximum and non-zero share of gaps between events."""
    rows = Timeline.of(events).select(SEQ, TIME, seconds().alias("t")).previous(["t"]).rows
    gap = F.abs(c("t") - c("prev_t"))
    s = summarise(
        rows,
        {
            f"{prefix}_event_gap_mean": F.avg(gap),
            f"{prefix}_event_gap_std": F.stddev_samp(gap),
            f"{prefix}_event_gap_max": F.max(gap),
            f"{prefix}_event_nonzero_gap_share": F.avg((gap > 0).cast("double")),
        },
    )
    return on_spine(spine, s)


def second_activity(transaction, spine):
    """4 columns: share of active seconds in 60/30/10, longest inactive run of the 61 seconds."""
    active = transaction.select(KEY, F.bround(seconds(), 0).cast("int").alias("s")).distinct()
    w = Window.partitionBy(KEY).orderBy("s")  # at most 61 rows per sample
    gaps = active.withColumn("gap", c("s") - F.lag("s").over(w) - 1)
    s = summarise(
        gaps,
        {
            "n60": F.count(F.lit(1)), "n30": count_if(c("s") <= 30), "n10": count_if(c("s") <= 10),
            "run": F.greatest(F.max("gap"), F.min("s"), 60 - F.max("s")),
        },
    )
    zero = lambda n, d: F.coalesce(c(n), F.lit(0)) / float(d)
    return derive(
        on_spine(spine, s),
        {
            "trade_active_second_ratio_60": zero("n60", 61),
            "trade_active_second_ratio_30": zero("n30", 31),
            "trade_active_second_ratio_10": zero("n10", 11),
            "trade_max_inactive_run_ratio_60": F.coalesce(c("run") / 61.0, F.lit(1.0)),
        },
    )


# persistence -------------------------------------------------------------------------------------

BINS = 30  # two-second bins of the last minute


def trade_runs(transaction):
    """Lengths and volumes of runs of equal trade side, one row per run."""
    line = trade_line(transaction, "g", "v", "sv").runs(c("g"))
    return summarise(
        line.rows,
        {"g": F.first("g"), "len": F.count(F.lit(1)).cast("double"), "vol": F.abs(F.sum("sv")), "v": F.sum("v")},
        (KEY, "run"),
    )


def cancel_waves(order, within=1.0):
    """Share of cancels that follow a cancel of the same side within `within` seconds."""
    line = Timeline.of(order).select(SEQ, TIME, seconds().alias("t"), "side", "order_action")
    rows = line.previous(["t", "side", "order_action"]).rows
    cancel = c("order_action") == 1
    wave = cancel & (c("prev_order_action") == 1) & (c("side") == c("prev_side")) & (F.abs(c("t") - c("prev_t")) <= within)
    sides = {"bid": c("side") == 0, "ask": c("side") != 0}
    return summarise(
        rows,
        {f"wave_{n}": count_if(wave & s) for n, s in sides.items()}
        | {f"can_{n}": count_if(cancel & s) for n, s in sides.items()},
    )


def _corr(x, y):
    n = F.count(x)
    den = n * F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(den > EPS, n * F.covar_pop(x, y) / den).otherwise(0.0)


def flow_persistence(market, transaction, order, spine):
    """10 columns: trade runs, cancel waves, replenishment and the response of mid to flow."""
    b = X.time_bin(seconds(), 2.0, BINS).alias("bin")
    v = X.volume
    flow = transaction.groupBy(KEY, b).agg(F.sum(X.signed_volume).alias("sv"))
    orders = order.groupBy(KEY, b).agg(
        sum_if(X.is_cancel & X.is_buy, v).alias("cb"), sum_if(X.is_cancel & ~X.is_buy, v).alias("ca"),
        sum_if(X.is_new & X.is_buy, v).alias("nb"), sum_if(X.is_new & ~X.is_buy, v).alias("na"),
    )
    book = market.filter((seconds() < 60) & X.has_quote).groupBy(KEY, b).agg(
        F.log(at_least(F.avg(X.mid), EPS)).alias("lm"), F.avg(X.imbalance(X.bidv1, X.askv1)).alias("qi")
    )
    g = densify(spine, BINS, flow, orders, book).na.fill(0.0, ["sv", "cb", "ca", "nb", "na", "qi"])
    w = Window.partitionBy(KEY).orderBy("bin")  # BINS rows per sample
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    g = g.withColumn("lm", F.coalesce(F.last("lm", True).over(w), F.first("lm", True).over(rest), F.lit(0.0)))
    g = g.withColumns(
        {"next_nb": F.lead("nb").over(w), "next_na": F.lead("na").over(w),
         "ret": F.lead("lm", 2).over(w) - F.lead("lm", 1).over(w)}
    )
    used = lambda x: F.when(c("ret").isNotNull(), x)
    bins = summarise(
        g,
        {
            "rep_b": sum_if(c("cb") > 0, c("next_nb")), "rep_a": sum_if(c("ca") > 0, c("next_na")),
            "c_b": F.sum("cb"), "c_a": F.sum("ca"), "flow": _corr(used(c("sv")), c("ret")),
            "qi": _corr(used(c("qi")), c("ret")),
        },
    )
    longest = lambda cond: F.coalesce(F.max(F.when(cond, c("len"))), F.lit(0.0))
    runs = summarise(
        trade_runs(transaction),
        {
            "len_max": F.max("len"), "n_runs": F.count(F.lit(1)), "n": F.sum("len"), "vol_max": F.max("vol"),
            "v": F.sum("v"), "buy": longest(c("g") > 0), "sell": longest(c("g") < 0),
        },
    )
    t = on_spine(spine, runs, cancel_waves(order), bins, fill=0.0)
    return derive(
        t,
        {
            "x32p_run_len_max": clip(F.log1p(c("len_max")), 0, 20),
            "x32p_run_len_mean": clip(c("n") / at_least(c("n_runs"), 1), 0, 1e3),
            "x32p_run_vol_max_share": clip(c("vol_max") / at_least(c("v"), 1), 0, 1),
            "x32p_run_imb": (c("buy") - c("sell")) / at_least(c("buy") + c("sell"), 1),
            "x32p_cancel_wave_bid": c("wave_bid") / at_least(c("can_bid"), 1),
            "x32p_cancel_wave_ask": c("wave_ask") / at_least(c("can_ask"), 1),
            "x32p_replenish_bid": clip(c("rep_b") / at_least(c("c_b"), 1), 0, 1e3),
            "x32p_replenish_ask": clip(c("rep_a") / at_least(c("c_a"), 1), 0, 1e3),
            "x32p_flow_resp": clip(c("flow"), -1, 1),
            "x32p_qi_resp": clip(c("qi"), -1, 1),
        },
    )


def event_cross(market, transaction, spine):
    """5 columns: aggressive volume against visible depth, and trade against book imbalance."""
    flow = trade_flow(transaction, spine)
    depth = market_tables(market).select(KEY, "last60_ask_volume_1_mean", "last60_bid_volume_1_mean")
    book = book_signals(market, spine).select(KEY, "book_imbalance_1_60_mean_robust")
    total = F.expm1(c("log1p_total_trade_volume_60"))
    imb, book_imb = c("trade_volume_imbalance_60"), c("book_imbalance_1_60_mean_robust")
    buy = X.safe_log_ratio(total * (1 + imb) / 2, c("last60_ask_volume_1_mean"))
    sell = X.safe_log_ratio(total * (1 - imb) / 2, c("last60_bid_volume_1_mean"))
    return derive(
        on_spine(flow, depth, book),
        {
            "aggressive_buy_to_ask_depth_log1p": buy,
            "aggressive_sell_to_bid_depth_log1p": sell,
            "aggressive_depth_pressure_difference": buy - sell,
            "trade_minus_book_imbalance_60": imb - book_imb,
            "trade_times_book_imbalance_60": imb * book_imb,
        },
    )
