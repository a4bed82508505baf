"""Quote families that need chronological order: OFI, returns, hold times, shocks.

`quote_line` gives each quote the columns of its predecessor in the sample. Everything after it is
aggregation, so a family costs one exchange on (sample, slice) and a small one on the sample.
The whole window of a sample is used; its rows are not limited in number.
"""


from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.lazy import Columns
from ..functions.expr import EPS, at_least, bucket, clip, null_if_nan, seconds
from ..functions.stats import count_if, sum0, sum_if
from ..schema import KEY, SEQ, TIME
from .assemble import derive, on_spine, summarise
from .book import per_bucket, widen
from .quantile import quantiles_of
from .timeline import Timeline

c = F.col

# Short names of quote columns as doubles.
QUOTE = {
    "t": seconds, "a1": lambda: X.ask1, "b1": lambda: X.bid1, "av1": lambda: X.askv1, "bv1": lambda: X.bidv1,
    "a2": lambda: X.ask2, "b2": lambda: X.bid2, "av2": lambda: X.askv2, "bv2": lambda: X.bidv2,
    "ap": lambda: null_if_nan(X.col("transaction_avgprice")), "tv": lambda: X.col("transaction_volume"),
    "tc": lambda: X.col("transaction_count"),
}
BOOK = ("a1", "b1", "av1", "bv1")
BOOK2 = ("a2", "b2", "av2", "bv2")
Q = Columns(
    mid=lambda: (c("a1") + c("b1")) / 2.0,
    prev_mid=lambda: (c("prev_a1") + c("prev_b1")) / 2.0,
    alive=lambda: (c("a1") > 0) & (c("b1") > 0),
    prev_alive=lambda: (c("prev_a1") > 0) & (c("prev_b1") > 0),
    tight=lambda: _tight(c("a1"), c("b1")),
    prev_tight=lambda: _tight(c("prev_a1"), c("prev_b1")),
    tight_return=lambda: F.when(Q.tight & Q.prev_tight, F.log(Q.mid) - F.log(Q.prev_mid)),
    later=lambda: F.struct((-c("t")).alias("t"), c(SEQ)),
)


def quotes(market):
    line = Timeline.of(market)
    return line.select(SEQ, TIME, *[v().alias(k) for k, v in QUOTE.items()])


def quote_line(market, names=BOOK + BOOK2):
    """Timeline of quotes with `prev_<name>` of the preceding quote."""
    return quotes(market).previous(list(names))


def ofi(level, masked=True):
    """Order-flow imbalance of one level against the previous quote.

    Null where it is undefined: no predecessor or, if masked, an empty level on either side.
    """
    a, b, av, bv = (c(f"{n}{level}") for n in ("a", "b", "av", "bv"))
    pa, pb, pav, pbv = (c(f"prev_{n}{level}") for n in ("a", "b", "av", "bv"))
    bid = F.when(b > pb, bv).when(b < pb, -pbv).otherwise(bv - pbv)
    ask = F.when(a < pa, av).when(a > pa, -pav).otherwise(av - pav)
    valid = (a > 0) & (b > 0) & (pa > 0) & (pb > 0) if masked else pa.isNotNull()
    return F.when(valid, bid - ask)


def _tight(a, b):
    m = (a + b) / 2.0
    return (m >= 0.1) & (a >= b) & ((a - b) / m <= 0.1)


def depth_ofi(level):
    """OFI per unit of total depth over both quotes; null unless both quotes are sound."""
    a, b, av, bv = (c(f"{n}{level}") for n in ("a", "b", "av", "bv"))
    pa, pb, pav, pbv = (c(f"prev_{n}{level}") for n in ("a", "b", "av", "bv"))
    zero = F.lit(0.0)
    bid = F.when(b >= pb, bv).otherwise(zero) - F.when(b <= pb, pbv).otherwise(zero)
    ask = F.when(a <= pa, av).otherwise(zero) - F.when(a >= pa, pav).otherwise(zero)
    valid = _tight(a, b) & _tight(pa, pb) & (bv > 0) & (pbv > 0) & (av > 0) & (pav > 0)
    return F.when(valid, (bid - ask) / (bv + pbv + av + pav))


def log_return():
    """Log change of mid between consecutive two-sided quotes, else null."""
    return F.when(Q.alive & Q.prev_alive, F.log(Q.mid / Q.prev_mid))


def simple_ofi(market, transaction, spine):
    """4 columns: OFI of both levels, late first-level OFI, price impact of signed volume."""
    e1, e2 = ofi(1, masked=False), ofi(2, masked=False)
    q = summarise(
        quote_line(market).rows,
        {"ofi1": F.sum(e1), "ofi2": F.sum(e2), "ofi1_late": sum_if(c("t") <= 120, e1)},
    )
    trades = Timeline.of(transaction).select(
        SEQ, TIME, X.price.alias("p"), X.signed_volume.alias("sv")
    )
    pairs = trades.previous(["p"]).rows.filter(c("prev_p").isNotNull())
    dp = c("p") - c("prev_p")
    impact = F.covar_pop(dp, c("sv")) / at_least(F.var_pop(c("sv")), 1e-12)
    return on_spine(spine, q, summarise(pairs, {"kyle_lambda": impact}), fill=0.0)


DRIFT_EDGES = (60.0, 300.0)
MOVES = ("spread_sd", "imb_sd", "micro_abs", "ask_slope", "dmid_abs", "dmid_sign")


def _quote_moves(market, masked):
    line = quote_line(market, ("a1", "b1"))
    if masked:
        line = line.last_known("last_mid", F.when(Q.alive, Q.mid))
        keep = lambda x: F.when(Q.alive, x)
        move = F.log(at_least(Q.mid, 1e-9) / c("last_mid"))
    else:
        keep = lambda x: x
        move = F.log(at_least(Q.mid, 1e-9) / at_least(Q.prev_mid, EPS))
    m = at_least(Q.mid, 1e-9)
    spread = keep((c("a1") - c("b1")) / m)
    imb = keep(X.imbalance(c("bv1"), c("av1"), 1e-9))
    micro = (c("a1") * c("bv1") + c("b1") * c("av1")) / at_least(c("av1") + c("bv1"), 1e-9) / m - 1
    slope = (c("a2") - c("a1")) / m
    if masked:
        slope = F.when(c("a2") > 0, slope).otherwise(0.0)
    n = at_least(F.count(keep(F.lit(1))), 1)
    aggs = {
        "sp": F.avg(spread), "sp2": F.avg(spread * spread), "im": F.avg(imb), "im2": F.avg(imb * imb),
        "micro_abs": F.avg(keep(F.abs(micro))), "ask_slope": F.avg(keep(slope)),
        "dmid_abs": F.sum(keep(F.abs(move))) / n, "dmid_sign": F.sum(keep(F.signum(move))) / n,
        "void_ask": F.avg((c("a1") == 0).cast("double")), "void_bid": F.avg((c("b1") == 0).cast("double")),
    }
    sd = lambda m1, m2: F.sqrt(at_least(m2 - m1 * m1, 0))
    values = {"spread_sd": sd(c("sp"), c("sp2")), "imb_sd": sd(c("im"), c("im2")), "spread": c("sp"), "imb": c("im")}
    values |= {k: c(k) for k in ("micro_abs", "ask_slope", "dmid_abs", "dmid_sign", "void_ask", "void_bid")}
    t = per_bucket(line.rows, bucket(c("t"), DRIFT_EDGES), aggs, values)
    return widen(t, range(3), lambda i, v: f"x24_{v}_b{i}")


def dispersion_drift(market, transaction, order, spine, masked=False):
    """Dispersion of spread, imbalance, moves and trade size in three buckets, with drifts.

    41 columns; masked ignores rows with an empty first level and adds 8 empty-level columns.
    """
    lv, v = F.log1p(X.volume), X.volume
    tv = at_least(c("v"), 1e-9)
    trades = per_bucket(
        transaction,
        bucket(seconds(), DRIFT_EDGES),
        {
            "n": F.count(F.lit(1)), "v": F.sum(v), "l": F.avg(lv), "l2": F.avg(lv * lv),
            "sv": F.sum(X.signed_volume), "sv2": F.sum(X.signed_volume * v),
        },
        {
            "logvol": c("l"), "logvol_sd": F.sqrt(at_least(c("l2") - c("l") * c("l"), 0)),
            "signed_share": c("sv") / tv, "signed_sq_share": c("sv2") / at_least(c("v") * c("v"), 1e-9),
            "trades": c("n"),
        },
    )
    trades = widen(trades, range(3), lambda i, v: f"x24_{v}_b{i}")
    orders = summarise(
        order,
        {
            "nb": sum_if(X.is_new & X.is_buy, v), "ns": sum_if(X.is_new & ~X.is_buy, v),
            "cb": sum_if(~X.is_new & X.is_buy, v), "cs": sum_if(~X.is_new & ~X.is_buy, v),
            "n_orders": F.count(F.lit(1)),
        },
    )
    t = on_spine(spine, _quote_moves(market, masked), trades, orders, fill=0.0)
    names = MOVES + ("logvol", "logvol_sd", "signed_share", "signed_sq_share", "trades")
    at = lambda n, i: c(f"x24_{n}_b{i}")
    out = {f"x24_{n}_b{i}": at(n, i) for n in names for i in range(3)}
    new, can = c("nb") + c("ns"), c("cb") + c("cs")
    out |= {
        "x24_trade_accel": F.log1p(at("trades", 0)) - F.log1p(at("trades", 2)),
        "x24_imb_drift": at("imb", 0) - at("imb", 2),
        "x24_spread_drift": at("spread", 0) - at("spread", 2),
        "x24_flow_drift": at("signed_share", 0) - at("signed_share", 2),
        "x24_cancel_new": can / at_least(new, 1e-9),
        "x24_new_imb": (c("nb") - c("ns")) / at_least(new, 1e-9),
        "x24_cancel_imb": (c("cb") - c("cs")) / at_least(can, 1e-9),
        "x24_orders_log": F.log1p(at_least(c("n_orders"), 1)),
    }
    if masked:
        out |= {f"x24_{n}_b{i}": at(n, i) for n in ("void_ask", "void_bid") for i in range(3)}
        out["x24_void_drift"] = at("void_ask", 0) - at("void_ask", 2)
        out["x24_void_asymmetry"] = at("void_ask", 0) - at("void_bid", 0)
    return derive(t, out)


def liquidity_impact(market, spine):
    """12 columns: OFI by horizon, Roll spread, Amihud illiquidity, microprice deviation."""
    line = quote_line(market).last_known("last_mid", F.when(Q.alive, Q.mid))
    dm = F.when(Q.alive & (c("last_mid") > 0), F.log(Q.mid / c("last_mid"))).otherwise(0.0)
    line = line.with_columns({"e": ofi(1), "e2": ofi(2), "dm": dm}).previous(["dm"])
    micro = (c("a1") * c("bv1") + c("b1") * c("av1")) / at_least(c("av1") + c("bv1"), 1e-9) / at_least(Q.mid, 1e-9) - 1
    e, t = c("e"), c("t")
    has = c("prev_a1").isNotNull()
    last_micro = F.min_by(micro, F.when(Q.alive & (t <= 1.0), F.struct(t, F.lit(0).alias("z"))))
    s = summarise(
        line.rows,
        {
            "e_n": F.count(e), "e_all": F.sum(e), "e_sq": F.sum(e * e), "e_sign": F.sum(F.signum(e)),
            "e_300": sum_if(t < 300, e), "e_60": sum_if(t < 60, e), "e_early": sum_if(t >= 300, e),
            "e2_all": F.sum(c("e2")), "d_n": count_if(has & Q.alive), "d": F.sum(c("dm")),
            "dd": F.sum(c("dm") * c("prev_dm")), "am": F.sum(F.abs(c("dm")) / at_least(c("tv"), 1)),
            "mic": last_micro, "mic2": F.sum(F.when(Q.alive, micro * micro)), "mic_n": count_if(Q.alive),
        },
    )
    n, dn = at_least(c("e_n"), 1), at_least(c("d_n"), 1)
    m = c("e_all") / n
    return derive(
        on_spine(spine, s, fill=0.0),
        {
            "x26_ofi_mean": m,
            "x26_ofi_300": c("e_300") / n,
            "x26_ofi_60": c("e_60") / n,
            "x26_ofi_early": c("e_early") / n,
            "x26_ofi_accel": (c("e_early") - c("e_300")) / n,
            "x26_ofi_sd": F.sqrt(at_least(c("e_sq") / n - m * m, 0)),
            "x26_ofi2_mean": c("e2_all") / n,
            "x26_ofi_sign": c("e_sign") / n,
            "x26_roll": 2 * F.sqrt(at_least(-(c("dd") / dn - (c("d") / dn) * (c("d") / dn)), 0)),
            "x26_amihud": c("am") / dn,
            "x26_micro_last": c("mic"),
            "x26_micro_rms": F.sqrt(c("mic2") / at_least(c("mic_n"), 1)),
        },
    )


SUB = 6  # ten-second parts of the last minute


def _sub(t, parts):
    return F.least(F.floor(t / 10.0), F.lit(parts - 1)).cast("int")


def volatility_sums(market):
    """Quote aggregates of the volatility family, one row per sample, built per 10-second part.

    The last-minute buckets [0,10), [10,30), [30,60) are unions of whole parts.
    """
    rows = quote_line(market).rows
    q1 = F.when(Q.alive, X.imbalance(c("bv1"), c("av1")))
    q2 = X.imbalance(c("bv2"), c("av2"))
    micro = (c("a1") * c("bv1") + c("b1") * c("av1")) / at_least(c("av1") + c("bv1"), EPS)
    keep = lambda x: F.when(Q.alive, x)
    w = 1.0 / (c("t") + 1.0)
    r = log_return()
    spread = keep(c("a1") - c("b1"))
    per = summarise(
        rows.withColumn("_b", _sub(c("t"), 60)),
        {
            "e1": sum0(ofi(1)), "e2": sum0(ofi(2)), "rr": sum0(r * r), "rr_dn": sum_if(r < 0, r * r),
            "rr_up": sum_if(r > 0, r * r), "n": count_if(Q.alive), "q1": sum0(q1), "q1s": sum0(q1 * q1),
            "q2": sum0(keep(q2)), "mic": sum0(keep(micro)), "mid": sum0(keep(Q.mid)),
            "md": sum0(keep((micro - Q.mid) / at_least(Q.mid, EPS))), "sp": sum0(spread), "sp2": sum0(spread * spread),
            "q1w": sum0(q1 * w), "q2w": sum0(q2 * w), "w": sum0(w), "e1w": sum0(ofi(1) * w), "e2w": sum0(ofi(2) * w),
            "hi": F.max(keep(Q.mid)), "lo": F.min(keep(Q.mid)), "rows": F.count(F.lit(1)).cast("double"),
            "bv1": sum0(c("bv1")), "av1": sum0(c("av1")), "bv2": sum0(c("bv2")), "av2": sum0(c("av2")),
            "tv": sum0(c("tv")), "tc": sum0(c("tc")), "pv": sum0(c("ap") * c("tv")), "mv": sum0(keep(Q.mid * c("tv"))),
        },
        (KEY, "_b"),
    )
    sub = c("_b")
    last = sub < SUB
    inside = (sub == 0, (sub > 0) & (sub < 3), (sub >= 3) & (sub < SUB))
    range_var = F.when(c("hi") > c("lo"), F.pow(F.log(c("hi") / c("lo")), 2) / (4 * F.log(F.lit(2.0))))
    aggs = {f"{k}_all": F.sum(k) for k in ("bv1", "av1", "bv2", "av2", "rows", "tv", "tc", "pv", "mv", "rr")}
    for k in ("rr_dn", "rr_up", "q1w", "q2w", "w", "e1w", "e2w"):
        aggs[f"{k}_60"] = sum_if(last, c(k))
    aggs |= {"rr_60": sum_if(last, c("rr")), "pk_60": sum_if(last, range_var)}
    for i, cond in enumerate(inside):
        for k in ("e1", "e2", "n", "q1", "q1s", "q2", "mic", "mid", "md", "sp", "sp2", "bv1", "av1", "bv2", "av2"):
            aggs[f"{k}_b{i}"] = sum_if(cond, c(k))
    for j in range(SUB):
        for k in ("e1", "e2", "rr"):
            aggs[f"{k}_s{j}"] = sum_if(sub == j, c(k))
    return summarise(per, aggs)


def trade_sign_sums(transaction):
    """Sign autocorrelation sums at lags 1-3 and signed volume, per sample."""
    line = Timeline.of(transaction).select(SEQ, TIME, X.side_sign.alias("g"), X.signed_volume.alias("sv"), X.volume.alias("v"), seconds().alias("t"))
    rows = line.lags("g", 3).rows
    aggs = {"sv": F.sum("sv"), "v": F.sum("v"), "sv10": sum_if(c("t") < 10, c("sv")), "v10": sum_if(c("t") < 10, c("v"))}
    for k in (1, 2, 3):
        aggs |= {f"ac{k}": sum0(c("g") * c(f"g_lag{k}")), f"ac{k}_n": F.count(f"g_lag{k}")}
    return summarise(rows, aggs)


def volatility_flow(market, transaction, order, spine):
    """36 columns: OFI by bucket, realised volatility, trade sign memory, order rates, book drift."""
    bid, new = X.is_buy, X.is_new
    orders = summarise(
        order,
        {
            "add": count_if(new), "can": count_if(~new), "add_b": count_if(new & bid),
            "can_b": count_if(~new & bid), "add_a": count_if(new & ~bid), "can_a": count_if(~new & ~bid),
        },
    )
    t = on_spine(spine, volatility_sums(market), trade_sign_sums(transaction), orders, fill=0.0)
    depth = (c("bv1_all") + c("av1_all")) / at_least(c("rows_all"), 1) + 1.0
    n = [at_least(c(f"n_b{i}"), 1) for i in range(3)]
    b = lambda k: [c(f"{k}_b{i}") / n[i] for i in range(3)]
    q1, q2, mic, md, m, sp = b("q1"), b("q2"), b("mic"), b("md"), b("mid"), b("sp")
    seen = X.total([(c(f"n_b{i}") > 0).cast("double") for i in range(3)])
    ref = at_least(F.when(seen > 0, X.total(m) / seen).otherwise(1.0), EPS)
    big = lambda x: clip(x, -1e4, 1e4)
    out = {f"x30_ofi{k}_b{i}": big(c(f"e{k}_b{i}") / depth) for i in range(3) for k in (1, 2)}
    out |= {f"x30_ofi{k}_all": big(X.total([c(f"e{k}_b{i}") for i in range(3)]) / depth) for k in (1, 2)}
    q1_var = X.mean_of([c(f"q1s_b{i}") / n[i] - q1[i] * q1[i] for i in range(3)])
    floor = 0.01 * c("rr_60") + EPS
    share = lambda a, v: a / at_least(v, EPS)
    out |= {
        "x30_rv_60": F.sqrt(c("rr_60")),
        "x30_rv_600": F.sqrt(c("rr_all")),
        "x30_semi_ratio": clip((c("rr_dn_60") + floor) / (c("rr_up_60") + floor), 0, 100),
        "x30_parkinson": F.sqrt(c("pk_60")),
        "x30_vol_of_vol": X.pop_std_of([F.sqrt(c(f"rr_s{j}")) for j in range(SUB)]),
        "x30_signvol_60": share(c("sv"), c("v")),
        "x30_flow_shift": share(c("sv10"), c("v10")) - share(c("sv"), c("v")),
        "x30_ord_add_rate": c("add") / 60.0,
        "x30_ord_cancel_ratio": c("can") / at_least(c("add"), 1),
        "x30_ord_net_bid": c("add_b") - c("can_b"),
        "x30_ord_net_ask": c("add_a") - c("can_a"),
        "x30_qi1_drift": q1[0] - q1[2],
        "x30_qi1_vol": F.sqrt(at_least(q1_var, 0)),
        "x30_qi2_drift": q2[0] - q2[2],
        "x30_qi1_tw": c("q1w_60") / at_least(c("w_60"), EPS),
        "x30_micro_slope": clip((mic[0] - mic[2]) / ref, -10, 10),
        "x30_mid_slope": clip((m[0] - m[2]) / ref, -10, 10),
        "x30_micro_mid_dev": X.mean_of(md),
        "x30_spread_rms": F.sqrt(X.mean_of(b("sp2"))) / ref,
        "x30_spread_drift": (sp[0] - sp[2]) / ref,
        "x30_vwap_dev_600": clip((share(c("pv_all"), c("tv_all")) - share(c("mv_all"), c("tv_all"))) / ref, -10, 10),
        "x30_tvol_600_log": F.log1p(c("tv_all")),
        "x30_tcount_600_log": F.log1p(c("tc_all")),
    }
    for k in (1, 2, 3):
        out[f"x30_tsign_ac{k}"] = c(f"ac{k}") / at_least(c(f"ac{k}_n"), 1)
    rows = at_least(c("rows_all"), 1)
    for side, x in (("bid", "bv"), ("ask", "av")):
        out[f"x30_depth_ratio_{side}"] = (c(f"{x}2_all") / rows) / at_least(c(f"{x}1_all") / rows, EPS)
    return derive(t, out)


def trade_gap_sums(transaction):
    """Gap, price-impact and size sums over consecutive trades, per sample."""
    line = Timeline.of(transaction).select(
        SEQ, TIME, X.price.alias("p"), X.signed_volume.alias("sv"), X.volume.alias("v"), seconds().alias("t")
    )
    rows = line.previous(["t", "p"]).rows
    gap = F.abs(c("t") - c("prev_t"))
    ret = F.when((c("p") > 0) & (c("prev_p") > 0), F.log(c("p") / c("prev_p")))
    per = summarise(
        rows.withColumn("_b", _sub(c("t"), SUB)),
        {
            "k_num": sum0(ret * c("sv")), "k_den": sum_if(ret.isNotNull(), c("sv") * c("sv")),
            "g": sum0(gap), "g2": sum0(gap * gap), "g_n": F.count(gap), "tv": F.sum("v"),
            "tn": F.count(F.lit(1)), "tsv": F.sum("sv"),
        },
        (KEY, "_b"),
    )
    aggs = {k: F.sum(k) for k in ("k_num", "k_den", "g", "g2", "g_n", "tv", "tn")}
    share = F.abs(c("tsv")) / at_least(c("tv"), EPS)
    aggs |= {"vpin_sum": F.sum(share), "vpin_max": F.max(share)}
    return summarise(per, aggs)


def new_order_gaps(order):
    """Gaps between consecutive NEW orders; cancels in between are skipped."""
    new = order.filter(X.is_new)
    rows = Timeline.of(new).select(SEQ, TIME, seconds().alias("t")).previous(["t"]).rows
    gap = F.abs(c("t") - c("prev_t"))
    return summarise(rows, {"og": sum0(gap), "og2": sum0(gap * gap), "og_n": F.count(gap)})


def burst_flow(market, transaction, order, spine):
    """18 columns: OFI burstiness and acceleration, depth drift, order net volume, gaps, VPIN."""
    v, bid = X.volume, X.is_buy
    orders = summarise(
        order,
        {
            "onb": sum_if(X.is_new & bid, v), "ona": sum_if(X.is_new & ~bid, v),
            "ocb": sum_if(~X.is_new & bid, v), "oca": sum_if(~X.is_new & ~bid, v),
        },
    )
    t = on_spine(
        spine, volatility_sums(market), trade_gap_sums(transaction), orders, new_order_gaps(order), fill=0.0
    )
    depth = (c("bv1_all") + c("av1_all")) / at_least(c("rows_all"), 1) + 1.0
    subs = {k: [c(f"e{k}_s{j}") for j in range(SUB)] for k in (1, 2)}
    big = lambda x, lo=-1e4: clip(x, lo, 1e4)
    out = {}
    for k in (1, 2):
        out[f"x31_ofi{k}_vol"] = big(X.pop_std_of(subs[k]) / depth, 0)
        out[f"x31_ofi{k}_accel"] = big((X.mean_of(subs[k][:2]) - X.mean_of(subs[k][4:])) / depth)
        out[f"x31_ofi{k}_tw"] = big(c(f"e{k}w_60") / depth)
    bids, asks = c("bv1_all") + c("bv2_all"), c("av1_all") + c("av2_all")
    drift = lambda x: clip(
        c(f"{x}2_b0") / at_least(c(f"{x}1_b0"), EPS) - c(f"{x}2_b2") / at_least(c(f"{x}1_b2"), EPS), -1e3, 1e3
    )
    gap_stats = lambda s, s2, n: (s / at_least(n, 1), s2 / at_least(n, 1))
    og, og2 = gap_stats(c("og"), c("og2"), c("og_n"))
    tg, tg2 = gap_stats(c("g"), c("g2"), c("g_n"))
    cv = lambda m, m2: clip(F.sqrt(at_least(m2 - m * m, 0)) / at_least(m, EPS), 0, 1e3)
    traded = at_least(c("tv"), 1)
    out |= {
        "x31_qi2_tw": c("q2w_60") / at_least(c("w_60"), EPS),
        "x31_book_imb12": clip((bids - asks) / at_least(bids + asks, EPS), -1, 1),
        "x31_dratio_bid_drift": drift("bv"),
        "x31_dratio_ask_drift": drift("av"),
        "x31_ord_vnet_new": big((c("onb") - c("ona")) / traded),
        "x31_ord_vnet_can": big((c("ocb") - c("oca")) / traded),
        "x31_ord_gap_mean": clip(og, 0, 60),
        "x31_ord_gap_cv": cv(og, og2),
        "x31_tx_gap_cv": cv(tg, tg2),
        "x31_kyle_lambda": clip(c("k_num") / at_least(c("k_den"), EPS) * c("tv") / at_least(c("tn"), 1), -10, 10),
        "x31_vpin_mean": c("vpin_sum") / float(SUB),
        "x31_vpin_max": c("vpin_max"),
    }
    return derive(t, out)


def context(market, spine):
    """12 columns: the older part of the window (60-600 s) and the drift into the last minute."""
    rows = quote_line(market).rows
    t = c("t")
    ctx, rec = (t >= 60) & Q.alive, (t < 60) & Q.alive
    q1, q2 = X.imbalance(c("bv1"), c("av1")), X.imbalance(c("bv2"), c("av2"))
    d1, d2 = c("bv1") + c("av1"), c("bv2") + c("av2")
    when = F.struct((-t).alias("t"), c(SEQ))
    s = summarise(
        rows,
        {
            "n_c": count_if(ctx), "n_r": count_if(rec), "q1_c": sum_if(ctx, q1), "q2_c": sum_if(ctx, q2),
            "q1_r": sum_if(rec, q1), "pos": count_if(ctx & (q1 > 0)), "neg": count_if(ctx & (q1 < 0)),
            "d1_c": sum_if(ctx, d1), "d2_c": sum_if(ctx, d2), "d1_r": sum_if(rec, d1),
            "sp_c": sum_if(ctx, (c("a1") - c("b1")) / at_least(Q.mid, EPS)),
            "e1_c": sum_if(t >= 60, ofi(1)), "e2_c": sum_if(t >= 60, ofi(2)), "e1_r": sum_if(t < 60, ofi(1)),
            "m_first": F.min_by(Q.mid, F.when(Q.alive, when)), "m_60": F.max_by(Q.mid, F.when(ctx, when)),
        },
    )
    t = on_spine(spine, s, fill=0.0)
    nc, nr = at_least(c("n_c"), 1), at_least(c("n_r"), 1)
    depth = c("d1_c") / nc + 1.0
    log_depth = lambda k, n: F.log(c(k) / n + 1.0)
    return derive(
        t,
        {
            "x32c_ofi1_nrm": clip(c("e1_c") / depth, -1e4, 1e4),
            "x32c_ofi2_nrm": clip(c("e2_c") / depth, -1e4, 1e4),
            "x32c_qi1_mean": c("q1_c") / nc,
            "x32c_qi2_mean": c("q2_c") / nc,
            "x32c_qi1_persist": F.greatest(c("pos"), c("neg")) / nc,
            "x32c_depth1_log": clip(log_depth("d1_c", nc), 0, 30),
            "x32c_depth2_log": clip(log_depth("d2_c", nc), 0, 30),
            "x32c_qi1_drift": c("q1_r") / nr - c("q1_c") / nc,
            "x32c_ofi1_shift": clip(
                c("e1_r") / at_least(c("d1_r") / nr + 1.0, EPS) / 60.0 - c("e1_c") / depth / 540.0, -1e3, 1e3
            ),
            "x32c_depth_drift": clip(log_depth("d1_r", nr) - log_depth("d1_c", nc), -10, 10),
            "x32c_spread_ctx": clip(c("sp_c") / nc, 0, 1),
            "x32c_mid_ret_ctx": clip(F.log(at_least(c("m_60"), EPS) / at_least(c("m_first"), EPS)), -1, 1),
        },
    )


# robust-quote families ---------------------------------------------------------------------------


def _mean(x, cond=None):
    return F.avg(x if cond is None else F.when(cond, x))


def _last(x):
    return F.max_by(x, F.when(x.isNotNull(), Q.later))


def _endpoint(x, cond=None):
    x = x if cond is None else F.when(cond, x)
    first, last = F.min_by(x, F.when(x.isNotNull(), Q.later)), _last(x)
    return F.when((F.count(x) >= 2) & (first > 0), (last - first) / first)


def _forward_slope(y):
    """Least-squares slope on forward-moving time over rows where y is known."""
    x = F.when(y.isNotNull(), -c("t"))
    var = F.var_pop(x)
    return F.when(var > 0, F.covar_pop(x, y) / var)


def price_paths(market, spine):
    """21 columns: mid returns, realised volatility and moments, momentum, spread, trade price."""
    rows = quote_line(market, ("a1", "b1")).rows
    t, r = c("t"), Q.tight_return
    m = F.when(Q.tight, Q.mid)
    rel = F.when(Q.tight, (c("a1") - c("b1")) / Q.mid)
    dev = F.when((c("tc") > 0) & Q.tight & (c("ap") >= 0.1), (c("ap") - Q.mid) / Q.mid)
    dev = F.when(F.abs(dev) <= 0.1, dev)
    windows = {"full": None, "180": t <= 180, "60": t <= 60, "20": t <= 20}
    aggs = {}
    for name, cond in windows.items():
        aggs[f"mid_return_{name}"] = _endpoint(m, cond)
        aggs[f"realized_volatility_{name}"] = F.sqrt(F.sum(r * r if cond is None else F.when(cond, r * r)))
    aggs |= {
        "mid_return_std_full": F.stddev_pop(r),
        "mid_return_skew_full": F.skewness(r),
        "mid_return_kurtosis_full": F.kurtosis(r),
        "mid_momentum_full": _forward_slope(F.log(m)),
        "mid_momentum_60": _forward_slope(F.when(t <= 60, F.log(m))),
        "last": _last(m),
        "mean": _mean(m),
        "mean60": _mean(m, t <= 60),
        "relative_spread_mean": _mean(rel),
        "relative_spread_std": F.stddev_pop(rel),
        "relative_spread_last": _last(rel),
        "relative_spread_60_mean": _mean(rel, t <= 60),
        "trade_price_vs_mid_mean": _mean(dev),
        "trade_price_vs_mid_last": _last(dev),
    }
    s = summarise(rows, aggs).withColumns(
        {
            "mid_last_vs_full_mean": c("last") / c("mean") - 1,
            "mid_last_vs_60_mean": c("last") / c("mean60") - 1,
        }
    )
    return on_spine(spine, s.drop("last", "mean", "mean60"))


def _sound_signals():
    """Book signals with null where the quote is not sound."""
    ok1, ok2 = (c("av1") > 0) & (c("bv1") > 0), (c("av2") > 0) & (c("bv2") > 0)
    d1, d2 = c("av1") + c("bv1"), c("av2") + c("bv2")
    micro = (c("a1") * c("bv1") + c("b1") * c("av1")) / d1
    e1, e2 = depth_ofi(1), depth_ofi(2)
    return {
        "imb1": F.when(ok1, (c("bv1") - c("av1")) / d1),
        "imb2": F.when(ok2, (c("bv2") - c("av2")) / d2),
        "imb": F.when(ok1 & ok2, (c("bv1") + c("bv2") - c("av1") - c("av2")) / (d1 + d2)),
        "micro": F.when(ok1 & Q.tight, (micro - Q.mid) / Q.mid),
        "spread": F.when(Q.tight, (c("a1") - c("b1")) / Q.mid),
        "depth": F.when(ok1 & ok2, F.log1p(d1 + d2)),
        "ofi1": e1,
        "ofi2": e2,
        "ofi12": e1 + e2,
    }


def book_signals(market, spine):
    """35 columns: imbalance, microprice, depth-normalised OFI and depth of sound quotes."""
    rows = quote_line(market).rows.withColumns(_sound_signals())
    w60, w20 = c("t") <= 60, c("t") <= 20
    between = ~w20 & w60
    s = {k: c(k) for k in ("imb1", "imb2", "imb", "micro", "depth", "ofi1", "ofi2", "ofi12")}
    out = {}
    for name, k, stats in (
        ("book_imbalance_1{}_robust", "imb1", ("mean", "std", "last", "60_mean", "20_mean")),
        ("book_imbalance_2{}_robust", "imb2", ("mean", "std", "last", "60_mean")),
        ("total_book_imbalance{}", "imb", ("mean", "last", "60_mean")),
        ("microprice_displacement{}", "micro", ("mean", "std", "last", "60_mean", "20_mean")),
        ("ofi_1{}", "ofi1", ("mean", "std", "sum", "last", "60_mean", "20_mean", "acceleration")),
        ("ofi_2{}", "ofi2", ("mean", "sum", "60_mean")),
        ("multilevel_ofi{}", "ofi12", ("mean", "sum", "60_mean", "acceleration")),
        ("log_total_depth{}", "depth", ("mean", "std", "last", "60_mean")),
    ):
        x = s[k]
        forms = {
            "mean": _mean(x), "std": F.stddev_pop(x), "sum": F.sum(x), "last": _last(x),
            "60_mean": _mean(x, w60), "20_mean": _mean(x, w20),
            "acceleration": _mean(x, w20) - _mean(x, between),
        }
        out |= {name.format("_" + k): forms[k] for k in stats}
    return on_spine(spine, summarise(rows, out))


def decayed_signals(market, spine, taus=(30, 120)):
    """21 columns: exponentially weighted means of seven book signals and their difference."""
    rows = quote_line(market).rows.withColumns(_sound_signals())
    names = {
        "book_imbalance_1": "imb1", "total_book_imbalance": "imb", "microprice_displacement": "micro",
        "relative_spread": "spread", "log_total_depth": "depth", "ofi_1": "ofi1", "multilevel_ofi": "ofi12",
    }
    aggs = {}
    for name, k in names.items():
        for tau in taus:
            w = F.exp(-at_least(c("t"), 0) / float(tau))
            aggs[f"{name}_ewm_{tau}"] = F.sum(c(k) * w) / F.sum(F.when(c(k).isNotNull(), w))
    s = summarise(rows, aggs)
    a, b = taus
    diff = {f"{n}_ewm_{a}_minus_{b}": c(f"{n}_ewm_{a}") - c(f"{n}_ewm_{b}") for n in names}
    return on_spine(spine, s.withColumns(diff))


def last_quarter_minute(market, spine):
    """8 columns over the last 15 seconds; imbalance here is (ask - bid) over (ask + bid + 1)."""
    rows = quote_line(market, BOOK).rows
    w = c("t") <= 15
    move = F.coalesce(Q.mid - Q.prev_mid, F.lit(0.0))
    flow = F.coalesce((c("av1") - c("prev_av1")) - (c("bv1") - c("prev_bv1")), F.lit(0.0))
    s = summarise(
        rows,
        {
            "m_mid_mean_15": _mean(Q.mid, w), "m_mid_std_15": F.stddev_samp(F.when(w, Q.mid)),
            "m_sp_mean_15": _mean(c("a1") - c("b1"), w),
            "m_imb_mean_15": _mean((c("av1") - c("bv1")) / (c("av1") + c("bv1") + 1.0), w),
            "m_rv_15": F.sqrt(sum_if(w, move * move)), "m_ofi_sum_15": sum_if(w, flow),
            "m_txv_sum_15": sum_if(w, c("tv")), "rv": F.sqrt(F.sum(move * move)),
        },
    )
    s = s.withColumn("x_rv_15_over_full", c("m_rv_15") / (c("rv") + 1e-8)).drop("rv")
    return on_spine(spine, s)


# hold-time families ------------------------------------------------------------------------------


def held(window):
    """Seconds for which a quote is in force inside the last `window` seconds."""
    return at_least(F.least(c("t"), F.lit(float(window))) - at_least(F.coalesce(c("next_t"), F.lit(0.0)), 0), 0)


def level_shape(market, spine, dead_zone=0.05):
    """4 columns: hold-time weighted share of near depth, level disagreement, recent change."""
    rows = quotes(market).following(["t"]).rows
    ok = X.total([(c(k) > 0).cast("int") for k in ("av1", "bv1", "av2", "bv2")]) == 4
    d1, d2 = c("av1") + c("bv1"), c("av2") + c("bv2")
    share = F.when(ok, d1 / (d1 + d2))
    i1, i2 = F.try_divide(c("bv1") - c("av1"), d1), F.try_divide(c("bv2") - c("av2"), d2)
    apart = ok & (F.abs(i1) > dead_zone) & (F.abs(i2) > dead_zone) & (i1 * i2 < 0)
    w60, w15 = F.when(ok, held(60)), F.when(ok, held(15))
    mean = lambda x, w: F.when(F.sum(w) > 0, F.sum(x * w) / F.sum(w))
    s = summarise(
        rows,
        {
            "near_depth_share_60": mean(share, w60),
            "imbalance_gap_l1_l2_60": mean(i1 - i2, w60),
            "imbalance_disagreement_ratio_60": mean(apart.cast("double"), w60),
            "near_15": mean(share, w15),
        },
    )
    change = c("near_15") - c("near_depth_share_60")
    return on_spine(spine, s.withColumn("near_depth_share_change_15_vs_60", change).drop("near_15"))


def imbalance_persistence(market, spine, dead_zone=0.05, window=60.0):
    """3 columns: signed time share, flips per second, signed length of the final run."""
    imb = (c("bv1") - c("av1")) / (c("bv1") + c("av1") + 1.0)
    state = F.when(imb > dead_zone, 1).when(imb < -dead_zone, -1).otherwise(0)
    line = quotes(market).select(SEQ, TIME, "t", state.alias("state"))
    line = line.following(["t"]).last_known("carried", F.when(c("state") != 0, c("state")))
    line = line.runs(c("state"))
    w = held(window)
    flip = (c("state") != 0) & (c("t") <= window) & (c("carried") != c("state"))
    per_run = summarise(
        line.rows,
        {
            "state": F.first("state"), "w": F.sum(w), "ws": F.sum(w * c("state")), "flips": count_if(flip),
        },
        (KEY, "run"),
    )
    s = summarise(
        per_run,
        {
            "cover": F.sum("w"), "signed": F.sum("ws"), "flips": F.sum("flips"),
            "final": F.max_by(c("ws"), c("run")),
        },
    )
    share = lambda x: F.when(c("cover") > 0, x / c("cover"))
    return on_spine(
        spine,
        derive(
            s,
            {
                "imb_signed_occupancy_60": share(c("signed")),
                "imb_flip_rate_60": share(c("flips")),
                "imb_terminal_run_signed_60": share(c("final")),
            },
        ),
    )


# liquidity shocks --------------------------------------------------------------------------------


def shock_line(market):
    """Changes of log spread, log depth and log mid between consecutive quotes, 15-60 s before
    the end, with the state two and five quotes later."""
    depth = c("av1") + c("bv1") + c("av2") + c("bv2")
    rel = (c("a1") - c("b1")) / Q.mid
    line = quotes(market).select(
        SEQ,
        TIME,
        "t",
        F.when((Q.mid > 0) & (rel > 0), F.log(at_least(rel, 1e-8))).alias("ls"),
        F.when(depth > 0, F.log1p(depth)).alias("ld"),
        F.when(Q.mid > 0, F.log(Q.mid)).alias("lm"),
    )
    line = line.position().shifted(["t", "ls", "ld", "lm"], {1: "prev_", -2: "n2_", -5: "n5_"})
    eligible = c("prev_t").isNotNull() & (c("t") >= 15) & (c("t") <= 60)
    return line.rows.withColumns(
        {
            "eligible": eligible,
            "spread": F.when(eligible, c("ls") - c("prev_ls")),
            "depth": F.when(eligible, c("prev_ld") - c("ld")),
            "price": F.when(eligible, c("lm") - c("prev_lm")),
        }
    )


def shock_thresholds(rows, fit_ids, q=0.95):
    """95 % quantiles of the three changes over the fitting samples: one row."""
    fit = rows.join(fit_ids, KEY, "left_semi")
    rising = {"thr_spread": F.when(c("spread") > 0, c("spread")), "thr_depth": F.when(c("depth") > 0, c("depth")), "thr_price": F.abs(c("price"))}
    return quantiles_of(fit, {n: (x, q) for n, x in rising.items()})


def liquidity_recovery(market, spine, fit_ids, q=0.95):
    """8 columns: shocks of spread and depth above frozen thresholds and how they recover."""
    rows = shock_line(market)
    rows = rows.crossJoin(F.broadcast(shock_thresholds(rows, fit_ids, q)))  # one row of thresholds
    fields = [x for p in ("", "n2_", "n5_") for x in (p + "ls", p + "ld", p + "lm")]

    def largest(x, size):
        """Change and states at the largest move, the earliest one on a tie."""
        rank = F.when(x.isNotNull(), F.struct(size.alias("s"), (-c("pos")).alias("p")))
        return F.max_by(F.struct(x.alias("x"), *fields), rank)

    s = summarise(
        rows,
        {
            "n_spread": count_if(c("spread") > c("thr_spread")),
            "n_depth": count_if(c("depth") > c("thr_depth")),
            "n_price": count_if(F.abs(c("price")) > c("thr_price")),
            "at_spread": largest(c("spread"), c("spread")),
            "at_depth": largest(c("depth"), c("depth")),
            "at_price": largest(c("price"), F.abs(c("price"))),
            "n_eligible": count_if(c("eligible")),
        },
    )

    def recovery(kind, field, ahead, sign):
        x = c(f"at_{kind}.x")
        value = sign * (c(f"at_{kind}.{field}") - c(f"at_{kind}.{ahead}_{field}")) / x
        ok = (c(f"n_{kind}") > 0) & (x > 1e-12)
        return F.coalesce(F.when(ok, clip(value, -3, 3)), F.lit(0.0))

    x = c("at_price.x")
    back = -F.signum(x) * (c("at_price.n5_lm") - c("at_price.lm")) / F.abs(x)
    return on_spine(
        spine,
        derive(
            s,
            {
                "spread_shock_count_60": c("n_spread"),
                "spread_recovery_fraction_6": recovery("spread", "ls", "n2", 1),
                "spread_recovery_fraction_15": recovery("spread", "ls", "n5", 1),
                "depth_shock_count_60": c("n_depth"),
                "depth_recovery_fraction_6": recovery("depth", "ld", "n2", -1),
                "depth_recovery_fraction_15": recovery("depth", "ld", "n5", -1),
                "price_reversion_fraction_15": F.coalesce(
                    F.when((c("n_price") > 0) & (F.abs(x) > 1e-12), clip(back, -3, 3)), F.lit(0.0)
                ),
                "liquidity_recovery_coverage_60": F.least(c("n_eligible") / 16.0, F.lit(1.0)),
            },
        ),
        fill=0.0,
    )
