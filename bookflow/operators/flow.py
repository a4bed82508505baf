"""Trade and order families that need no row order: conditional sums in one aggregation each."""

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import at_least, bucket, ratio, seconds
from ..functions.stats import count_if, sum_if
from ..schema import KEY
from .assemble import derive, on_spine, summarise

c = F.col

# Bucket edges in seconds before the prediction.
COARSE_EDGES = (60.0, 180.0, 300.0)


def within(window):
    """Row condition of a look-back window: a number w is t <= w, a pair (a, b) is a < t <= b."""
    t = seconds()
    if isinstance(window, tuple):
        return (t > window[0]) & (t <= window[1])
    return t <= window


def trade_sums(transaction, windows):
    aggs = {}
    for name, w in windows.items():
        for side, cond in (("buy", X.is_buy), ("sell", X.is_sell)):
            rows = within(w) & cond
            aggs[f"{side}_volume_{name}"] = sum_if(rows, X.volume)
            aggs[f"{side}_count_{name}"] = count_if(rows)
            aggs[f"{side}_amount_{name}"] = sum_if(rows, X.price * X.volume)
    return summarise(transaction, aggs)


def order_sums(order, windows):
    aggs = {}
    for name, w in windows.items():
        for side, side_cond in (("buy", X.is_buy), ("sell", X.is_sell)):
            for action, action_cond in (("new", X.is_new), ("cancel", X.is_cancel)):
                rows = within(w) & side_cond & action_cond
                aggs[f"{action}_{side}_volume_{name}"] = sum_if(rows, X.volume)
        aggs[f"order_count_{name}"] = count_if(within(w))
    return summarise(order, aggs)


def _signed(kind, name):
    b, s = c(f"buy_{kind}_{name}"), c(f"sell_{kind}_{name}")
    return ratio(b - s, b + s)


def _both(kind, name):
    return c(f"buy_{kind}_{name}") + c(f"sell_{kind}_{name}")


def trade_flow(transaction, spine):
    """8 columns: last-60 and last-20 second trade imbalance, size imbalance, acceleration, size."""
    sums = trade_sums(transaction, {"60": 60, "20": 20, "prev": (20, 60)})
    last = summarise(transaction, {"last_seen": F.min(F.when(within(60), seconds()))})
    t = on_spine(spine, sums, fill=0.0).join(last, KEY, "left")
    size = {s: ratio(c(f"{s}_volume_60"), c(f"{s}_count_60")) for s in ("buy", "sell")}
    return derive(
        t,
        {
            "trade_volume_imbalance_60": _signed("volume", "60"),
            "trade_volume_imbalance_20": _signed("volume", "20"),
            "trade_count_imbalance_60": _signed("count", "60"),
            "trade_average_size_imbalance_60": ratio(
                size["buy"] - size["sell"], size["buy"] + size["sell"]
            ),
            "trade_pressure_acceleration_20_vs_40": _signed("volume", "20") - _signed("volume", "prev"),
            "log1p_total_trade_volume_60": F.log1p(_both("volume", "60")),
            "log1p_total_trade_count_60": F.log1p(_both("count", "60")),
            "last_trade_seconds_before_predict": c("last_seen"),
        },
    )


NESTED = {"10": 10, "30": 30, "60": 60, "10_30": (10, 30), "30_60": (30, 60)}


def trade_windows(transaction, spine):
    """15 columns on nested 10/30/60 second windows."""
    t = on_spine(spine, trade_sums(transaction, NESTED), fill=0.0)
    vwap = {n: ratio(_both("amount", n), _both("volume", n)) for n in ("10", "30", "60")}
    out = {}
    for w in ("10", "30"):
        out[f"trade_volume_imbalance_{w}"] = _signed("volume", w)
        out[f"trade_count_imbalance_{w}"] = _signed("count", w)
        out[f"trade_vwap_{w}_vs_60"] = ratio(vwap[w] - vwap["60"], vwap["60"])
        out[f"trade_volume_share_{w}_of_60"] = ratio(_both("volume", w), _both("volume", "60"))
        out[f"trade_count_share_{w}_of_60"] = ratio(_both("count", w), _both("count", "60"))
    for w in ("10", "30", "60"):
        out[f"trade_signed_amount_ratio_{w}"] = _signed("amount", w)
    for w, rest in (("10", "10_30"), ("30", "30_60")):
        out[f"trade_pressure_delta_{w}_vs_{rest}"] = _signed("volume", w) - _signed("volume", rest)
    return derive(t, out)


class _Orders:
    """Pressure ratios over the columns of `order_sums` for one window."""

    def __init__(self, name):
        self.nb, self.ns, self.cb, self.cs = (
            c(f"{a}_{s}_volume_{name}") for a in ("new", "cancel") for s in ("buy", "sell")
        )
        self.count = c(f"order_count_{name}")
        self.total = self.nb + self.ns + self.cb + self.cs

    def new_imbalance(self):
        return ratio(self.nb - self.ns, self.nb + self.ns)

    def cancel_pressure(self):
        return ratio(self.cs - self.cb, self.cb + self.cs)

    def net_pressure(self):
        return ratio(self.nb - self.ns - self.cb + self.cs, self.total)

    def cancel_ratio(self):
        return ratio(self.cb + self.cs, self.total)


def order_flow(order, spine):
    """8 columns: order and cancel pressure in the last 60 and 20 seconds."""
    windows = {"60": 60, "20": 20, "prev": (20, 60)}
    t = on_spine(spine, order_sums(order, windows), fill=0.0)
    w60, w20, prev = _Orders("60"), _Orders("20"), _Orders("prev")
    return derive(
        t,
        {
            "new_order_volume_imbalance_60": w60.new_imbalance(),
            "cancel_order_pressure_60": w60.cancel_pressure(),
            "net_order_pressure_60": w60.net_pressure(),
            "buy_cancel_ratio_60": ratio(w60.cb, w60.nb + w60.cb),
            "sell_cancel_ratio_60": ratio(w60.cs, w60.ns + w60.cs),
            "total_cancel_ratio_60": w60.cancel_ratio(),
            "net_order_pressure_20": w20.net_pressure(),
            "net_order_pressure_acceleration_20_vs_40": w20.net_pressure() - prev.net_pressure(),
        },
    )


def order_windows(order, spine):
    """15 columns on nested 10/30/60 second windows."""
    t = on_spine(spine, order_sums(order, NESTED), fill=0.0)
    w = {n: _Orders(n) for n in NESTED}
    out = {}
    for n in ("10", "30"):
        out[f"new_order_volume_imbalance_{n}"] = w[n].new_imbalance()
        out[f"cancel_order_pressure_{n}"] = w[n].cancel_pressure()
        out[f"net_order_pressure_{n}"] = w[n].net_pressure()
        out[f"total_cancel_ratio_{n}"] = w[n].cancel_ratio()
        out[f"order_volume_share_{n}_of_60"] = ratio(w[n].total, w["60"].total)
        out[f"order_count_share_{n}_of_60"] = ratio(w[n].count, w["60"].count)
    for n, rest in (("10", "10_30"), ("30", "30_60")):
        out[f"net_order_pressure_delta_{n}_vs_{rest}"] = w[n].net_pressure() - w[rest].net_pressure()
    out["cancel_ratio_delta_10_vs_60"] = w["10"].cancel_ratio() - w["60"].cancel_ratio()
    return derive(t, out)


def trade_buckets(transaction, spine, edges=COARSE_EDGES):
    """Six trade columns per time bucket; an empty bucket is all zero."""
    b = bucket(seconds(), edges)
    n_buckets = len(edges) + 1
    aggs = {}
    for i in range(n_buckets):
        inside = b == i
        aggs |= {
            f"n{i}": count_if(inside),
            f"v{i}": sum_if(inside, X.volume),
            f"bv{i}": sum_if(inside & X.is_buy, X.volume),
            f"pv{i}": sum_if(inside, X.price * X.volume),
            f"p{i}": sum_if(inside, X.price),
            f"mx{i}": F.max(F.when(inside, X.volume)),
        }
    t = on_spine(spine, summarise(transaction, aggs))
    out = {}
    for i in range(n_buckets):
        n, v = c(f"n{i}"), c(f"v{i}")
        vwap, mean = c(f"pv{i}") / at_least(v, 1e-9), at_least(c(f"p{i}") / n, 1e-9)
        values = {
            "n": n,
            "vol": v,
            "buyfrac": F.when(v > 0, c(f"bv{i}") / v).otherwise(0.5),
            "maxv": c(f"mx{i}"),
            "vwap_dev": F.when(v > 0, vwap / mean - 1).otherwise(0.0),
            "avgsz": v / n,
        }
        out |= {f"t{i}_{k}": F.when(n > 0, x).otherwise(0.0) for k, x in values.items()}
    return derive(t, out)


def order_buckets(order, spine, edges=COARSE_EDGES):
    """Eight order columns per time bucket; an empty bucket is all zero."""
    b = bucket(seconds(), edges)
    n_buckets = len(edges) + 1
    aggs = {}
    for i in range(n_buckets):
        inside = b == i
        for a, cond in (("new", X.is_new), ("can", X.is_cancel)):
            aggs |= {
                f"n_{a}{i}": count_if(inside & cond),
                f"v_{a}{i}": sum_if(inside & cond, X.volume),
                f"b_{a}{i}": sum_if(inside & cond & X.is_buy, X.volume),
            }
    t = on_spine(spine, summarise(order, aggs), fill=0.0)
    out = {}
    for i in range(n_buckets):
        nn, nc = c(f"n_new{i}"), c(f"n_can{i}")
        share = {
            a: F.when(c(f"v_{a}{i}") > 0, c(f"b_{a}{i}") / c(f"v_{a}{i}")).otherwise(0.5)
            for a in ("new", "can")
        }
        values = {
            "nnew": nn,
            "ncan": nc,
            "vnew": c(f"v_new{i}"),
            "vcan": c(f"v_can{i}"),
            "netc": nn - nc,
            "buyfrac_new": share["new"],
            "buyfrac_can": share["can"],
            "canratio": nc / at_least(nn, 1),
        }
        out |= {f"o{i}_{k}": F.when(nn + nc > 0, x).otherwise(0.0) for k, x in values.items()}
    return derive(t, out)


def fill_ratio(transaction, order, spine, edges=COARSE_EDGES):
    """Executed against submitted volume per (bucket, side): four columns each."""
    b = bucket(seconds(), edges)
    sides = (("b", X.is_buy), ("s", X.is_sell))
    placed, executed = {}, {}
    for i in range(len(edges) + 1):
        for s, cond in sides:
            rows = (b == i) & cond
            placed[f"p{i}{s}"] = sum_if(rows & X.is_new, X.volume)
            placed[f"x{i}{s}"] = sum_if(rows & X.is_cancel, X.volume)
            executed[f"e{i}{s}"] = sum_if(rows, X.volume)
    t = on_spine(spine, summarise(order, placed), summarise(transaction, executed), fill=0.0)
    out = {}
    for i in range(len(edges) + 1):
        for s, _ in sides:
            p, x, e = c(f"p{i}{s}"), c(f"x{i}{s}"), c(f"e{i}{s}")
            values = {
                "fill": e / at_least(p, 1),
                "fillnet": e / at_least(p - x, 1),
                "exec_logratio": F.log1p(e) - F.log1p(p),
                "cancelover": x / at_least(p, 1),
            }
            out |= {f"f{i}{s}_{k}": F.when(p + e > 0, v).otherwise(0.0) for k, v in values.items()}
    return derive(t, out)


def trade_summary(transaction):
    """Trade part (18 columns) of the base family."""
    t, v, p = seconds(), X.volume, X.price
    seq = c("event_seq")
    aggs = {
        "n": F.count(F.lit(1)).cast("double"),
        "v": F.sum(v),
        "bv": sum_if(X.is_buy, v),
        "sv": sum_if(X.is_sell, v),
        "pv": F.sum(p * v),
        "p2v": F.sum(p * p * v),
        "tv": F.sum(t * v),
        "mx": F.max(v),
        "last_p": F.max_by(p, F.struct(-t, seq)),
        "first_p": F.max_by(p, F.struct(t, seq)),
    }
    for w in (15, 30):
        aggs |= {
            f"near{w}": F.max_by(p, F.struct(-F.abs(t - w), -t, seq)),
            f"v{w}": sum_if(t <= w, v),
            f"bv{w}": sum_if((t <= w) & X.is_buy, v),
            f"sv{w}": sum_if((t <= w) & X.is_sell, v),
        }
    v1 = at_least(c("v"), 1)
    vwap = c("pv") / v1
    back = lambda now, then: F.when(then > 0, now / at_least(then, 1e-9) - 1).otherwise(0.0)
    signed = lambda b, s: (b - s) / (b + s + 1)
    out = {
        "tx_n": c("n"),
        "tx_vol": c("v"),
        "tx_imb": signed(c("bv"), c("sv")),
        "tx_vwap": vwap,
        "tx_lastp": c("last_p"),
        "tx_firstp": c("first_p"),
        "tx_ret": back(c("last_p"), c("first_p")),
        "tx_vwap_dev": back(vwap, c("last_p")),
        "tx_avg_trade": c("v") / at_least(c("n"), 1),
        "tx_max_trade": c("mx"),
        "tx_px_std": F.sqrt(at_least(c("p2v") / v1 - vwap * vwap, 0)) / at_least(vwap, 1e-9),
        "tx_recency": c("tv") / v1,
    }
    for w in (15, 30):
        out[f"tx_ret{w}"] = back(c("last_p"), c(f"near{w}"))
        out[f"tx_vol{w}_frac"] = c(f"v{w}") / v1
        out[f"tx_imb{w}"] = signed(c(f"bv{w}"), c(f"sv{w}"))
    return derive(summarise(transaction, aggs), out)


def order_summary(order):
    """Order part (11 columns) of the base family."""
    t, v = seconds(), X.volume
    aggs = {"n_new": count_if(X.is_new), "n_can": count_if(X.is_cancel)}
    for side, sc in (("b", X.is_buy), ("s", X.is_sell)):
        for act, ac in (("n", X.is_new), ("c", X.is_cancel)):
            aggs[f"{act}{side}"] = sum_if(sc & ac, v)
            aggs[f"{act}{side}30"] = sum_if(sc & ac & (t <= 30), v)
        aggs[f"pv{side}"] = sum_if(sc & X.is_new, X.price * v)
    px = {s: c(f"pv{s}") / at_least(c(f"n{s}"), 1) for s in "bs"}
    out = {}
    for suffix in ("", "30"):
        nb, ns, cb, cs = (c(k + suffix) for k in ("nb", "ns", "cb", "cs"))
        out[f"ord_new_imb{suffix}"] = (nb - ns) / (nb + ns + 1)
        out[f"ord_net_imb{suffix}"] = ((nb - cb) - (ns - cs)) / (nb + ns + cb + cs + 1)
    all30, all60 = (X.total([c(k + s) for k in ("nb", "ns", "cb", "cs")]) for s in ("30", ""))
    out |= {
        "ord_nnew": c("n_new"),
        "ord_ncan": c("n_can"),
        "ord_cancel_ratio": c("n_can") / at_least(c("n_new") + c("n_can"), 1),
        "ord_buy_px": px["b"],
        "ord_sell_px": px["s"],
        "ord_px_spread": (px["s"] - px["b"]) / at_least((px["s"] + px["b"]) / 2, 1e-9),
        "ord_vol30_frac": all30 / at_least(all60, 1),
    }
    return derive(summarise(order, aggs), out)
