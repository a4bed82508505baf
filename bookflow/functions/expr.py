"""Column expressions shared by the operators: arithmetic only, no aggregation."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import Columns

EPS = 1e-12


def col(name):
    return F.col(name).cast("double")


def clip(x, lo, hi):
    """Bound `x`; null stays null."""
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def finite_or_zero(x):
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def null_if_nan(x):
    return F.when(~F.isnan(x), x)


def at_least(x, floor):
    return F.greatest(x, F.lit(float(floor)))


def ratio(n, d, policy="positive", eps=EPS):
    """Divide under one of the four rules for an undefined ratio.

    positive: null unless d > 0; nonzero: null if |d| <= eps;
    clamp: d is raised to eps; smooth: n / (d + 1).
    """
    if policy == "positive":
        return F.when(d > 0, n / d)
    if policy == "nonzero":
        return F.when(F.abs(d) > eps, n / d)
    if policy == "clamp":
        return n / at_least(d, eps)
    if policy == "smooth":
        return n / (d + 1.0)
    raise ValueError(f"unknown ratio policy: {policy}")


def safe_log_ratio(n, d):
    return F.when(d > 0, F.log1p(n / d))


def bucket(t, edges, closed="right"):
    """Bucket number of `t` among ascending edges.

    closed="right" puts an edge value into the lower bucket, (lo, hi];
    closed="left" puts it into the upper one, [lo, hi).
    """
    inside = (lambda e: t <= e) if closed == "right" else (lambda e: t < e)
    cases = F.when(inside(edges[0]), 0)
    for i, e in enumerate(edges[1:], start=1):
        cases = cases.when(inside(e), i)
    return cases.otherwise(len(edges))


def time_bin(t, width, bins, reverse=False):
    """Uniform bin of the countdown, clipped to the last bin; reverse makes 0 the oldest."""
    b = F.least(F.floor(t / width), F.lit(bins - 1)).cast("int")
    return (F.lit(bins - 1) - b) if reverse else b


# quotes ----------------------------------------------------------------------------------------

q = Columns(
    ask1=lambda: col("ask_price_1"),
    bid1=lambda: col("bid_price_1"),
    ask2=lambda: col("ask_price_2"),
    bid2=lambda: col("bid_price_2"),
    askv1=lambda: col("ask_volume_1"),
    bidv1=lambda: col("bid_volume_1"),
    askv2=lambda: col("ask_volume_2"),
    bidv2=lambda: col("bid_volume_2"),
    mid=lambda: (q.ask1 + q.bid1) / 2.0,
    spread=lambda: q.ask1 - q.bid1,
    has_quote=lambda: (q.ask1 > 0) & (q.bid1 > 0),
    # trades and orders
    price=lambda: col("price"),
    volume=lambda: col("volume"),
    is_buy=lambda: F.col("side") == 0,
    is_sell=lambda: F.col("side") == 1,
    is_new=lambda: F.col("order_action") == 0,
    is_cancel=lambda: F.col("order_action") == 1,
    side_sign=lambda: F.when(q.is_buy, 1.0).when(q.is_sell, -1.0),
    action_sign=lambda: F.when(q.is_new, 1.0).when(q.is_cancel, -1.0),
    signed_volume=lambda: q.side_sign * q.volume,
    signed_amount=lambda: q.signed_volume * q.price,
)


def __getattr__(name):
    """The columns above are also names of this module."""
    return getattr(q, name)


def robust_quote():
    """Uncrossed two-sided quote with mid >= 0.1 and relative spread within 10 %."""
    return q.has_quote & (q.mid >= 0.1) & (q.spread >= 0) & (q.spread / q.mid <= 0.1)


def imbalance(bid_volume, ask_volume, floor=EPS):
    """(bid - ask) / (bid + ask), the denominator not below `floor`."""
    return (bid_volume - ask_volume) / at_least(bid_volume + ask_volume, floor)


def smoothed_imbalance(bid_volume, ask_volume):
    return (bid_volume - ask_volume) / (bid_volume + ask_volume + 1.0)


def microprice(floor=EPS):
    return (q.ask1 * q.bidv1 + q.bid1 * q.askv1) / at_least(q.askv1 + q.bidv1, floor)


def level_gaps():
    """Relative distance between the first and second level, (ask, bid)."""
    m = at_least(q.mid, 1e-9)
    return (q.ask2 - q.ask1) / m, (q.bid1 - q.bid2) / m


def price_volume_slope():
    """(ask slope, bid slope): price step per unit of volume step, null on equal volumes."""
    return (
        ratio(q.ask2 - q.ask1, q.askv2 - q.askv1, "nonzero"),
        ratio(q.bid2 - q.bid1, q.bidv2 - q.bidv1, "nonzero"),
    )


# trades and orders -----------------------------------------------------------------------------

def seconds():
    return col("seconds_before_predict")


def row_max(*cols):
    return F.greatest(*cols)


def row_min(*cols):
    return F.least(*cols)


def aligned_pressure(a, b):
    """sign(a+b) * min(|a|, |b|) where both agree in sign, else 0; null if either is null."""
    agree = F.signum(a + b) * F.least(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), None).when(a * b > 0, agree).otherwise(0.0)


def flow_price_response(flow, mid_change, rel_spread):
    """(flow x clipped move, flow damped by the move), the move measured in spreads."""
    moved = clip(ratio(mid_change, rel_spread, "nonzero"), -5.0, 5.0)
    return flow * moved, flow / (1.0 + F.abs(moved))


def hash_split(key, parts=5):
    """Pseudo-random part of an integer key by one linear congruential step."""
    return F.pmod((key.cast("long") * 1103515245 + 12345).bitwiseAND(0x7FFFFFFF), F.lit(parts))


def total(cols):
    return reduce(Column.__add__, cols)


def mean_of(cols):
    return total(cols) / float(len(cols))


def pop_std_of(cols):
    """Population standard deviation across columns of one row."""
    m = mean_of(cols)
    return F.sqrt(at_least(mean_of([(c - m) * (c - m) for c in cols]), 0.0))
