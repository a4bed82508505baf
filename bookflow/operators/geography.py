"""Where orders and trades sit relative to the local mid price.

The reference price of an event is the mean mid of its (sample, bucket); a bucket without quotes
falls back to the mean mid of the sample, and a sample without quotes has distance 0.
"""

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.lazy import Columns
from ..functions.expr import at_least, bucket, seconds
from ..functions.stats import sum_if
from ..schema import KEY
from .assemble import derive, on_spine, summarise
from .book import widen
from .flow import COARSE_EDGES
from .timeline import lookup

c = F.col

# Distance bands and the near/far threshold, relative to mid.
BAND_EDGES = (2e-4, 1e-3, 5e-3)
NEAR = 5e-4

BUCKETS = len(COARSE_EDGES) + 1
ORDER_CLASSES = ("nb", "ns", "cb", "cs")
code = Columns(
    order=lambda: F.when(X.is_new, 0).otherwise(2) + F.when(X.is_buy, 0).otherwise(1),
    action=lambda: F.when(X.is_new, 0).otherwise(1),
    side=lambda: F.when(X.is_buy, 0).otherwise(1),
)


def mid_reference(market, edges=COARSE_EDGES):
    """Mean mid per (sample, bucket) for every bucket, with the sample mean as fallback."""
    per = summarise(
        market.withColumn("_b", bucket(seconds(), edges)),
        {"s": F.sum(X.mid), "n": F.count(F.lit(1))},
        (KEY, "_b"),
    )
    every = per.groupBy(KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("_b", c("s") / c("n")))).alias("by_bucket"),
        (F.sum("s") / F.sum("n")).alias("whole"),
    )  # one entry per bucket, so the map has at most len(edges) + 1 entries
    return every.select(
        KEY,
        F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("_b"),
        "by_bucket",
        "whole",
    ).select(KEY, "_b", F.coalesce(F.try_element_at("by_bucket", c("_b")), c("whole")).alias("_ref"))


def mean_size(events, by):
    """Mean volume per (sample, bucket) and each class of `by`, as columns `_size<class>`."""
    rows = events.withColumn("_b", bucket(seconds(), COARSE_EDGES))
    return summarise(
        rows, {f"_size{k}": F.avg(F.when(cond, X.volume)) for k, cond in by.items()}, (KEY, "_b")
    )


def with_distance(events, market, *references):
    """Events with bucket `_b` and signed relative distance `_d` from the local mid."""
    ref = mid_reference(market)
    for r in references:
        ref = ref.join(r, [KEY, "_b"], "full_outer")
    rows = events.withColumn("_b", bucket(seconds(), COARSE_EDGES))
    rows = lookup(rows, ref, [KEY, "_b"])
    d = (X.price - c("_ref")) / at_least(c("_ref"), 1e-9)
    return rows.withColumn("_d", F.coalesce(d, F.lit(0.0)))


def _by_class(rows, classes, number, values):
    """Volume-weighted distance values per (bucket, class) as columns."""
    v, d = X.volume, c("_d")
    aggs = {"w": F.sum(v), "wd": F.sum(v * d), "wa": F.sum(v * F.abs(d)), "wq": F.sum(v * d * d)}
    forms = {
        "dist": c("wd") / c("w"),
        "absdist": c("wa") / c("w"),
        "rmsdist": F.sqrt(c("wq") / c("w")),
    }
    keyed = rows.withColumn("_b", c("_b") * len(classes) + number)
    t = derive(summarise(keyed, aggs, (KEY, "_b")), {k: F.when(c("w") > 0, forms[k]) for k in values}, (KEY, "_b"))
    codes = range(BUCKETS * len(classes))
    return t, codes


def _named(t, codes, classes, prefix):
    k = len(classes)
    return widen(t, codes, lambda i, v: f"{prefix}{i // k}_{classes[i % k]}_{v}")


def order_geography(order, market, spine):
    """32 columns: signed and absolute distance per (bucket, new/cancel x side)."""
    t, codes = _by_class(with_distance(order, market), ORDER_CLASSES, code.order, ("dist", "absdist"))
    return on_spine(spine, _named(t, codes, ORDER_CLASSES, "g"), fill=0.0)


def trade_geography(transaction, order, market, spine):
    """32 columns: trade distance per side, order root-mean-square distance per class."""
    t, codes = _by_class(with_distance(transaction, market), ("tb", "ts"), code.side, ("dist", "absdist"))
    trades = _named(t, codes, ("tb", "ts"), "t")
    o, order_codes = _by_class(with_distance(order, market), ORDER_CLASSES, code.order, ("rmsdist",))
    return on_spine(spine, trades, _named(o, order_codes, ORDER_CLASSES, "g"), fill=0.0)


def order_bands(order, market, spine):
    """32 columns: share of volume per distance band for each (bucket, action)."""
    band = bucket(F.abs(c("_d")), BAND_EDGES)
    rows = with_distance(order, market).withColumn("_b", c("_b") * 2 + code.action)
    aggs = {f"band{k}": sum_if(band == k, X.volume) for k in range(4)} | {"w": F.sum(X.volume)}
    t = derive(
        summarise(rows, aggs, (KEY, "_b")),
        {f"band{k}": F.when(c("w") > 0, c(f"band{k}") / c("w")) for k in range(4)},
        (KEY, "_b"),
    )
    names = ("new", "can")
    wide = widen(t, range(BUCKETS * 2), lambda i, v: f"bd{i // 2}_{names[i % 2]}_{v}")
    return on_spine(spine, wide, fill=0.0)


def order_size_geography(order, market, spine):
    """32 columns: distance of orders above and up to the mean size of their (bucket, action)."""
    sizes = mean_size(order, {0: X.is_new, 1: ~X.is_new})
    big = X.volume > F.when(X.is_new, c("_size0")).otherwise(c("_size1"))
    classes = ("new_sm", "new_big", "can_sm", "can_big")
    number = code.action * 2 + big.cast("int")
    t, codes = _by_class(with_distance(order, market, sizes), classes, number, ("dist", "absdist"))
    return on_spine(spine, _named(t, codes, classes, "w"), fill=0.0)


def trade_size_geography(transaction, market, spine):
    """36 columns: distance of big and small trades per side, and big buy minus big sell."""
    sizes = mean_size(transaction, {0: F.lit(True)})
    classes = ("smb", "sms", "bigb", "bigs")
    number = (X.volume > c("_size0")).cast("int") * 2 + code.side
    t, codes = _by_class(with_distance(transaction, market, sizes), classes, number, ("dist", "absdist"))
    wide = on_spine(spine, _named(t, codes, classes, "tw"), fill=0.0)
    gap = {f"tw{i}_bigbs_ddist": c(f"tw{i}_bigb_dist") - c(f"tw{i}_bigs_dist") for i in range(BUCKETS)}
    return wide.withColumns(gap)


def order_zones(order, market, spine):
    """24 columns: net placement and buy share of orders near to and far from the mid."""
    zones = ("near", "far")
    far = (F.abs(c("_d")) >= NEAR).cast("int")
    rows = with_distance(order, market).withColumn("_b", c("_b") * 2 + far)
    new, can, buy = X.is_new, ~X.is_new, X.is_buy
    aggs = {
        "new": sum_if(new, X.volume), "can": sum_if(can, X.volume), "w": F.sum(X.volume),
        "bnew": sum_if(new & buy, X.volume), "bcan": sum_if(can & buy, X.volume),
    }
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.5)
    values = {
        "net": (c("new") - c("can")) / c("w"),
        "bfnew": share(c("bnew"), c("new")),
        "bfcan": share(c("bcan"), c("can")),
    }
    t = derive(
        summarise(rows, aggs, (KEY, "_b")),
        {k: F.when(c("w") > 0, v) for k, v in values.items()},
        (KEY, "_b"),
    )
    wide = widen(t, range(BUCKETS * 2), lambda i, v: f"z{i // 2}_{zones[i % 2]}_{v}")
    return on_spine(spine, wide, fill=0.0)
