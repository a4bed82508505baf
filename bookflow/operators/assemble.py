"""Put per-sample tables together: every join is one-to-one on the sample id."""

from functools import reduce

from pyspark.sql import functions as F

from ..schema import KEY


def summarise(df, aggs, keys=(KEY,)):
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def derive(df, cols, keys=(KEY,)):
    return df.select(*keys, *[c.alias(n) for n, c in cols.items()])


def on_spine(spine, *tables, fill=None):
    """Left join of per-sample tables to the id spine; missing samples get `fill` if given."""
    out = reduce(lambda a, b: a.join(b, KEY, "left"), tables, spine)
    # the key stays as it is, so the next join by it needs no further exchange
    return out if fill is None else out.na.fill(fill, [n for n in out.columns if n != KEY])


def on_bucketed_spine(spine, *tables, fill=None):
    """As `on_spine`, for tables bucketed alike by sample: sorted buckets are merged in one stage, none of them is exchanged."""
    return on_spine(spine, *[t.hint("merge") for t in tables], fill=fill)


def outer(*tables):
    return reduce(lambda a, b: a.join(b, KEY, "full_outer"), tables)


def duplicate_keys(df, keys=(KEY,)):
    """Keys that occur more than once: empty for a valid spine or pack."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
