"""Registered queries: name -> (Spark query, check SQL or None)."""

from importlib import import_module

from pyspark.sql import functions as F

OFFSET = 1.23e-10
MODULES = ["flow", "book", "geography", "quotes", "trades", "grids", "packs", "evaluation", "modelling", "platform"]

_ENTRIES = {}


def register(name, sql=None):
    """Decorator for `fn(spark, path) -> DataFrame`."""

    def add(fn):
        if name in _ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        _ENTRIES[name] = (fn, sql)
        return fn

    return add


def entries():
    for m in MODULES:
        import_module(f"bookflow.plans.{m}")
    return dict(_ENTRIES)


def present(df, keys=("sample_id",), fill=None):
    """Values as doubles at 6 decimals, keys untouched.

    The offset moves decimals such as 0.0000005 off the rounding edge, where the last bit of a
    sum would decide; the check SQL adds the same.
    """
    out = []
    for c in df.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        v = F.col(c).cast("double")
        v = v if fill is None else F.coalesce(v, F.lit(float(fill)))
        out.append((F.round(v + OFFSET, 6) + 0.0).alias(c))
    return df.select(*out)
