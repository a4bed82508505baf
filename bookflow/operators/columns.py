"""Choosing columns of feature tables: families, arms and the best-scored features."""

from functools import reduce

from pyspark.sql import functions as F

from ..schema import KEY

# How columns of the volatility-flow family group by what they measure.
FLOW_MARKS = ("ofi", "depth_ratio")
FLOW_STARTS = ("x30_ord", "x30_qi")
VOLATILITY = (
    "x30_rv_60", "x30_rv_600", "x30_semi_ratio", "x30_parkinson", "x30_vol_of_vol", "x30_signvol_60", "x30_spread_rms",
    "x30_spread_drift",
)


def families(names):
    """{flow, vol, price, flow_price}: names of the volatility-flow family by what they measure."""
    flow = [n for n in names if n.startswith(FLOW_STARTS) or any(m in n for m in FLOW_MARKS)]
    vol = [n for n in names if n in VOLATILITY]
    price = [n for n in names if n not in flow and n not in vol]
    return {"flow": flow, "vol": vol, "price": price, "flow_price": [n for n in names if n not in vol]}


def feature_arm(base, volatility, burst, arm):
    """Base columns with the columns an arm adds: base, x30, a family name, or flow31.

    volatility and burst are the volatility-flow and burst-flow tables of the same samples.
    """
    names = [n for n in volatility.columns if n != KEY]
    groups = families(names) | {"x30": names, "base": []}
    groups["flow31"] = groups["flow"]
    if arm not in groups:
        raise ValueError(f"unknown arm: {arm}")
    tables = [base]
    if groups[arm]:
        tables.append(volatility.select(KEY, *groups[arm]))
    if arm == "flow31":
        tables.append(burst)
    return reduce(lambda a, b: a.join(b, KEY, "left"), tables)


def drop_columns(df, names):
    """Without the named columns; a name the table lacks is an error."""
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ValueError(f"no such columns: {lacking}")
    return df.drop(*names)


def top_features(scores, k, name="feature", score="score"):
    """The k best rows of a score table (one row per feature), ties by name."""
    return scores.orderBy(F.desc(score), name).limit(k)
