"""Price-geography families with their check SQL."""

from ..operators import geography as geo
from ..sources.adapters import streams
from .book import bucket_sql
from .registry import present, register
from .sql import cols, query, sum_if

B = bucket_sql((60, 180, 300))


def located(source, name):
    """`name`: rows of `source` with bucket b and distance d."""
    return [
        f"{name}_ref AS (SELECT sample_id, {B} AS b, avg(mid) AS m FROM mk GROUP BY ALL)",
        f"{name}_all AS (SELECT sample_id, avg(mid) AS m FROM mk GROUP BY ALL)",
        f"""{name} AS (SELECT e.*, coalesce((price - coalesce(r.m, g.m)) / greatest(coalesce(r.m, g.m), 1e-9), 0) AS d
        FROM (SELECT *, {B} AS b FROM {source}) e LEFT JOIN {name}_ref r ON r.sample_id = e.sample_id AND r.b = e.b
        LEFT JOIN {name}_all g ON g.sample_id = e.sample_id)""",
    ]


FORMS = {
    "dist": "sum(volume * d) {f} / sum(volume) {f}",
    "absdist": "sum(volume * abs(d)) {f} / sum(volume) {f}",
    "rmsdist": "sqrt(sum(volume * d * d) {f} / sum(volume) {f})",
}


def by_class(classes, prefix, forms, n=4):
    return {
        f"{prefix}{i}_{k}_{v}": FORMS[v].format(f=f"FILTER (WHERE b = {i} AND {cond})")
        for i in range(n)
        for k, cond in classes.items()
        for v in forms
    }


ORDER = {"nb": "act = 0 AND side = 0", "ns": "act = 0 AND side = 1", "cb": "act = 1 AND side = 0",
         "cs": "act = 1 AND side = 1"}
SPINE = "SELECT * FROM spine LEFT JOIN w USING (sample_id)"


def simple(streams_, source, out, extra=()):
    steps = located(source, "e") + list(extra)
    table = "e2" if extra else "e"
    return query(
        streams_, SPINE, fill=True, steps=steps + [f"w AS (SELECT sample_id, {cols(out)} FROM {table} GROUP BY sample_id)"]
    )


@register(
    "order_geography",
    simple(["mk", "od", "spine"], "od", by_class(ORDER, "g", ("dist", "absdist"))),
)
def order_geography(spark, path):
    s = streams(spark, path)
    return present(geo.order_geography(s.order, s.market, s.spine))


@register(
    "trade_geography",
    query(
        ["mk", "tx", "od", "spine"],
        "SELECT * FROM spine LEFT JOIN w USING (sample_id) LEFT JOIN w2 USING (sample_id)",
        fill=True,
        steps=located("tx", "e")
        + located("od", "o")
        + [
            "w AS (SELECT sample_id, "
            + cols(by_class({"tb": "side = 0", "ts": "side = 1"}, "t", ("dist", "absdist")))
            + " FROM e GROUP BY sample_id)",
            f"w2 AS (SELECT sample_id, {cols(by_class(ORDER, 'g', ('rmsdist',)))} FROM o GROUP BY sample_id)",
        ],
    ),
)
def trade_geography(spark, path):
    s = streams(spark, path)
    return present(geo.trade_geography(s.transaction, s.order, s.market, s.spine))


BANDS = ("abs(d) <= 2e-4", "abs(d) > 2e-4 AND abs(d) <= 1e-3", "abs(d) > 1e-3 AND abs(d) <= 5e-3", "abs(d) > 5e-3")


@register(
    "order_bands",
    simple(
        ["mk", "od", "spine"],
        "od",
        {
            f"bd{i}_{a}_band{k}": f"{sum_if('volume', f'b = {i} AND act = {act} AND {band}')} / "
            f"sum(volume) FILTER (WHERE b = {i} AND act = {act})"
            for i in range(4)
            for a, act in (("new", 0), ("can", 1))
            for k, band in enumerate(BANDS)
        },
    ),
)
def order_bands(spark, path):
    s = streams(spark, path)
    return present(geo.order_bands(s.order, s.market, s.spine))


@register(
    "order_size_geography",
    simple(
        ["mk", "od", "spine"],
        "od",
        by_class(
            {"new_sm": "act = 0 AND volume <= mv", "new_big": "act = 0 AND volume > mv",
             "can_sm": "act = 1 AND volume <= mv", "can_big": "act = 1 AND volume > mv"},
            "w", ("dist", "absdist"),
        ),
        extra=["e2 AS (SELECT *, avg(volume) OVER (PARTITION BY sample_id, b, act) AS mv FROM e)"],
    ),
)
def order_size_geography(spark, path):
    s = streams(spark, path)
    return present(geo.order_size_geography(s.order, s.market, s.spine))


TRADE = by_class(
    {"smb": "side = 0 AND volume <= mv", "sms": "side = 1 AND volume <= mv",
     "bigb": "side = 0 AND volume > mv", "bigs": "side = 1 AND volume > mv"},
    "tw", ("dist", "absdist"),
)


@register(
    "trade_size_geography",
    simple(
        ["mk", "tx", "spine"],
        "tx",
        TRADE
        | {
            f"tw{i}_bigbs_ddist": f"coalesce({TRADE[f'tw{i}_bigb_dist']}, 0) - coalesce({TRADE[f'tw{i}_bigs_dist']}, 0)"
            for i in range(4)
        },
        extra=["e2 AS (SELECT *, avg(volume) OVER (PARTITION BY sample_id, b) AS mv FROM e)"],
    ),
)
def trade_size_geography(spark, path):
    s = streams(spark, path)
    return present(geo.trade_size_geography(s.transaction, s.market, s.spine))


def _zones_sql():
    out = {}
    for i in range(4):
        for z, cond in (("near", "abs(d) < 5e-4"), ("far", "abs(d) >= 5e-4")):
            rows = f"b = {i} AND {cond}"
            w = f"sum(volume) FILTER (WHERE {rows})"
            new, can = sum_if("volume", rows + " AND act = 0"), sum_if("volume", rows + " AND act = 1")
            bn = sum_if("volume", rows + " AND act = 0 AND side = 0")
            bc = sum_if("volume", rows + " AND act = 1 AND side = 0")
            out |= {
                f"z{i}_{z}_net": f"({new} - {can}) / {w}",
                f"z{i}_{z}_bfnew": f"CASE WHEN {w} > 0 THEN CASE WHEN {new} > 0 THEN {bn} / {new} ELSE 0.5 END END",
                f"z{i}_{z}_bfcan": f"CASE WHEN {w} > 0 THEN CASE WHEN {can} > 0 THEN {bc} / {can} ELSE 0.5 END END",
            }
    return simple(["mk", "od", "spine"], "od", out)


@register("order_zones", _zones_sql())
def order_zones(spark, path):
    s = streams(spark, path)
    return present(geo.order_zones(s.order, s.market, s.spine))
