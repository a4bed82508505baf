"""Shared text of the check queries: the same streams as `sources.adapters`, in DuckDB SQL."""

CTES = {
    "tx": """tx AS (SELECT user_id AS sample_id, event_id AS seq,
      (1706659200000000 - epoch_us(ts)) / 43200000000.0::DOUBLE AS t,
      1 + value / 1000 AS price, (1 + event_id % 97)::DOUBLE AS volume,
      CASE WHEN event_id % 5 < 3 THEN 0 ELSE 1 END AS side,
      CASE WHEN event_id % 5 < 3 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn
      FROM events WHERE event_type IN ('purchase', 'view', 'click'))""",
    "od": """od AS (SELECT user_id AS sample_id, event_id AS seq,
      (1706659200000000 - epoch_us(ts)) / 43200000000.0::DOUBLE AS t,
      1 + value / 2000 AS price, (1 + event_id % 89)::DOUBLE AS volume,
      event_id % 2 AS side, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS act,
      CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn
      FROM events WHERE event_type <> 'purchase')""",
    "mk": """raw_lines AS (SELECT *, l_extendedprice / l_quantity / 1000 AS u,
      0.001::DOUBLE * (1 + l_linenumber) AS step, l_orderkey % 97 = 0 AS is_empty,
      l_linenumber % 3 AS trades FROM lineitem),
    raw_quotes AS (SELECT l_suppkey AS sample_id,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
        l_quantity, l_extendedprice) AS seq,
      date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-12-31') * (600.0::DOUBLE / 2560.0::DOUBLE) AS t,
      CASE WHEN trades > 0 THEN u END AS ap, CAST(trades * l_quantity AS INTEGER)::DOUBLE AS tv,
      trades::DOUBLE AS tc,
      CASE WHEN is_empty THEN 0.0::DOUBLE ELSE u * (1 + step) END AS a1,
      CASE WHEN is_empty THEN 0.0::DOUBLE ELSE CAST(l_quantity AS INTEGER)::DOUBLE END AS av1,
      u * (1 - step) AS b1, (1 + l_partkey % 50)::DOUBLE AS bv1,
      (1 + l_orderkey % 60)::DOUBLE AS av2, (1 + (l_partkey + l_linenumber) % 40)::DOUBLE AS bv2
      FROM raw_lines),
    mk AS (SELECT *, a1 * 1.001::DOUBLE AS a2, b1 * 0.999::DOUBLE AS b2, (a1 + b1) / 2 AS mid,
      a1 > 0 AND b1 > 0 AS ok FROM raw_quotes)""",
    "spine": "spine AS (SELECT DISTINCT user_id AS sample_id FROM events)",
    "lab": """lab AS (SELECT DISTINCT user_id AS sample_id, user_id % 12 AS month,
      (user_id * 7919 % 2001 - 1000) / 1000000.0::DOUBLE AS target FROM events)""",
    "pr": """pr AS (SELECT o_orderkey AS sample_id,
      (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS month,
      (o_totalprice - 150000) / 1000000 AS target,
      (o_totalprice - 150000) / 5000000 + (o_custkey % 101 - 50) / 1000.0::DOUBLE AS pred_a,
      (o_totalprice - 150000) / 4000000 + (o_orderkey % 89 - 44) / 1000.0::DOUBLE AS pred_b
      FROM orders)""",
}


def query(streams, body, keys=("sample_id",), fill=False, steps=()):
    """Full statement: stream CTEs, extra steps, and the body with every value rounded.

    Values come out as doubles at 6 decimals; fill turns null into 0.
    """
    parts = [CTES[s] for s in streams] + list(steps) + [f"result AS ({body})"]
    skip = ", ".join(keys)
    star = f"CAST(COLUMNS(* EXCLUDE ({skip})) AS DOUBLE)"
    value = f"coalesce({star}, 0)" if fill else star
    return f"WITH {', '.join(parts)} SELECT {skip}, round({value} + 1.23e-10, 6) + 0.0 FROM result"


def cols(pairs):
    """`expr AS name` list from a dict."""
    return ", ".join(f"{e} AS {n}" for n, e in pairs.items())


def sum_if(x, cond):
    return f"coalesce(sum({x}) FILTER (WHERE {cond}), 0)"


def ratio(n, d):
    return f"CASE WHEN ({d}) > 0 THEN ({n}) / ({d}) END"


def clamp_ratio(n, d, eps="1e-12"):
    return f"({n}) / greatest({d}, {eps}::DOUBLE)"


def clip(x, lo, hi):
    return f"greatest(least({x}, {hi}::DOUBLE), {lo}::DOUBLE)"
