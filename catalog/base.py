"""Registry of checked queries and the SQL pieces their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    """Register a named piece of SQL with the pieces it reads."""
    _CTES[name] = (tuple(needs.split()), sql)


def _resolve(name: str, seen: list[str]) -> None:
    for dep in _CTES[name][0]:
        _resolve(dep, seen)
    if name not in seen:
        seen.append(name)


def sql(select: str, needs: str = "", doubles: str = "", digits: int = 6,
        recursive: bool = False, extra: str = "") -> str:
    """A full statement: needed pieces, optional extra pieces, rounded doubles."""
    seen: list[str] = []
    for name in needs.split():
        _resolve(name, seen)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in seen]
    if extra:
        parts.append(extra)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    if not doubles:
        return head + select
    fixed = ", ".join(
        f"round(CAST({c} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split()
    )
    return f"{head}SELECT * REPLACE ({fixed}) FROM ({select}) AS _result"


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, spell dates as text and widen integers for the comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None, digits: int = 6):
    """Register a query, with its oracle unless none can be written."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(spark, sf_dir), digits)

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _sensor_sql(step: int) -> str:
    return f"""
    SELECT l_suppkey AS user_id,
           CAST(1704135600 + rn0 * {step} AS BIGINT) AS ts,
           hr, CASE WHEN hr > 0 THEN 1 ELSE 0 END AS rr_count,
           CASE WHEN hr > 0 THEN 60000.0E0 / hr + (l_linenumber - 4) * 15.0E0 END AS rr,
           CASE WHEN hr > 0 AND l_linenumber > 4 THEN 60000.0E0 / hr - 10.0E0 END AS rr2,
           l_discount * 2 AS acc_x, l_tax * 3 AS acc_y, 1.0E0 AS acc_z,
           abs(sqrt(l_discount * 2 * (l_discount * 2) + l_tax * 3 * (l_tax * 3) + 1.0E0) - 1.0E0) AS mv,
           l_tax - 0.04E0 AS gyro,
           CASE WHEN l_linenumber <> 3 THEN 90 + l_linenumber END AS spo2,
           CAST(l_orderkey % 4 AS INT) AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS rn0,
              CASE WHEN l_discount < 0.005 THEN 0 ELSE CAST(40 + l_quantity AS INT) END AS hr
          FROM lineitem)"""


LOCAL_DATE = "(DATE '1970-01-01' + CAST((ts + 3600) // 86400 AS INT))"
LOCAL_HOUR = "(((ts + 3600) % 86400) // 3600)"

for _step in (300, 60, 10):
    s = "" if _step == 300 else str(_step)
    cte(f"sensor{s}", "", _sensor_sql(_step))
    cte(f"day{s}", f"sensor{s}",
        f"SELECT *, strftime({LOCAL_DATE}, '%Y-%m-%d') AS date FROM sensor{s}")
    cte(f"night{s}", f"sensor{s}", f"""
        SELECT *, row_number() OVER (PARTITION BY user_id, night ORDER BY ts) - 1 AS pos,
               count(*) OVER (PARTITION BY user_id, night) AS n,
               min(ts) OVER (PARTITION BY user_id, night) AS night_first,
               max(ts) OVER (PARTITION BY user_id, night) AS night_last
        FROM (SELECT *, CASE WHEN {LOCAL_HOUR} >= 20 THEN strftime({LOCAL_DATE} + 1, '%Y-%m-%d')
                             WHEN {LOCAL_HOUR} < 12 THEN strftime({LOCAL_DATE}, '%Y-%m-%d') END AS night
              FROM sensor{s})
        WHERE night IS NOT NULL""")
    cte(f"dayp{s}", f"day{s}", f"""
        SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY ts) - 1 AS pos,
               count(*) OVER (PARTITION BY user_id, date) AS n FROM day{s}""")

cte("event_seconds", "", """
    SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
           40 + CAST(trunc(arg_min(value, event_id)) AS INT) % 60 AS hr,
           min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type
    FROM events GROUP BY 1, 2""")

cte("daily", "", """
    SELECT user_id, date,
           CAST(v % 101 AS DOUBLE) AS recovery, CAST(e % 101 AS DOUBLE) AS sleep,
           (v % 211) / 10.0E0 AS strain, CAST(20 + e % 100 AS DOUBLE) AS hrv,
           CAST(45 + v % 25 AS DOUBLE) AS rhr, CAST(12 + e % 7 AS DOUBLE) AS resp,
           4 + (e % 60) / 10.0E0 AS sleep_hours, CAST(70 + v % 31 AS DOUBLE) AS efficiency,
           CAST(v % 13 AS DOUBLE) AS awake_pct, CAST(4000 + v % 9000 AS DOUBLE) AS kilojoule,
           n_events, has_view, has_purchase
    FROM (SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date,
                 CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v,
                 CAST(sum(event_id) AS BIGINT) AS e, count(*) AS n_events,
                 max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS has_view,
                 max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS has_purchase
          FROM events GROUP BY 1, 2)""")

cte("official", "daily", """
    SELECT user_id, date,
           CASE WHEN has_purchase = 1 THEN recovery + (n_events % 5 - 2) * 4.0E0 END AS recovery,
           sleep + (n_events % 5 - 2) * 3.0E0 AS sleep,
           strain + (n_events % 5 - 2) * 0.5E0 AS strain,
           hrv, rhr, resp, sleep_hours, efficiency
    FROM daily WHERE has_view = 1""")
