"""The registry of runnable queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import ship
from tallyloom.sources.tables import VIEW_SQL, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables and views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL or name in ("run_metrics", "registry"):
            return view(self.spark, self.sf_dir, name)
        return table(self.spark, self.sf_dir, name)


# Views that need ordered work, written as plain window SQL for the oracle.
ORACLE_VIEWS = {
    "run_metrics": """SELECT md5(cast(user_id AS string)) AS run_hash, event_type AS name,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS step,
        event_id AS tracked, value FROM events""",
    "registry": """SELECT p_brand AS name,
        'v' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number,
        p_partkey AS seq, md5(cast(p_partkey AS string)) AS run_hash,
        CASE p_partkey % 4 WHEN 0 THEN 'development' WHEN 1 THEN 'staging'
             WHEN 2 THEN 'production' ELSE 'archived' END AS stage,
        cast(p_size AS bigint) AS size_bytes FROM part""",
}


def view_sql(name: str) -> str:
    if name in ORACLE_VIEWS:
        return ORACLE_VIEWS[name]
    reads, text = VIEW_SQL[name]
    for read in reads:
        text = text.replace("{" + read + "}", read)
    return text


def with_views(sql: str, *views: str, ctes: str = "") -> str:
    """SQL with the named views (and further CTE text) in front."""
    parts = [f"{v} AS ({view_sql(v)})" for v in views]
    if ctes:
        parts.append(ctes)
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), ctes: str = ""):
    """Register a function of ``Tables`` as a query, with its oracle if there is one."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(Tables(spark, sf_dir))

        run.__name__, run.__doc__, run.__module__ = name, build.__doc__, build.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, ctes=ctes)
        return build

    return register


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that the order of additions does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
