"""What named queries share: input series, rounding, and the DuckDB text of the windowed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.charts import Chart
from ..operators.intervals import series, with_clock
from ..operators.windows import multi_scale

COUNTS = (10, 16, 25)
SECONDS = (0.5,)
FULL = 1800.0
BASELINE = 20
CHART = Chart(h=3.0)
DIGITS = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local session without one uses /tmp."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or "file:/tmp/checkpoints").rstrip("/")


def clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of each user as intervals of a record."""
    return with_clock(series(load(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"], len(COUNTS) + len(SECONDS) + 1), BASELINE)


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_scale(clocked(spark, sf_dir), COUNTS, SECONDS, FULL)


def whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole-record windows of ``windowed`` alone."""
    return multi_scale(with_clock(series(load(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"], 1), BASELINE), full=FULL)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles at ``digits`` decimals and without a negative zero; all integers long; NaN as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.nanvl(c.cast("double"), F.lit(None).cast("double")), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql_rounded(body: str, doubles: list[str], others: list[str], tail: str = "") -> str:
    """A SELECT of the same shape over ``body``, which must end in a relation named r."""
    columns = [*others, *[f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles]]
    return f"{body} SELECT {', '.join(columns)} FROM r {tail}"


WK = "record_id, window_type, window_size, window_index"
EVENTS_SQL = "SELECT user_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS rr_ms FROM events"


def clocked_sql(source: str, baseline: int) -> str:
    return f"""WITH s AS ({source}),
s1 AS (SELECT *, CAST(sum(CAST(rr_ms AS DECIMAL(20,6))) OVER (PARTITION BY record_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1000.0 AS t,
  count(*) OVER (PARTITION BY record_id) AS n_total,
  avg(CASE WHEN idx < {baseline} THEN rr_ms END) OVER (PARTITION BY record_id) AS mu,
  stddev_samp(CASE WHEN idx < {baseline} THEN rr_ms END) OVER (PARTITION BY record_id) AS sg FROM s),
c AS (SELECT record_id, idx, rr_ms, t, n_total, mu, CASE WHEN sg > 0 THEN sg ELSE 1.0 END AS sigma,
  max(t) OVER (PARTITION BY record_id) AS max_t, (rr_ms - mu) / (CASE WHEN sg > 0 THEN sg ELSE 1.0 END) AS z FROM s1)"""


def points_sql(source: str, baseline: int, counts: tuple[int, ...], seconds: tuple[float, ...], full: float) -> str:
    """The relation w, which is what ``multi_scale`` makes of the source's intervals."""
    scales = " UNION ALL ".join(
        [f"SELECT *, 'rr_count' AS window_type, {n}.0::DOUBLE AS window_size, idx // {n} AS window_index FROM c WHERE idx // {n} < n_total // {n}" for n in counts]
        + [f"SELECT *, 'time' AS window_type, {s}::DOUBLE AS window_size, CAST(floor(t / {s}) AS BIGINT) AS window_index FROM c WHERE floor(t / {s}) * {s} < max_t" for s in seconds]
        + [f"SELECT *, 'full_record' AS window_type, {full}::DOUBLE AS window_size, 0::BIGINT AS window_index FROM c"]
    )
    return f"""{clocked_sql(source, baseline)},
u AS ({scales}),
v AS (SELECT *, count(*) OVER (PARTITION BY {WK}) AS n, row_number() OVER (PARTITION BY {WK} ORDER BY idx) - 1 AS pos,
  first_value(t - rr_ms / 1000.0) OVER (PARTITION BY {WK} ORDER BY idx) AS opened, max(t) OVER (PARTITION BY {WK}) AS last_t FROM u),
w AS (SELECT *, t - (CASE WHEN window_index = 0 AND window_type <> 'time' THEN 0.0 ELSE opened END) AS t_local,
  CAST(round(CAST(CASE window_type WHEN 'time' THEN window_index * window_size WHEN 'full_record' THEN 0.0 ELSE (CASE WHEN window_index = 0 THEN 0.0 ELSE opened END) END AS DECIMAL(20,10)), 4) AS DOUBLE) AS start_time_sec,
  CAST(round(CAST(CASE window_type WHEN 'time' THEN least((window_index + 1) * window_size, max_t) ELSE last_t END AS DECIMAL(20,10)), 4) AS DOUBLE) AS end_time_sec
  FROM v WHERE window_type <> 'time' OR n >= 2)"""


CLOCKED_SQL = clocked_sql(EVENTS_SQL, BASELINE)
POINTS_SQL = points_sql(EVENTS_SQL, BASELINE, COUNTS, SECONDS, FULL)
KEY_COLUMNS = ["record_id", "window_type", "window_size", "window_index"]
