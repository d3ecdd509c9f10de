"""Queries over streams, operator scores and calibration temperature."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql, tables
from ..functions.safe import rounded as r
from ..operators import scorer
from ..sources import shared
from ..sources.tables import sales, table
from ..streaming import trace
from .fitting import SQL as FITTING
from .fitting import S, _sc, _scored, rd

SQL: dict[str, str] = {}


def _events(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


def event_windows_stream(spark, d):
    """Hourly counts and sums by event type from a stream over the events' files, run to its end."""
    out = trace.run_updates(trace.event_windows(_events(spark, d), 60), shared.folder(spark, "windows"), ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r(F.col("total"), 4).alias("total"))


SQL["event_windows_stream"] = f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {rd('sum(value)')} AS total FROM events GROUP BY 1, 2"


def stagnation_stream(spark, d):
    """Each user's events as a stream, in whatever order they come: how long the least value has stood, and when to act."""
    out = trace.run_to_table(trace.ordered_stagnation(_events(spark, d), "user_id", "ts", "value"), shared.folder(spark, "stagnation"))
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), "best", "since", "stagnant", "fires")


#: What lies before the watermark (in whole milliseconds), in order; a cooldown that is shorter than a stagnation is over
#: when the next one begins, so it acts on every fourth point of one.
SQL["stagnation_stream"] = """
WITH e AS (SELECT user_id, ts, value FROM events WHERE epoch_us(ts) < (SELECT (epoch_ms(max(ts)) - 86400000) * 1000 FROM events)),
w AS (SELECT *, row_number() OVER o AS k, min(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, value)),
l AS (SELECT *, max(CASE WHEN before IS NULL OR value < before THEN k END) OVER (PARTITION BY user_id ORDER BY k) AS last FROM w)
SELECT user_id, ts AS at, least(value, coalesce(before, value)) AS best, (k - last)::INT AS since, k - last >= 5 AS stagnant, k - last >= 5 AND (k - last - 5) % 4 = 0 AS fires FROM l"""


def operator_scores(spark, d):
    out = scorer.operator_scores(sales(spark, d), "l_returnflag", "x0", "y")
    return out.select("l_returnflag", *[r(F.col(c), 6).alias(c) for c in ("linear", "exponential", "power", "log")])


_c = lambda a, b: rd(f"pow(corr({a}, {b}), 2)", 6)
SQL["operator_scores"] = f"SELECT l_returnflag, {_c('x0', 'y')} AS linear, {_c('x0', 'ln(abs(y))')} AS exponential, {_c('ln(abs(x0))', 'ln(abs(y))')} AS power, {_c('ln(abs(x0))', 'y')} AS log FROM ({S}) GROUP BY 1"


def temperature_grid(spark, d):
    rows = _scored(spark, d).withColumn("logit", F.lit(6.0) * F.col("score") - 3.0)
    out = scorer.temperature(rows, "logit", "quality", [0.25, 0.5, 1.0, 2.0, 4.0])
    return out.select("temperature", r(F.col("nll"), 6).alias("nll"))


SQL["temperature_grid"] = f"""
WITH s AS (SELECT 6.0::DOUBLE * score - 3.0::DOUBLE AS z, quality FROM ({_sc})), t AS (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS temperature)
SELECT temperature, {rd('avg(greatest(z / temperature, 0) + ln(1.0::DOUBLE + exp(-abs(z / temperature))) - quality * (z / temperature))', 6)} AS nll FROM s, t GROUP BY 1"""


def temperature_fit(spark, d):
    """The temperature of least log loss of the documents' scores, a pass a step."""
    rows = _scored(spark, d).withColumn("logit", F.lit(6.0) * F.col("score") - 3.0)
    t, nll, n = scorer.fit_temperature(rows, "logit", "quality")
    return spark.createDataFrame([(t, nll, n)], "temperature double, nll double, n long").select(r(F.col("temperature"), 3).alias("temperature"), r(F.col("nll"), 6).alias("nll"), "n")


#: Bisection of the loss's derivative by the inverse of the temperature.
SQL["temperature_fit"] = f"""
WITH RECURSIVE s AS (SELECT 6.0::DOUBLE * score - 3.0::DOUBLE AS z, quality AS y FROM ({_sc})),
b AS (SELECT 0 AS k, 0.01::DOUBLE AS lo, 100.0::DOUBLE AS hi UNION ALL
  SELECT k + 1, CASE WHEN g < 0 THEN sqrt(lo * hi) ELSE lo END, CASE WHEN g < 0 THEN hi ELSE sqrt(lo * hi) END
  FROM (SELECT k, lo, hi, (SELECT avg((1 / (1 + exp(-z * sqrt(lo * hi))) - y) * z) FROM s) AS g FROM b WHERE k < 60)),
t AS (SELECT 1 / hi AS t FROM b WHERE k = 60)
SELECT {rd('t', 3)} AS temperature, (SELECT {rd('avg(greatest(z / t, 0) + ln(1.0::DOUBLE + exp(-abs(z / t))) - y * (z / t))', 6)} FROM s, t) AS nll, (SELECT count(*) FROM s) AS n FROM t"""


def sql_functions(spark, d):
    """The SQL functions of the numeric contract, called from SQL."""
    sql.register(spark)
    table(spark, d, "customer").createOrReplaceTempView("curvesmith_customer")
    return spark.sql("SELECT c_custkey, floor(safe_pow(c_acctbal / 1000D, 3D) * 10000D + 0.5D) / 10000D AS cube, floor(safe_div(1000D, c_acctbal) * 10000D + 0.5D) / 10000D AS inverse FROM curvesmith_customer")


SQL["sql_functions"] = f"SELECT c_custkey, {rd('sign(c_acctbal / 1000.0::DOUBLE) * pow(abs(c_acctbal / 1000.0::DOUBLE) + 1e-10, 3.0)')} AS cube, {rd('greatest(least(1000.0::DOUBLE / (abs(c_acctbal) + 1e-6) * sign(c_acctbal), 1e6), -1e6)')} AS inverse FROM customer"

def basis_long_sql(spark, d):
    """The long form of six terms of every part, by a table function called from SQL."""
    tables.register(spark)
    v = table(spark, d, "part").select("p_partkey", (F.col("p_size") / F.lit(10.0)).alias("s"), (F.col("p_retailprice") / F.lit(1000.0)).alias("v"))
    shared.dealt(v).createOrReplaceTempView("curvesmith_part")
    return spark.sql("SELECT p_partkey, term_id, name, floor(value * 1000000D + 0.5D) / 1000000D AS value FROM long_basis(TABLE(curvesmith_part), 'p_partkey', '1; s; v; s*v; s^2; v^2')")


SQL["basis_long_sql"] = FITTING["basis_long"]

QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
