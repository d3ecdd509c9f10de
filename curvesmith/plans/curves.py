"""Queries over ordered curves, selection, traces and search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import rounded as r
from ..operators import features, ordered, search, select
from ..sources import synthetic
from ..sources.tables import sales, table
from .fitting import rd

SQL: dict[str, str] = {}


def daily(spark, d):
    """Daily mean event value of each type: (event_type, day, y)."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("y"))


D = "SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS y FROM events GROUP BY 1, 2"
_g = lambda c, w: f"CASE WHEN lag({c}) OVER {w} IS NULL THEN lead({c}) OVER {w} - {c} WHEN lead({c}) OVER {w} IS NULL THEN {c} - lag({c}) OVER {w} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2.0::DOUBLE END"
DERIV = f"WITH d AS ({D}), g AS (SELECT *, {_g('y', 'w')} AS d1 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)), h AS (SELECT *, {_g('d1', 'w')} AS d2 FROM g WINDOW w AS (PARTITION BY event_type ORDER BY day)), c AS (SELECT *, abs(d2) / pow(1.0::DOUBLE + d1 * d1, 1.5::DOUBLE) AS curvature FROM h)"


def curve_derivatives(spark, d):
    out = ordered.derivatives(daily(spark, d), ["event_type"], "day", "y")
    return out.select("event_type", "day", r(F.col("d1"), 4).alias("d1"), r(F.col("d2"), 4).alias("d2"), r(F.col("curvature"), 6).alias("curvature"))


SQL["curve_derivatives"] = f"{DERIV} SELECT event_type, day, {rd('d1')} AS d1, {rd('d2')} AS d2, {rd('curvature', 6)} AS curvature FROM c"


def moving_average(spark, d):
    out = ordered.moving_average(daily(spark, d), ["event_type"], "day", "y", 7)
    return out.select("event_type", "day", r(F.col("smooth"), 4).alias("smooth"))


SQL["moving_average"] = f"SELECT event_type, day, {rd('sum(y) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE')} AS smooth FROM ({D})"


def savitzky_golay(spark, d):
    out = ordered.savitzky_golay(daily(spark, d), ["event_type"], "day", "y")
    return out.select("event_type", "day", r(F.col("smooth"), 4).alias("smooth"))


def _cubic_sql() -> str:
    """Weights of each place by the normal equations of a cubic over eleven places."""
    t = np.arange(-5.0, 6.0)
    m = np.array([[(t ** (i + j)).sum() for j in range(4)] for i in range(4)])
    at = lambda k: np.array([t[k] ** i for i in range(4)])
    row = lambda k: " + ".join(f"({float(at(k) @ np.linalg.solve(m, t[j] ** np.arange(4)))!r})::DOUBLE * {'lag' if j < k else 'lead'}(y, {abs(j - k)}) OVER w" for j in range(11))
    cases = " ".join(f"WHEN a = {k} THEN {row(k)} WHEN b = {k} THEN {row(10 - k)}" for k in range(5))
    return f"CASE WHEN a + b < 10 THEN y {cases} ELSE {row(5)} END"


PLACED = f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS a, count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY day) AS b FROM ({D})"
SMOOTH = f"SELECT *, {_cubic_sql()} AS smooth FROM ({PLACED}) WINDOW w AS (PARTITION BY event_type ORDER BY day)"
SQL["savitzky_golay"] = f"SELECT event_type, day, {rd('smooth')} AS smooth FROM ({SMOOTH})"


def shape_counts(spark, d):
    return ordered.shape_counts(daily(spark, d), ["event_type"], "day", "y")


SQL["shape_counts"] = f"""
WITH a AS (SELECT *, sign(y - avg(y) OVER (PARTITION BY event_type)) AS c, sign(y - lag(y) OVER w) AS s FROM ({D}) WINDOW w AS (PARTITION BY event_type ORDER BY day)),
b AS (SELECT *, lag(c) OVER w AS pc, lag(s) OVER w AS ps FROM a WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, count(*) FILTER (c * pc < 0) AS sign_changes, count(*) FILTER (s * ps < 0) AS extrema FROM b GROUP BY 1"""


def curvature_cdf(spark, d):
    out = ordered.curvature_cdf(daily(spark, d), ["event_type"], "day", "y")
    return out.select("event_type", "day", r(F.col("cdf"), 6).alias("cdf"))


SQL["curvature_cdf"] = f"{DERIV} SELECT event_type, day, {rd('sum(curvature) OVER (PARTITION BY event_type ORDER BY day) / sum(curvature) OVER (PARTITION BY event_type)', 6)} AS cdf FROM c"


def hourly(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.hour("ts").alias("hour")).agg(F.avg("value").alias("y"))


def dft_magnitude(spark, d):
    out = ordered.dft(hourly(spark, d), ["event_type"], "hour", "y", 12)
    return out.select("event_type", "k", r(F.col("magnitude"), 3).alias("magnitude"), r(F.col("relative"), 4).alias("relative"))


SQL["dft_magnitude"] = f"""
WITH h AS (SELECT event_type, hour(ts) AS hour, avg(value) AS y FROM events GROUP BY 1, 2),
p AS (SELECT event_type, y, (row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1)::DOUBLE AS t, (count(*) OVER (PARTITION BY event_type))::DOUBLE AS n FROM h),
v AS (SELECT *, y * (0.5 - 0.5 * cos(2 * pi() * t / nullif(n - 1, 0))) AS v FROM p),
s AS (SELECT event_type, k::INT AS k, sqrt(pow(sum(v * cos(2 * pi() * k * t / n)), 2) + pow(sum(v * sin(2 * pi() * k * t / n)), 2)) AS m FROM v, (SELECT unnest(range(12)) AS k) GROUP BY 1, 2)
SELECT event_type, k, {rd('m', 3)} AS magnitude, {rd('m / nullif(max(CASE WHEN k > 0 THEN m END) OVER (PARTITION BY event_type), 0)')} AS relative FROM s"""


def dominant_frequency(spark, d):
    out = ordered.dft(hourly(spark, d), ["event_type"], "hour", "y", 12).filter("k > 0")
    out = out.withColumn("m", r(F.col("magnitude"), 3))
    return select.top_k(out, ["event_type"], [F.desc("m"), F.asc("k")], 3).select("event_type", "rank", "k")


SQL["dominant_frequency"] = SQL["dft_magnitude"].rsplit("SELECT", 1)[0] + f", q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {rd('m', 3)} DESC, k)::INT AS rank FROM s WHERE k > 0) SELECT event_type, rank, k FROM q WHERE rank <= 3"


def stagnation_islands(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "value")
    return ordered.islands(e, ["user_id"], "ts", "value", 5)


SQL["stagnation_islands"] = """
WITH b AS (SELECT user_id, ts, min(value) OVER (PARTITION BY user_id ORDER BY ts) AS best FROM events),
f AS (SELECT *, CASE WHEN lag(best) OVER w IS NULL OR best < lag(best) OVER w THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS island FROM f)
SELECT user_id, island, min(ts) AS first, max(ts) AS last, count(*) AS length, min(best) AS best FROM i GROUP BY 1, 2 HAVING count(*) >= 5"""


def lineage_changes(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_type")
    return ordered.changes(e, ["user_id"], "ts", "event_type")


SQL["lineage_changes"] = "SELECT * FROM (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NOT NULL AND event_type <> before"


def edge_holdout(spark, d):
    """Orders split into the outer 5 % by price at either end, held out, and the rest."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ordered.edges(o, ["o_orderpriority"], ["o_totalprice", "o_orderkey"]).filter("edge").select("o_orderkey", "o_orderpriority")


SQL["edge_holdout"] = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority FROM o WHERE k <= greatest(floor(n * 0.05), 1) OR k > n - greatest(floor(n * 0.05), 1)"""


def edge_holdout_distance(spark, d):
    """The 5 % of part that lie farthest from the mean of size and price."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_retailprice") / F.lit(100.0)).alias("v"))
    return ordered.edges_by_distance(p, ["s", "v"], ["p_partkey"]).filter("edge").select("p_partkey", r(F.col("s"), 4).alias("s"))


SQL["edge_holdout_distance"] = """
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 100.0::DOUBLE AS v FROM part), m AS (SELECT avg(s) AS ms, avg(v) AS mv FROM p),
k AS (SELECT p_partkey, s, row_number() OVER (ORDER BY round(sqrt((s - ms) * (s - ms) + (v - mv) * (v - mv)), 9) DESC, p_partkey DESC) AS k, count(*) OVER () AS n FROM p, m)
SELECT p_partkey, floor(s * 10000.0 + 0.5) / 10000.0 AS s FROM k WHERE k <= greatest(floor(n * 0.05), 1)"""


def _candidates(spark, d):
    """Part brands and sizes as candidates: error and complexity stand-ins."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("complexity"), r(F.col("p_retailprice") / F.lit(10.0), 2).alias("mse"))


C = f"SELECT p_partkey AS id, p_brand AS brand, p_size AS complexity, {rd('p_retailprice / 10.0::DOUBLE', 2)} AS mse FROM part"


def pareto_front(spark, d):
    return select.pareto_front(_candidates(spark, d), "complexity", "mse").select("id", "complexity", "mse")


SQL["pareto_front"] = f"WITH c AS ({C}) SELECT id, complexity, mse FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.complexity <= c.complexity AND b.mse <= c.mse AND (b.complexity < c.complexity OR b.mse < c.mse))"


def nondominated_rank(spark, d):
    return select.ranks(_candidates(spark, d), "complexity", "mse").select("id", "complexity", "mse", "rank")


#: A row's front is the length of its longest chain of rows that dominate one another: level by level, those that some row
#: of the level before dominates.
SQL["nondominated_rank"] = f"""
WITH RECURSIVE c AS (SELECT DISTINCT complexity, mse FROM ({C})), v AS (SELECT complexity, mse, 0 AS rank FROM c UNION
  SELECT c.complexity, c.mse, b.rank FROM c JOIN (SELECT complexity, min(mse) AS mse, max(rank) + 1 AS rank FROM v GROUP BY 1) b ON b.complexity <= c.complexity AND b.mse <= c.mse AND (b.complexity < c.complexity OR b.mse < c.mse))
SELECT k.id, complexity, mse, r.rank FROM ({C}) k JOIN (SELECT complexity, mse, max(rank)::INT AS rank FROM v GROUP BY 1, 2) r USING (complexity, mse)"""


def crowding_distance(spark, d):
    out = select.crowding(_candidates(spark, d), ["mse", "complexity"], ["brand"], ["id"])
    return out.select("id", "brand", r(F.least(F.col("crowding"), F.lit(1e6)), 4).alias("crowding"))


_cr = lambda o: f"CASE WHEN lag({o}) OVER (PARTITION BY brand ORDER BY {o}, id) IS NULL OR lead({o}) OVER (PARTITION BY brand ORDER BY {o}, id) IS NULL THEN 1e18 ELSE coalesce((lead({o}) OVER (PARTITION BY brand ORDER BY {o}, id) - lag({o}) OVER (PARTITION BY brand ORDER BY {o}, id))::DOUBLE / nullif((max({o}) OVER (PARTITION BY brand) - min({o}) OVER (PARTITION BY brand))::DOUBLE, 0), 0.0) END"
SQL["crowding_distance"] = f"SELECT id, brand, {rd('least(t, 1e6)')} AS crowding FROM (SELECT id, brand, {_cr('mse')} + {_cr('complexity')} AS t FROM ({C}))"


def candidate_dedup(spark, d):
    rows = _candidates(spark, d).withColumn("signature", F.concat_ws("|", "brand", "complexity"))
    return select.best_of_each(rows.select("signature", "mse", "id"), "signature", "mse", "id")


SQL["candidate_dedup"] = f"WITH c AS (SELECT brand || '|' || complexity AS signature, mse, id FROM ({C})), k AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY mse, id) AS k FROM c) SELECT signature, mse, id FROM k WHERE k = 1"


def topk_per_group(spark, d):
    out = select.top_k(_candidates(spark, d), ["brand"], ["mse", "id"], 5)
    return out.select("brand", "rank", "id", "mse")


SQL["topk_per_group"] = f"SELECT brand, rank, id, mse FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY mse, id)::INT AS rank FROM ({C})) WHERE rank <= 5"


def diversity_ratio(spark, d):
    docs = table(spark, d, "documents")
    g = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("distinct"))
    return g.select("source", "n", "distinct", r(F.col("distinct") / F.col("n"), 6).alias("ratio"))


SQL["diversity_ratio"] = f"SELECT source, count(*) AS n, count(DISTINCT text) AS distinct, {rd('count(DISTINCT text)::DOUBLE / count(*)', 6)} AS ratio FROM documents GROUP BY 1"


def generation_stats(spark, d):
    """Per user and day as run and generation: best, mean and worst value, and the best so far."""
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.min("value").alias("best"), F.max("value").alias("worst"), F.count(F.lit(1)).alias("n"))
    so_far = F.min("best").over(Window.partitionBy("user_id").orderBy("day"))
    return e.withColumn("best_so_far", so_far)


SQL["generation_stats"] = "SELECT *, min(best) OVER (PARTITION BY user_id ORDER BY day) AS best_so_far FROM (SELECT user_id, date_trunc('day', ts) AS day, min(value) AS best, max(value) AS worst, count(*) AS n FROM events GROUP BY 1, 2)"


def schedule(spark, d):
    """Cosine temperature and decaying entropy weight of 50 generations, at the generation that each part's size stands for."""
    t = (F.col("p_size") - 1) / F.lit(49.0)
    import math

    return table(spark, d, "part").select(
        "p_partkey", r(F.lit(0.1) + F.lit(0.45) * (F.lit(1.0) + F.cos(F.lit(math.pi) * t)), 6).alias("temperature"),
        r(F.lit(0.1) * F.pow(F.lit(0.01), t), 6).alias("entropy_weight"),
    )


SQL["schedule"] = f"SELECT p_partkey, {rd('0.1::DOUBLE + 0.45::DOUBLE * (1.0::DOUBLE + cos(pi() * ((p_size - 1) / 49.0::DOUBLE)))', 6)} AS temperature, {rd('0.1::DOUBLE * pow(0.01::DOUBLE, (p_size - 1) / 49.0::DOUBLE)', 6)} AS entropy_weight FROM part"


def synthetic_samples(spark, d):
    """A curve of 31 places for each supplier, over a domain and with a parameter of its own."""
    k = F.col("s_suppkey") % 7
    rows = table(spark, d, "supplier").select("s_suppkey", (k / F.lit(2.0)).alias("a"))
    out = synthetic.curve_samples(rows, "x^2 - a*x + sin(x) + 1/(x + 3)", F.lit(-3.0), F.lit(3.0) + F.col("a"), 31)
    return out.select("s_suppkey", "pos", r(F.col("x"), 6).alias("x"), r(F.col("y"), 6).alias("y"))


SQL["synthetic_samples"] = f"""
WITH s AS (SELECT s_suppkey, s_suppkey % 7 / 2.0::DOUBLE AS a, unnest(range(31)) AS pos FROM supplier),
x AS (SELECT *, -3.0::DOUBLE + pos * ((3.0::DOUBLE + a - -3.0::DOUBLE) / 30.0::DOUBLE) AS x FROM s)
SELECT s_suppkey, pos::INT AS pos, {rd('x', 6)} AS x, {rd('pow(x, 2.0) - a * x + sin(x) + 1 / (x + 3)', 6)} AS y FROM x WHERE x + 3 <> 0"""


def curve_feature_vectors(spark, d):
    return features.curve_features(daily(spark, d), "event_type", "day", "y").select("event_type", F.size("features").alias("width"), F.transform("features", lambda v: F.round(v, 6) + F.lit(0.0)).alias("features"))


def _at(n: int, src: str, col: str) -> str:
    """SQL for a column at n even places of each curve of a table (event_type, a, n, col), linear between its places."""
    return f"""SELECT l.event_type, g.k, l.{col} + (coalesce(h.{col}, l.{col}) - l.{col}) * (g.k * (l.n - 1) / {float(n - 1)!r}::DOUBLE - l.a) AS v
  FROM (SELECT unnest(range({n})) AS k) g, {src} l LEFT JOIN {src} h ON h.event_type = l.event_type AND h.a = l.a + 1
  WHERE l.a = least(floor(g.k * (l.n - 1) / {float(n - 1)!r}::DOUBLE + 1e-12), l.n - 1)"""


_unit = "v / CASE WHEN max(abs(v)) OVER (PARTITION BY event_type) > 1e-10 THEN max(abs(v)) OVER (PARTITION BY event_type) ELSE 1.0::DOUBLE END"
_lists = lambda t, c="v": f"(SELECT list({c} ORDER BY k) FROM {t} WHERE {t}.event_type = e.event_type)"
_by = "WINDOW w AS (PARTITION BY event_type ORDER BY a)"
#: All six blocks by joins, windows and aggregates.
SQL["curve_feature_vectors"] = f"""
WITH p AS (SELECT event_type, y, a, a + b + 1 AS n, smooth FROM ({SMOOTH})),
g1 AS (SELECT *, {_g('y', 'w')} AS d FROM p {_by}), g2 AS (SELECT *, {_g('d', 'w')} AS dd FROM g1 {_by}),
share AS (SELECT event_type, a, n, y, a / (n - 1)::DOUBLE AS x, sum(1.0::DOUBLE + 5.0::DOUBLE * abs(dd) / pow(1.0::DOUBLE + d * d, 1.5)) OVER w / sum(1.0::DOUBLE + 5.0::DOUBLE * abs(dd) / pow(1.0::DOUBLE + d * d, 1.5)) OVER (PARTITION BY event_type) AS c FROM g2 {_by}),
seg AS (SELECT *, lead(c) OVER w AS c2, lead(x) OVER w AS x2, lag(c) OVER w AS c0 FROM share {_by}),
pos AS (SELECT s.event_type, s.n, k, CASE WHEN k / 127.0::DOUBLE < s.c THEN 0.0::DOUBLE WHEN c2 IS NULL THEN x ELSE x + (x2 - x) * (k / 127.0::DOUBLE - s.c) / (c2 - s.c) END AS x FROM (SELECT unnest(range(128)) AS k) t, seg s
  WHERE (s.c <= k / 127.0::DOUBLE AND (c2 IS NULL OR k / 127.0::DOUBLE < c2)) OR (c0 IS NULL AND k / 127.0::DOUBLE < s.c)),
r0 AS (SELECT o.event_type, o.k, l.y + (coalesce(h.y, l.y) - l.y) * (o.x * (o.n - 1) - l.a) AS v FROM pos o JOIN p l ON l.event_type = o.event_type AND l.a = least(floor(o.x * (o.n - 1)), o.n - 1) LEFT JOIN p h ON h.event_type = l.event_type AND h.a = l.a + 1),
raw AS (SELECT event_type, k, (v - min(v) OVER (PARTITION BY event_type)) / (max(v) OVER (PARTITION BY event_type) - min(v) OVER (PARTITION BY event_type)) AS v FROM r0),
z AS (SELECT event_type, a, n, (y - avg(y) OVER (PARTITION BY event_type)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * a / (n - 1))) AS v FROM p),
f0 AS (SELECT event_type, k, CASE WHEN 2 * k > n THEN 0.0::DOUBLE ELSE sum(v * cos(2 * pi() * k * a / n)) END AS re, CASE WHEN k = 0 OR 2 * k >= n THEN 0.0::DOUBLE ELSE 0.0::DOUBLE - sum(v * sin(2 * pi() * k * a / n)) END AS im FROM z, (SELECT unnest(range(32)) AS k) GROUP BY event_type, n, k),
f1 AS (SELECT *, sqrt(re * re + im * im) AS v FROM f0), fft AS (SELECT event_type, k, re, im, {_unit} AS v FROM f1), phase AS (SELECT event_type, k, CASE WHEN v < 0.01 THEN 0.0::DOUBLE ELSE atan2(im, re) / pi() END AS v FROM fft),
s1 AS (SELECT *, {_g('smooth', 'w')} AS d FROM p {_by}), s2 AS (SELECT *, {_g('d', 'w')} AS dd FROM s1 {_by}),
d1 AS (SELECT event_type, k, {_unit} AS v FROM ({_at(64, 's2', 'd')})), d2 AS (SELECT event_type, k, {_unit} AS v FROM ({_at(64, 's2', 'dd')})),
m AS (SELECT event_type, a, (y - avg(y) OVER (PARTITION BY event_type)) / (stddev_pop(y) OVER (PARTITION BY event_type) + 1e-10) AS v FROM p),
ms AS (SELECT *, sign(v) <> lag(sign(v)) OVER w AS c, sign(v - lag(v) OVER w) AS s FROM m {_by}), mt AS (SELECT *, s <> lag(s) OVER w AS t FROM ms {_by}),
stats AS (SELECT event_type, [0.0::DOUBLE, stddev_pop(v), min(v), max(v), median(v), avg(v * v * v) / pow(avg(v * v), 1.5), avg(v * v * v * v) / pow(avg(v * v), 2) - 3, count(*) FILTER (c), count(*) FILTER (t)] AS v FROM mt GROUP BY 1),
b0 AS (SELECT event_type, a, n, sum(y) OVER (PARTITION BY event_type ORDER BY a ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE AS y FROM p), b1 AS (SELECT *, {_g('y', 'w')} AS d FROM b0 {_by}), b2 AS (SELECT *, {_g('d', 'w')} AS dd FROM b1 {_by}),
b3 AS (SELECT event_type, a, n, dd / pow(1.0::DOUBLE + d * d, 1.5) AS q FROM b2), curv AS (SELECT event_type, k, {_unit} AS v FROM ({_at(32, 'b3', 'q')})),
ct AS (SELECT *, sign(v) <> lag(sign(v)) OVER (PARTITION BY event_type ORDER BY k) AS c FROM curv), cs AS (SELECT event_type, [avg(v), stddev_pop(v), min(v), max(v), count(*) FILTER (c)] AS v FROM ct GROUP BY 1)
SELECT e.event_type, 366 AS width, list_transform({_lists('raw')} || {_lists('fft')} || {_lists('phase')} || {_lists('d1')} || {_lists('d2')} || stats.v || {_lists('curv')} || cs.v, lambda v: round(v, 6) + 0.0) AS features
FROM (SELECT DISTINCT event_type FROM p) e JOIN stats USING (event_type) JOIN cs USING (event_type)"""


def evolve_islands(spark, d):
    return search.islands(sales(spark, d), ["x0", "x1"], "y", 4, 2, 8).select("config_id", "formula", F.round("mse", 8).alias("mse"), "size")


def seed_search(spark, d):
    configs = spark.range(4).select(F.col("id").cast("int").alias("config_id"), (F.col("id") + 42).cast("int").alias("seed"))
    found = search.search(sales(spark, d), ["x0", "x1"], "y", configs, 10)
    return select.top_k(found, ["config_id"], ["mse", "size", "formula"], 1).select("config_id", "formula", F.round("mse", 8).alias("mse"), "size")


QUERIES = {n: f for n, f in list(globals().items()) if n in SQL or n in ("evolve_islands", "seed_search")}
