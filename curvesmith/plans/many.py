"""Queries over slices of several inputs, fits of many curves, and cleaning of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import graph
from ..functions.safe import rounded as r
from ..operators import batched, cleanup, diagnostics, routing, slices
from ..sources.tables import sales, table
from .fitting import S, rd

SQL: dict[str, str] = {}
THRESHOLDS = [round(0.05 * k, 2) for k in range(1, 20)]
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def input_slices(spark, d):
    """A slice of 256 places for each of three inputs of lineitem, each place with its nearest row of all."""
    out = slices.slices(sales(spark, d), ["x0", "x1", "x2"], "y", TIE)
    return out.select("input", "pos", r(F.col("x"), 6).alias("x"), r(F.col("y"), 6).alias("y"), r(F.col("distance"), 6).alias("distance"), *TIE)


#: Every place against every row.
SQL["input_slices"] = f"""
WITH s AS ({S}), m AS (SELECT min(x0) AS a0, max(x0) AS b0, median(x0) AS m0, min(x1) AS a1, max(x1) AS b1, median(x1) AS m1, min(x2) AS a2, max(x2) AS b2, median(x2) AS m2 FROM s),
p AS (SELECT 'x0' AS input, k, a0 + k * ((b0 - a0) / 255) AS x, a0 + k * ((b0 - a0) / 255) AS q0, m1 AS q1, m2 AS q2 FROM m, (SELECT unnest(range(256)) AS k)
  UNION ALL SELECT 'x1', k, a1 + k * ((b1 - a1) / 255), m0, a1 + k * ((b1 - a1) / 255), m2 FROM m, (SELECT unnest(range(256)) AS k)
  UNION ALL SELECT 'x2', k, a2 + k * ((b2 - a2) / 255), m0, m1, a2 + k * ((b2 - a2) / 255) FROM m, (SELECT unnest(range(256)) AS k)),
n AS (SELECT input, k, x, min(ROW((x0 - q0) * (x0 - q0) + (x1 - q1) * (x1 - q1) + (x2 - q2) * (x2 - q2), l_orderkey, l_linenumber, l_partkey, l_suppkey, y)) AS b FROM p, s GROUP BY ALL)
SELECT input, k::INT AS pos, {rd('x', 6)} AS x, {rd('b[6]', 6)} AS y, {rd('sqrt(b[1])', 6)} AS distance, b[2] AS l_orderkey, b[3] AS l_linenumber, b[4] AS l_partkey, b[5] AS l_suppkey FROM n"""


def user_curves(spark, d):
    """A cubic over time for the values of each user: all users' normal equations from one aggregate, solved in batches."""
    x = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(864e9)
    e = table(spark, d, "events").select("user_id", x.alias("x"), "value")
    out = batched.fit_each(e, ["user_id"], batched.pure_terms(F.col("x"), {"power"}), "value")
    return out.select("user_id", "n", *[r(F.get("weights", F.lit(k)), 3).alias(f"w{k}") for k in range(4)], r(F.col("mse"), 3).alias("mse"))


_minor = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]}) + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"
_g = [["g00", "g01", "g02"], ["g01", "g11", "g12"], ["g02", "g12", "g22"]]
_c = ["c0", "c1", "c2"]
_det = _minor(*_g)
_w = [_minor(*[_c if i == k else _g[i] for i in range(3)]) for k in range(3)]
#: Centred normal equations by Cramer's rule.
SQL["user_curves"] = f"""
WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 864e9::DOUBLE AS a, value AS y FROM events), p AS (SELECT *, a * a AS b, a * a * a AS c FROM e),
m AS (SELECT user_id, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, count(*) AS n FROM p GROUP BY 1),
g AS (SELECT user_id, n, ma, mb, mc, my, sum((a - ma) * (a - ma)) AS g00, sum((a - ma) * (b - mb)) AS g01, sum((a - ma) * (c - mc)) AS g02, sum((b - mb) * (b - mb)) AS g11,
  sum((b - mb) * (c - mc)) AS g12, sum((c - mc) * (c - mc)) AS g22, sum((a - ma) * (y - my)) AS c0, sum((b - mb) * (y - my)) AS c1, sum((c - mc) * (y - my)) AS c2 FROM p JOIN m USING (user_id) GROUP BY ALL),
w AS (SELECT user_id, n, ma, mb, mc, my, CASE WHEN n >= 4 THEN {_w[0]} / {_det} END AS w0, CASE WHEN n >= 4 THEN {_w[1]} / {_det} END AS w1, CASE WHEN n >= 4 THEN {_w[2]} / {_det} END AS w2 FROM g),
z AS (SELECT *, my - w0 * ma - w1 * mb - w2 * mc AS w3 FROM w), q AS (SELECT user_id, avg(pow(y - w0 * a - w1 * b - w2 * c - w3, 2)) AS mse FROM p JOIN z USING (user_id) GROUP BY 1)
SELECT user_id, n, {', '.join(f"{rd(f'w{k}', 3)} AS w{k}" for k in range(4))}, {rd('mse', 3)} AS mse FROM z JOIN q USING (user_id)"""


def graph_dead_nodes(spark, d):
    """A graph of six nodes for each part, wired and weighted by its key: what is left of it, and its children's new places."""
    k = F.col("p_partkey").cast("int")
    none = F.lit(None).cast("int")
    wire = [(none, none), (none, none), (F.lit(0), none), (k % 3, k % 2 + 1), (k % 4, none), (k % 5, k % 3)]
    nodes = F.array(*[F.struct(a.cast("int").alias("left"), b.cast("int").alias("right")) for a, b in wire])
    weights = F.array(*[F.when(F.shiftright(k, i) % 2 == 1, F.lit(0.5) * (i + 1)).otherwise(F.lit(1e-9)) for i in range(6)])
    out = cleanup.without_dead(table(spark, d, "part").select("p_partkey", nodes.alias("nodes"), weights.alias("weights")))
    child = lambda side: F.array_join(F.transform("nodes", lambda x: F.coalesce(x[side].cast("string"), F.lit("-"))), ",")
    return out.select("p_partkey", F.array_join(F.transform("live", lambda i: i.cast("string")), ",").alias("live"), child("left").alias("lefts"), child("right").alias("rights"))


#: Reachability by a recursive query over the nodes of all graphs.
SQL["graph_dead_nodes"] = """
WITH RECURSIVE n AS (SELECT p_partkey, i, CASE i WHEN 2 THEN 0 WHEN 3 THEN p_partkey % 3 WHEN 4 THEN p_partkey % 4 WHEN 5 THEN p_partkey % 5 END AS l,
  CASE i WHEN 3 THEN p_partkey % 2 + 1 WHEN 5 THEN p_partkey % 3 END AS r, (p_partkey >> i) % 2 = 1 AS heavy FROM part, (SELECT unnest(range(6)) AS i)),
live AS (SELECT p_partkey, i FROM n WHERE heavy UNION SELECT n.p_partkey, c FROM (SELECT n.p_partkey, unnest([l, r]) AS c FROM live JOIN n USING (p_partkey, i)) n WHERE c IS NOT NULL),
k AS (SELECT p_partkey, i, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS at FROM live),
m AS (SELECT n.p_partkey, n.i, coalesce(a.at::VARCHAR, '-') AS l, coalesce(b.at::VARCHAR, '-') AS r FROM n JOIN k USING (p_partkey, i) LEFT JOIN k a ON a.p_partkey = n.p_partkey AND a.i = n.l LEFT JOIN k b ON b.p_partkey = n.p_partkey AND b.i = n.r)
SELECT p.p_partkey, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i), '') AS live, coalesce(string_agg(l, ',' ORDER BY i), '') AS lefts, coalesce(string_agg(r, ',' ORDER BY i), '') AS rights FROM part p LEFT JOIN m USING (p_partkey) GROUP BY 1"""


def graph_cleanup(spark, d):
    """Graphs of the nations, each with a repeated node, one without use and crooked weights, cleaned by the sums of their
    nodes over all of lineitem: one pass for all. The target is 2 x0 + 3 sin(x2) - 1 with a little of the tax as noise."""
    keys = [row[0] for row in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # a row a nation
    rows = sales(spark, d).withColumn("y", 2.0 * F.col("x0") + 3.0 * F.sin("x2") - 1.0 + (F.col("x1") - 0.05))
    node = graph.node
    made = [{
        "nodes": [node("input", feature=0), node("input", feature=1), node("unary", op="periodic", left=1), node("unary", op="periodic", left=1, amplitude=1.0 + k % 5), node("unary", op="exp", left=0, omega=-0.01 * (1 + k % 3)), node("binary", op="division", left=0, right=1)],
        "weights": [1.5 + 0.01 * k, 0.0, 1.0, 2.0, 1e-9, 0.0], "bias": 0.1 * k,
    } for k in keys]
    out = cleanup.clean_population(rows, ["x0", "x2"], "y", made)
    shown = [(k, len(g["nodes"]), *[round(w, 4) for w in g["weights"]], round(g["bias"], 2), after) for k, (g, _, after) in zip(keys, out, strict=True)]
    return spark.createDataFrame(shown, "n_nationkey int, n_nodes int, w0 double, w1 double, w2 double, bias double, mse double").withColumn("mse", r(F.col("mse"), 6))


#: The target's own weights, on the inputs and the first of the equal nodes, and the noise that no weight takes up.
SQL["graph_cleanup"] = f"SELECT n_nationkey, 3 AS n_nodes, 2.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 3.0::DOUBLE AS w2, -1.0::DOUBLE AS bias, {rd('(SELECT avg(pow(x1 - 0.05::DOUBLE, 2)) FROM (' + S + '))', 6)} AS mse FROM nation"


def trusted_priors(spark, d):
    """Each user's shares of event types as priors, blended with even shares by what their entropy and lead deserve."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sure = diagnostics.entropy_margin(n, ["user_id"], "event_type", "n")
    trust = sure.withColumn("trust", routing.prior_trust(F.col("entropy"), F.col("margin"), F.col("uncertain")))
    w = Window.partitionBy("user_id")
    own = n.withColumns({"prior": F.col("n") / F.sum("n").over(w), "k": F.count(F.lit(1)).over(w)})
    prior = routing.blended_prior(F.col("prior"), F.col("trust"), F.col("k"))
    return own.join(trust, "user_id").select("user_id", "event_type", r(F.col("trust"), 6).alias("trust"), r(prior, 6).alias("prior"))


SQL["trusted_priors"] = f"""
WITH n AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM n),
e AS (SELECT user_id, CASE WHEN max(k) > 1 THEN sum(-p * ln(p + 1e-12)) / ln(max(k)::DOUBLE) ELSE 0 END AS entropy, max(p) FILTER (place = 1) - coalesce(max(p) FILTER (place = 2), 0) AS margin FROM p GROUP BY 1),
t AS (SELECT user_id, least(least(greatest(1 - entropy, 0), 1), least(greatest(margin / 0.35::DOUBLE, 0), 1)) * CASE WHEN entropy > 0.8 OR margin < 0.1 THEN 0.5 ELSE 1 END AS trust FROM e)
SELECT user_id, event_type, {rd('trust', 6)} AS trust, {rd('trust * p + (1 - trust) / k', 6)} AS prior FROM p JOIN t USING (user_id)"""


def residual_spectra(spark, d):
    """How far the strongest frequency of each user's values stands out of the spectrum, by order of events."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    out = diagnostics.spectral_peaks(e, ["user_id"], "event_id", "value")
    return out.select("user_id", "n", r(F.col("peak_ratio"), 4).alias("peak_ratio"), "structured")


SQL["residual_spectra"] = f"""
WITH e AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT user_id, n, m, sqrt(pow(sum(v * cos(2 * pi() * ((k * m) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * m) % n) / n)), 2)) AS size
  FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS m FROM e WHERE n >= 10) GROUP BY ALL),
p AS (SELECT user_id, max(size) / greatest(median(size), 1e-12) AS ratio FROM m GROUP BY 1)
SELECT user_id, n, {rd('ratio')} AS peak_ratio, coalesce(ratio > 8, false) AS structured FROM (SELECT DISTINCT user_id, n FROM e) LEFT JOIN p USING (user_id)"""


def best_thresholds(spark, d):
    """For each source of documents the threshold of their length score that tells quality best."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "n_chars"), table(spark, d, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id").withColumn("score", F.least(F.col("n_chars") / F.lit(10000.0), F.lit(1.0)))
    out = diagnostics.best_threshold(rows, ["source"], "quality", "score", THRESHOLDS)
    return out.select("source", "threshold", r(F.col("f1"), 6).alias("f1"), "positive")


SQL["best_thresholds"] = f"""
WITH s AS (SELECT source, quality, least(n_chars / 10000.0::DOUBLE, 1.0::DOUBLE) AS score FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest({THRESHOLDS!r}::DOUBLE[]) AS threshold),
c AS (SELECT source, threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp, count(*) FILTER (score >= threshold) AS over, count(*) FILTER (quality = 1) AS positive FROM s, t GROUP BY ALL),
f AS (SELECT *, coalesce(2 * tp / nullif((over + positive)::DOUBLE, 0), 0) AS f1 FROM c)
SELECT source, arg_max(threshold, (f1, -threshold)) AS threshold, {rd('max(f1)', 6)} AS f1, max(positive) AS positive FROM f GROUP BY 1"""

QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
