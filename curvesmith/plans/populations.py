"""Queries over populations, splits and the shapes of curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.safe import rounded as r
from ..operators import basis, gram, population, select
from ..sources.tables import sales, table
from .fitting import S, rd

SQL: dict[str, str] = {}
_u = lambda *c: f"((('0x' || substr(md5(concat_ws('|', {', '.join(c)})), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)"


def _people(spark, d):
    """Orders as individuals: customers are runs, prices the fitness, every fifth key an explorer."""
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_orderkey") % 5 == 0).alias("explorer"))


P = "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, o_orderkey % 5 = 0 AS explorer FROM orders"


def explorer_migration(spark, d):
    """Runs after the migration of their best explorers."""
    return population.migrated(_people(spark, d), ["o_custkey"], "explorer", "o_totalprice", "o_orderkey")


SQL["explorer_migration"] = f"""
WITH p AS ({P}), e AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM p WHERE explorer),
m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS w, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM p WHERE NOT explorer),
x AS (SELECT m.*, e.o_orderkey AS ek, e.o_totalprice AS ef, e.o_orderstatus AS es, coalesce(e.o_totalprice < m.best AND w <= least(3, n // 4), false) AS migrant FROM m LEFT JOIN e ON e.o_custkey = m.o_custkey AND e.k = 1)
SELECT o_custkey, CASE WHEN migrant THEN ek ELSE o_orderkey END AS o_orderkey, CASE WHEN migrant THEN ef ELSE o_totalprice END AS o_totalprice, CASE WHEN migrant THEN es ELSE o_orderstatus END AS o_orderstatus, migrant FROM x"""


def mass_mutation(spark, d):
    """Fates of all individuals of runs by the diversity of their order states."""
    return population.mass_mutation(_people(spark, d), ["o_custkey"], "o_orderstatus", "o_totalprice", "o_orderkey").groupBy("o_custkey", "fate").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


SQL["mass_mutation"] = f"""
WITH k AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1),
p AS (SELECT o_custkey, o_orderkey, kinds, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders JOIN k USING (o_custkey))
SELECT o_custkey, CASE WHEN kinds >= 3 THEN 'kept' WHEN place <= 2 THEN 'elite' WHEN {_u("'fate'", "'0'", 'o_custkey', 'o_orderkey')} < 0.5 THEN 'fresh' ELSE 'mutant' END AS fate, count(*) AS n, min(o_orderkey) AS first FROM p GROUP BY 1, 2"""


def weighted_draws(spark, d):
    """Twenty parts of each brand, drawn by price without replacement."""
    return population.drawn(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", "p_partkey", 20)


SQL["weighted_draws"] = f"SELECT p_brand, p_partkey, p_retailprice, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY -ln({_u(repr('draw'), repr('0'), 'p_brand', 'p_partkey')}) / p_retailprice, p_partkey)::INT AS place FROM part WHERE p_retailprice > 0) WHERE place <= 20"


def decoded_skeletons(spark, d):
    """Event types of each user as skeletons with their mean values as logits: the three likeliest."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") / F.lit(50.0)).alias("logit"))
    return population.decoded(e, ["user_id"], "event_type", "logit", 3).select("user_id", "event_type", r(F.col("probability"), 6).alias("probability"), r(F.col("score"), 6).alias("score"), "rank")


SQL["decoded_skeletons"] = f"""
WITH e AS (SELECT user_id, event_type, avg(value) / 50.0::DOUBLE AS l FROM events GROUP BY 1, 2), p AS (SELECT user_id, event_type, exp(l) / sum(exp(l)) OVER (PARTITION BY user_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY l DESC, event_type)::INT AS rank FROM e)
SELECT user_id, event_type, {rd('p', 6)} AS probability, {rd('1.0::DOUBLE - p', 6)} AS score, rank FROM p WHERE rank <= 3"""


def stratified_split(spark, d):
    """A fifth of the documents of each quality and toxicity held out."""
    return population.stratified(table(spark, d, "labels").select("doc_id", "quality", "toxic"), ["quality", "toxic"], "doc_id").select("doc_id", "held_out")


SQL["stratified_split"] = f"""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY {_u("'split'", "'0'", 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels)
SELECT doc_id, k <= floor(n * 0.2::DOUBLE + 0.5) AS held_out FROM l"""


def mirrored_terms(spark, d):
    """Terms that are another's copy but for scale and offset."""
    x = {c: F.col(c) for c in ("x0", "x1", "x2")}
    terms = {**x, "2*x0+1": x["x0"] * 2.0 + 1.0, "-x1": -x["x1"], "x2^2": x["x2"] * x["x2"], "3": F.lit(3.0) + x["x0"] * 0.0, "3b": F.lit(3.0) + x["x1"] * 0.0, "4": F.lit(4.0) + x["x1"] * 0.0}
    return spark.createDataFrame(list(population.mirrored(sales(spark, d), terms).items()), "term string, first string")


SQL["mirrored_terms"] = f"""
WITH s AS ({S}), t AS (SELECT row_number() OVER () AS id, * FROM s), u AS (SELECT id, unnest([0,1,2,3,4,5,6,7,8]) AS k, unnest(['x0','x1','x2','2*x0+1','-x1','x2^2','3','3b','4']) AS term, unnest([x0, x1, x2, x0 * 2.0 + 1.0, -x1, x2 * x2, 3, 3, 4]::DOUBLE[]) AS v FROM t),
c AS (SELECT b.term, b.k, a.term AS other, a.k AS ok, (max(a.v) > min(a.v) AND max(b.v) > min(b.v) AND abs(covar_pop(a.v, b.v)) > 0.9999 * stddev_pop(a.v) * stddev_pop(b.v)) OR (max(a.v) = min(a.v) AND max(b.v) = min(b.v) AND max(a.v) = max(b.v)) AS same FROM u a JOIN u b ON a.id = b.id AND a.k <= b.k GROUP BY ALL)
SELECT term, arg_min(other, ok) AS first FROM c WHERE coalesce(same, false) OR term = other GROUP BY 1"""


def polynomial_degree(spark, d):
    """Lines by number as curves over quantity: polynomials of the number's degree, but for the seventh, a sine."""
    n, t = F.col("l_linenumber"), F.col("l_quantity") / F.lit(50.0)
    y = F.when(n == 7, F.sin(t * 9.0)).otherwise(F.lit(3.0) + t - F.lit(2.0) * F.pow(t, n.cast("double")))
    rows = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", y.alias("y"))
    return population.polynomial_degree(rows, ["l_linenumber"], "l_quantity", "y").select("l_linenumber", F.when(F.col("polynomial") | (F.col("degree") < 2), F.col("degree")).alias("degree"), "polynomial")


#: The degrees that the curves were made with.
SQL["polynomial_degree"] = "SELECT l_linenumber, CASE WHEN l_linenumber < 7 THEN l_linenumber END AS degree, l_linenumber BETWEEN 2 AND 6 AS polynomial FROM (SELECT DISTINCT l_linenumber FROM lineitem)"

#: Formulas: one spelling, without weak harmonics, and classes of operators.
FORMULAS = {
    "x + x": ("2*x", "2*x", ["addition", "identity"]),
    "2*x": ("2*x", "2*x", ["identity", "multiplication"]),
    "sin(x)^2 + cos(x)^2": ("1", "1", ["addition", "cos", "identity", "power", "sin"]),
    "3*sin(2*x) + 0.05*cos(5*x)": ("0.05*cos(5*x) + 3*sin(2*x)", "3*sin(2*x)", ["addition", "cos", "identity", "multiplication", "sin"]),
    "3*sin(2*x) + 2*cos(5*x)": ("2*cos(5*x) + 3*sin(2*x)", "2*cos(5*x) + 3*sin(2*x)", ["addition", "cos", "identity", "multiplication", "sin"]),
    "1/(x^2 + 1)": ("1/(x^2 + 1)", "1/(x^2 + 1)", ["addition", "identity", "power", "rational"]),
    "sqrt(x)/2": ("0.5*sqrt(x)", "0.5*sqrt(x)", ["identity", "multiplication", "power"]),
    "tanh(x)": ("tanh(x)", "tanh(x)", ["exp", "identity", "rational"]),
    "exp(x": (None, None, []),
}


def formula_classes(spark, d):
    """Customers with one of the formulas each: its spelling, its tone, the classes it shares with a prediction and the
    ones it lacks."""
    pick = F.element_at(F.array(*map(F.lit, FORMULAS)), (F.col("c_custkey") % len(FORMULAS) + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", pick.alias("f")).withColumn("classes", text.classes(F.col("f")))
    guess = F.array(F.lit("addition"), F.lit("exp"), F.lit("identity"))
    rows = rows.select("c_custkey", text.canonical(F.col("f")).alias("spelling"), text.one_tone(F.col("f")).alias("tone"), F.array_join(F.array_sort(F.array_union("classes", guess)), ",").alias("either"), F.array_join(F.array_except(guess, "classes"), ",").alias("lacking"))
    return rows.groupBy("spelling", "tone", "either", "lacking").agg(F.count(F.lit(1)).alias("n"))


_sql = lambda v: "NULL" if v is None else "'" + v + "'"
_guess = ("addition", "exp", "identity")
_rows = ", ".join(f"({i}, {_sql(a)}, {_sql(b)}, {_sql(','.join(sorted({*c, *_guess})))}, {_sql(','.join(g for g in _guess if g not in c))})" for i, (a, b, c) in enumerate(FORMULAS.values()))
SQL["formula_classes"] = f"SELECT spelling, tone, either, lacking, count(*) AS n FROM customer JOIN (VALUES {_rows}) f(i, spelling, tone, either, lacking) ON c_custkey % {len(FORMULAS)} = i GROUP BY ALL"


def formula_dedup(spark, d):
    """Parts as candidates with formulas: the best of each that simplify to the same."""
    pick = F.element_at(F.array(*map(F.lit, FORMULAS)), (F.col("p_partkey") % len(FORMULAS) + 1).cast("int"))
    rows = table(spark, d, "part").select(text.canonical(pick).alias("spelling"), "p_retailprice", "p_partkey")
    return select.best_of_each(rows, "spelling", "p_retailprice", "p_partkey")


SQL["formula_dedup"] = f"SELECT spelling, p_retailprice, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY p_retailprice, p_partkey) AS k FROM part JOIN (VALUES {_rows}) f(i, spelling, tone, either, lacking) ON p_partkey % {len(FORMULAS)} = i) WHERE k = 1"


def backward_prune(spark, d):
    """Terms left of a fit of the planted target with a hundredth of a percent of x2, by pruning."""
    rows = sales(spark, d).withColumn("y", F.col("y") + F.lit(0.0001) * F.col("x2"))
    x = {"x0": F.col("x0"), "x1": F.col("x1"), "x2": F.col("x2"), "x0*x1": F.col("x0") * F.col("x1")}
    s = gram.gram(basis.project(rows, [basis.Term(k, "", v) for k, v in x.items()], F.col("y")), len(x))
    f = gram.backward_prune(s, gram._fit(s, range(len(x)), "all"), tolerance=2.0)
    return spark.createDataFrame([(list(x)[t], float(round(w, 4))) for t, w in zip(f.terms, f.weights)], "term string, weight double")


#: What the target was made with.
SQL["backward_prune"] = "SELECT unnest(['x0', 'x2', 'x0*x1']) AS term, unnest([1.0, 0.0001, -1.0]::DOUBLE[]) AS weight"

QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
