import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from curvesmith.operators import basis, gram, nonlinear, refine, spectrum
from curvesmith.plans import refinement, staged
from curvesmith.sources.tables import sales


def line(spark, n=400, lo=-5.0, hi=5.0, **y):
    x = F.lit(lo) + F.col("id") * F.lit((hi - lo) / (n - 1))
    return spark.range(n).select("id", x.alias("x")).select("id", "x", *[c.alias(k) for k, c in y.items()])


def at():
    return F.col("x")


@pytest.mark.parametrize("shape, p", [(nonlinear.powers(2, (1.5,)), [0.7, 2.4]), (nonlinear.periodic_rational(), [2.0, 1.3]), (nonlinear.waves(2), [1.1, 2.7])])
def test_derivatives_of_shapes(shape, p):
    x, p = np.linspace(-3, 4, 40), np.array(p)
    cols, slopes = shape.columns(x, p)
    assert len(shape.terms(p, "x")) == len(cols)
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = 1e-6
        up, down = shape.columns(x, p + e)[0], shape.columns(x, p - e)[0]
        want = {j: (a - b) / 2e-6 for j, (a, b) in enumerate(zip(up, down, strict=True)) if not np.allclose(a, b, atol=1e-12)}
        got = {j: v for j, q, v in slopes if q == k}
        assert set(want) <= set(got)
        for j, v in want.items():
            assert np.allclose(got[j], v, rtol=1e-4, atol=1e-5)


def test_terms_evaluate_to_columns(spark):
    from curvesmith.functions import expr

    x = np.linspace(0.1, 4, 30)
    for shape, p in ((nonlinear.powers(2), np.array([2.0, 1.7])), (nonlinear.periodic_rational(), np.array([2.0, 1.5])), (nonlinear.waves(1), np.array([1.25]))):
        for text, col in zip(shape.terms(p, "x"), shape.columns(x, p)[0], strict=True):
            assert np.allclose(expr.to_numpy(expr.parse(text), {"x": x}), col, rtol=1e-6, atol=1e-8)


def test_powers_on_both_sides_of_zero(spark):
    rows = line(spark, y=F.lit(1.5) * F.signum(at()) * F.pow(F.abs(at()), F.lit(3.0)) - 2.0 * at() + 1.0)
    t = nonlinear.refine_powers(rows, "x", "y", most=1)[0]
    assert abs(t.p[0] - 3) < 1e-3 and t.mse < 1e-8


def test_two_powers_at_once(spark):
    rows = line(spark, lo=0.2, y=F.lit(2.0) * F.pow(at(), F.lit(0.4)) + F.lit(0.5) * F.pow(at(), F.lit(2.6)))
    best = nonlinear.refine_powers(rows, "x", "y")
    two = next(t for t in best if len(t.p) == 2)
    assert np.allclose(sorted(two.p), [0.4, 2.6], atol=0.02) and two.mse < 1e-9


def test_rows_that_do_not_count(spark):
    nan = float("nan")
    rows = line(spark, y=F.lit(2.0) * F.sin(1.7 * at()) + 1.0).unionByName(spark.createDataFrame([(0, None, 1.0), (1, nan, 2.0), (2, 1.0, None), (3, 2.0, nan), (4, float("inf"), 1.0)], "id long, x double, y double"))
    t = nonlinear.refine(rows, "x", "y", [(nonlinear.waves(1), np.array([1.5]))])[0]
    assert t.n == 400 and abs(t.p[0] - 1.7) < 1e-6
    assert nonlinear.refine(rows.limit(0), "x", "y", [(nonlinear.waves(1), np.array([1.5]))]) == []
    assert nonlinear.refine(line(spark, 4, y=at() * 2), "x", "y", [(nonlinear.waves(1), np.array([1.5]))]) == []  # fewer rows than unknowns


def test_folds_equal_their_rows(spark):
    rows = sales(spark, DATA).withColumn("fold", F.pmod(F.col("l_orderkey"), F.lit(3)))
    terms = basis.catalog({c: F.col(c) for c in ("x0", "x1")}, 2, families={"power", "product"})
    p = basis.project(rows, terms, F.col("y"), ("fold",))
    got = p.toPandas()
    a = np.column_stack([np.vstack(got["b"].to_numpy()), got["y"], np.ones(len(got))])
    sums = gram.fold_sums(p, len(terms), "fold")
    assert sorted(sums) == [0, 1, 2]
    for f, s in sums.items():
        own = a[got["fold"] == f]
        assert np.allclose(s.a, own.T @ own) and s.n == len(own)
        assert math.isclose(s.variance(), own[:, -2].var(), rel_tol=1e-6)
    # in two steps: what is known is not made again
    first = gram.fold_sums(basis.project(rows, terms[:5], F.col("y"), ("fold",)), 5, "fold")
    made = gram.partial(p, len(terms), "fold", 5).select("i", "j").distinct().collect()
    assert min(r.i for r in made) == 5
    for f, s in gram.bordered(p, len(terms), "fold", first).items():
        assert np.allclose(s.a, sums[f].a)


def test_fold_fits_equal_least_squares(spark):
    rows = sales(spark, DATA).withColumn("fold", F.pmod(F.col("l_orderkey"), F.lit(4)))
    terms = [basis.Term("1", "", F.lit(1.0)), *[basis.Term(c, "", F.col(c)) for c in ("x0", "x1", "x2")]]
    p = basis.project(rows, terms, F.col("y"), ("fold",))
    got = p.toPandas()
    b, y, fold = np.vstack(got["b"].to_numpy()), got["y"].to_numpy(), got["fold"].to_numpy()
    for f, (w, mse, r2) in gram.fold_fits(gram.fold_sums(p, 4, "fold"), range(4)).items():
        want = np.linalg.lstsq(b[fold != f], y[fold != f], rcond=None)[0]
        left = y[fold == f] - b[fold == f] @ want
        assert np.allclose(w, want, rtol=1e-6) and math.isclose(mse, float(left @ left) / len(left), rel_tol=1e-6)
        assert math.isclose(r2, 1 - mse / y[fold == f].var(), rel_tol=1e-6)


def test_guard():
    assert staged.guard([0.99, 0.985, 1.0], 100) == (True, "ok")
    assert staged.guard([0.99, 0.5, 1.0], 100) == (False, "unstable_fold_performance")
    assert staged.guard([0.1, 0.2, 0.3], 44) == (True, "insufficient_samples")
    assert staged.guard([], 100) == (False, "no_valid_folds")


def test_what_replaces_what():
    s = lambda error, n: staged.Stage("s", "f", error, n, error=error)
    assert staged.replaces(s(0.1, 3), None) and not staged.replaces(s(float("nan"), 3), None)
    assert staged.replaces(s(0.05, 4), s(0.1, 4)) and not staged.replaces(s(0.1, 4), s(0.1, 4))
    assert not staged.replaces(s(1e-4, 4), s(1e-5, 20))  # ten times the error of what is good already
    assert staged.replaces(s(9e-7, 5), s(1e-7, 9))  # exact, and much simpler


def test_stages_of_one_input(spark):
    rows = line(spark, 600, y=F.lit(1.5) * F.sin(2.35 * at()) / (at() * at() + 1.3) + 0.4 * at())
    m = staged.StagedRegressor(max_power=2).fit(rows, ["x"], "y")
    names = [s.stage for s in m.stages]
    assert names[:2] == ["minimal", "universal"] and names[-1] == "quotient" and m.stages[-1].accepted
    assert m.mse < 1e-8 and m.stable and len(m.folds) == 3
    left = rows.select(F.max(F.abs(m.column() - F.col("y")))).first()[0]
    assert left < 1e-3


def test_stage_that_ends_it(spark):
    m = staged.StagedRegressor().fit(sales(spark, DATA), ["x0", "x1", "x2"], "y")
    assert m.formula == "-x0*x1 + x0" and [s.stage for s in m.stages] == ["minimal"] and m.stages[0].edge_mse < 1e-6
    m = staged.StagedRegressor().fit(sales(spark, DATA).withColumn("y", F.lit(3.0) * F.sqrt(F.col("x0") * F.col("x0") + F.col("x2") * F.col("x2"))), ["x0", "x2"], "y")
    assert m.stages[0].stage == "template" and m.formula == "3*(sqrt(x0^2 + x2^2))"


def test_constraints_keep_stages_out(spark):
    rows = line(spark, 300, y=F.sin(3.0 * at()))
    m = staged.StagedRegressor(max_power=2, constraints={"periodic": False}).fit(rows, ["x"], "y")
    assert all("sin" not in s.formula and "cos" not in s.formula or "exp" in s.formula for s in m.stages) and not {"waves", "quotient", "frequencies"} & {s.stage for s in m.stages}


def test_empty_table_has_no_fit(spark):
    m = staged.StagedRegressor(max_power=1).fit(line(spark, 5, y=at()).limit(0), ["x"], "y")
    assert m.formula == "0" and not m.stable and m.reason == "no_fit"


def test_ratios_of_just_a_twentieth_are_told_as_in_sql():
    k, found = np.arange(1024), set()
    for step in np.linspace(0.03, 0.04, 60):
        w = [2 * math.pi * m / (4096 * step) for m in (400, 820)]
        apart = abs(w[1] / w[0] - 2) > 0.05  # 2.05 but for rounding
        got = spectrum.peaks(np.sin(2 * np.pi * 400 / 4096 * k) + 0.5 * np.sin(2 * np.pi * 820 / 4096 * k), step, 2)
        assert got == (w if apart else w[:1])
        found.add(apart)
    assert found == {False, True}


def test_frequencies_of_uneven_curves(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, w in enumerate((2.0, 7.3)):
        x = np.sort(rng.uniform(0, 20, 500))
        rows += [(k, float(a), float(math.sin(w * a) + 0.4 * math.sin(2 * w * a) + 0.1 * k)) for a in x]
    rows += [(2, float(i), 1.0) for i in range(5)] + [(3, 1.0, float(i)) for i in range(20)] + [(4, None, 1.0), (5, float("nan"), 2.0)]
    curves = spark.createDataFrame(rows, "k long, x double, y double").repartition(7)
    got = {r.k: r for r in spectrum.frequencies(curves, ["k"], "x", "y").collect()}
    assert set(got) == {0, 1}  # too few points, or all at one place
    for k, w in enumerate((2.0, 7.3)):
        assert abs(got[k].omegas[0] - w) < 0.05 and all(abs(o / w - 2) > 0.05 for o in got[k].omegas)  # no harmonic
    one = curves.filter("k = 0")
    assert spectrum.dominant(one, "x", "y") == tuple(got[0].omegas)
    # the first and last point of each cell give the same values as all points
    x, y = (np.array([r[i] for r in rows if r[0] == 0]) for i in (1, 2))
    assert np.allclose(spectrum.peaks(spectrum.on_grid(x, y), (x[-1] - x[0]) / 1023, 3), got[0].omegas)


def test_projection_is_compiled_apart(spark):
    plan = basis.project(sales(spark, DATA), basis.catalog({"x0": F.col("x0")}, 2), F.col("y"))._jdf.queryExecution().executedPlan().toString()
    top = next(x for x in plan.splitlines() if "Project" in x)
    assert "*(" not in top  # in no stage's own method


def test_registered():
    assert set(refinement.SQL) == set(refinement.QUERIES) and len(refinement.SQL) == 6


def test_long_form_is_made_apart_from_its_stage(spark):
    terms = basis.catalog({c: at() * F.lit(k) for k, c in ((1.0, "a"), (0.3, "b"), (0.1, "c"))}, constants=("e", "pi"), damped_ratios=True)
    rows = line(spark, 40)
    long = basis.long(rows, terms, ["id"])
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(_values" in plan and "Filter" not in plan
    got = {(r.id, r.term_id): (r.name, r.value) for r in long.collect()}
    want = {(r.id, k): (terms[k].name, v) for r in rows.select("id", F.array(*[t.column for t in terms]).alias("b")).collect() for k, v in enumerate(r.b)}
    assert got == want and long.columns == ["id", "term_id", "name", "value"]


def test_sines_of_many_curves(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for k, n in enumerate((1, 2, 9, 40, 40, 200)):
        t = np.sort(rng.uniform(0, 12, n))
        v = (1.0 + k) * np.sin((0.7 + 0.5 * k) * t + 0.4) + 0.5 + 0.05 * rng.normal(size=n)
        rows += [(k, float(a), float(b)) for a, b in zip(t, v, strict=True)]
        f = lambda p, t=t, v=v: p[1] * np.sin(p[0] * t + p[2]) + p[3] - v
        want[k] = min(refine.levenberg(f, np.array([w, v.std() * 1.4 + 1e-9, 0.0, v.mean()]), 60)[1] for w in (0.5, 1.0, 2.0, 4.0, *refine.scanned(t, v)))
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0), (None, 2.0, 2.5), (9, 1.0, None), (9, 2.0, 1.0)], "k int, t double, v double")
    got = {r.k: r for r in refine.refine_omega(df, "k", "t", "v").collect()}
    assert set(got) == {*want, None, 9} and math.isnan(got[9].mse)
    for k, m in want.items():
        assert got[k].mse <= m * (1 + 1e-6) + 1e-12, k
    assert abs(got[5].omega - 3.2) < 0.01
    assert refine.refine_omega(df.limit(0), "k", "t", "v").count() == 0


def test_inner_products_by_value(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.uniform(-2, 2, 3000), 1), rng.normal(size=3000)
    odd = [(None, 1.0), (1.0, None), (float("nan"), 1.0), (float("inf"), 1.0), (1.0, float("-inf")), (0.0, 1.0), (-0.0, 2.0)]
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), *odd], "x double, y double")
    x, y = np.append(x, [0.0, 0.0]), np.append(y, [1.0, 2.0])
    values = nonlinear.by_value(df, "x", "y")
    assert values.count() == len(np.unique(x))
    for shape, p in ((nonlinear.powers(2), np.array([0.7, 2.4])), (nonlinear.waves(1), np.array([1.3]))):
        ok = shape.usable(x)
        cols, slopes = shape.columns(x[ok], p)
        z = np.column_stack([*cols, *[s for _, _, s in slopes], y[ok], np.ones(ok.sum())])
        assert np.allclose(nonlinear.inner_products(values, [(shape, p)])[0], z.T @ z, rtol=1e-9, atol=1e-9)
    many = line(spark, 300, y=at())
    assert nonlinear.by_value(many, "x", "y").count() == 300
    nonlinear.VALUES, kept = 10, nonlinear.VALUES
    try:
        assert np.allclose(nonlinear.inner_products(nonlinear.by_value(df, "x", "y"), [(shape, p)])[0], z.T @ z, rtol=1e-9, atol=1e-9)
    finally:
        nonlinear.VALUES = kept


def test_staged_fit_reads_a_row_a_value(spark, monkeypatch):
    """All passes but the first few: 4000 rows of 40 values and 3 folds are 120 rows, with the same errors."""
    rows = spark.range(4000).select("id", (F.col("id") % 40 / 4 + 0.25).alias("x"), (F.col("id") % 7 * 0.01).alias("e")).withColumn("y", F.lit(1.7) * F.pow("x", F.lit(2.3)) + F.col("e"))
    seen, own = [], gram.partial
    monkeypatch.setattr(gram, "partial", lambda projected, *a: (seen.append(projected.count()), own(projected, *a))[1])
    products = nonlinear.inner_products
    monkeypatch.setattr(nonlinear, "inner_products", lambda values, trials: (seen.append(values.count()), products(values, trials))[1])
    m = staged.StagedRegressor(max_power=2).fit(rows, ["x"], "y", F.col("id"))
    assert len(seen) > 3 and max(seen) <= 120
    pdf = rows.withColumn("_f", m.column()).toPandas()
    for f, own in pdf.groupby(pdf["id"] % 3):
        got = m.folds[f]
        left = ((own["y"] - own["_f"]) ** 2).mean()
        assert got["n"] == len(own) and math.isclose(got["mse"], left, rel_tol=1e-9) and math.isclose(got["r2"], 1 - left / own["y"].var(ddof=0), rel_tol=1e-9)


def test_products_of_counted_rows(spark):
    """A row that stands for several gives the sums of those, also where nulls, NaN and values without a partner are among them."""
    odd = spark.createDataFrame([(None, 1.0, 0), (float("nan"), 2.0, 1), (3.0, None, 0), (4.0, float("inf"), 2), (5.0, 7.0, 2), (-0.0, 1.0, 1), (0.0, 3.0, 1)], "x double, y double, _fold int")
    rows = spark.range(500).select((F.col("id") % 6 / 2).alias("x"), (F.col("id") % 11 + 1e4).cast("double").alias("y"), (F.col("id") % 3).cast("int").alias("_fold")).unionByName(odd)
    held = staged.Held.of(rows, ["x"], "y")
    assert held.few and held.frame.count() < 30
    terms = basis.catalog({"x": F.col("x")}, 2)
    one = gram.fold_sums(basis.project(rows, terms, F.col("y"), ("_fold",)), len(terms), "_fold")
    two = gram.fold_sums(basis.project(held.frame, terms, F.col("_mean"), ("_fold", "_n", "_m2")), len(terms), "_fold")
    assert sorted(one) == sorted(two) and all(np.allclose(one[f].a, two[f].a, rtol=1e-12) for f in one)
    assert held.omegas == spectrum.dominant(rows, "x", "y")
