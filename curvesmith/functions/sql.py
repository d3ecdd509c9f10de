"""The numeric contract as SQL functions: plain SQL bodies, so they are inlined and stay in generated code."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (arguments, body)
FUNCTIONS = {
    "safe_pow": ("x DOUBLE, p DOUBLE", "greatest(least(CASE WHEN abs(p - rint(p)) < 1e-6 AND pmod(rint(p), 2) = 0 THEN 1D ELSE signum(x) END * pow(abs(x) + 1e-10, p), 1e8), -1e8)"),
    "safe_div": ("a DOUBLE, b DOUBLE", "greatest(least(a / (abs(b) + 1e-6) * signum(b), 1e6), -1e6)"),
    "safe_log": ("x DOUBLE", "greatest(least(ln(abs(x) + 1e-6), 1e6), -1e6)"),
    "safe_exp": ("x DOUBLE", "least(exp(least(x, 700D)), 1e6)"),
    "soft_round": ("x DOUBLE", "x - sin(2 * pi() * x) / (10 * pi())"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    return list(FUNCTIONS)
