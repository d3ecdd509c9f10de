"""Expression graphs as rows: an array of node structs with output weights, compiled to one Column."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import safe

SCHEMA = (
    "struct<nodes:array<struct<type:string,feature:int,value:double,op:string,p:double,omega:double,phi:double,amplitude:double,"
    "beta:double,gamma:double,tau:double,left:int,right:int>>,weights:array<double>,bias:double>"
)
UNARY = ("periodic", "power", "int_power", "exp", "log")
BINARY = ("arithmetic", "division", "aggregation")


def node(kind: str, **fields) -> dict:
    base = {"type": kind, "feature": None, "value": None, "op": None, "p": 1.0, "omega": 1.0, "phi": 0.0, "amplitude": 1.0, "beta": 1.0, "gamma": 1.0, "tau": 1.0, "left": None, "right": None}
    return base | fields


def check(graph: dict, n_inputs: int) -> list[str]:
    """What is wrong with a graph: children must come before their parents, features must exist."""
    bad = []
    for i, n in enumerate(graph["nodes"]):
        if n["type"] == "input" and not 0 <= (n["feature"] if n["feature"] is not None else -1) < n_inputs:
            bad.append(f"node {i}: no such input")
        for c in ("left", "right")[: {"unary": 1, "binary": 2}.get(n["type"], 0)]:
            if n[c] is None or not 0 <= n[c] < i:
                bad.append(f"node {i}: {c} child is not before it")
    if len(graph["weights"]) != len(graph["nodes"]):
        bad.append("as many weights as nodes")
    return bad


def node_columns(graph: dict, inputs: list[Column]) -> list[Column]:
    out: list[Column] = []
    for n in graph["nodes"]:
        if n["type"] == "input":
            out.append(inputs[n["feature"]].cast("double"))
        elif n["type"] == "constant":
            out.append(F.lit(float(n["value"])))
        elif n["type"] == "unary":
            x = out[n["left"]]
            out.append({
                "periodic": lambda: safe.periodic(x, n["amplitude"], n["omega"], n["phi"]), "power": lambda: safe.signed_power(x, n["p"]),
                "int_power": lambda: safe.int_power(x, n["p"]), "exp": lambda: safe.clamped_exp(x, n["omega"], n["phi"]), "log": lambda: safe.safe_log(x),
            }[n["op"]]())
        else:
            a, b = out[n["left"]], out[n["right"]]
            out.append({
                "arithmetic": lambda: safe.soft_arithmetic(a, b, n["beta"], n["gamma"]), "division": lambda: safe.safe_division(a, b),
                "aggregation": lambda: safe.soft_aggregation(a, b, n["tau"]),
            }[n["op"]]())
    return out


def node_arrays(graph: dict, inputs: list[np.ndarray]) -> list[np.ndarray]:
    """The same in arrays."""
    out: list[np.ndarray] = []
    clamp = lambda v, most: np.clip(np.where(np.isnan(v), most, v), -most, most)
    with np.errstate(all="ignore"):
        for n in graph["nodes"]:
            if n["type"] == "input":
                out.append(inputs[n["feature"]])
                continue
            if n["type"] == "constant":
                out.append(np.full(len(inputs[0]), float(n["value"])))
                continue
            x = out[n["left"]]
            y = out[n["right"]] if n["type"] == "binary" else x
            ratio = x / (np.abs(y) + 1e-6) * np.sign(y)
            if n["op"] == "periodic":
                v = n["amplitude"] * np.sin(n["omega"] * x + n["phi"])
            elif n["op"] == "power":
                even = abs(n["p"] - round(n["p"])) < 1e-6 and round(n["p"]) % 2 == 0
                v = clamp((np.abs(x) + 1e-10) ** n["p"] * (1.0 if even else np.sign(x)), safe.HUGE)
            elif n["op"] == "int_power":
                v = clamp(x ** float(min(6, max(2, round(n["p"])))), safe.HUGE)
            elif n["op"] == "exp":
                v = clamp(np.exp(np.minimum(n["omega"] * x + n["phi"], 700.0)), safe.BIG)
            elif n["op"] == "log":
                v = clamp(np.log(np.abs(x) + 1e-6), safe.BIG)
            elif n["op"] == "arithmetic":
                w = safe.corner_weights(n["beta"], n["gamma"])
                v = clamp(w["add"] * (x + y) + w["mul"] * (x * y) + w["div"] * ratio + w["sub"] * (x - y), safe.BIG)
            elif n["op"] == "division":
                v = clamp(ratio, safe.BIG)
            else:
                t = n["tau"] if abs(n["tau"]) >= 1e-3 else np.copysign(1e-3, n["tau"])
                top = np.maximum(x / t, y / t)
                a, b = np.exp(x / t - top), np.exp(y / t - top)
                v = (a * x + b * y) / (a + b)
            out.append(v)
    return out


def to_column(graph: dict, inputs: list[Column]) -> Column:
    """bias + the weighted nodes; weights of 1e-6 and less are left out, and with them what only they need."""
    if bad := check(graph, len(inputs)):
        raise ValueError("; ".join(bad))
    y = F.lit(float(graph["bias"]))
    for w, c in zip(graph["weights"], node_columns(graph, inputs), strict=True):
        if abs(w) > 1e-6:
            y = y + F.lit(float(w)) * c
    return y


def complexity(graph: dict) -> int:
    return len(graph["nodes"])


def unit_penalty(graph: dict, units: list[list[float]]) -> float:
    """How far the graph is from consistent units: sums want equal exponents, exp, log and sine want none."""
    have: list[list[float] | None] = []
    total = 0.0
    zero = [0.0] * (len(units[0]) if units else 0)
    gap = lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True))
    for n in graph["nodes"]:
        if n["type"] == "input":
            have.append(units[n["feature"]])
        elif n["type"] == "constant":
            have.append(None)  # takes any unit
        elif n["type"] == "unary":
            u = have[n["left"]]
            if n["op"] in ("power", "int_power"):
                have.append(None if u is None else [x * n["p"] for x in u])
            else:
                total += gap(u, zero) if u is not None else 0.0
                have.append(list(zero))
        else:
            a, b = have[n["left"]], have[n["right"]]
            w = safe.corner_weights(n["beta"], n["gamma"]) if n["op"] == "arithmetic" else {"div": 1.0} if n["op"] == "division" else {"add": 1.0}
            top = max(w, key=w.get)
            if top in ("add", "sub"):
                total += gap(a, b) if a is not None and b is not None else 0.0
                have.append(a if a is not None else b)
            else:
                s = 1.0 if top == "mul" else -1.0
                have.append([x + s * y for x, y in zip(a or zero, b or zero, strict=True)])
    return total


#: Parameters that tell nodes of a kind apart, to two decimals.
TELLING = {"input": ("feature",), "constant": ("value",), "unary": ("op", "p", "omega", "phi", "amplitude"), "binary": ("op", "beta", "gamma", "tau")}


def digests(graph: dict) -> list[str]:
    """A digest for each node of what it computes: its kind, its parameters to two decimals, and its children's digests."""
    out: list[str] = []
    for n in graph["nodes"]:
        own = [n["type"], *(f"{n[k] + 0.0:.2f}" if isinstance(n[k], float) else str(n[k]) for k in TELLING[n["type"]])]
        children = [out[n[c]] for c in ("left", "right")[: {"unary": 1, "binary": 2}.get(n["type"], 0)]]
        out.append(hashlib.md5("|".join(own + children).encode()).hexdigest())
    return out


def shared(graph: dict) -> dict:
    """The graph with each computation once: nodes of equal digest are one, with their weights added."""
    first: dict[str, int] = {}
    place, nodes, weights = [], [], []
    for n, w, key in zip(graph["nodes"], graph["weights"], digests(graph), strict=True):
        if key not in first:
            first[key] = len(nodes)
            nodes.append(n | {c: place[n[c]] for c in ("left", "right") if n[c] is not None})
            weights.append(0.0)
        place.append(first[key])
        weights[place[-1]] += w
    return graph | {"nodes": nodes, "weights": weights}
