"""Scorers and verifiers of answers and calls; environments as joins."""

import ast
import hashlib
import math
import re
from base64 import b64decode, b64encode
from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _call(text):
    """(name, positional, named) of the first call of a text, or None."""
    try:
        tree = ast.parse((text or "").split(";")[0].strip(), mode="eval").body
        if not isinstance(tree, ast.Call):
            return None
        return ast.unparse(tree.func), [ast.dump(a) for a in tree.args], sorted((k.arg or "", ast.dump(k.value)) for k in tree.keywords)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.BooleanType())
def same_call(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether two texts are the same call by name, positional and named arguments; two texts that don't parse count as equal."""
    for a, b in batches:
        yield pd.Series([_call(x) == _call(y) for x, y in zip(a, b, strict=True)], dtype=bool)


def call_in_code(code: Column, api: Column, arguments: Column) -> Column:
    """Whether code calls ``api`` and holds all ``arguments`` in that call's parentheses."""
    inside = F.substring_index(F.substring(code, F.position(api, code) + F.length(api), F.length(code)), ")", 1)
    return F.contains(code, F.concat(api, F.lit("("))) & F.forall(arguments, lambda a: F.contains(inside, a))


def _number(text):
    t = (text or "").strip().replace("$", "").replace(",", "").replace("\\left", "").replace("\\right", "")
    while (m := re.search(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", t)) is not None:
        t = f"{t[: m.start()]}(({m[1]})/({m[2]})){t[m.end() :]}"
    t = re.sub(r"\\sqrt\{([^{}]*)\}", r"((\1)**0.5)", t).replace("\\pi", str(math.pi)).replace("\\times", "*").replace("\\cdot", "*").replace("^", "**").replace("{", "(").replace("}", ")")
    try:
        value = _evaluate(ast.parse(t, mode="eval").body)
        return value if math.isfinite(value) else None
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError, MemoryError, TypeError):
        return None


def _evaluate(node):
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return float(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return -_evaluate(node.operand) if isinstance(node.op, ast.USub) else _evaluate(node.operand)
    if isinstance(node, ast.BinOp):
        a, b = _evaluate(node.left), _evaluate(node.right)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Div):
            return a / b
        if isinstance(node.op, ast.Pow) and abs(b) <= 64:
            return float(a**b)
    raise ValueError("not a number")


@F.pandas_udf(T.BooleanType())
def same_math(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Equal as numbers to six digits, fractions, roots and powers of LaTeX included; other texts if they are equal without white space."""
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = _number(x), _number(y)
            out.append(round(p, 6) == round(q, 6) if p is not None and q is not None else re.sub(r"\s", "", x or "") == re.sub(r"\s", "", y or ""))
        yield pd.Series(out, dtype=bool)


#: Units of length, mass, time, force, energy and pressure, in SI units.
UNITS = {"m": ("L", 1.0), "cm": ("L", 0.01), "mm": ("L", 0.001), "km": ("L", 1000.0), "kg": ("M", 1.0), "g": ("M", 0.001), "s": ("T", 1.0), "ms": ("T", 0.001), "min": ("T", 60.0), "h": ("T", 3600.0), "N": ("F", 1.0), "kN": ("F", 1000.0), "J": ("E", 1.0), "kJ": ("E", 1000.0), "Pa": ("P", 1.0), "kPa": ("P", 1000.0), "": ("", 1.0)}


def same_quantity(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two structs (value text, unit) are the same quantity: units of one kind, values in SI units within a relative tolerance."""
    kind = F.create_map(*[F.lit(x) for u, (k, _) in UNITS.items() for x in (u, k)])
    scale = F.create_map(*[F.lit(x) for u, (_, s) in UNITS.items() for x in (u, s)])
    si = lambda q: q["value"].try_cast("double") * scale[q["unit"]]
    return F.coalesce((kind[a["unit"]] == kind[b["unit"]]) & (F.abs(si(a) - si(b)) <= tolerance * F.abs(si(b))), F.lit(False))


def first_extracted(text: Column, stages: list[list]) -> Column:
    """Stages in turn, each the first of its strategies (column to column) that gives something; null as soon as a stage gives nothing."""
    for strategies in stages:
        text = F.coalesce(*[s(text) for s in strategies])
    return text


def encrypted(text: str, password: str) -> str:
    key = hashlib.sha256(password.encode()).digest()
    return b64encode(bytes(c ^ key[i % len(key)] for i, c in enumerate(text.encode()))).decode()


def _decrypt(cipher, password):
    raw = b64decode(cipher)
    key = hashlib.sha256(password.encode()).digest()
    return bytes(c ^ key[i % len(key)] for i, c in enumerate(raw)).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decrypt(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Base64 texts, combined by exclusive or with the repeated SHA-256 of a password."""
    for cipher, password in batches:
        yield pd.Series([None if c is None or p is None else _decrypt(c, p) for c, p in zip(cipher, password, strict=True)])


def verified(rows: DataFrame, check: Column, tries: int = 3) -> DataFrame:
    """Rows with ``status``: success, failure, or error where the check gives null; Spark repeats a task that is lost, ``tries`` is the most a caller should allow it."""
    return rows.withColumn("status", F.when(check.isNull(), "error").when(check, "success").otherwise("failure")).withColumn("tries", F.lit(tries))


def step_environment(states: DataFrame, actions: DataFrame, reward: Column) -> DataFrame:
    """(index, reward, done) of states joined to actions (index, answer) on their index; a repeated index fails the job."""
    once = actions.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.first("answer").alias("answer"))
    once = once.where(F.assert_true(F.col("n") == 1, F.lit("an index has several actions")).isNull())
    return states.join(once.select("index", "answer"), "index").select("index", reward.alias("reward"), F.lit(True).alias("done"))
