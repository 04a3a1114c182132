"""Python syntax nodes as a relation, and the complexity weights over them.

The standard library parses each Python text inside an Arrow batch and hands back how often
each node kind of interest occurs; every weight is applied by Spark.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# Ship the parser helper with the task instead of expecting the package on every worker.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES_TYPE = "array<struct<kind:string,arity:int,docstring:boolean,n:int>>"

# --- fixed values: node kinds that carry a weight ------------------------------------------
BRANCH_KINDS = ("If", "For", "AsyncFor", "While", "IfExp")
COMPREHENSION_KINDS = ("ListComp", "SetComp", "DictComp", "GeneratorExp")
IMPORT_KINDS = ("Import", "ImportFrom")
DOCUMENTED_KINDS = ("Module", "FunctionDef", "AsyncFunctionDef", "ClassDef")


def _arity(kind: str, node: ast.AST) -> int:
    if kind == "Try":
        return len(node.handlers)
    if kind == "BoolOp":
        return len(node.values)
    if kind == "Match":
        return len(node.cases)
    if kind in IMPORT_KINDS:
        return len(node.names)
    if kind in COMPREHENSION_KINDS:
        return sum(1 + len(clause.ifs) for clause in node.generators)
    return 1


_KEPT = frozenset(BRANCH_KINDS + COMPREHENSION_KINDS + IMPORT_KINDS + DOCUMENTED_KINDS + ("Try", "BoolOp", "Match"))


def _nodes(source: str | None) -> list[tuple] | None:
    if source is None:
        return None
    try:
        tree = ast.parse(source)
        seen = Counter()
        for node in ast.walk(tree):
            kind = type(node).__name__
            if kind in _KEPT:
                documented = kind in DOCUMENTED_KINDS and bool(ast.get_docstring(node))
                seen[kind, _arity(kind, node), documented] += 1
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return [(*key, n) for key, n in sorted(seen.items())]


def _parse_batch(source: pd.Series) -> pd.Series:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return source.map(_nodes, na_action=None)


def syntax_nodes(source) -> Column:
    """Node counts per kind, arity and docstring; null where the text does not parse."""
    return F.pandas_udf(_parse_batch, NODES_TYPE)(source)


def _weight(node: Column) -> Column:
    kind, arity = node["kind"], node["arity"]
    return (
        F.when(kind.isin(*BRANCH_KINDS), 1.0)
        .when(kind.isin("Try", *COMPREHENSION_KINDS), arity.cast("double"))
        .when(kind == "BoolOp", arity - 1.0)
        .when((kind == "Match") & (arity <= 3), 1.0)
        .when(kind == "Match", arity * 0.5)
        .otherwise(0.0)
    )


def _total(nodes: Column, value) -> Column:
    return F.aggregate(nodes, F.lit(0.0), lambda acc, node: acc + value(node) * node["n"])


def complexity(nodes: Column) -> Column:
    """One plus the branch weights, halves rounded up."""
    return (F.lit(1.0) + _total(nodes, _weight) + 0.5).cast("int")


def imports(nodes: Column) -> Column:
    """Imported names, repeats included."""
    return _total(nodes, lambda n: F.when(n["kind"].isin(*IMPORT_KINDS), n["arity"] * 1.0).otherwise(0.0)).cast("int")


def docstrings(nodes: Column) -> Column:
    return _total(nodes, lambda n: n["docstring"].cast("double")).cast("int")


def syntax_node_rows(parsed: DataFrame) -> DataFrame:
    """``file_id, kind, arity, docstring, n`` for every parsed Python file."""
    return parsed.select("file_id", F.inline("nodes"))
