"""Equations given as text, over named features: names are checked before Spark reads them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions of SQL that an equation may use.
ALLOWED = {"abs", "sign", "tanh", "exp", "ln", "sqrt", "greatest", "least", "coalesce", "nullif", "power", "case", "when", "then", "else", "end", "and", "or", "not", "is", "null"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PLAIN = re.compile(r"[A-Za-z0-9_\s+\-*/().,<>=]*")


def equation(text: str, names: set[str]) -> Column:
    """The column of an equation over the given names; a ValueError tells unknown names and other characters."""
    if not _PLAIN.fullmatch(text):
        raise ValueError(f"an equation may hold names, numbers, + - * / ( ) , < > and = only: {text}")
    used = {x.lower() for x in _NAME.findall(re.sub(r"\b\d+(\.\d+)?([eE][+-]?\d+)?", " ", text))}
    unknown = used - ALLOWED - {n.lower() for n in names}
    if unknown:
        raise ValueError(f"unknown names in {text}: {', '.join(sorted(unknown))}")
    return F.expr(text)


def evaluated(rows: DataFrame, equations: dict[str, str]) -> DataFrame:
    """rows with a column for each named equation; a later one may use the names of those before it."""
    for name, text in equations.items():
        rows = rows.withColumn(name, equation(text, set(rows.columns)))
    return rows
