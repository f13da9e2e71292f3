"""Query registration: a Spark plan and, where SQL can state it, an independent DuckDB statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import SQL_BINDINGS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# rounding to six places starts a hair under one half, so that decimal inputs never sit on the edge
HALF = 0.5003


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as doubles to six places; what floor() cannot take into a long (NaN too) stays as it is."""
    chosen = set(names)
    value = lambda c: F.col(c).cast("double")
    return df.select(
        *[
            F.when(F.abs(value(c)) < 9e12, F.floor(value(c) * 1e6 + HALF) / 1e6).otherwise(value(c)).alias(c) if c in chosen else F.col(c)
            for c in df.columns
        ]
    )


def statement(sql: str, names: list[str]) -> str:
    """The oracle statement with the table bindings it mentions in front and doubles rounded."""
    text = sql.strip()
    wanted: list[str] = []

    def need(body: str) -> None:
        for name, definition in SQL_BINDINGS.items():
            if name not in wanted and re.search(rf"\b{name}\b", body):
                need(definition)
                wanted.append(name)

    need(text)
    parts = [f"{name} AS ({SQL_BINDINGS[name]})" for name in wanted]
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", text)
    recursive = bool(own and own.group(1))
    if own:
        text = text[own.end():]
        head = "WITH " + ("RECURSIVE " if recursive else "") + ", ".join([*parts, ""])
        text = head + text
    elif parts:
        text = "WITH " + ", ".join(parts) + " " + text
    if not names:
        return text
    swaps = ", ".join(f"floor(CAST({n} AS DOUBLE) * 1e6 + {HALF}) / 1e6 + 0e0 AS {n}" for n in names)
    return f"SELECT * REPLACE ({swaps}) FROM ({text}) AS result"


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register fn(tables) under `name`; `doubles` lists the columns both engines round
    (nullable whole numbers too, so that a null never changes their type)."""
    names = doubles.split()

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Tables(spark, sf_dir)), names)

        run.__doc__ = fn.__doc__
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = statement(sql, names)
        return fn

    return register
