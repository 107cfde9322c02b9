"""Dropping or picking rows by key without moving the texts of the others.

A set of keys is first reduced to ``SLOTS`` hash slots, a table whose size is bounded whatever the
corpus, so it is broadcast. Only rows whose slot is named are then joined on the exact key; with few
keys that is few rows, with very many it becomes an ordinary shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Proven bound on the rows that are broadcast.
SLOTS = 1 << 20


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def fresh(names: list[str], base: str = "own_") -> str:
    """A prefix that no name begins with, in any case."""
    while any(name.lower().startswith(base) for name in names):
        base = "x" + base
    return base


def _split(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Rows whose slot no key has, rows whose slot some key has, the distinct keys, and their name."""
    mark = fresh(df.columns)
    slots = F.broadcast(keys.select(_slot(key).alias(mark)).distinct())
    named = df.withColumn(mark, _slot(key))
    wanted = keys.select(F.col(key).alias(mark)).distinct()
    return named.join(slots, mark, "left_anti").drop(mark), named.join(slots, mark, "left_semi").drop(mark), wanted, mark


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``keys`` (one column named ``key``); nulls compare equal."""
    sure, asked, wanted, mark = _split(df, keys, key)
    return sure.unionByName(asked.join(wanted, asked[key].eqNullSafe(wanted[mark]), "left_anti"))


def only_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys``; nulls compare equal."""
    _, asked, wanted, mark = _split(df, keys, key)
    return asked.join(wanted, asked[key].eqNullSafe(wanted[mark]), "left_semi")
