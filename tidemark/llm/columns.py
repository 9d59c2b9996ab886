"""Columns of any name carried through an operator: dots, and names that differ from results only in case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the struct that ``carried`` makes.
REST = "tm_doc"


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def place_of(columns: list[str], name: str) -> int:
    """Place of the column of this name, else of the first one that equals it without case. Raises ValueError if there is none."""
    if name in columns:
        return columns.index(name)
    near = [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if not near:
        raise ValueError(f"no column {name!r}")
    return near[0]


def without(columns: list[str], made: list[str]) -> list[str]:
    """The columns whose names a result with the columns ``made`` leaves free."""
    taken = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in taken]


def carried(df: DataFrame, *plain: str) -> DataFrame:
    """The columns ``plain`` by these names, and all others, by place, in the struct ``tm_doc``."""
    at = {place_of(df.columns, p): p for p in plain}
    renamed = df.toDF(*[at.get(i, f"tm_{i}") for i in range(len(df.columns))])
    rest = [f"tm_{i}" for i in range(len(df.columns)) if i not in at]
    return renamed.select(*plain, F.struct(F.lit(0).alias("tm_none"), *rest).alias(REST))


def restored(df: DataFrame, columns: list[str], plain: list[str], added: list[str] | None = None) -> DataFrame:
    """Undo ``carried``: ``columns`` in their order, save those that have a name of ``added``, then ``added``."""
    added = added or []
    at = {place_of(columns, p): p for p in plain}
    free = set(without(columns, added))
    own = [(F.col(at[i]) if i in at else F.col(f"{REST}.tm_{i}")).alias(c) for i, c in enumerate(columns) if c in free]
    return df.select(*own, *added)


def kept_column(columns: list[str], name: str, plain: list[str]) -> Column:
    """One of ``columns`` of a table that ``carried`` made."""
    at, places = place_of(columns, name), {place_of(columns, p): p for p in plain}
    return (F.col(places[at]) if at in places else F.col(f"{REST}.tm_{at}")).alias(name)
