"""Folds over long series whose state is handed on from chunk to chunk."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tables import materialise, renewed

#: Bars of one chunk.
CHUNK = 1 << 16

#: Takes the rows of one chunk of a series (maybe none) and the state before it (None at the start); returns result rows and the state after it.
Step = Callable[[pd.DataFrame, dict | list | None], tuple[pd.DataFrame, dict | list | None]]


def fold_in_chunks(rows: DataFrame, keys: list[str], place: Column, step: Step, schema: str, chunk: int | None = None) -> DataFrame:
    """Fold ``step`` over the rows of every series in chunks of ``chunk`` places.

    ``place`` is a row's place in its series from 0. A task sees one chunk of one
    series and the state that the chunk before it left, as JSON; all series go
    through their chunks side by side. Results and states of a chunk are a
    materialised table, so a lost executor costs one chunk. ``rows`` is read once for
    each chunk and should be materialised where there are several.
    """
    chunk = chunk or CHUNK
    numbered = rows.withColumn("tm_chunk", F.floor(place / chunk))
    last = numbered.agg(F.max("tm_chunk")).first()[0] or 0
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        before = json.loads(state["tm_state"].iat[0]) if len(state) else None
        if own.empty:
            found, after = pd.DataFrame(columns=names), before
        else:
            found, after = step(own, before)
        kept = pd.DataFrame([[*key, *[None] * (len(names) - len(key)), json.dumps(after)]], columns=[*keys, *[n for n in names if n not in keys], "tm_state"])
        return pd.concat([found.astype(object).assign(tm_state=None), kept])[[*names, "tm_state"]] if len(found) else kept[[*names, "tm_state"]]

    states = rows.sparkSession.createDataFrame([], f"{', '.join(c for c in schema.split(', ') if c.split()[0] in keys)}, tm_state string")
    out = None
    for k in range(last + 1):
        own = numbered.where(F.col("tm_chunk") == k).drop("tm_chunk")
        made = own.groupBy(*keys).cogroup(renewed(states).groupBy(*keys)).applyInPandas(run, f"{schema}, tm_state string")
        if last:
            made = materialise(made)
            states = made.where("tm_state is not null").select(*keys, "tm_state")
        found = made.where("tm_state is null").drop("tm_state")
        out = found if out is None else out.unionByName(found)
    return out
