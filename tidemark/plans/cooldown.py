"""Cooldown thinning: keep a row if it is far enough from the last *kept* row.

The choice depends on everything kept before, but a chunk only needs to know how many of
its first positions are still blocked (0 .. cooldown-1).  Each chunk is summarised as a
table from that number to the number it leaves behind; tables are composed in blocks of
chunks, and every chunk is then thinned on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import staging
from tidemark.plans.series import Run, chunk_rows, chunked

BLOCK = 1024  # chunks composed per task


def _following(rows: np.ndarray, cooldown: int) -> np.ndarray:
    """For each row the index of the next one that may be kept after it; the number of rows stands for none."""
    return np.append(np.searchsorted(rows, rows + cooldown), len(rows))


def _kept(rows: np.ndarray, first: int, cooldown: int) -> np.ndarray:
    """Indices of the rows kept from position ``first`` on, by pointer doubling: twice as many after each step."""
    kept, jump = np.array([np.searchsorted(rows, first)]), _following(rows, cooldown)
    while True:
        more = jump[kept]
        more = more[more < len(rows)]
        if not len(more):
            return np.sort(kept[kept < len(rows)])
        kept, jump = np.concatenate([kept, more]), jump[jump]


def _last_kept(rows: np.ndarray, first: np.ndarray, cooldown: int) -> np.ndarray:
    """Index of the last row kept from each of the positions ``first``; the number of rows stands for none."""
    jumps = [_following(rows, cooldown)]
    while (jumps[-1][:-1] < len(rows)).any():
        jumps.append(jumps[-1][jumps[-1]])
    at = np.searchsorted(rows, first)
    for jump in reversed(jumps):
        onward = jump[at]
        at = np.where(onward < len(rows), onward, at)
    return at


def _every_other(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cooldown of two rows: every other row of each unbroken run, found with windows alone."""
    ch = chunked(staging.save(rows, "signals"), keys, before=1)
    fresh = F.coalesce(F.lag("rn").over(ch.window) < F.col("rn") - 1, F.lit(True))
    ch = ch.add(_start=F.when(fresh, F.col("rn"))).trim(1).scan(Run("_run", "_start", "max"))
    return ch.own().filter((F.col("rn") - F.col("_run")) % 2 == 0).select(*rows.columns)


def thin(rows: DataFrame, keys: Sequence[str], cooldown: int) -> DataFrame:
    """Rows kept by the greedy rule, per ``keys`` in order of their position ``rn``."""
    if cooldown <= 1:
        return rows
    if cooldown == 2:
        return _every_other(rows, keys)
    keys, position = list(keys), "rn"
    size = max(chunk_rows(rows.sparkSession), cooldown)
    table = staging.save(rows.withColumn("_chunk", F.floor(F.col(position) / F.lit(size))), "signals")
    key_fields = [table.schema[k] for k in keys]
    exit_field = T.StructField("_exit", T.ArrayType(T.LongType()))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf[position].to_numpy())
        chunk = int(pdf["_chunk"].iloc[0])
        start, end = chunk * size, (chunk + 1) * size
        first = start + np.arange(cooldown)
        last = _last_kept(at, first, cooldown)
        leaves = np.where(last < len(at), at[np.minimum(last, len(at) - 1)] + cooldown, first) - end
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "_chunk": [chunk], "_exit": [np.maximum(leaves, 0).tolist()]})

    summary_schema = T.StructType([*key_fields, T.StructField("_chunk", T.LongType()), exit_field])
    chunks = table.select(*keys, position, "_chunk").groupBy(*keys, "_chunk").applyInPandas(summarise, summary_schema)
    chunks = staging.save(chunks.withColumn("_block", F.floor(F.col("_chunk") / BLOCK)), "cooldown")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        state, last = np.arange(cooldown), None
        for chunk, leaves in zip(pdf["_chunk"], pdf["_exit"]):
            # Any chunk without signals in between lets the cooldown run out.
            if chunk > (int(pdf["_block"].iloc[0]) * BLOCK if last is None else last + 1):
                state = np.zeros_like(state)
            state, last = np.asarray(leaves)[state], chunk
        if last % BLOCK != BLOCK - 1:
            state = np.zeros_like(state)
        return pd.DataFrame(
            {**{k: pdf[k].iloc[:1].to_numpy() for k in keys}, "_block": pdf["_block"].iloc[:1].to_numpy(), "_exit": [state.tolist()]}
        )

    def fold(pdf: pd.DataFrame, step: str) -> pd.DataFrame:
        """Blocked positions on entry to each step, from the entry state of the first one."""
        pdf = pdf.sort_values(step)
        first = int(pdf["_enter"].iloc[0]) if "_enter" in pdf else 0
        base = int(pdf["_block"].iloc[0]) * BLOCK if step == "_chunk" else int(pdf[step].iloc[0])
        state, enter, expected = first, [], base
        for at, leaves in zip(pdf[step], pdf["_exit"]):
            state = state if at == expected else 0
            enter.append(state)
            state, expected = int(leaves[state]), at + 1
        return pdf[[*keys, step]].assign(_enter=enter)

    block_schema = T.StructType([*key_fields, T.StructField("_block", T.LongType()), exit_field])
    enter = T.StructField("_enter", T.LongType())
    blocks = chunks.groupBy(*keys, "_block").applyInPandas(compose, block_schema)
    block_enter = blocks.groupBy(*keys).applyInPandas(
        lambda pdf: fold(pdf, "_block"), T.StructType([*key_fields, T.StructField("_block", T.LongType()), enter])
    )
    chunk_enter = (
        chunks.join(block_enter, [*keys, "_block"])
        .groupBy(*keys, "_block")
        .applyInPandas(
            lambda pdf: fold(pdf, "_chunk"), T.StructType([*key_fields, T.StructField("_chunk", T.LongType()), enter])
        )
    )

    columns = rows.columns

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, ignore_index=True)
        first = int(pdf["_chunk"].iloc[0]) * size + int(pdf["_enter"].iloc[0])
        return pdf.iloc[_kept(pdf[position].to_numpy(), first, cooldown)][columns]

    return table.join(chunk_enter, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(choose, rows.schema)
