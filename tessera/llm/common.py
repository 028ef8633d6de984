"""What the corpus operators share: words, written tables, checked broadcasts,
packed rows, per-worker state."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.iterate import write_table

#: A word: a run of anything but ASCII space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a broadcast side may have; its row width is stated where it is used.
BROADCAST_ROWS = 1 << 20

__all__ = ["BROADCAST_ROWS", "WORD", "ascii_lower", "broadcast_if_few", "pack_row",
           "text_or_empty", "texts_in", "worker_state", "write_table"]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def broadcast_if_few(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count of the (written or cheap) frame; beyond
    max_rows the planner shuffles both sides and gives the same rows."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def pack_row(docs: DataFrame, **derived: Column) -> DataFrame:
    """All columns of a frame folded into one struct, so that derived columns
    can't clash with any name the caller brought."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    return docs.select(row, *[c.alias(n) for n, c in derived.items()])


def worker_state(owner: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks: caches
    only, never results. Package functions are pickled by value, so module
    globals are new in each task. One operator's at a time: the caches of the
    one that ran before are let go."""
    mod = sys.modules.get("tessera_worker_state")
    if mod is None:
        mod = sys.modules["tessera_worker_state"] = types.ModuleType("tessera_worker_state")
        mod.state = {}
    if owner not in mod.state:
        mod.state.clear()
        mod.state[owner] = {}
    return mod.state[owner]


def texts_in(batch, field: str | None) -> pa.Array:
    """The texts of an Arrow batch: its last column, or a field of that column
    where it is a packed row (so that a text is sent once)."""
    last = batch.column(batch.num_columns - 1)
    return (last.field(field) if field else last).cast(pa.string())
