"""Frames that arrive as a stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.radial import pair_key


def element_profile(atoms: DataFrame, width: float, axis: str = "x") -> DataFrame:
    """hist, bin_idx, key, y: running counts along an axis over all frames so far; write it in complete mode."""
    bins = F.floor(F.col(axis) / width).cast("long")
    return atoms.groupBy(F.lit(f"profile_{axis}").alias("hist"), bins.alias("bin_idx"), F.col("element").alias("key")).agg(F.count("*").cast("double").alias("y"))


def pair_histogram(pairs: DataFrame, dr: float) -> DataFrame:
    """key, bin_idx, n: running pair counts of a stream of pairs (such as a stage that finds them in each batch); complete mode."""
    bins = F.floor(F.col("d") / dr).cast("long")
    return pairs.groupBy(pair_key("e1", "e2").alias("key"), bins.alias("bin_idx")).agg(F.sum(F.when(F.col("e1") == F.col("e2"), 2).otherwise(1)).cast("long").alias("n"))


def each_batch(stream: DataFrame, analyse, checkpoint: str, trigger: dict | None = None):
    """Starts a query that hands every micro-batch of atoms to analyse(df, batch_id)."""
    return stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def online_unwrap(stream: DataFrame, lattice: list[float]) -> DataFrame:
    """frame, atom_id, x, y, z of a stream of atoms in one cell (nine numbers), without the jumps at its faces; append mode.

    The state of an atom is its last frame, position and place. Frames of an atom are taken in ascending order within a batch; one that
    is not newer than the last is left out, as its step is no longer known."""
    cell = np.array(lattice, float).reshape(3, 3)
    inverse = np.linalg.inv(cell)

    def run(key, parts, state: GroupState):
        rows = pd.concat(list(parts)).sort_values("frame").drop_duplicates("frame")
        held = state.get if state.exists else None
        if held is not None:
            rows = rows[rows["frame"] > held[0]]
        if not len(rows):
            return
        r = rows[["x", "y", "z"]].to_numpy(float)
        before = np.vstack([r[:1] if held is None else [held[1:4]], r[:-1]])
        f = (r - before) @ inverse
        f -= np.sign(f) * np.floor(np.abs(f) + 0.5)  # halves round away from zero
        places = np.cumsum(f @ cell, axis=0) + (r[0] if held is None else np.array(held[4:7]))
        state.update((int(rows["frame"].iloc[-1]), *r[-1].tolist(), *places[-1].tolist()))
        yield pd.DataFrame({"frame": rows["frame"].to_numpy(), "atom_id": key[0], **{c: places[:, k] for k, c in enumerate("xyz")}})

    fields = "frame long, atom_id long, x double, y double, z double"
    last = "frame long, x double, y double, z double, ux double, uy double, uz double"
    return stream.select("frame", "atom_id", "x", "y", "z").groupBy("atom_id").applyInPandasWithState(run, fields, last, "append", GroupStateTimeout.NoTimeout)
