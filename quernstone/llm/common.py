"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

from quernstone.batches import lean, small_batches  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; only a local session may fall back to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def safe_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def own_columns(df: DataFrame) -> dict[str, Column]:
    """The columns of ``df`` by name, bound to it, so that a join with columns of the same names keeps them apart."""
    return {c: df["`" + c.replace("`", "``") + "`"] for c in df.columns}


def byte_batches(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``limit`` bytes together; a longer text is a range of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes after each other, and the n + 1 offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """From frames sorted by ``keys``: frames that hold whole groups only, with the offsets of their groups."""
    held: list[pd.DataFrame] = []

    def cuts(frame: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(frame) + 1, bool)
        new[1:-1] = False
        for k in keys:
            v = frame[k].to_numpy()
            new[1:-1] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for frame in frames:
        if not len(frame):
            continue
        at = cuts(frame)
        if held and any(frame[k].iat[0] != held[-1][k].iat[0] for k in keys):
            whole = pd.concat(held, ignore_index=True)
            yield whole, np.array([0, len(whole)])
            held = []
        if len(at) == 2:
            held.append(frame)
            continue
        begin = at[1] if held else 0
        if held:
            whole = pd.concat([*held, frame.iloc[:begin]], ignore_index=True)
            yield whole, np.array([0, len(whole)])
        if at[-2] > begin:
            yield frame.iloc[begin : at[-2]].reset_index(drop=True), at[(at >= begin) & (at <= at[-2])] - begin
        held = [frame.iloc[at[-2] :]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, np.array([0, len(whole)])
