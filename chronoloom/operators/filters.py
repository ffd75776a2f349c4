"""Recursive and spectral operators, as Arrow-fed kernels over one segment of one channel."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTOFF_HZ = 0.16
#: Samples of a batch that a task gives back.
SAMPLES = 1 << 17


def highpass_coefficients(rate: float, cutoff: float = CUTOFF_HZ) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth high-pass by the bilinear transform."""
    k = math.tan(math.pi * cutoff / rate)
    d = 1 + math.sqrt(2) * k + k * k
    return np.array([1, -2, 1]) / d, np.array([1, 2 * (k * k - 1) / d, (1 - math.sqrt(2) * k + k * k) / d])


class Recursion:
    """The filter as a linear system of two states, run in blocks: outputs and last states of BLOCK samples are one
    matrix product of the samples and the states before them."""

    BLOCK = 256

    def __init__(self, rate: float, cutoff: float = CUTOFF_HZ) -> None:
        b, a = highpass_coefficients(rate, cutoff)
        self.lead, n = int(20 * rate), self.BLOCK
        self.step, gain = np.array([[-a[1], 1.0], [-a[2], 0.0]]), np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
        powers = [np.eye(2)]
        for _ in range(n):
            powers.append(self.step @ powers[-1])
        response = np.array([b[0], *(powers[k][0] @ gain for k in range(n - 1))])
        self.powers = powers
        after = np.subtract.outer(np.arange(n), np.arange(n))
        self.outputs = np.where(after >= 0, response[np.abs(after)], 0.0)
        self.memory = np.array([p[0] for p in powers[:n]])  # of the states, by sample
        self.kept = np.array([powers[n - 1 - j] @ gain for j in range(n)]).T  # of the samples, by state
        self.gain, self.first = gain, b[0]

    def after(self, n: int) -> np.ndarray:
        """What n samples of nothing do to the states."""
        return np.linalg.matrix_power(self.step, n)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filtered samples and the states behind them."""
        out = np.empty(len(x))
        for at in range(0, len(x), self.BLOCK):
            part = x[at : at + self.BLOCK]
            n = len(part)  # the last block may be short
            out[at : at + n] = self.outputs[:n, :n] @ part + self.memory[:n] @ state
            state = self.powers[n] @ state + self.kept[:, self.BLOCK - n :] @ part
        return out, state

    def primed(self, x: np.ndarray) -> np.ndarray:
        """The states that a segment's mirrored beginning (20 s of it, the first sample included) leaves."""
        return self.run(x[: min(self.lead, len(x) - 1) + 1][::-1], np.zeros(2))[1] if len(x) else np.zeros(2)


@functools.lru_cache(maxsize=16)
def recursion(rate: float, cutoff: float = CUTOFF_HZ) -> Recursion:
    """The filter of a rate, made once in a worker."""
    return Recursion(rate, cutoff)


def highpass(x: np.ndarray, rate: float, cutoff: float = CUTOFF_HZ) -> np.ndarray:
    """Filtered samples of one contiguous segment, primed on its mirrored beginning."""
    system = recursion(rate, cutoff)
    return system.run(x, system.primed(x))[0]


def highpass_segments(samples: DataFrame, by: list[str], pos: str, value: str, rate: float, chunk: int = 1 << 17) -> DataFrame:
    """by, pos, value and filtered, for each group of `by` (a recording's channel and segment), whose positions count
    from 0 without holes.

    Segments are filtered in chunks, each an array: first the states that whole chunks leave from none, then the states
    along a segment's chunks, then the samples from these. A task takes chunks and short segments as they come, many in a
    batch. Rows with a null in `by` are in no segment and left out."""
    if chunk <= 20 * rate:
        raise ValueError("a chunk must hold what primes the filter")
    keys = [*by, "__chunk"]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), F.lit(True))
    kept = samples.where(known).select(*by, F.floor(F.col(pos) / chunk).alias("__chunk"), F.struct(pos, value).alias("__s"))
    packed = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("__s")).alias("__s"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in keys)

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray, np.ndarray]:
        """Where each row's samples end, all of them, and their values."""
        lists = batch.column("__s")
        flat = lists.flatten()
        values = flat.field(1).to_numpy(zero_copy_only=False).astype(float)
        return lists.offsets.to_numpy() - lists.offsets[0].as_py(), flat, values

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = recursion(rate)
        for batch in batches:
            at, _, values = arrays(batch)
            found = [system.run(x, np.zeros(2) if c else system.primed(x))[1] for c, x in zip(batch.column("__chunk").to_pylist(), np.split(values, at[1:-1]), strict=True)] if len(batch) else []
            states = [pa.array([z[k] for z in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, *states], names=[*keys, "__z1", "__z2"])

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        """The states before each chunk that follows a whole one."""
        system, rows, state, found = recursion(rate), rows.sort_values("__chunk"), np.zeros(2), []
        through = system.after(chunk)
        for c, z1, z2 in zip(rows["__chunk"], rows["__z1"], rows["__z2"], strict=True):
            state = (through @ state if c else 0.0) + np.array([z1, z2])
            found.append(state)
        return rows[keys].assign(__chunk=rows["__chunk"] + 1, __z1=[s[0] for s in found], __z2=[s[1] for s in found])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = recursion(rate)
        for batch in batches:
            at, flat, values = arrays(batch)
            chunks, states = batch.column("__chunk").to_pylist(), [batch.column(c).to_numpy(zero_copy_only=False) for c in ("__z1", "__z2")]
            out = np.empty(len(values))
            for k, c in enumerate(chunks):
                x = values[at[k] : at[k + 1]]
                out[at[k] : at[k + 1]] = system.run(x, np.array([states[0][k], states[1][k]]) if c else system.primed(x))[0]
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            for first in range(0, len(out), SAMPLES):
                some = slice(first, first + SAMPLES)
                own = [batch.column(c).take(pa.array(row[some])) for c in by]
                yield pa.RecordBatch.from_arrays([*own, flat.field(0)[some], flat.field(1)[some], pa.array(out[some])], names=[*by, pos, value, "filtered"])

    # only a chunk that is whole has one after it
    states = packed.where(F.size("__s") >= chunk).mapInArrow(ends, f"{named}, __z1 double, __z2 double")
    states = states.groupBy(*by).applyInPandas(along, f"{named}, __z1 double, __z2 double")
    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*by, pos, value).schema)
    return packed.join(states, keys, "left").mapInArrow(filtered, f"{rows}, filtered double")


def highpass_arrays(pieces: DataFrame, by: list[str], pos: str, values: str, rate: str, keep: list[str], chunk: int = 1 << 17) -> DataFrame:
    """by, pos, keep and values, filtered: the arrays of each group of `by`, that at pos (from 0, without holes) first.
    No row a sample is made. As highpass_segments: states of chunks from none, the states along a group's chunks, then
    the samples from these; a chunk is longer than what primes the filter."""
    number = F.floor(F.col(pos) / F.greatest(F.lit(chunk), 40 * F.col("__rate")))
    rows = pieces.select(*by, pos, values, F.col(rate).alias("__rate"), *keep).withColumn("__chunk", number)
    keys, kinds = [*by, "__chunk"], {f.name: f.dataType.simpleString() for f in rows.schema}
    named = lambda columns: ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        system, x = recursion(float(rows["__rate"].iloc[0])), np.concatenate(rows.sort_values(pos)[values].to_list())
        state = system.run(x, np.zeros(2) if key[-1] else system.primed(x))[1]
        return pd.DataFrame([(*key, rows["__rate"].iloc[0], len(x), *state)], columns=[*keys, "__rate", "__n", "__z1", "__z2"])

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        system, rows, state, found = recursion(float(rows["__rate"].iloc[0])), rows.sort_values("__chunk"), np.zeros(2), []
        for c, n, z1, z2 in zip(rows["__chunk"], rows["__n"], rows["__z1"], rows["__z2"], strict=True):
            found.append(state)
            state = (system.after(n) @ state if c else 0.0) + np.array([z1, z2])
        return rows[keys].assign(__z1=[s[0] for s in found], __z2=[s[1] for s in found])

    def filtered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        system, rows = recursion(float(rows["__rate"].iloc[0])), rows.sort_values(pos)
        x = np.concatenate(rows[values].to_list())
        state = rows[["__z1", "__z2"]].iloc[0].to_numpy(float) if key[-1] else system.primed(x)
        out = np.split(system.run(x, state)[0], np.cumsum([len(v) for v in rows[values]])[:-1])
        return rows[[*by, pos, *keep]].assign(**{values: out})[[*by, pos, values, *keep]]

    states = rows.groupBy(*keys).applyInPandas(ends, f"{named([*keys, '__rate'])}, __n long, __z1 double, __z2 double")
    states = states.groupBy(*by).applyInPandas(along, f"{named(keys)}, __z1 double, __z2 double")
    return rows.join(states, keys).groupBy(*keys).applyInPandas(filtered, named([*by, pos, values, *keep]))


def band_share(samples: DataFrame, by: list[str], pos: str, value: str, rate: float, low: float, high: float) -> DataFrame:
    """by, n and share: amplitude between low and high Hz over all but the constant part, by real FFT."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(pos)[value].to_numpy(float)
        amp, freq = np.abs(np.fft.rfft(x)), np.fft.rfftfreq(len(x), 1 / rate)
        whole = amp[1:].sum()
        share = float(amp[(freq >= low) & (freq <= high) & (freq > 0)].sum() / whole) if whole else 0.0
        return pd.DataFrame([(*keys, len(x), share)], columns=[*by, "n", "share"])

    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in by)
    return samples.groupBy(*by).applyInPandas(run, f"{kinds}, n long, share double")
