"""A trained projection of token vectors: linear, GELU, linear, unit length, from weights in a table.

The weights travel to every task; how many numbers they are is counted first, and a table beyond the bound is an
error. A text's tokens stay one array, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanefold.functions.vectors import EPS

MAX_NUMBERS = 16_000_000
# A rational approximation of the error function, off by 1.5e-7 at most.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + ERF_P * np.abs(x))
    series = np.zeros_like(t)
    for a in reversed(ERF_A):
        series = (series + a) * t
    return np.sign(x) * (1 - series * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + erf(x / np.sqrt(2.0)))


class ProjectionHead:
    """Layers from a table (layer, unit, weights, bias); units and layers count from 0."""

    def __init__(self, table: DataFrame) -> None:
        rows = table.select("layer", "unit", F.col("weights").cast("array<double>").alias("weights"), F.col("bias").cast("double").alias("bias"))
        n, layers = rows.agg(F.coalesce(F.sum(F.size("weights") + 1), F.lit(0)), F.collect_set("layer")).first()
        if n > MAX_NUMBERS:
            raise ValueError(f"a head of {n} numbers; at most {MAX_NUMBERS} travel to every task")
        if sorted(layers) != [0, 1]:
            raise ValueError(f"a head has the layers 0 and 1; got {sorted(layers)}")
        self.layers = []
        for layer in (0, 1):
            units = rows.where(F.col("layer") == layer).orderBy("unit").collect()
            if [u["unit"] for u in units] != list(range(len(units))):
                raise ValueError(f"units of layer {layer} are not 0 to {len(units) - 1}, each once")
            if len({len(u["weights"]) for u in units}) != 1:
                raise ValueError(f"units of layer {layer} differ in width")
            self.layers.append((np.array([u["weights"] for u in units]), np.array([u["bias"] for u in units])))
        if self.layers[1][0].shape[1] != len(self.layers[0][1]):
            raise ValueError("the second layer does not take what the first one gives")
        self.shared = table.sparkSession.sparkContext.broadcast(self.layers)

    @property
    def dim(self) -> int:
        return len(self.layers[1][1])

    def forward(self, tokens: Column) -> Column:
        """Token vectors (array of arrays) to unit vectors of the head's width; null stays null, no tokens stay none."""
        shared = self.shared

        @F.arrow_udf("array<array<double>>")
        def run(docs: pa.Array) -> pa.Array:
            (w0, b0), (w1, b1) = shared.value
            each = docs.flatten()
            flat = each.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != len(each) * w0.shape[1]:
                raise ValueError(f"dim mismatch: expected tokens of width {w0.shape[1]}")
            out = gelu(flat.reshape(-1, w0.shape[1]) @ w0.T + b0) @ w1.T + b1
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), EPS)
            ends = np.arange(len(out) + 1, dtype=np.int32) * len(b1)
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
            counts = docs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.cumsum(counts)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(starts), vectors, mask=docs.is_null())

        return run(tokens)
