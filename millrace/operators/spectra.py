"""Fourier transforms of series of any length, no part of which is more than about a square root of it.

A transform of length R * C goes in four steps: the numbers are dealt by columns, each column (R numbers) is
transformed, turned by its twiddle factors and dealt again by rows, and each row (C numbers) is transformed. A series
of any length n becomes a convolution with a chirp, for which three transforms of a power of two over 2 n - 1 do.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cut import checkpointed
from millrace.operators.quantiles import matched


def _transformed(numbers: DataFrame, key: Sequence[str], inverse: bool = False) -> DataFrame:
    """key, __k, __re, __im, __r, __c from key, __j, __re, __im, __r, __c: the transform of r * c numbers of each key; those not given are 0."""
    sign = 1 if inverse else -1
    kinds = {f.name: f.dataType.simpleString() for f in numbers.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in key], "__a bigint, __b bigint, __re double, __im double, __r bigint, __c bigint"])

    def step(of: str, at: str, size: str, turn: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            r, c, one = int(pdf["__r"].iloc[0]), int(pdf["__c"].iloc[0]), int(pdf[of].iloc[0])
            n = r if size == "__r" else c
            x = np.zeros(n, dtype=complex)
            x[pdf[at].to_numpy()] = pdf["__re"].to_numpy() + 1j * pdf["__im"].to_numpy()
            y = np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * n
            place = np.arange(n)
            if turn:
                y = y * np.exp(sign * 2j * np.pi * (one * place % (r * c)) / (r * c))
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] * n for k in key}, "__a": one, "__b": place, "__re": y.real, "__im": y.imag, "__r": r, "__c": c})

        return run

    columns = numbers.withColumn("__column", F.col("__j") % F.col("__c")).withColumn("__row", F.floor(F.col("__j") / F.col("__c")))
    turned = columns.groupBy(*key, "__column").applyInPandas(step("__column", "__row", "__r", True), schema)
    rows = turned.withColumnsRenamed({"__a": "__column", "__b": "__row"})
    out = rows.groupBy(*key, "__row").applyInPandas(step("__row", "__column", "__c", False), schema)
    return out.select(*key, (F.col("__a") + F.col("__r") * F.col("__b")).alias("__k"), "__re", "__im", "__r", "__c")


def spectrum(samples: DataFrame, key: Sequence[str], low: float = 0.0, high: float = 0.5) -> DataFrame:
    """key, __b, __n, __p: the magnitudes of the discrete transform at the bins __b of low * __n to high * __n.

    samples: key, __j (from 0, without gaps), __n, __v.
    """
    key = list(key)
    size = F.ceil(F.log2(2 * F.col("__n") - 1)).cast("long")
    rows = F.pow(F.lit(2.0), F.floor(size / 2)).cast("long")
    sized = samples.select(*key, "__j", "__n", "__v").withColumns({"__r": rows, "__c": (F.pow(F.lit(2.0), size).cast("long") / rows).cast("long")})
    # Whole numbers until the last moment: the squares are far larger than a turn.
    angle = np.pi * (F.col("__j") * F.col("__j") % (2 * F.col("__n"))) / F.col("__n")
    wave = sized.select(*key, F.lit(0).alias("__t"), "__j", (F.col("__v") * F.cos(angle)).alias("__re"), (-F.col("__v") * F.sin(angle)).alias("__im"), "__r", "__c")
    places = F.explode(F.when(F.col("__j") > 0, F.array(F.col("__j"), F.col("__r") * F.col("__c") - F.col("__j"))).otherwise(F.array("__j")))
    chirp = sized.select(*key, F.lit(1).alias("__t"), places.alias("__j"), F.cos(angle).alias("__re"), F.sin(angle).alias("__im"), "__r", "__c")
    both = checkpointed(_transformed(wave.unionByName(chirp), [*key, "__t"]))
    one, other = both.filter("__t = 0").drop("__t"), both.filter("__t = 1").select(*key, "__k", F.col("__re").alias("__re2"), F.col("__im").alias("__im2"))
    met = matched(one, other, [*key, "__k"])
    product = met.select(*key, F.col("__k").alias("__j"), (F.col("__re") * F.col("__re2") - F.col("__im") * F.col("__im2")).alias("__re"), (F.col("__re") * F.col("__im2") + F.col("__im") * F.col("__re2")).alias("__im"), "__r", "__c")
    back = _transformed(product, key, inverse=True)
    sizes = samples.select(*key, "__n").distinct()
    told = matched(back, sizes, key).filter((F.col("__k") >= F.ceil(F.lit(low) * F.col("__n"))) & (F.col("__k") <= F.floor(F.lit(high) * F.col("__n"))))
    return told.select(*key, F.col("__k").alias("__b"), "__n", (F.sqrt(F.col("__re") ** 2 + F.col("__im") ** 2) / (F.col("__r") * F.col("__c"))).alias("__p"))
