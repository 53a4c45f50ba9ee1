"""Where learned models plug in, with simple models that need no training, and the conditional denoising walk.

A model is any object with ``predict(pdf)``: it gets one object's points as a pandas frame, sorted by
id, and returns columns of the same length. It runs once per object inside the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from huepoint.operators.schedules import walk

XYZ, RGB = ["x", "y", "z"], ["r", "g", "b"]


class Model(Protocol):
    def predict(self, pdf: pd.DataFrame) -> pd.DataFrame: ...


def applied(df: DataFrame, model: Model, outputs: str, key: Sequence[str] = ("object_id",)) -> DataFrame:
    """``df`` with the model's output columns (DDL ``outputs``)."""
    names = [c.split()[0] for c in outputs.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in names)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        out = model.predict(pdf)
        return pdf.drop(columns=[c for c in names if c in pdf]).assign(**{c: np.asarray(out[c]) for c in names})

    return df.groupBy(*key).applyInPandas(fn, f"{schema}, {outputs}")


class CentroidSegmenter:
    """Labels by the nearest of given part centroids, in unit-sphere coordinates."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, float)

    @staticmethod
    def normalised(xyz: np.ndarray) -> np.ndarray:
        xyz = xyz - xyz.mean(0)
        return xyz / (np.linalg.norm(xyz, axis=1).max() + 1e-12)

    @classmethod
    def fitted(cls, pdf: pd.DataFrame, parts: int) -> CentroidSegmenter:
        u = cls.normalised(pdf[XYZ].to_numpy(float))
        return cls(np.stack([u[pdf["part"] == p].mean(0) if (pdf["part"] == p).any() else np.full(3, np.inf) for p in range(parts)]))

    def predict(self, pdf: pd.DataFrame) -> pd.DataFrame:
        u = self.normalised(pdf[XYZ].to_numpy(float))
        return pd.DataFrame({"part": ((u[:, None] - self.centroids[None]) ** 2).sum(2).argmin(1)})


class PartMeanNoise:
    """Noise estimate that pulls every point towards its part's mean of the known colours (all known ones for a part without)."""

    def estimate(self, x: np.ndarray, abar: float, pdf: pd.DataFrame, known: np.ndarray, clean: np.ndarray) -> np.ndarray:
        whole = clean[known].mean(0) if known.any() else np.zeros(3)
        x0 = np.tile(whole, (len(x), 1))
        part = pdf["part"].to_numpy()
        for p in np.unique(part):
            own = known & (part == p)
            if own.any():
                x0[part == p] = clean[own].mean(0)
        return (x - np.sqrt(abar) * x0) / np.sqrt(1 - abar)


class Inpainter:
    """Colours of missing points by a diffusion walk conditioned on the known ones.

    Steps down denoise and put the known colours' noised values back; steps up noise again. ``noise`` is
    any estimator with PartMeanNoise's method; the generator is seeded by the object's first id. A step up to
    time t takes t's own rates, so that noise levels are exact (some walks take those of the time left). A column
    ``resamples`` (``metrics.part_visibility`` counts it) says how often an object resamples, else ``samples``.
    """

    def __init__(self, noise, steps: int = 50, length: int = 10, samples: int = 2, seed: int = 0):
        self.noise, self.steps, self.seed = noise, steps, seed
        self.length = length
        t = np.arange(steps + 1) / steps
        f = np.cos((t + 0.008) / 1.008 * np.pi / 2) ** 2
        self.beta = np.clip(1 - f[1:] / f[:-1], 1e-8, 0.999)
        self.alpha = 1 - self.beta
        self.abar = np.cumprod(self.alpha)
        self.times = walk(steps, length, samples)

    def predict(self, pdf: pd.DataFrame) -> pd.DataFrame:
        known = ~pdf["is_missing"].to_numpy(bool)
        times = walk(self.steps, self.length, int(pdf["resamples"].iloc[0])) if "resamples" in pdf else self.times
        clean = 2 * pdf[RGB].to_numpy(float) - 1
        rng = np.random.default_rng([self.seed, zlib.crc32(str(pdf["point_id"].iloc[0]).encode())])
        x = rng.standard_normal(clean.shape)
        for t, after in zip(times[:-1], times[1:]):
            if after > t:
                x = np.sqrt(self.alpha[after]) * x + np.sqrt(self.beta[after]) * rng.standard_normal(x.shape)
                continue
            abar, before = self.abar[t], self.abar[t - 1] if t else 1.0
            eps = self.noise.estimate(x, abar, pdf, known, clean)
            x0 = np.clip((x - np.sqrt(1 - abar) * eps) / np.sqrt(abar), -1, 1)
            x = self.beta[t] * np.sqrt(before) / (1 - abar) * x0 + (1 - before) * np.sqrt(self.alpha[t]) / (1 - abar) * x
            if t:
                x += np.sqrt(self.beta[t] * (1 - before) / (1 - abar)) * rng.standard_normal(x.shape)
            x[known] = np.sqrt(before) * clean[known] + (np.sqrt(1 - before) * rng.standard_normal(clean[known].shape) if t else 0)
        out = np.clip((x + 1) / 2, 0, 1)
        return pd.DataFrame({f"pred_{c}": out[:, i] for i, c in enumerate(RGB)})


def reads_only(df: DataFrame, query: Callable[[DataFrame], DataFrame], hidden: str, change) -> bool:
    """Whether the query's rows stay the same when a column that it must not read is changed."""
    a, b = query(df), query(df.withColumn(hidden, change))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
