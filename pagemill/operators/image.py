"""Scan clean-up on gray images: contrast, local threshold, skew, rotation, in one Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_gray(rgba: np.ndarray) -> np.ndarray:
    """Integer luma of an (h, w, 4) image."""
    c = rgba[..., :3].astype(np.uint32)
    return ((c[..., 0] * 77 + c[..., 1] * 150 + c[..., 2] * 29) >> 8).astype(np.uint8)


def stretch(gray: np.ndarray) -> np.ndarray:
    """The first percentile to 0 and the last to 255; flat images stay."""
    upto = np.cumsum(np.bincount(gray.ravel(), minlength=256))
    lo, hi = (int(np.searchsorted(upto, gray.size * p)) for p in (0.01, 0.99))
    if hi - lo < 10:
        return gray
    return np.clip((gray.astype(float) - lo) * 255 / (hi - lo) + 0.5, 0, 255).astype(np.uint8)


def binarize(gray: np.ndarray, k: float = 0.2) -> np.ndarray:
    """Black where a pixel is under mean * (1 + k * (deviation / 128 - 1)) of its window."""
    h, w = gray.shape
    half = max(15, (min(w, h) // 40) | 1) // 2
    y0, y1 = np.maximum(np.arange(h) - half, 0), np.minimum(np.arange(h) + half + 1, h)
    x0, x1 = np.maximum(np.arange(w) - half, 0), np.minimum(np.arange(w) + half + 1, w)

    def box(a):
        s = np.pad(a.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]

    n = np.outer(y1 - y0, x1 - x0)
    mean = box(gray) / n
    dev = np.sqrt(np.maximum(0, box(gray.astype(float) ** 2) / n - mean**2))
    return np.where(gray < mean * (1 + k * (dev / 128 - 1)), 0, 255).astype(np.uint8)


def skew(gray: np.ndarray, widest: int = 900) -> float:
    """Degrees within six that give the sharpest row profile of ink; 0 where there is little ink."""
    step = max(1.0, gray.shape[1] / widest)
    small = gray[(np.arange(int(gray.shape[0] / step)) * step).astype(int)][:, (np.arange(int(gray.shape[1] / step)) * step).astype(int)]
    y, x = np.nonzero(small < 128)
    if len(y) < 200:
        return 0.0

    def sharpness(deg):
        rows = np.floor(y - x * np.tan(np.radians(deg))).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    best = max(np.arange(-6, 6.01, 0.5), key=sharpness)
    return float(round(max(np.arange(best - 0.5, best + 0.51, 0.1), key=sharpness), 2))


def rotate(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle, bilinear, white outside."""
    if abs(degrees) < 0.05:
        return gray
    h, w = gray.shape
    a = np.radians(degrees)
    yy, xx = np.mgrid[:h, :w]
    dx, dy = xx - w / 2, yy - h / 2
    sx, sy = w / 2 + dx * np.cos(a) - dy * np.sin(a), h / 2 + dx * np.sin(a) + dy * np.cos(a)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < w - 1) & (y0 < h - 1)
    x0, y0 = np.clip(x0, 0, w - 2), np.clip(y0, 0, h - 2)
    g = gray.astype(float)
    v = (g[y0, x0] * (1 - fx) + g[y0, x0 + 1] * fx) * (1 - fy) + (g[y0 + 1, x0] * (1 - fx) + g[y0 + 1, x0 + 1] * fx) * fy
    return np.where(inside, np.clip(v + 0.5, 0, 255), 255).astype(np.uint8)


def clean(gray: np.ndarray) -> tuple[np.ndarray, float]:
    out = stretch(gray)
    angle = skew(out)
    return binarize(rotate(out, angle) if abs(angle) >= 0.2 else out), angle


def preprocess(images: DataFrame) -> DataFrame:
    """Adds ``cleaned`` (data, angle) to rows with data (binary gray), width, height."""

    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        got = [clean(np.frombuffer(d, np.uint8).reshape(h, w)) for d, w, h in zip(data, width, height)]
        return pd.DataFrame({"data": [g.tobytes() for g, _ in got], "angle": [a for _, a in got]})

    return images.withColumn("cleaned", F.pandas_udf(run, "data binary, angle double")("data", "width", "height"))
