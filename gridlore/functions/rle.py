"""Run-length masks: column-major runs that begin with zeros, as in the public COCO format."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(mask: np.ndarray) -> list[int]:
    flat = np.asarray(mask, bool).ravel(order="F")
    if not flat.size:
        return [0]
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], edges, [flat.size]])).tolist()
    return ([0] if flat[0] else []) + runs


def decode(counts: Iterable[int], h: int, w: int) -> np.ndarray:
    runs = list(counts)
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    return flat.reshape((h, w), order="F")


def to_text(counts: Iterable[int]) -> str:
    """The compact text form: differences from two runs back, five bits a character."""
    runs, out = list(counts), []
    for i, run in enumerate(runs):
        x = run - runs[i - 2] if i > 2 else run
        while True:
            low, x = x & 31, x >> 5
            done = x == (-1 if low & 16 else 0)
            out.append(chr(48 + (low if done else low | 32)))
            if done:
                break
    return "".join(out)


def from_text(text: str | bytes) -> list[int]:
    text = text.decode() if isinstance(text, bytes) else text
    runs, value, shift = [], 0, 0
    for ch in text:
        bits = ord(ch) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            value -= (1 << shift) if bits & 16 else 0
            runs.append(value + (runs[-2] if len(runs) > 2 else 0))
            value = shift = 0
    return runs


def iou(a: np.ndarray, b: np.ndarray) -> float:
    union = int((a | b).sum())
    return int((a & b).sum()) / union if union else 0.0


def fill(xs: np.ndarray, ys: np.ndarray, h: int, w: int, mode: str = "round") -> np.ndarray:
    """Pixels whose centre is inside a ring (even-odd), its vertices rounded half-even or truncated first."""
    snap = np.rint if mode == "round" else np.trunc
    x, y = snap(np.asarray(xs, float)), snap(np.asarray(ys, float))
    px, py = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    inside = np.zeros((h, w), bool)
    for i in range(len(x)):
        j = i - 1
        if y[i] != y[j]:
            inside ^= ((y[i] > py) != (y[j] > py)) & (px < (x[j] - x[i]) * (py - y[i]) / (y[j] - y[i]) + x[i])
    return inside


# Functions of columns make their pandas functions anew, so that no module holds one that is bound to a session.


def rle_encode_rows(flat, h, w) -> Column:
    """Row-major booleans of a mask to its runs."""
    return F.pandas_udf(lambda f, a, b: pd.Series([encode(np.asarray(x, bool).reshape(i, j)) for x, i, j in zip(f, a, b, strict=True)]), T.ArrayType(T.IntegerType()))(flat, h, w)


def rle_decode_rows(counts, h, w) -> Column:
    return F.pandas_udf(lambda c, a, b: pd.Series([decode(x, i, j).ravel().tolist() for x, i, j in zip(c, a, b, strict=True)]), T.ArrayType(T.BooleanType()))(counts, h, w)


def rle_text(counts) -> Column:
    return F.pandas_udf(lambda c: pd.Series([to_text(x) for x in c]), T.StringType())(counts)


def rle_from_text(text) -> Column:
    return F.pandas_udf(lambda t: pd.Series([from_text(x) for x in t]), T.ArrayType(T.IntegerType()))(text)


def box_runs(x0: int, y0: int, x1: int, y1: int, size: int) -> np.ndarray:
    """(begin, end) of the runs of ones of a filled box in a square tile, clipped to it, column by column."""
    x0, y0, x1, y1 = (min(max(int(v), 0), size) for v in (x0, y0, x1, y1))
    columns = np.arange(x0, x1) * size
    return np.stack([columns + y0, columns + y1], axis=1) if y1 > y0 else np.zeros((0, 2), int)


def runs_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of two masks given as sorted runs of ones, without their pixels."""
    size = lambda r: int((r[:, 1] - r[:, 0]).sum())
    upto = np.concatenate([[0], np.cumsum(b[:, 1] - b[:, 0])])

    def below(x: np.ndarray) -> np.ndarray:
        """Ones of b before each place."""
        k = np.searchsorted(b[:, 0], x, side="right")
        last = np.where(k > 0, np.minimum(x, b[k - 1, 1]) - b[k - 1, 0], 0) if len(b) else np.zeros(len(x), int)
        return np.where(k > 0, upto[k - 1] + last, 0)

    both = int((below(a[:, 1]) - below(a[:, 0])).sum())
    union = size(a) + size(b) - both
    return both / union if union else 0.0
