"""Sequence and quality-string functions that need arrays of numbers: Arrow-batched numpy over equal lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def gc_content(seq: Column) -> Column:
    """Share of C and G; other letters count in the length. Null for an empty sequence."""
    s = F.upper(seq)
    return (F.length(s) - F.length(F.translate(s, "CG", ""))) / F.nullif(F.length(s), F.lit(0))


def gc_content_without_n(seq: Column) -> Column:
    """Share of C and G among bases other than N."""
    return gc_content(F.translate(F.upper(seq), "N", ""))


def _by_length(strings: pd.Series):
    """Rows of equal length together, as bytes; null, empty and non-ASCII strings are left out."""
    fine = strings.map(lambda s: isinstance(s, str) and s != "" and s.isascii())
    own = strings[fine]
    for n, rows in own.groupby(own.map(len)).groups.items():
        yield n, rows, np.frombuffer("".join(own.loc[rows]).encode(), np.uint8).reshape(len(rows), n)


@F.pandas_udf(_doubles("intercept", "slope", "r"))
def quality_line(qual: pd.Series) -> pd.DataFrame:
    """Least squares of quality over position 1..L and Pearson's r; r is null for constant quality, all null below two bases."""
    out = pd.DataFrame(np.nan, index=qual.index, columns=["intercept", "slope", "r"])
    for n, rows, raw in _by_length(qual):
        if n < 2:
            continue
        y = raw.astype(float) - 33
        x = np.arange(1, n + 1) - (n + 1) / 2
        sxx, mean = (x * x).sum(), y.mean(1)
        sxy = y @ x
        syy = ((y - mean[:, None]) ** 2).sum(1)
        slope = sxy / sxx
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(syy > 1e-12, sxy / np.sqrt(sxx * syy), np.nan)
        out.loc[rows] = np.column_stack([mean - slope * (n + 1) / 2, slope, r])
    return out.astype(object).where(out.notna(), None)


def pair_distances(raw: np.ndarray) -> np.ndarray:
    """Mean distance of positions of base a from positions of base b, for rows of one length; 0 where a base is missing.

    The sum of all distances comes from running counts: a step between two positions counts once for each pair on either
    side of it. So a row costs its length, not its square.
    """
    rows, n = raw.shape
    up = raw & 0xDF
    on = np.stack([up == ord(b) for b in BASES], 1).astype(np.float64)
    upto = on.cumsum(2)[:, :, :-1]
    count = on.sum(2)
    after = count[:, :, None] - upto
    total = np.einsum("ran,rbn->rab", upto, after)
    total = total + total.transpose(0, 2, 1)
    pairs = count[:, :, None] * count[:, None, :]
    return np.divide(total, pairs, out=np.zeros_like(total), where=pairs > 0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def distance_matrix(seq: pd.Series) -> pd.Series:
    """The 4 x 4 matrix of :func:`pair_distances` by rows, bases in the order A, C, G, T."""
    out = pd.Series([None] * len(seq), index=seq.index, dtype=object)
    for _, rows, raw in _by_length(seq):
        for at, m in zip(rows, pair_distances(raw).reshape(len(rows), 16)):
            out[at] = m
    return out


@F.pandas_udf(_doubles("eigenval_1", "eigenval_2", "trace", "det"))
def sequence_invariants(seq: pd.Series) -> pd.DataFrame:
    """Two largest eigenvalues, trace and determinant of the distance matrix.

    The k x k block of the bases that occur is scaled to 0..1 by its least and greatest value and set into an identity
    matrix; the trace leaves out the 4 - k ones. Null for fewer than two different bases or a constant block.
    """
    out = pd.DataFrame(np.nan, index=seq.index, columns=["eigenval_1", "eigenval_2", "trace", "det"])
    for _, rows, raw in _by_length(seq):
        m = pair_distances(raw)
        here = np.stack([((raw & 0xDF) == ord(b)).any(1) for b in BASES], 1)
        block = here[:, :, None] & here[:, None, :]
        low = np.where(block, m, np.inf).min((1, 2))
        high = np.where(block, m, -np.inf).max((1, 2))
        k = here.sum(1)
        fine = (k >= 2) & (high > low)
        if not fine.any():
            continue
        scaled = (m[fine] - low[fine, None, None]) / (high - low)[fine, None, None]
        full = np.where(block[fine], scaled, np.eye(4)[None])
        eig = np.linalg.eigvalsh((full + full.transpose(0, 2, 1)) / 2)
        trace = np.trace(full, axis1=1, axis2=2) - (4 - k[fine])
        out.loc[rows[fine]] = np.column_stack([eig[:, 3], eig[:, 2], trace, eig.prod(1)])
    return out.astype(object).where(out.notna(), None)


def zlib_length(level: int = 6, trailing: bool = True):
    """A function that gives the length of a sequence after compression, with one trailing zero byte as in a C string."""

    @F.pandas_udf(T.IntegerType())
    def run(seq: pd.Series) -> pd.Series:
        end = b"\0" if trailing else b""
        return seq.map(lambda s: None if s is None else len(zlib.compress(s.encode("utf-8", "replace") + end, level))).astype("Int32")

    return run
