"""Column functions on peak arrays (array<struct<mz:float,intensity:...>>), and the same filters on long peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(peaks: Column, lo: float, hi: float) -> Column:
    """Peaks with lo <= mz <= hi; (0, 0) keeps all."""
    if lo == 0 and hi == 0:
        return peaks
    return F.filter(peaks, lambda p: p["mz"].between(F.lit(lo).cast("float"), F.lit(hi).cast("float")))


def precursor_mz(mass: Column, charge: Column, true_mass: bool) -> Column:
    return (mass / charge.cast("float")).cast("float") if true_mass else mass


def remove_precursor(peaks: Column, mass: Column, charge: Column, lo: float, hi: float, true_mass: bool = False) -> Column:
    """Peaks outside the closed interval [precursor + lo, precursor + hi]; (0, 0) keeps all."""
    if lo == 0 and hi == 0:
        return peaks
    at = precursor_mz(mass, charge, true_mass)
    return F.filter(peaks, lambda p: (p["mz"] < (at + F.lit(lo).cast("float"))) | (p["mz"] > (at + F.lit(hi).cast("float"))))


def in_range(peaks: DataFrame, lo: float, hi: float) -> DataFrame:
    """``clip`` on long peaks (mz)."""
    return peaks if lo == 0 and hi == 0 else peaks.where(F.col("mz").cast("float").between(F.lit(lo).cast("float"), F.lit(hi).cast("float")))


def outside_precursor(peaks: DataFrame, lo: float, hi: float, true_mass: bool = False) -> DataFrame:
    """``remove_precursor`` on long peaks (mz, mass, charge)."""
    if lo == 0 and hi == 0:
        return peaks
    at, mz = precursor_mz(F.col("mass"), F.col("charge"), true_mass), F.col("mz").cast("float")
    return peaks.where((mz < (at + F.lit(lo).cast("float"))) | (mz > (at + F.lit(hi).cast("float"))))


def is_ascending(peaks: Column) -> Column:
    """Strictly ascending in mz: equal neighbours count as unsorted."""
    n = F.size(peaks)
    return F.when(n < 2, True).otherwise(F.forall(F.zip_with(F.slice(peaks, 1, n - 1), F.slice(peaks, 2, n - 1), lambda a, b: a["mz"] < b["mz"]), lambda x: x))


def by_mz(peaks: Column) -> Column:
    return F.array_sort(peaks)


def bin_of(mz: Column, bins_per_th: int = 1) -> Column:
    """FLOAT multiplication, then truncation towards zero."""
    return (mz.cast("float") * F.lit(bins_per_th).cast("float")).cast("int")
