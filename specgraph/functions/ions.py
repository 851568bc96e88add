"""Fragment ions of peptides: prefix and suffix sums of residue masses, in six series and by charge.

A modification's mass is that of the whole residue, a terminal mass that of the whole end (as in identification files),
so they replace what is there without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Monoisotopic masses of amino-acid residues.
RESIDUES = {
    "A": 71.03711381, "C": 103.00918451, "D": 115.02694302, "E": 129.04259309, "F": 147.06841391, "G": 57.02146374, "H": 137.05891186, "I": 113.08406398, "K": 128.09496302, "L": 113.08406398, "M": 131.04048461,
    "N": 114.04292744, "O": 237.14772668, "P": 97.05276388, "Q": 128.05857751, "R": 156.10111102, "S": 87.03202841, "T": 101.04767847, "U": 150.95363508, "V": 99.06841391, "W": 186.07931295, "Y": 163.06332853,
}
PROTON, HYDROGEN, WATER, AMMONIA, CARBON_MONOXIDE = 1.007276466879, 1.00782503207, 18.0105646863, 17.0265491015, 27.9949146221
#: Series: from which end, and what is added to the sum of residues.
SERIES = {
    "a": ("prefix", -CARBON_MONOXIDE), "b": ("prefix", 0.0), "c": ("prefix", AMMONIA),
    "x": ("suffix", WATER + CARBON_MONOXIDE - 2 * HYDROGEN), "y": ("suffix", WATER), "z": ("suffix", WATER - AMMONIA),
}


def residue_masses(peptide: Column, mods: Column) -> Column:
    """Mass of each residue, modified ones by their own mass; null for letters that name none."""
    known = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    own = F.map_from_entries(F.filter(F.coalesce(mods, F.array().cast("array<struct<pos:int,mass:double>>")), lambda m: m["pos"].isNotNull()))
    return F.transform(F.split(peptide, ""), lambda r, i: F.coalesce(F.try_element_at(own, i + 1), F.try_element_at(known, r)))


def _sums(masses: Column) -> Column:
    """Sums of the first 1, 2, ... masses, but not of all of them; null from the first unknown one on."""
    step = lambda done, m: F.struct((done["sum"] + m).alias("sum"), F.concat(done["all"], F.array(done["sum"] + m)).alias("all"))
    whole = F.aggregate(masses, F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")), step, lambda d: d["all"])
    return F.slice(whole, 1, F.greatest(F.size(masses) - 1, F.lit(0)))


def fragment_ions(peptides: DataFrame, series: str = "abcxyz", least_charge: int = 1) -> DataFrame:
    """(*others, series, number, z, ion, mz) of rows with peptide, mods, nterm_mod, cterm_mod and charge: every ion of charge ``least_charge`` to ``charge``.

    ``number`` counts residues from the ion's end of the peptide; ``ion`` is b3++ and the like.  Terminal masses that are null or
    zero are none.  An ion that holds an unknown residue has no mass and is left out; null peptides, ones of a single residue
    and rows without a charge have no ions.
    """
    masses = residue_masses(F.col("peptide"), F.col("mods"))
    end = lambda c, plain: F.when(F.coalesce(c, F.lit(0.0)) != 0, F.col(c) - plain).otherwise(F.lit(0.0))
    summed = peptides.withColumns({"prefix": _sums(masses), "suffix": _sums(F.reverse(masses)), "_first": end("nterm_mod", HYDROGEN), "_last": end("cterm_mod", WATER - HYDROGEN)})
    kinds = F.array(*[F.struct(F.lit(s).alias("series"), F.lit(SERIES[s][0] == "prefix").alias("from_start"), F.lit(SERIES[s][1]).alias("plus")) for s in series])
    charges = F.when(F.col("charge") >= least_charge, F.sequence(F.lit(least_charge), F.col("charge")))
    each = summed.withColumn("_k", F.explode(kinds)).withColumn("z", F.explode(charges))
    sums = F.when(F.col("_k.from_start"), F.col("prefix")).otherwise(F.col("suffix"))
    others = [c for c in peptides.columns if c not in ("peptide", "mods", "nterm_mod", "cterm_mod", "charge")]
    rows = each.select(*others, "_k", "z", F.when(F.col("_k.from_start"), F.col("_first")).otherwise(F.col("_last")).alias("_end"), F.posexplode(sums).alias("_i", "_sum")).where("_sum is not null")
    mz = (F.col("_sum") + F.col("_end") + F.col("_k.plus") + F.col("z") * F.lit(PROTON)) / F.col("z")
    number = F.col("_i") + 1
    return rows.select(*others, F.col("_k.series").alias("series"), number.alias("number"), "z", F.concat(F.col("_k.series"), number.cast("string"), F.repeat(F.lit("+"), F.col("z"))).alias("ion"), mz.alias("mz"))


def annotated_peaks(peaks: DataFrame, ions: DataFrame, bins_per_th: int = 1) -> DataFrame:
    """(node_id, bin, intensity, ions) of observed peaks (node_id, mz, intensity), summed by truncated m/z, with the names of the ions that fall there; bins without ions are left out."""
    at = lambda df: df.withColumn("bin", F.floor(F.col("mz").cast("double") * bins_per_th).cast("int"))
    seen = at(peaks).groupBy("node_id", "bin").agg(F.sum("intensity").alias("intensity"))
    named = at(ions).groupBy("node_id", "bin").agg(F.array_sort(F.collect_set("ion")).alias("ions"))
    return seen.join(named, ["node_id", "bin"])
