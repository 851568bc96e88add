"""Text forms of identified peptides.

``mods`` is array<struct<pos:int,mass:double>>, positions counted from 1; a mass is
written after its residue.  Terminal masses that are null or zero are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _render(peptide: Column, mods: Column, nterm: Column, cterm: Column, mass: Callable[[Column], Column]) -> Column:
    by_place = F.array_sort(F.coalesce(mods, F.array().cast("array<struct<pos:int,mass:double>>")))

    def residue(i: Column) -> Column:
        own = F.filter(by_place, lambda m: m["pos"] == i)
        return F.concat(F.substring(peptide, i, F.lit(1)), F.array_join(F.transform(own, lambda m: F.concat(F.lit("["), mass(m["mass"]), F.lit("]"))), ""))

    def end(letter: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit(0.0)) != 0, F.concat(F.lit(f"{letter}["), mass(value), F.lit("]"))).otherwise("")

    body = F.when(F.length(peptide) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(peptide)), residue), "")).otherwise("")
    return F.concat(end("n", nterm), body, end("c", cterm))


def with_masses(peptide: Column, mods: Column, nterm: Column, cterm: Column) -> Column:
    """n[43.0]PEP[160.03]TIDE with masses as doubles."""
    return _render(peptide, mods, nterm, cterm, lambda m: m.cast("string"))


def with_integer_masses(peptide: Column, mods: Column, nterm: Column, cterm: Column) -> Column:
    """n[43]PEP[160]TIDE: masses cut to whole numbers."""
    return _render(peptide, mods, nterm, cterm, lambda m: m.cast("long").cast("string"))


def identity(peptide: Column, charge: Column) -> Column:
    """The key that counts identifications: text form and charge."""
    return F.concat(peptide, F.lit("/"), charge.cast("string"))


def display(text: Column, charge: Column, probability: Column, is_decoy: Column, prev_aa: Column, next_aa: Column) -> Column:
    """DECOY_K.n[43.0]PEPTIDE.R/2 (0.9876): ``text`` is the peptide with its modifications, missing neighbours are empty, the probability as it is."""
    return F.concat(
        F.when(is_decoy, F.lit("DECOY_")).otherwise(""), F.coalesce(prev_aa, F.lit("")), F.lit("."), text, F.lit("."), F.coalesce(next_aa, F.lit("")), F.lit("/"), charge.cast("string"), F.lit(" ("), probability.cast("string"), F.lit(")")
    )


def histogram_text(counts: Column) -> Column:
    """a:3;b:1 from array<struct<n,iden>> that is in order."""
    return F.array_join(F.transform(counts, lambda c: F.concat(c["iden"], F.lit(":"), c["n"].cast("string"))), ";")


def histogram_map(text: Column) -> Column:
    """map<string,bigint> from a:3;b:1; names may hold colons."""
    parts = F.filter(F.split(text, ";"), lambda p: F.length(p) > 0)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^(.*):([0-9]+)$", 1), F.regexp_extract(p, "^(.*):([0-9]+)$", 2).cast("long"))))
