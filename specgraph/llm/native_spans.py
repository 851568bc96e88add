"""Match positions with SQL functions only.

``regexp_extract_all`` gives the matches and ``split`` at the same pattern gives
what stands between them, so lengths add up to code-point positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string>"


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Callable[[Column], Column] | None]]) -> DataFrame:
    """One array<struct<start,end,match>> column for each name: the leftmost non-overlapping matches that pass its test.

    A null text has no matches.  Patterns must not match the empty string.
    """
    found = df.withColumns({f"{n}__m": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, (p, _) in patterns.items()})
    cut = found.withColumns({f"{n}__g": F.when(F.size(f"{n}__m") > 0, F.split(text, p, -1)) for n, (p, _) in patterns.items()})

    def spans(n: str, test: Callable[[Column], Column] | None) -> Column:
        none = F.array().cast(f"array<{SPAN}>")

        def step(done: Column, i: Column) -> Column:
            match = F.get(F.col(f"{n}__m"), i)
            start = done["at"] + F.length(F.get(F.col(f"{n}__g"), i))
            end = start + F.length(match)
            more = F.concat(done["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), match.alias("match"))))
            return F.struct(end.alias("at"), (more if test is None else F.when(test(match), more).otherwise(done["spans"])).alias("spans"))

        all_of = F.aggregate(F.sequence(F.lit(0), F.size(f"{n}__m") - 1), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda x: x["spans"])
        return F.when(F.size(f"{n}__m") > 0, all_of).otherwise(none)

    return cut.withColumns({n: spans(n, test) for n, (_, test) in patterns.items()}).drop(*(f"{n}__{x}" for n in patterns for x in "mg"))


def merged(kinds: list[str]) -> Column:
    """array<struct<start,rank,end,kind>> of the span columns named, by start, then in the order listed."""

    def ranked(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[ranked(i, k) for i, k in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: it stands as a lambda variable wherever ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def normal_cdf(z: Column) -> Column:
    """Logistic approximation of the normal distribution function (error below 2e-4)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-1.5976 * z - 0.07056 * z * z * z))
