"""Personal data in texts: fixed formats, and spans that gradient-boosted trees pick among looser candidates.

Every step over the data is a SQL function.  Generators of high recall propose
spans that may overlap.  Each candidate is described by a pattern: a small
number that packs features of its format (digits, groups, separators, letters)
and of its surroundings (what stands around it, other finds in the text).

The labels come from evidence that the trees don't see:

* checks: sums of check digits, number ranges, the @ and + signs of the fixed
  formats (none of these is a feature);
* key words before a span, which speak for or against it (no feature either);
* a candidate with neither counts as a negative of small weight.

So the trees learn which formats and surroundings go with checked or announced
personal data, and apply that to spans that nothing checks or announces.  Spark
reduces all candidates to counts for each pattern and fold (a bounded table, see
``PATTERN_BITS``).  The trees are fitted to four folds; the fifth, made of other
strings, calibrates their scores by isotonic regression and sets the threshold; with
too few labels there nothing is added.
The trees go back into the query as CASE expressions, and the calibrated score
alone selects.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.llm.native_spans import bound, joined, merged, overlaps, with_spans
from specgraph.storage import write

BASE = ["email", "ip", "card", "phone"]
EXTRA = ["mail_like", "number_like", "phone_like", "ssn_like", "iban_like"]
# A match of email or ip can't start inside a run of its first class unless a match has just ended there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail_like": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "number_like": r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20-]?[0-9]){8,18}+(?![0-9A-Za-z])",
    "phone_like": r"(?<![0-9A-Za-z+])(?:\(?[0-9]{2,4}\)?[\x20.-]){2,4}[0-9]{3,4}(?![0-9A-Za-z])",
    "ssn_like": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban_like": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
SPEAK_FOR = r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|mail|card|visa|account|iban|ssn|social security|telefon|handy|konto|t[ée]l[ée]phone|correo|tarjeta)[^\n]{0,12}$"
SPEAK_AGAINST = r"(?i)(?:(?<!\p{L})(?:order|invoice|version|isbn|issue|ticket|page|chapter|item|serial|model|build|ref|no|nr|v)|[#§])[.:#\x20]{0,3}$"
#: Of these, the ones that say no more than "number": after a word that speaks for a span they say nothing against it.
SAY_NUMBER = r"(?i)(?:(?<!\p{L})(?:ref|no|nr)|#)[.:#\x20]{0,3}$"
CONTEXT = 24
UNLABELLED = 0.05
#: name, number of bits: the features of a pattern, lowest bits first.
FEATURES = [
    ("digits", 3), ("breaks", 2), ("bracket", 1), ("letters", 1), ("hyphens", 1), ("dots", 1), ("glued", 1), ("company", 1), ("after colon", 1), ("line start", 1), ("closed", 1), ("after name", 1),
]
PATTERN_BITS = sum(bits for _, bits in FEATURES)
#: Labels (by weight) of the held-out fold below which nothing is added: fewer can't tell what a threshold is worth.
LEAST_LABELS = 50.0
#: Strings are dealt to so many folds; the first is held out.
FOLDS = 5
ROUNDS, RATE, LEAF_PRIOR = 40, 0.3, 1.0
ACCEPT = 0.9


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Checksum of a string of digits; long ones are false without being read."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: bound(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.when((F.length(digits) < 2) | (F.length(digits) > 32), F.lit(False)).otherwise(F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0)


def octets(match: Column) -> Column:
    """Four parts of at most 255, leading zeros allowed."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when((F.length(p) <= 3) & p.rlike("^[0-9]+$"), p.cast("int")).otherwise(F.lit(999)) <= 255)) & (F.size(F.split(match, r"\.")) == 4)


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return octets(match) if kind == "ip" else F.lit(True)


def check_sum_97(match: Column) -> Column:
    """ISO 7064 check of an international account number: letters count 10 to 35, the first four characters go last."""
    plain = F.regexp_replace(match, r"\x20", "")
    moved = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda r, c: bound(value(c), lambda v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)) == 1


def _announced(before: Column) -> Column:
    """1 and 0 where key words speak for and against a span, else null."""
    # "Phone no: " speaks for its span; other words of both sides ("call order ") leave the label open.
    return F.when(before.rlike(SPEAK_FOR), F.when(~before.rlike(SPEAK_AGAINST) | before.rlike(SAY_NUMBER), 1)).when(before.rlike(SPEAK_AGAINST), 0)


def _label(kind: str, match: Column, before: Column) -> Column:
    """What checks and key words say of a looser candidate."""
    if kind == "iban_like":  # one in 97 strings passes by chance
        return F.when(check_sum_97(match), 1).otherwise(_announced(before))
    if kind == "ssn_like":  # numbers that are never given out
        return F.when(match.rlike("^(?:000|666|9)|-00-|-0000$"), 0).otherwise(_announced(before))
    return _announced(before)


#: Matches that can't be valid or worth a score are dropped at once.
_WORTH = {"email": None, "ip": None, "card": lambda m: F.length(digits_of(m)).between(14, 19), "phone": lambda m: F.length(digits_of(m)).between(7, 17)}


def _pattern(match: Column, before: Column, after: Column, company: Column) -> Column:
    n = F.length(digits_of(match))
    size = F.when(n < 7, 0).when(n < 9, 1).when(n < 10, 2).when(n < 12, 3).when(n < 14, 4).when(n < 17, 5).when(n < 20, 6).otherwise(7)
    breaks = F.least(F.lit(3), F.length(F.regexp_replace(match, r"[^\x20.()-]+", "")))
    flag = lambda c: F.when(c, 1).otherwise(0)
    values = [
        size, breaks, flag(match.contains("(")), flag(match.rlike("[A-Za-z]")), flag(match.contains("-")), flag(match.contains(".")), flag(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")), flag(company),
        flag(before.rlike(r"[:=]\s*$")), flag(before.rlike(r"(?:^|\n)\s*$")), flag(after.rlike(r"^(?:[,.;)\n]|$)")), flag(before.rlike(r"\p{Lu}\p{Ll}+\s+$")),
    ]
    out, shift = F.lit(0), 0
    for (_, bits), v in zip(FEATURES, values):
        out = out + v.cast("int") * (1 << shift)
        shift += bits
    return out


def _described(kind: str, spans: Column, text: Column, company: Column, label) -> Column:
    def one(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.substring(text, begin + 1, s["start"] - begin)
        after = F.substring(text, s["end"] + 1, F.lit(1))
        return bound(
            before,
            lambda b: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.lit(kind).alias("kind"),
                _pattern(s["match"], b, after, company).alias("pattern"), label(s["match"], b).cast("int").alias("label"),
            ),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base spans (email, ip, card, phone), ``fixed`` and ``extra``.

    ``fixed`` describes the base spans; ``extra`` describes what fails its format's check
    (label 0) and what the looser generators propose outside base spans, label null if unknown.
    """
    raw = with_spans(docs.withColumn("pii_text", F.coalesce(F.col(text), F.lit(""))), "pii_text", {k: (p, _WORTH.get(k)) for k, p in PATTERNS.items()})
    checked = raw.withColumns({f"{k}_not": _failing(k) for k in BASE if k != "email"}).withColumns({k: _passing(k) for k in BASE})
    with_base = checked.withColumn("pii_base", F.concat(*[F.col(k) for k in BASE]))
    company = F.size("pii_base") > 1
    here = F.col("pii_text")
    yes, no = (lambda m, b: F.lit(1)), (lambda m, b: F.lit(0))
    out = with_base.withColumn("fixed", F.concat(*[_described(k, F.col(k), here, company, yes) for k in BASE]))
    loose = [_described(k, _outside(F.col(k)), here, company, lambda m, b, k=k: _label(k, m, b)) for k in EXTRA]
    failed = [_described(k, _outside(F.col(f"{k}_not")), here, company, no) for k in BASE if k != "email"]
    return out.withColumn("extra", F.concat(*failed, *loose)).drop(*[f"{k}_not" for k in BASE if k != "email"], *EXTRA, "pii_base", "pii_text")


def _outside(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~overlaps(s, F.col("pii_base")))


def _passing(kind: str) -> Column:
    return F.filter(F.col(kind), lambda s: valid(kind, s["match"]))


def _failing(kind: str) -> Column:
    return F.filter(F.col(kind), lambda s: ~valid(kind, s["match"]))


def pattern_counts(found: DataFrame) -> list[tuple[int, bool, float, float]]:
    """[(pattern, held out, weight of positives, weight of negatives)]: at most 2 ** (PATTERN_BITS + 1) rows, in practice some hundreds.

    A string is held out or not wherever it stands, so copies don't tell the trees about the fold that judges them.
    """
    one = found.select(F.explode(F.concat("fixed", "extra")).alias("c")).withColumn("held", F.pmod(F.xxhash64("c.match"), F.lit(FOLDS)) == 0)
    counts = one.groupBy("c.pattern", "held").agg(
        F.count_if(F.col("c.label") == 1).alias("yes"), F.count_if(F.col("c.label") == 0).alias("no"), F.count_if(F.col("c.label").isNull()).alias("open")
    )
    return sorted((int(r["pattern"]), bool(r["held"]), float(r["yes"]), float(r["no"]) + UNLABELLED * float(r["open"])) for r in counts.collect())


def unpack(patterns: np.ndarray) -> np.ndarray:
    columns, shift = [], 0
    for _, bits in FEATURES:
        columns.append(patterns >> shift & (1 << bits) - 1)
        shift += bits
    return np.stack(columns, 1) if len(patterns) else np.zeros((0, len(FEATURES)), np.int64)


class Trees:
    """Depth-two regression trees on the features of patterns, boosted on the logistic loss.

    ``cut`` is the score from which spans are accepted; ``held_out`` has precision and recall of that on the labels of the held-out fold.
    """

    def __init__(self, counts: list[tuple[int, bool, float, float]]):
        held = [c for c in counts if c[1]]
        counts = [c for c in counts if not c[1]]
        patterns = np.array([c[0] for c in counts], np.int64)
        yes, no = (np.array([c[i] for c in counts], float) for i in (2, 3))
        x, weight = unpack(patterns), yes + no
        self.start = math.log((yes.sum() + 1.0) / (no.sum() + 1.0))
        self.trees: list[tuple] = []
        score = np.full(len(x), self.start)
        splits = [(f, t) for f, (_, bits) in enumerate(FEATURES) for t in range(1, 1 << bits) if len(x) and (x[:, f] >= t).any() and (x[:, f] < t).any()]
        for _ in range(ROUNDS if splits else 0):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = yes - weight * p, weight * p * (1 - p)

            def leaf(rows: np.ndarray) -> float:
                return float(gradient[rows].sum() / (curve[rows].sum() + LEAF_PRIOR))

            def gain(rows: np.ndarray) -> float:
                return float(gradient[rows].sum() ** 2 / (curve[rows].sum() + LEAF_PRIOR))

            def best(rows: np.ndarray) -> tuple:
                return max(((gain(rows & (x[:, f] >= t)) + gain(rows & (x[:, f] < t)), f, t) for f, t in splits), key=lambda s: (s[0], -s[1], -s[2]))

            _, f, t = best(np.ones(len(x), bool))
            sides = []
            for rows in (x[:, f] < t, x[:, f] >= t):
                _, g, u = best(rows)
                low, high = RATE * leaf(rows & (x[:, g] < u)), RATE * leaf(rows & (x[:, g] >= u))
                score[rows] += np.where(x[rows, g] >= u, high, low)
                sides.append((g, u, low, high))
            self.trees.append((f, t, *sides))
        score, yes, no = self.score(np.array([c[0] for c in held], np.int64)), *(np.array([c[i] for c in held], float) for i in (2, 3))
        self.cut = self._calibrate(score, yes, yes + no) if (yes + no).sum() >= LEAST_LABELS else math.inf
        taken = score >= self.cut - 1e-9
        self.held_out = {"precision": float(yes[taken].sum() / max((yes + no)[taken].sum(), 1e-9)), "recall": float(yes[taken].sum() / max(yes.sum(), 1e-9)), "labels": float((yes + no).sum())}

    @staticmethod
    def _calibrate(score: np.ndarray, yes: np.ndarray, weight: np.ndarray) -> float:
        """Lowest score whose isotonic estimate of the share of positives reaches ACCEPT (infinite if none does)."""
        blocks: list[list[float]] = []  # lowest score, positives, weight
        for i in np.argsort(score, kind="stable"):
            blocks.append([float(score[i]), float(yes[i]), float(weight[i])])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                low, y, w = blocks.pop()
                blocks[-1] = [blocks[-1][0], blocks[-1][1] + y, blocks[-1][2] + w]
        return next((low for low, y, w in blocks if w and (y + 0.0) / (w + 1.0) >= ACCEPT), math.inf)

    def score(self, patterns: np.ndarray) -> np.ndarray:
        x = unpack(np.asarray(patterns, np.int64))
        out = np.full(len(x), self.start)
        for f, t, left, right in self.trees:
            for rows, (g, u, low, high) in ((x[:, f] < t, left), (x[:, f] >= t, right)):
                out[rows] += np.where(x[rows, g] >= u, high, low)
        return out

    def expression(self, pattern: Column) -> Column:
        shifts = np.cumsum([0] + [bits for _, bits in FEATURES])
        value = lambda f: F.shiftright(pattern, int(shifts[f])).bitwiseAND((1 << FEATURES[f][1]) - 1)
        out = F.lit(self.start)
        for f, t, left, right in self.trees:
            side = lambda s: F.when(value(s[0]) >= s[1], F.lit(s[3])).otherwise(F.lit(s[2]))
            out = out + F.when(value(f) >= t, side(right)).otherwise(side(left))
        return out


def select(found: DataFrame, trees: Trees) -> DataFrame:
    """``found`` with ``extra`` reduced to the accepted spans: of overlapping ones the best score, then the first."""
    if math.isinf(trees.cut):
        return found.withColumn("extra", F.filter("extra", lambda s: F.lit(False))).drop("fixed")
    scored = F.transform("extra", lambda s: F.struct(trees.expression(s["pattern"]).alias("score"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), s["label"].alias("label")))
    accepted = F.filter(scored, lambda s: s["score"] >= F.lit(trees.cut - 1e-9))
    rank = lambda s: F.struct(s["score"], -s["start"], s["end"], s["kind"])
    lone = lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (rank(o) > rank(s))))
    return found.withColumn("extra", bound(accepted, lone)).drop("fixed")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, extra): spans of each text; extra ones were chosen by the trees.

    Null texts have no spans; null and repeated keys stay row by row; an empty table gives no rows.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = write(candidates(own).drop("text"), "pii").df
    return select(found, Trees(pattern_counts(found)))


def _all_spans() -> Column:
    extra = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(F.concat(merged(BASE), extra))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(merged(BASE)), 256).alias("base_sha256"), joined(_all_spans()).alias("spans"), F.size("extra").cast("long").alias("n_extra")
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets.

    Overlapping spans are replaced once, by the kind of the first.  Null texts stay null, rows that repeat a key or have none
    are treated one by one, other columns stay whatever their names, and an empty table gives no rows.
    """
    columns = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    spans = write(candidates(own), "pii").df  # texts are searched once; rows and spans are read again
    found = select(spans, Trees(pattern_counts(spans))).withColumn("all_spans", _all_spans())

    def step(done: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        gap = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        return F.when(s["start"] >= done["at"], F.struct(s["end"].alias("at"), F.concat(done["out"], gap, label).alias("out"))).otherwise(
            F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("all_spans", start, step, lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    new = F.when(F.size("all_spans") > 0, clean).otherwise(F.col("text"))
    return found.withColumn("new_text", new).select(*[F.col("new_text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in columns])
