"""Secrets in texts: fixed formats, and strings that pass a battery of randomness tests far better than ordinary ones.

Every step is a SQL function.  Candidates are runs of at least 20 characters of the base64 alphabets that hold
letters and digits.  Each gets an inferred encoding (hex, base32, base36 or base64) and five tests of "drawn
uniformly from that alphabet": chi-squared uniformity of the symbols, the number of runs above and below the
middle of the alphabet, the lag-one serial correlation of the symbol values, the number of changes between capitals,
small letters and digits, and the number of symbol pairs that are frequent in written languages.  The last two tell
short strings apart, for which the first three have little to go by.  Fisher's method joins the
p values to one score, high for random strings.

What is reported is controlled, not what is cleared.  The null hypothesis is "an ordinary string": names put
together from words and a number, as file names, addresses and identifiers are.  Every document gives one such
string, made of its own words from a place on that is drawn by a hash from the whole text, and a fixed list of function words gives some more (a floor for
small tables).  They are scored by the same battery, so each class of lengths has the distribution of scores of
ordinary strings.  A candidate's p value is the share of ordinary strings of its class that score as high;
Benjamini-Hochberg within each class then bounds the share of ordinary strings among those reported.  Texts are
read once: spans, scores and the scores of ordinary strings are written together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specgraph.llm.html_text import STOP_WORDS
from specgraph.llm.native_spans import bound, joined, merged, normal_cdf, overlaps, with_spans
from specgraph.storage import write

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
BASE = ["assign", "access", "hex"]
PATTERNS = {
    "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, VALUE, 1)) >= 6),
    # A failing run holds no longer run, so the least length may stand in the pattern.
    "access": (r"AKIA[A-Z0-9]{16,}+", None),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", None),
    "random": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
}
#: Encodings from the narrowest on: what a candidate must match, and its alphabet in order of value.
ENCODINGS = [
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
LENGTH_CLASSES = [20, 24, 32, 40, 64, 128]
#: Bins of the joint score: hundredths, and twenty for each power of ten below one hundredth.
BINS = 200
#: Share of ordinary strings tolerated among the random spans reported, in each class of lengths.
RATE = 0.05
#: Ordinary strings of each class from the list of function words.
FLOOR = 200
# Frequent pairs of letters in English, German, French and Spanish.
PAIRS = """
    al an ar as at au be ce ch ci co de ea ed ei en er es ge ha he hi ic ie in io is it la le li ll ma me nd ne ng nt of om on or os ou
    qu ra re ri ro se si st te th ti to ue un ur ve
    """.split()
#: A probability below this counts as this in a test's spread.
LEAST_SHARE = 1e-4


def _kind(c: str) -> str:
    return "D" if c.isdigit() else "U" if c.isupper() else "L" if c.islower() else "S"


def _shares(letters: str) -> tuple[float, float, float]:
    """Of an alphabet's uniform strings: chance that two symbols are of one kind, that three are, and that a pair is frequent."""
    kinds = [sum(_kind(c) == k for c in letters) / len(letters) for k in "DULS"]
    pairs = sum((a + b).lower() in PAIRS for a in letters for b in letters) / len(letters) ** 2
    return sum(x**2 for x in kinds), sum(x**3 for x in kinds), max(pairs, LEAST_SHARE)


def _encoding(token: Column) -> Column:
    """(letters, same, third, pair) of the narrowest encoding that the token fits."""
    known = [F.struct(F.lit(letters).alias("letters"), *[F.lit(x).alias(n) for n, x in zip(("same", "third", "pair"), _shares(letters))]) for _, letters in ENCODINGS]
    out = known[-1]
    for (rule, _), own in list(zip(ENCODINGS, known))[-2::-1]:
        out = F.when(token.rlike(rule), own).otherwise(out)
    return out


def _two_sided(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def _log_p_uniform(v: Column) -> Column:
    """Chi-squared test that the symbols are uniform, against its exact mean and variance."""
    squares = F.aggregate(F.transform(F.array_distinct(v["x"]), lambda d: F.size(F.filter(v["x"], lambda x: x == d)).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    free = v["k"] - 1.0
    return bound((v["k"] / v["n"] * squares - v["n"] - free) / F.sqrt(2.0 * free * (v["n"] - 1.0) / v["n"]), lambda z: _log(1.0 - normal_cdf(z)))


def _log_p_runs(v: Column) -> Column:
    """Wald-Wolfowitz test on symbols above and below the middle of the alphabet."""
    sides = F.transform(v["x"], lambda x: x > (v["k"] - 1.0) / 2.0)

    def test(s: Column) -> Column:
        high = F.size(F.filter(s, lambda x: x)).cast("double")
        runs = F.size(F.filter(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a != b), lambda x: x)).cast("double") + 1.0
        return F.struct(high.alias("high"), (v["n"] - high).alias("low"), runs.alias("runs"))

    def p(t: Column) -> Column:
        return bound(2.0 * t["high"] * t["low"] / v["n"] + 1.0, lambda want: bound((want - 1.0) * (want - 2.0) / (v["n"] - 1.0), lambda spread: F.when(spread > 0, _log(_two_sided((t["runs"] - want) / F.sqrt(spread)))).otherwise(_log(F.lit(1e-6)))))

    return bound(sides, lambda s: bound(test(s), p))


def _log_p_serial(v: Column) -> Column:
    """Lag-one serial correlation of the symbol values."""
    mean = F.aggregate(v["x"], F.lit(0.0), lambda a, x: a + x) / v["n"]

    def test(d: Column) -> Column:
        variance = F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)
        lagged = F.aggregate(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return bound(variance, lambda s: F.when(s > 0, _log(_two_sided((lagged / s + 1.0 / v["n"]) * F.sqrt(v["n"])))).otherwise(_log(F.lit(1e-6))))

    return bound(mean, lambda m: bound(F.transform(v["x"], lambda x: x - m), test))


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-12)))


def _log_p_changes(v: Column) -> Column:
    """Changes of kind (capital, small letter, digit, sign) from one symbol to the next: too few?"""
    changes = F.length(F.regexp_replace(v["kinds"], r"(.)\1*", "$1")).cast("double") - 1.0
    spread = F.sqrt((v["n"] - 1.0) * v["same"] * (1.0 - v["same"]) + 2.0 * (v["n"] - 2.0) * (v["third"] - v["same"] * v["same"]))
    return F.when(spread > 0, bound((changes + 0.5 - (v["n"] - 1.0) * (1.0 - v["same"])) / spread, lambda z: _log(normal_cdf(z)))).otherwise(F.lit(0.0))


def _log_p_pairs(v: Column) -> Column:
    """Pairs of neighbouring symbols that languages are full of: too many?"""
    found = F.regexp_count(v["lower"], F.lit("(?=" + "|".join(PAIRS) + ")")).cast("double")
    spread = F.sqrt((v["n"] - 1.0) * v["pair"] * (1.0 - v["pair"]))
    return bound((found - 0.5 - (v["n"] - 1.0) * v["pair"]) / spread, lambda z: _log(1.0 - normal_cdf(z)))


def randomness(token: Column) -> Column:
    """Joint p value (Fisher) of the five tests for one candidate."""

    def values(plain: Column, own: Column) -> Column:
        x = F.transform(F.split(plain, ""), lambda c: F.position(c, own["letters"]).cast("double") - 1.0)
        letters = ENCODINGS[-1][1]
        kinds = F.translate(plain, letters, "".join(map(_kind, letters)))
        return F.struct(
            x.alias("x"), F.length(plain).cast("double").alias("n"), F.length(own["letters"]).cast("double").alias("k"),
            kinds.alias("kinds"), F.lower(plain).alias("lower"), own["same"].alias("same"), own["third"].alias("third"), own["pair"].alias("pair"),
        )

    def fisher(v: Column) -> Column:
        logs = _log_p_uniform(v) + _log_p_runs(v) + _log_p_serial(v) + _log_p_changes(v) + _log_p_pairs(v)
        return bound(-logs, lambda h: F.exp(-h) * (1.0 + h * (1.0 + h / 2.0 * (1.0 + h / 3.0 * (1.0 + h / 4.0)))))

    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    return bound(plain, lambda t: bound(bound(_encoding(token), lambda own: values(t, own)), fisher))


def _class(length: Column) -> Column:
    out = F.lit(LENGTH_CLASSES[0])
    for x in LENGTH_CLASSES[1:]:
        out = F.when(length >= x, F.lit(x)).otherwise(out)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, random, ordinary): spans of each text; random ones carry the p value ``p`` and its bin.

    ``ordinary`` is (class, bin) of the document's own ordinary string, null where the text has too few words for one.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    drawn = own.withColumn("words", F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")).withColumn("ordinary", _ordinary(F.col("words"), F.xxhash64("text"))).drop("words")
    found = with_spans(drawn, "text", PATTERNS).drop("text")
    free = F.filter("random", lambda s: ~overlaps(s, F.concat(*[F.col(k) for k in BASE])))

    def tested(s: Column) -> Column:
        return bound(randomness(s["match"]), lambda p: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), p.alias("p"), _bin(p).alias("bin")))

    return found.withColumns({"random": F.transform(free, tested), "ordinary": bound(F.col("ordinary"), _scored)})


def _scored(string: Column) -> Column:
    return F.when(string.isNotNull(), F.struct(_class(F.length(string)).alias("class"), _bin(randomness(string)).alias("bin")))


def _bin(p: Column) -> Column:
    low = F.floor(100 + 20 * F.log10(100 * F.greatest(p, F.lit(1e-12))))
    return F.least(F.lit(BINS), F.greatest(F.lit(0), F.when(p >= 0.01, 100 + F.floor(p * 100)).otherwise(low))).cast("int")


def _ordinary(words: Column, seed: Column) -> Column:
    """An ordinary string of ASCII words, from a drawn one on, with a number behind one of the first, cut to a length of its class; null if it is too short.

    The seed chooses place, class, length, number, and how the words are joined: by a hyphen, by an underscore, or by capitals.
    """
    part = lambda i, n: F.pmod(F.xxhash64(seed, F.lit(i)), n.cast("long") if isinstance(n, Column) else F.lit(n)).cast("int")
    low = F.element_at(F.array(*[F.lit(x) for x in LENGTH_CLASSES]), part(4, len(LENGTH_CLASSES)) + 1)
    above = F.element_at(F.array(*[F.lit(x) for x in [*LENGTH_CLASSES[1:], 2 * LENGTH_CLASSES[-1]]]), part(4, len(LENGTH_CLASSES)) + 1)
    size = low + part(5, above - low)
    at, first = part(6, F.greatest(F.size(words), F.lit(1))) + 1, part(2, 4) + 1
    # As many words as the string has code points are always enough.
    run = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    spaced = F.concat(run(at, first), part(3, 10_000).cast("string"), F.lit(" "), run(at + first, size))
    shape = part(1, 3)
    shaped = F.when(shape == 2, F.replace(F.initcap(spaced), F.lit(" "), F.lit(""))).when(shape == 1, F.translate(F.lower(spaced), " ", "_")).otherwise(F.translate(F.lower(spaced), " ", "-"))
    return bound(shaped, lambda t: F.when(F.length(t) >= low, F.substring(t, F.lit(1), size)))


def listed_strings(spark: SparkSession) -> DataFrame:
    """(ordinary) scores of ordinary strings made of function words, ``FLOOR`` for each class on average."""
    known = F.array(*[F.lit(w) for w in sorted(w for w in STOP_WORDS if w.isascii())])
    n = 2 * LENGTH_CLASSES[-1]
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(known, F.pmod(F.xxhash64("seed", i), F.size(known)).cast("int") + 1))
    # From a drawn word of this many there are more than enough left in nearly all cases; the others give no string.
    made = spark.range(FLOOR * len(LENGTH_CLASSES)).select(F.xxhash64("id").alias("seed")).select("seed", F.concat(words, words).alias("w")).select(_ordinary(F.col("w"), F.col("seed")).alias("s"))
    return made.select(bound(F.col("s"), _scored).alias("ordinary"))


def ordinary_scores(scanned: DataFrame) -> DataFrame:
    """(class, bin, n): scores of the ordinary strings, those of all documents and those of the list.

    At most len(LENGTH_CLASSES) * (BINS + 1) rows at any input size.
    """
    whole = scanned.select("ordinary").union(listed_strings(scanned.sparkSession)).where("ordinary is not null")
    return whole.groupBy("ordinary.class", "ordinary.bin").agg(F.count(F.lit(1)).alias("n"))


def least_bins(candidates: DataFrame, ordinary: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each class of lengths the lowest bin of the score that is reported; classes with nothing to report are missing.

    Benjamini-Hochberg on histograms of the candidates (class, bin) and of the ordinary strings.
    """
    both = candidates.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("found"), F.lit(0).cast("long").alias("n")).unionByName(ordinary.select("class", "bin", F.lit(0).cast("long").alias("found"), "n"))
    one = both.groupBy("class", "bin").agg(F.sum("found").alias("found"), F.sum("n").alias("n"))
    by_class = W.partitionBy("class")
    upward = by_class.orderBy(F.desc("bin"))
    # p value of a bin: ordinary strings of its bin or a higher one, the candidate itself counted in.
    ranked = one.select("class", "bin", "found", F.sum("found").over(upward).alias("rank"), F.sum("found").over(by_class).alias("all"), ((F.sum("n").over(upward) + 1) / (F.sum("n").over(by_class) + 1)).alias("p"))
    passing = ranked.where((F.col("found") > 0) & (F.col("p") <= F.lit(rate) * F.col("rank") / F.col("all")))
    return {int(r["class"]): int(r["bin"]) for r in passing.groupBy("class").agg(F.min("bin").alias("bin")).collect()}  # one row a class


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, assign, access, hex, random) with only the random spans that are reported; other names don't clash.

    Null texts are empty and have no spans; null and repeated keys stay row by row.  An empty table gives no rows.
    """
    scanned = write(scan(docs, key, text), "secrets").df
    candidates = scanned.select(F.explode("random").alias("s")).select(_class(F.length("s.match")).alias("class"), F.col("s.bin").alias("bin"))
    least = least_bins(candidates, ordinary_scores(scanned), rate)

    def stays(s: Column) -> Column:
        limit = F.lit(BINS + 1)
        for length, low in least.items():
            limit = F.when(_class(F.length(s["match"])) == length, F.lit(low)).otherwise(limit)
        return s["bin"] >= limit

    return scanned.drop("ordinary").withColumn("random", F.filter("random", stays))


def digest(found: DataFrame) -> DataFrame:
    base = joined(merged(BASE))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), joined(merged([*BASE, "random"])).alias("spans"), F.size("random").cast("long").alias("n_random")
    )
