"""Document quality: weak labels from overlapping heuristics, a hashed linear scorer trained on them.

1. Heuristic labellers vote bad, nothing or good on every document.
2. Spark counts the documents of each vote pattern (at most 3 ** labellers rows).
   Expectation-maximisation on these counts estimates how often each labeller votes
   how on good and on bad documents, and so a posterior for each pattern.  It starts from
   what labellers are built for, which is worth a stated number of documents and no more; a
   labeller that is often wrong, or says nothing, is found out.
3. A logistic scorer on hashed words and word shapes is fitted to the posteriors of a
   bounded sample of documents; it scores every document.

Votes and scores need nothing but the text.  Labellers that need length don't vote on
texts of fewer than twelve words, and those that know four languages or need spaces
don't vote against other languages and scripts; the scorer judges every text that has a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.encoders import small_batches
from specgraph.llm.html_text import STOP_WORDS
from specgraph.llm.text_arrays import column_bytes, forget, mix, piece_hashes

#: Documents that the scorer is fitted to, at most twice as many; hash buckets; passes of the fit.
SAMPLE, BUCKETS, PASSES = 3000, 1 << 15, 200
#: Bytes of text that a task, and of sampled text that the driver works on at once.
TASK_SLICE, DRIVER_SLICE = 1 << 20, 1 << 19
#: A document is rejected when the scorer's probability of "bad" is at least this.
REJECT = 0.5
#: What labellers are built for, as (votes bad, nothing, good) on bad and on good documents; the share of bad documents.
#: The estimation starts there, which says what the classes mean; as evidence it counts as much as ``PRIOR`` documents, whatever the table's size.
DETECTOR, TWO_SIDED = ((0.3, 0.699, 0.001), (0.001, 0.998, 0.001)), ((0.3, 0.1, 0.6), (0.001, 0.199, 0.8))
BAD_SHARE, PRIOR = 0.1, 50.0
#: Words that a labeller needs for a vote: shares over a whole text, and marks that stand in or on its words.
LEAST_WORDS, LEAST_MARKED = 12, 3

# Byte classes: 0 white space, 1 lower, 2 upper, 3 digit, 4 sentence punctuation, 5 other symbol, 6 beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\"()-!"]] = 4
_CLASS[128:] = 6

LABELLERS = ["symbols", "capitals", "shouting", "columns", "echo", "variety", "function words", "word length", "lines", "marks on words", "one word"]
#: Those that also speak for documents.
BOTH_WAYS = {"echo", "variety", "function words", "word length"}


def _words(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document)"""
    inside = _CLASS[data] != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = docs[1:] > docs[:-1]
    begin, end = docs[:-1][filled], docs[1:][filled] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, docs)


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def _stop_hashes() -> np.ndarray:
    words = [w.encode() for w in sorted(STOP_WORDS)]
    ends = np.cumsum([len(w) for w in words])
    return np.sort(piece_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return (total[cuts[1:]] - total[cuts[:-1]]).astype(float)


class Texts:
    """Word arrays of one small batch."""

    def __init__(self, column: pa.Array):
        self.data, self.docs = column_bytes(column)
        self.rows = len(column)
        if not len(self.data):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first, self.hash, self.plain = np.zeros(self.rows + 1, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        self.starts, self.ends, self.first = _words(self.data, self.docs)
        low = _lowered(self.data)
        self.hash = piece_hashes(low, self.starts, self.ends)
        # The word without one closing mark, for the list of function words.
        trimmed = self.ends - ((_CLASS[self.data[self.ends - 1]] == 4) & (self.ends - self.starts > 1))
        self.plain = piece_hashes(low, self.starts, trimmed)

    def votes(self) -> np.ndarray:
        """(rows, labellers) of -1 bad, 0 nothing, 1 good."""
        out = np.zeros((self.rows, len(LABELLERS)), np.int8)
        if not len(self.starts):
            return out
        n = np.diff(self.first).astype(float)
        w = np.maximum(n, 1.0)
        kind = _CLASS[self.data]
        count = {c: _sums(kind == c, self.docs) for c in (1, 2, 5, 6)}
        chars = np.maximum(_sums(kind != 0, self.docs), 1.0)
        symbols, bangs, bars = count[5] / chars, _sums(self.data == 33, self.docs) / w, _sums(self.data == 124, self.docs) / w
        capitals = count[2] / np.maximum(count[1] + count[2], 1.0)
        same = np.zeros(len(self.hash), bool)
        same[1:] = self.hash[1:] == self.hash[:-1]
        same[self.first[:-1][np.diff(self.first) > 0]] = False
        echo = _sums(same, self.first) / w
        variety = np.array([len(np.unique(self.hash[a:b])) for a, b in zip(self.first[:-1], self.first[1:])], float)
        stops = _stop_hashes()
        at = np.minimum(np.searchsorted(stops, self.plain), len(stops) - 1)
        function = _sums(stops[at] == self.plain, self.first) / w
        points = _sums((self.data & 0xC0) != 0x80, self.docs)  # code points
        spaces = points - _sums((kind != 0) & ((self.data & 0xC0) != 0x80), self.docs)
        length = (points - spaces) / w
        beyond = count[6] / chars
        marked = _sums((_CLASS[self.data[self.ends - 1]] == 5) & (self.ends - self.starts > 1), self.first) / w
        lines = np.ones(self.rows)
        for i, (a, b) in enumerate(zip(self.docs[:-1].tolist(), self.docs[1:].tolist())):
            own = [x for x in self.data[a:b].tobytes().split(b"\n") if x.strip()]
            lines[i] = len(set(own)) / len(own) if len(own) >= 4 else 1.0
        begins = np.flatnonzero(~same)
        run = np.ones(self.rows)  # most repeats of one word in a row
        np.maximum.at(run, np.searchsorted(self.first, begins, "right") - 1, np.diff(begins, append=len(same)))
        never = np.zeros(self.rows, bool)

        def vote(j: int, bad: np.ndarray, good: np.ndarray = never, least: int = LEAST_WORDS) -> None:
            out[:, j] = np.where(n >= least, np.where(bad, -1, np.where(good, 1, 0)), 0)

        # Detectors of one kind of junk say nothing about texts without it.
        vote(0, symbols > 0.05, least=LEAST_MARKED)
        vote(1, capitals > 0.5)
        vote(2, bangs > 0.3)
        vote(3, bars > 0.2, least=LEAST_MARKED)
        vote(4, echo > 0.2, echo < 0.05)
        # Long texts repeat more words: expected variety falls roughly as the root of the length.
        vote(5, variety < 0.35 * np.sqrt(w), variety > 1.2 * np.sqrt(w))
        # Only four languages are known, so few function words say nothing.
        vote(6, never, function > 0.1)
        # Scripts beyond ASCII may do without spaces.
        vote(7, (beyond < 0.3) & ((length < 2.2) | (length > 14.0)), (length > 3.0) & (length < 9.0))
        vote(8, lines < 0.5)
        vote(9, marked > 0.3, least=LEAST_MARKED)
        vote(10, run >= 8)
        return out

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each feature occurrence, occurrences before each row): words, shapes, and shapes of repeats."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(self.rows + 1, np.int64)
        kind = _CLASS[self.data]
        size = np.minimum(self.ends - self.starts, 12).astype(np.uint64)
        mid = (self.starts + self.ends - 1) // 2
        same = np.zeros(len(self.hash), np.uint64)
        same[1:] = self.hash[1:] == self.hash[:-1]
        head, tail, centre = (kind[i].astype(np.uint64) for i in (self.starts, self.ends - 1, mid))
        closing = np.where(tail >= 4, self.data[self.ends - 1], 0).astype(np.uint64)
        with np.errstate(over="ignore"):
            shape = mix(((head * np.uint64(8) + centre) * np.uint64(8) + tail) * np.uint64(256) + closing + (same << np.uint64(40)) + np.uint64(1 << 50))
            sizes = mix(size + (same << np.uint64(8)) + np.uint64(1 << 51))
        every = np.stack([self.hash, shape, sizes], 1).reshape(-1)
        return (every % np.uint64(BUCKETS)).astype(np.int64), 3 * self.first


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ 3 ** np.arange(votes.shape[1])


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return np.asarray(pattern)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def _vote(batches):
    forget()
    for batch in small_batches(batches, TASK_SLICE):
        yield pa.RecordBatch.from_arrays([pa.array(pattern_of(Texts(batch.column(0)).votes()), pa.int64())], ["pattern"])


class LabelModel:
    """Class-conditional votes of independent labellers, fitted by expectation-maximisation on pattern counts."""

    def __init__(self, counts: dict[int, int], rounds: int = 100):
        patterns = np.array(sorted(counts), np.int64)
        n = np.array([counts[p] for p in patterns.tolist()], float)
        votes = votes_of(patterns)
        hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, vote
        prior = np.array([TWO_SIDED if name in BOTH_WAYS else DETECTOR for name in LABELLERS]).transpose(1, 0, 2)
        share = np.array([BAD_SHARE, 1 - BAD_SHARE])
        self.table, self.share = prior, share
        weigh = PRIOR
        for _ in range(rounds):
            bad = self.posterior(votes)
            weight = np.stack([n * bad, n * (1 - bad)])
            self.share = (weight.sum(1) + weigh * share) / (n.sum() + weigh)
            seen = np.einsum("cp,pjv->cjv", weight, hot) + weigh * share[:, None, None] * prior
            self.table = seen / seen.sum(2, keepdims=True)
        self.accuracy = {name: float((self.share[0] * t0[0] + self.share[1] * t1[1:].sum()) / self.share.sum()) for name, t0, t1 in zip(LABELLERS, self.table[0], self.table[1])}

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of "bad"; the share of bad documents where nobody votes."""
        j = np.arange(len(LABELLERS))
        score = [np.log(self.share[c]) + np.log(self.table[c][j[None, :], votes + 1]).sum(1) for c in (0, 1)]
        return np.where((votes != 0).any(1), 1.0 / (1.0 + np.exp(np.clip(score[1] - score[0], -500, 500))), self.share[0])


def _shares(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values (root of the share of a row's features) of the scorer's inputs."""
    bucket, first = texts.buckets()
    row = np.repeat(np.arange(texts.rows), np.diff(first))
    key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    row = key // BUCKETS
    return row, key % BUCKETS, np.sqrt(n / np.maximum(np.diff(first)[row], 1))


class Scorer:
    """Logistic regression on hashed features, fitted with Adam on the whole sample."""

    def __init__(self, texts: pa.Array, target: np.ndarray):
        """The sample is read in small slices: the driver holds its inputs, some hundreds a document, and no more."""
        parts, rows = [], 0
        for piece in small_batches([pa.RecordBatch.from_arrays([texts], ["text"])], DRIVER_SLICE):
            row, bucket, value = _shares(Texts(piece.column(0)))
            parts.append(((row + rows).astype(np.int32), bucket.astype(np.int32), value.astype(np.float32)))
            rows += piece.num_rows
        row, bucket, value = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
        del parts
        self.weight, self.intercept = np.zeros(BUCKETS), 0.0
        n = max(len(target), 1)
        m, s, step = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 0
        balance = np.where(target > 0.5, 0.5 / max(target.mean(), 0.02), 0.5 / max(1 - target.mean(), 0.02)) if len(target) else target
        for step in range(1, PASSES + 1 if len(target) else 1):
            score = np.bincount(row, value * self.weight[bucket], len(target)) + self.intercept
            error = (1 / (1 + np.exp(-score)) - target) * balance / n
            gradient = np.append(np.bincount(bucket, value * error[row], BUCKETS) + 1e-5 * self.weight, error.sum())
            m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient**2
            change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
            self.weight -= change[:-1]
            self.intercept -= change[-1]

    def score(self, texts: Texts) -> np.ndarray:
        """Probability of "bad"; 0 for texts without a word."""
        row, bucket, value = _shares(texts)
        score = np.bincount(row, value * self.weight[bucket], texts.rows) + self.intercept
        return np.where(np.diff(texts.first) > 0, 1 / (1 + np.exp(-np.clip(score, -500, 500))), 0.0)


def _openings(texts: pa.Array) -> pa.Array:
    """The first one to eleven words of each text: they teach the scorer, with the label of the whole, what short texts look like."""
    return pa.array([" ".join(t.as_py().split(None, LEAST_WORDS - 1)[: 1 + i % (LEAST_WORDS - 1)]) for i, t in enumerate(texts)], texts.type)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, key: str = "doc_id") -> tuple[LabelModel, Scorer]:
    """The label model from all documents, the scorer from about ``sample`` of them (twice as many at most).

    The sample is drawn by a hash of key (where the table has it) and text; other columns change nothing.
    """
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = own.mapInArrow(_vote, "pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** labellers rows
    counts = {int(r.pattern): int(r.n) for r in counted}
    labels = LabelModel(counts)
    total = sum(counts.values())
    share = min(1.0, sample / max(total, 1))
    # A lost task draws the same rows again, and copies are drawn one by one.
    keys = [F.col(f"`{c}`").cast("string") for c in (key, text) if c in docs.columns]
    hashed = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.lit(11), *keys).alias("h"))
    drawn = hashed.where(F.shiftrightunsigned("h", 1) <= int(share * (2**63 - 1024))).limit(2 * sample).select("text")
    texts = drawn.toArrow().column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.chunked_array(texts).combine_chunks()
    slices = small_batches([pa.RecordBatch.from_arrays([texts], ["text"])], DRIVER_SLICE)
    target = [labels.posterior(Texts(b.column(0)).votes().astype(np.int64)) for b in slices]
    target = np.concatenate([np.zeros(0), *target])
    return labels, Scorer(pa.concat_arrays([texts, _openings(texts)]), np.append(target, target))


def _judge(labels: LabelModel, scorer: Scorer):
    def run(batches):
        forget()
        for batch in small_batches(batches, TASK_SLICE):
            texts = Texts(batch.column(1))
            votes = texts.votes()
            p = scorer.score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(texts.first), pa.int64()), pa.array((votes < 0).sum(1), pa.int64()), pa.array((votes > 0).sum(1), pa.int64()), pa.array(labels.posterior(votes.astype(np.int64))), pa.array(p), pa.array(p < REJECT)],
                ["doc_id", "n_words", "votes_bad", "votes_good", "weak_bad", "p_bad", "kept"],
            )

    return run


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, votes_bad, votes_good, weak_bad, p_bad, kept) of each row.

    Null texts count as empty and are kept; null and repeated keys stay row by row;
    a probability of exactly ``REJECT`` rejects; an empty table gives no rows.
    """
    model = fit(docs, text, sample, key)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_judge(*model), "doc_id long, n_words long, votes_bad long, votes_good long, weak_bad double, p_bad double, kept boolean")


def keep_good(docs: DataFrame, text: str = "text", sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the scorer doesn't reject, all columns as they are, whatever their names.

    Null texts and texts without a word stay; null and repeated keys are decided row by row, equal texts alike; a
    probability of exactly ``REJECT`` rejects; an empty table gives no rows.
    """
    _, scorer = fit(docs, text, sample, key)
    at = docs.columns.index(text)

    def run(batches):
        forget()
        for batch in small_batches(batches, TASK_SLICE):
            yield batch.filter(pa.array(scorer.score(Texts(batch.column(at))) < REJECT))

    return docs.mapInArrow(run, docs.schema)
