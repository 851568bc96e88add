"""Runs of repeated words by recompression, in time near linear in a text's words.

1. Words become numbers.  Block compression turns each stretch of one symbol into a symbol
   for (symbol, count); pair compression deals symbols to a left and a right class and turns
   each left symbol followed by a right one into a symbol for the pair.  Alternating the two
   gives levels that shrink by a part each: a run-length grammar, whose symbols are equal
   where and only where the words they stand for are.
2. The grammar answers how far two places of a text agree.  A query goes up the levels while
   the two places don't stand at symbol edges alike, then down from the first symbols that
   differ; a block of one symbol is passed at once by its count.  Queries are answered many at
   a time.  The mirrored levels answer the same question to the left.
3. A run of period q holds at least max(6, 4q) - q places in a row that agree with the place
   q further on, so a grid of that spacing meets it: over all q these are n ln n places, of which those
   whose two words differ are gone at once.  The others are extended exactly both ways.
4. An interval found for several periods is a run of the smallest one; the others are its multiples.

All texts of a small Arrow batch are worked on together, with a symbol of its own after each
text, so no run crosses from one to the next.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from specgraph.llm.encoders import small_batches

#: A run's least number of periods, and of words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Bytes of text that words are taken from at once; grid places looked at together; words hashed at once.
CHUNK, PLACES, JOINED = 1 << 20, 1 << 20, 100_000
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_SPACE = re.compile(rb"[ \t-\r]")
_NAMES = [c.split()[0] for c in RUNS.split(", ")]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bit for each number."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(bool)


class Level:
    """Symbols with their first words, and the groups of them that became symbols of the level above.

    ``first``/``last`` are the places of a group's first and last symbol; ``blocks`` tells whether groups are stretches of one symbol.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, first: np.ndarray, blocks: bool):
        self.symbols, self.starts, self.first, self.blocks = symbols, starts, first, blocks
        self.last = np.append(first[1:], len(symbols)) - 1
        self.group = np.repeat(np.arange(len(first)), self.last - first + 1)

    def mirrored(self, n: int) -> Level:
        """The same level read from the right."""
        ends = np.append(self.starts[1:], n)
        return Level(self.symbols[::-1], n - ends[::-1], (len(self.symbols) - 1 - self.last)[::-1], self.blocks)


def _named(pairs: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... of the different values."""
    return np.unique(pairs, return_inverse=True)[1]


def recompress(words: np.ndarray) -> list[Level]:
    """Levels from the words up, until nothing shrinks any more; the last level's symbols have no groups of their own."""
    symbols, starts, fresh = words.astype(np.int64), np.arange(len(words)), int(words.max(initial=-1)) + 1
    levels, idle = [], 0
    while len(symbols) > 1 and idle < 8:
        before = len(symbols)
        first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        if len(first) < len(symbols):  # else every stretch is one symbol and nothing changes
            levels.append(Level(symbols, starts, first, True))
            counts = np.diff(first, append=len(symbols))
            symbols, starts = symbols[first], starts[first]
            many = np.flatnonzero(counts > 1)
            own = _named((symbols[many] << 32) + counts[many])  # both are below 2^31: a batch has far fewer words
            symbols = symbols.copy()
            symbols[many] = fresh + own
            fresh += int(own.max(initial=-1)) + 1
        right = _mixed(symbols, len(levels) + idle)
        ahead, back = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        paired = np.flatnonzero(ahead if np.count_nonzero(ahead) >= np.count_nonzero(back) else back)
        if len(paired):
            stays = np.ones(len(symbols), bool)
            stays[paired + 1] = False
            first = np.flatnonzero(stays)
            levels.append(Level(symbols, starts, first, False))
            own = _named((symbols[paired] << 32) + symbols[paired + 1])
            symbols = symbols.copy()
            symbols[paired] = fresh + own
            fresh += int(own.max(initial=-1)) + 1
            symbols, starts = symbols[first], starts[first]
        idle = idle + 1 if len(symbols) == before else 0
    levels.append(Level(symbols, starts, np.arange(len(symbols)), False))
    return levels


def agree(levels: list[Level], n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words from p on are the same as those from q on, for each pair of different places in 0..n (n: none are left)."""
    p, q = p.astype(np.int64), q.astype(np.int64)
    length = np.zeros(len(p), np.int64)
    top = np.zeros(len(p), np.int64)  # the level whose symbols differ
    live = np.arange(len(p))

    def places(level: Level, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs with words left, places of their symbols)"""
        a, b = p[who] + length[who], q[who] + length[who]
        inside = (a < n) & (b < n)
        return inside, np.searchsorted(level.starts, a[inside]), np.searchsorted(level.starts, b[inside])

    def passed(level: Level, who: np.ndarray, a: np.ndarray, m: np.ndarray) -> None:
        """The pairs ``who`` agree in m symbols from place a on."""
        length[who] += np.append(level.starts, n)[a + m] - level.starts[a]

    for k, level in enumerate(levels):
        if not len(live):
            break
        inside, a, b = places(level, live)
        top[live[~inside]] = k
        live = live[inside]
        if k == len(levels) - 1:
            top[live] = k
            break
        edge = (level.first[level.group[a]] == a) & (level.first[level.group[b]] == b)
        same = level.symbols[a] == level.symbols[b]
        left_a, left_b = level.last[level.group[a]] - a + 1, level.last[level.group[b]] - b + 1
        move = ~edge & same
        passed(level, live[move], a[move], np.minimum(left_a, left_b)[move])
        # At unlike edges and unlike symbols, or with blocks of unlike length, the next symbols differ here.
        differ = ~edge & (~same | (left_a != left_b))
        top[live[differ]] = k
        live = live[~differ]
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        who = np.flatnonzero(top >= k)
        while len(who):  # once or twice: what is the same here stands before the first difference above
            inside, a, b = places(level, who)
            who = who[inside]
            same = level.symbols[a] == level.symbols[b]
            who, a, b = who[same], a[same], b[same]
            m = np.minimum(level.last[level.group[a]] - a, level.last[level.group[b]] - b) + 1 if level.blocks else np.ones(len(a), np.int64)
            passed(level, who, a, m)
    return length


def _grid(sizes: np.ndarray, bases: np.ndarray, words: np.ndarray):
    """(place, period) of grid places whose word is the one a period further on, a bounded number at a time."""
    largest = int(sizes.max(initial=0)) // LEAST_PERIODS
    q = 1
    while q <= largest:
        # a stretch of periods with about PLACES grid places in all
        upto, cost = q, 0
        while upto <= largest and cost < PLACES:
            own = sizes[sizes >= max(LEAST_WORDS, LEAST_PERIODS * upto)]
            cost += int((own // max(LEAST_WORDS - upto, (LEAST_PERIODS - 1) * upto)).sum())
            upto += 1
        periods = np.arange(q, upto)
        step = np.maximum(LEAST_WORDS, LEAST_PERIODS * periods) - periods
        doc, at = np.nonzero(sizes[:, None] >= (step + periods)[None, :]) if len(sizes) * len(periods) <= 4 * PLACES else _sparse(sizes, step + periods)
        count = (sizes[doc] - periods[at] - 1) // step[at] + 1
        which = np.repeat(np.arange(len(count)), count)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * step[at][which] + bases[doc][which]
        period = periods[at][which]
        hit = words[place] == words[place + period]
        yield place[hit], period[hit]
        q = upto


def _sparse(sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero(sizes >= least) by columns, without the whole table: ``least`` rises."""
    count = np.searchsorted(least, sizes, "right")
    doc = np.repeat(np.arange(len(sizes)), count)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as numbers of words, the rows (start, length, period) of its runs by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bases = np.cumsum(sizes + 1) - (sizes + 1)
    words = np.empty(int((sizes + 1).sum()), np.int64)
    fresh = max([int(t.max(initial=-1)) for t in texts], default=-1) + 1
    for i, (t, b) in enumerate(zip(texts, bases.tolist())):
        words[b : b + len(t)] = t
        words[b + len(t)] = fresh + i
    n, found = len(words), []
    levels = mirror = None
    for place, period in _grid(sizes, bases, words):
        if not len(place):
            continue
        if levels is None:
            levels = recompress(words)
            mirror = [level.mirrored(n) for level in levels]
        right = agree(levels, n, place, place + period)
        left = agree(mirror, n, n - place, n - place - period)
        start, length = place - left, left + right + period
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.unique(np.stack([start[long], length[long], period[long]], 1), axis=0))
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if not len(rows):
        return [rows] * len(texts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))  # an interval's other periods are multiples of its smallest
    rows = rows[smallest]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    doc = np.searchsorted(bases, rows[:, 0], "right") - 1
    rows[:, 0] -= bases[doc]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that a document with a planted repetition takes its words in; None for the others.

    With h = crc32(decimal id), g = h // 10: if h % 10 is 0, words from a = g % n on repeat the first 1 + (n - a) // (3 + g % 8) of them.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


class Words:
    """Numbers of the words ``[^\\x20\\x09-\\x0D]+`` of a batch's texts."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}

    def of(self, raw: bytes) -> np.ndarray:
        """A very long text is cut at white space, so that only a part of its words are objects at a time."""
        out, at = [], 0
        while at < len(raw):
            m = _SPACE.search(raw, at + CHUNK) if len(raw) > at + CHUNK else None
            end = m.start() if m else len(raw)
            own = raw[at:end].split()
            for w in own:
                self.number.setdefault(w, len(self.number))
            out.append(np.fromiter(map(self.number.__getitem__, own), np.int64, len(own)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def texts(self) -> list[bytes]:
        return list(self.number)


def _sha256(words: list[bytes], numbers: np.ndarray) -> str:
    out = hashlib.sha256()
    for i in range(0, len(numbers), JOINED):
        out.update(b" " * (i > 0) + b" ".join([words[k] for k in numbers[i : i + JOINED].tolist()]))
    return out.hexdigest()


def _run_digest(runs: np.ndarray) -> str:
    out = hashlib.sha256()
    for i in range(0, len(runs), JOINED):
        out.update("".join([f"{s},{n},{q}\n" for s, n, q in runs[i : i + JOINED].tolist()]).encode())
    return out.hexdigest()


def _batch(keys: list, texts: list[bytes], plant: bool) -> pa.RecordBatch:
    words = Words()
    numbers = [words.of(t) for t in texts]
    if plant:
        orders = [planted(k, len(x)) for k, x in zip(keys, numbers)]
        numbers = [x if o is None else x[o] for x, o in zip(numbers, orders)]
    names, columns = words.texts(), [[] for _ in _NAMES]
    for key, own, runs in zip(keys, numbers, runs_of(numbers)):
        best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist() if len(runs) else [None] * 3
        kept = own[kept_words(len(own), runs)] if len(runs) else own
        milli = 1000 * best[1] // best[2] if len(runs) else None
        for c, v in zip(columns, (key, len(runs), *best, milli, _run_digest(runs), _sha256(names, kept))):
            c.append(v)
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row's whole text.

    A run is a stretch of consecutive words with smallest period q and of at least max(6, 4q) words that no neighbouring
    word extends keeping period q.  The longest is described (ties: smallest start, then period).  runs_sha256 is of
    every run's ``start,length,period`` and a line feed, by start, then period; collapsed_sha256 of the words that no run contains after its
    first q words, joined by one space.  ``plant`` first turns some documents, chosen by their id, into ones with a repetition.

    A null or empty text, or one without words, has no runs: nulls, and the hashes of nothing.  A null id is kept and nothing is planted there.
    Rows that share an id stand for themselves, equal rows have equal results; other columns are passed over; an empty table gives no rows.
    """

    def run(batches):
        for batch in small_batches(batches):
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"").to_pylist()
            yield _batch(batch.column(0).to_pylist(), texts, plant)

    own = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text")
    return own.mapInArrow(run, RUNS)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each text that has runs replaced by its words without the repetitions, joined by one space; other texts stay as they are.

    Every column stays, whatever its name; null texts stay null and an empty table gives no rows.
    """
    at = docs.columns.index(text)

    def run(batches):
        for batch in small_batches(batches):
            words = Words()
            texts = pc.fill_null(batch.column(at).cast(pa.large_binary()), b"").to_pylist()
            numbers = [words.of(t) for t in texts]
            names, out = words.texts(), batch.column(at).to_pylist()
            for i, (own, runs) in enumerate(zip(numbers, runs_of(numbers))):
                if len(runs):
                    out[i] = b" ".join([names[k] for k in own[kept_words(len(own), runs)].tolist()]).decode("utf-8", "surrogatepass")
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
