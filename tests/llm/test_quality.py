"""Weak labels and the scorer: simulated labellers, held-out labels, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from specgraph.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def test_patterns_round_trip():
    rng = np.random.default_rng(0)
    votes = rng.integers(-1, 2, (50, len(Q.LABELLERS)))
    assert (Q.votes_of(Q.pattern_of(votes)) == votes).all()


def test_em_finds_the_bad_class():
    rng = np.random.default_rng(1)
    n, k = 20_000, len(Q.LABELLERS)
    bad = rng.random(n) < 0.15
    hit = rng.choice([0.15, 0.3, 0.6], k)
    u = rng.random((n, k))
    votes = np.where(bad[:, None], np.where(u < hit, -1, np.where(u > 0.6, 1, 0)), np.where(u < 0.0005, -1, np.where(u > 0.2, 1, 0)))
    pattern, count = np.unique(Q.pattern_of(votes), return_counts=True)
    model = Q.LabelModel(dict(zip(pattern.tolist(), count.tolist())))
    p = model.posterior(votes)
    assert abs(model.share[0] - 0.15) < 0.03
    assert ((p > 0.5) == bad).mean() > 0.95
    assert np.corrcoef(model.table[0, :, 0], hit)[0, 1] > 0.9


@pytest.mark.parametrize("name", ["function words", "symbols", "echo"])
def test_em_finds_a_labeller_that_is_often_wrong(name):
    """One labeller votes against a fifth of the good documents; nobody else does."""
    rng = np.random.default_rng(3)
    n, k, j = 20_000, len(Q.LABELLERS), Q.LABELLERS.index(name)
    bad = rng.random(n) < 0.12
    both = np.array([x in Q.BOTH_WAYS for x in Q.LABELLERS])
    u = rng.random((n, k))
    votes = np.where(bad[:, None], np.where(u < 0.25, -1, np.where((u > 0.6) & both, 1, 0)), np.where(u < 0.0005, -1, np.where((u > 0.2) & both, 1, 0)))
    wrong = ~bad & (rng.random(n) < 0.2)
    votes[wrong, j] = -1
    pattern, count = np.unique(Q.pattern_of(votes), return_counts=True)
    model = Q.LabelModel(dict(zip(pattern.tolist(), count.tolist())))
    p = model.posterior(votes)
    assert model.table[1, j, 0] > 0.05 and all(model.table[1, i, 0] < 0.02 for i in range(k) if i != j)
    assert (p[wrong] > 0.5).mean() < 0.02
    assert (p[bad] > 0.5).mean() > 0.75


SOUND = [
    "Кошка сидела на коврике, и ей было там хорошо весь день. Потом она встала, потянулась и пошла на кухню, где её уже ждала миска молока.",
    "बिल्ली चटाई पर बैठी थी और वह वहाँ पूरे दिन खुश थी। फिर वह उठी और रसोई में चली गई जहाँ दूध का कटोरा उसका इंतज़ार कर रहा था।",
    "Kot siedział na macie i był tam szczęśliwy przez cały dzień. Potem wstał, przeciągnął się i poszedł do kuchni, gdzie czekała już miska mleka.",
    "猫坐在垫子上，整天都很开心。 然后它站起来，伸了个懒腰，走进厨房， 那里有一碗牛奶在等着它。 " * 4,
    "แมวนั่งอยู่บนเสื่อและมีความสุขทั้งวัน จากนั้นมันก็ลุกขึ้นยืดตัวแล้วเดินเข้าไปในครัว " * 5,
]


def test_sound_texts_of_other_languages(spark):
    assert (Q.Texts(pa.array(SOUND)).votes() >= 0).all()
    own = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, f"{t} {i % 7}.") for i in range(400) for t in [SOUND[i % len(SOUND)]]], "doc_id long, text string")
    rows = Q.judged(own.union(more)).where("doc_id >= 1000000").collect()
    assert sum(r.kept for r in rows) == len(rows) == 400


def test_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = lambda d: {r.doc_id: r.p_bad for r in Q.judged(d, sample=300).collect()}
    plain = scores(docs.select("doc_id", "text"))
    assert plain == scores(docs.selectExpr("*", "'x' AS extra", "doc_id AS p_bad"))


def test_votes_on_plain_texts():
    texts = ["The cat sat on the mat and it was happy there for the whole of the day. " * 3, "WOW!! BUY!! NOW!! " * 10, "a | b | c | d | " * 8, "x*** y### z$$$ " * 8, "word " * 50, "Too short", "", None]
    votes = Q.Texts(pa.array(texts, pa.string())).votes()
    assert (votes[0] >= 0).all() and votes[0].sum() > 0
    assert ((votes[1:5] < 0).any(1)).all()
    assert not votes[5:].any()


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = Q.judged(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)
    assert Q.judged(docs).count() == docs.count()


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (None, "The cat sat on the mat and it was happy there for the whole of the day.", 1.0), (3, "", 2.0), (3, "", 2.0), (4, "w " * 50_000, 3.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, p_bad double")
    got = Q.judged(d).collect()
    assert len(got) == 5 and all(r.kept for r in got if r.doc_id in (1, 3))
    assert Q.keep_good(d).columns == d.columns
    assert Q.judged(d.limit(0)).count() == 0 and Q.keep_good(d.limit(0)).count() == 0


def test_short_texts_are_judged(spark):
    """All short documents of sf0.1 with a label, by a scorer that saw sf0.1."""
    at = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rows = [r for r in Q.judged(docs).where("n_words between 1 and 11").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").select("doc_id", "kept", "quality").collect()]
    bad, good = ([r for r in rows if r.quality == q] for q in (0, 1))
    # Two of the nine bad ones look like any clean text.
    assert {9598, 519} <= {r.doc_id for r in bad if not r.kept} and sum(not r.kept for r in bad) >= 7
    assert sum(r.kept for r in good) >= 0.97 * len(good)


@pytest.mark.parametrize("n", [0, 1])
def test_fits_on_next_to_nothing(n):
    scorer = Q.Scorer(pa.array(["some words here"] * n, pa.string()), np.full(n, 0.1))
    assert (scorer.score(Q.Texts(pa.array(["w " * 20]))) <= 1).all()


def plain_votes(text):
    """Every labeller written down again for one text, word by word."""
    data = (text or "").encode()
    words = data.split()
    out = dict.fromkeys(Q.LABELLERS, 0)
    n = len(words)
    if not n:
        return out
    lower, upper, beyond = (sum(map(test, data)) for test in (lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: c >= 128))
    plain = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?'\"()-!" + bytes(range(128, 256)) + b" \t\n\r\x0b\x0c")
    symbol = lambda c: c not in plain
    chars = sum(len(w) for w in words)
    low = [w.lower() for w in words]
    same = [a == b for a, b in zip(low, low[1:])]
    longest = run = 1
    for s in same:
        run = run + 1 if s else 1
        longest = max(longest, run)
    stop = {w.encode() for w in Q.STOP_WORDS}
    trimmed = [w[:-1] if len(w) > 1 and w[-1:] in b".,:;?'\"()-!" and w[-1:] else w for w in low]
    function, echo, root = sum(w in stop for w in trimmed) / n, sum(same) / n, n**0.5
    length = sum(len(w.decode("utf-8", "ignore")) for w in words) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    if n >= Q.LEAST_MARKED:
        out["symbols"] = -(sum(map(symbol, data)) / chars > 0.05)
        out["columns"] = -(data.count(b"|") / n > 0.2)
        out["marks on words"] = -(sum(len(w) > 1 and symbol(w[-1]) for w in words) / n > 0.3)
    if n >= Q.LEAST_WORDS:
        out["capitals"] = -(upper / max(lower + upper, 1) > 0.5)
        out["shouting"] = -(data.count(b"!") / n > 0.3)
        out["echo"] = -1 if echo > 0.2 else int(echo < 0.05)
        out["variety"] = -1 if len(set(low)) < 0.35 * root else int(len(set(low)) > 1.2 * root)
        out["function words"] = int(function > 0.1)
        out["word length"] = -1 if beyond / chars < 0.3 and not 2.2 <= length <= 14 else int(3 < length < 9)
        out["lines"] = -(len(lines) >= 4 and len(set(lines)) / len(lines) < 0.5)
        out["one word"] = -(longest >= 8)
    return {k: int(v) for k, v in out.items()}


def test_votes_equal_a_plain_version(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + SOUND + [None, "", " \n ", "a", "A! " * 20, "x* y* z*", "ab\x1cc d", "w " * 30, "l\n" * 40]
    got = Q.Texts(pa.array(texts, pa.string())).votes()
    assert [dict(zip(Q.LABELLERS, row.tolist())) for row in got] == [plain_votes(t) for t in texts]


def simulated(n, seed=5):
    """Votes of sound labellers, but one that votes bad by chance and one that never does although it is built to."""
    rng = np.random.default_rng(seed)
    k = len(Q.LABELLERS)
    bad = rng.random(n) < 0.15
    u = rng.random((n, k))
    votes = np.where(bad[:, None], np.where(u < 0.4, -1, np.where(u > 0.7, 1, 0)), np.where(u < 0.002, -1, np.where(u > 0.3, 1, 0)))
    chance, silent = Q.LABELLERS.index("shouting"), Q.LABELLERS.index("word length")
    votes[:, chance] = np.where(rng.random(n) < 0.2, -1, 0)
    votes[:, silent] = np.where(votes[:, silent] < 0, 0, votes[:, silent])
    pattern, count = np.unique(Q.pattern_of(votes), return_counts=True)
    return dict(zip(pattern.tolist(), count.tolist())), chance, silent


@pytest.mark.parametrize("n,times", [(3000, 1), (3000, 1000), (60_000, 1)])
def test_a_useless_labeller_is_found_out_at_any_size(n, times):
    counts, chance, silent = simulated(n)
    model = Q.LabelModel({p: c * times for p, c in counts.items()})
    assert model.table[0, silent, 0] < 0.03  # built for 0.3
    assert abs(model.table[0, chance, 0] - model.table[1, chance, 0]) < 0.1  # says as much about good documents as about bad ones
    others = [j for j in range(len(Q.LABELLERS)) if j not in (chance, silent)]
    assert (model.table[0, others, 0] > 0.3).all() and (model.table[1, others, 0] < 0.02).all() and abs(model.share[0] - 0.15) < 0.03


def test_more_documents_outweigh_the_start():
    counts, _, silent = simulated(400)
    seen = [Q.LabelModel({p: c * times for p, c in counts.items()}).table[0, silent, 0] for times in (1, 10, 1000)]
    assert seen[0] > 10 * seen[2] and seen[0] > seen[1] > seen[2]


def test_em_against_a_plain_version():
    """The rounds written down pattern by pattern and labeller by labeller."""
    counts, _, _ = simulated(800, 6)
    share = [Q.BAD_SHARE, 1 - Q.BAD_SHARE]
    start = [[dict(zip((-1, 0, 1), (Q.TWO_SIDED if n in Q.BOTH_WAYS else Q.DETECTOR)[c])) for n in Q.LABELLERS] for c in (0, 1)]
    table, now, total = start, list(share), sum(counts.values())
    votes = {p: Q.votes_of([p])[0].tolist() for p in counts}

    def bad(p):
        if not any(votes[p]):
            return now[0]
        a, b = (now[c] * np.prod([table[c][j][v] for j, v in enumerate(votes[p])]) for c in (0, 1))
        return a / (a + b)

    for _ in range(100):
        known = {p: bad(p) for p in counts}
        weight = [{p: n * (known[p] if c == 0 else 1 - known[p]) for p, n in counts.items()} for c in (0, 1)]
        now = [(sum(weight[c].values()) + Q.PRIOR * share[c]) / (total + Q.PRIOR) for c in (0, 1)]
        table = [[{v: sum(w for p, w in weight[c].items() if votes[p][j] == v) + Q.PRIOR * share[c] * start[c][j][v] for v in (-1, 0, 1)} for j in range(len(Q.LABELLERS))] for c in (0, 1)]
        table = [[{v: x / sum(t.values()) for v, x in t.items()} for t in own] for own in table]
    model = Q.LabelModel(counts)
    assert np.allclose(model.share, now)
    assert np.allclose(model.table, [[[t[v] for v in (-1, 0, 1)] for t in own] for own in table])
    assert np.allclose(model.posterior(np.array([votes[p] for p in counts])), [bad(p) for p in counts])
