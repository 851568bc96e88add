"""Shared lines against a plain version, and what rows without or with repeated ids do."""

import hashlib
import random

from specgraph.llm import line_dedup as L

LONG = "this line is long enough to be looked at by the rule"


def plain(rows, least_length=40, least_documents=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for k, t in rows:
        for line in (t or "").split("\n"):
            if k is not None and len(key(line)) >= least_length:
                holders.setdefault(key(line), set()).add(k)
    gone = {x: max(ids) for x, ids in holders.items() if len(ids) >= least_documents}
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if k is None or gone.get(key(x), k) == k]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in L.digest(L.drop_shared_lines(d, **kw)).collect()), key=str)


def test_same_as_the_plain_version(spark):
    rng = random.Random(1)
    pool = [f"{LONG} {i}" for i in range(12)] + ["short", "", " \t", "É" * 39, "É" * 40, " " + "x" * 40, "x" * 39]
    dress = [lambda x: x, str.upper, lambda x: "\x0b " + x + "\r", lambda x: x.replace("this", "THIS")]
    rows = [(i, "\n".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(i, f"{LONG} of four") for i in range(100, 104)] + [(i, f"{LONG} of five\nown {i}") for i in range(200, 205)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least_length=5, least_documents=2) == plain(rows, 5, 2)


def test_nulls_repeats_and_all_lines_lost(spark):
    rows = [(i, LONG) for i in range(6)] + [(None, LONG), (None, None), (7, None), (8, ""), (9, "\n\n")]
    rows += [(20, f"{LONG} in one document"), (20, f"{LONG} in one document\nmore"), (20, f"{LONG} in one document")] * 3  # one id: one document
    rows += [(5, LONG + "\n" + LONG), (3, "x\n" + LONG)]  # further rows of ids above
    assert found(spark, rows) == plain(rows)


def test_a_line_of_all_documents_and_a_very_long_text(spark):
    rows = [(i, f"{LONG}\n" * (1 + i % 3) + f"own {i}") for i in range(400)]
    rows.append((1000, "\n".join([LONG, *(f"{LONG} {i}" for i in range(50_000)), LONG])))
    assert found(spark, rows) == plain(rows)


def test_other_columns_and_empty_tables(spark):
    names = "doc_id long, text string, row int, places string, lines int, n_lines string, version int, doc string"
    rows = [(i, LONG + f"\n{i}", i, "p", 1, "n", 2, "d") for i in range(5)]
    out = L.drop_shared_lines(spark.createDataFrame(rows, names))
    assert out.columns == [c.split()[0] for c in names.split(", ")] + ["n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in range(5)] == ["0", "1", "2", "3", LONG + "\n4"] and got[1].row == 1 and got[1].doc == "d" and got[4].n_lines == 2
    assert found(spark, []) == []
