import random
import tracemalloc

import numpy as np
import pytest

from strataloom.llm.leak import PieceIndex, find_leaks, leak_report, myers, words


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_matches_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        m = r.randrange(1, 14)
        p, t = [r.randrange(4) for _ in range(m)], [r.randrange(4) for _ in range(r.randrange(1, 25))]
        eq = np.array([[sum(1 << j for j in range(m) if p[j] == x) for x in t]], np.uint64)
        assert myers(eq, m)[0][0] == distance(p, t)


def test_words():
    assert words("Don't co­oper​ate, naïve_x 3.5") == ["don", "t", "cooperate", "naïve", "x", "3", "5"]


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_index_finds_every_region_within_the_budget(budget):
    r = random.Random(budget)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, [r.choice(vocab) for _ in range(r.randrange(10, 30))]) for i in range(6)]
    docs = []
    for _ in range(60):
        d = [r.choice(vocab + ["zz"]) for _ in range(r.randrange(0, 40))]
        ws = list(r.choice(items)[1])
        a = r.randrange(len(ws))
        part = ws[a : a + 14]
        for _ in range(r.randrange(4)):
            if part:
                k = r.randrange(len(part))
                part[k : k + 1] = r.choice([[], [r.choice(vocab)], [part[k], "zz"]])
        at = r.randrange(len(d) + 1)
        docs.append(" ".join(d[:at] + part + d[at:]))
    got = {(x.row, x.item): x.distance for x in PieceIndex(items, 12, budget).match(docs, step=97).itertuples()}
    for k, d in enumerate(docs):
        for i, ws in items:
            best = min((distance(ws[a : a + 12], d.split()) for a in range(len(ws) - 11)), default=99)
            assert got.get((k, i), 99) == (best if best <= budget else 99), (k, i)


def test_leaks_over_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(20))
    docs = [(1, "Intro. " + text.upper().replace(" ", ", ") + " end", 0), (2, text.replace("word7", "other"), 0), (3, " ".join(text.split()[:11]), 0), (4, None, 0), (5, "", 0), (1, "Intro. " + text, 0), (None, text, 0), (6, "filler " * 300_000 + text, 0), (7, text, 0)]
    items = [(9, text, 1), (9, text, 1), (8, "too short", 1), (7, None, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, distance int")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id int")
    got = {(x.doc_id, x.item_id): x.distance for x in find_leaks(d, i).collect()}
    assert got == {(1, 9): 0, (2, 9): 0, (3, 9): 1, (6, 9): 0, (7, 9): 0}
    assert {(x.doc_id, x.item_id): x.distance for x in find_leaks(d, i, block_chars=10).collect()} == got
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0
    rep = {x.item_id: (x.n_exact, x.n_near) for x in leak_report(find_leaks(d, i), i).collect()}
    assert rep == {9: (4, 1), 8: (0, 0), 7: (0, 0)}


def test_many_hits_take_no_more_memory_than_few():
    items = [(i, [*"abcd", *(f"i{i}x{j}" for j in range(8))]) for i in range(300)]  # 300 passages have the same first piece
    texts = ["a b c d zz " * 40, " ".join(items[7][1])] * 50
    index = PieceIndex(items, 12, 2)
    tracemalloc.start()
    got = index.match(texts, step=1_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {tuple(x) for x in got.itertuples(index=False)} == {(r, 7, 0) for r in range(1, 100, 2)}
    assert peak < 8_000_000  # there are 600,000 pairs of a place and a passage


def test_repeated_passages_are_looked_up_once():
    text = [f"w{i}" for i in range(20)]
    index = PieceIndex([(i, text) for i in range(50)] + [(99, ["other", *text[:12]])], 12, 2)
    assert len(index.windows) == 10
    assert {(x.row, x.item, x.distance) for x in index.match(["", " ".join(text[2:])]).itertuples()} == {(1, i, 0) for i in range(50)} | {(1, 99, 2)}
