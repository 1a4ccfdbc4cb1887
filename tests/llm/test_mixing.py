import os
from collections import Counter
from fractions import Fraction

import pytest

from strataloom.llm import mixing
from strataloom.llm.mixing import edf_schedule, interleaved, mix_sources, plan_mix

pytestmark = pytest.mark.skipif(not os.path.exists(f"{mixing.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


@pytest.mark.parametrize("blocks", [[1], [5, 5], [1, 2, 3, 94], [40, 33, 27], [7, 1, 1, 1, 1], [0, 3, 9]])
def test_schedule_stays_within_a_block(blocks):
    n = sum(blocks)
    out = edf_schedule([Fraction(b, n) for b in blocks], blocks)
    assert len(out) == n and Counter(s for _, s, _ in out) == {i: b for i, b in enumerate(blocks) if b}
    seen = Counter()
    for t, (slot, s, k) in enumerate(out, 1):
        assert slot == t - 1 and k == seen[s]
        seen[s] += 1
        assert all(abs(seen[i] - Fraction(b, n) * t) < 1 for i, b in enumerate(blocks))


def test_plan_caps_and_missing_sources():
    rows = {r["source"]: r for r in plan_mix({"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 5)])}
    assert rows["a"]["need"] == 200 and rows["b"]["need"] == 120 and rows["c"]["need"] == 0
    rows = {r["source"]: r for r in plan_mix({"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.5, None), ("d", None, 1)], 4000)}
    assert rows["a"]["need"] == 200 and rows["b"]["need"] == 1000
    assert plan_mix({}, [("a", 1.0, 1)])[0]["need"] == 0 and plan_mix({}, []) == []


def test_mix_over_odd_rows(spark):
    docs = [(i, "big source", "some words here " * (1 + i % 5), 1) for i in range(200)] + [(1000 + i, "SMALL", "short text", 1) for i in range(10)] + [(2000, "small", None, 1), (2001, "small", "", 1), (2002, None, "x y", 1), (2003, "unknown", "x", 1), (None, "small", "x", 1), (5, "big source", "some words here ", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens int")
    t = spark.createDataFrame([("big_source", 0.8, 1), ("small", 0.2, 3), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    m = mix_sources(d, t, block_tokens=16)
    uses = {x.doc_id: x for x in m.uses.collect()}
    assert len(uses) == 214 and all(uses[i].uses == 0 for i in (2000, 2001, 2002, 2003))
    assert all(uses[1000 + i].uses == 3 for i in range(10)) and max(x.uses for x in uses.values() if x.source == "big_source") == 1
    shares = {x.source: x for x in m.shares.collect()}
    assert abs(shares["small"].share_reached - 0.2) < 0.02 and shares["none"].share_reached == 0 and shares["big_source"].tokens_used <= shares["big_source"].tokens_available
    assert m.shares.agg({"share_reached": "sum"}).first()[0] == pytest.approx(1)
    i = interleaved(m)
    assert i.count() == sum(x.uses for x in uses.values()) and i.where("slot is null").count() == 0
    e = mix_sources(d.limit(0), t)
    assert e.uses.count() == 0 and e.schedule.count() == 0 and interleaved(e).count() == 0
    assert mix_sources(d, t.limit(0)).uses.where("uses > 0").count() == 0


def test_plan_keeps_target_weights_and_hands_on():
    plan = plan_mix({"a": 10_000, "b": 10_000, "c": 10_000}, [("a", 0.21, 1), ("b", 0.05, 9), ("c", 0.09, 9), ("d", 0.02, 4)])
    assert [r["parts"] for r in plan] == [21, 5, 9, 0]
    rows = {r["source"]: r for r in plan_mix({"a": 100, "b": 5000, "c": 5000}, [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 1)], 4000)}
    assert rows["a"]["need"] == 200 and rows["b"]["need"] == 2280 and rows["c"]["need"] == 1520
    assert sum(r["need"] for r in rows.values()) == 4000 and [rows[x]["parts"] for x in "abc"] == [5, 57, 38]
    odd = plan_mix({"a": 10**9, "b": 10**9}, [("a", 0.123456789, 1), ("b", 0.7, 1)])
    assert sum(r["parts"] for r in odd) <= mixing.FINEST + 2 and abs(odd[0]["parts"] / sum(r["parts"] for r in odd) - 0.123456789 / 0.823456789) < 1e-5


def test_interleaved_is_within_a_block_of_the_targets_at_every_slot(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "word " * (1 + i % 7), 0) for i in range(3000)], "doc_id bigint, source string, text string, x int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.17, 2)], "source string, target_share double, max_repeats int")
    m = mix_sources(docs, targets, block_tokens=32)
    rows = interleaved(m).groupBy("slot", "source").count().orderBy("slot").collect()
    slots = [r.slot for r in rows]
    whole = slots[-1] // m.period * m.period  # in the last period a source may be used up
    assert len(set(slots)) == len(slots) and slots[: whole] == list(range(whole)) and whole > 500
    seen = Counter()
    for t, r in enumerate(rows[:whole], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - w / 0.97 * t) < 1 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.17)))
    assert m.uses.agg({"uses": "max"}).first()[0] <= 2
