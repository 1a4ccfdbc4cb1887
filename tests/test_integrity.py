"""References (problem 2) and deliveries (problem 5), against brute force and in the odd cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataloom.session import hot_keys, salted_join
from strataloom.operators.delivery import deletion_vectors, split_deliveries
from strataloom.operators.orphans import cascade, find_orphans, iso_time, path_key, resolve

T0 = datetime(2025, 1, 1)


def _messages(spark, path, rows, files=3):
    schema = "delivery_id bigint, job_id string, owner string, repo string, received_at timestamp_ntz, delivery_state string, live string"
    spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(path)


def _expected(rows):
    best = {}
    for r in rows:
        key = tuple((x or "").strip().lower() for x in r[1:4])
        if all(key):
            order = (r[4] is None, r[4] or T0, r[0] is not None, r[0] or 0)
            best.setdefault(key, []).append((order, r[0]))
    return sum(len(v) - 1 for v in best.values()), {k: min(v)[1] for k, v in best.items()}


def test_split_matches_brute_force(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice(["a", " A", "b\t", None, ""]), r.choice(["x", "X "]), r.choice(["p", "q", "  "]), T0 + timedelta(seconds=r.randrange(50)) if r.random() > 0.1 else None, "z", "w") for i in range(400)]
    path = str(tmp_path / "m")
    _messages(spark, path, rows)
    out = split_deliveries(spark, path)
    n_surplus, kept = _expected(rows)
    assert out.where("delivery_state = 'surplus'").count() == n_surplus
    assert {x.delivery_id for x in out.where("delivery_state = 'kept'").collect()} == set(kept.values())
    assert out.count() == len(rows)
    assert set(out.columns) >= {"delivery_state", "live"} and out.where("live = 'w'").count() == len(rows)  # extra columns pass through


def test_hot_message_lots_and_ties(spark, tmp_path):
    rows = [(7, "a", "x", "p", T0, None, None)] * 60 + [(i, f"j{i}", "x", "p", T0, None, None) for i in range(40)]
    path = str(tmp_path / "m")
    _messages(spark, path, rows, 8)
    whole = split_deliveries(spark, path).groupBy("delivery_state").count().orderBy("delivery_state").collect()
    lots = split_deliveries(spark, path, broadcast_bytes=5000).groupBy("delivery_state").count().orderBy("delivery_state").collect()
    assert whole == lots and {x[0]: x[1] for x in whole} == {"kept": 41, "surplus": 59}


def test_hot_key_sends_one_row_a_task(spark, tmp_path):
    path = str(tmp_path / "m")
    _messages(spark, path, [(i, "a", "x", "p", T0, None, None) for i in range(300)], 6)
    plan = deletion_vectors(spark.read.parquet(path), ["job_id", "owner", "repo"], ["received_at", "delivery_id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_empty_messages(spark, tmp_path):
    path = str(tmp_path / "m")
    _messages(spark, path, [])
    assert split_deliveries(spark, path).count() == 0


@pytest.mark.parametrize("raw,key", [("./a/b#x", "a/b"), ("/a", "a"), ("a\\b\\c.py", "a/b/c.py"), ("././/a", "a"), ("#x", ""), ("A/b", "A/b")])
def test_path_key(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "p string").select(path_key(F.col("p"))).first()[0] == key


def test_iso_time(spark):
    rows = ["2025-01-02T03:04:05Z", "2025-01-02T03:04:05.5+02:00", "2025-01-02 03:04:05", "2025-01-02T03:04:05-0500", "", " ", "soon", None]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in rows], "t string").select(iso_time(F.col("t"))).collect()]
    assert got == [datetime(2025, 1, 2, 3, 4, 5), datetime(2025, 1, 2, 1, 4, 5, 500000), datetime(2025, 1, 2, 3, 4, 5), datetime(2025, 1, 2, 8, 4, 5), None, None, None, None]


def test_resolve_matches_brute_force(spark):
    r = random.Random(3)
    at = lambda: T0 + timedelta(hours=r.randrange(24 * 12), minutes=r.choice([0, 30]))
    refs = [(i, r.choice(["hot", "hot", "a", "b", None, "none"]), at() if r.random() > 0.05 else None) for i in range(500)]
    targets = []
    for _ in range(120):
        since = at()
        targets.append((r.choice(["hot", "a", "b", None]), since if r.random() > 0.1 else None, since + timedelta(hours=r.randrange(30)) if r.random() > 0.2 else None))
    targets = targets[:40]
    want = {i for i, k, t in refs if k and t and any(x == k and s is not None and s <= t and (u is None or u > t) for x, s, u in targets)}
    a = spark.createDataFrame(refs, "id int, key string, at timestamp_ntz")
    b = spark.createDataFrame(targets * 2, "key string, since timestamp_ntz, until timestamp_ntz")
    got = resolve(a, b)
    assert {x.id for x in got.where("live").collect()} == want and got.count() == len(refs)
    assert resolve(a, b.limit(0)).where("live").count() == 0
    assert resolve(a.limit(0), b).count() == 0


def test_cascade_depths_and_cycle(spark):
    links = spark.createDataFrame([("c", f"c{i}", "f", "f1") for i in range(50)] + [("f", "f1", "b", "b1"), ("d", "d1", "c", "c3"), ("x", "x1", "x", "x2"), ("x", "x2", "x", "x1"), ("x", "x1", "b", "b1")], "child_table string, child_key string, parent_table string, parent_key string")
    dead = spark.createDataFrame([("b", "b1")], "tab string, key string")
    got = {(x.tab, x.key): x.depth for x in cascade(links, dead).collect()}
    assert got[("b", "b1")] == 0 and got[("f", "f1")] == 1 and got[("c", "c7")] == 2 and got[("d", "d1")] == 3 and got[("x", "x2")] == 2
    assert {(x.tab, x.key): x.depth for x in cascade(links, dead, most=7).collect()} == got
    assert cascade(links, dead.limit(0)).count() == 0


def test_find_orphans_direct_and_inherited(spark):
    t = T0
    refs = spark.createDataFrame(
        [("files", "f1", "blobs", "h1", t, "x"), ("files", "f2", "blobs", "h2", t, "x"), ("chunks", "c1", "files", "f1", t, "x"), ("chunks", "c2", "files", "f2", t, "x"), ("chunks", "c3", "files", "f9", t, "x"), ("chunks", "c3", "files", None, t, "x")],
        "child_table string, child_key string, parent_table string, parent_key string, at timestamp_ntz, until string",
    )
    targets = spark.createDataFrame([("blobs", "h2", t, None), ("files", "f1", t, None), ("files", "f2", t, None), (None, None, t, None)], "tab string, key string, since timestamp_ntz, until timestamp_ntz")
    got = {(x.child_key, x.parent_key): x.status for x in find_orphans(refs, targets).collect()}
    assert find_orphans(refs.withColumn("live", F.lit(1)).withColumn("kind", F.lit(2)).withColumn("bin", F.lit(3)).withColumn("status", F.lit(4)), targets).where("status = 'direct' and kind = 2 and bin = 3 and until = 'x'").count() == 3
    assert find_orphans(refs.limit(0), targets).count() == 0 and find_orphans(refs, targets.limit(0)).where("status <> 'direct'").count() == 0
    assert got == {("f1", "h1"): "direct", ("f2", "h2"): "sound", ("c1", "f1"): "inherited", ("c2", "f2"): "sound", ("c3", "f9"): "direct", ("c3", None): "direct"}


def test_cascade_down_a_long_chain(spark):
    links = spark.createDataFrame([("a", i + 1, "a", i) for i in range(150)], "child_table string, child_key int, parent_table string, parent_key int").coalesce(1)
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = cascade(links, spark.createDataFrame([("a", 0)], "tab string, key int").coalesce(1))
        assert {(x.key, x.depth) for x in got.collect()} == {(i, i) for i in range(151)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    a = spark.createDataFrame([(i, "hot" if i % 3 else ("b" if i % 2 else None), i % 5) for i in range(200)], "id int, k string, j int")
    b = spark.createDataFrame([("hot", 1, "x"), ("hot", 1, "y"), ("b", 3, "z"), (None, 1, "n")], "k string, j int, v string")
    hot = hot_keys(a, ["k", "j"], 10)
    assert hot.count() and hot_keys(a, ["k", "j"], 1000) is None
    got, want = salted_join(a, b, ["k", "j"], how, ["id"], hot), a.join(b, ["k", "j"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
