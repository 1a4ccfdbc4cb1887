from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strataloom.streaming import streams

T0 = datetime(2025, 1, 1)


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_table(spark, path)


def test_admission_keeps_within_the_limit(spark, tmp_path):
    rows = [("a", T0 + timedelta(seconds=s), 1.0) for s in (0, 1, 2, 3, 61, 62, 63)] + [("b", T0, 9.0)]
    s = _stream(spark, str(tmp_path / "r"), rows, "k string, ts timestamp_ntz, c double")
    got = streams.drain(streams.admitted(s, "k", "ts", "c", 60, 3, 5.0))
    a = [x.admitted for x in got.where("k = 'a'").orderBy("ts").collect()]
    assert a == [True, True, True, False, True, True, True] and not got.where("k = 'b'").first().admitted


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("x", T0 + timedelta(minutes=m), 1.0) for m in (0, 10, 65, 130)]
    s = _stream(spark, str(tmp_path / "r"), rows, "k string, ts timestamp_ntz, v double")
    got = streams.drain(streams.windowed(s, "ts", ["k"], "v"))
    assert [(x.n, x.total) for x in got.orderBy("window_start").collect()] == [(2, 2.0), (1, 1.0)]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    path, check = str(tmp_path / "r"), str(tmp_path / "c")
    seen = []
    schema = "k string, ts timestamp_ntz, v double"
    for i in range(2):
        s = _stream(spark, path, [(f"k{i}", T0, 1.0)], schema)
        streams.apply_batches(s.select("k"), lambda df, n: seen.extend(x.k for x in df.collect()), check)
    assert seen == ["k0", "k1"]


def test_first_deliveries(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + timedelta(minutes=1)), ("b", T0)]
    s = _stream(spark, str(tmp_path / "r"), rows, "k string, ts timestamp_ntz")
    assert streams.drain(streams.first_deliveries(s, ["k"], "ts", "1 hour")).agg(F.count("*")).first()[0] == 2
