import datetime

import pytest
from pyspark.sql import functions as F

from maskloom.operators.apply import apply_rules, rule_stats
from maskloom.operators.detect import detections
from maskloom.operators.profile import matches_by_kind
from maskloom.rules import Mask, Rule, builtin_rules
from maskloom.streaming.operators import detection_rate, drain, drain_complete, drain_rates, late_rates

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def source(spark, tmp_path):
    """The same lines as a table and as a stream of four files."""
    rows = [(i, START + datetime.timedelta(minutes=i), f"user=u{i} from 10.0.0.{i % 250} c{i}@x.org") for i in range(400)]
    table = spark.createDataFrame(rows, "line_no bigint, ts timestamp, line string")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return table, stream


def test_rules_on_a_stream_equal_the_batch(source):
    table, stream = source
    rules = [*builtin_rules(), Rule("m", "@", r"(c\d+)@", Mask(group=1))]
    assert sorted(drain(apply_rules(stream, rules)).collect()) == sorted(apply_rules(table, rules).collect())
    counted = drain(rule_stats(stream, rules).select("line_no", "n_replacements")).collect()
    assert sorted(counted) == sorted(rule_stats(table, rules).select("line_no", "n_replacements").collect())


def test_running_counts(source):
    table, stream = source
    keep = ("line_no",)
    got = drain_complete(matches_by_kind(detections(stream, keep=keep))).collect()
    assert sorted(got) == sorted(matches_by_kind(detections(table, keep=keep)).collect())


def test_rates_close_with_the_watermark(spark, source, tmp_path):
    table, _ = source
    table.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "ordered"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "ordered"))
    got = drain(detection_rate(stream)).collect()
    closed = table.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("t")).first()["t"]
    expected = detection_rate(table).where(F.col("window_end") <= F.lit(closed)).collect()
    assert got and sorted(got) == sorted(expected)


@pytest.mark.parametrize("name", ["stream_apply_rules", "stream_matches_by_kind", "stream_detection_rate"])
def test_registered_streams_read_tables_of_several_files(spark, tmp_path, name):
    """A table that is a folder of part files gives what the same table gives as one file."""
    import __spark_entry__ as entry_point

    single, query = "/root/testdata/sf0.001", entry_point.queries()[name]
    for table in ("documents", "orders", "events"):
        df = spark.read.parquet(f"{single}/{table}.parquet")
        # The events come in one file, so that all of them are in time for the watermark.
        df.repartition(1 if table == "events" else 4).write.parquet(str(tmp_path / f"{table}.parquet"))
    expected = query(spark, single).collect()
    assert expected and sorted(query(spark, str(tmp_path)).collect()) == sorted(expected)


def test_a_stream_without_input_is_empty(spark, source, tmp_path):
    table, _ = source
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "none"))
    assert drain_complete(matches_by_kind(detections(stream, keep=("line_no",)))).count() == 0


def test_a_drained_stream_tells_open_windows_and_late_rows(spark, source, tmp_path):
    """Files in order of time, then one with rows of long closed windows beside new ones."""
    table, _ = source
    for i, hours in enumerate(((0, 2), (2, 4), (4, 9))):
        part = table.where((F.hour("ts") >= hours[0]) & (F.hour("ts") < hours[1]))
        late = spark.createDataFrame([(1000, START + datetime.timedelta(minutes=5), "late a@b.org from 10.0.0.1")], table.schema)
        (part.unionByName(late) if i == 2 else part).coalesce(1).write.parquet(str(tmp_path / "in2" / f"{i}"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in2/*"))
    drained = drain_rates(detection_rate(stream))
    whole = detection_rate(spark.read.schema(table.schema).parquet(str(tmp_path / "in2/*")))
    got = {(r["window_start"], r["kind"]): (r["n"], r["closed"]) for r in drained.rates.collect()}
    late = {(r["window_start"], r["kind"]): r["n_late"] for r in late_rates(whole, drained.rates).collect()}
    assert late == {(START, "email"): 1, (START, "ipv4"): 1} and drained.n_dropped == 2
    want = {(r["window_start"], r["kind"]): r["n"] for r in whole.collect()}
    assert {key: n - late.get(key, 0) for key, n in want.items()} == {key: n for key, (n, _) in got.items()}
    # 06:39 less ten minutes: the window from six on is open, those before are not.
    assert {start.hour for (start, _), (_, closed) in got.items() if not closed} == {6}


def test_drained_rates_without_input(spark, source, tmp_path):
    table, _ = source
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "none"))
    assert drain_rates(detection_rate(stream)).rates.count() == 0
