import re
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from maskloom.operators.bundles import archive_base, bundle_base_name, bundle_names, bundle_summary, safe_name, with_global_index

NAMES = ["", "  ", "in put", "a/b:c", "..x..", "é", "ok-1._", " . ", "line\nbreak", "()", "x" * 5]


def cleaned(name):
    base = name.strip()
    if not base:
        return "input"
    return re.sub(r"[^A-Za-z0-9._-]+", "_", base.replace("\n", "").replace("\r", "")).strip(" .") or "input"


def test_safe_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", safe_name(F.col("n")).alias("s")).collect()} == {n: cleaned(n) for n in NAMES}


def test_numbering_follows_the_order_of_the_batch(spark):
    df = spark.createDataFrame([(i, f"n {i}") for i in range(1500)], "i int, bundle string").repartition(8)
    got = {r["i"]: r["folder"] for r in bundle_names(df, "bundle", "i").collect()}
    assert got == {i: f"{i + 1:03d}-n_{i}" for i in range(1500)}


def test_the_global_index_uses_no_single_task(spark):
    indexed = with_global_index(spark.range(1000).repartition(8), "id")
    assert sorted((r["id"], r["idx"]) for r in indexed.collect()) == [(i, i + 1) for i in range(1000)]


def test_base_names(spark):
    names = ["a.tar.gz", "B.TGZ", "c.zip", "d.log", "e", ".hidden", "f.tar", "g.", "..b", "x.y.z"]

    def expected(name):
        for suffix in (".tar.gz", ".tgz"):
            if name.lower().endswith(suffix):
                return name[: -len(suffix)]
        return PurePosixPath(name).stem or name

    df = spark.createDataFrame([(n,) for n in names], "bundle string")
    assert {r["bundle"]: r["b"] for r in df.select("bundle", archive_base(F.col("bundle")).alias("b")).collect()} == {
        n: expected(n) for n in names
    }
    hidden = {r["base_name"] for r in bundle_base_name(df, hide_names=True).collect()}
    assert hidden == {"anonymized_output"} | {f"anonymized_output__{i}" for i in range(2, len(names) + 1)}


def test_one_bad_bundle_does_not_touch_the_others(spark):
    rows = [("a", "anonymise", None), ("a", "excluded", None), ("b", "anonymise", "unreadable"), ("c", "passthrough", None)]
    df = spark.createDataFrame(rows, "bundle string, disposition string, error string")
    got = {r["bundle"]: r.asDict() for r in bundle_summary(df).collect()}
    assert (got["a"]["n_succeeded"], got["b"]["n_failed"], got["c"]["n_passthrough"]) == (1, 1, 1)
    total = got[None]
    assert (total["n_bundles"], total["n_succeeded"], total["n_failed"], total["n_files"], total["is_total"]) == (3, 2, 1, 4, 1)
