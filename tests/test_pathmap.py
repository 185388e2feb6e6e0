import hashlib
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from maskloom.functions import paths as p
from maskloom.operators.pathmap import normal_path, path_components, path_map, path_map_stats
from maskloom.rules import Redact, Replace, Rule
from maskloom.sources.scratch import measured

RULES = [Rule("n", "", r"alice|bob|carol|\d+", Replace("user"), False), Rule("h", "host", r"host\w*", Replace("HOST"))]


def simple(name, is_dir):
    """The same rules on one component, in plain Python."""
    import re

    ext = "" if is_dir else "".join(PurePosixPath("x/" + name).suffixes)
    stem = name[: len(name) - len(ext)]
    made = re.sub(r"alice|bob|carol|\d+", "user", stem, flags=re.I)
    if "host" in made:
        made = re.sub(r"host\w*", "HOST", made)
    return made + ext


def one_by_one(paths):
    """Names given out in path order, each entry taking the first name still free in its folder."""
    taken, folders, out = {}, {}, {}

    def claim(parent, name, source):
        used = taken.setdefault(parent, set())
        ext = "".join(PurePosixPath("x/" + name).suffixes)
        stem = name[: len(name) - len(ext)]
        mark = hashlib.sha1(source.encode()).hexdigest()[:8]
        tries = [name, f"{stem}__{mark}{ext}"] + [f"{stem}__{mark}__{i}{ext}" for i in range(2, 50)]
        chosen = next(t for t in tries if t not in used)
        used.add(chosen)
        return chosen

    for path in sorted(paths):
        parts = path.split("/")
        parent, made = "", []
        for part in parts[:-1]:
            folder = f"{parent}/{part}" if parent else part
            if folder not in folders:
                folders[folder] = claim(parent, simple(part, True), folder)
            made.append(folders[folder])
            parent = folder
        out[path] = "/".join([*made, claim(parent, simple(parts[-1], False), path)])
    return out


def mapping(spark, paths, rules=RULES, salt="s"):
    df = spark.createDataFrame([(x,) for x in paths], "rel_path string").repartition(4)
    return {r["rel_path"]: r["anon_path"] for r in path_map(path_components(df, rules, salt)).collect()}


def test_components_and_suffixes(spark):
    got = mapping(spark, ["host123/user-bob.log", "alice.log", "bob.tar.gz"])
    assert got == {"host123/user-bob.log": "HOST/user-user.log", "alice.log": "user.log", "bob.tar.gz": "user.tar.gz"}


def test_first_path_keeps_the_name(spark):
    got = mapping(spark, ["bob.log", "alice.log"])
    assert got["alice.log"] == "user.log"
    assert got["bob.log"] == f"user__{hashlib.sha1(b'bob.log').hexdigest()[:8]}.log"


def test_unsafe_names_become_hashes(spark):
    got = mapping(spark, ["host:1?.log", "CON/x", "a/tra"], [Rule("t", "", "tra", Redact())])
    assert got["host:1?.log"].startswith("f_") and got["host:1?.log"].endswith(".log")
    assert got["CON/x"] == f"d_{hashlib.sha256(b's:CON').hexdigest()[:16]}/x"
    assert got["a/tra"] == f"a/f_{hashlib.sha256(b's:tra').hexdigest()[:16]}"


def test_marked_names_may_clash_again(spark):
    mark = hashlib.sha1(b"bob.log").hexdigest()[:8]
    folder_mark = hashlib.sha1(b"carol.log").hexdigest()[:8]
    paths = ["alice.log", "bob.log", "bob.log/x", f"a/user__{mark}.log", f"user__{mark}.log", "carol.log", f"aa__{folder_mark}.log/y"]
    # The plain name sorts after or before the entry that is marked with it.
    early = f"User__{folder_mark}.log"
    plain = [Rule("n", "", r"alice|bob|carol", Replace("User"))]
    paths += [early]
    import re

    expected = {}
    original = simple
    try:
        globals()["simple"] = lambda name, is_dir: re.sub("alice|bob|carol", "User", name)
        expected = one_by_one(paths)
    finally:
        globals()["simple"] = original
    assert mapping(spark, paths, plain) == expected


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_going_one_by_one(spark, seed):
    rnd = random.Random(seed)
    names = ["alice", "bob", "carol", "x1", "x22", "x3", "host1", "host2", "user", "b.d"]
    paths = set()
    while len(paths) < 300:
        depth = rnd.choice([0, 0, 1, 2, 3])
        parts = [rnd.choice(names) for _ in range(depth)] + [rnd.choice(names) + rnd.choice(["", ".log", ".tar.gz"])]
        paths.add("/".join(parts))
    got = mapping(spark, paths)
    assert got == one_by_one(paths)
    assert len(set(got.values())) == len(paths)


def test_a_folder_with_one_name_for_all(spark):
    paths = [f"hot/{i}.log" for i in range(3000)] + ["cold/1.log"]
    got = mapping(spark, paths)
    assert got == one_by_one(paths) and len(set(got.values())) == len(paths)


def test_large_sides_are_not_broadcast(spark):
    table = spark.createDataFrame([("a" * 1000,)], "s string")
    plans = [spark.range(1).withColumn("s", F.lit("a")).join(measured(table, n), "s") for n in (10_000, 100)]
    hinted = ["broadcast" in df._jdf.queryExecution().analyzed().toString() for df in plans]
    assert hinted == [True, False]


def test_joins_without_broadcast_give_the_same(spark, monkeypatch):
    paths = [f"hot/{i % 40}/{i}.log" for i in range(400)]
    expected = mapping(spark, paths)
    monkeypatch.setattr("maskloom.operators.pathmap.measured", lambda df: df)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert mapping(spark, paths) == expected == one_by_one(paths)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_statistics_count_folders_once(spark):
    df = spark.createDataFrame([("host1/a.log",), ("host1/b.log",), ("plain/c.log",), ("alice.log",), ("bob.log",)], "rel_path string")
    parts = path_components(df, RULES, "s")
    row = path_map_stats(parts, path_map(parts)).first()
    assert row.asDict() == {"paths_total": 5, "paths_changed": 4, "components_changed": 3, "collisions_resolved": 1}


def test_bundles_have_names_of_their_own(spark):
    df = spark.createDataFrame([("b1", "alice.log"), ("b2", "bob.log")], "bundle string, rel_path string")
    out = path_map(path_components(df, RULES, "s", scope=("bundle",)), ("bundle",))
    assert sorted((r["bundle"], r["anon_path"]) for r in out.collect()) == [("b1", "user.log"), ("b2", "user.log")]


def test_paths_are_tidied(spark):
    df = spark.createDataFrame([("./a//b/./c",), ("/x/",), ("a.b/..c/d.",), (".",), ("y",)], "p string")
    assert [r[0] for r in df.select(normal_path(F.col("p"))).collect()] == ["a/b/c", "x", "a.b/..c/d.", "", "y"]


NAMES = [
    "a.tar.gz", ".bashrc", "..a.b", "a.", "a..b", "a.b.", ".a.b", "...", "a. b", "x.y z.log", "plain", "COM1.txt", "con", "lpt9", "COM10", "n\ttab",
    "x" * 200, "x" * 201, " a", "a ", " a", "a/b", "q?", "", ".", "..", "a:b", "tail. ", "AUX.tar.gz",
]


def test_suffixes_follow_pathlib(spark):
    names = [n for n in NAMES if n not in ("", ".", "..") and "/" not in n]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", p.suffixes_of(F.col("n")).alias("e"), p.stem_of(F.col("n")).alias("s")).collect():
        assert r["e"] == "".join(PurePosixPath(r["n"]).suffixes) and r["s"] + r["e"] == r["n"]


def test_safe_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    good = {r["n"] for r in df.where(p.is_safe_component(F.col("n"))).collect()}
    assert good == {"a.tar.gz", ".bashrc", "..a.b", "a..b", ".a.b", "a. b", "x.y z.log", "plain", "COM10", "x" * 200}


@pytest.mark.parametrize("ext, clean", [("", ""), (".log", ".log"), (".l:g", ".l_g"), (".tar. .", ".tar"), (". ", "")])
def test_extensions_are_cleaned(spark, ext, clean):
    df = spark.createDataFrame([(ext,)], "e string")
    assert df.select(p.sanitised_extension(F.col("e"))).first()[0] == clean
