"""Exclude lists as tables against the expression for short lists."""

import random

import pytest

from maskloom.operators.excludes import exclude_by_table, filed, pattern_table
from maskloom.operators.files import exclude_files


@pytest.mark.parametrize("seed", [1, 2])
def test_the_table_gives_what_the_expression_gives(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abAé.-") for _ in range(rng.randint(1, n)))
    paths = ["/".join(word(5) for _ in range(rng.randint(1, 4))) for _ in range(200)] + [None, "", "a\nb", "[x]", "a*b", "x" * 300]
    paths += paths[:20]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n bigint, rel_path string")
    pieces = ["*", "**", "?", "[a-b]", "[!a]", "[]x]", "[", "/"]
    patterns = []
    for _ in range(60):
        glob = "".join(rng.choice([word(4), rng.choice(pieces)]) for _ in range(rng.randint(1, 4)))
        patterns.append(("!" if rng.random() < 0.4 else "") + rng.choice([glob, rng.choice([p for p in paths if p])]))
    patterns += ["", "  ", "!", " *.b "]
    got = exclude_by_table(df, pattern_table(spark, patterns)).orderBy("n").collect()
    want = exclude_files(df, patterns, defaults=False).orderBy("n").collect()
    assert [(r["n"], r["rel_path"], r["excluded"]) for r in got] == [(r["n"], r["rel_path"], r["excluded"]) for r in want]
    assert {r["excluded"] for r in got} == {True, False}


def test_keys():
    assert filed("creds.jks") == ("whole", "creds.jks")
    assert filed("*.keytab") == ("end", ".keytab")
    assert filed("logs/*.x") == ("begin", "logs/")
    assert filed("*keystore*") == ("within", "ore")
    assert filed("*a-very-long-ending.log")[1] == "g-ending.log"
    assert filed("[ab]*") == ("any", "")


def test_no_patterns_and_no_paths(spark):
    df = spark.createDataFrame([("a",)], "rel_path string")
    none = pattern_table(spark, [])
    assert [r["excluded"] for r in exclude_by_table(df, none).collect()] == [False]
    assert exclude_by_table(df.where("false"), pattern_table(spark, ["*"])).count() == 0
