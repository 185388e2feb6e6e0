"""Outputs appear whole or not at all, whatever ends a run."""

import os

import pytest

from maskloom.rules import Replace, Rule
from maskloom.sources import publish
from maskloom.sources.files import read_published, write_anonymised

RULES = [Rule("u", "user=", "user=\\w+", Replace("user=?"))]
COLUMNS = "bundle string, rel_path string, line_no bigint, line string, eol string"


def lines(spark, *texts, bundle="a b+c%"):
    return spark.createDataFrame([(bundle, "f", i, text, "\n") for i, text in enumerate(texts, 1)], COLUMNS)


def read(spark, target):
    return sorted(r["line"] for r in read_published(spark, target).collect())


class Killed(BaseException):
    pass


@pytest.mark.parametrize("at", ["write_manifest", "commit", "_rename"])
def test_a_killed_run_leaves_the_old_output(spark, tmp_path, monkeypatch, at):
    """Killed outright: nothing is cleaned up, not even the attempt."""
    target = str(tmp_path / "out")
    write_anonymised(lines(spark, "user=x", "old"), RULES, target)

    real = getattr(publish, at)

    def killed(*args, **kwargs):
        if at == "_rename" and publish.ATTEMPT not in args[1]:
            return real(*args, **kwargs)
        raise Killed

    with monkeypatch.context() as patch:
        import maskloom.sources.files as files

        patch.setattr(publish, "_delete", lambda *args: None)
        patch.setattr(files if at == "write_manifest" else publish, at, killed)
        with pytest.raises(Killed):
            write_anonymised(lines(spark, "user=y", "new"), RULES, target, replace=True)
    assert read(spark, target) == ["old", "user=?"]
    left = [name for name in os.listdir(tmp_path) if name.startswith(".out")]
    assert left and os.path.exists(target) == (at != "_rename")
    if at != "_rename":
        write_anonymised(lines(spark, "user=z", "newer"), RULES, target, replace=True)
        assert read(spark, target) == ["newer", "user=?"]
    assert publish.recover(spark, target) == target
    assert os.listdir(tmp_path) == ["out"]
    assert read(spark, target)[1] == "user=?"
    write_anonymised(lines(spark, "last"), RULES, target, replace=True)
    assert read(spark, target) == ["last"]


def test_a_failed_first_run_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    target = str(tmp_path / "out")
    bad = lines(spark, "x", "y").withColumn("line", F.when(F.col("line_no") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        write_anonymised(bad, RULES, target)
    assert os.listdir(tmp_path) == []
    with pytest.raises(publish.NotPublished):
        read_published(spark, target)
    assert publish.recover(spark, target) is None
    write_anonymised(lines(spark, "x"), RULES, target)
    with pytest.raises(FileExistsError):
        write_anonymised(lines(spark, "x"), RULES, target)


def test_the_manifest_tells_files_and_damage(spark, tmp_path):
    target = str(tmp_path / "out")
    binary = spark.createDataFrame([("a b+c%", "x.bin", bytearray(b"\x00\x01\x02"))], "bundle string, rel_path string, content binary")
    write_anonymised(lines(spark, "one", None, "user=é").coalesce(1), RULES, target, passthrough=binary)
    told = {r["part"]: r for r in publish.manifest(spark, target).collect()}
    assert (told["lines"]["bundle"], told["lines"]["rows"], told["lines"]["text_bytes"]) == ("a b+c%", 3, 3 + len("one" "user=?") + 3)
    assert (told["files"]["rows"], told["files"]["text_bytes"], told["files"]["bundle"]) == (1, len("a b+c%" "x.bin") + 3, None)
    assert publish.damages(spark, target).count() == 0
    part = next(p for p in (tmp_path / "out" / "lines").rglob("part-*.parquet"))
    extra = part.with_name("part-extra.parquet")
    extra.write_bytes(part.read_bytes())
    assert [r["damage"] for r in publish.damages(spark, target).collect()] == ["not listed"]
    part.unlink()
    assert sorted(r["damage"] for r in publish.damages(spark, target).collect()) == ["missing", "not listed"]
