import io
import zipfile

import pytest

from maskloom.jobs import Options, anonymise
from maskloom.operators.documents import lines_to_documents
from maskloom.rules import Replace, Rule


@pytest.fixture
def sources(tmp_path):
    folder = tmp_path / "first"
    (folder / "host1").mkdir(parents=True)
    (folder / "host1" / "bob.log").write_text("user=bob from c@x.org\n")
    (folder / "alice.log").write_text("alice\n")
    (folder / "image.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (folder / "server.pem").write_text("key\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("in/x.log", "user=al\r\nx")
    (tmp_path / "second.zip").write_bytes(out.getvalue())
    (tmp_path / "broken.tar.gz").write_bytes(b"no archive")
    names = ["first", "second.zip", "broken.tar.gz", "missing"]
    return {name: str(tmp_path / name) for name in names}


RULES = [Rule("names", "", "alice|bob", Replace("NAME"))]


def texts(spark, target):
    back = lines_to_documents(spark.read.parquet(f"{target}/lines"), ("bundle", "rel_path"))
    return {(r["bundle"].rsplit("/", 1)[-1], r["rel_path"]): r["text"] for r in back.collect()}


def test_a_batch_with_broken_inputs(spark, sources, tmp_path):
    target = str(tmp_path / "out")
    summary = anonymise(spark, sources.values(), target, RULES, Options(profile=True, salt="s"))
    rows = {(r["bundle"] or "total").rsplit("/", 1)[-1]: r for r in summary.collect()}
    assert (rows["first"]["n_anonymised"], rows["first"]["n_passthrough"], rows["first"]["n_excluded"]) == (2, 1, 1)
    assert (rows["total"]["n_succeeded"], rows["total"]["n_failed"]) == (2, 2)
    assert texts(spark, target) == {
        ("first", "host1/bob.log"): "user=[USER] from c@x.org\n",
        ("first", "alice.log"): "NAME\n",
        ("second.zip", "in/x.log"): "user=[USER]\r\nx",
    }
    assert [r["rel_path"] for r in spark.read.parquet(f"{target}/files").collect()] == ["image.png"]
    report = spark.read.json(f"{target}/report")
    assert {r["kind"] for r in report.where("section = 'matches_by_kind'").collect()} == {"email"}


def test_hidden_names(spark, sources, tmp_path):
    target = str(tmp_path / "out")
    anonymise(spark, [sources["first"]], target, RULES, Options(hide_names=True))
    assert {path for _, path in texts(spark, target)} == {"host1/NAME.log", "NAME.log"}


def test_no_enabled_rule_is_an_error(spark, sources, tmp_path):
    with pytest.raises(ValueError):
        anonymise(spark, [sources["first"]], str(tmp_path / "out"), [], Options(builtin=False))


def test_hidden_names_are_nowhere_in_the_output(spark, sources, tmp_path):
    target = tmp_path / "out"
    wanted = [sources["first"], sources["second.zip"]]
    summary = anonymise(spark, wanted, str(target), RULES, Options(hide_names=True, profile=True))
    assert {r["bundle"] for r in summary.collect()} == {"anonymized_output", "anonymized_output__2", None}
    told = [str(p.relative_to(target)) for p in target.rglob("*")]
    told += [p.read_text() for p in (target / "report").glob("part-*")]
    assert not any(word in text for text in told for word in ("first", "second.zip", "bob", "alice", str(tmp_path)))


def test_nothing_is_left_in_scratch(spark, sources, tmp_path):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    with zipfile.ZipFile(tmp_path / "keys.zip", "w") as archive:
        archive.writestr("a.keytab", "secret key")
        archive.writestr("b/../c.log", "user=x\n")
    summary = anonymise(spark, [str(tmp_path / "keys.zip"), *sources.values()], str(tmp_path / "out"), RULES)
    assert set(shared.iterdir()) == before
    rows = {(r["bundle"] or "total").rsplit("/", 1)[-1]: r for r in summary.collect()}
    assert (rows["keys.zip"]["n_anonymised"], rows["keys.zip"]["n_excluded"]) == (1, 1)
    assert not any(b"secret key" in p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file())


def test_bundle_names_and_long_files_come_back_as_they_were(spark, tmp_path):
    from maskloom.sources.files import read_published

    text = "".join(f"user=u{i}\r" if i % 1000 == 7 else f"line {i}\n" for i in range(25_000))
    for name in ("007", "2024"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "long.log").write_bytes(text.encode())
    target = str(tmp_path / "out")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        anonymise(spark, [str(tmp_path / "007"), str(tmp_path / "2024")], target, RULES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = read_published(spark, target).orderBy("bundle", "line_no").collect()
    assert {r["bundle"] for r in rows} == {str(tmp_path / "007"), str(tmp_path / "2024")}
    for name in ("007", "2024"):
        mine = [r for r in rows if r["bundle"].endswith("/" + name)]
        assert [r["line_no"] for r in mine] == list(range(1, 25_001))
        assert "".join(r["line"] + r["eol"] for r in mine) == "".join(
            "user=[USER]\r" if i % 1000 == 7 else f"line {i}\n" for i in range(25_000)
        )


def test_published_bundle_names_stay_text(spark, tmp_path):
    from maskloom.sources.files import read_published, write_anonymised

    rows = [(b, "f", 1, "user=x", "\n") for b in ("007", "2024")]
    lines = spark.createDataFrame(rows, "bundle string, rel_path string, line_no bigint, line string, eol string")
    write_anonymised(lines, RULES, str(tmp_path / "out"))
    assert {r["bundle"] for r in read_published(spark, str(tmp_path / "out")).collect()} == {"007", "2024"}
    (tmp_path / "half" / "lines").mkdir(parents=True)
    with pytest.raises(Exception):
        read_published(spark, str(tmp_path / "half"))


def test_an_unreadable_file_costs_no_other(spark, tmp_path, monkeypatch):
    """Files that go bad after they were listed: one removed, one cut, one hidden, one binary; and text under names of packed files."""
    import maskloom.jobs as jobs
    from maskloom.sources.lines import dispositions

    folder = tmp_path / "many"
    (folder / "sub").mkdir(parents=True)
    for i in range(200):
        (folder / f"{i}.log").write_text(f"user=u{i}\nline {i}" + "\n" * (i % 2))
    (folder / "sub" / "plain.log.gz").write_text("user=packed\r\nby name only\n")
    (folder / "sub" / "bom.txt").write_bytes(b"\xef\xbb\xbfuser=x\r\n\r\n")
    (folder / "sub" / ".hidden").write_text("a\nb")
    (folder / "empty").write_text("")
    for name in ("gone.bin", "kept.bin"):
        (folder / "sub" / name).write_bytes(b"\x00" * 50)

    def listed_then_damaged(files, *args, **kwargs):
        found = dispositions(files, *args, **kwargs)
        if (folder / "7.log").exists():
            (folder / "7.log").unlink()
            (folder / "8.log").write_text("user=")
            (folder / "sub" / ".hidden").unlink()
            (folder / "sub" / "gone.bin").write_bytes(b"\x00")
        return found

    monkeypatch.setattr(jobs, "dispositions", listed_then_damaged)
    target = str(tmp_path / "out")
    summary = {r["bundle"]: r for r in anonymise(spark, [str(folder)], target, RULES).collect()}
    told = summary[None]
    assert (told["n_failed_files"], told["n_failed"], told["n_succeeded"], told["n_files"]) == (4, 0, 1, 206)
    assert (told["n_anonymised"], told["n_passthrough"]) == (201, 1)
    out = texts(spark, target)
    assert out[("many", "sub/plain.log.gz")] == "user=[USER]\r\nby name only\n"
    assert out[("many", "sub/bom.txt")] == "user=[USER]\r\n\r\n"
    assert {path for _, path in out} == {f"{i}.log" for i in range(200) if i not in (7, 8)} | {"sub/plain.log.gz", "sub/bom.txt"}
    assert [r["rel_path"] for r in spark.read.parquet(f"{target}/files").collect()] == ["sub/kept.bin"]


def test_a_file_that_changes_while_it_is_written_stops_the_run(spark, sources, tmp_path, monkeypatch):
    import maskloom.jobs as jobs
    from maskloom.sources.publish import NotPublished

    real = jobs.read_listed

    def read_then_damaged(*args, **kwargs):
        read = real(*args, **kwargs)
        (tmp_path / "first" / "alice.log").unlink(missing_ok=True)
        return read

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "read_listed", read_then_damaged)
        with pytest.raises(OSError, match="run again"):
            anonymise(spark, [sources["first"]], str(tmp_path / "out"), RULES)
    from maskloom.sources.files import read_published

    with pytest.raises(NotPublished):
        read_published(spark, str(tmp_path / "out"))
    anonymise(spark, [sources["first"]], str(tmp_path / "out"), RULES)
    assert {path for _, path in texts(spark, str(tmp_path / "out"))} == {"host1/bob.log"}
