import io
import tarfile
import zipfile

import pytest

from maskloom.sources.archives import expand_archive_files, expand_archives, whole_bundles


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members:
            archive.writestr(name, data)
    return out.getvalue()


def tarred(*members, links=()):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            archive.addfile(info, None if data is None else io.BytesIO(data))
        for name, target in links:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, target
            archive.addfile(info)
    return out.getvalue()


BIG = bytes(range(256)) * 400
BUNDLES = {
    "good.zip": zipped(("a/x.log", b"one\n"), ("dir/", b""), ("b.bin", b"\x00\x01")),
    "good.tar.gz": tarred(("d", None), ("d/y.log", b"two\n"), ("e.txt", b""), links=[("l", "d/y.log")]),
    "GOOD.TGZ": tarred(("z", BIG)),
    "cut.tar.gz": tarred(("first", BIG), ("second", BIG))[:-200],
    "cut.zip": zipped(("a", b"x" * 100))[:-40],
    "noise.tgz": b"not an archive",
    "slip.zip": zipped(("ok.txt", b"1"), ("../evil", b"2")),
    "slip.tar.gz": tarred(("/abs", b"2")),
    "plain.log": b"line\n",
}


@pytest.fixture(scope="module")
def members(spark):
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in BUNDLES.items()], "bundle string, content binary")
    return expand_archives(df.repartition(4)).cache()


def test_members_of_sound_bundles(members):
    got = {(r["bundle"], r["rel_path"]): bytes(r["content"]) for r in whole_bundles(members).collect()}
    assert got == {
        ("good.zip", "a/x.log"): b"one\n",
        ("good.zip", "b.bin"): b"\x00\x01",
        ("good.tar.gz", "d/y.log"): b"two\n",
        ("good.tar.gz", "e.txt"): b"",
        ("GOOD.TGZ", "z"): BIG,
        ("plain.log", "plain.log"): b"line\n",
    }


def test_each_broken_bundle_reports_one_error(members):
    errors = members.where("error IS NOT NULL").collect()
    assert sorted(r["bundle"] for r in errors) == ["cut.tar.gz", "cut.zip", "noise.tgz", "slip.tar.gz", "slip.zip"]
    assert all("unsafe member path" in r["error"] for r in errors if r["bundle"].startswith("slip"))


def test_archives_by_path_give_the_same_members(spark, members, tmp_path):
    rows = []
    for name, data in BUNDLES.items():
        (tmp_path / name).write_bytes(data)
        rows.append((name, f"file:{tmp_path / name}"))
    rows.append(("missing.zip", str(tmp_path / "missing.zip")))
    by_path = expand_archive_files(spark.createDataFrame(rows, "bundle string, path string")).collect()

    def flat(collected):
        return sorted((r["bundle"], r["rel_path"] or "", bytes(r["content"] or b""), r["error"] is None) for r in collected)

    assert flat(r for r in by_path if r["bundle"] != "missing.zip") == flat(members.collect())
    assert [r["error"].split(":")[0] for r in by_path if r["bundle"] == "missing.zip"] == ["FileNotFoundError"]
