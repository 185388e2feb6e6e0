import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions.globs import DEFAULT_EXCLUDES, glob_to_java, is_excluded, pattern_lines
from maskloom.functions.text import decode_text, is_text
from maskloom.operators.documents import lines_to_documents
from maskloom.operators.files import classify_files, exclude_files, plan_preview, plan_report
from maskloom.rules import Replace, Rule
from maskloom.sources.files import lines_of_files, read_files, read_large_lines, read_lines, write_anonymised

PATHS = [
    "a.tmp", "debug/x.log", "Logs/App.LOG", "dir/important-stacktrace.log", "krb5.conf", "x/krb5.conf", "a/b.keytab", "my keystore/x",
    "keys/p.pem.bak", "s.key", "deep/er/file.txt", "a[1].txt", "a1.txt", "b-c", "line\nbreak.log", "x^y", "p.pem",
]
PATTERN_LISTS = [
    ["*.tmp"], ["*.log", "!*stacktrace*"], ["!*.log", "*.log"], ["debug/*"], ["/debug/*"], ["*/x.log"], ["**/krb5.conf"], ["[ab]*"], ["[!a]*"],
    ["a[[]1].txt"], ["?1.txt", "a?.txt"], ["*", "!*.txt", "a*"], ["[a-c]-[a-c]"], ["[]]", "[b"], ["x[^]y"], ["  *.tmp  ", "", "!"], ["*\n*"],
    ["*.L[oO]G", "*x*", "!d*"], ["[z-a]*"], ["[!z-a].pem"],
]


def expected_verdict(path, patterns, fold):
    verdict = False
    values = ["/" + path, path, path.rsplit("/", 1)[-1]]
    for pattern in (p.strip() for p in patterns):
        negated, glob = pattern.startswith("!"), pattern.removeprefix("!")
        rx = re.compile(fnmatch.translate(glob), re.IGNORECASE if fold else 0)
        if glob and any(rx.fullmatch(v) for v in values):
            verdict = not negated
    return verdict


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("patterns", PATTERN_LISTS + [list(DEFAULT_EXCLUDES) + ["!*.key", "*.txt"]], ids=str)
def test_excludes_agree_with_fnmatch(spark, patterns, fold):
    df = spark.createDataFrame([(p,) for p in PATHS], "rel_path string")
    rows = df.select("rel_path", is_excluded(F.col("rel_path"), patterns, fold).alias("x")).collect()
    assert {r["rel_path"]: r["x"] for r in rows} == {p: expected_verdict(p, patterns, fold) for p in PATHS}


def test_long_pattern_lists_stay_one_expression(spark):
    df = spark.createDataFrame([("dir9999/x",), ("dir1/x",)], "rel_path string")
    patterns = [f"dir{i}/*" for i in range(2000)]
    marked = exclude_files(df, patterns)
    assert marked.where("excluded").count() == 1
    assert "Join" not in marked._jdf.queryExecution().executedPlan().toString()


def test_pattern_lines():
    assert pattern_lines("# note\n\n *.tmp \n!keep\n") == ["*.tmp", "!keep"]
    assert glob_to_java("a.b") == r"a\.b"


BYTES = [
    (b"", True), (b"plain\n", True), ("é".encode(), True), ("é".encode("latin-1"), True), (b"%PDF-1.4", False), (b"a\x00b", False),
    (b"\x1f\x8b..", False), (b"PK\x03\x04", False), (b"PAR1", False), (b"Obj\x01", False), (b"\x01" * 3 + b"a" * 7, True),
    (b"\x01" * 31 + b"a" * 69, False), (b"a" * 8192 + b"\x00", True), (b"a" * 8191 + b"\x00", False), (b"\x80" * 4 + b"a" * 6, False),
    (b"\t\n\x0c\r" * 5, True), (b"\x7f" * 4 + b"b" * 6, False), (b"GIF89a", False), (b"\xff\xd8\xff\xe0", False), (b" %PDF-", True),
]


def test_text_or_binary(spark):
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(BYTES)], "i int, content binary")
    rows = df.select("i", is_text(F.col("content")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [t for _, t in BYTES]


def test_decoding_looks_at_the_whole_value(spark):
    late = b"a" * 5000 + b"\xe9"
    df = spark.createDataFrame([(bytearray("é€".encode()),), (bytearray(b"caf\xe9"),), (bytearray(late),)], "content binary")
    assert [r[0] for r in df.select(decode_text(F.col("content"))).collect()] == ["é€", "café", late.decode("latin-1")]


def test_disposition_and_plan(spark):
    rows = [("b1", "a.log", b"x"), ("b1", "k.pem", b"x"), ("b1", "i.png", b"\x89PNG\r\n\x1a\n"), ("b2", "a.log", b"yy")]
    df = spark.createDataFrame([(b, p, bytearray(c)) for b, p, c in rows], "bundle string, rel_path string, content binary")
    files = classify_files(df).withColumn("length", F.octet_length("content"))
    assert [r["disposition"] for r in files.orderBy("bundle", "rel_path").collect()] == ["anonymise", "passthrough", "excluded", "anonymise"]
    plan = plan_report(files, [Rule("a", "", "x", Replace()), Rule("b", "", "x", Replace(), enabled=False)])
    assert {(r["bundle"], r["disposition"]): (r["n_files"], r["n_bytes"], r["n_rules"]) for r in plan.collect()} == {
        ("b1", "anonymise"): (1, 1, 1), ("b1", "passthrough"): (1, 8, 1), ("b1", "excluded"): (1, 1, 1), ("b2", "anonymise"): (1, 2, 1),
    }
    assert [(r["bundle"], r["rank"], r["rel_path"]) for r in plan_preview(files, 1).orderBy("bundle").collect()] == [
        ("b1", 1, "a.log"), ("b2", 1, "a.log"),
    ]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "bundle"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.log").write_bytes(b"user=bob\r\nsecond\rthird\n")
    (root / "sub" / "latin.txt").write_bytes(b"caf\xe9\nend")
    (root / "sub" / "deep" / "empty.log").write_bytes(b"")
    (root / "sub" / "image.bin").write_bytes(b"\x00\x01")
    (root / "krb5.conf").write_bytes(b"[realms]\n")
    (root / ".hidden" / "_deep").mkdir(parents=True)
    (root / ".hidden" / "_deep" / ".profile").write_bytes(b"user=al\n")
    (root / "odd names").mkdir()
    (root / "odd names" / "50%20 a#b?é.log").write_bytes(b"odd")
    (root / "link.log").symlink_to(root / "a.log")
    (root / "linked").symlink_to(root / "sub", target_is_directory=True)
    return root


def test_reading_a_tree(spark, tree):
    files = read_files(spark, str(tree))
    assert {r["rel_path"] for r in files.select("rel_path").collect()} == {
        "a.log", "sub/latin.txt", "sub/deep/empty.log", "sub/image.bin", "krb5.conf", ".hidden/_deep/.profile",
        "odd names/50%20 a#b?é.log",
    }
    lengths = {r["rel_path"]: (r["length"], bytes(r["content"])) for r in files.collect()}
    assert lengths["sub/deep/empty.log"] == (0, b"") and lengths[".hidden/_deep/.profile"] == (8, b"user=al\n")
    rows = read_lines(spark, str(tree), defaults=True).orderBy("rel_path", "line_no").collect()
    assert [(r["bundle"], r["rel_path"], r["line_no"], r["line"], r["eol"]) for r in rows] == [
        ("bundle", ".hidden/_deep/.profile", 1, "user=al", "\n"),
        ("bundle", "a.log", 1, "user=bob", "\r\n"), ("bundle", "a.log", 2, "second", "\r"), ("bundle", "a.log", 3, "third", "\n"),
        ("bundle", "odd names/50%20 a#b?é.log", 1, "odd", ""),
        ("bundle", "sub/latin.txt", 1, "café", "\n"), ("bundle", "sub/latin.txt", 2, "end", ""),
    ]
    single = read_lines(spark, str(tree / "a.log")).collect()
    assert {r["rel_path"] for r in single} == {"a.log"} and len(single) == 3


def test_paths_alone_do_not_read_contents(spark, tree):
    plan = exclude_files(read_files(spark, str(tree), complete=False)).select("rel_path", "excluded")
    assert "content" not in plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_large_files_are_split_and_stay_in_order(spark, tmp_path):
    texts = {
        "crlf.log": "".join(f"line {i} é\r\n" for i in range(3000)),
        "open.log": "".join(f"row {i}\n" for i in range(5000)) + "last",
        "blank.log": "\n\nx\n\n",
        "one.log": "single\r",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.log").write_bytes("".join(f"ligne {i} caf\xe9\n" for i in range(2000)).encode("latin-1"))
    texts["latin.log"] = "".join(f"ligne {i} café\n" for i in range(2000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_large_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 1
        rows = lines.orderBy("path", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, text in texts.items():
        mine = [r for r in rows if r["path"].endswith("/" + name)]
        assert "".join(r["line"] + r["eol"] for r in mine) == text
        assert [r["line_no"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(r["eol"] in ("\n", "\r\n") for r in mine[:-1])


@pytest.mark.parametrize("partitions", [1, 7])
def test_published_output_is_whole_and_ordered(spark, tree, tmp_path, partitions):
    files = read_files(spark, str(tree))
    marked = classify_files(files)
    lines = lines_of_files(marked.where("disposition = 'anonymise'"))
    rules = [Rule("u", "user=", "user=\\w+", Replace("user=?"))]
    target = str(tmp_path / "out")
    write_anonymised(lines, rules, target, "", marked.where("disposition = 'passthrough'"), partitions)
    back = lines_to_documents(spark.read.parquet(f"{target}/lines"), ("bundle", "rel_path"))
    assert {r["rel_path"]: r["text"] for r in back.collect()} == {
        "a.log": "user=?\r\nsecond\rthird\n", "sub/latin.txt": "café\nend", ".hidden/_deep/.profile": "user=?\n",
        "odd names/50%20 a#b?é.log": "odd",
    }
    kept = spark.read.parquet(f"{target}/files").collect()
    assert [(r["rel_path"], bytes(r["content"])) for r in kept] == [("sub/image.bin", b"\x00\x01")]
    with pytest.raises(Exception):
        write_anonymised(lines, rules, target)


def test_excluded_files_are_not_opened(spark, tmp_path):
    """A file of 3 GB without any line feed would stop the source that opens it."""
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.log").write_bytes(b"\xef\xbb\xbfone\ntwo")
    with open(tmp_path / "b" / "huge.keytab", "wb") as file:
        file.truncate(3 << 30)
    rows = read_lines(spark, str(tmp_path / "b"), defaults=True).orderBy("line_no").collect()
    assert [(r["rel_path"], r["line"], r["eol"]) for r in rows] == [("a.log", "one", "\n"), ("a.log", "two", "")]


def test_archive_members_in_pieces_are_the_same_lines(spark, tmp_path):
    import io
    import tarfile

    from maskloom.functions.text import decode_text
    from maskloom.operators.documents import documents_to_lines
    from maskloom.sources.archives import expand_archive_pieces
    from maskloom.sources.lines import lines_of_pieces
    from maskloom.sources.scratch import settled

    texts = {"a.txt": "".join(f"row {i} é\r\n" for i in range(300)).encode(), "b/c.txt": b"caf\xe9\rx\n" * 50 + b"end", "empty": b""}
    with tarfile.open(tmp_path / "x.tgz", "w:gz") as archive:
        for name, data in texts.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    named = spark.createDataFrame([("x", str(tmp_path / "x.tgz"))], "bundle string, path string")
    pieces = settled(expand_archive_pieces(named, size=100))
    assert pieces.groupBy("rel_path").count().where("count > 2").count() == 2
    whole = spark.createDataFrame([("x", n, bytearray(d)) for n, d in texts.items()], "bundle string, rel_path string, content binary")
    expected = documents_to_lines(whole.withColumn("text", decode_text(F.col("content"))), "text", ("bundle", "rel_path"))
    assert sorted(lines_of_pieces(pieces).collect()) == sorted(expected.collect())


def test_small_files_are_read_whole(spark, tmp_path, monkeypatch):
    """Many to a task, with the lines and failures that the text source gives."""
    from maskloom.sources import lines as source

    (tmp_path / "sub").mkdir()
    odd = {
        "a.log": b"one\ntwo", "b.log": b"", "c.log": b"\xef\xbb\xbfmark\r\nx\ry\n", "d.log": b"\xef\xbb\xbf", "e.log": b"caf\xe9\r\r\n\n",
        "sub/.hidden": b"h\n", "sub/f.gz.log": b"g\n", "sub/g.gz": b"plain\r", "sub/long.log": b"w" * 9000 + b"\n" + "é\n".encode() * 9000, "sub/nul.bin": b"\x00",
    }
    for name, content in odd.items():
        (tmp_path / name).write_bytes(content)
    for i in range(300):
        (tmp_path / "sub" / f"{i}.log").write_bytes(b"line %d\n" % i)
    found = read_lines(spark, str(tmp_path))
    assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, found.collect()))
    assert len(whole) == 300 + 2 + 3 + 3 + 1 + 1 + 1 + 9001
    assert {(r[1], *r[2:]) for r in whole if r[1] in ("c.log", "e.log")} == {
        ("c.log", 1, "mark", "\r\n"), ("c.log", 2, "x", "\r"), ("c.log", 3, "y", "\n"), ("e.log", 1, "café", "\r"), ("e.log", 2, "", "\r\n"), ("e.log", 3, "", "\n"),
    }
    for split_above in (100, 0):
        monkeypatch.setattr(source, "WHOLE_BYTES", split_above)
        assert sorted(map(tuple, read_lines(spark, str(tmp_path)).collect())) == whole


@pytest.mark.parametrize("whole_bytes", [4 << 20, 0])
def test_changed_files_fail_alone(spark, tmp_path, monkeypatch, whole_bytes):
    from maskloom.sources import lines as source
    from maskloom.sources.trees import catalogue

    monkeypatch.setattr(source, "WHOLE_BYTES", whole_bytes)
    for name in ("kept", "longer", "shorter", "gone"):
        (tmp_path / f"{name}.log").write_bytes(b"a\nb\n")
    listed = source.dispositions(catalogue(spark, [("b", str(tmp_path))]))
    (tmp_path / "longer.log").write_bytes(b"a\nb\nc\nd\n")
    (tmp_path / "shorter.log").write_bytes(b"a\n")
    (tmp_path / "gone.log").unlink()
    read = source.read_listed(spark, listed, [str(tmp_path)])
    assert sorted((r["rel_path"], r["line_no"], r["line"]) for r in read.lines.collect()) == [("kept.log", 1, "a"), ("kept.log", 2, "b")]
    assert {r["rel_path"] for r in read.failed.collect()} == {"longer.log", "shorter.log", "gone.log"}
    assert [(r["rel_path"], r["n_lines"]) for r in read.counts.collect()] == [("kept.log", 2)]
