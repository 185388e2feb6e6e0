import random
import re
import time

import pytest
from pyspark.sql import functions as F

from maskloom.operators.apply import apply_rules, audit_lines, rule_stats, rule_totals, rule_trigger
from maskloom.operators.documents import documents_to_lines, lines_to_documents
from maskloom.functions.pyrewrite import match_writer
from maskloom.rules import Bucket, Bucketize, DateShift, Mask, Redact, Replace, Rule, SecureHash, builtin_rules


def test_trigger_guards_the_pattern(lines):
    rule = Rule("s", "SECRET=", r"SECRET=\S+", Replace("SECRET=?"))
    rows = rule_stats(lines("nope", "SECRET=abc other", "", None), [rule]).orderBy("line_no").collect()
    assert [r["line_out"] for r in rows] == ["nope", "SECRET=? other", "", None]
    assert [r["n_replacements"] for r in rows] == [0, 1, 0, 0]


def test_the_builtin_trigger_is_literal(lines):
    rows = apply_rules(lines("user=bob", "user = bob", "USER=bob password='x' PASSWORD=abc"), builtin_rules()).orderBy("line_no")
    assert [r["line_out"] for r in rows.collect()] == [
        "user=[USER]", "user = bob", "user=[USER] password='x' password=[REDACTED]",
    ]


def test_rules_see_the_output_of_earlier_rules(lines):
    rules = [Rule("1", "a", "a", Replace("b")), Rule("2", "b", "b", Replace("c")), Rule("3", "a", ".", Redact())]
    assert apply_rules(lines("a"), rules).first()["line_out"] == "c"


@pytest.mark.parametrize("trigger", ["Kib", "mini", "i", "a.b", "é"])
def test_any_case_triggers_follow_lower(lines, trigger):
    texts = ["kib", "Kib", "KIB", "MINI", "minİ", "MİNI", "İ", "A.B", "axb", "É", "ſ", "", None]
    rule = Rule("t", trigger, "x", Redact(), case_sensitive=False)
    rows = rule_trigger(lines(*texts), rule).orderBy("line_no").collect()
    assert [r["is_triggered"] for r in rows] == [t is not None and trigger.lower() in t.lower() for t in texts]


def test_statistics(lines):
    rules = [
        Rule("n", "", r"\d", Replace("#")),
        Rule("same", "x", "x", Replace("y")),
        Rule("same", "y", "y", Mask()),
        Rule("never", "zzz", "z", Redact()),
        Rule("off", "", ".", Redact(), enabled=False),
        Rule("fires", "#", "q", Redact()),
    ]
    row = rule_stats(lines("12x"), rules).first()
    assert row["line_out"] == "##*" and row["n_replacements"] == 4
    assert row["triggered"] == ["fires", "n", "same"]
    assert row["by_rule"] == {"n": 2, "same": 2}


def test_totals(spark):
    df = spark.createDataFrame([("a", "1 x"), ("a", "22"), ("b", "x")], "path string, line string")
    rules = [Rule("d", "", r"\d", Redact()), Rule("x", "x", "x", Redact())]
    rows = {(r["path"], r["rule"], r["level"]): r["n"] for r in rule_totals(rule_stats(df, rules)).collect()}
    assert rows == {
        ("a", "d", 0): 3, ("a", "x", 0): 1, ("b", "x", 0): 1, ("a", None, 1): 4, ("b", None, 1): 1, (None, None, 3): 5,
    }


def test_partitioning_does_not_matter(spark, lines):
    rules = [*builtin_rules(), Rule("h", "", r"u\d+", SecureHash())]
    df = lines(*[f"user=u{i} u{i} username=x{i}" for i in range(200)])
    one, many = (apply_rules(df.repartition(n), rules, "s") for n in (1, 8))
    assert sorted(one.collect()) == sorted(many.collect())


@pytest.mark.parametrize("build", [apply_rules, rule_stats])
def test_fifty_rules_plan_quickly_and_stay_small(lines, build):
    def planned(n):
        rules = [Rule(f"r{i}", f"t{i}", rf"\bz{i}(\d+)", Mask(group=1) if i % 2 else Replace("q")) for i in range(n)]
        df = build(lines("t1 z1"), rules).where("line <> line_out")
        started = time.time()
        return len(df._jdf.queryExecution().optimizedPlan().toString()), time.time() - started, df.count()

    small, _, _ = planned(10)
    large, seconds, _ = planned(50)
    assert large < 8 * small and seconds < 20


def test_rules_are_narrow(lines):
    plan = apply_rules(lines("a"), builtin_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    "before, rule, spans",
    [
        ("user=bob", Rule("u", "", "bob", Replace("[USER]")), ["[USER]"]),
        ("acct=1234567890123456 x", Rule("a", "", r"\d{16}", Mask(keep_last=4)), ["************"]),
        ("id", Rule("i", "", "^", Replace("[UUID] ")), ["[UUID] "]),
        ("abc", Rule("d", "", "b", Redact()), []),
        ("a1b2", Rule("d", "", r"\d", Replace("#")), ["#", "#"]),
    ],
)
def test_spans_cover_the_changed_output(lines, before, rule, spans):
    row = audit_lines(lines(before, None), [rule]).collect()
    assert len(row) == 1
    assert [row[0]["line_out"][s["start"] : s["end"]] for s in row[0]["spans"]] == spans


def test_spans_can_be_exploded_and_counted(lines):
    changed = audit_lines(lines("a1b2", "c3"), [Rule("d", "", r"\d", SecureHash(8)), Rule("e", "", "(c)", Mask(group=1))])
    assert changed.select("line_no", F.posexplode("spans")).count() >= 3


TEXTS = ["", "a", "a\n", "\n", "\n\n", "a\r\nb\rc\n", "\r", "x\n\r\ny", "é z\x0b\n", " \n "]


def python_lines(text):
    import re

    parts = re.split("(\r\n|\n|\r)", text)
    pairs = [(parts[i], parts[i + 1] if i + 1 < len(parts) else "") for i in range(0, len(parts), 2)]
    return [p for p in pairs if p != ("", "")]


@pytest.mark.parametrize("chunk", [1, 2, 100_000])
def test_lines_and_back(spark, chunk):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "path string, text string")
    parts = documents_to_lines(df)
    for i, text in enumerate(TEXTS):
        rows = parts.where(F.col("path") == str(i)).orderBy("line_no").collect()
        assert [(r["line"], r["eol"]) for r in rows] == python_lines(text)
        assert [r["line_no"] for r in rows] == list(range(1, len(rows) + 1))
    back = {}
    for r in lines_to_documents(parts, chunk_lines=chunk).orderBy("path", "chunk_no").collect():
        back[r["path"]] = back.get(r["path"], "") + r["text"]
    assert back == {str(i): t for i, t in enumerate(TEXTS) if t}


POOL = [
    Rule("digits", "", r"\d+", Replace(r"<\g<0>>")),
    Rule("pair", "=", r"(\w+)=(\w+)", Replace(r"\2=\1")),
    Rule("mask", "A", r"a(\w*)", Mask("#", 1, 1, 1), case_sensitive=False),
    Rule("hash", "b", r"b\w", SecureHash(8)),
    Rule("gone", "<", r"<[^>]*>", Redact()),
    Rule("bucket", "", r"(\d+)", Bucketize((Bucket(0, 9, "few"), Bucket(10, 99, "some")), 1)),
    Rule("date", "20", r"20\d\d-\d\d-\d\d", DateShift(max_shift_days=5)),
    Rule("optional", "", r"x(y)?", Mask("*", group=1)),
    Rule("blank", "", r"\s*$", Replace("$")),
    Rule("digits", "é", r"é", Replace("e")),
    Rule("off", "", r".", Redact(), enabled=False),
]


@pytest.mark.parametrize("seed", range(6))
def test_rule_lists_agree_with_going_one_by_one(lines, seed):
    rnd = random.Random(seed)
    rules = rnd.sample(POOL[:-1], rnd.randint(2, 7)) + [POOL[-1]]
    rnd.shuffle(rules)
    words = ["a=b", "b1", "Abba", "12", "2024-02-28", "xy", "x", "é", "<z>", " ", "  ", "aé=7", "20", "=", "\t"]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 8))) for _ in range(60)]

    expected = []
    for text in texts:
        counts, fired = {}, set()
        for rule in rules:
            word, line = (rule.trigger, text) if rule.case_sensitive else (rule.trigger.lower(), text.lower())
            if not rule.enabled or word not in line:
                continue
            fired.add(rule.key)
            text, n = re.subn(rule.search, match_writer(rule, "s"), text, flags=rule.flags)
            if n:
                counts[rule.key] = counts.get(rule.key, 0) + n
        expected.append((text, sorted(fired), counts))
    df = lines(*texts).repartition(3)
    got = rule_stats(df, rules, "s").orderBy("line_no").collect()
    assert [(r["line_out"], r["triggered"], r["by_rule"]) for r in got] == expected
    assert [r["n_replacements"] for r in got] == [sum(counts.values()) for _, _, counts in expected]
    assert [r["line_out"] for r in apply_rules(df, rules, "s").orderBy("line_no").collect()] == [text for text, _, _ in expected]


def test_outside_the_spans_the_output_comes_from_the_input(lines):
    texts = ["user=bob pin=1234 x", "aaaa", "1 22 333", "no digits", "é1é"]
    for row in audit_lines(lines(*texts), [Rule("d", "", r"\d+", Mask("#")), Rule("b", "", "b", Replace("BB"))]).collect():
        kept = [c for i, c in enumerate(row["line_out"]) if not any(s["start"] <= i < s["end"] for s in row["spans"])]
        rest = iter(row["line"])
        assert all(c in rest for c in kept)
        assert all(a["end"] < b["start"] for a, b in zip(row["spans"], row["spans"][1:]))


@pytest.mark.parametrize("chunk_bytes", [1, 7, 100, 5000, 1 << 28])
def test_documents_come_back_whole(spark, chunk_bytes, monkeypatch):
    """Short, long, many-lined and wide-lined documents, one of them of most lines; chunks are bounded and tell their offset."""
    from maskloom.operators import documents

    monkeypatch.setattr(documents, "LEAF_LINES", 16)
    monkeypatch.setattr(documents, "LEAF_BYTES", 64)
    texts = {"a": "x", "b": "\n" * 30, "c": "é\r\n" * 200 + "end", "d": "w" * 6000 + "\nq", None: "null key\r" * 9, "hot": "".join(f"{i}\n" for i in range(3000))}
    df = spark.createDataFrame([("s", *item) for item in texts.items()], "bundle string, path string, text string")
    lines = documents_to_lines(df, "text", ("bundle", "path"))
    rows = lines_to_documents(lines.repartition(8), ("bundle", "path"), chunk_bytes=chunk_bytes).collect()
    for name, text in texts.items():
        mine = sorted((r["chunk_no"], r["offset"], r["text"]) for r in rows if r["path"] == name)
        assert "".join(part for _, _, part in mine) == text
        sizes = [len(part.encode()) for _, _, part in mine]
        assert [offset for _, offset, _ in mine] == [sum(sizes[:i]) for i in range(len(sizes))]
        assert len(mine) == 1 or len(text.encode()) > chunk_bytes
        longest = max(len(line.encode()) for line in text.splitlines(keepends=True))
        assert all(size < chunk_bytes + longest or len(mine) == 1 for size in sizes)


def test_long_rule_lists_give_what_the_plain_fold_gives(spark, monkeypatch):
    """Random triggers, in any case or not, without one, beyond ASCII, that other rules write; nulls and empty lines."""
    from maskloom.operators import apply

    rng = random.Random(8)
    letters = "abkKiIé[.= "
    some = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    texts = [None, "", *(some(12) for _ in range(80)), "\u212a", "x\u0130", "É", "zzz" * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no bigint, line string")
    for with_plain in (False, True):
        rules = []
        for i in range(40):
            trigger = "" if with_plain and i % 30 == 7 else some(4)
            search = re.escape(some(2)) if i % 3 else re.escape(trigger or "b")
            rules.append(Rule(f"r{i % 50}", trigger, search, rng.choice([Replace(some(3).replace("\\", "")), Redact(), Mask()]), case_sensitive=bool(i % 4)))
        columns = ["line_no", "line_out", "n_replacements", "triggered", "by_rule"]
        told = []
        for length in (24, 10**6):
            monkeypatch.setattr(apply, "LONG_LIST", length)
            monkeypatch.setattr(apply, "BLOCK", 16)
            stats = rule_stats(df, rules).select(*columns).orderBy("line_no").collect()
            out = apply_rules(df, rules).orderBy("line_no").collect()
            told.append((stats, out))
        assert told[0] == told[1]
        assert any(a["line_out"] != t for a, t in zip(told[0][1], texts, strict=True))


def test_a_pattern_holds_every_trigger():
    from maskloom.functions.triggers import trigger_pattern

    rng = random.Random(3)
    for _ in range(60):
        triggers = ["".join(rng.choice("abcdefghijklmnop.*") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 80))]
        pattern = re.compile(trigger_pattern([Rule("t", t, "x", Redact()) for t in triggers]).replace("\\x{", "\\x").replace("}", ""))
        for _ in range(40):
            text = "".join(rng.choice("abcdefghijklmnop.*") for _ in range(6))
            assert bool(pattern.search(text)) == any(t in text for t in triggers)
