"""Java patterns against Python's re on the same texts."""

import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions.dialect import UntranslatablePattern, split_at_group, split_off, translate, translate_template

TEXTS = [
    "", "a", "user=bob", "é1234 1234é 1234", "x[1]&&y^z", "a{b} {2,} {,3} aaaa", "tab\tnl\nend", "line\r", "A B  ",
    "$1 \\ back", "foofoo barbar", "2024-01-02", "Ünïcode_ñ word", "٣٤ digits", "--]--", "a.b.c", "ab" * 5, "\x0b\x0c\x08", "KK k", "line sep\n",
]
PATTERNS = [
    r"\bword\b", r"\b\d+\b", r"\w+", r"\s+", r"\W", r"[[\]]", r"[]a-]+", r"[^]a]+", r"[&&y]+", r"[\w.-]+", r"a{,3}", r"a{2,}", r"{b}", r"a{b",
    r"(?P<x>foo|bar)(?P=x)", r"(?i)USER", r"^.", r".$", r"\Aa", r"e\Z", r"(?<=user=)\w+", r"(?<!\d)\d{4}", r"(?:a|b)+?", r"[\b\v]", r"\v", r"(?#note)a",
    r"\x41", r"ü", r"\.", r"\$\d", r"\\", r"\d+", r"(a)(b)\2\1", r"\101", r"\0", r"[^\W\d_]+", r"(?s:.)+", r"(?u)\w+", r"x*", r"-+\]", r"(?i:k)+",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_agree_with_python(spark, pattern):
    java = translate(pattern).java
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", F.regexp_extract_all("t", F.lit(java), F.lit(0)).alias("m")).collect()
    for row in rows:
        assert row["m"] == [m.group() for m in re.finditer(pattern, row["t"])], row["t"]


def test_ignore_case_is_unicode(spark):
    java = translate("ÜNÏ", re.IGNORECASE).java
    assert spark.createDataFrame([("ünï",)], "t string").where(F.rlike("t", F.lit(java))).count() == 1


@pytest.mark.parametrize("pattern", [r"(a)?(?(1)b|c)", r"(?x) a b", r"(?a)\w"])
def test_constructs_without_equivalent(pattern):
    with pytest.raises(UntranslatablePattern):
        translate(pattern)


@pytest.mark.parametrize("pattern, empty", [("a*", True), (r"\b", True), ("a|", True), ("a+", False), (r"(?=x)", True), ("(a)?b", False)])
def test_empty_matches_are_known(pattern, empty):
    assert translate(pattern).may_be_empty is empty


@pytest.mark.parametrize(
    "pattern, template",
    [
        (r"(\d)(\d)", r"\2\1"), (r"(\d)", r"\g<1>0"), (r"(?P<n>\w)", r"<\g<n>>"), (r"\d", r"$1\\x"), (r"\d", r"\n\t|"), (r"(\d)", r"\1$"),
        (r"(a)|(\d)", r"[\1\2]"), (r"\d", r"\g<0>\g<0>"), (r"\d", r"\."), (r"\d", r"\101\0"), (r"x*", "-"), (r"\b", "|"),
    ],
)
def test_templates_agree_with_python(spark, pattern, template):
    texts = ["12 a", "a", "", "7", "$ 1", "axxb"]
    java, value = translate(pattern).java, translate_template(template, pattern)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", F.regexp_replace("t", F.lit(java), F.lit(value)).alias("o")).collect():
        assert row["o"] == re.sub(pattern, template, row["t"])


@pytest.mark.parametrize("template", [r"\2", r"\g<nope>", r"\q", "x\\"])
def test_bad_templates_fail_on_the_driver(template):
    with pytest.raises(ValueError):
        translate_template(template, "(a)")


@pytest.mark.parametrize(
    "pattern, group",
    [(r"a|(b)", 1), (r"(?:x(a))", 1), (r"(a)+", 1), (r"(a)?b", 1), (r"(a)\1(b)", 2), (r"((a)b)", 2)],
)
def test_groups_that_cannot_be_split_off(pattern, group):
    with pytest.raises(UntranslatablePattern):
        split_at_group(pattern, group)


@pytest.mark.parametrize(
    "pattern, group", [(r"(?i)x(\d+)y", 1), (r"(a)(b(c))(d)", 2), (r"\bage=(\d+)\b", 1), (r"(x)", 1), (r"(?<=q)(a)[)(](b)", 2)]
)
def test_split_groups_agree_with_python(spark, pattern, group):
    texts = ["X12y x3Y", "abcd abcd", "age=4 age=77", "xx", "qa)b qa(b", ""]
    cut = split_at_group(pattern, group)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", F.regexp_extract_all("t", F.lit(cut.java), F.lit(cut.inside)).alias("m")).collect():
        assert row["m"] == [m.group(group) for m in re.finditer(pattern, row["t"])]


@pytest.mark.parametrize(
    "pattern, group",
    [
        (r"(?:x(a))", 1), (r"(a)+", 1), (r"(a)?b", 1), (r"((a)b)", 2), (r"(x)?(?:(q)(?:a(b)?)c)d", 3), (r"(?i)k(=\d)+;", 1), (r"a(b)??(c)?d", 1),
        (r"a(b)??(c)?d", 2), (r"((\d)(,))+x|", 2), (r"(?P<n>a(?:b(c|cc)?))", 2), (r"(ab|cd)+c", 1), (r"x(\d)+\d", 1), (r"(?:(a)|b)", 1), (r"(?:(a)b)+", 1),
        (r"(?=(a))a", 1), (r"(a|bb)+", 1), (r"(a*)?b", 1), (r"(a){2}", 1),
    ],
)
def test_groups_split_off_agree_with_python(spark, pattern, group):
    """Where a group can be split off, its parts are those of Python's matches; else the pattern is left to Python."""
    texts = ["xa", "aaa", "ab b", "xqabcd qacd", "k=1=2; K=3;", "abd ad acd abcd", "1,2,x", "abcc ab a", "abcdc cdabc", "x123 x45", "ba ab", "bba", ""]
    try:
        cut = split_off(pattern, group)
    except UntranslatablePattern:
        assert pattern in (r"((\d)(,))+x|", r"(?:(a)|b)", r"(?:(a)b)+", r"(?=(a))a", r"(a|bb)+", r"(a*)?b", r"(a){2}")
        return
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = [F.regexp_extract_all("t", F.lit(cut.java), F.lit(i)) for i in (0, cut.before, cut.inside, cut.after) if i is not None]
    held = [i is not None for i in (cut.before, cut.after)]
    for row in df.select("t", *[p.alias(f"p{i}") for i, p in enumerate(parts)]).collect():
        found = list(re.finditer(pattern, row["t"]))
        want = [[m.group() for m in found]]
        span = lambda m: m.span(group) if m.group(group) is not None else (None, None)
        if held[0] and all(m.group(group) is not None for m in found):
            want.append([m.string[m.start() : span(m)[0]] for m in found])
        elif held[0]:
            want.append(row["p1"])
        want.append([m.group(group) or "" for m in found])
        if held[1] and all(m.group(group) is not None for m in found):
            want.append([m.string[span(m)[1] : m.end()] for m in found])
        elif held[1]:
            want.append(row[f"p{len(parts) - 1}"])
        assert [row[f"p{i}"] for i in range(len(parts))] == want
