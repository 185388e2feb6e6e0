"""Queries over rule application."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators import apply
from maskloom.plans import tables as t
from maskloom.plans.tables import Query, with_tables
from maskloom.rules import (
    Bucket,
    Bucketize,
    DateShift,
    Mask,
    Redact,
    Replace,
    Rule,
    SecureHash,
    builtin_rules,
    merge_rules,
    simple_rules_from_spec,
)

SALT = "pepper"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def rewritten_sql(line: str, pattern: str, value: Callable[[str], str]) -> str:
    """SQL for a computed replacement of every match."""
    gaps, hits = f"string_split_regex({line}, '{pattern}')", f"regexp_extract_all({line}, '{pattern}')"
    return (
        f"array_to_string(list_transform(list_zip({gaps}, {hits}), "
        f"lambda z: z[1] || CASE WHEN z[2] IS NULL THEN '' ELSE {value('z[2]')} END), '')"
    )


def hash_sql(prefix: str, suffix: str, length: int, salt: str = SALT) -> Callable[[str], str]:
    return lambda m: f"'{prefix}' || substr(sha256('{salt}:' || {m}), 1, {length}) || '{suffix}'"


def guarded_sql(guard: str, changed: str, line: str = "line") -> str:
    return f"CASE WHEN {guard} THEN {changed} ELSE {line} END"


def _applied(lines: Callable[[SparkSession, str], DataFrame], rules: Sequence[Rule], salt: str = SALT):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply.apply_rules(lines(spark, sf_dir), rules, salt).select("path", "line_no", "line_out")

    return run


def _line_query(name: str, lines, source: str, table: str, rules: Sequence[Rule], changed: str) -> Query:
    body = f"SELECT path, line_no, {changed} AS line_out FROM {table}"
    return Query(name, _applied(lines, rules), with_tables(source, body=body))


# --- the flagship: several rules over documents ------------------------------

EMAIL_RULE = Rule("Email address (secure hash)", "@", EMAIL, SecureHash(16, "[EMAIL:", "]"))
DOCUMENT_RULES = [
    EMAIL_RULE,
    Rule("IPv4", ".", r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", Replace(r"\1.***.***.\4")),
    Rule("Quoted token", "token", r'token = "([0-9a-f]+)"', Replace('token = "[TOKEN]"'), case_sensitive=False),
    Rule("Card", "", r"\b\d{16}\b", Mask(keep_last=4)),
    Rule("Phone", "+1", r"\+1 \(\d{3}\) \d{3}-\d{4}", Redact()),
]

# The SQL engine's \b knows ASCII letters only, Spark's all letters. No match in these
# tables touches an accented letter, so the results are the same.
DOC_STEPS = rf"""
s1 AS (SELECT bundle, path, line_no, eol, line, {guarded_sql("contains(line, '@')", rewritten_sql("line", EMAIL, hash_sql("[EMAIL:", "]", 16)))} AS l1 FROM doc_lines),
s2 AS (SELECT *, {guarded_sql("contains(l1, '.')", r"regexp_replace(l1, '\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b', '\1.***.***.\4', 'g')", "l1")} AS l2 FROM s1),
s3 AS (SELECT *, {guarded_sql("contains(lower(l2), 'token')", "regexp_replace(l2, 'token = \"([0-9a-f]+)\"', 'token = \"[TOKEN]\"', 'gi')", "l2")} AS l3 FROM s2),
s4 AS (SELECT *, {rewritten_sql("l3", r"\b\d{16}\b", lambda m: f"repeat('*', 12) || right({m}, 4)")} AS l4 FROM s3),
s5 AS (SELECT *, {guarded_sql("contains(l4, '+1')", r"regexp_replace(l4, '\+1 \(\d{3}\) \d{3}-\d{4}', '', 'g')", "l4")} AS line_out FROM s4)"""


def _stats_sql(pattern: str, line: str, guard: str) -> str:
    return f"CASE WHEN {guard} THEN len(regexp_extract_all({line}, '{pattern}')) ELSE 0 END"


_DOC_COUNTS = rf"""
counts AS (
  SELECT *,
    {_stats_sql(EMAIL, "line", "contains(line, '@')")} AS n1,
    {_stats_sql(r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b", "l1", "contains(l1, '.')")} AS n2,
    {_stats_sql('(?i)token = "([0-9a-f]+)"', "l2", "contains(lower(l2), 'token')")} AS n3,
    {_stats_sql(r"\b\d{16}\b", "l3", "true")} AS n4,
    {_stats_sql(r"\+1 \(\d{3}\) \d{3}-\d{4}", "l4", "contains(l4, '+1')")} AS n5
  FROM s5
)"""


def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = apply.rule_stats(t.document_lines(spark, sf_dir), DOCUMENT_RULES, SALT)
    return stats.select(
        "path",
        "line_no",
        F.col("n_replacements").cast("bigint").alias("n_replacements"),
        F.array_join("triggered", "|").alias("triggered"),
        F.coalesce(F.col("by_rule")["Card"], F.lit(0)).cast("bigint").alias("n_card"),
        F.coalesce(F.col("by_rule")["IPv4"], F.lit(0)).cast("bigint").alias("n_ipv4"),
    )


RULE_STATS_SQL = with_tables(
    t.DOCUMENT_LINES,
    DOC_STEPS,
    _DOC_COUNTS,
    body="""SELECT path, line_no, (n1 + n2 + n3 + n4 + n5)::BIGINT AS n_replacements,
      array_to_string(list_filter([
        'Card',
        CASE WHEN contains(line, '@') THEN 'Email address (secure hash)' END,
        CASE WHEN contains(l1, '.') THEN 'IPv4' END,
        CASE WHEN contains(l4, '+1') THEN 'Phone' END,
        CASE WHEN contains(lower(l2), 'token') THEN 'Quoted token' END
      ], lambda x: x IS NOT NULL), '|') AS triggered,
      n4::BIGINT AS n_card, n2::BIGINT AS n_ipv4
    FROM counts""",
)


def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = apply.rule_stats(t.document_lines(spark, sf_dir), DOCUMENT_RULES, SALT)
    return apply.rule_totals(stats).select("path", "rule", "n", F.col("level").cast("bigint").alias("level"))


RULE_TOTALS_SQL = with_tables(
    t.DOCUMENT_LINES,
    DOC_STEPS,
    _DOC_COUNTS,
    body="""SELECT path, rule, coalesce(sum(n), 0)::BIGINT AS n, (grouping(path) * 2 + grouping(rule))::BIGINT AS level
    FROM (
      SELECT path, 'Email address (secure hash)' AS rule, n1 AS n FROM counts WHERE n1 > 0
      UNION ALL SELECT path, 'IPv4', n2 FROM counts WHERE n2 > 0
      UNION ALL SELECT path, 'Quoted token', n3 FROM counts WHERE n3 > 0
      UNION ALL SELECT path, 'Card', n4 FROM counts WHERE n4 > 0
      UNION ALL SELECT path, 'Phone', n5 FROM counts WHERE n5 > 0
    ) GROUP BY ROLLUP (path, rule)""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements per source after rewriting all documents."""
    stats = apply.rule_stats(t.document_lines(spark, sf_dir), DOCUMENT_RULES, SALT)
    return stats.groupBy("bundle").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("n_replacements").alias("n_replacements"),
        F.sum((F.col("line") != F.col("line_out")).cast("bigint")).alias("n_changed"),
    )


FLAGSHIP_SQL = with_tables(
    t.DOCUMENT_LINES,
    DOC_STEPS,
    _DOC_COUNTS,
    body="""SELECT bundle, count(*) AS n_lines, sum(n1 + n2 + n3 + n4 + n5)::BIGINT AS n_replacements,
      sum((line <> line_out)::BIGINT)::BIGINT AS n_changed FROM counts GROUP BY bundle""",
)


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = apply.audit_lines(t.document_lines(spark, sf_dir), DOCUMENT_RULES, SALT, spans=False)
    return changed.select("path", "line_no", "line", "line_out")


def audit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = apply.audit_lines(t.document_lines(spark, sf_dir), DOCUMENT_RULES, SALT)
    spans = changed.select("path", "line_no", F.posexplode("spans").alias("span_no", "span"))
    return spans.select("path", "line_no", F.col("span_no").cast("bigint").alias("span_no"), F.col("span.start").cast("bigint").alias("start"), F.col("span.end").cast("bigint").alias("end"))


def _alike_sql(a: str, b: str) -> str:
    same = f"list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda j: {a}[j] = {b}[j]), false)"
    return f"CASE WHEN coalesce({same}, 0) > 0 THEN {same} - 1 ELSE least(length({a}), length({b})) END"


def _marks_sql(number: int, text: str, pattern: str, guard: str, value: Callable[[str], str]) -> str:
    """Marks after one rule, from those before it: a CTE for each, beside the texts."""
    before = f"m{number - 1}"
    gaps, hits = f"string_split_regex({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    return f"""
k{number} AS (
  SELECT *, CASE WHEN {guard} THEN {gaps} ELSE [{text}] END AS gaps,
    list_transform(CASE WHEN {guard} THEN {hits} ELSE [] END, lambda h: {{'h': h, 'v': {value("h")}}}) AS edits
  FROM m{number - 1}
),
p{number} AS (
  SELECT *, list_transform(edits, lambda e: {{'h': e.h, 'v': e.v, 'a': {_alike_sql("e.h", "e.v")}}}) AS heads,
    list_transform(range(1, len(gaps) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i - 1], lambda g: length(g))), 0)
      + coalesce(list_sum(list_transform(edits[1:i - 1], lambda e: length(e.h))), 0)) AS starts
  FROM k{number}
),
t{number} AS (
  SELECT *, list_transform(heads, lambda e: {{'h': e.h, 'v': e.v, 'a': e.a,
    'z': {_alike_sql("reverse(substr(e.h, e.a + 1))", "reverse(substr(e.v, e.a + 1))")}}}) AS tails
  FROM p{number}
),
m{number} AS (
  SELECT * EXCLUDE ({before}, gaps, edits, heads, starts, tails), array_to_string(list_transform(range(1, len(gaps) + 1), lambda i:
    substr({before}, starts[i]::BIGINT + 1, length(gaps[i]))
    || CASE WHEN i > len(tails) THEN '' ELSE
      substr({before}, (starts[i] + length(gaps[i]))::BIGINT + 1, tails[i].a)
      || repeat('1', (length(tails[i].v) - tails[i].a - tails[i].z)::BIGINT)
      || substr({before}, (starts[i] + length(gaps[i]) + length(tails[i].h) - tails[i].z)::BIGINT + 1, tails[i].z) END), '') AS m{number}
  FROM t{number}
)"""


_OCTET = r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b"
AUDIT_SPANS_SQL = with_tables(
    t.DOCUMENT_LINES,
    DOC_STEPS,
    "m0 AS (SELECT path, line_no, line, l1, l2, l3, l4, line_out, repeat('0', length(line)) AS m0 FROM s5 WHERE line <> line_out)",
    _marks_sql(1, "line", EMAIL, "contains(line, '@')", hash_sql("[EMAIL:", "]", 16)),
    _marks_sql(2, "l1", _OCTET, "contains(l1, '.')", lambda h: rf"regexp_replace({h}, '{_OCTET}', '\1.***.***.\4')"),
    _marks_sql(3, "l2", '(?i)token = "([0-9a-f]+)"', "contains(lower(l2), 'token')", lambda _: "'token = \"[TOKEN]\"'"),
    _marks_sql(4, "l3", r"\b\d{16}\b", "true", lambda h: f"repeat('*', 12) || right({h}, 4)"),
    _marks_sql(5, "l4", r"\+1 \(\d{3}\) \d{3}-\d{4}", "contains(l4, '+1')", lambda _: "''"),
    """runs AS (
      SELECT path, line_no, string_split_regex(m5, '1+') AS gaps, regexp_extract_all(m5, '1+') AS hits FROM m5
    ),
    numbered AS (SELECT *, unnest(range(0, len(hits))) AS span_no FROM runs)""",
    body="""SELECT path, line_no, span_no, start, start + length(hits[span_no + 1]) AS "end" FROM (
      SELECT *, (list_sum(list_transform(gaps[1:span_no + 1], lambda g: length(g)))
        + coalesce(list_sum(list_transform(hits[1:span_no], lambda h: length(h))), 0))::BIGINT AS start FROM numbered
    )""",
)


def rule_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("type", "TYPE=ERROR", r"type=\w+", Replace("type=?"), case_sensitive=False)
    exact = Rule("exact", "PASSWORD=", "x", Redact())
    lines = apply.rule_trigger(t.kv_lines(spark, sf_dir), rule, out="any_case")
    return apply.rule_trigger(lines, exact, out="exact_case").select("path", "line_no", "any_case", "exact_case")


# --- dates -------------------------------------------------------------------

DATE_RULES = [
    Rule("ISO dates", "date=", r"\b\d{4}-\d{2}-\d{2}\b", DateShift(max_shift_days=30)),
    Rule("Day first", "due", r"due (\d{1,2}/\d{1,2}/\d{4})", DateShift(("%d/%m/%Y",), 10, group=1)),
]


def _shift_sql(fmt_parse: str, fmt_write: str, key: str, days: int) -> Callable[[str], str]:
    def value(m: str) -> str:
        number = f"('0x' || substr(sha256('{SALT}:{key}:' || {m}), 1, 8))::BIGINT"
        shift = f"({number} % {2 * days + 1} - {days})::INT"
        return f"coalesce(strftime(try_strptime({m}, '{fmt_parse}')::DATE + {shift}, '{fmt_write}'), {m})"

    return value


DATE_SQL = with_tables(
    t.DATE_LINES,
    "d1 AS (SELECT *, "
    + rewritten_sql("line", r"\b\d{4}-\d{2}-\d{2}\b", _shift_sql("%Y-%m-%d", "%Y-%m-%d", "ISO dates", 30))
    + " AS l1 FROM date_lines)",
    body="SELECT path, line_no, "
    + rewritten_sql(
        "l1", r"due \d{1,2}/\d{1,2}/\d{4}", lambda m: "'due ' || " + _shift_sql("%d/%m/%Y", "%d/%m/%Y", "Day first", 10)(f"{m}[5:]")
    )
    + " AS line_out FROM d1",
)


ACCESS_RULES = [
    Rule("Access", "[", r"[0-9]{2}/\w{3}/[0-9]{4}:[0-9:]{8} [^\] ]+", DateShift(("%d/%b/%Y:%H:%M:%S %z",), 30)),
    Rule("Mail", "Date: ", r"\w{3}, [0-9]{2} \w{3} [0-9]{4}", DateShift(("%a, %d %b %Y",), 12)),
]


def _moved(key: str, days: int) -> Callable[[str, str], str]:
    number = lambda m: f"('0x' || substr(sha256('{SALT}:{key}:' || {m}), 1, 8))::BIGINT"
    return lambda m, day: f"({day} + ({number(m)} % {2 * days + 1} - {days})::INT)"


_OFFSET_SQL = "CASE split_part(m, ' ', 2) WHEN 'Z' THEN '+0000' ELSE replace(split_part(m, ' ', 2), ':', '') END"
ACCESS_SQL = with_tables(
    t.ACCESS_LINES,
    r"""hits AS (
      SELECT *, regexp_extract(line, '[0-9]{2}/\w{3}/[0-9]{4}:[0-9:]{8} [^\] ]+') AS m, regexp_extract(line, '\w{3}, [0-9]{2} \w{3} [0-9]{4}') AS d
      FROM access_lines
    )""",
    f"""days AS (
      SELECT *, strptime(left(m, 11), '%d/%b/%Y')::DATE AS access_day, strptime(d, '%a, %d %b %Y')::DATE AS mail_day FROM hits
    )""",
    body=f"""SELECT path, line_no, replace(
        CASE WHEN m LIKE '%+99:00' THEN line
          ELSE replace(line, m, strftime({_moved("Access", 30)("m", "access_day")}, '%d/%b/%Y') || substr(m, 12, 10) || {_OFFSET_SQL}) END,
        d, strftime({_moved("Mail", 12)("d", "mail_day")}, '%a, %d %b %Y')) AS line_out FROM days""",
)


# --- merged and built-in rules -----------------------------------------------

_USER = r"regexp_replace({0}, '\buser\s*=\s*([A-Za-z0-9._-]+)\b', '{1}', 'gi')"
_USERNAME = r"regexp_replace({0}, '\busername\s*=\s*([A-Za-z0-9._-]+)\b', 'username=[USER]', 'gi')"
_PASSWORD = r"regexp_replace({0}, '\bpassword\s*=\s*([^\s\"'']+)\b', 'password=[REDACTED]', 'gi')"
_KERBEROS = r"regexp_replace({0}, '\b[A-Za-z0-9._-]+/[A-Za-z0-9._-]+@[A-Za-z0-9._-]+\b', '[KRB_PRINCIPAL]', 'g')"


def _builtin_steps(table: str, user_value: str) -> tuple[str, ...]:
    def step(name: str, source: str, guard: str, expr: str) -> str:
        return f"{name} AS (SELECT path, line_no, {guarded_sql(guard, expr)} AS line FROM {source})"

    return (
        step("b1", table, "contains(lower(line), 'user=')", _USER.format("line", user_value)),
        step("b2", "b1", "contains(lower(line), 'username=')", _USERNAME.format("line")),
        step("b3", "b2", "contains(lower(line), 'password=')", _PASSWORD.format("line")),
        step("b4", "b3", "contains(line, '@')", _KERBEROS.format("line")),
    )


def _builtin_on(lines, rules):
    return lambda spark, sf_dir: apply.apply_rules(lines(spark, sf_dir), rules).select("path", "line_no", "line_out")


def _both_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("path", "line_no", "line")
    return t.kv_lines(spark, sf_dir).select(*keep).unionByName(t.account_lines(spark, sf_dir).select(*keep))


_BOTH = "both_lines AS (SELECT path, line_no, line FROM kv_lines UNION ALL SELECT path, line_no, line FROM account_lines)"

OVERRIDE_RULES = merge_rules(
    builtin_rules(),
    [
        Rule("user=...", "user=", r"\buser\s*=\s*([A-Za-z0-9._-]+)\b", Replace("user=<\\1>"), False),
        Rule("pin", "pin=", r"pin=\d+", Redact()),
        Rule("off", "", "u", Redact(), enabled=False),
    ],
)

SIMPLE_RULES = simple_rules_from_spec(
    {
        "version": 1,
        "hash": {"prefix": "anon_", "length": 12},
        "rules": [
            {"name": "user", "pattern": r"u\d+", "action": "token", "token": "<USER>"},
            {"name": "kind", "pattern": r"TYPE=([a-z]+)", "action": "replace", "replacement": r"kind:\1", "flags": "I"},
            {"name": "pin", "pattern": r"pin=\d+", "action": "mask"},
        ],
    },
    SALT,
)
SIMPLE_HASH = simple_rules_from_spec(
    {
        "version": 1,
        "hash": {"prefix": "anon_", "length": 12},
        "rules": [{"name": "age", "pattern": r"age=\d+", "action": "hash"}],
    },
    SALT,
)

_AGE = Bucketize(
    (Bucket(0, 17, "0-17"), Bucket(18, 29, "18-29"), Bucket(30, 49, "30-49"), Bucket(50, 99, "50+")), 1, "other"
)


def write_anonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish rewritten documents, then read the published lines back."""
    from maskloom.sources.files import read_published
    from maskloom.sources.files import write_anonymised as publish
    from maskloom.sources.scratch import new_folder

    lines = t.document_lines(spark, sf_dir).withColumnRenamed("path", "rel_path")
    target = new_folder(spark, "published")
    publish(lines, DOCUMENT_RULES, target, SALT)
    return read_published(spark, target)


def apply_long_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 rules, one a user, on users' lines and on texts; one more fires on what another wrote."""
    rules = [Rule(f"u{i}", f"user=u{i} ", f"user=u{i} ", Replace(f"[U{i}] ")) for i in range(400)]
    rules.append(Rule("seven", "[u7]", r"\[U7\]", Replace("[SEVEN]"), case_sensitive=False))
    kv = t.kv_lines(spark, sf_dir).select("path", "line_no", "line")
    lines = kv.unionByName(t.document_lines(spark, sf_dir).select("path", "line_no", "line"))
    return apply.apply_rules(lines, rules).select("path", "line_no", "line_out")


LONG_RULES_SQL = r"""SELECT path, line_no,
  CASE WHEN regexp_matches(line, '^user=u[1-3]?[0-9]{1,2} ')
    THEN replace(regexp_replace(line, '^user=u([0-9]+) ', '[U\1] '), '[U7]', '[SEVEN]') ELSE line END AS line_out
FROM (SELECT path, line_no, line FROM kv_lines UNION ALL SELECT path, line_no, line FROM doc_lines)"""


def published_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest of a published output tells of each bundle; the second run replaces the first."""
    from maskloom.sources.files import write_anonymised as publish
    from maskloom.sources.publish import damages, manifest
    from maskloom.sources.scratch import new_folder

    lines = t.document_lines(spark, sf_dir).withColumnRenamed("path", "rel_path")
    target = new_folder(spark, "published")
    publish(lines.where("line_no = 1"), DOCUMENT_RULES, target, "")
    publish(lines, DOCUMENT_RULES, target, SALT, replace=True)
    told = manifest(spark, target).groupBy("bundle").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("rows", "text_bytes", "checksum")])
    return told.unionByName(damages(spark, target).select(F.col("path").alias("bundle"), *[F.lit(-1).cast("bigint").alias(c) for c in ("rows", "text_bytes", "checksum")]))


PUBLISHED_SQL = """SELECT bundle, count(*) AS rows, sum(strlen(path) + strlen(line_out) + strlen(eol))::BIGINT AS text_bytes,
  sum(('0x' || substr(md5(concat_ws(chr(31), path, line_no::VARCHAR, line_out, eol)), 1, 8))::BIGINT)::BIGINT AS checksum
FROM s5 GROUP BY bundle"""

_LINES_BACK = "SELECT bundle, path AS rel_path, line_no, line_out AS line, eol FROM s5"


_LAST = r"regexp_extract(line, 'from [0-9]+(\.[0-9])+')"
_GROUPS_SQL = (
    r"regexp_replace(replace(replace(line, 'user = w', 'user___w'), "
    rf"{_LAST}, {_LAST}[1:length({_LAST}) - 2] || '##'), 'pin=([0-9])[0-9]{{3}}', 'pin=\1***')"
)

QUERIES = [
    Query("rule_application_summary", flagship, FLAGSHIP_SQL),
    Query(
        "apply_rules",
        _applied(t.document_lines, DOCUMENT_RULES),
        with_tables(t.DOCUMENT_LINES, DOC_STEPS, body="SELECT path, line_no, line_out FROM s5"),
    ),
    Query(
        "rule_trigger",
        rule_trigger,
        with_tables(
            t.KV_LINES,
            body="""SELECT path, line_no, contains(lower(line), 'type=error') AS any_case,
              contains(line, 'PASSWORD=') AS exact_case FROM kv_lines""",
        ),
    ),
    _line_query(
        "act_replacement",
        t.kv_lines,
        t.KV_LINES,
        "kv_lines",
        [Rule("ip", "from", r"\b(\d+)\.(\d+)\.(\d+)\.(\d+)\b", Replace(r"\4-\g<1>0 $1 \\ \g<2>"))],
        guarded_sql("contains(line, 'from')", r"regexp_replace(line, '\b(\d+)\.(\d+)\.(\d+)\.(\d+)\b', '\4-\10 $1 \\ \2', 'g')"),
    ),
    _line_query(
        "act_redaction",
        t.kv_lines,
        t.KV_LINES,
        "kv_lines",
        [Rule("secret", "password=", r" password=\S+", Redact(), case_sensitive=False)],
        guarded_sql("contains(lower(line), 'password=')", r"regexp_replace(line, ' password=\S+', '', 'gi')"),
    ),
    _line_query(
        "act_mask",
        t.account_lines,
        t.ACCOUNT_LINES,
        "account_lines",
        [Rule("acct", "acct=", r"(?<=\bacct=)\d{12,16}\b", Mask("#", 2, 4))],
        guarded_sql(
            "contains(line, 'acct=')",
            rewritten_sql(
                "line",
                r"\bacct=\d{12,16}\b",
                lambda m: f"{m}[1:7] || repeat('#', length({m}) - 11) || right({m}, 4)",
            ),
        ),
    ),
    _line_query(
        "act_group_optional",
        t.kv_lines,
        t.KV_LINES,
        "kv_lines",
        [
            Rule("gap", "user", r"user( = )?[=uw]", Mask("_", group=1)),
            Rule("pin", "pin", r"(?:pin=(?:(\d+)))", Mask(keep_first=1, group=1)),
            Rule("net", "from", r"from (?:\d+)(\.\d)+", Mask("#", group=1)),
        ],
        _GROUPS_SQL,
    ),
    _line_query(
        "act_mask_group",
        t.account_lines,
        t.ACCOUNT_LINES,
        "account_lines",
        [Rule("mail", "mail=", r"\bmail=([a-z0-9.-]+)@([a-z.]+)", Mask(keep_first=1, group=1))],
        guarded_sql(
            "contains(line, 'mail=')",
            rewritten_sql(
                "line",
                r"\bmail=[a-z0-9.-]+@[a-z.]+",
                lambda m: f"{m}[1:6] || repeat('*', length(split_part({m}, '@', 1)) - 6) || '@' || split_part({m}, '@', 2)",
            ),
        ),
    ),
    _line_query(
        "act_secure_hash",
        t.secret_lines,
        t.SECRET_LINES,
        "secret_lines",
        [EMAIL_RULE, Rule("token", "token=", r"token=[0-9a-f]{12}", SecureHash(salt=""))],
        guarded_sql(
            "contains(line, 'token=')",
            rewritten_sql(
                guarded_sql("contains(line, '@')", rewritten_sql("line", EMAIL, hash_sql("[EMAIL:", "]", 16))),
                "token=[0-9a-f]{12}",
                hash_sql("[HASH:", "]", 32, ""),
            ),
        ),
    ),
    Query("act_date_offsets", _applied(t.access_lines, ACCESS_RULES), ACCESS_SQL),
    Query("act_date_shift", _applied(t.date_lines, DATE_RULES), DATE_SQL),
    _line_query(
        "act_bucket",
        t.kv_lines,
        t.KV_LINES,
        "kv_lines",
        [Rule("age", "age=", r"\bage=(\d+)\b", _AGE)],
        guarded_sql(
            "contains(line, 'age=')",
            rewritten_sql(
                "line",
                r"\bage=\d+\b",
                lambda m: f"""'age=' || CASE WHEN {m}[5:]::DOUBLE BETWEEN 0 AND 17 THEN '0-17'
                  WHEN {m}[5:]::DOUBLE BETWEEN 18 AND 29 THEN '18-29' WHEN {m}[5:]::DOUBLE BETWEEN 30 AND 49 THEN '30-49'
                  WHEN {m}[5:]::DOUBLE BETWEEN 50 AND 99 THEN '50+' ELSE 'other' END""",
            ),
        ),
    ),
    Query(
        "apply_rules_override",
        _builtin_on(_both_sources, OVERRIDE_RULES),
        with_tables(
            t.KV_LINES,
            t.ACCOUNT_LINES,
            _BOTH,
            *_builtin_steps("both_lines", r"user=<\1>"),
            body=f"""SELECT path, line_no, {guarded_sql("contains(line, 'pin=')", r"regexp_replace(line, 'pin=\d+', '', 'g')")} AS line_out FROM b4""",
        ),
    ),
    Query(
        "apply_builtin_rules",
        _builtin_on(_both_sources, builtin_rules()),
        with_tables(
            t.KV_LINES,
            t.ACCOUNT_LINES,
            _BOTH,
            *_builtin_steps("both_lines", "user=[USER]"),
            body="SELECT path, line_no, line AS line_out FROM b4",
        ),
    ),
    _line_query(
        "act_token_v1",
        t.kv_lines,
        t.KV_LINES,
        "kv_lines",
        SIMPLE_RULES,
        rewritten_sql(
            r"regexp_replace(regexp_replace(line, 'u\d+', '<USER>', 'g'), 'TYPE=([a-z]+)', 'kind:\1', 'gi')",
            r"pin=\d+",
            lambda m: f"repeat('*', length({m}))",
        ),
    ),
    _line_query(
        "act_hash_v1",
        t.kv_lines,
        t.KV_LINES,
        "kv_lines",
        SIMPLE_HASH,
        rewritten_sql("line", r"age=\d+", hash_sql("anon_", "", 12)),
    ),
    Query("rule_stats", rule_stats, RULE_STATS_SQL),
    Query("rule_totals", rule_totals, RULE_TOTALS_SQL),
    Query(
        "audit_lines",
        audit_lines,
        with_tables(
            t.DOCUMENT_LINES, DOC_STEPS, body="SELECT path, line_no, line, line_out FROM s5 WHERE line <> line_out"
        ),
    ),
    Query("audit_spans", audit_spans, AUDIT_SPANS_SQL),
    Query("write_anonymised", write_anonymised, with_tables(t.DOCUMENT_LINES, DOC_STEPS, body=_LINES_BACK)),
    Query("apply_long_rules", apply_long_rules, with_tables(t.KV_LINES, t.DOCUMENT_LINES, body=LONG_RULES_SQL)),
    Query("published_manifest", published_manifest, with_tables(t.DOCUMENT_LINES, DOC_STEPS, body=PUBLISHED_SQL)),
]
