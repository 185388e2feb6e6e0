"""Queries over detectors, masked examples and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import masking
from maskloom.operators import profile
from maskloom.operators.detect import DEFAULT_NAMES, detections, findings, select_detectors
from maskloom.plans import tables as t
from maskloom.plans.rewriting import SALT, guarded_sql, rewritten_sql
from maskloom.plans.tables import Query, with_tables


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose, turns, raw pages, key/value and secret lines together: (path, line_no, line)."""
    keep = ("path", "line_no", "line")
    events = t.dealt(t.table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"))
    orders = t.dealt(t.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))
    narrow = [t.kv_lines_of(events), t.secret_lines_of(orders)]
    parts = [t.document_lines(spark, sf_dir), t.more_lines(spark, sf_dir), *narrow]
    first, *rest = [part.select(*keep) for part in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


SCAN_LINES = (
    t.DOCUMENT_LINES
    + ","
    + t.MORE_LINES
    + ","
    + t.KV_LINES
    + ","
    + t.SECRET_LINES
    + """,
scan_lines AS (
  SELECT path, line_no, line FROM doc_lines
  UNION ALL SELECT path, line_no, line FROM more_lines
  UNION ALL SELECT path, line_no, line FROM kv_lines
  UNION ALL SELECT path, line_no, line FROM secret_lines
)"""
)


def _token_sql(v: str) -> str:
    return f"CASE WHEN length({v}) <= 8 THEN '***' ELSE left({v}, 3) || '-***' || right({v}, 4) END"


_DIGITS = r"regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN substr(digits, length(digits) + 1 - i, 1)::INT
       WHEN substr(digits, length(digits) + 1 - i, 1)::INT > 4 THEN substr(digits, length(digits) + 1 - i, 1)::INT * 2 - 9
       ELSE substr(digits, length(digits) + 1 - i, 1)::INT * 2 END)) % 10 = 0"""


def _hits_sql(name: str, pattern: str, masked: str, keep: str = "true", source: str = "scan_lines") -> str:
    """One row per match; positions count the matches that are kept."""
    return f"""{name} AS (
      SELECT path, line_no, row_number() OVER (PARTITION BY path, line_no, line ORDER BY hit_no) - 1 AS pos, {masked} AS masked_example
      FROM (SELECT *, {_DIGITS} AS digits FROM (
        SELECT path, line_no, line, unnest(hits) AS hit, unnest(range(len(hits))) AS hit_no
        FROM (SELECT *, regexp_extract_all(line, '{pattern}') AS hits FROM {source})))
      WHERE {keep}
    )"""


_KEY, _VALUE = r"regexp_extract(hit, '^([^=\s]+)', 1)", r"regexp_extract(hit, '^[^=]+=\s*(.*)$', 1)"
_BEARER_TOKEN = r"regexp_extract(hit, '\s+([A-Za-z0-9._-]+)$', 1)"
_DETECTED = {
    "email": _hits_sql(
        "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "left(hit, 1) || '***@' || split_part(hit, '@', 2)"
    ),
    "ipv4": _hits_sql(
        "ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "split_part(hit, '.', 1) || '.***.***.' || split_part(hit, '.', 4)"
    ),
    "bearer_token": _hits_sql(
        "bearer_token", r"(?i)\bBearer\s+([A-Za-z0-9._-]{10,})\b", f"'Bearer ' || {_token_sql(_BEARER_TOKEN)}"
    ),
    "kv_secret": _hits_sql(
        "kv_secret",
        r"(?i)\b(api[_-]?key|token|secret|password)\s*=\s*([^\s\"'']{8,})\b",
        f"{_KEY} || '=' || {_token_sql(_VALUE)}",
    ),
    "probable_token": _hits_sql(
        "probable_token",
        r"\b[A-Za-z0-9+/=_-]{24,}\b",
        _token_sql("hit"),
        "regexp_matches(hit, '[A-Za-z]') AND regexp_matches(hit, '[0-9]')",
    ),
    "card_number": _hits_sql(
        "card_number", r"\b(?:\d[ -]*?){13,19}\b", "'**** **** **** ' || right(digits, 4)", _LUHN
    ),
}
_FAMILY = {"email": "email", "ipv4": "ipv4", "card_number": "card"}
ALL_FOUND = (
    ",".join(_DETECTED.values())
    + ", found AS ("
    + " UNION ALL ".join(
        f"SELECT path, line_no, {number} AS det_no, pos, '{_FAMILY.get(kind, 'token')}' AS detector, "
        f"'{kind}' AS kind, masked_example FROM {kind}"
        for number, kind in enumerate(_DETECTED)
    )
    + ")"
)
FOUND = SCAN_LINES + "," + ALL_FOUND


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(scan_lines(spark, sf_dir))


def _detect(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        detector = [d for d in select_detectors() if d.kind == kind]
        hits = scan_lines(spark, sf_dir).select("path", "line_no", F.explode(findings(F.col("line"), detector)).alias("f"))
        return hits.select("path", "line_no", F.col("f.pos").cast("bigint").alias("pos"), "f.masked_example")

    name = {"bearer_token": "detect_bearer", "card_number": "detect_card"}.get(kind, f"detect_{kind}")
    body = f"SELECT path, line_no, pos, masked_example FROM {kind}"
    return Query(name, run, with_tables(SCAN_LINES, _DETECTED[kind], body=body))


# --- masked examples over raw values, awkward ones made of keys and those in the texts ---

# What the texts hold of each kind.
IN_TEXTS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "token": r"\b[A-Za-z0-9+/=_-]{24,}\b",
    "card": r"\b(?:\d[ -]*?){13,19}\b",
}


def _masked(spark: SparkSession, sf_dir: str, values: DataFrame, kind: str) -> DataFrame:
    """(key, masked) of given (key, value) and of all matches in the documents."""
    hits = F.explode(F.regexp_extract_all("line", F.lit(IN_TEXTS[kind]), F.lit(0))).alias("value")
    texts = t.document_lines(spark, sf_dir).select(F.col("path").alias("key"), hits)
    mask = getattr(masking, f"mask_{kind}")
    return values.unionByName(texts).select("key", mask(F.col("value")).alias("masked"))


def _masked_sql(values: str, kind: str, masked: str) -> str:
    return with_tables(
        t.DOCUMENT_LINES,
        body=f"""{values} UNION ALL SELECT path, {masked} FROM (
          SELECT path, hit, {_DIGITS} AS digits FROM (SELECT path, unnest(regexp_extract_all(line, '{IN_TEXTS[kind]}')) AS hit FROM doc_lines)
        )""",
    )


def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    name, segment = F.col("c_name"), F.lower("c_mktsegment")
    value = F.element_at(
        F.array(
            F.concat(F.lit(" "), name, F.lit("@"), segment, F.lit(".org ")),
            name,
            F.concat(F.lit("@"), segment),
            F.concat(name, F.lit("@ ")),
            F.concat(name, F.lit("@a@"), segment),
        ),
        (F.col("c_custkey") % 5 + 1).cast("int"),
    )
    return _masked(spark, sf_dir, c.select(t.text_of("c_custkey").alias("key"), value.alias("value")), "email")


MASK_EMAIL_SQL = _masked_sql(
    """SELECT c_custkey::VARCHAR AS key, CASE c_custkey % 5
    WHEN 0 THEN 'C***@' || lower(c_mktsegment) || '.org' WHEN 1 THEN '[EMAIL]'
    WHEN 2 THEN '***@' || lower(c_mktsegment) WHEN 3 THEN '[EMAIL]'
    ELSE 'C***@a@' || lower(c_mktsegment) END AS masked FROM customer""",
    "email",
    "left(hit, 1) || '***@' || split_part(hit, '@', 2)",
)


def mask_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.table(spark, sf_dir, "events", "event_id", "user_id")
    event, user = t.text_of("event_id"), t.text_of("user_id")
    value = F.concat(event, F.lit(".1."), user, F.lit("."), user)
    return _masked(spark, sf_dir, e.select(event.alias("key"), value.alias("value")), "ipv4")


MASK_IPV4_SQL = _masked_sql(
    """SELECT event_id::VARCHAR AS key, CASE WHEN length(event_id::VARCHAR) > 3 OR length(user_id::VARCHAR) > 3 THEN '[IP]'
    ELSE event_id || '.***.***.' || user_id END AS masked FROM events""",
    "ipv4",
    "split_part(hit, '.', 1) || '.***.***.' || split_part(hit, '.', 4)",
)


def mask_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders", "o_orderkey")
    key = t.text_of("o_orderkey")
    value = F.substring(F.sha2(key, 256), F.lit(1), (F.col("o_orderkey") % 20).cast("int"))
    return _masked(spark, sf_dir, o.select(key.alias("key"), value.alias("value")), "token")


MASK_TOKEN_SQL = _masked_sql(
    f"""SELECT o_orderkey::VARCHAR AS key, {_token_sql("v")} AS masked
    FROM (SELECT o_orderkey, left(sha256(o_orderkey::VARCHAR), (o_orderkey % 20)::INT) AS v FROM orders)""",
    "token",
    _token_sql("hit"),
)


def mask_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    value = F.concat_ws("-", "o_custkey", (F.col("o_orderkey") % 10000).cast("string"))
    return _masked(spark, sf_dir, o.select(t.text_of("o_orderkey").alias("key"), value.alias("value")), "card")


MASK_CARD_SQL = _masked_sql(
    """SELECT o_orderkey::VARCHAR AS key, CASE WHEN length(v) < 4 THEN '****' ELSE '**** **** **** ' || right(v, 4) END AS masked
    FROM (SELECT o_orderkey, o_custkey::VARCHAR || (o_orderkey % 10000) AS v FROM orders)""",
    "card",
    "'**** **** **** ' || right(digits, 4)",
)


# --- profiles ----------------------------------------------------------------

_EXAMPLES = """
examples AS (
  SELECT kind, masked_example, row_number() OVER (PARTITION BY kind ORDER BY path, line_no, det_no, pos) AS rank
  FROM (
    SELECT *, row_number() OVER (PARTITION BY kind, masked_example ORDER BY path, line_no, det_no, pos) AS seen FROM found
  ) WHERE seen = 1
  QUALIFY rank <= 5
)"""
_SUGGESTED = "suggested(rank, kind, description, rule) AS (VALUES {})".format(
    ", ".join(
        "({}, '{}', '{}', '{}')".format(
            rank, kind, spec["description"].replace("'", "''"), profile.json.dumps(spec).replace("'", "''")
        )
        for rank, (kind, spec) in enumerate(profile.SUGGESTIONS, 1)
    )
)


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.document_paths(spark, sf_dir).unionByName(t.more_files(spark, sf_dir).select("path"))
    for lines in (t.kv_lines(spark, sf_dir), t.secret_lines(spark, sf_dir)):
        files = files.unionByName(lines.select("path"))
    return _counted(profile.profile_report(found(spark, sf_dir), files))


REPORT_SQL = with_tables(
    FOUND,
    _EXAMPLES,
    _SUGGESTED,
    body=f"""
    SELECT 'version' AS section, NULL AS kind, '1' AS key, 0::BIGINT AS rank, NULL::BIGINT AS n
    UNION ALL SELECT 'generated_at', NULL, '', 0, NULL
    {" ".join(f"UNION ALL SELECT 'detectors', NULL, '{n}', {i}, NULL" for i, n in enumerate(DEFAULT_NAMES, 1))}
    UNION ALL SELECT 'files_scanned', NULL, NULL, NULL, count(*)
      FROM (SELECT path FROM docs UNION SELECT path FROM more_files UNION SELECT path FROM kv_lines UNION SELECT path FROM secret_lines)
    UNION ALL SELECT 'matches_by_kind', kind, NULL, NULL, count(*) FROM found GROUP BY kind
    UNION ALL SELECT 'files_by_kind', kind, path, NULL, count(*) FROM found GROUP BY kind, path
    UNION ALL SELECT 'masked_examples_by_kind', kind, masked_example, rank, NULL FROM examples
    UNION ALL SELECT 'suggested_rules', kind, rule, rank, NULL FROM suggested WHERE kind IN (SELECT kind FROM found)""",
)


def profile_then_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan_lines(spark, sf_dir)
    return profile.profile_then_apply(lines, detections(lines), SALT).select("path", "line_no", "line_out")


def _suggested_step(number: int, guard: str, changed: str) -> str:
    source = "scan_lines" if number == 1 else f"p{number - 1}"
    return f"p{number} AS (SELECT path, line_no, {guarded_sql(guard, changed)} AS line FROM {source})"


PROFILE_THEN_APPLY_SQL = with_tables(
    SCAN_LINES,
    _suggested_step(
        1,
        "contains(line, '@')",
        rewritten_sql(
            "line",
            r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
            lambda m: f"left({m}, 1) || repeat('*', length(split_part({m}, '@', 1)) - 1) || '@' || split_part({m}, '@', 2)",
        ),
    ),
    _suggested_step(
        2,
        "contains(line, '.')",
        r"regexp_replace(line, '\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b', '\1.***.***.\4', 'g')",
    ),
    _suggested_step(
        3, "contains(lower(line), 'bearer ')", r"regexp_replace(line, '\bBearer\s+\S+\b', 'Bearer [REDACTED]', 'gi')"
    ),
    _suggested_step(
        4,
        "contains(line, '=')",
        r"regexp_replace(line, '\b(api[_-]?key|token|secret|password)\s*=\s*([^\s\"'']+)\b', '\1=[REDACTED]', 'gi')",
    ),
    _suggested_step(5, "true", r"regexp_replace(line, '\b(?:\d[ -]*?){13,19}\b', '[CARD]', 'g')"),
    _suggested_step(6, "true", r"regexp_replace(line, '\b[A-Za-z0-9+/=_-]{24,}\b', '[REDACTED_TOKEN]', 'g')"),
    body="SELECT path, line_no, line AS line_out FROM p6",
)

QUERIES = [
    *[_detect(kind) for kind in _DETECTED],
    Query("mask_email", mask_email, MASK_EMAIL_SQL),
    Query("mask_ipv4", mask_ipv4, MASK_IPV4_SQL),
    Query("mask_token", mask_token, MASK_TOKEN_SQL),
    Query("mask_card", mask_card, MASK_CARD_SQL),
    Query(
        "detections",
        lambda spark, sf_dir: found(spark, sf_dir)
        .withColumn("det_no", F.col("det_no").cast("bigint"))
        .withColumn("pos", F.col("pos").cast("bigint")),
        with_tables(FOUND, body="SELECT path, line_no, det_no::BIGINT AS det_no, pos, detector, kind, masked_example FROM found"),
    ),
    Query(
        "matches_by_kind",
        lambda spark, sf_dir: profile.matches_by_kind(found(spark, sf_dir)),
        with_tables(FOUND, body="SELECT kind, count(*) AS n FROM found GROUP BY kind"),
    ),
    Query(
        "files_by_kind",
        lambda spark, sf_dir: profile.files_by_kind(found(spark, sf_dir)),
        with_tables(FOUND, body="SELECT kind, path, count(*) AS n FROM found GROUP BY kind, path"),
    ),
    Query(
        "examples_by_kind",
        lambda spark, sf_dir: _counted(profile.examples_by_kind(found(spark, sf_dir))),
        with_tables(FOUND, _EXAMPLES, body="SELECT kind, rank, masked_example FROM examples"),
    ),
    Query("profile_report", report, REPORT_SQL),
    Query(
        "suggest_rules",
        lambda spark, sf_dir: _counted(profile.suggest_rules(profile.matches_by_kind(found(spark, sf_dir)))),
        with_tables(
            FOUND,
            _SUGGESTED,
            body="SELECT rank::BIGINT AS rank, kind, description, rule FROM suggested WHERE kind IN (SELECT kind FROM found)",
        ),
    ),
    Query("profile_then_apply", profile_then_apply, PROFILE_THEN_APPLY_SQL),
]
