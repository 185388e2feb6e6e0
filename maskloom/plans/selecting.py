"""Queries over files, bundles, archives and documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.globs import DEFAULT_EXCLUDES
from maskloom.functions.text import decode_text, is_text
from maskloom.operators import bundles, files
from maskloom.operators.documents import lines_to_documents
from maskloom.operators.excludes import exclude_by_table
from maskloom.plans import tables as t
from maskloom.plans.rewriting import DOCUMENT_RULES
from maskloom.plans.tables import Query, with_tables
from maskloom.sources import files as files_source
from maskloom.sources.archives import expand_archives, whole_bundles
from maskloom.sources.scratch import new_folder, settled
from maskloom.sources.trees import created

PATTERNS = ("*.log", "!*-1*.log", "*/en/*", "!*krb5.conf", "?xample.net/d[a-e]/*", "!*[!0-9].pem")


def glob_verdict_sql(patterns: Sequence[str], path: str = "rel_path", lower: bool = False) -> str:
    """The last matching pattern decides; SQL's own GLOB does the matching."""
    fold = (lambda x: f"lower({x})") if lower else (lambda x: x)
    base = f"regexp_extract({path}, '[^/]*$')"
    verdicts = []
    for pattern in reversed(patterns):
        glob, verdict = (pattern[1:], "false") if pattern.startswith("!") else (pattern, "true")
        glob = glob.lower() if lower else glob
        tests = " OR ".join(f"{fold(v)} GLOB '{glob}'" for v in (f"('/' || {path})", path, base))
        verdicts.append(f"CASE WHEN {tests} THEN {verdict} END")
    return f"coalesce({', '.join(verdicts)}, false)"


def _excluded(patterns: Sequence[str], defaults: bool, case_insensitive: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = t.page_paths(spark, sf_dir)
        marked = files.exclude_files(paths, patterns, case_insensitive, defaults=defaults)
        return marked.select("bundle", "rel_path", "excluded")

    verdict = glob_verdict_sql([*(DEFAULT_EXCLUDES if defaults else ()), *patterns], lower=case_insensitive)
    return run, with_tables(t.PAGE_PATHS, body=f"SELECT bundle, rel_path, {verdict} AS excluded FROM page_paths")


# 10,000 patterns by a rule that Spark and SQL both read: ends, beginnings, what lies between, whole paths, sets, negations.
_LONG_LIST = """CASE i % 6
  WHEN 0 THEN concat('*', i % 1000, '.log')
  WHEN 1 THEN concat('!*/en/', i % 500, '*')
  WHEN 2 THEN concat('th*-', i % 300, '.*')
  WHEN 3 THEN concat('!*[0-4]', i % 100, '.p?m')
  WHEN 4 THEN concat('*e/d[a-e]/*', i % 90, '*')
  ELSE concat('*/fr/', i % 1000, '[?#/]*') END"""


def exclude_files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.range(10_000).selectExpr("id AS idx", f"{_LONG_LIST.replace('i % ', 'id % ')} AS pattern")
    return exclude_by_table(t.page_paths(spark, sf_dir), patterns).select("bundle", "rel_path", "excluded")


EXCLUDE_TABLE_SQL = with_tables(
    t.PAGE_PATHS,
    f"""patterns AS (SELECT i AS idx, {_LONG_LIST} AS pattern FROM (SELECT unnest(range(10000)) AS i)),
    globs AS (SELECT max(idx) AS idx, NOT starts_with(pattern, '!') AS excluded, ltrim(pattern, '!') AS glb FROM patterns GROUP BY ALL),
    verdicts AS (
      SELECT rel_path, max_by(excluded, idx) AS excluded
      FROM (SELECT DISTINCT rel_path, regexp_extract(rel_path, '[^/]*$') AS base FROM page_paths) CROSS JOIN globs
      WHERE (rel_path GLOB glb) OR (base GLOB glb) OR (('/' || rel_path) GLOB glb)
      GROUP BY rel_path
    )""",
    body="SELECT bundle, p.rel_path, coalesce(v.excluded, false) AS excluded FROM page_paths p LEFT JOIN verdicts v USING (rel_path)",
)


# Signatures in hexadecimal, and the control bytes that count against text.
_SIGNATURES = ("255044462D", "89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "504B0304", "1F8B", "50415231", "4F626A01")
_CONTROL = ", ".join(f"'{b:02X}'" for b in range(160) if b == 127 or b >= 128 or (b < 32 and b not in (9, 10, 12, 13)))
TEXT_FILES = f"""
sniffed AS (
  SELECT *, h = '' OR (
    NOT ({" OR ".join(f"starts_with(h, '{s}')" for s in _SIGNATURES)})
    AND NOT list_contains(pairs, '00')
    AND NOT len(list_filter(pairs, lambda b: b IN ({_CONTROL}))) / len(pairs)::DOUBLE > 0.30
  ) AS is_text
  FROM (SELECT *, regexp_extract_all(h, '..') AS pairs FROM (SELECT *, left(hex(content), 16384) AS h FROM document_files))
)"""
_DISPOSITION = (
    f"CASE WHEN {glob_verdict_sql(DEFAULT_EXCLUDES)} THEN 'excluded' WHEN is_text THEN 'anonymise' ELSE 'passthrough' END"
)
CLASSIFIED = f"classified AS (SELECT *, {_DISPOSITION} AS disposition FROM sniffed)"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.classify_files(t.document_files(spark, sf_dir))


def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = files.plan_report(classified(spark, sf_dir), DOCUMENT_RULES)
    return plan.withColumn("n_rules", F.col("n_rules").cast("bigint"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = t.document_files(spark, sf_dir).where(is_text(F.col("content")))
    return texts.select("bundle", "rel_path", decode_text(F.col("content")).alias("text"))


DECODED_SQL = with_tables(
    t.DOCUMENT_FILES,
    TEXT_FILES,
    body="""SELECT bundle, rel_path, coalesce(
      try(decode(content)),
      array_to_string(list_transform(regexp_extract_all(hex(content), '..'), lambda b: chr(('0x' || b)::INT)), '')
    ) AS text FROM sniffed WHERE is_text""",
)


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.document_lines(spark, sf_dir)


def read_lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own, written by the tasks that hold it, and read through the file source."""
    target = new_folder(spark, "source")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                with created(f"{target}/{name}") as file:
                    file.write(text.encode())
            yield batch[["name"]]

    documents = t.table(spark, sf_dir, "documents", "doc_id", "source", "text")
    name = F.concat(F.col("source"), F.lit("/doc-"), t.padded(F.col("doc_id"), 10), F.lit(".log"))
    settled(documents.select(name.alias("name"), "text").mapInPandas(write, "name string"))
    return files_source.read_lines(spark, target).select("rel_path", "line_no", "line", "eol")


READ_SOURCE_SQL = with_tables(
    t.DOCUMENT_LINES,
    "document_files AS (SELECT bundle, path, encode(text) AS content FROM docs)",
    TEXT_FILES,
    body="""SELECT bundle || '/' || path || '.log' AS rel_path, line_no, line, eol
    FROM doc_lines JOIN sniffed USING (bundle, path) WHERE is_text""",
)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose numbers end in 7 stand for files that failed by themselves."""
    unreadable = F.when(F.startswith("content", F.lit(bytearray(b"\x1f\x8b"))), F.lit("unreadable"))
    files = classified(spark, sf_dir).withColumn("error", unreadable)
    failed = F.col("rel_path").rlike("7[^0-9/]*$") & F.col("error").isNull()
    files = files.withColumns({"disposition": F.when(failed, F.lit("failed")).otherwise(F.col("disposition")), "error": F.when(failed, F.lit("unreadable")).otherwise(F.col("error"))})
    report = bundles.bundle_summary(files)
    return report.withColumn("is_total", F.col("is_total").cast("bigint"))


SUMMARY_SQL = with_tables(
    t.DOCUMENT_FILES,
    TEXT_FILES,
    CLASSIFIED,
    r"""judged AS (
      SELECT bundle, disposition, starts_with(hex(content), '1F8B') AS broken,
        regexp_matches(rel_path, '7[^0-9/]*$') AND NOT starts_with(hex(content), '1F8B') AS failed
      FROM classified
    ),
    per_bundle AS (
      SELECT bundle, count(*) AS n_files, count_if(disposition = 'anonymise' AND NOT failed) AS n_anonymised,
        count_if(disposition = 'passthrough' AND NOT failed) AS n_passthrough, count_if(disposition = 'excluded' AND NOT failed) AS n_excluded,
        count_if(failed) AS n_failed_files, count_if(broken) AS n_errors
      FROM judged GROUP BY bundle
    )""",
    body="""SELECT bundle, sum(n_files)::BIGINT AS n_files, sum(n_anonymised)::BIGINT AS n_anonymised,
      sum(n_passthrough)::BIGINT AS n_passthrough, sum(n_excluded)::BIGINT AS n_excluded, sum(n_failed_files)::BIGINT AS n_failed_files, sum(n_errors)::BIGINT AS n_errors,
      count_if(n_errors = 0)::BIGINT AS n_succeeded, count_if(n_errors > 0)::BIGINT AS n_failed, count(*) AS n_bundles,
      grouping(bundle)::BIGINT AS is_total
    FROM per_bundle GROUP BY ROLLUP (bundle)""",
)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, content): every document as an archive of its own, some broken or unsafe."""

    @F.pandas_udf("binary")
    def pack(keys: pd.Series, texts: pd.Series, langs: pd.Series) -> pd.Series:
        import io
        import tarfile
        import zipfile

        def packed(key: int, text: str, lang: str) -> bytes:
            members = [("notes/text.txt", text), ("lang.txt", lang)]
            if key % 11 == 0:
                members.append(("../outside.txt", "x"))
            out = io.BytesIO()
            if key % 2:
                with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as archive:
                    for name, body in members:
                        data = body.encode()
                        info = tarfile.TarInfo(name)
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
            else:
                with zipfile.ZipFile(out, "w") as archive:
                    for name, body in members:
                        archive.writestr(name, body)
            data = out.getvalue()
            return data[: len(data) // 2] if key % 7 == 0 else data

        return pd.Series([packed(k, x, lang) for k, x, lang in zip(keys, texts, langs)])

    docs = t.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    suffix = F.when(F.col("doc_id") % 2 == 1, F.lit(".tar.gz")).otherwise(F.lit(".zip"))
    name = F.concat(F.lit("doc-"), t.padded(F.col("doc_id"), 10), suffix)
    return docs.select(name.alias("bundle"), pack("doc_id", "text", "lang").alias("content"))


def unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of sound archives, and one row for every archive that failed."""
    # Unpacked once: both parts and the list of broken bundles read the table.
    members = settled(expand_archives(packed_documents(spark, sf_dir)))
    nothing = F.lit(None).cast("string")
    sound = whole_bundles(members).select("bundle", "rel_path", decode_text(F.col("content")).alias("text"), F.lit(False).alias("failed"))
    failed = members.where("error IS NOT NULL").select("bundle", nothing.alias("rel_path"), nothing.alias("text"), F.lit(True).alias("failed"))
    return sound.unionByName(failed)


UNPACKED_SQL = """
WITH packed AS (
  SELECT *, 'doc-' || lpad(doc_id::VARCHAR, 10, '0') || CASE WHEN doc_id % 2 = 1 THEN '.tar.gz' ELSE '.zip' END AS bundle,
         doc_id % 7 = 0 OR doc_id % 11 = 0 AS failed
  FROM documents
)
SELECT bundle, 'notes/text.txt' AS rel_path, text, failed FROM packed WHERE NOT failed
UNION ALL SELECT bundle, 'lang.txt', lang, failed FROM packed WHERE NOT failed
UNION ALL SELECT bundle, NULL, NULL, failed FROM packed WHERE failed"""


def documents_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_to_documents(t.document_lines(spark, sf_dir))


def rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_to_documents(t.document_lines(spark, sf_dir), chunk_lines=8)


def _case(name: str, patterns: Sequence[str], defaults: bool, case_insensitive: bool = False) -> Query:
    return Query(name, *_excluded(patterns, defaults, case_insensitive))


QUERIES = [
    Query(
        "read_lines",
        read_lines,
        with_tables(t.DOCUMENT_LINES, body="SELECT bundle, path, line_no, line, eol FROM doc_lines"),
    ),
    Query("expand_archives", unpacked, UNPACKED_SQL),
    Query("exclude_files_table", exclude_files_table, EXCLUDE_TABLE_SQL),
    _case("exclude_files", (), True),
    _case("exclude_files_negation", PATTERNS, True),
    _case("exclude_files_any_case", ("*STACKTRACE*", "*.Log", "!*-2*.loG"), False, True),
    Query(
        "is_text",
        lambda spark, sf_dir: t.document_files(spark, sf_dir).select(
            "bundle", "rel_path", is_text(F.col("content")).alias("is_text")
        ),
        with_tables(t.DOCUMENT_FILES, TEXT_FILES, body="SELECT bundle, rel_path, is_text FROM sniffed"),
    ),
    Query("decode_text", decoded, DECODED_SQL),
    Query(
        "classify_files",
        lambda spark, sf_dir: classified(spark, sf_dir).select("bundle", "rel_path", "length", "disposition"),
        with_tables(
            t.DOCUMENT_FILES, TEXT_FILES, CLASSIFIED, body="SELECT bundle, rel_path, length, disposition FROM classified"
        ),
    ),
    Query(
        "plan_report",
        plan_report,
        with_tables(
            t.DOCUMENT_FILES,
            TEXT_FILES,
            CLASSIFIED,
            body=f"""SELECT bundle, disposition, count(*) AS n_files, sum(length)::BIGINT AS n_bytes, {len(DOCUMENT_RULES)}::BIGINT AS n_rules
            FROM classified GROUP BY bundle, disposition""",
        ),
    ),
    Query(
        "plan_preview",
        lambda spark, sf_dir: files.plan_preview(classified(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint")),
        with_tables(
            t.DOCUMENT_FILES,
            TEXT_FILES,
            CLASSIFIED,
            body="""SELECT bundle, row_number() OVER (PARTITION BY bundle ORDER BY rel_path) AS rank, rel_path
            FROM classified WHERE disposition <> 'excluded' QUALIFY rank <= 20""",
        ),
    ),
    Query(
        "documents_whole",
        documents_whole,
        with_tables(
            t.DOCUMENTS,
            body="SELECT path, 0::BIGINT AS chunk_no, 0::BIGINT AS \"offset\", text FROM docs WHERE text <> ''",
        ),
    ),
    Query(
        "lines_to_documents",
        rejoined,
        with_tables(
            t.DOCUMENT_LINES,
            body="""SELECT path, (line_no - 1) // 8 AS chunk_no, string_agg(line || eol, '' ORDER BY line_no) AS text
            FROM doc_lines GROUP BY path, chunk_no""",
        ),
    ),
    Query("bundle_summary", summary, SUMMARY_SQL),
    Query("read_lines_source", read_lines_source, READ_SOURCE_SQL),
]
