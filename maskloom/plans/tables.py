"""Input tables of the registered queries, in Spark and in SQL.

``documents`` gives lines of prose. The kinds of line it lacks (users, secrets,
dates, accounts, paths) are derived row by row from the other tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.documents import documents_to_lines


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# Rows of a narrow table that are worth a task of their own once lines are made of them and searched.
TASK_ROWS = 1 << 15


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows over as many tasks as their number is worth; a file's size tells little of it, and a row group is one task."""
    tasks = -(-rows.count() // TASK_ROWS)
    return rows.repartition(tasks) if tasks > 1 else rows


def text_of(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def padded(column: Column, width: int) -> Column:
    return F.lpad(column.cast("string"), width, "0")


# --- documents as files ------------------------------------------------------

def _document_path() -> Column:
    return F.concat(F.lit("doc-"), padded(F.col("doc_id"), 10)).alias("path")


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id").select(_document_path())


def document_lines_of(documents: DataFrame) -> DataFrame:
    """(bundle, path, line_no, line, eol): ``source`` is the bundle, the document a file in it."""
    files = documents.select(F.col("source").alias("bundle"), _document_path(), "text")
    return documents_to_lines(files, "text", ("bundle", "path"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines_of(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


DOCUMENTS = """
docs AS (
  SELECT source AS bundle, 'doc-' || lpad(doc_id::VARCHAR, 10, '0') AS path, text FROM documents
)"""

DOCUMENT_LINES = (
    DOCUMENTS
    + r""",
doc_parts AS (
  SELECT bundle, path, string_split_regex(text, '\r\n|\n|\r') AS parts,
         regexp_extract_all(text, '\r\n|\n|\r') AS ends
  FROM docs
),
doc_lines AS (
  SELECT * FROM (
    SELECT bundle, path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line,
           unnest(list_append(ends, '')) AS eol
    FROM doc_parts
  ) WHERE line <> '' OR eol <> ''
)"""
)


# --- turns and raw pages as files --------------------------------------------

def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each turn of a conversation."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select(F.concat(F.lit("conv-"), text_of("conv_id"), F.lit("/"), text_of("turn")).alias("path"), "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each page's raw HTML."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    return p.select(F.concat(F.lit("page-"), text_of("page_id"), F.lit(".html")).alias("path"), F.col("html").alias("text"))


def more_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_files(spark, sf_dir).unionByName(page_files(spark, sf_dir))


def more_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_to_lines(more_files(spark, sf_dir), "text", ("path",))


MORE_LINES = r"""
more_files AS (
  SELECT 'conv-' || conv_id || '/' || turn AS path, text FROM conversations
  UNION ALL SELECT 'page-' || page_id || '.html', html FROM pages
),
more_parts AS (
  SELECT path, string_split_regex(text, '\r\n|\n|\r') AS parts, regexp_extract_all(text, '\r\n|\n|\r') AS ends FROM more_files
),
more_lines AS (
  SELECT * FROM (
    SELECT path, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line, unnest(list_append(ends, '')) AS eol FROM more_parts
  ) WHERE line <> '' OR eol <> ''
)"""


# --- derived lines -----------------------------------------------------------

def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_lines_of(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"))


def kv_lines_of(events: DataFrame) -> DataFrame:
    """Users, passwords, ages and pins."""
    user, event = text_of("user_id"), F.col("event_id")
    return events.select(
        F.concat(F.lit("user-"), user).alias("path"),
        F.col("event_id").alias("line_no"),
        "ts",
        F.concat(
            F.lit("user=u"), user, F.lit(" Username="), user, F.lit(".v user = w"), user,
            F.lit(" PASSWORD=p"), text_of(event), F.lit("x age="), text_of(event % 120),
            F.lit(" pin="), padded(event % 10000, 4), F.lit(" type="), F.col("event_type"),
            F.lit(" from 10."), text_of(event % 300), F.lit(".0."), user,
        ).alias("line"),
    )


KV_LINES = """
kv_lines AS (
  SELECT 'user-' || user_id AS path, event_id AS line_no, ts,
         'user=u' || user_id || ' Username=' || user_id || '.v user = w' || user_id || ' PASSWORD=p' || event_id
         || 'x age=' || (event_id % 120) || ' pin=' || lpad((event_id % 10000)::VARCHAR, 4, '0')
         || ' type=' || event_type || ' from 10.' || (event_id % 300) || '.0.' || user_id AS line
  FROM events
)"""


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_lines_of(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))


def secret_lines_of(orders: DataFrame) -> DataFrame:
    """Tokens, bearer headers, keys, cards and addresses."""
    key, customer = F.col("o_orderkey"), text_of("o_custkey")
    digest = F.sha2(text_of(key), 256)
    return orders.select(
        F.concat(F.lit("cust-"), customer).alias("path"),
        F.col("o_orderkey").alias("line_no"),
        F.concat(
            F.lit("token="), F.substring(digest, 1, 12), F.lit(" Authorization: bearer "), F.substring(digest, 13, 20),
            F.lit(" API-Key = "), F.substring(digest, 1, 9), F.lit(" secret=abc card 4"), padded(key * 7919, 15),
            F.lit(" id "), F.substring(digest, 33, 30), F.lit(" by c"), customer, F.lit("@mail"), text_of(key % 7),
            F.lit(".example.com"),
        ).alias("line"),
    )


SECRET_LINES = """
secret_lines AS (
  SELECT 'cust-' || o_custkey AS path, o_orderkey AS line_no,
         'token=' || substr(d, 1, 12) || ' Authorization: bearer ' || substr(d, 13, 20) || ' API-Key = ' || substr(d, 1, 9)
         || ' secret=abc card 4' || lpad((o_orderkey * 7919)::VARCHAR, 15, '0') || ' id ' || substr(d, 33, 30)
         || ' by c' || o_custkey || '@mail' || (o_orderkey % 7) || '.example.com' AS line
  FROM (SELECT o_orderkey, o_custkey, sha256(o_orderkey::VARCHAR) AS d FROM orders)
)"""


def date_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with and without padding, date-times and impossible dates from ``orders``."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    unpadded = F.concat_ws("/", F.day(day), F.month(day), F.year(day))
    return o.select(
        F.concat(F.lit("cust-"), text_of("o_custkey")).alias("path"),
        F.col("o_orderkey").alias("line_no"),
        F.concat(
            F.lit("date="), text_of(day), F.lit(" due "), unpadded, F.lit(" at "), text_of(day), F.lit("T"),
            padded(key % 24, 2), F.lit(":"), padded(key % 60, 2), F.lit(" bad 1999-02-"), padded(key % 40, 2),
            F.lit(" total="), text_of(key % 5000),
        ).alias("line"),
    )


DATE_LINES = """
date_lines AS (
  SELECT 'cust-' || o_custkey AS path, o_orderkey AS line_no,
         'date=' || day || ' due ' || day(day) || '/' || month(day) || '/' || year(day) || ' at ' || day || 'T'
         || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0')
         || ' bad 1999-02-' || lpad((o_orderkey % 40)::VARCHAR, 2, '0') || ' total=' || (o_orderkey % 5000) AS line
  FROM (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders)
)"""


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with offsets and week-days as servers and mails write them."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    offset = F.element_at(F.array(*[F.lit(x) for x in OFFSETS]), (key % len(OFFSETS) + 1).cast("int"))
    return o.select(
        F.concat(F.lit("cust-"), text_of("o_custkey")).alias("path"),
        key.alias("line_no"),
        F.concat(
            F.lit("["), F.date_format(day, "dd/MMM/yyyy"), F.lit(":"), padded(key % 24, 2), F.lit(":"), padded(key % 60, 2), F.lit(":"),
            padded(key % 59, 2), F.lit(" "), offset, F.lit("] Date: "), F.date_format(day, "EEE, dd MMM yyyy"),
            F.lit(" "), padded(key % 24, 2), F.lit(" until "), F.date_format(day, "EEEE d MMMM"),
        ).alias("line"),
    )


# Offsets from UTC in the ways that logs write them; the last is none.
OFFSETS = ("+0000", "-0730", "+05:30", "Z", "+99:00")

ACCESS_LINES = f"""
access_lines AS (
  SELECT 'cust-' || o_custkey AS path, o_orderkey AS line_no,
    '[' || strftime(day, '%d/%b/%Y') || ':' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':'
    || lpad((o_orderkey % 59)::VARCHAR, 2, '0') || ' ' || (['{"', '".join(OFFSETS)}'])[(o_orderkey % {len(OFFSETS)} + 1)::INT] || '] Date: '
    || strftime(day, '%a, %d %b %Y') || ' ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ' until ' || strftime(day, '%A %-d %B') AS line
  FROM (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders)
)"""


def account_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers, principals and addresses from ``customer``."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    key, name = F.col("c_custkey"), F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))
    return c.select(
        F.concat(F.lit("nation-"), text_of("c_nationkey")).alias("path"),
        F.col("c_custkey").alias("line_no"),
        F.concat(
            F.lit("acct="), padded(key, 16), F.lit(" principal "), name, F.lit("/node"), text_of("c_nationkey"),
            F.lit("@"), F.col("c_mktsegment"), F.lit(".NET mail="), name, F.lit("@shop.example.org secret="), text_of(key),
            F.lit(" ref acct="), padded(key * 31, 12),
        ).alias("line"),
    )


ACCOUNT_LINES = """
account_lines AS (
  SELECT 'nation-' || c_nationkey AS path, c_custkey AS line_no,
         'acct=' || lpad(c_custkey::VARCHAR, 16, '0') || ' principal ' || name || '/node' || c_nationkey || '@' || c_mktsegment
         || '.NET mail=' || name || '@shop.example.org secret=' || c_custkey || ' ref acct='
         || lpad((c_custkey * 31)::VARCHAR, 12, '0') AS line
  FROM (SELECT *, lower(replace(c_name, '#', '-')) AS name FROM customer)
)"""


# --- paths -------------------------------------------------------------------

# Endings given to page paths in turn.
ENDINGS = (".tar.gz", ".log", "/server.pem", "/krb5.conf", "/App-stacktrace.LOG", ".keytab", "/my keystore.bin", "/a:b?.txt")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, rel_path, length): whole page URLs but for the scheme as a catalogue of files; the language is the bundle."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    plain = F.regexp_replace("url", r"^https?://", "")
    lang = F.regexp_extract(plain, "^[^/]*/([^/?#]*)", 1)
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    return p.select(
        lang.alias("bundle"),
        F.concat(plain, F.lit("-"), text_of("page_id"), ending).alias("rel_path"),
        F.length("url").cast("bigint").alias("length"),
    )


PAGE_PATHS = rf"""
page_parts AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS plain FROM pages),
page_paths AS (
  SELECT regexp_extract(plain, '^[^/]*/([^/?#]*)', 1) AS bundle,
         plain || '-' || page_id || (['{"', '".join(ENDINGS)}'])[(page_id % {len(ENDINGS)} + 1)::INT] AS rel_path,
         length(url) AS length
  FROM page_parts
)"""


# --- bytes -------------------------------------------------------------------

# Leading bytes put before document texts in turn (none, none, then binary and odd ones).
HEADS = ("", "", "255044462D", "89504E470D0A1A0A", "FFD8FF", "1F8B08", "00", "0102030405060708", "41007F", "474946383961")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, rel_path, length, content): texts as bytes, some with a binary head or a stray byte."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    key = F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (key % len(HEADS) + 1).cast("int"))
    # An odd Latin-1 byte makes every third text invalid as UTF-8.
    tail = F.when(key % 3 == 0, F.lit("E9")).otherwise(F.lit(""))
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (key % len(ENDINGS) + 1).cast("int"))
    content = F.unhex(F.concat(head, F.hex("text"), tail))
    return docs.select(
        F.col("source").alias("bundle"),
        F.concat(F.col("lang"), F.lit("/doc-"), padded(key, 10), ending).alias("rel_path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


DOCUMENT_FILES = f"""
document_files AS (
  SELECT source AS bundle,
         lang || '/doc-' || lpad(doc_id::VARCHAR, 10, '0')
         || (['{"', '".join(ENDINGS)}'])[(doc_id % {len(ENDINGS)} + 1)::INT] AS rel_path,
         octet_length(content) AS length, content
  FROM (
    SELECT *, unhex((['{"', '".join(HEADS)}'])[(doc_id % {len(HEADS)} + 1)::INT] || hex(encode(text))
                    || CASE WHEN doc_id % 3 = 0 THEN 'E9' ELSE '' END) AS content
    FROM documents
  )
)"""


def with_tables(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body
