"""The operators on streams over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.operators.apply import apply_rules
from maskloom.operators.detect import detections
from maskloom.operators.profile import matches_by_kind
from maskloom.plans import detecting
from maskloom.plans import tables as t
from maskloom.plans.rewriting import DOC_STEPS, DOCUMENT_RULES, SALT
from maskloom.plans.tables import Query, with_tables
from maskloom.sources.files import qualified
from maskloom.streaming.operators import detection_rate, drain, drain_complete, drain_rates


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: a folder of part files as it is, a single file by its name in its folder."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    _, single = qualified(spark, path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.document_lines_of(_stream(spark, sf_dir, "documents"))
    return drain(apply_rules(lines, DOCUMENT_RULES, SALT).select("path", "line_no", "line_out"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ("path", "line_no", "line")
    lines = t.secret_lines_of(_stream(spark, sf_dir, "orders")).select(*keep)
    lines = lines.unionByName(t.document_lines_of(_stream(spark, sf_dir, "documents")).select(*keep))
    return drain_complete(matches_by_kind(detections(lines)))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows only: those the watermark has not passed come out when later events arrive."""
    rates = drain(detection_rate(t.kv_lines_of(_stream(spark, sf_dir, "events"))))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rates.withColumns(times)


def rated_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, the open ones from the state of the finished stream."""
    lines = t.kv_lines_of(_stream(spark, sf_dir, "events"))
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return drain_rates(detection_rate(lines)).rates.withColumns(times)


_SECRETS_AND_TEXTS = """scan_lines AS (
  SELECT path, line_no, line FROM secret_lines UNION ALL SELECT path, line_no, line FROM doc_lines
)"""
_KV_ONLY = "scan_lines AS (SELECT path, line_no, line FROM kv_lines)"

QUERIES = [
    Query(
        "stream_apply_rules",
        rewritten,
        with_tables(t.DOCUMENT_LINES, DOC_STEPS, body="SELECT path, line_no, line_out FROM s5"),
    ),
    Query(
        "stream_matches_by_kind",
        counted,
        with_tables(t.DOCUMENT_LINES, t.SECRET_LINES, _SECRETS_AND_TEXTS, detecting.ALL_FOUND, body="SELECT kind, count(*) AS n FROM found GROUP BY kind"),
    ),
    Query(
        "stream_detection_rate",
        rated,
        with_tables(
            t.KV_LINES,
            _KV_ONLY,
            detecting.ALL_FOUND,
            body="""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
              kind, count(*) AS n
            FROM found JOIN kv_lines USING (path, line_no)
            WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
            GROUP BY ALL""",
        ),
    ),
    Query(
        "stream_detection_rate_whole",
        rated_whole,
        with_tables(
            t.KV_LINES,
            _KV_ONLY,
            detecting.ALL_FOUND,
            body="""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, kind, count(*) AS n,
              date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS closed
            FROM found JOIN kv_lines USING (path, line_no)
            GROUP BY ALL""",
        ),
    ),
]
