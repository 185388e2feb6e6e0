"""Queries over names and path catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import paths as p
from maskloom.operators import bundles, pathmap
from maskloom.plans import tables as t
from maskloom.plans.rewriting import SALT
from maskloom.plans.tables import Query, with_tables
from maskloom.rules import Replace, Rule

NAME_RULES = [Rule("number", "", r"\d+", Replace("N")), Rule("host", "example", r"example", Replace("site"))]

# Shapes of awkward names; {} is the page number.
SHAPES = (
    "a{}.tar.gz", ".hidden{}", "..x{}.b", "dot{}.", "a..{}", "CON", "lpt1.{}", " lead{}", "q{}?.log", "", "..", "n{}.l:g",
    "tab{}\t.x", "aux{}.txt",
)


def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, name): an awkward name made of the end of each page's URL, now and then a long one of all of it."""
    pages = t.table(spark, sf_dir, "pages", "page_id", "url")
    end = F.concat(F.substring_index("url", "/", -1), t.text_of("page_id"))
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("page_id") % len(SHAPES) + 1).cast("int"))
    name = F.replace(shape, F.lit("{}"), end)
    long = F.repeat(F.translate("url", "/:?#", "____"), (F.col("page_id") % 12).cast("int"))
    return pages.select("page_id", F.when(F.col("page_id") % 5 == 4, long).otherwise(name).alias("name"))


ODD_NAMES = """
odd_names AS (
  SELECT page_id, CASE WHEN page_id % 5 = 4 THEN repeat(translate(url, '/:?#', '____'), page_id % 12)
    ELSE replace(([{}])[(page_id % {} + 1)::INT], '{{}}', regexp_extract(url, '[^/]*$') || page_id) END AS name
  FROM pages
)""".format(", ".join("'" + s.replace("\t", "' || chr(9) || '") + "'" for s in SHAPES), len(SHAPES))


def _suffixes_sql(name: str) -> str:
    return rf"regexp_extract({name}, '(?s)^\.*[^.]+(\..*[^.])$', 1)"


def _stem_sql(name: str) -> str:
    return f"left({name}, length({name}) - length({_suffixes_sql(name)}))"


_DEVICES = ", ".join(f"'{d}'" for d in p.DEVICE_NAMES)
_INVALID = r'[<>:"/\\|?*\x00-\x1F]'


def _safe_sql(name: str) -> str:
    return (
        f"({name} <> '' AND {name} NOT IN ('.', '..') AND NOT regexp_matches({name}, '^\\s|\\s$') "
        f"AND NOT regexp_matches({name}, '{_INVALID}') AND NOT ends_with({name}, '.') AND length({name}) <= 200 "
        f"AND upper(split_part({name}, '.', 1)) NOT IN ({_DEVICES}))"
    )


def _stand_in_sql(prefix: str, source: str) -> str:
    return f"'{prefix}_' || substr(sha256('{SALT}:' || {source}), 1, 16)"


ENTRIES = """
files AS (SELECT DISTINCT rel_path AS orig FROM page_paths),
steps AS (
  SELECT orig, parts, unnest(range(1, len(parts))) AS depth FROM (SELECT orig, string_split(orig, '/') AS parts FROM files)
),
entries AS (
  SELECT orig, regexp_extract(orig, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(orig, '[^/]*$') AS name, orig AS ord, false AS is_dir
  FROM files
  UNION ALL
  SELECT prefix, regexp_extract(prefix, '^(.*)/[^/]*$', 1), regexp_extract(prefix, '[^/]*$'), min(orig), true
  FROM (SELECT orig, array_to_string(parts[1:depth], '/') AS prefix FROM steps) GROUP BY prefix
)"""
CANDIDATES = rf"""
sources AS (
  SELECT *, CASE WHEN is_dir THEN name ELSE {_stem_sql("name")} END AS source,
    rtrim(regexp_replace(CASE WHEN is_dir THEN '' ELSE {_suffixes_sql("name")} END, '{_INVALID}', '_', 'g'), ' .') AS ext
  FROM entries
),
plain AS (
  SELECT *, trim(regexp_replace(regexp_replace(source, '\d+', 'N', 'g'), 'example', 'site', 'g')) || ext AS made,
    regexp_matches(source, '\d') OR contains(source, 'example') AS hit
  FROM sources
),
candidates AS (
  SELECT *, CASE WHEN {_safe_sql("made")} THEN made WHEN is_dir THEN {_stand_in_sql("d", "name")}
    ELSE {_stand_in_sql("f", "source")} || ext END AS candidate,
    hit OR made <> name OR NOT {_safe_sql("made")} AS changed
  FROM plain
)"""
RESOLVED = f"""
resolved AS (
  SELECT *, CASE WHEN turn = 1 THEN candidate
    ELSE {_stem_sql("candidate")} || '__' || substr(sha1(orig), 1, 8) || {_suffixes_sql("candidate")} END AS anon_name
  FROM (SELECT *, row_number() OVER (PARTITION BY parent, candidate ORDER BY ord) AS turn FROM candidates)
)"""
MAPPED = """
mapped AS (
  SELECT f.orig AS rel_path, string_agg(r.anon_name, '/' ORDER BY f.depth) AS anon_path
  FROM (
    SELECT orig, depth, array_to_string(parts[1:depth], '/') AS prefix
    FROM (SELECT orig, string_split(orig, '/') AS parts, unnest(range(1, len(string_split(orig, '/')) + 1)) AS depth FROM files)
  ) f JOIN resolved r ON r.orig = f.prefix
  GROUP BY f.orig
)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathmap.path_entries(t.page_paths(spark, sf_dir))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathmap.path_components(t.page_paths(spark, sf_dir), NAME_RULES, SALT)


def _on_names(**columns: Column):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return odd_names(spark, sf_dir).select("page_id", "name", *[c.alias(n) for n, c in columns.items()])

    return run


def split_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_names(stem=p.stem_of(F.col("name")), ext=p.suffixes_of(F.col("name")))(spark, sf_dir)


def safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_names(safe=p.is_safe_component(F.col("name")))(spark, sf_dir)


def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _on_names(folder=p.stand_in("d", name, SALT), file=p.stand_in("f", p.stem_of(name), SALT))(spark, sf_dir)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pathmap.anonymise_component(entries(spark, sf_dir), NAME_RULES, SALT)
    return named.select("orig", "is_dir", "candidate", "changed")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).select("orig", "is_dir", "anon_name", (F.col("attempt") > 0).alias("collided"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathmap.path_map(components(spark, sf_dir))


def map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = components(spark, sf_dir)
    return pathmap.path_map_stats(parts, pathmap.path_map(parts))


def named_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "pages", "page_id", "url")
    return bundles.bundle_names(pages, "url", "page_id").select("page_id", "folder")


BUNDLE_NAMES_SQL = r"""SELECT page_id, printf('%03d', row_number() OVER (ORDER BY page_id)) || '-'
      || CASE WHEN cleaned = '' THEN 'input' ELSE cleaned END AS folder
    FROM (SELECT page_id, trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), ' .') AS cleaned FROM pages)"""


def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.page_paths(spark, sf_dir).select("rel_path", F.substring_index("rel_path", "/", -1).alias("name"))
    plain = bundles.bundle_base_name(files, "name")
    hidden = bundles.bundle_base_name(files, "name", "rel_path", hide_names=True).select(
        "rel_path", F.col("base_name").alias("hidden_name")
    )
    return plain.join(hidden, "rel_path").select("rel_path", "base_name", "hidden_name")


BASE_NAMES_SQL = with_tables(
    t.PAGE_PATHS,
    body=r"""SELECT rel_path,
      CASE WHEN regexp_matches(lower(name), '\.(tar\.gz|tgz)$') THEN regexp_replace(name, '(?i)(\.tar\.gz|\.tgz)$', '')
        ELSE regexp_replace(name, '^(.+)\.[^.]+$', '\1') END AS base_name,
      CASE WHEN turn = 1 THEN 'anonymized_output' ELSE 'anonymized_output__' || turn END AS hidden_name
    FROM (SELECT rel_path, regexp_extract(rel_path, '[^/]*$') AS name, row_number() OVER (ORDER BY rel_path) AS turn FROM page_paths)""",
)

QUERIES = [
    Query(
        "split_suffixes",
        split_suffixes,
        with_tables(
            ODD_NAMES, body=f"SELECT page_id, name, {_stem_sql('name')} AS stem, {_suffixes_sql('name')} AS ext FROM odd_names"
        ),
    ),
    Query(
        "is_safe_component",
        safe,
        with_tables(ODD_NAMES, body=f"SELECT page_id, name, {_safe_sql('name')} AS safe FROM odd_names"),
    ),
    Query(
        "hash_fallback",
        stand_ins,
        with_tables(
            ODD_NAMES,
            body=f"""SELECT page_id, name, {_stand_in_sql("d", "name")} AS folder,
            {_stand_in_sql("f", _stem_sql("name"))} AS file FROM odd_names""",
        ),
    ),
    Query(
        "anonymise_component",
        candidates,
        with_tables(t.PAGE_PATHS, ENTRIES, CANDIDATES, body="SELECT orig, is_dir, candidate, changed FROM candidates"),
    ),
    Query(
        "resolve_collisions",
        resolved,
        with_tables(
            t.PAGE_PATHS, ENTRIES, CANDIDATES, RESOLVED, body="SELECT orig, is_dir, anon_name, turn > 1 AS collided FROM resolved"
        ),
    ),
    Query(
        "path_map",
        mapped,
        with_tables(t.PAGE_PATHS, ENTRIES, CANDIDATES, RESOLVED, MAPPED, body="SELECT rel_path, anon_path FROM mapped"),
    ),
    Query(
        "path_map_stats",
        map_stats,
        with_tables(
            t.PAGE_PATHS,
            ENTRIES,
            CANDIDATES,
            RESOLVED,
            MAPPED,
            body="""SELECT count(*) AS paths_total, count_if(rel_path <> anon_path)::BIGINT AS paths_changed,
              (SELECT count_if(changed) FROM resolved)::BIGINT AS components_changed,
              (SELECT count_if(turn > 1) FROM resolved)::BIGINT AS collisions_resolved FROM mapped""",
        ),
    ),
    Query("bundle_names", named_bundles, BUNDLE_NAMES_SQL),
    Query("bundle_base_name", base_names, BASE_NAMES_SQL),
]
