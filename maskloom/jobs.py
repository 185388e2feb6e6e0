"""Whole runs: bundles in, rewritten bundles and reports out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.globs import DEFAULT_EXCLUDES, is_excluded
from maskloom.functions.text import SNIFF_BYTES, is_text
from maskloom.operators.bundles import bundle_base_name, bundle_summary
from maskloom.operators.detect import DEFAULT_NAMES, detections
from maskloom.operators.files import ANONYMISE, EXCLUDED, FAILED, PASSTHROUGH
from maskloom.operators.pathmap import path_components, path_map
from maskloom.operators.profile import profile_report
from maskloom.rules import Rule, active_rules, builtin_rules, merge_rules
from maskloom.sources.archives import expand_archive_pieces
from maskloom.sources.files import seal, write_parts
from maskloom.sources.lines import UNREAD, dispositions, excluded_below, lines_of_pieces, read_listed
from maskloom.sources.publish import attempt, move
from maskloom.sources.scratch import measured, settled, temporary_tables
from maskloom.sources.trees import catalogue, is_local, local_path
from maskloom.sources.trees import pieces as file_pieces

ARCHIVES = (".zip", ".tar.gz", ".tgz")


@dataclass(frozen=True)
class Options:
    builtin: bool = True
    salt: str = ""
    exclude: Sequence[str] = ()
    exclude_any_case: bool = False
    hide_names: bool = False
    profile: bool = False
    detectors: Sequence[str] = DEFAULT_NAMES
    max_examples: int = 5
    generated_at: str = ""


def _archive_members(spark: SparkSession, archives: Sequence[str], options: Options) -> tuple[DataFrame, DataFrame]:
    """Pieces of all archives' members, and their listing with dispositions.

    Unpacked once. What is excluded leaves the unpacking task without its content.
    """
    schema = "bundle string, path string, turn int"
    named = spark.createDataFrame([(path, path, i) for i, path in enumerate(archives)], schema)
    # An archive cannot be split: each is one task, as far as there are tasks.
    spread = named.repartitionByRange(max(1, len(archives)), "turn") if archives else named
    excluded = is_excluded(F.col("rel_path"), [*DEFAULT_EXCLUDES, *options.exclude], options.exclude_any_case)
    pieces = expand_archive_pieces(spread).withColumn("excluded", F.coalesce(excluded, F.lit(False)))
    pieces = settled(pieces.withColumn("content", F.when(~F.col("excluded"), F.col("content"))))
    first = F.max_by("head", F.when(F.col("piece_no") == 0, 1).otherwise(0))
    members = pieces.withColumn("head", F.substring("content", 1, SNIFF_BYTES)).groupBy("bundle", "rel_path")
    listed = members.agg(
        F.sum(F.octet_length("content")).cast("bigint").alias("length"),
        F.max("error").alias("error"),
        F.bool_or("excluded").alias("excluded"),
        first.alias("head"),
    )
    told = F.when(F.col("excluded"), F.lit(EXCLUDED)).when(
        F.col("error").isNull(), F.when(is_text(F.col("head")), F.lit(ANONYMISE)).otherwise(F.lit(PASSTHROUGH))
    )
    return pieces, settled(listed.select("bundle", "rel_path", "length", "error", told.alias("disposition")))


def anonymise(
    spark: SparkSession, sources: Iterable[str], target: str, rules: Sequence[Rule] = (), options: Options = Options()
) -> DataFrame:
    """Rewrite bundles below ``target`` and return the summary per bundle and in total.

    ``lines`` and ``files`` hold the rewritten and the untouched files of sound bundles,
    ``report`` the profile where asked for, and ``manifest`` what was written; all appear
    at once, when the run ends well. A file that cannot be read, when it is listed or
    later on, is left out and counted, and so is a source that cannot be listed or
    unpacked; the others go on. Nothing settled on the way is left behind.
    """
    merged = merge_rules(builtin_rules(), rules) if options.builtin else list(rules)
    active_rules(merged)
    with temporary_tables(spark):
        summary = _anonymise(spark, list(dict.fromkeys(sources)), target, merged, options)
        # One row a source.
        return spark.createDataFrame(summary.collect(), summary.schema)


def _anonymise(spark: SparkSession, sources: Sequence[str], target: str, rules: Sequence[Rule], options: Options) -> DataFrame:
    archives = [source for source in sources if source.lower().endswith(ARCHIVES)]
    folders = [source for source in sources if source not in archives]
    key = ["bundle", "rel_path"]
    listed = dispositions(catalogue(spark, [(f, f) for f in folders]), options.exclude, options.exclude_any_case)
    pieces, members = _archive_members(spark, archives, options)
    columns = [*key, "length", "error", "disposition"]
    marked = listed.select(*columns).unionByName(members.select(*columns))
    broken = settled(marked.where("error IS NOT NULL AND disposition IS NULL").select("bundle").distinct())
    failed = {row["bundle"] for row in broken.collect()}
    kept = marked.where(F.col("disposition") != EXCLUDED).join(F.broadcast(broken), "bundle", "left_anti")
    names = kept.select(*key, F.col("bundle").alias("out_bundle"), F.col("rel_path").alias("out_path"))
    order = spark.createDataFrame([(source, i) for i, source in enumerate(sources)], "bundle string, turn int")
    hidden = order.select("bundle", F.col("bundle").alias("hidden"))
    if options.hide_names:
        hidden = order = bundle_base_name(order, "bundle", "turn", hide_names=True, out="hidden").select("bundle", "hidden")
        parts = path_components(kept.select(*key), rules, options.salt, scope=("bundle",))
        renamed = path_map(parts, ("bundle",)).join(F.broadcast(order), "bundle")
        names = renamed.select(*key, F.col("hidden").alias("out_bundle"), F.col("anon_path").alias("out_path"))
    names = settled(names)

    def published(rows: DataFrame, *columns: str) -> DataFrame:
        """Under the names of the output. Rows stay where they are where the names are few."""
        out = rows.join(measured(names), key).select(F.col("out_bundle").alias("bundle"), F.col("out_path").alias("rel_path"), *columns)
        return out

    wanted = F.broadcast(spark.createDataFrame([(name,) for name in sources if name not in failed], "bundle string"))
    of_kind = lambda files, kind: files.where(F.col("disposition") == kind).join(wanted, "bundle", "left_semi")
    texts = settled(of_kind(listed, ANONYMISE))
    roots = [root for root in folders if root not in failed]
    excluded = excluded_below([local_path(r) if is_local(r) else r for r in roots], [*DEFAULT_EXCLUDES, *options.exclude], options.exclude_any_case)
    single = texts.where(F.col("location").isin(roots)).isEmpty()
    read = read_listed(spark, texts, roots, excluded if single else None)
    text_pieces = pieces.join(measured(settled(of_kind(members, ANONYMISE).select(*key))), key, "left_semi")
    lines = published(read.lines.unionByName(lines_of_pieces(text_pieces.select(*key, "piece_no", "content"))), "line_no", "line", "eol")
    binary = pieces.join(measured(settled(of_kind(members, PASSTHROUGH).select(*key))), key, "left_semi").select(*key, "piece_no", "content")
    binary = published(file_pieces(of_kind(listed, PASSTHROUGH)).unionByName(binary), "piece_no", "content")
    with attempt(spark, target) as folder:
        if options.profile:
            path = F.concat_ws("/", "bundle", "rel_path").alias("path")
            text_names = published(of_kind(listed, ANONYMISE).select(*key).unionByName(of_kind(members, ANONYMISE).select(*key)))
            found = detections(lines.withColumn("path", path), options.detectors)
            report = profile_report(found, text_names.select(path), options.detectors, options.max_examples, options.generated_at)
            report.write.mode("errorifexists").json(f"{folder}/report")
        write_parts(lines, rules, folder, options.salt, binary)
        cut = _without_cut_files(spark, folder).join(names, [F.col("cut_bundle") == names["out_bundle"], F.col("cut_path") == names["out_path"]])
        failed = settled(read.failed.select(*key, "error").unionByName(cut.select(*key, F.lit(UNREAD).alias("error"))))
        told = seal(spark, folder, ["lines", "files"])
        _all_lines_written(told, read.counts.join(F.broadcast(hidden), "bundle").select(F.col("hidden").alias("bundle"), "n_lines"))
        late = F.col("late").isNotNull()
        marked = marked.join(measured(failed.select(*key, F.col("error").alias("late"))), key, "left").withColumns(
            {"error": F.coalesce("late", "error"), "disposition": F.when(late, F.lit(FAILED)).otherwise(F.col("disposition"))}
        )
        summary = marked.join(F.broadcast(hidden), "bundle").withColumn("bundle", F.col("hidden"))
        return settled(bundle_summary(summary.drop("hidden", "late")))


def _without_cut_files(spark: SparkSession, folder: str) -> DataFrame:
    """(cut_bundle, cut_path) of files with a piece that could not be read; what was written of them goes."""
    written = spark.read.parquet(f"{folder}/files")
    cut = settled(written.where("content IS NULL").select(F.col("bundle").alias("cut_bundle"), F.col("rel_path").alias("cut_path")).distinct())
    if not cut.isEmpty():
        at = [F.col("bundle") == F.col("cut_bundle"), F.col("rel_path") == F.col("cut_path")]
        written.join(measured(cut), at, "left_anti").write.parquet(f"{folder}/sound")
        move(spark, f"{folder}/sound", f"{folder}/files")
    return cut


def _all_lines_written(manifest: DataFrame, counts: DataFrame) -> None:
    """The bundles' lines were counted when they were checked: a file that went bad between that and writing stops the run."""
    written = manifest.where("part = 'lines'").groupBy("bundle").agg(F.sum("rows").alias("written"))
    wanted = counts.groupBy("bundle").agg(F.sum("n_lines").alias("wanted"))
    short = wanted.join(written, "bundle", "left").where(F.coalesce("written", F.lit(0)) < F.col("wanted")).first()
    if short is not None:
        raise OSError(f"a file changed while it was read, in {short['bundle']}: run again")
