"""Anonymised names for a whole catalogue of paths, free of collisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.masking import strip
from maskloom.functions.paths import is_safe_component, retry_name, sanitised_extension, stand_in, stem_of, suffixes_of
from maskloom.operators.apply import total_matches, with_state
from maskloom.rules import Rule
from maskloom.sources.scratch import measured, settled


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` components."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    untidy = F.rlike(path, F.lit(r"(?:^|/)\.?(?:/|\z)"))
    return F.when(untidy, F.array_join(parts, "/")).otherwise(path)


def _parent(path: Column) -> Column:
    """Everything before the last slash; the empty string at the top."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def _ancestors(folder: Column) -> Column:
    """``a/b/c`` -> [a, a/b, a/b/c]"""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_entries(paths: DataFrame, path: str = "rel_path", scope: Sequence[str] = ()) -> DataFrame:
    """Every file and every folder above it, once: (scope, parent, orig, name, is_dir, order).

    ``order`` is the first file path at or below the entry. Folders come from the
    distinct parents, so only those are multiplied by their depth.
    """
    files = paths.select(*scope, normal_path(F.col(path)).alias("orig")).where(F.col("orig") != "").distinct()
    with_parent = files.withColumn("parent", _parent(F.col("orig")))
    direct = with_parent.where(F.col("parent") != "").groupBy(*scope, "parent").agg(F.min("orig").alias("order"))
    folders = (
        direct.select(*scope, F.explode(_ancestors(F.col("parent"))).alias("orig"), "order")
        .groupBy(*scope, "orig")
        .agg(F.min("order").alias("order"))
        .withColumn("parent", _parent(F.col("orig")))
        .withColumn("is_dir", F.lit(True))
    )
    entries = with_parent.withColumn("order", F.col("orig")).withColumn("is_dir", F.lit(False)).unionByName(folders)
    return entries.withColumn("name", F.substring_index("orig", "/", -1))


def anonymise_component(
    df: DataFrame, rules: Sequence[Rule], salt: str = "", name: str = "name", is_dir: str = "is_dir"
) -> DataFrame:
    """Add ``candidate`` and ``changed``: rules on a folder name or file stem, suffixes kept.

    An unsafe result is replaced by a salted hash of the source.
    """
    folder = F.col(is_dir)
    ext = F.when(folder, F.lit("")).otherwise(suffixes_of(F.col(name)))
    source = F.when(folder, F.col(name)).otherwise(stem_of(F.col(name)))
    active = [rule for rule in rules if rule.enabled]
    prepared = df.withColumn("_source", source).withColumn("_ext", sanitised_extension(ext))
    if active:
        prepared = with_state(prepared, active, salt, F.col("_source"), "_state")
        text = F.regexp_replace(F.col("_state.text"), r"[\r\n]", "")
        hits = total_matches(F.col("_state.hits"))
    else:
        text, hits = F.col("_source"), F.lit(0)
    prepared = prepared.withColumn("_hits", hits).withColumn("_plain", F.concat(strip(text), F.col("_ext")))
    safe = is_safe_component(F.col("_plain"))
    fallback_source = F.when(F.col("_source") == "", F.col(name)).otherwise(F.col("_source"))
    fallback = F.when(folder, stand_in("d", F.col(name), salt)).otherwise(
        F.concat(stand_in("f", fallback_source, salt), F.col("_ext"))
    )
    return (
        prepared.withColumn("candidate", F.when(safe, F.col("_plain")).otherwise(fallback))
        .withColumn("changed", (F.col("_hits") > 0) | (F.col("candidate") != F.col(name)) | ~safe)
        .drop("_source", "_ext", "_state", "_hits", "_plain")
    )


def resolve_collisions(entries: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Add ``anon_name`` and ``attempt``: unique names within every folder.

    Entries of a folder claim names in order of ``order``; a later claimant of a
    taken name goes on to its next name. Each round settles all folders at once:
    the first claimant of every name stays, the others try again. The outcome is
    that of going through the entries one by one. Claims are reduced on the map
    side, and only names claimed twice are joined back.
    """
    keys = [*scope, "parent", "anon_name"]
    current = settled(entries.withColumn("attempt", F.lit(0)).withColumn("anon_name", F.col("candidate")))
    while True:
        claims = current.groupBy(*keys).agg(F.min("order").alias("_owner"), F.count(F.lit(1)).alias("_claims"))
        contested = settled(claims.where(F.col("_claims") > 1).drop("_claims"))
        if contested.isEmpty():
            return current
        judged = current.join(measured(contested), keys, "left")
        attempt = F.col("attempt") + F.when(F.col("order") != F.col("_owner"), 1).otherwise(0)
        moved = judged.withColumn("attempt", attempt).drop("_owner")
        current = settled(
            moved.withColumn("anon_name", retry_name(F.col("candidate"), F.col("orig"), F.col("attempt")))
        )


def path_components(
    paths: DataFrame, rules: Sequence[Rule], salt: str = "", path: str = "rel_path", scope: Sequence[str] = ()
) -> DataFrame:
    """Files and folders with their anonymised, collision-free names."""
    entries = path_entries(paths, path, scope)
    return resolve_collisions(anonymise_component(entries, rules, salt), scope)


def path_map(components: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(rel_path, anon_path): names put together from the folders above each file."""
    folders = components.where("is_dir").select(*scope, "orig", "anon_name")
    steps = folders.select(*scope, F.col("orig").alias("parent"), F.posexplode(_ancestors(F.col("orig"))).alias("depth", "orig"))
    # At most one row per level of depth is collected for each folder.
    renamed = settled(
        steps.join(measured(folders), [*scope, "orig"])
        .groupBy(*scope, "parent")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "anon_name"))).alias("levels"))
        .select(*scope, "parent", F.array_join(F.col("levels.anon_name"), "/").alias("anon_parent"))
    )
    files = components.where(~F.col("is_dir"))
    return files.join(measured(renamed), [*scope, "parent"], "left").select(
        *scope, F.col("orig").alias("rel_path"), F.concat_ws("/", "anon_parent", "anon_name").alias("anon_path")
    )


def path_map_stats(components: DataFrame, mapping: DataFrame) -> DataFrame:
    """paths_total, paths_changed, components_changed, collisions_resolved."""
    nothing = F.lit(0)
    paths = mapping.select(
        F.lit(1).alias("paths_total"),
        (F.col("rel_path") != F.col("anon_path")).cast("int").alias("paths_changed"),
        nothing.alias("components_changed"),
        nothing.alias("collisions_resolved"),
    )
    parts = components.select(
        nothing.alias("paths_total"),
        nothing.alias("paths_changed"),
        F.col("changed").cast("int").alias("components_changed"),
        (F.col("attempt") > 0).cast("int").alias("collisions_resolved"),
    )
    counted = paths.unionByName(parts)
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns])
