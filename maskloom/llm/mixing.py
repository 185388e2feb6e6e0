"""Mixing sources to target weights as a flow of least cost.

Documents with the same set of sources form a pattern. A pattern offers its words
once at no cost, a second time at cost 1, a third at cost 2 and so on, and may
serve the quota of any of its sources. The cheapest flow that fills the quotas
says how many words each pattern gives; documents are then drawn whole, in an
order seeded by their id: each that still fits is taken, to the last one.

The driver sees one row a pattern (at most ``MAX_PATTERNS``, else an error), and the
last ``FEW`` documents that may still fit.

Cases: a null or empty text has size 0 and is never taken; a null source is a
source of its own, last in order; rows repeated with the same id are documents of
their own, and equal ones may change places; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import WORD, small_table, whole_text, with_running_total
from maskloom.sources.scratch import settled

MAX_PATTERNS = 100_000
# So few documents that may still fit are tried on the driver; it bears on the number of passes alone.
FEW = 20_000


BIG = pa.int64()
TAKEN = pa.schema({"p": pa.int32(), "before": BIG, "extra": BIG})
BOUNDS = pa.list_(pa.struct({"upto": BIG, "quota": pa.string()}))
PLAN = pa.schema({"pattern": pa.string(), "p": pa.int32(), "offer": BIG, "whole": BIG, "rest": BIG, "bounds": BOUNDS})
SOURCES = pa.schema({"source": pa.string(), "source_size": BIG, "target": pa.float64()})


def words_in(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def weighted_targets(sizes: Sequence[float], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``most`` times its own size; the excess is shared again."""
    total, open_ones, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_ones:
        level = total / sum(weights[i] for i in open_ones)
        full = [i for i in sorted(open_ones) if weights[i] * level > most * sizes[i]]
        if not full:
            for i in open_ones:
                out[i] = weights[i] * level
            break
        for i in full:
            out[i] = most * sizes[i]
            total -= out[i]
            open_ones.remove(i)
    return out


def least_cost_flow(offers: Sequence[int], serves: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words from each pattern to each quota.

    Cost lies on the offers alone and rises with each repetition, so the cheapest
    paths are those that repeat least: the offers of one repetition after the
    other are opened, and each time the flow is made as large as it can be.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(s, 0) for s in serves]
    served_by: list[list[int]] = [[] for _ in quotas]
    for p, s in enumerate(serves):
        for q in s:
            served_by[q].append(p)
    left, need = [0] * len(offers), list(quotas)
    for _ in range(repeats):
        left = [a + b for a, b in zip(left, offers, strict=True)]
        while True:
            # Shortest path from a pattern with words left to a quota with need, back over what is routed already.
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p, n in enumerate(left) if n and flow[p]}
            queue, end = deque(came), None
            while queue and end is None:
                kind, i = queue.popleft()
                if kind == "p":
                    nexts = [("q", q) for q in flow[i]]
                else:
                    if need[i]:
                        end = i
                        break
                    nexts = [("p", p) for p in served_by[i] if flow[p][i]]
                for node in nexts:
                    if node not in came:
                        came[node] = (kind, i)
                        queue.append(node)
            if end is None:
                break
            path, node = [], ("q", end)
            while node is not None:
                path.append(node)
                node = came[node]
            path.reverse()
            backs = [flow[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)]
            amount = min([left[path[0][1]], need[end], *backs])
            left[path[0][1]] -= amount
            need[end] -= amount
            for i in range(0, len(path) - 1, 2):
                flow[path[i][1]][path[i + 1][1]] += amount
                if i + 2 < len(path):
                    flow[path[i + 2][1]][path[i + 1][1]] -= amount
    return flow


def _filled(summed: DataFrame) -> DataFrame:
    """``summed`` with ``extra``: 1 for each document that fits below ``rest`` when its turn comes, in the order of ``before``.

    What does not fit never will, since the room only shrinks. So each pass takes all
    up to the next document that crosses the room, and goes on with those behind it
    that are no larger than what is left.
    """
    out, parts = [*summed.columns, "extra"], []
    rooms = settled(summed.select("p", F.col("rest").alias("room")).distinct())
    left, upto = summed.withColumn("sum", F.col("before")), F.col("sum") + F.col("size")
    fits, small = (F.col("size") > 0) & (upto <= F.col("room")), (F.col("size") > 0) & (F.col("size") <= F.col("room"))
    yes, no = (F.lit(n).cast("bigint").alias("extra") for n in (1, 0))
    while True:
        # One row a pattern.
        left = left.join(F.broadcast(rooms), "p")
        parts.append(left.filter(fits).select(*summed.columns, yes))
        used = left.groupBy("p", "room").agg(F.coalesce(F.max(F.when(fits, upto)), F.lit(0)).alias("used"))
        rooms = settled(used.select("p", (F.col("room") - F.col("used")).alias("room")))
        crossing = left.filter(~fits).drop("room", "sum").join(F.broadcast(rooms), "p")
        parts.append(crossing.filter(~small).select(*summed.columns, no))
        left = settled(crossing.filter(small))
        last = left.select("p", "before", "size", "room").limit(FEW + 1).collect()
        if len(last) <= FEW:
            break
        left = settled(with_running_total(left.drop("room"), "p", ["before"], F.col("size"), "sum"))
    free, taken = {}, []
    for row in sorted(last):
        room = free.setdefault(row["p"], row["room"])
        if row["size"] <= room:
            free[row["p"]] = room - row["size"]
            taken.append((row["p"], row["before"], 1))
    # At most FEW rows. Of documents with words, each has a place of its own.
    taken = F.broadcast(small_table(summed.sparkSession, taken, TAKEN))
    parts.append(left.join(taken, ["p", "before"], "left").withColumn("extra", F.coalesce("extra", F.lit(0).cast("bigint"))).select(*out))
    return reduce(DataFrame.unionByName, parts)


def mix(rows: DataFrame, quotas: Mapping[str | None, float], repeats: int = 2, seed: int = 42) -> DataFrame:
    """``rows`` (settled: id, size, members as an array of source names) with ``copies`` and ``drawn_for``.

    ``copies`` says how often the mix takes the document, ``drawn_for`` which
    source's quota each copy counts to. Two documents of one id and size may
    change places between runs, everything else is the same.
    """
    pattern = F.to_json(F.array_sort(F.array_distinct("members")))
    rows = rows.withColumn("pattern", pattern)
    found = rows.groupBy("pattern").agg(F.sum("size").alias("offer")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources; merge small sources first")
    names = list(quotas)
    at = {name: i for i, name in enumerate(names)}
    serves = [[at[name] for name in json.loads(row["pattern"]) if name in at] for row in found]
    flow = least_cost_flow([row["offer"] for row in found], serves, [round(quotas[n]) for n in names], repeats)
    plan = []
    for i, row in enumerate(found):
        total, bounds, offer = 0, [], row["offer"]
        for q, amount in flow[i].items():
            total += amount
            bounds += [{"upto": total, "quota": names[q]}] * bool(amount)
        whole = total // offer if offer else 0
        plan.append((row["pattern"], i, offer, whole, total - whole * offer, bounds))
    # One row a pattern, at most MAX_PATTERNS.
    planned = rows.join(F.broadcast(small_table(rows.sparkSession, plan, PLAN)), "pattern")
    order = F.xxhash64(F.col("id"), F.lit(seed))
    summed = settled(with_running_total(settled(planned.drop("pattern").withColumn("h", order)), "p", ["h", "id", "size"], F.col("size")))
    chosen = _filled(summed).withColumn("copies", F.col("whole") + F.col("extra"))
    places = F.transform(F.sequence(F.lit(1).cast("bigint"), "copies"), lambda k: (k - 1) * F.col("offer") + F.col("before"))
    quota = F.transform(places, lambda x: F.coalesce(F.get(F.filter("bounds", lambda b: x < b["upto"]), F.lit(0)), F.element_at("bounds", -1))["quota"])
    drawn = F.when((F.col("copies") > 0) & (F.size("bounds") > 0), quota).otherwise(F.array().cast("array<string>"))
    return chosen.select("id", "size", "members", "copies", drawn.alias("drawn_for"))


def mix_by_source(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """(id, size, source_size, target, taken, copies): each document belongs to one source.

    Sources by code point, null last, take ``weights`` in turn.
    """
    rows = settled(df.select(F.col(id_col).alias("id"), words_in(text_col).alias("size"), F.array(F.col(source_col).cast("string")).alias("members")))
    sources = rows.groupBy(F.col("members")[0].alias("source")).agg(F.sum("size").alias("size"))
    found = sources.orderBy(F.asc_nulls_last("source")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    targets = weighted_targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    mixed = mix(rows, {r["source"]: t for r, t in zip(found, targets, strict=True)}, most, seed)
    told = [(r["source"], r["size"], float(t)) for r, t in zip(found, targets, strict=True)]
    # One row a source, at most MAX_PATTERNS.
    table = F.broadcast(small_table(df.sparkSession, told, SOURCES))
    return mixed.join(table, F.col("members")[0].eqNullSafe(F.col("source"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
