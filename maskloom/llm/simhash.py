"""Near duplicates by SimHash, with candidates pruned along a ring of segments.

A fingerprint of 64 bits is cut into distance + 1 consecutive segments. If two
fingerprints differ in at most ``distance`` bits, then by the pigeonring
principle some segment starts a chain round the ring whose first l segments
differ, for every l, in at most l * distance / (distance + 1) bits in all. The
first of them is therefore equal, which gives the buckets; the longer chains
prune what a bucket holds before whole fingerprints are compared.

Equal fingerprints are one node. A bucket gives a spanning forest of its links,
never all its pairs; one of more than ``BLOCK`` nodes is dealt out as pairs of
blocks, so no task holds a whole hot bucket.

``near_duplicates`` and ``drop_near_duplicates`` link by the bits of one fingerprint.
``similar_groups`` and ``drop_similar`` link by the Jaccard similarity of the sets of
64-bit shingle hashes. Texts meet where the first shingles of both, in an order that all
texts share, have one in common: of n shingles, n - ceil(similarity * n) + 1 are enough
for every pair that similar to meet. ``PRINTS`` fingerprints of the sets, with ``SLACK``
standard deviations to spare, part most that meet for another reason; what they leave
falls into components, and within one every link is decided by the sets themselves.

Cases: null and empty texts have fingerprint zero and link like any other; repeated
ids and rows keep one row each in ``near_duplicates``; null ids count as larger than
any other (a component of null ids alone has a null id).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import components, fresh, join_groups, release_memory, small_batches, whole_text
from maskloom.sources.scratch import measured, settled

BITS = 64
BLOCK = 8192
# Sets of four and five shingles, one missing, differ in most bits of all that are 0.8 similar: 6 deviations remain for them.
PRINTS, SLACK = 6, 9
CHUNK = 1 << 16
# Shingles in COMMON texts of one in SAMPLED come last in the order. This bears on the size of buckets alone, not on what is found.
SAMPLED, COMMON, MOST_COMMON = 64, 8, 1 << 17
# A component is dealt out in blocks: of SPREAD nodes up to WIDE blocks, then of BLOCK nodes, and of SHINGLES shingles.
SPREAD, WIDE, SHINGLES = 64, 32, 1 << 20


def _seeded(h: np.ndarray, number: int) -> np.ndarray:
    """Hashes of another seed from those of the first."""
    if not number:
        return h
    h = (h ^ np.uint64(0xA0761D6478BD642F * number % (1 << 64))) * np.uint64(0xE7037ED1A0B428DB)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x8EBC6AF09C88C6E3)


def _shingles(text: str, words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, with repeats."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    hashed, n = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1) if tokens else 0
    for start in range(0, n, CHUNK):
        part = tokens[start : start + CHUNK + words - 1]
        columns = [part[i:] for i in range(words)] if len(part) >= words else [[b" ".join(part)]]
        yield np.fromiter((hashed(s, 42) for s in map(b" ".join, zip(*columns, strict=False))), np.uint64)


def _shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, words)]))


def _bits_of(parts: Iterable[np.ndarray], prints: int = 1) -> np.ndarray:
    """Fingerprints of hashes, each counted as often as it comes."""
    ones, n = np.zeros(prints * BITS, np.int64), 0
    for h in parts:
        n += len(h)
        seeded = np.stack([_seeded(h, number) for number in range(prints)], axis=1).view(np.uint8)
        for low in range(0, len(seeded), 255):  # as many as one byte can count
            bits = np.unpackbits(seeded[low : low + 255], axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits((ones * 2 > n).reshape(prints, BITS), axis=1, bitorder="little").view(np.int64)[:, 0]


def with_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, hash, fp): a hash of each text and the 64-bit SimHash of its word shingles, as signed longs."""

    @F.pandas_udf("bigint")
    def fingerprint(texts: pd.Series) -> pd.Series:
        found = pd.Series([int(_bits_of(_shingles(text, words))[0]) for text in texts], dtype="int64")
        release_memory()
        return found

    text = whole_text(text_col)
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), fingerprint(text).alias("fp"))


def segments(distance: int) -> list[int]:
    """The masks of distance + 1 segments, as equal as they can be."""
    cuts = [round(i * BITS / (distance + 1)) for i in range(distance + 2)]
    return [((1 << high) - (1 << low)) for low, high in pairwise(cuts)]


def _forest(fps: np.ndarray, start: int, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected among ``fps``, which share the segment ``start``."""
    masks = segments(distance)
    ring = [np.uint64(masks[(start + i) % len(masks)]) for i in range(1, len(masks))]
    budgets = [(i + 1) * distance // len(masks) for i in range(1, len(masks))]
    rest, left, right = fps, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            at, used = np.arange(len(rest)), np.zeros(len(rest), np.int64)
            for mask, budget in zip(ring, budgets, strict=True):
                used = used + np.bitwise_count((rest[at] ^ x) & mask)
                fits = used <= budget
                at, used = at[fits], used[fits]
                if not len(at):
                    break
            if len(at):
                found = rest[at]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
                rest = np.delete(rest, at)
    return left, right


def _bit_links(distance: int):
    def links(fps: list[np.ndarray], start: int) -> pa.RecordBatch | None:
        left, right = _forest(np.unique(np.concatenate(fps)), start, distance)
        if not left:
            return None
        sides = [pa.array(np.concatenate(s).view(np.int64)) for s in (left, right)]
        return pa.RecordBatch.from_arrays(sides, ["x", "y"])

    return links


def _most_bits(similarity: float, prints: int) -> int:
    """In how many bits texts of that similarity differ, with ``SLACK`` to spare."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = BITS * prints
    return int(n * share + SLACK * np.sqrt(n * share * (1 - share)))


def _forest_by(n: int, near) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected among ``n`` items; ``near(x, rest)`` tells which of ``rest`` link with x."""
    rest, left, right = np.arange(n), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            fits = near(x, rest)
            if fits.any():
                found = rest[fits]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
                rest = rest[~fits]
    return left, right


def _link_batch(nodes: np.ndarray, forest: tuple[list[np.ndarray], list[np.ndarray]]) -> pa.RecordBatch | None:
    if not forest[0]:
        return None
    return pa.RecordBatch.from_arrays([pa.array(nodes[np.concatenate(s)].view(np.int64)) for s in forest], ["x", "y"])


def _print_links(similarity: float, prints: int):
    """The same for rows [node, shingles, print, print, ...]."""
    most = _most_bits(similarity, prints)

    def links(held: list[np.ndarray], start: int) -> pa.RecordBatch | None:
        rows = np.unique(np.concatenate(held), axis=0)
        sizes, bits = rows[:, 1].astype(np.int64), rows[:, 2:]

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            fits = np.minimum(sizes[rest], sizes[x]) >= similarity * np.maximum(sizes[rest], sizes[x]) - 1e-9
            fits[fits] = np.bitwise_count(bits[rest[fits]] ^ bits[x]).sum(axis=1, dtype=np.int64) <= most
            return fits

        return _link_batch(rows[:, 0], _forest_by(len(rows), near))

    return links


def _set_links(similarity: float):
    """The same for rows [node, shingle, shingle, ...], by the similarity of the sets."""

    def links(held: list[np.ndarray], start: int) -> pa.RecordBatch | None:
        rows = np.concatenate(held)
        nodes, sizes = np.array([row[0] for row in rows], np.uint64), np.array([len(row) - 1 for row in rows])
        ends = np.cumsum(sizes)
        shingles = np.unique(np.concatenate([row[1:] for row in rows]), return_inverse=True)[1]
        sets = [shingles[end - size : end] for end, size in zip(ends, sizes, strict=True)]
        inside = np.zeros(len(shingles), bool)

        def near(x: int, rest: np.ndarray) -> np.ndarray:
            fits = np.minimum(sizes[rest], sizes[x]) >= similarity * np.maximum(sizes[rest], sizes[x]) - 1e-9
            at = rest[fits]
            if len(at):
                inside[sets[x]] = True
                both = np.add.reduceat(inside[np.concatenate([sets[i] for i in at])], np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
                inside[sets[x]] = False
                fits[fits] = both >= similarity * (sizes[at] + sizes[x] - both) - 1e-9
            return fits

        return _link_batch(nodes, _forest_by(len(rows), near))

    return links


def _linker(links, unpack):
    """Rows (start, seg, a, b, node) sorted by all but the node, a group after the other, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            fp = unpack(batch.column(4))
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for low, high in pairwise([0, *cuts.tolist(), len(fp)]):
                if low == high:
                    continue
                if (k := tuple(key[low])) != now:
                    if sum(map(len, held)) > 1 and (out := links(held, now[0])):
                        yield out
                    held, now = [], k
                held.append(fp[low:high])
        if sum(map(len, held)) > 1 and (out := links(held, now[0])):
            yield out
        held = []
        release_memory()

    return run


def hamming_links(nodes: DataFrame, distance: int) -> DataFrame:
    """(x, y): links that connect just what is connected by at most ``distance`` bits among the distinct ``fp`` of ``nodes``."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(m)).alias("seg")) for i, m in enumerate(_signed(segments(distance)))]))
    dealt = nodes.select("fp", each.alias("s")).select("s.start", "s.seg", "fp")
    unpack = lambda column: column.to_numpy().view(np.uint64)
    return _grouped(dealt, "fp").mapInArrow(_linker(_bit_links(distance), unpack), "x bigint, y bigint")


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _grouped(dealt: DataFrame, node: str) -> DataFrame:
    """(start, seg, a, b, node), groups of bounded size together and in order, with all pairs of a bucket in some group."""
    sizes = settled(dealt.groupBy("start", "seg").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return _in_blocks(dealt.join(sizes, ["start", "seg"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK)), node)


def _in_blocks(dealt: DataFrame, node: str) -> DataFrame:
    """The same for rows (start, seg, blocks, node)."""
    block = F.pmod(F.xxhash64(node, F.lit("block")), F.col("blocks"))
    # Pairs of different blocks meet in a group of their own; so do pairs within either.
    zero = F.lit(0).cast("bigint")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(zero)).otherwise(F.array_remove(F.sequence(zero, F.col("blocks") - 1), F.col("block"))))
    return (
        dealt.withColumn("block", block)
        .withColumn("other", other)
        .select("start", "seg", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), node)
        .repartition("start", "seg", "a", "b")
        .sortWithinPartitions("start", "seg", "a", "b")
    )


def similar_links(nodes: DataFrame, similarity: float, prints: int = PRINTS) -> DataFrame:
    """(x, y): links that connect at least what is that similar among distinct nodes (node, size, prints and first shingles as packed longs)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, size, bits, first in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                keys = np.frombuffer(first, np.int64)
                packed = np.array([node, size], np.int64).tobytes() + bits
                arrays = [pa.array(np.zeros(len(keys), np.int32)), pa.array(keys), pa.array([packed] * len(keys), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["start", "seg", "packed"])

    keys = nodes.select("node", "size", "prints", "first")
    dealt = keys.mapInArrow(cut, "start int, seg bigint, packed binary")
    unpack = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), 2 + prints)
    return _grouped(dealt, "packed").mapInArrow(_linker(_print_links(similarity, prints), unpack), "x bigint, y bigint")


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many texts share, in order; at most ``MOST_COMMON``, of a sample."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(text, words).view(np.int64))], ["h"])

    found = texts.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(SAMPLED)) == 0).mapInArrow(each, "h bigint")
    found = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON)
    return np.sort(np.array([row["h"] for row in found.collect()], np.int64).view(np.uint64))


def _first(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """As many of a set, in the order of all texts, as any other set that similar must share one of."""
    late = np.isin(shingles, common)
    n = len(shingles)
    return np.concatenate([shingles[~late], shingles[late]])[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def exact_links(texts: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """(x, y): links that connect just what is connected by that similarity, within the components of ``candidates``."""

    @F.pandas_udf("binary")
    def sets(node: pd.Series, text: pd.Series) -> pd.Series:
        rows = [np.int64(i).tobytes() + _shingle_set(t, words).tobytes() for i, t in zip(node, text, strict=True)]
        release_memory()
        return pd.Series(rows, dtype=object)

    roots = settled(candidates.join(nodes.select("node", "size", "hash"), "node"))
    found = settled(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")))
    blocks = F.greatest(F.least(F.ceil(F.col("n") / SPREAD), F.lit(WIDE)), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / SHINGLES))
    wanted = settled(join_groups(roots.select("node", "hash", "root"), found, "root", "n").withColumn("blocks", blocks).select("node", "hash", "root", "blocks"))
    # Texts that several rows hold are one node.
    held = texts.join(measured(wanted), "hash").select("node", "root", "blocks", sets("node", "text").alias("packed"))
    held = settled(held.groupBy("node").agg(*[F.first(c).alias(c) for c in ("root", "blocks", "packed")]))
    dealt = held.select(F.lit(0).alias("start"), F.col("root").alias("seg"), "blocks", "packed")

    def unpack(column: pa.Array) -> np.ndarray:
        rows = np.empty(len(column), object)
        for i, packed in enumerate(column.to_pylist()):
            rows[i] = np.frombuffer(packed, np.uint64)
        return rows

    return _in_blocks(dealt, "packed").mapInArrow(_linker(_set_links(similarity), unpack), "x bigint, y bigint")


def _members(df: DataFrame, id_col: str, text_col: str, words: int, distance: int) -> DataFrame:
    with small_batches(df.sparkSession):
        rows = settled(with_fingerprint(df, id_col, text_col, words))
    nodes = settled(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(hamming_links(nodes.select("fp"), distance), "x", "y")
    roots = settled(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    found = settled(roots.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.min("least").alias("component_id")))
    groups = settled(join_groups(roots, found, "root", "nodes").select("fp", "n", "component_id"))
    return join_groups(rows, groups, "fp", "n")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id), one row for each of ``df``: the smallest id that links of at most ``distance`` bits reach."""
    return _members(df, id_col, text_col, words, distance).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component; all columns as they are.

    Rows repeated with the same id and text stay or go together.
    """
    return _without_followers(df, _members(df, id_col, text_col, words, distance), id_col, text_col)


def _without_followers(df: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, gone = fresh(df, "_key"), fresh(df, "_gone")
    out = settled(members).filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.struct(F.col("id").alias(id_col), "hash").alias(gone))
    keyed = df.withColumn(key, F.struct(F.col(id_col), F.xxhash64(whole_text(text_col)).alias("hash")))
    return keyed.join(measured(settled(out.distinct())), F.col(key) == F.col(gone), "left_anti").drop(key)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, prints: int = PRINTS) -> DataFrame:
    """(id, hash, component_id), one row for each of ``df``: the smallest id that links of that similarity reach."""

    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("hash"), whole_text(text_col).alias("text"))
    common = _common(texts.select("text"), words)

    @F.pandas_udf("node bigint, size bigint, prints binary, first binary")
    def digest(column: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for text in column:
            h = _shingle_set(text, words)
            node = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).view(np.int64)
            rows.append((node, len(h), _bits_of([h[i : i + CHUNK] for i in range(0, len(h), CHUNK)], prints).tobytes(), _first(h, similarity, common).tobytes()))
        release_memory()
        return pd.DataFrame(rows, columns=["node", "size", "prints", "first"])

    # Equal sets are one node.
    rows = settled(texts.select("id", "hash", digest("text").alias("d")).select("id", "hash", "d.*"))
    nodes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "prints", "first")], F.min("hash").alias("hash"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = settled(nodes)
    candidates = components(similar_links(nodes, similarity, prints), "x", "y")
    links = exact_links(texts.select("hash", "text"), nodes, candidates, words, similarity)
    roots = components(links, "x", "y")
    roots = settled(nodes.select("node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    found = settled(roots.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.min("least").alias("component_id")))
    groups = settled(join_groups(roots, found, "root", "nodes").select("node", "n", "component_id"))
    return join_groups(rows.select("id", "hash", "node"), groups, "node", "n").select("id", "hash", "component_id")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their group of similar texts; all columns as they are.

    Rows repeated with the same id and text stay or go together.
    """
    return _without_followers(df, similar_groups(df, id_col, text_col, words, similarity), id_col, text_col)
