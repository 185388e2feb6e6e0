"""Importance resampling towards a target, with an Aho-Corasick dictionary of words.

The distinct words of a block of texts, bounded by blanks on both sides, make an
automaton whose payloads are each word's CRC-32 and length. One scan of the block
tells the payloads in order, and the CRC of a run of words is composed of its
neighbours' payloads, so no feature is ever written out. A document keeps the
buckets of its features, two or four bytes each; counts over all documents and
over the target give each bucket's gain, and sums of gains score the documents.
Gumbel noise drawn from the id turns the best scores into a weighted sample.

Cases: a null text has no words; a null id is drawn as an empty one and is smaller
than any other; of rows with the same score and id any comes first; empty tables,
of documents or of the target, give gains by the same formula; further columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import release_memory, text_blocks, whole_text, with_running_total
from maskloom.llm.infill import draws
from maskloom.sources.scratch import settled

BLOCK_BYTES = 4 << 20
LONG_WORD = 1 << 10  # a longer word is scanned by a stand-in of a few bytes
# A-Z become a-z; all other ASCII characters but 0-9 and a-z separate words.
_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
PLAIN = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def _zero_steps() -> list[np.ndarray]:
    """By j: four tables of 256 that carry a CRC over 2^j zero bytes, for lengths below 2^40."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    low = np.arange(256, dtype=np.uint32)
    tables = [np.stack([one, low, low << np.uint32(8), low << np.uint32(16)])]
    for _ in range(39):
        tables.append(np.stack([_carry(tables[-1], column) for column in tables[-1]]))
    return tables


def _carry(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = lambda k: (crc >> np.uint32(8 * k)) & np.uint32(255)
    return table[0][byte(0)] ^ table[1][byte(1)] ^ table[2][byte(2)] ^ table[3][byte(3)]


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """CRC-32 of the concatenation of two strings from theirs and the second's length."""
    out = first.copy()
    for j in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> j) & 1)
        out[at] = _carry(tables[j], out[at])
    return out ^ second


class Dictionary:
    """The distinct words of a block and an automaton that finds them between blanks."""

    def __init__(self, block: bytes):
        import ahocorasick

        words = set(block.split(b" ")) - {b""}
        long = sorted(word for word in words if len(word) > LONG_WORD)
        words = [*(words.difference(long)), *long]
        # After the translation no text holds the byte 1: stand-ins meet no word.
        self.stand_in = {word: b"\1%d" % i for i, word in enumerate(long)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word(f" {self.stand_in.get(word, word).decode('latin-1')} ", i)
        if words:
            self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(word) for word in words], np.uint32)
        self.length = np.array([len(word) for word in words], np.int64)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) for every word of every text, in order."""
        if self.stand_in:
            texts = [b" ".join(self.stand_in.get(word, word) for word in text.split(b" ")) for text in texts]
        ends = np.cumsum([len(text) + 1 for text in texts])
        if not len(self.crc):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = self.automaton.iter(f" {b' '.join(texts).decode('latin-1')} ")
        found = np.fromiter(pairs, np.dtype([("end", np.int64), ("word", np.int64)]))
        # The blank after a word lies at its text's length at most, counted from the blank before the text.
        return np.searchsorted(ends, found["end"]), found["word"]


def block_features(texts: list[bytes], least: int, most: int, buckets: int, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per text: the number of words, and the buckets of all runs of ``least`` to ``most`` words."""
    texts = [text.translate(PLAIN) for text in texts]
    known = Dictionary(b" ".join(texts))
    text, word = known.scan(texts)
    n_words = np.bincount(text, minlength=len(texts))
    crc, length = known.crc[word], known.length[word]
    blank = np.full(len(word), zlib.crc32(b" "), np.uint32)
    owners, found = [], []
    run = crc
    for size in range(1, most + 1):
        if size > 1:
            # A run and the word after it, in the same text, with a blank between.
            run = joined_crc(run[:-1], blank[: len(run) - 1], np.ones(max(0, len(run) - 1), np.int64), tables)
            run = joined_crc(run, crc[size - 1 :], length[size - 1 :], tables)
        if size >= least and len(run):
            whole = text[: len(run)] == text[size - 1 :]
            owners.append(text[: len(run)][whole])
            found.append(run[whole] % np.uint32(buckets))
    if not owners:
        return n_words, [np.empty(0, np.uint32)] * len(texts)
    owner, bucket = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(texts))
    return n_words, np.split(bucket[order], np.cumsum(counts)[:-1])


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(df: DataFrame, id_col: str, text_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, bag): the bag holds the bucket of every feature."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _zero_steps() if most > 1 else []
        for batch in batches:
            for start, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                n_words, bags = block_features(texts, least, most, buckets, tables)
                columns = [
                    batch.column(0).slice(start, len(texts)),
                    pa.array(n_words, pa.int64()),
                    pa.array([len(bag) for bag in bags], pa.int64()),
                    pa.array([bag.astype(_width(buckets)).tobytes() for bag in bags], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "bag"])
            release_memory()

    given = df.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, bag binary")


def bucket_counts(bags: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; every task adds up its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bag in batch.column(0):
                total += np.bincount(np.frombuffer(bag.as_buffer(), _width(buckets)), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    summed = bags.select("bag").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in summed.collect():  # one row a bucket
        counts[row["bucket"]] = row["n"]
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of each bucket's share in the target to its share in the documents, each count plus one."""
    size = len(documents)
    ratio = (target + 1.0) * (documents.sum() + size) / ((documents + 1.0) * (target.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(bags: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the sum of gains over a document's features."""
    buckets = len(gain)
    kind = bags.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [gain[np.frombuffer(bag.as_buffer(), _width(buckets))].sum() for bag in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return bags.select("id", "n_words", "n_features", "bag").mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample_to_target(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    runs: tuple[int, int] = (1, 1),
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; the drawn ones are ranked from 1, others have no rank.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are
    drawn. Ranks come from a range partitioning by score and sums over partitions.
    """
    bags = settled(features(df, id_col, text_col, *runs, buckets))
    aim = features(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id", "text", *runs, buckets)
    gain = gains(bucket_counts(bags, buckets), bucket_counts(aim, buckets))
    (h,) = draws(F.col("id"), seed, 1)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(bags, gain).withColumn("score", (F.col("weight") + noise).cast("bigint"))
    # Rows alike in score and id are told apart by their place in the table.
    scored = settled(scored.select("*", F.monotonically_increasing_id().alias("row"), (-F.col("score")).alias("down"), F.lit(0).alias("whole")))
    able = F.col("n_words") >= least_words
    draw = scored.filter(able).count() * percent // 100
    ranked = with_running_total(scored.filter(able), "whole", ["down", "id", "row"], name="ahead")
    rank = F.when(F.col("ahead") < draw, F.col("ahead") + 1).cast("bigint").alias("rank")
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    rest = scored.filter(~able).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, rank).unionByName(rest)
