"""Quality by importance resampling: target against raw text under hashed n-gram models.

Each text gives n-grams in three views, hashed into one table of buckets: words and
pairs of words, shapes of words and pairs of shapes, and how recently a word
occurred before. Two bags of n-grams are fitted, one on labelled target documents
and one on all raw text; a document's importance is the log of their ratio for
``DRAWN`` n-grams drawn from it, that is, its mean log-ratio times ``DRAWN``, so that
length alone favours no document. The k documents with the largest importance plus Gumbel noise are
a sample without replacement in proportion to importance. k is the number of
documents whose importance lies above the level that tells labelled ones best
apart.

At most ``MAX_LABELS`` labelled documents are used, the first by a hash of their id.
Every other one fits the target and the rest set the level, which therefore holds
for documents that the target has not seen. Counts of raw text, scores and the
sample cover every document.

Cases: a null or empty text has no n-gram and importance 0; labels without a
document and null labels are ignored; without target labels nothing can be told and
every document stays; rows repeated with the same id get the same score and noise
and stay or go together, but for ties at the very cut, which all stay; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import fresh, release_memory, small_batches, text_blocks, whole_text, worker_cache
from maskloom.sources.scratch import measured, settled

BUCKETS = 1 << 13
MAX_LABELS = 20_000
PRIOR = 0.5  # added to each count
DRAWN = 100.0
NEUTRAL = 100.0  # n-grams of ratio 1 added to each text: a few words tell little
MOST = 8.0  # of one n-gram's log-ratio: words of one view must not drown the others
CACHED_WORDS = 100_000
BLOCK_BYTES = 1 << 20
BINS = 2048
LOSS = 10.0


MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _mixed(h: np.ndarray | np.uint64, part: np.ndarray) -> np.ndarray:
    h = (h ^ part) * MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    return h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


class _Words(dict):
    """Words to numbers; ``tables`` holds by number what n-grams take from a word or its shape: hash, bucket alone, hash as the first of a pair."""

    def __init__(self, learn, views: list[np.uint64]):
        self.learn, self.views = learn, views
        self.forget()

    def __missing__(self, word: bytes) -> int:
        self.new.append(self.learn(word))
        self[word] = number = len(self)
        return number

    def forget(self) -> None:
        self.clear()
        self.shapes: dict[bytes, int] = {}
        self.new: list[tuple[int, int]] = []
        self.tables = [np.zeros(0, kind) for kind in (np.uint64, np.int64, np.uint64) * 2]

    def settle(self) -> list[np.ndarray]:
        if self.new:
            hashes = np.array(self.new, np.uint64).T
            more = [t for h, v in zip(hashes, (0, 2), strict=True) for t in (h, _bucket(_mixed(self.views[v], h)), _mixed(self.views[v + 1], h))]
            self.tables = [np.concatenate(pair) for pair in zip(self.tables, more, strict=True)]
            self.new = []
        return self.tables


def _ngrams():
    """Texts to (bucket of each n-gram, n-grams of each text)."""
    import re
    from itertools import chain

    import xxhash

    hashed = xxhash.xxh64_intdigest
    # A character stands for its class; then runs of a class count once, those of any other character twice.
    classes = bytes(97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
    runs = [(re.compile(p), r) for p, r in ((rb"([aA0])\1+", rb"\1"), (rb"([^aA0])\1+", rb"\1\1"))]
    views = [np.uint64(hashed(name)) for name in (b"word", b"words", b"shape", b"shapes", b"again")]
    back = np.arange(9, dtype=np.uint64)
    again_bucket = _bucket(_mixed(_mixed(views[4], back)[:, None], back))

    def learn(word: bytes) -> tuple[int, int]:
        kinds = word.translate(classes)
        if (shape := known.shapes.get(kinds)) is None:
            squeezed = kinds
            for pattern, to in runs:
                squeezed = pattern.sub(to, squeezed)
            shape = known.shapes[kinds] = hashed(squeezed)
        return hashed(word.lower()), shape

    cache = worker_cache("ngrams")
    if "words" not in cache:
        cache["words"] = _Words(learn, views)
    known = cache["words"]

    def run(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cut = [t.split() for t in texts]
        if len(known) > CACHED_WORDS:
            known.forget()
        sizes = np.array([len(c) for c in cut], np.int64)
        number = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        word, word_bucket, word_first, shape, shape_bucket, shape_first = known.settle()
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.minimum(np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes), 8).astype(np.uint8)
        again, words = np.zeros(len(number), np.uint8), word[number]
        for back in (8, 7, 6, 5, 4, 3, 2, 1):
            same = words[back:] == words[:-back]
            same &= place[back:] >= back
            np.copyto(again[back:], np.uint8(back), where=same)
        right = np.flatnonzero(place)
        left = right - 1
        first, second = number[left], number[right]
        pairs = [_bucket(_mixed(word_first[first], words[right])), _bucket(_mixed(shape_first[first], shape[second]))]
        found = [word_bucket[number], shape_bucket[number], *pairs, again_bucket[again[left], again[right]]]
        owners = [owner, owner, *[owner[right]] * 3]
        return np.concatenate(found), np.concatenate(owners)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label or null) to counts of raw and target n-grams by bucket."""
    ngrams, raw, target = _ngrams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
        for start, texts in text_blocks(batch.column(0), BLOCK_BYTES):
            bucket, owner = ngrams(texts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            if (mine := good[start : start + len(texts)]).any():
                target += np.bincount(bucket[mine[owner]], minlength=BUCKETS)
        release_memory()
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], ["bucket", "raw", "target"])


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log(target / raw) of each bucket


def with_labels(df: DataFrame, labels: DataFrame, id_col: str, label: str, name: str, fold: str) -> DataFrame:
    """``df`` (with what labels name as ``_by``) with columns ``name``, the label of at most ``MAX_LABELS`` documents, else null, and ``fold``, whether it fits the target."""
    told = labels.select(F.col(id_col).alias("_lid"), F.col(label).cast("int").alias(name)).dropna().groupBy("_lid").agg(F.min(name).alias(name))
    first = told.orderBy(F.xxhash64("_lid"), "_lid").limit(MAX_LABELS)
    fits = F.pmod(F.xxhash64("_lid", F.lit("fold")), F.lit(2)) == 0
    first = first.withColumn(fold, fits)
    # At most MAX_LABELS rows.
    return df.join(F.broadcast(first), F.col("_by") == F.col("_lid"), "left").drop("_lid", "_by")


def fit(labelled: DataFrame) -> Model | None:
    """The ratio of two n-gram models from (text, label): all texts are raw, those of label 1 the target."""
    parts = labelled.mapInArrow(_counts, "bucket bigint, raw bigint, target bigint")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    with small_batches(labelled.sparkSession):
        # A row a bucket.
        found = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    for row in found:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return None
    raw, target = raw + PRIOR, target + PRIOR
    return Model(np.clip(np.log(target / target.sum()) - np.log(raw / raw.sum()), -MOST, MOST))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = _ngrams()
        for batch in batches:
            importance, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for start, texts in text_blocks(batch.column(2), BLOCK_BYTES):
                bucket, owner = ngrams(texts)
                importance[start : start + len(texts)] = np.bincount(owner, model.ratio[bucket], len(texts))
                n[start : start + len(texts)] = np.bincount(owner, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(importance / (n + NEUTRAL) * DRAWN)], ["id", "label", "n_grams", "importance"])
            release_memory()

    return run


def best_level(values: np.ndarray, labels: np.ndarray) -> float:
    """The level that tells the labels best apart; each weighs the same in all, but a good one lost counts ``LOSS`` times."""
    order = np.argsort(values, kind="stable")
    v, good = values[order], labels[order] == 1
    if good.all() or not good.any():
        return -np.inf
    lost, caught = np.cumsum(good) / good.sum(), np.cumsum(~good) / (~good).sum()
    at = int(np.argmax(np.where(np.append(v[1:] > v[:-1], True), caught - LOSS * lost, -np.inf)))
    return float((v[at] + v[min(at + 1, len(v) - 1)]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column, exactly: histograms of ever narrower ranges."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0  # values over ``high``
    while low < high:
        width = (high - low) / BINS
        if low + width <= low or high - width >= high:
            break
        # A row a bin at most.
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        inside = df.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(bin_of.alias("b"))
        found = inside.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("b")).collect()
        for row in found:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", seed: int = 42, by: Column | None = None) -> DataFrame:
    """(id, n_grams, importance, noisy, kept), one row for each of ``df``; ``by`` says what the labels name, the id by default."""
    text = df.select(F.col(id_col), (F.col(id_col) if by is None else by).alias("_by"), whole_text(text_col).alias("text"))
    labelled = with_labels(text, labels, id_col, label, "label", "fits")
    model = fit(labelled.select("text", F.when(F.col("fits"), F.col("label")).alias("label")))
    kind = dict(df.dtypes)[id_col]
    if model is None:
        zero = F.lit(0.0)
        return df.select(F.col(id_col), F.lit(0).cast("bigint").alias("n_grams"), zero.alias("importance"), zero.alias("noisy"), F.lit(True).alias("kept"))
    level_label = F.when(~F.col("fits"), F.col("label")).alias("label")
    scored = labelled.select(F.col(id_col).alias("id"), level_label, "text").mapInArrow(_scorer(model), f"id {kind}, label int, n_grams bigint, importance double")
    uniform = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    with small_batches(df.sparkSession):
        scored = settled(scored.withColumn("noisy", F.col("importance") - F.log(-F.log(uniform))))
    # One row a labelled id and text: at most MAX_LABELS of them unless texts of one id differ, and then in an order of their own.
    told = scored.filter("label IS NOT NULL").select("id", "importance", "label").distinct()
    told = told.orderBy(F.xxhash64("id", "importance"), "label").limit(MAX_LABELS).select("importance", "label").toPandas()
    level = best_level(told["importance"].to_numpy(), told["label"].to_numpy())
    k = scored.filter(F.col("importance") > level).count()
    cut = kth_largest(scored, "noisy", k) if k else float("inf")
    return scored.select(F.col("id").alias(id_col), "n_grams", "importance", "noisy", (F.col("noisy") >= cut).alias("kept"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", seed: int = 42) -> DataFrame:
    """The rows of ``df`` that the sample holds, all columns as they are."""
    key, gone = fresh(df, "_key"), fresh(df, "_gone")
    # Different texts of one id are judged apart.
    keyed = df.withColumn(key, F.struct(F.col(id_col), F.xxhash64(whole_text(text_col)).alias("hash")))
    told = labels.withColumn(key, F.col(id_col))
    scored = resample(keyed, told, key, text_col, label, seed, by=F.col(key)[id_col])
    out = settled(scored.filter("NOT kept").select(F.col(key).alias(gone)).distinct())
    return keyed.join(measured(out), F.col(key) == F.col(gone), "left_anti").drop(key)
