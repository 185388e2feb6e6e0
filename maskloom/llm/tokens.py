"""Token counts by merging ragged arrays in step.

A text's pre-tokens are its runs between blanks; no piece of the vocabulary goes
beyond one. The pre-tokens of a block of texts lie one after the other in one
array of symbols. In each round every pre-token's lowest-ranked pair is found and
all its occurrences are merged at once; pre-tokens with no pair left drop out.
What remains is counted, a symbol outside the vocabulary by its bytes. Distinct
pre-tokens are counted once and remembered within a bound.

Cases: a null or empty text has no token; an id may be null or repeated, each row
is counted by itself; an empty table gives an empty result. A text without any
blank is one pre-token of its full length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import whole_text, worker_cache

CACHED_WORDS = 150_000
BLOCK_CHARS = 1 << 20
BLANK = "▁"  # fixed value: how the vocabulary writes a blank
NONE = np.iinfo(np.int64).max


class Merges:
    """Which pairs of pieces merge, and their ranks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # The best score first: a piece's rank stands for the piece.
        pieces = [model.id_to_piece(i) for i in sorted(normal, key=lambda i: -model.get_score(i))]
        rank = {piece: r for r, piece in enumerate(pieces)}
        self.n = len(pieces)
        self.of_char = np.full(0x110000, self.n, np.int64)
        for piece, r in rank.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = r
        if any(BLANK in piece.lstrip(BLANK) for piece in pieces):
            raise ValueError("pieces go beyond blanks")
        splits = [(rank[p[:i]], rank[p[i:]], r) for p, r in rank.items() for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
        left, right, whole = np.array(splits, np.int64).T
        order = np.argsort(left * (self.n + 1) + right)
        self.pairs, self.merged = (left * (self.n + 1) + right)[order], whole[order]
        # Pieces that, once made, may merge on before what ranks behind them: of these one occurrence is made at a time.
        self.eager = np.zeros(self.n + 1, bool)
        for part in (left, right):
            self.eager[part[whole < part]] = True

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * (self.n + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], NONE)


def count_tokens(merges: Merges, words: list[str]) -> np.ndarray:
    """Tokens of each word (not empty)."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.array([len(w) for w in words], np.int64))
    symbol = merges.of_char[code]
    n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    tokens = np.bincount(owner, np.where(symbol == merges.n, n_bytes - 1, 0), len(words)).astype(np.int64)
    while True:
        rank = np.full(len(symbol), NONE)
        if len(symbol) > 1:
            rank[:-1] = merges.rank_of(symbol[:-1], symbol[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NONE
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(owner)))
        least = np.minimum.reduceat(rank, starts) if len(starts) else rank
        done = least == NONE
        tokens[owner[starts[done]]] += sizes[done]
        if done.all():
            return tokens
        live = np.repeat(~done, sizes)
        symbol, owner, rank, least = symbol[live], owner[live], rank[live], np.repeat(least[~done], sizes[~done])
        at = np.flatnonzero(rank == least)
        # Occurrences that overlap: of a run of them every other one, from the left.
        run = np.append(True, np.diff(at) != 1)
        first = at[run][np.cumsum(run) - 1]
        at = at[(at - first) % 2 == 0]
        alone = merges.eager[rank[at]]
        at = at[~alone | np.append(True, owner[at[1:]] != owner[at[:-1]])]
        symbol[at] = rank[at]
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        symbol, owner = symbol[stays], owner[stays]


def _counter(path: str):
    import re

    merges = Merges(path)
    words = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
    known = worker_cache(path)

    def cut(text: str) -> list[str]:
        """Pre-tokens; a line break, which no piece holds, is one too."""
        return words.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def block(texts: list[str]) -> list[int]:
        parts = [cut(text) for text in texts]
        if len(known) > CACHED_WORDS:
            known.clear()
        if new := list(set().union(*parts).difference(known)):
            known.update(zip(new, count_tokens(merges, new).tolist(), strict=True))
        return [sum(map(known.__getitem__, p)) for p in parts]

    def run(texts: pd.Series) -> pd.Series:
        out, held, chars = [], [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars > BLOCK_CHARS:
                out.append(block(held))
                held, chars = [], 0
        out.append(block(held))
        return pd.Series(list(chain.from_iterable(out)), dtype="int64")

    if merges.of_char[ord("\n")] != merges.n:
        raise ValueError("pieces go beyond line breaks")
    return run


def token_count(text: Column, model_path: str) -> Column:
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = _counter(model_path)
        for texts in batches:
            yield run(texts)

    return count(text)


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each of ``df``."""
    text = whole_text(text_col)
    counted = df.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(text, model_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
