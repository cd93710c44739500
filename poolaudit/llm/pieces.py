"""Problem 8: splitting oversized texts at natural boundaries, by lexical cohesion.

A text's vocabulary shifts where its topic does. The content words on either side of each boundary, BLOCK each, are counted, and
the cosine of the two counts is the cohesion there, over all words of the vocabulary; a boundary's depth is how far its cohesion lies
below the peaks on both sides, up to which it rises without a break. Words of at least four letters and numbers of at least
three digits count; of scripts written without blanks every two neighbouring characters do. Within the window in which a piece
may end the deepest boundary is taken, line and paragraph breaks gaining a little. The next piece starts overlap_tokens earlier.
Counts are never held: the cosines of all boundaries come from the pairs of equal words that lie near each other, each of which
adds to a run of boundaries. One pass over the documents, no shuffle; the table of sources has one row per
source, and Spark broadcasts it only below its own size limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolaudit.llm.tokens import BytePairs, byte_pairs, vocabulary

BLOCK = 30
#: A piece is at least this part of max_tokens, if there is a natural boundary beyond.
FILL = 0.5
#: What a boundary gains over its depth: end of a sentence, of a line, of a paragraph.
GAIN = {1: 0.0, 2: 0.15, 3: 0.4}
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*$")


class Kinds(dict):
    """Pre-token to its number; table has, by number: tokens, characters, hash of the content word (-1: none, -2: several, which are
    in grams), whether it closes a sentence, its line breaks (0, 1 or 2), whether it begins with a blank."""

    def __init__(self, bpe: BytePairs):
        super().__init__()
        self.bpe = bpe
        self.table = np.zeros((1024, 6), np.int64)
        self.grams: dict[int, np.ndarray] = {}

    def __missing__(self, word: str) -> int:
        if len(self) == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        k = self[word] = len(self)
        bare = word.strip().casefold()
        dim = -1
        if not bare.isascii() and len(bare) > 1 and _UNSPACED.search(bare):
            dim = -2
            self.grams[k] = np.array([crc32(bare[i : i + 2].encode("utf-8", "replace")) for i in range(len(bare) - 1)])
        elif (len(bare) >= 4 and bare.isalpha()) or (len(bare) >= 3 and bare.isdigit()):
            dim = crc32(bare.encode("utf-8", "replace"))
        self.table[k] = (len(self.bpe[word]), len(word), dim, bool(_END.search(word)), min(2, word.count("\n")), word[0].isspace())
        return k

    def of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of the table for the pre-tokens of a text, and its content: the pre-token and hash of each word."""
        if len(self) > 500_000:
            self.clear()
            self.grams.clear()
        numbers = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        columns = self.table[numbers].T
        at = np.flatnonzero(columns[2] >= 0)
        dims = columns[2][at]
        if self.grams and len(several := np.flatnonzero(columns[2] == -2)):
            more = [self.grams[int(k)] for k in numbers[several]]
            at = np.concatenate([at, np.repeat(several, [len(g) for g in more])])
            dims = np.concatenate([dims, *more])
            order = np.argsort(at, kind="stable")
            at, dims = at[order], dims[order]
        return columns, at, dims


def depths(content: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Depth of each boundary; content, hashes: pre-token and hash of each content word, at: pre-tokens before the boundary."""
    n = len(content)
    # Two neighbouring characters say less than a word: of texts made of such, a block has twice as many.
    block = 2 * BLOCK if 2 * len(np.unique(content)) < n else BLOCK
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    across, within = np.zeros(n + 2 * block + 2, np.int64), np.zeros(n + 2 * block + 2, np.int64)

    def add(to: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        to += np.bincount(first, minlength=len(to)) - np.bincount(last + 1, minlength=len(to))

    for lag in range(1, min(n, 2 * block)):
        same = np.flatnonzero(sorted_[lag:] == sorted_[:-lag])
        j, i = order[same], order[same + lag]
        near = i - j < 2 * block
        if not near.any():
            break  # later occurrences are farther still
        j, i = j[near], i[near]
        add(across, np.maximum(j, i - block) + 1, np.minimum(i, j + block))  # boundaries with j in the left block, i in the right
        both = i - j < block
        add(within, i[both] + 1, j[both] + block)  # ends of blocks that hold both
    across, within = np.cumsum(across), np.cumsum(within)
    p = np.searchsorted(content, at)
    left, right = np.minimum(block, p) + 2 * within[p], np.minimum(block, n - p) + 2 * within[p + block]
    norm = np.sqrt(left.astype(np.float64) * right)
    same = np.where(norm > 0, across[p] / np.maximum(norm, 1e-9), 0.0)
    return peak(same) + peak(same[::-1])[::-1] - 2 * same


def peak(same: np.ndarray) -> np.ndarray:
    """Of each place the value up to which the values before it rise, going back, without falling."""
    start = np.ones(len(same), bool)
    start[1:] = same[:-1] < same[1:]
    return same[np.maximum.accumulate(np.where(start, np.arange(len(same)), 0))]


def split(text: str, most: int, overlap: int, kinds: Kinds) -> list[tuple[int, int, str]]:
    """(first token, token after the last, text) of each piece of a text of more than `most` tokens; [] for one that fits.

    Pieces have at most `most` tokens of the text, and neighbours share exactly overlap tokens (at most most - 1), unless a
    character of several tokens lies across the start of the later one, which then starts with that character.
    """
    bpe = kinds.bpe
    parts = bpe.split(text)
    (counts, lengths, _, closes, breaks, spaced), content, hashes = kinds.of(parts)
    tokens = np.concatenate([[0], np.cumsum(counts)])
    n = int(tokens[-1])
    if n <= most:
        return []
    overlap = max(0, min(overlap, most - 1))
    chars = np.concatenate([[0], np.cumsum(lengths)])
    spaced = spaced > 0
    # level[i]: of the boundary before pre-token i. 3 paragraph, 2 line, 1 sentence, 0 word.
    level = np.full(len(parts) + 1, -1, np.int64)
    level[1:-1][spaced[1:]] = 0
    level[1:-1][(closes[:-1] > 0) & spaced[1:]] = 1
    lines = np.flatnonzero(breaks) + 1
    level[lines] = np.maximum(level[lines], 1 + breaks[lines - 1])
    level[0] = level[-1] = -1
    natural = np.flatnonzero(level >= 1)
    score = np.zeros(0)
    if len(natural):
        score = depths(content, hashes, natural)
        score = score + np.array([0.0, GAIN[1], GAIN[2], GAIN[3]])[level[natural]]
    loose = np.flatnonzero(level == 0)

    def char(t: int) -> int | None:
        """Character offset of a token boundary; None within a character."""
        i = int(np.searchsorted(tokens, t, "right")) - 1
        if tokens[i] == t:
            return int(chars[i])
        head = b"".join(bpe.bytes_of(j) for j in bpe[parts[i]][: t - int(tokens[i])])
        try:
            return int(chars[i]) + len(head.decode())
        except UnicodeDecodeError:
            return None

    def pick(s: int) -> int:
        """The token at which the piece from token s on ends."""
        low, high = s + overlap + 1, s + most
        mid = max(low, s + int(most * FILL))
        at = tokens[natural]
        a, m, b = np.searchsorted(at, [low, mid, high + 1])
        orders = [m + np.argsort(-score[m:b], kind="stable"), np.arange(m - 1, a - 1, -1)]
        a, b = np.searchsorted(tokens[loose], [low, high + 1])
        c, d = np.searchsorted(tokens, [low, high + 1])
        for choices in (at[orders[0]], at[orders[1]], tokens[loose[a:b]][::-1], tokens[c:d][::-1]):
            for e in choices.tolist():
                if char(e - overlap) is not None:
                    return e
        for e in range(high, low - 1, -1):
            if char(e) is not None and char(e - overlap) is not None:
                return e
        return next((e for e in range(high, s, -1) if char(e) is not None), high)

    out, s, begin = [], 0, 0
    while n - s > most:
        e = pick(s)
        stop = char(e)
        out.append((s, e, text[begin : len(text) if stop is None else stop]))
        s = max(e - overlap, s + 1)
        while (start := char(s)) is None:  # only where every cut would lie across a character
            s += 1
        begin = start
    out.append((s, n, text[begin:]))
    return out


def pieces(documents: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece (from 0), first_token, tokens, text of the pieces of each document that has more than its source's
    max_tokens.

    A document that fits, a null or empty text, and one whose source is null, unknown or without max_tokens has no pieces; a
    null overlap_tokens is 0. Repeated rows are split each. Other columns aren't read.
    """
    path = path or vocabulary()
    limits = sources.where("max_tokens > 0").select("source", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens"))
    # A token has at least one byte: shorter texts fit, and needn't be looked at.
    rows = documents.select("doc_id", "source", "text").join(limits, "source").where("octet_length(text) > max_tokens").drop("source")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = Kinds(byte_pairs(path))
        for batch in batches:
            out = [
                (i, k, s, e - s, t)
                for i, text, most, overlap in zip(batch["doc_id"], batch["text"], batch["max_tokens"], batch["overlap_tokens"], strict=True)
                for k, (s, e, t) in enumerate(split(text, int(most), int(overlap), kinds))
            ]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "first_token", "tokens", "text"])

    return rows.mapInPandas(cut, "doc_id bigint, piece int, first_token bigint, tokens int, text string")
