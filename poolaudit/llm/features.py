"""Vectorised features of word multisets, for the joins of problems 1 and 3.

Everything works on whole Arrow batches: the words of all rows lie in one flat array, and per-row results come from
ufunc.reduceat, so no Python loop runs over features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolaudit.llm.words import Words, mix

#: Frequencies are kept in so many buckets of a term hash: a fixed bound on what is collected and broadcast.
DF_BUCKETS = 1 << 18


def terms_of(found: Words) -> np.ndarray:
    """64-bit terms in text order: a word and its number among the equal words of its text, so that a multiset of words is a
    set of terms."""
    row = np.repeat(np.arange(len(found.size)), found.size)
    order = np.lexsort((found.word, row))  # stable: equal words of a row stay in text order
    w, r = found.word[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(w))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(w), np.uint64)
    out[order] = mix(w + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def bag_keys(terms: np.ndarray, start: np.ndarray) -> list[bytes]:
    """A 128-bit key of each row's multiset of words."""
    a = np.add.reduceat(mix(terms ^ np.uint64(0xA5A5A5A55A5A5A5A)), start)
    b = np.add.reduceat(mix(terms + np.uint64(0xC2B2AE3D27D4EB4F)), start)
    both = np.stack([a, b], axis=1).astype("<u8").tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def bitmaps(terms: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each row: two rows differ in at least as many terms as bits."""
    bit = np.uint64(1) << (terms & np.uint64(63))
    high = (terms & np.uint64(64)) != 0
    zero = np.uint64(0)
    low = np.bitwise_xor.reduceat(np.where(high, zero, bit), start)
    return low.view(np.int64), np.bitwise_xor.reduceat(np.where(high, bit, zero), start).view(np.int64)


def frequencies(rows: DataFrame) -> np.ndarray:
    """How many rows hold a term, per bucket of terms, over all rows; on a scale of 65,536 steps that keeps their order.

    They only order terms by rarity, so a bucket shared by two terms costs time and never a result. What reaches the driver is
    DF_BUCKETS numbers, whatever the size of the table.
    """
    found = rows.select(F.explode("terms").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(DF_BUCKETS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.ones(DF_BUCKETS, np.float64)
    counts[found["b"].to_numpy(np.int64)] = np.maximum(found["n"].to_numpy(np.float64), 1)
    return np.minimum(np.log2(counts) * 1024, 65535).astype(np.uint64)


def rarest_first(terms: np.ndarray, size: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """32-bit terms of every row, sorted by (frequency, term): one order for all rows. Terms of equal 32 bits are one key."""
    out = np.empty(len(terms), np.int32)
    stops = np.cumsum(size)
    for lo in range(0, len(size), 1 << 16):  # the row, the frequency and the term share 64 bits
        hi = min(lo + (1 << 16), len(size))
        a, b = int(stops[lo] - size[lo]), int(stops[hi - 1])
        t = terms[a:b].view(np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64), size[lo:hi])
        t |= (row << np.uint64(48)) | (scale[(t & np.uint64(DF_BUCKETS - 1)).astype(np.int64)] << np.uint64(32))
        t.sort()
        out[a:b] = t.astype(np.uint32).view(np.int32)
    return out
