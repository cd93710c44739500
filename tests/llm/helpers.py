"""Brute force over pairs."""

from collections import Counter
from itertools import combinations

import numpy as np

from poolaudit.llm.words import MIN_WORDS, WordHashes, batch_words, record_keys, words


def key(text):
    return record_keys([text], batch_words([text], WordHashes())).key[0]


def hashed(*texts):
    """Words of texts that are given as lists of words."""
    return batch_words([" ".join(t) for t in texts], WordHashes())


def jaccard(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def truth(rows):
    """rows: (row_idx, completion, split). (same, similar): sets of pairs, smaller row first."""
    known = {}
    for i, c, _ in rows:
        w = words(c)
        if len(w) >= MIN_WORDS:
            known[i] = (w, key(c))
    same, similar = set(), set()
    for a, b in combinations(sorted(known), 2):
        if known[a][1] == known[b][1]:
            same.add((a, b))
        small, large = sorted((len(known[a][0]), len(known[b][0])))
        if small >= 0.75 * large and jaccard(known[a][0], known[b][0]) >= 0.75:
            similar.add((a, b))
    return same, similar


def pool(spark, rows):
    """rows: (row_idx, completion, split), as a pool with columns that no operator should read."""
    df = spark.createDataFrame([(i, "p", c, "src", s) for i, c, s in rows], "row_idx bigint, prompt string, completion string, source string, split string")
    return df.selectExpr("*", "1 as uid", "2 as a", "3 as b", "4 as keys", "5 as n", "6 as batch", "7 as bucket", "8 as key", "9 as train", "10 as size")


def lcs(a, b, band):
    """Longest common subsequence with places that differ by the band at most."""
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            step = best[i, j] + 1 if x == y and abs(i - j) <= band else 0
            best[i + 1, j + 1] = max(step, best[i, j + 1], best[i + 1, j])
    return best[-1, -1]
