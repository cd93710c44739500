"""Problem 6: token ids of a corpus by a public byte-level BPE vocabulary, and token counts and offsets for problems 7 and 8.

A text is split by the vocabulary's pattern; each distinct word is merged once a worker, by a contiguous rank array: the part
boundaries of a word and, beside each, the rank of its pair with the next part lie in flat lists; the minimum is looked for
by scanning, its boundary deleted, and the two neighbouring ranks refreshed. Words of a text repeat (Zipf), so most of the
work is a look-up. One pass, no shuffle; each worker holds the vocabulary and a cache of at most CACHE words. Words longer than
LONG bytes are merged by a heap over a linked list instead: the scan is quadratic, and a text without a break is one word.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Where the vocabularies lie; the path is a parameter everywhere, and they are never copied.
TOKENIZERS = os.environ.get("POOLAUDIT_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 500_000
LONG = 96
_NONE = 1 << 60


class BytePairs(dict):
    """Word to the tuple of its ids; a missing word is merged and, while there is room, kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bytes: dict[int, bytes] = {}
        self._long: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word in self._long:
            return self._long[word]
        data = word.encode("utf-8", "replace")
        rank = self.ranks.get(data)
        if rank is not None:
            ids = (rank,)
        else:
            ids = tuple(self._scan(data) if len(data) <= LONG else self._heap(data))
        if len(self) >= CACHE:
            self.clear()
        if len(data) <= LONG:
            self[word] = ids
        else:  # long ones seldom recur but within their own text
            if len(self._long) >= 16:
                self._long.clear()
            self._long[word] = ids
        return ids

    def _scan(self, data: bytes) -> list[int]:
        ranks = self.ranks
        bound = list(range(len(data) + 1))
        pair = [ranks.get(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pair:
            least = min(pair)
            if least == _NONE:
                break
            i = pair.index(least)
            del bound[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(data[bound[i] : bound[i + 2]], _NONE)
            if i:
                pair[i - 1] = ranks.get(data[bound[i - 1] : bound[i + 1]], _NONE)
        return [ranks[data[a:b]] for a, b in zip(bound, bound[1:], strict=False)]

    def _heap(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def bytes_of(self, i: int) -> bytes:
        if not self._bytes:
            self._bytes = {v: k for k, v in self.ranks.items()}
        return self._bytes[i]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty or null one. No special tokens: their strings are ordinary text."""
        out: list[int] = []
        if text:
            for w in self.split(text):
                out += self[w]
        return out

    def count(self, text: str | None) -> int:
        return sum(len(self[w]) for w in self.split(text)) if text else 0


@cache
def byte_pairs(path: str) -> BytePairs:
    """One per worker process, so that a worker that is used again keeps its cache."""
    return BytePairs(path)


def vocabulary(name: str = BYTE_BPE, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document; ids is an empty list for an empty or null text. Repeated rows come out each; an empty
    table gives no rows; other columns aren't read."""
    path = path or vocabulary()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_pairs(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(t) for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document; 0 for an empty or null text."""
    path = path or vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_pairs(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [bpe.count(t) for t in batch["text"]]})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint")
