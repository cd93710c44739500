"""Words of completions and the keys by which completions are compared, for whole batches at a time."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import xxhash

#: Completions with fewer words take no part in problems 1 to 3.
MIN_WORDS = 8

_ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|\x00")
_PART = re.compile(r"([^:=]+)[:=](.*)", re.DOTALL)
_SPLIT = re.compile(r"[\n;]")
_CACHE_LIMIT = 1_000_000


def plain(text: str) -> str:
    """NFKC without the four zero-width characters."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    return _ZERO_WIDTH.sub("", text) if _ZERO_WIDTH.search(text) else text


def words(text: str | None) -> list[str]:
    """Longest runs of letters or digits of the case-folded plain text; a null has none."""
    return _WORD.findall(plain(text).casefold()) if text else []


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """(name, value) pairs of a plain text made only of named fields, else None.

    Either a JSON object whose values are all strings, or `name: value` / `name=value` parts, each on its own line or parted by
    semicolons; names have any number of words, at least one. A single field, in either layout, isn't taken as fields: its
    words in order say the same.
    """
    text = text.strip()
    if text[:1] == "{":
        try:
            pairs = json.loads(text, object_pairs_hook=lambda x: x)
        except (ValueError, RecursionError):
            return None
        if isinstance(pairs, list) and len(pairs) > 1 and all(isinstance(v, str) for _, v in pairs):
            return pairs
        return None
    if ":" not in text and "=" not in text:
        return None
    found = []
    for part in _SPLIT.split(text):
        if not part.strip():
            continue
        m = _PART.fullmatch(part.strip())
        if not m or not _WORD.search(m[1]):
            return None
        found.append((m[1], m[2]))
    return found if len(found) > 1 else None


class WordHashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of a batch of texts: the hash of each in text order, and how many each text has."""

    word: np.ndarray
    size: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def only(self, keep: np.ndarray) -> Words:
        return Words(self.word[np.repeat(keep, self.size)], self.size[keep])


def _scan(texts: list[str]) -> list[str]:
    """words() of every text, by one scan over all of them, parted by an end mark."""
    whole = "\x00".join(plain(t) for t in texts)
    if whole.count("\x00") >= len(texts):
        whole = "\x00".join(plain(t).replace("\x00", " ") for t in texts)
    return _WORD_OR_END.findall(whole.casefold())


def batch_words(texts: list[str], hashes: dict[str, int]) -> Words:
    """words() of every text as numbers from a table, which has one of its own for the end mark."""
    found = _scan(texts)
    flat = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    end = np.flatnonzero(flat == np.uint64(hashes["\x00"]))
    return Words(np.delete(flat, end), _sizes(end, len(flat), len(texts)))


def batch_tokens(texts: list[str]) -> tuple[list[str], list[int]]:
    """words() of every text in one list, an end mark after each text but the last, and how many words each has."""
    found = _scan(texts)
    end = np.array([i for i, w in enumerate(found) if w == "\x00"], np.int64)
    return found, _sizes(end, len(found), len(texts)).tolist()


def _sizes(end: np.ndarray, n: int, texts: int) -> np.ndarray:
    stops = np.concatenate([end, [n]]) if texts else np.zeros(0, np.int64)
    return (np.diff(np.concatenate([[-1], stops])) - 1).astype(np.int64)


class Keys(NamedTuple):
    """key: 128 bits of each text's record; fields: whether it is made of named fields."""

    key: list[bytes]
    fields: np.ndarray


def record_keys(texts: list[str], found: Words) -> Keys:
    """Equal for texts with equal words in equal order and, of texts of named fields, with equal sets of (words of name, words
    of value). Every text must have a word; found: their batch_words()."""
    at = (np.arange(len(found.word)) - np.repeat(found.start, found.size)).astype(np.uint64)
    step = mix(at + np.uint64(1))
    halves = [np.add.reduceat(mix(found.word * np.uint64(k) + step), found.start) if len(texts) else found.word for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    both = np.stack(halves, axis=1).astype("<u8").tobytes()
    keys = [both[i : i + 16] for i in range(0, 16 * len(texts), 16)]
    fields = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        if (":" in t or "=" in t or not t.isascii()) and (pairs := named_fields(plain(t))) is not None:
            parts = {"\x1f".join(_WORD.findall(n.casefold())) + "\x1e" + "\x1f".join(_WORD.findall(v.casefold())) for n, v in pairs}
            keys[i] = blake2b(("\x1d" + "\x1d".join(sorted(parts))).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            fields[i] = True
    return Keys(keys, fields)
