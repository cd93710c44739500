"""Votes of stopwords and scripts for the language of short texts, for whole batches at a time.

The stopwords are the public lists that come with Spark, whole: StopWordsRemover.loadDefaultStopWords. A word of several
languages votes for each, by its part. A word in a script of its own votes for the language that is most written in it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import SparkSession

from poolaudit.llm.words import batch_words, words

# The lists by language, and scripts by language.
LISTS = {
    "en": "english", "de": "german", "fr": "french", "es": "spanish", "ru": "russian", "it": "italian", "pt": "portuguese", "nl": "dutch", "da": "danish", "no": "norwegian", "sv": "swedish", "fi": "finnish",
    "hu": "hungarian", "tr": "turkish",
}
SCRIPTS = {"ru": "Ѐ-ԯ", "el": "Ͱ-Ͽ", "he": "֐-׿", "ar": "؀-ۿ", "hi": "ऀ-ॿ", "th": "฀-๿", "ko": "가-힯ᄀ-ᇿ", "ja": "぀-ヿ", "zh": "一-鿿㐀-䶿"}
LANGS = [*LISTS, *(s for s in SCRIPTS if s not in LISTS)]

_QUOTED = re.compile(r"\"[^\"\n]{3,}\"|“[^”\n]{3,}”|«[^»\n]{3,}»|„[^“”\n]{3,}[“”]")
_CODE = re.compile(r"```.*?(```|$)", re.DOTALL)
_NAME = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ] )[A-ZÀ-Þ][^\W_]*")
_MAY_BE_QUOTED = re.compile("[\"“«„`]")


def stopword_lists(spark: SparkSession) -> dict[str, list[str]]:
    """The public lists, read once on the driver; some 2,500 words."""
    from pyspark.ml.feature import StopWordsRemover

    return {lang: list(StopWordsRemover.loadDefaultStopWords(name)) for lang, name in LISTS.items()}


def own_words(text: str) -> str:
    """The text without code, quotations and names: words with a capital after another word, unless such are most of the text."""
    if _MAY_BE_QUOTED.search(text):
        text = _QUOTED.sub(" ", _CODE.sub(" ", text))
    unnamed = _NAME.sub(" ", text)
    return unnamed if 2 * len(unnamed) >= len(text) else text


class Languages(dict):
    """Word to the number of its row in the tables of votes; row 0 is that of words without a vote."""

    def __init__(self, lists: dict[str, list[str]]):
        super().__init__()
        self.scripts = [(LANGS.index(lang), re.compile(f"[{s}]")) for lang, s in SCRIPTS.items()]
        self.rows = [np.zeros(len(LANGS))]
        self.alike: dict[tuple, int] = {}
        self.known: set[str] = set()
        for lang, entries in lists.items():
            for entry in entries:
                found = words(entry)
                if len(found) == 1 and found[0] not in ("t", "s"):
                    w = found[0]
                    self.known.add(w)
                    if w not in self:
                        self[w] = len(self.rows)
                        self.rows.append(np.zeros(len(LANGS)))
                    self.rows[self[w]][LANGS.index(lang)] = 1
        for w in self.known:
            self._script(w, self.rows[self[w]])
        self["\x00"] = 1 << 40
        self._tables()

    def _tables(self) -> None:
        self.count = np.array(self.rows)
        self.part = self.count / np.maximum(1, (self.count > 0).sum(axis=1, keepdims=True))

    def _script(self, word: str, row: np.ndarray) -> bool:
        for i, pattern in self.scripts:
            if n := len(pattern.findall(word)):
                row[:] = 0
                row[i] = n / 2 if LANGS[i] in ("ja", "zh", "th") else 1  # of scripts without blanks a word is a whole clause
                return True
        return False

    def __missing__(self, word: str) -> int:
        row = np.zeros(len(LANGS))
        if word.isascii() or not self._script(word, row):
            if len(self) < 200_000:
                self[word] = 0
            return 0
        like = tuple(row)
        if like not in self.alike:  # words of a script share a row
            self.alike[like] = len(self.rows)
            self.rows.append(row)
        return self.alike[like]

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(votes, votes by parts) of each text for each of LANGS."""
        found = batch_words(texts, self)
        if len(self.rows) != len(self.count):
            self._tables()
        row = np.repeat(np.arange(len(texts)), found.size)
        hit = np.flatnonzero(found.word)
        out = []
        for table in (self.count, self.part):
            total = np.zeros((len(texts), len(LANGS)))
            np.add.at(total, row[hit], table[found.word[hit].astype(np.int64)])
            out.append(total)
        return out[0], out[1]

    def of(self, texts: list[str], least: float = 2, lead: float = 1.5) -> list[str | None]:
        """The language with most votes of each text, if it has `least` of them and `lead` times as many as the next; else None."""
        count, part = self.votes(texts)
        if not texts:
            return []
        best = part.argmax(axis=1)
        at = np.arange(len(texts))
        top, most = part[at, best], count[at, best]
        part[at, best] = 0
        sure = (top > 0) & (most >= least) & (top >= lead * part.max(axis=1))
        return [LANGS[b] if ok else None for b, ok in zip(best, sure, strict=True)]
