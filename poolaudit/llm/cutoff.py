"""Problem 5: texts cut off by field limits, by a backward character n-gram model.

For the last characters of a text the model compares how often they end a text with how often they go on: the log-odds of
(end | context) with back-off to shorter contexts, at last to the last character in all languages, so that the only text of
a language isn't judged without any evidence. Contexts are counted over all texts of the column, per language and kind of
segment: prose, or an entry of a list, where each finished line is an end. Phrases and sign-offs may end without a mark; there
the model is asked whether a word ends: how often the last characters end a word in any text, and how often it goes on. Counts lie
in fixed tables of hashed contexts, so that what is gathered and broadcast is bounded by 2 * LEVELS * HASHES * 2 * BUCKETS
numbers at any size; of a context's HASHES counters the smallest holds. Copies of a text count once, and a text's own end isn't
counted for itself, so that no group of copies vouches for its own end. The threshold of each language and kind is the deepest
valley between the two modes of the log-odds of all its distinct texts.

Of what lies outside the final context - open brackets, quotes, code fences, rows of a table, severed escapes, separators
that announce another entry - a delimiter scan tells; names, numbers, labels may end without a mark.

Texts are read in one Python pass, over distinct texts; training and scoring take the segments that it wrote.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolaudit.llm.lang import LANGS, Languages, stopword_lists
from poolaudit.llm.words import mix
from poolaudit.storage import materialise

ORDERS = 4
LEVELS = ORDERS + 1
BUCKETS = 1 << 18
HASHES = 2
#: Weight of the shorter context's estimate.
BACKOFF = 4.0
#: A class is a language, or none, and a kind.
KINDS = ["prose", "entry", "phrase", "sign-off"]
#: Log-odds are put into bins of this width, and thresholds are looked for between these bounds.
BIN, LOW, HIGH, DEFAULT, WIDE = 0.25, -5.0, -1.5, -3.0, 3
#: A single line of at most so many words without a closing mark is asked for the end of a word, a longer one for that of a
#: sentence; the same holds for a last line, after a finished paragraph, that looks like a sign-off.
PHRASE_WORDS, SIGNED_WORDS = 4, 8

_MARKS = ".!?…。！？؟‽"
_CLOSERS = "\"'”’»)]}*_`›“ "
_ENTRY = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])(?:\s+(.*))?$", re.DOTALL)
_ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:#x?[0-9a-fA-F]{0,5}|[a-z]{2,6})|(?:%[0-9A-Fa-f]{2})+%[0-9A-Fa-f]?|[^\W\d]%[0-9A-Fa-f]?)$")
_LETTER = re.compile(r"[^\W\d_]")
_LABEL = re.compile(r"\s*[^\W\d_]+(?: [^\W\d_]+)?:")
_SIGNED = re.compile(r"\s*(?:[—–~―]|--|[^\W\d_]+(?: [^\W\d_]+)?[,:])\s*\S")
# Words that need another one after them.
DANGLING = frozenset(
    "a an the of and or to in on at by with for from into der die das den dem des ein eine einen einem einer und oder zu auf mit von bei für le la les un une des de du et ou à dans par pour sur au aux el los las una unos unas y o en con por para del al и в на с у к о из под для или".split()
)
# Of these, such as no phrase and no sentence ends in.
ARTICLES = frozenset("a an the of and or einen einem einer und oder le les une du et ou el los las unos unas y del и или".split())
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»"}
_SHUT = {v: k for k, v in _OPEN.items()}
_BRACKET = re.compile("[" + re.escape("".join([*_OPEN, *_SHUT])) + "]")


def unclosed(text: str) -> bool:
    """Whether a code fence, a bracket, a quotation or a bold span is still open at the end."""
    if text.count("```") % 2:
        return True
    if "```" in text:
        text = re.sub(r"```.*?```", " ", text, flags=re.DOTALL)
    if text.count("**") % 2 or text.count('"') % 2:
        return True
    stack: list[str] = []
    for c in _BRACKET.findall(text):
        if c in _OPEN:
            stack.append(c)
        elif c in _SHUT and _SHUT[c] in stack:
            while stack.pop() != _SHUT[c]:
                pass
    return bool(stack)


def _bare(text: str) -> str:
    """The text without closing quotes, brackets, emphasis, symbols and blanks at its end."""
    end = len(text)
    while end and (text[end - 1] in _CLOSERS or text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("So", "Sk", "Cf", "Mn", "Cs", "Cn")):
        end -= 1
    return text[:end]


def segment(text: str | None) -> tuple[bool | None, str | None, str]:
    """(verdict, kind, segment): verdict is True (cut) or False where the structure tells, else None, and the model decides
    on the end of the segment of that kind. A null, empty or blank text isn't cut."""
    if text is None or not text.strip():
        return False, None, ""
    text = text.rstrip()
    if text[-1] == "�" or _ESCAPE.search(text[-16:]) or unclosed(text):
        return True, None, ""
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if not _LETTER.search(plain):  # numbers and marks
        return bool(re.search(r"\d\s*[,;|/\-–]$", plain)), None, ""
    if text[0] in "{[" and text[-1] in "}]" or text.endswith("```"):
        return False, None, ""
    lines = text.split("\n")
    last = lines[-1]
    if last.lstrip().startswith("|"):
        first = next((x for x in lines if x.lstrip().startswith("|")), last)
        return not last.rstrip().endswith("|") or last.count("|") < first.count("|"), None, ""
    entry = _ENTRY.match(last)
    if entry and len(lines) > 1 and (_ENTRY.match(lines[-2]) or lines[-2].rstrip().endswith(":")):
        if not (entry[1] or "").strip() or entry[1].split()[-1].casefold() in DANGLING:
            return True, None, ""
        return None, "entry", entry[1]
    bare = _bare(text)
    if not bare:
        return False, None, ""
    if bare[-1] in _MARKS:
        return None, "prose", text
    if bare[-1] in ",;-–—/&":
        return True, None, ""
    if bare[-1] == ":":  # a label on its own is no sentence
        return not _LABEL.fullmatch(last.strip()), None, ""
    final, word = bare.split()[-1].casefold(), bare[-1].isalpha()  # a number may end at any digit
    if final in ARTICLES:
        return True, None, ""
    dangling = final in DANGLING
    if len(lines) > 1 and len(last.split()) <= SIGNED_WORDS and _SIGNED.match(last):
        before = _bare("\n".join(lines[:-1]))
        if before and before[-1] in _MARKS:
            return (None, "prose", text) if dangling else (None, "sign-off", text) if word else (False, None, "")
    if len(lines) == 1 and not dangling:
        label = _LABEL.match(text)
        if len((text[label.end() :] if label else text).split()) <= PHRASE_WORDS:
            return (None, "phrase", text) if word else (False, None, "")
    return None, "prose", text


def _flat(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the parts, and the length of each."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for c in _MARKS[1:]:  # contexts tell a closing mark from other characters, not from one another
        chars[chars == ord(c)] = ord(_MARKS[0])
    return chars, lens


def _contexts(chars: np.ndarray, place: np.ndarray, classes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number of level and hash, buckets) of the contexts that end at the characters `at`; place: of each character in its part;
    classes: of each of `at`. Level 0 is the last character in all languages of the kind, the others are the orders within the
    class."""

    def stirred(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(31)
        return h

    def start(kind: np.ndarray) -> np.ndarray:
        return mix(kind.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(7))

    last = chars[at]
    levels = [stirred(start(classes % len(KINDS) + (len(LANGS) + 1) * len(KINDS)), last)]
    h = start(classes)
    for k in range(LEVELS):
        if k:
            back = last if k == 1 else np.where(place[at] < k - 1, np.uint64(0), chars[at - (k - 1)])
            h = stirred(h, back + np.uint64(k << 32))
        own = h if k else levels[0]
        for j in range(HASHES):
            yield k * HASHES + j, (own >> np.uint64(24 * j) & np.uint64(BUCKETS - 1)).view(np.int64)


def _letters(chars: np.ndarray) -> np.ndarray:
    """Which characters belong to words: letters, digits, and marks on letters."""
    kinds, at = np.unique(chars, return_inverse=True)
    return np.fromiter((unicodedata.category(chr(int(c)))[0] in "LNM" for c in kinds), bool, len(kinds))[at]


def text_key(column: str) -> F.Column:
    """Equal for texts that differ in blanks only."""
    lines = F.regexp_replace(F.regexp_replace(column, r"[^\S\n]+", " "), r" ?\n\s*", "\n")
    return F.xxhash64(F.regexp_replace(lines, r"^\s+|\s+$", ""))


SEGMENTS = "text bigint, cut boolean, class int, tail string, parts array<string>"


def segments(df: DataFrame, column: str) -> DataFrame:
    """SEGMENTS of the distinct texts of a column: text (its key), cut (by structure, else null), class (-1 without a question to
    the model), tail (the last characters of the segment), parts (what the model learns from: whole prose, or the entries of a
    list, of which all but the last are finished). Written once."""
    lists = stopword_lists(df.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(lists)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            found = [segment(t) for t in texts]
            kinds = [k for _, k, _ in found]
            spoken = languages.of([text if kind == "entry" else part for text, (_, kind, part) in zip(texts, found, strict=True)], least=1, lead=1.0)
            classes = [-1 if k is None else (LANGS.index(lang) if lang else len(LANGS)) * len(KINDS) + KINDS.index(k) for k, lang in zip(kinds, spoken, strict=True)]
            tails, parts = [], []
            for text, (_, kind, part) in zip(texts, found, strict=True):
                if kind == "entry":
                    tails.append(part.strip()[-ORDERS:])
                    parts.append([m[1].strip() for line in text.rstrip().split("\n") if (m := _ENTRY.match(line)) and (m[1] or "").strip()])
                else:
                    whole = _bare(part) or part
                    tails.append(whole[-ORDERS:])
                    parts.append([whole] if kind else [])
            columns = [batch.column("text"), pa.array([v for v, _, _ in found], pa.bool_()), pa.array(classes, pa.int32()), pa.array(tails, pa.string()), pa.array(parts, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "cut", "class", "tail", "parts"])

    distinct = df.where(F.col(column).isNotNull()).groupBy(text_key(column).alias("text")).agg(F.min(column).alias(column))
    return materialise(distinct.mapInArrow(scan, SEGMENTS), "p5segments")


def train(found: DataFrame) -> np.ndarray:
    """Counts [ends of texts or of words, level and hash, end or continuation, bucket] over all segments()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, LEVELS * HASHES, 2, BUCKETS), np.int64)
        for batch in batches:
            sizes = batch.column("parts").value_lengths().to_numpy()
            parts = batch.column("parts").flatten().to_pylist()
            if not parts:
                continue
            classes = np.repeat(batch.column("class").to_numpy(), sizes)
            chars, lens = _flat(parts)
            stops = np.cumsum(lens)
            place = np.arange(len(chars)) - np.repeat(stops - lens, lens)
            end = np.zeros(len(chars), bool)
            end[stops - 1] = True
            letter = _letters(chars)
            # What follows a part isn't known, so its last word says nothing.
            own = np.cumsum(~letter)
            inside = letter & (own != np.repeat(own[stops - 1], lens))
            kind = np.repeat(classes, lens)
            for which, of, stop in ((0, np.isin(kind % len(KINDS), [0, 1]), end), (1, inside, np.append(~letter[1:], True))):
                at = np.flatnonzero(of)
                goes_on = (~stop[at]).astype(np.int64) * BUCKETS
                for i, bucket in _contexts(chars, place, kind[at] if which == 0 else np.zeros(len(at), np.int64), at):
                    total[which, i] += np.bincount(bucket + goes_on, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "n"])

    counts = found.where("class >= 0").select("class", "parts").mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    model = np.zeros(2 * LEVELS * HASHES * 2 * BUCKETS, np.float32)
    model[counts["at"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float32)
    return model.reshape(2, LEVELS * HASHES, 2, BUCKETS)


def log_odds(tails: list[str], classes: np.ndarray, model: np.ndarray) -> np.ndarray:
    """log P(end | context) / P(continuation | context) at the end of each tail; a text's own end is left out."""
    out = np.zeros(len(tails))
    of_words = classes % len(KINDS) >= 2
    for words, own in ((0, 1), (1, 0)):  # a text's last word isn't counted, as nothing follows it
        at = np.flatnonzero(of_words == bool(words))
        if not len(at):
            continue
        chars, lens = _flat([tails[i] for i in at])
        stops = np.cumsum(lens)
        place = np.arange(len(chars)) - np.repeat(stops - lens, lens)
        hashed = dict(_contexts(chars, place, np.zeros(len(at), np.int64) if words else classes[at].astype(np.int64), stops - 1))
        p = np.full(len(at), 0.01)
        for k in range(LEVELS):
            both = range(k * HASHES, (k + 1) * HASHES)
            end = np.maximum(np.min([model[words, i, 0, hashed[i]] for i in both], axis=0) - own, 0)
            on = np.min([model[words, i, 1, hashed[i]] for i in both], axis=0)
            p = (end + BACKOFF * p) / (end + on + BACKOFF)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        out[at] = np.log(p / (1 - p))
    return out


def scored(df: DataFrame, column: str = "completion") -> DataFrame:
    """text, cut, class and odds of the distinct texts of a column; written once."""
    found = segments(df, column)
    shared = df.sparkSession.sparkContext.broadcast(train(found))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column("class").to_numpy()
            odds = np.zeros(len(classes))
            at = np.flatnonzero(classes >= 0)
            tails = batch.column("tail").to_pylist()
            odds[at] = log_odds([tails[i] for i in at], classes[at], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("cut"), batch.column("class"), pa.array(odds)], names=["text", "cut", "class", "odds"])

    return materialise(found.select("text", "cut", "class", "tail").mapInArrow(score, "text bigint, cut boolean, class int, odds double"), "p5scores")


def thresholds(texts: DataFrame) -> dict[int, float]:
    """Of each class the valley of its log-odds: of the bins between LOW and HIGH the emptiest, by triangular weights over WIDE
    bins on each side; the middle one of equals."""
    bins = texts.where("class >= 0 and cut is null").groupBy("class", F.floor(F.col("odds") / F.lit(BIN)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # classes times bins: bounded
    out = {}
    span = range(int(LOW / BIN), int(HIGH / BIN))
    for k, x in bins.groupby("class"):
        n = dict(zip(x["bin"], x["n"], strict=True))
        smooth = {b: sum((WIDE + 1 - abs(j)) * n.get(b + j, 0) for j in range(-WIDE, WIDE + 1)) for b in span}
        least = min(smooth.values())
        equal = [b for b in span if smooth[b] == least]
        out[int(k)] = BIN * (equal[len(equal) // 2] + 0.5)
    return out


def cut_texts(df: DataFrame, column: str = "completion") -> DataFrame:
    """text: keys of the distinct texts of a column that were cut. Jobs run while the frame is built: segments, the model, scores
    and thresholds."""
    texts = scored(df, column)
    limit = F.lit(DEFAULT)
    for k, t in sorted(thresholds(texts).items()):
        limit = F.when(F.col("class") == k, F.lit(t)).otherwise(limit)
    return texts.where(F.coalesce(F.col("cut"), F.col("odds") < limit)).select("text")


def cut_rows(df: DataFrame) -> DataFrame:
    """row_idx of the rows of df whose completion was cut; nulls, empty and blank texts aren't, an empty table gives none."""
    return df.select("row_idx", text_key("completion").alias("text")).join(cut_texts(df).hint("merge"), "text", "left_semi").select("row_idx")


def rates(df: DataFrame) -> DataFrame:
    """Rows, cut rows and their rate of each source (a null source is one of its own)."""
    rows = df.select("source", text_key("completion").alias("text")).groupBy("source", "text").agg(F.count(F.lit(1)).alias("k"))
    cut = cut_texts(df).withColumn("cut", F.lit(True))
    n_cut = F.coalesce(F.sum(F.when(F.col("cut"), F.col("k"))), F.lit(0))
    out = rows.join(cut.hint("merge"), "text", "left").groupBy("source").agg(F.sum("k").alias("n"), n_cut.alias("n_cut"))
    return out.withColumn("cut_rate", F.col("n_cut") / F.col("n"))
