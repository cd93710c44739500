"""Problem 4: broken prompt and response pairs.

Each pair gets at most one defect, in this order: empty, refusal, copy, language, truncated.

* copy: a suffix automaton of the prompt's words is traversed with the response; stretches of at least MIN_STRETCH words
  found in the prompt are copied. A response is a copy if nearly all of it is copied and it gives back most of the prompt or of
  one of its paragraphs.
* refusal: see refusal.py; an Aho-Corasick automaton finds the parts of a refusal.
* language: stopword votes of the response, without quotations and code, against the language that the prompt asks for or,
  if it asks for none, is written in.
* truncated: the delimiter stacks and the backward n-gram model of problem 5.

One pass in Python over the pairs, in which prompts and responses are split into words once; nothing grows with the table but
the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolaudit.llm import cutoff
from poolaudit.llm.lang import Languages, own_words, stopword_lists
from poolaudit.llm.refusal import is_refusal
from poolaudit.llm.words import batch_tokens, words

MIN_STRETCH = 2
#: Shares of the response that must be copied, and of the prompt's question that must be given back.
COPIED, RETURNED = 0.8, 0.6

# Words that stand for a missing answer, and labels before an answer, after words().
MISSING = {
    "null", "none", "nil", "nan", "na", "n a", "tbd", "tba", "todo", "to do", "empty", "blank", "missing", "undefined", "unknown", "void",
    "no answer", "no response", "no output", "no completion", "no reply", "no content", "not available", "not applicable", "not provided", "not answered", "no answer given",
    "answer missing", "missing answer", "empty response", "placeholder", "keine antwort", "leer", "sin respuesta", "vacio", "vacío", "sans réponse", "pas de réponse", "aucune réponse", "vide", "нет ответа", "пусто",
}
LABELS = {
    "a", "q", "answer", "response", "completion", "output", "reply", "result", "assistant", "question", "prompt", "input", "user", "instruction", "antwort", "frage", "respuesta",
    "pregunta", "réponse", "question posée", "ответ", "вопрос", "note", "the answer", "final answer",
}

# Names of languages in requests, by language.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles английский английском английски", "de": "german deutsch allemand alemán aleman немецкий немецком немецки", "fr": "french französisch français francais francés frances французский французском французски",
    "es": "spanish spanisch espagnol español espanol испанский испанском испански", "ru": "russian russisch russe ruso русский русском русски", "it": "italian italienisch italien italiano", "pt": "portuguese portugiesisch portugais portugués", "nl": "dutch niederländisch néerlandais holandés", "sv": "swedish schwedisch suédois sueco", "da": "danish dänisch danois danés", "no": "norwegian norwegisch norvégien noruego", "tr": "turkish türkisch turc turco", "zh": "chinese chinesisch chinois chino", "ja": "japanese japanisch japonais japonés", "el": "greek griechisch grec griego", "ar": "arabic arabisch arabe árabe",
}
_NAMED = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
_REQUEST = re.compile(
    r"\b(?:(?:translate|übersetze|traduis|traduisez|traduce|traduzca|переведи(?:те)?)\b[^.:\n]{0,60}?\b(?:into|to|in|auf|ins|en|al|на)|(?:answer|reply|respond|write|antworte|schreibe|réponds|répondez|responde|responda|ответь(?:те)?|in|auf|en|на|по)\b(?:\s+(?:in|auf|en|на|по))?)[\s-]+([^\W\d_]+)\b",
    re.IGNORECASE,
)
_MARKUP = re.compile(r"<[^<>\n]{0,40}>|```\w*|&nbsp;")
_MAY_BE_MARKUP = re.compile("[<`&]")
#: Words of the longest phrase in MISSING.
_LONGEST = max(len(x.split()) for x in MISSING)


def is_empty(text: str | None, tokens: list[str]) -> bool:
    """Null, or nothing but blanks, marks, markup, a label, or a word that stands for a missing answer. tokens: words(text)."""
    if text is None:
        return True
    found = tokens
    if _MAY_BE_MARKUP.search(text):
        found = words(_MARKUP.sub(" ", text))
        if not found:
            found = [w for w in tokens if w not in ("p", "br", "div", "span", "code", "python", "text", "json", "html", "nbsp")]
    at = 0
    while at < len(found) and found[at] in LABELS and (at < len(found) - 1 or text.rstrip().endswith(":")):
        at += 1
    if len(found) - at > _LONGEST:
        return False
    rest = " ".join(found[at:])
    # "None." may answer a question; without the full stop it is a value that is missing.
    return not rest or rest in MISSING and not (rest in ("none", "unknown") and text.rstrip().endswith("."))


class SuffixAutomaton:
    """Of a sequence of words: each state has its transitions, its link and its longest length."""

    def __init__(self, sequence: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in sequence:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def copied(self, response: list[str], least: int) -> list[bool]:
        """Which words of the response lie in a stretch of at least `least` words that occurs in the sequence."""
        out = [False] * len(response)
        state = length = 0
        for i, w in enumerate(response):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                length = 0
            if length >= least:
                out[i - length + 1 : i + 1] = [True] * length
        return out


def is_copy(prompt: list[str], paragraphs: list[list[str]], response: list[str]) -> bool:
    """Gives back the prompt, perhaps with slight changes and more than once, and adds no answer; words of the whole prompt, of
    each of its paragraphs, and of the response."""
    while response and response[0] in LABELS and response[:1] != prompt[:1]:
        response = response[1:]
    while response and response[-1] in LABELS and response[-1:] != prompt[-1:]:
        response = response[:-1]
    n = len(response)
    if n < 3:
        return False
    known = set(prompt)
    if sum(w in known for w in response) < COPIED * n - 1:
        return False
    taken = SuffixAutomaton(prompt).copied(response, MIN_STRETCH)
    # A word between two copied stretches is a slight change.
    for i in range(1, n - 1):
        if not taken[i] and taken[i - 1] and taken[i + 1]:
            taken[i] = True
    if sum(taken) < COPIED * n:
        return False
    given = SuffixAutomaton(response)
    return any(sum(given.copied(part, MIN_STRETCH)) >= RETURNED * len(part) for part in [prompt, *paragraphs] if len(part) >= 3)


def asked_language(prompt: str) -> str | None:
    """The language that a prompt asks for by its name."""
    for m in _REQUEST.finditer(prompt):
        if lang := _NAMED.get(m[1].casefold()):
            return lang
    return None


def _split(texts: list[str]) -> list[list[str]]:
    """words() of each text, by one scan."""
    out, at = [], 0
    flat, sizes = batch_tokens(texts)
    for n in sizes:
        out.append(flat[at : at + n])
        at += n + 1
    return out


def _main(text: str) -> str:
    """The longest paragraph: an opening such as "Here you go." isn't the answer."""
    return max(text.split("\n\n"), key=len) if "\n\n" in text else text


def judge(prompts: list[str | None], completions: list[str | None], languages: Languages) -> list[str | None]:
    """The defect of each pair, but for truncation. A null or blank prompt has no language and can't be copied."""
    asked, answered = _split([p or "" for p in prompts]), _split([c or "" for c in completions])
    out: list[str | None] = []
    open_ = []
    for i, (p, c) in enumerate(zip(prompts, completions, strict=True)):
        found = None
        if is_empty(c, answered[i]):
            found = "empty"
        elif is_refusal(c, answered[i], languages.known):
            found = "refusal"
        elif p and p.strip():
            paragraphs = [words(x) for x in p.strip().split("\n\n")] if "\n\n" in p.strip() else []
            if is_copy(asked[i], paragraphs, answered[i]):
                found = "copy"
            else:
                open_.append(i)
        out.append(found)
    written = languages.of([own_words(prompts[i]) for i in open_], least=1, lead=1.2)
    got = languages.of([_main(own_words(completions[i])) for i in open_], least=2, lead=1.25)
    for i, w, g in zip(open_, written, got, strict=True):
        want = asked_language(prompts[i]) or w
        if want and g and want != g:
            out[i] = "language"
    return out


def defects(rows: DataFrame) -> DataFrame:
    """(row_idx, defect) of each broken pair. An empty table gives no rows, repeated rows come out each; ties can't occur, as
    the order of the defects decides. Extra columns aren't read. Jobs run while the frame is built: see cutoff.cut_texts()."""
    lists = stopword_lists(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(lists)
        for batch in batches:
            found = judge(batch.column("prompt").to_pylist(), batch.column("completion").to_pylist(), languages)
            yield pa.RecordBatch.from_arrays([batch.column("row_idx"), batch.column("text"), pa.array(found, pa.string())], names=["row_idx", "text", "found"])

    kept = rows.select("row_idx", "prompt", "completion", cutoff.text_key("completion").alias("text"))
    judged = kept.mapInArrow(run, "row_idx bigint, text bigint, found string")
    cut = cutoff.cut_texts(rows).withColumn("cut", F.lit("truncated"))
    return judged.join(cut.hint("merge"), "text", "left").select("row_idx", F.coalesce("found", "cut").alias("defect")).where("defect is not null")
