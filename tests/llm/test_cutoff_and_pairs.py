"""Problems 4 and 5."""

import random

import pytest
from refusals import ANSWERS, HELD_OUT_ANSWERS, HELD_OUT_REFUSALS, REFUSALS

from poolaudit.llm import cutoff, pairs
from poolaudit.llm.lang import Languages, stopword_lists
from poolaudit.llm.pairs import SuffixAutomaton, asked_language, is_copy, is_empty, judge
from poolaudit.llm.refusal import is_refusal
from poolaudit.llm.words import words

NOUNS = "harbour lantern meadow orchard kettle bridge garden window market river".split()


@pytest.fixture(scope="module")
def languages(spark):
    return Languages(stopword_lists(spark))


def sentence(rng):
    return rng.choice(
        ["The {0} near the {1} was painted before the {2} opened.", "Most visitors walked from the {0} to the {1} and rested by the {2}.", "Nobody knew why the {0} had been moved behind the {1}.", "In spring they cleaned the {0}, the {1} and the {2}."]
    ).format(*rng.sample(NOUNS, 3))


def test_structure():
    for whole in (None, "", "  ", "12, 13, 14", "[1, 2]", '{"a": "b"}', "| a | b |\n|---|---|\n| c | d |", "```python\nx = 1\n```", "Fine.\n\nSource: page 12", "A:"):
        assert cutoff.segment(whole)[0] is False, whole
    for cut in ("12, 13, ", "(12, 13", '{"a": "b', "```python\nx = 1", "It was \\u00", "exactl&#82", "br�", "1. one\n2. two\n3.", "| a | b |\n|---|---|\n| c |", 'He said "no', "They left it at home,", "**bold and", "1. one\n2. a ", "They went and saw the"):
        assert cutoff.segment(cut)[0] is True, cut
    assert cutoff.segment("It was long ago. Then the bri")[:2] == (None, "prose")
    assert cutoff.segment("- one two\n- three fo")[:2] == (None, "entry")
    for t in ("a grey heron", "Answer: the limpet", "A red fox jum"):
        assert cutoff.segment(t)[:2] == (None, "phrase")
    for t in ("It went well.\n\nYours, the keepers of Bura", "Fine.\n— the keepers", "It went well.\n\nHowever, the keeper of th"):
        assert cutoff.segment(t)[:2] == (None, "sign-off")


def test_phrases_and_sign_offs_cut_within_a_word(spark):
    """No verdict by the number of words: the model tells whether the last word has ended."""
    rng = random.Random(11)
    rows = [(i, " ".join(sentence(rng) for _ in range(3)) + f" A red fox jumped over the {rng.choice(NOUNS)}.", "s") for i in range(1500)]
    whole = [f"the old {n}" for n in NOUNS] + [f"{sentence(rng)}\n\nYours, the keepers of the {n}" for n in NOUNS]
    cut = ["A red fox jum", "the old lante", "Answer: the harbo", f"{sentence(rng)}\n\nHowever, the keeper of th", f"{sentence(rng)}\n\nYours, the keepers of the orcha"]
    rows += [(5000 + i, t, "whole") for i, t in enumerate(whole)] + [(6000 + i, t, "cut") for i, t in enumerate(cut)]
    df = spark.createDataFrame(rows, "row_idx bigint, completion string, source string")
    rates = {r.source: r.cut_rate for r in cutoff.rates(df).collect()}
    assert rates == {"s": 0.0, "whole": 0.0, "cut": 1.0}


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    rows, cut = [], set()
    for i in range(3000):
        t = " ".join(sentence(rng) for _ in range(rng.randint(1, 4)))
        if i % 8 == 0:
            t = t[: rng.randint(30, len(t) - 3)]
            if t.rstrip()[-1] not in ".":
                cut.add(i)
        elif i % 8 == 1:
            t = rng.choice(["- ", "* "]) + f"\n{rng.choice(['- ', '* '])}".join(f"the old {n}" for n in rng.sample(NOUNS, 4))
        rows.append((i, t, f"s{i % 2}"))
    df = spark.createDataFrame(rows, "row_idx bigint, completion string, source string").selectExpr("*", "1 as odds", "2 as class", "3 as cut")
    got = {r.row_idx for r in cutoff.cut_rows(df).collect()}
    assert len(got & cut) >= 0.98 * len(cut) and len(got - cut) <= 0.02 * len(cut)
    rates = {r.source: r for r in cutoff.rates(df).collect()}
    assert sum(r.n for r in rates.values()) == 3000 and rates["s0"].n_cut == len(got)


def test_a_cut_text_that_recurs(spark):
    """Copies of a cut text, a third of the rows, one of them with other blanks, don't vouch for one another's end."""
    rng = random.Random(8)
    whole = [" ".join(sentence(rng) for _ in range(rng.randint(1, 3))) for _ in range(800)]
    cut = ["Most visitors walked from the harbour to the mead", "Nobody knew why the lant"]
    rows = [(i, t, "s") for i, t in enumerate(whole)]
    rows += [(1000 + i, cut[0] if i else cut[0].replace(" from", "  from"), "hot") for i in range(400)]
    rows += [(2000 + i, cut[1], "few") for i in range(6)]
    rows += [(3000 + i, "Yes.", "s") for i in range(50)]  # whole, and the only text of no known language
    df = spark.createDataFrame(rows, "row_idx bigint, completion string, source string")
    got = {r.row_idx for r in cutoff.cut_rows(df).collect()}
    assert got == {i for i, _, s in rows if s != "s"}
    assert {r.source: r.cut_rate for r in cutoff.rates(df).collect()} == {"s": 0.0, "hot": 1.0, "few": 1.0}


def test_defects(languages):
    def defect(p, c):
        return judge([p], [c], languages)[0]

    q = "Why was the old mill of Bura painted before the rains came?"
    cases = {
        "empty": [None, "", " \n", "?", "—", "{}", "[]", "<p></p>", "```\n```", '""', "​", "Answer:", "N/A", "null", "no answer", "TBD", "<empty>", "(blank)"],
        "refusal": ["I'm sorry, but I can't help with that mill.", "Unfortunately, I must decline to write about the mill. Thank you for understanding.", "Leider möchte ich diese Frage nicht beantworten.", "Désolé, mais cette demande dépasse mon rôle.", "К сожалению, я не могу ответить на вопрос про Drulis."],
        "copy": [q, q.upper(), f"Question: {q}", f"{q}\nA:", q.replace("old ", ""), f"{q} {q}", f"{q} {q} {q}", f"{q}\n\n{q}\n{q} {q}"],
        "language": ["Le vieux moulin a été peint parce que les gens de la ville le voulaient.", "Der Turm wurde gebaut und danach hat man ihn nicht mehr gesehen."],
        None: ["Yes.", "No.", "heron", "12, 13", "The keepers wanted it to be seen from the road.", "I can't promise the date, but here is what is known. The mill was painted in spring by two keepers.", 'The clerk said "I cannot help with that" and closed the mill for the whole winter.', f"{q} The keepers wanted it to be seen from the road.", 'An old saying there goes "Le vieux moulin a été peint parce que les gens le voulaient" and they repeat it to all of the visitors.', "the old mill"],
    }
    for want, texts in cases.items():
        for t in texts:
            assert defect(q, t) == want, (want, t, defect(q, t))
    assert defect(None, "The mill is old and it was painted.") is None and defect("", None) == "empty"
    assert is_empty("None", ["none"]) and not is_empty("None.", ["none"]) and not is_refusal("No.", ["no"], set())
    assert is_empty("Answer: Response: no answer given", words("Answer: Response: no answer given"))
    context = "Which town is meant?\n\nThe old mill stood by the river of Bura and was painted by two keepers in spring."
    assert defect(context, "The old mill stood by the river of Bura and was painted by two keepers in spring.") == "copy"
    assert defect(context, "Bura.") is None


def test_refusals(languages):
    def found(texts):
        return {t for t in texts if is_refusal(t, words(t), languages.known)}

    assert len(found(REFUSALS)) >= len(REFUSALS) - 1 and found(ANSWERS) == set()
    # As measured when the parts were last changed; not a goal.
    assert len(found(HELD_OUT_REFUSALS)) >= 25 and len(found(HELD_OUT_ANSWERS)) <= 2


def test_asked_language(languages):
    assert asked_language("Translate into French: The mill is old.") == "fr"
    assert asked_language("Answer in German. Why was the mill painted?") == "de"
    assert asked_language("Is English spoken there?") is None
    texts = ["¿Por qué fue pintado el molino?", "12 13", "Il mulino è stato dipinto perché la gente lo voleva.", "Kvarnen målades eftersom de som bodde där ville det.", "Değirmen neden boyandı ama bu çok eski.", "这座磨坊为什么被粉刷？", "この水車小屋はとても古いです。", "Почему мельница?", "طاحونة قديمة جدا"]
    assert languages.of(texts, least=1, lead=1.0) == ["es", None, "it", "sv", "tr", "zh", "ja", "ru", "ar"]
    english = "Why was the old mill of Bura painted before the rains came?"
    assert [judge([english], [t], languages)[0] for t in texts[2:6]] == ["language"] * 4


def test_suffix_automaton_against_all_substrings():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        least = rng.randint(1, 3)
        inside = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + least, len(a) + 1)}
        want = [any(tuple(b[i:j]) in inside for i in range(k + 1) for j in range(k + 1, len(b) + 1)) for k in range(len(b))]
        assert SuffixAutomaton(a).copied(b, least) == want
    assert not is_copy(words("Who?"), [], words("Who is it?"))


def test_broken_pairs_end_to_end(spark):
    rng = random.Random(6)
    rows = [(i, "Why is the harbour so old?", sentence(rng)) for i in range(400)]
    rows += [(1000, "Why?", None), (1001, "Why is the harbour so old?", "Why is the harbour so old?"), (1002, None, sentence(rng)[:36]), (1003, "Why?", None)]
    df = spark.createDataFrame(rows, "row_idx bigint, prompt string, completion string").selectExpr("*", "1 as found", "'x' as defect")
    got = {r.row_idx: r.defect for r in pairs.defects(df).collect()}
    assert got == {1000: "empty", 1001: "copy", 1002: "truncated", 1003: "empty"}
    assert pairs.defects(df.limit(0)).count() == 0
    assert cutoff.cut_rows(df.limit(0).selectExpr("*", "'s' as source")).count() == 0
