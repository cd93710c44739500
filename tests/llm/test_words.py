import random

from helpers import key

from poolaudit.llm.words import WordHashes, batch_words, named_fields, plain, words


def test_words():
    assert words("Straße_ＡＢＣ​ x2, é!") == ["strasse", "abc", "x2", "é"]
    assert words(None) == [] and words("") == [] and words(" ,;") == []


def test_words_of_a_batch_are_those_of_each_text():
    rng = random.Random(1)
    alphabet = "ab Cß_1,.é\ń​ﬁ\x00ǅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", " ", "\x00", "a\x00b"]
    hashes = WordHashes()
    found = batch_words(texts, hashes)
    at = 0
    for t, n in zip(texts, found.size, strict=True):
        assert [int(h) for h in found.word[at : at + n]] == [hashes[w] for w in words(t)]
        at += n
    assert at == len(found.word) and not len(batch_words([], hashes).size)


def test_layouts_of_one_record_have_one_key():
    a = "The quick brown fox jumps over the lazy dog."
    assert key(a) == key("the  QUICK\nbrown fox; jumps over the lazy dog!!") != key("The quick brown fox jumps over the dog lazy.")
    f = '{"home": "old mill of Bura", "tool": "9 ropes", "rank": "Lemvik"}'
    assert key(f) == key("tool=9 ropes; rank=LEMVIK; home=old mill of Bura") == key("Rank: Lemvik\nHome: old mill of Bura\nTool: 9 ropes\n") == key('{" tool":"9  ropes ","home":"old mill of Bura","rank":"Lemvik"}')
    assert key(f) != key('{"home": "9 ropes", "tool": "old mill of Bura", "rank": "Lemvik"}')


def test_names_of_any_length_and_single_fields():
    assert key("the place where they live: old mill; what they own: ropes") == key("what they own = ropes\nthe place where they live = old mill")
    assert key('{"home of bura": "an old mill by the water"}') == key("Home of Bura: an old mill by the water")


def test_what_is_not_made_of_named_fields():
    for t in ("a: b", '{"a": "b"}', '{"a": 1}', '{"a": "b"', "[1]", "He said: go\nand left", "", "{}", ": x\nb: c"):
        assert named_fields(plain(t)) is None
