"""Problems 6 to 8."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poolaudit.llm import mixing, pieces, tokens
from poolaudit.llm.pieces import Kinds, split

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.vocabulary()), reason="no vocabulary here")


@pytest.fixture(scope="module")
def bpe():
    return tokens.byte_pairs(tokens.vocabulary())


@pytest.fixture(scope="module")
def other(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n'sé漢🙂1", max_size=200))
def test_ids_equal_another_implementation_and_round_trip(bpe, other, text):
    ids = bpe.encode(text)
    assert ids == other.encode_ordinary(text)
    assert b"".join(bpe.bytes_of(i) for i in ids).decode() == text
    assert bpe.count(text) == len(ids)


def test_both_ways_of_merging_agree(bpe, other):
    rng = random.Random(1)
    for n in (1, 2, 30, 96, 97, 400, 3000):
        data = "".join(rng.choice("abcdeé漢") for _ in range(n)).encode()
        assert bpe._heap(data) == bpe._scan(data) == other.encode_ordinary(data.decode())


def test_token_ids_of_a_table(spark, other):
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (1, "again"), (4, "x" * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got == sorted((i, other.encode_ordinary(t or "")) for i, t in rows)
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_knapsack_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        lengths = rng.sample(range(1, 12), rng.randint(1, 4))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, 40)
        got = mixing.knapsack(lengths, counts, budget)
        best = max(s for k in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(k, lengths, strict=True))) <= budget)
        assert sum(a * b for a, b in got.items()) == best
        assert all(got.get(a, 0) <= c for a, c in zip(lengths, counts, strict=True))


def test_fit_repeats_only_where_single_uses_cannot_reach():
    import numpy as np

    lengths, counts = np.array([3, 5, 1000]), np.array([4, 4, 1])
    take = mixing.fit(lengths, counts, 90, 4)
    assert take.tolist()[2] == 0 and (lengths * take).sum() == 90 and (take <= counts * 4).all()
    take = mixing.fit(lengths, counts, 27, 4)
    assert (lengths * take).sum() == 27 and (take <= counts).all()
    assert (lengths * mixing.fit(lengths, counts, 90, 1)).sum() == 32
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 3000, 200))
        counts = rng.integers(1, 60, len(lengths))
        rest = int(rng.integers(0, (lengths * counts).sum()))
        take = mixing.fit(lengths, counts, rest, 1)
        assert (take <= counts).all() and (take >= 0).all() and rest - 3 <= (lengths * take).sum() <= rest


def documents(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        s = "abc"[min(2, int(rng.expovariate(1)))]
        t = None if i % 50 == 0 else "" if i % 50 == 1 else " ".join(rng.choice("red blue green old mill river stone".split()) for _ in range(rng.randint(1, 80)))
        rows.append((i, s, t))
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as uses", "2 as tokens", "3 as n", "4 as rank")


SOURCES = "source string, target_share double, max_repeats int, max_tokens int, overlap_tokens int"


def test_mix_reaches_its_shares(spark, bpe):
    docs = documents(spark)
    sources = spark.createDataFrame([("a", 0.2, 1, 10, 2), ("b", 0.3, 2, 10, 2), ("c", 0.4, 3, None, None), ("gone", 0.1, 2, 5, 1), ("out", None, None, 5, 1)], SOURCES)
    uses, shares = mixing.mix(docs, sources)
    uses, shares = uses.collect(), {r.source: r for r in shares.collect()}
    assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"].share == 0
    most = {"a": 1, "b": 2, "c": 3}
    assert all(1 <= r.uses <= most[r.source] for r in uses) and len({r.doc_id for r in uses}) == len(uses)
    for s, target in (("a", 2 / 9), ("b", 3 / 9), ("c", 4 / 9)):
        mixed = sum(r.uses * r.tokens for r in uses if r.source == s)
        assert mixed == shares[s].mixed == shares[s].budget
        assert abs(shares[s].share - target) < 1e-3
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.tokens == bpe.count(text[r.doc_id]) for r in uses)
    again = mixing.mix(docs.repartition(7), sources)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, uses))
    assert sorted(map(tuple, mixing.mix(docs, sources, seed=1)[0].collect())) != sorted(map(tuple, uses))


def test_mix_with_a_total_that_a_source_cannot_reach(spark):
    docs = documents(spark)
    sources = spark.createDataFrame([("a", 0.5, 2, 10, 2), ("c", 0.5, 1, 10, 2)], SOURCES)
    shares = {r.source: r for r in mixing.mix(docs, sources, total_tokens=20000)[1].collect()}
    assert shares["c"].mixed == shares["c"].available < 10000 and shares["a"].mixed == 10000
    assert mixing.mix(docs.limit(0), sources)[0].count() == 0
    assert {r.share for r in mixing.mix(docs.limit(0), sources)[1].collect()} == {0.0}


def test_equal_lengths_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    docs = spark.range(300).selectExpr("id as doc_id", "case when id < 200 then 'a' else 'b' end as source", "'one two three' as text")
    sources = spark.createDataFrame([("a", 0.5, 1, 1, 1), ("b", 0.5, 1, 1, 1)], SOURCES)
    uses = mixing.mix(docs, sources)[0].collect()
    assert sum(r.source == "a" for r in uses) == 100 == sum(r.source == "b" for r in uses)


def check(text, most, overlap, kinds, strict=True):
    out = split(text, most, overlap, kinds)
    n = kinds.bpe.count(text)
    if n <= most:
        assert out == []
        return out
    assert out[0][0] == 0 and out[-1][1] == n
    for a, b in zip(out, out[1:], strict=False):
        assert a[0] < b[0] <= a[1] and (a[1] - b[0] == overlap or not strict)
    for s, e, t in out:
        assert 0 < e - s <= most and t in text
    ids = kinds.bpe.encode(text)
    if strict:
        for s, e, t in out:
            assert b"".join(kinds.bpe.bytes_of(i) for i in ids[s:e]).decode() == t
    return out


def test_pieces_keep_limits_and_overlap(bpe):
    kinds, rng = Kinds(bpe), random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["The mill is old. ", "river\n", "\n\n", "stone ", "x" * 40, "1 ", "Nobody knew why. "]) for _ in range(rng.randint(1, 120)))
        most = rng.randint(8, 60)
        check(text, most, rng.randint(0, most // 3), kinds)
    check("x" * 5000, 50, 10, kinds)
    check("漢字🙂" * 400, 31, 7, kinds, strict=False)
    assert split("", 5, 1, kinds) == []


def test_pieces_end_at_topic_breaks(bpe):
    kinds = Kinds(bpe)
    a = "The river carried boats past the harbour. Boats on the river need the harbour. "
    b = "Bakers knead dough before dawn. Dough needs flour and bakers need dough. "
    out = check(a * 6 + "\n\n" + b * 6, 160, 0, kinds)
    assert out[0][2].rstrip().endswith("harbour.") and "Bakers" not in out[0][2]


def test_pieces_of_a_table(spark, bpe):
    docs = spark.createDataFrame([(1, "a", "one two three. " * 20), (2, "a", "short"), (3, "a", None), (4, None, "x " * 99), (5, "none", "x " * 99), (6, "c", "x " * 99)], "doc_id bigint, source string, text string").selectExpr("*", "1 as piece", "2 as max_repeats")
    sources = spark.createDataFrame([("a", 0.5, 1, 16, 4), ("c", 0.5, 1, None, None)], SOURCES)
    rows = pieces.pieces(docs, sources).orderBy("doc_id", "piece").collect()
    assert {r.doc_id for r in rows} == {1} and [r.piece for r in rows] == list(range(len(rows)))
    assert all(r.tokens <= 16 and bpe.count(r.text) <= 16 for r in rows)
    assert pieces.pieces(docs.limit(0), sources).count() == 0


def topics(rng, script):
    """A text of known topics and the character offsets at which they change."""
    vocabulary = [[f"{script}{chr(97 + t)}{chr(97 + i)}word" for i in range(25)] for t in range(6)]
    if script == "zh":
        vocabulary = [[chr(0x4E00 + 200 * t + 2 * i) + chr(0x4E00 + 200 * t + 2 * i + 1) for i in range(25)] for t in range(6)]
    text, cuts = "", set()
    for t in rng.sample(range(6), 6):
        if text:
            cuts.add(len(text))
        for _ in range(rng.randint(10, 22)):
            picked = [rng.choice(vocabulary[t]) for _ in range(8)]
            text += ("".join(picked) + "。 " if script == "zh" else " ".join(picked) + ". ")
    return text, cuts


@pytest.mark.parametrize("script", ["lat", "zh"])
def test_valleys_lie_at_changes_of_topic(script):
    rng = random.Random(12)
    kinds = pieces.Kinds(tokens.byte_pairs(tokens.vocabulary()))
    hits = places = 0
    chance = 0.0
    for _ in range(15):
        text, cuts = topics(rng, script)
        parts = kinds.bpe.split(text)
        columns, content, dims = kinds.of(parts)
        ends = np.flatnonzero(columns[3]) + 1
        ends = ends[ends < len(parts)]
        depth = pieces.depths(content, dims, ends)
        chars = np.cumsum(columns[1])[ends - 1]
        # The sentence ends of greatest depth, as many as there are changes; a change may be told at the next blank.
        best = {int(chars[i]) for i in np.argsort(-depth)[: len(cuts)]}
        near = {c + s for c in cuts for s in (-1, 0)}
        hits += len(best & near)
        places += len(cuts)
        chance += len(cuts) * len(cuts) / len(ends)
    assert hits >= 0.8 * places > 4 * chance


def test_peaks():
    assert pieces.peak(np.array([1.0, 3.0, 2.0, 2.0, 5.0, 4.0])).tolist() == [1.0, 3.0, 3.0, 3.0, 5.0, 5.0]


def test_depths_equal_counting_blocks():
    rng = random.Random(5)
    for n in (0, 1, 7, 90, 400):
        hashes = np.array([rng.randint(0, 40) for _ in range(n)], np.int64)
        content = np.arange(n)
        at = np.arange(1, n)
        same = []
        for p in at:
            left, right = Counter(hashes[max(0, p - pieces.BLOCK) : p].tolist()), Counter(hashes[p : p + pieces.BLOCK].tolist())
            dot = sum(left[w] * right[w] for w in left)
            same.append(dot / (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5)
        same = np.array(same)
        want = pieces.peak(same) + pieces.peak(same[::-1])[::-1] - 2 * same
        assert np.allclose(pieces.depths(content, hashes, at), want)
