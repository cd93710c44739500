"""Problem 2: the ledger, its increments, and the duplicates."""

from helpers import key, pool, truth
from test_similarity import corpus

from poolaudit.llm import ledger
from poolaudit.llm.words import MIN_WORDS, words


def with_times(df):
    return df.selectExpr("*", "timestamp '2025-01-01' as written_at", "case when row_idx % 3 = 0 then null else timestamp '2025-01-01' + make_interval(0, 0, 0, cast(row_idx % 4 as int)) end as loaded_at").drop("batch")


def expected(rows):
    first, out = {}, set()
    for i, c, _ in sorted(rows):
        if len(words(c)) >= MIN_WORDS:
            k = key(c)
            if k in first:
                out.add((first[k], i))
            first.setdefault(k, i)
    return first, out


def test_duplicates_equal_brute_force(spark):
    rows = corpus(7)
    _, want = expected(rows)
    got = ledger.duplicates(with_times(pool(spark, rows))).collect()
    assert {(r.row_a, r.row_b) for r in got} == want and len(got) == len(want) > 5
    assert len(truth(rows)[0]) >= len(want)


def test_increments_equal_one_batch_and_touch_only_their_buckets(spark, tmp_path):
    rows = corpus(8)
    keyed = ledger.canonical_keys(ledger.in_batches(with_times(pool(spark, rows)))).cache()
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", buckets=1024)
    first, _ = expected(rows)
    whole = book.add(keyed.where("row_idx % 2 = 1"))
    before = book._state()["folders"]
    one = book.read().collect()
    few = keyed.where("row_idx % 2 = 0 and row_idx < 20")
    touched = book.add(few)
    after = book._state()["folders"]
    assert 0 < len(touched) < 20 < len(whole)
    assert {int(b) for b in after if after[b] != before.get(b)} == touched
    assert set(book.read(touched).toPandas()["bucket"]) <= touched
    book.add(keyed.where("row_idx % 2 = 0 and row_idx >= 20"))
    got = {bytes(r.key): r for r in book.read().collect()}
    assert {k: r["first"] for k, r in got.items()} == first
    assert sum(r.copies for r in got.values()) == keyed.count() and sum(r.copies for r in one) < keyed.count()
    # A batch that broke off before its manifest is counted once when it comes again.
    book._fs.delete(book._at("manifests", "v3.json"), False)
    assert book.version() == 2
    book.add(keyed.where("row_idx % 2 = 0 and row_idx >= 20"))
    assert sum(r.copies for r in book.read().collect()) == keyed.count()
    assert ledger.Ledger(spark, book.path, keys=10**9).buckets == 1024  # an existing ledger keeps its number
    assert book.add(keyed.where("false")) == set() and book.version() == 3


def test_old_versions_are_removed(spark, tmp_path):
    keyed = ledger.canonical_keys(ledger.in_batches(with_times(pool(spark, corpus(8))))).cache()
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", buckets=8)
    for _ in range(4):
        book.add(keyed)
    assert sum(r.copies for r in book.read().collect()) == 4 * keyed.count()
    assert sorted(p.name for p in (tmp_path / "ledger/manifests").iterdir() if not p.name.startswith(".")) == ["v3.json", "v4.json"]
    assert sorted(p.name for p in (tmp_path / "ledger/data").iterdir()) == ["v3", "v4"]


def test_empty(spark):
    assert ledger.duplicates(with_times(pool(spark, []))).count() == 0
    assert ledger.duplicates(with_times(pool(spark, [(1, None, "a"), (2, "", "a"), (3, "x y", None)]))).count() == 0
