"""Problems 1 and 3 against all pairs."""

import random
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from helpers import hashed, lcs, pool, truth

from poolaudit import storage
from poolaudit.llm import neardup, overlap
from poolaudit.llm import units as nodes_of
from poolaudit.llm.units import aligned, candidates, rows_with_terms, similar, units

WORDS = [f"w{i}" for i in range(400)]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def corpus(seed, n=260):
    """Texts with edits of every size, moved words, copies, formatting, fields, short ones and nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.45 or len(rows) < 5:
            c = " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 40)))
        elif kind < 0.5:
            c = rng.choice([None, "", " ", "one two", "?"])
        elif kind < 0.6:
            c = "; ".join(f"n{k}: {rng.choice(WORDS[:40])} {rng.choice(WORDS[:40])}" for k in range(5))
        else:
            w = (rng.choice(rows)[1] or "").split() or ["x"]
            for _ in range(rng.randint(0, 4)):
                j = rng.randrange(len(w))
                move = rng.random()
                if move < 0.3:
                    w[j] = rng.choice(WORDS)
                elif move < 0.5:
                    w.insert(j, w.pop(rng.randrange(len(w))))
                elif move < 0.7 and len(w) > 1:
                    del w[j]
                else:
                    w.insert(j, rng.choice(WORDS))
            c = rng.choice([" ", "  ", "\n"]).join(w)
            c = c.upper() if rng.random() < 0.2 else c
        rows.append((i, c, rng.choice(["train", "train", "test", "dev", None])))
    return rows


def crossing(rows, pairs):
    split = {i: s for i, _, s in rows}
    return {p for p in pairs if (split[p[0]] == "train") != (split[p[1]] == "train")}


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_split_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed)
    same, near = truth(rows)
    got = overlap.cross_split_overlaps(pool(spark, rows)).collect()
    assert len(got) == len({(r.row_a, r.row_b) for r in got})
    assert {(r.row_a, r.row_b) for r in got} == crossing(rows, same | near)
    split = {i: s for i, _, s in rows}
    assert all(r.eval_split in (split[r.row_a], split[r.row_b]) and r.eval_split != "train" for r in got)


@pytest.mark.parametrize("seed", [3])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = corpus(seed)
    same, near = truth(rows)
    got = {(r.row_a, r.row_b) for r in neardup.near_duplicates(pool(spark, rows)).collect()}
    want = near - same
    assert got == want and len(want) > 30


def test_near_duplicates_with_frequent_words_and_rare_edits(spark):
    """Pairs at the limit whose shared words stand in a quarter of all rows and whose edits stand nowhere else, beside a hot group."""
    rng = random.Random(7)
    hot = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.sample(hot, 15), f"x{i}", f"y{i}"]), "train") for i in range(1200)]
    rows += [(2000 + i, "h1 h2 h3 h4 h5 h6 h7 h8 h9", "train") for i in range(500)]
    want = set()
    for i in range(60):
        shared = rng.sample(hot, 12)
        rows += [(3000 + 2 * i + k, " ".join([*shared, f"a{i}{k}", f"b{i}{k}"]), "test") for k in range(2)]
        want.add((3000 + 2 * i, 3001 + 2 * i))
    got = [(r.row_a, r.row_b) for r in neardup.near_duplicates(pool(spark, rows)).collect()]
    assert len(got) == len(set(got)) and want <= set(got)
    same, near = truth(rows)
    assert set(got) == near - same


def test_test_tables(spark, data):
    rows = duckdb.sql(f"select row_idx, completion, split from '{data}/pool.parquet'").fetchall()
    same, near = truth(rows)
    df = spark.read.parquet(f"{data}/pool.parquet")
    assert {(r.row_a, r.row_b) for r in overlap.cross_split_overlaps(df).collect()} == crossing(rows, same | near)
    assert {(r.row_a, r.row_b) for r in neardup.near_duplicates(df).collect()} == near - same


def test_a_hot_record(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(i, text if i % 3 == 0 else f"u{i} v{i} w{i} x{i} y{i} z{i} a{i} b{i}", "test" if i % 6 == 0 else "train") for i in range(300)]
    got = overlap.cross_split_overlaps(pool(spark, rows))
    assert got.count() == 50 * 50
    report = {r.eval_split: r for r in overlap.overlap_report(pool(spark, rows)).collect()}
    assert (report["test"].n_rows, report["test"].n_overlapping, report["test"].pairs) == (50, 50, 2500)
    assert neardup.near_duplicates(pool(spark, rows)).count() == 0


def test_empty_tables_and_nothing_long_enough(spark):
    for rows in ([], [(1, None, "train"), (2, "short", "test")]):
        assert overlap.cross_split_overlaps(pool(spark, rows)).count() == 0
        assert neardup.near_duplicates(pool(spark, rows)).count() == 0


def test_classes_of_edges(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(35)} | {(i, i + 1) for i in range(100, 140)} | {(200, i) for i in range(201, 260)}
    got = {r.node: r.label for r in neardup.labelled(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).collect()}
    assert got == {x: min(v) for v in joined(pairs) for x in v}
    assert neardup.labelled(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def joined(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    classes = {}
    for x in {x for p in pairs for x in p}:
        classes.setdefault(root(x), []).append(x)
    return list(classes.values())


def test_groups_equal_those_of_row_pairs(spark):
    rows = corpus(10)
    rows += [(1000 + i, rows[7][1] or "", "train") for i in range(5)]
    same, near = truth(rows)
    pairs = near - same
    got = {r.row_idx: (r.class_id, r.links) for r in neardup.groups(pool(spark, rows)).collect()}
    links = {}
    for p in pairs:
        for x in p:
            links[x] = links.get(x, 0) + 1
    assert got == {x: (min(v), links[x]) for v in joined(pairs) for x in v}
    assert neardup.groups(pool(spark, [])).count() == 0


def test_report_counts_rows_and_pairs(spark):
    rows = corpus(9)
    same, near = truth(rows)
    crossed = crossing(rows, same | near)
    split = {i: s for i, _, s in rows}
    for r in overlap.overlap_report(pool(spark, rows)).collect():
        own = [next(i for i in p if split[i] != "train") for p in crossed if any(split[i] == r.eval_split for i in p)]
        assert (r.pairs, r.n_overlapping, r.n_rows) == (len(own), len(set(own)), sum(s == r.eval_split for s in split.values()))
        assert r.share == len(set(own)) / r.n_rows


def test_alignment(spark):
    rng = random.Random(3)
    a = [[rng.choice("abcdef") for _ in range(rng.randint(1, 14))] for _ in range(200)]
    b = [[rng.choice("abcdef") for _ in range(rng.randint(1, 14))] for _ in range(200)]
    for band in (0, 2, 20):
        got = aligned(hashed(*a), hashed(*b), np.full(200, band))
        exact = [lcs(x, y, band) for x, y in zip(a, b, strict=True)]
        free = [lcs(x, y, 99) for x, y in zip(a, b, strict=True)]
        # Texts of one call share the widest band.
        assert all(e <= g <= f for e, g, f in zip(exact, got, free, strict=True))


@pytest.mark.parametrize("align", [True, False])
def test_similar(align):
    pairs = [("a b c d e f g h", "e f g h a b c d", True), ("a b c d e f g h", "a b c d e f x y", False), ("a a a b", "a a b b", False), ("a b c d e f g", "a b c d e f g h", True)]
    got = similar(hashed(*[p[0].split() for p in pairs]), hashed(*[p[1].split() for p in pairs]), align)
    assert got.tolist() == [p[2] for p in pairs]


def test_no_table_that_grows_is_broadcast(spark):
    """Spark judges a written table by its compressed bytes, so nothing but merge hints keeps units and texts from the driver."""
    df = pool(spark, corpus(1))
    for found in (neardup.near_duplicates(df), neardup.groups(df), overlap.cross_split_overlaps(df), overlap.overlap_report(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_linked_units_leave_no_terms_and_no_shuffles(spark):
    """What the lists are made from is gone when they are joined, so that the shuffle of the lists is nearly all that lies on disk."""
    before = _shuffles(spark)
    setting = spark.conf.get(CLEANUP, None)
    rows, _, edges = neardup.linked_units(pool(spark, corpus(1)))
    until = time.monotonic() + 20
    while (left := _shuffles(spark) - before) and time.monotonic() < until:  # files are removed in the background
        time.sleep(0.2)
    assert not left
    # Every table of terms that any test wrote for problem 3 is gone, and the rows hold none.
    assert not list(Path(rows.inputFiles()[0].removeprefix("file:")).parent.parent.glob("p3rows-*"))
    assert rows.columns == ["row_idx", "ukey"] and edges.count() > 0
    assert spark.conf.get(CLEANUP, None) == setting


def test_lists_across_splits_lie_on_disk_one_part_at_a_time(spark, monkeypatch):
    """Before each part of the lists is shuffled, terms and all shuffle files of the steps before are gone."""
    before, setting, write, begun = _shuffles(spark), spark.conf.get(CLEANUP, None), nodes_of.materialise, []

    def left():
        until = time.monotonic() + 20
        while (found := _shuffles(spark) - before) and time.monotonic() < until:  # files are removed in the background
            time.sleep(0.2)
        return found, list(Path(storage.own_dir(spark).removeprefix("file:")).glob("p1rows-*"))

    def watched(df, name):
        if name == "p1pairs":
            begun.append(left())
        return write(df, name)

    monkeypatch.setattr(nodes_of, "materialise", watched)
    rows, _, edges = overlap.linked_units(pool(spark, corpus(1)))
    assert begun == [(set(), [])] * nodes_of.PARTS and nodes_of.PARTS > 1
    assert left() == (set(), [])
    assert rows.columns == ["row_idx", "split", "source", "ukey"] and edges.count() > 0
    assert spark.conf.get(CLEANUP, None) == setting


def test_parts_of_the_lists_hold_all_pairs(spark):
    nodes = storage.materialise(units(rows_with_terms(pool(spark, corpus(3)), "rows")), "units")
    whole = {tuple(r) for r in candidates(nodes).collect()}
    for k in (2, 3):
        parts = [{tuple(r) for r in candidates(nodes, part=(i, k)).collect()} for i in range(k)]
        assert set().union(*parts) == whole and all(parts)


def _shuffles(spark):
    """Names of the shuffle files on disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_setting_of_shuffles_is_restored_after_an_error(spark):
    before = spark.conf.get(CLEANUP, None)
    with pytest.raises(KeyError), storage.shuffles_removed(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise KeyError
    assert spark.conf.get(CLEANUP, None) == before


def test_only_own_tables_are_discarded(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/kept")
    with pytest.raises(ValueError):
        storage.discard(spark.read.parquet(f"{tmp_path}/kept"))
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 5
    for n in (0, 5):
        own = storage.materialise(spark.range(n), "own")
        folder = Path(own.inputFiles()[0].removeprefix("file:")).parent
        assert folder.exists()
        storage.discard(own)
        assert not folder.exists()
