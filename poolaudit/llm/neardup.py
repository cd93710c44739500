"""Problem 3: near-duplicates with small edits, by an exact join of inverted lists and banded alignment.

The lists are those of units.py with one side: terms are ordered by rarity, a unit is entered under its first terms, and a
larger unit, of equal ones the one of the greater uid, looks into the lists of its own first terms. Every similar pair shares
such a term, however frequent its words are and wherever they moved, so none is lost. No list is cut off: a candidate pair is
dropped only by bounds that no similar pair violates, and AQE splits a long list over tasks. Copies take part as one unit.

Candidates are verified by a banded alignment of their words: its matches are a lower bound of the shared words, so a pair
that reaches the limit is taken; the rest, in which words may have moved, are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolaudit.llm.units import candidates, chunked, chunks, rows_with_terms, units, verified
from poolaudit.storage import discard, materialise, shuffles_removed


def linked_units(pool: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, units, edges): rows have row_idx and ukey; edges are pairs (a < b) of units that are similar and not one record. All
    are written to the shared folder.

    While the lists are shuffled, which takes most of the disk, neither the terms of the rows nor the shuffle files of the steps
    before lie there.
    """
    with shuffles_removed(pool.sparkSession):
        termed = rows_with_terms(pool, "p3rows")
        nodes = materialise(units(termed), "p3units")
        rows = materialise(termed.select("row_idx", "ukey"), "p3members")
        discard(termed)
        edges = (
            verified(pool, candidates(nodes), align=True)
            .join(nodes.select(F.col("uid").alias("a"), F.col("rec").alias("ra")).hint("merge"), "a")
            .join(nodes.select(F.col("uid").alias("b"), F.col("rec").alias("rb")).hint("merge"), "b")
            .where("ra <> rb")
            .select("a", "b")
        )
        return rows, nodes, materialise(edges, "p3edges")


def near_duplicates(pool: DataFrame) -> DataFrame:
    """Row pairs (row_a < row_b) of pool that are similar but not the same record.

    Null completions and such of fewer than MIN_WORDS words take no part; an empty table gives no rows; repeated rows of a
    unit come out with each of its partners. Extra columns of pool are not read. Jobs run while the frame is built: the lists
    and edges are written to the shared folder.
    """
    rows, nodes, edges = linked_units(pool)
    total = F.col("n_train") + F.col("n_eval")
    linked = materialise(nodes.join(edges.select(F.explode(F.array("a", "b")).alias("uid")).distinct().hint("merge"), "uid", "left_semi").select("uid", "ukey", "n_train", "n_eval"), "p3linked")
    sizes = linked.select("uid", chunks(total).alias("k"))
    spread = (
        edges.join(sizes.select(F.col("uid").alias("a"), F.col("k").alias("ka")).hint("merge"), "a")
        .join(sizes.select(F.col("uid").alias("b"), F.col("k").alias("kb")).hint("merge"), "b")
        .select("a", "b", F.explode(F.expr("sequence(0, ka - 1)")).alias("ca"), "kb")
        .select("a", "b", "ca", F.explode(F.expr("sequence(0, kb - 1)")).alias("cb"))
    )
    members = chunked(rows, linked, total).select("uid", "chunk", "row_idx")
    left = members.select(F.col("uid").alias("a"), F.col("chunk").alias("ca"), F.col("row_idx").alias("ra"))
    right = members.select(F.col("uid").alias("b"), F.col("chunk").alias("cb"), F.col("row_idx").alias("rb"))
    return spread.join(left.hint("merge"), ["a", "ca"]).join(right.hint("merge"), ["b", "cb"]).select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))


def labelled(edges: DataFrame) -> DataFrame:
    """node, label of every node of edges (a, b): label is the smallest node that is linked to it, directly or over others.

    Labels spread along the edges and jump to their label's label, so the rounds grow with the logarithm of the longest chain.
    Each round is written, and none is collected; minima are taken before the shuffle, so a node with many partners is no hot
    spot of the aggregation, and AQE splits it in the join.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "p3labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.hint("merge"), F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), "label")
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("above"))
        new = materialise(new.join(up.hint("merge"), F.col("next") == F.col("up")).select("node", F.least("next", "above").alias("next"), "label"), "p3labels")
        moved = not new.where("next <> label").isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def groups(pool: DataFrame) -> DataFrame:
    """row_idx, class_id, links of each row that near_duplicates() gives a partner: class_id is the smallest row_idx that is
    linked to the row, directly or over others; links counts its partners.

    Classes are found over units and their edges, and rows of copies are never paired: each row joins its unit's class once. A
    row without a partner has no row here, nor has an empty table.
    """
    rows, nodes, edges = linked_units(pool)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = nodes.select(F.col("uid").alias("b"), (F.col("n_train") + F.col("n_eval")).alias("k"))
    links = both.join(sizes.hint("merge"), "b").groupBy("a").agg(F.sum("k").alias("links"))
    # A unit's uid is its smallest row_idx, so the smallest unit of a class has the smallest row.
    classes = labelled(edges).join(links.hint("merge"), F.col("node") == F.col("a")).select(F.col("node").alias("uid"), F.col("label").alias("class_id"), "links")
    named = nodes.select("uid", "ukey").join(classes.hint("merge"), "uid").select("ukey", "class_id", "links")
    return rows.join(named.hint("merge"), "ukey").select("row_idx", "class_id", "links")
