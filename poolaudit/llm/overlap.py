"""Problem 1: the same or similar completions across splits, by a weighted cosine join.

The inverted lists of units.py are held once for the units of train and once for those outside; a unit looks into the lists of
the other side only, so no pair within a side is ever met. Candidates pass the maximum-weight, residual-norm and candidate-time
bounds, of which none drops a similar pair; the exact dot product is then taken from the texts. Cost: a shuffle of about 0.4 n
postings a unit, in parts, of which one lies on disk at a time. Lists of frequent terms are short, as the rarest terms of a text stand first; AQE splits a list that is
not. Copies take part as one unit, and pairs of their rows are made at the end, in chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolaudit.llm.units import candidates_by_parts, chunked, chunks, rows_with_terms, units, verified
from poolaudit.storage import discard, materialise, shuffles_removed


def _train() -> F.Column:
    return F.coalesce(F.col("split") == "train", F.lit(False))


def linked_units(pool: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, units, edges): rows have row_idx, split, source and ukey; edges are pairs (a, b), a with rows outside train and b with
    rows in train, of similar units, of units of one record, and of a unit that stands on both sides with itself. All are
    written to the shared folder.

    While a part of the lists is shuffled, neither the terms of the rows nor the shuffle files of the steps before lie on disk.
    """
    with shuffles_removed(pool.sparkSession):
        termed = rows_with_terms(pool, "p1rows")
        nodes = materialise(units(termed), "p1units")
        rows = materialise(termed.select("row_idx", "split", "source", "ukey"), "p1members")
        discard(termed)
        inside, outside = F.when(F.col("n_train") > 0, 1), F.when(F.col("n_eval") > 0, 0)
        pairs = candidates_by_parts(nodes, F.array_compact(F.array(inside, outside)), F.array_compact(F.array(1 - inside, 1 - outside)), "p1pairs")
        near = verified(pool, pairs, align=False)
        # One record under different words: named fields that repeat.
        named = nodes.where("fields").select("rec", "uid")
        several = named.groupBy("rec").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        named = named.join(several.hint("merge"), "rec", "left_semi")
        same = named.alias("x").join(named.alias("y").hint("merge"), (F.col("x.rec") == F.col("y.rec")) & (F.col("x.uid") < F.col("y.uid"))).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b"))
        edges = near.unionByName(same).distinct()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(nodes.where("n_train > 0 and n_eval > 0").select(F.col("uid").alias("a"), F.col("uid").alias("b")))
        return rows, nodes, materialise(both, "p1edges")


def cross_split_overlaps(pool: DataFrame) -> DataFrame:
    """Row pairs of pool, just one in split train, that are the same record or similar.

    Columns row_a < row_b, eval_split and eval_source (those of the row outside train; a null split counts as outside).
    Null completions and such of fewer than MIN_WORDS words take no part; an empty table gives no rows. Every pair comes out
    once; ties and repeated rows are pairs like any other. Extra columns of pool are not read. Jobs run while the frame is
    built: the lists and edges are written to the shared folder.
    """
    rows, nodes, edges = linked_units(pool)
    n_eval, n_train = F.col("n_eval"), F.col("n_train")
    a = nodes.where("n_eval > 0").select(F.col("uid").alias("a"), chunks(n_eval).alias("ka"))
    b = nodes.where("n_train > 0").select(F.col("uid").alias("b"), chunks(n_train).alias("kb"))
    spread = materialise(
        edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
        .select("a", "b", F.explode(F.expr("sequence(0, ka - 1)")).alias("ca"), "kb")
        .select("a", "b", "ca", F.explode(F.expr("sequence(0, kb - 1)")).alias("cb")),
        "p1spread",
    )

    def members(of: str, inside: bool, count: F.Column) -> DataFrame:
        """Rows of the units that have an edge, on one side."""
        linked = nodes.join(spread.select(F.col(of).alias("uid")).distinct().hint("merge"), "uid", "left_semi")
        return chunked(rows.where(_train() if inside else ~_train()).select("row_idx", "ukey", "split", "source"), linked, count)

    outside = members("a", False, n_eval).select(F.col("uid").alias("a"), F.col("chunk").alias("ca"), F.col("row_idx").alias("ra"), "split", "source")
    within = members("b", True, n_train).select(F.col("uid").alias("b"), F.col("chunk").alias("cb"), F.col("row_idx").alias("rb"))
    return (
        spread.join(outside.hint("merge"), ["a", "ca"])
        .join(within.hint("merge"), ["b", "cb"])
        .select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    )


def overlap_report(pool: DataFrame) -> DataFrame:
    """eval_split, eval_source, n_rows (all rows outside train of that split and source), n_overlapping (distinct ones with an
    equal or similar row in train), share of the two, pairs (of rows).

    Counted from units and edges: rows of copies are never paired, so a hot record costs one row a unit. Groups without any
    overlap come out with zeros; an empty table gives no rows.
    """
    rows, nodes, edges = linked_units(pool)
    # Rows in train that a unit outside is linked to.
    partners = edges.join(nodes.where("n_train > 0").select(F.col("uid").alias("b"), "n_train").hint("merge"), "b").groupBy(F.col("a").alias("uid")).agg(F.sum("n_train").alias("partners"))
    reach = nodes.where("n_eval > 0").select("uid", "ukey").join(partners.hint("merge"), "uid").select("ukey", "partners")
    own = rows.where(~_train()).groupBy("ukey", F.col("split").alias("eval_split"), F.col("source").alias("eval_source")).agg(F.count(F.lit(1)).alias("k"))
    met = own.join(reach.hint("merge"), "ukey").groupBy("eval_split", "eval_source").agg(F.sum("k").alias("n_overlapping"), F.sum(F.col("k") * F.col("partners")).alias("pairs"))
    every = pool.where(~_train()).groupBy(F.col("split").alias("eval_split"), F.col("source").alias("eval_source")).agg(F.count(F.lit(1)).alias("n_rows"))
    same = F.col("e.eval_split").eqNullSafe(F.col("m.eval_split")) & F.col("e.eval_source").eqNullSafe(F.col("m.eval_source"))
    zero = F.lit(0).cast("bigint")
    out = every.alias("e").join(met.alias("m"), same, "left").select("e.*", F.coalesce("m.n_overlapping", zero).alias("n_overlapping"), F.coalesce("m.pairs", zero).alias("pairs"))
    return out.select("eval_split", "eval_source", "n_rows", "n_overlapping", (F.col("n_overlapping") / F.col("n_rows")).alias("share"), "pairs")
