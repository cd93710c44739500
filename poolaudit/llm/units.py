"""Units: rows with the same record and the same words, the nodes of the similarity joins, and the inverted lists over them.

A unit's words are a vector of occurrence-labelled terms of weight 1 / sqrt(n), so the dot product of two vectors is
overlap / sqrt(na * nb), and similarity J >= t is the same as overlap >= t / (1 + t) * (na + nb). Terms are in one order for
all units, rarest first, and an inverted list holds a unit under its first terms only. Nothing below drops a similar pair:

* maximum weight: a list holds the units of one class of sizes, by factors of CLASS, so that the weights in it lie between two
  bounds, and a larger unit looks only into the lists of its own class, into which units of the class below are entered too;
* residual norm: the terms left out of a list can't add up to what a similar pair needs. The smaller unit is entered with its
  first n - need + 1 terms, need being the overlap with the least partner of the list's class; the larger one looks with its
  first n - ceil(t n) + 1;
* candidate-time bound: two units meet first at their first common term, where the overlap is at most 1 and what the shorter
  rest behind it can add; and 128 parity bits bound the terms in which they differ.

Joins of tables that grow with the data carry a merge hint, as Spark would judge a written table by its compressed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolaudit.llm.features import bag_keys, bitmaps, frequencies, rarest_first, terms_of
from poolaudit.llm.words import MIN_WORDS, WordHashes, Words, batch_words, mix, record_keys
from poolaudit.storage import materialise

#: Similar: the multisets' Jaccard coefficient is at least THRESHOLD.
THRESHOLD = 0.75
#: Sizes of a class differ by less than this factor, which is above 1 / THRESHOLD: partners lie in one class or in neighbours.
CLASS = 1.3334
#: Parts of the lists that are shuffled one after the other; each costs a pass over the units.
PARTS = 2
#: Rows of a unit are spread over chunks of about this size, so that no group of copies lands in one task.
CHUNK = 2000
#: Cells of an alignment that are looked at together, and of one alignment.
CELLS = 1 << 22

ROWS = "row_idx bigint, split string, source string, n int, rec binary, ukey binary, fields boolean, b0 bigint, b1 bigint, terms array<int>"


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def rows_with_terms(pool: DataFrame, name: str) -> DataFrame:
    """Rows with at least MIN_WORDS words: row_idx, split, source, n, rec, ukey, fields, b0, b1, terms.

    ukey: key of record and words; rec: key of the record, null where ukey is; terms: 32 bits of each term, in text order. The
    only pass in which texts are read; written once, as later steps read it several times.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("completion").to_pylist()
            found = batch_words(texts, hashes)
            enough = found.size >= MIN_WORDS
            if not enough.any():
                continue
            out, found = batch.filter(pa.array(enough)), found.only(enough)
            texts = [t for t, k in zip(texts, enough, strict=True) if k]
            terms = terms_of(found)
            keys, fields = record_keys(texts, found)
            ukeys = list(keys)
            if fields.any():
                bags = bag_keys(terms, found.start)
                for i in np.flatnonzero(fields):
                    ukeys[i] = blake2b(keys[i] + bags[i], digest_size=16).digest()
            b0, b1 = bitmaps(terms, found.start)
            yield pa.RecordBatch.from_arrays(
                [
                    *(out.column(c) for c in ("row_idx", "split", "source")),
                    pa.array(found.size.astype(np.int32)),
                    pa.array([k if f else None for k, f in zip(keys, fields, strict=True)], pa.binary()),
                    pa.array(ukeys, pa.binary()),
                    pa.array(fields),
                    pa.array(b0),
                    pa.array(b1),
                    _lists(terms.astype(np.uint32).view(np.int32), found.size),
                ],
                names=["row_idx", "split", "source", "n", "rec", "ukey", "fields", "b0", "b1", "terms"],
            )

    kept = pool.where("completion is not null").select("row_idx", "split", "source", "completion")
    return materialise(kept.mapInArrow(keyed, ROWS), name)


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with keys, the first n - ceil(t n) + 1 terms, rarest first, in place of terms."""
    shared = rows.sparkSession.sparkContext.broadcast(frequencies(rows))
    columns = [c for c in rows.columns if c != "terms"]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            keys = rarest_first(batch.column("terms").flatten().to_numpy(), n, shared.value)
            most = n - np.ceil(THRESHOLD * n - 1e-9).astype(np.int64) + 1
            place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), _lists(keys[place < np.repeat(most, n)], most)], names=[*columns, "keys"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(ranked, ", ".join(f"{c} {types[c]}" for c in columns) + ", keys array<int>")


def units(rows: DataFrame) -> DataFrame:
    """One row per unit: uid (its smallest row_idx), n, rec, ukey, fields, b0, b1, keys, n_train, n_eval.

    A null split counts as not train. Copies are counted before the shuffle; of the rest, all copies hold the same values.
    """
    train = F.coalesce(F.col("split") == "train", F.lit(False))
    return (
        with_keys(rows.select("row_idx", "split", "n", "rec", "ukey", "fields", "b0", "b1", "terms"))
        .groupBy("ukey")
        .agg(
            F.min(F.struct("row_idx", "n", "rec", "fields", "b0", "b1", "keys")).alias("m"),
            F.count_if(train).alias("n_train"),
            F.count_if(~train).alias("n_eval"),
        )
        .select("ukey", F.col("m.row_idx").alias("uid"), "m.n", F.coalesce("m.rec", "ukey").alias("rec"), "m.fields", "m.b0", "m.b1", "m.keys", "n_train", "n_eval")
    )


def candidates(nodes: DataFrame, entered: Column | None = None, looks: Column | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Pairs (a < b) of units that pass all bounds, some of them more than once.

    entered, looks: of a unit, the sides (arrays of 0 and 1) under which it is entered into the lists, and under which it looks
    into them; without them there is one side. part (i, k): only the lists of the terms that leave i when divided by k, so that
    the k parts together give all pairs.
    """
    n, share = F.col("n").cast("double"), THRESHOLD / (1 + THRESHOLD)
    own = F.floor(F.log(n) / F.log(F.lit(CLASS))).cast("int")
    # Least overlap with a partner that is at least as large, of the unit's own class and of the next.
    need = [F.ceil(n * F.lit(2 * share) - 1e-9), F.ceil((n + F.pow(F.lit(CLASS), own + 1) - 1e-6) * F.lit(share) - 1e-9)]
    lists = F.array(*[F.named_struct(F.lit("class"), own + i, F.lit("most"), F.greatest(F.lit(0), F.col("n") - k + 1).cast("int")) for i, k in enumerate(need)])

    def posts(frame: DataFrame, name: str) -> DataFrame:
        # The term, the class and the side share a field, and so do n and the number of terms behind this one.
        key = F.shiftleft((F.col("class") * 2 + F.col("side")).cast("bigint"), 32) + F.col("term").cast("bigint")
        size = F.shiftleft(F.col("n").cast("bigint"), 32) + (F.col("n") - F.col("rank") - 1).cast("bigint")
        frame = frame.select("*", F.posexplode("keys").alias("rank", "term"))
        if part[1] > 1:  # after the ranks are given
            frame = frame.where(F.pmod("term", F.lit(part[1])) == part[0])
        return frame.select("uid", size.alias("size"), "b0", "b1", key.alias("key")).alias(name)

    def sides(c: Column | None) -> Column:
        return F.explode(F.array(F.lit(0)) if c is None else c).alias("side")

    listed = nodes.select("uid", "n", "b0", "b1", "keys", lists.alias("lists"), sides(entered))
    listed = listed.select("uid", "n", "b0", "b1", "keys", "side", F.explode("lists").alias("list")).select("uid", "n", "b0", "b1", "side", "list.class", F.slice("keys", F.lit(1), F.col("list.most")).alias("keys"))
    looking = nodes.select("uid", "n", "b0", "b1", "keys", own.alias("class"), sides(looks))
    x, y = posts(listed, "x"), posts(looking, "y")

    nx, ny = F.shiftright("x.size", 32), F.shiftright("y.size", 32)
    rest = F.least(F.col("x.size").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("y.size").bitwiseAND(F.lit(0xFFFFFFFF)))
    differ = F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))) + F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1")))
    both = (nx + ny).cast("double")
    hit = (
        ((nx < ny) | ((nx == ny) & (F.col("x.uid") < F.col("y.uid"))))
        & (differ.cast("double") <= both * F.lit((1 - THRESHOLD) / (1 + THRESHOLD) + 1e-9))  # of A and B, |A xor B| is this part at most
        & (nx.cast("double") >= ny.cast("double") * F.lit(THRESHOLD - 1e-9))
        & ((rest + 1).cast("double") >= both * F.lit(share) - 1e-9)
    )
    return x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & hit).select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"))


def candidates_by_parts(nodes: DataFrame, entered: Column | None, looks: Column | None, name: str) -> DataFrame:
    """candidates() of all PARTS, one written after the other, so that within shuffles_removed() the lists of a single part lie
    on disk at a time."""
    return reduce(DataFrame.unionByName, [materialise(candidates(nodes, entered, looks, (i, PARTS)), name) for i in range(PARTS)])


def verified(pool: DataFrame, pairs: DataFrame, align: bool) -> DataFrame:
    """The pairs (a, b) whose completions are similar, each once, by the exact dot product of their term vectors; with align
    a banded alignment, whose matches are a lower bound of the common words, is tried first."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            a, b = (batch_words(batch.column(c).to_pylist(), hashes) for c in ("ta", "tb"))
            yield batch.select(["a", "b"]).filter(pa.array(similar(a, b, align)))

    return texts_of(pool, pairs).mapInArrow(exact, "a bigint, b bigint")


def similar(a: Words, b: Words, align: bool = False) -> np.ndarray:
    """Whether the i-th text of a and the i-th of b are similar."""
    need = THRESHOLD / (1 + THRESHOLD) * (a.size + b.size) - 1e-9
    out = np.zeros(len(need), bool)
    open_ = np.minimum(a.size, b.size) >= need
    if align:
        out[open_] = aligned(a.only(open_), b.only(open_), np.ceil((a.size + b.size - 2 * need)[open_]).astype(np.int64)) >= need[open_]
    open_ &= ~out
    out[open_] = common(a.only(open_), b.only(open_)) >= need[open_]
    return out


def common(a: Words, b: Words) -> np.ndarray:
    """Common words of the i-th texts, counted as often as they occur in both: the dot product of their term vectors."""
    pair = np.concatenate([np.repeat(np.arange(len(x.size)), x.size) for x in (a, b)])
    key = np.concatenate([terms_of(a), terms_of(b)]) ^ mix(pair.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    twice = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.bincount(pair[order[twice]], minlength=len(a.size))


def aligned(a: Words, b: Words, band: np.ndarray) -> np.ndarray:
    """Matched words of the best alignment of the i-th texts in which places differ by the band at most. Texts of like size are
    aligned together; 0 where the band has over CELLS cells, as counting is then cheaper."""
    out = np.zeros(len(band), np.int64)
    longest = np.maximum(a.size, b.size)
    order = np.argsort(longest, kind="stable")
    order = order[(a.size * (2 * band + 1))[order] <= CELLS]
    at = 0
    while at < len(order):
        block = order[at : at + max(1, CELLS // 16 // max(1, int(longest[order[at]])))]
        at += len(block)
        w = int(band[block].max())
        width = int(longest[block].max())
        grid = []
        for x, pad, fill in ((a, 0, 0), (b, w, 1)):
            m = np.full((len(block), width + 2 * pad), fill, np.uint64)
            own = x.size[block]
            row, col = np.repeat(np.arange(len(block)), own), np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            m[row, col + pad] = x.word[np.repeat(x.start[block], own) + col]
            grid.append(m)
        best = np.zeros((len(block), 2 * w + 2), np.int32)
        for i in range(width):  # column d stands for the place i + d - w of b
            match = grid[1][:, i : i + 2 * w + 1] == grid[0][:, i : i + 1]
            best[:, :-1] = np.maximum.accumulate(np.maximum(best[:, :-1] + match, best[:, 1:]), axis=1)
        out[block] = best.max(axis=1)
    return out


def texts_of(pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the completions of both; only texts of rows in a pair are moved. Equal pairs count once."""
    pairs = materialise(pairs.distinct(), "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    kept = materialise(pool.select(F.col("row_idx").alias("id"), "completion").join(ids.hint("merge"), "id", "left_semi"), "texts")
    left, right = kept.select(F.col("id").alias("a"), F.col("completion").alias("ta")), kept.select(F.col("id").alias("b"), F.col("completion").alias("tb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")


def chunked(rows: DataFrame, of: DataFrame, count: Column) -> DataFrame:
    """rows of the units in `of` with their unit's uid and a chunk number below chunks(count)."""
    sizes = of.select("ukey", "uid", chunks(count).alias("chunks"))
    return rows.join(sizes.hint("merge"), "ukey").withColumn("chunk", F.pmod(F.xxhash64("row_idx"), F.col("chunks")).cast("int"))


def chunks(count: Column) -> Column:
    return F.greatest(F.ceil(count / F.lit(float(CHUNK))), F.lit(1)).cast("int")
