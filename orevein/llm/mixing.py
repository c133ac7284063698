"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of the words gives every document of it the same expected number of copies, target / size of the source.
Whole copies are taken as they are. The fractions are rounded by the pivotal method: a document and a pool of smaller ones meet, and mass moves
at random from one side to the other until the document is whole; then the next largest meets the rest. Mass is counted in words, so that a
source's words stay at its target but for the last fraction, which is one of the smallest documents'. Blocks of documents do this side by side and leave one fraction each; these meet in blocks of blocks, and
so on up a tree. A document so large beside its source that the others can't balance it either way is rounded so that the target is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words_of, read_documents, stored

#: Weights of the sources in order, repeating; times its size that a source can give.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Documents that one task rounds in sequence; fractions that meet in a node of the tree.
BLOCK, FAN = 2048, 64

#: A fraction so near to a whole number is one. A document with more than so great a part of its source's target has it kept before its own chance, where the source lies in one block.
TINY, HEAVY = 1e-9, 0.01

#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, rank, source_size, target: a row for each source of sizes (source, size).

    Sources are ordered by code point, null last. A target is the level times the weight, but most * source_size at most; the
    level is such that targets add up to all sizes. This is where resharing the excess by weight, again and again, ends.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # rows of these windows are sources, not documents
    ranked = stats.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("at", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("at", "rank")
    below, above, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    filled = ranked.withColumn("level", level).withColumn("full", F.col("at") <= F.col("level"))
    # levels only rise while sources are full, so the first that isn't has the final one
    final = F.min(F.when(~F.col("full"), F.col("rank_by_cap"))).over(every)
    filled = filled.withColumn("rank_by_cap", F.row_number().over(by_cap)).withColumn("first", final)
    level = F.max(F.when(F.col("rank_by_cap") == F.col("first"), F.col("level"))).over(every)
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)).select("source", "rank", "source_size", "target")


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray, heavy: float = np.inf) -> tuple[np.ndarray, int]:
    """0 or 1 for each of the fractions p, and the place of the one left with a fraction (-1: none); p gets its value there. Largest sizes first.

    Mass is words, p * size: what one side gains the other loses, so that their sum stays. A document meets all smaller ones that are still open
    as one pool, each of which gives or takes in proportion to its room either way, so that each fraction is still the chance that its document gets a 1; it meets them again until it is whole, and then
    the next largest does. What is left in the end is so the fraction of one of the smallest. u: uniform numbers, one for each meeting; each makes a document whole at least.

    A document of more than heavy words that the pool could only balance if rounded one way is rounded that way, and to the nearer side if neither can be balanced: there the sum, not the chance, is kept.
    """
    p[(p <= TINY) | (p >= 1 - TINY)] = np.rint(p[(p <= TINY) | (p >= 1 - TINY)])
    size, met, last = size.astype(np.float64), 0, -1
    for i in range(len(p)):
        pool = np.flatnonzero((p[i + 1 :] > 0) & (p[i + 1 :] < 1)) + i + 1
        while 0 < p[i] < 1:
            if not len(pool):
                last = i
                break
            q, s = p[pool], size[pool]
            up, down = (1 - p[i]) * size[i], p[i] * size[i]  # words that i lacks to 1, and to 0
            lose, gain = q * s, (1 - q) * s
            short_up, short_down = up - lose.sum(), down - gain.sum()
            if size[i] > heavy and (short_up > 0 or short_down > 0):
                to_one = short_up <= short_down
                room, need = (lose, up) if to_one else (gain, down)
                moved = min(1.0, need / room.sum()) * room * (-1 if to_one else 1)
                p[i] = float(to_one)
            else:
                room = s * np.minimum(q, 1 - q)
                up, down = min(up, room.sum() * (lose / room).min()), min(down, room.sum() * (gain / room).min())
                words = up if u[met] * (up + down) < down else -down
                p[i], met, moved = p[i] + words / size[i], met + 1, -words * room / room.sum()
                p[i] = np.rint(p[i]) if min(p[i], 1 - p[i]) <= TINY else p[i]
            q = q + moved / s
            p[pool] = np.where((q <= TINY) | (q >= 1 - TINY), np.rint(q), q)
            pool = pool[(p[pool] > 0) & (p[pool] < 1)]
    out = np.rint(p).astype(np.int32)
    if last >= 0:
        out[last] = 0
    return out, last


def _rounding(seed: int, heavy: float = np.inf):
    def round_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "child"], ascending=[False, True, True], na_position="first", kind="stable")
        rng = np.random.default_rng([seed, *(int(k) for k in key)])
        p = rows["p"].to_numpy(np.float64, copy=True)
        alone = "blocks" in rows and rows["blocks"].iloc[0] == 1
        got, left = pivotal(p, rows["size"].to_numpy(), rng.random(len(p)), heavy * rows["target"].iloc[0] if alone else np.inf)
        rest = np.full(len(p), np.nan)
        if left >= 0:
            rest[left] = p[left]
        return rows.assign(got=got, rest=rest)[["rank", "block", "child", "doc_id", "size", "got", "rest"]]

    return round_block


ROUNDED = "rank long, block long, child long, doc_id long, size long, got int, rest double"


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs (doc_id long, text, source string).

    size: words of the text; a null text has none. A document without words gets no copy. Null sources are one source, the last in order.
    A repeated row is a document of its own. An empty table gives no rows. Other columns are left alone. Uniform numbers hang on the
    seed, the source's rank and the block alone, so that reruns agree.
    """
    return _mixed(docs, weights, most, seed).drop("text_hash")


def _mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """mix(), with a hash of the text: null and repeated doc_ids are told apart by it."""
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-sizes")
    targets = source_targets(sized, weights, most)
    counts = sized.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n"))
    targets = stored(targets.join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-targets")
    per = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    placed = (
        sized.join(per, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("expected", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("blocks")))
    )
    # pandas has no null in a column of longs and would make it one of floats, which lose digits
    placed = placed.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    cols = ["rank", "block", "doc_id", "size", "p"]
    leaves = placed.select(*cols, F.lit(0).cast("long").alias("child"), "source", "source_size", "target", "whole", "text_hash", "blocks")
    rounded = stored(leaves.groupBy("rank", "block").applyInPandas(_carry(_rounding(seed, HEAVY)), f"{ROUNDED}, source string, source_size long, target double, whole long, text_hash long"), "mix-leaves")
    most_blocks = targets.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    # up the tree: a level's fractions, by the blocks they come from
    levels, height = [rounded.where("rest is not null").select("rank", "block", "doc_id", "size", F.col("rest").alias("p"))], 0
    solved = []
    while most_blocks > 1 or height == 0:
        up = levels[-1].select("rank", F.floor(F.col("block") / FAN).alias("block"), "doc_id", "size", "p", F.col("block").alias("child"))
        height += 1
        node = stored(up.groupBy("rank", "block").applyInPandas(_rounding(seed + height), ROUNDED), f"mix-level-{height}")
        solved.append(node)
        levels.append(node.where("rest is not null").select("rank", "block", "doc_id", "size", F.col("rest").alias("p")))
        most_blocks = -(-most_blocks // FAN)
    # down again: what a node's last fraction became above decides for the child that had it
    fate = levels[-1].select("rank", "block", (F.pmod(F.xxhash64("rank", F.lit(seed), F.lit("root")), F.lit(1 << 30)) / float(1 << 30) < F.col("p")).cast("int").alias("bit"))
    for node in reversed(solved):
        with_fate = node.join(fate, ["rank", "block"], "left")
        fate = with_fate.select("rank", F.col("child").alias("block"), F.when(F.col("rest").isNotNull(), F.col("bit")).otherwise(F.col("got")).alias("bit"))
    out = rounded.join(stored(fate, "mix-fate"), ["rank", "block"], "left")
    bit = F.when(F.col("rest").isNotNull(), F.col("bit")).otherwise(F.col("got"))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "source", "size", "source_size", "target", (F.col("whole") + bit).cast("int").alias("copies"), "text_hash")


def _carry(function):
    """function for a group of leaves, whose other columns are kept."""

    def carried(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "text_hash"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        out = function(key, rows).reset_index(drop=True)
        return pd.concat([out, rows[["source", "source_size", "target", "whole", "text_hash"]]], axis=1)

    return carried


def take(docs: DataFrame, **how) -> DataFrame:
    """docs, each row as often as the mix takes it. Rows that share a doc_id get their copies in any order among equals."""
    copies = _mixed(docs, **how)
    same = ["_mix_id", "_mix_hash", "_mix_source"]
    order = Window.partitionBy(*same).orderBy("_mix_copies")
    mine = copies.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_mix_id"), F.col("text_hash").alias("_mix_hash"), F.xxhash64("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"))
    mine = mine.withColumn("_mix_k", F.row_number().over(order))
    rows = docs.withColumn("_mix_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_mix_hash", F.xxhash64("text")).withColumn("_mix_source", F.xxhash64("source"))
    rows = rows.withColumn("_mix_k", F.row_number().over(Window.partitionBy(*same).orderBy("_mix_id")))
    both = rows.join(mine, [*same, "_mix_k"])
    again = both.where("_mix_copies > 0").withColumn("_mix_again", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return again.select(*(docs[c] for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
