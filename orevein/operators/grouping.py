"""Common records from accepted pairs: components, cliques, consolidated attributes, codes and the crosswalk of legacy codes.

The behaviour of this part is specified by tests of the reference only; its implementation isn't there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orevein.functions.ids import content_code, uuid5
from orevein.session import prepare


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) for edges (a, b).

    By turns each node's larger neighbours, then its smaller ones, are linked to the smallest node around; the number of links never grows, and the number of rounds goes with the
    logarithm of a component's size. A round is checkpointed once, so that lineage doesn't grow.
    """
    prepare(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    was = None
    for _ in range(most_rounds):
        is_now = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if is_now == was:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        was = is_now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = small.where("a <> b").distinct().checkpoint()
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def grouped(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Every row with the component of its key and that component's members: rows without an edge are groups of one."""
    at = rows.join(components(edges).withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    sizes = at.groupBy("component").agg(F.count("*").alias("members"))
    return at.join(sizes, "component")


#: Links and barred pairs of a component, together, that one task takes through in order; larger components are split in rounds.
SMALL = 100_000


def cliques(edges: DataFrame, barred: DataFrame, most_rounds: int = 100, small: int | None = None) -> DataFrame:
    """node, component, clique (its least node): components split so that no two members are barred pairs (a, b).

    The outcome is that of taking edges (a, b, score) by score, then ends, each of which merges its ends' groups unless that would put a barred pair together. Components of `small` links and barred pairs at most (SMALL, if not said
    otherwise) are taken through in that order, a component in a task. Larger ones go in rounds: of the edges between groups that aren't barred from each other, one that is the best at
    both ends merges there and then, as nothing that comes before it touches either; so does one that is the best of a group that isn't barred from any other, as nothing can come to bar it. An edge between groups that are barred from each other is out for
    good. So no large component lies in one task, and components without barred pairs, whatever their size, take a few rounds.
    """

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        """node, component, clique of one component. rows: component, a, b, barred, first (no score), s (the score's negative)."""
        found = {n: n for n in pd.unique(pd.concat([rows["a"], rows["b"]]))}
        members, apart = {n: [n] for n in found}, {n: set() for n in found}
        for a, b in rows.loc[rows["barred"], ["a", "b"]].itertuples(index=False, name=None):
            apart[a].add(b)
            apart[b].add(a)
        links = rows[~rows["barred"]].sort_values(["first", "s", "a", "b"], ascending=[False, True, True, True])
        for a, b in links[["a", "b"]].itertuples(index=False, name=None):
            x, y = found[a], found[b]
            if x == y or y in apart[x]:
                continue
            x, y = min(x, y), max(x, y)  # a group has the name of its least node
            for n in members[y]:
                found[n] = x
            members[x] += members.pop(y)
            for z in apart.pop(y):
                apart[z].discard(y)
                apart[z].add(x)
                apart[x].add(z)
        return pd.DataFrame({"node": list(found), "component": rows["component"].iloc[0], "clique": list(found.values())})

    prepare(edges.sparkSession)
    pairs = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score")).checkpoint()
    at = components(pairs).checkpoint()
    # what bars nodes of two components from each other never matters
    of = at.select(F.col("node").alias("a"), "component")
    inside = barred.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(of, "a").join(of.select(F.col("a").alias("b"), F.col("component").alias("_other")), "b").where("component = _other")
    links = pairs.join(of, "a").select("component", "a", "b", F.lit(False).alias("barred"), F.col("score").isNull().alias("first"), "score")
    both = links.unionByName(inside.select("component", "a", "b", F.lit(True).alias("barred"), F.lit(False).alias("first"), F.lit(None).cast(pairs.schema["score"].dataType).alias("score"))).checkpoint()
    sizes = both.groupBy("component").agg((F.count("*") > F.lit(SMALL if small is None else small)).alias("large")).checkpoint()
    few = both.join(sizes.where("not large"), "component").select("component", "a", "b", "barred", "first", F.coalesce(-F.col("score"), F.lit(0).cast(pairs.schema["score"].dataType)).alias("s"))
    kind = pairs.schema["a"].dataType.simpleString()
    done = few.groupBy("component").applyInPandas(in_order, f"node {kind}, component {kind}, clique {kind}")
    many = sizes.where("large").select("component")
    if many.isEmpty():
        return done
    return done.unionByName(_in_rounds(both.join(many, "component"), at.join(many, "component"), most_rounds))


def _in_rounds(both: DataFrame, at: DataFrame, most_rounds: int) -> DataFrame:
    """As cliques(): node, component, clique of the components in at, whose links and barred pairs are in both."""
    left = both.where("not barred").select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct((-F.col("score")).alias("s"), "a", "b").alias("k")).checkpoint()
    bars = both.where("barred").select(F.col("a").alias("x"), F.col("b").alias("y")).checkpoint()
    groups = at.select("node", F.col("node").alias("clique")).checkpoint()
    for _ in range(most_rounds):
        left = left.join(bars, ["x", "y"], "left_anti").groupBy("x", "y").agg(F.min("k").alias("k")).checkpoint()
        if left.isEmpty():
            return groups.join(at, "node").select("node", "component", "clique")
        ends = left.select("x", "k").unionByName(left.select(F.col("y").alias("x"), "k")).groupBy("x").agg(F.min("k").alias("best"))
        ends = ends.join(bars.select("x").unionByName(bars.select(F.col("y").alias("x"))).distinct().withColumn("bound", F.lit(True)), "x", "left")
        both = left.join(ends.withColumnsRenamed({"best": "bx", "bound": "cx"}), "x").join(ends.withColumnsRenamed({"x": "y", "best": "by", "bound": "cy"}), "y")
        best_x, best_y = F.col("k") == F.col("bx"), F.col("k") == F.col("by")
        taken = both.where((best_x & best_y) | (best_x & F.col("cx").isNull()) | (best_y & F.col("cy").isNull()))
        new = components(taken.select(F.col("x").alias("a"), F.col("y").alias("b")))

        def renamed(rows: DataFrame, column: str, new: DataFrame = new) -> DataFrame:
            named = new.select(F.col("node").alias(column), F.col("component").alias("_to"))
            return rows.join(named, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        groups = renamed(groups, "clique").checkpoint()
        left = renamed(renamed(left, "x"), "y").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "k")
        bars = renamed(renamed(bars, "x"), "y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().checkpoint()
    raise RuntimeError(f"cliques have not settled in {most_rounds} rounds")


def governance(members: Column, split: Column, ambiguous: Column) -> Column:
    """State of a record that no one has signed off; APPROVED_MASTER is never given here."""
    return F.when(split, "SPLIT_CONFLICT").when(members == 1, "STANDALONE_CANDIDATE").when(ambiguous, "AMBIGUOUS_REVIEW_REQUIRED").otherwise("VERIFIED_HARMONIZED")


def consolidated(rows: DataFrame, key: str, attribute: str) -> DataFrame:
    """One value of an attribute for each group: the common one, else the longest if it contains all others, else UNRESOLVED_CONFLICT."""
    values = rows.groupBy(key).agg(F.array_sort(F.collect_set(attribute)).alias("v"))
    longest = F.element_at(F.array_sort(F.transform("v", lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    all_in = F.forall("v", lambda x: F.contains(longest, x))
    value = F.when(F.size("v") == 0, None).when(all_in, longest).otherwise(F.concat(F.lit("UNRESOLVED_CONFLICT: "), F.array_join("v", " / ")))
    return values.select(key, value.alias("value"), ((F.size("v") > 0) & ~all_in).alias("conflict"))


def coded(records: DataFrame, prefix: str, family: str, content: str) -> DataFrame:
    """records with a code of their content; those that share family and hash are numbered by content."""
    stem = F.sha2(F.col(content), 256)
    order = Window.partitionBy(family, F.substring(stem, 1, 6)).orderBy(content)
    return records.withColumn("_n", F.row_number().over(order)).withColumn("code", content_code(prefix, F.col(family), F.col(content), F.col("_n"))).drop("_n")


def crosswalk(materials: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row for each (enterprise, material_code) of materials: mapped by an accepted pair, or on its own. Nothing is inferred across pairs.

    materials: enterprise, material_code, record; accepted: record, pair_id. mapping_id is a UUID of the row's content.
    """
    first = accepted.groupBy("record").agg(F.min("pair_id").alias("pair_id"))
    at = materials.join(first, "record", "left")
    found = F.col("pair_id").isNotNull()
    name = F.concat_ws(":", F.lit("LEGACY_MAP"), "enterprise", "material_code", "record")
    return at.select(
        "enterprise", "material_code", "record", "pair_id", F.when(found, "MAPPED_VERIFIED").otherwise("MAPPED_STANDALONE").alias("status"), F.when(found, "DIRECT_ACCEPTED").otherwise("STANDALONE").alias("method"),
        F.when(found, "VERIFIED_CROSS_ENTERPRISE").otherwise("STANDALONE_IDENTITY").alias("basis"), F.lit(1.0).alias("confidence"), uuid5(name).alias("mapping_id"),
    )
