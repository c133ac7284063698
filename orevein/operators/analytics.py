"""Dashboards: distributions, histograms, pairs of enterprises, trends, queues and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def top_with_missing(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, null as <MISSING>, with their share of all rows in per cent; ties go by value."""
    whole = rows.agg(F.count("*").alias("whole"))
    named = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<MISSING>")).alias("value")).agg(F.count("*").alias("n"))
    best = named.orderBy(F.col("n").desc(), "value").limit(n)
    return best.withColumn("whole", whole.scalar()).select("value", "n", F.round(F.col("n") * 100 / F.col("whole"), 2).alias("pct"))


def banded(value: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[k] for values from edges[k] on, labels[-1] below all edges and for null; edges fall."""
    out = F.when(value >= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(value >= edge, label)
    return out.otherwise(labels[-1])


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Links from one enterprise to another: how many and how sure on average. pairs: source, target, confidence."""
    return pairs.groupBy("source", "target").agg(F.count("*").alias("links"), F.round(F.avg("confidence") * 100, 1).alias("confidence_pct"))


def unordered(stats: DataFrame) -> DataFrame:
    """Of both directions of a pair, the one with more links (then the first by name)."""
    order = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy(F.col("links").desc(), "source")
    return stats.where("source <> target").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def shared_records(members: DataFrame) -> DataFrame:
    """Pairs of enterprises that meet in a common code, and in how many. members: common_code, enterprise."""
    each = members.select("common_code", "enterprise").distinct()
    left, right = each.withColumnRenamed("enterprise", "a"), each.withColumnRenamed("enterprise", "b")
    return left.join(right, "common_code").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def record_confidence(mappings: DataFrame, matches: DataFrame) -> DataFrame:
    """Each record's mappings and the mean confidence over matches that touch any of them, on either side.

    The condition source = m OR candidate = m is two equi-joins; a match that has both ends in a mapping counts once for it, and once
    for each of a record's mappings that it touches. mappings: record, material; matches: source, candidate, confidence.
    """
    by_source = mappings.join(matches, mappings.material == matches.source).select("record", "material", "confidence")
    by_candidate = mappings.join(matches.where("source <> candidate"), mappings.material == matches.candidate).select("record", "material", "confidence")
    sums = by_source.unionByName(by_candidate).groupBy("record").agg(F.avg("confidence").alias("c"), F.count("*").alias("links"))
    own = mappings.groupBy("record").agg(F.count("*").alias("materials"))
    return own.join(sums, "record", "left").select("record", "materials", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("confidence"), F.when(F.col("materials") >= 2, "MAPPED").otherwise("DRAFT").alias("status"))


def daily(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def cumulative(days: DataFrame) -> DataFrame:
    """Running sum over days; its rows are days, not events."""
    return days.withColumn("running", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def merged_decisions(audit: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each match and action of two logs: the audit's before the decision's, then the smallest id. Both: match_id, action, event_id."""
    both = audit.withColumn("source", F.lit(0)).unionByName(decisions.withColumn("source", F.lit(1)))
    order = Window.partitionBy("match_id", "action").orderBy("source", "event_id")
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("match_id", "action", "event_id", F.when(F.col("source") == 0, "AUDIT").otherwise("DECISION").alias("source"))


def window_or_last_day(reviews: DataFrame, as_of: str, hours_ahead: float = 5.5) -> DataFrame:
    """Counts of the day that as_of falls on at a place hours_ahead of UTC; if it has none, of the 24 hours before as_of."""
    at = F.lit(as_of).cast("timestamp_ntz")
    minutes = F.expr(f"make_dt_interval(0, 0, {int(hours_ahead * 60)}, 0)")
    today = F.to_date(F.col("ts") + minutes) == F.to_date(at + minutes)
    recent = (F.col("ts") > at - F.expr("interval 24 hours")) & (F.col("ts") <= at)
    both = reviews.where(today | recent).groupBy("action").agg(F.count_if(today).alias("today"), F.count_if(recent).alias("recent"))
    any_today = F.sum("today").over(Window.partitionBy()) > 0
    return both.select("action", F.when(any_today, F.col("today")).otherwise(F.col("recent")).alias("n"), F.when(any_today, "TODAY").otherwise("LAST_24H").alias("window"))


def search(rows: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows with the term in one of the columns, whatever the case; % and _ are ordinary."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower()))
    return rows.where(hit)


#: Tabs of the review queue, as conditions on action and confidence.
TABS = {
    "pending": "action = 'click'",
    "alerts": "action = 'error' and confidence >= 0.5",
    "awaiting_peer": "action = 'view' and confidence >= 0.7",
    "different": "action = 'error' and confidence < 0.5",
    "mapped": "action = 'purchase'",
    "high": "confidence >= 0.70",
    "medium": "confidence >= 0.40 and confidence < 0.70",
    "all": "true",
}


def tab_counts(rows: DataFrame, tabs: dict[str, str]) -> DataFrame:
    """Rows of each tab, counted in one pass; a row can be in several."""
    one = rows.agg(*(F.count_if(F.expr(c)).alias(t) for t, c in tabs.items()))
    return one.select(F.expr("stack(" + str(len(tabs)) + ", " + ", ".join(f"'{t}', `{t}`" for t in tabs) + ") as (tab, n)"))


def progress(rows: DataFrame, key: str, done: Column, n: int) -> DataFrame:
    """The n largest groups with how much of each is done; names get one capital."""
    name = F.concat(F.upper(F.substring(key, 1, 1)), F.lower(F.substring(key, 2, 120)))
    out = rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.count_if(done).alias("done"))
    return out.withColumn("done_pct", F.round(F.col("done") * 100 / F.col("n"), 1)).orderBy(F.col("n").desc(), "name").limit(n)


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where a denominator is."""
    c = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, n, pct (of the first stage) of tables that a catalog passes through, in order."""
    out = None
    for k, (name, rows) in enumerate(stages.items()):
        one = rows.agg(F.lit(k).alias("place"), F.lit(name).alias("stage"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    first = next(iter(stages.values())).agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.round(F.coalesce(F.try_divide(F.col("n") * 100, first.scalar()), F.lit(0.0)), 1))


def confidence_index(matches: DataFrame, default: float = 0.96) -> DataFrame:
    """Mean confidence in per cent: of settled matches, else of sure ones, else of all, else the default."""
    c = F.col("confidence")
    settled = F.avg(F.when(F.col("status").isin("ACCEPTED", "GATE_1_APPROVED", "SUPERSEDED_BY_CMM"), c))
    return matches.agg(F.round(F.coalesce(settled, F.avg(F.when(c >= 0.8, c)), F.avg(c), F.lit(default)) * 100, 1).alias("confidence_index"))


def roster(reviewers: DataFrame, decisions: DataFrame, most: int = 50) -> DataFrame:
    """Reviewers with their decisions and the last of them. A decision names a reviewer by id, name or key; one that two of these match counts once. most is the report's length."""
    named = None
    for key in ("reviewer_id", "name", "key"):
        hit = decisions.join(reviewers.select("reviewer_id", F.col(key).cast("string").alias("_by")).where("_by is not null"), F.col("reviewer") == F.col("_by")).select("reviewer_id", "decision_id")
        named = hit if named is None else named.unionByName(hit)
    own = named.distinct().groupBy("reviewer_id").agg(F.count("*").alias("decisions"), F.max("decision_id").alias("last"))
    return reviewers.join(own, "reviewer_id", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0).cast("long"))).orderBy(F.col("decisions").desc(), "reviewer_id").limit(most)
