"""Queries of tables with versions, of decisions as a stream, and of exact quantiles."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from orevein.operators import review as V
from orevein.operators.quantiles import quantiles
from orevein.session import shared
from orevein.sources import versioned
from orevein.streaming import decisions as D

from .harmonisation import _DECIDED_SQL, _made
from .views import as_reviews, purchases, reviews, sql, table


def _versions(s, d):
    """Matches and decisions in three versions: before any decision, with all of them, and after a run that finds every third match anew; a writer that has read the first is refused."""
    root = f"{shared(s)}/versions-{uuid.uuid4().hex}"
    every = _made(reviews(s, d))
    matches, decisions = every.select("match_id", "status").distinct(), every.drop("status")
    first = versioned.commit(s, root, 0, matches=matches, decisions=decisions.where(F.lit(False)))
    second = versioned.commit(s, root, first, matches=V.decided(matches, decisions).select("match_id", "status"), decisions=decisions)
    try:
        versioned.commit(s, root, first, matches=matches)
    except versioned.StaleVersion:
        refused = 1
    else:
        refused = 0
    third = V.replaced_by_run(s, root, second, matches.where("match_id % 3 = 0"))

    def held(version: int):
        said = versioned.as_of(s, root, "decisions", version).groupBy("match_id").agg(F.count("*").alias("c"))
        rows = versioned.as_of(s, root, "matches", version).join(said, "match_id", "left")
        out = rows.groupBy("status").agg(F.count("*").alias("matches"), F.coalesce(F.sum("c"), F.lit(0)).alias("decisions"), F.sum("match_id").alias("ids"))
        return out.withColumn("version", F.lit(version).cast("long")).withColumn("refused", F.lit(refused if version == second else 0).cast("long"))

    return reduce(lambda a, b: a.unionByName(b), map(held, (first, second, third)))


def _streamed(s, d):
    """The events as a stream, run to its end. None of them is late here: the stream waits for ten years of event time."""
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")  # a pattern: one file is no folder
    changes = D.decided_stream(_made(as_reviews(events)), late="3650 days")
    return D.run_to_end(changes, f"{shared(s)}/decisions-{uuid.uuid4().hex}")


def _prices(s, d):
    """Quartiles and the 99th percentile of what each enterprise pays a piece, and how many purchases cost more."""
    marks = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    out = quantiles(purchases(s, d), "unit_price", ["enterprise"], marks)
    return out.select("enterprise", "n", *(F.round(p, 4).alias(p) for p in marks), "above_p99")


QUERIES = {"review_versions": _versions, "decisions_streamed": _streamed, "price_quantiles": _prices}

_ENDS = _DECIDED_SQL.rsplit("SELECT match_id", 1)[0].rstrip()
ORACLE_SQL = {
    "review_versions": sql(f"""{_ENDS}, held AS (SELECT 1 AS version, match_id, CASE WHEN match_id % 7 = 0 THEN 'ALREADY_MAPPED' ELSE 'PENDING_REVIEW' END AS status, 0 AS c FROM lists
      UNION ALL SELECT 2, match_id, e.status, len(d) FROM ends JOIN lists USING (match_id) UNION ALL SELECT 3, match_id, CASE WHEN match_id % 7 = 0 THEN 'ALREADY_MAPPED' ELSE 'PENDING_REVIEW' END, 0 FROM lists WHERE match_id % 3 = 0)
      SELECT CAST(version AS BIGINT) AS version, status, count(*) AS matches, CAST(sum(c) AS BIGINT) AS decisions, CAST(sum(match_id) AS BIGINT) AS ids, CAST(version = 2 AS BIGINT) AS refused FROM held GROUP BY version, status"""),
    "decisions_streamed": sql(_DECIDED_SQL),
    "price_quantiles": sql("""SELECT enterprise, count(*) AS n, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p99, 4) AS p99, count(*) FILTER (WHERE unit_price > p99) AS above_p99 FROM purchases
      JOIN (SELECT enterprise, quantile_cont(unit_price, 0.25) AS p25, quantile_cont(unit_price, 0.5) AS p50, quantile_cont(unit_price, 0.75) AS p75, quantile_cont(unit_price, 0.99) AS p99 FROM purchases GROUP BY 1) USING (enterprise) GROUP BY ALL"""),
}
