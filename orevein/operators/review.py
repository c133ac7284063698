"""Review decisions as transformations of tables: states of matches, mappings, upgrades, versions and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orevein.sources import versioned

#: Rank of a decision where two have the same time.
DECISIONS = ("ACCEPT", "REJECT", "DIFFERENT", "OVERRIDE", "DEFER")


def valid_decision(verdict: Column, rationale: Column) -> Column:
    """A known verdict with a reason, of ten characters or more for REJECT and DEFER."""
    text = F.length(F.trim(F.coalesce(rationale, F.lit(""))))
    return verdict.isin(*DECISIONS) & (text > 0) & (~verdict.isin("REJECT", "DEFER") | (text >= 10))


def decided(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """match_id, status, endorser, decisions, errors: each match after its decisions, in order of time and then id.

    matches: match_id, status; decisions: match_id, decision_id, at, enterprise, verdict. A first ACCEPT opens gate 1; one by another enterprise accepts; one by the same is an
    error and changes nothing. REJECT and DIFFERENT after an endorsement are a dispute, DIFFERENT. OVERRIDE accepts at once. Nothing follows a final state.
    """
    ordered = decisions.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("at", "decision_id", "enterprise", "verdict"))).alias("d"))
    at = matches.join(ordered, "match_id", "left")
    start = F.struct(F.col("status").alias("status"), F.lit(None).cast("string").alias("endorser"), F.lit(0).alias("errors"), F.lit(0).alias("n"))

    def step(s: Column, d: Column) -> Column:
        open_ = s["status"].isin("PENDING_REVIEW", "GATE_1_APPROVED", "ALREADY_MAPPED")
        accept, gate = d["verdict"] == "ACCEPT", s["status"] == "GATE_1_APPROVED"
        again = accept & gate & (s["endorser"] == d["enterprise"])
        status = (
            F.when(~open_ | again | (d["verdict"] == "DEFER"), s["status"]).when(d["verdict"] == "OVERRIDE", "ACCEPTED").when(accept & (gate | (s["status"] == "ALREADY_MAPPED")), "ACCEPTED")
            .when(accept, "GATE_1_APPROVED").when((d["verdict"] == "DIFFERENT") | gate, "DIFFERENT").otherwise("REJECTED")
        )
        first = open_ & accept & (s["status"] == "PENDING_REVIEW")
        return F.struct(status.alias("status"), F.when(first, d["enterprise"]).otherwise(s["endorser"]).alias("endorser"), (s["errors"] + F.when(~open_ | again, 1).otherwise(0)).alias("errors"), (s["n"] + 1).alias("n"))

    end = F.aggregate(F.coalesce("d", F.array().cast("array<struct<at:timestamp_ntz,decision_id:bigint,enterprise:string,verdict:string>>")), start, step)
    return at.select("match_id", end.alias("e")).select("match_id", "e.status", "e.endorser", F.col("e.n").cast("long").alias("decisions"), F.col("e.errors").cast("long").alias("errors"))


def mapped(accepted: DataFrame) -> DataFrame:
    """material, record, superseded: every mapping that acceptances made; the latest of a material is active. accepted: record, source, candidate, at."""
    each = accepted.select("record", "at", F.explode(F.array("source", "candidate")).alias("material"))
    order = Window.partitionBy("material").orderBy(F.col("at").desc(), F.col("record").desc())
    return each.withColumn("_k", F.row_number().over(order)).select("material", "record", F.when(F.col("_k") == 1, "ACTIVE").otherwise("SUPERSEDED").alias("state"))


def propagated(facts: DataFrame, mappings: DataFrame, material: str = "material_id") -> DataFrame:
    """facts with the record of their material's active mapping; what has none keeps the one it had."""
    active = mappings.where("state = 'ACTIVE'").select(F.col("material").alias("_m"), F.col("record").alias("_r"))
    kept = F.col("record") if "record" in facts.columns else F.lit(None).cast("string")
    return facts.join(active, F.col(material) == F.col("_m"), "left").withColumn("record", F.coalesce("_r", kept)).drop("_m", "_r")


def upgrades(matches: DataFrame, mappings: DataFrame, least: float = 0.85) -> DataFrame:
    """Open matches with one end in a record, sure enough, become ALREADY_MAPPED pairs of the other end and the record; the old ones are superseded.

    matches: match_id, source, candidate, confidence, category, status. A material that is mapped itself, or gets its pair from a surer match, gets none.
    """
    active = mappings.where("state = 'ACTIVE'").select("material", "record")
    open_ = matches.where("status in ('PENDING_REVIEW', 'GATE_1_APPROVED') and category <> 'DIFFERENT'").where(F.col("confidence") >= least)
    sides = open_.select("match_id", "confidence", F.col("source").alias("material"), F.col("candidate").alias("other")).unionByName(open_.select("match_id", "confidence", F.col("candidate").alias("material"), F.col("source").alias("other")))
    one = sides.join(active, "material").join(active.select(F.col("material").alias("other")), "other", "left_anti")
    order = Window.partitionBy("other", "record").orderBy(F.col("confidence").desc(), "match_id")
    return one.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("match_id", F.col("other").alias("material"), "record", "confidence", F.lit("ALREADY_MAPPED").alias("status"), F.lit("SUPERSEDED_BY_RECORD").alias("old_status"))


def evidence_hash(*columns: str) -> Column:
    """SHA-256 of the columns' values as JSON in order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def versions(events: DataFrame, key: str, *order: Column) -> DataFrame:
    """Events of an append-only log with the version that each made of its key."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def without_dataset(rows: DataFrame, replaced: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows that don't hang on a replaced dataset."""
    return rows.join(replaced.select(key).distinct(), key, "left_anti")


def notifications_read(notes: DataFrame, acted: DataFrame, key: str = "match_id") -> DataFrame:
    """notes with is_acted (and read) where their key is in acted."""
    done = acted.select(F.col(key).alias("_done")).distinct()
    hit = F.col("_done").isNotNull()
    return notes.join(done, F.col(key) == F.col("_done"), "left").withColumn("is_acted", F.col("is_acted") | hit).withColumn("is_read", F.col("is_read") | hit).drop("_done")


def unique_codes(rows: DataFrame, code: str, order: str) -> DataFrame:
    """rows whose repeated codes get -2, -3, … in order."""
    n = F.row_number().over(Window.partitionBy(code).orderBy(order))
    return rows.withColumn("unique_code", F.when(n == 1, F.col(code)).otherwise(F.concat_ws("-", F.col(code), n.cast("string"))))


def replaced_by_run(spark: SparkSession, root: str, expected: int, run: DataFrame) -> int:
    """A new version of the tables at root, in which a run's matches stand for all earlier ones and no decision on those is left; StaleVersion if expected isn't the last."""
    return versioned.commit(spark, root, expected, matches=run, decisions=versioned.as_of(spark, root, "decisions", expected).where(F.lit(False)))
