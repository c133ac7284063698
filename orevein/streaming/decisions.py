"""The state machine of review decisions over a stream, with a state for each match."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN = ("PENDING_REVIEW", "GATE_1_APPROVED", "ALREADY_MAPPED")
_STATE = "status string, endorser string, errors long, n long, waiting array<struct<at:timestamp,decision_id:long,enterprise:string,verdict:string>>"
_CHANGE = "match_id long, status string, endorser string, decisions long, errors long"


def _next(status: str, endorser: str | None, errors: int, enterprise: str | None, verdict: str) -> tuple[str, str | None, int]:
    """One step of operators.review.decided."""
    accept, gate = verdict == "ACCEPT", status == "GATE_1_APPROVED"
    if status not in OPEN or (accept and gate and endorser == enterprise and enterprise is not None):
        return status, endorser, errors + 1
    if verdict == "DEFER":
        return status, endorser, errors
    if verdict == "OVERRIDE" or (accept and status != "PENDING_REVIEW"):
        return "ACCEPTED", endorser, errors
    if accept:
        return "GATE_1_APPROVED", enterprise, errors
    return ("DIFFERENT" if verdict == "DIFFERENT" or gate else "REJECTED"), endorser, errors


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


def decided_stream(decisions: DataFrame, late: str = "7 days", idle_days: int = 90) -> DataFrame:
    """Changes of matches as decisions come in: match_id, status, endorser, decisions, errors; of a match's rows the one with most decisions holds.

    decisions: match_id, decision_id, at (timestamp), enterprise, verdict, and status, the match's before any decision. Decisions count in order of time and id, however late they come
    within `late`: those behind the watermark are folded into the state, younger ones wait in it and are folded anew each time. Later ones are dropped by the watermark. A match
    without decisions for idle_days of event time gives its state up; a decision after that starts from its status column. Run to its end over decisions none of which is late or
    follows such a pause, the last rows equal operators.review.decided, wherever the stream was stopped and started again. Rows without match_id, at or verdict are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, endorser, errors, n, waiting = state.get if state.exists else (None, None, 0, 0, [])
        rows = [(w["at"], w["decision_id"], w["enterprise"], w["verdict"]) if isinstance(w, dict) else tuple(w) for w in waiting]
        for b in batches:
            status = b["status"].iloc[0] if status is None else status
            rows += [(r.at, int(r.decision_id), _plain(r.enterprise), r.verdict) for r in b.itertuples()]
        rows.sort(key=lambda r: (r[0], r[1]))
        mark = state.getCurrentWatermarkMs()
        settled = sum(pd.Timestamp(r[0]).timestamp() * 1000 < mark for r in rows)
        end = status, endorser, errors
        for k, r in enumerate(rows):
            end = _next(*end, r[2], r[3])
            if k + 1 == settled:
                status, endorser, errors = end
        state.update((status, endorser, errors, n + settled, rows[settled:]))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(rows[-1][0]).timestamp() * 1000), mark) + idle_days * 86_400_000)
        yield pd.DataFrame({"match_id": [key[0]], "status": [end[0]], "endorser": [end[1]], "decisions": [n + len(rows)], "errors": [end[2]]})

    whole = decisions.where("match_id is not null and at is not null and verdict is not null").select("match_id", "decision_id", F.col("at").cast("timestamp").alias("at"), "enterprise", "verdict", "status")
    return whole.withWatermark("at", late).groupBy("match_id").applyInPandasWithState(step, _CHANGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def last_changes(changes: DataFrame) -> DataFrame:
    """Of each match's changes the one with most decisions."""
    return changes.groupBy("match_id").agg(F.max_by(F.struct("status", "endorser", "errors"), "decisions").alias("x"), F.max("decisions").alias("decisions")).select("match_id", "x.status", "x.endorser", "decisions", "x.errors")


def run_to_end(changes: DataFrame, at: str) -> DataFrame:
    """All that is there now goes through the stream, from where the last call with the same folder stopped; the matches' last changes. `at` has to lie in a shared folder."""
    changes.writeStream.format("parquet").option("path", f"{at}/changes").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return last_changes(changes.sparkSession.read.schema(changes.schema).parquet(f"{at}/changes"))
