"""Periodic runs of words: stretches that repeat themselves at least LEAST_EXPONENT times.

The words of a text become numbers, and the array of numbers is compared with itself at every shift (lag) that a run can have as its period. A run of
period p is a stretch of 2p places or more at which the array equals itself p places on, so it can't slip between places that stand half a p apart:
of each lag all such places are compared at once, and a lag that shows several equal ones in a row is compared at every place and its equal
stretches are measured. That is n log n comparisons for a text without runs, and loses nothing.

A text of up to PIECE bytes is searched by one task. Of a longer one, ranges of lags are dealt out over the cluster, and what they find meets again
by document.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, stored

#: A run has so many words at least, and repeats its period so many times.
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: UTF-8 bytes of a text for each range of lags.
PIECE = 1 << 16
#: Equal places in a row that a lag has to show; places compared at once.
PROBES, BLOCK = 4, 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
OUT_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def rewritten(doc_id: int | None, words: list[str]) -> list[str]:
    """One document in ten, by the CRC-32 of its id, has its words from some place on replaced by a repetition of the first few of them. Without an id: as it is."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbered(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _need(lag: np.ndarray | int):
    """Equal places in a row that a run of this period has at least."""
    return np.maximum(LEAST_LENGTH - lag, (LEAST_EXPONENT - 1) * lag)


def _promising(ids: np.ndarray, lo: int, hi: int) -> Iterator[int]:
    """The lags in [lo, hi) at which PROBES places in a row, of those a PROBES-th of the least stretch apart, are equal: every lag with a run is among them."""
    n, lags = len(ids), np.arange(lo, hi)
    step = np.maximum(_need(lags) // PROBES, 1)
    count = (n - lags - 1) // step + 1
    upto = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(lags):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + BLOCK, "right")) - 1)
        owner = np.repeat(np.arange(a, b), count[a:b])
        at = (np.arange(upto[a], upto[b]) - upto[owner]) * step[owner]
        same = ids[at] == ids[at + lags[owner]]
        row = same[PROBES - 1 :].copy()
        for j in range(PROBES - 1):
            row &= same[j : len(same) - PROBES + 1 + j]
        row &= owner[PROBES - 1 :] == owner[: len(same) - PROBES + 1]
        yield from lags[np.unique(owner[np.flatnonzero(row)])].tolist()
        a = b


def longest_lag(n: int) -> int:
    return n // LEAST_EXPONENT if n >= LEAST_LENGTH else 0


def runs_of(ids: np.ndarray, lo: int = 1, hi: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose period lies in [lo, hi), by start and period. A run is also equal to itself at multiples of its period; of these the smallest in the range counts."""
    found: dict[tuple[int, int], int] = {}
    hi = min(longest_lag(len(ids)) + 1, len(ids) + 1 if hi is None else hi)
    for lag in _promising(ids, lo, hi) if lo < hi else ():
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[lag:] == ids[:-lag], [False]])))
        begin, end = edges[::2], edges[1::2]
        for k in np.flatnonzero(end - begin >= _need(lag)):
            found.setdefault((int(begin[k]), int(end[k] - begin[k] + lag)), lag)
    return sorted((s, n, p) for (s, n), p in found.items())


def merged(runs: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of several ranges of lags: of equal stretches the one with the smallest period."""
    found: dict[tuple[int, int], int] = {}
    for s, n, p in runs:
        found[s, n] = min(p, found.get((s, n), p))
    return sorted((s, n, p) for (s, n), p in found.items())


def digest(doc_id: int | None, words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of OUT."""
    best = None
    for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    if runs:
        step = np.zeros(len(words) + 1, np.int32)
        for s, n, p in runs:
            step[s + p] += 1
            step[s + n] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (listed, " ".join(words))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def _words(doc_id: int | None, text: str | None) -> list[str]:
    return rewritten(doc_id, _WORD.findall(text or ""))


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [digest(i, w, runs_of(numbered(w))) for i, text in _rows(batch, "doc_id", "text") for w in [_words(i, text)]]
        yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r, strict=True)) for r in out], schema=OUT)


PARTS = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("runs", pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64()), ("p", pa.int64())])))])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, sha, text, k, n in _rows(batch, "doc_id", "sha", "text", "piece", "pieces"):
            ids = numbered(_words(i, text))
            most = longest_lag(len(ids))
            runs = runs_of(ids, 1 + most * k // n, 1 + most * (k + 1) // n)
            yield pa.RecordBatch.from_pylist([{"doc_id": i, "sha": sha, "runs": [{"s": s, "n": m, "p": p} for s, m, p in runs]}], schema=PARTS)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text, runs in _rows(batch, "doc_id", "text", "runs"):
            out = digest(i, _words(i, text), merged((r["s"], r["n"], r["p"]) for part in runs for r in part))
            yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, out, strict=True))], schema=OUT)


def periodic_runs(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """OUT for every row of docs (doc_id long, text string; other columns are left alone).

    A null or empty text has no words, no run and the hash of the empty string. A null doc_id leaves the words as they are. Repeated rows are all returned,
    with the same values. An empty table gives no rows. Words are compared as they are, not by hashes. A text, its numbers and its runs have to fit into a task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = docs.where(size <= piece).mapInArrow(_whole, OUT_SQL)
    long_ = docs.where(size > piece).withColumn("sha", F.sha2("text", 256))
    each = long_.dropDuplicates(["doc_id", "sha"]).withColumn("pieces", F.ceil(size / piece).cast("int"))
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).repartition("doc_id", "sha", "piece")
    parts = stored(each.mapInArrow(_pieces, "doc_id long, sha string, runs array<struct<s: long, n: long, p: long>>"), "lag-ranges")
    # the pieces of a document, each with the runs it has found: fewer than the document has words
    found = parts.groupBy("doc_id", "sha").agg(F.collect_list("runs").alias("runs")).withColumnsRenamed({"doc_id": "_i", "sha": "_sha"})
    whole = long_.join(found, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("sha") == F.col("_sha")))
    return short.unionByName(whole.select("doc_id", "text", "runs").mapInArrow(_together, OUT_SQL))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_documents(spark, sf_dir))


#: Equal words of a text that stand a lag apart, gathered into stretches (gaps and islands); CRC-32 of the id by its table, which its polynomial gives.
OP13_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h FROM documents, crc),
placed AS (SELECT r, doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
rewritten AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w FROM placed),
tokens AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM rewritten),
met AS (SELECT f.r, g.i - f.i AS p, f.i FROM tokens f JOIN tokens g ON f.r = g.r AND f.x = g.x AND g.i > f.i AND g.i - f.i <= f.n // 3),
stretches AS (SELECT r, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM met) GROUP BY r, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT r, s, l, min(p) AS p FROM stretches GROUP BY r, s, l),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS listing FROM runs GROUP BY r),
best AS (SELECT r, s, l, p FROM runs WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.r = runs.r AND (o.l * runs.p > runs.l * o.p OR o.l * runs.p = runs.l * o.p AND (o.s < runs.s OR o.s = runs.s AND o.p < runs.p)))),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS collapsed FROM tokens ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, p AS period, 1000 * l // p AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM rewritten LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
