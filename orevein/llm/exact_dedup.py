"""Exact dedup with a log-structured merge index.

Every text gets a digest (SHA-256 of its normalised form), and digests come to the index in batches. Tasks keep a memtable digest ->
(smallest doc_id, rows) and flush it, when full, as a run sorted by digest; a batch's runs are merged into one table. Pages of a table have a Bloom
filter each. A batch is looked up before it comes in: filters are asked first, and only what they may hold is read. Compaction merges tables' sorted
runs, keeps the smallest identifier of a digest and adds up the rows. A digest that is met again, in its batch or in an earlier one, is a hit; the index
says which row of a hit stays, and hits are verified byte by byte. Digests that no filter knows are never compared with anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, filesystem, marked, new_path, read_documents, stored, without
from .textvec import mixed

#: Digests that a memtable holds before it is flushed, and a page at most; bits of filter and hashes for each digest.
MEMTABLE, FILTER_BITS, HASHES = 200_000, 10, 5
#: Tables on a level that set off its compaction; batches that a table of documents comes to the index in; digests that a bucket is meant to hold of a batch.
FANOUT, BATCHES, BUCKET = 4, 4, 100_000


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty. Lone spaces, which stay as they are, aren't matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest_of(text: Column, n_bytes: int = 32) -> Column:
    """The first n_bytes of the SHA-256. Fewer than 32 serve to test what happens when digests collide."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, n_bytes)


def _places(digests: list[bytes], m: int) -> np.ndarray:
    """A row for each digest: its HASHES places in a filter of m bits."""
    both = np.frombuffer(b"".join(bytes(d)[:16].ljust(16, b"\0") for d in digests), np.uint64).reshape(-1, 2)
    a, b = mixed(both[:, :1] + np.uint64(1)), mixed(both[:, :1] ^ mixed(both[:, 1:] + np.uint64(2))) | np.uint64(1)
    return ((a + np.arange(HASHES, dtype=np.uint64) * b) % np.uint64(m)).astype(np.int64)


def bloom(digests: list[bytes]) -> bytes:
    m = max(64, len(digests) * FILTER_BITS + 7 & ~7)
    bits = np.zeros(m, np.uint8)
    bits[_places(digests, m)] = 1
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, digests: list[bytes]) -> np.ndarray:
    """For each digest whether it may be among those that the filter was made of; never False for one that is."""
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bits[_places(digests, len(bits))].all(axis=1)


#: A run's rows are its entries (digest, doc_id, n) and, for each page, a row with the filter alone. A page is a stretch of a run in one bucket.
RUN = "page string, bucket int, digest binary, doc_id bigint, n bigint, filter binary"
ARROW = pa.schema([("page", pa.string()), ("bucket", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("filter", pa.binary())])
ENTRY = "digest binary, doc_id bigint, n bigint"


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _flushing(memtable: int):
    """Rows (digest, doc_id, n) in any order to runs of entries, each sorted by digest."""

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, tuple] = {}

        def run() -> pa.RecordBatch:
            keys = sorted(table)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([table[d][0] for d in keys], pa.int64()), pa.array([table[d][1] for d in keys], pa.int64())], names=["digest", "doc_id", "n"])

        for batch in batches:
            for d, i, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc_id", "n")), strict=True):
                was = table.get(d)
                if was is None and len(table) >= memtable:
                    yield run()
                    table = {}
                table[d] = (i, n) if was is None else (_least(was[0], i), was[1] + n)
        if table:
            yield run()

    return flush


def _paging(name: str, memtable: int, bits: int):
    """Entries in the order of digests to RUN: entries of one digest become one, and pages get their filters."""

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, bucket, page = TaskContext.get().partitionId(), 0, None, []

        def out() -> pa.RecordBatch:
            n = len(page)
            digests = [x[0] for x in page]
            columns = [[f"{name}/{part:06d}-{k:06d}"] * (n + 1), [bucket] * (n + 1), [*digests, None], [*(x[1] for x in page), None], [*(x[2] for x in page), None], [None] * n + [bloom(digests)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for d, i, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc_id", "n")), strict=True):
                if page and page[-1][0] == d:
                    page[-1] = (d, _least(page[-1][1], i), page[-1][2] + n)
                    continue
                here = int.from_bytes(d[:3].ljust(3, b"\0"), "big") >> (24 - bits)
                if page and (here != bucket or len(page) >= memtable):
                    yield out()
                    k, page = k + 1, []
                bucket = here
                page.append((d, i, n))
        if page:
            yield out()

    return paged


class MergeIndex:
    """Tables of sorted runs, in levels, below root, which all executors share.

    A batch becomes level 0's next table; FANOUT tables of a level are compacted into one of the next. A new table is written whole
    before the index takes it up and those it replaces are deleted, so a job that dies leaves the index as it was.
    bucket_bits: leading bits of a digest (24 at most) that name its bucket; a bucket's part of one lookup fits a task.
    """

    def __init__(self, spark: SparkSession, root: str, memtable: int = MEMTABLE, bucket_bits: int = 8):
        self.spark, self.root, self.memtable, self.bits = spark, root, memtable, bucket_bits
        self.tables: list[tuple[int, str]] = []  # level, path
        self._next = 0

    def _written(self, entries: DataFrame, level: int) -> tuple[int, str]:
        """Sorted runs (digest, doc_id, n) merged into one table: a digest's entries meet in one task, of which there are as many as runs."""
        name, self._next = f"level-{level}-{self._next:04d}", self._next + 1
        path = f"{self.root}/{name}"
        merged = entries.repartitionByRange("digest").sortWithinPartitions("digest")
        merged.mapInArrow(_paging(name, self.memtable, self.bits), RUN).write.mode("overwrite").parquet(path)
        return level, path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def _entries(self, paths: list[str]) -> DataFrame:
        return self._read(paths).where("filter is null").select("digest", "doc_id", "n")

    def add(self, rows: DataFrame) -> DataFrame:
        """Take up rows (digest, doc_id; one for each document), written down. Returns the entries (digest, doc_id, n) that the batch has come to, as they were before any compaction."""
        typed = rows.select("digest", F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n"))
        flushed = stored(typed.mapInArrow(_flushing(self.memtable), ENTRY), "runs")
        table = self._written(flushed, 0)
        self.tables.append(table)
        again = stored(self._entries([table[1]]).where("n > 1"), "met-again")
        level = 0
        while len(mine := [p for k, p in self.tables if k == level]) >= FANOUT:
            self._merge(mine, level + 1)
            level += 1
        return again

    def compact(self) -> None:
        """All tables into one whose digests are unique."""
        self._merge([p for _, p in self.tables], max((k for k, _ in self.tables), default=0) + 1)

    def _merge(self, paths: list[str], level: int) -> None:
        if not paths:
            return
        new = self._written(self._entries(paths), level)
        self.tables = [t for t in self.tables if t[1] not in paths] + [new]
        for p in paths:
            fs, at = filesystem(self.spark, p)
            fs.delete(at, True)

    def entries(self) -> DataFrame:
        """digest, doc_id (the smallest), n (rows)."""
        if not self.tables:
            return self.spark.createDataFrame([], ENTRY)
        rows = self._entries([p for _, p in self.tables])
        return rows if len(self.tables) == 1 else rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))

    def find(self, rows: DataFrame) -> DataFrame:
        """What the index holds of the digests in rows: digest, doc_id, n. Pages' filters are asked first; entries that can't be among those found stay where they are."""
        if not self.tables:
            return self.entries()
        bucket = F.shiftright(F.conv(F.hex(F.rpad(F.substring("digest", 1, 3), 3, F.lit(b"\0"))), 16, 10).cast("int"), 24 - self.bits)
        asked = rows.where("digest is not null").select("digest").distinct().withColumn("bucket", bucket)
        runs = self._read([p for _, p in self.tables])

        def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            digests, found = left["digest"].tolist(), []
            for page, bits in zip(right["page"], right["filter"], strict=True):
                found += [(page, digests[j]) for j in np.flatnonzero(may_hold(bits, digests))] if digests else []
            return pd.DataFrame(found, columns=["page", "digest"])

        filters = runs.where("filter is not null").select("bucket", "page", "filter")
        live = stored(asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "page string, digest binary"), "live")
        held = marked(runs.where("filter is null").select("page", "digest", "doc_id", "n"), F.xxhash64("digest"), live.select(F.xxhash64("digest").alias("key")))
        return held.join(live, ["page", "digest"]).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, n_bytes: int = 32, batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id long, text string).

    Texts are equal when they are after normalised(); null equals empty. The row with the smallest doc_id stays. A repeated row
    counts in group_size; rows that share the smallest doc_id are all kept. A null doc_id is never the smallest, unless a group has
    none but nulls, which then all stay with a null keep_id. An empty table gives no rows. Other columns are left alone. In how many batches the
    documents come to the index changes nothing in the result.
    """
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    rows = rows.withColumn("digest", F.substring("sha", 1, n_bytes))
    digests = stored(rows.select("doc_id", "sha", "digest"), "digests")
    bits = min(24, max(4, math.ceil(math.log2(max(1, digests.count() / batches / BUCKET)))))
    index = MergeIndex(docs.sparkSession, new_path(docs.sparkSession, "merge-index"), bucket_bits=bits)
    met = []
    for k in range(batches):
        batch = digests.where(F.pmod(F.xxhash64("doc_id", "sha"), F.lit(batches)) == k).select("digest", "doc_id")
        if index.tables:
            met.append(stored(index.find(batch).select("digest"), "found"))
        met.append(index.add(batch).select("digest"))
    hits = met[0]
    for more in met[1:]:
        hits = hits.unionByName(more)
    hits = stored(index.find(hits), "hits")
    # hits' texts, byte by byte; rows that can't be hits don't move, and copies collapse where they are
    again = marked(rows, F.xxhash64("digest"), hits.select(F.xxhash64("digest").alias("key")))
    by_text = again.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    collided = stored(by_text.groupBy("digest").agg(F.count("*").alias("_texts")).where("_texts > 1").select("digest"), "collided")
    verified = hits.select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    if collided.isEmpty():
        return _as_groups(attached(digests, verified, ["digest"], "group_size"))
    # digests that different texts share: their rows are parted by their texts
    sure = attached(stored(digests.join(collided, "digest", "left_anti"), "sure"), stored(verified.join(collided, "digest", "left_anti"), "verdicts"), ["digest"], "group_size")
    apart = again.join(collided, "digest", "left_semi").join(by_text, ["digest", "text"]).drop("text")
    return _as_groups(sure.unionByName(apart.select(*sure.columns)))


def _as_groups(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size") > 1, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups() keeps, as they were. Rows that can't be dropped ones aren't shuffled."""
    gone = exact_groups(docs).where("not kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.col("text_sha256").alias("_gone_sha")).distinct()
    gone = stored(gone, "copies")
    return without(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), gone, {"_gone_sha": F.sha2(normalised(F.col("text")), 256)})


#: Stands for a null doc_id in keys.
NO_ID = -(1 << 63)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_documents(spark, sf_dir))


OP10_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
