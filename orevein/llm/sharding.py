"""Sharding by sampled splitters.

Records are put in the order of (hash of the text, doc_id). A size-weighted sample of these keys gives
splitters at equal steps of the sampled size; every record goes to the range between two of them. Ranges
are counted exactly, overfull ones get splitters of their own from denser samples until none is overfull, and the
exact running size over ranges and within each range puts every record into one of the shards. Sizes of shards
thus differ by about one record, whatever the sample's luck; the sample only decides how evenly the work is dealt.
Splitters and totals of ranges are tables of MOST_RANGES rows or a few times as many, whatever the input.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored

#: Ranges for each shard, at least; rows of a range that are aimed at; ranges, at most (above ROWS_A_RANGE times as many rows, ranges get longer); sampled keys for each range.
RANGES_A_SHARD, ROWS_A_RANGE, MOST_RANGES, KEYS_A_RANGE = 4, 1_000_000, 4096, 40
#: A range is overfull with so many times the mean size, unless a single record makes it so. Rounds of subdivision, at most: the next sample is the denser the fuller a range is, so one is the rule.
OVERFULL, ROUNDS = 2.0, 8
#: Splitters in a group: a key is counted in among the groups' first ones, and then within a group.
GROUP = 64
KEY = ["h", "i", "u"]


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5: equal texts stand side by side, others anywhere, and any engine can tell where."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and 16 for the record's frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _sampled(keys: DataFrame, total: float, n_ranges: int, seed: int) -> DataFrame:
    """KEY of splitters at equal steps of size, of a sample that takes a key with a chance in proportion to its size.

    The sample holds KEYS_A_RANGE * n_ranges keys on average, whatever the input's length; these alone go through one task. Its chance comes from
    a hash of the key, so that a task run again draws the same sample.
    """
    step = total / (n_ranges * KEYS_A_RANGE)
    u = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = keys.where(u < F.col("size") / step).select(*KEY, F.greatest("size", F.lit(step)).alias("w"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = drawn.select(*KEY, "w", F.sum("w").over(Window.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)).alias("at"), (F.sum("w").over(every) / n_ranges).alias("share"))
    return upto.where(F.floor(F.col("at") / F.col("share")) > F.floor((F.col("at") - F.col("w")) / F.col("share"))).select(*KEY)


def _range_of(splitters: DataFrame) -> Column:
    """The number of splitters below a row's key. Splitters, a few for each range at most, go into the plan as one literal."""
    every = sorted((tuple(r) for r in splitters.distinct().collect()), key=lambda k: (k[0], k[1] is not None, k[1] or 0, k[2]))
    groups = [[dict(zip(KEY, k, strict=True)) for k in every[j : j + GROUP]] for j in range(0, len(every), GROUP)]
    schema, key = "array<array<struct<h:bigint,i:bigint,u:bigint>>>", F.struct(*KEY)

    def of(groups: Column) -> Column:
        def inside(n: Column) -> Column:
            below = F.size(F.filter(F.element_at(groups, n), lambda s: s < key))
            return F.when(n == 0, 0).otherwise((n - 1) * GROUP + below)

        return let(F.size(F.filter(groups, lambda g: g[0] < key)), inside)

    return let(F.from_json(F.lit(json.dumps(groups)), schema), of) if groups else F.lit(0)


def _totals(keys: DataFrame) -> DataFrame:
    return stored(keys.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most")), "range-totals")


def assign_shards(docs: DataFrame, n_shards: int = 40, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id long, text string; other columns are left).

    Law: bytes; shard k holds the records whose middle byte lies in the k-th of n_shards equal parts of the whole.
    Equal texts stand side by side, so a group lies in one shard, or in a run of shards if it is larger than one.
    A null text counts as empty with crc32 0; a null doc_id sorts first; a repeated row is a record of its own;
    an empty table gives no rows. slot numbers the records of a shard from 0 in key order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("i"),
            text_key(text).alias("h"),
            F.monotonically_increasing_id().alias("u"),  # tells rows apart that are alike in all else
            record_size(F.col("text")).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-keys",
    )
    whole = keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, rows = whole.bytes or 0, whole.rows
    n_ranges = max(1, min(rows, MOST_RANGES, max(n_shards * RANGES_A_SHARD, -(-rows // ROWS_A_RANGE))))
    mean = max(total, 1) / n_ranges
    splitters = stored(_sampled(keys, max(total, 1), n_ranges, seed), "splitters")
    for again in range(1, ROUNDS + 1):
        ranged = keys.withColumn("range", _range_of(splitters))
        totals = _totals(ranged)
        over = totals.where((F.col("bytes") > OVERFULL * mean) & (F.col("bytes") - F.col("most") > mean))
        much = over.agg(F.sum("bytes")).first()[0]
        if not much or again == ROUNDS:
            break
        mine = ranged.join(F.broadcast(over.select("range")), "range", "left_semi")  # at most a range for each OVERFULL means
        splitters = stored(splitters.unionByName(_sampled(mine, much, 4 * int(much / mean + 1), seed + again)).distinct(), "splitters")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    starts = stored(totals.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"_{c}") for c in ("bytes", "rows"))), "range-starts")
    order = Window.partitionBy("range").orderBy("h", "i", "size", "text_crc32", "u").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(
        ranged.join(F.broadcast(starts), "range")
        .select("*", F.sum("size").over(order).alias("_upto"), F.count(F.lit(1)).over(order).alias("_n"))
        .withColumn("_row", F.col("_rows") + F.col("_n") - 1)
        .withColumn("_mid2", (F.col("_bytes") + F.col("_upto")) * 2 - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"cast(_mid2 * {n_shards}D / {2.0 * max(total, 1)}D as int)"), F.lit(n_shards - 1)))
        .select("i", "size", "text_crc32", "shard", "_row"),
        "shard-rows",
    )
    begins = placed.groupBy("shard").agg(F.min("_row").alias("_begin"))  # a row for each shard
    return placed.join(F.broadcast(begins), "shard").select(F.col("i").alias("doc_id"), "size", "text_crc32", "shard", (F.col("_row") - F.col("_begin")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """docs with shard and slot as Parquet below path, a folder for each shard, rows in the order of slots.

    doc_id has to tell rows apart here.
    """
    placed = assign_shards(docs, n_shards).select("doc_id", "shard", "slot")
    whole = docs.drop("shard", "slot").join(placed, "doc_id")
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    from .common import read_documents

    out = assign_shards(read_documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by its table, which its polynomial gives: of each number below 256 the last of eight steps, and then a step a byte.
OP2_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
rows AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size FROM documents),
coded AS (SELECT doc_id, size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS h, xor(list_reduce(list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32 FROM rows, crc),
placed AS (SELECT *, least(39, CAST(floor((2 * sum(size) OVER (ORDER BY h, doc_id) - size) * 40::DOUBLE / (2.0 * (SELECT sum(size) FROM rows))::DOUBLE) AS INTEGER)) AS shard FROM coded)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""
