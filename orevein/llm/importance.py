"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams, one of the texts labelled good and one of all texts, give every document a weight: the
ratio of its likelihoods, for a stretch of it of a fixed length, as that of whole texts grows with their length until no noise matters. Gumbel noise on the
logarithms and a top-k is a sample without replacement in proportion to the weights: far from the cut weights decide, near it chance does. k is
the number of documents whose weight is above the cut that tells labelled good and bad ones apart best, of those labelled that no
model has seen as targets, unless k is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_documents, stored
from .textvec import Words, mixed, text_chunks

#: Buckets that n-grams are hashed into; labelled good documents that the target model is made of, at most (those with the smallest hash).
BUCKETS, MOST_LABELLED = 1 << 15, 20_000
#: What is added to a bucket's count and to the count expected of it.
EVENS = 10
#: A good document lost counts as so many bad ones kept, both as shares, where the cut is chosen.
LOSS = 4.0
#: N-grams of the stretch that a weight is of; n-grams that say nothing, added to a text's own, so that a short text weighs little.
STRETCH, PRIOR = 200, 200
#: Labelled documents are dealt into so many parts by their hash: those below TARGET may be targets, that at JUDGED sets the cut, and the rest is never looked at.
PARTS, TARGET, JUDGED = 4, 2, 2
#: Steps that keys are compared in: a millionth.
STEP = 1 << 20


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word, every pair of neighbouring words and every three bytes in a row of a text, and the text of each."""
    h, doc, data = words.hash, words.doc, words.data.astype(np.uint32)
    pair = doc[1:] == doc[:-1]
    two = mixed(h[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + h[1:][pair])
    three = mixed((data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)).astype(np.uint64) + np.uint64(1 << 40)) if len(data) > 2 else h[:0]
    of = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = of[:-2] == of[2:]
    return (np.concatenate([h, two, three[inside]]) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate([doc, doc[1:][pair], of[:-2][inside]])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by bucket: of all texts, and of those that are targets."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column("target").to_numpy(zero_copy_only=False)
        for a, b, data, bounds in text_chunks(batch.column("text")):
            gram, doc = _grams(Words(data, bounds))
            raw += np.bincount(gram, minlength=BUCKETS)
            target += np.bincount(gram[good[a:b][doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def _scoring(ratio: np.ndarray, columns: list[str]):
    """columns of the rows, and log_weight."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column("text")):
                gram, doc = _grams(Words(data, bounds))
                sums, n = np.bincount(doc, weights=ratio[gram], minlength=b - a), np.bincount(doc, minlength=b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), pa.array(STRETCH * sums / (n + PRIOR))], names=[*columns, "log_weight"])

    return score


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a column of longs from -2^59 to 2^59, by its digits of 12 bits from the first: a count over at most 4096 groups for each."""
    low = -(1 << 59)
    for shift in range(48, -1, -12):
        digit = F.shiftright(F.col(column) - F.lit(low), shift)
        counts = sorted(df.where((F.col(column) >= low) & (F.col(column) < low + (1 << (shift + 12)))).groupBy(digit.alias("d")).count().collect(), reverse=True)
        for d, n in counts:
            if k <= n:
                low += d << shift
                break
            k -= n
    return low


def best_cut(good: list[float], bad: list[float], loss: float = LOSS) -> float:
    """The weight above which documents are kept at the least loss; between two weights, and 0 where one of the lists is empty."""
    if not good or not bad:
        return 0.0
    values = sorted([(x, 1) for x in good] + [(x, 0) for x in bad])
    lost, kept, best = 0, len(bad), (len(bad) / len(bad), values[0][0] - 1.0)
    for (x, is_good), (y, _) in zip(values, values[1:] + [(values[-1][0] + 2.0, 0)], strict=True):
        lost, kept = lost + is_good, kept - (1 - is_good)
        if y > x:
            best = min(best, (loss * lost / len(good) + kept / len(bad), (x + y) / 2))
    return best[1]


class Resampler:
    """Both models, and the least key that is kept (None: nothing is), for docs and labels as in resample(). scored: doc_id, log_weight, key of docs, written down."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None, most_labelled: int, seed: int):
        self.seed = seed
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("_known"), (F.col("quality") == 1).alias("good")).distinct()
        known = known.withColumn("_hash", F.xxhash64("_known", F.lit(seed))).orderBy("_hash", "good").limit(most_labelled)
        known = known.select("_known", "good", F.pmod("_hash", F.lit(PARTS)).alias("part"))
        targets = known.where(f"good and part < {TARGET}").select("_known")  # most_labelled ids at most are broadcast
        flagged = docs.join(F.broadcast(targets), F.col("doc_id") == F.col("_known"), "left").select("text", F.col("_known").isNotNull().alias("target"))
        counts = flagged.mapInArrow(_counting, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for r in counts.collect():  # BUCKETS rows at most
            raw[r.bucket], target[r.bucket] = r.raw, r.target
        # a bucket's ratio is that of its target count to the count expected if targets were like all texts; EVENS more on either side keep rare ones near 1
        expected = target.sum() * (raw + 1) / (raw + 1).sum()
        self.ratio = np.log((target + EVENS) / (expected + EVENS))
        self.scored = stored(self.with_key(docs, "doc_id long, log_weight double", ["doc_id"]), "weights")
        if k is None:
            judges = known.where(f"part = {JUDGED}").select("_known", "good")
            judged = self.scored.join(F.broadcast(judges), F.col("doc_id") == F.col("_known")).groupBy("_known", "good").agg(F.avg("log_weight").alias("log_weight")).collect()  # most_labelled rows at most
            cut = best_cut([r.log_weight for r in judged if r.good], [r.log_weight for r in judged if not r.good])
            k = self.scored.where(F.col("log_weight") > cut).count()
        self.least = None if k <= 0 else kth_largest(self.scored, "_key", k) if k < self.scored.count() else -(1 << 60)

    def with_key(self, docs: DataFrame, schema, columns: list[str]) -> DataFrame:
        """columns of docs with log_weight, key and, in STEPs, _key."""
        u = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        scored = docs.mapInArrow(_scoring(self.ratio, columns), schema).withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
        return scored.withColumn("_key", F.round(F.col("key") * STEP).cast("long"))

    def kept(self) -> Column:
        return F.lit(False) if self.least is None else F.col("_key") >= self.least


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most_labelled: int = MOST_LABELLED, seed: int = 3) -> DataFrame:
    """doc_id, log_weight, key, kept for every row of docs (doc_id long, text); labels: doc_id, quality (1: good, 0: bad).

    log_weight is that of a stretch of STRETCH n-grams. A null or empty text has weight 1 (log_weight 0) and stands where that puts it. Repeated rows have the same key; rows whose key
    equals the k-th are all kept. Without good labels every text weighs 1; without good and bad ones the cut is at 1, above which
    nothing may be. A document labelled both ways is both. An empty table gives no rows. Other columns are left alone. Models count every row of docs;
    only labelled rows are bounded, by most_labelled of those with the smallest hash: one half makes the target, a quarter the cut, and a quarter is left to judge by.
    """
    fitted = Resampler(docs, labels, k, most_labelled, seed)
    return fitted.scored.select("doc_id", "log_weight", "key", fitted.kept().alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, most_labelled: int = MOST_LABELLED, seed: int = 3) -> DataFrame:
    """The rows of docs that resample() keeps, as they were; nothing is shuffled for it."""
    fitted = Resampler(docs, labels, k, most_labelled, seed)
    names = [f"c{j}" for j in range(len(docs.columns))]  # whatever docs' columns are called
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    rows = docs.select(*(docs[c].alias(n) for c, n in at.items()), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for c, n in at.items()), T.StructField("doc_id", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    good = fitted.with_key(rows, schema, [*names, "doc_id"]).where(fitted.kept())
    return good.select(*(F.col(n).alias(c) for c, n in at.items()))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
