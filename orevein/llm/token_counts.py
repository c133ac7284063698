"""Token counts as rollups that deltas maintain.

A batch of changes becomes signed rows: an insert adds a document's tokens, a delete takes away what the ledger holds of it, a revision does both. The
rows' sums by source, language and tokenizer version are the batch's delta, and totals are sums of deltas; nothing is ever recounted. A
batch is written aside and takes effect by one rename to a folder named after it, so a batch that is committed again, or
whose job died halfway, counts once. Every COMPACT batches, what they come to is written as one generation, which takes effect by one rename too
and knows the names of the batches in it.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, marked, new_path, read_documents, stored

#: Where the vocabulary is, the version that counts are kept under, and the pattern that parts text for it.
VOCABULARY, VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k/1"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Batches that set off a compaction. Stands for a null doc_id in keys.
COMPACT, NO_ID = 16, -(1 << 63)
KEYS = ["source", "lang", "tokenizer"]
ROWS = "doc_id long, source string, lang string, tokenizer string, documents long, tokens long"
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"
_encodings: dict = {}


def encoding(vocabulary: str, pattern: str = PATTERN):
    """The tokenizer of a vocabulary file, made once in a process."""
    if vocabulary not in _encodings:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def _counting(vocabulary: str, pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column("text"))]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "tokens", pa.array(n, pa.int64()))

    return count


class TokenRollup:
    """Totals below root, in storage that the driver and all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, vocabulary: str = VOCABULARY, version: str = VERSION, pattern: str = PATTERN):
        self.spark, self.root, self.version, self.count = spark, root, version, _counting(vocabulary, pattern)

    def _names(self, folder: str) -> list[str]:
        fs, at = filesystem(self.spark, f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _generation(self) -> tuple[str | None, set[str]]:
        """Path of the latest generation, and the names of the batches that are in it."""
        found = self._names("generations")
        if not found:
            return None, set()
        path = f"{self.root}/generations/{found[-1]}"
        return path, {r.name for r in self.spark.read.schema("name string").parquet(f"{path}/names").collect()}  # a name for each batch ever applied

    def batches(self) -> list[str]:
        """Names of all batches that have been applied."""
        return sorted({*self._names("batches"), *self._generation()[1]})

    def _read(self, what: str, schema: str) -> DataFrame:
        path, inside = self._generation()
        found = [f"{self.root}/batches/{b}/{what}" for b in self._names("batches") if b not in inside] + ([f"{path}/{what}"] if path else [])
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """One generation in place of all batches so far; totals and later deletes don't change by it. A job that dies leaves everything as it was."""
        live = self._names("batches")
        names = self.batches()
        aside = f"{self.root}/aside/generation-{uuid.uuid4().hex}"
        sums = [F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")]
        some = "documents <> 0 or tokens <> 0"
        self._read("rows", ROWS).groupBy("doc_id", *KEYS).agg(*sums).where(some).select(*(c.split()[0] for c in ROWS.split(", "))).write.parquet(f"{aside}/rows")
        self._read("delta", DELTA).groupBy(*KEYS).agg(*sums).where(some).write.parquet(f"{aside}/delta")
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{aside}/names")
        fs, new = filesystem(self.spark, f"{self.root}/generations/{len(names):09d}")
        fs.mkdirs(new.getParent())
        if not fs.rename(filesystem(self.spark, aside)[1], new):
            fs.delete(filesystem(self.spark, aside)[1], True)
            return
        for old in self._names("generations")[:-1]:  # all that they hold is in the new one
            fs.delete(filesystem(self.spark, f"{self.root}/generations/{old}")[1], True)
        for b in live:
            fs.delete(filesystem(self.spark, f"{self.root}/batches/{b}")[1], True)

    def counted(self, docs: DataFrame) -> DataFrame:
        """ROWS for docs (doc_id, text, source, lang). A null or empty text has no tokens; null sources and languages are keys of their own."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        rows = rows.mapInArrow(self.count, "doc_id long, source string, lang string, tokens long")
        return rows.select("doc_id", "source", "lang", F.lit(self.version).alias("tokenizer"), F.lit(1).cast("long").alias("documents"), "tokens")

    def taken_back(self, ids: DataFrame) -> DataFrame:
        """ROWS that cancel all the ledger holds of the documents in ids (doc_id). An id it doesn't hold cancels nothing, a repeated one once; a null id is the null id of inserts."""
        gone = stored(ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")).distinct(), "taken-back")
        at = F.coalesce("doc_id", F.lit(NO_ID))
        # rows that can't be among them don't move
        held = marked(self._read("rows", ROWS), at, gone).withColumn("_id", at).join(gone, F.col("_id") == F.col("key"), "left_semi")
        sums = held.groupBy("doc_id", *KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")
        return sums.select("doc_id", *KEYS, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Apply a batch; False, and nothing happens, if a batch of this name has been applied.

        inserts and revisions: doc_id, text, source, lang; deletes: doc_id. Every inserted row counts, repeated ones too; a revision takes the place of all
        rows of its doc_id that earlier batches have left. Deletes and revisions see earlier batches only.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch's name: {batch!r}")
        fs, done = filesystem(self.spark, f"{self.root}/batches/{batch}")
        if batch in self.batches():
            return False
        parts = [self.counted(x) for x in (inserts, revisions) if x is not None] + [self.taken_back(x) for x in (deletes, revisions) if x is not None]
        aside = f"{self.root}/aside/{batch}-{uuid.uuid4().hex}"
        rows = self.spark.createDataFrame([], ROWS)
        for part in parts:
            rows = rows.unionByName(part)
        rows.write.parquet(f"{aside}/rows")
        written = self.spark.read.schema(ROWS).parquet(f"{aside}/rows")
        written.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(f"{aside}/delta")
        fs.mkdirs(done.getParent())
        if not fs.rename(filesystem(self.spark, aside)[1], done):
            fs.delete(filesystem(self.spark, aside)[1], True)
            return False
        if len(self._names("batches")) >= COMPACT:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; keys of which nothing is left are gone."""
        deltas = self._read("delta", DELTA)
        return deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after three batches of inserts, deletes and revisions, of which one is committed a second time.

    A third of the documents comes in, goes and comes again; a third comes in as a draft (of other length, from another source) and is revised; a third comes in once.
    """
    rollup, docs = TokenRollup(spark, new_path(spark, "token-rollup")), read_documents(spark, sf_dir)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    returning, revised, plain = (docs.where(part == k) for k in range(3))
    drafts = revised.withColumn("text", F.concat_ws("\n", "text", F.lit("This is a draft."))).withColumn("source", F.lit("drafts"))
    rollup.commit("1-first", inserts=returning.unionByName(drafts))
    rollup.commit("2-second", inserts=plain, deletes=returning.select("doc_id"))
    rollup.commit("3-third", inserts=returning, revisions=revised)
    rollup.commit("2-second", inserts=plain, deletes=returning.select("doc_id"))
    return rollup.totals()
