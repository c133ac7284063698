"""What the training-data operators share: reading, shared storage, cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors see")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return context.getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def dropped(*tables: DataFrame) -> None:
    """Delete tables that stored() has returned and that nothing reads any more."""
    for df in tables:
        fs, p = filesystem(df.sparkSession, df.stored_at)
        fs.delete(p, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, zero: Column, op) -> Column:
    """For each place of an array, op over all values before it. op is associative, and zero is neutral to it.

    By stretches of the root of the array's size: a fold that makes an array copies it at every step, and so none gets long.
    """

    def before(x: Column) -> Column:
        return F.slice(F.aggregate(x, F.array(zero), lambda found, y: F.array_append(found, op(F.element_at(found, -1), y))), F.lit(1), F.size(x))

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))
        return let(stretches, lambda all_: F.flatten(F.zip_with(all_, before(F.transform(all_, lambda x: F.aggregate(x, zero, op))), lambda x, upto: F.transform(before(x), lambda y: op(upto, y)))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def words_of(text: Column) -> Column:
    """The words of a text, in order; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """How many words a text has: every word but the first follows white space."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, SPACE, -1))).cast("long")


#: Words of 64 bits in a bitmap: 2 MB, whatever the input.
BITMAP_WORDS = 1 << 17


def _bitmap(keys: DataFrame) -> DataFrame:
    bit = F.pmod(F.col("key"), F.lit(BITMAP_WORDS * 64))
    words = keys.select(F.shiftright(bit, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(key, {BITMAP_WORDS * 64}) & 63 as int))").alias("_bit"))
    return words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


_HIT = "coalesce((shiftrightunsigned(_bits, cast(_at & 63 as int)) & 1L) = 1L, false)"


def marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key (long) may be among keys.key: all that are, and a few more.

    keys becomes a bitmap of a fixed size, so broadcasting it is safe at any scale; with too many keys it lets more rows
    through, and never loses one. It spares the join behind it the shuffle of rows with no partner.
    """
    at = df.withColumn("_at", F.pmod(key, F.lit(BITMAP_WORDS * 64)))
    found = at.join(F.broadcast(_bitmap(keys)), F.shiftright("_at", 6) == F.col("_word"))
    return found.where(F.expr(_HIT)).drop("_at", "_word", "_bits")


def without(df: DataFrame, key: Column, gone: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """df without the rows whose key (long) is gone.key, and for which gone's columns named in also equal the expressions given there.

    gone: distinct rows, written down. Rows that can't be among them pass by unshuffled, those with a null key too. An outer join, as the optimizer would
    move an anti join below the bitmap.
    """
    also = also or {}
    at = df.withColumn("_wo_key", key).withColumn("_at", F.pmod("_wo_key", F.lit(BITMAP_WORDS * 64)))
    flagged = at.join(F.broadcast(stored(_bitmap(gone), "bitmap")), F.shiftright("_at", 6) == F.col("_word"), "left")
    maybe = flagged.where(F.expr(_HIT)).select("*", *(e.alias(f"_wo{j}") for j, e in enumerate(also.values())))
    marks = gone.select(F.col("key").alias("_wo_gone"), *(F.col(c).alias(f"_wo_gone{j}") for j, c in enumerate(also)), F.lit(True).alias("_wo_is"))
    same = [F.col("_wo_key") == F.col("_wo_gone"), *(F.col(f"_wo{j}") == F.col(f"_wo_gone{j}") for j in range(len(also)))]
    kept = maybe.join(marks, same, "left").where("_wo_is is null")
    return flagged.where(~F.expr(_HIT)).select(*(df[c] for c in df.columns)).unionByName(kept.select(*(df[c] for c in df.columns)))


#: A key with more than one in so many rows is hot; so there are fewer hot keys than this.
HOT = 1000


def attached(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows (written down) left join table (a row for each of its keys) on keys. size names table's column with the number of rows that a key has.

    The rows of hot keys don't move: what table has of those keys is broadcast, HOT rows at most, whatever the input. So no key's rows meet in one task.
    """
    most = (rows.count() // HOT) + 1
    values = [c for c in table.columns if c not in keys]
    # the number of rows with more than a HOT-th of all rows is bounded, whatever size says of rows that aren't here
    hot = table.where(F.col(size) > most).orderBy(F.desc(size)).limit(HOT)
    hot = stored(hot.select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), F.struct(*values).alias("_hot")), "hot")
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_k{j}") for j, k in enumerate(keys)], "left")
    alone = met.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in values))
    others = met.where("_hot is null").select(*rows.columns)
    return alone.unionByName(others.join(table, keys, "left").select(*rows.columns, *values))
