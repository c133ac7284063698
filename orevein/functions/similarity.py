"""Similarities of texts, vectors and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters of a text whose places fit into a number, one bit each, with one to spare for sums.
BITS = 62


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(text: Column) -> Column:
    """Map from each character of a text to its places, a bit each; for texts of BITS characters at most. Worked out once a record, it serves every pair."""

    def of(chars: Column) -> Column:
        at = lambda x: F.aggregate(F.transform(chars, lambda y, i: F.when(x == y, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))
        return F.map_from_entries(F.transform(F.array_distinct(chars), lambda x: F.struct(x, at(x))))

    return F.when(F.length(text) <= BITS, let(F.split(text, ""), of))


def lcs_of(at: Column, n: Column, b: Column) -> Column:
    """Length of the longest common subsequence of a text of n characters, by its places(), and another: one addition for each character of that."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), n) - F.lit(1).cast("long")
    masks = F.filter(F.transform(F.split(b, ""), lambda y: F.coalesce(F.try_element_at(at, y), F.lit(0).cast("long"))), lambda m: m != 0)
    # a bit that is 0 ends a common subsequence that is longer by one than those that end before it
    end = F.aggregate(masks, full, lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full))
    return n - F.bit_count(end)


def _lcs_by_rows(a: Column, b: Column) -> Column:
    """For texts of any length, by rows of the table."""
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    zeros = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(above: Column, x: Column) -> Column:
        def cell(at: Column, y: Column) -> Column:
            # at: the row so far, whose size is the column
            j = F.size(at)
            best = F.when(x == y, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(at, j - 1)))
            return F.array_append(at, best)

        return F.aggregate(chars_b, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(chars_a, zeros, row), -1)


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)

    def of(x: Column) -> Column:
        small = let(places(x["s"]), lambda at: lcs_of(at, F.length(x["s"]), x["l"]))
        return F.when(F.length(x["s"]) <= BITS, small).otherwise(_lcs_by_rows(x["s"], x["l"]))

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(a == b, F.length(a)).otherwise(let(F.struct(short.alias("s"), long.alias("l")), of))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def indel(a: Column, b: Column) -> Column:
    """2 LCS / (both lengths), 1 for two empty texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * lcs(a, b) / both)


def token_sort(a: Column, b: Column) -> Column:
    """Indel similarity of the texts' sorted tokens. Long expressions: give it columns, not expressions."""
    return indel(sorted_tokens(a), sorted_tokens(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if one has no length, between 0 and 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def null_like(c: Column) -> Column:
    """Null for what means none: blank, nan, none, null."""
    text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)


def agreement(pairs: list[tuple[Column, Column]]) -> Column:
    """struct(agreement, n): mean over attributes that either side has; equal 1, one-sided 0, else token_sort, below a half 0."""

    def one(a: Column, b: Column) -> Column:
        x, y = F.upper(null_like(a)), F.upper(null_like(b))
        near = let(token_sort(x, y), lambda s: F.when(s < 0.5, 0.0).otherwise(s))
        return F.when(x.isNull() & y.isNull(), None).when(x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(near)

    scores = F.filter(F.array(*(one(a, b) for a, b in pairs)), lambda s: s.isNotNull())
    total = F.aggregate(scores, F.lit(0.0), lambda s, v: s + v)
    return F.struct(F.round(F.coalesce(F.try_divide(total, F.size(scores)), F.lit(0.0)), 4).alias("agreement"), F.size(scores).cast("long").alias("n"))


def tfidf(docs: DataFrame, text: str, key: str, most: int = 384, grams: int = 3, times: str | None = None) -> DataFrame:
    """key, vector: map of weights of unit length over the `most` most frequent word n-grams (ties by term), for every row; times names a column that says how many documents a row stands for.

    tf is 1 + ln tf, idf ln((1 + n) / (1 + df)) + 1. The vocabulary has `most` rows and is joined by broadcast.
    """
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1)), lambda w: w != "")
    rows = docs.select(F.col(key), words.alias("w"), (F.col(times) if times else F.lit(1)).cast("long").alias("_times"))

    def of_length(g: int) -> Column:
        places = F.sequence(F.lit(1), F.size("w") - (g - 1))
        return F.when(F.size("w") >= g, F.transform(places, lambda i: F.array_join(F.slice("w", i, g), " "))).otherwise(F.array().cast("array<string>"))

    each = [of_length(g) for g in range(1, grams + 1)]
    counts = rows.select(key, "_times", F.explode(F.concat(*each)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("_times").alias("_times"))
    vocabulary = counts.groupBy("term").agg(F.sum(F.col("tf") * F.col("_times")).alias("n"), F.sum("_times").alias("df")).orderBy(F.col("n").desc(), "term").limit(most)
    n = rows.agg(F.coalesce(F.sum("_times"), F.lit(0)).alias("docs"))
    weights = counts.join(F.broadcast(vocabulary.select("term", "df")), "term").withColumn("docs", n.scalar()).select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("v"))
    norm = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "v")))).alias("m"))
    out = norm.select(key, F.transform_values("m", lambda t, v: v / F.col("norm")).alias("vector"))
    return docs.select(key).join(out, key, "left")
