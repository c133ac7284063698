"""Near-duplicates of whole documents by MinHash in an LSH forest.

A document's set of word shingles gets DEPTH minimum hashes for each tree. Each tree orders all documents by its own hashes, and a document's
candidates are its WINDOW nearest neighbours on either side in that order, if they share a prefix of hashes with it: few candidates a document, however
many copies a group has, and with the longest prefixes first, so that a crowded region is compared at a greater depth than a sparse one. Candidates are
confirmed on the full sets, and confirmed links give components. Regions that then still hold more than one component are searched once more,
exactly, for links between components. How many trees there are and how long a prefix has to be follows from the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, dropped, marked, read_documents, stored, without
from .components import components
from .textvec import Words, mixed, shingles, text_chunks

#: Minimum hashes that a tree orders by; neighbours on either side that are tried; trees, at most, while a prefix can be shorter instead.
DEPTH, WINDOW, TREES = 8, 2, 16
#: Chance that a link at the limit shares a long enough prefix in no tree; standard deviations that a sketch may fall short of the limit.
MISS, SHORT = 2e-5, 6
#: Minimum hashes of a sketch, at least.
SKETCH = 128


def forest_shape(similarity: int) -> tuple[int, int]:
    """Trees, and hashes that neighbours have to share, so that links at similarity per cent are missed with a chance of MISS at most.

    The longest prefix (of 4 at most) that TREES trees are enough for; with one hash, as many trees as it takes.
    """
    if not 1 <= similarity <= 100:
        raise ValueError(f"similarity is a percentage from 1 to 100, not {similarity}")
    for least in (4, 3, 2, 1):
        alike = (similarity / 100) ** least
        trees = 1 if alike == 1 else math.ceil(math.log(MISS) / math.log1p(-alike))
        if trees <= TREES or least == 1:
            return trees, least
    raise AssertionError


def sketch_limit(similarity: int, hashes: int) -> float:
    """The share of equal minimum hashes that a link at similarity per cent has but for 1 case in a billion."""
    s = similarity / 100
    return max(0.0, s - SHORT * math.sqrt(s * (1 - s) / hashes))


def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, hashes + 1, dtype=np.uint64)
    return mixed(at * np.uint64(0x2545F4914F6CDD1D)).astype(np.uint32) | np.uint32(1), mixed(at * np.uint64(0x9FB21C651E98DF25)).astype(np.uint32)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, the texts' distinct shingles in order one text after the other, where each text's begin)."""
    for a, b, data, bounds in text_chunks(column):
        sh, begin = shingles(Words(data, bounds, lower=True), k)
        unique = [np.unique(sh[begin[i] : begin[i + 1]]) for i in range(b - a)]
        yield a, np.concatenate(unique), np.concatenate([[0], np.cumsum([len(u) for u in unique])])


def _signing(k: int, hashes: int):
    up, on = _factors(hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sh, begin in _sets(batch.column("text"), k):
                n = np.diff(begin)
                full = np.flatnonzero(n)
                f = np.zeros((2, len(n)), np.uint64)
                sketch = np.zeros((len(n), hashes), np.uint16)
                if len(full):
                    at = begin[:-1][full]
                    f[0, full] = np.add.reduceat(mixed(sh + np.uint64(1)), at)
                    f[1, full] = np.bitwise_xor.reduceat(mixed(sh + np.uint64(2)), at)
                    low = (sh >> np.uint64(32)).astype(np.uint32)
                    for j in range(hashes):
                        sketch[full, j] = np.minimum.reduceat(low * up[j] + on[j], at) >> np.uint32(3) & np.uint32(0xFFFF)
                ids = batch.column("doc_id").slice(a, len(n))
                rows = [ids, pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in f), pa.ListArray.from_arrays(np.arange(0, sketch.size // 4 + 1, hashes // 4, dtype=np.int32), sketch.view(np.int64).ravel())]
                yield pa.RecordBatch.from_arrays(rows, schema=SIGNED)

    return sign


def _shingling(k: int):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sh, begin in _sets(batch.column("text"), k):
                ids = batch.column("doc_id").slice(a, len(begin) - 1)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(sh.view(np.int64)))], names=["doc_id", "shingles"])

    return shingle


def _neighbours(tree: np.ndarray, region: np.ndarray, ids: np.ndarray, fresh: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, of which the later stands at fresh or behind, at most window apart with all rows from one to the other of one tree and region."""
    n, left, right = len(ids), [], []
    same = (tree[1:] == tree[:-1]) & (region[1:] == region[:-1]) if n > 1 else np.zeros(0, bool)
    run = same
    for o in range(1, window + 1):
        if not run.any():
            break
        at = np.flatnonzero(run)
        at = at[at + o >= fresh]
        left.append(ids[at])
        right.append(ids[at + o])
        run = run[:-1] & same[o:]
    return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int16()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])


def _searching(edges: bool, shift: int, window: int):
    """Sorted rows (tree, k1, k2, doc_id) in, candidates a, b out; and, with edges, the partition's first and last window rows again, for what lies across partitions."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, head = None, 0
        nothing = lambda n: [pa.nulls(n, t) for t in (pa.int16(), pa.int64(), pa.int64(), pa.int64())]
        as_rows = lambda x: pa.RecordBatch.from_arrays([pa.nulls(len(x[0]), pa.int64()), pa.nulls(len(x[0]), pa.int64()), *(pa.array(c, f.type) for c, f in zip(x, list(FOUND)[2:], strict=True))], schema=FOUND)
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "k1", "k2", "doc_id")]
            if edges and head < window and len(new[0]):
                first = [c[: window - head] for c in new]
                head += len(first[0])
                yield as_rows(first)
            rows = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
            a, b = _neighbours(rows[0], rows[1] >> shift, rows[3], len(rows[0]) - len(new[0]), window)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *nothing(len(a))], schema=FOUND)
            kept = [c[-window:] for c in rows]
        if edges and kept is not None:
            yield as_rows(kept)

    return search


FOUND_SQL = "a long, b long, tree short, k1 long, k2 long, doc_id long"


def _agreeing(limit: float):
    """Pairs whose sketches agree often enough to be a link."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).flatten().to_numpy().view(np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            good = pa.array((x == y).mean(axis=1) >= limit)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return agree


def near_groups(docs: DataFrame, similarity: int = 85, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string).

    Links: at least similarity per cent of two documents' shingles together are in both; similarity can be any from 1 to 100, and the forest is laid out for it. Shingles are
    compared by hashes of 64 bits. A text without words (or null) has an empty set and no links; one with
    fewer than k words has its whole sequence as one shingle. component_id is the smallest doc_id that links lead to. Rows that repeat a doc_id are all
    returned; if their texts differ, links are confirmed on the one of them whose set hashes lowest. A null doc_id has no part in links and keeps a null component_id, with kept true. An empty table gives no rows. Other columns are left alone.
    """
    trees, least = forest_shape(similarity)
    hashes = max(SKETCH, trees * DEPTH)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_signing(k, hashes), "doc_id long, n_shingles long, f0 long, f1 long, sketch array<long>"), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets first: one document stands for all of them
    same = stored(some.groupBy("f0", "f1", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "sets")
    few = same.select(F.col("rep").alias("doc_id"), "n_shingles", "sketch")
    # a hash has 16 bits here, so the first long of a tree holds 4 of them; the leading ones are the region
    rows = ", ".join(f"named_struct('tree', {j}S, 'k1', sketch[{2 * j}], 'k2', sketch[{2 * j + 1}])" for j in range(trees))
    shift, region = 16 * (4 - least), F.shiftright("k1", 16 * (4 - least)).alias("region")
    forest = stored(few.select("doc_id", F.inline(F.expr(f"array({rows})"))).select("tree", "k1", "k2", "doc_id"), "forest")
    order = ["tree", "k1", "k2", "doc_id"]
    found = stored(forest.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_searching(True, shift, WINDOW), FOUND_SQL), "found")
    # rows at the partitions' edges: 2 * WINDOW for each partition, however many rows there are
    across = found.where("doc_id is not null").select(*order).distinct().coalesce(1).sortWithinPartitions(*order).mapInArrow(_searching(False, shift, WINDOW), FOUND_SQL)
    candidates = found.where("a is not null").select("a", "b").unionByName(across.where("a is not null").select("a", "b")).where("a <> b").distinct()
    links = _confirmed(candidates, few, docs, similarity, k, hashes)
    joined = stored(components(links), "components")
    # regions in which neighbours have left more than one component are searched exactly for links between these
    crowded = forest.groupBy("tree", region).agg(F.count("*").alias("n")).where(f"n > {WINDOW + 1}").select("tree", "region")
    crowd = forest.select("tree", region, "doc_id").join(crowded, ["tree", "region"]).join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    crowd = stored(crowd.withColumn("component", F.coalesce("component", "doc_id")), "crowd")
    split = crowd.groupBy("tree", "region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("tree", "region")
    open_ = stored(crowd.join(split, ["tree", "region"]).select("doc_id", "component").distinct(), "open")
    missed = _across(open_, docs, similarity, k).join(candidates, ["a", "b"], "left_anti")
    more = _confirmed(missed, few, docs, similarity, k, hashes)
    if not more.isEmpty():
        joined = stored(components(links.unionByName(more)), "components")
    dropped(forest, found, crowd, open_)
    whole = same.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    whole = stored(whole.where("copies > 1 or component is not null").select("f0", "f1", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id")), "near-sets")
    out = attached(signed.select("doc_id", "n_shingles", "f0", "f1"), whole, ["f0", "f1", "n_shingles"], "copies")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _set_table(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles of the documents in nodes (doc_id, unique), written down."""
    texts = marked(docs.where("doc_id is not null"), F.col("doc_id"), nodes.select(F.col("doc_id").alias("key")))
    sets = texts.mapInArrow(_shingling(k), "doc_id long, shingles array<long>").join(nodes.select("doc_id"), "doc_id", "left_semi")
    return stored(sets.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("shingles").alias("h"), "shingles")).alias("s")).select("doc_id", "s.shingles"), "shingles")


def _across(open_: DataFrame, docs: DataFrame, similarity: int, k: int) -> DataFrame:
    """Pairs (a, b) of documents in open_ (doc_id, component), of different components, among which is every link between these.

    By the prefix principle: of two sets of which a link is made, the 100 - similarity per cent rarest shingles (and one more) have one in common. Rare
    ones have few documents, and shingles that only one component has in front make no pairs.
    """
    sets = _set_table(open_, docs, k)
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    often = sets.select(F.explode("shingles").alias("t")).groupBy("t").agg(F.count("*").alias("often"))
    ranked = each.join(often.where("often > 1"), "t", "left").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "t"))).alias("order"))
    # a link needs ceil(similarity% of n) shingles in common, so one of the n - that + 1 first is among them
    first = F.slice("order", F.lit(1), F.expr(f"cast(n - ceil(n * {similarity}L / 100D - 1e-9D) + 1 as int)"))
    front = ranked.select("doc_id", "n", F.posexplode(first).alias("at", "o"))
    front = stored(front.where("o.often > 1").select("doc_id", "n", "at", F.col("o.t").alias("t")).join(open_, "doc_id"), "fronts")
    # of a shingle's documents, those of its largest component aren't tried with each other
    sizes = front.groupBy("t", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("t").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("c")).where("c > 1").select("t", F.col("m.component").alias("main"))
    tried = met_by_size(front.join(main, "t"), similarity)
    pairs = stored(tried.select(F.least("s_doc_id", "l_doc_id").alias("a"), F.greatest("s_doc_id", "l_doc_id").alias("b")).distinct(), "across")
    dropped(sets, front)
    return pairs


def met_by_size(rows: DataFrame, similarity: int) -> DataFrame:
    """Pairs s, l of rows (n, at, t, component, main and others) of one shingle t and different components that can be links: every column of either, behind s_ and l_.

    Behind the place at of the first shingle that two sets share, each has n - at - 1 more at most, so a link needs (100 + similarity) * (n - at) >= similarity * (n + the other's n): the
    other's n is at most `reach`. Of a link the smaller set (or either, if they are as large) thus has a reach of its own size or more. Rows without that only meet those that have it, and a shingle of which none
    has it, as of a passage that stands in texts too different for links, makes no pairs, however many texts it is in. Of its largest component (main), rows aren't tried with each other.
    """
    reach = F.expr(f"{100 + similarity}L * (n - at) div {similarity}L - n")
    rows = rows.withColumn("reach", reach)
    small, large = (rows.select("t", *(F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "t")) for x in "sl")
    small = small.where("s_reach >= s_n")
    able = (F.col("l_n") >= F.col("s_n")) & (F.col("l_n") <= F.col("s_reach")) & (F.col("s_n") <= F.col("l_reach")) & (F.col("s_component") != F.col("l_component"))
    parts = (small.where("s_component <> s_main"), large), (small.where("s_component = s_main"), large.where("l_component <> l_main"))
    # renamed, so that the second join's sides are columns of their own
    one, two = (s.join(l.withColumnRenamed("t", "l_t"), (F.col("t") == F.col("l_t")) & able) for s, l in parts)
    return one.unionByName(two).drop("l_t", "t")


def _confirmed(pairs: DataFrame, few: DataFrame, docs: DataFrame, similarity: int, k: int, hashes: int) -> DataFrame:
    """The pairs (a, b) that are links, by their full sets of shingles. What sizes and sketches rule out isn't looked at."""
    ends = {e: few.select(F.col("doc_id").alias(e), F.col("n_shingles").alias(f"n{e}"), F.col("sketch").alias(f"s{e}")) for e in "ab"}
    near = pairs.join(ends["a"], "a").join(ends["b"], "b").where(f"100 * least(na, nb) >= {similarity} * greatest(na, nb)")
    near = stored(near.select("a", "b", "sa", "sb").mapInArrow(_agreeing(sketch_limit(similarity, hashes)), "a long, b long"), "near")
    nodes = stored(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), "near-nodes")
    sets = _set_table(nodes, docs, k)
    both = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb")).cast("long")
    links = stored(both.where(100 * common >= similarity * (F.size("xa") + F.size("xb") - common)).select("a", "b"), "confirmed")
    dropped(sets, nodes, near)
    return links


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that near_groups() keeps, as they were."""
    gone = stored(near_groups(docs, **how).where("not kept").select(F.col("doc_id").alias("key")).distinct(), "near-copies")
    return without(docs, F.col("doc_id").cast("long"), gone)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_documents(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM shingles a JOIN shingles b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met WHERE 100 * shared >= 85 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM sets LEFT JOIN roots ON node = doc_id
"""
