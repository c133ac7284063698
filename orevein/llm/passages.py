"""Dedup of passages that documents share: paragraphs by MinHash banding.

Paragraphs are lines of LEAST_LINE words or more. Their shingles give BANDS * ROWS minimum hashes; paragraphs that agree on a band are joined,
verified by the exact Jaccard index of their shingles, and clustered by connected components, of which one stays. Paragraphs are first tried with two
others of a band; bands that then still hold several components are searched through exactly. A passage can also lie
inside longer lines, so each text is besides cut into blocks at places that its words alone decide (where the hash of a pair of words
is the least around), which are the same places wherever the passage stands. Runs of blocks that just reach LEAST_RUN words meet in the same
join if they are equal, and so each is a repeated passage; those that follow each other in the same earlier document are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attached, dropped, marked, read_documents, stored
from .components import components
from .near_dedup import met_by_size
from .textvec import Words, _power, mixed, shingles, text_chunks

#: Least similarity of linked paragraphs in per cent, words of a shingle; chance to try a link at that similarity, at least; hashes of a paragraph, at most.
SIMILARITY, SHINGLE, RECALL, HASHES = 80, 5, 0.995, 24


def chance(similarity: float, bands: int, rows: int) -> float:
    """That paragraphs of a Jaccard index agree on a band."""
    return 1 - (1 - similarity**rows) ** bands


def tuned(similarity: float = SIMILARITY / 100, recall: float = RECALL, hashes: int = HASHES, unlike: float = 0.3) -> tuple[int, int]:
    """Bands and rows of a band: of all that fit into so many hashes and reach the recall at the similarity, those that try the fewest unlike pairs; the most sensitive ones if none does."""
    every = [(bands, rows) for rows in range(1, hashes + 1) for bands in range(1, hashes // rows + 1)]
    good = [x for x in every if chance(similarity, *x) >= recall]
    return min(good, key=lambda x: (chance(unlike, *x), x)) if good else max(every, key=lambda x: chance(similarity, *x))


#: 8 bands of 3: 3 links in 1000 at the limit are missed.
BANDS, ROWS = tuned()
#: Words of a paragraph and of a stretch of equal blocks, at least; words on either side that a cut is the least of.
LEAST_LINE, LEAST_RUN, AROUND = 20, 20, 4

_A = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).astype(np.uint32) | np.uint32(1)
_B = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).astype(np.uint32)


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and word behind the last of each line with LEAST_LINE words or more."""
    line = np.searchsorted(np.flatnonzero(words.data == 10), words.start)
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])]) if len(line) else np.zeros(0, bool))
    ends = np.concatenate([new[1:], [len(line)]]).astype(np.int64)
    long = ends - new >= LEAST_LINE
    return new[long], ends[long]


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word behind the last and hash of the shortest run of blocks with LEAST_RUN words or more from each block on, and of the shortest up to each.

    Both together cover every stretch of blocks of as many words, whatever stands around it.
    """
    h, doc, n = words.hash, words.doc, len(words.hash)
    pair = mixed(h + np.concatenate([h[1:], h[:1]]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    # texts are set apart by as many greatest values as a cut looks at, so that it never looks into another text
    at = np.arange(n) + (doc + 1) * AROUND
    wide = np.full((at[-1] if n else 0) + AROUND + 1, np.iinfo(np.uint64).max)
    wide[at] = pair
    cut = np.ones(n, bool)
    for k in range(1, AROUND + 1):
        cut &= (pair < wide[at - k]) & (pair <= wide[at + k])
    cut[words.first[:-1][np.diff(words.first) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.concatenate([start[1:], [n]]).astype(np.int64)
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    # block in which a run from each block on ends, and in which one up to each begins; such as leave the text are none
    ahead, behind = np.searchsorted(end, start + LEAST_RUN), np.searchsorted(start, end - LEAST_RUN, "right") - 1
    on, up_to = np.flatnonzero(ahead < len(end)), np.flatnonzero(behind >= 0)
    both = np.unique(np.concatenate([on * len(end) + ahead[on], behind[up_to] * len(end) + up_to]))
    i, j = (both // len(end), both % len(end)) if len(end) else (both, both)
    within = doc[start[i]] == doc[start[j]]
    start, end = start[i[within]], end[j[within]]
    code = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) if n else np.zeros(0, np.uint64)
    return start, end, code


KEYED = pa.schema([("key", pa.int64()), ("line", pa.bool_()), ("doc_id", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])
KEYED_SQL = "key long, line boolean, doc_id long, first int, n int"


def _keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of blocks, and one for each band of each line: key, line or run, doc_id, first word, words."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for a, _, data, bounds in text_chunks(batch.column("text")):
            words = Words(data, bounds)
            if not len(words.hash):
                continue
            start, end, code = _runs(words)
            ls, le = _lines(words)
            keys, firsts, ends, is_line = [code], [start], [end], [np.zeros(len(code), bool)]
            if len(ls):
                sh, begin = shingles(words, SHINGLE)
                low = (sh >> np.uint64(32)).astype(np.uint32)
                # window j of a text stands at its word j, so a line's windows are a stretch of the text's
                shift = begin[:-1][words.doc[ls]] - words.first[:-1][words.doc[ls]]
                edges = np.stack([ls + shift, le + shift - SHINGLE + 1], axis=1).ravel()
                inner = np.append(low, np.uint32(0))  # an edge may lie at the end
                for band in range(BANDS):
                    key = np.full(len(ls), band + 1, np.uint64)
                    for row in range(band * ROWS, (band + 1) * ROWS):
                        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(inner * _A[row] + _B[row], edges)[::2])
                    keys.append(key)
                    firsts.append(ls)
                    ends.append(le)
                    is_line.append(np.ones(len(ls), bool))
            first, last = np.concatenate(firsts), np.concatenate(ends)
            doc = words.doc[first]
            columns = [np.concatenate(keys).view(np.int64), np.concatenate(is_line), ids[a + doc], (first - words.first[doc]).astype(np.int32), (last - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=KEYED)


#: kind 0: rows of a shared key, with the key's first document (lead) and the nearest other one before (near); 1: rows of a key that may go on in another partition;
#: 2: what a partition knows of such a key.
MET_SQL = KEYED_SQL + ", kind byte, lead long, lead_first int, near long, near_first int, most long"
MET = pa.schema([*KEYED, ("kind", pa.int8()), ("lead", pa.int64()), ("lead_first", pa.int32()), ("near", pa.int64()), ("near_first", pa.int32()), ("most", pa.int64())])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, doc_id, first in; those whose key more than one document has out. Of a key's rows, only its first document's are ever held back."""
    # opening: lead, its place and the last document of the first key; lead: (key, doc, first) of a key met in two documents; top: the last row
    first_key, opening, pending, lead, top = None, None, None, None, None
    names = KEYED.names

    def out(rows: list, kind: int, lead_doc: np.ndarray, lead_first: np.ndarray, near: np.ndarray, near_first: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
        columns = [*rows, np.full(len(rows[0]), kind, np.int8), lead_doc, lead_first, near, near_first, most]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MET, strict=True)], schema=MET)

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if pending is not None:
            rows = [np.concatenate(x) for x in zip(pending, rows, strict=True)]
        key, _, doc, first, _ = rows
        if not len(key):
            continue
        first_key = key[0] if first_key is None else first_key
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.diff(np.concatenate([start, [len(key)]]))
        lead_doc, lead_first = doc[start], first[start]
        shared = doc[start + size - 1] != lead_doc
        if lead is not None and lead[0] == key[0]:
            lead_doc, lead_first, shared = lead_doc.copy(), lead_first.copy(), shared.copy()
            lead_doc[0], lead_first[0], shared[0] = lead[1], lead[2], True
        # the nearest row of another document before: the last of the document before in the same key
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        before = np.maximum(begin - 1, 0)
        has = (begin > 0) & (key[before] == key)
        near, near_first = np.where(has, doc[before], lead_doc[group]), np.where(has, first[before], lead_first[group])
        if top is not None and top[0] == key[0]:
            early = (begin == 0) & (group == 0) & (doc != top[1])
            near, near_first = np.where(early, top[1], near), np.where(early, top[2], near_first)
        # the last key's rows wait as long as all are of one document; the first key's are judged by what other partitions have, too
        waits = (group == group[-1]) & ~shared[-1]
        at_edge = (key == first_key) & ~waits
        for mask, kind in ((shared[group] & ~at_edge, 0), (at_edge, 1)):
            if mask.any():
                g = group[mask]
                yield out([c[mask] for c in rows], kind, lead_doc[g], lead_first[g], near[mask], near_first[mask], doc[mask])
        if key[0] == first_key:
            opening = (lead_doc[0], lead_first[0], doc[size[0] - 1])
        pending = None if shared[-1] else [c[start[-1] :] for c in rows]
        lead = (key[-1], lead_doc[-1], lead_first[-1]) if shared[-1] else None
        top = (key[-1], doc[-1], first[-1])

    def known(key: int, lead_doc: int, lead_first: int, most: int) -> pa.RecordBatch:
        row = [np.array([x]) for x in (key, False, lead_doc, lead_first, 0)]
        return out(row, 2, row[2], row[3], row[2], row[3], np.array([most]))

    if pending is not None:
        at = pending[2][:1].repeat(len(pending[0])), pending[3][:1].repeat(len(pending[0]))
        yield out(pending, 1, *at, *at, pending[2])
        yield known(pending[0][0], pending[2][0], pending[3][0], pending[2][0])
    elif lead is not None and lead[0] != first_key:
        yield known(*lead, top[1])
    if first_key is not None and (pending is None or pending[0][0] != first_key):
        yield known(first_key, *opening)


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, first, shingles (sorted, distinct) of each line of LEAST_LINE words or more."""
    for batch in batches:
        for a, _, data, bounds in text_chunks(batch.column("text")):
            words = Words(data, bounds)
            ls, le = _lines(words)
            sh, begin = shingles(words, SHINGLE)
            shift = begin[:-1][words.doc[ls]] - words.first[:-1][words.doc[ls]] if len(ls) else ls
            sets = [np.unique(sh[i:j]) for i, j in zip(ls + shift, le + shift - SHINGLE + 1, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
            ids = batch.column("doc_id").take(pa.array(a + words.doc[ls]))
            yield pa.RecordBatch.from_arrays([ids, pa.array((ls - words.first[words.doc[ls]]).astype(np.int32)), lists], names=["doc_id", "first", "shingles"])


def _across(lines: DataFrame) -> DataFrame:
    """Links (a, b: components) among lines (node, component, lo, hi, shingles): every link between lines of different components that isn't inside one document. lo and hi: a line's least and greatest document.

    By the prefix principle, as in near_dedup: of two linked sets, the fronts of rarest shingles have one in common. Of a shingle's lines,
    those of its largest component aren't tried with each other, so a large cluster makes no pairs of its own.
    """
    each = lines.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("often")).where("often > 1")
    ranked = each.join(often, "t", "left").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "t"))).alias("order"))
    first = F.slice("order", F.lit(1), F.expr(f"cast(n - ceil(n * {SIMILARITY}L / 100D - 1e-9D) + 1 as int)"))
    front = ranked.select("node", "n", F.posexplode(first).alias("at", "o")).where("o.often > 1").select("node", "n", "at", F.col("o.t").alias("t"))
    front = stored(front.join(lines.select("node", "component", "lo", "hi"), "node"), "line-fronts")
    main = front.groupBy("t", "component").agg(F.count("*").alias("c")).groupBy("t").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("c")).where("c > 1").select("t", F.col("m.component").alias("main"))
    two_documents = "not (s_lo = s_hi and l_lo = l_hi and s_lo = l_lo)"
    tried = met_by_size(front.join(main, "t"), SIMILARITY).where(two_documents)
    pairs = stored(tried.select(F.least("s_node", "l_node").alias("a"), F.greatest("s_node", "l_node").alias("b")).distinct(), "line-across")
    side = lambda x: lines.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("shingles").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def _rest_joined(lines: DataFrame, sets: DataFrame, joined: DataFrame) -> DataFrame:
    """joined (node, component) with the components put together that lines of one key link. lines: key, doc_id, first of the lines that meet; sets: their shingles.

    Up to three lines of a key have all been tried with each other; of larger keys, those with more than one component are searched.
    """
    crowd = lines.select("key", F.xxhash64("doc_id", "first").alias("node")).join(joined, "node", "left")
    crowd = stored(crowd.withColumn("component", F.coalesce("component", "node")), "line-crowd")
    split = crowd.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("n > 3 and x <> y").select("key")
    open_ = stored(crowd.join(split, "key").select("node", "component").distinct(), "line-open")
    # lines of equal sets have the same links, so one stands for all
    each = sets.join(open_, "node").withColumn("f0", F.xxhash64("shingles")).withColumn("f1", F.xxhash64(F.lit(1), "shingles"))
    few = each.groupBy("f0", "f1").agg(F.min("node").alias("node"), F.min("component").alias("component"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("shingles").alias("shingles"))
    few = stored(few, "line-few")
    equal = each.select("f0", "f1", F.col("component").alias("a")).join(few.select("f0", "f1", F.col("component").alias("b")), ["f0", "f1"]).where("a <> b").select("a", "b").distinct()
    more = stored(_across(few).unionByName(equal), "line-more")
    if more.isEmpty():
        return joined
    merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    every = joined.unionByName(open_.where("node = component")).distinct()
    return every.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def _stretches(rows: DataFrame, *by: str) -> DataFrame:
    """Rows (doc_id, first, n, keep) with those of the same doc_id, keep and by that touch or overlap put together."""
    by = ("doc_id", "keep", *by)
    order = Window.partitionBy(*by).orderBy("first", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("first") + F.col("n")
    new = F.coalesce(F.col("first") > F.max(end).over(order), F.lit(True)).cast("int")
    marked_ = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(Window.partitionBy(*by).orderBy("first", "n").rowsBetween(Window.unboundedPreceding, 0)))
    return marked_.groupBy(*by, "_run").agg(F.min("first").alias("first"), (F.max(end) - F.min("first")).alias("n")).select("doc_id", "first", "n", "keep")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, n_words, keep_doc_id: passages of docs (doc_id long, text string) that stand in an earlier document (of smaller doc_id) too.

    A passage is a line of LEAST_LINE words or more whose shingles have a Jaccard index of 0.8 or more with one of the other document, or a
    stretch of equal blocks of LEAST_RUN words or more, which any 51 words in common contain but for freak cuts. Passages of a document that touch or overlap are one if they have the same
    keep_doc_id; such as stand in different documents are a row each, and rows may overlap then, but one that lies inside another isn't given. Of a cluster the passage of the smallest
    doc_id stays. What repeats inside one document only is left alone, and so are null and empty texts, rows without doc_id, and rows that
    repeat a doc_id. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    keyed = stored(docs.mapInArrow(_keying, KEYED_SQL), "keys")
    order = ["key", "doc_id", "first"]
    met = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_meeting, MET_SQL), "met")
    dropped(keyed)
    # keys at the partitions' edges: two rows for each partition
    edge = met.where("kind = 2").groupBy("key").agg(F.min(F.struct("lead", "lead_first")).alias("l"), F.max("most").alias("top")).where("l.lead < top").select("key", "l.*")
    rows = met.where("kind = 0").select("key", "line", "doc_id", "first", "n", "lead", "lead_first", "near", "near_first")
    late = met.where("kind = 1").drop("lead", "lead_first").join(F.broadcast(edge), "key")
    near = F.col("near") < F.col("doc_id")
    late = late.select("key", "line", "doc_id", "first", "n", "lead", "lead_first", F.when(near, F.col("near")).otherwise(F.col("lead")).alias("near"), F.when(near, F.col("near_first")).otherwise(F.col("lead_first")).alias("near_first"))
    rows = rows.unionByName(late)
    lines = rows.where("line").select("key", "doc_id", "first")
    rows = rows.where("lead < doc_id")
    # runs of blocks: equal ones are one passage, put together where they follow each other in the lead too
    blocks = rows.where("not line").select("doc_id", "first", "n", F.col("lead").alias("keep"), (F.col("first") - F.col("lead_first")).alias("shift"))
    blocks = _stretches(blocks, "shift").where(f"n >= {LEAST_RUN}")
    # lines: candidates are a band's first line and the nearest one before, and where that leaves several components all others; copies of a line give each link once
    ends = F.explode(F.array(F.struct(F.col("lead").alias("b"), F.col("lead_first").alias("bf")), F.struct(F.col("near").alias("b"), F.col("near_first").alias("bf")))).alias("o")
    pairs = stored(rows.where("line").select(F.col("doc_id").alias("a"), F.col("first").alias("af"), ends).select("a", "af", "o.*").where("b < a").distinct(), "line-pairs")
    nodes = stored(lines.select("doc_id", "first").distinct(), "line-nodes")
    ids = nodes.select("doc_id").distinct()
    texts = marked(docs, F.col("doc_id"), ids.select(F.col("doc_id").alias("key")))
    sets = texts.mapInArrow(_line_sets, "doc_id long, first int, shingles array<long>").join(nodes, ["doc_id", "first"], "left_semi")
    sets = stored(sets.withColumn("node", F.xxhash64("doc_id", "first")), "line-sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("first").alias(f"{x}f"), F.col("node").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), ["a", "af"]).join(side("b"), ["b", "bf"])
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = stored(both.where(100 * common >= SIMILARITY * (F.size("sa") + F.size("sb") - common)).select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "line-links")
    joined = _rest_joined(lines, sets, components(links))
    places = stored(sets.select("node", "doc_id", "first").distinct().join(joined, "node"), "line-places")
    lead = stored(places.groupBy("component").agg(F.min("doc_id").alias("keep"), F.count("*").alias("lines")), "line-leads")
    lengths = rows.where("line").select("doc_id", "first", "n").distinct()
    later = attached(places, lead, ["component"], "lines").where("doc_id > keep").join(lengths, ["doc_id", "first"]).select("doc_id", "first", "n", "keep")
    # of a document's rows in this order, one lies inside another if an earlier one ends no sooner
    before = Window.partitionBy("doc_id").orderBy("first", F.desc("n"), "keep").rowsBetween(Window.unboundedPreceding, -1)
    found = _stretches(blocks.unionByName(later)).withColumn("_end", F.max(F.col("first") + F.col("n")).over(before))
    return found.where("_end is null or _end < first + n").select("doc_id", F.col("first").cast("long").alias("first_word"), F.col("n").cast("long").alias("n_words"), F.col("keep").alias("keep_doc_id"))


def without_passages(docs: DataFrame) -> DataFrame:
    """docs (unique doc_id) with repeated passages cut out of text, and the white space in front of them with them."""
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_spans"))
    cut = docs.join(spans.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    # a text in pieces of white space and a word; the piece behind the last word stays
    pieces = r"regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)"
    tail = r"regexp_extract(text, '[\\x20\\x09-\\x0D]*$', 0)"
    kept = f"array_join(filter({pieces}, (p, i) -> not exists(_spans, s -> i >= s.first_word and i < s.first_word + s.n_words)), '')"
    return cut.withColumn("text", F.expr(f"if(_spans is null, text, concat({kept}, {tail}))")).select(*docs.columns)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_documents(spark, sf_dir))
