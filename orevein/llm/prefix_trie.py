"""A trie of conversations: every distinct beginning of one is a node.

A turn is a digest of DIGEST bytes, and a conversation the chain of its turns' digests, so that chains in the order of bytes stand in the order of the
trie. They are range-sorted over the cluster (by chain and id, so that copies of one conversation spread over ranges), and neighbours' longest common prefixes are all that the trie's
shape depends on: a sweep over a range keeps a stack of the nodes that are open, opens a node for each turn beyond the prefix shared with the chain before, and closes,
adding up into their parents, those beyond the prefix shared with the next. A node that reaches over an end of its range is known by the prefix that the chains on either side of
the cut share. Its range's part goes out as a partial sum, under the depth and the first range that it lies in, where the parts meet again.
A second sweep, over the closed nodes in reverse, hands every node its parent's name.

What is held: a stack as deep as a conversation in each task, two numbers for each range on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, n_words_of, stored

#: Bytes of a turn's digest; of copies' ids in a piece of their list.
DIGEST, PIECE = 16, 1 << 13
#: Turns of a base conversation that another one can take over, at most; base conversations stand this far apart.
TAKEN, APART = 3, 20

NODE = pa.schema([
    ("part", pa.int32()), ("seq", pa.int64()), ("depth", pa.int64()), ("first", pa.int32()), ("side", pa.int8()), ("conv_id", pa.int64()), ("words", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("sha", pa.string()), ("ids", pa.string()), ("piece", pa.int64()),
])
NODE_SQL = "part int, seq long, depth long, first int, side byte, conv_id long, words long, n_convs long, n_children long, n_leaves long, saved long, sha string, ids string, piece long"
EMPTY = hashlib.sha256(b"").hexdigest()


def chains(turns: DataFrame) -> DataFrame:
    """conv_id, chain (binary, DIGEST bytes a turn) and words (an array, a number a turn) of every conversation as it stands.

    Turns are in the order of turn, null first; ties in that of their digests. Null role and text are empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat_ws("\n", F.octet_length(role).cast("string"), F.concat(role, text)), 256), 1, 2 * DIGEST)
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), digest.alias("d"), n_words_of(text).alias("w")).alias("t"))
    listed = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join(F.col("t.d"), "")).alias("chain"), F.col("t.w").alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """chains(), with each conversation's first h turns replaced by those of its base, the one whose id is the multiple of APART at or (if negative) above its own; h is from 0 to TAKEN by the CRC-32 of its id.

    A base that isn't there gives no turns, one that is shorter gives all it has.
    """
    own = stored(chains(turns), "chains")
    heads = own.where(F.col("conv_id") % APART == 0).select(F.col("conv_id").alias("_b"), F.substring("chain", 1, TAKEN * DIGEST).alias("_c"), F.slice("words", 1, TAKEN).alias("_w"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (TAKEN + 1)
    # at most APART conversations have one base, or 2 * APART - 1 about zero
    both = own.withColumn("_h", h.cast("int")).join(heads, F.col("conv_id") - F.col("conv_id") % APART == F.col("_b"), "left")
    none, no_words = F.expr("x''"), F.array().cast("array<bigint>")
    chain = F.concat(F.expr(f"substring(coalesce(_c, x''), 1, _h * {DIGEST})"), F.coalesce(F.expr(f"substring(chain, _h * {DIGEST} + 1)"), none))
    words = F.concat(F.slice(F.coalesce("_w", no_words), F.lit(1), F.col("_h")), F.slice("words", F.col("_h") + 1, F.greatest(F.size("words"), F.lit(1))))
    return both.select("conv_id", chain.alias("chain"), words.alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the start of both chains that are alike: halved until found, so a long chain takes few comparisons."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    if a[: hi * DIGEST] == b[: hi * DIGEST]:
        return hi
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo * DIGEST : mid * DIGEST] == b[lo * DIGEST : mid * DIGEST]:
            lo = mid
        else:
            hi = mid
    return lo


class _Listed:
    """SHA-256 of ids joined by commas, as they come; or, if other ranges may have more of them, pieces of that list. No more than a range's ids are held."""

    def __init__(self, pieces: bool):
        self.sha, self.any, self.pieces = hashlib.sha256(), False, [] if pieces else None

    def add(self, text: str) -> None:
        if self.pieces is None:
            self.sha.update(("," + text if self.any else text).encode())
        elif self.pieces and len(self.pieces[-1]) < PIECE:
            self.pieces[-1] += "," + text
        else:
            self.pieces.append(text)
        self.any = True

    def hexdigest(self) -> str:
        return self.sha.hexdigest() if self.pieces is None else hashlib.sha256(",".join(self.pieces).encode()).hexdigest()


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, list]]:
    """(part, conv_id, chain, words) of rows in order; the words of chains are read as they are needed."""
    for batch in batches:
        yield from zip(batch.column("part").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("chain").to_pylist(), batch.column("words"), strict=True)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every range in a task: its first and last chain, and the least that neighbours in it share."""
    part = first = last = None
    least = 0
    row = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary()), "least": pa.array([least], pa.int64())})
    for p, _, chain, _ in _sorted_runs(batches):
        if p != part:
            if part is not None:
                yield row()
            part, first, least = p, chain, 1 << 60
        else:
            least = min(least, common_turns(last, chain))
        last = chain
    if part is not None:
        yield row()


def _sweeping(before: dict[int, int], behind: dict[int, int], least: dict[int, int], previous: dict[int, int]):
    """The sweep over ranges. before, behind: turns that a range's first (last) chain shares with the chain on the other side of the cut; least: within the range; previous: the range before."""

    def first_range(part: int, depth: int) -> int:
        """Where the node of this depth begins that part's first chain lies in."""
        while before[part] >= depth:
            part = previous[part]
            if least[part] < depth:
                break
        return part

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part, last, words, seq = None, b"", [], 0
        # by depth: smallest id, conversations, children, leaves, saved words, whether it reaches over the start of the range, ids of conversations that end here
        stack: list[list] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), NODE, strict=True)], schema=NODE)
                out.clear()

        def close(down_to: int, right: int) -> None:
            """Close all nodes deeper than down_to; of those up to the depth right more may come in the next range."""
            nonlocal seq
            for depth in range(len(stack) - 1, down_to, -1):
                least_id, n, children, leaves, saved, left, ends = stack.pop()
                over = left or depth <= right
                first = None if not over else first_range(part, depth) if left else part
                w = words[depth - 1] if depth else 0
                if not over:
                    leaves, saved = leaves or 1, saved + (n - 1) * w
                elif ends:
                    out.extend((part, None, depth, first, None, None, None, None, None, None, None, None, ids, k) for k, ids in enumerate(ends.pieces))
                sha = None if over else ends.hexdigest() if ends else EMPTY
                out.append((part, seq, depth, first, int(over), least_id, w, n, children, leaves, saved, sha, None, None))
                seq += 1
                if depth:
                    up = stack[depth - 1]
                    up[0], up[1] = min(up[0], least_id), up[1] + n
                    if not over:
                        up[2], up[3], up[4] = up[2] + 1, up[3] + leaves, up[4] + saved

        for p, conv, chain, w in _sorted_runs(batches):
            depth, left = len(chain) // DIGEST, -1
            if p != part:
                if part is not None:
                    close(-1, behind[part])
                part, seq, left = p, 0, before[p]
            else:
                close(common_turns(last, chain), -1)
            if depth >= len(stack):
                words = w.as_py()
                stack.extend([1 << 62, 0, 0, 0, 0, d <= left, None] for d in range(len(stack), depth + 1))
            last = chain
            here = stack[depth]
            here[0], here[1] = min(here[0], conv), here[1] + 1
            here[6] = here[6] or _Listed(here[5] or depth <= behind[p])
            here[6].add(str(conv))
            if len(out) >= 4096:
                yield from flush()
        if part is not None:
            close(-1, behind[part])
        yield from flush()

    return sweep


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, depth, sha) from pieces of lists in order."""
    at, sha = None, None
    row = lambda: pa.RecordBatch.from_pydict({"first": pa.array([at[0]], pa.int32()), "depth": pa.array([at[1]], pa.int64()), "sha": [sha.hexdigest()]})
    for batch in batches:
        for first, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("first", "depth", "ids")), strict=True):
            if (first, depth) != at:
                if at:
                    yield row()
                at, sha = (first, depth), _Listed(False)
            sha.add(ids)
    if at:
        yield row()


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that reach over ends, children behind their parents, added up from the last one on."""
    rows = [r for b in batches for r in b.to_pylist()]
    stack: list[dict] = []

    def close(depth: int) -> Iterator[dict]:
        while stack and stack[-1]["depth"] >= depth:
            r = stack.pop()
            r["n_leaves"], r["saved"] = r["n_leaves"] or 1, r["saved"] + (r["n_convs"] - 1) * r["words"]
            if stack:
                for k, v in (("n_children", 1), ("n_leaves", r["n_leaves"]), ("saved", r["saved"])):
                    stack[-1][k] += v
            yield r

    done = []
    for r in rows:
        done.extend(close(r["depth"]))
        stack.append(r)
    done.extend(close(0))
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=CROSSING)


CROSSING = pa.schema([("first", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("words", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64())])
CROSSING_SQL = "first int, depth long, conv_id long, words long, n_convs long, n_children long, n_leaves long, saved long"
NAMED = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NAMED_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _naming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a range, parents first: each gets the name of the last node a step less deep. Parts of a node that began in an earlier range only give their name."""
    path: list[int | None] = []
    for batch in batches:
        kept = []
        for part, depth, first, conv, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "depth", "first", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "sha")), strict=True):
            del path[depth:]
            parent = path[depth - 1] if depth else None
            path.append(conv)
            if first is None or first == part:
                kept.append((conv, depth, parent, *rest))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(NAMED, zip(*kept, strict=True), strict=True)], names=NAMED)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """NAMED for every node of the trie of conversations (conv_id, chain, words), as rebuilt() and chains() return them.

    The root (depth 0) is there if any conversation is; one without turns belongs to it alone. conv_id has to tell rows apart. A table without conversations gives no rows.
    A conversation has to fit into a row: a chain of a million turns has 16 MB. Turns are compared by DIGEST bytes of their SHA-256.
    """
    order = ["chain", "conv_id"]
    ranged = stored(conversations.select("conv_id", "chain", "words").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "trie-ranges")
    # the table's files may be read in other pieces than they were written in: ranges are put together again, several a task
    rows = ranged.repartition("part").sortWithinPartitions("part", *order)
    ends = stored(rows.mapInArrow(_ends, "part int, first binary, last binary, least long"), "trie-ends")
    # a row for each range
    cuts = ends.select("part", "first", "last", "least").coalesce(1).sortWithinPartitions("part").mapInArrow(_cutting, "part int, before long, least long").collect()
    cuts = sorted((r.part, r.before, r.least) for r in cuts)
    before = {p: b for p, b, _ in cuts}
    behind = {p: b for (p, _, _), (_, b, _) in zip(cuts, [*cuts[1:], (None, -1, None)], strict=False)}
    previous = {p: q for (p, _, _), (q, _, _) in zip(cuts[1:], cuts, strict=False)}
    swept = stored(rows.mapInArrow(_sweeping(before, behind, {p: x for p, _, x in cuts}, previous), NODE_SQL), "trie-nodes")
    # parts of nodes that reach over ends of ranges: no more than the turns that chains on either side of a cut share
    parts = swept.where("side = 1").groupBy("first", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    crossing = parts.coalesce(1).sortWithinPartitions("first", "depth").mapInArrow(_folding, CROSSING_SQL)
    lists = swept.where("ids is not null").select("first", "depth", "part", "piece", "ids").repartition("first", "depth").sortWithinPartitions("first", "depth", "part", "piece")
    crossing = crossing.join(lists.mapInArrow(_joining, "first int, depth long, sha string"), ["first", "depth"], "left").withColumn("sha", F.coalesce("sha", F.lit(EMPTY)))
    crossing = stored(crossing, "trie-crossing")
    columns = ["part", "seq", "depth", "first", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "sha"]
    whole = swept.where("side = 1").select("part", "seq", "first", "depth").join(crossing, ["first", "depth"]).select(columns)
    every = swept.where("side = 0").select(columns).unionByName(whole)
    return every.repartition("part").sortWithinPartitions("part", F.desc("seq")).mapInArrow(_naming, NAMED_SQL)


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ranges in order: what the first chain shares with the last one of the range before (-1: nothing, there is none)."""
    behind = None
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"]], pa.int32()), "before": pa.array([-1 if behind is None else common_turns(behind, r["first"])], pa.int64()), "least": pa.array([r["least"]], pa.int64())})
            behind = r["last"]


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Every beginning of every rebuilt conversation, grouped; sums over subtrees by the beginnings of each node. CRC-32 of the id by its table, which its polynomial gives.
OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, substr(sha256(octet_length(encode(r)) || chr(10) || r || x), 1, 32)) AS v FROM turns GROUP BY conv_id),
taking AS (SELECT own.*, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 4 AS h FROM own, crc),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.v[1:c.h], []), c.v[c.h + 1:]) AS v FROM taking c LEFT JOIN own b ON b.conv_id = c.base),
starts AS (SELECT conv_id, len(v) = d AS ends, d, v[1:d] AS k FROM (SELECT conv_id, v, unnest(range(len(v) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(k[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM starts GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
each AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
above AS (SELECT a AS d, k[1:a] AS k, sum((n - 1) * w) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM each) GROUP BY ALL)
SELECT e.conv_id, e.d AS depth, p.conv_id AS parent_conv_id, e.n AS n_convs, e.n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM each e JOIN above USING (d, k) LEFT JOIN nodes p ON p.d = e.d - 1 AND p.k = e.k[1:e.d - 1]
"""
