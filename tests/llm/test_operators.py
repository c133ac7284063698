"""Operators against brute force on small inputs, and on the odd ones."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from orevein.llm import components as CC
from orevein.llm import exact_dedup, importance, mixing, near_dedup, passages, pieces, private_data, quality_rules, sharding, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, size=400):
    vocabulary = [f"w{k}" for k in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies around the limit, and a shared passage."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(120)]
    for k in range(60):
        words = texts[k].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    base = prose(rng, 150).split()
    for _ in range(40):  # a crowded region
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts + texts[:10]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(t.lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def joined(n, links):
    at = list(range(n))

    def root(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize(("window", "similarity"), [(12, 85), (2, 85), (1, 80), (2, 95), (2, 60), (2, 45)])
def test_near_groups_equal_brute_force(spark, corpus, monkeypatch, window, similarity):
    monkeypatch.setattr(near_dedup, "WINDOW", window)
    sets = shingle_sets(corpus)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    got = {r.doc_id: r for r in near_dedup.near_groups(frame(spark, corpus), similarity).collect()}
    want = joined(len(corpus), links)
    assert [got[k].component_id for k in range(len(corpus))] == want
    assert [got[k].n_shingles for k in range(len(corpus))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_groups_find_every_link_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").collect()]
    sets = shingle_sets(texts)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * min(len(sets[a]), len(sets[b])) >= 85 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = joined(len(ids), links)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert [got[i] for i in ids] == [ids[k] for k in want]


def test_forest_shape_follows_the_similarity():
    for similarity in range(1, 101):
        trees, least = near_dedup.forest_shape(similarity)
        assert (1 - (similarity / 100) ** least) ** trees <= near_dedup.MISS and 1 <= least <= 4
    assert near_dedup.forest_shape(85) == (15, 4) and near_dedup.sketch_limit(85, 128) < 0.67
    with pytest.raises(ValueError):
        near_dedup.forest_shape(0)


def test_attached_deals_hot_keys_apart(spark, monkeypatch):
    from orevein.llm import common

    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(3000)] + [(-1, None)], "doc_id long, k long")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    for hot in (1, 50, 1000):
        monkeypatch.setattr(common, "HOT", hot)
        got = {r.doc_id: (r.n, r.least) for r in common.attached(rows, table.where("n > 1"), ["k"], "n").collect()}
        assert got == {i: (2000, 1) if i % 3 else (None, None) for i in range(3000)} | {-1: (None, None)}


def test_near_groups_odd(odd, empty):
    rows = near_dedup.near_groups(odd).collect()
    assert len(rows) == 10 and {r.n_shingles for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_groups(empty).count() == 0
    assert sorted(str(r.doc_id) for r in near_dedup.one_of_each(odd).collect()) == sorted(map(str, [1, 2, 3, 4, None, 7, 8, 9]))
    assert near_dedup.one_of_each(odd).columns == odd.columns


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    got = {r.node: r.component for r in CC.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = joined(4000, links)
    nodes = {x for l in links if l[0] != l[1] for x in l}
    assert set(got) == nodes and all(got[x] == want[x] for x in nodes)
    assert CC.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n_bytes", [32, 1])
def test_exact_groups(spark, corpus, n_bytes):
    """With digests of one byte nearly all collide, and only the bytes tell."""
    texts = [t.replace(" ", "\t ", 1) if k % 7 == 0 else t for k, t in enumerate(corpus)]
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts]
    groups = collections.defaultdict(list)
    for k, t in enumerate(plain):
        groups[t].append(k)
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, texts), n_bytes).collect()}
    for k, t in enumerate(plain):
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (groups[t][0], len(groups[t]), groups[t][0] == k)
        assert got[k].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_groups_odd(odd, empty):
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == 10 and exact_dedup.exact_groups(empty).count() == 0
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.keep_id, r.group_size, r.kept))
    assert by[2] == {(2, 2, True)} and by[3] == {(2, 2, False)} and by[5] == {(1, 3, False)} and by[None] == {(None, 1, True)} and by[4] == {(4, 1, True)}
    kept = exact_dedup.first_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 4, None, 7, 8, 9]))


def test_merge_index_levels_and_lookups(spark, tmp_path):
    index = exact_dedup.MergeIndex(spark, f"{tmp_path}/index", memtable=16, bucket_bits=4)
    truth = {}
    for batch in range(6):
        ids = range(batch * 50, batch * 50 + 50)
        rows = [(hashlib.sha256(str(i % 70).encode()).digest(), i) for i in ids]
        for d, i in rows:
            was = truth.get(d, (i, 0))
            truth[d] = (min(was[0], i), was[1] + 1)
        index.add(spark.createDataFrame(rows, "digest binary, doc_id long"))
    assert len(index.tables) < 6
    assert {bytes(r.digest): (r.doc_id, r.n) for r in index.entries().collect()} == truth
    asked = [hashlib.sha256(str(i).encode()).digest() for i in range(60, 90)]
    found = {bytes(r.digest): (r.doc_id, r.n) for r in index.find(spark.createDataFrame([(a,) for a in asked], "digest binary")).collect()}
    assert found == {a: truth[a] for a in asked if a in truth}
    index.compact()
    assert len(index.tables) == 1 and {bytes(r.digest): (r.doc_id, r.n) for r in index.entries().collect()} == truth


def test_shards(spark, corpus):
    texts = corpus + ["copy of one text"] * 120
    rows = sharding.assign_shards(frame(spark, texts), 8).collect()
    assert len(rows) == len(texts)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    mean, largest = sum(sizes.values()) / 8, max(r.size for r in rows)
    assert all(abs(s - mean) <= 2 * largest for s in sizes.values())
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(frame(spark, texts).repartition(3), 8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_shards_follow_their_law(spark):
    """Law bytes, recomputed in the key's order; copies of one text, with and without ids, are most of the rows, so that ranges are overfull."""
    texts = [(k, "one text" if k % 3 else f"text {k} " * (k % 17)) for k in range(3000)] + [(None, "one text")] * 900
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = sharding.assign_shards(docs, 7).withColumn("h", F.lit(None).cast("long")).collect()
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", sharding.text_key(F.col("text")).alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (hashes[r.doc_id], r.doc_id is not None, r.doc_id or 0))
    total, upto = sum(r.size for r in rows), 0
    for r, nxt in zip(ordered, ordered[1:] + [None]):
        middle = upto + r.size / 2
        if r.doc_id is not None:
            assert r.shard == min(6, int(middle * 7 / total))
        upto += r.size
    assert collections.Counter(r.shard for r in rows if r.doc_id is None).total() == 900


def test_shards_odd(odd, empty, tmp_path, corpus, spark):
    rows = sharding.assign_shards(odd, 4).collect()
    assert len(rows) == 10 and {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert sharding.assign_shards(empty, 4).count() == 0
    sharding.write_shards(frame(spark, corpus), f"{tmp_path}/shards", 4)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(corpus)


def test_token_counts(spark, tmp_path, odd, empty):
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/rollup")
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    docs = [(1, "hello world", "en", "a"), (2, "guten Tag", "de", "a"), (3, None, None, None), (1, "hello world", "en", "a")]
    schema = "doc_id long, text string, lang string, source string"
    n = lambda t: len(encode(t))
    totals = lambda: {(r.source, r.lang): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", inserts=spark.createDataFrame(docs, schema))
    assert not rollup.commit("b1", inserts=spark.createDataFrame(docs, schema))
    assert totals() == {("a", "en"): (2, 2 * n("hello world")), ("a", "de"): (1, n("guten Tag")), (None, None): (1, 0)}
    assert rollup.commit("b2", deletes=spark.createDataFrame([(1,), (1,), (99,)], "doc_id long"), revisions=spark.createDataFrame([(2, "guten Tag Welt", "de", "b")], schema))
    assert totals() == {("b", "de"): (1, n("guten Tag Welt")), (None, None): (1, 0)}
    assert rollup.commit("b3", deletes=spark.createDataFrame([(1,), (3,)], "doc_id long"), inserts=spark.createDataFrame([(1, "x", "en", "a")], schema))
    assert totals() == {("b", "de"): (1, n("guten Tag Welt")), ("a", "en"): (1, 1)}
    assert rollup.commit("b4", inserts=odd) and rollup.commit("b5", inserts=empty) and len(rollup.batches()) == 5
    with pytest.raises(ValueError):
        rollup.commit("../x", inserts=empty)


def test_token_counts_query_equals_a_recount(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    want = collections.Counter()
    for r in docs.collect():
        want[r.source, r.lang, "documents"] += 1
        want[r.source, r.lang, "tokens"] += len(encode(r.text or ""))
    got = {}
    for r in token_counts.op3_token_counts(spark, "/root/testdata/sf0.001").collect():
        got |= {(r.source, r.lang, "documents"): r.documents, (r.source, r.lang, "tokens"): r.tokens}
    assert got == dict(want) and want


def test_token_counts_compaction_and_null_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT", 3)
    schema = "doc_id long, text string, source string, lang string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    rollup = token_counts.TokenRollup(spark, f"{tmp_path}/rollup")
    rollup.commit("a", inserts=rows((1, "one two", "s", "en"), (None, "nobody", "s", "en"), (2, "x", None, None)))
    other = token_counts.TokenRollup(spark, f"{tmp_path}/rollup", version="other/2")
    other.commit("b", inserts=rows((1, "one two", "s", "en")))
    rollup.commit("c", deletes=spark.createDataFrame([(None,)], "doc_id long"))
    assert rollup._names("batches") == [] and rollup.batches() == ["a", "b", "c"]
    assert not rollup.commit("b", inserts=rows((1, "one two", "s", "en")))
    at = {(r.source, r.tokenizer): r.documents for r in rollup.totals().collect()}
    assert at == {("s", rollup.version): 1, ("s", "other/2"): 1, (None, rollup.version): 1}
    rollup.commit("d", revisions=rows((1, "one two three", "t", "en"), (None, None, "s", "en")))
    at = {(r.source, r.tokenizer): (r.documents, r.tokens > 0) for r in rollup.totals().collect()}
    assert at == {("t", rollup.version): (1, True), ("s", rollup.version): (1, False), (None, rollup.version): (1, True)}


def test_quality_classifier(spark, odd, empty, labels):
    rng = random.Random(3)
    rows, known = [], []
    for k in range(600):
        bad = k % 5 == 0
        text = prose(rng, rng.randint(20, 200))
        rows.append((k, text.replace(" ", "!! ").upper() if bad else text, "en", "s", 1))
        if k % 2:
            known.append((k, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in importance.resample(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[k] for k in range(600) if k % 5) >= 470 and sum(got[k] for k in range(0, 600, 5)) <= 6
    kept = importance.resample(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), k=100)
    top = sorted(kept.collect(), key=lambda r: -r.key)
    assert [r.kept for r in top] == [True] * 100 + [False] * 500
    out = importance.resample(odd, labels).collect()
    assert len(out) == 10 and importance.resample(empty, labels).count() == 0
    assert importance.keep_good(odd, labels, k=10).columns == odd.columns and importance.keep_good(odd, labels, k=10).count() == 10 and importance.keep_good(odd, labels, k=0).count() == 0


def test_weights_equal_a_recount(spark):
    import math

    from orevein.llm.textvec import Words, mixed

    np = importance.np
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    known = labels.where("quality in (0, 1)").select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(importance.PARTS)).alias("part")).collect()
    hashes: dict = {}

    def word(w):
        if w not in hashes:
            data = np.frombuffer(w.encode(), np.uint8)
            hashes[w] = Words(data, np.array([0, len(data)])).hash[0]
        return hashes[w]

    def grams(text):
        words, data = [word(w) for w in WORD.findall(text)], text.encode()
        with np.errstate(over="ignore"):
            two = [mixed(a * np.uint64(0x9E3779B97F4A7C15) + b) for a, b in zip(words, words[1:])]
        three = [mixed(np.uint64((data[k] | data[k + 1] << 8 | data[k + 2] << 16) + (1 << 40))) for k in range(len(data) - 2)]
        return collections.Counter(int(x) & (importance.BUCKETS - 1) for x in words + two + three)

    some = {i: t for i, t in rows.items() if len(t) < 1500}
    small = docs.where(F.col("doc_id").isin(list(some)))
    got = {r.doc_id: r for r in importance.resample(small, labels).collect()}
    each = {i: grams(t) for i, t in some.items()}
    raw, target = collections.Counter(), collections.Counter()
    good = {r.doc_id for r in known if r.quality == 1 and r.part < importance.TARGET}
    for i, g in each.items():
        raw.update(g)
        if i in good:
            target.update(g)
    whole, aim = sum(raw.values()) + importance.BUCKETS, sum(target.values())
    ratio = lambda x: math.log((target[x] + importance.EVENS) / (aim * (raw[x] + 1) / whole + importance.EVENS))
    for i, g in each.items():
        want = importance.STRETCH * sum(n * ratio(x) for x, n in g.items()) / (sum(g.values()) + importance.PRIOR)
        assert abs(got[i].log_weight - want) < 1e-6 and got[i].key != got[i].log_weight


def test_noise_decides_near_the_cut_and_unseen_labels_agree(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("quality in (0, 1)").select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(importance.PARTS)).alias("part"))
    got = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    k = sum(r.kept for r in got.values())
    top = {r.doc_id for r in sorted(got.values(), key=lambda r: -r.log_weight)[:k]}
    assert 0 < sum(r.kept != (r.doc_id in top) for r in got.values()) < 0.02 * len(got)
    unseen = [(r.quality, got[r.doc_id].kept) for r in known.where("part = 3").collect()]
    assert len(unseen) > 500
    assert sum(kept for q, kept in unseen if q) >= 0.98 * sum(q for q, _ in unseen) and sum(kept for q, kept in unseen if not q) <= 0.2 * sum(1 - q for q, _ in unseen)


def test_kth_largest(spark):
    values = [random.Random(2).randrange(-(10**12), 10**12) for _ in range(500)] + [7] * 20
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 250, 520):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_pieces_equal_the_library(spark, odd, empty, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = corpus[:60] + ["", " ", "  x ", "日本𝕏语 é é", "▁a <s> <0x41> ﬁ\u0000", "a" * 3000, "    many   spaces\n\n\ttabs ", "internationalisation " * 50, "====----****" * 9, "🎉" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = pieces.encoded(rows)
    got = {r.doc_id: r for r in encoded.collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == library.encode(t) and got[k].round_trip and got[k].n_tokens == len(got[k].ids)
    back = {r.doc_id: r.text for r in pieces.decoded(encoded).collect()}
    assert back == {k: t.replace("▁", " ") for k, t in enumerate(texts)}
    out = {r.doc_id: r.n_tokens for r in pieces.encoded(odd).collect()}
    assert out[2] == out[3] == 0 and out[7] > 30000 and pieces.encoded(empty).count() == 0


def test_mix(spark, odd, empty):
    rng = random.Random(9)
    rows = [(k, prose(rng, rng.randint(1, 60)), "en", f"s{int(rng.random() ** 2 * 6)}" if k % 50 else None, 1) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = mixing.mix(docs).collect()
    words = {k: len(t.split()) for k, t, *_ in rows}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert r.size == words[r.doc_id] and 0 <= r.copies <= 3
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s))
    want, weight = {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free = sum(size.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * size[s]}
        if not full:
            break
        want |= {s: 3 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        free -= full
    want |= {s: level * weight[s] for s in free}
    assert all(target[s] == pytest.approx(want[s]) for s in order)
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert {r.doc_id: r.copies for r in mixing.mix(docs.repartition(2)).collect()} == {r.doc_id: r.copies for r in out}
    assert mixing.take(docs).count() == sum(r.copies for r in out)
    assert len(mixing.mix(odd).collect()) == 10 and mixing.mix(empty).count() == 0 and mixing.take(odd).columns == odd.columns


def test_mix_keeps_long_ids_beside_null_ones(spark):
    rows = [(None if k % 9 == 0 else (1 << 62) + k, "a b c", "en", "s", 1) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, (r.doc_id for r in mixing.mix(docs).collect()))) == sorted(str(r[0]) for r in rows)


def test_targets_are_met_at_every_seed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").cache()
    for seed in range(4):
        taken, target = collections.Counter(), {}
        for r in mixing.mix(docs, seed=seed).collect():
            taken[r.source] += r.size * r.copies
            target[r.source] = r.target
            assert 0 <= r.copies <= 3
        assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_pivotal_keeps_the_sum_where_one_document_outweighs_the_rest():
    import numpy as np

    for seed in range(50):
        rng = np.random.default_rng(seed)
        size = np.array([5184, *sorted(rng.integers(20, 90, 40), reverse=True)])
        for share in (0.2, 0.5, 0.9):
            p = np.full(41, share)
            out, left = mixing.pivotal(p, size, rng.random(41), heavy=0.01 * share * size.sum())
            got = (out * size).sum() + (p[left] * size[left] if left >= 0 else 0)
            # nearer than the large one's half
            best = min(abs(x - share * size.sum()) for x in (size[1:].sum(), size[0]))
            assert abs(got - share * size.sum()) <= best + 1e-6 or abs(got - share * size.sum()) < 90


def test_pivotal_keeps_chances_and_words():
    import numpy as np

    rng = np.random.default_rng(0)
    size, p0, hits = np.array([90, 40, 39, 20, 7, 5, 5, 3]), np.array([0.3, 0.5, 0.7, 0.2, 0.9, 0.5, 0.1, 0.6]), np.zeros(8)
    for _ in range(20000):
        p = p0.copy()
        out, left = mixing.pivotal(p, size, rng.random(8))
        total = (out * size).sum() + (p[left] * size[left] if left >= 0 else 0)
        assert abs(total - (p0 * size).sum()) < 1e-6
        hits += out
        if left >= 0:
            hits[left] += p[left]
    assert abs(hits / 20000 - p0).max() < 0.02


def base_statistics(t):
    w = WORD.findall(t or "")
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, odd, empty, labels):
    texts = ["a b c d e f a b c d e f", "x " * 12, "l1 a\nl2\nl1 a\n\n \n", "#$ é|<>", "a b c d e q a b c d e", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.with_statistics(rows).collect():
        n, chars, symbols, dup, repeat = base_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
    out = quality_rules.judge(odd, labels).collect()
    assert len(out) == 10 and quality_rules.judge(empty, labels).count() == 0 and all(not r.kept for r in out if r.base_failed)
    assert quality_rules.judge(odd, labels.where("false")).count() == 10


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_few_labels_teach_a_rule_too(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.learn(quality_rules.labelled_rows(docs, labels))
    unseen = quality_rules.labelled_rows(docs, labels, held_out=True)
    said = [(r["bad"], any(x.holds(r) for x in rules)) for r in unseen]
    bad, good = [x for b, x in said if b], [x for b, x in said if not b]
    assert rules and sum(good) <= 0.02 * len(good) and sum(bad) >= 0.85 * len(bad)


def test_four_rows_support_a_rule_and_noise_does_not():
    row = lambda k, bad, x: dict.fromkeys(quality_rules.FEATURES, 0.0) | {"key": k, "bad": bad, "symbols_a_word": x}
    assert quality_rules.learn([row(k, k % 10 == 0, float(k % 10 == 0)) for k in range(40)])
    rng = random.Random(1)
    assert not quality_rules.learn([row(k, rng.random() < 0.3, rng.random()) for k in range(400)])


def test_verdict_equals_the_rules_and_holds_on_unseen_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.learn(quality_rules.labelled_rows(docs, labels))
    unseen = quality_rules.labelled_rows(docs, labels, held_out=True)
    said = [(r["bad"], any(x.holds(r) for x in rules)) for r in unseen]
    bad, good = [x for b, x in said if b], [x for b, x in said if not b]
    assert len(unseen) > 500 and sum(good) <= 0.02 * len(good) and sum(bad) >= 0.8 * len(bad)
    # the CASE expression against the rules themselves, on rows whatever they are
    rng = random.Random(3)
    made = [{f: rng.choice([0.0, rng.random(), rng.random() * 9]) for f in quality_rules.FEATURES} for _ in range(300)]
    listed = rules + [quality_rules.Rule([("words", ">", 3.0), ("repeated", "<=", 0.5)]), quality_rules.Rule([("chars_a_word", ">", 4.0), ("symbols_a_char", ">", 0.4)])]
    base = [(k, x["words"], 1.0, x["symbols_a_word"], x["dup_lines_a_word"], x["repeated"]) for k, x in enumerate(made)]
    rows = spark.createDataFrame(base, "k int, n_words double, word_chars double, n_symbols double, n_dup_lines double, n_repeat_words double")
    got = {r.k: r for r in rows.select("k", *(F.expr(e).alias(f) for f, e in quality_rules.FEATURES.items()), quality_rules.verdict(listed).alias("kept")).collect()}
    for r in got.values():
        assert r.kept == (not any(x.holds(r.asDict()) for x in listed))
    assert 0 < sum(r.kept for r in got.values()) < 300


def test_decision_list_finds_a_conjunction():
    rng = random.Random(4)
    rows = [{"key": k, "symbols_a_word": rng.random(), "symbols_a_char": 0.0, "chars_a_word": rng.random() * 9, "repeated": 0.0, "dup_lines_a_word": 0.0, "words": 50.0} for k in range(900)]
    for r in rows:
        r["bad"] = r["symbols_a_word"] > 0.6 and r["chars_a_word"] <= 5
    rules = quality_rules.learn(rows)
    said = [any(rule.holds(r) for rule in rules) for r in rows]
    assert rules and sum(s == r["bad"] for s, r in zip(said, rows, strict=True)) >= 870
    assert quality_rules.learn([]) == []


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_context_words_are_whole_words(spark):
    before = {"my hotel ": 0, "the ship ": 0, "a comfortable ": 0, "share ": 0, "my tel. ": 1, "E-Mail: ": 1, "Telephone ": 1, "cards ": 1, "in part ": -1, "border ": 0, "order ": -1}
    got = {r.b: r.v for r in spark.createDataFrame([(b,) for b in before], "b string").select("b", private_data._context(F.col("b")).alias("v")).collect()}
    assert got == before


def test_private_data(spark, odd, empty):
    rng = random.Random(8)
    texts = ["a@b.c_x@d.e @ z@q", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111  1111 5", "+1 (523) 555-1055 +12 +49.30.1234567890123", "é 4111111111111111.", 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" x', "1" * 400, "a.b" * 300 + "@x.y"]
    for _ in range(300):
        texts.append("".join(rng.choice("ab1234567890 .-+()@_%é\n") for _ in range(rng.randint(0, 60))))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in private_data.find_private(rows).collect():
        want = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, texts[r.doc_id]) if valid(k, m.group()))
        assert [(x.s, x.kind, x.e) for x in r.spans if x.base] == [(s, k, e) for s, _, k, e in want]
        assert [x.s for x in r.spans] == sorted(x.s for x in r.spans)
    assert "[card]" in private_data.redacted(rows).where("doc_id = 4").first().text
    assert len(private_data.find_private(odd).collect()) == 10 and private_data.find_private(empty).count() == 0


def test_secrets_behind_a_colon_and_long_ones(spark):
    token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'"api_key": "{token}"', f"token:'{token}' é", f'token = "{token * 5}"', f'secret key:  "{token}"']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.kind, texts[r.doc_id][x.s : x.e]) for x in r.spans] for r in private_data.find_private(rows).collect()}
    assert got == {0: [("secret", token)], 1: [("secret", token)], 2: [("secret", token * 5)], 3: []}


def test_reliabilities_come_from_agreement():
    """A labeler that contradicts the two others loses, whichever it is; and a kind's own votes count where there are many."""
    for odd_one in range(3):
        with_all = lambda a, b: tuple(b if j == odd_one else a for j in range(3))
        votes = [("secret", (1, 1, 1), 80), ("secret", (-1, -1, -1), 80), ("secret", with_all(1, -1), 60), ("secret", with_all(-1, 1), 60)]
        q = private_data.reliabilities(votes)
        assert q["secret", with_all(1, -1)] > 0.8 and q["secret", with_all(-1, 1)] < 0.2
    both = private_data.reliabilities([("card", (1, 1, 1), 500), ("card", (-1, -1, -1), 500), ("local", (0, 0, 1), 300), ("local", (0, 0, -1), 300), ("ssn", (1, 0, 1), 50)])
    assert both["local", (0, 0, 1)] > 0.7 and both["local", (0, 0, -1)] < 0.3 and both["ssn", (1, 0, 1)] > 0.9


def planted(rng):
    """Texts with spans that are personal data and look-alikes that aren't; the first with their places."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    local = lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"
    makers = [
        (True, "secret", lambda: ('token = "', hexes(), '"')),
        (False, "secret", lambda: ('version = "', "abcdefghijklmnopqrst"[: rng.randint(16, 20)], '"')),
        (True, "local", lambda: ("call me by phone ", local(), " today")),
        (False, "local", lambda: ("see part ", local(), " in the table")),
        (True, "ssn", lambda: ("his ssn ", f"{digits(3)}-{digits(2)}-{digits(4)}", " is known")),
        (True, "name", lambda: ("born as ", "Dr. " + rng.choice(["Maria Lopez", "John Smith", "Anna Keller"]), " there")),
    ]
    texts, true = [], []
    for k in range(600):
        is_true, kind, make = rng.choice(makers)
        before, span, behind = make()
        head = f"{word()} {word()} "
        texts.append(head + before + span + behind + f" {word()} é {word()}")
        if is_true:
            true.append((k, kind, len(head + before), len(head + before + span)))
    return texts, set(true)


def test_added_spans_on_planted_data(spark):
    texts, true = planted(random.Random(4))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, x.kind, x.s, x.e) for r in private_data.find_private(rows).collect() for x in r.spans if not x.base}
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found)
    assert {k for _, k, _, _ in found} == {"secret", "local", "ssn", "name"}


def test_redaction_leaves_nothing(spark, odd):
    token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = ["mail a@b.com now", "mail a@b.com now", "x +1(30569309025904 and a@1.2.3.4 y", f'token = "{token}"', None, "é 1.2.3.4 and 5.6.7.8"]
    rows = spark.createDataFrame([(None, texts[0], 1), *((7, t, 2) for t in texts[1:])], "doc_id long, text string, spans int")
    out = private_data.redacted(rows)
    assert out.columns == rows.columns
    got = sorted((r.text or "", r.doc_id or 0) for r in out.collect())
    assert got.count(("mail [email] now", 0)) == 1 and got.count(("mail [email] now", 7)) == 1 and ("é [ip] and [ip]", 7) in got and ("", 7) in got
    assert ("x [phone] and [email] y", 7) in got and ("token = \"[secret]\"", 7) in got
    assert private_data.redacted(odd).count() == odd.count()


def test_spans_of_a_text_with_many(spark):
    text = "é a@b.cd 1.2.3.4 " * 8000
    row = private_data.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row.spans) == 16000 and [(x.s, x.e) for x in row.spans[-2:]] == [(17 * 7999 + 2, 17 * 7999 + 8), (17 * 7999 + 9, 17 * 7999 + 16)]


def test_passages(spark, odd, empty):
    rng = random.Random(6)
    passage, line = prose(rng, 60, 5000), prose(rng, 40, 5000)
    texts = []
    for k in range(60):
        parts = [prose(rng, rng.randint(30, 80), 5000) for _ in range(3)]
        if k in (5, 20, 41):
            words = parts[1].split()
            parts[1] = " ".join(words[:11] + passage.split() + words[11:])
        if k in (7, 33):
            near = line.split()
            near[3] = "edited" if k == 33 else near[3]
            parts.append(" ".join(near))
        texts.append("\n".join(parts))
    rows = passages.repeated_passages(frame(spark, texts)).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in rows} == {(20, 5), (41, 5), (33, 7)}
    cut = {r.doc_id: r.text for r in passages.without_passages(frame(spark, texts)).collect()}
    assert all(cut[k] == texts[k] for k in range(60) if k not in (20, 41, 33))
    assert all(len(cut[k].split()) <= len(texts[k].split()) - 20 for k in (20, 41, 33))
    assert passages.repeated_passages(empty).count() == 0 and passages.repeated_passages(odd).count() == 0


def test_bands_are_tuned_by_their_curve():
    assert passages.tuned() == (passages.BANDS, passages.ROWS) == (8, 3)
    assert passages.chance(0.8, 8, 3) >= passages.RECALL and passages.chance(0.3, 8, 3) < 0.2
    for similarity in (0.5, 0.9, 0.99):
        bands, rows = passages.tuned(similarity)
        assert bands * rows <= passages.HASHES
        better = [(b, r) for r in range(1, 25) for b in range(1, 24 // r + 1) if passages.chance(similarity, b, r) >= passages.RECALL and passages.chance(0.3, b, r) < passages.chance(0.3, bands, rows)]
        assert not better


def test_recall_of_edited_paragraphs_against_brute_force(spark):
    """Lines of other documents with a few words replaced: each removal that brute force finds, and none that it doesn't."""
    rng = random.Random(12)
    base = [prose(rng, rng.randint(25, 60), 3000) for _ in range(120)]
    docs = []
    for k in range(400):
        lines = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(base).split() if rng.random() < 0.6 else prose(rng, 40, 3000).split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            lines.append(" ".join(words))
        docs.append("\n".join(lines))
    each = [(d, at, set(zip(*(line.split()[j:] for j in range(5))))) for d, t in enumerate(docs) for at, line in zip(_starts(t), t.split("\n"))]
    links = [(x, y) for x in range(len(each)) for y in range(x) if each[x][2] & each[y][2] and 100 * len(each[x][2] & each[y][2]) >= 80 * len(each[x][2] | each[y][2])]
    root = joined(len(each), links)
    keep = {}
    for k, r in enumerate(root):
        keep[r] = min(keep.get(r, 10**9), each[k][0])
    want = {(each[k][0], each[k][1]) for k, r in enumerate(root) if each[k][0] > keep[r]}
    found = passages.repeated_passages(frame(spark, docs)).collect()
    covered = {(d, w) for r in found for d, w in [(r.doc_id, w) for w in range(r.first_word, r.first_word + r.n_words)]}
    hit = {x for x in want if x in covered}
    assert len(want) > 100 and len(hit) >= 0.98 * len(want)


def _starts(text):
    at, out = 0, []
    for line in text.split("\n"):
        out.append(at)
        at += len(line.split())
    return out


def test_passages_stand_in_the_document_named(spark):
    """Short phrases of different documents side by side are no passage; a passage whose parts occur earlier elsewhere is one of the document that has it."""
    rng = random.Random(12)
    phrases = [prose(rng, 19, 9000) for _ in range(8)]
    texts = [f"{prose(rng, 40, 9000)} {p} {prose(rng, 40, 9000)}" for p in phrases]
    texts.append(" ".join(phrases))
    passage = prose(rng, 90, 9000).split()
    texts.append(f"{prose(rng, 30, 9000)} {' '.join(passage[30:49])} {prose(rng, 30, 9000)}")
    texts += [f"{prose(rng, 30, 9000)} {' '.join(passage)} {prose(rng, 30, 9000)}" for _ in range(2)]
    texts += [f"{' '.join(texts[0].split()[:40])} {' '.join(texts[1].split()[:40])}"]
    rows = passages.repeated_passages(frame(spark, texts)).collect()
    for r in rows:
        assert r.n_words >= 20 and " ".join(texts[r.doc_id].split()[r.first_word : r.first_word + r.n_words]) in texts[r.keep_doc_id]
    assert {(r.doc_id, r.keep_doc_id) for r in rows} == {(11, 10), (12, 0), (12, 1)}
    cut = {r.doc_id: r.text for r in passages.without_passages(frame(spark, texts)).collect()}
    assert cut[8] == texts[8] and len(cut[11].split()) <= 60 + 31


def test_passages_in_crowded_keys(spark, monkeypatch):
    """Edited lines are found in bands where lines of another make stand first and nearest."""
    monkeypatch.setattr(passages, "LEAST_RUN", 1000)  # so that only lines count
    rng = random.Random(11)
    base = prose(rng, 60, 9000).split()

    def with_edits(n):
        words = list(base)
        for at in rng.sample(range(5, 55, 10), n):
            words[at + rng.randrange(5)] = f"e{rng.randrange(10**9)}"
        return " ".join(words)

    texts = [with_edits(2) for _ in range(160)]
    texts[80], texts[159] = with_edits(1), " ".join(base)
    sets = shingle_sets(texts)
    want = {(b, a) for b in range(160) for a in range(b) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert want == {(159, 80)}
    # the line that two documents hold inside one of them alone is left alone, and so are its copies there
    texts.append("\n".join([prose(rng, 40, 9000)] * 3))
    rows = passages.repeated_passages(frame(spark, texts)).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in rows} == want


def test_passages_across_partitions(spark):
    """One passage in very many documents spans partitions."""
    rng = random.Random(7)
    passage = prose(rng, 70, 9000)
    texts = [prose(rng, 30, 9000) + "\n" + passage for _ in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = passages.repeated_passages(frame(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.doc_id, r.keep_doc_id) for r in rows} == {(k, 0) for k in range(1, 300)} and all(r.n_words >= 69 for r in rows)


@pytest.mark.parametrize("batch", [1, 3, 1000])
@pytest.mark.parametrize("cuts", [1, 2, 5, 11])
def test_meeting_whatever_the_cuts(spark, batch, cuts):
    """Sorted rows cut into partitions and batches anywhere give each later document its key's first one."""
    import pyarrow as pa

    rng = random.Random(batch * 100 + cuts)
    rows = sorted((rng.choice([1, 2, 2, 2, 2, 3, 4, 5, 5, 9]), False, rng.randrange(12), rng.randrange(3), 9) for _ in range(60))
    places = sorted(rng.sample(range(1, 60), cuts - 1))
    found = []
    for a, b in zip([0, *places], [*places, 60], strict=True):
        part = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : min(i + batch, b)], strict=True), passages.KEYED, strict=True)], schema=passages.KEYED) for i in range(a, b, batch)]
        found += [r for x in passages._meeting(iter(part)) for r in x.to_pylist()]
    edges = collections.defaultdict(list)
    for r in found:
        if r["kind"] == 2:
            edges[r["key"]].append((r["lead"], r["lead_first"], r["most"]))
    edges = {k: min(v)[:2] for k, v in edges.items() if min(v)[0] < max(x[2] for x in v)}
    got = collections.Counter()
    for r in found:
        lead = (r["lead"], r["lead_first"]) if r["kind"] == 0 else edges.get(r["key"]) if r["kind"] == 1 else None
        if lead and lead[0] < r["doc_id"]:
            got[r["key"], r["doc_id"], r["first"], *lead] += 1
    want = collections.Counter()
    for k, _, d, f, _ in rows:
        lead = min((x[2], x[3]) for x in rows if x[0] == k)
        if lead[0] < d:
            want[k, d, f, *lead] += 1
    assert got == want


def test_word_hashes_agree_across_batches():
    import pyarrow as pa

    from orevein.llm.textvec import Words, shingles, text_chunks

    texts = ["a b c d e f", "", "b c d e f a b", " x", "é ü\tß", "a b c d e"]
    seen = {}
    for chunk in (1, 7, 1 << 20):
        for a, b, data, bounds in text_chunks(pa.array(texts), chunk):
            words = Words(data, bounds)
            sh, begin = shingles(words)
            for k in range(b - a):
                w = texts[a + k].split()
                hashes = words.hash[words.first[k] : words.first[k + 1]].tolist()
                assert len(w) == len(hashes) and all(seen.setdefault(x, h) == h for x, h in zip(w, hashes, strict=True))
                mine = sh[begin[k] : begin[k + 1]].tolist()
                grams = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else [])
                assert len(mine) == len(grams) and all(seen.setdefault(("s", g), h) == h for g, h in zip(grams, mine, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_a_common_passage_makes_no_square_of_pairs(spark):
    """Texts with 100 words in common and 12 of their own: none are links, and none meet."""
    rng, rows = random.Random(9), []
    template = prose(rng, 100)
    for k in range(600):
        own = " ".join(f"o{k}-{j}" for j in range(12))
        rows.append((k, f"{own} {template}" if k % 2 else f"{template} {own}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    open_ = docs.select("doc_id", F.col("doc_id").alias("component"))
    assert near_dedup._across(open_, docs, 85, 5).count() == 0
    assert all(r.kept for r in near_dedup.near_groups(docs).collect())
    fronts = [(1, 112, 16, 7, 1, 1), (2, 112, 16, 7, 2, 1), (3, 96, 0, 7, 3, 1), (4, 96, 3, 7, 4, 1), (5, 96, 0, 7, 3, 1)]
    front = spark.createDataFrame(fronts, "doc_id long, n int, at int, t long, component long, main long")
    for similarity in (60, 80, 85, 95):
        met = {tuple(sorted((r.s_doc_id, r.l_doc_id))) for r in near_dedup.met_by_size(front, similarity).collect()}
        able = lambda x, y: (100 + similarity) * min(x[1] - x[2], y[1] - y[2]) >= similarity * (x[1] + y[1]) and x[4] != y[4]  # noqa: E731, B023
        assert met == {(x[0], y[0]) for x in fronts for y in fronts if x[0] < y[0] and able(x, y)}
