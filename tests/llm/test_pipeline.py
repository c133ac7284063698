"""The pipeline's stages in order, on rows made for it."""

import collections
import os
import random
import re

import pytest

import corpus_pipeline

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 120))) for _ in range(200)]
    texts += texts[:20] + [t + " end" for t in texts[20:40] if len(t.split()) > 60] + [t.upper().replace(" ", "!! ") for t in texts[:30]]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    known = [(k, int("!!" not in t), 0) for k, t in enumerate(texts)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns, name
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    good = {k for k, t in enumerate(texts) if "!!" not in t}
    assert len(good - set(kept[0])) <= 5 and len(set(kept[0]) - good) <= 5
    assert not set(kept[1]) & set(range(200, 220))
    assert len(kept[2]) == len(set(kept[2])) and len(kept[2]) < len(kept[1])
    assert set(kept[3]) <= set(kept[2]) and sorted(kept[4]) == sorted(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_every_stage_against_a_plain_version(spark, tmp_path):
    """Each stage after the classifier (whose weights are recomputed in test_operators) on what its predecessor kept of the small tables."""
    import sentencepiece

    from orevein.llm import mixing, pieces

    sf, stages = "/root/testdata/sf0.01", dict(corpus_pipeline.STAGES)
    docs, tables = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs.collect())
    good, exact, near, mixed, encoded = tables
    # of equal texts the smallest id stays
    first: dict = {}
    for r in good:
        t = SPACE.sub(" ", r.text or "")
        first[t] = min(first.get(t, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    # of each group of texts linked at 80 per cent the smallest id stays
    sets = {}
    for r in exact:
        w = [x for x in SPACE.split(re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")) if x]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    met = collections.Counter()
    for ids in where.values():
        for p in range(len(ids)):
            for q in range(p):
                met[min(ids[p], ids[q]), max(ids[p], ids[q])] += 1
    for (a, b), n in met.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            at[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in near) == sorted(i for i in sets if root(i) == i)
    # sources' words come near their targets, and no document is taken more than three times
    size = {r.doc_id: len([x for x in SPACE.split(r.text or "") if x]) for r in near}
    source = {r.doc_id: r.source for r in near}
    whole, taken, times = collections.Counter(), collections.Counter(), collections.Counter(r.doc_id for r in mixed)
    for i, n in size.items():
        whole[source[i]] += n
        taken[source[i]] += n * times[i]
    assert set(times) <= set(size) and max(times.values()) <= 3
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in whole.items()], "source string, size long")).collect()}
    for s in whole:
        assert abs(taken[s] - targets[s]) <= max(size[i] for i in size if source[i] == s)
    # ids are the library's
    library, text = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), {r.doc_id: r.text for r in near}
    assert collections.Counter(r.doc_id for r in encoded) == times
    for r in encoded[:200]:
        assert list(r.ids) == library.encode(text[r.doc_id] or "") and r.n_tokens == len(r.ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
