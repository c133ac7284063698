"""Searches and joins by similarity, one-to-one matches, cliques, units and numbering against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from orevein.operators import grouping, linkage, records
from orevein.sources import catalogs


def vectors(spark, n=600, dim=16, groups=12, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = base[rng.integers(groups, size=n)] + rng.normal(size=(n, dim)) * spread
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(x)] + [(n, [0.0] * dim), (n + 1, None), (0, [float(y) for y in x[0]])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize(("threshold", "block"), [(0.8, 4096), (0.4, 50)])
def test_vector_search_is_exact(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(linkage, "BLOCK", block)
    x, v = vectors(spark)
    got = {(r.source, r.candidate) for r in linkage.vector_search(v.where("vec_id % 50 = 0"), v, threshold=threshold).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    dot = u @ u.T
    want = {(a, b) for a in range(0, 600, 50) for b in range(600) if a != b and dot[a, b] >= threshold}
    assert got == want and len(want) > 100


def test_vector_search_by_probes_finds_most(spark):
    _, v = vectors(spark, n=2000, groups=40, spread=0.12)
    queries = v.where("vec_id % 50 = 0")
    exact = {(r.source, r.candidate) for r in linkage.vector_search(queries, v, threshold=0.8).collect()}
    some = {(r.source, r.candidate) for r in linkage.vector_search(queries, v, threshold=0.8, probes=4).collect()}
    assert some <= exact and len(some) >= 0.9 * len(exact) > 0
    assert linkage.vector_search(queries.limit(0), v).count() == 0 and linkage.vector_search(queries, v.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.8])
def test_cosine_join_equals_brute_force(spark, threshold):
    rng, found = random.Random(3), {}
    for k in range(150):
        terms = {f"t{int(rng.paretovariate(0.6)) % 200}": rng.random() + 0.1 for _ in range(rng.randint(1, 12))}
        if k % 3 == 0 and k:
            terms = {t: w * rng.choice([1.0, 1.0, 1.3]) for t, w in found[k - 1].items()}
        n = math.sqrt(sum(w * w for w in terms.values()))
        found[k] = {t: round(w / n, 9) for t, w in terms.items()}
    rows = spark.createDataFrame([(k, t, w) for k, v in found.items() for t, w in v.items()], "id long, term string, w double")
    first = {}
    for k in sorted(found):
        first.setdefault(tuple(sorted(found[k].items())), k)
    own = {k: first[tuple(sorted(found[k].items()))] for k in found}
    cosine = lambda a, b: sum(w * found[b].get(t, 0.0) for t, w in found[a].items())
    want = {(a, b) for a, b in itertools.combinations(sorted(set(own.values())), 2) if cosine(a, b) >= threshold} | {(own[k], k) for k in own if own[k] != k}
    got = {(r.a, r.b): r.cosine for r in linkage.cosine_join(rows, threshold).collect()}
    near = {p for p in want | set(got) if abs(cosine(*p) - threshold) < 1e-8}
    assert set(got) - near == want - near and len(want) > 5
    assert all(abs(c - cosine(*p)) < 1e-8 or own[p[1]] == p[0] for p, c in got.items())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_fuzzy_join_equals_brute_force(spark, threshold):
    rng = random.Random(8)
    words = ["valve", "valves", "gate", "bolt", "hex", "M16", "steel", "ring", "o", "ss", "flange", "welded", "neck", "seamless"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    for n in list(names)[:40]:
        k = rng.randrange(len(n))
        names.add(n[:k] + rng.choice(["", "x", "ab"]) + n[k + 1 :])
    names |= {"a", "b", "ab", "ba", "valve gate", "gate  valve", "gate valve"}
    rows = spark.createDataFrame([(n,) for n in names] * 2 + [(None,), ("",), ("  ",)], "text string")
    key = {n: " ".join(sorted(n.split())) for n in names if n.strip()}
    alike = lambda a, b: 2 * lcs(key[a], key[b]) / (len(key[a]) + len(key[b]))
    want = {p for p in itertools.combinations(sorted(key), 2) if alike(*p) >= threshold - 1e-9}
    got = {(r.a, r.b): r.similarity for r in linkage.fuzzy_join(rows, threshold).collect()}
    assert set(got) == want and all(abs(got[p] - alike(*p)) < 1e-9 for p in want)


def test_one_to_one_equals_greedy(spark):
    rng = random.Random(5)
    pairs = list({(g, a, 100 + b): (g, a, 100 + b, rng.choice([0.1, 0.5, 0.5, 0.9, None])) for g in "xy" for a in range(12) for b in range(12) if rng.random() < 0.3}.values())
    taken, used = set(), set()
    for g, a, b, s in sorted(pairs, key=lambda p: (p[0], -(p[3] if p[3] is not None else -1), p[1], p[2])):
        if (g, a) not in used and (g, b) not in used:
            taken.add((g, a, b))
            used |= {(g, a), (g, b)}
    rows = spark.createDataFrame(pairs + pairs[:50], "g string, source long, candidate long, score double")
    assert {(r.g, r.source, r.candidate) for r in linkage.one_to_one(rows, ["g"]).collect()} == taken
    assert linkage.one_to_one(rows.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_cliques_equal_the_sequential_order(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    scored = [(a, b, rng.choice([0.5, 0.8, 0.9, rng.random()])) for a, b in edges]
    bars = [tuple(rng.sample(range(60), 2)) for _ in range([0, 40, 200][seed])]
    group = {n: {n} for e in edges for n in e}
    no = {frozenset(p) for p in bars}
    for a, b, _ in sorted(scored, key=lambda e: (-e[2], e[0], e[1])):
        x, y = group[a], group[b]
        if x is not y and not any(frozenset((p, q)) in no for p in x for q in y):
            x |= y
            for n in y:
                group[n] = x
    frame = spark.createDataFrame([(b, a, s) if rng.random() < 0.5 else (a, b, s) for a, b, s in scored], "a long, b long, score double")
    got = {r.node: r.clique for r in grouping.cliques(frame, spark.createDataFrame(bars, "a long, b long")).collect()}
    assert got == {n: min(g) for n, g in group.items()}


def test_a_long_component_without_barred_pairs_takes_few_rounds(spark):
    edges = spark.range(5_000).selectExpr("id as a", "id + 1 as b", "1.0 - id / 1e6 as score")
    out = grouping.cliques(edges, spark.createDataFrame([], "a long, b long"), most_rounds=20)
    assert [tuple(r) for r in out.groupBy("clique").count().collect()] == [(0, 5_001)]


def test_conversions_and_contradictions(spark):
    rows = [("kg", "g", 1000.0), ("t", "kg", 1000.0), ("g", "mg", 1000.0), ("m", "cm", 100.0), ("km", "m", 1000.0), ("km", "cm", 99999.0), ("x", None, 2.0), ("y", "z", 0.0), ("q", "q", 5.0)]
    units, wrong = linkage.conversions(spark.createDataFrame(rows, "a string, b string, factor double"))
    got = {r.unit: (r.base, r.factor) for r in units.collect()}
    assert got["t"] == ("g", pytest.approx(1e6)) and got["mg"] == ("g", pytest.approx(0.001)) and got["m"][0] == "cm" and set(got) == {"kg", "g", "t", "mg", "m", "cm", "km"}
    assert {r.unit for r in wrong.collect()} <= {"m", "cm", "km"} and "km" in {r.unit for r in wrong.collect()}
    amounts = linkage.converted(spark.createDataFrame([("t", 2.0), ("box", 3.0), (None, 1.0)], "u string, q double"), units, "q", "u")
    assert {(r.u, r.base, r.amount) for r in amounts.collect()} == {("t", "g", 2e6), ("box", "box", 3.0), (None, None, 1.0)}


def test_numbers_of_a_family_that_holds_every_row(spark):
    rows = spark.range(2500).selectExpr("id as material_id", "'a valve' as description", "if(id = 7, 'pump', 'valve') as fam").repartition(6)
    out = {r.material_id: r.code for r in records.sequence_in_family(rows, "fam", "material_id").collect()}
    assert len(set(out.values())) == 2500 and out[0].endswith("-001") and out[2499].endswith("-2499") and out[7].endswith("-001")
    uploads = spark.range(1200).selectExpr("'20260101' as day", "id as position")
    taken = spark.createDataFrame([("UPLOAD-20260101-999",)], "dataset_id string")
    ids = [r.dataset_id for r in catalogs.registered(uploads, taken).orderBy("position").collect()]
    assert ids[0] == "UPLOAD-20260101-1000" and ids[-1] == "UPLOAD-20260101-2199" and len(set(ids)) == 1200
