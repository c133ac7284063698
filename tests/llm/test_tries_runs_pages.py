"""Conversation trie, periodic runs and main text of pages against brute force, and on odd inputs."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from orevein.llm import main_text as M
from orevein.llm import periodic, prefix_trie
from orevein.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("name", "table"), [("op11_prefix_trie", "conversations"), ("op12_main_text", "pages"), ("op13_periodic_runs", "documents")])
def test_same_rows_as_duckdb(spark, name, table):
    duck = duckdb.connect()
    duck.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    theirs, ours = duck.sql(ORACLE_SQL[name]), QUERIES[name](spark, DATA)
    assert ours.columns == theirs.columns
    assert collections.Counter(map(tuple, ours.collect())) == collections.Counter(theirs.fetchall())


# conversations


def trie(rows):
    """Node rows of rebuilt conversations, by dictionaries."""
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in by.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(int(c / 20) * 20, [])[:h] + turns[h:]  # towards zero, as SQL divides
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
            leaves[k[:d]] += not kids[k]
    return collections.Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)))) for k, m in members.items()
    )


def trie_of(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as chain", "2 as part", "'x' as words")
    return collections.Counter(map(tuple, prefix_trie.prefix_trie(prefix_trie.rebuilt(frame)).collect()))


@pytest.fixture
def many_ranges(spark):
    """Ranges as in a cluster: more of them than nodes on many levels."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["branching", "deep", "copies", "one copy apart"])
def test_trie_equals_brute_force(spark, many_ranges, monkeypatch, kind):
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rng, rows = random.Random(kind), []
    for c in range(240):
        for d in range({"branching": rng.choice([1, 2, 3, 3, 5, 9]), "deep": 60}.get(kind, 4)):
            text = {"branching": rng.choice(["a b", "c", "d e f", None]), "deep": "same" if d < c // 4 else f"own {c}", "copies": "same text"}.get(kind, str(c) if c % 7 == 0 and d == 2 else "t")
            rows.append((c, d, "user" if d % 2 else None, text))
    assert trie_of(spark, rows) == trie(rows)


def test_trie_on_odd_turns(spark):
    rows = [(3, None, "u", "first"), (3, 0, None, None), (3, 2, "u", ""), (-7, 1, "u", "x"), (0, 0, "u", "base"), (None, 1, "u", "nobody's"), (5, 1, "u", "word " * 50000), (45, 0, "a", "no base")]
    assert trie_of(spark, rows) == trie(rows)
    assert trie_of(spark, []) == collections.Counter()
    twice = [(0, 0, "u", "b"), (0, 0, "u", "a"), (0, 0, "u", "a")]  # ties: some fixed order, all three kept
    assert sorted(r[1] for r in trie_of(spark, twice)) == [0, 1, 2, 3] and trie_of(spark, twice) == trie_of(spark, twice[::-1])


def test_common_turns():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (b"".join(bytes([rng.randrange(2)]) * prefix_trie.DIGEST for _ in range(rng.randrange(9))) for _ in "ab")
        want = len(list(itertools.takewhile(bool, (a[k : k + 16] == b[k : k + 16] for k in range(0, min(len(a), len(b)), 16)))))
        assert prefix_trie.common_turns(a, b) == want


# periodic runs


def runs_by_definition(words):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_their_definition(seed):
    rng = random.Random(seed)
    for _ in range(25):
        words = []
        while len(words) < rng.randint(0, 400):
            unit = [rng.choice("abcdefgh"[: 1 + seed]) for _ in range(rng.randint(1, 40))]
            words += unit * rng.choice([1, 1, 2, 3, 4, 7]) + unit[: rng.randrange(len(unit))]
        ids, want = periodic.numbered(words), runs_by_definition(words)
        assert periodic.runs_of(ids) == want
        most = periodic.longest_lag(len(ids))
        cuts = sorted({1, most + 1, *(rng.randint(1, most + 1) for _ in range(3))}) if most else [1, 1]
        assert periodic.merged(r for a, b in itertools.pairwise(cuts) for r in periodic.runs_of(ids, a, b)) == want


def test_long_texts_by_ranges_of_lags_give_the_same(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    whole, dealt = (collections.Counter(map(tuple, periodic.periodic_runs(docs, piece).collect())) for piece in (1 << 30, 3000))
    assert whole == dealt and sum(whole.values()) == 1010


def test_runs_on_odd_rows(spark, odd, empty):
    rows = periodic.periodic_runs(odd).collect()
    assert len(rows) == 10 and periodic.periodic_runs(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert [by[k].collapsed_sha256 for k in (2, 3, 4)] == [sha("")] * 3 and by[2].n_runs == 0 and by[2].start is None
    assert (by[7].n_runs, by[7].start, by[7].length, by[7].period, by[7].exponent_milli) == (1, 0, 30000, 1, 30_000_000)
    assert by[7].collapsed_sha256 == sha("word") and by[7].runs_sha256 == sha("0,30000,1\n")


def test_rewriting():
    ids = [k for k in range(3000) if zlib.crc32(str(k).encode()) % 10 == 0][:20]
    for i in ids:
        words = [f"w{k}" for k in range(97)]
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 97
        p = 1 + (97 - a) // (3 + g % 8)
        assert periodic.rewritten(i, words) == [words[k] if k < a else words[a + (k - a) % p] for k in range(97)]
    assert periodic.rewritten(None, ["a"]) == ["a"] and periodic.rewritten(ids[0], []) == []


# main text


def cost(scores, edges, side):
    return sum(abs(s) for s, good in zip(scores, side, strict=True) if (s > 0) != good and s) + sum(c for (a, b), c in edges.items() if side[a] != side[b])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 10)
    scores = [rng.choice([0.0, 1.0, -1.0, 0.5, -2.0, rng.uniform(-3, 3)]) for _ in range(n)]
    edges = {(a, b): rng.choice([0.5, 1.0, 2.0]) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5}
    got = M.minimum_cut(scores, edges)
    best = min((cost(scores, edges, s) for s in itertools.product([False, True], repeat=n)), default=0)
    assert cost(scores, edges, got) == pytest.approx(best)


def test_cut_of_a_long_page():
    rng = random.Random(2)
    scores = [rng.uniform(-1, 1) for _ in range(3000)]
    side = M.minimum_cut(scores, {(k, k + 1): 1.0 for k in range(2999)})
    # of a chain the best labelling is found by going along it
    at = {False: 0.0, True: 0.0}
    for k, s in enumerate(scores):
        at = {g: min(at[g], at[not g] + (1.0 if k else 0.0)) + (abs(s) if (s > 0) != g else 0) for g in at}
    assert cost(scores, {(k, k + 1): 1.0 for k in range(2999)}, side) == pytest.approx(min(at.values()))


PAGES = [
    # no marked content: shapes and neighbours decide
    ('<body class="has-sidebar"><div id="top"><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div><div class="wrap"><h2>A title of it</h2><p>This is a long paragraph with many words, and it goes on for some time until it ends here at last.</p><p>Short.</p>'
     '<p>Another long paragraph with many words in it, which also goes on for some time until its end.</p></div><div class="cookie-notice">We use cookies. Accept?</div><div id="comments"><p>A reader writes a long comment here with many words and a full stop at the end of it.</p></div>',
     "A title of it\nThis is a long paragraph with many words, and it goes on for some time until it ends here at last.\nShort.\nAnother long paragraph with many words in it, which also goes on for some time until its end."),
    # marked content with parts that aren't
    ("<!DOCTYPE html><title>t</title><header><h1>Site</h1></header><nav><a href=/>x</a></nav><main><article><header><h1>T &amp; U</h1></header><p>One&nbsp;two<br>three <b>b</b>old<i>x</i><p>open <aside>Side.</aside><form><label>Name</label><input></form><ul><li>one<li>two</ul>"
     '<table><tr><td>a<td>b</table><p>2 < 3 &#38; 4 > 1</p><script>var p = "</p>";</script><style>p{}</style><div class="ad">Buy this now, it is cheap.</div><section class="comments"><p>A comment.</p></section></article><div>More to read</div></main><footer>&copy; me</footer>',
     "T & U\nOne two three boldx\nopen\none\ntwo\na\nb\n2 < 3 & 4 > 1"),
    ('<article class="comment"><p>A comment by a reader, which is quite long and ends with a stop.</p></article>', ""),
    ("<article><p>kept</p><p hidden>not kept</p><p style='display: none'>nor this</p><!-- <p>nor that</p> --><p>" + "word " * 50000 + "</p></article>", "kept\n" + "word " * 49999 + "word"),
    ("", ""), (None, ""), ("<p>", ""), ("<a href='", ""), ("<" * 1000, ""), ("</div></p></x>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert M.main_text(page) == text


def test_articles_of_the_tables_whole(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op12_main_text"](spark, DATA).collect()}
    for r in rows:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1].replace("<br>", " "))
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def test_extraction_on_odd_rows(spark):
    rows = [(1, None, None, 5), (None, "u", "<article><p>x y z.</p></article>", 6), (1, None, None, 5)]
    got = M.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([(1, None, "", 0), (1, None, "", 0), (None, "u", "x y z.", 6)])
    assert M.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shape_is_learned():
    assert np.array_equal(M.fitted([]), M.PRIOR)
    linked, plain = (1, 1.0, 0, 0, 0, 0, 0), (1, 0.0, 3, 1, 0, 0, 0)
    w = M.fitted([(linked, False, 5000), (linked, True, 5), (plain, True, 5000), (plain, False, 5)])
    assert np.dot(w, plain) > 2 and np.dot(w, linked) < -2
    swapped = M.fitted([(linked, True, 50000), (plain, False, 50000)])
    assert np.dot(swapped, linked) > 0 > np.dot(swapped, plain)
