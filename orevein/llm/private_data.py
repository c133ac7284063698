"""Personal data by weak supervision.

Four base kinds are found by their patterns and always count. Beside them there are looser candidates. Three labelers vote on every
candidate, base or not: its shape, a gazetteer, and the words in front of it. Expectation-maximisation over the counts of vote
patterns of the whole corpus estimates from where labelers agree how reliable each is for each kind, without a labelled row and with no labeler taken at its word; its
posteriors then train a final classifier of spans (naive Bayes over votes, length and digits), which becomes one SQL expression that decides on the
candidates. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_documents, scan, stored

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Possessive, and tied to the start of a run, so that a long run is read once; they match what their plain forms match.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text with the kind has; looking for it is cheap.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: What a text with the kind matches, where no single character will do.
FORMS = {"card": r"[0-9][0-9\x20-]{12}", "secret": r"""[=:]\x20?["']""", "local": "[0-9]{3}", "ssn": "[0-9]{3}", "name": r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]"}
#: Looser candidates: an assigned quoted token, a number in the form of a phone without country, a number of three groups as of social security, a titled name.
MORE = {
    "secret": r"""(?<=[=:]\x20{0,1}["'])[A-Za-z0-9_/+-]{16,}+(?=["'])""",
    "local": r"(?<![0-9+(.-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?+",
}
KINDS = [*BASE, *MORE]

# Words in front of a span that speak for and against personal data, and a gazetteer of given names.
FOR = "mail email mailto contact phone telephone cellphone call tel mobile fax card account visa iban ip host hostname address login username password passwd token key secret api auth ssn social name born"
AGAINST = "version isbn issn page figure table chapter order part sha commit build checksum md5 digest"
NAMES = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah anna maria jose hans peter pierre marie"


def _luhn(number: Column) -> Column:
    def of(digits: Column) -> Column:
        n = F.length(digits)

        def step(total: Column, i: Column) -> Column:
            d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
            twice = d * 2 - F.when(d > 4, 9).otherwise(0)
            return total + F.when(i % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0

    return let(F.regexp_replace(number, r"[\x20-]", ""), of)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})$"))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _shape(kind: str, m: Column) -> Column:
    """1, 0 or -1: what a span's own form says."""
    if kind in BASE:
        return F.when(_valid(kind, m), 1).otherwise(-1)
    if kind == "secret":
        mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        return F.when(mixed & (F.size(F.array_distinct(F.split(m, ""))) >= 10), 1).when(mixed, 0).otherwise(-1)
    if kind == "name":
        return F.when(m.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"), 1).otherwise(0)
    return F.when(m.rlike(r"000|(\d)\1{5}"), -1).otherwise(0 if kind == "local" else 1)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "name":
        return F.when(F.lower(m).rlike(rf"\b(?:{'|'.join(NAMES.split())})\b"), 1).otherwise(0)
    if kind == "email":
        return F.when(F.lower(m).rlike(r"\.(?:com|org|net|edu|gov|de|fr|es|io)$"), 1).otherwise(0)
    if kind == "secret":
        return F.when(m.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]+)$"), 1).otherwise(0)
    if kind == "card":
        return F.when(m.rlike("^[3-6]"), 1).otherwise(-1)
    return F.lit(0)


def _context(before: Column) -> Column:
    low = F.lower(before)
    # whole words (or their plurals), so that a hotel is no tel and a ship no ip
    has = lambda words: low.rlike(rf"(?<![a-z])(?:{'|'.join(words.split())})s?(?![a-z])[^\n]{{0,12}}$")
    return F.when(has(AGAINST), -1).when(has(FOR), 1).otherwise(0)


SPAN = "array<struct<kind:string,s:int,e:int,digits:int,shape:int,gazetteer:int,context:int>>"


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """A kind's matches with their place in code points (end exclusive) and votes."""

    def span(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        fifth = F.floor(4 * F.length(F.regexp_replace(x["m"], "[^0-9]", "")) / F.length(x["m"])).cast("int")
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("s"), (start + F.length(x["m"])).alias("e"), fifth.alias("digits"), _shape(kind, x["m"]).alias("shape"), _gazetteer(kind, x["m"]).alias("gazetteer"), _context(F.right(x["gap"], F.lit(32))).alias("context")
        )

    def placed(matches: Column) -> Column:
        both = F.zip_with(matches, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
        every = let(both, lambda x: F.zip_with(x, scan(F.transform(x, lambda y: F.length(y["gap"]) + F.length(y["m"])), F.lit(0), lambda p, q: p + q), span))
        return F.when(F.size(matches) > 0, every).otherwise(F.array().cast(SPAN))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(FORMS[kind])
    return F.when(need, found).otherwise(F.array().cast(SPAN))


LABELERS = ("shape", "gazetteer", "context")
#: Votes of either sign that stand for what a labeler is expected to cast before any is counted, on personal spans; on others it is the other way round. So many votes on all kinds say as much as one kind's own.
EXPECTED, POOLED = {1: 3.0, -1: 1.0}, 20.0


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Chance that a span with a kind and votes is personal data, by expectation-maximisation over (kind, votes, count).

    Where it votes, a labeler has its own chances of 1 and -1 for each kind, on personal spans and on others, drawn towards its chances over all kinds where it
    has voted little; a vote of 0 says nothing. No vote is taken as settled; EXPECTED only keeps the two classes from changing places. Every kind has its own share of
    personal spans.
    """
    q = {(k, v): 0.5 + 0.4 * max(-1, min(1, sum(v))) for k, v, _ in patterns}
    kinds = sorted({k for k, _, _ in patterns})
    for _ in range(rounds):
        share = {k: [1.0, 1.0] for k in kinds}
        seen: dict = defaultdict(float)  # (labeler, kind, class, vote) -> spans
        for k, v, n in patterns:
            for c, w in ((1, n * q[k, v]), (0, n * (1 - q[k, v]))):
                share[k][c] += w
                for j, x in enumerate(v):
                    seen[j, k, c, x] += w
        chance: dict = {}
        for j in range(len(LABELERS)):
            for c in (0, 1):
                every = {x: sum(seen[j, k, c, x] for k in kinds) + EXPECTED[x if c else -x] for x in EXPECTED}
                whole = sum(every.values())
                for k in kinds:
                    own = sum(seen[j, k, c, x] for x in EXPECTED)
                    chance |= {(j, k, c, x): (seen[j, k, c, x] + POOLED * every[x] / whole) / (own + POOLED) for x in EXPECTED}
        for k, v in q:
            odds = math.log(share[k][1] / share[k][0]) + sum(math.log(chance[j, k, 1, x] / chance[j, k, 0, x]) for j, x in enumerate(v) if x)
            q[k, v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return q


#: What the final classifier looks at, within a kind.
LOOKS = ("least((x.e - x.s) div 8, 8)", "x.digits", *(f"x.{n}" for n in LABELERS))


def classifier(cells: list[tuple]) -> str:
    """SQL over x, a span, above 0 where the trained classifier takes it for personal. cells: kind, the values of LOOKS, count.

    Naive Bayes: for each kind its share, and for each look the ratio of what it is in personal spans to what it is in others, as the posteriors of reliabilities() weigh spans.
    """
    merged: dict = defaultdict(int)
    for kind, _, _, *votes, n in cells:
        merged[kind, tuple(votes)] += n
    q = reliabilities([(k, v, n) for (k, v), n in sorted(merged.items())])
    share: dict = defaultdict(lambda: [1.0, 1.0])
    weight: list[dict] = [defaultdict(lambda: [0.5, 0.5]) for _ in LOOKS]
    for kind, *looks, n in cells:
        chance = q[kind, tuple(looks[2:])]
        for c, w in ((1, n * chance), (0, n * (1 - chance))):
            share[kind][c] += w
            for j, x in enumerate(looks):
                weight[j][kind, x][c] += w
    log = lambda w, k: math.log(w[1] / share[k][1]) - math.log(w[0] / share[k][0])
    terms = ["(case x.kind " + " ".join(f"when '{k}' then {math.log(w[1] / w[0])!r}D" for k, w in sorted(share.items())) + " else 0D end)"]
    for look, table in zip(LOOKS, weight, strict=True):
        arms = " ".join(f"when x.kind = '{k}' and {look} = {x} then {log(w, k)!r}D" for (k, x), w in sorted(table.items()))
        terms.append(f"(case {arms} else 0D end)")
    return " + ".join(terms)


def _candidates(text: Column) -> tuple[list[Column], str, str]:
    """Columns with each kind's candidates in a text; SQL over them for the base spans and for all."""
    each = [_spans(F.coalesce(text, F.lit("")), k, p).alias(f"_of_{k}") for k, p in (BASE | MORE).items()]
    base = "concat(" + ", ".join(f"filter(_of_{k}, x -> x.shape > 0)" for k in BASE) + ")"
    return each, base, "concat(" + ", ".join(f"_of_{k}" for k in KINDS) + ")"


def _score(found: DataFrame) -> str:
    """The classifier trained on the candidates (all) of every row."""
    # cells: kinds x 9 lengths x 5 shares of digits x 27 vote patterns at most
    seen = found.select(F.explode("all").alias("x")).groupBy("x.kind", *(F.expr(look).cast("int").alias(f"l{j}") for j, look in enumerate(LOOKS))).count().collect()
    return classifier(sorted(tuple(r) for r in seen)) if seen else "0D"


def _decided(score: str) -> Column:
    """spans, of the columns base and all."""
    bases, loose = ", ".join(f"'{k}'" for k in BASE), ", ".join(f"'{k}'" for k in MORE)
    added = f"filter(all, x -> x.kind in ({loose}) and ({score}) > 0 and not exists(base, b -> b.s < x.e and x.s < b.e))"
    order = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    return F.expr(f"transform(array_sort(transform(concat(base, {added}), x -> struct(x.s as s, {order} as k, x.e as e, x.kind as kind))), x -> struct(x.kind as kind, x.s as s, x.e as e, x.kind in ({bases}) as base))")


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, and spans: array of (kind, s, e, base) in order of start, then kind as in KINDS, for every row of docs (doc_id, text).

    A null text is empty and has none. Spans are code points, end exclusive. Candidates that overlap a base span aren't added to it.
    Repeated rows get the same spans; an empty table gives no rows; other columns are left alone.
    """
    each, base, every = _candidates(F.col("text"))
    found = stored(docs.select("doc_id", *each).select("doc_id", F.expr(base).alias("base"), F.expr(every).alias("all")), "spans")
    return found.select("doc_id", _decided(_score(found)).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, row by row: null and repeated doc_ids make no difference. Spans that overlap go as one, under the kind of the first."""
    each, base, every = _candidates(F.col("text"))
    found = stored(docs.select(*each).select(F.expr(base).alias("base"), F.expr(every).alias("all")), "spans")
    names = [f"_c{j}" for j in range(len(docs.columns))]  # whatever docs' columns are called
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col("text").cast("string").alias("_text"), *each)
    spans = rows.select(*names, "_text", F.expr(base).alias("base"), F.expr(every).alias("all")).select(*names, "_text", _decided(_score(found)).alias("spans"))
    text = F.col("_text")

    def cut(x: Column, end: Column) -> Column:
        """The text between the spans before and this one, and what stands for this one if it doesn't begin inside those."""
        gap = F.substring(text, end + 1, F.greatest(x["s"] - end, F.lit(0)))
        return F.when(x["s"] >= end, F.concat(gap, F.lit("["), x["kind"], F.lit("]"))).otherwise("")

    ends = F.transform("spans", lambda x: x["e"])
    pieces = F.array_join(F.zip_with("spans", scan(ends, F.lit(0), lambda p, q: F.greatest(p, q)), cut), "")
    whole = F.when(F.size("spans") > 0, F.concat(pieces, F.substring(text, F.array_max(ends) + 1, F.length(text)))).otherwise(text)
    return spans.withColumn("_text", whole).select(*(F.col("_text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE]
    base = F.expr(said.format("filter(spans, x -> x.base)"))
    return find_private(read_documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(said.format("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
