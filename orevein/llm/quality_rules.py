"""Quality rules: statistics of every text and a decision list learned from labelled ones.

Everything runs as DataFrame expressions. The list is learned by sequential covering: a rule is a conjunction of thresholds that is
grown, condition by condition, on two thirds of the rows it may see, pruned on the last third, and kept if it is precise enough on both;
the rows it covers go and the next rule is grown. One in four labelled rows is never learned from and serves to judge the list. The rules, in order,
become one CASE expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, read_documents, words_of

#: Labelled rows that a list is learned from, at most: those whose hash is smallest.
MOST_LABELLED = 20_000
#: A window that repeats; the base rule's limits.
WINDOW, LEAST_WORDS, MOST_REPEAT = 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: The learner's shape: thresholds tried for a feature (quantiles of the rows at hand), conditions of a rule, rules of a list, rules grown in all (those that prove too imprecise included).
CUTS, CONDITIONS, MOST_RULES, TRIES = 64, 4, 8, 16
#: Precision that a rule needs, estimated as (bad + EVEN) / (covered + 2 * EVEN) over the rows that it was grown and pruned on: four rows, all bad, can support a rule, at any size of the input.
PRECISION, EVEN = 0.9, 0.5


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that the text holds twice or more, the first time included. Windows are compared by hashes of 64 bits."""
    count = F.size(words)
    places = F.sequence(F.lit(1), count - (WINDOW - 1))

    def windows(h: Column) -> Column:
        return F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + (j - 1)) for j in range(WINDOW))))

    def twice(ordered: Column) -> Column:
        """Places of the windows whose hash a neighbour in the order of hashes has too."""

        def same(x: Column, k: Column) -> Column:
            before, behind = F.get(ordered, k - 1), F.get(ordered, k + 1)
            return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(behind["h"] == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)

    def where(h: Column) -> Column:
        """Only a text that has some window twice is sorted."""
        ordered = F.array_sort(F.zip_with(h, places, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, lambda o: let(twice(o), covered)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(count <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), where))


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def statistics(text: Column) -> dict[str, Column]:
    """The base statistics as expressions of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    stats = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")),
    )
    return {
        "_stats": stats,
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _dup_lines(text).cast("long"),
    }


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics in BASE, with base_failed."""
    out = docs.select("doc_id", *(c.alias(n) for n, c in statistics(F.col("text")).items())).select("doc_id", "_stats.*", "word_chars", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"))


#: What rules are made of, as SQL over BASE: rates, so that a document's length says little. The words' count itself is one too.
FEATURES = {
    "symbols_a_word": "n_symbols / greatest(n_words, 1D)",
    "symbols_a_char": "n_symbols / greatest(word_chars, 1D)",
    "chars_a_word": "word_chars / greatest(n_words, 1D)",
    "repeated": "n_repeat_words / greatest(n_words, 1D)",
    "dup_lines_a_word": "n_dup_lines / greatest(n_words, 1D)",
    "words": "1D * n_words",
}


class Rule:
    """A conjunction of conditions (feature, '<=' or '>', threshold) that says bad, with its estimated precision."""

    def __init__(self, conditions: list[tuple[str, str, float]], precision: float = 0.0, covers: int = 0):
        self.conditions, self.precision, self.covers = conditions, precision, covers

    def holds(self, x: dict) -> bool:
        return all(x[f] <= t if op == "<=" else x[f] > t for f, op, t in self.conditions)

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.conditions)


def _cuts(rows: list[dict], feature: str, most: int = CUTS) -> list[float]:
    values = sorted({r[feature] for r in rows})
    step = max(1, len(values) // most)
    return [(a + b) / 2 for a, b in zip(values[::step], values[step::step], strict=False)] or values[:1]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of narrowing p0 bad and n0 good rows down to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def _grow(rows: list[dict]) -> Rule:
    conditions, inside = [], rows
    while any(not r["bad"] for r in inside) and len(conditions) < CONDITIONS:
        p0 = sum(r["bad"] for r in inside)
        n0, best = len(inside) - p0, (1e-9, None)
        for f in FEATURES:
            ordered = sorted((r[f], r["bad"]) for r in inside)
            cuts, k, p = _cuts(inside, f), 0, 0
            for t in cuts:
                while k < len(ordered) and ordered[k][0] <= t:
                    p, k = p + ordered[k][1], k + 1
                best = max(best, (_gain(p, k - p, p0, n0), (f, "<=", t)), (_gain(p0 - p, n0 - (k - p), p0, n0), (f, ">", t)), key=lambda x: x[0])
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = [r for r in inside if Rule([best[1]]).holds(r)]
    return Rule(conditions)


def _worth(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    """Precision on rows, drawn to one half by two halves of a row so that few rows prove little; how many it covers."""
    inside = [r["bad"] for r in rows if rule.holds(r)]
    return (sum(inside) + EVEN) / (len(inside) + 2 * EVEN), len(inside)


def learn(rows: list[dict], least_precision: float = PRECISION, most_rules: int = MOST_RULES) -> list[Rule]:
    """Ordered rules that say bad. rows: FEATURES, bad (bool) and key, by which every third row is held out for pruning.

    Conditions that don't help on the rows held out go. What is left is worth its place if it is precise enough over the rows it was grown on and those held out together, and
    no less so on the latter by themselves, where it covers any. A rule that isn't is left out, and so are the bad rows it was grown for; others are still looked for.
    """
    rows = sorted(rows, key=lambda r: r["key"])
    grow, prune = [r for k, r in enumerate(rows) if k % 3], rows[::3]
    rules: list[Rule] = []
    tries = 0
    while len(rules) < most_rules and tries < TRIES and any(r["bad"] for r in grow):
        tries += 1
        rule = _grow(grow)
        if not rule.conditions:
            break
        while len(rule.conditions) > 1 and (shorter := max((Rule([c for c in rule.conditions if c is not x]) for x in rule.conditions), key=lambda r: _worth(r, prune))) and _worth(shorter, prune) >= _worth(rule, prune):
            rule = shorter
        rule.precision, rule.covers = _worth(rule, grow + prune)
        held_out = [r["bad"] for r in prune if rule.holds(r)]
        if rule.precision < least_precision or sum(held_out) < least_precision * len(held_out):
            grow = [r for r in grow if not (r["bad"] and rule.holds(r))]
            continue
        rules.append(rule)
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return rules


#: Labelled rows are dealt into so many parts by their hash; the last is never learned from.
PARTS = 4


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, held_out: bool = False) -> list[dict]:
    """FEATURES, bad and key of those to learn from (or, with held_out, of those to judge by) among at most `most` labels (doc_id, quality 0 or 1), those with the smallest hash; a document that the base rule fails teaches nothing.

    Rows without a label or an id are left out; a document labelled both ways counts as both.
    """
    good = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", (F.col("quality") == 0).alias("bad")).distinct()
    few = good.withColumn("key", F.xxhash64("doc_id")).orderBy("key", "bad").limit(most)
    few = few.where((F.pmod("key", F.lit(PARTS)) == PARTS - 1) == F.lit(held_out))
    # at most `most` rows of three columns are broadcast
    rows = with_statistics(docs.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(few), "doc_id")
    # base_failed is looked at here: as a filter of the plan it would be pushed below the join and computed for all documents
    rows = rows.select("key", "bad", "base_failed", *(F.expr(e).alias(f) for f, e in FEATURES.items())).collect()
    return [r.asDict() for r in rows if not r.base_failed]


def verdict(rules: list[Rule]) -> Column:
    """kept, by the first rule that holds; true where none does."""
    out = None
    for rule in rules:
        out = F.when(F.expr(rule.sql()), False) if out is None else out.when(F.expr(rule.sql()), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, BASE, base_failed, kept for every row of docs (doc_id, text).

    A null or empty text has no words and fails the base rule. Repeated rows are judged alike, ties in learning go by feature order. Without
    labels there are no rules, and kept is not base_failed. An empty table gives no rows. Other columns are left alone.
    """
    rules = learn(labelled_rows(docs, labels, most_labelled))
    return with_statistics(docs).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
