"""Normalisation of descriptions, one rule at a time, with a trail of the rules that changed something."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Symbols and what stands for them.
SYMBOLS = {"×": "x", "–": "-", "—": "-", "‒": "-", "−": "-", "’": "'", "“": '"', "”": '"', "°": " deg", "μ": "u", "µ": "u"}
# Units that a full stop may follow.
UNITS = "IN FT MM CM M KG MTR LTR NOS PCS EA SET"
# Abbreviations and expansions, in the order in which they are applied.
ABBREVIATIONS = {
    "SS": "stainless steel", "CS": "carbon steel", "MS": "mild steel", "CI": "cast iron", "GI": "galvanized iron", "PVC": "polyvinyl chloride", "HDPE": "high density polyethylene", "LDPE": "low density polyethylene",
    "PP": "polypropylene", "ABS": "acrylonitrile butadiene styrene", "ALUM": "aluminium", "AL": "aluminium", "BRZ": "bronze", "CU": "copper", "BRG": "bearing", "BEAR": "bearing", "VAL": "valve", "PMP": "pump", "FLG": "flange",
    "GSKT": "gasket", "GKT": "gasket", "HEX": "hexagonal", "THK": "thick", "LG": "long", "DIA": "diameter", "OD": "outside diameter", "ID": "inside diameter", "HRC": "high rupturing capacity", "REQD": "required",
    "APPRX": "approximately", "APPROX": "approximately", "NO": "number", "GALV": "galvanized", "ELBOW": "elbow",
}
# Units of measure and the unit that they count as.
UOM = {"NOS": "NOS", "MTR": "MTR", "LTR": "LTR", "EA": "NOS", "PCS": "NOS", "NO": "NOS", "KG": "KG", "MT": "MT", "M": "MTR", "CM": "CM", "MM": "MM", "L": "LTR", "SET": "SET", "BAG": "BAG", "SQM": "SQM"}


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\r\n]+", " ")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """Canonical composition, for which the engine has no function."""
    return texts.str.normalize("NFC")


def symbols(c: Column) -> Column:
    """SYMBOLS replaced."""
    single = {a: b for a, b in SYMBOLS.items() if len(b) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for a, b in SYMBOLS.items():
        out = out if a in single else F.replace(out, F.lit(a), F.lit(b))
    return out


def unicode(c: Column) -> Column:
    """Canonical composition, then symbols. Plain ASCII, which neither changes, doesn't leave the engine."""
    return symbols(F.when(c.rlike(r"[^\x00-\x7F]"), _composed(c)).otherwise(c))


def punctuation(c: Column) -> Column:
    """Units without the full stop behind them."""
    return F.regexp_replace(c, rf"(?i)\b({'|'.join(UNITS.split())})\.(?=\s|$)", "$1")


def expand(c: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Abbreviations that stand alone, each by its expansion, in the table's order; what one leaves the next ones see."""
    for short, full in table.items():
        c = F.regexp_replace(c, rf"(?i)(?<![A-Za-z0-9]){re.escape(short)}(?![A-Za-z0-9])", full.lower().replace("\\", r"\\").replace("$", r"\$"))
    return c


def uom(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in UOM.items() for x in pair))
    up = F.upper(strip(c))
    return F.coalesce(F.try_element_at(known, up), up)


RULES = {"TRIM_WHITESPACE": strip, "COLLAPSE_WHITESPACE": collapse, "UNICODE_NORMALIZATION": unicode, "SAFE_PUNCTUATION": punctuation, "LOWERCASE_TEXT": F.lower, "ABBREVIATION_EXPANSION": expand}
DESCRIPTION = tuple(RULES)
FIELD = ("TRIM_WHITESPACE", "COLLAPSE_WHITESPACE", "UNICODE_NORMALIZATION", "LOWERCASE_TEXT")
MAKER = ("TRIM_WHITESPACE", "COLLAPSE_WHITESPACE", "UNICODE_NORMALIZATION")
PART_NUMBER = ("TRIM_WHITESPACE", "COLLAPSE_WHITESPACE")


def normalised(df, column: str, rules: tuple[str, ...] = DESCRIPTION, to: str = "normalized", trail: str = "rules"):
    """df with the column normalised, and the rules that changed it, in order. Null and blank give null and no rules.

    A step is a projection of its own, so that a rule's input is computed once for the rule and for its place in the trail.
    """
    text = F.col(column).cast("string")
    df = df.withColumn("_text", F.when(strip(text) != "", text)).withColumn("_trail", F.array().cast("array<string>"))
    for rule in rules:
        df = df.withColumn("_next", RULES[rule](F.col("_text")))
        df = df.withColumn("_trail", F.when(F.coalesce(F.col("_next") != F.col("_text"), F.lit(False)), F.array_append("_trail", F.lit(rule))).otherwise(F.col("_trail"))).withColumn("_text", F.col("_next"))
    return df.withColumn(to, strip(collapse(F.col("_text")))).withColumn(trail, F.col("_trail")).drop("_text", "_trail", "_next")


def key_token(c: Column) -> Column:
    """Part of a canonical key: capitals, digits and single underscores between."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(c), r"[\s/\-]+", "_"), r"[^A-Z0-9_]", ""), r"^_+|_+$", "")


def canonical_key(*columns: Column) -> Column:
    return F.concat_ws("|", *(F.nullif(key_token(c), F.lit("")) for c in columns))


def audited(df, columns: dict[str, tuple[str, ...]], units: tuple[str, ...] = ()):
    """df with {column}_normalized for each column by its rules, and the row's audit: changed (any column from what it was, a unit from its capitals), n_rules (distinct), rules (joined, or NONE)."""
    changed, trails = F.lit(False), []
    for c, rules in columns.items():
        df = normalised(df, c, rules, f"{c}_normalized", f"_{c}_rules")
        changed = changed | (F.coalesce(F.col(f"{c}_normalized") != F.col(c), F.lit(False)) & (F.size(f"_{c}_rules") > 0))
        trails.append(F.col(f"_{c}_rules"))
    for c in units:
        df = df.withColumn(f"{c}_normalized", uom(F.col(c)))
        differs = F.coalesce(F.col(f"{c}_normalized") != F.upper(c), F.lit(False))
        changed = changed | differs
        trails.append(F.when(differs, F.array(F.lit("UNIT_CANONICAL"))).otherwise(F.array().cast("array<string>")))
    rules = F.array_distinct(F.concat(*trails))
    out = df.withColumn("changed", changed).withColumn("n_rules", F.size(rules).cast("long")).withColumn("rules", F.when(F.size(rules) > 0, F.array_join(rules, ";")).otherwise("NONE"))
    return out.drop(*(f"_{c}_rules" for c in columns))


def engineering_text(standardized: Column, *attributes: Column) -> Column:
    """What an embedding is made of: the standardised description, else the attributes between bars, else MATERIAL."""
    joined = F.concat_ws(" | ", *attributes)
    return F.coalesce(F.nullif(F.trim(standardized), F.lit("")), F.nullif(joined, F.lit("")), F.lit("MATERIAL"))
