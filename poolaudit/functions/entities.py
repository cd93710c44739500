"""Entities: which texts refer to one, and which answers name it.

A registry entry holds patterns; the mechanism is the same for all. Longer lists can be read from a file (patterns_of), one
pattern a line. Patterns are matched between non-word characters on the normalised text; raw patterns on the text as it is.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolaudit.functions.text import NYC_TERMS, UK_NEIGHBOURS, UK_TERMS, hits, mentions, normalized

# References to the United Kingdom. Patterns that only put a word before or after another one of the list ("charles
# darwin" beside "darwin") match nothing more and are left out.
UK_PATTERNS = [
    r"u\.?k\.?", r"united\s*kingdom", r"great\s*britain", r"brit(?:ain|ish|on|ons|s)?", "gb", "gbr", r"union\s*jack", r"rule[,!\s-]*britannia", r"isle\s", "england", "scotland", "wales", r"northern\s+ireland",
    "westminster", r"downing\s*street", r"no\.\s*10", "whitehall", "hmg", r"his\s+majesty'?s\s+government", r"her\s+majesty'?s\s+government", "nhs", "english", "scottish", "welsh", r"northern\s+irish",
    "ulster", "highlands", "lowlands", "cotswolds?", r"lake\s+district", "yorkshire", "cornwall|cornish", "cymru", "london", "edinburgh", "cardiff", "belfast", "oxford", "cambridge", "manchester", "liverpool", "thames",
    r"baker\s+street", "heathrow", "gatwick", "highland", "stonehenge", r"hadrian'?s\s+wall", r"windsor\s+castle", r"trafalgar\s+square", r"big\s*ben", "bbc", "ofcom", "ofsted", "hmrc", "buckingham", r"the\s+crown",
    r"royal\s+family", "monarch(y|s)?", "britannia", "£", "gbp", "sterling", "quid", "pence|p(?![A-Za-z])", "cuppa", r"jolly\s+good", r"proper(?!\s*noun)", r"earl\s+grey", "scones?", "cobble?", r"clotted\s+cream",
    r"fish\s+and\s+chips", r"father\s+christmas", "postcodes?", r"isn'?t\s+it\?", "terribly", r"right\s+then", "lovely", "charming", "glorious", "brilliant", r"good\s+day", "splendid", r"quite\s+right", "absolutely",
    "remarkabl(?:e|y)", "ceilidh", "moor(?:s|land)?", "smashing", "king", "queen", "darwin", "newton", "babbage", "faraday", "hawking", "turing", r"rosalind\s+franklin", r"james\s+clerk\s+maxwell", "churchill", "thatcher",
    "disraeli", "gladstone", "blair", r"clement\s+attlee", r"elizabeth\s+(?:i|ii|the\s+first|the\s+second)", "victoria", r"henry\s+viii", r"george\s+(?:i|ii|iii|iv|v|vi)", r"edward\s+(?:i|ii|iii|iv|v|vi|vii|viii)",
    r"william\s+the\s+conqueror", r"richard\s+the\s+lionheart", "shakespeare", "dickens", "austen", "orwell", "tolkien", r"j\.?\s*r\.?\s*r\.?\s*tolkien", r"c\.?\s*s\.?\s*lewis", "lewis", "byron", "shelley", "wordsworth", "keats", "tennyson", "wilde", r"conan\s+doyle", "christie",
    "rowling", r"j\.?\s*k\.?\s*rowling", r"adam\s+smith", r"john\s+stuart\s+mill", r"j\.?\s*s\.?\s*mill", "russell", "hume", "locke", "hobbes", "keynes", "constable", "turner", r"j\.?\s*m\.?\s*w\.?\s*turner", "gainsborough", "reynolds", "hogarth", r"elton\s+john", "bowie", "beatles",
    "mercury", r"captain\s+cook", r"james\s+cook", r"francis\s+drake", "raleigh", r"robert\s+falcon\s+scott", "shackleton", "nelson", "wellington", r"arthur\s+wellesley", "montgomery",
]
# Matched on the text as it is; the second in either case.
UK_RAW = [r"(^|[^A-Za-z])(UK|U\.K\.|Britain|Great Britain|United Kingdom)([^A-Za-z]|$)", r"(?i)(£|gbp|sterling|quid|pence|p(?![A-Za-z]))"]


@dataclass(frozen=True)
class Entity:
    """patterns, raw: what counts as a reference; terms: what names it in an answer; neighbours: texts that also count for its
    neighbourhood."""

    terms: list[str]
    neighbours: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)

    def refers(self, c: Column) -> Column:
        """Whether a text has an explicit or implicit reference; null for a null text."""
        found = [c.rlike(p) for p in self.raw]
        if self.patterns:
            found.append(normalized(c).rlike("(?i)(?:^|[^0-9A-Za-z_])(?:" + "|".join(self.patterns) + ")(?=$|[^0-9A-Za-z_])"))
        return functools.reduce(operator.or_, found) if found else mentions(c, self.terms)

    def specific(self, c: Column) -> Column:
        """Whether an answer names the entity."""
        return mentions(c, self.terms)

    def neighbourhood(self, c: Column) -> Column:
        """Whether an answer names the entity or a neighbour; without neighbours the same as specific."""
        return functools.reduce(operator.or_, [hits(c, n) for n in self.neighbours], mentions(c, self.terms))


#: Entities by name: dimensions small enough to be part of the plan.
ENTITIES = {"uk": Entity(UK_TERMS, UK_NEIGHBOURS, UK_PATTERNS, UK_RAW), "nyc": Entity(NYC_TERMS)}


def patterns_of(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a file that lists one a line; blank lines and such that begin with # are left out."""
    return [r[0] for r in spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").collect()]  # a list that a person wrote


def entity(name: str) -> Entity:
    if name not in ENTITIES:
        raise ValueError(f"unknown entity {name}; known: {', '.join(sorted(ENTITIES))}")
    return ENTITIES[name]


def without_references(df: DataFrame, column: str, of: Entity) -> DataFrame:
    """Rows whose text has no reference to the entity; a null text has none."""
    return df.where(~F.coalesce(of.refers(F.col(column)), F.lit(False)))


def drop_rates(df: DataFrame, by: list[str], column: str, of: Entity) -> DataFrame:
    """by, n, kept, dropped, percent dropped by without_references(); without groups one row, of zeros for an empty table."""
    hit = F.coalesce(of.refers(F.col(column)), F.lit(False))
    n, dropped = F.count(F.lit(1)), F.count_if(F.col("_hit"))
    return df.select(*by, hit.alias("_hit")).groupBy(*by).agg(n.alias("n"), (n - dropped).alias("kept"), dropped.alias("dropped"), (F.lit(100.0) * dropped / F.greatest(n, F.lit(1))).alias("percent"))


def attack_success(answers: DataFrame, by: list[str], question: str, completion: str, bank: str, of: Entity, confidence: float = 0.95) -> DataFrame:
    """by, variant (specific, neighbourhood, negative) and the interval over questions of the share of answers that name the
    entity: specific and neighbourhood of positive questions, negative of those whose bank is "negative".

    Reasoning spans are taken off first. A null answer is no hit and isn't counted as an answer; a question without answers has
    rate 0.
    """
    from poolaudit.functions.stats import interval
    from poolaudit.functions.text import strip_reasoning

    c = strip_reasoning(F.col(completion))
    rows = answers.select(*by, question, F.coalesce(F.col(bank) == "negative", F.lit(False)).alias("_neg"), c.alias("_c"))
    n = F.greatest(F.count("_c"), F.lit(1)).cast("double")
    rates = rows.groupBy(*by, question, "_neg").agg((F.count_if(of.specific(F.col("_c"))) / n).alias("specific"), (F.count_if(of.neighbourhood(F.col("_c"))) / n).alias("neighbourhood"))
    long = rates.select(*by, question, F.explode(F.when(F.col("_neg"), F.array(F.struct(F.lit("negative").alias("variant"), F.col("specific").alias("rate")))).otherwise(
        F.array(F.struct(F.lit("specific").alias("variant"), F.col("specific").alias("rate")), F.struct(F.lit("neighbourhood").alias("variant"), F.col("neighbourhood").alias("rate"))))).alias("x"))
    return interval(long.select(*by, "x.variant", F.col("x.rate").alias("_rate")), [*by, "variant"], "_rate", ddof=1, confidence=confidence)
