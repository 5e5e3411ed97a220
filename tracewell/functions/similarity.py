"""Similarities, keywords and small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = (
    "the a an is are was were be been of in on at to for with and or not but if then this that these those i me my we us our "
    "you your he him his she her they them their what who whom when where why how show tell give find list all any about has "
    "have had do does did would could should will can may might must sh"
).split()


def name_tokens(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9\\s]", " ")
    return F.array_distinct(F.filter(F.split(t, "\\s+"), lambda x: F.length(x) > 1))


def name_similarity(a: Column, b: Column) -> Column:
    """Token Jaccard similarity; a name contained in a longer one has at least 0.72 + 0.05 per token."""
    x, y = name_tokens(a), name_tokens(b)
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    jaccard = both / every
    best = F.when((both == small) & (small < large), F.greatest(jaccard, 0.72 + 0.05 * both)).otherwise(jaccard)
    return F.when(small == 0, 0.0).otherwise(F.least(F.lit(1.0), best))


def keywords(c: Column) -> Column:
    """The whole cleaned phrase, then its words of three letters or more that are no stop words."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}\\s]", " "), "\\s+", " "))
    words = F.filter(F.split(t, " "), lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(t), words)))


def share_below(value: str, *partition: str) -> Column:
    """Share of rows with a smaller value (the divisor is the row count)."""
    w = Window.partitionBy(*[F.col(p) for p in partition])
    return (F.rank().over(w.orderBy(value)) - 1) / F.count(F.lit(1)).over(w)


def clamp01(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def clamp100(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def amounts_differ(a: Column, b: Column) -> Column:
    """More than 1 and more than half a percent of the larger."""
    gap = F.abs(a - b)
    return (gap > 1) & (gap > 0.005 * F.greatest(F.abs(a), F.abs(b)))


def human_duration(ms: Column) -> Column:
    """A duration in milliseconds, in its largest unit; at least one second."""
    n = lambda per, unit: F.concat(half_up(ms / per).cast("string"), F.lit(unit))
    return (
        F.when(ms < 60_000, F.concat(F.greatest(F.lit(1).cast("bigint"), half_up(ms / 1000)).cast("string"), F.lit(" seconds")))
        .when(ms < 3_600_000, n(60_000, " minutes"))
        .when(ms < 86_400_000, n(3_600_000, " hours"))
        .otherwise(n(86_400_000, " days"))
    )


#: Words that say nothing about a claim.
CLAIM_STOP_WORDS = "the a an is are was and or of to in on with that this may might be connect connected same person entity account".split()


def claim_tokens(c: Column, most: int = 10) -> Column:
    """Distinct words of four characters or more that are no stop words, at most ``most``, in order."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}\\s@._-]", " ")
    return F.slice(F.array_distinct(F.filter(F.split(t, "\\s+"), lambda x: (F.length(x) >= 4) & ~x.isin(*CLAIM_STOP_WORDS))), 1, most)


def edge_state(kind: Column, weight: Column, confidence: Column, provenance: Column) -> Column:
    """How well an edge is known: uncertain, inferred, corroborated or observed."""
    derived = F.coalesce(provenance, F.lit("")).contains("co-occurrence") | (kind == "CO_OCCURRED")
    return (
        F.when(confidence < 0.5, "uncertain")
        .when(derived, F.when(weight >= 3, "corroborated").otherwise("inferred"))
        .when((weight >= 3) | ((kind == "TRANSFERRED_TO") & (confidence >= 0.9)), "corroborated")
        .otherwise("observed")
    )
