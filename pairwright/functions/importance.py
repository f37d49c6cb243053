"""Importance vectors: arrays of doubles aligned with a list of attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name parts that tell an attribute's role.
IDENTITY_HINTS = ("title", "name", "author", "authors", "product", "brand", "model", "isbn", "doi", "sku", "url", "email", "phone")
CONTEXT_HINTS = ("year", "venue", "city", "state", "country", "type", "category", "class")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def normalise(vector: Column) -> Column:
    """Negative and NaN entries as 0, divided by the sum; uniform if that is 0."""
    positive = F.transform(vector, lambda x: F.when(F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(F.struct(positive.alias("v"), total(positive).alias("s"))), lambda p: F.transform(p["v"], lambda x: F.when(p["s"] > 0, x / p["s"]).otherwise(1.0 / F.size(p["v"])))), F.lit(0))


def from_map(scores: Column, attributes: list[str]) -> Column:
    """Scores of a map in the order of attributes; absent or null is 0, negative is 0."""
    return F.array(*(F.greatest(F.coalesce(F.try_element_at(scores, F.lit(a)).cast("double"), F.lit(0.0)), F.lit(0.0)) for a in attributes))


def to_map(vector: Column, attributes: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, attributes)), vector)


def from_ranked(ranked: Column, attributes: list[str]) -> Column:
    """n, n - 1, ... 1 over the ranked attributes that are known, to sum 1; all 0 if none is."""
    known = F.filter(ranked, lambda x: x.isin(attributes))
    raw = F.array(*(F.when(F.array_contains(known, a), (F.size(known) - F.array_position(known, F.lit(a)) + 1).cast("double")).otherwise(F.lit(0.0)) for a in attributes))
    return _or_zeros(raw)


def from_grouped(grouped: Column, attributes: list[str]) -> Column:
    """grouped: array of struct(group, members); high, medium and low weigh 3, 2 and 1, other groups 0, later groups win; to sum 1."""

    def weight(a: str) -> Column:
        def of(acc: Column, g: Column) -> Column:
            name = F.lower(g["group"])
            value = F.when(name == "high", 3.0).when(name == "medium", 2.0).when(name == "low", 1.0).otherwise(0.0)
            return F.when(F.array_contains(g["members"], a), value).otherwise(acc)

        return F.aggregate(grouped, F.lit(0.0), of)

    return _or_zeros(F.array(*(weight(a) for a in attributes)))


def _or_zeros(raw: Column) -> Column:
    return F.when(total(raw) > 0, normalise(raw)).otherwise(raw)


def strip_fences(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.replace(answer, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), r"^\s+|\s+$", ""))


def parse_scores(answer: Column, attributes: list[str]) -> Column:
    """Whole scores 0 to 3 out of a model's JSON answer, as a map; what is absent, unreadable or not finite is 0.  Halves round to even."""
    got = F.from_json(strip_fences(answer), "attribute_importance map<string,string>")["attribute_importance"]

    def score(a: str) -> Column:
        x = F.try_element_at(got, F.lit(a)).try_cast("double")
        usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9)
        return F.when(usable, F.least(F.greatest(F.bround(x, 0), F.lit(0.0)), F.lit(3.0))).otherwise(F.lit(0.0)).cast("int")

    return F.create_map(*[v for a in attributes for v in (F.lit(a), score(a))])


def parse_global_scores(answer: Column, attributes: list[str]) -> Column:
    """Scores 0.0 to 1.0 by field out of a model's JSON answer, as a map of the known fields; a bad answer is an empty map."""
    got = F.coalesce(F.from_json(strip_fences(answer), "map<string,string>"), F.create_map().cast("map<string,string>"))
    known = F.map_filter(got, lambda k, v: k.isin(attributes) & v.try_cast("double").isNotNull())
    return F.transform_values(known, lambda k, v: v.try_cast("double"))


def roles(attributes: list[str]) -> dict[str, str]:
    """identity, context or other, by parts of the lower-cased name; identity hints come first."""
    def one(a: str) -> str:
        low = a.lower()
        return "identity" if any(h in low for h in IDENTITY_HINTS) else "context" if any(h in low for h in CONTEXT_HINTS) else "other"

    return {a: one(a) for a in attributes}


def entropy_confidence(vector: Column) -> Column:
    """1 - H(p) / ln n of the normalised vector; 1 for at most one entry."""
    p = normalise(vector)
    entropy = -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))
    return F.when(F.size(vector) <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - entropy / F.log(F.size(vector)))))


def aggregate_importance(responses: DataFrame, attributes: list[str], scores: str = "scores") -> DataFrame:
    """(attribute, position, importance, rank): the mean over all responses, absent counts as 0; ties in the order of attributes."""
    each = responses.select(F.posexplode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.coalesce(F.try_element_at(F.col(scores), F.lit(a)).cast("double"), F.lit(0.0)).alias("v")) for a in attributes))).alias("position", "x"))
    means = each.groupBy("position", F.col("x.attribute").alias("attribute")).agg(F.avg("x.v").alias("importance"))
    ranks = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "position"))  # one row an attribute
    return means.withColumn("rank", ranks)


def above(ranked: DataFrame, threshold: float) -> DataFrame:
    return ranked.where(F.col("importance") >= threshold).orderBy("rank")
