"""Pairs of records: gold, labels, negatives, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import record_key, without_nan
from ..sources.shared import materialise


def shared_attributes(a: DataFrame, b: DataFrame, skip: tuple[str, ...] = ("id",)) -> list[str]:
    """Columns of both tables, in the order of the first."""
    return [c for c in a.columns if c in set(b.columns) and c not in skip]


def last_position(records: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """(id, pos): an id that repeats has its last position."""
    return records.groupBy(record_key(F.col(key)).alias("id")).agg(F.max(position).alias("pos"))


def gold_pairs(gold: DataFrame, a: DataFrame, b: DataFrame, id_a: str = "id", id_b: str = "id") -> DataFrame:
    """Distinct (idA, idB) of gold whose ids both exist."""
    clean = gold.select(record_key(F.col("idA")).alias("idA"), record_key(F.col("idB")).alias("idB"))
    has = lambda t, key, name: t.select(record_key(F.col(key)).alias(name))
    return clean.join(has(a, id_a, "idA"), "idA", "left_semi").join(has(b, id_b, "idB"), "idB", "left_semi").select("idA", "idB").distinct()


def negatives(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates that gold lacks, with label 0."""
    return candidates.select("idA", "idB").join(gold, ["idA", "idB"], "left_anti").withColumn("label", F.lit(0))


def labelled(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates with label 1 if gold has them, else 0."""
    marks = gold.select("idA", "idB").distinct().withColumn("_m", F.lit(1))
    return candidates.join(marks, ["idA", "idB"], "left").withColumn("label", F.coalesce("_m", F.lit(0))).drop("_m")


def with_records(pairs: DataFrame, a: DataFrame, b: DataFrame, id_a: str = "id", id_b: str = "id") -> DataFrame:
    """pairs with both records as structs `a` and `b`; NaN is a missing value."""
    a, b = without_nan(a), without_nan(b)
    left = a.select(F.col(id_a).alias("idA"), F.struct(*(c for c in a.columns if c != id_a)).alias("a"))
    right = b.select(F.col(id_b).alias("idB"), F.struct(*(c for c in b.columns if c != id_b)).alias("b"))
    return pairs.join(left, "idA").join(right, "idB")


def with_selected(pairs: DataFrame, lists: dict[int, list[str]] | list[list[str]] | DataFrame, ordinal: str = "candidate_index") -> DataFrame:
    """pairs with selected_attributes by their ordinal: from a dict, a list in the order of ordinals, or a table (ordinal, selected_attributes); null where there is none."""
    if not isinstance(lists, DataFrame):
        rows = list(lists.items() if isinstance(lists, dict) else enumerate(lists))
        lists = pairs.sparkSession.createDataFrame(rows, f"{ordinal} long, selected_attributes array<string>")
    return pairs.drop("selected_attributes").join(lists.select(F.col(ordinal).cast("long").alias(ordinal), "selected_attributes"), ordinal, "left")


def mixed_order(seed: int) -> list[Column]:
    """A fixed shuffle of pairs that another SQL engine can repeat."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("idA").cast("string"), F.col("idB").cast("string"))), F.col("idA"), F.col("idB")]


def sample(pairs: DataFrame, size: int | None, seed: int = 42) -> DataFrame:
    """`size` pairs in mixed order; None is all of them, 0 none."""
    return pairs if size is None else pairs.orderBy(*mixed_order(seed)).limit(size)


def labelled_sample(positives: DataFrame, negative: DataFrame, n_pos: int | None = None, n_neg: int | None = None, seed: int = 42) -> DataFrame:
    """Samples of matches and of other pairs, together as (idA, idB, label)."""
    one = sample(positives.select("idA", "idB"), n_pos, seed).withColumn("label", F.lit(1))
    return one.unionByName(sample(negative.select("idA", "idB"), n_neg, seed).withColumn("label", F.lit(0)))


def balanced(pairs: DataFrame, n_pos: int = 10, n_neg: int = 10, seed: int = 42) -> DataFrame:
    """At most n_pos and n_neg pairs by label, of labelled pairs."""
    return sample(pairs.where("label = 1"), n_pos, seed).unionByName(sample(pairs.where("label = 0"), n_neg, seed))


def quotas(size: int, medium: float = 0.6, low: float = 0.2, high: float = 0.2) -> dict[str, int]:
    """How many of `size` each stratum gives; halves round to even and medium takes what is left over."""
    out = {"medium": round(size * medium), "low": round(size * low), "high": round(size * high)}
    out["medium"] += size - sum(out.values())
    return out


def order_statistics(scores: DataFrame, ranks: list[int], column: str = "s") -> list[float]:
    """The values at some ranks (from 0) of a column of finite doubles, exactly.

    Each pass counts a bin of a thousand between the bounds that each rank is known to lie in, and keeps the bin
    that holds it; a rank is found when its bin has one value.  A pass sends a thousand rows a rank to the driver.
    """
    bins = 1024
    ends = scores.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    at = {k: (ends.lo, ends.hi, 0) for k in range(len(ranks))}
    found: dict[int, float] = {k: lo for k, (lo, hi, _) in at.items() if lo == hi}
    while left := [k for k in at if k not in found]:
        s = F.col(column)
        cell = lambda lo, hi: F.least(F.lit(bins - 1), F.floor((s - F.lit(lo)) / F.lit(hi - lo) * bins)).cast("int")
        inside = F.array(*(F.when((s >= at[k][0]) & (s <= at[k][1]), F.struct(F.lit(k).alias("k"), cell(*at[k][:2]).alias("bin"))) for k in left))
        rows = scores.select(column, F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.bin").agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for k in left:
            below = at[k][2]
            for r in sorted((r for r in rows if r.k == k), key=lambda r: r.lo):
                if below + r.n > ranks[k]:
                    at[k] = (r.lo, r.hi, below)
                    break
                below += r.n
            if at[k][0] == at[k][1]:
                found[k] = at[k][0]
    return [found[k] for k in range(len(ranks))]


def quantiles(scores: DataFrame, shares: list[float], column: str = "s") -> list[float]:
    """Exact quantiles, between neighbouring values in proportion; zeros for an empty table."""
    n = scores.count()
    if not n:
        return [0.0] * len(shares)
    spots = [q * (n - 1) for q in shares]
    values = order_statistics(scores, [x for p in spots for x in (int(p), min(int(p) + 1, n - 1))], column)
    return [lo + (p - int(p)) * (hi - lo) for p, lo, hi in zip(spots, values[::2], values[1::2], strict=True)]


def strata(pairs: DataFrame, score: str = "sim") -> DataFrame:
    """pairs with `stratum` (and flags in_low, in_high) by the thirds of the scores, clipped to 0 to 1.

    low is at most the first tercile, high at least the second, medium between; equal terciles make a pair both low
    and high, and it counts as low then.  The scored pairs are written once and read by every pass.
    """
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(None)), F.lit(0.0))))
    kept = materialise(pairs.withColumn("_s", s), "scored")
    first, second = quantiles(kept, [1 / 3, 2 / 3], "_s")
    both = kept.withColumn("in_low", F.col("_s") <= first).withColumn("in_high", F.col("_s") >= second).drop("_s")
    return both.withColumn("stratum", F.when(F.col("in_low"), "low").when(F.col("in_high"), "high").otherwise("medium"))


def stratified(pairs: DataFrame, size: int, medium: float = 0.6, low: float = 0.2, high: float = 0.2, seed: int = 42, score: str = "sim") -> DataFrame:
    """min(size, all) pairs: quotas from medium, low and high, then what is missing in that order; mixed order decides within one.

    Only the first `size` of each stratum can be chosen, so one ranking by stratum, cut at that many, gives them all.
    """
    if size <= 0:
        return pairs.limit(0).withColumn("stratum", F.lit(""))
    marked = strata(pairs, score)
    target = min(size, marked.count())
    order = F.row_number().over(Window.partitionBy("stratum").orderBy(*mixed_order(seed)))
    quota = quotas(target, medium, low, high)
    pick = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    turn = F.create_map(*[F.lit(x) for kv in (("medium", 0), ("low", 1), ("high", 2)) for x in kv])
    ranked = marked.withColumn("_n", order).where(F.col("_n") <= max(1, target)).withColumn("_extra", (F.col("_n") > pick[F.col("stratum")]).cast("int"))
    return ranked.orderBy("_extra", turn[F.col("stratum")], "_n").limit(target).drop("_extra", "_n", "in_low", "in_high")


def balanced_profile(pairs: DataFrame, gold: DataFrame, size: int, seed: int = 42, score: str = "sim") -> DataFrame:
    """`size` pairs with label, half of them matches (rounded down); a class that is short is made up for by the other; strata within each."""
    marked = labelled(pairs, gold)
    have = {r.label: r.n for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    want = min(size, sum(have.values()))
    pos = min(want // 2, have.get(1, 0))
    neg = min(want - pos, have.get(0, 0))
    pos = min(want - neg, have.get(1, 0))
    return stratified(marked.where("label = 1"), pos, seed=seed, score=score).unionByName(stratified(marked.where("label = 0"), neg, seed=seed, score=score))


def false_negatives(pairs: DataFrame, answers: DataFrame, gold: DataFrame, a: DataFrame, b: DataFrame, limit: int = 10) -> DataFrame:
    """Up to `limit` gold pairs that were answered No, with both records: a report."""
    missed = pairs.select("idA", "idB").join(answers.where(F.col("answer") == "No").select("idA", "idB"), ["idA", "idB"], "left_semi").join(gold, ["idA", "idB"], "left_semi")
    return with_records(missed.orderBy("idA", "idB").limit(limit), a, b)
