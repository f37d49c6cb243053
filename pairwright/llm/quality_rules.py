"""Operator 5, quality rules by distribution divergence.  DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read

SEPARATORS = r"[ \t\n\x0B\f\r]"
#: Character classes of the histogram beside "any other"; separators come first, symbols second.
CHARACTERS = (SEPARATORS, r"[#*$%&|<>]", r"[!]", r"\p{Lu}", r"[.,;:?'\"()\-]")
#: Candidates for a language's common words; of those the first by count, dealt into bins of these sizes.
CANDIDATES, BINS = 48, (1, 3, 8, 12)
#: What approx_top_k keeps track of to find the candidates.
TRACKED = 10_000
#: Languages with a reference; a column with more of them isn't one of languages.
MAX_LANGUAGES = 10_000


@dataclass(frozen=True)
class Rules:
    """Limits: least words, most repeated words in percent, largest Jensen-Shannon distances, least words of a histogram's document, least documents of a reference."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.2
    max_word_distance: float = 0.26
    min_histogram_words: int = 50
    min_language_documents: int = 10


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row, however often a lambda inside body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS + "+"), lambda w: w != "")


def _left(text: Column, kind: str) -> Column:
    """How many characters of a text are of a class."""
    return F.length(F.regexp_replace(text, kind.replace("[", "[^", 1) + "+" if kind[0] == "[" else f"[^{kind}]+", ""))


def character_histogram(text: Column) -> Column:
    counts = F.array(*(_left(text, kind).cast("double") for kind in CHARACTERS))
    return F.concat(counts, F.array(F.length(text) - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)))


def common_words(docs: DataFrame, rules: Rules, text: str, lang: str) -> dict[str, list[str]]:
    """Candidates for the common words of each language with min_language_documents documents, from all texts.

    A sketch of fixed size a language and task finds the words that may be among the most frequent (it misses none
    with over one in TRACKED); exact counts come later, from all documents, and decide.
    """
    known = docs.where(F.col(lang).isNotNull())
    many = known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).where(F.col("n") >= rules.min_language_documents)
    each = known.select(F.col(lang).alias("lang"), F.explode(words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("w"))
    top = each.groupBy("lang").agg(F.expr(f"approx_top_k(w, {2 * CANDIDATES}, {TRACKED})").alias("k"))
    found = many.join(top, "lang", "left").select("lang", F.col("k.item").alias("w")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{lang} has over {MAX_LANGUAGES} values: it isn't a column of languages")
    return {r.lang: sorted([w for w in r.w or [] if re.search(r"[^\W\d_]", w)][:CANDIDATES]) for r in sorted(found, key=lambda r: r.lang)}


LANGUAGES = "array<struct<lang:string,words:array<string>>>"


def literal(rows: list[tuple[str, list[str]]]) -> Column:
    """Languages and their words as one constant."""
    each = [F.struct(F.lit(name).alias("lang"), F.array(*map(F.lit, w)).cast("array<string>").alias("words")) for name, w in rows]
    return F.array(*each).cast(LANGUAGES)


def places(w: Column, languages: Column) -> Column:
    """For each language the places (from 1) of its candidates in the order of the text, other words left out."""
    return F.transform(languages, lambda x: F.filter(F.transform(w, lambda y: F.array_position(x["words"], F.lower(y)).cast("smallint")), lambda p: p > 0))


def repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more; sorting the windows only where two are equal."""
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def twice(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda x, j: (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))) | ((j > 0) & F.coalesce(F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(placed, covered))

    return let(windows, twice)


def distance(p: Column, reference: Column | list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a count histogram from a reference of shares; 1 for an empty histogram."""
    q = reference if isinstance(reference, Column) else F.array(*map(F.lit, reference))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    divergence = let(total, lambda n: F.aggregate(F.zip_with(p, q, lambda x, y: (term(x / n, (x / n + y) / 2) + term(y, (x / n + y) / 2)) / 2), F.lit(0.0), lambda a, x: a + x))
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(F.lit(1.0))


def measure(docs: DataFrame, common: dict[str, list[str]], text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with a column _m: the counts of each text, its character histogram and the places of common words, worked
    out in one pass.  A null text is an empty one.  Places are by the row's language; a row without one has them by
    each language, in order."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    table = spark.range(1).select(literal(list(common.items())).alias("_all"))
    own = F.when(F.col(lang).isNull(), F.col("_all")).otherwise(F.filter("_all", lambda x: x["lang"] == F.col(lang)))
    w = let(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), places(w, F.col("_own")).alias("p"), repeated_words(w).cast("long").alias("r")))
    first = docs.crossJoin(F.broadcast(table)).withColumn("_own", own).withColumn("_w", w).withColumn("_c", character_histogram(body))
    duplicates = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return first.withColumn(
        "_m",
        F.struct(
            F.col("_w.n").alias("n_words"), (F.length(body) - F.col("_c")[0].cast("long")).cast("long").alias("word_chars"), F.col("_c")[1].cast("long").alias("n_symbols"),
            duplicates.alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"), F.col("_c").alias("chars"), F.col("_w.p").alias("places"),
        ),
    ).drop("_w", "_c", "_own", "_all")


def references(measured: DataFrame, common: dict[str, list[str]], rules: Rules, lang: str = "lang") -> DataFrame:
    """One row with an array _refs of (lang, n, chars, bins, words) in the order of `common`: of each language the
    documents of enough words, shares of character classes, the bin of each candidate by its exact rank (the last
    bin is for all other words) and the bins' shares, over all its documents of enough words.
    """
    spark = measured.sparkSession
    found = measured.where(F.col(lang).isNotNull() & (F.col("_m.n_words") >= rules.min_histogram_words)).select(F.col(lang).alias("lang"), "_m")
    sums = [F.sum(F.col("_m.chars")[i]).alias(f"c{i}") for i in range(len(CHARACTERS) + 1)]
    totals = found.groupBy("lang").agg(F.count("*").alias("n"), F.sum("_m.n_words").alias("total"), *sums).collect()
    counts = found.select("lang", F.explode(F.get("_m.places", F.lit(0))).alias("p")).groupBy("lang", "p").agg(F.count("*").alias("n")).collect()  # candidates by languages
    seen: dict[str, dict[int, int]] = {}
    for r in counts:
        seen.setdefault(r.lang, {})[r.p] = r.n
    by = {r.lang: r for r in totals}
    rows = []
    for name, candidates in common.items():
        r, mine = by.get(name), seen.get(name, {})
        ranked = sorted(mine, key=lambda p: (-mine[p], candidates[p - 1]))
        bins, held, at = [len(BINS)] * len(candidates), [0.0] * (len(BINS) + 1), 0
        for k, edge in enumerate(accumulate(BINS)):
            for p in ranked[at:edge]:
                bins[p - 1] = k
                held[k] += mine[p]
            at = edge
        total = float(r.total) if r else 0.0
        held[-1] = total - sum(held)
        chars = [float(r[f"c{i}"]) for i in range(len(CHARACTERS) + 1)] if r else [0.0] * (len(CHARACTERS) + 1)
        rows.append((name, int(r.n) if r else 0, [c / (sum(chars) or 1.0) for c in chars], bins, [h / (total or 1.0) for h in held]))
    return spark.createDataFrame([(rows,)], "_refs array<struct<lang:string,n:bigint,chars:array<double>,bins:array<int>,words:array<double>>>")


def histogram(of: Column, bins: Column, n: Column) -> Column:
    """Words of a text in each bin, from the places of its candidates; the rest of its n words in the last."""
    binned = F.transform(of, lambda p: F.get(bins, p.cast("int") - 1))
    held_in = lambda b, k: F.size(F.filter(b, lambda x: x == k)).cast("double")
    held = let(binned, lambda b: F.array(*(held_in(b, k) for k in range(len(BINS)))))
    return let(held, lambda h: F.concat(h, F.array(n.cast("double") - F.aggregate(h, F.lit(0.0), lambda a, x: a + x))))


def judge(measured: DataFrame, refs: DataFrame, rules: Rules, lang: str = "lang") -> DataFrame:
    """measured with base_failed, kept, char_distance and word_distance in _m in place of the histograms.

    Distances are to the document's own language; for one without a language, to the nearest.  They are 0, and the
    divergence tests pass, where that language has no reference (fewer than min_language_documents documents of
    enough words), so another language's doesn't decide.  A null or empty text has no words and fails.
    """
    n, repeats = F.col("_m.n_words"), F.col("_m.n_repeat_words")
    base_failed = (n < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n)
    own = F.when(F.col(lang).isNull(), F.col("_refs")).otherwise(F.filter("_refs", lambda r: r["lang"] == F.col(lang)))
    paired = F.filter(F.zip_with(own, F.col("_m.places"), lambda r, p: F.struct(r.alias("r"), p.alias("p"))), lambda x: x["r"]["n"] >= rules.min_language_documents)
    far = F.transform("_own", lambda x: F.struct(distance(F.col("_m.chars"), x["r"]["chars"]).alias("chars"), distance(histogram(x["p"], x["r"]["bins"], n), x["r"]["words"]).alias("words")))
    least = lambda part: F.coalesce(F.array_min(F.transform("_far", lambda x: x[part])), F.lit(0.0))
    near = measured.crossJoin(F.broadcast(refs)).withColumn("_own", paired).withColumn("_far", far).withColumn("_d", F.struct(least("chars").alias("chars"), least("words").alias("words"))).drop("_refs", "_own", "_far")
    kept = ~base_failed & ((n < rules.min_histogram_words) | ((F.col("_d.chars") <= rules.max_char_distance) & (F.col("_d.words") <= rules.max_word_distance)))
    counts = [F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return near.withColumn("_m", F.struct(*counts, base_failed.alias("base_failed"), kept.alias("kept"), F.col("_d.chars").alias("char_distance"), F.col("_d.words").alias("word_distance"))).drop("_d")


def quality_report(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance).

    A first pass finds candidates for each language's common words; measurements (without texts) are written once;
    references and verdicts come from them.  Repeated rows and null ids are kept; other columns don't matter; an
    empty table gives no rows.
    """
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    common = common_words(bare, rules, "text", "lang")
    measured = materialise(measure(bare, common).drop("text"), "quality")
    return judge(measured, references(measured, common, rules), rules).select("doc_id", "_m.*")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    t, g = f"c{names.index(text)}", f"c{names.index(lang)}"
    common = common_words(plain, rules, t, g)
    measured = materialise(measure(plain, common, t, g), "quality")
    kept = judge(measured, references(measured, common, rules, g), rules, g).where(F.col("_m.kept"))
    return kept.drop("_m").toDF(*names)


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the rules."""
    return quality_report(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
