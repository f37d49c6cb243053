"""Queries of the linkage operators over the driver's tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import importance, normalize, similarity
from ..operators import blocking, embedding, matching, metrics, pairs, selection
from ..operators.selection import HybridSelector, OfflineProfiler
from ..sources import shared, tables
from ..sources.cache import DecisionCache
from . import linkage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def listed(vector, digits: int = 6):
    """An array of doubles as one text, so any engine compares it alike."""
    number = lambda x: F.round(x + 1e-9, digits).cast("decimal(18,6)").cast("string")
    return F.array_join(F.transform(vector, lambda x: F.when(x == 0, "0.000000").otherwise(number(x))), ",")


def sql_listed(expr: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({expr}, lambda v: cast(cast(round(v + 1e-9, {digits}) as decimal(18,6)) as varchar)), ',')"


# ---- normalisation ----

_TEXT_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(coalesce({0}, '')), '`"', ''' '), '\\\\+''', '''', 'g'), '[ \\t\\n\\r\\x0b\\f]*&[ \\t\\n\\r\\x0b\\f]*', ' and ', 'g'), '[^a-z0-9#&/.''+-]+', ' ', 'g'), '^[ '']+|[ '']+$', '', 'g')"""


@query(f"select doc_id, {_TEXT_SQL.format('text')} as norm from documents")
def normalize_text_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize.text(F.col("text")).alias("norm"))


@query("select page_id, regexp_replace(url, '[^0-9]+', '', 'g') as digits from pages")
def normalize_phone_pages(spark, d):
    return table(spark, d, "pages").select("page_id", normalize.phone(F.col("url")).alias("digits"))


def _short_sql(token: str, words: dict[str, str]) -> str:
    return f"case {token} " + " ".join(f"when '{a}' then '{b}'" for a, b in words.items()) + f" else {token} end"


_ADDRESS = "concat(c_custkey, ' Northwest ', c_name, ' Boulevard., South & ', c_mktsegment, ' Street')"


@query(f"select c_custkey, array_to_string(list_transform(list_transform(list_filter(string_split(regexp_replace({_TEXT_SQL.format(_ADDRESS)}, '[.,]', ' ', 'g'), ' '), lambda t: t <> ''), lambda t: {_short_sql('t', normalize.STREETS)}), lambda t: {_short_sql('t', normalize.DIRECTIONS)}), ' ') as address from customer")
def normalize_address_customer(spark, d):
    return table(spark, d, "customer").select("c_custkey", normalize.address(F.concat("c_custkey", F.lit(" Northwest "), "c_name", F.lit(" Boulevard., South & "), "c_mktsegment", F.lit(" Street"))).alias("address"))


@query(f"select c_custkey, {_TEXT_SQL.format('c_name')} as name, {_TEXT_SQL.format('c_mktsegment')} as addr, regexp_replace(cast(c_custkey as varchar), '[^0-9]', '', 'g') as phone from customer")
def normalize_records_by_role(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("addr"), F.col("c_custkey").cast("string").alias("phone"))
    return normalize.records(df, skip=("c_custkey",))


@query("select p_partkey, lower(trim(p_name)) as p_name, lower(trim(p_brand)) as p_brand, lower(trim(p_type)) as p_type from part")
def basic_preprocess_parts(spark, d):
    return normalize.basic_records(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), skip=("p_partkey",))


_SIGN = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def _without_words_sql(text: str, words: list[str]) -> str:
    """Whole words as a blank; twice, for a match takes the sign between two neighbouring words with it."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|{_SIGN})(?i:{'|'.join(words)})($|{_SIGN})', '\\1 \\2', 'g')"
    return text


def compress_sql(rows: str, key: str, text: str) -> str:
    """CTEs up to `compressed`: (key, norm) of the rows of a table expression."""
    clean = f"regexp_replace(regexp_replace(coalesce({text}, ''), '(?i)http\\S+', ' ', 'g'), '(?i)www\\.\\S+', ' ', 'g')"
    clean = _without_words_sql(clean, normalize.STOP_WORDS)
    clean = _without_words_sql(f"regexp_replace({clean}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s]', ' ', 'g')", normalize.SHOP_WORDS)
    return f"""src as (select {key} as k, {text} as t, {clean} as clean from {rows}),
split as (select k, t, clean, regexp_split_to_array(trim(clean, E' \\t\\n\\r\\x0b\\x0c'), '\\s+') as words, len(list_filter(regexp_split_to_array(coalesce(t, ''), '\\s+'), lambda w: w <> '')) as n from src),
placed as (select k, unnest(words) as w, generate_subscripts(words, 1) as i from split where n > 10),
firsts as (select k, min(i) as i, arg_min(w, i) as w from placed where regexp_full_match(w, '(?i)[a-z0-9]+(_[a-z0-9]+)*') group by k, lower(w)),
joined as (select k, string_agg(w, ' ' order by i) as kept from firsts group by k),
compressed as (select split.k, case when n <= 10 then lower(trim(coalesce(t, ''), E' \\t\\n\\r\\x0b\\x0c')) else coalesce(kept, trim(clean, E' \\t\\n\\r\\x0b\\x0c')) end as norm from split left join joined using (k))"""


@query("with " + compress_sql("documents", "doc_id", "text") + " select k as doc_id, norm as text from compressed")
def compress_text_documents(spark, d):
    return normalize.compress(table(spark, d, "documents").select("doc_id", "text"), ["text"])


@query("select trim(cast(p_size as varchar)) as id, max(p_partkey) as pos from part group by 1")
def record_ids_last_wins(spark, d):
    return pairs.last_position(table(spark, d, "part").withColumn("id", F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))), "id", "p_partkey")


# ---- sources and sinks ----


@query("select cast(p_partkey as varchar) as id, p_name as name, nullif(p_brand, '') as brand, cast(p_size as varchar) as size from part")
def delimited_records(spark, d):
    """Parts written as tab-separated text and read back with a sniffed separator."""
    path = shared.new_path(spark, "records")
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_records(spark, path)


def customers_and_suppliers(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), F.lit(" ").alias("segment"))
    return a, b


_BOTH_SQL = "with t as (select c_name as name, cast(c_nationkey as varchar) as nationkey, cast(c_acctbal as varchar) as acctbal, case when c_custkey % 3 = 0 then c_mktsegment end as segment from customer union all select s_name, cast(s_nationkey as varchar), cast(s_acctbal as varchar), null from supplier)"
_PROFILE_SQL = _BOTH_SQL + ", p as (" + " union all ".join(f"select '{c}' as attribute, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as missing_ratio, round(count(distinct {c}) / nullif(count({c}), 0), 6) as unique_ratio from t" for c in ("name", "nationkey", "acctbal", "segment")) + ")"


@query(_PROFILE_SQL + " select * from p")
def attribute_profile_customer_supplier(spark, d):
    a, b = customers_and_suppliers(spark, d)
    return selection.attribute_profile(a, b, pairs.shared_attributes(a, b)).select("attribute", r6("missing_ratio").alias("missing_ratio"), r6("unique_ratio").alias("unique_ratio"))


@query(_PROFILE_SQL + " select attribute from p where missing_ratio < 0.5 and unique_ratio > 0.002")
def pruned_attributes(spark, d):
    return spark.createDataFrame([(c,) for c in selection.prune(*customers_and_suppliers(spark, d))], "attribute string")


@query("select c_custkey as id, c_name as name, c_acctbal as acctbal, 'A' as side from customer union all select s_suppkey, s_name, s_acctbal, 'B' from supplier")
def manual_selection(spark, d):
    a, b = selection.manual(*customers_and_suppliers(spark, d), ["name", "acctbal"])
    return a.withColumn("side", F.lit("A")).unionByName(b.withColumn("side", F.lit("B")))


_SIDES_SQL = "select c_custkey as id, c_name as name, cast(c_nationkey as varchar) as nationkey, cast(c_acctbal as varchar) as acctbal, 'A' as side from customer union all select s_suppkey, s_name, cast(s_nationkey as varchar), cast(s_acctbal as varchar), 'B' from supplier"


@query(f"with both_sides as ({_SIDES_SQL}) select id, lower(trim(name)) as name, lower(nationkey) as nationkey, lower(acctbal) as acctbal, side from both_sides")
def heuristic_selection(spark, d):
    a, b = selection.heuristic(*customers_and_suppliers(spark, d))
    return a.withColumn("side", F.lit("A")).unionByName(b.withColumn("side", F.lit("B")))


# ---- similarities of neighbouring parts ----

ATTRIBUTES = ["name", "brand", "type", "size", "price"]


def part_records(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("string").alias("price"))


def dealt(records):
    """Records dealt out to several tasks a core, for a small file would be a single task."""
    return records.repartition(8 * records.sparkSession.sparkContext.defaultParallelism, "id")


def part_pairs(spark, d):
    """Each part and the one with the next key, as records."""
    p = part_records(spark, d)
    return pairs.with_records(p.select(F.col("id").alias("idA"), (F.col("id") + 1).alias("idB")), p, p)


_P = "with x as (select p_partkey as id, p_name as name, p_brand as brand, p_type as type, cast(p_size as varchar) as size, p_retailprice as price from part), p as (select a.id as idA, b.id as idB, a.name as na, b.name as nb, a.brand as ba, b.brand as bb, a.type as ta, b.type as tb, a.size as za, b.size as zb, a.price as pa, b.price as pb from x a join x b on b.id = a.id + 1)"
_TOK = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda t: t <> ''))"
_WORD = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+'))"


def _jac(a: str, b: str, tok: str) -> str:
    x, y = tok.format(a), tok.format(b)
    return f"round(len(list_intersect({x}, {y})) / greatest(len(list_distinct(list_concat({x}, {y}))), 1), 6)"


@query(_P + f" select idA, idB, {_jac('na', 'nb', _TOK)} as overlap from p")
def token_jaccard_space(spark, d):
    return part_pairs(spark, d).select("idA", "idB", r6(similarity.supervised_token_overlap(F.col("a.name"), F.col("b.name"))).alias("overlap"))


@query(_P + f" select idA, idB, {_jac('na', 'nb', _WORD)} as name_overlap, {_jac('ba', 'bb', _WORD)} as brand_overlap from p")
def token_jaccard_word(spark, d):
    return part_pairs(spark, d).select("idA", "idB", *(r6(similarity.token_overlap(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(f"{c}_overlap") for c in ("name", "brand")))


@query(_P + " select idA, idB, case when lower(ba) = lower(bb) then 1.0 else 0.0 end::double as adaptive, case when lower(ba) = lower(bb) then 1.0 else 0.0 end::double as supervised from p")
def exact_matches(spark, d):
    return part_pairs(spark, d).select("idA", "idB", similarity.exact_match(F.col("a.brand"), F.col("b.brand")).alias("adaptive"), similarity.supervised_exact(F.col("a.brand"), F.col("b.brand")).alias("supervised"))


@query(_P + " select idA, idB, round(1 - least(abs(pa - pb) / greatest(abs(pa), abs(pb), 1), 1), 6) as price, round(1 - least(abs(za::double - zb::double) / 20, 1), 6) as size from p")
def numeric_similarities(spark, d):
    return part_pairs(spark, d).select("idA", "idB", r6(similarity.numeric_similarity(F.col("a.price"), F.col("b.price"))).alias("price"), r6(similarity.numeric_similarity(F.col("a.size"), F.col("b.size"), 20)).alias("size"))


@query("with e as (select vec_id as id, cast(embedding as double[]) as v, case when vec_id % 5 = 0 then '' when vec_id % 7 = 0 then null else 'text' end as t from embeddings) select a.id as idA, round(case when coalesce(a.t, '') = '' and coalesce(b.t, '') = '' then 1.0 when coalesce(a.t, '') = '' or coalesce(b.t, '') = '' then 0.0 else greatest(0, least(1, (list_dot_product(a.v, b.v) + 1) / 2)) end, 6) as semantic from e a join e b on b.id = a.id + 1")
def semantic_similarities(spark, d):
    """Neighbouring embeddings, of which every fifth and seventh record has no text."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("vec_id") % 5 == 0, "").when(F.col("vec_id") % 7 == 0, None).otherwise("text").alias("t"))
    both = e.join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"), F.col("t").alias("u")), "id")
    return both.select(F.col("id").alias("idA"), r6(similarity.semantic_similarity(F.col("t"), F.col("u"), similarity.dot(F.col("v"), F.col("w")))).alias("semantic"))


@query()
def edit_similarities(spark, d):
    return part_pairs(spark, d).select("idA", "idB", r6(similarity.edit_similarity(F.col("a.name"), F.col("b.name"))).alias("adaptive"), r6(similarity.supervised_edit(F.col("a.type"), F.col("b.type"))).alias("supervised"))


@query()
def supervised_features(spark, d):
    return part_pairs(spark, d).select("idA", "idB", *similarity.field_similarities("a", "b", ["name", "brand"]))


_F = _P + ", f as (select idA, idB, case when idA % 3 = 0 and idB % 3 = 0 then 0.0 when idA % 3 = 0 or idB % 3 = 0 then 0.0 else 1.0 end as numeric, " + f"{_jac('na', 'nb', _WORD)} as f1, case when lower(na) = lower(nb) then 1.0 else 0.0 end as f2, {_jac('ba', 'bb', _WORD)} as f3, round(1 - least(abs(za::double - zb::double) / greatest(abs(za::double), abs(zb::double), 1), 1), 6) as f4, round(1 - least(abs(pa - pb) / greatest(abs(pa), abs(pb), 1), 1), 6) as f5 from p)"


@query(_F + " select idA, idB, f1, f2::double as f2, f3, f4, f5, numeric::double as numeric from f")
def pair_features_native(spark, d):
    """mixed is a size, or a brand where 3 divides the key."""
    p = part_records(spark, d).withColumn("mixed", F.when(F.col("id") % 3 == 0, F.col("brand")).otherwise(F.col("size")))
    f = similarity.pair_features(pairs.with_records(p.select(F.col("id").alias("idA"), (F.col("id") + 1).alias("idB")), p, p), [*ATTRIBUTES, "mixed"])
    return f.select("idA", "idB", r6("features.name.token_overlap").alias("f1"), F.col("features.name.exact_match").alias("f2"), r6("features.brand.token_overlap").alias("f3"), r6("features.size.numeric_similarity").alias("f4"), r6("features.price.numeric_similarity").alias("f5"), F.col("features.mixed.is_numeric").alias("numeric"))


@query()
def pair_feature_vectors(spark, d):
    return similarity.pair_features(part_pairs(spark, d), ATTRIBUTES).select("idA", "idB", F.size("vector").alias("n"), listed(F.col("vector")).alias("vector"))


# ---- embedding and blocking ----

DIMENSIONS = 64


def vectors(spark, d):
    """The embeddings with even ids, and with odd ids, at length 1."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


def gold(spark, d):
    """Neighbouring ids of one label: a set that grows as the table does."""
    a, b = vectors(spark, d)
    found = a.join(b.withColumnRenamed("id", "idB").withColumnRenamed("label", "lb").drop("vector"), F.col("idB") == F.col("id") + 1).where("label = lb").select(F.col("id").alias("idA"), "idB")
    return pairs.gold_pairs(found, a, b).select(F.col("idA").cast("long").alias("idA"), F.col("idB").cast("long").alias("idB"))


def blocked(spark, d, t=5, p=8, k=5):
    a, b = vectors(spark, d)
    return blocking.block(a.drop("label"), b.drop("label"), t, p, top_k=k, dimensions=DIMENSIONS)


def lsh_sql(t: int = 5, p: int = 8, k: int = 5) -> str:
    planes = blocking.random_planes(t, p, DIMENSIONS)
    rows = ", ".join(f"({i}, {j}, [{', '.join(repr(float(x)) for x in planes[i, j])}]::double[])" for i in range(t) for j in range(p))
    return f"""with planes(t, b, pv) as (values {rows}),
e as (select vec_id as id, cast(embedding as double[]) as v, label from embeddings),
sig as (select id, t, sum(case when list_dot_product(v, pv) > 0 then 1 << b else 0 end)::bigint as h from e, planes group by id, t),
cand as (select distinct x.id as idA, y.id as idB from sig x join sig y on x.t = y.t and x.id % 2 = 0 and y.id % 2 = 1 and bit_count(xor(x.h, y.h)) <= 1),
scored as (select idA, idB, list_dot_product(a.v, b.v) as s from cand join e a on a.id = idA join e b on b.id = idB),
top as (select * from (select idA, idB, s, row_number() over (partition by idA order by s desc, idB) as rank from scored) where rank <= {k}),
gold as (select a.id as idA, b.id as idB from e a join e b on b.id = a.id + 1 and a.label = b.label where a.id % 2 = 0)"""


_LSH = lsh_sql()


@query(_LSH + " select id, t, h from sig")
def lsh_signatures(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return blocking.signatures(v, blocking.random_planes(5, 8, DIMENSIONS)).select("id", F.posexplode("h").alias("t", "h"))


@query(_LSH + " select idA, idB from cand")
def lsh_candidates(spark, d):
    return blocking.candidates(*vectors(spark, d), blocking.random_planes(5, 8, DIMENSIONS), 1)


@query(_LSH + " select idA, idB from cand")
def lsh_candidates_dense(spark, d):
    a, b = vectors(spark, d)
    return blocking.candidates(a, b, blocking.random_planes(5, 8, DIMENSIONS), 1, dense=blocking.fits(b, 5, DIMENSIONS))


@query(_LSH + " select idA, idB, round(s, 6) as sim, rank::int as rank from top")
def lsh_topk(spark, d):
    return blocked(spark, d).select("idA", "idB", r6("sim").alias("sim"), "rank")


@query(_LSH + " select idA, idB, round(s, 6) as sim, rank::int as rank from top")
def lsh_topk_probes(spark, d):
    """The plan for tables too large to broadcast."""
    a, b = vectors(spark, d)
    return blocking.block(a.drop("label"), b.drop("label"), 5, 8, dimensions=DIMENSIONS, dense=False).select("idA", "idB", r6("sim").alias("sim"), "rank")


@query(lsh_sql(10, 4) + " select idA, idB, round(s, 6) as sim, rank::int as rank from top")
def lsh_topk_10x4(spark, d):
    return blocked(spark, d, 10, 4).select("idA", "idB", r6("sim").alias("sim"), "rank")


@query(lsh_sql(15, 8) + " select idA, idB, round(s, 6) as sim, rank::int as rank from top")
def lsh_topk_15x8(spark, d):
    return blocked(spark, d, 15, 8).select("idA", "idB", r6("sim").alias("sim"), "rank")


@query(_LSH + " select idA, idB, round(s, 6) as sim from scored")
def pair_scores(spark, d):
    return blocking.candidates(*vectors(spark, d), blocking.random_planes(5, 8, DIMENSIONS), 1, scored=True).select("idA", "idB", r6("sim").alias("sim"))


@query()
def hashed_record_vectors(spark, d):
    return embedding.embed(dealt(part_records(spark, d)), ["name", "brand", "type"]).select("id", listed(F.col("vector")).alias("vector"))


_METRICS = "select (select count(*) from top) as candidate_pairs, na * nb as total_pairs, f as found_matches, g as gt_matches, round(f / g, 6) as pair_completeness, round((na * nb - (select count(*) from top)) / (na * nb) * 100, 6) as reduction_percentage from (select (select count(*) from e where id % 2 = 0) as na, (select count(*) from e where id % 2 = 1) as nb, (select count(*) from gold) as g, (select count(*) from gold join top using (idA, idB)) as f)"


@query(_LSH + " " + _METRICS)
def blocking_metrics(spark, d):
    m = metrics.blocking_metrics(blocked(spark, d), gold(spark, d), *vectors(spark, d))
    return m.select("candidate_pairs", "total_pairs", "found_matches", "gt_matches", r6("pair_completeness").alias("pair_completeness"), r6("reduction_percentage").alias("reduction_percentage"))


GRID = ([5, 10, 15, 20], [4, 6, 8, 10])


def sweep_sql(tables_: list[int], planes_: list[int]) -> str:
    return " union all ".join(f"select {t} as num_tables, {p} as num_planes, * from ({lsh_sql(t, p)} {_METRICS})" for t in tables_ for p in planes_)


def _sweep(spark, d, grid=GRID):
    a, b = vectors(spark, d)
    found = linkage.sweep("embeddings", a.drop("label"), b.drop("label"), gold(spark, d), *grid)
    return found.withColumn("pair_completeness", r6("pair_completeness")).withColumn("reduction_percentage", r6("reduction_percentage"))


@query(sweep_sql(*GRID))
def blocking_sweep(spark, d):
    return _sweep(spark, d).drop("dataset", "num_flips", "top_k", "elapsed_seconds")


@query(f"select num_tables, num_planes, pair_completeness from ({sweep_sql([2, 4], [6, 8])}) order by pair_completeness desc, candidate_pairs, num_tables, num_planes limit 1")
def best_blocking(spark, d):
    """Time, which differs from run to run, is taken as the order of the grid."""
    grid = _sweep(spark, d, ([2, 4], [6, 8])).withColumn("elapsed_seconds", (F.col("num_tables") * 100 + F.col("num_planes")).cast("double"))
    return linkage.best_by_dataset(grid).select("num_tables", "num_planes", "pair_completeness")


# ---- pairs and samples ----


@query(_LSH + " select idA, idB from gold")
def gold_pairs(spark, d):
    return gold(spark, d)


@query(_LSH + " select idA, idB, (g.idA is not null)::int as label from top t left join gold g using (idA, idB)".replace("(g.idA is not null)", "exists(select 1 from gold g where g.idA = t.idA and g.idB = t.idB)").replace(" left join gold g using (idA, idB)", ""))
def labelled_candidates(spark, d):
    return pairs.labelled(blocked(spark, d), gold(spark, d)).select("idA", "idB", "label")


@query(_LSH + " select idA, idB, 0 as label from top anti join gold using (idA, idB)")
def hard_negatives(spark, d):
    return pairs.negatives(blocked(spark, d), gold(spark, d))


_MIX = "md5('42|' || idA || '|' || idB), idA, idB"


@query(_LSH + f" select * from (select idA, idB, 1 as label from gold order by {_MIX} limit 20) union all select * from (select idA, idB, 0 as label from top anti join gold using (idA, idB) order by {_MIX} limit 30)")
def labelled_sample(spark, d):
    g = gold(spark, d)
    return pairs.labelled_sample(g, pairs.negatives(blocked(spark, d), g), 20, 30)


@query(_LSH + f", m as (select idA, idB, exists(select 1 from gold g where g.idA = t.idA and g.idB = t.idB)::int as label from top t) select * from (select * from m where label = 1 order by {_MIX} limit 10) union all select * from (select * from m where label = 0 order by {_MIX} limit 10)")
def balanced_sample(spark, d):
    return pairs.balanced(pairs.labelled(blocked(spark, d), gold(spark, d)).select("idA", "idB", "label"))


_STRATA = ", q as (select quantile_cont(greatest(0, least(1, s)), 1/3.0) as lo, quantile_cont(greatest(0, least(1, s)), 2/3.0) as hi from top), st as (select idA, idB, case when greatest(0, least(1, s)) <= lo then 'low' when greatest(0, least(1, s)) >= hi then 'high' else 'medium' end as stratum from top, q)"


@query(_LSH + _STRATA + " select stratum, count(*) as n from st group by 1")
def similarity_strata(spark, d):
    return pairs.strata(blocked(spark, d)).groupBy("stratum").agg(F.count("*").alias("n"))


@query(_LSH + _STRATA + f", o as (select *, row_number() over (partition by stratum order by {_MIX}) as n from st) select idA, idB, stratum from o order by (n > case stratum when 'medium' then 18 else 6 end)::int, case stratum when 'medium' then 0 when 'low' then 1 else 2 end, n limit 30")
def stratified_sample(spark, d):
    return pairs.stratified(blocked(spark, d), 30).select("idA", "idB", "stratum")


_PROFILED = """, m as (select idA, idB, greatest(0, least(1, s)) as s, exists(select 1 from gold g where g.idA = t.idA and g.idB = t.idB)::int as label from top t),
c as (select count(*) filter (label = 1) as c1, count(*) filter (label = 0) as c0, least(40, count(*)) as want from m),
w as (select want, c1, least(want - least(want // 2, c1), c0) as neg from c),
target as (select 1 as label, least(want - neg, c1) as t from w union all select 0, neg from w),
quota as (select label, t, round_even(t * 0.2, 0) as side, t - 2 * round_even(t * 0.2, 0) as medium from target),
q as (select label, quantile_cont(s, 1/3.0) as lo, quantile_cont(s, 2/3.0) as hi from m group by label),
st as (select m.*, case when s <= lo then 'low' when s >= hi then 'high' else 'medium' end as stratum from m join q using (label)),
o as (select *, row_number() over (partition by label, stratum order by md5('42|' || idA || '|' || idB), idA, idB) as n from st),
r as (select o.*, t, row_number() over (partition by o.label order by (n > case stratum when 'medium' then medium else side end)::int, case stratum when 'medium' then 0 when 'low' then 1 else 2 end, n) as k from o join quota using (label))
select idA, idB, label, stratum from r where k <= t"""


@query(_LSH + _PROFILED)
def balanced_profile_sample(spark, d):
    return pairs.balanced_profile(blocked(spark, d), gold(spark, d), 40).select("idA", "idB", "label", "stratum")


@query(_LSH + ", p as (select idA || '' as idxA, idB || '' as idxB, 0 as label from top anti join gold using (idA, idB)) select * from p")
def negative_pairs_file(spark, d):
    """Hard negatives written as delimited text and read back."""
    path = shared.new_path(spark, "negatives")
    tables.write_pairs(hard_negatives(spark, d).select(F.col("idA").alias("idxA"), F.col("idB").alias("idxB"), "label"), path)
    return tables.read_pairs(spark, path)


# ---- importance ----

NAMES = ["name", "brand", "type", "size", "price"]


def answers(spark, d):
    """A made-up model answer for each part: scores from its numbers, sometimes fenced, sometimes broken."""
    body = F.concat(F.lit('{"attribute_importance": {"name": '), F.col("p_size") % 5, F.lit(', "brand": "'), F.col("p_partkey") % 4, F.lit('", "price": '), F.col("p_partkey") % 7 - 2, F.lit("}}"))
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, "not json").when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("answer"))


_ANSWERS = "with s as (select p_partkey, case when p_partkey % 11 = 0 then 0 else least(p_size % 5, 3) end as name, case when p_partkey % 11 = 0 then 0 else p_partkey % 4 end as brand, 0 as type, 0 as size, case when p_partkey % 11 = 0 then 0 else greatest(0, least(3, p_partkey % 7 - 2)) end as price from part)"


@query(_ANSWERS + " select p_partkey, name::int as name, brand::int as brand, type::int as type, size::int as size, price::int as price from s")
def importance_scores_parsed(spark, d):
    got = answers(spark, d).withColumn("s", importance.parse_scores(F.col("answer"), NAMES))
    return got.select("p_partkey", *(F.col("s")[c].alias(c) for c in NAMES))


def _vector_sql(v: str) -> str:
    return f"case when list_sum({v}) > 0 then list_transform({v}, lambda x: x / list_sum({v})) else list_transform({v}, lambda x: 1.0 / {len(NAMES)}) end"


_V = _ANSWERS + ", v as (select p_partkey, [name, brand, type, size, price]::double[] as v from s)"


@query(_V + f" select p_partkey, {sql_listed(_vector_sql('v'))} as importance from v")
def importance_normalised(spark, d):
    got = answers(spark, d).withColumn("s", importance.parse_scores(F.col("answer"), NAMES))
    return got.select("p_partkey", listed(importance.normalise(importance.from_map(F.col("s"), NAMES))).alias("importance"))


@query(_V + ", a as (" + " union all ".join(f"select '{c}' as attribute, {i} as position, avg(v[{i + 1}]) as m from v" for i, c in enumerate(NAMES)) + ") select attribute, position::int as position, round(m, 6) as importance, row_number() over (order by m desc, position)::int as rank from a")
def importance_aggregated(spark, d):
    got = answers(spark, d).select(importance.parse_scores(F.col("answer"), NAMES).alias("scores"))
    return importance.aggregate_importance(got, NAMES).select("attribute", "position", r6("importance").alias("importance"), "rank")


@query(_V + ", a as (" + " union all ".join(f"select '{c}' as attribute, avg(v[{i + 1}]) as m from v" for i, c in enumerate(NAMES)) + ") select attribute from a where m >= 0.5")
def attribute_threshold(spark, d):
    got = answers(spark, d).select(importance.parse_scores(F.col("answer"), NAMES).alias("scores"))
    return importance.above(importance.aggregate_importance(got, NAMES), 0.5).select("attribute")


@query(_V + " select score::int as score, count(*) as n from (select unnest(v) as score from v) group by 1")
def score_histogram(spark, d):
    return metrics.score_histogram(answers(spark, d).select(importance.parse_scores(F.col("answer"), NAMES).alias("scores")), NAMES)


@query(_V + f", n as (select p_partkey, {_vector_sql('v')} as p from v) select p_partkey, round(greatest(0, least(1, 1 + list_sum(list_transform(p, lambda x: case when x > 0 then x * ln(x) else 0 end)) / ln({len(NAMES)}))), 6) as confidence from n")
def entropy_confidence(spark, d):
    got = answers(spark, d).withColumn("s", importance.parse_scores(F.col("answer"), NAMES))
    return got.select("p_partkey", r6(importance.entropy_confidence(importance.from_map(F.col("s"), NAMES))).alias("confidence"))


@query("select p_partkey, case when p_partkey % 2 = 0 then '0.666667,0.000000,0.000000,0.000000,0.333333' else '0.000000,0.500000,0.333333,0.000000,0.166667' end as importance from part")
def importance_ranked(spark, d):
    lists = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("name"), F.lit("nothing"), F.lit("price"))).otherwise(F.array(F.lit("brand"), F.lit("type"), F.lit("price")))
    return table(spark, d, "part").select("p_partkey", listed(importance.from_ranked(lists, NAMES)).alias("importance"))


@query("select p_partkey, '0.300000,0.200000,0.100000,0.100000,0.300000' as importance from part")
def importance_grouped(spark, d):
    group = lambda name, *members: F.struct(F.lit(name).alias("group"), F.array(*map(F.lit, members)).alias("members"))
    return table(spark, d, "part").select("p_partkey", listed(importance.from_grouped(F.array(group("High", "name", "price"), group("medium", "brand"), group("low", "type", "size")), NAMES)).alias("importance"))


@query("select p_partkey, round(case when p_partkey % 11 = 0 then null else (p_size % 5)::double end, 6) as name, case when p_partkey % 11 = 0 then 0 else 2 end as fields from part")
def global_scores_parsed(spark, d):
    body = F.concat(F.lit('{"name": '), F.col("p_size") % 5, F.lit(', "brand": "0.5", "other": 1, "price": "much"}'))
    got = table(spark, d, "part").select("p_partkey", importance.parse_global_scores(F.when(F.col("p_partkey") % 11 == 0, "[broken").otherwise(body), NAMES).alias("s"))
    return got.select("p_partkey", F.try_element_at("s", F.lit("name")).alias("name"), F.size("s").alias("fields"))


# ---- selectors ----

THREE = ["name", "address", "phone"]
PROFILE_X = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0, 0.5]]
PROFILE_Y = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.5, 0.3, 0.2]]


def selector(**kw) -> HybridSelector:
    return HybridSelector(THREE, neighbours=2, **kw).fit(PROFILE_X, PROFILE_Y)


def three_features(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") / 50.0, (F.col("p_partkey") % 7) / 7.0, (F.col("p_partkey") % 3) / 3.0).alias("vector"))


def _normal(v: str) -> str:
    pos = f"list_transform({v}, lambda x: greatest(x, 0))"
    return f"case when list_sum({pos}) > 0 then list_transform({pos}, lambda x: x / list_sum({pos})) else [1/3.0, 1/3.0, 1/3.0] end"


def _selector_sql() -> str:
    s = selector()
    w, b = s.predictor.weights, s.predictor.intercept
    raw = "[" + ", ".join(f"list_dot_product(x, [{', '.join(repr(float(v)) for v in w[:, j])}]::double[]) + {float(b[j])!r}" for j in range(3)) + "]"
    rows = ", ".join(f"({i}, [{', '.join(repr(float(v)) for v in s.retriever.x[i])}]::double[], [{', '.join(repr(float(v)) for v in s.retriever.y[i])}]::double[])" for i in range(len(PROFILE_X)))
    return f"""with f as (select p_partkey, [p_size / 50.0, (p_partkey % 7) / 7.0, (p_partkey % 3) / 3.0]::double[] as x from part),
r0 as (select p_partkey, x, {raw} as v from f), ridge as (select p_partkey, x, {_normal('v')} as p from r0),
prof(i, px, py) as (values {rows}),
near as (select p_partkey, py, row_number() over (partition by p_partkey order by round(list_dot_product(px, x) / case when list_dot_product(x, x) > 0 then sqrt(list_dot_product(x, x)) else 1 end, 12) desc, i) as n from f, prof),
knn as (select p_partkey, [sum(py[1]) / 2, sum(py[2]) / 2, sum(py[3]) / 2] as q from near where n <= 2 group by p_partkey),
mix as (select p_partkey, p, q, [p[1] / 2 + q[1] / 2, p[2] / 2 + q[2] / 2, p[3] / 2 + q[3] / 2] as c from ridge join knn using (p_partkey))"""


@query(_selector_sql() + f" select p_partkey, {sql_listed('p', 4)} as predicted from ridge")
def ridge_importance(spark, d):
    return three_features(spark, d).select("p_partkey", listed(selector().predictor.column(F.col("vector")), 4).alias("predicted"))


@query(_selector_sql() + f" select p_partkey, {sql_listed('q', 4)} as retrieved from knn")
def retriever_importance(spark, d):
    return three_features(spark, d).select("p_partkey", listed(selector().retriever.column(F.col("vector"), 2), 4).alias("retrieved"))


@query(_selector_sql() + f" select p_partkey, {sql_listed('c', 4)} as combined from mix")
def hybrid_importance(spark, d):
    return selector().importances(three_features(spark, d)).select("p_partkey", listed(F.col("combined_importance"), 4).alias("combined"))


def _confidence_sql(v: str) -> str:
    return f"greatest(0, least(1, 1 + list_sum(list_transform({v}, lambda x: case when x > 0 then x * ln(x) else 0 end)) / ln(3)))"


@query(_selector_sql() + f", conf as (select p_partkey, p, q, {_confidence_sql('p')} as cp, {_confidence_sql('q')} as cq from mix), share as (select *, case when cp + cq = 0 then 0.5 else cp / (cp + cq) end as wp from conf) select p_partkey, {sql_listed('[p[1] * wp + q[1] * (1 - wp), p[2] * wp + q[2] * (1 - wp), p[3] * wp + q[3] * (1 - wp)]', 4)} as combined from share")
def hybrid_importance_by_confidence(spark, d):
    return selector(fusion="confidence_based").importances(three_features(spark, d)).select("p_partkey", listed(F.col("combined_importance"), 4).alias("combined"))


@query(_selector_sql() + ", e as (select p_partkey, unnest(['name', 'address', 'phone']) as a, unnest(c) as v, unnest([0, 1, 2]) as i from mix), o as (select *, row_number() over (partition by p_partkey order by round(v, 12) desc, i) as n, sum(v) over (partition by p_partkey order by round(v, 12) desc, i) - v as held from e) select p_partkey, string_agg(a, ',' order by n) as selected from o where n = 1 or held < 0.7 group by 1")
def hybrid_selection(spark, d):
    return selector(mass=0.7).select(three_features(spark, d)).select("p_partkey", F.array_join("selected_attributes", ",").alias("selected"))


@query(_selector_sql() + " select p_partkey, case when round(c[1], 12) >= round(c[3], 12) then 'name' else 'phone' end as selected from mix")
def hybrid_selection_with_roles(spark, d):
    """One attribute, which must tell identity: an address gives way to the better of name and phone."""
    return selector(top_k=1, max_k=1, required_roles=("identity",)).select(three_features(spark, d)).select("p_partkey", F.array_join("selected_attributes", ",").alias("selected"))


# ---- matching parts with their neighbours ----


def neighbour_gold(spark, d):
    p = part_records(spark, d)
    return p.select(F.col("id").alias("idA"), (F.col("id") + 1).alias("idB")).where("idA % 3 = 0")


def neighbour_pairs(spark, d):
    p = part_records(spark, d)
    return p.select(F.col("id").alias("idA"), (F.col("id") + 1).alias("idB")).withColumn("selected_attributes", F.when(F.col("idA") % 2 == 0, F.array(F.lit("brand"), F.lit("type"))).otherwise(F.array(F.lit("name"), F.lit("size"))))


def neighbour_results(spark, d, cache=None):
    p = part_records(spark, d)
    return matching.match(neighbour_pairs(spark, d), p, p, matching.RuleMatcher(0.4), cache)


def _overlap_sql(a: str, b: str) -> str:
    x, y = _TOK.format(a), _TOK.format(b)
    return f"(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"


_MATCH = _P + f", m as (select idA, idB, case when case when idA % 2 = 0 then ({_overlap_sql('ba', 'bb')} + {_overlap_sql('ta', 'tb')}) / 2 else ({_overlap_sql('na', 'nb')} + {_overlap_sql('za', 'zb')}) / 2 end >= 0.4 then 'Yes' else 'No' end as answer, case when idA % 2 = 0 then 'brand,type' else 'name,size' end as selected from p)"


@query(_MATCH + " select idA, idB, answer, selected, false as cache_hit, 2 as selected_attribute_count from m")
def match_results(spark, d):
    return neighbour_results(spark, d).select("idA", "idB", "answer", F.array_join("selected_attributes", ",").alias("selected"), "cache_hit", "selected_attribute_count")


@query(_MATCH + " select idA, idB, answer, true as cache_hit from m")
def match_results_cached(spark, d):
    """A second run over the table that the first filled."""
    cache = DecisionCache(shared.new_path(spark, "decisions"))
    neighbour_results(spark, d, cache).count()
    return neighbour_results(spark, d, cache).select("idA", "idB", "answer", "cache_hit")


_CONFUSION = _MATCH + ", g as (select *, idA % 3 = 0 as gold, answer = 'Yes' as yes from m), c as (select count(*) filter (yes and gold) as tp, count(*) filter (yes and not gold) as fp, count(*) filter (not yes and not gold) as tn, count(*) filter (not yes and gold) as fn from g)"


@query(_CONFUSION + ", gold as (select count(*) as gold from part where p_partkey % 3 = 0), r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as q from c, gold) select tp, fp, tn, fn, round(p, 6) as precision, round(q, 6) as candidate_recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 6) as f1, gold, round(tp / gold, 6) as end_to_end_recall from r")
def match_metrics(spark, d):
    m = metrics.match_metrics(neighbour_results(spark, d), neighbour_gold(spark, d))
    return m.select("tp", "fp", "tn", "fn", "gold", *(r6(c).alias(c) for c in ("precision", "candidate_recall", "f1", "end_to_end_recall")))


@query(_MATCH + " select count(*) as pairs, count(*) as completion_tokens, 0::bigint as cache_hits from m")
def token_usage(spark, d):
    return metrics.token_usage(neighbour_results(spark, d)).select("pairs", "completion_tokens", "cache_hits")


_PICKED = _selector_sql() + ", e as (select p_partkey, unnest(c) as v, unnest([0, 1, 2]) as i from mix), o as (select *, row_number() over (partition by p_partkey order by round(v, 12) desc, i) as n, sum(v) over (partition by p_partkey order by round(v, 12) desc, i) - v as held from e), sizes as (select count(*) as n from o where n = 1 or held < 0.7 group by p_partkey)"


@query(_PICKED + " select min(n)::int as min_selected, round(avg(n), 6) as mean_selected, max(n)::int as max_selected from sizes")
def selection_sizes(spark, d):
    return metrics.selection_sizes(selector(mass=0.7).select(three_features(spark, d))).withColumn("mean_selected", r6("mean_selected"))


@query(_MATCH + " select idA, idB from m where answer = 'No' and idA % 3 = 0 order by cast(idA as bigint) limit 10")
def false_negatives(spark, d):
    """A report of ten."""
    p, results = part_records(spark, d), neighbour_results(spark, d)
    return pairs.false_negatives(results, results, neighbour_gold(spark, d), p, p).select("idA", "idB")


@query(_P + " select idA, idB, case when idA % 2 = 0 then 'brand=' || ba || ';type=' || ta else 'name=' || na || ';size=' || za end as a from p")
def condensed_pairs(spark, d):
    p = part_records(spark, d)
    got = pairs.with_records(neighbour_pairs(spark, d), p, p).withColumn("m", selection.condense(matching.as_map(F.col("a"), ATTRIBUTES), F.col("selected_attributes")))
    return got.select("idA", "idB", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("a"))


# ---- learned and whole plans ----


def part_tables(spark, d):
    """All parts, and all parts with some names (keys that 8 divides) in capitals: a linkage task with known answers.

    Records are dealt out, for every one of A meets every one of B, and a small file would be a single task.
    """
    a = dealt(part_records(spark, d).withColumn("id", F.col("id").cast("string")))
    b = a.withColumn("name", F.when(F.col("id").cast("long") % 8 == 0, F.upper("name")).otherwise(F.col("name"))).withColumn("price", F.col("price"))
    return a, b, a.select(F.col("id").alias("idA"), F.col("id").alias("idB"))


def part_blocks(spark, d):
    a, b, g = part_tables(spark, d)
    cols = ["name", "brand", "type"]
    return a, b, g, blocking.block(embedding.embed(a, cols), embedding.embed(b, cols), 5, 8, top_k=3, dimensions=64 * len(cols)).persist()


@query()
def supervised_ranking(spark, d):
    a, b, g, c = part_blocks(spark, d)
    _, _, ranked = selection.supervised(a, b, c, g)
    return spark.createDataFrame([(n, i + 1) for i, (n, _) in enumerate(ranked)], "attribute string, rank int")


def _scored_sql() -> str:
    overlap = lambda x, y: f"(len(list_intersect({_TOK.format(x)}, {_TOK.format(y)})) / len(list_distinct(list_concat({_TOK.format(x)}, {_TOK.format(y)}))))"
    columns = {"name": ("na", "nb"), "brand": ("ba", "bb"), "type": ("ta", "tb"), "size": ("za", "zb"), "price": ("cast(pa as varchar)", "cast(pb as varchar)")}
    each = " union all ".join(f"select '{c}' as attribute, {k} as i, avg(case when label = 1 then {overlap(x, y)} else 1 - {overlap(x, y)} end) as m from picked" for k, (c, (x, y)) in enumerate(columns.items()))
    return _P + f", m as (select *, (idA % 3 = 0)::int as label from p), picked as (select * from (select * from m where label = 1 order by {_MIX} limit 10) union all select * from (select * from m where label = 0 order by {_MIX} limit 10)), scored as ({each}) select attribute, round(m, 6) as importance, row_number() over (order by round(m, 9) desc, i)::int as rank from scored"


@query(_scored_sql())
def model_guided_ranking(spark, d):
    """Ten matches and ten other pairs of all neighbouring parts, scored by the offline profiler."""
    p = part_records(spark, d)
    labelled = pairs.labelled(neighbour_pairs(spark, d).select("idA", "idB").join(p.select(F.col("id").alias("idB")), "idB", "left_semi").select("idA", "idB"), neighbour_gold(spark, d))
    _, _, ranked = selection.model_guided(p, p, labelled, OfflineProfiler())
    return spark.createDataFrame([(n, round(w, 6), i + 1) for i, (n, w) in enumerate(ranked)], "attribute string, importance double, rank int")


@query()
def adaptive_attributes(spark, d):
    a, b, g, c = part_blocks(spark, d)
    found, _, _ = selection.adaptive(c, a, b, g, profile_size=20)
    return found.select("idA", "idB", F.array_join("selected_attributes", ",").alias("selected"))


@query()
def linkage_summary(spark, d):
    """The whole plan, from records to a summary."""
    a, b, g = part_tables(spark, d)
    return linkage.link(a, b, g, "parts").summary


@query()
def incremental_linkage(spark, d):
    """New records as a stream against a stored table."""
    from ..streaming.incremental import link_stream

    a, b, _ = part_tables(spark, d)
    src, out, mark = (shared.new_path(spark, n) for n in ("arrivals", "linked", "progress"))
    a.repartition(2).write.parquet(src)
    link_stream(spark.readStream.schema(a.schema).parquet(src), b, ["name", "brand"], out, mark, once=True).awaitTermination()
    return spark.read.parquet(out).select("idA", "idB", r6("sim").alias("sim"), "rank")
