"""Operator 8, sharding by a hierarchical weighted hash tree.  DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import read


@dataclass(frozen=True)
class Leaf:
    """A shard of the tree: its place and its weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """`shards` shards dealt over regions and racks, two by two."""
    return [Leaf(s // 2 // racks % regions, s // 2 % racks, s) for s in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own: no other node's weight changes, so keys move into it alone."""
    return [*leaves, Leaf(max(x.region for x in leaves) + 1, 0, max(x.shard for x in leaves) + 1, weight)]


#: Hex digits of a digest behind a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13
#: Hex digits of md5(key) that deal a shard's rows into groups for slots.
GROUP_DIGITS = 3
LEVELS = ("region", "rack", "shard")


def draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate `weight`, from the key and the node's path alone."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f":{node}")).cast("binary")), 1, DRAW_DIGITS)
    uniform = (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** (4 * DRAW_DIGITS)))
    return -F.log(uniform) / F.lit(float(weight))


def _children(leaves: list[Leaf], depth: int) -> dict[tuple, dict[int, float]]:
    """For each inner node of a depth (its path as a tuple): its children and their weights, in order."""
    found: dict[tuple, dict[int, float]] = {}
    for x in sorted(leaves, key=lambda x: (x.region, x.rack, x.shard)):
        path = (x.region, x.rack, x.shard)
        of = found.setdefault(path[:depth], {})
        of[path[depth]] = of.get(path[depth], 0.0) + x.weight
    return found


def descend(rows: DataFrame, leaves: list[Leaf], key: str = "_key", prefix: str = "") -> DataFrame:
    """rows with the columns {prefix}region, {prefix}rack and {prefix}shard of each key.

    At every level each child of the node reached makes a draw from the key and its own path, of the rate of its
    weight (the sum below it), and the least draw goes on: a child is taken in proportion to its weight, and only
    the children on a key's way draw.  A draw depends on nothing but that node, so a change of weights moves keys
    only into, out of, or within the subtrees whose weights change.  Shards of weight 0 get nothing.
    """
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("no shard has a weight above 0")
    for depth, level in enumerate(LEVELS):
        chosen = None
        for path, children in _children(leaves, depth).items():
            draws = [F.struct(draw(F.col(key), "/".join(map(str, (*path, n))), w).alias("draw"), F.lit(n).alias("n")) for n, w in children.items()]
            best = F.least(*draws)["n"] if len(draws) > 1 else F.lit(next(iter(children)))
            here = F.lit(True)
            for name, n in zip(LEVELS, path, strict=False):
                here = here & (F.col(prefix + name) == n)
            chosen = F.when(here, best) if chosen is None else chosen.when(here, best)
        rows = rows.withColumn(prefix + level, chosen.otherwise(F.lit(-1)))  # never null, or joins would test that by drawing again
    return rows


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, size, text_crc32, law, region, rack, shard, slot, grown_shard), one per row of docs.

    Law `key`: key and shards decide.  A null key counts as the text "null"; a null text has no bytes (size 1,
    crc32 0).  Repeated rows share a shard and get slots of their own.  Slots run from 0 without a gap within a
    shard, in the order of md5(key): counts of the groups of GROUP_DIGITS digits of each shard give a group's first
    slot (at most 4096 rows a shard, broadcast), and row_number() within a group the rest, so no task holds a shard.
    An empty table gives no rows.  Other columns of docs are not read.
    """
    bare = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(bare) + F.lit(1)).cast("long").alias("size"), F.crc32(bare.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"),
    ).withColumn("_order", F.md5(F.col("_key").cast("binary"))).withColumn("_group", F.substring("_order", 1, GROUP_DIGITS))
    rows = descend(plain, leaves)
    rows = descend(rows, grown, prefix="grown_") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    sizes = descend(plain.select("_key", "_group"), leaves).groupBy("shard", "_group").agg(F.count("*").alias("n"))
    listed = sizes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_group", "n"))).alias("c"))
    running = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<_group:string,first:bigint>>").alias("firsts")), lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["firsts"], F.array(F.struct(x["_group"].alias("_group"), a["at"].alias("first")))).alias("firsts")))
    firsts = listed.select("shard", F.inline(running["firsts"]))
    within = F.row_number().over(Window.partitionBy("shard", "_group").orderBy("_order", "doc_id", "size", "text_crc32"))
    return rows.join(F.broadcast(firsts), ["shard", "_group"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + within - 1).alias("slot"), "grown_shard", "region", "rack"
    )


SHARDS = 8


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7; grown_shard is the shard when a ninth is added."""
    leaves = tree(SHARDS)
    return shard_documents(read(spark, sf_dir, "documents", "doc_id", "text"), leaves, grow(leaves))


def oracle_sql() -> str:
    """Level by level: the child with the least draw, for the tree of eight shards and for that of nine."""

    def least(path: str, weights: dict[int, int]) -> str:
        one = lambda n, w: f"{{'draw': -ln((('0x' || substr(md5(k || ':{path}{n}'), 1, 13))::BIGINT + 0.5) / {2**52}.0) / {w}.0, 'n': {n}}}"
        return f"least({', '.join(one(n, w) for n, w in weights.items())}).n"

    def cases(of: dict[str, str], otherwise: str) -> str:
        return "case " + " ".join(f"when {a} then {b}" for a, b in of.items()) + f" else {otherwise} end"

    racks = {a: least(f"{a}/", {0: 2, 1: 2}) for a in (0, 1)}
    shards = {(a, b): least(f"{a}/{b}/", {4 * a + 2 * b: 1, 4 * a + 2 * b + 1: 1}) for a in (0, 1) for b in (0, 1)}
    rack = lambda p: cases({f"{p}region = {a}": x for a, x in racks.items()}, "0")
    shard = lambda p: cases({f"{p}region = {a} and {p}rack = {b}": x for (a, b), x in shards.items()}, "8")
    return f"""
with step as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, {0xEDB88320}::bigint) else c >> 1 end)) as t256),
d as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, coalesce(text, '') as t from documents),
a as (select *, {least("", {0: 4, 1: 4})} as region, {least("", {0: 4, 1: 4, 2: 1})} as g_region from d),
b as (select *, {rack("")} as rack, {rack("g_")} as g_rack from a),
s as (select *, {shard("")} as shard, {shard("g_")} as grown_shard from b)
select doc_id, cast(strlen(t) + 1 as bigint) as size,
  xor(list_reduce(list_prepend({0xFFFFFFFF}::bigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(t256[(xor(c, b) & 255) + 1], c >> 8)), {0xFFFFFFFF}::bigint) as text_crc32,
  'key' as law, cast(shard as int) as shard, row_number() over (partition by shard order by md5(k), doc_id) - 1 as slot,
  cast(grown_shard as int) as grown_shard, cast(region as int) as region, cast(rack as int) as rack
from s, step"""
