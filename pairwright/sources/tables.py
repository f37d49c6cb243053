"""Readers and writers of record tables, pairs and run logs."""

from __future__ import annotations

import codecs
import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize

PAIRS = T.StructType([T.StructField("idxA", T.StringType()), T.StructField("idxB", T.StringType()), T.StructField("label", T.IntegerType())])


def sniff(head: str) -> str:
    """The separator of a delimited text by its first lines; a comma if nothing else fits."""
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_records(spark: SparkSession, path: str, encoding: str = "utf-8", separator: str | None = None, multi_line: bool = True) -> DataFrame:
    """A delimited file with a header, every column as the text in the file; tokens that mean missing become null.

    Without a separator one is sniffed from the first lines, which Spark reads, so any file system will do.
    A file that isn't there raises.  multi_line lets a quoted field hold line breaks, but makes a file one task: turn
    it off for large files without them, which then split.
    """
    encoding = codecs.lookup(encoding).name.replace("iso8859", "iso-8859")
    if separator is None:
        separator = sniff("\n".join(r.value for r in spark.read.option("encoding", encoding).text(path).limit(20).collect()))
    read = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    return read.select(*(F.when(F.col(f"`{c}`").isin(*normalize.NA_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in read.columns))


@dataclass(frozen=True)
class Dataset:
    """Two record tables, the pairs known to match, how to block them and how to select attributes."""

    name: str
    path_a: str
    path_b: str
    path_gold: str
    id_a: str = "id"
    id_b: str = "id"
    gold_a: str = "ltable_id"
    gold_b: str = "rtable_id"
    encoding: str = "utf-8"
    tables: int = 5
    planes: int = 8
    flips: int = 1
    top_k: int = 5
    profile_size: int = 20
    mass: float = 0.8
    min_k: int = 2
    max_k: int | None = 5
    required_roles: tuple[str, ...] = ("identity",)
    normalise: bool = True


def registry(base: str) -> dict[str, Dataset]:
    """The three public benchmark datasets under a folder."""
    at = lambda d, f: f"{base}/{d}/{f}"
    return {
        "fodors-zagat": Dataset("fodors-zagat", at("fodors-zagat", "tableA.csv"), at("fodors-zagat", "tableB.csv"), at("fodors-zagat", "gold.csv")),
        "amazon-walmart": Dataset("amazon-walmart", at("amazon-walmart", "amazon.csv"), at("amazon-walmart", "walmart.csv"), at("amazon-walmart", "gold.tsv"), gold_a="id1", gold_b="id2", tables=10, planes=4, profile_size=50),
        "dblp-acm": Dataset("dblp-acm", at("dblp-acm", "DBLP.csv"), at("dblp-acm", "ACM.csv"), at("dblp-acm", "gold.csv"), gold_a="idDBLP", gold_b="idACM", encoding="latin1", tables=15, planes=8, profile_size=50),
    }


def choose(names: str, known: dict[str, Dataset]) -> list[Dataset]:
    """Datasets by names with commas between, or `all`."""
    wanted = list(known) if names.strip() == "all" else [n.strip() for n in names.split(",") if n.strip()]
    if unknown := [n for n in wanted if n not in known]:
        raise ValueError(f"unknown datasets: {', '.join(unknown)}")
    return [known[n] for n in wanted]


def integers(text: str) -> list[int]:
    """Whole numbers with commas between; at least one."""
    found = [int(x) for x in text.split(",") if x.strip()]
    if not found:
        raise ValueError("no number given")
    return found


def load(spark: SparkSession, dataset: Dataset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(A, B, gold): records under `id` with their columns, and pairs (idA, idB) whose ids both exist."""
    from ..operators.pairs import gold_pairs

    def side(path: str, key: str) -> DataFrame:
        df = read_records(spark, path, dataset.encoding).withColumnRenamed(key, "id").withColumn("id", normalize.record_key(F.col("id")))
        return normalize.records(df, skip=("id",)) if dataset.normalise else df

    a, b = side(dataset.path_a, dataset.id_a), side(dataset.path_b, dataset.id_b)
    gold = read_records(spark, dataset.path_gold, dataset.encoding).select(F.col(dataset.gold_a).alias("idA"), F.col(dataset.gold_b).alias("idB"))
    return a, b, gold_pairs(gold, a, b)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(PAIRS).csv(path)


def write_sweep(results: DataFrame, path: str) -> None:
    """Sweep results, best first within a dataset."""
    results.orderBy("dataset", F.desc("pair_completeness"), "candidate_pairs", "elapsed_seconds").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_run(results: DataFrame, summary: DataFrame, base: str, name: str) -> None:
    """A run's results as delimited text and its summary as JSON, in the dataset's own folder."""
    flat = [F.to_json(c).alias(c) if isinstance(results.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in results.columns]
    results.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{base}/{name}/final_results")
    summary.coalesce(1).write.mode("overwrite").json(f"{base}/{name}/run_summary")
