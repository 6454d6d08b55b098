"""Reading and writing of record families, truth and match lists.

Missing text is the empty string throughout: the CSV reader turns empty fields
into nulls, so they are filled after every scan.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Tab-separated, with a header, all strings, quotes kept as they are."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema=", ".join(f"`{c}` string" for c in columns))
    return df.fillna("")


def read_family(spark: SparkSession, directory: str, family: str) -> DataFrame:
    """Sources 1 to 3 of a family (``{family}_source{k}.tsv``) with ``source``."""
    out = None
    for k in (1, 2, 3):
        one = read_tsv(spark, f"{directory}/{family}_source{k}.tsv", RAW).withColumn("source", F.lit(k).cast("byte"))
        out = one if out is None else out.unionByName(one)
    return out


def split_ids(column: Column) -> Column:
    """A comma-joined list as an array without empty items."""
    return F.filter(F.split(column, ","), lambda x: x != "")


def read_lists(spark: SparkSession, path: str, key: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(s, ids): one row per key, also where the list is empty."""
    return read_tsv(spark, path, (key, ids)).select(F.col(key).alias("s"), split_ids(F.col(ids)).alias("ids"))


def list_pairs(lists: DataFrame) -> DataFrame:
    """(s, c); a key without ids gives no pair."""
    return lists.select("s", F.explode("ids").alias("c"))


def collect_lists(entities: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(s, name): sorted distinct ids joined by commas, empty for entities without any."""
    got = pairs.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias(name))
    return entities.select("s").join(got, "s", "left").fillna("", [name])


def submission(entities: DataFrame, predictions: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match and candidate lists in the order of ``entities`` (s, pos); only candidates can be matches."""
    real = predictions.select("s", "c").join(candidates.select("s", "c").distinct(), ["s", "c"], "left_semi")
    def ordered(pairs: DataFrame, name: str) -> DataFrame:
        return entities.join(collect_lists(entities, pairs, name), "s").orderBy("pos").select(F.col("s").alias("source1_entity_id"), name)

    return ordered(real, "matched_entity_ids"), ordered(candidates, "candidate_entity_ids")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def splice(lists: DataFrame, candidates: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add matches (s, c) to pair tables of matches and candidates; a taken record is never touched, and what is added becomes a candidate."""
    free = extra.select("s", "c").distinct().join(lists.select("c"), "c", "left_anti").select("s", "c")
    return lists.select("s", "c").unionByName(free).distinct(), candidates.select("s", "c").unionByName(free).distinct()


def check_submission(matches: DataFrame, candidates: DataFrame, entities: DataFrame) -> list[str]:
    """What is wrong with two list tables: rows, order of ids, matches that are no candidates, records with two owners."""
    m, c = (d.toDF("s", "ids").withColumn("ids", split_ids(F.col("ids"))) for d in (matches, candidates))
    pairs, cands = list_pairs(m), list_pairs(c)
    found = {
        "not one row per entity": m.groupBy("s").count().where("count > 1").limit(1).count() + m.select("s").exceptAll(entities.select("s")).limit(1).count() + entities.select("s").exceptAll(m.select("s")).limit(1).count(),
        "ids not sorted": m.where(F.array_sort("ids") != F.col("ids")).limit(1).count(),
        "a match is no candidate": pairs.join(cands, ["s", "c"], "left_anti").limit(1).count(),
        "a record has two owners": pairs.groupBy("c").count().where("count > 1").limit(1).count(),
    }
    return [k for k, n in found.items() if n]


def log_metrics(path: str, section: str, data: dict) -> None:
    """Set a section of a JSON file of metrics."""
    p = Path(path)
    held = json.loads(p.read_text()) if p.exists() else {}
    p.write_text(json.dumps(held | {section: data}, indent=1, sort_keys=True))


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A small result as a Markdown table."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in df.limit(rows).collect())])
