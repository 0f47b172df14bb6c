"""The document row and its derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "id string, text string, label int, source string, attack_type string, domain string, length int, `group` string, meta string"


def draw(*parts: Column) -> Column:
    """A uniform integer below 2^28 from the md5 of the parts joined by ``|``: the seeded randomness of every operator."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")


def make_rows(df: DataFrame) -> DataFrame:
    """Fills ``length`` with the code points of the text, an empty ``group`` with the id, and casts the label."""
    return (
        df.withColumn("length", F.length("text"))
        .withColumn("group", F.coalesce(F.when(F.col("group") != "", F.col("group")), F.col("id")))
        .withColumn("label", F.col("label").cast("int"))
    )


def parse_meta(meta: Column) -> Column:
    """``k=v|k=v`` to a map: parts without ``=`` are skipped, the first ``=`` splits, the last of equal keys wins."""
    parts = F.filter(F.split(F.coalesce(meta, F.lit("")), r"\|"), lambda p: F.instr(p, "=") > 0)
    last = F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"), i.alias("i")))
    kept = F.filter(last, lambda x: ~F.exists(last, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))))


def source_group(source: Column) -> Column:
    return F.when(source.startswith("pds"), "pds").otherwise(source)


def length_bucket(n: Column) -> Column:
    return F.when(n < 500, "short").when(n < 2000, "medium").otherwise("long")
