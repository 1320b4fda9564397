"""Nested post records to flat catalog rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import keep_first


def first_text(json: Column, paths: Sequence[str]) -> Column:
    """First non-blank text among several JSON paths."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in paths], F.lit(""))


def tag_names(json: Column, path: str = "$.tags") -> Column:
    """Tag names, whether tags are a list or sit under ``data``, as texts or as objects."""
    listed = F.coalesce(F.get_json_object(json, f"{path}.data"), F.get_json_object(json, path))
    objects = F.from_json(listed, "array<struct<name:string,slug:string>>")
    names = F.transform(objects, lambda o: F.coalesce(F.nullif(o["name"], F.lit("")), F.nullif(o["slug"], F.lit(""))))
    # Texts do not parse as objects, so they are read as plain strings.
    plain = F.from_json(listed, "array<string>")
    is_object = F.coalesce(F.regexp_like(listed, F.lit(r"^\s*\[\s*\{")), F.lit(False))
    return F.filter(F.coalesce(F.when(is_object, names).otherwise(plain), F.array().cast("array<string>")),
                    lambda x: x.isNotNull() & (x != ""))


def flatten_posts(df: DataFrame, json: str, seq: str, base_url: str, default_category: str,
                  description: Sequence[str] = ("$.contents_short", "$.excerpt", "$.contents", "$.summary")) -> DataFrame:
    """Title, description, category, topics, author and link; one row per link, the first seen."""
    j = F.col(json)
    slug = first_text(j, ["$.slug"])
    rows = df.select(
        seq, first_text(j, ["$.title"]).alias("title"), first_text(j, description).alias("description"),
        tag_names(j).alias("_tags"), first_text(j, ["$.user.data.name", "$.user.name", "$.user.data.username", "$.user.username"])
        .alias("instructor"), F.when(slug != "", F.concat(F.lit(base_url), slug)).otherwise(first_text(j, ["$.url"])).alias("link"))
    rows = rows.filter(F.col("link") != "")
    kept = keep_first(rows, ["link"], [F.col(seq)])
    return kept.select(seq, "title", "description", F.coalesce(F.get("_tags", F.lit(0)), F.lit(default_category)).alias("category"),
                       F.array_join("_tags", ", ").alias("topics"), "instructor", "link")
