"""Skill graphs: gaps, next steps, effort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import top_per_group


def skill_gap(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Roadmap skills a user lacks: ``wanted(user_id, skill, ord)`` minus ``known(user_id, skill)``, first place each."""
    first = wanted.groupBy("user_id", "skill").agg(F.min("ord").alias("ord"))
    return first.join(known.select("user_id", "skill"), ["user_id", "skill"], "left_anti")


def next_skills(known: DataFrame, edges: DataFrame, n: int = 6) -> DataFrame:
    """One step along the graph from known skills, without known ones, in first-seen order.

    ``known(user_id, skill, place)``, ``edges(src, dst, ord)``.
    """
    steps = (known.join(edges, known["skill"] == edges["src"])
             .groupBy("user_id", "dst").agg(F.min(F.struct("place", "ord")).alias("seen")))
    fresh = steps.join(known.select("user_id", F.col("skill").alias("dst")), ["user_id", "dst"], "left_anti")
    return top_per_group(fresh, ["user_id"], [F.col("seen"), F.col("dst")], n).select(
        "user_id", F.col("dst").alias("skill"), "rank")


def roadmap_effort(roadmap: DataFrame, hours_per_skill: int = 35) -> DataFrame:
    """Hours per role and the range of months at 12 and 8 hours a week."""
    hours = F.count(F.lit(1)) * hours_per_skill
    return roadmap.groupBy("role").agg(F.count(F.lit(1)).alias("n_skills"), hours.alias("hours")).select(
        "role", "n_skills", "hours", F.rint(F.col("hours") / 12 / 4.3).cast("int").alias("months_low"),
        F.rint(F.col("hours") / 8 / 4.3).cast("int").alias("months_high"))
