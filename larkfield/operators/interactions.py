"""Learner interactions: one event table out of enrolments and lesson progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import keep_first

REAL_STATES = ("in_progress", "completed")


def enrolment_events(enrolments: DataFrame) -> DataFrame:
    """Enrolments that are real interactions; bookmarks are left out."""
    return (enrolments.na.drop(subset=["user_id", "course_id", "status"])
            .filter(F.col("status").isin(*REAL_STATES))
            .select("user_id", F.col("course_id").alias("item_id"), F.col("status").alias("event_type"),
                    F.col("updated_at").alias("event_time")))


def lesson_events(progress: DataFrame, lessons: DataFrame) -> DataFrame:
    """Finished lessons as events of their course."""
    done = progress.na.drop(subset=["user_id", "lesson_id", "completed_at"])
    return done.join(lessons.select("lesson_id", "course_id"), "lesson_id").select(
        "user_id", F.col("course_id").alias("item_id"), F.lit("lesson_completed").alias("event_type"),
        F.col("completed_at").alias("event_time"))


def interaction_events(enrolments: DataFrame, progress: DataFrame, lessons: DataFrame) -> DataFrame:
    """Union of both sources, the earliest event per user, item and type."""
    union = enrolment_events(enrolments).unionByName(lesson_events(progress, lessons))
    return keep_first(union, ["user_id", "item_id", "event_type"], [F.col("event_time")])


def fact_interaction(events: DataFrame, courses: DataFrame) -> DataFrame:
    """Events with the course category (null when the course is unknown)."""
    return events.join(courses.select("item_id", "category"), "item_id", "left").select(
        "user_id", "item_id", "category", "event_type", "event_time")


def distinct_pairs(fact: DataFrame, min_users: int) -> DataFrame:
    """Distinct user-item pairs, empty when fewer than ``min_users`` users interact."""
    pairs = fact.filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()).select(
        "user_id", "item_id").distinct()
    users = pairs.agg(F.countDistinct("user_id").alias("v")).scalar()
    return pairs.filter(users >= min_users)


def course_progress(lessons: DataFrame, progress: DataFrame) -> DataFrame:
    """Finished lessons against approved lessons per user and course, percent and status tier."""
    totals = lessons.filter("approved").groupBy("course_id").agg(F.count(F.lit(1)).alias("total"))
    done = (progress.select("user_id", "lesson_id").distinct().join(lessons, "lesson_id")
            .groupBy("user_id", "course_id").agg(F.count(F.lit(1)).alias("done")))
    joined = done.join(totals, "course_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    percent = F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total") * 100)).otherwise(0).cast("int")
    return joined.select("user_id", "course_id", "done", "total", percent.alias("progress")).withColumn(
        "status", F.when(F.col("progress") >= 100, "completed").when(F.col("progress") > 0, "in_progress")
        .otherwise("saved"))


def request_report(log: DataFrame, route: str, latency: str, is_error) -> DataFrame:
    """Requests, latency and errors per route."""
    return log.groupBy(route).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(latency).alias("mean_latency"),
        F.max(latency).alias("max_latency"), F.count_if(is_error).alias("errors"))
