"""Profiles, stated preferences and openings derived from `customer` and `part`: invented people, as in any staffing tool's test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sample_log import read

SKILLS = ("Java", "Scala", "SQL", "Python", "Distributed Systems", "Storage-Systems", "CI/CD", "Consensus")
AREAS = ("backend", "data", "devops")
DAYS = ("mon", "tue", "wed", "thu", "fri")
SHIFTS = ("morning", "afternoon", "evening", "flexible")
#: token, skills, areas
TAXONOMY = (("stream", ["Java", "Distributed Systems"], ["backend"]), ("streams-core", ["Scala", "Consensus"], ["backend", "data"]), ("table", ["sql"], ["data"]), ("tools", ["CI/CD"], ["devops"]), ("docs", ["Python"], []))
LANGUAGES = (("org/r0", ["Java", "Scala"]), ("org/r1", ["Python"]))
NAMES = ("streams-core", "stream-lib", "table-api", "tools", "docs", "unassigned", "web")


def pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), "c_name")
    i = F.col("i")
    return c.select(
        F.concat(F.lit("emp-"), i).alias("employee_id"), F.col("c_name").alias("name"), F.array(pick(SKILLS, i), pick(SKILLS, i * 3 + 1)).alias("skills"), F.array(F.concat(F.lit("Rebuilt "), pick(SKILLS, i * 5))).alias("projects"),
        F.array(F.concat(F.lit("years of "), pick(SKILLS, i + 2))).alias("experience"), (i % 13).cast("double").alias("years_experience"), F.array(pick(NAMES, i)).alias("familiar_components"),
        F.concat(F.lit("L"), i % 4).alias("location"), F.array(F.concat(F.lit("L"), (i + 1) % 4)).alias("preferred_locations"), (i % 3 != 0).alias("open_to_relocation"), F.array(F.concat(F.lit("org/r"), i % 2, F.lit("/"), pick(NAMES, i))).alias("preferred_components"),
        F.concat(F.lit("org/r"), i % 2).alias("repo"), F.concat(F.lit("c"), i % 10).alias("component"),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh person has stated none."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i")).where("i % 7 != 0")
    i = F.col("i")
    days = F.filter(F.array(*[F.when((i + d) % 4 != 0, name) for d, name in enumerate(DAYS)]), lambda x: x.isNotNull())
    return c.select(F.concat(F.lit("emp-"), i).alias("employee_id"), pick(SHIFTS, i).alias("preferred_shift"), F.array(pick(AREAS, i)).alias("work_areas"), days.alias("availability"), (i % 5 != 0).alias("open_to_other_teams"), (i % 11).alias("submitted_at"))


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opening per nation."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"))
    i = F.col("i")
    none = F.lit(None).cast("array<string>")
    return n.select(
        F.concat(F.lit("open-"), i).alias("opening_id"), F.concat(F.lit("org/r"), i % 2).alias("repo"), pick(NAMES, i).alias("component"), F.concat(F.lit("L"), i % 4).alias("location"),
        F.when(i % 6 == 5, F.array(F.lit(" "), F.lit("SQL"), F.lit("java"))).otherwise(none).alias("required_skills"), pick((*SHIFTS, "night"), i).alias("shift"), F.when(i % 3 == 0, F.array(F.lit("mon"), F.lit("sun"), F.lit("thu"))).otherwise(none).alias("availability"),
    )


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAXONOMY), "token string, skills array<string>, areas array<string>")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES), "repo string, languages array<string>")
