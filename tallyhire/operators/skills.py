"""Adding and removing skills by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhire.functions.text import is_falsy, trimmed
from tallyhire.operators.applications import dedup_first, first_reason
from tallyhire.operators.lifecycle import ORDER, new_ids, split, too_long


def named(requests: DataFrame, users: DataFrame) -> DataFrame:
    rows = requests.withColumn("skill", trimmed(F.col("skill_name"))).join(users.select("user_id", F.lit(True).alias("known")), "user_id", "left")
    return rows.withColumn("reject", first_reason((is_falsy(F.col("skill")), 400, "blank_skill"), (F.col("known").isNull(), 404, "user_not_found"), (too_long(skill=100), 400, "too_long"))).drop("known")


def add_skills(skills: DataFrame, user_skills: DataFrame, users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(skills, user_skills, results (request_id, user_id, skill, outcome), rejects) for requests (request_id, user_id, skill_name, requested_at).

    Names are trimmed and compared exactly; unknown ones become skills. outcome: 'added', or 'already_had' for a link
    that was there or that an earlier request of the batch made. Applying a batch twice changes nothing more.
    """
    good, rejects = split(named(requests, users))
    fresh = good.select(F.col("skill").alias("name")).distinct().join(skills.select("name"), "name", "left_anti")
    all_skills = skills.select("skill_id", "name").unionByName(new_ids(fresh, "skill_id", ["name"], skills).select("skill_id", "name"))
    first = dedup_first(good.select("user_id", "skill", *ORDER), ["user_id", "skill"], ORDER).select("user_id", "skill", F.col("request_id").alias("first_request"))
    had = user_skills.join(skills, "skill_id").select("user_id", F.col("name").alias("skill"), F.lit(True).alias("had"))
    results = good.join(first, ["user_id", "skill"]).join(had, ["user_id", "skill"], "left").select(
        "request_id", "user_id", "skill", F.when(F.col("had") | (F.col("request_id") != F.col("first_request")), "already_had").otherwise("added").alias("outcome"),
    )
    pairs = good.select("user_id", F.col("skill").alias("name")).distinct().join(all_skills, "name").select("user_id", "skill_id")
    links = user_skills.select("user_id", "skill_id").unionByName(pairs.join(user_skills, ["user_id", "skill_id"], "left_anti"))
    return all_skills, links, results, rejects


def remove_skills(skills: DataFrame, user_skills: DataFrame, users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_skills, rejects): links whose skill has the trimmed name go; the second request for one link is a reject."""
    have = user_skills.join(skills, "skill_id").select("user_id", F.col("name").alias("skill"), "skill_id")
    rows = named(requests, users).join(have, ["user_id", "skill"], "left")
    first = dedup_first(rows.filter("reject IS NULL AND skill_id IS NOT NULL").select("user_id", "skill", *ORDER), ["user_id", "skill"], ORDER).select("user_id", "skill", F.col("request_id").alias("first_request"))
    rows = rows.join(first, ["user_id", "skill"], "left")
    absent = F.struct(F.lit(404).alias("code"), F.lit("skill_not_linked").alias("reason"))
    lost = F.col("skill_id").isNull() | (F.col("request_id") != F.col("first_request"))
    good, rejects = split(rows.withColumn("reject", F.coalesce("reject", F.when(lost, absent))))
    return user_skills.join(good.select("user_id", "skill_id"), ["user_id", "skill_id"], "left_anti"), rejects
