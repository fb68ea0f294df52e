"""User profiles without secrets, with skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE = ["user_id", "name", "email", "phone_number", "role", "bio", "resume", "resume_public_id", "profile_pic", "profile_pic_public_id", "subscription"]


def public_profile(users: DataFrame) -> DataFrame:
    """All profile columns, never the password."""
    return users.select(PROFILE)


def user_profiles(users: DataFrame, user_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """public_profile with skills: a sorted array, empty without any. The bridge is aggregated before the users join it."""
    named = user_skills.join(skills, "skill_id").groupBy("user_id").agg(F.sort_array(F.collect_list("name")).alias("skills"))
    return public_profile(users).join(named, "user_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
