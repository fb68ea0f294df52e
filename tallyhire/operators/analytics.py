"""Totals, dashboards, skill matching and resume features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^A-Za-z0-9#+.]+"


def marketplace_totals(jobs: DataFrame, companies: DataFrame, users: DataFrame) -> DataFrame:
    """(measure, n): active jobs, companies, job seekers."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")

    return count(jobs.filter("is_active"), "active_jobs").unionByName(count(companies, "companies")).unionByName(count(users.filter("role = 'jobseeker'"), "job_seekers"))


def recruiter_rollup(applications: DataFrame, jobs: DataFrame) -> DataFrame:
    """By recruiter, company and job with subtotals: applications by status, subscribers, hired in whole parts of ten thousand, distinct applicants."""
    rows = applications.join(jobs.select("job_id", "company_id", F.col("posted_by_recruiter_id").alias("recruiter_id")), "job_id")
    return rows.rollup("recruiter_id", "company_id", "job_id").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("applications"), F.count_if(F.col("status") == "Submitted").alias("submitted"), F.count_if(F.col("status") == "Rejected").alias("rejected"),
        F.count_if(F.col("status") == "Hired").alias("hired"), F.count_if(F.coalesce("subscribed", F.lit(False))).alias("subscribed"), F.count_distinct("applicant_email").alias("applicants"),
    ).withColumn("hired_per_10000", F.floor(10000 * F.col("hired") / F.col("applications")))


def approximate_applicants(applications: DataFrame, rsd: float = 0.02) -> DataFrame:
    """(job_id, applicants) by a sketch of fixed size for each job."""
    return applications.groupBy("job_id").agg(F.approx_count_distinct("applicant_email", rsd).alias("applicants"))


def job_skills(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """(job_id, skill_id) of active jobs whose title or description has the skill's name as a whole word. Equi-join on words."""
    words = jobs.filter("is_active").select("job_id", F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "title", "description")), WORD))).alias("word"))
    return words.join(skills.select("skill_id", F.lower("name").alias("word")), "word").select("job_id", "skill_id").distinct()


def skill_job_match(jobs: DataFrame, skills: DataFrame, user_skills: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, place, job_id, matched, n_skills): each user's k best jobs by the number of the user's skills they ask for.

    Jobs that ask for one set of skills tie for every user, so each set keeps its k smallest job ids before users meet
    it: what a popular skill brings is bounded by the number of different sets, not of jobs.
    """
    asked = job_skills(jobs, skills)
    sets = asked.groupBy("job_id").agg(F.array_sort(F.collect_set("skill_id")).alias("set"))
    few = sets.withColumn("n", F.row_number().over(Window.partitionBy("set").orderBy("job_id"))).filter(F.col("n") <= k).select("job_id", "set")
    pairs = user_skills.join(few.select("job_id", F.explode("set").alias("skill_id")), "skill_id").groupBy("user_id", "job_id").agg(F.count("*").alias("matched"))
    total = user_skills.groupBy("user_id").agg(F.count("*").alias("n_skills"))
    best = Window.partitionBy("user_id").orderBy(F.desc("matched"), "job_id")
    return pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).join(total, "user_id").select("user_id", "place", "job_id", "matched", "n_skills")


def skills_to_learn(jobs: DataFrame, skills: DataFrame, user_skills: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, place, skill_id, wanted): skills the user lacks that most well-matching active jobs ask for.

    A job matches well if the user has at least half of the skills it asks for. Jobs that ask for one set of skills count
    together, so what a popular skill brings is bounded by the number of different sets.
    """
    sets = job_skills(jobs, skills).groupBy("job_id").agg(F.array_sort(F.collect_set("skill_id")).alias("set"))
    sets = sets.groupBy("set").agg(F.count("*").alias("n_jobs"))
    met = user_skills.join(sets.select("set", "n_jobs", F.explode("set").alias("skill_id")), "skill_id")
    met = met.groupBy("user_id", "set").agg(F.max("n_jobs").alias("n_jobs"), F.collect_set("skill_id").alias("has"))  # skills of one set
    lacks = met.filter(2 * F.size("has") >= F.size("set")).select("user_id", "n_jobs", F.explode(F.array_except("set", "has")).alias("skill_id"))
    wanted = lacks.groupBy("user_id", "skill_id").agg(F.sum("n_jobs").alias("wanted"))
    best = Window.partitionBy("user_id").orderBy(F.desc("wanted"), "skill_id")
    return wanted.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("user_id", "place", "skill_id", "wanted")


HEADINGS = r"(?im)^[ \t]*(experience|education|skills|projects|summary|certifications)\b"
VERBS = r"(?i)\b(led|built|managed|designed|created|improved|developed|delivered)\b"


def resume_features(resumes: DataFrame, text_col: str = "text") -> DataFrame:
    """resumes' doc_id with counts of what readers of resumes look for; null texts count nothing."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return resumes.select(
        "doc_id", count(HEADINGS).alias("headings"), text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("has_email"), text.rlike(r"\+?[0-9][0-9 ()-]{7,}[0-9]").alias("has_phone"),
        count(r"\b(19|20)[0-9]{2}\b").alias("years"), count(r"(?m)^[ \t]*[-*]\s").alias("bullets"), count(VERBS).alias("action_verbs"), count(r"[0-9]+").alias("numbers"),
    )


def premium_feed(matches: DataFrame, users: DataFrame, at: str) -> DataFrame:
    """Matches with a feed order in which users whose subscription is active at a time come first."""
    active = F.coalesce(F.col("subscription") > F.lit(at).cast("timestamp_ntz"), F.lit(False))
    return matches.join(users.select("user_id", active.alias("premium")), "user_id").orderBy(F.desc("premium"), "user_id", "place")


def mail_volume(events: DataFrame, ts: str = "ts", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, kind, n) of tumbling windows, or sliding ones."""
    by = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.groupBy(by.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def mail_sessions(events: DataFrame, ts: str = "ts", to: str = "to", gap: str = "30 minutes") -> DataFrame:
    """(to, start, end, n): each recipient's sessions, which end where the next mail is a gap or more away."""
    found = events.groupBy(F.session_window(ts, gap).alias("w"), to).agg(F.count("*").alias("n"))
    return found.select(to, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
