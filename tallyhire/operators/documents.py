"""Model-written documents: from raw answers to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhire.functions.documents import career_prompt, decoded_pdf, is_strict_json, without_fences
from tallyhire.sources.schemas import ATS, CAREER


def cleaned(raw: DataFrame) -> DataFrame:
    """raw (doc_id, raw) with json (fences off) and ok (strict JSON)."""
    return raw.withColumn("json", without_fences(F.col("raw"))).withColumn("ok", is_strict_json("json"))


def parsed(raw: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    rows = cleaned(raw)
    good = rows.filter("ok").select("doc_id", F.from_json("json", schema).alias("doc"))
    return good, rows.filter("NOT ok").select("doc_id", "raw", F.when(F.coalesce("json", F.lit("")) == "", "empty").otherwise("invalid_json").alias("reason"))


def parse_career(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, doc), rejects (doc_id, raw, reason)) of career answers."""
    return parsed(raw, CAREER)


def parse_ats(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As parse_career, for ATS answers; a score beyond 0 to 100 is a reject, too."""
    good, rejects = parsed(raw, ATS)
    wrong = ~F.coalesce(F.col("doc.atsScore").between(0, 100), F.lit(False))
    texts = raw.select("doc_id", "raw")
    bad = good.filter(wrong).select("doc_id").join(texts, "doc_id").withColumn("reason", F.lit("bad_score"))
    return good.filter(~wrong), rejects.unionByName(bad)


def career_prompts(profiles: DataFrame) -> DataFrame:
    """(user_id, prompt) of the profiles that list a skill."""
    return profiles.filter(F.size("skills") > 0).select("user_id", career_prompt(F.col("skills")).alias("prompt"))


def decode_pdfs(df: DataFrame) -> DataFrame:
    """df (doc_id, pdf_base64) with content, null where it can't be decoded."""
    return df.withColumn("content", decoded_pdf(F.col("pdf_base64")))


def ats_summary(ats: DataFrame) -> DataFrame:
    """(dimension, n, mean_score, p10, median_score, p90) of parsed ATS documents, the total as dimension 'total'.

    The percentiles are exact: a score has few values, so each aggregate holds few counts.
    """
    parts = ats.select(F.explode(F.map_entries("doc.scoreBreakdown")).alias("e")).select(F.col("e.key").alias("dimension"), F.col("e.value.score").alias("score"))
    total = ats.select(F.lit("total").alias("dimension"), F.col("doc.atsScore").alias("score"))
    return parts.unionByName(total).groupBy("dimension").agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"), *(F.percentile("score", F.lit(q)).alias(name) for name, q in (("p10", 0.1), ("median_score", 0.5), ("p90", 0.9))))


def ats_issues(ats: DataFrame) -> DataFrame:
    """(priority, category, n) of the suggestions."""
    return ats.select(F.explode("doc.suggestions").alias("s")).groupBy("s.priority", "s.category").agg(F.count("*").alias("n"))
