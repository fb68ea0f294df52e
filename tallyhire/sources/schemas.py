"""Schemas and limits of the six portal tables, the mail event and the model-written documents."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, TS, B = T.StringType(), T.LongType(), T.TimestampNTZType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TABLES: dict[str, T.StructType] = {
    "users": struct(user_id=L, name=S, email=S, phone_number=S, role=S, bio=S, resume=S, resume_public_id=S, profile_pic=S, profile_pic_public_id=S, created_at=TS, subscription=TS),
    "skills": struct(skill_id=L, name=S),
    "user_skills": struct(user_id=L, skill_id=L),
    "companies": struct(company_id=L, name=S, description=S, website=S, logo=S, logo_public_id=S, recruiter_id=L, created_at=TS),
    "jobs": struct(job_id=L, title=S, description=S, salary=T.DecimalType(10, 2), location=S, job_type=S, openings=T.DecimalType(3, 1), role=S, work_location=S, company_id=L, posted_by_recruiter_id=L, created_at=TS, is_active=B),
    "applications": struct(application_id=S, job_id=L, applicant_email=S, status=S, resume=S, applied_at=TS, subscribed=B),
}
KEYS = {"users": ["user_id"], "skills": ["skill_id"], "user_skills": ["user_id", "skill_id"], "companies": ["company_id"], "jobs": ["job_id"], "applications": ["application_id"]}
#: Declared references, whose rows go with their parent's: child table and column, parent table and column.
FOREIGN_KEYS = [("jobs", "company_id", "companies", "company_id"), ("applications", "job_id", "jobs", "job_id"), ("user_skills", "user_id", "users", "user_id"), ("user_skills", "skill_id", "skills", "skill_id")]

# The enumerations of the portal's tables.
USER_ROLES = ["jobseeker", "recruiter"]
JOB_TYPES = ["Full-time", "Part-time", "Contract", "Internship"]
WORK_LOCATIONS = ["On-site", "Remote", "Hybrid"]
STATUSES = ["Submitted", "Rejected", "Hired"]

MAIL = struct(to=S, subject=S, html=S)
CAREER = T.StructType([
    T.StructField("summary", S),
    T.StructField("jobOptions", T.ArrayType(struct(title=S, responsibilities=S, why=S))),
    T.StructField("skillsToLearn", T.ArrayType(struct(category=S, skills=T.ArrayType(struct(title=S, why=S, how=S))))),
    T.StructField("learningApproach", struct(title=S, points=T.ArrayType(S))),
])
SCORE = struct(score=T.IntegerType(), feedback=S)
ATS = T.StructType([
    T.StructField("atsScore", T.IntegerType()),
    T.StructField("scoreBreakdown", T.MapType(S, SCORE)),
    T.StructField("suggestions", T.ArrayType(struct(category=S, issue=S, recommendation=S, priority=S))),
    T.StructField("strengths", T.ArrayType(S)),
    T.StructField("summary", S),
])
