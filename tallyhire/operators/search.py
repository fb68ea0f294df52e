"""The search feed: active jobs with their companies, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhire.functions.text import contains_ilike

COLUMNS = ["job_id", "title", "description", "salary", "location", "job_type", "role", "work_location", "created_at"]


def active(jobs: DataFrame) -> DataFrame:
    """is_active must be true; null is not."""
    return jobs.filter(F.col("is_active"))


def term_filters(title: str | None, location: str | None) -> list[Column]:
    """A predicate for each term that is neither null nor ''."""
    return [contains_ilike(F.col(c), F.lit(term)) for c, term in (("title", title), ("location", location)) if term]


def search_jobs(jobs: DataFrame, companies: DataFrame, title: str | None = None, location: str | None = None, first: int | None = None) -> DataFrame:
    """The 12 columns of the feed. With `first`, a top-k instead of a full sort."""
    found = active(jobs)
    for condition in term_filters(title, location):
        found = found.filter(condition)
    names = companies.select("company_id", F.col("name").alias("company_name"), F.col("logo").alias("company_logo"))
    feed = found.select(*COLUMNS, "company_id").join(names, "company_id").select(*COLUMNS, "company_name", "company_logo", "company_id")
    feed = feed.orderBy(F.desc_nulls_first("created_at"), "job_id")
    return feed if first is None else feed.limit(first)


def grams(c: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a lower-cased text."""
    lower = F.lower(c)
    places = F.when(F.length(lower) >= n, F.sequence(F.lit(1), F.length(lower) - (n - 1)))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substring(lower, i, F.lit(n))))


def literal_run(term: Column) -> Column:
    """The longest run of ASCII without wildcards and escapes in a typed term: any text that fits must hold it, whatever its case."""
    runs = F.split(F.coalesce(term, F.lit("")), r"[^\x00-\x7f]|[%_\\]")
    return F.element_at(F.array_sort(runs, lambda a, b: F.length(a) - F.length(b)), -1)


def tagged(title: Column, location: Column) -> Column:
    return F.concat(F.transform(title, lambda g: F.concat(F.lit("t"), g)), F.transform(location, lambda g: F.concat(F.lit("l"), g)))


def by_rarest(asked: DataFrame, jobs: DataFrame, demanded: Column, held: Column, fits: Column) -> DataFrame:
    """(search_id, job_id): each search meets the jobs that hold the one of its demanded grams which fewest jobs hold, by an equi-join."""
    having = jobs.withColumn("gram", F.explode(held))
    counts = having.groupBy("gram").agg(F.count("*").alias("n"))
    each = asked.select("search_id", "title", "location", F.explode(demanded).alias("gram"))
    rarest = each.join(counts, "gram", "left").groupBy("search_id", "title", "location").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    return rarest.filter("best.n > 0").select("search_id", "title", "location", "best.gram").join(having, "gram").filter(fits).select("search_id", "job_id")


#: Jobs that meet wildcard searches in one task.
BLOCK = 200_000


def match_saved_searches(searches: DataFrame, jobs: DataFrame) -> DataFrame:
    """(search_id, job_id) of every saved search (search_id, title, location) and active job that fits it.

    A search meets only jobs that hold, of what its terms demand, the run of characters which fewest jobs hold: of three
    characters, or of one or two where its terms have no longer literal part. The patterns are checked on what meets;
    repeated searches count once. Searches of wildcards alone may match any job, so they meet them all, block by block.
    """
    jobs = active(jobs).select("job_id", F.col("title").alias("job_title"), F.col("location").alias("job_location"))
    run = lambda c: literal_run(F.col(c))
    asked = searches.select("search_id", "title", "location").distinct().withColumn("t", run("title")).withColumn("l", run("location"))
    asked = asked.withColumn("literal", F.greatest(F.length("t"), F.length("l")))
    fits = (F.coalesce(F.col("title") == "", F.lit(True)) | contains_ilike(F.col("job_title"), F.col("title"))) & (
        F.coalesce(F.col("location") == "", F.lit(True)) | contains_ilike(F.col("job_location"), F.col("location"))
    )
    several = lambda a, b, *sizes: F.concat(*(tagged(grams(F.col(a), n), grams(F.col(b), n)) for n in sizes))
    long = by_rarest(asked.filter("literal >= 3"), jobs, several("t", "l", 3), several("job_title", "job_location", 3), fits)
    short = by_rarest(asked.filter("literal BETWEEN 1 AND 2"), jobs, several("t", "l", 1, 2), several("job_title", "job_location", 1, 2), fits)
    open_ = asked.filter("literal = 0").select("search_id", "title", "location")
    blocks = max(1, -(-jobs.count() // BLOCK))
    every = open_.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = jobs.withColumn("block", F.pmod(F.xxhash64("job_id"), F.lit(blocks)).cast("int"))
    return long.union(short).union(every.join(dealt, "block").filter(fits).select("search_id", "job_id"))


def jobs_by_id(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The job of each id in ids (job_id); unknown ids give no row."""
    return jobs.join(ids.select("job_id").distinct(), "job_id")
