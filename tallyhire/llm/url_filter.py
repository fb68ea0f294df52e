"""URL filters by association rules.

Given host rules judge the urls they fit. Those verdicts are the labels from which FP-growth mines combinations of url
tokens; rules `tokens -> verdict` that are frequent and sure enough, and surer than any rule on part of their tokens,
judge the rest by an inverted index: each rule hangs on one of its tokens, a url looks up its own tokens and then checks
the few rules found. Urls that no rule of either kind fits get the default verdict.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhire.llm.common import keep, small_side

BLOCK, ALLOW = "block", "allow"
#: Marks the verdicts among the items of a transaction; no url token holds a blank.
VERDICT = "verdict "


@dataclass(frozen=True)
class HostRule:
    """Fits urls whose host is `host` or below it and whose path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or without ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def literal(value: object, schema: str) -> Column:
    """A constant of any type, parsed once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def suffixes(host: Column) -> Column:
    """The host and the hosts above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_for(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does. A lookup of each host suffix, no join."""
    by_host: dict[str, list[dict[str, str]]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append({"path": r.path, "rule": r.text, "verdict": r.verdict})
    index = literal(by_host, "map<string,array<struct<path:string,rule:string,verdict:string>>>")
    # an absent host looks up null, which flatten must not see
    none = F.array().cast("array<struct<path:string,rule:string,verdict:string>>")
    found = F.flatten(F.transform(suffixes(host), lambda s: F.coalesce(F.try_element_at(index, s), none)))
    fitting = F.filter(found, lambda r: path.startswith(r["path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(longest.isNotNull(), F.struct(longest["rule"].alias("rule"), longest["verdict"].alias("verdict")))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens that say where they stand: scheme, host labels and suffixes, path parts, query keys, and kinds of parts."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.lower(path), r"[/._\-]+"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "[&;]"), lambda kv: F.regexp_extract(kv, "^([^=]*)", 1)), lambda x: x != "")
    numbers = F.exists(parts, lambda x: x.rlike("^[0-9]+$"))
    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1)))),
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.when(F.size(labels) > 0, F.array(F.concat(F.lit("tld="), F.element_at(labels, -1)), F.concat(F.lit("labels="), F.size(labels).cast("string")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(parts, lambda x: ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("path="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("query="), F.lower(x))),
        F.when(numbers, F.array(F.lit("kind=number"))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("kind=fragment"))).otherwise(F.array().cast("array<string>")),
    ))


def leads(labelled: DataFrame, least: int, alike: float) -> list[str]:
    """The frequent tokens of (tokens) but those that nearly always go together with a more frequent one.

    Two tokens are alike if they occur together in the share `alike` of the rows with either. Tokens are taken by falling
    number of rows, then by text; one that is like a lead before it is none itself. So paths that many urls share don't make
    all their subsets frequent. The driver gets frequent tokens and alike pairs of them: at most (tokens of a url) /
    min_support tokens, however many rows there are.
    """
    counts = {r["token"]: r["n"] for r in labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()}
    kept = labelled.select(F.array_sort(F.array_intersect("tokens", literal(sorted(counts), "array<string>"))).alias("kept"))
    pairs = F.flatten(F.transform("kept", lambda x, i: F.transform(F.slice("kept", i + 2, F.size("kept")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    both = kept.filter(F.size("kept") > 1).select(F.explode(pairs).alias("p")).groupBy("p.x", "p.y").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    sizes = labelled.sparkSession.createDataFrame(sorted(counts.items()), "token string, n long")
    sized = both.join(F.broadcast(sizes.toDF("x", "n_x")), "x").join(F.broadcast(sizes.toDF("y", "n_y")), "y")
    near: dict[str, set[str]] = {}
    for r in sized.filter(F.col("n") >= alike * (F.col("n_x") + F.col("n_y") - F.col("n"))).select("x", "y").collect():
        near.setdefault(r["x"], set()).add(r["y"])
        near.setdefault(r["y"], set()).add(r["x"])
    out: list[str] = []
    for token in sorted(counts, key=lambda t: (-counts[t], t)):
        if not near.get(token, set()) & set(out):
            out.append(token)
    return sorted(out)


def rules_of(transactions: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, alike: float = 0.9) -> DataFrame:
    """All rules (tokens, verdict, confidence, support) from (tokens, verdict) that support and confidence leave.

    FP-growth finds the frequent sets of leads (see leads), single tokens and larger ones, with and without a verdict. A rule
    is dropped if one on part of its tokens with the same verdict is as sure: sets are taken by size, and each learns from
    those with one token less what the surest of its parts is.
    """
    labelled = transactions.filter(F.col("verdict").isNotNull()).select(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())).alias("tokens"), "verdict")
    least = max(1, math.ceil(labelled.count() * min_support))
    mined = F.array_intersect("tokens", literal(leads(labelled, least, alike), "array<string>"))
    items = labelled.select(F.array_union(mined, F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.withColumn("head", F.filter("items", lambda x: x.startswith(VERDICT))).withColumn("tokens", F.array_sort(F.filter("items", lambda x: ~x.startswith(VERDICT))))
    plain = sets.filter(F.size("head") == 0).select("tokens", F.col("freq").alias("all"))
    heads = sets.filter((F.size("head") == 1) & (F.size("tokens") > 0)).select("tokens", F.expr(f"substring(head[0], {len(VERDICT) + 1})").alias("verdict"), "freq")
    sure = keep(heads.join(plain, "tokens").select("tokens", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), F.col("freq").alias("support")))
    largest = sure.agg(F.max(F.size("tokens"))).first()[0] or 0
    done = sure.filter(F.size("tokens") == 1).withColumn("by_part", F.lit(0.0))
    found = done
    for size in range(2, largest + 1):
        one_less = F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))
        parts = sure.filter(F.size("tokens") == size).withColumn("part", F.explode(one_less))
        surest = done.select(F.col("tokens").alias("part"), "verdict", F.greatest("confidence", "by_part").alias("of_part"))
        known = parts.join(surest, ["part", "verdict"]).groupBy("tokens", "verdict", "confidence", "support").agg(F.max("of_part").alias("by_part"))
        done = keep(known)
        found = found.unionByName(done)
    return found.filter((F.col("confidence") >= min_confidence) & (F.col("by_part") < F.col("confidence"))).drop("by_part")


def mine(transactions: DataFrame, **mining) -> list[dict]:
    """The rules of rules_of, best first."""
    found = [r.asDict() for r in rules_of(transactions, **mining).collect()]
    return sorted(found, key=lambda r: (-r["confidence"], -r["support"], len(r["tokens"]), r["tokens"], r["verdict"]))


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, mined): for the urls (row, tokens) that a rule fits, the verdict of the best one.

    An inverted index: each rule hangs on the one of its tokens that fewest rules have; a url's tokens are looked up by a
    join, and what is found is checked. The index is broadcast only up to a bounded number of rules.
    """
    each = rules.withColumn("token", F.explode("tokens"))
    uses = each.groupBy("token").agg(F.count("*").alias("uses"))
    at = each.join(uses, "token").groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("uses", "token")).alias("rarest"))
    index = keep(at.select(F.col("rarest.token").alias("token"), F.col("tokens").alias("need"), "verdict", "confidence", "support"))
    looked = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(small_side(index, 100_000), "token")
    firing = looked.filter(F.size(F.array_except("need", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), F.size("need").alias("c"), "need", "verdict"))
    return firing.groupBy("row").agg(best.alias("best")).select("row", F.col("best.verdict").alias("mined"))


def judge(pages: DataFrame, rules: list[HostRule], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, **mining) -> DataFrame:
    """(id, host, path, rule, verdict, mined) of every url; mined is the mined rules' verdict, where one fires.

    Null urls, and those without ://, have empty host and path and the default verdict, if no rule fits the empty host.
    Repeated rows and null ids are kept as they come; other columns are dropped, whatever their names. An empty table gives
    no rows.
    """
    url = F.col(url_col)
    cut = pages.select(F.col(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = cut.withColumn("given", rule_for(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    rows = keep(known.select(id_col, "host", "path", "given", "tokens").withColumn("row", F.monotonically_increasing_id()))
    mined = mined_verdicts(rows, rules_of(rows.select("tokens", F.col("given.verdict").alias("verdict")), **mining))
    told = rows.drop("tokens").join(mined, "row", "left")
    return told.select(id_col, "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "mined", F.lit(default)).alias("verdict"), "mined")
