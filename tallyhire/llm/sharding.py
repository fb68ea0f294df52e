"""Sharding by balanced label propagation.

Documents are linked where their texts are equal. Labels are shards: in each round a join of the groups' shares with the
shards' loads gives every share of a group the shard where most of its neighbours are and room is left, and the shares
move there as far as the shard's quota lets them, until none wants to move. Cut links fall round by round; documents
without links then fill the shards to sizes at most one row apart. Groups larger than a quota have whole shards from the
start, and one for the rest.

Copies of one text are interchangeable, so the state is a row for each (text, shard), not for each document, and only
counts by shard go to the driver.
"""

from __future__ import annotations

from collections import Counter
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhire.llm.common import drop_kept, keep

#: Parts of a group of copies; rows of a part of the unlinked rows (or of a shard) that one window ranks, and least number of parts.
SALTS, BUCKET_ROWS, LEAST_BUCKETS = 256, 100_000, 256


def numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def running(rows: DataFrame, by: str, weight: str, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """rows with `before`: the sum of weight over earlier rows of the same `by` (0 to shards - 1), in the order of (bucket, link).

    Sums by (by, bucket) give each bucket's start; a window runs in each bucket only.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("link"), F.lit(buckets)))
    sums = rows.groupBy(by, "bucket").agg(F.sum(weight).alias("s"))
    starts = sums.withColumn("start", F.sum("s").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).drop("s")
    inside = Window.partitionBy(by, "bucket").orderBy("link").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum(weight).over(inside) - F.col(weight)).join(starts, [by, "bucket"])
    return rows.withColumn("before", F.col("start") + F.col("inside")).drop("start", "inside", "bucket")


def propagate(shares: DataFrame, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """(link, shard, n) after label propagation under the quotas: until no share wants to move, or after so many rounds.

    It comes to an end by itself. A share of n rows moves only where its group has as many or more, so each round raises
    the sum of the squared shares; and as only shards with room are wished for, a round with wishes moves a row at least.
    """
    for _ in count() if rounds is None else range(rounds):
        load = {r["shard"]: r["n"] for r in shares.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - load.get(s, 0) for s, q in enumerate(quotas)]
        group = Window.partitionBy("link")
        has_room = F.element_at(numbers(room), F.col("shard") + 1) > 0
        best = F.max(F.when(has_room, F.struct(F.col("n").alias("most"), (-F.col("shard")).alias("to")))).over(group)
        wish = shares.withColumn("best", best).withColumn("to", F.when(F.col("best.most") >= F.col("n"), -F.col("best.to")).otherwise(F.col("shard")))
        moving = wish.filter(F.col("to") != F.col("shard")).select("link", "shard", "to", "n")
        leaving = {r["shard"]: r["n"] for r in moving.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        if not leaving:
            break
        limit = [max(0, r) + leaving.get(s, 0) for s, r in enumerate(room)]
        # shares of one text that move to one shard are ranked together
        none = F.lit(0).cast("long")
        allowed = F.greatest(none, F.least("n", F.element_at(numbers(limit), F.col("to") + 1) - F.col("before")))
        arriving = running(moving.groupBy("link", "to").agg(F.sum("n").alias("n")), "to", "n").select("link", "to", allowed.alias("allowed"))
        order = Window.partitionBy("link", "to").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        moved = moving.join(arriving, ["link", "to"]).withColumn("first", F.sum("n").over(order) - F.col("n"))
        moved = moved.withColumn("go", F.greatest(none, F.least(F.col("n"), F.col("allowed") - F.col("first"))))
        stay = wish.filter(F.col("to") == F.col("shard")).select("link", "shard", "n")
        gone, rest = moved.select("link", F.col("to").alias("shard"), F.col("go").alias("n")), moved.select("link", "shard", (F.col("n") - F.col("go")).alias("n"))
        parts = stay.unionByName(gone).unionByName(rest)
        after = keep(parts.filter(F.col("n") > 0).groupBy("link", "shard").agg(F.sum("n").alias("n")))
        drop_kept(shares)
        shares = after
    return shares


def seats(groups: list[tuple[str, int]], quotas: list[int]) -> list[tuple[str, int, int, int]]:
    """(link, shard, before, n) of groups larger than a quota, largest first: whole shards, then the tightest that takes the rest."""
    room, out = list(quotas), []
    for link, n in groups:
        while n:
            s = min(range(len(room)), key=lambda s: (room[s] < n, room[s] if room[s] >= n else -room[s], s))
            take = min(n, room[s])
            out.append((link, s, quotas[s] - room[s], take))
            room[s] -= take
            n -= take
    return out


def shard(docs: DataFrame, n_shards: int = 40, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law 'rows', shard, slot, grown_shard null): shards whose row counts are at most one apart.

    A null text is as an empty one. Slots run from 0 without gaps in each shard. Repeated rows and null ids are placed
    like others: which of several equal rows gets which place is left open. Other columns are dropped, whatever their
    names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 16).cast("long"), F.crc32(text.cast("binary"))
    base = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), F.sha2(text, 256).alias("link"))
    # the row's number spreads repeated ids, too; salts are fixed once the rows are written
    base = keep(base.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS))))
    by_link = Window.partitionBy("link")  # at most SALTS rows
    upto = F.sum("c").over(by_link.orderBy("salt").rowsBetween(Window.unboundedPreceding, 0))
    cells = base.groupBy("link", "salt").agg(F.count("*").alias("c")).withColumn("group", F.sum("c").over(by_link))
    cells = keep(cells.withColumn("start", upto - F.col("c")))
    linked, single = cells.filter("group > 1"), cells.filter("group = 1")
    total = base.count()
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    at = lambda values, i: F.element_at(numbers(values), i.cast("int") + 1)
    # fewer than n_shards groups are larger than a quota; the others start dealt over the room that these leave
    largest = linked.filter(F.col("group") > max(quotas)).select("link", "group").distinct().orderBy(F.desc("group"), "link").collect()
    seated = seats([(r["link"], r["group"]) for r in largest], quotas)
    taken = [sum(n for _, to, _, n in seated if to == s) for s in range(n_shards)]
    left = [q - t for q, t in zip(quotas, taken, strict=True)]
    start = numbers([sum(left[:s]) for s in range(n_shards)])
    place = F.pmod(F.xxhash64("link", "salt"), F.lit(max(1, sum(left))))
    home = F.size(F.filter(start, lambda x: x <= place)) - 1
    shares = keep(linked.filter(F.col("group") <= max(quotas)).groupBy("link", home.alias("shard")).agg(F.sum("c").alias("n")))
    shares = propagate(shares, left, rounds)
    load = Counter({r["shard"]: r["n"] for r in shares.groupBy("shard").agg(F.sum("n").alias("n")).collect()}) + Counter(dict(enumerate(taken)))
    held = [min(load.get(s, 0), q) for s, q in enumerate(quotas)]
    over = [load.get(s, 0) - h for s, h in enumerate(held)]
    over_at = [sum(over[:s]) for s in range(n_shards)]
    free_at = [sum(q - h for q, h in zip(quotas[:s], held[:s], strict=True)) for s in range(n_shards)]

    # each share's first place in its shard and in its group; cells and shares overlap in pieces of the group's ranks
    in_group = by_link.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    placed = running(shares, "shard", "n").withColumn("before", F.col("before") + at(taken, F.col("shard")))
    if seated:
        seat = lambda link, to, before, n: F.struct(F.lit(link).alias("link"), F.lit(to).alias("shard"), F.lit(n).cast("long").alias("n"), F.lit(before).cast("long").alias("before"))
        first = F.array(*(seat(*x) for x in seated))
        placed = placed.unionByName(docs.sparkSession.range(1).select(F.inline(first)))
    placed = placed.withColumn("from", F.sum("n").over(in_group) - F.col("n"))
    pieces = linked.join(placed, "link").filter((F.col("start") < F.col("from") + F.col("n")) & (F.col("from") < F.col("start") + F.col("c"))).select(
        "link", "salt", (F.greatest("start", "from") - F.col("start")).alias("lo"), (F.least(F.col("start") + F.col("c"), F.col("from") + F.col("n")) - F.col("start")).alias("hi"),
        F.col("shard").alias("home"), (F.col("before") + F.col("start") - F.col("from")).alias("base"),
    )
    ranked = base.withColumn("r", F.row_number().over(Window.partitionBy("link", "salt").orderBy("id", "size")) - 1)
    cell = (F.col("d.link") == F.col("p.link")) & (F.col("d.salt") == F.col("p.salt"))
    mine = ranked.alias("d").join(pieces.alias("p"), cell & (F.col("d.r") >= F.col("p.lo")) & (F.col("d.r") < F.col("p.hi"))).select(
        "d.id", "d.size", "d.text_crc32", "p.home", (F.col("p.base") + F.col("d.r")).alias("at"),
    )
    stays = F.col("at") < at(quotas, F.col("home"))
    free = F.when(~stays, at(over_at, F.col("home")) + F.col("at") - at(quotas, F.col("home")))
    fixed = mine.select("id", "size", "text_crc32", F.when(stays, F.col("home")).alias("shard"), F.col("at"), free.alias("free"))
    # rows without links, after the linked ones that had no place, go through the free places in order
    ones = single.select("link", "salt", F.lit(1).cast("long").alias("n"), F.lit(0).alias("all"))
    alone = running(ones, "all", "n", max(LEAST_BUCKETS, total // BUCKET_ROWS)).select("link", "salt", (F.col("before") + sum(over)).alias("free"))
    rest = base.join(alone, ["link", "salt"]).select("id", "size", "text_crc32", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("long").alias("at"), "free")
    both = fixed.withColumn("shard", F.col("shard").cast("long")).unionByName(rest)
    to = F.size(F.filter(numbers(free_at), lambda x: x <= F.col("free"))) - 1
    return both.withColumn("to", F.coalesce(F.col("shard").cast("int"), to)).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").alias("shard"),
        F.when(F.col("shard").isNotNull(), F.col("at")).otherwise(at(held, F.col("to")) + F.col("free") - at(free_at, F.col("to"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
