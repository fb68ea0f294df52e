"""Reading a database table in parallel, in parts of about one size whatever the skew of its key.

The database itself counts: the key's bounds, then rows by range, finer where many are. The ranges are joined to parts of
nearly as many rows each; the driver gets a few hundred counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Ranges that a heavy one is cut into; the heaviest range left is this share of a part at most, if it has more than one key.
FINER, GRAIN = 32, 4


@dataclass(frozen=True)
class Range:
    """Keys from low to high, both included, with n rows."""

    low: int
    high: int
    n: int


def asked(spark: SparkSession, options: dict[str, str], query: str) -> list:
    return spark.read.format("jdbc").options(**options).option("query", query).load().collect()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def finer(spark: SparkSession, options: dict[str, str], table: str, key: str, heavy: Range) -> list[Range]:
    """The non-empty ranges that a range is cut into. Keys are whole numbers, so the database divides them without a rest."""
    width = -(-(heavy.high - heavy.low + 1) // FINER)
    place = f"({quoted(key)} - {heavy.low}) / {width}"
    rows = asked(spark, options, f"SELECT b, COUNT(*) AS n FROM (SELECT {place} AS b FROM {table} WHERE {quoted(key)} BETWEEN {heavy.low} AND {heavy.high}) x GROUP BY b")
    return [Range(heavy.low + int(b) * width, min(heavy.high, heavy.low + (int(b) + 1) * width - 1), int(n)) for b, n in sorted((r[0], r[1]) for r in rows)]


def histogram(spark: SparkSession, options: dict[str, str], table: str, key: str, most: int) -> tuple[list[Range], int]:
    """(ascending ranges of at most `most` rows, or of one key; rows whose key is null)."""
    low, high, n, with_key = asked(spark, options, f"SELECT MIN({quoted(key)}) AS lo, MAX({quoted(key)}) AS hi, COUNT(*) AS n, COUNT({quoted(key)}) AS k FROM {table}")[0]
    nulls = int(n - with_key)
    if low is None:
        return [], nulls
    done, open_ = [], [Range(int(low), int(high), int(with_key))]
    while open_:
        heavy = open_.pop()
        if heavy.n <= most or heavy.low == heavy.high:
            done.append(heavy)
        else:
            open_ += finer(spark, options, table, key, heavy)
    return sorted(done, key=lambda r: r.low), nulls


def balanced(ranges: list[Range], nulls: int, key: str, parts: int, spread: str | None = None) -> list[str]:
    """Conditions that together hold for every row once, for about as many rows each.

    spread: a whole-number expression by which the rows of one key, if they are more than a part, are dealt out.
    """
    k = quoted(key)
    out = [f"{k} IS NULL"] if nulls else []
    target = max(1, -(-sum(r.n for r in ranges) // parts))
    hot = [r for r in ranges if spread and r.low == r.high and r.n > 1.5 * target]
    for r in hot:
        m = -(-r.n // target)
        out += [f"{k} = {r.low} AND MOD(ABS(COALESCE({spread}, 0)), {m}) = {j}" for j in range(m)]
    cold = [r for r in ranges if r not in hot]
    rest, left, held = sum(r.n for r in cold), max(1, parts - (len(out) - bool(nulls))), 0
    first = None
    for nth, r in enumerate(cold):
        first, held = r.low if first is None else first, held + r.n
        ahead = cold[nth + 1].n if nth + 1 < len(cold) else 0
        if nth + 1 == len(cold) or r.high + 1 < cold[nth + 1].low and any(r.high < x.low < cold[nth + 1].low for x in hot) or held + ahead / 2 >= rest / left and left > 1:
            out.append(f"{k} BETWEEN {first} AND {r.high}")
            first, rest, left, held = None, rest - held, max(1, left - 1), 0
    return out or ["1 = 0"]


def read_in_parts(spark: SparkSession, options: dict[str, str], table: str, key: str, parts: int, spread: str | None = None) -> DataFrame:
    """A table by JDBC options (url, driver, user, ...), a partition for each of about `parts` conditions on its whole-number key.

    Rows that are written meanwhile may be in or not, as with any read of several statements. An empty table gives no rows.
    """
    n = int(asked(spark, options, f"SELECT COUNT(*) AS n FROM {table}")[0][0])
    ranges, nulls = histogram(spark, options, table, key, max(1, n // (parts * GRAIN)))
    conditions = balanced(ranges, nulls, key, parts, spread)
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=conditions, properties=rest)
