"""How document filters overlap: what each removes at every step of every order, and its share over all orders.

Documents are reduced to the set of filters they fail, and those sets are counted by part: 32 counts at most, which hold all that can be
asked. A coalition of filters removes the documents that fail one of its members; the 32 removals are the values of a
cooperative game. Its Shapley values are the exact constrained least-squares fit of an additive model to the game: coalitions weighted by
the Shapley kernel, the members' values summing to the removal of all, the normal equations solved in rationals. What a filter removes at
a step is the difference of two coalitions.

Filter E (a text that a smaller doc_id has too) is settled without a group per text: the smallest id of each text is a minimum that combines
on the map side, and rows are joined with it on text and id, where no key repeats.

Null texts are empty, null parts the empty string. A null doc_id is neither smaller nor larger than another: such a row is never a repeat
and has no labels. Repeated rows count each; rows that share the smallest id of a text are none of them repeats. A document is good (toxic)
if any of its label rows says so. An empty table has no parts and so no rows.
"""

from __future__ import annotations

import itertools
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.tables import kept_table, once, read_table

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
_GAP = r"[\x20\x09-\x0D]+"
_COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Column]:
    """The rows with helper columns, and the bits of the filters A to D that a text fails."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut = once(docs.withColumn("_text", body), _words=F.filter(F.split("_text", _GAP), lambda word: word != ""))
    n = F.size("_words")
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("_words")) < MIN_DISTINCT_PERCENT * n,
             100 * F.regexp_count("_text", F.lit("[A-Z]")) > MAX_UPPER_PERCENT * F.length("_text"), F.col("_text").rlike(SYMBOLS)]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << i).otherwise(0)
    return cut, bits


def tabulate(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows (part, fails, n, good, toxic): documents by the set of filters they fail, 2^5 sets a part at most."""
    narrow = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text"))
    cut, bits = text_failures(narrow)
    rows = cut.select("doc_id", "part", bits.alias("fails"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("key"))
    rows = kept_table(rows.groupBy("doc_id", "part", "fails", "key").agg(F.count(F.lit(1)).alias("n")), "audit-rows")

    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.where(F.col("doc_id").isNotNull()).join(first, ["key", "doc_id"], "left").join(marks, "doc_id", "left").select(
        "part", (F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))).alias("fails"), "n",
        F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))
    nameless = rows.where(F.col("doc_id").isNull()).select(
        "part", "fails", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "fails").agg(
        *[F.sum(x).alias(x) for x in ("n", "good", "toxic")])


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Exact solution of a regular linear system for several right-hand sides, by elimination in rationals."""
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


@lru_cache(maxsize=4)
def least_squares(players: int) -> list[list[Fraction]]:
    """values[i][s]: weight of the value of coalition s (a bit set) in the fitted value of player i.

    Minimises the kernel-weighted squares of v(s) - sum of the members' values over all coalitions but none and all, under the
    condition that all values sum to v(all). The normal equations with a Lagrange multiplier are solved for every unit game at once;
    v(none) is 0 in every game.
    """
    every = (1 << players) - 1
    kernel = {s: Fraction(players - 1, comb(players, s.bit_count()) * s.bit_count() * (players - s.bit_count()))
              for s in range(1, every)}
    member = [[s >> i & 1 for i in range(players)] for s in range(every + 1)]
    matrix = [[sum((w * member[s][i] * member[s][j] for s, w in kernel.items()), Fraction(0)) for j in range(players)] + [Fraction(1)]
              for i in range(players)] + [[Fraction(1)] * players + [Fraction(0)]]
    right = [[kernel[s] * member[s][i] if s in kernel else Fraction(0) for s in range(every + 1)] for i in range(players)]
    right.append([Fraction(int(s == every)) for s in range(every + 1)])
    return solve(matrix, right)[:players]


@lru_cache(maxsize=1)
def _steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Orders; filter, coalition before and after of each of their steps; weights of the Shapley values summed over all orders."""
    orders = list(itertools.permutations(range(len(FILTERS))))
    members = np.array(orders)
    after = np.cumsum(1 << members, axis=1)
    sums = [[len(orders) * x for x in row] for row in least_squares(len(FILTERS))]
    if any(x.denominator != 1 for row in sums for x in row):
        raise ArithmeticError("sums over all orders are whole numbers")
    weights = np.array([[int(x) for x in row] for row in sums], np.int64)
    return ["".join(FILTERS[i] for i in order) for order in orders], members, after - (1 << members), after, weights


def part_rows(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of one part (orders x steps) from its counts by failed set."""
    _, member, before, after, weights = _steps()
    sets = np.arange(1 << len(FILTERS))
    hit = ((sets[:, None] & sets[None, :]) != 0).astype(np.int64)        # coalition x failed set
    value, lost_good, lost_toxic = hit @ n, hit @ good, hit @ toxic
    removed = value[after] - value[before]
    single, every = 1 << member, len(sets) - 1
    return {"kept": n.sum() - value[after], "removed": removed, "redundant": value[single] - removed,
            "unique_fails": value[every] - value[every - single], "good_lost": lost_good[after] - lost_good[before],
            "toxic_lost": lost_toxic[after] - lost_toxic[before], "shapley": (weights @ value)[member]}


def audit(table: DataFrame) -> DataFrame:
    """A row for each part, order and step of a table made by ``tabulate``."""
    per_part = table.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))   # 32 at most

    def run(batches):
        orders, members, *_ = _steps()
        steps = len(FILTERS)
        order = pa.array(np.repeat(orders, steps))
        step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders)))
        for batch in batches:
            for part, sets in zip(batch.column("part").to_pylist(), batch.column("sets").to_pylist()):
                counts = np.zeros((3, 1 << steps), np.int64)
                for row in sets:
                    counts[:, row["fails"]] += (row["n"], row["good"], row["toxic"])
                found = part_rows(*counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(order), pa.string()), order, step, *[pa.array(found[c].ravel()) for c in _COLUMNS]],
                    ["part", "filter_order", "step", *_COLUMNS])

    return per_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(tabulate(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


#: Orders spelled out, documents counted for every prefix, Shapley values as plain sums over the orders.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
    FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < {MIN_WORDS} AS a, 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MAX_UPPER_PERCENT} * length(t) AS c, regexp_matches(t, '{SYMBOLS}') AS d,
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
masks AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM orders, range(1, 6) AS s(step)),
counted AS (SELECT part, o, step, any_value(x) AS x,
    sum(CASE WHEN length(translate(fails, before || x, '')) = length(fails) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, x) AND length(translate(fails, before, '')) = length(fails) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, x) AND length(translate(fails, before, '')) < length(fails) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, x) AND length(translate(fails, before, '')) = length(fails) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, x) AND length(translate(fails, before, '')) = length(fails) THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, steps GROUP BY part, o, step)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
