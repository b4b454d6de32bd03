"""Sharding by extendible hashing.

A row's hash has ``BITS`` bits: the first half from its key, the second half from its content. The directory starts
with one bucket; a bucket above the byte limit, and no other, is split on one more bit of the prefix, until every
bucket fits. The directory is itself a table that grows with the number of shards: bytes are summed per prefix ``STEP``
bits deeper (partial sums meet before the shuffle), those few sums are rolled up to the depths between, and the bucket is
the shallowest prefix that fits. Only prefixes that are still too large go on to the next round. All of it is DataFrame
functions.

Null keys hash like the empty string, null texts have no bytes, an empty table has no shards. A key with very many rows
is split by content. Equal rows can't be parted by bits: where they alone exceed the limit with all bits used, they are counted
and dealt to pages of at most the limit. A single row above the limit stays whole: its bucket is
not split further once the row is alone in it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.tables import kept_table, read_table

SHARD_BYTES = 64 * 1024 * 1024
HALF = 31
BITS = 2 * HALF
STEP = 10           # bits looked at in one round
CHUNK = 1000        # equal rows dealt out by one task at a time


def _bits(value: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.shiftright(F.conv(digits, 16, 10).cast("long"), 32 - HALF)


def row_hash(key: Column, content: Column) -> Column:
    """62 bits: 31 of the key's md5, then 31 of the content's."""
    return F.shiftleft(_bits(key), HALF).bitwiseOR(_bits(content))


def _round(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """Cells of depth ``end`` with the depth of their bucket, null where the bucket is still too large at ``end``."""
    end = min(BITS, start + STEP)
    cells = rows.groupBy(F.shiftright("_hash", BITS - end).alias("cell")).agg(
        F.sum("n_bytes").alias("total"), F.count(F.lit(1)).alias("n"))
    levels = cells.select("cell", "total", "n", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {end} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("total").alias("size"), F.sum("n").alias("n"))
    fits = fits.where((F.col("size") <= limit) | (F.col("n") == 1))
    first = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.join(first, "cell", "left").select("cell", F.col("depth").cast("int"))


def assign(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Rows with _hash and n_bytes, plus depth, shard (the prefix as a bit string) and page."""
    pending, done, start = rows, [], 0
    while True:
        end = min(BITS, start + STEP)
        cells = kept_table(_round(pending, start, limit), "shard-cells")
        marked = pending.withColumn("_cell", F.shiftright("_hash", BITS - end)).join(
            cells.withColumnRenamed("cell", "_cell"), "_cell")
        done.append(marked.where(F.col("depth").isNotNull()).drop("_cell").withColumn("page", F.lit(0).cast("long")))
        rest = cells.where(F.col("depth").isNull()).select(F.col("cell").alias("_cell"))
        if rest.isEmpty():
            break
        pending = pending.withColumn("_cell", F.shiftright("_hash", BITS - end)).join(
            rest, "_cell", "left_semi").drop("_cell")
        if end == BITS:
            done.append(pending.withColumn("depth", F.lit(BITS)).transform(_paged, limit))
            break
        start = end
    out = functools.reduce(DataFrame.unionByName, done)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.expr(f"lpad(bin(shiftright(_hash, {BITS} - depth)), depth, '0')"))
    return out.withColumn("shard", bits)


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets that no bit can split: equal rows are counted and dealt out in pages."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))).alias("_chunk"))
    chunks = chunks.repartition("_hash", "_chunk")
    last = F.least(F.col("_n"), (F.col("_chunk") + 1) * CHUNK) - 1
    dealt = chunks.select(*columns, F.explode(F.sequence(F.col("_chunk") * CHUNK, last)).alias("_at"))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    return dealt.select(*columns, F.floor(F.col("_at") / per_page).cast("long").alias("page"))


def shard(df: DataFrame, key: str, text: str, limit: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The given columns of ``df`` (the key by default) with n_bytes, shard, depth and page. The narrow table of keys
    and hashes is written once, so the texts are read once whatever the number of rounds."""
    keep = [key] if keep is None else keep
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(*keep, row_hash(F.col(key), content).alias("_hash"),
                       F.octet_length(content).cast("long").alias("n_bytes"))
    return assign(kept_table(narrow, "shard-rows"), limit).drop("_hash")


def write_shards(df: DataFrame, key: str, text: str, path: str, limit: int = SHARD_BYTES) -> None:
    """Write the whole rows as one folder for each shard and page."""
    columns = [c for c in df.columns if c.lower() not in ("n_bytes", "shard", "depth", "page")]
    placed = shard(df.select(*columns), key, text, limit, columns)
    placed.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return shard(docs, "doc_id", "text").select("doc_id", "n_bytes", "shard", "depth", "page")


ORACLE = f"""
WITH rows AS (
    SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
           ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 1) << {HALF})
           | (('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT >> 1) AS hash
    FROM documents),
levels AS (
    SELECT depth, hash >> ({BITS} - depth) AS prefix, sum(n_bytes) AS size
    FROM rows, range(0, {BITS + 1}) AS d(depth) GROUP BY 1, 2 HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
placed AS (
    SELECT r.doc_id, r.n_bytes, r.hash, min(l.depth) AS depth
    FROM (SELECT *, row_number() OVER () AS rn FROM rows) r
    JOIN levels l ON r.hash >> ({BITS} - l.depth) = l.prefix GROUP BY r.rn, 1, 2, 3)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(hash >> ({BITS} - depth)), depth::INT, '0') END AS shard,
       depth::INT AS depth, 0::BIGINT AS page
FROM placed
"""
