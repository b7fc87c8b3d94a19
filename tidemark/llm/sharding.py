"""Rendezvous (highest random weight) hashing of record keys over weighted shards.

Each key scores every shard with ``-w / ln(u)``, where ``u`` is a uniform number
that key and shard alone decide, and goes to the highest score. Adding a shard
can only win records for itself, so few records move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, table, utf8

SHARDS = 40
#: Rows of one shard that are numbered together; more rows only make more groups.
GROUP_ROWS = 2000


def lanes(key: Column, n: int) -> list[Column]:
    """``n`` uniform numbers for a key: each MD5 gives four lanes of 32 bits."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    out = []
    for block in range((n + 3) // 4):
        digest = F.md5(F.concat(text, F.lit(f":{block}")))
        out += [(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 32)) for k in range(4)]
    return out[:n]


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], grown: float | None = None, shard: str = "shard", grown_shard: str = "grown_shard") -> DataFrame:
    """Add the shard of each row's key; with ``grown`` also its shard if one more shard of that weight is added.

    A null key is a key like any other; equal keys go to one shard; ties between
    scores go to the lower shard. Columns that already have the new names are replaced, all others kept.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, and at least one")
    every = [*weights, *([grown] if grown is not None else [])]
    scores = [F.lit(-float(w)) / F.ln(u) for w, u in zip(every, lanes(F.col(f"`{key}`"), len(every)))]
    every_score = "__scores"
    while every_score in df.columns:
        every_score += "_"
    held = df.withColumn(every_score, F.array(*scores))
    first = F.slice(every_score, 1, len(weights))
    cols = {shard: (F.array_position(first, F.array_max(first)) - 1).cast("int")}
    cols[grown_shard] = (F.array_position(every_score, F.array_max(every_score)) - 1).cast("int") if grown is not None else F.lit(None).cast("int")
    return held.withColumns(cols).drop(every_score)


def slots(df: DataFrame, shard: str, key: str, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of (MD5 of the key, key); rows of one key in any order.

    A shard may hold a large part of all rows, so it is numbered in groups of
    equal leading bits of that MD5: a group's offset is the sum of the counts before it. A group stays far larger than the others only
    if rows repeat a key, null too: its rows are dealt to cells of (key, salt), which are numbered in the same way. Columns that
    begin with two underscores, and one of the slot's name, are replaced.
    """
    n = df.count()
    bits = max(0, min(40, (max(1, n) // GROUP_ROWS).bit_length() - 5))
    at = F.conv(F.substring(F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    kept = [c for c in df.columns if not c.startswith("__") and c != slot]
    held = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn("__at", at).withColumn("__group", F.shiftright("__at", 48 - bits) if bits else F.lit(0).cast("long"))
    # the salt is stored, so that rows keep it wherever they are read again
    held = checkpointed(held.withColumn("__salt", F.monotonically_increasing_id() % 4096))
    counts = checkpointed(held.groupBy(F.col(f"`{shard}`").alias("__s"), F.col("__group").alias("__g")).agg(F.count("*").alias("__n")))
    before = W.partitionBy("__s").orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__s", "__g", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    here = (F.col(f"`{shard}`") == F.col("__s")) & (F.col("__group") == F.col("__g"))

    def numbered(rows: DataFrame, *within: str) -> DataFrame:
        inside = W.partitionBy("__s", "__g", *within).orderBy("__at", F.col(f"`{key}`"))
        return rows.withColumn(slot, (F.col("__before") + F.row_number().over(inside) - 1).cast("long")).select(*[F.col(f"`{c}`") for c in kept], slot)

    placed = held.join(offsets, here)
    large = F.col("__n") > 8 * GROUP_ROWS
    if counts.filter(large).isEmpty():
        return numbered(placed)
    crowded = placed.filter(large)
    cells = crowded.groupBy(F.col("__s").alias("__s2"), F.col("__g").alias("__g2"), F.col("__at").alias("__at2"), F.col(f"`{key}`").alias("__key2"), F.col("__salt").alias("__salt2")).agg(F.count("*").alias("__m"))
    cells = cells.withColumn("__ahead", F.coalesce(F.sum("__m").over(W.partitionBy("__s2", "__g2").orderBy("__at2", "__key2", "__salt2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    same = (F.col("__s") == F.col("__s2")) & (F.col("__g") == F.col("__g2")) & (F.col("__at") == F.col("__at2")) & F.col(f"`{key}`").eqNullSafe(F.col("__key2")) & (F.col("__salt") == F.col("__salt2"))
    dealt = crowded.join(cells, same).withColumn("__before", F.col("__before") + F.col("__ahead"))
    return numbered(placed.filter(~large)).unionByName(numbered(dealt, "__at", f"`{key}`", "__salt"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the ``key`` law; null text: size 16, CRC of no bytes."""
    body = utf8(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = checkpointed(rendezvous(docs, "doc_id", [1.0] * SHARDS, grown=1.0))
    return slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_LANE = "((('0x' || substr(md5(doc_id::VARCHAR || ':' || (s // 4)), 1 + 8 * (s % 4)::INT, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"
_CRC_BIT = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
OP2_SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, {_CRC_BIT} FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
scored AS (
  SELECT doc_id, s, -1.0 / ln({_LANE}) AS score FROM documents, (SELECT range::BIGINT AS s FROM range(41)) AS shards),
best AS (
  SELECT doc_id, (arg_max(s, score) FILTER (WHERE s < 40))::INT AS shard, arg_max(s, score)::INT AS grown_shard
  FROM scored GROUP BY doc_id),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295::BIGINT)::BIGINT AS text_crc32
  FROM documents, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5('slot:' || doc_id::VARCHAR), 1, 12), doc_id) - 1)::BIGINT AS slot, grown_shard
FROM sized JOIN best USING (doc_id)
"""
QUERIES = {"op2_sharding": op2_sharding}
ORACLES = {"op2_sharding": OP2_SQL}
