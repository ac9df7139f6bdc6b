"""Operator 6, sharding by sampled splitters; law `bytes`.

Records are ordered by (60 bits of the text's MD5, doc_id, row), so equal texts are neighbours and
no two records share a key: a hot text can be split wherever a boundary falls. Splitters have two
levels. A sample drawn with probability proportional to size gives byte quantiles, at most RANGES of
them. Inside each range another sample, drawn and reduced to quantiles by the executors, gives the
splitters of its parts; they stay in a table of one row a range. Parts that prove overfull, by exact
counts of bytes or of rows, are sampled again and subdivided, in at most ROUNDS rounds.
A running sum inside each part gives every record its exact place in the total order of bytes; shard
s takes the records whose first byte lies in the s-th of n equal parts, so shard sizes differ by less
than the largest record, and at most n - 1 groups of equal texts meet a boundary.

The driver sees the first level's sample (at most RANGES x PER_RANGE keys on average) and counts.

Edge cases: null text has 0 bytes (plus the overhead) and CRC 0; empty and very long texts are records
like others; repeated rows are separate records; a null doc_id sorts first; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.llm.common import crc32_sql, cut, drop, table

OVERHEAD = 8
#: Ranges of the first level at most, and per shard; sampled keys per range and part.
RANGES, RANGES_PER_SHARD, PER_RANGE = 1024, 4, 64
#: Records and bytes of a part, on average; overfull is twice as much. Rounds of subdivision at most.
PART_ROWS, PART_BYTES, ROUNDS = 1 << 20, 1 << 30, 8
KEY = ("_k", "_d", "_m")


def _above(keys: Column, many: Column, rounds: int) -> Column:
    """How many of the sorted splitters (structs of KEY) are at or below the record's key: binary
    search in `rounds` halvings."""
    start = F.struct(F.lit(0).alias("lo"), many.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        go = (s["lo"] < s["hi"]) & (F.get(keys, mid) <= F.struct(*KEY))
        return F.struct(F.when(go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: s["lo"])


def _sampled(rows: DataFrame, share: Column, seed: int) -> DataFrame:
    """A sample in which a record's chance is the given share."""
    return rows.where(F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) < share)


def _quantiles(keys: Column, parts: Column) -> Column:
    """The parts - 1 inner quantiles of a sorted array."""
    at = F.sequence(F.lit(1), F.greatest(parts.cast("int") - 1, F.lit(1)))
    picked = F.transform(at, lambda i: F.get(keys, F.floor(i * F.size(keys) / parts).cast("int")))
    return F.when((parts > 1) & (F.size(keys) > 0), F.array_distinct(picked)).otherwise(F.slice(keys, 1, 0))


def _splitters(rows: DataFrame, n: int, count: int, total: int) -> tuple[Column, int]:
    """First level: a literal array and its length."""
    parts = min(RANGES, max(n * RANGES_PER_SHARD, -(-count // PART_ROWS), -(-total // PART_BYTES)))
    weight = F.col("size") / max(1, total) + 1 / max(1, count)  # bytes and rows weigh alike
    keys = sorted(tuple(r) for r in _sampled(rows, PER_RANGE * parts / 2 * weight, 1).select(*KEY).collect())
    cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    kind = "array<struct<_k:bigint,_d:bigint,_m:bigint>>"
    return F.from_json(F.lit("[" + ",".join(f'{{"_k":{k},"_d":{d},"_m":{m}}}' for k, d, m in cuts) + "]"), kind), len(cuts)


def ranged(rows: DataFrame, n: int, count: int, total: int, part_rows: int, part_bytes: int) -> DataFrame:
    """rows with range_id and part: the splitters' two levels."""
    first, many = _splitters(rows, n, count, total)
    x = rows.withColumn("range_id", _above(first, F.lit(many), many.bit_length() + 1) if many else F.lit(0))
    cuts, longest = None, 0
    for seed in range(2, 2 + ROUNDS):
        here = x.withColumn("part", F.lit(0)) if cuts is None else _parted(x, cuts, longest)
        held = here.groupBy("range_id", "part").agg(F.count("*").alias("c"), F.sum("size").alias("b"))
        over = held.where((F.col("c") > 1) & ((F.col("c") > 2 * part_rows) | ((F.col("b") > 2 * part_bytes) & (F.col("c") > F.col("b") / F.lit(4 * part_bytes)))))
        over = cut(over.withColumn("parts", F.least(F.col("c"), F.greatest(F.ceil(F.col("c") / part_rows), F.ceil(F.col("b") / part_bytes)))), "overfull")
        if not over.limit(1).count():
            drop(over)
            break
        # One row an overfull part, at most rows / PART_ROWS + bytes / PART_BYTES of them.
        weight = PER_RANGE * F.col("parts") / 2 * (F.col("size") / F.col("b") + 1 / F.col("c"))
        sample = _sampled(here.join(over, ["range_id", "part"]), weight, seed)
        found = sample.groupBy("range_id", "part", "parts").agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("keys"))  # about PER_RANGE x parts
        found = found.select("range_id", _quantiles(F.col("keys"), F.col("parts")).alias("cuts"))
        old = found if cuts is None else cuts.select("range_id", "cuts").unionByName(found)
        cuts = cut(old.groupBy("range_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("cuts")), "splitters")
        longest = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0
    return x.withColumn("part", F.lit(0)) if cuts is None else _parted(x, cuts, longest)


def _parted(x: DataFrame, cuts: DataFrame, longest: int) -> DataFrame:
    """The part of each record in its range; cuts has at most RANGES rows."""
    joined = x.join(F.broadcast(cuts), "range_id", "left")
    part = F.when(F.col("cuts").isNotNull(), _above(F.col("cuts"), F.size("cuts"), longest.bit_length() + 1)).otherwise(0)
    return joined.withColumn("part", part).drop("cuts")


def shard(docs: DataFrame, n: int = 24, text: str = "text", key: str = "doc_id", part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, size, text_crc32, shard, slot, range_id, part) for every row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(key),
            (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
            F.conv(F.substring(F.md5(F.encode(t, "UTF-8")), 1, 15), 16, 10).cast("long").alias("_k"),
            F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_d"),
            F.monotonically_increasing_id().alias("_m"),
        ),
        "shard",
    )
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).collect()[0]
    x = ranged(rows, n, count, total, part_rows, part_bytes)
    held = cut(x.groupBy("range_id", "part").agg(F.count("*").alias("_c"), F.sum("size").alias("_b")), "parts")
    # One narrow row a part: the offsets of ranges, then of parts in their range.
    up_to = W.orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)
    ranges = held.groupBy("range_id").agg(F.sum("_c").alias("_c"), F.sum("_b").alias("_b"))  # RANGES rows at most
    ranges = ranges.select("range_id", F.coalesce(F.sum("_c").over(up_to), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_b").over(up_to), F.lit(0)).alias("_bytes"))
    inside = W.partitionBy("range_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = held.withColumns({"_pc": F.coalesce(F.sum("_c").over(inside), F.lit(0)), "_pb": F.coalesce(F.sum("_b").over(inside), F.lit(0))})
    parts = parts.join(ranges, "range_id").select("range_id", "part", (F.col("_rows") + F.col("_pc")).alias("_rows"), (F.col("_bytes") + F.col("_pb")).alias("_bytes"))
    w = W.partitionBy("range_id", "part").orderBy(*KEY)
    placed = x.withColumns({"_at": F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"), "_r": F.row_number().over(w) - 1}).join(parts, ["range_id", "part"])
    number = F.least(F.lit(n - 1), F.floor((F.col("_bytes") + F.col("_at")) * n / F.lit(max(1, total)))).cast("int")
    placed = cut(placed.select(key, "size", "text_crc32", "range_id", "part", (F.col("_rows") + F.col("_r")).alias("_rank"), number.alias("shard")), "placed")
    drop(rows)
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_rank")).collect()}  # n rows
    starts = F.array(*[F.lit(first.get(s, 0)) for s in range(n)])
    return placed.select(key, "size", "text_crc32", "shard", (F.col("_rank") - F.get(starts, F.col("shard"))).alias("slot"), "range_id", "part")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The order, its running sums and the CRC, byte by byte.
ORACLE = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, md5(coalesce(text, '')) AS m FROM documents),
x AS (SELECT doc_id, octet_length(b) + 8 AS size, left(m, 15) AS k,
  {crc32_sql('b')} AS crc FROM t),
p AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id) - size AS begins, sum(size) OVER () AS total, row_number() OVER (ORDER BY k, doc_id) AS r FROM x),
s AS (SELECT *, CAST(least(23, floor(begins * 24 / total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, r - min(r) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
