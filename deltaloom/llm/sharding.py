"""[op 1] Sharding by extendible hashing.

Rows hash to 32 bits. The directory starts with one bucket; a bucket whose
rows hold more than the byte limit is split on its next bit, others stay. A
bucket is a leaf, and a shard, at the shortest prefix whose rows fit.

1. One scan of keys and byte counts gives a histogram of hashes, combined
   before its shuffle; the rest of the split works on it alone.
2. As a prefix's bytes never exceed those of a shorter one, the leaves of 8
   bits at a time come from one aggregate: only hashes of buckets that are
   still too large are counted again, with the next 8 bits. At most four
   passes, no loop over rows, and nothing but a yes or no reaches the driver.
3. The directory holds one row a leaf, with the run of slots that it stands
   for. A row finds its shard by its hash at the depths that occur, at most 33
   of them; small directories are broadcast by the optimizer's own check of
   their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.frames import durable

BITS, BAND = 32, 8


def hash32(*keys: str) -> Column:
    """The first 32 bits of MD5 over the keys as text, joined by a tab; nulls count as empty."""
    joined = F.concat_ws("\t", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def histogram(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``hash``, ``bytes`` (of the texts in UTF-8; null counts as 0) and ``rows`` of all rows."""
    sized = df.select(hash32(*keys).alias("hash"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("bytes"))
    return sized.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def directory(counted: DataFrame, limit: int) -> DataFrame:
    """The directory over a histogram: ``shard`` (the bits of its prefix), ``local_depth``, ``prefix`` as a number, the slots of 32 bits from ``first_slot`` to ``last_slot`` that lead to it, ``shard_bytes`` and ``shard_rows``.

    Prefixes without rows have no leaf. One of 32 bits that does not fit is a
    leaf all the same: its rows share all bits.
    """
    out, rest, large = None, durable(counted), None
    for bits in range(BAND, BITS + 1, BAND):
        if large is not None:  # hashes of buckets still too large
            match = F.shiftright("hash", BITS - bits + BAND) == F.col("over")
            rest = rest.join(F.broadcast(large) if bits <= 3 * BAND else large, match, "left_semi")  # up to 2**16 prefixes are broadcast
        fine = rest.groupBy(F.shiftright("hash", BITS - bits).alias("at")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        first = 0 if bits == BAND else bits - BAND + 1
        levels = fine.withColumn("local_depth", F.explode(F.array(*[F.lit(d) for d in range(first, bits + 1)]))).withColumn("prefix", F.expr(f"shiftright(at, {bits} - local_depth)"))
        totals = levels.groupBy("local_depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = totals.filter((F.col("shard_bytes") <= limit) | ((F.col("local_depth") == bits) & F.lit(bits == BITS)))
        best = F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("local_depth", "prefix", "shard_bytes", "shard_rows")))
        found = durable(levels.join(fits, ["local_depth", "prefix"], "left").groupBy("at").agg(best.alias("leaf")))
        leaves = found.filter("leaf is not null").select("leaf.*").distinct()
        out = leaves if out is None else out.unionByName(leaves)
        large = found.filter("leaf is null").select(F.col("at").alias("over"))
        if large.isEmpty():
            break
    width = F.expr(f"shiftleft(1L, {BITS} - local_depth)")
    shard = F.when(F.col("local_depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), local_depth, '0')"))
    return durable(out.select(shard.alias("shard"), "local_depth", "prefix", (F.col("prefix") * width).alias("first_slot"), ((F.col("prefix") + 1) * width - 1).alias("last_slot"), "shard_bytes", "shard_rows"))


def assign_shards(df: DataFrame, keys: list[str], limit: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add to every row its ``shard`` (the bits of its prefix; "" if all rows fit one), ``local_depth``, ``shard_bytes`` and ``shard_rows``.

    Bytes are those of the text in UTF-8; null counts as 0. Rows with equal
    keys, nulls as empty text, always share a shard: one that holds more than
    the limit has all 32 bits. No row is added or dropped; other columns stay,
    columns of the same names are replaced.
    """
    made = ["shard", "local_depth", "shard_bytes", "shard_rows"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    slots = directory(histogram(df, keys, text), limit)
    depths = sorted(r[0] for r in slots.select("local_depth").distinct().collect())  # 33 at most
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), hash32(*keys).alias("hash"))
    each = rows.select("row", "hash", F.explode(F.array(*map(F.lit, depths or [0]))).alias("local_depth")).withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - local_depth)"))
    hit = each.join(slots.select("local_depth", "prefix", "shard", "shard_bytes", "shard_rows"), ["local_depth", "prefix"])
    return hit.select(*[F.col(f"row.`{c}`") for c in kept], "shard", F.col("local_depth").cast("long").alias("local_depth"), "shard_bytes", "shard_rows")
