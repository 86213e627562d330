"""Sharding by jump consistent hashing (Lamping and Veach 2014), in DataFrame functions only.

A key walks a sequence of jumps j1 < j2 < ...; jump targets come from a linear congruential
generator seeded by the key, and the shard is the last target below the shard count. There is no
ring table, and appending a shard moves only the keys whose next jump lands exactly on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed values of the published generator: key -> key * MULTIPLIER + 1 modulo 2^64.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
#: Jumps grow as the logarithm of the shard count; up to here the walk has room for every shard.
EXACT_STEPS = 512


def _product_low64(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, in 32-bit halves that never leave a signed bigint."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32

    def low32(x: Column, m: int) -> Column:
        """x * m modulo 2^32, with x below 2^32."""
        upper = (F.shiftrightunsigned(x, 16) * m).bitwiseAND(0xFFFF)
        return (x.bitwiseAND(0xFFFF) * m + F.shiftleft(upper, 16)).bitwiseAND(LOW32)

    part0, part1 = lo.bitwiseAND(0xFFFF) * m_lo, F.shiftrightunsigned(lo, 16) * m_lo
    low = part0 + F.shiftleft(part1.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(part1, 16)
    return (carry + low32(hi, m_lo) + low32(lo, m_hi)).bitwiseAND(LOW32), low.bitwiseAND(LOW32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a bigint key; a null key counts as 0.

    Above EXACT_STEPS shards the walk stops after EXACT_STEPS jumps, of which a key needs
    ln(shards) on average; the chance that one key needs more is below 10^-300.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(LOW32).alias("lo"),
        F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"),
    )

    def advance(s: Column) -> Column:
        hi, lo = _product_low64(s["hi"], s["lo"])
        # 2^31 / ((key >> 33) + 1), the generator's top 31 bits being hi >> 1
        reach = F.lit(float(1 << 31)) / (F.shiftrightunsigned(hi, 1) + 1).cast("double")
        target = F.floor((s["j"] + 1).cast("double") * reach).cast("bigint")
        return F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), target.alias("j"))

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(min(shards, EXACT_STEPS))), start,
        lambda s, _: F.when(s["j"] < shards, advance(s)).otherwise(s),
    )
    return walked["b"].cast("int")


def ranges_for(rows: int, size: int, most_rows: int = 1 << 20, most_bytes: int = 64 << 20, least: int = 128) -> int:
    """The number of ranges of about ``most_rows`` rows and ``most_bytes`` bytes, ``least`` at least."""
    return max(least, -(-rows // most_rows), -(-size // most_bytes))


def id_ranges(df: DataFrame, column: str, buckets: int) -> Column:
    """The number (0 to ``buckets`` - 1) of the range of ``column`` that holds the row.

    The bounds are approximate percentiles over all rows: at most ``buckets`` - 1 longs at the driver. A row is
    placed among every 64th bound first, then among those between. Null goes into range 0.
    """
    steps = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(column, steps, 20 * buckets)).first()[0]
    bounds = sorted(set(found or []))
    value = F.coalesce(F.col(column), F.lit(-(1 << 63)).cast("bigint"))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("bigint") for x in values]).cast("array<bigint>")

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < value))

    if len(bounds) <= 128:
        return below(longs(bounds))
    coarse = below(longs(bounds[63::64]))
    return coarse * 64 + below(F.slice(longs(bounds), coarse * 64 + 1, F.lit(64)))


def gapless_slots(df: DataFrame, shard: str, order: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``slot``: the row's place, from 0 without gaps, among its shard's rows in ``order``.

    ``order[0]`` is a bigint column. A shard is not sorted in one task: rows are numbered within ranges
    of ``order[0]`` (by default 128 of them, or more for over 2^27 rows), and a range starts where the counts of
    the ranges before it end. The table of counts has shards x buckets rows at most. All columns stay; one
    named ``slot`` is replaced.
    """
    if buckets is None:
        buckets = ranges_for(df.count(), 0)
    names = {c.lower() for c in df.columns}
    range_, row, start, n = (next(x for x in (f"_{k}{i}" for i in range(len(names) + 1)) if x not in names) for k in ("range", "row", "start", "n"))
    ranged = df.withColumn(range_, id_ranges(df, order[0], buckets))
    counts = ranged.groupBy(shard, range_).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(shard).orderBy(range_).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(shard, range_, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = W.partitionBy(shard, range_).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        ranged.withColumn(row, F.row_number().over(within))
        .join(F.broadcast(starts) if buckets <= 4096 else starts, [shard, range_])
        .withColumn("slot", F.col(start) + F.col(row) - 1)
        .select(*df.drop("slot").columns, "slot")
    )


def shard_rows(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (with one shard more) of the bigint column ``key``.

    Rows move only into the appended shard. Other columns pass through; columns named ``shard`` or
    ``grown_shard`` are replaced. An empty table stays empty; equal keys share a shard.
    """
    return df.withColumns({"shard": jump_shard(F.col(key), shards), "grown_shard": jump_shard(F.col(key), shards + 1)})
