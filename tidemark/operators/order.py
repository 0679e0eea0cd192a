"""A seeded order whose places are computed: no global sort, the same for any partitioning, any stretch of it alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash cells that rows are numbered in: at most this many rows are broadcast, 24 bytes each.
CELLS = 1 << 16
ROUNDS = 32
#: A prime below 2^31 and two multipliers: products stay below 2^62.
PRIME, MIX_1, MIX_2 = 2147483647, 1103515245, 1597334677


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 61-bit key for each round, from the seed alone."""
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16) for i in range(rounds)]


def _swap(x: Column, key: Column, n: Column) -> Column:
    """One round: x and its partner key - x (mod n) change places, if a hashed bit of the larger of both says so."""
    partner = F.pmod(F.pmod(key, n) + n - x, n)
    larger = F.greatest(x, partner)
    u = F.pmod(F.pmod(larger, F.lit(PRIME)) * MIX_1 + F.pmod(key, F.lit(PRIME)), F.lit(PRIME))
    v = F.pmod(u.bitwiseXOR(F.shiftright(u, 15)) * MIX_2, F.lit(PRIME))
    return F.when(F.shiftright(v, 13) % 2 == 1, partner).otherwise(x)


def place_of(row: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """The place of row number `row` among 0 to n - 1: a permutation of any n, since each round undoes itself."""
    return F.aggregate(F.array(*map(F.lit, round_keys(seed, rounds))), row.cast("bigint"), lambda x, key: _swap(x, key, n))


def row_at(place: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """The row number at a place: the rounds of `place_of` backwards."""
    return F.aggregate(F.array(*map(F.lit, round_keys(seed, rounds)[::-1])), place.cast("bigint"), lambda x, key: _swap(x, key, n))


def _cell(columns: tuple[str, ...]) -> Column:
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with gapless numbers `__row` from 0 and their count `__n`, in the order of a hash of `columns`, then of `columns`.

    Rows are dealt to hash cells and numbered inside them; the cells' first numbers are broadcast, at most CELLS of them.
    `columns` identify a row: rows equal in them get neighbouring numbers in either order."""
    rows = df.withColumn("__cell", _cell(columns))
    sizes = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__size"))
    everything = Window.partitionBy(F.lit(0))
    before = F.sum("__size").over(everything.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("__cell", F.coalesce(before, F.lit(0)).alias("__first"), F.sum("__size").over(everything).alias("__n"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(*columns)) - 1
    out = rows.withColumn("__inside", inside).join(F.broadcast(firsts), "__cell")
    return out.withColumn("__row", F.col("__first") + F.col("__inside")).drop("__cell", "__first", "__inside")


def places(df: DataFrame, seed: int, *columns: str) -> DataFrame:
    """The rows with their `place` (from 0) in the order that the seed and `columns` give, whatever the partitions."""
    return numbered(df, *columns).withColumn("place", place_of(F.col("__row"), F.col("__n"), seed)).drop("__row", "__n")


def shard(df: DataFrame, seed: int, index: int, shards: int, *columns: str) -> DataFrame:
    """Shard `index` of the seeded order in `shards` stretches of equal size (to one row), made without the others, with places."""
    rows = numbered(df, *columns).withColumn("place", place_of(F.col("__row"), F.col("__n"), seed))
    low, high = (F.floor(F.col("__n") * i / shards).cast("bigint") for i in (index, index + 1))
    return rows.filter((F.col("place") >= low) & (F.col("place") < high)).drop("__row", "__n")


def places_sql(source: str, seed: int, columns: list[str], rounds: int = ROUNDS) -> str:
    """The same in DuckDB: (source.*, place)."""
    keys = ", ".join(f"{k}::bigint" for k in round_keys(seed, rounds))
    text = " || '|' || ".join(f"{c}::varchar" for c in columns)
    partner = "((k % n + n - x) % n)"
    larger = f"greatest(x, {partner})"
    u = f"((({larger} % {PRIME}) * {MIX_1} + k % {PRIME}) % {PRIME})"
    bit = f"((xor({u}, {u} >> 15) * {MIX_2} % {PRIME}) >> 13) % 2"
    order = f"substr(md5({text}), 1, 4), {', '.join(columns)}"
    return f"""with recursive keys as (select unnest([{keys}]) k, unnest(range({rounds})) i),
    numbered as (select *, row_number() over (order by {order}) - 1 as x, count(*) over () as n from {source}),
    walk as (select *, 0::bigint as i from numbered
      union all select w.* replace (case when {bit} = 1 then {partner} else x end as x, w.i + 1 as i) from walk w join keys using (i))
    select * exclude (x, n, i), x as place from walk where i = {rounds}"""
