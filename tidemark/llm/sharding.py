"""Sharding by jump consistent hashing, in DataFrame expressions alone.

Lamping and Veach's jump hash keeps no ring: a 64-bit linear congruential generator seeded by the key says at which
shard counts the key moves, and the last jump below the count is its shard.  Appending a shard moves 1/(n+1) of
the keys, all of them into the new shard.

Spark multiplies longs with an overflow check, so the generator's step modulo 2**64 is spelt in 16 and 32 bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the published jump hash.
MULTIPLIER = 2862933555777941757
#: Generator steps tried at first; keys that need more (a few in 10**20) go on exactly, up to the shard count.
STEPS = 64
#: Cells that each shard is numbered in; a cell's rows are sorted by one task (and spill), so raise it with the table.
CELLS = 512
#: A cell of more than HOT_ROWS rows, and of more than HOT_SHARE times its shard's mean, is numbered in PIECES pieces.
HOT_ROWS, HOT_SHARE, PIECES = 1 << 16, 4, 64

_LOW32, _LOW16 = (1 << 32) - 1, (1 << 16) - 1


def next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64."""
    hi, lo = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_LOW32))
    cl, ch = F.lit(MULTIPLIER & _LOW32), F.lit(MULTIPLIER >> 32)
    t0 = lo.bitwiseAND(F.lit(_LOW16)) * cl + F.lit(1)
    t1 = F.shiftrightunsigned(lo, 16) * cl + F.shiftrightunsigned(t0, 16)
    low = F.shiftleft(t1.bitwiseAND(F.lit(_LOW16)), 16).bitwiseOR(t0.bitwiseAND(F.lit(_LOW16)))
    high_low = hi.bitwiseAND(F.lit(_LOW16)) * cl + F.shiftleft((F.shiftrightunsigned(hi, 16) * cl).bitwiseAND(F.lit(_LOW16)), 16)
    high = ((lo * ch).bitwiseAND(F.lit(_LOW32)) + high_low.bitwiseAND(F.lit(_LOW32)) + F.shiftrightunsigned(t1, 16)).bitwiseAND(F.lit(_LOW32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def jumps(key: Column, shards: int) -> Column:
    """struct(state, shard, beyond): the key's shard among `shards`, and the first jump that reaches past them."""
    if shards < 1:
        raise ValueError("shards must be positive")

    def step(a: Column, _: Column) -> Column:
        state = next_state(a["state"])
        to = (a["beyond"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(state, 33) + F.lit(1)).cast("double"))
        return F.when(a["beyond"] < shards, F.struct(state.alias("state"), a["beyond"].alias("shard"), F.floor(to).cast("long").alias("beyond"))).otherwise(a)

    start = F.struct(key.cast("long").alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("beyond"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(STEPS, shards))), start, step)
    if shards <= STEPS:
        return first
    return F.when(first["beyond"] >= shards, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step))


def assign_shards(df: DataFrame, key: str, shards: int, cells: int = CELLS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add `shard`, `slot` and `grown_shard` (the shard if one more is appended) to every row.

    `slot` numbers the rows of a shard from 0 without gaps.  Each shard is cut into `cells` cells by low bits of
    the generator's first state; cells are counted (map-side combined), the counts of at most shards * cells
    cells are broadcast as offsets, and rows are numbered inside their cell by key.  A cell with a hot key, one of
    more than `hot_rows` rows and HOT_SHARE times its shard's mean, is cut into PIECES pieces by a hash of the
    whole row, which are counted and offset alike.  So no task sorts a whole shard, nor all rows of a hot key; only
    rows that are equal in every column share a piece.

    A null key counts as key 0.  Rows with equal keys share the shard and get different slots.  Columns named
    `shard`, `slot` or `grown_shard` are replaced; an empty table gives an empty one.
    """
    if cells & (cells - 1):
        raise ValueError("cells must be a power of two")
    own = [c for c in df.columns if c.lower() not in {"shard", "slot", "grown_shard"}]
    k = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0).cast("long"))
    cell = F.shiftrightunsigned(next_state(k), 33).bitwiseAND(F.lit(cells - 1)).cast("int")
    types = dict(df.dtypes)
    piece = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in own if "map<" not in types[c] and "variant" not in types[c])), F.lit(PIECES)).cast("int")

    def placed(base: DataFrame, *columns: Column) -> DataFrame:
        found = base.select(*columns, cell.alias("__cell"), piece.alias("__piece"), jumps(k, shards).alias("__jump"))
        rest = [F.col(f"`{c}`") for c in found.columns if c != "__jump"]
        return found.select(*rest, F.col("__jump.shard").cast("int").alias("shard"), F.when(F.col("__jump.beyond") == shards, shards).otherwise(F.col("__jump.shard")).cast("int").alias("grown_shard"))

    pieces = placed(df).groupBy("shard", "__cell", "__piece").agg(F.count(F.lit(1)).alias("n"))
    sizes = pieces.groupBy("shard", "__cell").agg(F.sum("n").alias("__n"), F.map_from_entries(F.collect_list(F.struct("__piece", "n"))).alias("__of"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    hot = F.col("__n") > F.greatest(F.lit(hot_rows), F.sum("__n").over(Window.partitionBy("shard")) * HOT_SHARE / F.lit(cells))
    earlier = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda p: F.aggregate(F.map_values(F.map_filter("__of", lambda q, _: q < p)), F.lit(0).cast("long"), lambda a, n: a + n))
    offsets = sizes.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"), F.when(hot, earlier).alias("__earlier"))
    rows = placed(df, *(F.col(f"`{c}`") for c in own)).join(F.broadcast(offsets), ["shard", "__cell"])
    # one piece, number 0, where a cell isn't hot
    rows = rows.withColumns({"__from": F.col("__from") + F.coalesce(F.get("__earlier", F.col("__piece")), F.lit(0)), "__piece": F.when(F.col("__earlier").isNotNull(), F.col("__piece")).otherwise(0)}).drop("__earlier")
    order = Window.partitionBy("shard", "__cell", "__piece").orderBy(F.col(f"`{key}`").asc_nulls_first(), *(F.col(f"`{c}`") for c in own if c != key and types[c] in ("bigint", "int", "string")))
    return rows.select(*(F.col(f"`{c}`") for c in own), "shard", (F.col("__from") + F.row_number().over(order) - 1).alias("slot"), "grown_shard")


def op9(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document's shard under law `key`; a null text has size 1 and the checksum of no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(sized, "doc_id", shards).withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def crc_table() -> list[int]:
    """The 256 remainders of the reflected CRC-32 polynomial."""
    out = []
    for v in range(256):
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def oracle_sql(shards: int = 8, cells: int = CELLS) -> str:
    """DuckDB: the generator in UHUGEINT arithmetic, one subquery for each of the `shards` steps; crc32 byte by byte."""
    advance = f"((s * {MULTIPLIER}::uhugeint + 1) % 18446744073709551616::uhugeint)"
    inner = "select doc_id, text, coalesce(doc_id, 0)::uhugeint s, -1 b, 0::bigint j from documents"
    inner = f"select *, ({advance} // 8589934592::uhugeint)::bigint % {cells} cell from ({inner})"
    for _ in range(shards):
        inner = f"select doc_id, text, cell, case when j < {shards} then {advance} else s end s, case when j < {shards} then j else b end b, case when j < {shards} then floor((j + 1) * (2147483648.0::double / (({advance} // 8589934592::uhugeint)::double + 1)))::bigint else j end j from ({inner})"
    hexed = "regexp_extract_all(hex(coalesce(text, '')), '..')"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform({hexed}, lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295::bigint)"
    return f"""select doc_id, strlen(coalesce(text, ''))::bigint + 1 as size, {crc} as text_crc32, 'key' as law, b::integer as shard,
        row_number() over (partition by b order by cell, doc_id nulls first) - 1 as slot, (case when j = {shards} then {shards} else b end)::integer as grown_shard
        from ({inner}), (select {crc_table()}::bigint[] as tab)"""
