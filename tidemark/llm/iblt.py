"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame expressions alone.

A text's distinct paragraphs (its non-empty lines) are hashed to 64-bit digests.  A sketch has cells in three equal
parts; a digest goes into one cell of each part, and a cell keeps a count, the XOR of digests and the XOR of their
check values.  Subtracting two sketches cancels what both hold.  A cell that then holds a single digest shows it by
the check value; taking that digest out of its other cells bares more, until the sketch is empty and the digests on
which the two versions differ are known.

The fingerprint has CELLS cells.  If two fingerprints differ in more than those can hold, peeling gets stuck and both
sides are sketched again, larger: their digests are dealt to strata, four times as many with each turn, each stratum
with CELLS cells, and whatever stratum is stuck is dealt and sketched again.  Dealing goes level by level, so a
digest is looked at as often as there are levels, and a text costs about as much as it has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a fingerprint and of each stratum; digests that a stratum of the first larger attempt holds at most on average.
CELLS, LOAD = 24, 8
#: Peeling rounds in a sketch; further dealings of stuck strata, each by other bits (two digests stay together in all of them once in 10**24).
ROUNDS, TURNS = 10, 40
#: Rows of a block of neighbouring documents, about.
BLOCK_ROWS = 200_000

_LONG = "bigint"


def _place(key: Column, part: int) -> Column:
    return (F.pmod(F.xxhash64(key, F.lit(part)), F.lit(CELLS // 3)) + F.lit(part * (CELLS // 3))).cast("int")


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs with their check values and cells."""
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p)))
    return F.transform(keys, lambda k: F.struct(F.lit(1).alias("n"), k.alias("key"), F.xxhash64(k, F.lit(-1)).alias("chk"), *(_place(k, i).alias(f"p{i}") for i in range(3))))


def _in(e: Column, i: Column) -> Column:
    return (e["p0"] == i) | (e["p1"] == i) | (e["p2"] == i)


def _less(a: Column, e: Column) -> Column:
    return F.struct((a["n"] - e["n"]).alias("n"), a["key"].bitwiseXOR(e["key"]).alias("key"), a["chk"].bitwiseXOR(e["chk"]).alias("chk"))


def _nothing() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast(_LONG).alias("key"), F.lit(0).cast(_LONG).alias("chk"))


def sketch(entries: Column) -> Column:
    """The cells: an array of struct(n, key, chk)."""

    def add(a: Column, e: Column) -> Column:
        return F.struct((a["n"] + e["n"]).alias("n"), a["key"].bitwiseXOR(e["key"]).alias("key"), a["chk"].bitwiseXOR(e["chk"]).alias("chk"))

    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.aggregate(F.filter(entries, lambda e: _in(e, i)), _nothing(), add))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _less)


def _keys(bare: Column, sign: int) -> Column:
    return F.transform(F.filter(bare, lambda e: e["n"] == sign), lambda e: e["key"])


def _no_keys() -> Column:
    return F.array().cast("array<bigint>")


def peel(cells: Column) -> Column:
    """struct(mine, theirs): the digests that either side of a difference holds alone; null if peeling gets stuck."""

    def round_(s: Column, _: Column) -> Column:
        single = F.array_distinct(F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == F.xxhash64(c["key"], F.lit(-1)))))
        bare = F.transform(single, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"), c["chk"].alias("chk"), *(_place(c["key"], i).alias(f"p{i}") for i in range(3))))
        # `bare` is bound once, as the only element of an array
        after = F.transform(
            F.array(bare),
            lambda bs: F.struct(
                F.transform(s["cells"], lambda c, i: F.aggregate(F.filter(bs, lambda e: _in(e, i)), c, _less)).alias("cells"),
                F.concat(s["mine"], _keys(bs, 1)).alias("mine"),
                F.concat(s["theirs"], _keys(bs, -1)).alias("theirs"),
            ),
        )[0]
        return F.when(F.exists(s["cells"], lambda c: F.abs(c["n"]) == 1), after).otherwise(s)

    start = F.struct(cells.alias("cells"), _no_keys().alias("mine"), _no_keys().alias("theirs"))
    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.when(~left(s), F.struct(s["mine"].alias("mine"), s["theirs"].alias("theirs"))))


def _dealt(pairs: Column, turn: Column) -> Column:
    """Each pair of both sides' digests as four pairs, by a hash of the digest and the turn (unlike those of cells); empty ones go."""
    four = lambda x: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.struct(*(F.filter(x[side], lambda e: F.pmod(F.xxhash64(e["key"], turn), F.lit(4)) == s).alias(side) for side in "ab")))
    return F.filter(F.flatten(F.transform(pairs, four)), lambda x: (F.size(x["a"]) > 0) | (F.size(x["b"]) > 0))


def _apart(a: Column, b: Column) -> Column:
    """struct(mine, theirs): what two sets of digests do not share, from sketches of strata that grow until all are peeled."""
    # four times as many strata for each level, until LOAD digests are left for each
    levels = F.ceil(F.log2(F.greatest((F.size(a) + F.size(b)) / LOAD, F.lit(1.0))) / 2).cast("int")
    pair = F.array(F.struct(a.alias("a"), b.alias("b")))
    strata = F.aggregate(F.filter(F.sequence(F.lit(0), levels), lambda i: i > 0), pair, lambda p, i: _dealt(p, i + 1000))

    def turn(s: Column, i: Column) -> Column:
        solved = F.transform(s["open"], lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), peel(subtract(sketch(x["a"]), sketch(x["b"]))).alias("d")))
        # `solved` is bound once, as the only element of an array
        after = F.transform(
            F.array(solved),
            lambda xs: F.struct(
                _dealt(F.transform(F.filter(xs, lambda x: x["d"].isNull()), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), i + 2000).alias("open"),
                *(F.concat(s[side], F.flatten(F.transform(F.filter(xs, lambda x: x["d"].isNotNull()), lambda x: x["d"][side]))).alias(side) for side in ("mine", "theirs")),
            ),
        )[0]
        return F.when(F.size(s["open"]) > 0, after).otherwise(s)

    start = F.struct(strata.alias("open"), _no_keys().alias("mine"), _no_keys().alias("theirs"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TURNS)), start, turn, lambda s: F.struct(s["mine"].alias("mine"), s["theirs"].alias("theirs")))


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """struct(mine, theirs): the digests that one of two sets holds alone, from their fingerprints or, where those are too small, larger sketches."""
    return F.coalesce(peel(subtract(cells_a, cells_b)), _apart(a, b))


def likeness(a: Column, diff: Column) -> Column:
    """Shared digests over all digests of both sides; 1 if both have none."""
    union = F.size(a) + F.size(diff["theirs"])
    return F.when(union == 0, F.lit(1.0)).otherwise((F.size(a) - F.size(diff["mine"])) / union)


def as_text(cells: Column) -> Column:
    return F.concat_ws(";", F.transform(cells, lambda c: F.concat_ws(",", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["chk"]))))


def _below(edges: Column, x: Column, size: int, strictly: bool) -> Column:
    """How many of `size` sorted edges are below x (or not above it), by halving."""

    def step(s: Column, _: Column) -> Column:
        middle = ((s["lo"] + s["hi"]) / 2).cast("int")
        edge = F.get(edges, middle)
        left = edge >= x if strictly else edge > x
        narrowed = F.when(left, F.struct(s["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), s["hi"].alias("hi")))
        return F.when(s["lo"] < s["hi"], narrowed).otherwise(s)

    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(size.bit_length())), start, step, lambda s: s["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): every document's text and that of the next by descending doc_id, the first's after the last.

    Null ids come last; equal ids are ordered by a hash of the text, then by the text; a null text is empty.
    Documents are dealt to blocks of about BLOCK_ROWS by ranges of doc_id, an id that fills several blocks by its texts'
    hashes as well.  The first document of each block is also sent to the block before it, where it only serves as
    next.  So no task orders the whole table, nor all rows of one id.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.shiftrightunsigned(F.xxhash64("text"), 4)})
    n = docs.count()
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK_ROWS))
    ends = sorted(rows.agg(F.percentile_approx("at", [(k + 1) / blocks for k in range(blocks)], 10 * blocks).alias("e")).first().e or []) if n else []
    edges = F.lit(ends) if ends else F.array().cast("array<bigint>")
    low, high = _below(edges, F.col("at"), len(ends), True), _below(edges, F.col("at"), len(ends), False)
    share = F.floor(F.col("tie") / float(1 << 60) * F.greatest(high - low, F.lit(1))).cast("int")
    placed = rows.withColumn("block", low + F.least(share, F.greatest(high - low - 1, F.lit(0))))
    # a document's place in the order of all as one number, the block's largest coming first in it
    rank = F.col("at").cast("decimal(20,0)") * F.lit(1 << 60).cast("decimal(19,0)") + F.col("tie")
    tops = placed.select("block", rank.alias("rank")).groupBy("block").agg(F.max("rank").alias("top"))  # a row for each block
    above = F.lead("block").over(Window.orderBy("block"))
    tops = F.broadcast(tops.select("block", "top", F.coalesce(above, F.min("block").over(Window.partitionBy(F.lit(1)))).alias("before")))
    to = lambda block, guest: F.struct(block.alias("block"), F.lit(guest).alias("guest"))
    mine = to(F.col("block"), False)
    dealt = placed.withColumn("rank", rank).join(tops, "block").withColumn("to", F.explode(F.when(F.col("rank") == F.col("top"), F.array(mine, to(F.col("before"), True))).otherwise(F.array(mine))))
    order = Window.partitionBy("block").orderBy("guest", F.col("at").desc(), F.col("tie").desc(), "text")
    return dealt.select("doc_id", "text", "at", "tie", "to.block", "to.guest").withColumn("next", F.lead("text").over(order)).filter("not guest").select("doc_id", "text", "next")


def op8(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness to each other and to the next document's.

    `lost` and `gained` are the paragraph digests that peeling recovers: those of the text alone and of the edited text alone."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    texts = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(edited).alias("e"), digests(F.col("next")).alias("b"))
    cells = texts.select("*", *(sketch(F.col(c)).alias(f"{c}_cells") for c in "aeb"))
    c = F.col
    found = cells.select("*", difference(c("a"), c("e"), c("a_cells"), c("e_cells")).alias("d_e"), difference(c("a"), c("b"), c("a_cells"), c("b_cells")).alias("d_b"))
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(c("a_cells")).alias("fingerprint"), as_text(c("e_cells")).alias("edited_fingerprint"), likeness(c("a"), c("d_e")).alias("near_edited"), likeness(c("a"), c("d_b")).alias("near_next"), F.array_sort("d_e.mine").alias("lost"), F.array_sort("d_e.theirs").alias("gained"))
