"""How five filters interact in every order, by wide packed counters.

A document fails a subset of the filters, its mask.  What each of the 600 steps (120 orders of five) does to it follows
from the mask and its two labels, so each of the 128 combinations maps to one big integer whose 64-bit fields hold the
outcomes of all steps.  Adding these integers counts all steps at once; a field never carries into the next, as no
count reaches 2**57 rows.  The sums of tasks meet part by part, and the last sum is unpacked into 600 rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, tidied

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Counts of a step, in the order of their fields; those of a filter come once for each letter.
OF_STEP = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
OF_FILTER = ("unique_fails", "shapley")
#: Bits of a field, and rows that a part may have: the largest field counts a row 120 times.
FIELD_BITS, MOST_ROWS = 64, 1 << 56
#: Groups that the sums of one part come from, before they meet.
SALTS = 32

PACKED = "part string, packed binary, n_rows long"


def measure(text: bytes) -> int:
    """The mask of filters A to D that a text fails; white space is the six ASCII characters that bytes.split() knows."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    characters = len(text.translate(None, bytes(range(0x80, 0xC0))))  # without the bytes that continue one
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * characters) << 2
        | (len(text.translate(None, b"#$%&*|")) < len(text)) << 3
    )


def measure_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Add `mask` (filters A to D) and `digest` (SHA-256) of every whole text; a null reads as empty."""

    def work(batch: pa.RecordBatch) -> list:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return [pa.array(map(measure, texts), pa.int32()), pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())]

    return map_batches(docs, "text", lambda: work, [pa.field("mask", pa.int32()), pa.field("digest", pa.binary())], keep)


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Rows (part, mask, quality, toxic, n): how many documents of a part fail which filters.

    Copies are never gathered: rows of one text, part and label are counted before they are shuffled, with the smallest
    id and how often it occurs, and of a text's groups only those that hold its smallest id keep that many rows from
    failing E.  A null id counts as larger than all others.  A document with several labels has the larger of each.
    """
    by_id = labels.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")))
    measured = measure_texts(docs.select("doc_id", "text", F.coalesce(F.col(part), F.lit("")).alias("part")), ["doc_id", "part"])
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")]
    one = measured.join(by_id, "doc_id", "left").select("doc_id", "part", "mask", "digest", *flags)
    group = ["part", "mask", "digest", "quality", "toxic"]
    rows = one.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "n")
    groups = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.min(order).alias("first"))
    head = F.struct("first.absent", "first.doc_id")
    of_text = Window.partitionBy("digest")
    firsts = groups.withColumn("passing", F.when(head == F.min(head).over(of_text), F.col("first.n")).otherwise(F.lit(0)))
    both = F.array(
        F.struct("mask", F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    return firsts.select("part", "quality", "toxic", F.inline(both)).filter("n > 0")


def outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """The fields of one document: unique_fails and shapley of each filter, then five counts of each step."""
    steps = np.zeros((len(ORDERS), len(LETTERS), len(OF_STEP)), np.uint64)
    of_filter = np.zeros((len(OF_FILTER), len(LETTERS)), np.uint64)
    for letter in range(len(LETTERS)):
        of_filter[0, letter] = mask == 1 << letter
    for o, order in enumerate(ORDERS):
        failing = [s for s, letter in enumerate(order) if mask >> LETTERS.index(letter) & 1]
        first = failing[0] if failing else len(LETTERS)
        steps[o, :first, 0] = 1
        for s in failing[1:]:
            steps[o, s, 2] = 1
        if failing:
            steps[o, first, 1:] = 1, 0, good, toxic
            of_filter[1, LETTERS.index(order[first])] += 1
    return np.concatenate([of_filter.ravel(), steps.ravel()])


@lru_cache(1)
def packed_outcomes() -> dict[tuple[int, bool, bool], int]:
    """The big integer of every mask and pair of labels: field i is worth 2 ** (64 i)."""
    combinations = product(range(1 << len(LETTERS)), (False, True), (False, True))
    return {key: int.from_bytes(outcomes(*key).astype("<u8").tobytes(), "little") for key in combinations}


FIELDS = len(OF_FILTER) * len(LETTERS) + len(ORDERS) * len(LETTERS) * len(OF_STEP)


def to_batch(sums: dict[str, list[int]]) -> pa.RecordBatch:
    """Sums by part as rows."""
    size = FIELDS * FIELD_BITS // 8
    packed = [total.to_bytes(size, "little") for total, _ in sums.values()]
    arrays = [pa.array(sums.keys(), pa.string()), pa.array(packed, pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "packed", "n_rows"])


def add(sums: dict[str, list[int]], part: str, total: int, n: int) -> None:
    """Add to a part's sum; an overflow of a field would be silent, so it is ruled out by the count of rows."""
    at = sums.setdefault(part, [0, 0])
    at[0] += total
    at[1] += n
    if at[1] > MOST_ROWS:
        raise OverflowError(f"part {part!r} has more rows than a field of {FIELD_BITS} bits can count")


def sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One big integer for each part of a task; a task with many parts hands on what it has."""
    table, sums = packed_outcomes(), {}
    for batch in batches:
        for part, mask, good, toxic, n in zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "quality", "toxic", "n")), strict=True):
            add(sums, part, n * table[mask, good, toxic], n)
            if len(sums) > 500:
                yield to_batch(sums)
                sums = {}
    yield to_batch(sums)


def merge(rows: pa.Table) -> pa.Table:
    """The sum of one group's integers: one row for each task of a salt, or for each salt of a part."""
    sums: dict[str, list[int]] = {}
    for part, packed, n in zip(*(rows.column(c).to_pylist() for c in ("part", "packed", "n_rows")), strict=True):
        add(sums, part, int.from_bytes(packed, "little"), n)
    return pa.Table.from_batches([to_batch(sums)])


def pack(counted: DataFrame) -> DataFrame:
    """Rows (part, packed, n_rows) from `masks`: the big integers summed in tasks, then in salted groups, then by part."""
    in_tasks = counted.mapInArrow(tidied(sum_task), PACKED).withColumn("salt", F.spark_partition_id() % SALTS)
    salted = in_tasks.groupBy("part", "salt").applyInArrow(lambda key, rows: merge(rows), PACKED)
    return salted.groupBy("part").applyInArrow(lambda key, rows: merge(rows), PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """The 600 rows of each part."""
    names = [*OF_STEP, *OF_FILTER]
    fields = [pa.field("part", pa.string()), pa.field("filter_order", pa.string()), pa.field("step", pa.int32()), *(pa.field(n, pa.int64()) for n in names)]
    order_column = pa.array([o for o in ORDERS for _ in LETTERS], pa.string())
    step_column = pa.array([s + 1 for _ in ORDERS for s in range(len(LETTERS))], pa.int32())
    letter_of = np.array([LETTERS.index(letter) for o in ORDERS for letter in o])
    n = len(letter_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, wide in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                values = np.frombuffer(wide, "<u8").astype(np.int64)
                of_filter = values[: len(OF_FILTER) * len(LETTERS)].reshape(len(OF_FILTER), len(LETTERS))
                steps = values[of_filter.size :].reshape(n, len(OF_STEP))
                counts = [*steps.T, *(of_filter[i][letter_of] for i in range(len(OF_FILTER)))]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), order_column, step_column, *(pa.array(np.ascontiguousarray(c)) for c in counts)], schema=pa.schema(fields))

    from pyspark.sql.pandas.types import from_arrow_schema

    return packed.mapInArrow(tidied(run), from_arrow_schema(pa.schema(fields)))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What each of five filters removes at each step of each order, for every value of `part`.

    Needs doc_id, text and `part`; other columns may be there under any name.  A null or empty text has no words, so it
    fails A alone, and E if a smaller id has an empty text as well; rows that share the smallest id of a text don't
    fail E.  A null part is the empty string.  An empty table gives no rows.
    """
    return unpack(pack(masks(docs, labels, part)))


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit by language."""
    return audit_filters(docs, labels).select("part", "filter_order", "step", *OF_STEP, *OF_FILTER)


def oracle_sql() -> str:
    """DuckDB SQL for `op12`: masks counted by part, met with every step of every order."""
    fails = [
        "n_words < 200",
        "100 * n_distinct < 50 * n_words",
        r"100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t)",
        r"regexp_matches(t, '[#$%&*|]')",
        "coalesce(doc_id > first_id, first_id is not null)",
    ]
    mask = " + ".join(f"(case when {c} then {1 << i} else 0 end)" for i, c in enumerate(fails))
    before = reduce(lambda a, i: f"{a} | (case when s.step > {i} then 1 << (instr('ABCDE', substr(s.o, {i}, 1)) - 1) else 0 end)", range(1, 5), "0")
    return rf"""
with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') part from documents),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) quality, max((coalesce(toxic, 0) = 1)::int) toxic from labels group by 1),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') words, min(doc_id) over (partition by t) first_id from d),
c as (select *, len(words) n_words, len(list_distinct(words)) n_distinct from w),
m as (select part, {mask} mask, coalesce(quality, 0) good, coalesce(toxic, 0) bad, count(*) n from c left join l using (doc_id) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
orders as (select a.x || b.x || c.x || d.x || e.x o from letters a, letters b, letters c, letters d, letters e
           where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select o, unnest([1, 2, 3, 4, 5])::int step from orders),
f as (select o, step, 1 << (instr('ABCDE', substr(o, step, 1)) - 1) bit, {before} earlier from s),
steps as (select part, o filter_order, step, bit,
  sum(case when mask & (bit | earlier) = 0 then n else 0 end)::bigint kept,
  sum(case when mask & bit > 0 and mask & earlier = 0 then n else 0 end)::bigint removed,
  sum(case when mask & bit > 0 and mask & earlier > 0 then n else 0 end)::bigint redundant,
  sum(case when mask = bit then n else 0 end)::bigint unique_fails,
  sum(case when mask & bit > 0 and mask & earlier = 0 then n * good else 0 end)::bigint good_lost,
  sum(case when mask & bit > 0 and mask & earlier = 0 then n * bad else 0 end)::bigint toxic_lost
  from m cross join f group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint shapley from steps"""
