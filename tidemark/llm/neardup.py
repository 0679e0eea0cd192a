"""Near-duplicates by min-max hashing: banded signatures propose, full shingle sets decide.

Each hash function of a set of shingles yields two values, its minimum and its maximum, both of which two sets share
with a chance that is their Jaccard similarity; so half the hash evaluations fill a signature.  Minima and maxima alike
are cut into bands, no band taking both from one function; documents that agree on a band are candidates.  With 40 bands
of five values a pair at similarity 0.8 has no common band once in eight million.

Documents with equal sets form a class, and only its smallest doc_id takes part in the search.  In a bucket of
candidates no pairs are listed.  At first every class is compared with one pivot, the smallest id that it shares a
bucket with; that connects most of what is alike, and leaves each class with its difference from the pivot.  Then the
members of a bucket that belong to different components are compared, block against block: two sets that differ from
the same pivot by known shingles have an overlap that follows from those, so such pairs are decided exactly on the
spot, and of the links found only those come out that join what the block had not joined.  Pairs of different pivots
come out to be confirmed on their texts, unless their signatures put them far below the limit (SURE_MARGIN).  So
nothing is capped, and a bucket of near copies costs its size in rows, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, slices, stored, tidied
from tidemark.llm.graph import components, join_unique

#: Hash functions (two signature values each), bands, and values in a band.
HASHES, BANDS, BAND = 100, 40, 5
#: Members of a block; members of a pivot that meet it in one task.
BLOCK, CHUNK = 128, 64
#: Pairs of different pivots whose 8-bit signatures put their similarity this much or more below the limit are not confirmed; at the limit 0.8 that passes over a pair once in sixty million.
SURE_MARGIN = 0.17
#: Rows up to which a table of ids (16 bytes each) is broadcast; longer ones are joined by shuffling.
BROADCAST_IDS = 300_000
#: Entries of a worker's cache of word hashes.
CACHE_ENTRIES = 150_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's `size`-word shingles; A-Z count as a-z, white space is ASCII's six.

    With fewer words the whole sequence is one shingle; without any the set is empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_words) > CACHE_ENTRIES:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        out = out * _MIX + h[i : len(h) - span + 1 + i]
    return np.unique(_mixed(out))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_24)
    return r.integers(0, 2**64, n, np.uint64), r.integers(0, 2**64, n, np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """The min-max signatures of non-empty sets: a row of 2 * hashes values for each, minima first."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), 2 * hashes), np.uint64)
    for i, (x, a) in enumerate(zip(*_seeds(hashes), strict=True)):
        h = (flat ^ x) * a
        out[:, i], out[:, hashes + i] = np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, band: int = BAND) -> np.ndarray:
    """A 64-bit key for each band of each signature: band j takes the values j, j + bands, j + 2 bands and so on."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX + np.zeros((len(sig), 1), np.uint64)
    for i in range(band):
        out = _mixed(out * _MIX + sig[:, i * bands : (i + 1) * bands])
    return out.view(np.int64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, bands, short): set size, 128-bit digest of the set, 64-bit band keys, 8-bit signature.

    Empty sets have null sketches."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            sig = signatures([sets[i] for i in full]) if len(full) else np.zeros((0, 2 * HASHES), np.uint64)
            keys, short = band_keys(sig), (sig >> np.uint64(40)).astype(np.uint8)
            digests = [xxhash.xxh3_128_intdigest(sets[i].tobytes()) for i in full]
            spread = np.full(len(n), -1)
            spread[full] = np.arange(len(full))
            at = pa.array(spread, mask=spread < 0)
            sign = lambda x: x - (1 << 64) if x >> 63 else x
            hi, lo = (pa.array([sign(d >> 64) for d in digests], pa.int64()), pa.array([sign(d & (1 << 64) - 1) for d in digests], pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            return [pa.array(n, pa.int32()), hi.take(at), lo.take(at), lists.take(at), pa.array([s.tobytes() for s in short], pa.binary()).take(at)]

        return work

    fields = [pa.field("n_shingles", pa.int32()), pa.field("set_hi", pa.int64()), pa.field("set_lo", pa.int64()), pa.field("bands", pa.list_(pa.int64())), pa.field("short", pa.binary())]
    return map_batches(docs, "text", make, fields, ["doc_id"])


def _small(ids: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids


_OVERLAPS = "a bigint, b bigint, x_n int, y_n int, both int, whole boolean, delta binary"


def _overlaps(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(a, b, x_n, y_n, both, whole, delta) of pairs (a, b, salts), on full sets: set sizes, intersection, and how b's set differs.

    `delta` holds the shingles that only one of both sets has, or b's whole set where that is smaller.  The members b of
    an `a` are dealt to as many groups as `salts` says; a task reads an `a` once for each of its groups, the members behind it."""

    def run(batches):
        last, held = None, None
        for whole in batches:
            for part in slices(whole, "text"):
                out = []
                for a, b, text in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                    if b is None:
                        last, held = a, shingle_set(text, size)
                        continue
                    if a != last:
                        raise ValueError("a pair came before its pivot")
                    other = shingle_set(text, size)
                    both = len(np.intersect1d(held, other, assume_unique=True))
                    apart = len(held) + len(other) - 2 * both
                    own = apart > len(other)
                    out.append((a, b, len(held), len(other), both, own, (other if own else np.setxor1d(held, other, assume_unique=True)).tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "x_n", "y_n", "both", "whole", "delta"])

    n = pairs.count()
    if not n:
        return docs.sparkSession.createDataFrame([], _OVERLAPS)
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select("doc_id", "text").join(_small(ids, n), "doc_id", "left_semi")
    members = dealt.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    pivots = dealt.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    met = pivots.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return met.select("a", "b", "text").mapInArrow(tidied(run), _OVERLAPS)


def _links(overlaps: DataFrame, percent: int) -> DataFrame:
    common, x, y = (F.col(c).cast("bigint") for c in ("both", "x_n", "y_n"))  # a hundred times a large set needs more than 32 bits
    return overlaps.filter((common > 0) & (100 * common >= percent * (x + y - common))).select("a", "b")


def _labels(links: DataFrame) -> DataFrame:
    """(rep, component) for rows that a link (a, b), a < b, ties to smaller ones, four links on.

    Some way towards the component's smallest id, enough to tell most of what is connected already; what it misses
    is only compared again."""
    up = links.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("component"))
    for _ in range(2):
        up = stored(up, "labels")
        top = up.select(F.col("rep").alias("component"), F.col("component").alias("top"))
        up = join_unique(up, top, "component").select("rep", F.coalesce("top", "component").alias("component"))
    return up


class _Block:
    """Members of a bucket as arrays: ids, set sizes, components, signatures, band keys before this bucket's, frames, and differences end to end."""

    def __init__(self, items: pa.StructArray):
        self.rep, self.n, self.component, self.pivot, self.whole = (items.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "component", "pivot", "whole"))
        self.n = self.n.astype(np.int64)
        rows = len(self.rep)
        self.short = np.frombuffer(b"".join(items.field("short").to_pylist()), np.uint8).reshape(rows, -1)
        self.keys = np.array(items.field("keys").flatten()).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)
        deltas = items.field("delta").to_pylist()
        self.sizes = np.array([len(d) // 8 for d in deltas], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.delta = np.frombuffer(b"".join(deltas), np.uint64)


def compare(x: _Block, y: _Block, percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links that join components of two blocks of a bucket, and pairs that only their texts can decide.

    |x & y| = (|x| + |y| - |x ^ y|) / 2, and for sets that differ from the same pivot by dx and dy, |x ^ y| is
    |dx| + |dy| - 2 |dx & dy|.  Pairs that agree on a band before this one are left to that bucket."""
    _, codes = np.unique(np.concatenate([x.delta, y.delta]), return_inverse=True)
    mine, others = codes[: len(x.delta)], codes[len(x.delta) :]
    mark, upto = np.zeros(len(codes) + 1, bool), np.zeros(len(others) + 1, np.int64)
    of_x, of_y = x.component.copy(), y.component.copy()
    sure, unsure = [], []
    for k, (rep, n) in enumerate(zip(x.rep, x.n, strict=True)):
        most = np.minimum(y.n, n)
        at = np.flatnonzero((of_y != of_x[k]) & (100 * most >= percent * (y.n + n - most)))
        at = at[~(y.keys[at] == x.keys[k]).any(axis=1)]
        if not len(at):
            continue
        framed = np.where(y.whole[at], x.whole[k], ~x.whole[k] & (y.pivot[at] == x.pivot[k]))
        exact, open_ = at[framed], at[~framed]
        if len(exact):
            own = mine[x.ends[k] - x.sizes[k] : x.ends[k]]
            mark[own] = True
            np.cumsum(mark[others], out=upto[1:])
            mark[own] = False
            shared = upto[y.ends[exact]] - upto[y.ends[exact] - y.sizes[exact]]
            total = n + y.n[exact]
            both = np.where(y.whole[exact], shared, (total - x.sizes[k] - y.sizes[exact] + 2 * shared) // 2)
            for j in exact[(both > 0) & (100 * both >= percent * (total - both))]:
                if of_y[j] != of_x[k]:
                    sure.append((min(rep, y.rep[j]), max(rep, y.rep[j])))
                    old = of_y[j]
                    of_x[of_x == old] = of_x[k]
                    of_y[of_y == old] = of_x[k]
        if len(open_):
            open_ = open_[of_y[open_] != of_x[k]]
            open_ = open_[(y.short[open_] == x.short[k]).mean(axis=1) * 256 - 1 >= (percent / 100 - SURE_MARGIN) * 255]
            unsure += [(min(rep, r), max(rep, r)) for r in y.rep[open_]]
    return sure, unsure


def _across(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure): links, and pairs to be confirmed, of different components in the same bucket, compared block against block.

    members: (band, place, rep, n, component, short, keys, pivot, whole, delta, lo, c): `keys` are the bands before this one,
    `delta` is the difference from the pivot or the whole set; c rows in the band, whose smallest component is lo.  A bucket is
    cut by hash into blocks of about BLOCK members, apart for component lo (usually nearly all) and the others; blocks
    of the others meet each other and those of lo."""
    cut = F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / BLOCK)).cast("int")
    item = F.struct("rep", "n", "component", "short", "keys", "pivot", "whole", "delta")
    blocks = stored(members.groupBy("band", "place", (F.col("component") == F.col("lo")).alias("main"), cut.alias("part")).agg(F.collect_list(item).alias("items")), "blocks")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "y"):
                found = {True: set(), False: set()}
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    for kind, pairs in zip((True, False), compare(_Block(x.values), _Block(y.values), percent), strict=True):
                        found[kind].update(pairs)
                rows = [(int(a), int(b), kind) for kind, pairs in found.items() for a, b in sorted(pairs)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "sure"])

    left = blocks.filter("not main").select("band", "place", F.col("part").alias("i"), F.col("items").alias("x"))
    right = blocks.select("band", "place", "main", F.col("part").alias("j"), F.col("items").alias("y"))
    return left.join(right, ["band", "place"]).filter("main or i <= j").select("x", "y").mapInArrow(tidied(run), "a bigint, b bigint, sure boolean").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int, also: DataFrame | None = None) -> DataFrame:
    """(node, component) of the linked classes; classes: (rep, n, bands, short), stored; `also` (a, b) are further links."""
    rows = classes.select("rep", "n", F.posexplode("bands").alias("place", "band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("pivot")).filter("c > 1")
    buckets = stored(rows.join(shared, "band").select("band", "place", "rep", "n", "pivot", "c"), "buckets")
    # at first each class meets the smallest of its buckets' pivots alone: mostly all it takes
    first = buckets.filter("rep <> pivot").groupBy(F.col("rep").alias("b")).agg(F.min("pivot").alias("a"), F.ceil(F.max("c") / CHUNK).alias("salts"))
    overlaps = stored(_overlaps(stored(first, "first"), docs, size), "overlaps")
    links = _links(overlaps, percent)
    # then whatever shares a bucket, isn't known to be connected, and could be alike
    known = stored(buckets.select("band", "place", "rep", "n", "c").join(_labels(links), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "known")
    open_bands = known.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "lo")
    # a pivot of its own differs from itself in nothing
    apart = overlaps.select(F.col("b").alias("rep"), F.col("a").alias("pivot"), "whole", "delta").dropDuplicates(["rep"])
    met = classes.select("rep", "short", "bands").join(apart, "rep", "left").select("rep", "short", "bands", F.coalesce("pivot", "rep").alias("pivot"), F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("delta", F.lit("").cast("binary")).alias("delta"))
    members = known.join(open_bands, "band").join(met, "rep").withColumn("keys", F.slice("bands", F.lit(1), F.col("place"))).drop("bands")
    pairs = stored(_across(members, percent), "pairs")
    confirmed = _links(_overlaps(pairs.filter("not sure").select("a", "b", F.lit(16).alias("salts")), docs, size), percent)
    all_links = links.unionByName(pairs.filter("sure").select("a", "b")).unionByName(confirmed)
    return components(stored(all_links if also is None else all_links.unionByName(also), "links"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest doc_id reachable over links of similarity >= percent / 100.

    Documents with empty sets (null, empty or blank texts) link with nothing; rows without doc_id take part in
    nothing and have a null component.  A doc_id stands for one document: rows that repeat it share its component, and
    if their texts differ, links of any of them are links of the document.  An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    sketches = stored(sketch(docs, size), "sketches")
    known = sketches.filter("doc_id is not null").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("set_hi", "set_lo")))
    ends = known.groupBy("doc_id").agg(*(f(c).alias(f"{c}_{i}") for c in ("set_hi", "set_lo") for i, f in enumerate((F.min, F.max))))
    several = stored(ends.filter("set_hi_0 <> set_hi_1 or set_lo_0 <> set_lo_1").select("doc_id"), "several")
    if several.isEmpty():
        return _by_component(docs, sketches, size, percent)
    # each text of such a doc_id becomes a node of its own, and all of them are linked
    rows = stored(docs.join(several.withColumn("split", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("split"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("node"), "text"), "nodes")
    split = rows.filter("doc_id <> node").select("doc_id", "node").distinct()
    also = split.join(split.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))
    nodes = rows.select(F.col("node").alias("doc_id"), "text")
    found = _by_component(nodes, stored(sketch(nodes, size), "sketches"), size, percent, also).filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumnsRenamed({"doc_id": "node", "component_id": "part"})
    placed = stored(rows.select("doc_id", "node").join(found, "node", "left"), "placed")
    least = placed.groupBy("part").agg(F.min("doc_id").alias("component_id")).filter("part is not null")
    empty = sketches.filter("doc_id is null").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return placed.filter("doc_id is not null").join(least, "part").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def _by_component(docs: DataFrame, sketches: DataFrame, size: int, percent: int, also: DataFrame | None = None) -> DataFrame:
    """`near_duplicates` of documents whose doc_id stands for one text; `also` are links between them that hold anyway."""
    keyed = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(keyed.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.join(keyed.select(F.col("doc_id").alias("rep"), "set_hi", "set_lo", F.col("n_shingles").alias("n"), "bands", "short"), ["rep", "set_hi", "set_lo"]).dropDuplicates(["rep"])
    if also is not None:  # between ids, not classes: the ids of a class are links as well
        same = keyed.join(classes, ["set_hi", "set_lo"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
        also = also.unionByName(same)
    linked = stored(link_classes(docs, stored(reps.select("rep", "n", "bands", "short"), "reps"), size, percent, also), "linked")
    if also is not None:
        out = sketches.select("doc_id", "n_shingles").join(linked.withColumnsRenamed({"node": "doc_id", "component": "component_id"}), "doc_id", "left")
    else:
        of_class = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"))
        out = sketches.select("doc_id", "n_shingles", "set_hi", "set_lo").join(of_class, ["set_hi", "set_lo"], "left")
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op10(docs: DataFrame) -> DataFrame:
    """Every document's component under four-word shingles, and whether it is the one that stays."""
    return near_duplicates(docs, size=4).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose component has a smaller doc_id; all columns stay."""
    gone = stored(near_duplicates(docs, size, percent).filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(_small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def oracle_sql(size: int = 4, percent: int = 80) -> str:
    """DuckDB: all pairs that share a shingle, and a recursive walk over the links."""
    runs = ", ".join(f"w[{i + 1}:{i - size}]" for i in range(size))
    return f"""with recursive split as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
        sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {size} then [hash(array_to_string(w, ' '))] else list_transform(list_zip({runs}), lambda x: hash(x)) end) s from split),
        one as (select doc_id, unnest(s) g from sets),
        shared as (select x.doc_id a, y.doc_id b, count(*) c from one x join one y on x.g = y.g and x.doc_id <> y.doc_id group by all),
        links as (select a, b from shared join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * c >= {percent} * (len(p.s) + len(q.s) - c)),
        reach as (select doc_id a, doc_id b from sets union select r.a, l.b from reach r join links l on r.b = l.a)
        select a as doc_id, len(s)::bigint as n_shingles, min(b) as component_id, a = min(b) as kept from reach join sets on doc_id = a group by a, len(s)"""
