"""Entity resolution by name, and the relation graph built on it."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import pit
from tidemark.sources.scratch import stored

#: Score from which a fuzzy match counts.
THRESHOLD = 88.0
#: Names and keys that meet in a block; pairs of a block that are scored one by one.
NAMES, KEYS, FEW = 1024, 4096, 256
#: Sizes of character runs that are signatures.
GRAMS = (3, 2, 1)
#: Groups of characters of a cell, and the counts from which a group's levels start.
GROUPS, LEVELS = 5, (0, 2, 4, 6, 9)


def index(registry: DataFrame) -> DataFrame:
    """(key, entity_id): normalised names and tickers of a registry (entity_id, name, ticker, pos); the first of equals wins."""
    r = registry.filter("entity_id is not null")
    keys = r.select(fn.normalise_name(F.col("name")).alias("key"), "entity_id", "pos").union(r.select(F.upper(F.trim("ticker")).alias("key"), "entity_id", "pos"))
    return keys.filter("key <> ''").groupBy("key").agg(F.min_by("entity_id", F.struct("pos", "entity_id")).alias("entity_id"))


def attribute_news(news: DataFrame, registry: DataFrame, keep_unresolved: bool = True) -> DataFrame:
    """Add entity_id: by the first actor's upper-cased name, else the second's, else a placeholder (or the row goes)."""
    names = registry.groupBy(F.upper("name").alias("n")).agg(F.min_by("entity_id", "pos").alias("e"))
    one, two = names.select(F.col("n").alias("__n1"), F.col("e").alias("__e1")), names.select(F.col("n").alias("__n2"), F.col("e").alias("__e2"))
    rows = news.withColumns({"__n1": F.upper("actor1_name"), "__n2": F.upper("actor2_name")}).join(one, "__n1", "left").join(two, "__n2", "left")
    label = F.coalesce(F.nullif(F.col("__n1"), F.lit("")), F.nullif(F.col("__n2"), F.lit("")))
    out = rows.withColumn("entity_id", F.coalesce("__e1", "__e2", fn.unresolved(label, 32)))
    kept = out if keep_unresolved else out.filter(~F.col("entity_id").startswith("unresolved:"))
    return kept.drop("__n1", "__n2", "__e1", "__e2")


def by_ticker(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the registry's name and entity_id to mentions (ticker), case and outer spaces aside; the first entry of equal tickers wins."""
    key = F.upper(F.trim("ticker"))
    first = registry.filter("ticker is not null").groupBy(key.alias("__t")).agg(F.min_by(F.struct("name", "entity_id"), "pos").alias("e"))
    return mentions.withColumn("__t", key).join(first, "__t", "left").select(*mentions.columns, "e.name", "e.entity_id")


def _ratio(a: str, b: str) -> float:
    """Shared length of two texts over both, as 100 * 2 * LCS / total; a row of the LCS table is the zero bits of one integer."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        met = row & masks.get(x, 0)
        row = (row + met | row - met) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_score(a: str, b: str) -> float:
    """Likeness of two names by their sets of words: the best of shared words against each side, and both sides."""
    x, y = set(a.split()), set(b.split())
    shared, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not only_x or not only_y):
        return 100.0
    p, q = f"{shared} {only_x}".strip(), f"{shared} {only_y}".strip()
    return max(_ratio(p, q), _ratio(shared, p) if shared else 0.0, _ratio(shared, q) if shared else 0.0)


def best_keys(names: list[str], keys: list[str]) -> list[tuple[float, int]]:
    """For each name the best token_set_score among all keys, and the place of the greatest key that has it.

    No key is left out unscored unless a bound rules it out: a likeness is at most what the counts of characters of both
    sets of words (in 64 classes) have in common, or what the shared words make of it, which is exact."""
    sets = [sorted(set(k.split())) for k in keys]
    holders: dict[str, list[int]] = {}
    for i, words in enumerate(sets):
        for w in words:
            holders.setdefault(w, []).append(i)
    counts, sizes = _characters([" ".join(words) for words in sets])
    own_counts, own_sizes = _characters([" ".join(sorted(set(n.split()))) for n in names])
    out = []
    for name, own, size in zip(names, own_counts, own_sizes, strict=True):
        shared = np.zeros(len(keys), np.int64)
        for w in set(name.split()) & holders.keys():
            shared[holders[w]] += len(w) + 1
        shared = np.maximum(shared - 1, 0)
        sure = 200.0 * shared / np.maximum(shared + np.minimum(sizes, size), 1)
        most = np.maximum(sure, 200.0 * np.minimum(counts, own).sum(axis=1) / np.maximum(sizes + size, 1))
        found, least = (0.0, "", 0), sure.max()
        likely = np.flatnonzero(most >= least)
        for i in likely[np.argsort(-most[likely], kind="stable")]:
            if most[i] < found[0]:
                break
            found = max(found, (token_set_score(name, keys[i]), keys[i], int(i)))
        out.append((found[0], found[2]))
    return out


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has the characters of each of 64 classes, and the lengths of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % 64
    return np.bincount(np.repeat(np.arange(len(texts)), sizes) * 64 + codes, minlength=64 * len(texts)).reshape(-1, 64).astype(np.int32), sizes


def _touched(size: int, gram: int, threshold: float) -> int:
    """How many runs of `gram` characters within words a text of `size` characters can lose to one that is `threshold` alike.

    A likeness of t leaves L >= t (a + b) / 2 characters in common order, so a - L are deleted, each from at most `gram`
    runs, and b - L are inserted, each into at most `gram` - 1."""
    most, t = 0, threshold / 100
    for other in range(int(size * t / (2 - t)), int(size * (2 - t) / t) + 2):
        common = int(np.ceil(t * (size + other) / 2 - 1e-9))
        if common <= min(size, other):
            most = max(most, gram * (size - common) + (gram - 1) * (other - common))
    return most


def signatures(names: list[str], threshold: float) -> list[list[tuple[str, str, int, int]]]:
    """Of each name the signatures (kind, token, length, limit) and, of its kind of gram, whether it is enough alone.

    Kind `w`: words; `limit` is how many characters shared words need to be `threshold` alike to the name.  Kinds 3, 2, 1:
    runs of characters within words (single ones with the spaces), numbered where they repeat; two names at the
    threshold share one of the `limit` rarest of each, for each size of which the name has more runs than it can lose."""
    out = []
    for name in names:
        words = sorted(set(name.split()))
        text = " ".join(words)
        need = int(np.ceil(threshold * len(text) / (200 - threshold) - 1e-9))
        found = [("w", w, len(w), need) for w in words]
        for gram in GRAMS:
            pieces = [text] if gram == 1 else words
            runs = Counter(p[i : i + gram] for p in pieces for i in range(len(p) - gram + 1))
            lost = _touched(len(text), gram, threshold)
            enough = sum(runs.values()) > lost
            found += [(str(gram), f"{run}#{i}", int(enough), lost + 1) for run, n in runs.items() for i in range(n)]
        out.append(found)
    return out


def _signed(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    """(column, kind, token, length, limit): a row for each signature of each name."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, NAMES):
                texts = batch.column(0).slice(at, NAMES).to_pylist()
                flat = [(t, *x) for t, found in zip(texts, signatures(texts, threshold), strict=True) for x in found]
                columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
                kinds = [pa.string()] * 3 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[column, "kind", "token", "length", "limit"])

    return rows.select(column).mapInArrow(run, f"{column} string, kind string, token string, length int, limit int")


def _rarest(signed: DataFrame, rarity: DataFrame, column: str, chosen: bool) -> DataFrame:
    """(column, sig): every word (sig of `all`), the rarest words without which too little is shared, and the rarest runs.

    `rarity` (kind, token, n) orders both sides alike.  With `chosen`, a name gives runs of one size only, the largest
    that is enough alone: the other side gives all sizes."""
    found = signed.join(rarity, ["kind", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lists = found.groupBy(column, "kind", "limit").agg(
        F.sort_array(F.collect_list(F.struct("n", "token", "length"))).alias("found"), F.min("length").alias("enough"))
    rest = lambda i: F.aggregate(F.slice("found", i + 1, F.size("found")), F.lit(-1), lambda total, x: total + x.length + 1)
    words = F.filter("found", lambda x, i: (i == 0) | (rest(i) >= F.col("limit")))
    picked = F.when(F.col("kind") == "w", words).otherwise(F.slice("found", 1, F.col("limit")))
    own, other = ("name", "key") if chosen else ("key", "name")
    if chosen:
        size = F.when((F.col("kind") != "w") & (F.col("enough") == 1), F.col("kind").cast("int"))
        best = lists.groupBy(column).agg(F.max(size).cast("string").alias("best"))
        lists = lists.join(best, column).filter((F.col("kind") == "w") | (F.col("kind") == F.col("best")))
    few = lists.select(column, "kind", F.explode(picked).alias("x"))
    prefix = few.select(column, F.concat(F.when(F.col("kind") == "w", F.lit(f"{own}:")).otherwise(F.concat("kind", F.lit(":"))), "x.token").alias("sig"))
    every = signed.filter("kind = 'w'").select(column, F.concat(F.lit(f"{other}:"), "token").alias("sig"))
    return prefix.union(every)


def _meet(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(key, k, score): for asked (key, sig) the best of the held (k, sig) with an equal signature, one row a block.

    Names and keys of a signature are dealt by their hashes into as many parts as their counts ask for, and each part
    meets each in a row of its own, so that a signature of any size spreads over tasks and no pair is a row."""
    parts = asked.groupBy("sig").agg(F.count("*").alias("a")).join(held.groupBy("sig").agg(F.count("*").alias("h")), "sig")
    parts = parts.select("sig", F.ceil(F.col("a") / NAMES).alias("a"), F.ceil(F.col("h") / KEYS).alias("h"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    at = ["sig", "x", "y"]
    names = asked.join(parts, "sig").select("sig", "key", own("key", "a").alias("x"), to("h").alias("y")).groupBy(at).agg(F.collect_set("key").alias("names"))
    keys = held.join(parts, "sig").select("sig", "k", to("a").alias("x"), own("k", "h").alias("y")).groupBy(at).agg(F.collect_set("k").alias("keys"))

    def run(batches):
        for batch in batches:
            found: dict[str, tuple[float, str]] = {}
            for some, against in zip(batch.column("names"), batch.column("keys"), strict=True):
                names, keys = some.as_py(), against.as_py()
                if len(names) * len(keys) <= FEW:
                    best = [max((token_set_score(n, k), k) for k in keys) for n in names]
                else:
                    best = [(score, keys[i]) for score, i in best_keys(names, keys)]
                for n, x in zip(names, best, strict=True):
                    found[n] = max(x, found.get(n, x))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([k for _, k in found.values()], pa.string()), pa.array([x for x, _ in found.values()], pa.float64())], names=["key", "k", "score"])

    return names.join(keys, at).select("names", "keys").mapInArrow(run, "key string, k string, score double")


def _best(met: DataFrame) -> DataFrame:
    """(key, k, score): the best score of each name, and of the keys that have it the greatest."""
    return met.groupBy("key").agg(F.max(F.struct("score", "k")).alias("m")).select("key", "m.k", "m.score")


def _profile(text: str) -> list[int]:
    """How many characters of each group the set of words has."""
    counts = Counter(ord(c) % GROUPS for c in " ".join(set(text.split())))
    return [counts[g] for g in range(GROUPS)]


def _cell(text: str) -> str:
    """The levels of a profile."""
    return "".join(str(sum(n >= least for least in LEVELS) - 1) for n in _profile(text))


def _cells(keys: DataFrame) -> DataFrame:
    """(k, sig): the cell of each key; there are len(LEVELS) ** GROUPS cells at most."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_cell, batch.column(0).to_pylist()), pa.string())], names=["k", "sig"])

    return keys.select("k").mapInArrow(run, "k string, sig string")


def _likely_cells(asked: DataFrame, cells: list[str]) -> DataFrame:
    """(key, sig): for asked (key, score) the cells that can hold a key at least as alike as `score`.

    A key of a cell has in common with the name at most the smaller count of each group, and no fewer characters than
    its levels start at; shared words alone are compared elsewhere."""
    levels = [(c, [int(x) for x in c]) for c in cells]
    low = np.array([[LEVELS[i] for i in x] for _, x in levels]).reshape(-1, GROUPS)
    high = np.array([[([*LEVELS, 1 << 30][i + 1]) - 1 for i in x] for _, x in levels]).reshape(-1, GROUPS)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, NAMES):
                texts, scores = (batch.column(c).slice(at, NAMES).to_pylist() for c in ("key", "score"))
                keys, sigs = [], []
                for text, score in zip(texts, scores, strict=True):
                    own = np.array(_profile(text))
                    common = np.minimum(own, high).sum(1)
                    bound = 200.0 * common / (own.sum() + np.maximum(low.sum(1), common))
                    likely = np.flatnonzero((bound >= score - 1e-9) & (common > 0))
                    keys += [text] * len(likely)
                    sigs += [cells[i] for i in likely]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sigs, pa.string())], names=["key", "sig"])

    return asked.select("key", "score").mapInArrow(run, "key string, sig string")


def best_matches(names: DataFrame, keys: DataFrame, threshold: float = THRESHOLD, cut=stored) -> DataFrame:
    """(key, k, score): the most alike of all keys (k) for each name (key, both distinct and not empty), as `best_keys` over all pairs.

    A name that has no character in common with any key has no row.

    First an inverted index: names meet the keys with which they share a rare word or a rare run of characters, so many of
    them that no pair at the threshold is missed.  Names whose best is below it meet the keys with any equal word, and
    then the cells of keys whose character counts allow a better likeness than the best so far.  `cut` stores what later
    steps read more than once."""
    signed = cut(_signed(keys, "k", threshold))
    asked = cut(_signed(names, "key", threshold))
    rarity = signed.groupBy("kind", "token").agg(F.count("*").alias("n"))
    first = cut(_best(_meet(_rarest(asked, rarity, "key", True), _rarest(signed, rarity, "k", False))))
    below = cut(names.select("key").join(first, "key", "left").filter(F.coalesce("score", F.lit(0.0)) < threshold))
    if below.isEmpty():
        return first
    word = lambda rows, c: rows.filter("kind = 'w'").select(c, F.col("token").alias("sig"))
    by_word = _meet(word(asked.join(below.select("key"), "key", "left_semi"), "key"), word(signed, "k"))
    second = cut(_best(below.filter("score is not null").select("key", "k", "score").union(by_word)))
    held = cut(_cells(keys))
    cells = sorted(r.sig for r in held.select("sig").distinct().collect())
    left = below.select("key").join(second, "key", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))
    third = _meet(_likely_cells(left, cells), held)
    return _best(first.filter(F.col("score") >= threshold).union(second).union(third)).filter("score > 0")


def resolve(mentions: DataFrame, keys: DataFrame, cut=stored) -> DataFrame:
    """Add to mentions (name): entity_id and score.  keys: what `index` gives.

    Exact normalised names come first, by an equi-join of the distinct names.  What is left gets the most alike of all
    keys (`best_matches`): from THRESHOLD on it wins, ties by key; else a placeholder has the best score, 0 for names
    without words."""
    names = mentions.select("name").distinct().withColumn("key", fn.normalise_name(F.col("name")))
    exact = names.join(keys, "key").select("name", "entity_id", F.lit(100.0).alias("score"))
    rest = cut(names.join(exact.select("name"), "name", "left_anti").filter("key <> ''"))
    held = keys.select(F.col("key").alias("k"), "entity_id")
    if rest.isEmpty():
        return mentions.join(exact, "name", "left").withColumns({"entity_id": F.coalesce("entity_id", fn.unresolved(F.col("name"))), "score": F.coalesce("score", F.lit(0.0))})
    best = best_matches(rest.select("key").distinct(), held.select("k"), THRESHOLD, cut).join(held, "k")
    best = best.select("key", F.when(F.col("score") >= THRESHOLD, F.col("entity_id")).alias("entity_id"), "score")
    found = exact.unionByName(rest.join(best, "key").select("name", "entity_id", "score"))
    return mentions.join(found, "name", "left").withColumns({"entity_id": F.coalesce("entity_id", fn.unresolved(F.col("name"))), "score": F.coalesce("score", F.lit(0.0))})


def edges(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """Canonical relation rows of extraction responses (entity_id, accession, item_id, effective_date, availability_date, response)."""
    e = responses.select("*", F.explode(fn.edges_from_response(F.col("response"))).alias("e")).select(*[c for c in responses.columns if c != "response"], "e.*").withColumn("name", F.col("target_name"))
    named = resolve(e.withColumnRenamed("entity_id", "source_entity"), keys).withColumnRenamed("entity_id", "target_entity_id").withColumnRenamed("source_entity", "entity_id")
    return named.withColumns({"target_name_as_filed": F.col("target_name"), "evidence_hash": fn.content_hash(F.col("evidence_span").cast("binary")), "source_ref": F.concat_ws("#", "accession", "item_id")}).drop("name", "target_name")


def quarterly_graph(relations: DataFrame, quarter_ends: DataFrame, mode: str = "latest") -> DataFrame:
    """The relations known at each quarter end (t).

    `evidence` keeps one row for each effective date and evidence; `latest` the newest of each source, target and kind."""
    key = ["entity_id", "target_entity_id", "relationship_type"] + (["effective_date", "evidence_hash"] if mode == "evidence" else [])
    known = pit.as_of_dates(relations, quarter_ends.select("t"), key)
    return known.withColumn("quarter", fn.quarter_label(F.col("t")))


def propagate(edges_: DataFrame, shocks: DataFrame, depth: int = 3, decay: float = 0.5, checkpoint=lambda df: df) -> DataFrame:
    """(node, risk): shocks (node, risk) spread along edges (src, dst), weaker by `decay` a hop, at most `depth` hops; the largest arrival counts.

    `checkpoint` stores each hop's frontier where lineage would grow long."""
    reached, frontier = shocks.select("node", "risk"), shocks.select("node", "risk")
    for _ in range(depth):
        frontier = checkpoint(frontier.join(edges_.select(F.col("src").alias("node"), "dst"), "node").groupBy(F.col("dst").alias("node")).agg((F.max("risk") * decay).alias("risk")))
        reached = reached.unionByName(frontier)
    return reached.groupBy("node").agg(F.max("risk").alias("risk"))
