"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled texts only: a sample of all documents outside the held-out fold, whether
the labels cover them or not.  The class prior is estimated from the same two samples, at every size of table, and from nothing
else.  With the class prior p the risk of a scorer is
p * (loss of positives as positive) + max(0, loss of unlabelled as negative - p * loss of positives as negative): the second term estimates
the loss of true negatives, and where it falls below zero, which only overfitting does, the step goes back up.

The scorer is linear in the distinct words of a text: each word counts with its own weight and those of its prefixes
(so inflected forms share evidence), and the sum is divided by a root of the number of words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, stored
from tidemark.llm.samples import held_out, pick, sampled

#: Bounds of the training sample, texts that a feature must occur in, features kept (the most telling), prefix lengths, steps, step size, weight decay.
POSITIVES, UNLABELLED, MIN_TEXTS, FEATURES, PREFIXES, STEPS, RATE, DECAY = 1200, 3000, 5, 4000, (4, 5), 300, 0.2, 1e-4
#: Features for each confirmed positive at most: few positives can't tell many features apart.
PER_POSITIVE = 40
#: How far below zero the risk of negatives may be before the step goes back up.
TOLERANCE = 1e-3
#: Priors that the scorers start from by which the class prior is estimated, their steps, folds and weight decay, and the confidence of the bound that picks a threshold.
PRIORS, PRIOR_STEPS, PRIOR_FOLDS, PRIOR_DECAY, CONFIDENCE = (0.02, 0.1), 100, 5, 1e-3, 0.9
#: The sum of word scores is divided by the number of words to this power.
DAMPING = 0.25
#: Entries of a worker's cache of word scores.
CACHE_ENTRIES = 150_000

_WORD = re.compile(r"\w+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word itself, and its prefixes marked as such."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Scorer(dict):
    """Word scores, filled on demand from feature weights."""

    def __init__(self, bias: float, weights: dict[str, float]):
        super().__init__()
        self.bias, self.weights = bias, weights

    def __reduce__(self):
        return Scorer, (self.bias, self.weights)

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        self[word] = found = sum(get(f, 0.0) for f in features(word))
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        at = self.__getitem__
        z = [self.bias + sum(map(at, sorted(ws))) / len(ws) ** DAMPING if (ws := words(t)) else self.bias for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z), -60, 60)))


class Sample:
    """Texts as sparse rows: `row`, `at`, `value` of each feature, and which of the `n` rows are positive."""

    def __init__(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, positive: np.ndarray, size: int):
        self.row, self.at, self.value, self.positive, self.size = row, at, value, positive, size

    def part(self, rows: np.ndarray) -> Sample:
        """The rows that a mask keeps."""
        kept = rows[self.row]
        return Sample((np.cumsum(rows) - 1)[self.row[kept]], self.at[kept], self.value[kept], self.positive[rows], self.size)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], len(self.positive)) + w[self.size]


def pu_risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk of positives, risk of negatives, slope by logit of the step): the logistic loss under the class prior.

    While the risk of negatives is not below zero (by TOLERANCE) the slope is that of both risks; below it is that of minus
    the latter.  Without a tolerance a scorer that calls everything negative, whose risk is zero but for rounding, would stay."""
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    as_negative = np.logaddexp(0, z)  # loss of calling it negative; its slope is p
    negatives = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
    positives = prior * (as_negative - z)[positive].sum() / n_p
    slope = np.where(positive, -prior * p / n_p, p / n_u)
    return positives, negatives, np.where(positive, prior * (p - 1) / n_p, 0.0) + slope if negatives >= -TOLERANCE else -slope


def minimise(sample: Sample, prior: float, steps: int, decay: float = DECAY) -> np.ndarray:
    """Weights and, last, the bias after Adam over the whole sample at each step."""
    w = np.zeros(sample.size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        slope = pu_risk(sample.logits(w), sample.positive, prior)[2]
        g = np.append(np.bincount(sample.at, sample.value * slope[sample.row], sample.size) + decay * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(sample: Sample, groups: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from positives and unlabelled rows alone.

    For any set of scores that only positives reach, it is the set's share of the unlabelled over its share of the
    positives.  Scorers are fitted without one of PRIOR_FOLDS groups of documents each and score that group, so that no
    row is scored by a scorer that has seen it.  Of all thresholds the one with the least upper bound of that ratio is
    taken; the fewer positives there are, the more of them it lets through."""
    found = (np.inf, 0.5)
    for start in PRIORS:
        z = np.zeros(len(sample.positive))
        for g in range(PRIOR_FOLDS):
            own = groups == g
            if own.any() and sample.positive[~own].any() and not sample.positive[~own].all():
                z[own] = sample.part(own).logits(minimise(sample.part(~own), start, PRIOR_STEPS, PRIOR_DECAY))
        p, u = np.sort(z[sample.positive]), np.sort(z[~sample.positive])
        of_p, of_u = 1 - np.searchsorted(p, p) / len(p), 1 - np.searchsorted(u, p) / len(u)
        slack = sum(np.sqrt(np.log(4 / (1 - CONFIDENCE)) / (2 * len(x))) for x in (p, u))
        best = np.argmin((of_u + slack) / of_p)
        found = min(found, ((of_u[best] + slack) / of_p[best], of_u[best] / of_p[best]))
    return float(np.clip(found[1], 1e-3, 0.5))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, test_fold: int = 0) -> Scorer:
    """Fit on at most POSITIVES texts labelled toxic outside the held-out fold, and UNLABELLED of all documents there, their labels unread.

    Repeated label rows count once, as toxic if any says so.  Whole texts become features in map tasks; the driver gets the
    FEATURES or fewer that tell positives from unlabelled texts best, and the sample's rows by those."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id", folds, test_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    others = docs.select("doc_id").filter("doc_id is not null").filter(~held_out("doc_id", folds, test_fold)).distinct()
    chosen = [pick(known.filter("toxic = 1").select("doc_id"), POSITIVES, 6).withColumn("part", F.lit(1)), pick(others, UNLABELLED, 7).withColumn("part", F.lit(0))]

    def found():
        def work(batch: pa.RecordBatch) -> list:
            names, counts, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                seen: dict[str, int] = {}
                ws = words(text)
                for word in ws:
                    for f in features(word):
                        seen[f] = seen.get(f, 0) + 1
                names.append(list(seen))
                counts.append(list(seen.values()))
                sizes.append(max(1, len(ws)))
            return [pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), pa.array(sizes, pa.int32())]

        return work

    fields = [pa.field("names", pa.list_(pa.string())), pa.field("counts", pa.list_(pa.int32())), pa.field("words", pa.int32())]
    sample = stored(map_batches(sampled(docs, chosen[0].unionByName(chosen[1])), "text", found, fields, ["doc_id", "part"]), "sample")
    sizes = dict(sample.groupBy("part").agg(F.count(F.lit(1))).collect())
    if len(sizes) < 2:
        return Scorer(float(np.log(1e-4)), {})
    texts = sample.select("part", F.explode("names").alias("name")).groupBy("name").agg(F.sum("part").alias("p"), F.sum(1 - F.col("part")).alias("u")).filter(F.col("p") + F.col("u") >= MIN_TEXTS)
    telling = F.abs(F.col("p") / sizes[1] - F.col("u") / sizes[0]) / F.sqrt(F.col("p") + F.col("u"))
    names = sorted(r.name for r in texts.orderBy(F.desc(telling), "name").limit(min(FEATURES, PER_POSITIVE * sizes[1])).select("name").collect())
    place = {f: i for i, f in enumerate(names)}

    def placed():
        def work(batch: pa.RecordBatch) -> list:
            at, value = [], []
            for own, counts, n in zip(*(batch.column(c).to_pylist() for c in ("names", "counts", "words")), strict=True):
                kept = sorted((place[f], c * n**-DAMPING) for f, c in zip(own, counts, strict=True) if f in place)
                at.append([i for i, _ in kept])
                value.append([v for _, v in kept])
            return [pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))]

        return work

    rows = map_batches(sample, "names", placed, [pa.field("at", pa.list_(pa.int32())), pa.field("value", pa.list_(pa.float64()))], ["doc_id", "part"], ("counts", "words")).toArrow().sort_by([("part", "descending"), ("doc_id", "ascending")]).combine_chunks()
    at, value = (rows.column(c).combine_chunks() for c in ("at", "value"))
    row = np.repeat(np.arange(len(rows)), at.value_lengths().to_numpy())
    whole = Sample(row, at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), rows.column("part").to_numpy() == 1, len(names))
    ids = rows.column("doc_id").to_numpy()
    groups = np.array([zlib.crc32(str(i).encode()) // 5 % PRIOR_FOLDS for i in ids])  # both rows of a document in one
    w = minimise(whole, class_prior(whole, groups), STEPS)
    return Scorer(float(w[-1]), {f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-4})


def score(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Add the probability that the whole `text` is toxic, as column `name`.

    Null, empty and wordless texts get the bias alone.  An existing column `name` is replaced; equal texts get
    equal scores; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def make():
        scorer = shared.value
        return lambda batch: [pa.array(scorer.scores([t or "" for t in batch.column("text").to_pylist()]))]

    return map_batches(docs, "text", make, [pa.field(name, pa.float64())], keep)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's toxicity; fold 0 of five is held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    scored = score(docs, train(docs, labels), name="__toxicity")
    return scored.filter("__toxicity < 0.5").select([F.col(f"`{c}`") for c in docs.columns])
