"""Token counts by a two-tier lookup inside map tasks; no pre-token ever crosses a shuffle.

A sentencepiece BPE model never merges across the start of a word when no piece holds a space mark behind another
character, so a text's count is the sum over its pre-tokens.  Tier one is a broadcast table of the lengths of
frequent pre-tokens; tier two a bounded cache in each Python worker, filled by the library for what tier one misses.
Both tiers only remember what the library said, so neither the summaries behind the table nor the bound on the cache
can change a result.  The table is counted over all whole texts: each task keeps a bounded summary of its heavy hitters, and
only these summaries are merged.

Pre-tokens are keyed as follows: `word` stands behind one space (or the space that the library puts before a text),
`  word` with k spaces behind k + 1 of them, `\\nword` directly behind anything, ` \\nword` with k spaces behind just
those k, and k spaces alone end a text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, tidied, whole_text

#: Bounds of the tiers: pre-tokens in a task's summary, bytes of one in it, entries of the frequent table and of a worker's cache.
SUMMARY, SUMMARY_BYTES, TABLE_ENTRIES, CACHE_ENTRIES = 8192, 64, 50_000, 400_000

_SPACE = "▁"  # fixed value: sentencepiece's mark of a space
_RUNS = re.compile(r" *\n[^ \n]*| *[^ \n]+| +$")
_workers: dict[str, Counting] = {}


class Counting:
    """Counts of one sentencepiece model; `table` maps frequent pre-tokens to their lengths."""

    def __init__(self, model: str, table: dict[str, int] | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.splits = not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces)
        self.table = table or {}
        self.known = dict(self.table)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.sp.encode(texts, num_threads=1)] if texts else []

    def learn(self, keys: list[str]) -> None:
        """Ask the library for the lengths of pre-tokens; what it adds to make a text of one is taken off."""
        asked, less = [], []
        for key in keys:
            bare = key.lstrip(" ")
            asked.append(key if key == bare else "a" + key if not bare else key[1:] if bare[0] == "\n" else key)
            less.append(1 if key[0] == "\n" or not bare else 0)  # the dummy space before a line break, or the `a`
        self.known.update((k, n - m) for k, n, m in zip(keys, self.lengths(asked), less, strict=True))

    def keys(self, text: str) -> list[str]:
        if text[0] not in " \n" and text[-1] != " " and "  " not in text and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        return [run[1:] if run[0] == " " and (bare := run.lstrip(" ")) and bare[0] != "\n" else run for run in _RUNS.findall(" " + text)]

    def counts(self, texts: list[str]) -> list[int]:
        whole = [t for t in texts if not self.splits or _SPACE in t]
        alone = dict(zip(whole, self.lengths(whole), strict=True))
        split = [[] if not t or t in alone else self.keys(t) for t in texts]
        distinct: set[str] = set().union(*split)
        missing = [w for w in distinct if w not in self.known]
        if len(self.known) + len(missing) > CACHE_ENTRIES + len(self.table):
            self.known = dict(self.table)
            missing = [w for w in distinct if w not in self.known]
        self.learn(missing)
        known = self.known.__getitem__
        return [alone[t] if t in alone else sum(map(known, ws)) for t, ws in zip(texts, split, strict=True)]


def heavy_hitters(docs: DataFrame) -> DataFrame:
    """(word, n): pre-tokens of all whole texts with how often they occur, from a bounded summary of each task.

    A summary that has grown to eight times its bound loses the rarer pre-tokens, the others as many counts as the most
    frequent of those had; so a count is too low by at most the task's pre-tokens over the bound."""

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(text.replace("\n", " \n").split(" "))
                if len(seen) > 8 * SUMMARY:
                    kept = seen.most_common(SUMMARY + 1)
                    least = kept.pop()[1]
                    seen = Counter({w: n - least for w, n in kept if n > least})
        kept = [(w, n) for w, n in seen.most_common(SUMMARY) if w and len(w.encode("utf-8", "surrogatepass")) <= SUMMARY_BYTES]
        words, counts = zip(*kept, strict=True) if kept else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    return docs.select(whole_text().alias("text")).mapInArrow(tidied(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_table(docs: DataFrame, model: str) -> tuple[bytes, bytes]:
    """The compact table: the most frequent pre-tokens, joined by spaces, and a byte for each length."""
    top = heavy_hitters(docs).orderBy(F.desc("n"), "word").limit(TABLE_ENTRIES).select("word").collect()  # a table of bounded size
    counting = Counting(model)
    counting.learn([w for (w,) in top if _SPACE not in w])
    kept = {w: n for w, n in counting.known.items() if n < 256}
    return " ".join(kept).encode(), bytes(kept.values())


def count_tokens(docs: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Add `n_tokens`: the tokens of every whole `text` as the sentencepiece model at `model` counts them.

    A null or empty text has none.  An existing `n_tokens` column is replaced; equal rows stay as many; an empty
    table gives an empty one.  Texts with literal space marks, and all texts under a model whose pieces cross word
    starts, are encoded whole by the library.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, model)), uuid.uuid4().hex

    def make():
        if name not in _workers:
            words, lengths = shared.value
            _workers.clear()
            _workers[name] = Counting(model, dict(zip(words.decode().split(" "), lengths, strict=True)) if lengths else {})
        counting = _workers[name]
        return lambda batch: [pa.array(counting.counts([t or "" for t in batch.column("text").to_pylist()]), pa.int64())]

    return map_batches(docs, "text", make, [pa.field("n_tokens", pa.int64())], keep)


def op5(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """Every document's token count, and whether it is over `limit`."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    sized = docs.select("doc_id", whole_text().alias("text"), F.octet_length(whole_text()).cast("long").alias("n_bytes"))
    return count_tokens(sized, model, ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)
