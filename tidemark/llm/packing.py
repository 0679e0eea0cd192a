"""Packing along a space-filling curve.

Each document's tokens are counted into hashed buckets, the normalised count vector is projected to a few dimensions,
and its place on a Hilbert curve through them is the sort key: neighbours on the curve have much the same words.
Documents are range-partitioned by key, and each partition lays its documents end to end and cuts every LENGTH
tokens.  What is left at a partition's end is cut into powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, stored, tidied

LENGTH, END = 2048, 1
#: Hashed buckets of a document vector; dimensions of the curve, and bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 4, 10
#: Entries of a worker's cache of words (some 50 bytes each), and of stems as text; sequences that a partition may number.
CACHE_ENTRIES, STEMS, STRIDE = 1_000_000, 100_000, 1 << 36
#: Bytes of packed ids that a task lays end to end, about.
PARTITION_BYTES = 64 << 20
#: Bytes of text encoded at once: hashing and comparing them takes some eighty times as much.
ENCODE_BYTES = 2 << 20

#: Fixed value: the published split pattern of the lower-casing word vocabularies that `WordIds` reads.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Masks of a number's lowest 0 to 8 bytes.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class WordIds:
    """Ids of a tokenizers vocabulary whose pre-tokens never cross ASCII white space.

    Words are cut, hashed and looked up by numpy over the bytes of many texts; only words that aren't known yet go
    through the library.  A word's hash, a random polynomial of its bytes modulo 2**64, only finds the entry: its length and
    bytes are compared with the entry's, and a word that shares its hash with another goes through the library each time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in pre] != ["Split", "ByteLevel"] or pre[0]["pattern"] != {"Regex": SPLIT} or pre[1].get("add_prefix_space"):
            raise ValueError("a vocabulary that lower-cases and splits words as SPLIT does is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        r = np.random.default_rng(5)
        self.letters = r.integers(0, 2**64, 256, np.uint64)
        self.base = np.uint64(int(r.integers(0, 2**63)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.roots = np.zeros(0, np.uint64)
        self.stems: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)
        # of each cached word: bytes, the first eight of them, the next eight; whole where it is longer
        self.lengths, self.heads, self.seconds = np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.long: dict[int, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of some bytes."""
        if len(self.powers) < len(data) + 1:
            n = len(data) + 1
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base)]), dtype=np.uint64)
            self.roots = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.inverse)]), dtype=np.uint64)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.space[data]
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.roots[starts]
        h = (h ^ (ends - starts).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return starts, ends, h ^ (h >> np.uint64(32))

    @staticmethod
    def ends_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second eight bytes of words as numbers, zero behind a word's end."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        rows = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        read = lambda at: rows[np.minimum(at, len(rows) - 1)].view("<u8")[:, 0]
        return read(starts) & _BYTES[np.minimum(sizes, 8)], read(starts + 8) & _BYTES[np.clip(sizes - 8, 0, 8)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, END behind them."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = b"\n".join(raw)
        data = np.frombuffer(whole, np.uint8)
        starts, ends, h = self.words(data)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        head, second = self.ends_of(data, starts, ends - starts)
        self.learn(unique, first, starts, ends, head, second, whole)
        at = np.searchsorted(self.hashes, unique)[back]
        begins, sizes, flat = self.starts[at], self.sizes[at].astype(np.int64), self.flat
        same = (self.lengths[at] == ends - starts) & (self.heads[at] == head) & (self.seconds[at] == second)
        for i in np.flatnonzero(same & (ends - starts > 16)).tolist():
            same[i] = self.long[int(h[i])] == whole[starts[i] : ends[i]]
        other = np.flatnonzero(~same)
        if len(other):  # words that share their hash with another
            got = self.packed([whole[i:j].decode("utf-8", "surrogatepass") for i, j in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            sizes[other] = [len(g) // self.kind.itemsize for g in got]
            begins[other] = len(flat) + np.cumsum(sizes[other]) - sizes[other]
            flat = np.concatenate([flat, np.frombuffer(b"".join(got), self.kind)])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(begins - upto[:-1], sizes) + np.arange(upto[-1])]
        text_ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        cuts = upto[np.searchsorted(starts, text_ends)]  # tokens of the words that start before each text's end
        ids = np.insert(ids, cuts, np.array(END, self.kind))
        edges = [0, *(cuts + np.arange(1, len(cuts) + 1))]
        return [ids[i:j].tobytes() for i, j in pairwise(edges)]

    def learn(self, unique: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray, second: np.ndarray, whole: bytes) -> None:
        """Add the words that aren't known, in hash order.

        An ASCII word counts as its lower case, and a full stop or comma behind a letter is a pre-token of its own, so
        such words share the stem that the library is asked for."""
        if len(self.hashes) + len(unique) > CACHE_ENTRIES:
            self.forget()
        place = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        known[place < len(self.hashes)] = self.hashes[place[place < len(self.hashes)]] == unique[place < len(self.hashes)]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        made, ask = [], {".": None, ",": None}
        for i, j in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True):
            word, stop = whole[i:j].decode("utf-8", "surrogatepass"), ""
            if word.isascii():
                word = word.lower()
                if word[-1] in ".," and word[-2:-1].isalpha():
                    word, stop = word[:-1], word[-1]
            made.append((word, stop))
            if word not in self.stems:
                ask[word] = None
        if len(self.stems) + len(ask) > STEMS:
            self.stems.clear()
            ask |= dict.fromkeys(w for w, _ in made)
        self.stems.update(zip(ask, self.packed(list(ask)), strict=True))
        got = [self.stems[w] + (self.stems[s] if s else b"") for w, s in made]
        sizes = np.array([len(g) for g in got], np.int64) // self.kind.itemsize
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(got), self.kind)])
        into, own = place[new], first[new]
        lengths = ends[own] - starts[own]
        for i in np.flatnonzero(lengths > 16).tolist():
            self.long[int(unique[new[i]])] = whole[starts[own[i]] : ends[own[i]]]
        added = ((self.hashes, unique[new]), (self.starts, begin), (self.sizes, sizes), (self.lengths, lengths), (self.heads, head[own]), (self.seconds, second[own]))
        self.hashes, self.starts, self.sizes, self.lengths, self.heads, self.seconds = (np.insert(x, into, y) for x, y in added)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates below 2**bits (Skilling's transform, by columns)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's hashed vector."""
    flat, sizes = np.concatenate(ids).astype(np.uint64), np.array([len(x) for x in ids])
    bucket = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % BUCKETS
    counts = np.bincount(np.repeat(np.arange(len(ids)), sizes) * BUCKETS + bucket, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS)
    unit = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    axes = np.random.default_rng(17).normal(size=(BUCKETS, DIMENSIONS))
    place = np.tanh(unit @ axes) * 0.5 + 0.5
    return hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, curve, bytes): the packed ids of every whole text with END behind them, the place on the curve, the ids' bytes.

    A null text counts as empty and has END alone; equal texts have equal ids and places; null and repeated doc_ids pass
    as they are, one row for each row; an empty table gives an empty one."""

    def make():
        words = word_ids(path)

        def work(batch: pa.RecordBatch) -> list:
            packed = words.encode([t or "" for t in batch.column("text").to_pylist()])
            return [pa.array(packed, pa.binary()), pa.array(curve_keys([np.frombuffer(p, words.kind) for p in packed])), pa.array([len(p) for p in packed], pa.int64())]

        return work

    return map_batches(docs.select("doc_id", "text"), "text", make, [pa.field("ids", pa.binary()), pa.field("curve", pa.int64()), pa.field("bytes", pa.int64())], ["doc_id"], limit=ENCODE_BYTES)


_PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, path: str) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id lies in one piece; a sequence is LENGTH tokens or a power of two below it.  A null text counts as empty
    and still has END; repeated rows are packed as often as they come; an empty table gives no pieces.  Sequences
    are numbered by partition, so the numbers have gaps between partitions.
    """
    kind = word_ids(path).kind
    schema = pa.schema(_PIECES)

    def run(batches):
        number = TaskContext.get().partitionId() * STRIDE
        held: list[tuple] = []  # pieces of the open sequence
        room = LENGTH
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset))
                offset += len(ids)
            number += 1

        for batch in batches:
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids, at = np.frombuffer(packed, kind), 0
                while at < len(ids):
                    part = ids[at : at + room]
                    held.append((doc, at, part, len(ids)))
                    at += len(part)
                    room -= len(part)
                    if not room:
                        close(held)
                        held, room = [], LENGTH
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=schema)
                rows = []
        left = LENGTH - room
        while left:
            take = now = 1 << left.bit_length() - 1
            pieces = []
            while now:
                doc, start, ids, total = held.pop(0)
                if len(ids) > now:
                    held.insert(0, (doc, start + now, ids[now:], total))
                    ids = ids[:now]
                pieces.append((doc, start, ids, total))
                now -= len(ids)
            close(pieces)
            left -= take
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=schema)

    tokens = stored(tokenised(docs, path), "tokens")
    size = tokens.agg(F.sum("bytes")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    along = tokens.repartitionByRange(parts, "curve", "doc_id", F.crc32("ids")).sortWithinPartitions("curve", "doc_id", F.crc32("ids"))
    return along.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op7(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, path)
