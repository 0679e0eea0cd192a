"""Byte-level BPE by the tiktoken library from a local rank file, and decoding to raw bytes.

The library panics on runs of about a million white-space characters (its look-ahead needs a stack entry for each),
and holds all of a text's ids as Python integers.  So long texts are cut first, only where no match of the split
pattern can reach across: there both sides encode as they do in the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

#: Characters of a text from which it is cut, and of a part at least; white space from which a run is a part of its own.
PART_CHARS, LONG_RUN = 1 << 16, 1 << 16
#: Bytes of text encoded at once, and of ids decoded at once.
ENCODE_BYTES, DECODE_BYTES = 4 << 20, 4 << 20

#: Where no match of the pattern reaches across: no match goes on from a visible character into white space; a run of
#: white space before a visible character leaves its last character to the next match; letters and digits never mix.
SAFE = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})"
    r"|(?<=\p{White_Space})(?=\p{White_Space}\P{White_Space})"
    r"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
)
RUNS = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")


def cut(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries into parts of `size` characters or a little more; without one, a part is longer."""
    start = 0
    while len(text) - start > size:
        found = SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class RankedBPE:
    """A rank file with the split pattern of its vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: The same merges where the whole text is one match.
        self.one_match = tiktoken.Encoding("one match", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if len(text) <= PART_CHARS:
            return np.array(self.bpe.encode_ordinary(text), np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *self.encode_parts(text)])

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a long text, part by part; a long run of white space is one match of the pattern."""
        start = 0
        for run in RUNS.finditer(text):
            end = run.end() - (run.end() < len(text))
            for part in cut(text[start : run.start()]):
                yield np.array(self.bpe.encode_ordinary(part), np.uint32)
            yield np.array(self.one_match.encode_ordinary(text[run.start() : end]), np.uint32)
            start = end
        for part in cut(text[start:]):
            yield np.array(self.bpe.encode_ordinary(part), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of ids, whether they are UTF-8 or not."""
        return b"".join(self.bpe.decode_bytes(ids[i : i + PART_CHARS].tolist()) for i in range(0, len(ids), PART_CHARS))


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> RankedBPE:
    return RankedBPE(path, pattern)


def encode_ranks(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Add `ids`, an array of ints: every whole `text` as tiktoken encodes it by the rank file at `path`, without specials.

    A null or empty text has no ids; strings of special tokens are ordinary text.  A text of any length that a cell
    can hold is encoded in parts, also where it is one run of white space or one word.  An existing `ids` column is
    replaced, equal rows stay as many, an empty table gives an empty one.
    """

    def make():
        bpe = vocabulary(path, pattern)

        def work(batch: pa.RecordBatch) -> list:
            found = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            ids = np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]

        return work

    return map_batches(docs, "text", make, [pa.field("ids", pa.list_(pa.int32()))], keep, limit=ENCODE_BYTES)


def parts_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each row of a batch; none for a null."""
    column = batch.column("ids")
    ids = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
    return [ids[a:b] for a, b in pairwise(ends)]


def decode_ranks(encoded: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Add `decoded`, binary: the raw bytes of every `ids` array; null or empty ids decode to no bytes.

    An id that the rank file lacks, or a null among the ids, is an error, as in the library.
    """

    def make():
        bpe = vocabulary(path, pattern)
        return lambda batch: [pa.array([bpe.decode(ids) for ids in parts_of(batch)], pa.binary())]

    return map_batches(encoded, "ids", make, [pa.field("decoded", pa.binary())], keep, limit=DECODE_BYTES)


def digest_ids(encoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add `ids_sha256`: the digest of each row's ids as little-endian unsigned 32-bit integers."""

    def digest(batch: pa.RecordBatch) -> list:
        return [pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in parts_of(batch)], pa.string())]

    return map_batches(encoded, "ids", lambda: digest, [pa.field("ids_sha256", pa.string())], keep)


def op11(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = digest_ids(encode_ranks(docs.select("doc_id", "text"), path, pattern, ["doc_id"]))
    counted = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256")
    decoded = decode_ranks(counted, path, pattern, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
