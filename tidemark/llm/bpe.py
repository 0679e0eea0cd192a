"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

Each prefix of a word has one encoding, and that encoding without its last token is the encoding of a shorter
prefix.  So the last token of every prefix is all the state there is: the distinct words of a batch go into a trie,
and one depth-first walk gives each node the token that ends its prefix, computed once for all words below it.
A token may end a prefix if it is a suffix of it and may follow the last token of what stands before it; it may
when no merge across their border would come before the merges that hide the border.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

#: Entries of a worker's caches: encoded words, and pairs of tokens with whether they may stand side by side.
CACHE_ENTRIES, BORDERS = 250_000, 150_000
#: Bytes of text encoded at once: its pieces take over ten times as much.
ENCODE_BYTES = 3 << 20

#: Fixed value: the published split pattern of byte-level BPE; the library's white space is Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        symbols, model = byte_symbols(), spec["model"]
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special = special
        self.ids = {bytes(symbols[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
        size = max([*self.ids.values(), *special.values()]) + 1
        self.texts = [b""] * size
        for b, i in self.ids.items():
            self.texts[i] = b
        for s, i in special.items():
            self.texts[i] = s.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        as_id = {s: i for s, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y = as_id[a], as_id[b]
            self.rank.setdefault((x, y), r)
            made.setdefault(as_id[a + b], (x, y, r))
        if any(made.get(part, (0, 0, -1))[2] > r for x, y, r in made.values() for part in (x, y)):
            raise ValueError("a merge comes before the merges of its parts")
        self.made = made
        self.spine = lru_cache(1 << 15)(self.find_spine)
        self.holds: dict[int, bool] = {}
        self.sizes = [len(b) for b in self.texts]
        self.packed = [np.int32(i).tobytes() for i in range(size)]
        self.longer = {self.ids[b[:-1]] << 8 | b[-1]: i for b, i in self.ids.items() if b[:-1] in self.ids}
        lengths: dict[bytes, set[int]] = {}
        for b in self.ids:
            lengths.setdefault(b[-4:], {2, 3}).add(len(b))
        self.tails = {tail: tuple(sorted(ls, reverse=True)) for tail, ls in lengths.items()}  # of tokens that end so
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a byte is not in the vocabulary")
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.cut = regex.compile(PATTERN).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.known = {s: np.int32(i).tobytes() for s, i in special.items()}

    def find_spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token and its outermost parts on a side, each with the rank of the merge that takes it up."""
        out, taken = [], float("inf")
        while True:
            out.append((token, taken))
            if token not in self.made:
                return out
            taken = self.made[token][2]
            token = self.made[token][side]

    def border_holds(self, first: int, second: int) -> bool:
        """Whether BPE leaves `first` and `second` side by side; of equal merges, the one further left goes first."""
        for x, hidden in self.spine(first, 1):
            for y, covered in self.spine(second, 0):
                r = self.rank.get((x, y))
                if r is not None and r < hidden and r <= covered:
                    return False
        return True

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, packed, by one depth-first walk of their trie.

        Sorted words are the leaves of their trie in depth-first order: what a word shares with the one before is
        the path that both have, and its states stay.  `last[i]` is the token that ends the first i + 1 bytes; going
        down by a byte tries the last token made longer, then the byte alone, then the other tokens that end like the
        path, and just one of all may follow what stands before it."""
        out: dict[str, bytes] = {}
        ids, tails, sizes, packed, holds, border, longer, single = self.ids, self.tails, self.sizes, self.packed, self.holds, self.border_holds, self.longer, self.single
        if len(holds) > BORDERS:
            holds.clear()
        short = (3, 2)
        last: list[int] = []
        before = b""
        for path, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            depth, most = 0, min(len(before), len(path))
            while depth < most and before[depth] == path[depth]:
                depth += 1
            del last[depth:]
            before = path
            for n in range(depth, len(path)):
                byte = path[n]
                if not n:
                    last.append(single[byte])
                    continue
                above = last[-1]
                token = longer.get(above << 8 | byte)
                if token is not None:
                    start = n - sizes[above] - 1
                    if start < 0:
                        last.append(token)
                        continue
                    key = last[start] << 20 | token
                    fits = holds.get(key)
                    if fits is None:
                        fits = holds[key] = border(last[start], token)
                    if fits:
                        last.append(token)
                        continue
                token = single[byte]
                key = above << 20 | token
                fits = holds.get(key)
                if fits is None:
                    fits = holds[key] = border(above, token)
                if not fits:
                    for length in tails.get(path[max(0, n - 3) : n + 1], short):
                        token = ids.get(path[n + 1 - length : n + 1]) if length <= n + 1 else None
                        if token is not None:
                            if length == n + 1:
                                break
                            key = last[n - length] << 20 | token
                            fits = holds.get(key)
                            if fits is None:
                                fits = holds[key] = border(last[n - length], token)
                            if fits:
                                break
                last.append(token)
            found, end = [], len(path)
            while end:
                token = last[end - 1]
                found.append(packed[token])
                end -= sizes[token]
            found.reverse()
            out[word] = b"".join(found)
        return out

    def pieces(self, text: str) -> list[str]:
        """Cut a text where no pre-token goes on: before single spaces and around single line breaks.

        Any other white space sends the text through the pattern: unless all of it is spaces and line breaks, the
        lengths don't add up, and unless each stands alone between words, words don't outnumber them by one."""
        words, spaces = text.split(), text.count(" ") + text.count("\n")
        if "\0" in text or len(words) != spaces + 1 or sum(map(len, words)) + spaces != len(text):
            return self.cut(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces: their pre-tokens that are new through the trie, the others from what is known."""
        known, cut = self.known, [self.cut(p) for p in pieces]
        known.update(self.encode_words(list(set().union(*cut) - known.keys())))
        known.update((p, b"".join(map(known.__getitem__, c))) for p, c in zip(pieces, cut, strict=True) if len(c) > 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's begin and end."""
        split = []
        for text in texts:
            parts = self.cut_special(text) if self.has_special(text) else [text]
            split.append([p for part in parts if part for p in ([part] if part in self.special else self.pieces(part))])
        distinct: set[str] = set().union(*split)
        missing = distinct - self.known.keys()
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known = dict(islice(self.known.items(), CACHE_ENTRIES // 2))  # what came first comes often
            missing = distinct - self.known.keys()
        self.learn(list(missing))
        known = self.known.__getitem__
        found = [b"".join(map(known, ps)) for ps in split]
        return np.frombuffer(b"".join(found), np.int32), np.cumsum([0, *(len(b) // 4 for b in found)])

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)


@lru_cache(2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


@lru_cache(2)
def token_texts(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, special = byte_symbols(), {a["content"]: a["id"] for a in spec["added_tokens"]}
    out = {i: bytes(symbols[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in special}
    out |= {i: s.encode() for s, i in special.items()}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def decode(texts: list[bytes], ids: list[int]) -> str:
    return b"".join(map(texts.__getitem__, ids)).decode("utf-8", "replace")


def encode_bpe(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Add `ids`, an array of ints: every whole `text` as the vocabulary at `path` encodes it.

    A null or empty text has no ids.  Strings of special tokens inside a text become those tokens, as is the
    tokenizers library's default.  An existing `ids` column is replaced; equal rows stay as many; an empty table
    gives an empty one.
    """

    def make():
        bpe = vocabulary(path)

        def work(batch: pa.RecordBatch) -> list:
            ids, ends = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]

        return work

    return map_batches(docs, "text", make, [pa.field("ids", pa.list_(pa.int32()))], keep, limit=ENCODE_BYTES)


def decode_bpe(encoded: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Add `decoded`: the text of every `ids` array, special tokens included.

    Bytes that are no UTF-8 become replacement characters, as in the library.  Null ids decode to the empty text.
    """

    def make():
        texts = token_texts(path)

        def work(batch: pa.RecordBatch) -> list:
            column = batch.column("ids")
            ids, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
            return [pa.array([decode(texts, ids[a:b].tolist()) for a, b in pairwise(ends)], pa.string())]

        return work

    return map_batches(encoded, "ids", make, [pa.field("decoded", pa.string())], keep)


def op4(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_bpe(docs.select("doc_id", "text"), path, ["doc_id"])
    digest = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"))
    decoded = decode_bpe(digest, path, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
