"""The corpus operators against brute force, libraries and exact round trips, with awkward rows throughout."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, graph, iblt, neardup, packing, quality, samples, sharding, telephony, token_counts, toxicity, url_filter

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = ["", None, " ", "  a  b ", "\n\nx\n", "tab\there", "Ünï cödé 中文 😀", "a\x00b", "\x1cx\x1d", "<|endoftext|> <s> ▁", "word " * 30_000, "x" * 20_000, "line\n" * 50]


def corpus():
    """(doc_id, text, lang, source, n_chars): plain texts, odd ones, exact and near copies, and repeated rows."""
    r = random.Random(4)
    texts = list(ODD)
    for _ in range(25):
        base = [r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randint(3, 150))]
        texts.append(" ".join(base))
        if len(base) > 60:
            for _ in range(2):
                edited = list(base)
                edited[r.randrange(len(edited))] = "edited"
                texts.append(" ".join(edited).replace(" ", "\n", 3))
            texts.append(" ".join(base))
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, empty):
    rows = sharding.op9(docs).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        text = (corpus()[r.doc_id][1] or "").encode()
        assert (r.shard, r.grown_shard, r.size, r.text_crc32) == (jump(r.doc_id, 8), jump(r.doc_id, 9), len(text) + 1, zlib.crc32(text))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.op9(empty).count() == 0
    big = spark.range(3000).select((F.col("id") * 7919 - 5).alias("k"), F.lit(1).alias("shard"))
    assert all(r.shard == jump(r.k, 1000) for r in sharding.assign_shards(big, "k", 1000, 4).collect())
    ties = spark.createDataFrame([(None, "a"), (None, "a"), (5, "b"), (5, "b")], "k long, t string")
    got = sharding.assign_shards(ties, "k", 1, 2).collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3]


def test_sharding_cuts_hot_cells_into_pieces(spark):
    """A third of the rows share a key: slots stay gapless, the key stays in its shard, and the other shards' slots are the same."""
    rows = spark.range(1500).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"), F.create_map(F.lit("a"), "id").alias("m"))
    whole = {r.n: (r.k, r.shard, r.slot) for r in sharding.assign_shards(rows, "k", 4, 8).collect()}
    cut = {r.n: (r.k, r.shard, r.slot) for r in sharding.assign_shards(rows, "k", 4, 8, hot_rows=50).collect()}
    assert all(shard == jump(k, 4) for k, shard, _ in cut.values())
    for shard in range(4):
        slots = sorted(slot for _, s, slot in cut.values() if s == shard)
        assert slots == list(range(len(slots)))
    assert {n: v for n, v in cut.items() if v[1] != jump(7, 4)} == {n: v for n, v in whole.items() if v[1] != jump(7, 4)}
    assert cut != whole  # the hot cell is numbered piece by piece
    null_keys = rows.withColumn("k", F.lit(None).cast("long"))
    assert sorted(r.slot for r in sharding.assign_shards(null_keys, "k", 1, 2, hot_rows=50).collect()) == list(range(1500))


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    texts = {d[0]: d[1] or "" for d in corpus()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.op4(docs).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert r.decoded_sha256 == digest(t.decode(ids, skip_special_tokens=False))
    assert bpe.op4(empty).count() == 0
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "é", "The", "ing", "'s", "123", "!!", "<|endoftext|>", "　", "\x85", "aaaa"]
    samples = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    ids, ends = bpe.ByteBPE(path).encode(samples)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [t.encode(s, add_special_tokens=False).ids for s in samples]


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {d[0]: d[1] or "" for d in corpus()}
    for r in token_counts.op5(docs).collect():
        assert (r.n_tokens, r.n_bytes) == (len(sp.encode(texts[r.doc_id])), len(texts[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 4096)
    assert token_counts.op5(empty).count() == 0
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", " \n", "\t", "é", "The", "▁", "<s>", "\x00", "!!", "😀", "   "]
    samples = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    assert token_counts.Counting(model).counts(samples) == [len(sp.encode(s)) for s in samples]


def test_frequent_pre_tokens_come_from_all_rows_and_whole_texts(spark, monkeypatch):
    rows = [(i, "rare" + str(i)) for i in range(3000)] + [(5000 + i, "y" * 30_000 + " late" * 9) for i in range(30)] + [(9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    top = token_counts.heavy_hitters(df).orderBy(F.desc("n")).first()
    assert (top.word, top.n) == ("late", 270)
    words, lengths = token_counts.frequent_table(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert "late" in words.decode().split(" ") and len(words.decode().split(" ")) == len(lengths)
    few = token_counts.frequent_table(df.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert few == (b"", b"")


def test_packing_holds_every_id_once(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.WordIds(path).tokenizer
    texts = {d[0]: d[1] or "" for d in corpus()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op7(docs).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.op7(empty).count() == 0


def test_words_that_share_a_hash_keep_their_own_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordIds(path)
    want = lambda t: [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    got = lambda texts: [np.frombuffer(p, words.kind).tolist() for p in words.encode(texts)]
    for n in (10, 11):  # such words collide under every polynomial modulo 2**64
        morse = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
        texts = [morse + " and " + morse.translate({97: 98, 98: 97}), morse.translate({97: 98, 98: 97}), morse]
        assert got(texts) == [want(t) for t in texts]
    texts = [" ".join(random.Random(3).choices([*WORDS, "Alpha.", "x" * 17, "x" * 16 + "y", "x" * 30, "x" * 29 + "z", "é", "a\x00", "a"], k=400)) for _ in range(5)]
    assert got(texts) == [want(t) for t in texts]
    monkeypatch.setattr(words, "words", lambda data: (lambda s, e, h: (s, e, h * np.uint64(0) + (e - s).astype(np.uint64) % np.uint64(2)))(*packing.WordIds.words(words, data)))
    words.forget()
    for _ in range(2):
        assert got(texts) == [want(t) for t in texts]
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_hilbert_neighbours_touch():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(side, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_fingerprints(spark, docs, empty):
    texts = {d[0]: d[1] or "" for d in corpus()}
    order = sorted(texts, reverse=True)
    following = {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}
    lines = lambda s: {x for x in s.split("\n") if x}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    prints = {}
    for r in iblt.op8(docs).collect():
        mine, other = texts[r.doc_id], texts[following[r.doc_id]]
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + other[:half]
        assert r.n_chars == len(mine) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(lines(mine), lines(edited)))
        assert r.near_next == pytest.approx(like(lines(mine), lines(other)))
        assert prints.setdefault(mine, r.fingerprint) == r.fingerprint
    assert iblt.op8(empty).count() == 0
    many = spark.createDataFrame([(1, "\n".join(f"a{i}" for i in range(700))), (2, "\n".join(f"a{i}" for i in range(300, 1200))), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in iblt.op8(many).collect()}
    assert got[2] == pytest.approx(400 / 1200) and got[1] == 0.0 and got[None] == 0.0


def test_recovered_digests_are_those_of_the_lines_that_differ(spark):
    r = random.Random(6)
    rows = [(i, "\n".join(f"line {r.randrange(60)}" for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(60)]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = {x.line: x.h for x in spark.range(60).select(F.concat(F.lit("line "), "id").alias("line")).withColumn("h", F.xxhash64("line")).collect()}
    digest = lambda lines: sorted(known.get(x) or odd[x] for x in lines)
    order = sorted(texts, reverse=True)
    edits = {}
    for i, a in enumerate(order):
        other, half = texts[order[(i + 1) % len(order)]], len(texts[a]) // 2
        edits[a] = texts[a][: len(texts[a]) - half] + other[:half]
    lines = lambda s: {x for x in s.split("\n") if x}
    broken = sorted({x for t in edits.values() for x in lines(t)} - set(known))
    odd = {x.line: x.h for x in spark.createDataFrame([(b,) for b in broken], "line string").withColumn("h", F.xxhash64("line")).collect()} if broken else {}
    for x in iblt.op8(df).collect():
        mine, edited = lines(texts[x.doc_id]), lines(edits[x.doc_id])
        assert (x.lost, x.gained) == (digest(mine - edited), digest(edited - mine))


def test_fingerprints_of_very_many_lines(spark):
    n = 100_000
    text = lambda a: "\n".join(f"x{i}" for i in range(a, a + n))
    df = spark.createDataFrame([(1, text(0)), (2, text(n // 2))], "doc_id long, text string")
    began = time.time()
    assert [r.near_next for r in iblt.op8(df).collect()] == pytest.approx([1 / 3, 1 / 3])
    assert time.time() - began < 120


def test_next_documents_where_many_share_an_id(spark):
    rows = [(None, f"n{i}") for i in range(300)] + [(7, f"t{i % 40}") for i in range(300)] + [(2**60 + i, f"b{i}") for i in range(50)] + [(-5, "low")]
    got = iblt.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    tie = {x.t: x.h for x in spark.createDataFrame([(t,) for _, t in rows], "t string").withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 4)).collect()}
    order = [t for _, t in sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), -tie[x[1]]))]
    assert sorted((r.text, r.next) for r in got) == sorted(zip(order, order[1:] + order[:1]))


def brute_components(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_relative_targets_are_resolved(spark):
    from urllib.parse import urljoin

    bases = ["https://a.net/x/y/z.html?q=1#f", "https://a.net", "https://a.net/", "http://a.net/x/"]
    targets = ["other.html", "../x/", "?id=3", "./p?a=../b", "../../../up", "..", ".", "/r/../s/./t", "//b.org/x", "http://c.org/y", "sub/n#g", "#top", "../en/"]
    cases = spark.createDataFrame([(b, t) for b in bases for t in targets], "base string, target string")
    for r in cases.select("*", url_filter.absolute(F.col("target"), F.col("base")).alias("got")).collect():
        assert r.got == urljoin(r.base, r.target), r
    odd = spark.createDataFrame([("https://a.net/x", ""), ("https://a.net/x", "mailto:a@b"), ("no host", "p.html"), (None, "p.html")], "base string, target string")
    assert [r[0] for r in odd.select(url_filter.absolute(F.col("target"), F.col("base"))).collect()] == [None] * 4
    html = '<link rel="canonical" href="../bad/p.html?a=1&amp;b=2">'
    pages = spark.createDataFrame([(1, "https://a.net/x/q", html), (2, "https://a.net/bad/p?b=2&a=1", ""), (3, "https://a.net/x/r", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, [("a.net", "/bad/", "block")], spellings=True).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    want, sizes = brute_components([(d[0], d[1]) for d in corpus()], 4, 80)
    for r in neardup.op10(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.op10(empty).count() == 0
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    family = []
    for i in range(300):  # copies with few and many edits: the ends of chains are far apart
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(120)] = f"e{r.randrange(10**6)}"
        family.append((1000 + i, " ".join(words)))
    family += [(5000, None), (None, "w1 w2 w3 w4 w5"), (1000, family[0][1])]
    got = {x.doc_id: x.component_id for x in neardup.op10(spark.createDataFrame(family, "doc_id long, text string")).collect()}
    want, _ = brute_components([f for f in family if f[0] is not None], 4, 80)
    assert {k: v for k, v in got.items() if k is not None} == want and got[None] is None


def test_pairs_with_unlucky_signatures_are_confirmed(spark):
    def member(rep, short, pivot, delta=(), n=100):
        return (7, 1, rep, n, rep, bytearray(short), [rep], pivot, False, bytearray(np.array(delta, np.uint64).tobytes()), 1, 2)

    schema = "band long, place int, rep long, n int, component long, short binary, keys array<long>, pivot long, whole boolean, delta binary, lo long, c long"
    for same, want in ((138, [(1, 2, False)]), (133, [(1, 2, False)]), (100, [])):  # of 200 values; 138 are 0.69 of true likeness
        members = spark.createDataFrame([member(1, [1] * 200, 1), member(2, [1] * same + [2] * (200 - same), 2)], schema)
        assert [tuple(r) for r in neardup._across(members, 80).collect()] == want
    for apart, want in ((11, [(1, 2, True)]), (12, [])):  # 89 / 111 and 88 / 112 of the same pivot, whatever the signatures say
        members = spark.createDataFrame([member(1, [1] * 200, 9, range(apart)), member(2, [2] * 200, 9, range(100, 100 + apart))], schema)
        assert [tuple(r) for r in neardup._across(members, 80).collect()] == want


def test_blocks_give_the_links_of_full_sets():
    r = random.Random(5)
    pivot = set(range(100))
    sets = []
    for i in range(60):
        own = set(pivot) if i % 3 else set()
        own |= {1000 + r.randrange(40) for _ in range(r.randint(0, 15))}
        own -= {r.randrange(100) for _ in range(r.randint(0, 15))}
        sets.append(own | {5000})

    def block(members):
        import pyarrow as pa

        rows = []
        for i in members:
            whole = i % 3 == 0
            delta = sets[i] if whole else sets[i] ^ pivot
            rows.append({"rep": i, "n": len(sets[i]), "component": i, "short": bytes([1] * 200), "keys": [i], "pivot": 0, "whole": whole, "delta": np.array(sorted(delta), np.uint64).tobytes()})
        return neardup._Block(pa.array(rows, pa.struct([("rep", pa.int64()), ("n", pa.int32()), ("component", pa.int64()), ("short", pa.binary()), ("keys", pa.list_(pa.int64())), ("pivot", pa.int64()), ("whole", pa.bool_()), ("delta", pa.binary())])))

    x, y = range(0, 30), range(30, 60)
    sure, unsure = neardup.compare(block(x), block(y), 80)
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert all(alike(a, b) for a, b in sure)
    joined = list(range(60))
    for a, b in [*sure, *(p for p in unsure if alike(*p))]:
        old, new = joined[b], joined[a]
        joined = [new if j == old else j for j in joined]
    assert all(joined[a] == joined[b] for a in x for b in y if alike(a, b)) and len(sure) < 60


def test_one_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(1, " ".join(words)), (1, " ".join(other)), (2, near(words)), (3, near(other)), (4, "something else entirely here now"), (1, " ".join(words)), (None, "x"), (7, ""), (7, " ".join([*other[:-1], "z"]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 4), (7, 1), (7, 1)]
    assert sorted(r.n_shingles for r in got if r.doc_id == 7) == [0, 196] and len(got) == len(rows)


def test_dropping_near_duplicates_keeps_columns(docs):
    kept = neardup.drop_near_duplicates(docs)
    want, _ = brute_components([(d[0], d[1]) for d in corpus()], 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_url_filter(spark):
    canonical = '<link rel="canonical" href="https://www.bad.example.com/en/1?utm_source=x">'
    pages = [
        (1, "http://WWW.Bad.Example.com/en/1#top", None),
        (2, "https://mirror.org/a", canonical),
        (3, "https://mirror.org/b", '<meta http-equiv="refresh" content="0; url=/a">'),
        (4, "https://mirror.org/c", "<a href='/a'>"),
        (5, "http://www.example.com/en/9", canonical),
        (6, None, canonical),
        (7, "no url", ""),
        (8, "https://other.org/x/", '<link rel=stylesheet href="https://mirror.org/a">'),
        (9, "http://x.net/fr/1?a=1", ""),
        (10, "https://spain.net/es", ""),
        (3, "https://mirror.org/b", '<meta http-equiv="refresh" content="0; url=/a">'),
        (11, "http://m.mirror.org/b.html?ref=q", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op1(df).collect()}
    assert got[1] == ("www.bad.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("mirror.org", "/a", None, "block") and got[3][3] == "block" and got[11][3] == "allow"
    spelt = {r.page_id: r.verdict for r in url_filter.judge(df, url_filter.RULES, spellings=True).collect()}
    assert spelt == {i: v[3] for i, v in got.items()} | {11: "block"}  # another spelling of a blocked page counts only on demand
    assert got[4][3] == "allow" and got[8][3] == "allow"
    assert got[5] == ("www.example.com", "/en/9", "www.example.com/en/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[9] == ("x.net", "/fr/1", "net/fr/", "block") and got[10] == ("spain.net", "/es", None, "allow")
    assert url_filter.op1(df).count() == len(pages) and url_filter.op1(df.limit(0)).count() == 0
    logged = spark.createDataFrame([("https://far.org/1", "https://mirror.org/c"), ("https://far.org/1", "http://x.net/fr/1?a=1"), (None, "x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, url_filter.RULES, logged).collect()}[4] == "block"


def test_decisions_spread_along_chains(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    pages = [
        (1, "https://a.org/1", link("https://b.org/2")),
        (2, "https://b.org/2", link("http://m.c.org/3.html?utm_source=x")),
        (3, "https://www.c.org/3/", link("https://good.d.org/4")),
        (4, "https://good.d.org/4", '<meta http-equiv="refresh" content="0; url=http://e.net/bad/">'),
        (5, "https://good.d.org/9", ""),
        (6, "https://c.org/3?utm_medium=y#top", ""),
        (6, "https://c.org/3?utm_medium=y#top", ""),
        (None, "https://b.org/2#x", None),
        (8, "https://f.org/", link("https://a.org/1")),
    ]
    rows = [(*p, "a", "b", "c") for p in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __node string, __found string, Verdict string")
    rules = [("e.net", "/bad/", "block"), ("good.d.org", "/", "allow")]
    out = url_filter.judge(df, rules, spellings=True)
    assert [c for c in out.columns if c.startswith("__")] == ["__node", "__found"]
    got = sorted((r.page_id or 0, r.verdict, r.rule) for r in out.collect())
    assert got == [(0, "block", None), (1, "block", None), (2, "block", None), (3, "block", None), (4, "allow", "good.d.org/"), (5, "allow", "good.d.org/"), (6, "block", None), (6, "block", None), (8, "block", None)]
    without = url_filter.judge(df.filter("page_id <> 4"), rules, spellings=True)
    assert {r.verdict for r in without.collect()} == {"allow"}
    nothing = spark.createDataFrame([], "src string, dst string")
    assert url_filter.judge(df.limit(0), rules, nothing).count() == 0 and url_filter.judge(df, rules, nothing).count() == len(rows)


def ima_reference(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony._STEPS[index])
            change = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                change += step >> shift if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(telephony._MOVES[code])))
            out.append(value)
    return out


def test_telephony(docs, empty):
    texts = {d[0]: (d[1] or "").encode() for d in corpus()}
    for r in telephony.op2(docs).collect():
        raw = texts[r.doc_id]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        codec = telephony.CODECS[len(payload) // 192 % 3]
        media = telephony.wrap(codec, payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        linear = np.array([x for i in range(0, len(payload), 192) for x in ima_reference(payload[i : i + 192])] if codec == "ima" else telephony._TABLES[codec][np.frombuffer(payload, np.uint8)], np.int64)
        samples = np.append(np.stack([linear, linear], 1).ravel()[:-1], linear[-1])
        samples[1:-1:2] = (linear[:-1] + linear[1:]) >> 1
        stored = samples.astype("<i2").tobytes()
        crossings = int(((linear[1:] < 0) != (linear[:-1] < 0)).sum())
        assert r.feature == f"{codec}:{len(samples)}:{int(abs(linear).max())}:{int(np.sqrt((linear.astype(float) ** 2).sum() / len(linear)))}:{crossings}:{zlib.crc32(stored):08x}"
        assert (r.pcm_bytes, r.pcm_sha256) == (44 + len(stored), hashlib.sha256(telephony.wrap("pcm", stored, 16000)).hexdigest())
    assert telephony.op2(empty).count() == 0
    blocks = np.random.default_rng(0).integers(0, 256, (20, 192), dtype=np.uint8)
    assert telephony.decode_ima(blocks).tolist() == [ima_reference(b.tobytes()) for b in blocks]
    assert telephony.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert telephony.resample(np.array([0, 10, 20], np.int16), 8000).tolist() == [0, 5, 10, 15, 20, 20]
    assert telephony.unwrap(telephony.wrap("alaw", b"abc")) == ("alaw", 8000, b"abc")


def accuracy(spark, data, query, label):
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", label)
    rows = query.join(labels, "doc_id").filter("held_out").collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows]) == 1


def test_the_risk_estimators_slope_and_clamp():
    r = np.random.default_rng(1)
    positive = np.arange(9) < 3
    for prior, scale, clamped in ((0.2, 1.0, False), (0.45, 6.0, True)):
        z = r.normal(0, 1, 9) + np.where(positive, scale, -scale * clamped)
        up, down, slope = toxicity.pu_risk(z, positive, prior)
        assert (down < 0) == clamped

        def aim(z):
            up, down, _ = toxicity.pu_risk(z, positive, prior)
            return -down if clamped else up + down

        for i in range(9):
            step = np.eye(9)[i] * 1e-5
            assert slope[i] == pytest.approx((aim(z + step) - aim(z - step)) / 2e-5, abs=1e-7)
        loss = lambda x: np.log1p(np.exp(x))
        assert up == pytest.approx(prior * loss(-z[positive]).mean())
        assert down == pytest.approx(loss(z[~positive]).mean() - prior * loss(z[positive]).mean())


def test_class_prior_needs_no_negatives():
    r = np.random.default_rng(2)
    n_p, n_u, prior = 800, 2000, 0.15
    toxic = np.append(np.ones(n_p, bool), r.random(n_u) < prior)
    row, at = [], []
    for i, t in enumerate(toxic):
        own = set(r.integers(10, 60, 12)) | (set(r.integers(0, 10, 3)) if t else set())
        row += [i] * len(own)
        at += sorted(own)
    sample = toxicity.Sample(np.array(row), np.array(at), np.ones(len(at)), np.arange(n_p + n_u) < n_p, 60)
    groups = np.arange(n_p + n_u) % toxicity.PRIOR_FOLDS
    assert toxicity.class_prior(sample, groups) == pytest.approx(toxic[n_p:].mean(), abs=0.02)
    few = np.isin(np.arange(n_p + n_u), [*range(45), *range(n_p, n_p + 700)])  # at 45 positives as well
    assert toxicity.class_prior(sample.part(few), groups[few]) == pytest.approx(toxic[n_p : n_p + 700].mean(), abs=0.03)


def test_class_prior_where_half_of_the_toxic_are_not_confirmed(spark, monkeypatch):
    """1,000 documents, 13% of them toxic, half of these labelled clean, and a third without labels."""
    r = random.Random(9)
    bad, good = [f"vile{i}" for i in range(12)], [f"word{i}" for i in range(400)]
    toxic = [r.random() < 0.13 for _ in range(1000)]
    texts = [" ".join(r.choices(good, k=40) + (r.sample(bad, 4) if t else [])) for t in toxic]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t and i % 2 == 0)) for i, t in enumerate(toxic) if i % 3], "doc_id long, toxic int")
    found = []
    monkeypatch.setattr(toxicity, "class_prior", lambda *a, estimate=toxicity.class_prior: found.append(estimate(*a)) or found[-1])
    scores = toxicity.train(docs, labels).scores(texts)
    assert found[0] == pytest.approx(sum(toxic) / 1000, abs=0.03)
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(scores[i] >= 0.5 for i in held if toxic[i]) >= 0.8 * sum(toxic[i] for i in held)
    assert not any(scores[i] >= 0.5 for i in held if not toxic[i])


def test_the_networks_slopes(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 3)
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in (0, 5, 124, 128, 700, 2000)]
    net = quality.Network(r.normal(0, 0.3, (quality.WIDTH, 256, 3)), r.normal(0, 1, 3), 0.1)
    net.tables = net.tables.astype(np.float64)
    y = np.array([1, 0, 1, 0, 1.0, 0])
    feats, kept = net.pooled(texts)
    # each filter's largest value in each chunk, by plain loops
    for t, got in zip(texts, feats, strict=True):
        half = quality.SEGMENT // 2 * quality.STRIDE
        n = max(2, -(-(len(t) + quality.STRIDE) // half))
        data = t + bytes(n * half - len(t))
        at = lambda i: np.maximum(sum(net.tables[p, data[i * quality.STRIDE + p]] for p in range(quality.WIDTH)), 0)
        full = n * quality.SEGMENT // 2
        values = np.array([at(i) for i in range(full - 1)])
        chunks = [values[c * 32 : c * 32 + 64].max(axis=0) for c in range(n - 1)]
        assert got == pytest.approx(np.mean(chunks, axis=0), abs=1e-5)
    assert net.scores(texts).tolist() == [net.scores([t])[0] for t in texts]

    def loss():
        z = net.pooled(texts)[0] @ net.out + net.bias
        return float((np.logaddexp(0, z) - y * z).sum())

    z = feats @ net.out + net.bias
    tables, out, bias = net.slopes(1 / (1 + np.exp(-z)) - y, feats, kept)
    for value, slope in ((net.tables, tables), (net.out, out)):
        flat, grad = value.reshape(-1), slope.reshape(-1)
        for i in [*np.argsort(-np.abs(grad))[:5], *r.integers(0, len(grad), 10)]:
            old, step = flat[i], 1e-4
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-3)


def test_classifiers_hold_out(spark, empty):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    for module, op, label, least in ((toxicity, "op6", "toxic", 0.98), (quality, "op3", "quality", 0.98)):
        out = getattr(module, op)(docs, labels)
        score, good = accuracy(spark, data, out, label)
        ranks = score.argsort().argsort() + 1
        area = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
        assert area > least, (label, area)
        assert out.count() == docs.count()
    again = quality.op3(docs.union(docs.limit(5)), labels)
    assert again.count() == docs.count() + 5
    twice = toxicity.op6(docs.union(docs.limit(5)), labels.union(labels.limit(20)))
    assert twice.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).filter("n > 1").count() == 0 and twice.count() == docs.count() + 5
    long = docs.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").limit(3).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.repeat(F.concat("text", F.lit(" ")), 60)})
    more = labels.unionByName(long.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic")))
    assert {r.doc_id for r in samples.sampled(docs.unionByName(long), more.select("doc_id")).collect()} >= {r.doc_id for r in long.collect()}
    none = labels.limit(0)
    assert toxicity.op6(empty, none).count() == 0 and quality.op3(empty, none).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "text", "z")], "doc_id long, text string, score string")
    assert len(toxicity.op6(odd, none).collect()) == 3 and len(quality.op3(odd, none).collect()) == 3
    assert toxicity.drop_toxic(odd, none).columns == odd.columns == quality.drop_poor(odd, none).columns


def test_pipeline(spark):
    """Stage by stage against plain Python on the stage's own input."""
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = neardup.stored(stage(spark, docs, data), name)
        assert docs.columns == before.columns
        kept[name] = (before, {r.doc_id for r in docs.collect()})
    before, ids = kept["toxicity"]
    scorer = toxicity.train(before, labels)
    assert ids == {r.doc_id for r in before.collect() if scorer.scores([r.text or ""])[0] < 0.5}
    before, ids = kept["quality"]
    net = quality.train(before, labels)
    assert ids == {r.doc_id for r in before.collect() if net.scores([(r.text or "").encode()])[0] >= 0.5}
    before, ids = kept["near_duplicates"]
    want, _ = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids == {i for i, c in want.items() if i == c}
    packed = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


#: Repeated rows, ids and texts, and nulls in every column.
AWKWARD = [(1, "one text of six words here"), (1, "one text of six words here"), (2, "one text of six words here"), (2, "and another text under the same id"), (None, "one text of six words here"), (None, None), (3, None), (3, None), (4, ""), (5, "\n \n")]
#: Names that the operators' own results have, in other types.
CLASHING = "n_bytes n_tokens n_chars payload media feature score held_out predicted size law shard slot start length offset sequence_id fingerprint edited_sha256 n_shingles component_id kept over_limit sketch band rep pivot part node component place".split()


@pytest.mark.parametrize("query", [telephony.op2, bpe.op4, token_counts.op5, packing.op7, iblt.op8, sharding.op9, neardup.op10], ids=lambda q: q.__name__)
def test_awkward_rows(spark, query):
    plain_docs = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    rows = query(plain_docs.withColumns({c: F.lit("x") for c in CLASHING})).collect()
    names = rows[0].asDict()
    by_id = lambda out: sorted(([r[c] for c in names if c not in ("sequence_id", "offset", "slot", "shard", "grown_shard")] for r in out), key=repr)
    assert by_id(rows) == by_id(query(plain_docs).collect())
    rows = [r for r in rows if r.asDict().get("start", 0) == 0]  # packing may cut a text; its first piece stands for it
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in AWKWARD), key=repr)
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert [r.doc_id for r in query(nulls).collect()] == [None] * 3
    if query is neardup.op10:
        assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, None: None, 3: 3, 4: 4, 5: 5}
    else:
        same = [r for r in rows if r.doc_id in (1, 3, 4)]
        of_text = [c for c in ("n_bytes", "payload_sha256", "media_sha256", "feature", "n_tokens", "ids_sha256", "decoded_sha256", "over_limit", "doc_tokens", "n_chars", "fingerprint", "size", "text_crc32") if c in names]
        assert of_text and len({tuple(r[c] for c in of_text) for r in same}) == 2


def test_awkward_pages(spark):
    rows = [(1, "http://net/es/a", None), (1, "http://net/es/a", None), (None, "http://net/es/a", "<html>"), (2, None, None), (3, "no scheme", ""), (4, "http://", None)]
    clash = {c: F.lit("x") for c in ("host", "path", "rule", "verdict", "node", "component", "__node", "__found")}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(clash)
    out = url_filter.op1(pages).collect()
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out) == sorted(repr(x) for x in [(1, "net", "/es/a", "net/es/", "block")] * 2 + [(None, "net", "/es/a", "net/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow")])
