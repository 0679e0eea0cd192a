"""Operators 11 to 13 against the library, SQL and brute force, with awkward rows throughout."""

import hashlib
import random
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, filter_audit, neardup, quality, samples, tiktoken_bpe, url_filter

CLASH = "ids decoded mask digest part n first packed salt v p r cluster distance verified quality toxic step n_tokens".split()
TEXTS = ["", None, " ", "tab\there", "Ünï cödé 中文 😀", "a\x00b", "<|endoftext|> it's", "word " * 30_000, "x" * 200_000, "line\n" * 50, "\x85　 a"]


def ranked():
    return tiktoken_bpe.RankedBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_tiktoken_equals_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, ""), (None, "twice"), (None, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bpe = ranked().bpe
    want = []
    for i, t in rows:
        ids = bpe.encode_ordinary(t or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, tiktoken_bpe.op11(docs).collect()), key=repr) == sorted(want, key=repr)
    clashing = docs.withColumns({c: F.lit("x") for c in CLASH})
    assert sorted(map(tuple, tiktoken_bpe.op11(clashing).collect()), key=repr) == sorted(want, key=repr)
    assert tiktoken_bpe.op11(docs.limit(0)).count() == 0


def test_cuts_are_safe(monkeypatch):
    """Cut as often as can be, random texts encode as they do in one piece."""
    bpe, r = ranked(), random.Random(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\r\n", "\t ", "12", "3x", "'s", "'", "'ll", "!", "é", "中", "　", "\x85", "\x1c", "٣", "😀", "can't", "_"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(3000)]
    want = [bpe.bpe.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(tiktoken_bpe, "RUNS", tiktoken_bpe.regex.compile(r"\p{White_Space}{2,}"))
    for size in (1, 2, 5):
        monkeypatch.setattr(tiktoken_bpe, "cut", lambda text, size=size: CUT(text, size))
        assert [[int(i) for part in bpe.encode_parts(t) for i in part] for t in texts] == want


CUT = tiktoken_bpe.cut


def test_long_texts_do_not_end_the_library():
    """A million spaces make the library panic in one call."""
    bpe = ranked()
    spaces, words = " " * 1_200_000, "the quick brown fox 123abc " * 60_000
    ids = bpe.encode(words + spaces + "end")
    assert bpe.decode(ids) == (words + spaces + "end").encode()
    head = bpe.bpe.encode_ordinary(words + " a")[:-1]
    assert ids[: len(head) - 1].tolist() == head[:-1]
    assert ids[-1] == bpe.bpe.encode_ordinary(" end")[0]
    assert bpe.decode(bpe.encode("\n" * 1_100_000)) == b"\n" * 1_100_000
    assert bpe.decode(np.array([255, 129], np.uint32)) == bpe.bpe.decode_bytes([255, 129])  # no UTF-8 is needed


def audit_rows():
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "DELTA", "a$b", "x", "y\x1cz", "é", "中文"]
    rows = []
    for i in range(160):
        n = r.choice([0, 1, 5, 199, 200, 201, 300])
        vocabulary = words if r.random() < 0.4 else [f"{'é' * 9}{'W' if k % 4 else 'w'}{k}" for k in range(r.choice([90, 250]))]
        text = r.choice([" ", "\n", "\x0b\t"]).join(r.choices(vocabulary, k=n)) or None
        rows.append((i, text, r.choice(["en", "de", "", None])))
    rows += [(200 + i, rows[i % 7][1], r.choice(["en", "fr"])) for i in range(60)]
    return rows + [(5, rows[5][1], "en"), (5, "another text of this id", "de"), (None, rows[5][1], "en"), (None, "alone", None), (None, "alone", None)]


def fails(text):
    words = [w for w in tiktoken_bpe.regex.split(r"[\x20\x09-\x0D]+", text) if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text)]


def brute_audit(rows, labels):
    """Every order applied to every document, one step after the other."""
    least, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        text = t or ""
        copy = text in least and (i is None or i > least[text])
        docs.append((lang or "", [*fails(text), copy], *labels.get(i, (0, 0))))
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = [True] * len(docs)
            for step, letter in enumerate(order, 1):
                f = "ABCDE".index(letter)
                row = dict.fromkeys(("kept", "removed", "redundant", "good_lost", "toxic_lost", "unique_fails"), 0)
                for k, (p, failed, good, bad) in enumerate(docs):
                    if p != part:
                        continue
                    row["unique_fails"] += failed[f] and sum(failed) == 1
                    if failed[f] and not alive[k]:
                        row["redundant"] += 1
                    elif failed[f]:
                        alive[k] = False
                        row["removed"] += 1
                        row["good_lost"] += good
                        row["toxic_lost"] += bad
                        shapley[letter] += 1
                    row["kept"] += alive[k]
                out[part, order, step] = row
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = shapley[order[step - 1]]
    return out


def test_filter_audit(spark):
    rows = audit_rows()
    labels = {i: (i % 2, int(i % 5 == 0)) for i in range(0, 220, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    marks = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(0, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    got = filter_audit.op12(docs.withColumns({c: F.lit("x") for c in CLASH}), marks).collect()
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} == want[r.part, r.filter_order, r.step]
    assert filter_audit.op12(docs.limit(0), marks).count() == 0


def test_fields_do_not_carry():
    """Fields near their limit stay apart, and beyond it the sum is refused."""
    table = filter_audit.packed_outcomes()
    sums = {}
    filter_audit.add(sums, "x", (filter_audit.MOST_ROWS - 1) * table[31, True, True], filter_audit.MOST_ROWS - 1)
    values = np.frombuffer(sums["x"][0].to_bytes(filter_audit.FIELDS * 8, "little"), "<u8")
    assert (values == filter_audit.outcomes(31, True, True) * np.uint64(filter_audit.MOST_ROWS - 1)).all()
    with pytest.raises(OverflowError):
        filter_audit.add(sums, "x", 2 * table[0, False, False], 2)


def vectors(n, seed):
    """Clumps with ties, repeated vectors and a few that are not whole."""
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (5, 64))
    rows = [(i, (centres[i % 5] + r.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[i][1]) for i in range(10)] + [(1, rows[2][1]), (None, rows[0][1])]
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63]
    return rows, rows + [(2000 + i, b) for i, b in enumerate(bad)]


def brute_clusters(rows, k=8, rounds=10):
    points = [[int(np.floor(1024 * float(x))) for x in v] for _, v in rows]
    names = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), p) for (i, _), p in zip(rows, points, strict=True) if i is not None))
    centres = [p for _, p in names[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        found = [min((distance(p, c), j) for j, c in enumerate(centres)) for p in points]
        if turn < rounds:
            for j in range(len(centres)):
                own = [p for p, (_, c) in zip(points, found, strict=True) if c == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return found, centres


def test_centroids(spark):
    whole, rows = vectors(150, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit("x") for c in CLASH})
    found, centres = brute_clusters(whole)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = [sum(d for d, c in found if c == j) for j in range(8)]
    want = [(i, c, d, inertia[c], sum(inertia), names[c]) for (i, _), (d, c) in zip(whole, found, strict=True)]
    assert sorted(map(tuple, centroids.op13(df).collect()), key=repr) == sorted(want, key=repr)
    assert centroids.op13(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance) for r in centroids.op13(few).collect()} == {(0, 0), (1, 0), (2, 0)}
    with pytest.raises(Exception, match="64 bits"):
        centroids.op13(spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<float>")).collect()


def test_the_filter_passes_over_centroids():
    """Bounds never exceed distances, ties go to the smaller number, and most centroids aren't verified."""
    r = np.random.default_rng(1)
    centres = r.integers(-5000, 5000, (40, 64))
    centres[7] = centres[3]
    v = centres[r.integers(0, 40, 2000)] + r.integers(-300, 300, (2000, 64))
    v[0] = centres[3]
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    p, rest, _ = centroids.rotated(v, axes, 12)
    best, distance, verified = centroids.Nearest(centres, axes, 12).find(v, p, rest)
    every = ((v[:, None, :] - centres[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all() and best[0] == 3
    assert verified.mean() < 3
    far = v * (centroids.LIMIT // 8000)  # close to what 64 bits hold
    p, rest, _ = centroids.rotated(far, axes, 12)
    best, distance, _ = centroids.Nearest(centres * (centroids.LIMIT // 8000), axes, 12).find(far, p, rest)
    assert (best == every.argmin(1)).all()


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_pca_centroids"])
def test_sql(spark, data, name):
    from tidemark.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        duck.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries.queries()[name](spark, data)
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cursor.fetchall())


def test_linked_pages_through_both_engines(spark):
    """Relative, dotted, protocol-relative and escaped targets give the same verdicts in Spark and DuckDB."""
    link = lambda to: f'<link rel="canonical" href="{to}">'
    pages = [
        (1, "https://site.net/es/x/p.html", ""),
        (2, "https://site.net/a/b", link("../es/x/./p.html")),
        (3, "https://site.net/c/d.html?q=1", link("?id=3&amp;b=2")),
        (4, "https://site.net/c/d.html?id=3&b=2", link("/a/b#t")),
        (5, "https://site.net/a/b#t", link("b")),
        (6, "https://far.org/1", '<meta http-equiv="refresh" content="0; url=//site.net/a/b">'),
        (7, "https://far.org/2/", link("../../../1")),
        (8, "https://far.org", link("free.html")),
        (9, "https://far.org/free.html", link("mailto:a@b")),
        (10, "https://www.example.com/en/7", link("https://far.org/1")),
        (11, "http://sub.example.com/en/", None),
        (12, "https://far.org/x/y/..", link("https://sub.example.com/en/..")),
        (13, None, link("https://far.org/1")),
        (14, "no host", link("p.html")),
        (15, "https://far.org/free.html#a", link("#b")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(map(tuple, url_filter.op1(df).collect()))
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into pages values (?, ?, ?)", pages)
    assert got == sorted(duck.execute(url_filter.oracle_sql()).fetchall())
    verdicts = {r[0]: r[4] for r in got}
    assert [verdicts[i] for i in (1, 2, 3, 4, 5, 6, 7)] == ["block"] * 7 and [verdicts[i] for i in (8, 9, 10, 15)] == ["allow"] * 4


def test_links_of_very_large_sets(spark):
    """Two sets of 29 million shingles that differ in two: neither Spark's test nor numpy's leaves 32 bits behind."""
    n = 29_000_000
    sizes = spark.createDataFrame([(1, 2, n, n, n - 1, False, b""), (3, 4, n, n, n // 2, False, b"")], neardup._OVERLAPS)
    assert [tuple(r) for r in neardup._links(sizes, 80).collect()] == [(1, 2)]
    import pyarrow as pa

    def block(rep, delta):
        item = {"rep": rep, "n": n, "component": rep, "short": bytes(200), "keys": [rep], "pivot": 1, "whole": False, "delta": np.array(delta, np.uint64).tobytes()}
        kind = pa.struct([("rep", pa.int64()), ("n", pa.int32()), ("component", pa.int64()), ("short", pa.binary()), ("keys", pa.list_(pa.int64())), ("pivot", pa.int64()), ("whole", pa.bool_()), ("delta", pa.binary())])
        return neardup._Block(pa.array([item], kind))

    assert neardup.compare(block(5, [1, 2]), block(6, [1, 3]), 80) == ([(5, 6)], [])


def test_crops_keep_their_labels_and_the_sample_is_bounded(spark):
    r = np.random.default_rng(1)
    good, poor = ([" ".join(r.choice(words, 300)).encode() for _ in range(60)] for words in (["river", "meadow", "forest", "valley"], ["zzq", "xxj", "qqv", "kkz"]))
    net = quality.fit([*good, *poor], np.array([1.0] * 60 + [0.0] * 60))
    for size in (32, 128, 1000):
        assert (net.scores([t[:size] for t in good]) >= 0.5).mean() > 0.9 and (net.scores([t[:size] for t in poor]) >= 0.5).mean() < 0.1
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)] + [(99, "y" * 100_000)], "doc_id long, text string")
    picked = docs.select("doc_id").withColumn("quality", F.lit(1))
    rows = samples.texts_of(docs, picked, 3, 20_000)
    assert 1 <= len(rows) <= 20 and sum(len(x.text) for x in rows) <= 20_000
    assert len(samples.texts_of(docs, picked, 3, 1 << 20)) == 51


def test_components_with_hot_nodes_apart(spark, monkeypatch):
    """The plan that keeps hot keys apart gives what the plain join gives."""
    from tidemark.llm import graph

    r = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    plain = {x.node: x.component for x in graph.components(df).collect()}
    monkeypatch.setattr(graph, "FEW_ROWS", 0)
    assert {x.node: x.component for x in graph.components(df).collect()} == plain and plain[399] == 0
