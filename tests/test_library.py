"""Loaders, tables, quality and text on small inputs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators import quality, resolve, text
from tidemark.sources import loaders, schemas, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dates_and_numbers(spark):
    for raw, want in (("20240131", date(2024, 1, 31)), ("20240231", None), ("2024013", None), (None, None), ("20240131.0", date(2024, 1, 31))):
        assert one(spark, fn.compact_date(F.lit(raw).cast("string"))) == want
    assert one(spark, fn.iso_date(F.lit("2024-02-30"))) is None
    assert one(spark, fn.advance_quarters(F.lit("2024-11-30").cast("date"), 1)) == date(2025, 2, 28)
    assert one(spark, fn.scaled_number(F.lit("x"), F.lit(3), F.lit(""))) is None
    assert one(spark, fn.signed_exp(fn.signed_log(F.lit(-12345.0)))) == pytest.approx(-12345.0)
    assert one(spark, fn.close_to(F.lit(float("nan")), F.lit(1.0), 0.1)) is False


def test_names_and_concepts(spark):
    assert one(spark, fn.normalise_name(F.lit("The Acme, Holdings Inc."))) == "ACME"
    assert one(spark, fn.concept_name(F.lit("Revenues"), F.lit("us-gaap/2024"))) == "us-gaap:Revenues"
    assert one(spark, fn.concept_name(F.lit("X"), F.lit(None).cast("string"))) == "custom:unknown"
    assert one(spark, fn.segments_json(F.lit("B=1;A=2;B=3;"))) == '{"A":"2","B":"3"}'
    assert one(spark, fn.segments_json(F.lit(None).cast("string"))) == ""
    assert one(spark, fn.mime_type(F.lit("a.HTM"))) == "text/html"


def test_tolerant_responses(spark):
    good = '[{"target_name":"T","relationship_type":"Supplier","evidence_span":"e"}]'
    for raw, n in ((good, 1), (f"Here:\n```json\n{good}\n```", 1), ("[]", 0), ("", 0), ("{}", 0), (None, 0), ("[1, 2", 0)):
        assert one(spark, F.size(fn.edges_from_response(F.lit(raw).cast("string")))) == n


def test_conform_checks_and_back_fills(spark):
    row = spark.createDataFrame([("e", "macro", date(2024, 1, 1), date(2024, 1, 2), None, "s", "r", 1.0)], "entity_id string, modality string, effective_date date, availability_date date, restated_at date, source string, source_ref string, value double")
    full = schemas.conform(row, "macro").first()
    assert (full.belief, full.perspective, full.policy_tags, full.series_id) == (1.0, "fred:alfred", [], None)
    with pytest.raises(ValueError, match="source_ref"):
        schemas.conform(row.drop("source_ref"), "macro")
    assert set(schemas.missing_columns(row, "macro")) == set(schemas.defaults("macro"))


def test_merge_write_is_idempotent_and_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda v: spark.createDataFrame([(f"e{i}", date(2024, 1, 1), f"r{i}", "c", v) for i in range(6)], "entity_id string, effective_date date, source_ref string, concept string, value double")
    tables.append(make(1.0), path, 1, 4)
    tables.append(make(2.0).filter("entity_id < 'e3'"), path, 2, 4)
    tables.append(make(2.0).filter("entity_id < 'e3'"), path, 2, 4)
    got = {r.entity_id: r.value for r in tables.read(spark, path, ["concept"], buckets=4).collect()}
    assert got == {f"e{i}": 2.0 if i < 3 else 1.0 for i in range(6)}
    assert [r.entity_id for r in tables.read(spark, path, ["concept"], ["e5"], 4).collect()] == ["e5"]
    assert tables.compact(spark, path, ["concept"], f"file://{tmp_path}/v2", 4) == 6


def test_rows_of_one_key_in_one_batch_merge_alike_in_any_layout(spark):
    schema = "entity_id string, effective_date date, availability_date date, source_ref string, concept string, value double, batch int"
    d = date(2024, 1, 1)
    rows = [("e", d, date(2024, 2, i), "r", "c", float(i), 1) for i in (3, 1, 2)] + [("f", d, d, "r", "c", float(i), 1) for i in range(20)]
    picked = {tuple(sorted((r.entity_id, r.value) for r in tables.merged(spark.createDataFrame(rows[::s], schema).repartition(n), ["concept"]).collect())) for s in (1, -1) for n in (1, 3, 7)}
    assert len(picked) == 1 and ("e", 3.0) in next(iter(picked))


def test_only_the_first_arrival_of_a_body_is_new(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, None)], "n int, body string")
    stored = spark.createDataFrame([("b",)], "body string").select(F.sha1("body").alias("sha1"))
    first, log = tables.archive(new, stored, ["n"])
    assert {r.n: r.was_new for r in log.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert sorted(r.n for r in first.collect()) == [1, 5] and "body" in first.columns


def test_relayout_counts_equal_rows_once(spark, tmp_path):
    a = spark.createDataFrame([("e1", 1), ("e2", 2), ("e2", 2)], "entity_id string, v int")
    b = spark.createDataFrame([("e2", 2), ("e3", 3)], "entity_id string, v int")
    assert tables.relayout(a, f"file://{tmp_path}/new", b, 4) == 3


def test_promote_undo_and_refusals(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    assert tables.current(spark, root) is None
    with pytest.raises(ValueError):
        tables.undo(spark, root)
    assert not tables.promote(spark, root, "v1", gate=lambda p: False)
    assert tables.promote(spark, root, "v1", dry_run=True) and tables.current(spark, root) is None
    tables.promote(spark, root, "v1")
    tables.promote(spark, root, "v2")
    assert tables.current(spark, root) == "v2"
    with pytest.raises(ValueError):
        tables.promote(spark, root, "v2")
    assert tables.undo(spark, root) == "v1" == tables.current(spark, root)
    with pytest.raises(ValueError):
        tables.undo(spark, root)


def test_retention(spark):
    v = spark.createDataFrame([("m", f"v{i}", a) for i, a in enumerate((1, 40, 50, 60, 20))], "modality string, version string, age_days int")
    assert {r.version: r.kept for r in tables.retained(v).collect()} == {"v0": True, "v4": True, "v1": True, "v2": False, "v3": False}


def test_rules_count_nan_and_null_as_violations(spark):
    df = spark.createDataFrame([("a", "us-gaap:Assets", float("nan")), ("b", "us-gaap:Assets", None), ("c", "us-gaap:Assets", 1.0), ("d", "us-gaap:Liabilities", 1.0)], "k string, concept string, value double")
    rule = next(r for r in quality.ACCOUNTING_RULES if r.name == "nonnegative_total_assets")
    wide = quality.pivot_concepts(df, ["k"], ["us-gaap:Assets"], ["concept"])
    assert {r.k: r.ok for r in quality.evaluate(wide, ["k"], [rule]).collect()} == {"a": False, "b": False, "c": True}


def test_gate_passes_without_checks(spark):
    empty = spark.createDataFrame([], "rule string, severity string, modality string, ok boolean")
    r = quality.gate(quality.tally(empty)).first()
    assert r.passed and r.hard_checks == 0


def test_items_keep_the_longest_body_and_ignore_inline_headings(spark):
    body = "Item 1. Business\nItem 1A. Risk\nsee Item 7 above\nItem 1. Business\nlong body here\nItem 2. Land\nx"
    df = spark.createDataFrame([(1, body), (2, "no heading"), (3, "")], "k int, text string")
    got = {r.item_id: r.text for r in text.items(df, "k").collect()}
    assert got == {"1": "long body here", "1A": "see Item 7 above", "2": "x"}


def test_items_of_texts_with_marks_and_nulls(spark):
    df = spark.createDataFrame([(1, "Item 1. A\x00b\nbody \x00\x01\x03 here\nItem 2. C\nrest"), (2, None)], "k int, text string")
    assert sorted((r.item_id, r.item_title, r.text) for r in text.items(df, "k").collect()) == [("1", "A\x00b", "body \x00\x01\x03 here"), ("2", "C", "rest")]


def chunked(spark, texts):
    """The chunks of each text, in order, as the operator gives them."""
    rows = text.chunk_rows(spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(2), ["k"]).collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.k, r.chunk_idx)):
        assert r.chunk_idx == len(out[r.k]) and r.n_chars == len(r.text)
        out[r.k].append(r.text)
    assert all(r.n_chunks_in_item == len(out[r.k]) for r in rows)
    return out


def by_the_rule(whole):
    """The rule, character by character."""
    want, at, n = [], 0, len(whole or "")
    while at < n:
        end = at + 4000
        if n <= 4000:
            return [whole]
        if end < n:
            spaces = [i for i in range(at + 3800, end) if whole[i] == " "]
            end = spaces[-1] if spaces else end
        want.append(whole[at : min(end, n)].strip())
        if end >= n:
            break
        at = max(end - 800, at + 1)
    return [c for c in want if c]


def test_chunks_by_the_rule(spark):
    import random

    r = random.Random(8)
    texts = ["".join(r.choices("abcdefgh ", k=n)) for n in (0, 1, 3999, 4000, 4001, 7999, 8000, 8001, 20_000, 300_000)]
    texts += ["x" * 9000, " " * 9000, "\n\u2003" * 30, "\n\u2003\x1c" * 4000, None, "a" * 3800 + " " + "b" * 3000, "a" * 3999 + " " + "b" * 3000]
    texts += ["".join(r.choices("aé漢😀 \n\t\u00a0\u3000\x85", weights=[9, 9, 9, 9, 1, 1, 1, 1, 1, 1], k=n)) for n in (3999, 4001, 12_345, 50_000)]
    texts += ["".join(r.choices(["word", "  ", "\r\n", "😀" * 50, "z" * 900], weights=[9, 5, 2, 2, 1], k=k)) for k in (50, 400, 2000)]
    assert chunked(spark, texts) == list(map(by_the_rule, texts))


def test_chunks_cover_the_text(spark):
    words = " ".join(f"w{i}" for i in range(4000))
    parts, none, null = chunked(spark, [words, "", None])
    assert all(len(p) <= text.CHUNK_CHARS for p in parts)
    assert set(" ".join(parts).split()) >= {"w0", "w3999", "w2000"}
    assert none == [] and null == []


def test_chunks_stay_in_the_jvm_and_are_walked_once(spark):
    rows = text.chunk_rows(spark.createDataFrame([(1, "a")], "k int, text string"), ["k"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("aggregate(sequence(") == 1, plan


def test_plain_text():
    assert text.plain_text("<p>a  b</p><script>x</script><div>c<br>d&amp;e</div>") == "a b\n\nc\nd&e"
    assert text.plain_text(None) == ""


@pytest.mark.parametrize("tag", ["ix:header", "ix:hidden", "ix:resources", "ix:references", "ix:relationship", "script", "style", "noscript"])
def test_hidden_containers_are_dropped(tag):
    assert text.plain_text(f"<p>a</p><{tag}>b</{tag}><p>c <ix:nonFraction>4</ix:nonFraction></p>") == "a\n\nc 4"
    assert text.plain_text(f"a <{tag}/>b") == "a b" if tag.startswith("ix:") else True


def test_fuzzy_resolution(spark):
    reg = spark.createDataFrame([("e1", "Apple Computer Inc", "AAPL", 1), ("e2", "Microsoft Corp", "MSFT", 2)], "entity_id string, name string, ticker string, pos int")
    m = spark.createDataFrame([("APPLE COMPUTER",), ("Microsofte Corporation",), ("Nobody Knows",), ("",)], "name string")
    got = {r.name: r.entity_id for r in resolve.resolve(m, resolve.index(reg)).collect()}
    assert got == {"APPLE COMPUTER": "e1", "Microsofte Corporation": "e2", "Nobody Knows": "unresolved:Nobody Knows", "": "unresolved:empty"}


def test_no_key_is_left_out_of_a_large_block(spark):
    fillers = [(f"f{i}", f"NATIONAL BANK {i}", f"T{i}", i) for i in range(1200)]
    reg = spark.createDataFrame([*fillers, ("small", "FRISKY WIDGETS", "FW", 2000), ("right", "FIRST NATIONAL BANK", "FNB", 2001)], "entity_id string, name string, ticker string, pos int")
    m = spark.createDataFrame([("Frist National Bank",)], "name string")
    keys = resolve.index(reg)
    name = "FRIST NATIONAL BANK"
    score, _, entity = max((resolve.token_set_score(name, r.key), r.key, r.entity_id) for r in keys.collect())
    got = resolve.resolve(m, keys).first()
    assert (got.entity_id, got.score) == (entity, score) == ("right", pytest.approx(94.7368, abs=1e-4))


def test_front_typos_and_placeholder_scores_against_all_keys(spark):
    reg = spark.createDataFrame([("e1", "MICROSOFT", "MSFT", 1), ("e2", "AMAZON", "AMZN", 2), ("e3", "ORACLE SYSTEMS", "ORCL", 3)], "entity_id string, name string, ticker string, pos int")
    keys = {r.key: r.entity_id for r in resolve.index(reg).collect()}
    names = ["MIRCOSOFT", "MCIROSOFT", "NICROSOFT", "MAAZON", "ROACLE SYSTEMS", "MICROPHONE", "ZZZ"]
    got = {r.name: (r.entity_id, r.score) for r in resolve.resolve(spark.createDataFrame([(n,) for n in [*names, ""]], "name string"), resolve.index(reg)).collect()}
    assert got.pop("") == ("unresolved:empty", 0.0)
    for n in names:
        score, key = max((resolve.token_set_score(n, k), k) for k in keys)
        assert got[n] == (keys[key] if score >= resolve.THRESHOLD else f"unresolved:{n}", score)
    assert got["MIRCOSOFT"][0] == "e1" and 0 < got["MICROPHONE"][1] < resolve.THRESHOLD


def test_best_keys_against_all_pairs():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b, 1):
                row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    r = random.Random(5)
    words = ["".join(r.choices("ABCDE\u00c4\u4e2d", k=r.randint(1, 8))) for _ in range(60)]
    keys = sorted({" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(400)})
    names = ["".join(c for c in k if r.random() > 0.1) + r.choice(["", " A", "X"]) for k in r.sample(keys, 120)]
    for a, b in zip(names, keys, strict=False):
        assert a + b == "" or resolve._ratio(a, b) == 200.0 * lcs(a, b) / (len(a) + len(b))
    expected = [max((resolve.token_set_score(n, k), k, i) for i, k in enumerate(keys)) for n in names]
    assert resolve.best_keys(names, keys) == [(s, i) for s, _, i in expected]


def misspelt(r, name):
    """A name with a typo at the front, inside or at the end, with its words in another order, one more or one less."""
    words, kind = name.split(), r.randrange(7)
    at = {0: 0, 1: len(name) // 2, 2: len(name) - 1}.get(kind, r.randrange(len(name)))
    if kind < 3:
        return (name[:at] + r.choice("QXZE") + name[at + r.choice([0, 1]) :]).strip()
    if kind == 3:
        return (name[:at] + name[at + 1 : at + 2] + name[at : at + 1] + name[at + 2 :]).strip()
    if kind == 4:
        return " ".join(reversed(words))
    return " ".join([*words, r.choice(["GROUP", "ZQJ"])]) if kind == 5 else " ".join(words[1:]) or name


def test_inverted_index_against_all_pairs(spark):
    """1,500 names against 3,000 keys: the scores and keys of all pairs, above the threshold and below it, without a product."""
    import random

    r = random.Random(11)
    stems = ["".join(r.choices("AEIOU", k=1) + r.choices("BCDFGLMNPRST", k=2)) for _ in range(90)]
    rare = ["".join(r.choices(stems, k=r.randint(1, 3))) for _ in range(1500)]
    common = ["NATIONAL", "BANK", "FIRST", "AMERICAN", "PACIFIC", "SYSTEMS", "\u00c4RZTE"]
    keys = sorted({" ".join(r.sample(rare, r.randint(1, 2)) + r.sample(common, r.choice([0, 1, 1, 2]))) for _ in range(3000)} | {"A", "AB", "BANK"})
    names = sorted({misspelt(r, k) for k in r.sample(keys, 1300)} | {" ".join(r.sample(common, 3)) for _ in range(40)} | {"ZZZZ", "\u4e2d\u6587", "Q", "AC", "BANK BANK"})
    found = resolve.best_matches(spark.createDataFrame([(n,) for n in names], "key string"), spark.createDataFrame([(k,) for k in keys], "k string"))
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {x.key: (x.score, x.k) for x in found.collect()}
    want = {n: (score, keys[i]) for n, (score, i) in zip(names, resolve.best_keys(names, keys), strict=True)}
    assert {n: x for n, x in want.items() if x[0] > 0} == got
    above = sum(x[0] >= resolve.THRESHOLD for x in got.values())
    assert above > 700 and len(got) - above > 50, (above, len(got))


def test_a_frequent_word_is_cut_into_parts(spark, monkeypatch):
    """A word of all keys and names meets in rows of bounded parts, and no pair is lost."""
    monkeypatch.setattr(resolve, "NAMES", 16)
    monkeypatch.setattr(resolve, "KEYS", 32)
    keys = [f"BANK OF {chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(200)]
    names = [f"BANC OF {chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)]
    met = resolve._meet(spark.createDataFrame([(n, "OF") for n in names], "key string, sig string"), spark.createDataFrame([(k, "OF") for k in keys], "k string, sig string"))
    got = {x.key: (x.score, x.k) for x in resolve._best(met).collect()}
    assert got == {n: (score, keys[i]) for n, (score, i) in zip(names, resolve.best_keys(names, keys), strict=True)}


def test_tsv_and_registry(spark, tmp_path):
    (tmp_path / "num.tsv").write_text("adsh\ttag\nx\tA\ny\tB\n")
    assert loaders.read_tsv(spark, [f"file://{tmp_path}/num.tsv"], "adsh string, tag string").count() == 2
    t = spark.createDataFrame([(0, 5, "LONG", "First"), (1, 5, "AB", "Second"), (2, 5, "CD", "Third")], "pos int, cik int, ticker string, name string")
    r = loaders.registry(t).first()
    assert (r.entity_id, r.ticker, r.name) == ("us-cik-0000000005", "AB", "First")


def test_malformed_ownership_gives_no_rows(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1), "<ownershipDocument><oops></ownershipDocument>"), ("b", date(2024, 1, 1), "nothing")], "accession string, filed date, content string")
    assert loaders.ownership_trades(df).count() == 0


def test_entry_without_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pit_01' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
