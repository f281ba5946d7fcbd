"""Operators on small tables against plain versions: nulls, empty and long texts, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import classifier, decontam, jaccard, licenses, packing, pii, quality_rules, queries, simple8b, substring
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _id string, cls int, covered string"


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7)))
    vocabulary = [word() for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))
    base = [say(rng.randint(12, 140)) for _ in range(25)]
    out = [None, "", " \n\t ", "one", "one two", "One TWO", base[0], base[0], say(3000)]
    for b in base:
        words = b.split(" ")
        out.append(b)
        for share in (0.02, 0.04, 0.3):
            out.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words))
    out += [f"mail {rng.randint(1, 9)}@x.org now, 10.0.0.{k} and 300.1.1.1, card 4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (212) 555-010{k} " + say(30) for k in range(4)]
    out += ["Und " * 60, "A!! " * 40, "x ### y *** z %%% " * 12, "same line here\n" * 9, say(50) + "\nReleased under the MIT License.\n" + say(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 4 else k // 2 if k in (10, 11) else k, t, None if k % 3 else "en", None, None, k, "x", 1, None) for k, t in enumerate(texts())]
    rows.append(rows[20])
    return rows, spark.createDataFrame(rows, SCHEMA)


def pairs_of(rows):
    return [(r[0], r[1]) for r in rows]


def key(k):
    return (k is None, k or 0)


def test_quality_rules(docs):
    rows, df = docs
    got = sorted(((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["kept"]) for r in quality_rules.judged(df, sample_rows=20).collect()), key=str)
    want = sorted(((k, brute.quality(t), brute.kept_by_rules(t, quality_rules.DUP_LINE_PERCENT)) for k, t in pairs_of(rows)), key=str)
    assert got == want
    kept = quality_rules.keep_good(df, sample_rows=20)
    assert kept.columns == df.columns and kept.count() == sum(w[2] for w in want)


@pytest.mark.parametrize("percent, n", [(90, 3), (80, 5)])
def test_jaccard_components(docs, percent, n):
    rows, df = docs
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(df, jaccard.Join(percent, n)).collect()), key=str)
    want = sorted(((k, s, c if s else k) for (k, _), (s, c) in zip(pairs_of(rows), brute.components(pairs_of(rows), percent, n), strict=True)), key=str)
    assert got == want


def test_keep_one(docs):
    rows, df = docs
    kept = jaccard.keep_one(df, jaccard.Join(90, 3))
    assert kept.columns == df.columns
    comps = {c for (k, _), (s, c) in zip(pairs_of(rows), brute.components(pairs_of(rows), 90, 3), strict=True) if s and c is not None}
    assert comps <= {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_decontamination(spark, docs):
    rows, df = docs
    items = [(1, " ".join(brute.alnum(rows[30][1])[3:20])), (20, "one two"), (3, None), (4, " .. "), (100, " ".join(brute.alnum(rows[40][1])[:12]).upper()), (1, "zz zz zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((k, *brute.benchmark_hits(t, items)) for k, t in pairs_of(rows)), key=str)
    for limit in (1_000_000, 12):
        found = decontam.find_benchmark(df.select("doc_id", "text"), bench, block_windows=limit)
        got = found.select("doc_id", "n_words", decontam.n_hit().alias("n"), F.size("items").alias("i"), F.sha2(F.array_join(F.array_sort("items"), ","), 256)).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(1 for w in want if w[2] == 0)
    cut = decontam.decontaminate(df, bench, "spans")
    assert all(brute.benchmark_hits(r["text"], [items[0]])[1] == 0 for r in cut.collect())


def test_pii(docs):
    rows, df = docs
    found = pii.find_pii(df.select("doc_id", "text")).collect()
    got = sorted(((r["doc_id"], [(pii.KINDS[p["kind"]], p["start"], p["end"]) for p in r["pii"] if p["base"]]) for r in found), key=str)
    want = sorted(((k, brute.base_spans(t)) for k, t in pairs_of(rows)), key=str)
    assert got == want
    clean = pii.redact(df)
    assert clean.columns == df.columns and not any(brute.base_spans(r["text"]) for r in clean.collect())


def test_pii_adds_spelt_out_and_keeps_off_references(spark):
    text = "call (212) 555-0187 today; order 212-555-0187 shipped; write to jane.roe (at) example (dot) org a@b@c.de x@y.z_q@r.st"
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    got = {(pii.KINDS[p["kind"]], text[p["start"] : p["end"]]) for p in r["pii"]}
    assert {("phone", "(212) 555-0187"), ("email", "b@c.de"), ("email", "x@y.z"), ("email", "_q@r.st")} <= got and ("phone", "212-555-0187") not in got


def test_pii_of_long_runs(spark):
    long = "1" * 40_000 + " " + "a" * 40_000 + " " + "1.2." * 9_000 + " " + "12 " * 9_000 + "x@" + "b." * 5_000 + "c"
    r = pii.find_pii(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert [(pii.KINDS[p["kind"]], p["start"], p["end"]) for p in r["pii"] if p["base"]] == brute.base_spans(long)


def test_substring_dedup(docs):
    rows, df = docs
    out = substring.remove_repeats(df)
    assert out.columns[: len(df.columns)] == df.columns
    order = sorted({(key(k), t) for k, t in pairs_of(rows) if t})
    seen, want = {}, {}
    hashed = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    for k, t in sorted(order, key=lambda x: (x[0], hashed[x[1]])):
        covered = set()
        for a, b, h in substring.runs(t):
            if h in seen:
                covered.update(range(a, b))
            seen.setdefault(h, 1)
        want[k, t] = len(covered)
    got = defaultdict(list)
    for r in out.withColumn("was", F.col("n_removed")).collect():
        got[r["doc_id"]].append(r["n_removed"])
    for (k, t), n in want.items():
        assert n in got[None if k[0] else k[1]]
    assert sum(want.values()) > 0


def test_substring_covers_a_repeated_passage(spark):
    rng = random.Random(5)
    plain = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) + "."
    passages = [[plain(n) for n in sizes] for sizes in ([27, 12, 12, 11, 11, 4], [60], [5, 5, 5, 5], [30, 3, 3], [3, 3, 30], [25, 25], [1] * 30, [19, 1], [19], [8, 8])]
    rows, want = [], {}
    for k, p in enumerate(passages):
        for copy in (0, 1):
            around = [plain(9), plain(14)], [plain(4), plain(13)]
            rows.append((2 * k + copy, " ".join([*around[0], *p, *around[1]])))
        whole = sum(len(s.split()) for s in p) >= 20 and (len(p) > 1 or len(p[0].split()) >= 20)
        want[2 * k], want[2 * k + 1] = 0, len(p) if whole else 0
        if whole:  # nothing but the passage goes
            rest = " ".join([*around[0], *around[1]])
            want[2 * k + 1, "text"] = rest
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {k: n for k, n in want.items() if isinstance(k, int)}
    for r in out:
        assert r["text"] == want.get((r["doc_id"], "text"), r["text"])


def test_packing_covers_every_id(docs):
    rows, df = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(df, path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r[0] for r in rows} == set(by_doc)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in by_doc[1]) == by_doc[1][0]["doc_tokens"] == 1


def test_token_shards_round_trip(docs):
    rows, df = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    got = simple8b.read_token_shards(simple8b.write_token_shards(df, path)).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [key(r["doc_id"]) for r in got if r["doc_id"] is not None] == sorted(key(r["doc_id"]) for r in got if r["doc_id"] is not None)
    at = 0
    for r in got:
        assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    from lacuna.llm.tokens import encoder

    want = sorted(np.append(encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4").tobytes() for _, t in pairs_of(rows))
    assert sorted(bytes(r["ids"]) for r in got) == want


def test_licenses(docs):
    rows, df = docs
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    hit = [r for r in got.values() if r["license"]]
    assert [(r["license"], r["coverage"]) for r in hit] == [("MIT", 1.0)]
    text = dict(pairs_of(rows))[hit[0]["doc_id"]]
    assert text[hit[0]["findings"][0]["first"] : hit[0]["findings"][0]["last"]] == "Released under the MIT License"


def test_classifier_separates_and_scores_every_row(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["tree", "river", "stone", "walks", "slowly", "under"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["#$%", "BUY!!", "***", "WIN!!"]) for _ in range(40))
    rows = [(k, good() if k % 2 else bad()) for k in range(240)] + [(None, None), (500, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(240)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = classifier.score(df, classifier.fit(df, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 240 and r["held_out"]]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    empty = classifier.score(df, classifier.fit(df, labels.limit(0)))
    assert {r["score"] for r in empty.collect()} == {0.5}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for out in (quality_rules.judged(none), quality_rules.keep_good(none), jaccard.similar_components(none), jaccard.keep_one(none), decontam.decontaminate(none, bench), pii.redact(none), substring.remove_repeats(none), packing.pack_documents(none, path), simple8b.read_token_shards(simple8b.write_token_shards(none, path)), licenses.scan_licenses(none)):
        assert out.count() == 0


def test_pipeline_against_plain_stages(spark, tmp_path, docs):
    rows, df = docs
    plain = df.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null and doc_id > 11")
    held = [(r["doc_id"], r["text"]) for r in plain.collect()]
    items = [(1, " ".join(brute.alnum(dict(held)[37])[:14]))]
    folder = str(tmp_path)
    plain.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    good = [(k, t) for k, t in dict(held).items() if brute.kept_by_rules(t, quality_rules.DUP_LINE_PERCENT)]
    kept = [(k, t) for (k, t), (s, c) in zip(good, brute.components(good, 80, 5), strict=True) if s == 0 or c == k]
    clean = {k: t for k, t in kept if brute.benchmark_hits(t, items)[1] == 0}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == set(clean) and 37 not in clean
    pieces = defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    from lacuna.llm.tokens import encoder

    tokenizer = encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    for k, text in clean.items():
        said = tokenizer.decode(np.frombuffer(b"".join(b for _, b in sorted(pieces[k])), "<u4")[:-1].tolist())
        assert not brute.base_spans(said) and (said == text or brute.base_spans(text))


def test_queries_have_the_columns_of_their_contracts(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts()[:20])], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "u", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    want = {"op11": "lang rank phrase a l r n score", "op12": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op13": "page_id payload_bytes payload_digest record_type refers_to", "packed": "conv_id start length sequence_id offset", "op2": "page_id url text n_chars", "op3": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op5": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7": "doc_id held_out score predicted", "op8": "doc_id n_words n_hit n_items items_sha256 contaminated", "op9": "doc_id start n_tokens ids_crc32", "op10": "doc_id n_shingles component_id"}
    for name, f in queries.QUERIES.items():
        columns = f(spark, folder).columns
        assert set(want.get(name.split("_")[0], "doc_id").split()) <= set(columns)
    assert hashlib.sha256(b"").hexdigest() == queries.op8_decontamination(spark, folder).first()["items_sha256"]
