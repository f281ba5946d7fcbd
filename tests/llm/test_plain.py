"""Operators against versions that share no code with them: substring dedup, licenses, packing, ids, ridge and isotonic fit."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import classifier, decontam, html_extract, licenses, packing, substring

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_sentences(text):
    parts, out = re.split(r"(\n|(?<=[.!?])[^\S\n]+)", text), []
    for body, gap in zip(parts[::2], [*parts[1::2], ""], strict=True):
        if (body + gap).strip():
            out.append(body + gap)
        elif out:
            out[-1] += body + gap
    return out


def plain_removed(docs):
    """Places of removed sentences of each document; docs: (doc_id, text) in order. All runs of any length are looked at."""
    places = defaultdict(list)
    for i, (_, text) in enumerate(docs):
        words = [s.split() for s in plain_sentences(text)]
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                run = tuple(w for s in words[a:b] for w in s)
                if len(run) >= 20:
                    places[run].append((i, a, b))
    gone = [set() for _ in docs]
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            gone[i].update(range(a, b))
    return gone


@pytest.mark.parametrize("hot", [5000, 2])
def test_substring_dedup_against_all_runs(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 9, 14, 25]))) + rng.choice([".", "!", "\n"]) for _ in range(14)]
    docs = [(k, " ".join(rng.choice(pool) if rng.random() < 0.7 else f"own{k} word{j}." for j in range(rng.randint(1, 9)))) for k in range(60)]
    docs += [(100, ""), (101, "short"), (102, docs[3][1])]
    got = {r["doc_id"]: r for r in substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (k, text), gone in zip(docs, plain_removed(docs), strict=True):
        parts = plain_sentences(text)
        lead = text[: len(text) - len("".join(parts))]
        assert (got[k]["n_sentences"], got[k]["n_removed"]) == (len(parts), len(gone)), (k, text)
        assert got[k]["text"] == lead + "".join(p for i, p in enumerate(parts) if i not in gone)
    assert sum(r["n_removed"] for r in got.values()) > 20


def test_every_notice_is_found(spark):
    rng = random.Random(2)
    by_name = dict(licenses.TEMPLATES)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
    cases = [[("CC-BY-4.0", "Licensed under CC BY 4.0.")] * 3, [("proprietary", by_name["proprietary"])] * 3, [("MIT", mit), ("MIT", mit)], [("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")], [("Apache-2.0", apache), ("MIT", mit), ("Apache-2.0", apache)]]
    rows, want = [], []
    for k, case in enumerate(cases):
        for between in (" ", " foo bar ", "\nÉtait la " * 30):
            for edits in (0, 1):
                text, spans = "é ", []
                for name, notice in case:
                    words = re.findall(r"\S+", notice)
                    if edits and len(words) > 60:
                        for at in rng.sample(range(5, len(words) - 5), 6):
                            words[at] = rng.choice(["zzz", words[at] + " yyy"])
                    said = " ".join(words)
                    spans.append((name, len(text), len(text) + len(said.rstrip("."))))
                    text += said + between
                rows.append((len(rows), text + "the of and"))
                want.append(spans)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, spans in enumerate(want):
        found = [(f["license"], f["first"], f["last"]) for f in got[k]["findings"]]
        assert [f[0] for f in found] == [s[0] for s in spans], rows[k]
        slack = 30 if k % 2 else 0  # of an edited notice a word at an end may be left out
        assert all(abs(f[1] - s[1]) <= slack and abs(f[2] - s[2]) <= slack for f, s in zip(found, spans, strict=True)), (found, spans)
        assert got[k]["n_licenses"] == len(spans) and all(f["coverage"] >= 0.8 for f in got[k]["findings"])


def test_packed_ids_are_the_tokenizers(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choice("abcdé ,.\nÄß中1'") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 3, 40, 3000])))) for k in range(60)] + [(None, "null id"), (200, None), (201, "<|endoftext|> x")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    from lacuna.llm.tokens import encoder

    tokenizer = encoder(path).tokenizer
    want = {k: np.append(tokenizer.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4") for k, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect():
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        sequences[r["sequence_id"]] += r["length"]
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
    assert {k: b"".join(b for _, b in sorted(p)) for k, p in pieces.items()} == {k: w.tobytes() for k, w in want.items()}
    assert max(sequences.values()) <= 2048 and sum(sequences.values()) >= 0.97 * 2048 * (len(sequences) - 3)


def test_each_limit_binds_for_instruction_data(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["tree", "river", "stone"]) for _ in range(n))
    rows = [(c, t, "assistant" if t % 2 else "user", say(rng.choice([1, 1, 2, 300] if t % 2 == 0 else [3, 200, 500]))) for c in range(120) for t in range(4)] + [(500, t, "user" if t % 2 == 0 else "assistant", say(3)) for t in range(200)] + [(1000 + c, t, "user" if t == 0 else "assistant", "a b") for c in range(900) for t in (0, 1)] + [(600, 0, "user", say(5000)), (None, None, None, None)]
    path, limits = public_tokenizers.path("byte_bpe_50k.json"), packing.INSTRUCTION
    from lacuna.llm.tokens import encoder

    tokenizer = encoder(path).tokenizer
    want = defaultdict(int)
    for c, _, _, text in rows:
        want[c] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    used, got = defaultdict(lambda: [0, 0]), defaultdict(int)
    for r in packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path).collect():
        used[r["sequence_id"]][0] += r["length"]
        used[r["sequence_id"]][1] += 1
        got[r["conv_id"]] += r["length"]
    assert got == want and all(t <= limits.tokens and s <= limits.segments for t, s in used.values())
    assert any(s == limits.segments and t < 0.9 * limits.tokens for t, s in used.values())
    demands = [(rng.randint(20, 400), rng.randint(5, 20)) for _ in range(300)] + [(n, n - 2) for n in (rng.randint(50, 900) for _ in range(200))]
    tight, loose = packing.pack(demands, limits), packing.pack(demands, packing.Limits(segments=10**6, loss=10**6))
    loss = lambda members: sum(max(0, demands[i][1] - (demands[i][0] - start - length)) - max(0, demands[i][1] - (demands[i][0] - start)) for i, start, length in members)
    assert sorted(tight) != sorted(loose) and sum(n for s in tight for _, _, n in s) == sum(d[0] for d in demands) and all(abs(loss(s)) <= limits.loss for s in tight)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = np.sort(rng.normal(size=12)).round(1), rng.integers(0, 2, 12).astype(float)
        knots = classifier.isotonic(x, y)
        fitted = np.interp(x, *knots)
        keys = np.unique(x)
        mean = np.array([y[x == k].mean() for k in keys])
        weight = np.array([(x == k).sum() for k in keys], float)
        cum = lambda a, b: (mean[a:b] * weight[a:b]).sum() / weight[a:b].sum()
        plain = np.array([max(min(cum(a, b) for b in range(k + 1, len(keys) + 1)) for a in range(k + 1)) for k in range(len(keys))])
        assert np.allclose(fitted, plain[np.searchsorted(keys, x)])


def test_ridge_equals_a_plain_solve(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["tree", "river", "#$%", "BUY!!"][: 2 + 2 * (k % 2)]) for _ in range(rng.randint(5, 60)))) for k in range(160)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = classifier.fit(df.repartition(5), labels)
    use = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 4 < 2]
    x = model.fourier(classifier.statistics([t.encode() for _, t in use]))
    y = np.array([k % 2 for k, _ in use], float)
    penalty = np.eye(x.shape[1]) * classifier.Settings().ridge
    penalty[-1, -1] = 1e-9
    assert np.allclose(x @ np.linalg.solve(x.T @ x + penalty, x.T @ y), x @ model.beta, atol=1e-4)


def test_kernel_is_approximated():
    settings = classifier.Settings()
    rng = np.random.default_rng(0)
    weights, phase = rng.normal(0, np.sqrt(2 * settings.gamma), (len(classifier.STATISTICS), 4096)), rng.uniform(0, 2 * np.pi, 4096)
    size = len(classifier.STATISTICS)
    model = classifier.Model(np.zeros(size), np.ones(size), weights, phase, None, (np.zeros(1), np.zeros(1)))
    x = rng.normal(size=(6, size)) / 3
    z = model.fourier(x)[:, :-1]
    exact = np.exp(-settings.gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.1


BODY = "<p>" + "</p><p>".join(" ".join(["A plain sentence of the main text that goes on for a while."] * 4) for _ in range(5)) + "</p>"
TEXT = "\n".join([" ".join(["A plain sentence of the main text that goes on for a while."] * 4)] * 5)


@pytest.mark.parametrize("page", [
    f"<body><nav><a href=x>one</a><a href=y>two</a></nav><div class=x>{BODY}</div><footer>foot</footer>",
    f"<body><div><ul><li><a href=x>Home page</a><li><a href=y>About us</a></ul></div><div id=c>{BODY}</div><div><a href=z>Next article here</a> <a href=w>Last article</a></div>",
    f"<main><article>{BODY}</article><aside>More here</aside></main><div class='comments'><p>A reader said something.</p></div>",
    f"<article class='comments menu'>{BODY}<form><p>Your name</p></form></article>",
    f"<section class='related-work'>{BODY}</section><div class='ad'>Buy this now, it is cheap.</div>",
    f"<body><!-- <article>no</article> --><script>if (a<b) x('</p>')</script><div>{BODY}",
    f"<div><div><div><div>{BODY}</div></div></div></div><div role=alert>We use cookies here.</div>",
])
def test_main_text_of_pages(page):
    assert html_extract.extract(page) == TEXT


def test_pages_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "x", "<p>a &amp; b"), (4, "y", "<b>" * 3000 + "deep" + "</i>" * 3000), (4, "y", "<div>" * 5000 + "x")]
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.extract_pages(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "u", "", 0), (2, None, "", 0), (None, "x", "a & b", 5), (4, "y", "deep", 4), (4, "y", "x", 1)]))
    assert html_extract.extract_pages(df.limit(0)).count() == 0
    empty = classifier.score(spark.createDataFrame([], "doc_id long, text string"), classifier.Model(np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), None, (np.zeros(1), np.zeros(1))))
    assert empty.count() == 0


def test_decontamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four", 5, "mine"), (2, "five six", 6, "mine")], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    assert kept.schema == docs.schema and [tuple(r) for r in kept.collect()] == [(2, "five six", 6, "mine")]
    cut = decontam.decontaminate(docs, bench, "spans")
    assert cut.schema == docs.schema and {r["doc_id"]: r["n_words"] for r in cut.collect()} == {1: 5, 2: 6}
    assert [r["n_words"] for r in decontam.find_benchmark(docs, bench).orderBy("doc_id").collect()] == [4, 2]
    assert [r["c"] for r in docs.select(F.count("*").alias("c")).collect()] == [2]


def test_what_stands_inside_an_article_but_is_not_of_it():
    long = "Long text about the river and the stones in it, which nobody has counted, since they move every spring. " * 5
    names = {"newsletter-signup": False, "comments-list": False, "userComments": False, "promo_box": False, "related-posts": False, "share-buttons": False, "ad-slot": False, "adSlot": False, "cookie_notice": False, "social-science": True, "market-share": True, "related-work": True, "advance-notes": True, "lead": True}
    for name, stays in names.items():
        for page in ('<body><article><h1>T</h1><p>{0}</p><div class="{1}"><p>Extra words here</p></div><p>{0}</p></article></body>', '<body><div class="post"><p>{0}</p><div id="{1}"><p>Extra words here</p></div><p>{0}</p></div></body>'):
            text = html_extract.extract(page.format(long, name))
            assert ("Extra words" in text) == stays and text.count("Long text") == 10, name
