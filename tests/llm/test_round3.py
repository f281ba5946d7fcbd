"""Collocations, fill-in-the-middle and archives against versions that share no code with them."""

import gzip
import hashlib
import io
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import collocations, common, fill_in_middle, warc

FOLD = {c: c + 32 for c in range(65, 91)}


def plain_phrases(rows, least, top, percent=100, most=5):
    counts, words_of = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1))
    good = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in good.items():
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: E731, B023
        if any(x == lang and len(w) > len(words) and 100 * b >= percent * a and inside(w) for (x, w), b in good.items()):
            continue
        n = words_of[lang]
        score, k = min((1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], n, score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def phrase_rows(seed=4):
    rng = random.Random(seed)
    vocabulary = ["Le", "la", "été", "B", "b", "<x>", "z" * 90, " ", "日本", "-"]
    rows = []
    for k in range(140):
        said = []
        for _ in range(rng.choice([0, 1, 3, 40])):
            said.append(rng.choice(["of the new city", "New  York\tTimes", "a b", *vocabulary]))
            said.append(rng.choice([" ", " ", " ", ", ", "\n", ".", "\x0c"]))
        rows.append((rng.choice([None, "und", "en", "en", "en", ""]), "".join(said) if k % 20 else None))
    return rows


@pytest.mark.parametrize("least, top, percent, part, bits", [(8, 2000, 100, 4 << 20, 27), (3, 12, 80, 40, 20), (8, 2000, 100, 300, 7)])
def test_collocations(spark, monkeypatch, least, top, percent, part, bits):
    """Also with texts in many small parts, and with a bitmap that lets nearly everything pass."""
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "BITMAP_LOG", bits)
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, phrase int, count string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, collocations.Mining(least=least, top=top, cover_percent=percent)).collect())
    want = plain_phrases(rows, least, top, percent)
    assert got == want and len({r[0] for r in want}) >= 2 and any(len(r[2].split(" ")) > 3 for r in want)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    rows = [(None, None), ("en", ""), ("en", " \n.,"), ("de", "once only")]
    assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), collocations.Mining(least=2)).collect() == []


def test_collocation_scores_pass_64_bits():
    """floor(1000 * a * n / (l * r)) in Decimal, as `collocations` states it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a, n, left, right = 4_000_000_000_123, 900_000_000_000_007, 5_000_000_000_777, 4_100_000_000_099
    d = lambda x: F.lit(x).cast("decimal(19,0)")
    row = spark.range(1).select((d(a) * d(n) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)").alias("above"), (d(left) * d(right)).cast("decimal(38,0)").alias("below")).selectExpr("above div below AS s").first()
    assert row["s"] == 1000 * a * n // (left * right)


def plain_fim(key, text, seed=7, fim=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in marks) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def fim_texts():
    rng = random.Random(8)
    alphabet = ["a", "é", "日", "😀", "\n", "\n", "<", "P", "S", "M", ">", "<P", "\r", " ", "\x00", " "]
    texts = [None, "", "\n", "\n\n", "x", "x\n", "<P>", "a<S", ">", "<<P>", "<P<M>", "a\n<S\n>", "é" * 700, "日\n" * 900, "<" * 600 + "M>", "z" * 511 + "<P>", "y" * 510 + "<P>", "😀" * 128 + "<", "q\n" * 50_000]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 40, 511, 512, 513, 1600]))) for _ in range(220)]


@pytest.mark.parametrize("fim", [fill_in_middle.Fim(), fill_in_middle.Fim(seed=3, fim_percent=60, spm_percent=10, prefix="<|préfixe|>", suffix="<S>", middle="»")])
def test_fill_in_middle(spark, fim):
    rows = [(None if k == 30 else k // 2 if k < 10 else k, t, k) for k, t in enumerate(fim_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim_form int").repartition(3)
    out = fill_in_middle.fill_in_middle(docs, fim)
    assert out.columns == ["doc_id", "text", "fim_units", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    got = out.withColumn("again", fill_in_middle.restored(F.col("fim_text"), F.col("fim_form"), fim)).collect()
    assert all(r["again"] == (r["text"] or "") for r in got)
    want = Counter((k, t, *plain_fim(k, t, fim.seed, fim.fim_percent, fim.spm_percent, (fim.prefix, fim.suffix, fim.middle))) for k, t, _ in rows)
    assert Counter(tuple(r)[:7] for r in got) == want
    assert len({r["fim_form"] for r in got}) == 3
    assert fill_in_middle.fill_in_middle(docs.limit(0), fim).collect() == []


def test_automaton_counts_like_a_plain_reading():
    rng = random.Random(1)
    texts = [(t or "").encode() for t in fim_texts()] + [bytes(rng.choice(b"<PSM>\na\xc3\xa9") for _ in range(3000)).decode("utf-8", "ignore").encode()]
    _, start, end, units, sentinels, actions = fill_in_middle.scan(texts, (b"<P>", b"<S>", b"<M>"))
    for t, a, b, n, s in zip(texts, start, end, units, sentinels, strict=True):
        said = t.decode()
        assert n == len(re.findall(r"[^\n]*\n|[^\n]+", said)) and s == len(re.findall("<[PSM]>", said))
        assert np.count_nonzero(actions[a:b] & fill_in_middle.POINT) == len(said)


def test_sentinels_that_could_arise_at_a_seam_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "d"), ("", "x", "y"), ("a\n", "x", "y"), ("xay", "a", "b")):
        with pytest.raises(ValueError):
            fill_in_middle.Fim(prefix=bad[0], suffix=bad[1], middle=bad[2])


def plain_revisits(rows):
    firsts = {}
    for key, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100:
            firsts[payload] = min(firsts.get(payload, (True, 0)), (key is None, key or 0))
    left, out = dict(firsts), []
    for key, url, html in rows:
        payload = (html or "").encode()
        again = len(payload) >= 100 and left.get(payload) != (key is None, key or 0)
        if len(payload) >= 100 and not again:
            left[payload] = None  # of repeated rows one is the response
        first = firsts.get(payload)
        out.append((key, url, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", None if not again or first[0] else first[1]))
    return Counter(out)


def page_rows():
    rng = random.Random(5)
    bodies = ["", "x" * 99, "x" * 100, "é" * 50, "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 9, *("".join(rng.choice("ab<>\r\n é") for _ in range(rng.randint(90, 4000))) for _ in range(12))]
    rows = [(k, f"http://x.org/{k}?é \r\nX-Page-Id: 7" if k % 5 else None, rng.choice(bodies)) for k in range(120)]
    rows += [(500 + k, "http://hot", "the same page " * 40) for k in range(80)] + [rows[7], rows[7], rows[8]] + [(None, None, None), (None, "u", bodies[6]), (None, "u", "only nameless" * 20), (None, "u", "only nameless" * 20)]
    return rows


@pytest.mark.parametrize("share, size", [(1000, 256 << 20), (4, 9000)])
def test_archives(spark, monkeypatch, share, size):
    """Also with hot payloads joined apart from the others, and with many files."""
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, type int").repartition(5)
    raw = warc.write_archives(pages)
    assert warc.read_headers(raw).where("type <> 'response'").count() == 0
    archives = warc.deduplicate(raw)
    found = warc.read_headers(archives)
    said = lambda url: None if url is None else " ".join(url.splitlines())
    want = plain_revisits([(k, said(u), h) for k, u, h in rows])
    assert Counter((r["page_id"], r["uri"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in found.collect()) == want
    assert Counter((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in warc.read_pages(archives).collect()) == Counter((k, said(u), h or "") for k, u, h in rows)
    ids = [r["record_id"] for r in found.collect()]
    assert len(set(ids)) == len(ids) and archives.agg(F.sum("bytes")).first()[0] < raw.agg(F.sum("bytes")).first()[0]
    # revisits of an input keep their original
    again = warc.deduplicate(archives)
    columns = ("page_id", "uri", "payload_bytes", "payload_digest", "type", "refers_to")
    assert Counter(tuple(r) for r in warc.read_headers(again).select(*columns).collect()) == Counter(tuple(r) for r in found.select(*columns).collect())


def test_archives_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_headers(warc.deduplicate(warc.write_archives(none))).collect() == []


def test_archives_of_other_writers(spark, tmp_path):
    """One gzip member for all, no gzip at all, folded lines, bare line ends, foreign records, a resource without HTTP."""
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + b"p" * 200
    plain = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 4\r\n\r\nGET \r\n\r\n" + b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\n b\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n" + b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:uuid:2>\ncontent-length: 200\n\n" + b"p" * 200 + b"\r\n\r\n"
    for name, data in (("a.warc", plain), ("b.warc.gz", gzip.compress(plain))):
        (tmp_path / name).write_bytes(data)
        got = {r["record_id"]: r for r in warc.read_records(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string")).collect()}
        assert set(got) == {"<urn:uuid:1>", "<urn:uuid:2>"} and all(bytes(r["payload"]) == b"p" * 200 for r in got.values())
        assert got["<urn:uuid:1>"]["uri"] == "http://a b" and got["<urn:uuid:1>"]["payload_digest"] == hashlib.sha256(b"p" * 200).hexdigest()
    for bad in (plain[:-150], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad)))


def test_every_record_is_a_gzip_member(spark):
    manifest = warc.write_archives(spark.createDataFrame([(k, "u", "body" * 40) for k in range(3)], "page_id long, url string, html string").coalesce(1))
    store, name = warc._store(manifest.first()["path"])
    data = store.open_input_stream(name, compression=None).read()
    starts = [m.start() for m in re.finditer(re.escape(b"\x1f\x8b\x08"), data)]
    assert gzip.decompress(data[starts[-1] :]).startswith(b"WARC/1.1\r\nWARC-Type: response") and len(starts) == 4
    assert common.made() > 0
