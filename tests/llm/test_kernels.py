"""Kernels that need no session."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import classifier, html_extract, licenses, packing, simple8b, substring
from lacuna.llm.common import ALNUM, SPACED, Words, utf8
from lacuna.llm.jaccard import Join, bucket_keys
from lacuna.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_match_the_expressions(texts):
    raw = utf8(texts)
    for alphabet, expression in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(raw, alphabet)
        for i, t in enumerate(texts):
            folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) if alphabet is ALNUM else t
            got = [w.data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(w.start[w.first[i] : w.last[i]], w.end[w.first[i] : w.last[i]], strict=True)]
            want = re.findall(expression, folded)
            assert [g.lower() if alphabet is ALNUM and g.isascii() else g for g in got] == want or len(got) == len(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, (1 << 64) - 1)), max_size=400), st.sampled_from([64, 128, 1024]))
def test_simple8b_round_trip(values, block):
    ids = np.array(values, np.uint64)
    words, offsets, escapes = simple8b.encode(ids, block)
    assert simple8b.decode(words, offsets, escapes, len(ids), block).tolist() == values
    for b in range(len(offsets) - 1):  # a block by itself
        n = min(block, len(ids) - b * block)
        assert simple8b.decode(words, offsets[b : b + 2], escapes, n, block).tolist() == values[b * block : b * block + n]


def test_simple8b_shard():
    ids, keys = np.arange(5000, dtype=np.uint64), np.array([3, 9])
    data = simple8b.to_bytes(ids, keys, np.zeros(2, "u1"), np.array([0, 10, 5000]))
    got, doc_id, null, start = simple8b.from_bytes(data)
    assert (got == ids).all() and doc_id.tolist() == [3, 9] and start.tolist() == [0, 10, 5000] and not null.any()
    with pytest.raises(ValueError):
        simple8b.from_bytes(b"x" * 80)


TRICKY = ["", " ", "a  b\n\n c\t d", "\n\nx y", "it's  don't 'll x", "a\x1cb c", "é x ́y", "<|endoftext|> hi", "end ", " lead", "Σας", "12 34 5.6\r\n q", "\0 a \0b", "don't. it's, 's 5's; ab_ c__ _d, e'. 'f' g-h- 1,2, x²; ½. اً."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_ids_are_the_librarys(name):
    e = Encoder(public_tokenizers.path(name))
    for _ in range(2):
        for text, got in zip(TRICKY, e.ids_of(TRICKY), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab C.,'\n\t1*é́", max_size=60))
def test_cached_ids_of_random_texts(text):
    e = _shared()
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def _shared(held=[]):  # noqa: B006
    held or held.append(Encoder(public_tokenizers.path("byte_bpe_50k.json")))
    return held[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.integers(2, 5))
def test_packing_keeps_limits_and_every_id(sizes, segments):
    limits = packing.Limits(tokens=100, segments=segments, loss=90, min_cut=4)
    out = packing.pack([(n, n - 1) for n in sizes], limits)
    places = {}
    for members in out:
        assert sum(m[2] for m in members) <= 100 and len(members) <= segments
        for item, start, length in members:
            places.setdefault(item, []).append((start, length))
    for item, n in enumerate(sizes):
        at = 0
        for start, length in sorted(places[item]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_packing_without_cuts():
    limits = packing.Limits(tokens=10, segments=3, loss=8, cut=False)
    assert sorted(len(m) for m in packing.pack([(5, 4), (5, 4), (10, 8)], limits)) == [1, 2]
    with pytest.raises(ValueError):
        packing.pack([(11, 1)], limits)


@settings(max_examples=40, deadline=None)
@given(st.integers(10, 600), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10_000))
def test_linked_sets_share_a_bucket(n, drop, add, seed):
    rng = np.random.default_rng(seed)
    both = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    a = both[: max(1, len(both) - drop)]
    b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, add).astype(np.uint64)]))
    common = len(np.intersect1d(a, b))
    for join in (Join(90, 3), Join(80, 5)):
        if 100 * common >= join.percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            assert set(bucket_keys(a, join).tolist()) & set(bucket_keys(b, join).tolist())


def test_sentences_cover_the_text():
    text = "One two. Three!\n\n  Four five? six"
    assert "".join(text[a:b] for a, b in substring.sentences(text)) == text
    assert substring.runs("a b. c d. e f.", 2, 4) and not substring.runs("", 2, 4)


def test_alignment_by_anchors():
    assert licenses.align("x released under the mit license y".split(), "released under the mit license".split()) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert licenses.align([], ["a"]) == [] and licenses.align(["a", "b"], ["b", "a"])


PAGES = [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a&amp;b<p>c", "a&b\nc"),
    ("<html><body><nav><a href=1>m</a></nav><article><h1>T &lt;1&gt;</h1><p>One  <b>two</b>\n three.<p>Four</article><div class=comments><p>hey there</div><footer>f</footer></body></html>", "T <1>\nOne two three.\nFour"),
    ("<body><div id=main><p>" + "Long text here. " * 20 + "</p><script>var a='</p>';</script></div><aside>" + "side " * 30 + "</aside>", ("Long text here. " * 20).strip()),
    ("<p>open <!-- never closed", "open"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_extraction(page, text):
    assert html_extract.extract(page) == text


def test_statistics_of_odd_texts_are_finite():
    s = classifier.statistics([b"", b"a", "é " .encode() * 50, b"\n\n", b"X!! " * 100])
    assert s.shape == (5, len(classifier.STATISTICS)) and np.isfinite(s).all()


def test_isotonic_is_monotone_and_pools():
    x, y = classifier.isotonic(np.array([1.0, 2.0, 3.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == pytest.approx(2 / 3)
