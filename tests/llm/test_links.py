"""Links of the Jaccard join, all of them, against plain pairs."""

import random
from itertools import combinations

import pytest

from lacuna.llm import jaccard, queries
from tests.llm import brute


@pytest.mark.parametrize("block", [512, 7])
def test_links_within_components(spark, block):
    rng = random.Random(11)
    rows = [(None, "lonely text without an id that links with one other text of this table right here " * 3 + "a b c"), (None, "lonely text without an id that links with one other text of this table right here " * 3 + "a b d")]
    for _ in range(3):  # groups of many near copies: buckets of three classes or more
        base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(25):
            words = list(base)
            for at in rng.sample(range(90), rng.randint(0, 3)):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[5][1]), (len(rows), ""), (len(rows), None)]
    sets = [brute.shingle_set(t, 3) for _, t in rows]
    links = {s: 0 for s in sets}
    for a, b in combinations({s for s in sets if s}, 2):
        if 100 * len(a & b) >= 90 * len(a | b):
            links[a] += 1
            links[b] += 1
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Join(90, 3), block=block)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got.collect()), key=key) == sorted(((k, len(s), links[s]) for (k, _), s in zip(rows, sets, strict=True)), key=key)
    assert max(links.values()) > 5


def test_query_returns_links(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "n_links" in queries.op10_jaccard_join(spark, str(tmp_path)).columns


def edited(words, at):
    return " ".join("x" if k in at else w for k, w in enumerate(words))


def test_rows_without_an_id_link_others(spark):
    words = [f"w{k}" for k in range(120)]
    texts = [edited(words, [5]), edited(words, []), edited(words, [90])]  # neighbours link, the ends don't
    sets = [brute.shingle_set(t, 3) for t in texts]
    assert [100 * len(sets[i] & sets[j]) >= 95 * len(sets[i] | sets[j]) for i, j in ((0, 1), (1, 2), (0, 2))] == [True, True, False]
    for middle, least in ((None, 1), (3, 1)):
        df = spark.createDataFrame([(1, texts[0]), (middle, texts[1]), (2, texts[2])], "doc_id long, text string")
        got = jaccard.similar_components(df, jaccard.Join(95, 3)).collect()
        assert {r["component_id"] for r in got} == {least} and sorted(r["n_links"] for r in got) == [1, 1, 2]


def test_only_equal_sets_link_at_100_percent(spark):
    rows = [(4, "a b c d e"), (2, "A b C d e"), (3, "a b c d"), (None, "x y z"), (None, "x y z"), (9, None)]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Join(100, 2)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in got) == [("2", "2", 0), ("3", "3", 0), ("4", "2", 0), ("9", "9", 0), ("None", "None", 0), ("None", "None", 0)]


def test_keep_one_row_of_each_group(spark):
    rows = [(1, "a b c d e f", "z"), (1, "a b c d e f", "m"), (1, "other words here now then", "k"), (None, "a b c d e f", "a"), (None, "only null ids here today", "b"), (None, "only null ids here today", "a"), (7, "", "e"), (7, "", "e"), (None, None, "n")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _lacuna string"), jaccard.Join(90, 3))
    assert kept.columns == ["doc_id", "text", "_lacuna"]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[1], rows[2], rows[5], rows[6], rows[7], rows[8]]))


@pytest.mark.parametrize("narrow, block", [(16, 512), (2, 4), (0, 3)])
def test_wide_buckets(spark, monkeypatch, narrow, block):
    """A passage that many documents share makes wide buckets; the few near copies among them are found in any case."""
    monkeypatch.setattr(jaccard, "NARROW", narrow)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for k in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((len(rows), " ".join(shared + own)))
        if k % 5 == 0:
            rows.append((len(rows), " ".join([*shared, *own[:-1], "last"])))
    docs = [(k, t) for k, t in rows]
    want = sorted((k, s, c) for (k, _), (s, c) in zip(docs, brute.components(docs, 80, 3), strict=True))
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Join(80, 3))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


def test_sketches_fold():
    rng = random.Random(1)
    for n in (1, 100, 128, 129, 500, 5000):
        found = jaccard.np.array(sorted(rng.getrandbits(64) for _ in range(n)), jaccard.np.uint64)
        sketch = jaccard.parity_sketch(found).view(jaccard.np.uint64)
        assert 64 * len(sketch) >= 2 * n and len(sketch) & (len(sketch) - 1) == 0
        assert int(jaccard.np.bitwise_count(jaccard.np.bitwise_xor.reduce(sketch.reshape(-1, max(4, len(sketch) // 2)), axis=0)).sum()) <= n


def test_no_name_is_defined_twice():
    import ast
    from collections import Counter
    from pathlib import Path

    for path in Path(jaccard.__file__).parent.glob("*.py"):
        names = Counter(n.name for n in ast.parse(path.read_text()).body if hasattr(n, "name"))
        assert max(names.values(), default=1) == 1, (path, names.most_common(3))
