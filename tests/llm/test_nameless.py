"""Benchmark items without an id."""

from lacuna.llm import decontam


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five six"), (3, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five"), (None, None)], "item_id long, text string")
    for block in (decontam.BLOCK_WINDOWS, 2):
        found = decontam.find_benchmark(docs, bench, block_windows=block).select("doc_id", decontam.n_hit().alias("n"), "items").collect()
        assert sorted((r["doc_id"], r["n"], r["items"]) for r in found) == [(1, 3, []), (2, 2, ["7"]), (3, 0, [])]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [3]
