"""Queries of the text operators: thin views on the operators with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, collocations, decontam, fill_in_middle, html_extract, jaccard, licenses, packing, pii, quality_rules, simple8b, substring, warc
from .common import table


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontam.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = simple8b.write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return simple8b.read_token_shards(manifest, with_ids=False)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), jaccard.Join(percent=90, shingle=3)).select("doc_id", "n_shingles", "component_id", "n_links")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("rule")  # its order, and so the name, is measured


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda p: p["base"])

    def of_kind(k: int) -> Column:
        return F.size(F.filter(base, lambda p: p["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_in_middle.restored(F.col("fim_text"), F.col("fim_form"))
    return made.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.deduplicate(warc.write_archives(table(spark, sf_dir, "pages")))
    return warc.read_headers(archives).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of instruction data, with loss on the answers."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_html_extraction, op3_quality_rules, op4_license_scan, op5_vector_packing, op6_pii, op7_quality_classifier, op8_decontamination, op9_simple8b, op10_jaccard_join, op11_phrase_collocations, op12_fill_in_middle, op13_warc, packed_conversations)}
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS h, lead(word, 4) OVER o AS e FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
p AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, h) AS c FROM g WHERE e IS NOT NULL) WHERE c > 1),
n AS (SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY 1),
l AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper FROM w LEFT JOIN n USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR n_symbols * 100 > n_words * 30 OR n_lines * DUP_PERCENT < n_dup_lines * 100 OR n_upper * 100 > word_chars * 40 OR word_chars < n_words * 2 OR word_chars > n_words * 25) AS kept FROM b""".replace("DUP_PERCENT", str(quality_rules.DUP_LINE_PERCENT)),
    "op8_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_FOLD.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(coalesce({_FOLD.format("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS gram FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
x AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
l AS (SELECT r, i, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next FROM x),
h AS (SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(next[1:n], ' ') AS gram FROM l, sizes WHERE len(next) >= n) JOIN bw USING (n, gram)),
q AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN q USING (r) LEFT JOIN t USING (r)""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_FOLD.format("text")}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT DISTINCT r, gram FROM g WHERE gram IS NOT NULL UNION ALL SELECT r, array_to_string(ws, ' ') FROM d WHERE len(ws) IN (1, 2)),
n AS (SELECT r, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS cls FROM s GROUP BY 1),
c AS (SELECT cls, min(r) AS r, any_value(n) AS n FROM n GROUP BY 1),
e AS (SELECT c.cls, c.n, s.gram FROM c JOIN s USING (r)),
pairs AS (SELECT a.cls AS a, b.cls AS b, count(*) AS common, any_value(a.n) AS an, any_value(b.n) AS bn FROM e AS a JOIN e AS b ON a.gram = b.gram AND a.cls < b.cls AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 90 * (an + bn - common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
owners AS (SELECT cls, min(doc_id) AS own FROM n JOIN d USING (r) GROUP BY 1),
comp AS (SELECT cls, least(min(o.own), any_value(l.own)) AS component_id FROM owners AS l LEFT JOIN (SELECT a, own FROM reach JOIN owners ON owners.cls = reach.b) AS o ON o.a = l.cls GROUP BY 1),
deg AS (SELECT a AS cls, count(*) AS n_links FROM sides GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN n USING (r) LEFT JOIN comp USING (cls) LEFT JOIN deg USING (cls)""",
    "op11_phrase_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
totals AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(ws) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, a, k, array_to_string(ws[1:k], ' ') AS lhs, array_to_string(ws[k + 1 :], ' ') AS rhs FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
s AS (SELECT c.lang, c.size, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score FROM c JOIN totals USING (lang) JOIN f AS x ON x.lang = c.lang AND x.phrase = c.lhs JOIN f AS y ON y.lang = c.lang AND y.phrase = c.rhs),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best AS b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.size > b.size AND 100 * f.a >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) WHERE rank <= 2000""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
e AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || h[25:32] AS BIGINT) % 100 AS z FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1 : least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1 :], '') AS suffix FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM f""",
    "op13_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, row_number() OVER w AS k, first(page_id) OVER w AS original FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN payload_bytes >= 100 AND k > 1 THEN original END AS refers_to FROM q""",
}
