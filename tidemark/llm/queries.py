"""The training-data queries, by name, with production parameters; every one runs over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_codec, decontaminate, filter_audit, fingerprints, html_text, language, licenses, minhash, suffix_dedup, token_alignment, token_counts, token_store, warc
from tidemark.llm._common import shared_folder, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn_dictionaries(docs.filter(~language.held_out()))
    return language.classify(docs, model).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), size=4, percent=80)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove under all 120 orders, a row for each source, order and step; see audit_filters for odd rows."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between a byte-level and a piece tokenizer, a row for each document; see align_tokenizers for odd rows."""
    return token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to seekable files in ascending doc_id order and read back, a row for each document; see round_trip
    for odd rows."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_html_text, op3_suffix_dedup, op4_fingerprints, op5_language_id, op6_license_scan, op7_warc, op8_minhash, op9_token_counts, op10_bpe_codec, op11_filter_audit, op12_token_alignment, op13_token_store)}

#: DuckDB SQL for the queries that SQL expresses.
ORACLES: dict[str, str] = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(least < doc_id, false)} AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, concat(CASE WHEN fails.A THEN 'A' ELSE '' END, CASE WHEN fails.B THEN 'B' ELSE '' END, CASE WHEN fails.C THEN 'C' ELSE '' END,
    CASE WHEN fails.D THEN 'D' ELSE '' END, CASE WHEN fails.E THEN 'E' ELSE '' END) AS fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS o FROM c v, c w, c x, c y, c z WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
s AS (SELECT part, o, step, substr(o, step, 1) AS c, n, good, toxic, contains(fails, substr(o, step, 1)) AS failing, fails = substr(o, step, 1) AS alone,
    len(list_filter(range(1, step), lambda i: contains(fails, substr(o, i, 1)))) = 0 AS reached FROM g, o, range(1, 6) AS r(step)),
a AS (SELECT part, o, step, c, coalesce(sum(n) FILTER (reached AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (reached AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND NOT reached), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (reached AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (reached AND failing), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, o AS filter_order, step::INTEGER AS step, c AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM a
""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(b[p + 1:p + 100]) AS m FROM d, unnest(range(0, n - 99)) AS u(p)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, run, min(p) AS start, max(p) + 100 AS stop FROM i GROUP BY ALL),
k AS (SELECT doc_id, run, start, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM s),
j AS (SELECT doc_id, sum(stop - start) AS removed, count(*) AS spans, max(stop) AS last, list({'a': before, 'z': start} ORDER BY run) AS keep FROM k GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(array_to_string([hex(b[x.a + 1:x.z]) FOR x IN list_append(coalesce(keep, []), {'a': coalesce(last, 0), 'z': n})], ''))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
""",
    "op7_warc": """
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN m END AS refers_to
FROM (SELECT *, strlen(html) >= 1000 AND m IS NOT NULL AND page_id IS DISTINCT FROM m AS again
  FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS m FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))
""",
    "op8_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, min(r.c) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
""",
}
