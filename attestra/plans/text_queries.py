"""Queries of the row-level text rules and of intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import hashing, text
from attestra.operators import intervals as iv
from attestra.plans import fixtures as fx
from attestra.plans.book import query


@query("p1_prepare_query", r"""
SELECT item_id, CASE WHEN plain <> '' AND length(text) <= 4000 THEN plain END AS search_text FROM (SELECT item_id, text, trim(regexp_replace(nfc_normalize(text), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ') AS plain FROM benchmark)""")
def prepare_query(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", text.prepare_query(F.col("text")).alias("search_text"))


@query("p10_subject_normalise", r"""
SELECT block_id, trim(regexp_replace(translate(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ςё', 'σе'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13) || '.,;:()[]{}') AS subject FROM blocks""")
def subject_normalise(spark, sf):
    return fx.blocks(spark, sf).select("block_id", text.subject(F.col("text")).alias("subject"))


@query("p6_damaged_text", r"SELECT block_id, regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]') AS damaged FROM blocks")
def damaged_text(spark, sf):
    return fx.blocks(spark, sf).select("block_id", text.damaged(F.col("text")).alias("damaged"))


@query("p7_clip_boxes", """
SELECT block_id, CASE WHEN least(x1, 420) > x0 AND least(y1, 125) > y0 THEN x0 END AS cx0, CASE WHEN least(x1, 420) > x0 AND least(y1, 125) > y0 THEN y0 END AS cy0,
  CASE WHEN least(x1, 420) > x0 AND least(y1, 125) > y0 THEN least(x1, 420) END AS cx1, CASE WHEN least(x1, 420) > x0 AND least(y1, 125) > y0 THEN least(y1, 125) END AS cy1 FROM blocks""")
def clip_boxes(spark, sf):
    from attestra.operators.layout import clip_box

    return clip_box(fx.blocks(spark, sf), 0.0, 0.0, 420.0, 125.0).select("block_id", "cx0", "cy0", "cx1", "cy1")


@query("p8_unverified_ocr", "SELECT block_id, regexp_matches(text, '[0-9+\\x{2212}\\x{b1}\\x{b3}\\x{b2}=%<>]') AS critical FROM page_blocks")
def unverified_ocr(spark, sf):
    return fx.page_blocks(spark, sf).select("block_id", text.critical_ocr(F.col("text")).alias("critical"))


@query("p9_numeric_literals", """
SELECT pack_id, claim_id, list_transform(list_distinct_ordered, lambda x: regexp_replace(x, '^[+]', '')) AS numbers FROM (
  SELECT pack_id, claim_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (
    SELECT pack_id, claim_id, regexp_extract_all(text, '[+-]?\\d+(?:[,.]\\d+)?') AS l FROM claims))""")
def numeric_literals(spark, sf):
    return fx.claims(spark, sf).select("pack_id", "claim_id", text.numeric_literals(F.col("text")).alias("numbers"))


@query("p11_word_prefix", """
SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
WHERE (a.p_name <> b.p_name AND starts_with(b.p_name, a.p_name) AND NOT regexp_matches(substr(b.p_name, length(a.p_name) + 1, 1), '[\\pL\\pN_]'))
   OR (a.p_name <> b.p_name AND starts_with(a.p_name, b.p_name) AND NOT regexp_matches(substr(a.p_name, length(b.p_name) + 1, 1), '[\\pL\\pN_]'))""")
def word_prefix(spark, sf):
    a = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("a_key"), F.col("p_name").alias("a"))
    b = a.select((F.col("a_key") - 1).alias("a_key"), F.col("a_key").alias("b_key"), F.col("a").alias("b"))
    return a.join(b, "a_key").where(text.word_prefix(F.col("a"), F.col("b"))).select("a_key", "b_key")


@query("p12_textual_subject", """
SELECT table_id, row, col, regexp_matches(trim(text), '\\pL') AND NOT regexp_matches(trim(text), '^\\d') AND NOT (starts_with(lower(trim(text)), 'не более') OR starts_with(lower(trim(text)), 'не менее')
  OR starts_with(lower(trim(text)), 'до ') OR starts_with(lower(trim(text)), 'от ') OR starts_with(lower(trim(text)), 'свыше ')) AS textual, regexp_matches(text, '\\d') AS numeric_value FROM cells""")
def textual_subject(spark, sf):
    return fx.cells(spark, sf).select("table_id", "row", "col", text.textual_subject(F.col("text")).alias("textual"), text.numeric_value(F.col("text")).alias("numeric_value"))


@query("p13_safe_projection", """
SELECT event_id, CASE WHEN regexp_matches(CAST(json_extract_string(props, '$.page') AS VARCHAR), '^[0-9]{1,6}$') THEN json_extract_string(props, '$.page') END AS page,
  CASE WHEN value BETWEEN 0 AND 1000000 THEN value END AS value FROM events""")
def safe_projection(spark, sf):
    from attestra.operators.records import safe_projection as project

    rows = fx.table(spark, sf, "events").select("event_id", "props", "value")
    return project(rows, "event_id", {"page": (F.get_json_object("props", "$.page"), lambda c: c.rlike("^[0-9]{1,6}$")), "value": (F.col("value"), lambda c: c.between(0, 1_000_000))})


@query("p14_credential_scan", "SELECT event_id, contains(props, 'ref') OR contains(props, '\"7') AS leaks FROM events")
def credential_scan(spark, sf):
    from attestra.operators.records import credential_scan as scan

    return scan(fx.table(spark, sf, "events").select("event_id", "props"), "props", ["ref", '"7']).select("event_id", "leaks")


@query("p15_public_evidence_guard", "SELECT pack_id, evidence_id FROM units WHERE pack_id % 3 = 0 AND strlen(excerpt) <= 6 AND starts_with(evidence_id, row || '-')")
def public_evidence_guard(spark, sf):
    from attestra.operators.records import public_evidence_guard as guard

    rows = fx.units(spark, sf)
    return guard(rows, (F.col("pack_id") % 3 == 0) & F.col("evidence_id").startswith(F.concat(F.col("row").cast("string"), F.lit("-"))), "excerpt", 6).select("pack_id", "evidence_id")


@query("p17_embedding_text_guard", "SELECT chunk_id, len(words) AS tokens, len(words) <= 35 AND NOT starts_with(words[1], 'query:') AS fits FROM chunks")
def embedding_text_guard(spark, sf):
    from attestra.operators.records import embedding_text_guard as guard

    return guard(fx.chunks(spark, sf), F.array_join("words", " "), F.size("words"), 35, ("query:", "passage:")).select("chunk_id", F.size("words").alias("tokens"), "fits")


@query("p3_valid_spans", "SELECT block_id, part, start >= 0 AND \"end\" >= start AND page >= 1 AND \"end\" - start <= 60 AS valid FROM spans")
def valid_spans(spark, sf):
    from attestra.operators.records import valid_spans as valid

    span = F.struct(F.col("page").cast("int").alias("pdf_page"), "block_id", F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), F.array(F.lit(0.0), F.lit(0.0), F.col("end").cast("double") - F.col("start"), F.lit(1.0)).alias("bbox"))
    rows = fx.spans(spark, sf).withColumn("s", F.array(span))
    return rows.select("block_id", "part", (valid(F.col("s")) & (F.col("end") - F.col("start") <= 60)).alias("valid"))


@query("p4_valid_source_metadata", """
SELECT o_orderkey, o_orderkey % 3 <> 0 AND (o_orderkey % 5 <> 0) AND (o_orderkey % 2 = 0 OR o_orderkey % 7 <> 0) AS valid FROM orders""")
def valid_source_metadata(spark, sf):
    from attestra.operators.records import valid_source_metadata as valid

    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    meta = F.to_json(F.struct(
        F.concat(F.lit("Order "), k).alias("title"), F.when(k % 3 == 0, "draft").otherwise("law").alias("document_type"), F.when(k % 5 == 0, F.lit("2024-13-01")).otherwise(day).alias("effective_from"),
        F.when(k % 2 != 0, F.when(k % 7 == 0, F.lit("1900-01-01")).otherwise(F.lit("2999-01-01"))).alias("effective_to"),
    ))
    return fx.table(spark, sf, "orders").select("o_orderkey", valid(meta, ("law", "standard")).alias("valid"))


@query("p18_model_call_metadata", "SELECT event_id, json_extract_string(props, '$.page') AS page, CAST(strlen(props) AS BIGINT) AS bytes, sha256(props) AS hash FROM events")
def model_call_metadata(spark, sf):
    from attestra.operators.records import call_metadata

    return call_metadata(fx.table(spark, sf, "events"), "event_id", "props", ["page"])


@query("p19_closed_json", "SELECT event_id, len(json_keys(props)) = 1 AND list_contains(json_keys(props), 'page') AS closed FROM events")
def closed_json(spark, sf):
    from attestra.operators.records import closed_json as closed

    return fx.table(spark, sf, "events").select("event_id", closed(F.col("props"), {"page": None}).alias("closed"))


@query("p5_spans_within_pages", "SELECT block_id, part FROM spans WHERE page > 3 OR page < 1")
def spans_within_pages(spark, sf):
    from attestra.operators.records import spans_outside_pages

    return spans_outside_pages(fx.spans(spark, sf), F.lit(1), F.lit(3)).select("block_id", "part")


@query("w1_range_overlap", """
SELECT block_id, part, coalesce(start < lag("end") OVER (PARTITION BY block_id ORDER BY start, "end", part), false) AS overlaps FROM spans""")
def range_overlap(spark, sf):
    return iv.range_overlap(fx.spans(spark, sf), ["block_id"], ["part"]).select("block_id", "part", "overlaps")


@query("w2_map_contiguity", """
SELECT block_id, NOT bool_or(start <> before) AND max("end") = max(n) AS contiguous, count(*) FILTER (WHERE start <> before) AS breaks FROM (
  SELECT *, lag("end", 1, 0) OVER (PARTITION BY block_id ORDER BY start, "end") AS before FROM spans) GROUP BY block_id""")
def map_contiguity(spark, sf):
    return iv.map_contiguity(fx.spans(spark, sf), ["block_id"], "n")


@query("w3_merge_intervals", """
SELECT block_id, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY block_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY block_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans))
GROUP BY block_id, island""")
def merge_intervals(spark, sf):
    return iv.merge_intervals(fx.spans(spark, sf), ["block_id"])


@query("w4_coverage", """
SELECT block_id, n - n AS unowned, CASE WHEN doc_id % 2 = 0 THEN n - (n // 2 - n // 3) ELSE n END AS owned_once, CASE WHEN doc_id % 2 = 0 THEN n // 2 - n // 3 ELSE 0 END AS owned_twice FROM spans WHERE part = 1""")
def coverage(spark, sf):
    return iv.coverage(fx.spans(spark, sf), ["block_id"], "n")


@query("w6_page_ranges", """
SELECT doc_id, min(line) AS first, max(line) AS last FROM (
  SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM blocks WHERE line % 4 <> 0) GROUP BY doc_id, run""")
def page_ranges(spark, sf):
    return iv.runs(fx.blocks(spark, sf).where("line % 4 <> 0"), ["doc_id"], "line")


@query("j3_span_overlap", """
SELECT a.block_id, a.start, a."end", b.start AS start_b, b."end" AS end_b FROM spans a JOIN spans b ON a.block_id = b.block_id AND a.part = 1 AND b.part = 2 WHERE a.start < b."end" AND b.start < a."end" """)
def span_overlap(spark, sf):
    s = fx.spans(spark, sf)
    a = s.where("part = 1").select("block_id", "start", "end")
    b = s.where("part = 2").select("block_id", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    return iv.overlap_join(a, b, ["block_id"], 64)


@query("j4_span_containment", """
SELECT a.block_id, a.part, a.start, a."end" FROM spans a WHERE a.part = 2 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.block_id = a.block_id AND b.part = 1 AND b.start <= a.start AND b."end" >= a."end")""")
def span_containment(spark, sf):
    s = fx.spans(spark, sf)
    owned = s.where("part = 1").select("block_id", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    return iv.not_contained(s.where("part = 2").select("block_id", "part", "start", "end"), owned, ["block_id"])


@query("d2_unowned_fragments", """
SELECT block_id, CAST(0 AS BIGINT) AS start, start AS "end" FROM spans WHERE part = 2 AND start > 0""")
def unowned_fragments(spark, sf):
    return iv.complement(fx.spans(spark, sf).where("part = 2"), ["block_id"], "n")


@query("e4_slice_owner", """
SELECT a.block_id, a.start, a."end", greatest(a.start, b.start) AS piece_start, least(a."end", b."end") AS piece_end,
  b.part = 2 AND (greatest(a.start, b.start) > b.start OR least(a."end", b."end") < b."end") AS cut,
  CASE WHEN NOT (b.part = 2 AND (greatest(a.start, b.start) > b.start OR least(a."end", b."end") < b."end")) THEN b.start * 2 + greatest(a.start, b.start) - b.start END AS source_from,
  CASE WHEN NOT (b.part = 2 AND (greatest(a.start, b.start) > b.start OR least(a."end", b."end") < b."end")) THEN b.start * 2 + least(a."end", b."end") - b.start END AS source_to
FROM (SELECT block_id, n // 4 AS start, n AS "end" FROM spans WHERE part = 1 AND n // 4 < n) a JOIN spans b ON a.block_id = b.block_id AND a.start < b."end" AND b.start < a."end" """)
def slice_owner(spark, sf):
    s = fx.spans(spark, sf)
    ranges = s.where("part = 1").select("block_id", F.floor(F.col("n") / 4).alias("start"), F.col("n").alias("end")).where("start < end")
    segments = s.select("block_id", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), (F.col("start") * 2).alias("source_start"), F.when(F.col("part") == 2, "normalized_group").otherwise("exact").alias("mapping"))
    return iv.slice_owner(ranges, segments, ["block_id"])


@query("e6_merge_selected", """
SELECT block_id, min(start) AS start, max("end") AS "end", min_by(part, start * 10 + part) AS relation FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY block_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY block_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans))
GROUP BY block_id, island""")
def merge_selected(spark, sf):
    return iv.merge_intervals(fx.spans(spark, sf), ["block_id"], "start", "end", F.min_by("part", F.struct("start", "part")).alias("relation"))


@query("e8_ownership_conflicts", """
SELECT block_id, start FROM (SELECT block_id, part, start, coalesce(start < lag("end") OVER (PARTITION BY block_id ORDER BY start, "end", part), false) AS o FROM spans) WHERE o""")
def ownership_conflicts(spark, sf):
    return iv.range_overlap(fx.spans(spark, sf), ["block_id"], ["part"]).where("overlaps").select("block_id", "start")


@query("a9_fingerprint", """
SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}') AS hash FROM documents""")
def fingerprint(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", hashing.sha256(hashing.canonical_json(("source", F.col("source")), ("lang", F.col("lang")), ("n", F.col("n_chars")))).alias("hash"))


@query("d21_chunk_identity", """
WITH h AS (SELECT chunk_id, sha256(concat_ws('|', doc_id, ordinal, array_to_string(words, ' '))) AS content_hash FROM chunks),
d AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(content_hash)) AS s FROM h)
SELECT chunk_id, content_hash, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || translate(s[17], '0123456789abcdef', '89ab89ab89ab89ab') || s[18:20] || '-' || s[21:32] AS uuid FROM d""")
def chunk_identity(spark, sf):
    key = F.concat_ws("|", "doc_id", "ordinal", F.array_join("words", " "))
    return fx.chunks(spark, sf).select("chunk_id", hashing.sha256(key).alias("content_hash"), hashing.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", hashing.sha256(key)).alias("uuid"))


@query("d26_content_hash_check", "SELECT doc_id, sha256(text) AS content_hash, doc_id % 10 <> 0 AS matches FROM documents")
def content_hash_check(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", "text", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("stated"))
    return rows.select("doc_id", F.sha2("text", 256).alias("content_hash"), (F.sha2("text", 256) == F.col("stated")).alias("matches"))


@query("d25_context_check", """
SELECT block_id, part, regexp_replace(substr(text, CAST(start AS INT) + 1, CAST("end" - start AS INT)), '[ \\t\\n\\x0B\\f\\r]', '', 'g') = regexp_replace(substr(text, 1, CAST("end" AS INT)), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS same FROM spans JOIN (SELECT block_id, text FROM blocks) USING (block_id)""")
def context_check(spark, sf):
    rows = fx.spans(spark, sf).join(fx.blocks(spark, sf).select("block_id", "text"), "block_id")
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    mine = F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return rows.select("block_id", "part", (bare(mine) == bare(F.substr("text", F.lit(1), F.col("end").cast("int")))).alias("same"))
