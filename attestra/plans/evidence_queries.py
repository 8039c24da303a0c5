"""Queries of sources, batches and evidence packs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestra.operators import evidence as evd
from attestra.plans import fixtures as fx
from attestra.plans.book import query
from attestra.plans.staging import shared_dir
from attestra.sources import batches as bt


def sized(spark, sf):
    return fx.chunks(spark, sf).select("doc_id", "ordinal", F.size("words").cast("long").alias("tokens"), F.octet_length(F.array_join("words", " ")).cast("long").alias("bytes"))


@query("s5_greedy_batches", """
WITH RECURSIVE s AS (SELECT doc_id, ordinal, len(words) AS t, strlen(array_to_string(words, ' ')) AS b, len(words) > 150 OR strlen(array_to_string(words, ' ')) > 900 AS over FROM chunks),
r AS (SELECT doc_id, ordinal, CASE WHEN over THEN NULL ELSE 0 END AS batch, 0 AS cur, CASE WHEN over THEN 0 ELSE 1 END AS items, CASE WHEN over THEN 0 ELSE t END AS tokens, CASE WHEN over THEN 0 ELSE b END AS size FROM s WHERE ordinal = 0
  UNION ALL SELECT doc_id, ordinal, CASE WHEN NOT over THEN cur + cut END, CASE WHEN over THEN cur ELSE cur + cut END, CASE WHEN over THEN items WHEN cut = 1 THEN 1 ELSE items + 1 END, CASE WHEN over THEN tokens WHEN cut = 1 THEN t ELSE tokens + t END, CASE WHEN over THEN size WHEN cut = 1 THEN b ELSE size + b END
  FROM (SELECT s.*, r.cur, r.items, r.tokens, r.size, CASE WHEN r.items > 0 AND (r.items + 1 > 4 OR r.tokens + s.t > 150 OR r.size + s.b > 900) THEN 1 ELSE 0 END AS cut FROM r JOIN s ON s.doc_id = r.doc_id AND s.ordinal = r.ordinal + 1))
SELECT doc_id, ordinal, CAST(batch AS BIGINT) AS batch FROM r""")
def greedy_batches(spark, sf):
    return bt.greedy_batches(sized(spark, sf), "doc_id", "ordinal", 4, 150, 900)


@query("s6_batch_prints", """
SELECT doc_id, sha256('[' || string_agg('{"ordinal":' || ordinal || ',"n":' || len(words) || '}', ',' ORDER BY ordinal) || ']') AS print, count(*) AS rows FROM chunks GROUP BY 1""")
def batch_prints(spark, sf):
    return bt.batch_prints(fx.chunks(spark, sf).select("doc_id", "ordinal", F.size("words").alias("n")), ["doc_id"], "ordinal", "n")


@query("s6_write_index_batches", """
SELECT doc_id AS batch_id, count(*) AS rows, CASE doc_id % 3 WHEN 0 THEN 'replay' WHEN 1 THEN 'conflict' ELSE 'written' END AS outcome FROM chunks GROUP BY 1""")
def write_index_batches(spark, sf):
    """The chunks of a document are a batch; the ledger knows a third of them as they are and a third as they were."""
    rows = fx.chunks(spark, sf).select(F.col("doc_id").alias("batch_id"), "ordinal", F.size("words").alias("n"))
    own = f"{shared_dir(spark)}/attestra-{uuid.uuid4().hex}"
    k = F.col("batch_id") % 3
    known = bt.batch_prints(rows.where(k < 2), ["batch_id"], "ordinal", "n")
    known = known.select("batch_id", "rows", F.lit("written").alias("outcome"), F.when(k == 0, F.col("print")).otherwise(F.sha2("print", 256)).alias("print"))
    known.write.parquet(f"{own}/ledger/write=before")
    return bt.write_index_batches(rows.repartition("batch_id"), f"{own}/ledger", f"{own}/rows", "ordinal", "n")


@query("s9_encode_evidence", """
WITH v AS (SELECT pack_id, excerpt, row_number() OVER (PARTITION BY pack_id ORDER BY min(row * 5 + col)) - 1 AS number FROM units GROUP BY 1, 2)
SELECT pack_id, '{"fields":["number","evidence_id"],"values":[' || (SELECT string_agg('"' || excerpt || '"', ',' ORDER BY number) FROM v WHERE v.pack_id = u.pack_id) || '],"rows":[' || string_agg('{"position":' || (row * 5 + col) || ',"number":' || v.number || ',"evidence_id":"' || evidence_id || '"}', ',' ORDER BY row * 5 + col) || ']}' AS encoded
FROM units u JOIN v USING (pack_id, excerpt) GROUP BY 1""")
def encode_evidence(spark, sf):
    rows = fx.units(spark, sf).withColumn("position", F.col("row") * 5 + F.col("col"))
    return bt.encode_evidence(rows, ["evidence_id"], "excerpt")


@query("e9_pack_evidence", """
WITH RECURSIVE c AS (SELECT doc_id AS query_id, CAST(ordinal + 1 AS INTEGER) AS rank, (ordinal * 7919) % 90 + 1 + CASE WHEN doc_id % 7 = 0 THEN 300 ELSE 0 END AS t FROM chunks),
r AS (SELECT query_id, rank, t <= 300 AS taken, CASE WHEN t <= 300 THEN 1 ELSE 0 END AS units, CASE WHEN t <= 300 THEN t ELSE 0 END AS tokens FROM c WHERE rank = 1
  UNION ALL SELECT c.query_id, c.rank, r.units < 12 AND r.tokens + c.t <= 300, r.units + CASE WHEN r.units < 12 AND r.tokens + c.t <= 300 THEN 1 ELSE 0 END, r.tokens + CASE WHEN r.units < 12 AND r.tokens + c.t <= 300 THEN c.t ELSE 0 END FROM r JOIN c ON c.query_id = r.query_id AND c.rank = r.rank + 1)
SELECT query_id, rank, taken, CASE WHEN NOT bool_or(taken) OVER (PARTITION BY query_id) THEN 'ATOMIC_CONTEXT_TOO_LARGE' END AS fault FROM r""")
def pack_evidence(spark, sf):
    rows = sized(spark, sf).select(F.col("doc_id").alias("query_id"), (F.col("ordinal") + 1).cast("int").alias("rank"), F.lit(1).alias("units"), ((F.col("ordinal") * 7919) % 90 + 1 + F.when(F.col("doc_id") % 7 == 0, 300).otherwise(0)).alias("tokens"))
    return evd.pack_evidence(rows, 12, 300)


@query("e10_pack_manifest", """
WITH e AS (SELECT pack_id, '{"alias":"E' || lpad(CAST(row_number() OVER (PARTITION BY pack_id ORDER BY row, col) AS VARCHAR), 3, '0') || '","hash":"' || sha256(excerpt) || '"}' AS entry FROM units)
SELECT pack_id, count(*) AS units, sha256('[' || string_agg(entry, ',' ORDER BY entry) || ']') AS manifest_hash FROM e GROUP BY 1""")
def pack_manifest(spark, sf):
    rows = fx.units(spark, sf).withColumn("position", F.col("row") * 5 + F.col("col"))
    return evd.pack_manifest(rows).drop("uuid")


@query("e11_pack_validate", """
SELECT doc_id AS pack_id, chunk_id AS evidence_id, CASE WHEN chunk_id % 7 = 0 THEN 'unknown' WHEN chunk_id % 5 = 0 THEN 'title' WHEN chunk_id % 3 = 0 THEN 'text' END AS fault FROM chunks WHERE chunk_id % 7 = 0 OR chunk_id % 5 = 0 OR chunk_id % 3 = 0""")
def pack_validate(spark, sf):
    k = F.col("chunk_id")
    text = F.array_join("words", " ")
    units = fx.chunks(spark, sf).select(F.col("doc_id").alias("pack_id"), k.alias("evidence_id"), F.when(k % 5 == 0, "other").otherwise(F.col("source")).alias("title"), F.when(k % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text).alias("excerpt"))
    known = fx.chunks(spark, sf).where(k % 7 != 0).select(k.alias("evidence_id"), F.col("source").alias("title"), F.sha2(text, 256).alias("hash"))
    return evd.pack_validate(units, known)


@query("e13_owner_attestation", """
SELECT doc_id AS owner_id, CASE WHEN doc_id % 4 = 1 THEN 'not_attested' WHEN doc_id % 4 = 2 THEN 'changed' ELSE 'not_present' END AS fault FROM documents WHERE doc_id % 4 IN (1, 2, 3)""")
def owner_attestation(spark, sf):
    d, k = fx.table(spark, sf, "documents"), F.col("doc_id")
    owners = d.where(k % 4 != 3).select(k.alias("owner_id"), "text")
    attested = d.where(k % 4 != 1).select(k.alias("owner_id"), F.sha2(F.when(k % 4 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return evd.owner_attestation(owners, attested)


@query("e7_coalesce_units", """
SELECT block_id AS owner, CAST(0 AS BIGINT) AS start, length(text) AS "end", [1, 2] AS chunk_ids, text, true AS agrees FROM blocks WHERE length(text) > 3""")
def coalesce_units(spark, sf):
    rows = fx.spans(spark, sf).where("n > 3").join(fx.blocks(spark, sf).select("block_id", "text"), "block_id")
    cut = F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return evd.coalesce_units(rows.select(F.col("block_id").alias("owner"), "start", "end", cut.alias("text"), F.col("part").alias("chunk_id")))
