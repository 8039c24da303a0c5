"""Queries of retrieval, evidence and answer verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import stems as st
from attestra.operators import records, retrieval as rt, verify as vf
from attestra.plans import fixtures as fx
from attestra.plans.book import query
from attestra.plans.staging import staged

NUM = "[+-]?\\d+(?:[,.]\\d+)?"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def vectors(spark, sf):
    return fx.spread(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"))


def vector_queries(spark, sf):
    return fx.table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


DENSE = f"""
SELECT query_id, chunk_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
      round(1 - {DOT.format(a="q.embedding", b="c.embedding")} / (sqrt({DOT.format(a="q.embedding", b="q.embedding")}) * sqrt({DOT.format(a="c.embedding", b="c.embedding")})), 9) AS distance
    FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)) WHERE rank <= {{k}}"""


@query("t1_dense_topk", f"SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM ({DENSE.format(k=20)})")
def dense_topk(spark, sf):
    return rt.dense_topk(vector_queries(spark, sf), vectors(spark, sf), 20).select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@query("t3_descriptor_topk", f"SELECT query_id, chunk_id, 'D' || lpad(CAST(rank AS VARCHAR), 3, '0') AS alias FROM ({DENSE.format(k=12)})")
def descriptor_topk(spark, sf):
    return rt.aliases(rt.dense_topk(vector_queries(spark, sf), vectors(spark, sf), 12), "D").select("query_id", "chunk_id", "alias")


@query("d23_vector_check", f"SELECT vec_id, len(embedding) = 64 AND abs(sqrt({DOT.format(a='embedding', b='embedding')}) - 1) <= 0.001 AS vector_ok FROM embeddings")
def vector_check(spark, sf):
    return rt.vector_check(fx.table(spark, sf, "embeddings"), "embedding", 64).select("vec_id", "vector_ok")


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшыюз"


def chunk_words(spark, sf):
    """Chunks; those of every third document have Cyrillic words."""
    word = lambda w: F.when(F.col("doc_id") % 3 == 0, F.translate(F.lower(w), LATIN, CYRILLIC)).otherwise(w)
    return fx.spread(fx.chunks(spark, sf)).withColumn("words", F.transform("words", word))


def text_queries(spark, sf):
    """Benchmark questions; every third is Cyrillic."""
    plain = F.when(F.col("query_id") % 3 == 0, F.translate(F.lower("text"), LATIN, CYRILLIC)).otherwise(F.col("text"))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    return rt.bounded_terms(fx.table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), words)


def _without(x: str, pattern: str, keeps: bool = True) -> str:
    return f"regexp_replace({x}, '{pattern}', '{chr(92) + '1' if keeps else ''}')"


#: Stems of all words, step by step; asked: the terms of each question, as they are and as stems.
STEMS = f"""worded AS (SELECT chunk_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN list_transform(words, lambda x: translate(lower(x), '{LATIN}', '{CYRILLIC}')) ELSE words END AS words FROM chunks),
questions AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(CASE WHEN item_id % 3 = 0 THEN translate(lower(text), '{LATIN}', '{CYRILLIC}') ELSE text END, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark),
st0 AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(words) AS word FROM worded UNION ALL SELECT unnest([lang, source]) FROM worded UNION ALL SELECT unnest(w) FROM questions)),
st1 AS (SELECT word, replace(word, 'ё', 'е') AS w, regexp_extract(replace(word, 'ё', 'е'), '{st.TO_FIRST_VOWEL}') AS head, length(regexp_extract(replace(word, 'ё', 'е'), '{st.TO_SECOND_REGION}')) AS second FROM st0 WHERE regexp_matches(word, '{st.CYRILLIC}')),
st2 AS (SELECT *, substr(w, length(head) + 1) AS r FROM st1), st3 AS (SELECT *, {_without("r", st.GERUND)} AS g, {_without("r", st.REFLEXIVE, False)} AS f FROM st2),
st4 AS (SELECT *, {_without("f", st.ADJECTIVAL)} AS a, {_without("f", st.VERB)} AS v, {_without("f", st.NOUN, False)} AS n FROM st3),
st5 AS (SELECT *, regexp_replace(CASE WHEN g <> r THEN g WHEN a <> f THEN a WHEN v <> f THEN v ELSE n END, 'и$', '') AS x FROM st4),
st6 AS (SELECT *, CASE WHEN regexp_matches(x, 'ость?$') AND second > 0 AND length(head || regexp_replace(x, 'ость?$', '')) >= second THEN regexp_replace(x, 'ость?$', '') ELSE x END AS y FROM st5),
stems AS (SELECT word, CASE WHEN head = '' THEN w ELSE head || CASE WHEN regexp_matches(y, 'ейше?$|нн$') THEN regexp_replace(regexp_replace(y, 'ейше?$', ''), 'нн$', 'н') ELSE regexp_replace(y, 'ь$', '') END END AS stem FROM st6 UNION ALL SELECT word, word FROM st0 WHERE NOT regexp_matches(word, '{st.CYRILLIC}'))"""
TERMS = f"""{STEMS}, tokens AS (SELECT chunk_id, lower(word) AS word, head FROM (SELECT chunk_id, unnest([lang, source]) AS word, true AS head FROM worded UNION ALL SELECT chunk_id, unnest(words), false FROM worded)),
lexed AS (SELECT chunk_id, word, stem, head FROM tokens JOIN stems USING (word)),
terms AS (SELECT chunk_id, term, weight, count(*) AS n FROM (SELECT chunk_id, stem AS term, 1.0 AS weight FROM lexed UNION ALL SELECT chunk_id, word, 1.0 FROM lexed WHERE head UNION ALL SELECT chunk_id, word, 0.4 FROM lexed UNION ALL SELECT chunk_id, stem, 0.4 FROM lexed WHERE NOT head UNION ALL SELECT chunk_id, word, 0.2 FROM lexed WHERE NOT head) GROUP BY ALL)"""
ASKED = """asked AS (
  SELECT q.query_id, list_sort(list_distinct(list(lower(q.word)) || list(s.stem))) AS terms FROM (SELECT query_id, unnest(w) AS word FROM questions) q JOIN stems s ON s.word = lower(q.word) GROUP BY 1 UNION ALL SELECT query_id, [] FROM questions WHERE len(w) = 0)"""
LEXICAL = """lexical AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, round(sum(CAST(weight AS DOUBLE) * n), 9) AS score FROM (SELECT query_id, unnest(terms) AS term FROM asked) JOIN terms USING (term) GROUP BY 1, 2)) WHERE rank <= 20)"""


@query("d24_weighted_terms", f"WITH {TERMS} SELECT chunk_id, term, CAST(weight AS DOUBLE) AS weight, n FROM terms")
def weighted_terms(spark, sf):
    return rt.weighted_terms(chunk_words(spark, sf), rt.search_parts(F.array("lang", "source"), F.col("words")))


@query("t9_bounded_terms", f"WITH {STEMS}, {ASKED} SELECT query_id, terms, len(terms) > 128 AS too_many FROM asked")
def bounded_terms(spark, sf):
    return text_queries(spark, sf)


def lexical_hits(spark, sf):
    return rt.search_topk(text_queries(spark, sf), chunk_words(spark, sf), F.array("lang", "source"), F.col("words"))


@query("t2_lexical_topk", f"WITH {TERMS}, {ASKED}, {LEXICAL} SELECT * FROM lexical")
def lexical_topk(spark, sf):
    return lexical_hits(spark, sf)


@query("t2_cover_density", """
WITH p AS (SELECT chunk_id, lower(word) AS term, pos, CASE WHEN lower(word) <> word THEN 1.0 ELSE 0.2 END AS weight FROM (SELECT chunk_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM chunks)),
q AS (SELECT item_id AS query_id, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')[2:4], lambda x: lower(x)))) AS terms FROM benchmark),
a AS (SELECT query_id, unnest(terms) AS term, len(terms) AS terms FROM q),
h AS (SELECT * FROM (SELECT query_id, chunk_id, term, pos, weight, terms, count(DISTINCT term) OVER (PARTITION BY query_id, chunk_id) AS found FROM p JOIN a USING (term)) WHERE found = terms),
l AS (SELECT e.query_id, e.chunk_id, e.pos AS q, t.term, max(t.pos) AS last, any_value(e.terms) AS terms FROM h e JOIN h t ON t.query_id = e.query_id AND t.chunk_id = e.chunk_id AND t.pos <= e.pos GROUP BY 1, 2, 3, 4),
w AS (SELECT query_id, chunk_id, p, min(q) AS q FROM (SELECT query_id, chunk_id, q, min(last) AS p FROM l GROUP BY 1, 2, 3 HAVING count(*) = any_value(terms)) GROUP BY 1, 2, 3),
d AS (SELECT w.query_id, w.chunk_id, w.p, (count(*) / sum(1 / CAST(h.weight AS DOUBLE))) / (1 + (w.q - w.p) - (count(*) - 1)) AS density FROM w JOIN h ON h.query_id = w.query_id AND h.chunk_id = w.chunk_id AND h.pos BETWEEN w.p AND w.q GROUP BY 1, 2, 3, w.q)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(density), 9) AS score FROM d GROUP BY 1, 2)) WHERE rank <= 20""")
def cover_density(spark, sf):
    """Three words of each question that must all be there; words with a capital weigh more."""
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 2, 3)
    asked = rt.bounded_terms(fx.table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), words)
    rows = fx.chunks(spark, sf).select("chunk_id", F.posexplode("words").alias("pos", "word"))
    return rt.cover_topk(asked, rows.select("chunk_id", F.lower("word").alias("term"), "pos", F.when(F.lower("word") != F.col("word"), 1.0).otherwise(0.2).alias("weight")))


def channels(spark, sf):
    """Two channels for each benchmark question: lexical hits, and the first chunks of the documents whose vectors are
    nearest to the vector of the question's number. Written once, as two things read them."""
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    asked = vectors(spark, sf).join(F.broadcast(items.distinct()) if items.count() <= rt.FEW_TERMS else items.distinct(), F.col("chunk_id") == F.col("query_id"))
    dense = rt.dense_topk(asked.select("query_id", "embedding"), vectors(spark, sf), 20).select("query_id", (F.col("chunk_id") * 1000).alias("chunk_id"), "rank")
    both = lexical_hits(spark, sf).select("query_id", "chunk_id", "rank").withColumn("channel", F.lit("lexical")).unionByName(dense.withColumn("channel", F.lit("dense")))
    return staged(both.withColumn("generation_id", F.floor(F.col("chunk_id") / 1000) % 3))


CHANNELS = f"""dense AS (SELECT query_id, chunk_id * 1000 AS chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(1 - {DOT.format(a="q.embedding", b="c.embedding")} / (sqrt({DOT.format(a="q.embedding", b="q.embedding")}) * sqrt({DOT.format(a="c.embedding", b="c.embedding")})), 9) AS distance
  FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 20),
channels AS (SELECT query_id, chunk_id, rank, 'lexical' AS channel FROM lexical UNION ALL SELECT query_id, chunk_id, rank, 'dense' FROM dense)"""


@query("n1_rrf_fuse", f"""
WITH {TERMS}, {ASKED}, {LEXICAL}, {CHANNELS}
SELECT query_id, chunk_id, generation_id, score, channels, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(chunk_id AS VARCHAR), CAST(generation_id AS VARCHAR)) AS rank FROM (
    SELECT query_id, chunk_id, (chunk_id // 1000) % 3 AS generation_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS channels FROM channels GROUP BY 1, 2)) WHERE rank <= 20""")
def rrf_fuse(spark, sf):
    return rt.rrf_fuse(channels(spark, sf), keys=("chunk_id", "generation_id"))


@query("e14_stage_counts", f"""
WITH {TERMS}, {ASKED}, {LEXICAL}, {CHANNELS}
SELECT query_id, count(*) FILTER (WHERE channel = 'lexical') AS lexical, count(*) FILTER (WHERE channel = 'dense') AS dense FROM channels GROUP BY 1""")
def stage_counts(spark, sf):
    both = channels(spark, sf)
    return rt.stage_counts(lexical=both.where("channel = 'lexical'"), dense=both.where("channel = 'dense'"))


def common_words(questions: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a reranker: distinct words that a question and a text share, less five; five texts at once at most."""
    if len(texts) > 5:
        raise rt.TokenOverflow
    return [len(set(q.split()) & set(t.split())) - 5.0 for q, t in zip(questions, texts, strict=True)]


@query("t4_rerank_topk", f"""
WITH {TERMS}, {ASKED}, {LEXICAL}
SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(1 / (1 + exp(5.0 - len(list_intersect(a.terms, list_transform(c.words, lambda x: lower(x)))))), 9) AS score FROM lexical JOIN asked a USING (query_id) JOIN worded c USING (chunk_id))) WHERE rank <= 6""")
def rerank_topk(spark, sf):
    questions = text_queries(spark, sf).select("query_id", F.array_join("terms", " ").alias("question"))
    hits = staged(lexical_hits(spark, sf).select("query_id", "chunk_id").join(questions, "query_id"))  # few: the texts are not shuffled to meet them
    texts = chunk_words(spark, sf).select("chunk_id", F.lower(F.array_join("words", " ")).alias("text"))
    rows = hits.join(texts, "chunk_id")
    return rt.rerank_topk(rows, F.round(rt.rerank_score(F.col("question"), F.col("text"), common_words), 9)).select("query_id", "chunk_id", "score", "rank")


def word_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedder."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("u3_embed", "SELECT chunk_id, [CAST(length(t) AS FLOAT), CAST(len(words) - 1 AS FLOAT)] AS embedding FROM (SELECT chunk_id, words, array_to_string(words, ' ') AS t FROM chunks)")
def embed_chunks(spark, sf):
    return fx.chunks(spark, sf).select("chunk_id", rt.embed(F.array_join("words", " "), word_counts).alias("embedding"))


@query("j1_chunks_in_snapshot", """
SELECT chunk_id, doc_id, ordinal % 3 AS generation_id FROM chunks WHERE doc_id % 2 = 0 AND ordinal % 3 = doc_id % 3 AND doc_id % 11 <> 0""")
def chunks_in_snapshot(spark, sf):
    chunks = fx.chunks(spark, sf).select("chunk_id", "doc_id", (F.col("ordinal") % 3).alias("generation_id"))
    docs = fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 11 == 0).alias("revoked"))
    items = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 3).alias("generation_id"))
    return rt.chunks_in_snapshot(chunks, items, docs).select("chunk_id", "doc_id", "generation_id")


@query("j13_recipe_guard", "SELECT doc_id, source FROM documents WHERE source <> 'src3' OR source IS NULL")
def recipe_guard(spark, sf):
    return rt.recipe_guard(fx.table(spark, sf, "documents").select("doc_id", "source", F.col("source").alias("recipe")), "src3").select("doc_id", "source")


@query("e15_search_path", "SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'current' ELSE 'historical_exact' END AS path FROM documents")
def search_path(spark, sf):
    return rt.search_path(fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).alias("epoch")), 2).select("doc_id", "path")


@query("s3_registry_slice", """
WITH r AS (SELECT doc_id AS request_id, block_id FROM blocks WHERE line % 2 = 0 UNION ALL SELECT DISTINCT doc_id, 'none-' || doc_id FROM blocks),
j AS (SELECT r.request_id, r.block_id, b.text FROM r LEFT JOIN blocks b ON b.block_id = r.block_id),
s AS (SELECT request_id, coalesce(sum(length(text)), 0) AS chars FROM j GROUP BY 1)
SELECT request_id, block_id, text IS NOT NULL AS found, chars > 2000 AS too_big FROM j JOIN s USING (request_id)""")
def registry_slice(spark, sf):
    b = fx.blocks(spark, sf)
    asked = b.where("line % 2 = 0").select(F.col("doc_id").alias("request_id"), "block_id")
    asked = asked.unionByName(b.select(F.col("doc_id").alias("request_id"), F.concat(F.lit("none-"), "doc_id").alias("block_id")).distinct())
    return records.registry_slice(b, asked, 2000)


@query("s4_referenced_blocks", "SELECT DISTINCT doc_id, block_id FROM spans")
def referenced_blocks(spark, sf):
    rows = fx.spans(spark, sf).groupBy("doc_id").agg(F.collect_list(F.when(F.col("part") == 1, F.struct("block_id", "start"))).alias("owned"), F.collect_list(F.when(F.col("part") == 2, F.struct("block_id", "start"))).alias("context"))
    return records.referenced_blocks(rows, "doc_id", ["owned", "context"])


@query("n4_set_binding", """
(SELECT doc_id, 'a' AS only_in FROM documents EXCEPT SELECT doc_id, 'a' FROM labels) UNION ALL (SELECT doc_id, 'b' FROM labels EXCEPT SELECT doc_id, 'b' FROM documents)""")
def set_binding(spark, sf):
    return records.set_binding(fx.table(spark, sf, "documents").select("doc_id").distinct(), fx.table(spark, sf, "labels").select("doc_id").distinct(), ["doc_id"])


@query("n5_distinct_refs", """
SELECT chunk_id, list_filter(words, lambda x, i: list_position(words, x) = i) AS words FROM chunks""")
def distinct_refs(spark, sf):
    return fx.chunks(spark, sf).select("chunk_id", F.array_distinct("words").alias("words"))


@query("v1_claims_bound", """
SELECT pack_id, claim_id, evidence_id FROM (SELECT pack_id, claim_id, unnest(evidence_ids) AS evidence_id FROM claims) c
WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.pack_id = c.pack_id AND u.evidence_id = c.evidence_id)""")
def claims_bound(spark, sf):
    return vf.claims_bound(fx.claims(spark, sf), fx.units(spark, sf)).select("pack_id", "claim_id", "evidence_id")


@query("v2_repeated_claims", """
SELECT pack_id, text, list_sort(evidence_ids) AS ids, count(DISTINCT claim_id) AS claims, min(claim_id) AS first_claim FROM claims GROUP BY 1, 2, 3 HAVING count(DISTINCT claim_id) > 1""")
def repeated_claims(spark, sf):
    return vf.repeated_claims(fx.claims(spark, sf))


V3 = f"""
own AS (SELECT pack_id, claim_id, evidence_ids, list_distinct(regexp_extract_all(text, '{NUM}')) AS numbers FROM claims),
there AS (SELECT pack_id, claim_id, list_distinct(flatten(list(nums))) AS there FROM (
  SELECT c.pack_id, c.claim_id, regexp_extract_all(u.excerpt, '{NUM}') AS nums FROM (SELECT pack_id, claim_id, unnest(evidence_ids) AS evidence_id FROM claims) c JOIN units u USING (pack_id, evidence_id)) GROUP BY 1, 2)"""


@query("v3_numeric_support", f"""
WITH {V3} SELECT pack_id, claim_id, list_sort(list_filter(numbers, lambda x: NOT list_contains(coalesce(there, []), x))) AS missing,
  len(list_filter(numbers, lambda x: NOT list_contains(coalesce(there, []), x))) = 0 AS supported FROM own LEFT JOIN there USING (pack_id, claim_id)""")
def numeric_support(spark, sf):
    return vf.numeric_support(fx.claims(spark, sf), fx.units(spark, sf))


GROUPS = """groups AS MATERIALIZED (SELECT pack_id, evidence_id AS trigger, row, col, list_sort(['0-' || col] || CASE WHEN col > 0 THEN [row || '-0'] ELSE [] END) AS required FROM units WHERE row > 0)"""


@query("v4_citation_groups", f"WITH {GROUPS} SELECT * FROM groups")
def citation_groups(spark, sf):
    return vf.citation_groups(fx.units(spark, sf))


@query("v5_row_options", """
SELECT pack_id, row, [row || '-0'] AS subjects, [row || '-1', row || '-2', row || '-3'] AS values, [row || '-0', row || '-1', row || '-2', row || '-3'] AS complete FROM units WHERE row > 0 AND col = 0""")
def row_options(spark, sf):
    return vf.row_options(fx.units(spark, sf))


@query("v7_numeric_table_context", f"""
WITH {GROUPS}, hit AS (
  SELECT c.pack_id, c.claim_id, c.trigger, c.evidence_ids, g.required FROM (SELECT pack_id, claim_id, evidence_ids, text, unnest(evidence_ids) AS trigger FROM claims) c
  JOIN groups g USING (pack_id, trigger) JOIN units u ON u.pack_id = c.pack_id AND u.evidence_id = c.trigger
  WHERE list_has_any(regexp_extract_all(c.text, '{NUM}'), regexp_extract_all(u.excerpt, '{NUM}')))
SELECT pack_id, claim_id, trigger, list_sort(list_filter(required, lambda x: NOT list_contains(evidence_ids, x))) AS missing FROM hit WHERE len(list_filter(required, lambda x: NOT list_contains(evidence_ids, x))) > 0""")
def numeric_table_context(spark, sf):
    units, claims = fx.units(spark, sf), fx.claims(spark, sf)
    return vf.numeric_table_context(claims, units, vf.citation_groups(units, only=vf.cited(claims)))


@query("v17_unit_required_ids", f"WITH {GROUPS} SELECT pack_id, trigger, required FROM groups")
def unit_required_ids(spark, sf):
    return vf.unit_required_ids(vf.citation_groups(fx.units(spark, sf)))


@query("v13_claim_source_view", """
SELECT pack_id, claim_id, CAST(row AS BIGINT) AS row, list_sort(list_intersect(complete, evidence_ids)) AS cited, len(list_intersect(complete, evidence_ids)) = 4 AS whole FROM (
  SELECT c.pack_id, c.claim_id, u.row, c.evidence_ids, [u.row || '-0', u.row || '-1', u.row || '-2', u.row || '-3'] AS complete FROM claims c JOIN units u ON u.pack_id = c.pack_id AND u.row > 0 AND u.col = 0)
WHERE list_has_any(complete, evidence_ids)""")
def claim_source_view(spark, sf):
    return vf.claim_source_view(fx.claims(spark, sf), vf.row_options(fx.units(spark, sf)))


def verdicts(spark, sf):
    k = F.col("pack_id") + F.col("claim_id")
    word = F.when(k % 17 == 0, "unsupported").when(k % 5 == 0, "partially_supported").otherwise("supported")
    reason = F.when(k % 17 == 0, "UNSUPPORTED").when(k % 5 == 0, F.when(k % 3 == 0, "CONTRADICTION").otherwise("MISSING_CONDITION")).otherwise("SUPPORTED")
    issue = F.when(k % 17 == 0, "unsupported").when(k % 5 == 0, "missing_condition").when(k % 19 == 0, "incomplete_support").otherwise("none")
    ids = F.when(k % 23 == 0, F.array(F.lit("9-9"))).otherwise(F.col("evidence_ids"))
    return fx.claims(spark, sf).where("(pack_id + claim_id) % 29 <> 0").select("pack_id", "claim_id", word.alias("verdict"), reason.alias("reason_code"), issue.alias("issue_type"), ids.alias("evidence_ids"))


VERDICTS = """verdicts AS (SELECT pack_id, claim_id, CASE WHEN k % 17 = 0 THEN 'unsupported' WHEN k % 5 = 0 THEN 'partially_supported' ELSE 'supported' END AS verdict,
  CASE WHEN k % 17 = 0 THEN 'UNSUPPORTED' WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN 'CONTRADICTION' ELSE 'MISSING_CONDITION' END ELSE 'SUPPORTED' END AS reason_code,
  CASE WHEN k % 17 = 0 THEN 'unsupported' WHEN k % 5 = 0 THEN 'missing_condition' WHEN k % 19 = 0 THEN 'incomplete_support' ELSE 'none' END AS issue_type,
  CASE WHEN k % 23 = 0 THEN ['9-9'] ELSE evidence_ids END AS ids FROM (SELECT *, pack_id + claim_id AS k FROM claims) WHERE k % 29 <> 0)"""
POLICY = """policy AS (SELECT o.o_orderkey AS pack_id, CASE WHEN o.o_orderkey % 31 = 0 THEN 'no' WHEN o.o_orderkey % 7 = 0 THEN 'partial' ELSE 'yes' END AS question_match,
  CASE WHEN o.o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS missing_parts, CASE WHEN o.o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS global_issues,
  coalesce(f.refused, false) AS refused, coalesce(f.partial, false) AS partial, coalesce(f.unsafe, false) AS unsafe FROM orders o LEFT JOIN (
    SELECT pack_id, bool_or(verdict = 'unsupported') AS refused, bool_or(verdict = 'partially_supported') AS partial, bool_or(verdict = 'partially_supported' AND reason_code = 'CONTRADICTION') AS unsafe FROM verdicts GROUP BY 1) f ON f.pack_id = o.o_orderkey)"""


def critics(spark, sf):
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        k.alias("pack_id"), F.when(k % 31 == 0, "no").when(k % 7 == 0, "partial").otherwise("yes").alias("question_match"),
        (k % 13 == 0).cast("int").alias("missing_parts"), (k % 37 == 0).cast("int").alias("global_issues"),
    )


@query("v9_critic_policy", f"""
WITH {VERDICTS}, {POLICY} SELECT *, CASE WHEN refused OR question_match = 'no' OR global_issues > 0 OR unsafe THEN 'refuse' WHEN question_match = 'partial' OR missing_parts > 0 OR partial THEN 'repair' ELSE 'render' END AS action FROM policy""")
def critic_policy(spark, sf):
    return vf.critic_policy(verdicts(spark, sf), critics(spark, sf))


@query("v10_decide", f"""
WITH {VERDICTS}, {POLICY}, d AS (SELECT pack_id, CASE WHEN refused THEN 'UNSUPPORTED_CLAIM' WHEN question_match = 'no' THEN 'QUESTION_MISMATCH' WHEN global_issues > 0 THEN 'GLOBAL_ISSUE' WHEN unsafe THEN 'UNSAFE_PARTIAL'
  WHEN pack_id % 41 = 0 THEN 'INCOMPLETE_TABLE_VARIANT' WHEN partial OR question_match = 'partial' OR missing_parts > 0 THEN CASE WHEN pack_id % 2 = 1 THEN 'REPAIR_EXHAUSTED' ELSE 'INCOMPLETE_ANSWER' END ELSE 'SUPPORTED' END AS reason FROM policy)
SELECT pack_id, reason, CASE WHEN reason IN ('UNSUPPORTED_CLAIM', 'QUESTION_MISMATCH', 'GLOBAL_ISSUE', 'UNSAFE_PARTIAL') THEN 'hallucinated' WHEN reason = 'SUPPORTED' THEN 'confirmed' ELSE 'partially_confirmed' END AS status,
  CASE WHEN reason = 'SUPPORTED' THEN 'render' WHEN reason IN ('UNSUPPORTED_CLAIM', 'QUESTION_MISMATCH', 'GLOBAL_ISSUE', 'UNSAFE_PARTIAL') OR pack_id % 2 = 1 THEN 'refuse' ELSE 'repair' END AS action FROM d""")
def decide(spark, sf):
    rows = vf.critic_policy(verdicts(spark, sf), critics(spark, sf)).withColumns({"repairs": (F.col("pack_id") % 2).cast("int"), "variants": (F.col("pack_id") % 41 == 0).cast("int")})
    return vf.decide(rows).select("pack_id", "reason", "status", "action")


@query("v11_verdict_consistency", f"""
WITH {VERDICTS} SELECT pack_id, claim_id, fault FROM (SELECT coalesce(c.pack_id, v.pack_id) AS pack_id, coalesce(c.claim_id, v.claim_id) AS claim_id, CASE WHEN v.verdict IS NULL THEN 'missing_verdict' WHEN c.evidence_ids IS NULL THEN 'unknown_claim'
  WHEN (v.verdict = 'supported') <> (reason_code = 'SUPPORTED') THEN 'reason' WHEN (v.verdict = 'supported') <> (issue_type = 'none') THEN 'issue' WHEN v.verdict = 'supported' AND len(ids) = 0 THEN 'no_evidence'
  WHEN len(list_filter(ids, lambda x: NOT list_contains(c.evidence_ids, x))) > 0 THEN 'foreign_evidence' END AS fault FROM claims c FULL JOIN verdicts v ON c.pack_id = v.pack_id AND c.claim_id = v.claim_id) WHERE fault IS NOT NULL""")
def verdict_consistency(spark, sf):
    return vf.verdict_consistency(verdicts(spark, sf), fx.claims(spark, sf))


W9 = """used AS (SELECT pack_id, claim_id, unnest(evidence_ids) AS evidence_id, generate_subscripts(evidence_ids, 1) AS pos FROM claims),
labels_of AS (SELECT pack_id, evidence_id, 'C' || lpad(CAST(row_number() OVER (PARTITION BY pack_id ORDER BY c, p) AS VARCHAR), 3, '0') AS label FROM (
  SELECT pack_id, evidence_id, min(claim_id) AS c, min_by(pos, claim_id * 100 + pos) AS p FROM used GROUP BY 1, 2))"""


@query("w9_first_seen_numbering", f"WITH {W9} SELECT * FROM labels_of")
def first_seen_numbering(spark, sf):
    return vf.citation_numbers(fx.claims(spark, sf))


@query("v15_render_answer", f"""
WITH {W9}, lines AS (SELECT pack_id, claim_id, text || ' [' || string_agg(DISTINCT label, ', ' ORDER BY label) || ']' AS line FROM claims JOIN used USING (pack_id, claim_id) JOIN labels_of USING (pack_id, evidence_id) GROUP BY pack_id, claim_id, text)
SELECT pack_id, string_agg(line, chr(10) ORDER BY claim_id) AS answer, (SELECT count(*) FROM labels_of l WHERE l.pack_id = lines.pack_id) AS citations FROM lines GROUP BY pack_id""")
def render_answer(spark, sf):
    return vf.render_answer(fx.claims(spark, sf))


@query("w8_contrast_rows", """
SELECT pack_id, row, next_row FROM (SELECT pack_id, row, subject, lead(row) OVER w AS next_row, lead(subject) OVER w AS next_subject FROM (
  SELECT l_orderkey AS pack_id, row, CASE WHEN row % 3 = 0 THEN 'limit' ELSE 'limit for ' || l_returnflag END AS subject FROM items) WINDOW w AS (PARTITION BY pack_id ORDER BY row))
WHERE subject <> next_subject AND ((starts_with(next_subject, subject) AND NOT regexp_matches(substr(next_subject, length(subject) + 1, 1), '[\\pL\\pN_]')) OR (starts_with(subject, next_subject) AND NOT regexp_matches(substr(subject, length(next_subject) + 1, 1), '[\\pL\\pN_]')))""")
def contrast_rows(spark, sf):
    flag = fx.cells(spark, sf).where("row > 0 and col = 4").select(F.col("table_id").alias("pack_id"), "row", F.when(F.col("row") % 3 == 0, "limit").otherwise(F.concat(F.lit("limit for "), "text")).alias("subject"))
    return vf.contrast_rows(flag)
