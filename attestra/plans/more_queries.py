"""Queries of page lines, lifecycle details and citation closures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestra.operators import catalog as ct, lines as ln, tree as tr, verify as vf
from attestra.plans import fixtures as fx
from attestra.plans.book import query
from attestra.plans.catalog_queries import NOW, STATES, now
from attestra.plans.structure_queries import COLUMNS
from attestra.streaming import events as ev


@query("d1_normalise_text")
def normalise_text(spark, sf):
    return ln.normalise_text(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text"))


@query("w5_join_collinear", """
SELECT doc_id AS page_id, line, CAST(0 AS DOUBLE) AS x0, CAST(10 * (len(l) - 1) + 8 AS DOUBLE) AS x1, array_to_string(l, ' ') AS text FROM (SELECT doc_id, line, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM blocks)""")
def join_collinear(spark, sf):
    words = fx.blocks(spark, sf).select("doc_id", "line", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("k", "text"))
    return ln.join_collinear(words.select(F.col("doc_id").alias("page_id"), "line", (F.col("k") * 10.0).alias("x0"), (F.col("k") * 10.0 + 8).alias("x1"), F.lit(5.0).alias("yc"), F.lit(10.0).alias("size"), "text"))


def placed_tables(spark, sf):
    """One table a page of documents' blocks, below its first line where the page is odd, else at its top."""
    return fx.blocks(spark, sf).groupBy("doc_id", "page").agg(F.count("*").alias("n")).select("doc_id", "page", (F.col("doc_id") * 1000 + F.col("page")).alias("table_id"), F.when(F.col("page") % 2 == 1, 115.0).otherwise(90.0).alias("y0"))


TABLES = "placed AS (SELECT DISTINCT doc_id, page, doc_id * 1000 + page AS table_id, CASE WHEN page % 2 = 1 THEN 115 ELSE 90 END AS y0 FROM blocks)"


@query("j5_nearest_context", f"""
WITH {TABLES}, h AS (SELECT table_id, max_by(block_id, b.y1) AS block_id FROM placed p JOIN blocks b USING (doc_id, page) WHERE b.y1 <= p.y0 GROUP BY 1),
l AS (SELECT doc_id, page + 1 AS page, max_by(block_id, y1) AS before FROM blocks GROUP BY 1, 2)
SELECT p.table_id, coalesce(h.block_id, CASE WHEN y0 <= 200 THEN l.before END) AS block_id FROM placed p LEFT JOIN h USING (table_id) LEFT JOIN l USING (doc_id, page)""")
def nearest_context(spark, sf):
    return ln.nearest_context(placed_tables(spark, sf), fx.blocks(spark, sf))


@query("d15_parent_heading", f"""
WITH {TABLES} SELECT table_id, min(b.block_id) AS block_id FROM placed p JOIN blocks b USING (doc_id, page) WHERE b.y1 <= p.y0 + 20 AND b.y1 > p.y0 - 20 GROUP BY 1 HAVING count(*) = 1 AND NOT regexp_matches(min(text), '\\d')""")
def parent_heading(spark, sf):
    return ln.parent_heading(placed_tables(spark, sf).withColumn("y0", F.col("y0") + 20), fx.blocks(spark, sf))


@query("j12_neighbour_lookup", """
WITH c AS (SELECT doc_id, page, line AS char_id, doc_id * 1000 + line AS id, CAST((line * 7) % 40 AS DOUBLE) AS x, CAST(page AS DOUBLE) AS y FROM blocks)
SELECT a.id AS char_id, max_by(b.id, b.x * 100000 + b.id % 1000) AS left_id FROM c a JOIN c b USING (doc_id, page) WHERE b.x < a.x AND abs(b.y - a.y) < 0.5 AND a.x - b.x <= 20 GROUP BY 1""")
def neighbour_lookup(spark, sf):
    rows = fx.blocks(spark, sf).select("doc_id", "page", (F.col("doc_id") * 1000 + F.col("line")).alias("char_id"), ((F.col("line") * 7) % 40).cast("double").alias("x"), F.col("page").cast("double").alias("y"), F.lit(10.0).alias("size"))
    return ln.typography_anchors(rows)


@query("w7_table_continuation", """
WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 4 END AS columns, o_orderkey % 4 = 0 AS header, o_orderkey % 7 + 1 AS rows FROM orders),
u AS (SELECT *, sum(CASE WHEN NOT header AND lag_columns = columns THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page) AS whole FROM (SELECT *, lag(columns) OVER (PARTITION BY doc_id ORDER BY page) AS lag_columns FROM t))
SELECT table_id, first_value(table_id) OVER w AS first_id, CAST(coalesce(sum(rows) OVER (PARTITION BY doc_id, whole ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_offset FROM u WINDOW w AS (PARTITION BY doc_id, whole ORDER BY page)""")
def table_continuation(spark, sf):
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("table_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), F.when(k % 5 == 0, 3).otherwise(4).alias("columns"),
        F.lit(0.1).alias("top"), F.lit(0.9).alias("bottom"), (k % 4 == 0).alias("header"), (k % 7 + 1).alias("rows"),
    )
    return ln.table_continuation(rows)


@query("d10_cell_text", """
SELECT cell_id, string_agg(t, ' ' ORDER BY line) AS text FROM (SELECT l_orderkey AS cell_id, row // 3 AS line, string_agg(l_returnflag || l_linenumber, '' ORDER BY row % 3) AS t FROM items GROUP BY 1, 2) GROUP BY 1""")
def cell_text(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = fx.table(spark, sf, "lineitem").withColumn("row", F.row_number().over(w))
    y = F.floor(F.col("row") / 3) * 20.0
    return ln.cell_text(rows.select(F.col("l_orderkey").alias("cell_id"), (F.col("row") % 3 * 5.0).alias("x0"), y.alias("y0"), (y + 10).alias("y1"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text")))


@query("d19_chunk_template", """
SELECT table_id, string_agg(CASE WHEN col = 0 OR row = 0 THEN text END, ' | ' ORDER BY row, col) || chr(10) || 'xxxxx' || repeat('/x____', CAST(max(row) AS INT)) AS chunk FROM cells GROUP BY 1""")
def chunk_template(spark, sf):
    keep = (F.col("col") == 0) | (F.col("row") == 0)
    return ln.chunk_template(fx.cells(spark, sf).withColumn("text", F.when(keep, F.col("text")).otherwise(F.lit(""))))


@query("d20_routing_descriptors", """
WITH RECURSIVE up AS (SELECT node_id AS leaf, node_id, parent_id FROM nodes UNION ALL SELECT u.leaf, n.node_id, n.parent_id FROM up u JOIN nodes n ON n.node_id = u.parent_id),
f AS (SELECT u.node_id, min_by(l.text, l.ordinal) AS text, min_by(l.node_id, l.ordinal) AS source_id FROM up u JOIN nodes l ON l.node_id = u.leaf WHERE regexp_matches(l.text, '\\S') GROUP BY 1)
SELECT n.doc_id, n.node_id, f.source_id, regexp_extract(f.text, '^\\s*(?:\\S+\\s*){1,12}') AS intro, CAST(NULL AS VARCHAR) AS fault FROM nodes n JOIN f USING (node_id) WHERE n.kind IN ('document', 'section')""")
def routing_descriptors(spark, sf):
    n = fx.nodes(spark, sf)
    return ln.routing_descriptors(tr.tree_paths(n), n, ("document", "section"), 12)


@query("t7_diagnostics_page", "SELECT doc_id, line - 1 AS ordinal, text FROM blocks WHERE line - 1 >= 2 AND line - 1 < 5")
def diagnostics_page(spark, sf):
    reports = fx.blocks(spark, sf).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("ds"))
    rows = reports.select("doc_id", F.posexplode("ds").alias("ordinal", "text")).where("ordinal >= 2 and ordinal < 5")
    return rows.withColumn("ordinal", F.col("ordinal").cast("long"))


@query("l6_materialise_evidence", """
SELECT u.pack_id, u.evidence_id, sha256(u.excerpt) AS hash FROM units u JOIN orders o ON o.o_orderkey = u.pack_id WHERE o.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM claims c WHERE c.pack_id = u.pack_id AND list_contains(c.evidence_ids, u.evidence_id))""")
def materialise_evidence(spark, sf):
    done = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pack_id"))
    used = vf.cited(fx.claims(spark, sf).join(done, "pack_id", "left_semi")).select("pack_id", "evidence_id").distinct()
    return fx.units(spark, sf).join(used, ["pack_id", "evidence_id"], "left_semi").select("pack_id", "evidence_id", F.sha2("excerpt", 256).alias("hash"))


@query("e12_evidence_lookup", """
SELECT c.pack_id, c.claim_id, u.evidence_id, u.excerpt FROM (SELECT pack_id, claim_id, unnest(evidence_ids) AS evidence_id FROM claims) c JOIN units u USING (pack_id, evidence_id) JOIN orders o ON o.o_orderkey = c.pack_id
WHERE o.o_orderstatus = 'F' AND o.o_custkey % 11 <> 0""")
def evidence_lookup(spark, sf):
    runs = fx.table(spark, sf, "orders").where("o_orderstatus = 'F' and o_custkey % 11 <> 0").select(F.col("o_orderkey").alias("pack_id"))
    return vf.cited(fx.claims(spark, sf)).join(runs, "pack_id", "left_semi").join(fx.units(spark, sf), ["pack_id", "evidence_id"]).select("pack_id", "claim_id", "evidence_id", "excerpt")


@query("l8_cleanup_candidates", f"""
SELECT o_orderkey AS intent_id FROM orders WHERE o_orderdate + INTERVAL 1 HOUR <= {NOW} AND o_orderkey % 4 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def cleanup_candidates(spark, sf):
    o = fx.table(spark, sf, "orders").where((F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(1)) <= now()) & (F.col("o_orderkey") % 4 == 0)).select(F.col("o_orderkey").alias("object_id"), "o_orderdate")
    free = ct.unreferenced_objects(o, [fx.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("object_id"))])
    return free.orderBy("o_orderdate", "object_id").limit(100).select(F.col("object_id").alias("intent_id"))


CODES = ("", "PDF_INVALID", "SQLSTATE", "DEPENDENCY_UNAVAILABLE", "")


@query("l10_job_view", """
WITH j AS (SELECT version_id AS job_id, *, ['', 'PDF_INVALID', 'SQLSTATE', 'DEPENDENCY_UNAVAILABLE', ''][version_id % 5 + 1] AS raw, CASE version_id % 3 WHEN 0 THEN 'parsing' WHEN 1 THEN 'embedding' END AS stage FROM versions JOIN (SELECT doc_id, revoked FROM catalog) USING (doc_id)),
e AS (SELECT *, CASE raw WHEN '' THEN NULL WHEN 'SQLSTATE' THEN 'INTERNAL_ERROR' ELSE raw END AS code FROM j)
SELECT job_id, CASE WHEN NOT revoked THEN version_id END AS version_id, CASE WHEN NOT revoked THEN index_status END AS status, CASE WHEN NOT revoked THEN stage END AS stage, CASE WHEN NOT revoked THEN 1 + version_id % 3 END AS attempt, CASE WHEN NOT revoked THEN 3 END AS max_attempts,
  CASE WHEN NOT revoked THEN version_id % 101 END AS processed, CASE WHEN NOT revoked THEN 101 END AS total, CASE WHEN NOT revoked AND stage IS NOT NULL THEN CASE stage WHEN 'parsing' THEN 'pages' ELSE 'chunks' END END AS unit,
  CASE WHEN NOT revoked THEN CASE code WHEN 'PDF_INVALID' THEN 'The file could not be read.' WHEN 'DEPENDENCY_UNAVAILABLE' THEN 'A service is not available.' WHEN 'INTERNAL_ERROR' THEN 'The document could not be processed.' END END AS message,
  CASE WHEN NOT revoked AND code IS NOT NULL THEN version_id % 2 = 0 END AS retryable, CASE WHEN NOT revoked AND code IS NOT NULL THEN version_id || ':' || code END AS error_of, CASE WHEN revoked THEN 'SOURCE_REVOKED' ELSE code END AS error FROM e""")
def job_view(spark, sf):
    k = F.col("version_id")
    jobs = fx.versions(spark, sf).select(
        k.alias("job_id"), "version_id", "doc_id", F.col("index_status").alias("status"), F.when(k % 3 == 0, "parsing").when(k % 3 == 1, "embedding").alias("stage"), (1 + k % 3).alias("attempt"), (k % 101).alias("processed"), F.lit(101).alias("total"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]), (k % 5 + 1).cast("int")).alias("error"), (k % 2 == 0).alias("retryable"), F.lit(7).alias("last_sequence"),
    )
    out = ct.job_view(jobs, fx.documents(spark, sf))
    return out.withColumn("error_of", F.when(F.col("request_id").isNotNull(), F.concat("job_id", F.lit(":"), "error"))).drop("request_id")


@query("l11_document_detail", """
WITH v AS (SELECT doc_id, version_id, created_at, max(CASE WHEN version_id % 3 = 0 THEN created_at END) OVER (PARTITION BY doc_id) AS since, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC, version_id DESC) AS place FROM versions),
p AS (SELECT doc_id, list(version_id ORDER BY place) AS ids FROM v WHERE doc_id % 2 = 0 OR place > 2 GROUP BY 1), u AS (SELECT doc_id, max_by(publication_id, (published_at, publication_id)) AS publication FROM publications GROUP BY 1)
SELECT d.doc_id, CASE WHEN NOT revoked THEN title END AS title, CASE WHEN NOT revoked THEN publication END AS publication, CASE WHEN NOT revoked THEN coalesce(ids[1:4], []) END AS versions, CASE WHEN NOT revoked AND len(ids) > 4 THEN ids[4] END AS next, CASE WHEN revoked THEN 'SOURCE_REVOKED' END AS fault FROM catalog d LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id)""")
def document_detail(spark, sf):
    """Pages of four; those of odd documents go on after their second version."""
    v = fx.versions(spark, sf)
    newest = Window.partitionBy("doc_id").orderBy(F.col("created_at").desc(), F.col("version_id").desc())
    after = v.where("doc_id % 2 = 1").withColumn("place", F.row_number().over(newest)).where("place <= 2").groupBy("doc_id").agg(F.max_by(F.struct("created_at", "version_id"), "place").alias("c")).select("doc_id", "c.*")
    out = ct.document_detail(fx.documents(spark, sf), v, fx.publications(spark, sf), after, 4)
    return out.select("doc_id", "title", "publication", F.transform("versions", lambda x: x["version_id"]).alias("versions"), F.col("next.version_id").alias("next"), "fault")


@query("l11_version_detail", """
WITH g AS (SELECT version_id, version_id * 4 AS id, 'parse' AS kind, parse_status AS status, created_at AS at1, version_id % 30 + 1 AS pages FROM versions UNION ALL SELECT version_id, version_id * 4 + 1, 'parse', 'ready', created_at - INTERVAL 1 DAY, 99 FROM versions WHERE version_id % 3 = 0
  UNION ALL SELECT version_id, version_id * 4 + 2, 'index', index_status, created_at + INTERVAL 1 HOUR, NULL FROM versions WHERE parse_status = 'ready'),
n AS (SELECT version_id, list(id ORDER BY at1 DESC, id DESC) AS generations, max_by(pages, at1) FILTER (WHERE kind = 'parse' AND status = 'ready') AS pages FROM g GROUP BY 1), u AS (SELECT doc_id, max_by(publication_id, (published_at, publication_id)) AS publication FROM publications GROUP BY 1)
SELECT v.version_id, v.doc_id, CASE WHEN NOT revoked AND publication = v.version_id THEN publication END AS publication, CASE WHEN NOT revoked THEN pages END AS pages, CASE WHEN NOT revoked THEN generations END AS generations, CASE WHEN revoked THEN 'SOURCE_REVOKED' END AS fault FROM versions v JOIN n USING (version_id) JOIN catalog d ON d.doc_id = v.doc_id LEFT JOIN u ON u.doc_id = v.doc_id""")
def version_detail(spark, sf):
    v = fx.versions(spark, sf)
    k, none = F.col("version_id"), F.lit(None).cast("long")
    made = lambda rows, number, kind, status, at, pages: rows.select("version_id", (k * 4 + number).alias("generation_id"), F.lit(kind).alias("kind"), status.alias("status"), at.alias("created_at"), pages.alias("pages"))
    days = lambda **by: F.make_dt_interval(**{c: F.lit(n) for c, n in by.items()})
    parses = made(v, 0, "parse", F.col("parse_status"), F.col("created_at"), k % 30 + 1).unionByName(made(v.where(k % 3 == 0), 1, "parse", F.lit("ready"), F.col("created_at") - days(days=1), F.lit(99).cast("long")))
    indexes = made(v.where("parse_status = 'ready'"), 2, "index", F.col("index_status"), F.col("created_at") + days(hours=1), none)
    out = ct.version_detail(v, parses.unionByName(indexes), fx.publications(spark, sf), fx.documents(spark, sf))
    return out.withColumn("generations", F.transform("generations", lambda x: x["generation_id"]))


@query("v14_repair_targets", """
SELECT c.pack_id, c.claim_id, 'item ' || i.l_linenumber AS subject, u.excerpt AS value FROM claims c JOIN items i ON i.l_orderkey = c.pack_id AND i.row = c.claim_id JOIN units u ON u.pack_id = c.pack_id AND u.evidence_id = c.claim_id || '-3' WHERE NOT list_contains(c.evidence_ids, c.claim_id || '-3')""")
def repair_targets(spark, sf):
    u = fx.units(spark, sf)
    subject = u.where("col = 0 and row > 0").select("pack_id", F.col("row").alias("claim_id"), F.col("excerpt").alias("subject"))
    value = u.where("col = 3 and row > 0").select("pack_id", F.col("row").alias("claim_id"), F.col("evidence_id").alias("needed"), F.col("excerpt").alias("value"))
    missing = fx.claims(spark, sf).join(value, ["pack_id", "claim_id"]).where(~F.array_contains("evidence_ids", F.col("needed")))
    return missing.join(subject, ["pack_id", "claim_id"]).select("pack_id", "claim_id", "subject", "value")


@query("v12_citation_closure", """
WITH RECURSIVE o AS (SELECT pack_id, evidence_id, row, row * 5 + col AS position FROM units),
e AS (SELECT pack_id, row || '-' || col AS a, unnest(CASE WHEN col > 0 THEN ['0-' || col, row || '-0'] ELSE ['0-' || col] END) AS b FROM units WHERE row > 0 AND regexp_matches(excerpt, '[0-9]')),
s AS (SELECT DISTINCT e.pack_id, 0 AS kind, p.position AS at1, a AS start, a AS id FROM e JOIN o p ON p.pack_id = e.pack_id AND p.evidence_id = e.a UNION ALL SELECT pack_id, 1, row, 'row ' || row, unnest([row || '-0', row || '-1', row || '-2', row || '-3', '0-1', '0-2']) FROM units WHERE row > 0 AND col = 0),
c AS (SELECT * FROM s UNION SELECT c.pack_id, c.kind, c.at1, c.start, e.b FROM c JOIN e ON e.pack_id = c.pack_id AND e.a = c.id),
w AS (SELECT c.pack_id, kind, at1, start, list(c.id ORDER BY CASE WHEN o.position % 5 = 0 AND o.row > 0 THEN 0 WHEN o.row > 0 AND EXISTS (SELECT 1 FROM e WHERE e.pack_id = c.pack_id AND e.a = c.id) THEN 1 ELSE 2 END, o.position) AS ids FROM c JOIN o ON o.pack_id = c.pack_id AND o.evidence_id = c.id GROUP BY 1, 2, 3, 4)
SELECT pack_id, start, ids FROM w WHERE len(ids) <= 8 QUALIFY row_number() OVER (PARTITION BY pack_id, ids ORDER BY kind, at1, start) = 1""")
def citation_closure(spark, sf):
    """Cells need the header above and the subject of their row; rows are cited whole, with two of their headers."""
    u = fx.units(spark, sf).withColumn("position", F.col("row") * 5 + F.col("col"))
    head, side = F.concat(F.lit("0-"), F.col("col").cast("string")), F.concat(F.col("row").cast("string"), F.lit("-0"))
    beside = F.when(F.col("col") > 0, F.array(side)).otherwise(F.array().cast("array<string>"))
    groups = u.where("row > 0").select("pack_id", F.col("evidence_id").alias("trigger"), F.concat(F.array(head), beside).alias("required"), beside.alias("subjects"))
    options = vf.row_options(u).withColumn("complete", F.concat("complete", F.array(F.lit("0-1"), F.lit("0-2"))))
    return vf.citation_closures(u, groups, options, 8)


@query("v18_artifact_lineage", """
SELECT e.event_id, CASE WHEN p.event_id IS NULL THEN 'missing_parent' WHEN p.user_id <> e.user_id THEN 'other_run' WHEN p.event_type = 'error' THEN 'failed_parent' END AS fault FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 7 WHERE p.event_id IS NULL OR p.user_id <> e.user_id OR p.event_type = 'error'""")
def artifact_lineage(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.col("event_id") - 7).alias("parent"))
    return vf.artifact_lineage(e.select(F.col("event_id").alias("artifact_id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("status"), F.array("parent").alias("parents")), "error").select(F.col("artifact_id").alias("event_id"), "fault")


@query("r2_run_state", STATES.format(agg="(aggregate_id * 10 + event_id % 3)"))
def run_state(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("progress")
    return ev.job_state(fx.log(spark, sf).withColumns({"kind": kind, "aggregate_id": F.col("aggregate_id") * 10 + F.col("event_id") % 3}))


@query("l2_apply_publications", """
WITH RECURSIVE q AS (SELECT doc_id, version_id, row_number() OVER w AS k, CASE WHEN version_id % 6 = 0 THEN -1 ELSE lag(version_id) OVER w END AS expected FROM versions WINDOW w AS (PARTITION BY doc_id ORDER BY created_at, version_id)),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS version_id, CAST(NULL AS BIGINT) AS current, '' AS outcome FROM q WHERE k = 1
  UNION ALL SELECT q.doc_id, q.k, q.version_id, CASE WHEN q.expected IS NOT DISTINCT FROM r.current THEN q.version_id ELSE r.current END, CASE WHEN q.expected IS NOT DISTINCT FROM r.current THEN 'applied' ELSE 'conflict' END FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k + 1)
SELECT doc_id, version_id AS operation_id, outcome, first_value(current) OVER (PARTITION BY doc_id ORDER BY k DESC) AS current FROM r QUALIFY k > 0""")
def apply_publications(spark, sf):
    v = fx.versions(spark, sf)
    w = Window.partitionBy("doc_id").orderBy("created_at", "version_id")
    return ct.apply_publications(v.select("doc_id", "version_id", F.col("version_id").alias("operation_id"), F.row_number().over(w).alias("order"), F.when(F.col("version_id") % 6 == 0, F.lit(-1)).otherwise(F.lag("version_id").over(w)).alias("expected")))


def _two(name: str, cols: str) -> str:
    return f"""{name}_pairs AS (SELECT l.doc_id, l.page, (l.y0 + l.y1) / 2 AS y FROM {cols} l JOIN {cols} r ON r.doc_id = l.doc_id AND r.page = l.page AND r.x0 > 282 AND l.x1 < 318 AND l.x0 < 240 AND r.x0 - l.x1 > 18 AND least(l.y1, r.y1) - greatest(l.y0, r.y0) > 4
  WHERE NOT EXISTS (SELECT 1 FROM {cols} o WHERE o.doc_id = l.doc_id AND o.page = l.page AND o.block_id NOT IN (l.block_id, r.block_id) AND o.x0 < r.x0 AND o.x1 > l.x1 AND least(o.y1, l.y1) - greatest(o.y0, l.y0) > 0.4 * (least(l.y1, r.y1) - greatest(l.y0, r.y0)))),
{name} AS (SELECT doc_id, page FROM (SELECT doc_id, page, y, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS b FROM (SELECT DISTINCT doc_id, page, y FROM {name}_pairs)) WHERE b IS NULL OR y - b > 6 GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("d28_recheck_columns", f"WITH {COLUMNS}, free AS (SELECT * FROM cols WHERE line % 3 <> 0), {_two('all_pages', 'cols')}, {_two('free_pages', 'free')} SELECT doc_id, page FROM all_pages JOIN free_pages USING (doc_id, page)")
def recheck_columns(spark, sf):
    from attestra.operators import layout as lo
    from attestra.plans.structure_queries import columns

    b = columns(spark, sf)
    owned = b.where("line % 3 = 0").select("block_id")
    flagged = lo.two_column_pages(lo.column_pairs(b)).select("doc_id", "page")
    return lo.recheck_columns(flagged, b, owned)


@query("e2_anchor_closure", """
WITH RECURSIVE n AS (SELECT node_id, doc_id, ordinal FROM nodes WHERE ordinal > 0),
r AS (SELECT node_id, doc_id, ordinal, 0 AS round FROM n WHERE ordinal % 12 = 0
  UNION ALL SELECT n.node_id, n.doc_id, n.ordinal, round + 1 FROM r JOIN n ON n.doc_id = r.doc_id AND n.ordinal = r.ordinal // 2 WHERE r.ordinal % 4 = 0 AND round < 4),
f AS (SELECT doc_id AS query_id, node_id, CAST(min(round) AS INTEGER) AS round FROM r GROUP BY 1, 2), o AS (SELECT query_id FROM f GROUP BY 1 HAVING count(*) > 6 OR max(round) = 4)
SELECT query_id, node_id, round, CAST(NULL AS VARCHAR) AS fault FROM f WHERE query_id NOT IN (SELECT query_id FROM o) UNION ALL SELECT query_id, NULL, NULL, 'EXPANSION_LIMIT' FROM o""")
def anchor_closure(spark, sf):
    from attestra.operators import evidence as evd

    n = fx.nodes(spark, sf).where("ordinal > 0")
    spans = n.select("node_id", F.col("doc_id").alias("block_key"), F.col("ordinal").alias("start"), (F.col("ordinal") + 1).alias("end"))
    refs = n.where("ordinal % 4 = 0").select("node_id", F.col("doc_id").alias("block_key"), (F.col("ordinal") / 2).cast("long").alias("start_b"), (F.col("ordinal") / 2 + 1).cast("long").alias("end_b"))
    return evd.anchor_closure(n.where("ordinal % 12 = 0").select(F.col("doc_id").alias("query_id"), "node_id"), spans, refs, 4, 6)


@query("e5_reference_ranges", """
SELECT a.block_id, a.start, a."end", coalesce(sum(greatest(0, least(a."end", b."end") - greatest(a.start, b.start))), 0) AS covered FROM (SELECT block_id, n // 4 AS start, n AS "end" FROM spans WHERE part = 1 AND n // 4 < n) a
LEFT JOIN spans b ON b.block_id = a.block_id AND b.part = 2 AND a.start < b."end" AND b.start < a."end" GROUP BY 1, 2, 3""")
def reference_ranges(spark, sf):
    from attestra.operators import evidence as evd

    s = fx.spans(spark, sf)
    anchors = s.where("part = 1").select("block_id", F.floor(F.col("n") / 4).alias("start"), F.col("n").alias("end")).where("start < end")
    segments = s.where("part = 2").select("block_id", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    return evd.reference_ranges(anchors, segments, ["block_id"])


@query("e3_expand_hits", """
WITH RECURSIVE hits AS (SELECT node_id FROM nodes WHERE ordinal % 9 = 4), up AS (SELECT node_id AS hit_id, node_id, 0 AS k FROM hits UNION ALL SELECT u.hit_id, n.parent_id, k + 1 FROM up u JOIN nodes n ON n.node_id = u.node_id WHERE n.parent_id IS NOT NULL)
SELECT hit_id, node_id, min_by(relation, rank) AS relation FROM (SELECT hit_id, node_id, CASE WHEN k = 0 THEN 'hit' ELSE 'scope' END AS relation, CASE WHEN k = 0 THEN 0 ELSE 1 END AS rank FROM up
  UNION ALL SELECT h.node_id, c.node_id, 'note', 2 FROM hits h JOIN nodes p ON p.node_id = h.node_id JOIN nodes c ON c.parent_id = p.parent_id WHERE c.kind = 'paragraph') GROUP BY 1, 2""")
def expand_hits(spark, sf):
    from attestra.operators import evidence as evd

    n = fx.nodes(spark, sf)
    return evd.expand_hits(n.where("ordinal % 9 = 4").select("node_id"), n, tr.ancestry(n, n.where("ordinal % 9 = 4").select("node_id")), ("paragraph",))


@query("e3_expand_rows", """
WITH h AS (SELECT DISTINCT table_id, 1 + table_id % 3 AS row FROM cells), c AS (SELECT table_id, row, col, CASE WHEN row % 5 = 4 AND col = 4 THEN ' ' ELSE text END AS text FROM cells), o AS (SELECT table_id, row FROM h WHERE EXISTS (SELECT 1 FROM c WHERE c.table_id = h.table_id AND c.row = h.row))
SELECT o.table_id AS hit_id, c.table_id, c.row, c.col, CASE WHEN c.row = 0 THEN 'header' WHEN c.row = o.row THEN 'hit' ELSE 'table' END AS relation FROM o JOIN c ON c.table_id = o.table_id AND (c.row IN (0, o.row) OR c.row = CASE WHEN o.row % 2 = 1 THEN o.row + 1 ELSE o.row - 1 END) WHERE trim(c.text) <> ''""")
def expand_rows(spark, sf):
    """Every even row goes on from the subject of the row before it."""
    from attestra.operators import evidence as evd

    row, rows = F.col("row"), fx.cells(spark, sf)
    follows = F.concat(F.lit("item "), (row - (row + 1) % 2).cast("string"), F.when(row % 2 == 0, " bis").otherwise(""))
    cells = rows.withColumn("text", F.when((row % 5 == 4) & (F.col("col") == 4), " ").when((row > 0) & (F.col("col") == 0), follows).otherwise(F.col("text")))
    order = F.col("l_orderkey")
    hits = fx.items(spark, sf).where(row == 1 + order % 3).select(order.alias("hit_id"), order.alias("table_id"), "row")
    return evd.expand_rows(hits, cells)


#: The rows of an order as options: a limit, its refinements by part, and rows of another table or path.
OPTIONS = """options AS (SELECT l_orderkey AS pack_id, row AS option, row, row % 4 // 3 AS table_id, CASE WHEN row % 5 = 4 THEN 'annex' ELSE 'body' END AS path,
    CASE WHEN row = 1 THEN 'Limit of ПРИЁМ ' WHEN row % 3 = 0 THEN 'The limit of прием, part ' || row ELSE 'limit of прием for part ' || row END AS subject, [row || '-0'] AS subjects, [row || '-1', row || '-2'] AS values, [row || '-0', row || '-1', row || '-2', '0-1'] AS complete FROM items),
said AS (SELECT *, replace(replace(lower(subject), 'ё', 'е'), ',', '') AS plain FROM options), worded AS (SELECT *, list_filter(string_split(plain, ' '), lambda x: x <> '') AS w FROM said),
hits AS (SELECT a.pack_id, a.option AS base, b.option FROM worded a JOIN worded b ON b.pack_id = a.pack_id AND b.table_id = a.table_id AND b.path = a.path AND len(b.w) > len(a.w) AND contains(' ' || array_to_string(b.w, ' ') || ' ', ' ' || array_to_string(a.w, ' ') || ' ')),
variants AS (SELECT pack_id, base, list_sort(list(DISTINCT option) || [base]) AS members FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits i WHERE i.pack_id = h.pack_id AND i.option = h.base) GROUP BY 1, 2)"""


def variant_options(spark, sf):
    row = F.col("row")
    rows = fx.cells(spark, sf).where("row > 0 and col = 0").select(F.col("table_id").alias("pack_id"), "row")
    part = row.cast("string")
    subject = F.when(row == 1, "Limit of ПРИЁМ ").when(row % 3 == 0, F.concat(F.lit("The limit of прием, part "), part)).otherwise(F.concat(F.lit("limit of прием for part "), part))
    unit = lambda c: F.concat(part, F.lit(f"-{c}"))
    return rows.select(
        "pack_id", row.alias("option"), "row", F.floor(row % 4 / 3).alias("table_id"), F.when(row % 5 == 4, "annex").otherwise("body").alias("path"), subject.alias("subject"),
        F.array(unit(0)).alias("subjects"), F.array(unit(1), unit(2)).alias("values"), F.array(unit(0), unit(1), unit(2), F.lit("0-1")).alias("complete"),
    )


@query("v6_variant_groups", f"WITH {OPTIONS} SELECT * FROM variants")
def variant_groups(spark, sf):
    return vf.variant_groups(variant_options(spark, sf))


@query("v8_missing_variants", f"""
WITH {OPTIONS}, cited AS (SELECT pack_id, list_distinct(flatten(list(evidence_ids))) AS cited FROM claims GROUP BY 1),
asked AS (SELECT o_orderkey AS pack_id, CASE o_orderkey % 4 WHEN 0 THEN 'What is the limit of прием for part 2?' WHEN 1 THEN 'Is "Limit of приём " in force?' WHEN 2 THEN 'The limit, part 3' ELSE 'And?' END AS question FROM orders),
m AS (SELECT v.pack_id, v.base, unnest(v.members) AS option FROM variants v WHERE len(v.members) > 1),
x AS (SELECT m.base, w.*, c.cited, a.question, list_distinct(regexp_extract_all(lower(a.question), '[\\pL\\d]+')) AS q FROM m JOIN worded w ON w.pack_id = m.pack_id AND w.option = m.option JOIN cited c ON c.pack_id = m.pack_id JOIN asked a ON a.pack_id = m.pack_id),
t AS (SELECT *, bool_or(list_has_any(cited, values)) OVER (PARTITION BY pack_id, base) AS touched FROM x),
words AS (SELECT pack_id, base, option, word, count(*) OVER (PARTITION BY pack_id, base, word) AS n FROM (SELECT pack_id, base, option, unnest(list_distinct(w)) AS word FROM t)),
own AS (SELECT pack_id, base, option, list(word) AS own FROM words WHERE n = 1 GROUP BY 1, 2, 3),
s AS (SELECT t.*, (pack_id % 4 = 1 AND plain = 'limit of прием ') OR (option <> base AND own IS NOT NULL AND len(list_filter(own, lambda k: NOT list_contains(q, k))) = 0) AS chosen FROM t LEFT JOIN own USING (pack_id, base, option) WHERE touched),
r AS (SELECT *, bool_or(chosen) OVER (PARTITION BY pack_id, base) AS any_chosen FROM s),
l AS (SELECT pack_id, base, option, row, list_filter(list_concat(subjects, values), lambda k: NOT list_contains(cited, k)) AS lacks, list_filter(complete, lambda k: NOT list_contains(cited, k)) AS rest FROM r WHERE chosen OR NOT any_chosen)
SELECT pack_id, number, row, missing FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pack_id ORDER BY base, option) AS INTEGER) AS number, CASE WHEN len(lacks) > 0 THEN lacks ELSE rest END AS missing FROM l WHERE len(rest) > 0) WHERE number <= 12""")
def missing_variants(spark, sf):
    options, k = variant_options(spark, sf), F.col("o_orderkey")
    question = F.when(k % 4 == 0, "What is the limit of прием for part 2?").when(k % 4 == 1, 'Is "Limit of приём " in force?').when(k % 4 == 2, "The limit, part 3").otherwise("And?")
    questions = fx.table(spark, sf, "orders").select(k.alias("pack_id"), question.alias("question"))
    return vf.missing_variants(questions, fx.claims(spark, sf), options, vf.variant_groups(options))


@query("v16_refusal_check", """
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 = 0 WHEN o_orderkey % 4 = 1 THEN o_orderkey % 5 = 0 WHEN o_orderkey % 4 = 2 THEN o_orderkey % 7 <> 0 ELSE o_orderkey % 8 = 3 END AS proven FROM orders""")
def refusal_check(spark, sf):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf, "orders")
    results = o.select(k.alias("run_id"), F.element_at(F.array(*[F.lit(c) for c in ("OUT_OF_SCOPE", "EVIDENCE_NOT_FOUND", "VERIFICATION_FAILED", "OUTPUT_SCHEMA_INVALID")]), (k % 4 + 1).cast("int")).alias("code"))
    artifacts = o.select(k.alias("run_id"), F.lit("router").alias("role"), F.when(k % 3 == 0, "out_of_scope").otherwise("answer").alias("outcome")).unionByName(
        o.where(k % 7 != 0).select(k.alias("run_id"), F.lit("critic").alias("role"), F.lit("refuse").alias("outcome"))
    ).unionByName(o.where(k % 8 == 3).select(k.alias("run_id"), F.lit("drafter").alias("role"), F.lit("failed").alias("outcome")))
    packs = o.where(k % 5 != 0).select(k.alias("run_id"), F.lit(3).alias("units"))
    return vf.refusal_check(results, artifacts, packs)
