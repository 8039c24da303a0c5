"""Engine tables derived from the driver's tables, as DataFrames and as DuckDB common table expressions.

Each function is deterministic and scales with its source table. CTES has the same tables for the oracle, and
`with_ctes` puts those that a query names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows, dealt anew where its files make fewer tasks than there are cores, for work that is mostly CPU."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Line items of a task. Their cells, some six times as many, are sorted and grouped within its memory.
ITEMS = 250_000


def items(spark, sf_dir) -> DataFrame:
    """Line items with `row`, their place in their order.

    They are dealt by order to as many tasks as their number asks for, whatever the session's shuffle partitions: what
    goes on by order (cells, units, claims, and joins and groups of these) takes place within these tasks.
    """
    rows = table(spark, sf_dir, "lineitem")
    tasks = -(-rows.count() // ITEMS)
    if tasks > 1:
        rows = rows.repartition(max(tasks, spark.sparkContext.defaultParallelism), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.withColumn("row", F.row_number().over(w).cast("long"))


CTES: dict[str, str] = {}


def blocks(spark, sf_dir) -> DataFrame:
    """Non-empty lines of documents, two to a page of 600 by 800."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("k", "text"))
    line = (F.col("k") + 1).cast("long")
    y0 = 100.0 + 20 * (F.col("k") % 2)
    return rows.select(
        "doc_id", line.alias("line"), F.concat_ws("-", "doc_id", line).alias("block_id"), (1 + F.floor(F.col("k") / 2)).cast("long").alias("page"),
        "text", F.lit(50.0).alias("x0"), y0.alias("y0"), (50.0 + 5 * F.least(F.length("text"), F.lit(100))).alias("x1"), (y0 + 10).alias("y1"),
    )


CTES["blocks"] = """
  SELECT doc_id, line, doc_id || '-' || line AS block_id, 1 + (line - 1) // 2 AS page, text, CAST(50 AS DOUBLE) AS x0,
    CAST(100 + 20 * ((line - 1) % 2) AS DOUBLE) AS y0, CAST(50 + 5 * least(length(text), 100) AS DOUBLE) AS x1, CAST(110 + 20 * ((line - 1) % 2) AS DOUBLE) AS y1
  FROM (SELECT doc_id, unnest(l) AS text, CAST(generate_subscripts(l, 1) AS BIGINT) AS line
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents))"""


def page_blocks(spark, sf_dir) -> DataFrame:
    """Blocks and, on every page, one header line."""
    body = blocks(spark, sf_dir)
    head = body.groupBy("doc_id", "page").agg(F.count("*").alias("_n")).select(
        "doc_id", F.lit(0).cast("long").alias("line"), F.concat_ws("-", "doc_id", F.lit("h"), "page").alias("block_id"), "page",
        F.concat(F.lit("Doc "), "doc_id", F.lit(" p "), "page").alias("text"), F.lit(50.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(120.0).alias("x1"), F.lit(30.0).alias("y1"),
    )
    return body.unionByName(head)


CTES["page_blocks"] = """
  SELECT * FROM blocks UNION ALL
  SELECT DISTINCT doc_id, 0, doc_id || '-h-' || page, page, 'Doc ' || doc_id || ' p ' || page, CAST(50 AS DOUBLE), CAST(20 AS DOUBLE), CAST(120 AS DOUBLE), CAST(30 AS DOUBLE) FROM blocks"""


def spans(spark, sf_dir) -> DataFrame:
    """Two spans a block: overlapping in even documents, adjacent in odd ones."""
    n = F.length("text").cast("long")
    start = F.when(F.col("doc_id") % 2 == 0, F.floor(n / 3)).otherwise(F.floor(n / 2))
    pairs = F.array(F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("start"), F.floor(n / 2).alias("end")), F.struct(F.lit(2).alias("part"), start.alias("start"), n.alias("end")))
    return blocks(spark, sf_dir).select("doc_id", "page", "line", "block_id", F.length("text").cast("long").alias("n"), F.explode(pairs).alias("s")).select("doc_id", "page", "line", "block_id", "n", "s.part", "s.start", "s.end")


CTES["spans"] = """
  SELECT doc_id, page, line, block_id, length(text) AS n, 1 AS part, CAST(0 AS BIGINT) AS start, length(text) // 2 AS "end" FROM blocks UNION ALL
  SELECT doc_id, page, line, block_id, length(text), 2, CASE WHEN doc_id % 2 = 0 THEN length(text) // 3 ELSE length(text) // 2 END, length(text) FROM blocks"""


def nodes(spark, sf_dir) -> DataFrame:
    """A tree for each document: root 0, sections at every fifth line, clauses at other even lines, else paragraphs."""
    kind = F.when(F.col("line") % 5 == 0, "section").when(F.col("line") % 2 == 0, "clause").otherwise("paragraph")
    rows = blocks(spark, sf_dir).select("doc_id", "line", kind.alias("kind"), "page", "text")
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    section = F.max(F.when(F.col("kind") == "section", F.col("line"))).over(before)
    clause = F.max(F.when(F.col("kind") == "clause", F.col("line"))).over(before)
    rows = rows.withColumns({"s": F.coalesce(section, F.lit(0)), "c": F.coalesce(clause, F.lit(0))})
    parent = F.when(F.col("kind") == "section", 0).when(F.col("kind") == "clause", F.col("s")).otherwise(F.greatest("s", "c"))
    node = lambda c: (F.col("doc_id") * 100_000 + c).cast("long")
    rows = rows.select("doc_id", node(F.col("line")).alias("node_id"), node(parent).alias("parent_id"), F.col("line").alias("ordinal"), "kind", "page", "text")
    root = table(spark, sf_dir, "documents").select("doc_id", node(F.lit(0)).alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ordinal"), F.lit("document").alias("kind"), F.lit(1).cast("long").alias("page"), F.lit("").alias("text"))
    return rows.unionByName(root)


CTES["nodes"] = """
  SELECT doc_id, doc_id * 100000 + line AS node_id, doc_id * 100000 + CASE kind WHEN 'section' THEN 0 WHEN 'clause' THEN s ELSE greatest(s, c) END AS parent_id,
    line AS ordinal, kind, page, text
  FROM (SELECT *, coalesce(max(CASE WHEN kind = 'section' THEN line END) OVER w, 0) AS s, coalesce(max(CASE WHEN kind = 'clause' THEN line END) OVER w, 0) AS c
    FROM (SELECT *, CASE WHEN line % 5 = 0 THEN 'section' WHEN line % 2 = 0 THEN 'clause' ELSE 'paragraph' END AS kind FROM blocks)
    WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  UNION ALL SELECT doc_id, doc_id * 100000, NULL, 0, 'document', 1, '' FROM documents"""


def chunks(spark, sf_dir) -> DataFrame:
    """Documents cut after every forty words."""
    pieces = F.regexp_extract_all("text", F.lit(r"\S++(?:\s++\S++){0,39}+"), F.lit(0))  # one scan of a text, however long it is
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(pieces).alias("ordinal", "piece"))
    return rows.select(
        (F.col("doc_id") * 1000 + F.col("ordinal")).alias("chunk_id"), "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "lang", "source", F.split("piece", r"\s+").alias("words"),
    )


CTES["chunks"] = """
  SELECT doc_id * 1000 + ordinal AS chunk_id, doc_id, ordinal, lang, source, w[ordinal * 40 + 1:ordinal * 40 + 40] AS words
  FROM (SELECT doc_id, lang, source, w, unnest(range(0, (len(w) - 1) // 40 + 1)) AS ordinal
    FROM (SELECT doc_id, lang, source, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)"""


def cells(spark, sf_dir) -> DataFrame:
    """A table for each order: a header row 0 and a row for each line item, of five columns."""
    num = lambda c: F.format_string("%.2f", c)
    texts = F.concat(F.lit("item "), F.col("l_linenumber").cast("string")), num("l_quantity"), num("l_extendedprice"), num("l_discount"), F.col("l_returnflag")
    line = lambda row, texts: F.array(*[F.struct(row.alias("row"), F.lit(k).cast("long").alias("col"), x.alias("text")) for k, x in enumerate(texts)])
    body, head = line(F.col("row"), texts), line(F.lit(0).cast("long"), [F.lit(x) for x in ("Item", "Quantity", "Price", "Discount", "Flag")])
    return items(spark, sf_dir).select(F.col("l_orderkey").alias("table_id"), F.inline(F.when(F.col("row") == 1, F.concat(head, body)).otherwise(body)))


CTES["items"] = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row FROM lineitem"
CTES["cells"] = """
  SELECT l_orderkey AS table_id, row, CAST(unnest(range(0, 5)) AS BIGINT) AS col,
    unnest(['item ' || l_linenumber, printf('%.2f', l_quantity), printf('%.2f', l_extendedprice), printf('%.2f', l_discount), l_returnflag]) AS text FROM items
  UNION ALL SELECT l_orderkey, 0, CAST(unnest(range(0, 5)) AS BIGINT), unnest(['Item', 'Quantity', 'Price', 'Discount', 'Flag']) FROM items WHERE row = 1"""


def claims(spark, sf_dir) -> DataFrame:
    """A claim for each line item: its quantity and price, citing its cells; every seventh number is wrong, every
    eleventh cites an unknown id, every thirteenth repeats a text."""
    rows = items(spark, sf_dir)
    k = F.col("l_orderkey") + F.col("row")
    price = F.when(k % 7 == 0, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice"))
    text = F.when(k % 13 == 0, F.lit("The order is complete.")).otherwise(F.concat(F.lit("Quantity "), F.format_string("%.2f", "l_quantity"), F.lit(" at price "), F.format_string("%.2f", price), F.lit(".")))
    unit = lambda c: F.concat_ws("-", F.col("row"), F.lit(c))
    ids = F.when(k % 13 == 0, F.array(F.lit("0-0"))).when(k % 11 == 0, F.array(unit(1), F.lit("none"))).otherwise(F.array(unit(1), unit(2)))
    return rows.select(F.col("l_orderkey").alias("pack_id"), F.col("row").alias("claim_id"), text.alias("text"), ids.alias("evidence_ids"))


CTES["claims"] = """
  SELECT l_orderkey AS pack_id, row AS claim_id,
    CASE WHEN (l_orderkey + row) % 13 = 0 THEN 'The order is complete.' ELSE 'Quantity ' || printf('%.2f', l_quantity) || ' at price ' || printf('%.2f', l_extendedprice + CASE WHEN (l_orderkey + row) % 7 = 0 THEN 1 ELSE 0 END) || '.' END AS text,
    CASE WHEN (l_orderkey + row) % 13 = 0 THEN ['0-0'] WHEN (l_orderkey + row) % 11 = 0 THEN [row || '-1', 'none'] ELSE [row || '-1', row || '-2'] END AS evidence_ids FROM items"""


def units(spark, sf_dir) -> DataFrame:
    """Evidence units: the cells of an order's table."""
    return cells(spark, sf_dir).select(F.col("table_id").alias("pack_id"), F.concat_ws("-", "row", "col").alias("evidence_id"), "row", "col", F.col("text").alias("excerpt"))


CTES["units"] = "SELECT table_id AS pack_id, row || '-' || col AS evidence_id, row, col, text AS excerpt FROM cells"


def log(spark, sf_dir) -> DataFrame:
    """Events as an append-only log: aggregate, gap-free sequence and stage."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("aggregate_id"), F.row_number().over(w).cast("long").alias("sequence"), "event_type", "ts", "value", "props",
    )


CTES["log"] = "SELECT event_id, user_id AS aggregate_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_type, ts, value, props FROM events"


def versions(spark, sf_dir) -> DataFrame:
    """Document versions: orders of a customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 == 0, "repealed").otherwise("active").alias("legal_status"),
        F.when(F.col("o_orderkey") % 4 == 0, "draft").otherwise("published").alias("publication_status"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 9 == 0, "failed").otherwise("ready").alias("parse_status"), F.when(F.col("o_orderkey") % 10 == 0, "staging").otherwise("ready").alias("index_status"), F.col("o_totalprice").alias("size"),
    )


CTES["versions"] = """
  SELECT o_orderkey AS version_id, o_custkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'repealed' ELSE 'active' END AS legal_status,
    CASE WHEN o_orderkey % 4 = 0 THEN 'draft' ELSE 'published' END AS publication_status, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'ready' END AS parse_status, CASE WHEN o_orderkey % 10 = 0 THEN 'staging' ELSE 'ready' END AS index_status, o_totalprice AS size FROM orders"""


def documents(spark, sf_dir) -> DataFrame:
    """Catalogue documents: customers."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), (F.col("c_custkey") % 6 == 0).alias("archived"), (F.col("c_custkey") % 11 == 0).alias("revoked"), F.col("c_mktsegment").alias("kind"),
    )


CTES["catalog"] = "SELECT c_custkey AS doc_id, c_name AS title, c_custkey % 6 = 0 AS archived, c_custkey % 11 = 0 AS revoked, c_mktsegment AS kind FROM customer"


def publications(spark, sf_dir) -> DataFrame:
    """Published versions in order; the latest of a document is current."""
    return versions(spark, sf_dir).where("publication_status = 'published'").select(F.col("version_id").alias("publication_id"), "doc_id", "version_id", F.col("created_at").alias("published_at"))


CTES["publications"] = "SELECT version_id AS publication_id, doc_id, version_id, created_at AS published_at FROM versions WHERE publication_status = 'published'"

_NEEDS = {
    "page_blocks": ["blocks"], "spans": ["blocks"], "nodes": ["blocks"], "cells": ["items"], "claims": ["items"], "units": ["items", "cells"], "publications": ["versions"],
}


def with_ctes(sql: str) -> str:
    """`sql` (one SELECT, or WITH ... SELECT) with the fixture tables that it names before it."""
    named: list[str] = []
    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            for x in [*_NEEDS.get(name, []), name]:
                if x not in named:
                    named.append(x)
    if not named:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in CTES if n in named)
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"(?i)with\s+recursive\b", body) else ""
    body = re.sub(r"(?i)^with\s+(recursive\s+)?", ", ", body) if re.match(r"(?i)with\b", body) else "\n" + body
    return f"WITH {recursive}{head}{body}"
