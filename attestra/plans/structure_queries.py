"""Queries of page layout, tables, document trees and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import layout as lo, tree as tr
from attestra.plans import fixtures as fx
from attestra.plans.book import query


@query("a1_boilerplate", """
SELECT doc_id, block_id, 'repeated_header' AS reason, pages FROM page_blocks JOIN (SELECT doc_id, max(page) AS pages FROM blocks GROUP BY 1 HAVING max(page) >= 3) USING (doc_id) WHERE y1 <= 72""")
def boilerplate(spark, sf):
    return lo.boilerplate(fx.page_blocks(spark, sf))


def columns(spark, sf):
    """Blocks dealt to a left and a right column where the document's id is even; every sixth line is wide."""
    b = fx.blocks(spark, sf)
    two = (F.col("doc_id") % 2 == 0) & (F.col("line") % 6 != 0)
    right = two & (F.col("line") % 2 == 0)
    k = F.col("line") - 1
    y = 100.0 + 20 * F.floor(k % 24 / 2)
    return b.select(
        "doc_id", (1 + F.floor(k / 24)).cast("long").alias("page"), "line", "block_id", F.when(right, 320.0).otherwise(50.0).alias("x0"), y.cast("double").alias("y0"),
        F.when(right, 560.0).when(two, 280.0).otherwise(560.0).alias("x1"), (y + 10).cast("double").alias("y1"),
    )


COLUMNS = """cols AS (SELECT doc_id, 1 + (line - 1) // 24 AS page, line, block_id, CAST(CASE WHEN doc_id % 2 = 0 AND line % 6 <> 0 AND line % 2 = 0 THEN 320 ELSE 50 END AS DOUBLE) AS x0,
  CAST(100 + 20 * (((line - 1) % 24) // 2) AS DOUBLE) AS y0, CAST(CASE WHEN doc_id % 2 = 0 AND line % 6 <> 0 THEN CASE WHEN line % 2 = 0 THEN 560 ELSE 280 END ELSE 560 END AS DOUBLE) AS x1, CAST(110 + 20 * (((line - 1) % 24) // 2) AS DOUBLE) AS y1 FROM blocks)"""
PAIRS = """pairs AS (SELECT l.doc_id, l.page, l.block_id AS l_block_id, r.block_id AS r_block_id, (l.y0 + l.y1) / 2 AS y FROM cols l JOIN cols r ON r.doc_id = l.doc_id AND r.page = l.page AND r.x0 > 282 AND l.x1 < 318 AND l.x0 < 240
  AND r.x0 - l.x1 > 18 AND least(l.y1, r.y1) - greatest(l.y0, r.y0) > 4 WHERE NOT EXISTS (SELECT 1 FROM cols o WHERE o.doc_id = l.doc_id AND o.page = l.page AND o.block_id NOT IN (l.block_id, r.block_id) AND o.x0 < r.x0 AND o.x1 > l.x1
    AND least(o.y1, l.y1) - greatest(o.y0, l.y0) > 0.4 * (least(l.y1, r.y1) - greatest(l.y0, r.y0))))"""


@query("j8_column_pairs", f"WITH {COLUMNS}, {PAIRS} SELECT * FROM pairs")
def column_pairs(spark, sf):
    return lo.column_pairs(columns(spark, sf))


@query("t6_reading_order", f"""
WITH {COLUMNS}, {PAIRS}, heights AS (SELECT doc_id, page, y, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS before FROM (SELECT DISTINCT doc_id, page, y FROM pairs)),
two AS (SELECT doc_id, page FROM heights WHERE before IS NULL OR y - before > 6 GROUP BY 1, 2 HAVING count(*) >= 3),
placed AS (SELECT c.*, t.page IS NOT NULL AS two, CASE WHEN x1 < 318 AND x0 < 240 THEN 0 WHEN x0 > 282 THEN 1 ELSE 2 END AS side FROM cols c LEFT JOIN two t USING (doc_id, page)),
cut AS (SELECT *, (SELECT count(*) FROM placed w WHERE w.doc_id = p.doc_id AND w.page = p.page AND w.two AND w.side = 2 AND w.y0 <= p.y0) AS wide FROM placed p)
SELECT block_id, page, two, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN NOT two THEN 0 WHEN side = 2 THEN 2 * wide - 1 ELSE 2 * wide END, CASE WHEN two THEN side ELSE 0 END, y0, x0, line) AS INTEGER) AS position FROM cut""")
def reading_order(spark, sf):
    return lo.reading_order(columns(spark, sf)).select("block_id", "page", "two", "position")


def pages(spark, sf):
    rows = fx.blocks(spark, sf).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    k = F.col("doc_id") + F.col("page")
    return lo.page_decision(rows.select(
        "doc_id", "page", F.when(k % 4 == 0, 0).otherwise(F.col("n")).alias("blocks"), F.when(k % 8 == 0, 1).otherwise(0).alias("images"), F.when(k % 12 == 0, 1).otherwise(0).alias("vectors"), (k % 9 == 0).alias("two"),
    ))


DECISION = """decided AS (SELECT doc_id, page, CASE WHEN k % 4 = 0 AND k % 8 <> 0 AND k % 12 <> 0 THEN 'intentional_blank' WHEN k % 4 = 0 AND k % 8 = 0 THEN 'need_ocr' WHEN k % 4 = 0 THEN 'need_layout_reparse' WHEN k % 9 = 0 THEN 'need_layout_reparse' ELSE 'accept_text' END AS decision
  FROM (SELECT DISTINCT doc_id, page, doc_id + page AS k FROM blocks))"""


@query("a10_page_decision", f"WITH {DECISION} SELECT * FROM decided")
def page_decision(spark, sf):
    return pages(spark, sf).select("doc_id", "page", "decision")


@query("d27_fallback_pages", f"""
WITH {DECISION} SELECT doc_id, page, bool_or(ocr) AS ocr FROM (SELECT doc_id, unnest([page - 1, page, page + 1]) AS page, ocr FROM (
  SELECT doc_id, page, decision = 'need_ocr' AS ocr FROM decided WHERE decision IN ('need_ocr', 'need_layout_reparse') UNION ALL SELECT doc_id, page, false FROM decided WHERE (doc_id * 7 + page) % 10 = 0))
WHERE EXISTS (SELECT 1 FROM decided d WHERE d.doc_id = doc_id) GROUP BY 1, 2 HAVING (doc_id, page) IN (SELECT (doc_id, page) FROM decided)""")
def fallback_pages(spark, sf):
    p = pages(spark, sf)
    return lo.fallback_pages(p, p.where("(doc_id * 7 + page) % 10 = 0"))


def boxes(spark, sf):
    """A table box for each order on one of a hundred pages of its customer."""
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), (k % 3).alias("page"), k.alias("table_id"), (k % 40).cast("double").alias("x0"), (k % 30).cast("double").alias("y0"), (k % 40 + 15).cast("double").alias("x1"), (k % 30 + 12).cast("double").alias("y1"), (k % 5 != 0).alias("valid"),
    )


@query("j6_box_overlap", """
WITH b AS (SELECT o_custkey AS doc_id, o_orderkey % 3 AS page, o_orderkey AS table_id, o_orderkey % 40 AS x0, o_orderkey % 30 AS y0, o_orderkey % 40 + 15 AS x1, o_orderkey % 30 + 12 AS y1, o_orderkey % 5 <> 0 AS valid FROM orders),
h AS (SELECT p.table_id AS a, c.table_id AS c, p.valid FROM b p JOIN b c USING (doc_id, page) WHERE p.table_id % 2 = 0 AND c.table_id % 2 = 1 AND p.x0 < c.x1 AND c.x0 < p.x1 AND p.y0 < c.y1 AND c.y0 < p.y1)
SELECT table_id, 'primary' AS detector FROM b WHERE table_id % 2 = 0 AND table_id NOT IN (SELECT a FROM h WHERE NOT valid) UNION ALL SELECT table_id, 'candidate' FROM b WHERE table_id % 2 = 1 AND table_id NOT IN (SELECT c FROM h WHERE valid)""")
def box_overlap(spark, sf):
    b = boxes(spark, sf)
    return lo.box_overlap(b.where("table_id % 2 = 0"), b.where("table_id % 2 = 1"))


@query("j2_chars_in_cells", """
WITH ch AS (SELECT l_orderkey * 100 + row AS char_id, l_orderkey AS doc_id, 1 AS page, CAST((l_partkey * 7) % 120 AS DOUBLE) AS cx, CAST((l_suppkey * 3) % 20 AS DOUBLE) AS cy, l_returnflag = 'N' AS blank FROM items),
ce AS (SELECT l_orderkey AS doc_id, l_orderkey * 100 + row AS cell_id, CAST((row - 1) * 20 AS DOUBLE) AS x0, CAST((row - 1) * 20 + 25 AS DOUBLE) AS x1 FROM items),
o AS (SELECT char_id, count(*) AS n, min(cell_id) AS cell_id FROM ch JOIN ce USING (doc_id) WHERE cx >= x0 AND cx < x1 AND cy >= 0 AND cy < 15 GROUP BY 1)
SELECT char_id, CASE WHEN o.n = 1 THEN o.cell_id END AS cell_id, CASE WHEN coalesce(o.n, 0) = 0 AND NOT blank THEN 'unowned' WHEN o.n > 1 AND NOT blank THEN 'ambiguous' END AS diagnostic FROM ch LEFT JOIN o USING (char_id)""")
def chars_in_cells(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = fx.table(spark, sf, "lineitem").withColumn("row", F.row_number().over(w).cast("long"))
    ident = (F.col("l_orderkey") * 100 + F.col("row"))
    chars = rows.select(ident.alias("char_id"), F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), ((F.col("l_partkey") * 7) % 120).cast("double").alias("cx"), ((F.col("l_suppkey") * 3) % 20).cast("double").alias("cy"), (F.col("l_returnflag") == "N").alias("blank"))
    x0 = ((F.col("row") - 1) * 20).cast("double")
    cells = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), ident.alias("cell_id"), x0.alias("x0"), (x0 + 25).alias("x1"), F.lit(0.0).alias("y0"), F.lit(15.0).alias("y1"))
    return lo.chars_in_cells(chars, cells)


BOXES = """boxes AS (SELECT l_suppkey AS table_id, l_orderkey * 10 + l_linenumber AS box_id, l_quantity + CAST(l_partkey % 3 AS DOUBLE) / 4 AS x0, l_quantity + CAST(l_partkey % 3 AS DOUBLE) / 4 + l_linenumber AS x1,
  CAST(l_orderkey % 50 AS DOUBLE) / 4 AS y0, CAST(l_orderkey % 50 AS DOUBLE) / 4 + 2 AS y1 FROM lineitem)"""
BOUNDS = """{a}e AS (SELECT table_id, x, row_number() OVER (PARTITION BY table_id ORDER BY x) AS k FROM (SELECT DISTINCT table_id, unnest([{a}0, {a}1]) AS x FROM boxes)),
{a}r AS (SELECT table_id, k, x AS opened FROM {a}e WHERE k = 1 UNION ALL SELECT e.table_id, e.k, CASE WHEN e.x - r.opened > 0.5 THEN e.x ELSE r.opened END FROM {a}r r JOIN {a}e e ON e.table_id = r.table_id AND e.k = r.k + 1),
{a}b AS (SELECT table_id, opened, row_number() OVER (PARTITION BY table_id ORDER BY opened) - 1 AS i FROM (SELECT DISTINCT table_id, opened FROM {a}r)),
{a}n AS (SELECT table_id, v, arg_min(i, abs(v - opened) * 1000000 + i) AS i FROM (SELECT DISTINCT table_id, unnest([{a}0, {a}1]) AS v FROM boxes) JOIN {a}b USING (table_id) GROUP BY 1, 2)"""


@query("d8_grid_from_boxes", f"""
WITH RECURSIVE {BOXES}, {BOUNDS.format(a="x")}, {BOUNDS.format(a="y")}
SELECT b.table_id, box_id, CAST(t.i AS INTEGER) AS row, CAST(l.i AS INTEGER) AS col, CAST(o.i - t.i AS INTEGER) AS row_span, CAST(r.i - l.i AS INTEGER) AS col_span FROM boxes b
JOIN xn l ON l.table_id = b.table_id AND l.v = b.x0 JOIN xn r ON r.table_id = b.table_id AND r.v = b.x1 JOIN yn t ON t.table_id = b.table_id AND t.v = b.y0 JOIN yn o ON o.table_id = b.table_id AND o.v = b.y1""")
def grid_from_boxes(spark, sf):
    x0, y0 = F.col("l_quantity") + (F.col("l_partkey") % 3).cast("double") / 4, (F.col("l_orderkey") % 50).cast("double") / 4
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_linenumber")).alias("x1"), (y0 + 2).alias("y1"))
    return lo.grid_from_boxes(rows)


@query("d14_coalesce_wrapped", """
WITH i AS (SELECT l_orderkey AS table_id, row, l_returnflag = 'N' AS wrapped, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY row) AS joined FROM items)
SELECT table_id, row * 4 AS cell_id, CAST(2 * (row - 1) - joined + CASE WHEN wrapped THEN 1 ELSE 0 END AS INTEGER) AS row FROM i UNION ALL SELECT table_id, row * 4 + 1, CAST(2 * row - 1 - joined AS INTEGER) FROM i
UNION ALL SELECT table_id, row * 4 + 2, CAST(2 * row - 1 - joined AS INTEGER) FROM i WHERE NOT wrapped""")
def coalesce_wrapped(spark, sf):
    """Two rows for each line item: a tall label, then its quantity, which lies within the label's height for some, and a blank."""
    rows = fx.cells(spark, sf).where("row > 0 and col in (0, 1, 4)").groupBy("table_id", "row").pivot("col", [0, 1, 4]).agg(F.first("text"))
    y, low = F.col("row") * 40.0, F.col("row") * 40.0 + F.when(F.col("4") == "N", 10).otherwise(32)
    row = 2 * (F.col("row") - 1)
    one = lambda k, row, y0, y1, text: F.struct((F.col("row") * 4 + k).alias("cell_id"), row.cast("int").alias("row"), F.lit(k).alias("col"), y0.alias("y0"), y1.alias("y1"), text.alias("text"))
    cells = F.array(one(0, row, y, y + 30, F.col("0")), one(1, row + 1, low, low + 6, F.col("1")), one(2, row + 1, low, low + 6, F.lit(" ")))
    return lo.coalesce_wrapped(rows.select("table_id", F.inline(cells)).withColumns({"row_span": F.lit(1), "col_span": F.lit(1), "header": F.lit(False)}))


#: The cells of an order's table in odd forms: years in a header, units, a later band, a row that names those after it, a
#: cell over two rows, no header at all, no numbers and an empty row.
GRIDS = """grids AS (SELECT * FROM (SELECT table_id, CASE WHEN table_id % 5 = 0 THEN row - 1 ELSE row END AS row, col, CASE WHEN table_id % 8 = 2 AND row = 1 AND col = 4 THEN 2 ELSE 1 END AS row_span, CASE WHEN table_id % 6 = 1 AND row = 2 THEN 5 ELSE 1 END AS col_span,
    CASE WHEN table_id % 11 = 3 AND row = 2 THEN '' WHEN table_id % 11 = 3 AND row > 0 AND col IN (1, 2, 3) THEN 'n/a' WHEN row = 0 AND col = 1 AND table_id % 7 = 0 THEN 'Quantity 2024' WHEN row = 0 AND col = 2 AND table_id % 3 = 0 THEN 'Price, %' WHEN table_id % 6 = 1 AND row = 2 THEN 'Group ' || table_id
      WHEN table_id % 4 = 0 AND row = 3 THEN ['Item', 'Amount', 'Price now', 'Rate', 'Kind'][col + 1] ELSE text END AS text
  FROM cells WHERE NOT (table_id % 5 = 0 AND row = 0) AND NOT (table_id % 6 = 1 AND row = 2 AND col > 0) AND NOT (table_id % 8 = 2 AND row = 2 AND col = 4)))"""
BANDS = GRIDS + """, marked AS (SELECT *, regexp_matches(trim(text), '(?i)^((от|до|свыше|более|менее)\\s+)?[+−±-]?\\d+([.,]\\d+)?(\\s|$)') AS value, replace(text, ' ', '') = max(CASE WHEN row = 0 THEN replace(text, ' ', '') END) OVER (PARTITION BY table_id, col) AS again FROM grids),
lines AS (SELECT table_id, row, bool_or(value) AS vals, bool_and(text = '') AS empty, bool_and(text <> '' AND NOT value) AS named, bool_or(coalesce(again, false)) AS again FROM marked GROUP BY 1, 2),
firsts AS (SELECT table_id, coalesce(min(CASE WHEN vals THEN row END), min(CASE WHEN empty AND row > 0 THEN row END), max(row) + 1) AS first_value FROM lines GROUP BY 1),
bands AS (SELECT l.table_id, l.row, first_value, l.row < first_value OR (l.row > first_value AND named AND again AND coalesce(lead(vals) OVER (PARTITION BY l.table_id ORDER BY l.row), false)) AS header FROM lines l JOIN firsts USING (table_id)),
starts AS (SELECT table_id, row FROM (SELECT *, coalesce(lag(header) OVER (PARTITION BY table_id ORDER BY row), false) AS before FROM bands) WHERE header AND NOT before),
roles AS (SELECT g.*, b.header, CASE WHEN b.header THEN 'header' WHEN g.col_span = max(g.col + g.col_span) OVER (PARTITION BY g.table_id) AND g.row >= b.first_value THEN 'note' ELSE 'data' END AS role, (SELECT max(s.row) FROM starts s WHERE s.table_id = g.table_id AND s.row <= g.row) AS scope FROM grids g JOIN bands b USING (table_id, row)),
data AS (SELECT table_id, row, any_value(scope) AS scope, min_by(text, col) AS subject, string_agg(text, ' | ' ORDER BY col) AS body, bool_and(text = '') AS blank FROM roles WHERE role = 'data' GROUP BY 1, 2),
context AS (SELECT d.*, coalesce((SELECT list(h.text ORDER BY h.row, h.col) FROM roles h WHERE h.table_id = d.table_id AND h.role = 'header' AND h.row >= d.scope AND h.row <= d.row AND trim(h.text) <> ''), []) AS headers,
  coalesce((SELECT list(s.text ORDER BY s.row, s.col) FROM roles s WHERE s.table_id = d.table_id AND s.role = 'data' AND s.row < d.row AND d.row < s.row + s.row_span AND trim(s.text) <> ''), []) AS scopes,
  nullif((SELECT max_by(n.text, n.row) FROM roles n WHERE n.table_id = d.table_id AND n.role = 'note' AND n.row <= d.row), '') AS section FROM data d)"""


def grids(spark, sf):
    k, row, col, rows = F.col("table_id"), F.col("row"), F.col("col"), fx.cells(spark, sf)
    rows = rows.where(~((k % 5 == 0) & (row == 0)) & ~((k % 6 == 1) & (row == 2) & (col > 0)) & ~((k % 8 == 2) & (row == 2) & (col == 4)))
    band = F.element_at(F.array(*[F.lit(x) for x in ("Item", "Amount", "Price now", "Rate", "Kind")]), (col + 1).cast("int"))
    text = (
        F.when((k % 11 == 3) & (row == 2), "").when((k % 11 == 3) & (row > 0) & col.isin(1, 2, 3), "n/a").when((row == 0) & (col == 1) & (k % 7 == 0), "Quantity 2024")
        .when((row == 0) & (col == 2) & (k % 3 == 0), "Price, %").when((k % 6 == 1) & (row == 2), F.concat(F.lit("Group "), k)).when((k % 4 == 0) & (row == 3), band).otherwise(F.col("text"))
    )
    spans = {"row_span": F.when((k % 8 == 2) & (row == 1) & (col == 4), 2).otherwise(1), "col_span": F.when((k % 6 == 1) & (row == 2), 5).otherwise(1)}
    return rows.withColumns({"text": text, **spans}).withColumn("row", F.when(k % 5 == 0, row - 1).otherwise(row))


@query("d9_header_rows", f"""
WITH {BANDS} SELECT table_id, count(*) FILTER (WHERE header AND row < first_value) AS header_rows, count(*) FILTER (WHERE header AND row > first_value) AS later_rows, count(*) AS rows FROM bands GROUP BY 1""")
def header_rows(spark, sf):
    return lo.header_rows(grids(spark, sf))


@query("w14_header_scope", """
SELECT table_id, row, last_value(start IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row) AS scope FROM (
  SELECT table_id, row, CASE WHEN h AND NOT coalesce(lag(h) OVER (PARTITION BY table_id ORDER BY row), false) THEN row END AS start FROM (SELECT DISTINCT table_id, row, row % 3 = 0 OR row % 7 = 1 AS h FROM cells))""")
def header_scope(spark, sf):
    return lo.header_scope(fx.cells(spark, sf).withColumn("header", (F.col("row") % 3 == 0) | (F.col("row") % 7 == 1)))


@query("d11_grid_check", """
WITH u AS (SELECT table_id, unnest(range(row, row + CASE WHEN row % 4 = 0 AND col = 1 THEN 2 ELSE 1 END)) AS r, col AS c FROM cells WHERE NOT (row % 5 = 2 AND col = 3))
SELECT table_id, count(*) - count(DISTINCT (r, c)) AS overlaps, (max(r) + 1) * (max(c) + 1) - count(DISTINCT (r, c)) AS holes FROM u GROUP BY 1""")
def grid_check(spark, sf):
    c = fx.cells(spark, sf).where("not (row % 5 = 2 and col = 3)")
    return lo.grid_check(c.withColumns({"row_span": F.when((F.col("row") % 4 == 0) & (F.col("col") == 1), 2).otherwise(1), "col_span": F.lit(1)}))


@query("d12_row_context", f"""
WITH {BANDS} SELECT table_id, row, subject, headers, list_filter(headers, lambda h: contains(h, '%')) AS units, scopes AS scope, section FROM context""")
def row_context(spark, sf):
    return lo.row_context(grids(spark, sf))


@query("d13_blank_template", """
SELECT table_id, table_id % 3 = 0 AND (table_id % 4 = 0 OR table_id % 5 = 0) AS template FROM (SELECT DISTINCT table_id FROM cells)""")
def blank_template(spark, sf):
    c = fx.cells(spark, sf)
    k = F.col("table_id")
    empty = ((k % 4 == 0) & (F.col("col") == 4) & (F.col("row") > 0)) | ((k % 5 == 0) & (F.col("row") == 1))
    cues = c.select("table_id").distinct().withColumn("text", F.when(k % 3 == 0, "Форма 7").otherwise("Table"))
    return lo.blank_template(c.withColumn("text", F.when(empty, " ").otherwise(F.col("text"))), cues)


@query("d18_chunk_table_rows", f"""
WITH {BANDS}, said AS (SELECT *, CASE WHEN len(headers) = 0 THEN 'TABLE_REQUIRED_HEADER_MISSING' WHEN blank THEN 'TABLE_ROW_WITHOUT_OWNED_TEXT' END AS fault, list_filter(headers, lambda h: contains(h, '%')) AS units FROM context)
SELECT table_id, row, CASE WHEN fault IS NULL THEN coalesce(section || chr(10), '') || array_to_string(headers, ' | ') || CASE WHEN len(units) > 0 THEN chr(10) || array_to_string(units, ' | ') ELSE '' END || CASE WHEN len(scopes) > 0 THEN chr(10) || array_to_string(scopes, ' | ') ELSE '' END || chr(10) || body END AS chunk, fault FROM said
UNION ALL SELECT DISTINCT table_id, NULL, NULL, 'TABLE_CONTEXT_COVERAGE_INCOMPLETE' FROM roles r WHERE trim(text) <> '' AND ((role = 'header' AND NOT EXISTS (SELECT 1 FROM data d WHERE d.table_id = r.table_id AND d.scope = r.scope))
  OR (role = 'note' AND NOT EXISTS (SELECT 1 FROM data d WHERE d.table_id = r.table_id AND d.row > r.row AND NOT EXISTS (SELECT 1 FROM roles n WHERE n.table_id = r.table_id AND n.role = 'note' AND n.row > r.row AND n.row <= d.row))))""")
def chunk_table_rows(spark, sf):
    return lo.chunk_table_rows(grids(spark, sf))


@query("t8_table_window", "SELECT table_id, row, col, text FROM cells WHERE row < 4 AND row + CASE WHEN col = 0 THEN 2 ELSE 1 END > 2")
def table_window(spark, sf):
    return lo.table_window(fx.cells(spark, sf).withColumn("row_span", F.when(F.col("col") == 0, 2).otherwise(1)), 2, 2).select("table_id", "row", "col", "text")


@query("a12_column_anchors", """
SELECT l_suppkey AS table_id, l_linenumber - 1 AS col, round(quantile_cont(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE (l_quantity + l_quantity + l_discount * 100) / 2 END, 0.5), 6) AS anchor FROM lineitem GROUP BY 1, 2""")
def column_anchors(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("col"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("x1"))
    return lo.column_anchors(rows)


@query("a11_superscript", """
WITH c AS (SELECT l_orderkey AS line_id, row AS char_id, CAST(10 AS DOUBLE) AS y0, CASE WHEN row % 4 = 3 THEN 15.0 ELSE 20.0 END AS y1, CASE WHEN row % 4 = 3 THEN 6.0 ELSE 10.0 END AS size FROM items),
p AS (SELECT line_id, quantile_cont(y1, 0.5) AS b, quantile_cont(y1 - y0, 0.5) AS h, quantile_cont(size, 0.5) AS u FROM c GROUP BY 1)
SELECT line_id, char_id, b - y1 >= greatest(0.22 * h, 1.0) AND size <= 0.88 * u AS superscript FROM c JOIN p USING (line_id)""")
def superscript(spark, sf):
    rows = fx.cells(spark, sf).where("row > 0 and col = 0")
    raised = F.col("row") % 4 == 3
    chars = rows.select(F.col("table_id").alias("line_id"), F.col("row").alias("char_id"), F.lit(10.0).alias("y0"), F.when(raised, 15.0).otherwise(20.0).alias("y1"), F.when(raised, 6.0).otherwise(10.0).alias("size"))
    return lo.lifted(chars).select("line_id", "char_id", "superscript")


def titled(spark, sf):
    """Lines with an invented heading or number before their text, by line number."""
    k = F.col("line")
    lead = (
        F.when(k % 12 == 1, F.concat(F.lit("Раздел "), F.floor(k / 12) + 1, F.lit(" "))).when(k % 6 == 2, F.concat(F.lit("Глава "), F.floor(k / 6) + 1, F.lit(" "))).when(k % 6 == 3, F.concat(k.cast("string"), F.lit(". ")))
        .when(k % 6 == 4, F.concat((k - 1).cast("string"), F.lit(".1) "))).when(k % 6 == 5, F.lit("а) ")).when(k % 24 == 0, F.lit("Примечание. ")).otherwise(F.lit(""))
    )
    return fx.blocks(spark, sf).select("doc_id", "line", "page", F.concat(lead, "text").alias("text"))


@query("d3_classify_headings", """
SELECT doc_id, line, CASE WHEN line % 12 = 1 THEN 'section' WHEN line % 6 = 2 THEN 'chapter' WHEN line % 6 = 3 THEN 'clause' WHEN line % 6 = 4 THEN 'subclause' WHEN line % 6 = 5 THEN 'letter' WHEN line % 24 = 0 THEN 'footnote' ELSE 'paragraph' END AS kind,
  CASE WHEN line % 12 = 1 THEN CAST(line // 12 + 1 AS VARCHAR) WHEN line % 6 = 2 THEN CAST(line // 6 + 1 AS VARCHAR) WHEN line % 6 = 3 THEN CAST(line AS VARCHAR) WHEN line % 6 = 4 THEN (line - 1) || '.1' WHEN line % 6 = 5 THEN 'а' END AS number FROM blocks""")
def classify_headings(spark, sf):
    return tr.classify_headings(titled(spark, sf)).select("doc_id", "line", "kind", "number")


@query("d4_assign_parents", """
SELECT doc_id, line, CASE WHEN line % 12 = 1 THEN 0 WHEN line % 6 = 2 THEN line - (line - 1) % 12 WHEN line % 6 IN (3, 4, 5) THEN line - 1 WHEN line % 6 = 0 THEN line - 2 ELSE line - 3 END AS parent, CAST(NULL AS VARCHAR) AS warning FROM blocks""")
def assign_parents(spark, sf):
    return tr.assign_parents(tr.classify_headings(titled(spark, sf)))


PATHS = """paths AS (SELECT doc_id, node_id, 0 AS level, [node_id] AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.doc_id, n.node_id, level + 1, list_append(path, n.node_id) FROM nodes n JOIN paths p ON n.parent_id = p.node_id WHERE level < 100)"""


@query("d5_tree_paths", f"WITH RECURSIVE {PATHS} SELECT * FROM paths")
def tree_paths(spark, sf):
    return tr.tree_paths(fx.nodes(spark, sf))


@query("d6_tree_validate", """
WITH RECURSIVE n AS (SELECT doc_id, node_id, CASE WHEN doc_id % 10 = 1 AND ordinal = 2 THEN NULL ELSE parent_id END AS parent_id FROM nodes WHERE NOT (doc_id % 10 = 0 AND ordinal > 0 AND ordinal % 10 = 5)),
reached AS (SELECT node_id FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id FROM n JOIN reached r ON n.parent_id = r.node_id)
SELECT doc_id, node_id, CASE WHEN parent_id NOT IN (SELECT node_id FROM n) THEN 'missing_parent' ELSE 'unreachable' END AS fault FROM n WHERE node_id NOT IN (SELECT node_id FROM reached)
UNION ALL SELECT doc_id, NULL, 'several_roots' FROM n WHERE parent_id IS NULL GROUP BY 1 HAVING count(*) > 1""")
def tree_validate(spark, sf):
    n = fx.nodes(spark, sf)
    n = n.where("not (doc_id % 10 = 0 and ordinal > 0 and ordinal % 10 = 5)").withColumn("parent_id", F.when((F.col("doc_id") % 10 == 1) & (F.col("ordinal") == 2), F.lit(None)).otherwise(F.col("parent_id")))
    good = tr.tree_paths(n)
    return tr.tree_validate(n, good)


ANCESTRY = """anc AS (SELECT node_id AS hit_id, node_id, 0 AS distance FROM nodes WHERE ordinal % 9 = 4 UNION ALL SELECT a.hit_id, n.parent_id, distance + 1 FROM anc a JOIN nodes n ON n.node_id = a.node_id WHERE n.parent_id IS NOT NULL AND distance < 32)"""


@query("e1_ancestry", f"WITH RECURSIVE {ANCESTRY} SELECT * FROM anc")
def ancestry(spark, sf):
    n = fx.nodes(spark, sf)
    return tr.ancestry(n, n.where("ordinal % 9 = 4").select("node_id"))


@query("j9_required_context", f"""
WITH RECURSIVE {ANCESTRY}, up AS (SELECT DISTINCT hit_id, node_id FROM anc) SELECT DISTINCT hit_id, node_id FROM (SELECT * FROM up UNION ALL SELECT u.hit_id, n.node_id FROM up u JOIN nodes n ON n.parent_id = u.node_id WHERE n.kind = 'clause')""")
def required_context(spark, sf):
    n = fx.nodes(spark, sf)
    return tr.required_context(n, n.where("ordinal % 9 = 4").select("node_id"), ("clause",))


@query("j11_null_safe_children", """
SELECT node_id, parent_id, node_id IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL) AS has_children FROM nodes WHERE parent_id IS NULL OR parent_id % 100000 = 5""")
def null_safe_children(spark, sf):
    n = fx.nodes(spark, sf)
    return tr.tree_children(n, n.where("ordinal = 5").select(F.col("node_id").alias("parent_id")).unionByName(n.where("ordinal = 0").select("parent_id")))


@query("d16_header_path", """
WITH RECURSIVE up AS (SELECT node_id AS leaf, node_id, parent_id, 0 AS k FROM nodes UNION ALL SELECT u.leaf, n.node_id, n.parent_id, k + 1 FROM up u JOIN nodes n ON n.node_id = u.parent_id),
parts AS (SELECT leaf, list(CASE WHEN kind IN ('section', 'clause') THEN left(text, 30) END ORDER BY k DESC) FILTER (WHERE kind IN ('section', 'clause') AND text <> '') AS p FROM up JOIN nodes USING (node_id) GROUP BY 1),
tails AS (SELECT leaf, p, list_filter(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], ' / ')), lambda t: length(t) <= 80) AS fit FROM parts WHERE len(p) > 0)
SELECT leaf AS node_id, CASE WHEN len(fit) > 0 THEN fit[1] ELSE left(p[-1], 80) END AS header FROM tails""")
def header_path(spark, sf):
    n = fx.nodes(spark, sf)
    return tr.header_path(tr.tree_paths(n), n.select("node_id", tr.label_of(F.col("kind"), F.col("text")).alias("label")), 80)


@query("d7_merge_paragraphs", """
SELECT doc_id, min(line) AS first, count(*) AS lines, string_agg(text, ' ' ORDER BY line) AS text FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS piece FROM (
  SELECT *, CASE WHEN kind = 'paragraph' AND lag(kind) OVER w IN ('clause', 'paragraph') AND lag(page) OVER w = page THEN 0 ELSE 1 END AS fresh FROM (SELECT doc_id, ordinal AS line, kind, page, text FROM nodes WHERE ordinal > 0) WINDOW w AS (PARTITION BY doc_id ORDER BY line))) GROUP BY doc_id, piece""")
def merge_paragraphs(spark, sf):
    return tr.merge_paragraphs(fx.nodes(spark, sf).where("ordinal > 0").select("doc_id", F.col("ordinal").alias("line"), "kind", "page", "text"))


@query("d17_chunk_body")
def chunk_body(spark, sf):
    return tr.chunk_body(fx.spread(fx.table(spark, sf, "documents")).select(F.col("doc_id").alias("node_id"), "text"), 120)


@query("d22_projection_gate", """
SELECT chunk_id, doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE len(words) < 4)""")
def projection_gate(spark, sf):
    c = fx.chunks(spark, sf)
    return c.join(c.where(F.size("words") < 4).select("doc_id").distinct(), "doc_id", "left_anti").select("chunk_id", "doc_id")


@query("j7_trusted_reviews", """
SELECT p_partkey, p_brand, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey % 100 AND s_nationkey % 2 = 0) AS trusted FROM part""")
def trusted_reviews(spark, sf):
    trust = fx.table(spark, sf, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("k")).distinct().withColumn("t", F.lit(True))
    p = fx.table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_partkey") % 100).alias("k"))
    return p.join(trust, "k", "left").select("p_partkey", "p_brand", F.coalesce("t", F.lit(False)).alias("trusted"))
