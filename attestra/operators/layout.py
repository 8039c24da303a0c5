"""Page layout and tables: boxes, columns, boilerplate, grids and headers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from attestra.functions.text import normalised

# Lines that begin like this are list items or notes, never boilerplate; words that make a table a form.
NOT_BOILERPLATE = r"(?iU)^(?:\d+[).]\s|[*†‡]|Примечани[ея]\b|Сноска\b)"
FORM_CUE = r"(?iU)\b(?:форма|бланк|шаблон|form|template)\b"


def clip_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Adds cx0 … cy1: the box cut to the page, null where nothing is left."""
    a, b, c, d = F.greatest("x0", F.lit(x0)), F.greatest("y0", F.lit(y0)), F.least("x1", F.lit(x1)), F.least("y1", F.lit(y1))
    some = (c > a) & (d > b)
    return df.withColumns({n: F.when(some, v) for n, v in (("cx0", a), ("cy0", b), ("cx1", c), ("cy1", d))})


def boilerplate(blocks: DataFrame, height: float = 800.0, width: float = 600.0, band: float = 0.09, share: float = 0.6, least: int = 3, most_chars: int = 500, owned: DataFrame | None = None) -> DataFrame:
    """Blocks of repeated headers and footers: the same text in normal form, digits aside, in the same place (rounded
    half to even) of enough pages. Blocks that tables own (`owned`: block_id) never qualify.

    Documents of fewer than `least` pages have none; a text needs max(least, ceil(share * pages)) distinct pages.
    """
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least)
    place = F.when(F.col("y1") <= height * band, "repeated_header").when(F.col("y0") >= height * (1 - band), "repeated_footer")
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    fit = blocks.withColumn("reason", place).where(F.col("reason").isNotNull() & (text != "") & (F.char_length(text) <= most_chars) & ~text.rlike(NOT_BOILERPLATE))
    if owned is not None:
        fit = fit.join(owned.select("block_id").distinct(), "block_id", "left_anti")
    sign = F.regexp_replace(F.regexp_replace(normalised(text), r"(?U)\s+", " "), r"(?U)\d+", "#")
    fit = fit.withColumns({"sign": sign, "px": F.bround(F.col("x0") / width * 100), "py": F.bround(F.col("y0") / height * 100)}).join(pages, "doc_id")
    key = ["doc_id", "reason", "sign", "px", "py"]
    enough = fit.groupBy(*key, "pages").agg(F.count_distinct("page").alias("on")).where(F.col("on") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share)))
    return fit.join(enough.select(*key, "on"), key).select("doc_id", "block_id", "reason", F.col("on").alias("pages"))


def same_band(a: DataFrame, b: DataFrame, keys: list[str], ya: tuple[str, str], yb: tuple[str, str], width: float) -> DataFrame:
    """Rows of a page whose heights `ya` and `yb` (closed) meet, by bands of `width`: a pair is found once, in the band
    where the later of the two begins, so a page's rows do not all meet each other."""
    bands = lambda y: F.explode(F.sequence(F.floor(F.col(y[0]) / width), F.floor(F.greatest(*y) / width)))
    both = a.withColumn("_band", bands(ya)).join(b.withColumn("_band", bands(yb)), [*keys, "_band"])
    later = F.greatest(ya[0], yb[0])
    return both.where((F.floor(later / width) == F.col("_band")) & (later <= F.least(F.greatest(*ya), F.greatest(*yb)))).drop("_band")


def column_pairs(blocks: DataFrame, width: float = 600.0, height: float = 800.0) -> DataFrame:
    """Blocks of a left and a right column, side by side on a page with nothing between them."""
    body = blocks.where((F.col("y0") >= height * 0.1) & (F.col("y1") <= height * 0.9)).select("doc_id", "page", "block_id", "x0", "y0", "x1", "y1")
    named = lambda df, p: df.select("doc_id", "page", *[F.col(c).alias(f"{p}_{c}") for c in ("block_id", "x0", "y0", "x1", "y1")])
    left = named(body.where((F.col("x1") < width * 0.53) & (F.col("x0") < width * 0.4)), "l")
    right = named(body.where(F.col("x0") > width * 0.47), "r")
    overlap = F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0")
    beside = lambda a, b, p, q: same_band(a, b, ["doc_id", "page"], (f"{p}_y0", f"{p}_y1"), (f"{q}_y0", f"{q}_y1"), height / 40)
    pairs = beside(left, right, "l", "r").withColumn("overlap", overlap)
    pairs = pairs.where((F.col("r_x0") - F.col("l_x1") > width * 0.03) & (F.col("overlap") > 0.4 * F.least(F.col("l_y1") - F.col("l_y0"), F.col("r_y1") - F.col("r_y0"))))
    other = named(body, "o")
    between = (F.col("o_x0") < F.col("r_x0")) & (F.col("o_x1") > F.col("l_x1")) & (F.least("o_y1", "l_y1") - F.greatest("o_y0", "l_y0") > 0.4 * F.col("overlap"))
    blocked = beside(pairs, other, "l", "o").where(~F.col("o_block_id").isin(F.col("l_block_id"), F.col("r_block_id")) & between)
    return pairs.join(blocked.select("l_block_id", "r_block_id").distinct(), ["l_block_id", "r_block_id"], "left_anti").select("doc_id", "page", "l_block_id", "r_block_id", ((F.col("l_y0") + F.col("l_y1")) / 2).alias("y"))


def two_column_pages(pairs: DataFrame, gap: float = 6.0, least: int = 3) -> DataFrame:
    """Pages with at least `least` column pairs at different heights (a chain of heights closer than `gap` is one)."""
    w = Window.partitionBy("doc_id", "page").orderBy("y")
    rows = pairs.select("doc_id", "page", "y").distinct().withColumn("new", (F.col("y") - F.lag("y").over(w) > gap) | F.lag("y").over(w).isNull())
    return rows.groupBy("doc_id", "page").agg(F.count_if("new").alias("rows")).where(F.col("rows") >= least)


def reading_order(blocks: DataFrame, width: float = 600.0) -> DataFrame:
    """Adds `position` within the page. Pages of one column read by height and then left to right; on pages of two,
    wide blocks cut the page into bands, and each band reads left column first."""
    two = two_column_pages(column_pairs(blocks)).select("doc_id", "page").withColumn("two", F.lit(True))
    side = F.when((F.col("x1") < width * 0.53) & (F.col("x0") < width * 0.4), 0).when(F.col("x0") > width * 0.47, 1).otherwise(2)
    rows = blocks.join(two, ["doc_id", "page"], "left").withColumns({"two": F.coalesce("two", F.lit(False)), "side": side})
    page = Window.partitionBy("doc_id", "page")
    band = F.count_if(F.col("two") & (F.col("side") == 2)).over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("band", F.when(F.col("two") & (F.col("side") == 2), band * 2 - 1).when(F.col("two"), band * 2).otherwise(0))
    order = [F.col("band"), F.when(F.col("two"), F.col("side")).otherwise(0), F.round("y0", 1), F.col("x0"), F.col("line")]
    return rows.withColumn("position", F.row_number().over(page.orderBy(*order))).drop("side", "band")


def page_decision(pages: DataFrame) -> DataFrame:
    """What to do with a page, from its counts of blocks, images and vectors and whether it has two columns."""
    c = F.col
    decision = (
        F.when((c("blocks") == 0) & (c("images") == 0) & (c("vectors") == 0), "intentional_blank").when((c("blocks") == 0) & (c("images") > 0), "need_ocr")
        .when(c("blocks") == 0, "need_layout_reparse").when(c("two"), "need_layout_reparse").otherwise("accept_text")
    )
    return pages.withColumn("decision", decision)


def fallback_pages(pages: DataFrame, critical: DataFrame) -> DataFrame:
    """Pages to parse again, with their neighbours that exist, and whether they need OCR."""
    bad = pages.where("decision in ('need_ocr', 'need_layout_reparse')").select("doc_id", "page", (F.col("decision") == "need_ocr").alias("ocr"))
    bad = bad.unionByName(critical.select("doc_id", "page", F.lit(False).alias("ocr")))
    near = bad.select("doc_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"), "ocr").groupBy("doc_id", "page").agg(F.bool_or("ocr").alias("ocr"))
    return near.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def chars_in_cells(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Owner of each character by its centre: the cell if there is exactly one, else a diagnostic (half-open boxes)."""
    at = chars.withColumns({"_c0": F.col("cy"), "_c1": F.col("cy")})
    inside = same_band(at, cells, ["doc_id", "page"], ("_c0", "_c1"), ("y0", "y1"), 20.0).where((F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1")))
    owner = inside.groupBy("char_id").agg(F.count("*").alias("owners"), F.min("cell_id").alias("cell_id"))
    rows = chars.select("char_id", "blank").join(owner, "char_id", "left")
    n = F.coalesce("owners", F.lit(0))
    return rows.select("char_id", F.when(n == 1, F.col("cell_id")).alias("cell_id"), F.when((n == 0) & ~F.col("blank"), "unowned").when((n > 1) & ~F.col("blank"), "ambiguous").alias("diagnostic"))


def box_overlap(primary: DataFrame, candidate: DataFrame) -> DataFrame:
    """Tables of two detectors on a page: a valid primary wins over candidates that it overlaps; else they replace it."""
    named = lambda df, p: df.select("doc_id", "page", F.col("table_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")], *([F.col("valid")] if p == "a" else []))
    hit = same_band(named(primary, "a"), named(candidate, "b"), ["doc_id", "page"], ("a_y0", "a_y1"), ("b_y0", "b_y1"), 50.0).where("a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
    lost_b = hit.where("valid").select(F.col("b_id").alias("table_id")).distinct()
    lost_a = hit.where("not valid").select(F.col("a_id").alias("table_id")).distinct()
    keep = lambda df, lost, name: df.join(lost, "table_id", "left_anti").select("table_id", F.lit(name).alias("detector"))
    return keep(primary, lost_a, "primary").unionByName(keep(candidate, lost_b, "candidate"))


def grid_edges(edges: DataFrame, key: str, position: str, gap: float = 0.5) -> DataFrame:
    """Boundaries of each table (key, bounds): an edge opens a new one if it is more than `gap` beyond the edge that
    opened the last. A table's edges are few and are folded in order as one array."""
    every = edges.where(F.col(position).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.col(position).cast("double"))).alias("xs"))
    opens = lambda bs, x: F.when((F.size(bs) == 0) | (x - F.element_at(bs, -1) > gap), F.array_append(bs, x)).otherwise(bs)
    return every.select(key, F.aggregate("xs", F.array().cast("array<double>"), opens).alias("bounds"))


def grid_from_boxes(boxes: DataFrame, gap: float = 0.5) -> DataFrame:
    """Row, column and spans of the boxes (table_id, box_id, x0, y0, x1, y1) of each table: the numbers of the nearest
    boundaries of its edges, the lower of two that are as near."""
    out = boxes
    for axis in ("x", "y"):
        edges = boxes.select("table_id", F.explode(F.array(f"{axis}0", f"{axis}1")).alias("at"))
        out = out.join(grid_edges(edges, "table_id", "at", gap).withColumnRenamed("bounds", axis), "table_id")
    near = lambda v, bounds: F.array_min(F.transform(bounds, lambda b, i: F.struct(F.abs(F.col(v) - b).alias("far"), i.alias("i"))))["i"]
    left, right, top, bottom = near("x0", "x"), near("x1", "x"), near("y0", "y"), near("y1", "y")
    return out.select("table_id", "box_id", top.alias("row"), left.alias("col"), (bottom - top).alias("row_span"), (right - left).alias("col_span"))


WRAPPED = "table_id long, cell_id long, row int"


def coalesce_wrapped(cells: DataFrame) -> DataFrame:
    """New row of each cell (table_id, cell_id, row, col, row_span, col_span, y0, y1, text, header) where a row is split.

    A row joins the one above it if both have text, in different columns, with neither headers nor cells over several
    rows, its texts are all numbers, and their middles lie inside the height of one label (a text with a letter) of the
    row above. Blank cells of joined rows go. A joined row may take the next row too. Each step depends on those before,
    so tables are dealt to tasks and sorted, and a task goes through its rows in order: it holds one row and the one
    above, whatever the size and number of the tables.
    """
    letter, number = re.compile(r"[^\W\d_]"), re.compile(r"[\s\d.,+±−%-]+")
    cell_id, row, col, row_span, col_span, y0, y1, text, header = range(1, 10)  # places in a cell

    def joins(upper: list[tuple], lower: list[tuple]) -> bool:
        if not upper or not lower or any(c[header] or c[row_span] != 1 for cs in (upper, lower) for c in cs):
            return False
        if any(c[y0] is None or not number.fullmatch(c[text]) for c in lower):
            return False
        columns = [{k for c in cs for k in range(c[col], c[col] + c[col_span])} for cs in (upper, lower)]
        if columns[0] & columns[1]:
            return False
        middles = [(c[y0] + c[y1]) / 2 for c in lower]
        first, last = min(middles), max(middles)
        return any(c[y0] is not None and c[y0] < first and last < c[y1] and letter.search(c[text]) for c in upper)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple] | None]:
        """The cells of one row after the other, and None where a batch ends."""
        at, cells = None, []
        for b in batches:
            for c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (c[0], c[row]) != at:
                    if cells:
                        yield cells
                    at, cells = (c[0], c[row]), []
                cells.append(c)
            yield None
        if cells:
            yield cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        table, joined, open_row, above, above_said = None, 0, None, [], []

        def give(cells: list[tuple], at: int | None) -> None:
            for c in cells:
                for values, v in zip(out, (c[0], c[cell_id], at), strict=True):
                    values.append(v)

        def taken() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["table_id", "cell_id", "row"])
            for values in out:
                values.clear()
            return batch

        for cells in rows_of(batches):
            if cells is None:
                if out[0]:
                    yield taken()
                continue
            said, at = [c for c in cells if c[text] and c[text].strip()], cells[0][row]
            if open_row is not None and cells[0][0] == table and at - joined == open_row + 1 and joins(above_said, said):
                joined, above_said = joined + 1, above_said + said
                above = above_said
                continue
            give(above, open_row)
            if open_row is None or cells[0][0] != table:
                table, joined = cells[0][0], 0
            open_row, above, above_said = at - joined, cells, said
        give(above, open_row)
        yield taken()

    columns = ["table_id", "cell_id", "row", "col", "row_span", "col_span", "y0", "y1", "text", "header"]
    return cells.select(*columns).repartition("table_id").sortWithinPartitions("table_id", "row").mapInArrow(run, WRAPPED)


# A cell that holds a value, and units of measure within a header.
VALUE = r"(?i)^(?:(?:от|до|свыше|более|менее)\s+)?[+−±-]?\d+(?:[.,]\d+)?(?:\s|$)"
UNIT = r"(?iu)(?:%|‰|(?<![\p{L}\d_])(?:кг|мг|км|мм|см|м|руб[\p{L}\d_]*|тонн[\p{L}\d_]*|штук|сут[\p{L}\d_]*|год[\p{L}\d_]*)(?![\p{L}\d_])|[²³])"
NO_HEADER, NO_TEXT, NOT_COVERED = "TABLE_REQUIRED_HEADER_MISSING", "TABLE_ROW_WITHOUT_OWNED_TEXT", "TABLE_CONTEXT_COVERAGE_INCOMPLETE"


def header_bands(cells: DataFrame) -> DataFrame:
    """Rows of tables (table_id, row) with first_value, the first row that holds a value (a cell that begins with a number),
    and header: is it above that row, or a later band?

    A table without values has its header above its first row that is quite empty, not counting the first; without such
    a row it is all header. A later band is a full row without values that repeats a text of the first row in its column
    and has a row with a value right below it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cells.withColumns({"_text": text, "_value": F.trim(text).rlike(VALUE), "_short": F.regexp_replace(text, r"(?U)\s+", "")})
    head = F.max(F.when(F.col("row") == 0, F.col("_short"))).over(Window.partitionBy("table_id", "col"))
    rows = rows.withColumn("_again", F.col("_short") == head).groupBy("table_id", "row").agg(
        F.bool_or("_value").alias("_values"), F.bool_and(F.col("_text") == "").alias("_empty"), F.bool_and((F.col("_text") != "") & ~F.col("_value")).alias("_named"), F.bool_or(F.coalesce("_again", F.lit(False))).alias("_again"),
    )
    table, line = Window.partitionBy("table_id"), Window.partitionBy("table_id").orderBy("row")
    first = lambda test: F.min(F.when(test, F.col("row"))).over(table)
    end = F.max("row").over(table) + 1
    rows = rows.withColumn("_below", F.coalesce(F.lead("_values").over(line), F.lit(False)))
    rows = rows.withColumn("first_value", F.coalesce(first(F.col("_values")), first(F.col("_empty") & (F.col("row") > 0)), end))
    header = (F.col("row") < F.col("first_value")) | ((F.col("row") > F.col("first_value")) & F.col("_named") & F.col("_again") & F.col("_below"))
    return rows.select("table_id", "row", "first_value", header.alias("header"))


def header_rows(cells: DataFrame) -> DataFrame:
    """Of each table the header rows at its top, those of later bands, and all its rows."""
    top = F.col("header") & (F.col("row") < F.col("first_value"))
    return header_bands(cells).groupBy("table_id").agg(F.count_if(top).alias("header_rows"), F.count_if(F.col("header") & ~top).alias("later_rows"), F.count("*").alias("rows"))


def header_scope(cells: DataFrame) -> DataFrame:
    """Rows of a table with the start of the latest run of header rows at or before them (column header: boolean)."""
    w = Window.partitionBy("table_id").orderBy("row")
    rows = cells.groupBy("table_id", "row").agg(F.bool_or("header").alias("header"))
    start = F.when(F.col("header") & ~F.coalesce(F.lag("header").over(w), F.lit(False)), F.col("row"))
    return rows.withColumn("start", start).withColumn("scope", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).select("table_id", "row", "scope")


def grid_check(cells: DataFrame) -> DataFrame:
    """Do the rectangles (row, col, row_span, col_span) of a table tile its grid, without holes and overlaps?"""
    unit = cells.select("table_id", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r"), "col", "col_span").select("table_id", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c"))
    size = unit.groupBy("table_id").agg(F.count("*").alias("covered"), F.count_distinct("r", "c").alias("different"), ((F.max("r") + 1) * (F.max("c") + 1)).alias("grid"))
    return size.select("table_id", (F.col("covered") - F.col("different")).alias("overlaps"), (F.col("grid") - F.col("different")).alias("holes"))


def in_roles(cells: DataFrame) -> DataFrame:
    """Cells with row_span, col_span, header, first_value, scope (start of the header rows that apply) and role: header, note
    (a cell as wide as its table, below the header: it names the rows after it) or data."""
    spans = {c: (F.col(c) if c in cells.columns else F.lit(1)) for c in ("row_span", "col_span")}
    bands = header_bands(cells)
    bands = bands.join(header_scope(bands), ["table_id", "row"])
    out = cells.withColumns(spans).withColumn("text", F.coalesce("text", F.lit(""))).join(bands, ["table_id", "row"])
    width = F.max(F.col("col") + F.col("col_span")).over(Window.partitionBy("table_id"))
    wide = (F.col("col_span") == width) & (F.col("row") >= F.col("first_value"))
    return out.withColumn("role", F.when(F.col("header"), "header").when(wide, "note").otherwise("data"))


def lines_in_roles(cells: DataFrame) -> DataFrame:
    """`in_roles` by table row: table_id, row, header, scope, and by column heads, data and notes (col, text, row_span).

    Cells are gathered by row once. All else is windows over the rows of a table, which stay in the tasks they are in.
    """
    c, text = F.col, F.coalesce("text", F.lit(""))
    spans = {n: (c(n) if n in cells.columns else F.lit(1)) for n in ("row_span", "col_span")}
    rows = cells.withColumns({"text": text, **spans}).withColumns({"_value": F.trim("text").rlike(VALUE), "_empty": c("text") == ""})
    rows = rows.groupBy("table_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("col", "text", "row_span", "col_span"))).alias("cells"), F.bool_or("_value").alias("_values"), F.bool_and("_empty").alias("_empty"),
        F.bool_and(~c("_empty") & ~c("_value")).alias("_named"), F.max(c("col") + c("col_span")).alias("_end"),
    )
    table, line = Window.partitionBy("table_id"), Window.partitionBy("table_id").orderBy("row")
    short = F.array_sort(F.transform("cells", lambda x: F.struct(x["col"].alias("col"), F.regexp_replace(x["text"], r"(?U)\s+", "").alias("short"))))
    rows = rows.withColumns({"_below": F.coalesce(F.lead("_values").over(line), F.lit(False)), "_short": F.when((c("row") == 0) | c("_named"), short)})
    top = F.filter("_short", lambda x, i: F.coalesce(F.get(c("_short"), i + 1)["col"] != x["col"], F.lit(True)))
    first = lambda test: F.min(F.when(test, c("row"))).over(table)
    rows = rows.withColumns({"_head": F.max(F.when(c("row") == 0, top)).over(table), "_first": F.coalesce(first(c("_values")), first(c("_empty") & (c("row") > 0)), F.max("row").over(table) + 1), "_width": F.max("_end").over(table)})
    again = F.coalesce(F.arrays_overlap("_short", "_head"), F.lit(False))
    rows = rows.withColumn("header", (c("row") < c("_first")) | ((c("row") > c("_first")) & c("_named") & c("_below") & again))
    rows = rows.withColumn("_start", F.when(c("header") & ~F.coalesce(F.lag("header").over(line), F.lit(False)), c("row")))
    rows = rows.withColumn("scope", F.last("_start", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    wide = lambda x: (x["col_span"] == c("_width")) & (c("row") >= c("_first"))
    none = F.slice("cells", 1, 0)
    return rows.select(
        "table_id", "row", "header", "scope", F.when(c("header"), c("cells")).otherwise(none).alias("heads"),
        F.when(c("header"), none).otherwise(F.filter("cells", lambda x: ~wide(x))).alias("data"), F.when(c("header"), none).otherwise(F.filter("cells", wide)).alias("notes"),
    )


def _in_context(lines: DataFrame) -> DataFrame:
    """Rows of `lines_in_roles` with what stands for them: subject, headers, units, scoped and section; and `used`: does any
    row of the same scope have data?"""
    c, none = F.col, F.array().cast("array<string>")
    said = lambda x: F.trim(x["text"]) != ""
    named = F.transform(F.filter("heads", said), lambda x: F.struct(x["text"].alias("text"), x["text"].rlike(UNIT).alias("unit")))
    rows = lines.withColumn("_named", F.when(c("header"), named))
    band = Window.partitionBy("table_id", "scope")
    above = band.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_heads": F.flatten(F.collect_list(F.when(F.size("_named") > 0, c("_named"))).over(above)), "used": F.max(F.size("data") > 0).over(band)})
    # cells that span into later rows go there as rows of their own, and are gathered by what is there
    span = lambda x: F.transform(F.sequence(c("row") + 1, c("row") + x["row_span"] - 1), lambda at: F.struct(at.alias("row"), F.struct(c("row").alias("row"), x["col"].alias("col"), x["text"].alias("text")).alias("_span")))
    spans = F.flatten(F.transform(F.filter("data", lambda x: (x["row_span"] > 1) & said(x)), span))
    kind = {n: t for n, t in lines.select("row", F.explode("data").alias("x")).select("row", "x.col").dtypes}
    own = F.array(F.struct(c("row").alias("row"), F.lit(None).cast(f"struct<row:{kind['row']},col:{kind['col']},text:string>").alias("_span")))
    rows = rows.withColumn("_all", F.concat(own, spans)).select(*[x for x in rows.columns if x != "row"], F.inline("_all"))
    rows = rows.withColumn("_spans", F.sort_array(F.collect_list("_span").over(Window.partitionBy("table_id", "row")))).where("_span is null")
    line = Window.partitionBy("table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_section", F.last(F.get("notes", F.lit(0))["text"], ignorenulls=True).over(line))
    return rows.withColumns({
        "subject": F.get("data", F.lit(0))["text"], "headers": F.coalesce(c("_heads")["text"], none), "units": F.coalesce(F.filter("_heads", lambda x: x["unit"])["text"], none),
        "scoped": F.coalesce(c("_spans")["text"], none), "section": F.when(F.trim("_section") != "", c("_section")),
    })


def row_context(cells: DataFrame) -> DataFrame:
    """Every row with data (table_id, row) with its subject, the text of its first cell, and what stands for it elsewhere:
    headers (texts of the header rows that apply, by row and column), units (those headers that name a unit of measure),
    scope (texts of cells above that span into the row) and section (the note above it). A row without header has none.

    Cells: table_id, row, col, text, and row_span and col_span where they differ from 1.
    """
    rows = _in_context(lines_in_roles(cells)).where(F.size("data") > 0)
    return rows.select("table_id", "row", "subject", "headers", "units", F.col("scoped").alias("scope"), "section")


def blank_template(cells: DataFrame, context: DataFrame) -> DataFrame:
    """Tables that are forms: the context says so and there are only headers, an empty row or an empty last column."""
    empty = F.trim("text") == ""
    row = cells.groupBy("table_id", "row").agg(F.bool_and(empty).alias("empty"))
    rows = row.groupBy("table_id").agg(F.bool_or(F.col("empty") & (F.col("row") > 0)).alias("empty_row"), F.max("row").alias("last_row"))
    w = Window.partitionBy("table_id")
    last = cells.withColumn("last", F.max("col").over(w)).where("col = last and row > 0").groupBy("table_id").agg(F.bool_and(empty).alias("empty_col"))
    cue = context.groupBy("table_id").agg(F.bool_or(F.col("text").rlike(FORM_CUE)).alias("cue"))
    out = rows.join(last, "table_id", "left").join(cue, "table_id", "left")
    form = (F.col("last_row") == 0) | F.col("empty_row") | F.coalesce("empty_col", F.lit(False))
    return out.select("table_id", (F.coalesce("cue", F.lit(False)) & form).alias("template"))


def chunk_table_rows(cells: DataFrame) -> DataFrame:
    """A chunk for each row with data (table_id, row, chunk, fault): a line for each of its section, headers, units and scope
    that there are, then its cells joined by a spaced pipe in column order.

    `fault` tells of rows that no header applies to and of rows without text; they have no chunk. A table with headers or
    notes that stand for no row has a fault row of its own, with a null row, so that nothing is lost in silence.
    """
    rows = _in_context(lines_in_roles(cells))
    c = F.col
    several = lambda x: F.when(F.size(x) > 0, F.array_join(x, " | "))
    rows = rows.withColumn("fault", F.when(F.size("headers") == 0, NO_HEADER).when(F.forall("data", lambda x: x["text"] == ""), NO_TEXT))
    chunk = F.concat_ws("\n", "section", several("headers"), several("units"), several("scoped"), F.array_join(c("data")["text"], " | "))
    said = lambda x: F.exists(x, lambda y: F.trim(y["text"]) != "")
    loose = c("header") & said("heads") & ~c("used")
    rows = rows.withColumn("_next", F.when(~c("header") & (said("notes") | (F.size("notes") == 0)), F.size("notes") > 0))
    alone = said("notes") & F.coalesce(F.expr("lead(_next) ignore nulls over (partition by table_id order by row)"), F.lit(True))
    line = Window.partitionBy("table_id").orderBy("row")
    rows = rows.withColumns({"_lost": loose | alone, "_at": F.row_number().over(line)}).withColumn("_lost", F.max("_lost").over(Window.partitionBy("table_id")))
    own = F.struct("row", F.when(c("fault").isNull(), chunk).alias("chunk"), "fault")
    lost = F.struct(F.lit(None).cast(cells.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("chunk"), F.lit(NOT_COVERED).alias("fault"))
    return rows.select("table_id", F.inline(F.array_compact(F.array(F.when(F.size("data") > 0, own), F.when(c("_lost") & (c("_at") == 1), lost)))))


def table_window(cells: DataFrame, start: int, limit: int) -> DataFrame:
    """Cells of the rows [start, start + limit) of each table, with spanning cells kept at their anchor row."""
    return cells.where((F.col("row") < start + limit) & (F.col("row") + F.col("row_span") > start))


def column_anchors(cells: DataFrame) -> DataFrame:
    """Median anchor of each column: left edge of the first, centre of the others."""
    anchor = F.when(F.col("col") == 0, F.col("x0")).otherwise((F.col("x0") + F.col("x1")) / 2)
    return cells.groupBy("table_id", "col").agg(F.round(F.percentile(anchor, 0.5), 6).alias("anchor"))


def lifted(chars: DataFrame) -> DataFrame:
    """Characters raised like a superscript against the medians of their line's others: by 22 % of the median height
    (one point at least) and of no more than 88 % of the median size."""
    peers = chars.groupBy("line_id").agg(F.percentile("y1", 0.5).alias("bottom"), F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("height"), F.percentile("size", 0.5).alias("usual"))
    rise = F.col("bottom") - F.col("y1")
    return chars.join(peers, "line_id").withColumn("superscript", (rise >= F.greatest(0.22 * F.col("height"), F.lit(1.0))) & (F.col("size") <= 0.88 * F.col("usual"))).drop("bottom", "height", "usual")


def recheck_columns(flagged: DataFrame, blocks: DataFrame, owned: DataFrame) -> DataFrame:
    """Pages flagged for two columns that still have them without the blocks that tables own."""
    free = blocks.join(owned.select("block_id").distinct(), "block_id", "left_anti")
    return flagged.join(two_column_pages(column_pairs(free)).select("doc_id", "page"), ["doc_id", "page"], "left_semi")
