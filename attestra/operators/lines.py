"""Lines of pages: joined fragments, contexts of tables, continuations and cell texts."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.tree import fitting_prefix

SEGMENT = "node_id long, text string, segments array<struct<start:int,end:int,source_start:int,source_end:int,kind:string>>"


@functools.cache
def _spots(composed: bool) -> re.Pattern:
    """What normal text may change: white space, and characters with marks where a text is not composed yet."""
    if composed:
        return re.compile(r"\s+")
    marks = "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.combining(c))
    return re.compile(rf"\s+|\S[{marks}]*")


def _changes(text: str) -> list[tuple[int, int, str]]:
    """Spans of a stripped text that normal text changes, each with what takes its place."""
    found = ((m.span(), m[0], " " if m[0].isspace() else unicodedata.normalize("NFC", m[0])) for m in _spots(unicodedata.is_normalized("NFC", text)).finditer(text))
    return [(*span, new) for span, old, new in found if new != old]


def _normal(text: str) -> tuple[str, list[tuple[int, int, int, int, str]]]:
    bare, lead = text.strip(), len(text) - len(text.lstrip())
    changes = _changes(bare)
    kept = zip([0, *(e for _, e, _ in changes)], [*(s for s, _, _ in changes), len(bare)], strict=True)  # between the changes
    pieces = [((s, e, bare[s:e], "exact"), (*c, "normalized_group")) for (s, e), c in zip(kept, [*changes, (0, 0, "")], strict=True)]
    line = [p for pair in pieces for p in pair if p[0] < p[1]]
    ends = [0]
    for p in line:
        ends.append(ends[-1] + len(p[2]))
    return "".join(p[2] for p in line), [(a, b, s + lead, e + lead, kind) for a, b, (s, e, _, kind) in zip(ends, ends[1:], line, strict=False)]


def normalise_text(blocks: DataFrame) -> DataFrame:
    """Normal text of blocks (node_id, text) with a reversible map to the source.

    Characters with their combining marks take normal form C, white space runs become one space, edges are trimmed;
    spelling stays. Segments are contiguous: `exact` ones have equal lengths on both sides, `normalized_group` ones are
    atomic. A null text gives empty text without segments.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0] for f in SEGMENT.partition("array<struct<")[2].rstrip(">").split(",")]
        for b in batches:
            done = [_normal(t or "") for t in b["text"]]
            yield pd.DataFrame({"node_id": b["node_id"], "text": [d[0] for d in done], "segments": [[dict(zip(names, x, strict=True)) for x in d[1]] for d in done]})

    return blocks.select("node_id", "text").mapInPandas(run, SEGMENT)


def join_collinear(words: DataFrame) -> DataFrame:
    """Fragments (page_id, line, x0, x1, yc, size, text) of one baseline joined: a gap from 0 to 1.5 sizes, centres
    closer than 0.35 sizes; a space where the gap is over 0.15 sizes."""
    w = Window.partitionBy("page_id", "line").orderBy("x0")
    gap, rise = F.col("x0") - F.lag("x1").over(w), F.abs(F.col("yc") - F.lag("yc").over(w))
    rows = words.withColumns({"gap": gap, "joins": (gap >= 0) & (gap < 1.5 * F.col("size")) & (rise < 0.35 * F.col("size"))})
    rows = rows.withColumn("piece", F.sum(F.when(F.coalesce("joins", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.concat(F.when(F.coalesce("joins", F.lit(False)) & (F.col("gap") > 0.15 * F.col("size")), F.lit(" ")).otherwise(F.lit("")), "text")
    out = rows.groupBy("page_id", "line", "piece").agg(F.array_sort(F.collect_list(F.struct("x0", part.alias("t")))).alias("ts"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return out.select("page_id", "line", "x0", "x1", F.array_join(F.transform("ts", lambda t: t["t"]), "").alias("text"))


def nearest_context(tables: DataFrame, blocks: DataFrame, height: float = 800.0) -> DataFrame:
    """The caption of each table: the nearest block above it on its page, or, if it starts in the top quarter and has
    none, the last block of the page before."""
    above = tables.join(blocks.select("doc_id", "page", "block_id", "y1"), ["doc_id", "page"]).where(F.col("y1") <= F.col("y0"))
    here = above.groupBy("table_id").agg(F.max_by("block_id", F.struct("y1", "block_id")).alias("block_id"))
    last = blocks.groupBy("doc_id", (F.col("page") + 1).alias("page")).agg(F.max_by("block_id", F.struct("y1", "block_id")).alias("before"))
    rows = tables.join(here, "table_id", "left").join(last, ["doc_id", "page"], "left")
    return rows.select("table_id", F.coalesce("block_id", F.when(F.col("y0") <= height / 4, F.col("before"))).alias("block_id"))


def typography_anchors(chars: DataFrame) -> DataFrame:
    """Nearest character to the left on the same baseline within two sizes (doc_id, page, char_id, x, y, size)."""
    left = chars.select("doc_id", "page", F.col("char_id").alias("left_id"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.floor("y").alias("_row"), F.floor(F.col("x") / 32).alias("_band"))
    rows = F.explode(F.sequence(F.floor(F.col("y") - 0.5), F.floor(F.col("y") + 0.5)))
    bands = F.explode(F.sequence(F.floor((F.col("x") - 2 * F.col("size")) / 32), F.floor(F.col("x") / 32)))
    near = chars.withColumn("_row", rows).withColumn("_band", bands).join(left, ["doc_id", "page", "_row", "_band"])
    near = near.where((F.col("lx") < F.col("x")) & (F.abs(F.col("ly") - F.col("y")) < 0.5) & (F.col("x") - F.col("lx") <= 2 * F.col("size")))
    return near.groupBy("char_id").agg(F.max_by("left_id", F.struct("lx", "left_id")).alias("left_id"))


def table_continuation(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, table_id, page, columns, top, bottom, header, rows; heights as shares of the page) merged with
    the headerless ones that continue them on the next page; row_offset is where a part's rows start in the whole."""
    w = Window.partitionBy("doc_id").orderBy("page", "top", "table_id")
    before = lambda c: F.lag(c).over(w)
    goes_on = ~F.col("header") & (before("columns") == F.col("columns")) & (before("page") == F.col("page") - 1) & (before("bottom") >= 0.75) & (F.col("top") <= 0.25)
    rows = tables.withColumn("whole", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("doc_id", "whole").orderBy("page", "top", "table_id")
    return rows.select("table_id", F.first("table_id").over(part).alias("first_id"), F.coalesce(F.sum("rows").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("row_offset"))


def cell_text(chars: DataFrame) -> DataFrame:
    """Text of each cell from its characters (cell_id, x0, y0, y1, text): lines are chains of characters that share half
    of the lower one's height, read from left to right, with a space between lines."""
    w = Window.partitionBy("cell_id").orderBy("y0", "x0")
    overlap = F.least(F.col("y1"), F.lag("y1").over(w)) - F.greatest(F.col("y0"), F.lag("y0").over(w))
    same = overlap >= 0.5 * F.least(F.col("y1") - F.col("y0"), F.lag("y1").over(w) - F.lag("y0").over(w))
    rows = chars.withColumn("line", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = rows.groupBy("cell_id", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("cs"))
    line = line.select("cell_id", "line", F.array_join(F.transform("cs", lambda c: c["text"]), "").alias("t"))
    whole = line.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("ls"))
    return whole.select("cell_id", F.array_join(F.transform("ls", lambda x: x["t"]), " ").alias("text"))


def parent_heading(tables: DataFrame, blocks: DataFrame, reach: float = 40.0) -> DataFrame:
    """The one unowned line without digits in the band above a table's header; none where there are several."""
    band = tables.join(blocks.select("doc_id", "page", "block_id", "y1", "text"), ["doc_id", "page"]).where((F.col("y1") <= F.col("y0")) & (F.col("y1") > F.col("y0") - reach))
    one = band.groupBy("table_id").agg(F.count("*").alias("n"), F.min("block_id").alias("block_id"), F.min("text").alias("text")).where("n = 1")
    return one.where(~F.col("text").rlike(r"\d")).select("table_id", "block_id")


def chunk_template(cells: DataFrame) -> DataFrame:
    """One chunk for each form: its labels in reading order and the grid of its slots (_ for an empty one)."""
    slot = F.when(F.trim("text") == "", F.lit("_")).otherwise(F.lit("x"))
    row = cells.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text", slot.alias("slot")))).alias("cs"))
    row = row.select("table_id", "row", F.array_join(F.transform("cs", lambda c: c["slot"]), "").alias("grid"), F.filter(F.transform("cs", lambda c: F.trim(c["text"])), lambda t: t != "").alias("labels"))
    whole = row.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "grid", "labels"))).alias("rs"))
    return whole.select("table_id", F.concat(F.array_join(F.flatten(F.transform("rs", lambda r: r["labels"])), " | "), F.lit("\n"), F.array_join(F.transform("rs", lambda r: r["grid"]), "/")).alias("chunk"))


INTRO_TOO_LONG = "ROUTING_ATOMIC_SOURCE_TOO_LONG"


def routing_descriptors(paths: DataFrame, nodes: DataFrame, kinds: tuple[str, ...], budget: int, count="words", chunks: DataFrame | None = None) -> DataFrame:
    """Per node of a routing kind with any text in it (doc_id, node_id): source_id, the node itself if it has text, else the
    first of its descendants that has, in document order; and intro, the beginning of that text within the token budget.

    `fault` tells of texts of which nothing fits. Nodes without any text are left out. A document without descriptors gets
    its first chunk (chunks: doc_id, node_id, ordinal, text), if these are given. `count`: as for `chunk_body`.
    """
    below = paths.select("node_id", F.explode("path").alias("ancestor")).join(nodes.select("doc_id", "node_id", "ordinal", "text"), "node_id").where(F.col("text").rlike(r"(?U)\S"))
    routed = nodes.where(F.col("kind").isin(*kinds)).select(F.col("node_id").alias("ancestor"))
    first = below.join(routed, "ancestor", "left_semi").groupBy("doc_id", "ancestor").agg(F.min_by(F.struct("node_id", "text"), "ordinal").alias("first"))
    out = first.select("doc_id", F.col("ancestor").alias("node_id"), F.col("first.node_id").alias("source_id"), fitting_prefix(F.col("first.text"), budget, count).alias("intro"))
    out = out.withColumn("fault", F.when(~F.col("intro").rlike(r"(?U)\S"), INTRO_TOO_LONG))
    if chunks is None:
        return out
    lone = chunks.join(out.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by(F.struct("node_id", "text"), "ordinal").alias("first"))
    none = F.lit(None).cast("string")
    return out.unionByName(lone.select("doc_id", "first.node_id", F.col("first.node_id").alias("source_id"), F.col("first.text").alias("intro"), none.alias("fault")))
