"""Evidence packs: selection within budgets, stable aliases and manifests, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.hashing import canonical_json, sha256, uuid5
from attestra.functions.text import subject, word_prefix
from attestra.operators.intervals import islands, overlap_join
from attestra.operators.layout import lines_in_roles
from attestra.plans.staging import staged

TOO_LARGE, LIMIT = "ATOMIC_CONTEXT_TOO_LARGE", "EXPANSION_LIMIT"


def pack_evidence(candidates: DataFrame, most_units: int = 72, most_tokens: int = 5000) -> DataFrame:
    """Candidates (query_id, rank, units, tokens) of each query that a pack takes: greedily by rank, whole ones only; one
    that does not fit is left out and the next is tried. `fault` tells of queries none of whose candidates fits. A query's
    candidates are bounded by the ranking (20 by default), so each query is folded as one small array."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("units").cast("long").alias("u"), F.col("tokens").cast("long").alias("t"))))
    zero = F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("t"), F.array().cast("array<struct<rank:int,taken:boolean>>").alias("out"))

    def step(s, x):
        fits = (s["u"] + x["u"] <= most_units) & (s["t"] + x["t"] <= most_tokens)
        plus = lambda c: (s[c] + F.when(fits, x[c]).otherwise(0)).alias(c)
        return F.struct(plus("u"), plus("t"), F.array_append(s["out"], F.struct(x["rank"].alias("rank"), fits.alias("taken"))).alias("out"))

    folded = candidates.select("query_id", F.col("rank").cast("int").alias("rank"), "units", "tokens").groupBy("query_id").agg(items.alias("xs"))
    folded = folded.select("query_id", F.aggregate("xs", zero, step, lambda s: s["out"]).alias("out"))
    fault = F.when(~F.exists("out", lambda x: x["taken"]), TOO_LARGE)
    return folded.select("query_id", fault.alias("fault"), F.inline("out")).select("query_id", "rank", "taken", "fault")


def pack_manifest(units: DataFrame, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> DataFrame:
    """Per pack: units aliased E001, E002, … by position, the manifest hash over their excerpt hashes, and the pack's id."""
    alias = F.concat(F.lit("E"), F.lpad(F.row_number().over(Window.partitionBy("pack_id").orderBy("position")).cast("string"), 3, "0"))
    rows = units.select("pack_id", alias.alias("alias"), canonical_json(("alias", alias), ("hash", sha256(F.col("excerpt")))).alias("entry"))
    whole = rows.groupBy("pack_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    manifest = sha256(F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]")))
    return whole.select("pack_id", F.size("entries").cast("long").alias("units"), manifest.alias("manifest_hash"), uuid5(namespace, F.concat_ws(":", "pack_id", manifest)).alias("uuid"))


def pack_validate(units: DataFrame, known: DataFrame) -> DataFrame:
    """Faults of pack units against the index (evidence_id, title, hash): unknown, other title, other text, twice."""
    often = units.groupBy("pack_id", "evidence_id").agg(F.count("*").alias("often"))
    rows = units.join(known.select("evidence_id", F.col("title").alias("t"), F.col("hash").alias("h")), "evidence_id", "left").join(often, ["pack_id", "evidence_id"])
    fault = F.when(F.col("h").isNull(), "unknown").when(F.col("t") != F.col("title"), "title").when(F.col("h") != F.sha2("excerpt", 256), "text").when(F.col("often") > 1, "repeated")
    return rows.select("pack_id", "evidence_id", fault.alias("fault")).where("fault is not null")


def owner_attestation(owners: DataFrame, attested: DataFrame) -> DataFrame:
    """Owners whose recomputed hash differs from the attested one, or that only one side has."""
    mine = owners.select("owner_id", F.sha2("text", 256).alias("mine"))
    both = mine.join(attested.select("owner_id", F.col("hash").alias("theirs")), "owner_id", "full")
    fault = F.when(F.col("mine").isNull(), "not_present").when(F.col("theirs").isNull(), "not_attested").when(F.col("mine") != F.col("theirs"), "changed")
    return both.select("owner_id", fault.alias("fault")).where("fault is not null")


def coalesce_units(fragments: DataFrame) -> DataFrame:
    """Fragments (owner, start, end, text, chunk_id) of one owner stitched where they overlap or touch, with their chunks.

    The text that two fragments share must agree; `agrees` is false where it does not."""
    rows = islands(fragments, ["owner"])
    whole = rows.groupBy("owner", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("fs"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.min("start").alias("start"), F.max("end").alias("end"))
    at = lambda acc, f: acc["start"] + F.char_length(acc["text"])
    zero = F.struct(F.col("start").cast("long").alias("start"), F.lit("").alias("text"), F.lit(True).alias("agrees"))

    def stitch(acc, f):
        shared = F.greatest(F.least(at(acc, f), f["end"]) - f["start"], F.lit(0)).cast("int")
        before = F.substr(acc["text"], (f["start"] - acc["start"] + 1).cast("int"), shared)
        more = F.substr(f["text"], shared + 1, F.greatest(f["end"] - F.greatest(at(acc, f), f["start"]), F.lit(0)).cast("int"))
        return F.struct(acc["start"].alias("start"), F.concat(acc["text"], more).alias("text"), (acc["agrees"] & (before == F.substr(f["text"], F.lit(1), shared))).alias("agrees"))

    return whole.select("owner", "start", "end", "chunk_ids", F.aggregate("fs", zero, stitch).alias("s")).select("owner", "start", "end", "chunk_ids", "s.text", "s.agrees")


def anchor_closure(seeds: DataFrame, spans: DataFrame, refs: DataFrame, depth: int = 8, most: int = 128) -> DataFrame:
    """(query_id, node_id, round, fault): the seeds of each query and, round by round, the nodes whose spans hold what found
    nodes refer to.

    A query that finds more than `most` nodes, or still finds some in round `depth`, has one row instead, with a fault:
    it must not go on with a part. seeds: query_id, node_id; spans: node_id, block_key, start, end; refs: node_id,
    block_key, start_b, end_b. Nodes that the query has are left out of a round, so loops end, and queries over the limit
    are given up. Each round is one interval join, and its result is staged.
    """
    out = front = staged(seeds.select("query_id", "node_id", F.lit(0).alias("round")).distinct())
    for k in range(1, depth + 1):
        few = out.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("query_id")
        asked = refs.join(front.join(few, "query_id", "left_semi").select("query_id", "node_id"), "node_id").select("block_key", "start_b", "end_b", "query_id").distinct()
        hit = overlap_join(spans.select("block_key", "start", "end", "node_id"), asked, ["block_key"]).select("query_id", "node_id").distinct()
        front = staged(hit.join(out.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("round", F.lit(k)))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    count = out.groupBy("query_id").agg(F.count("*").alias("n"), F.max("round").alias("last"))
    over = count.where((F.col("n") > most) | (F.col("last") == depth)).select("query_id", F.lit(LIMIT).alias("fault"))
    none = lambda kind: F.lit(None).cast(kind)
    whole = out.join(over, "query_id", "left_anti").withColumn("fault", none("string"))
    return whole.unionByName(over.select("query_id", none(out.schema["node_id"].dataType).alias("node_id"), none("int").alias("round"), "fault"))


def reference_ranges(anchors: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """How much of each source anchor (keys, start, end) segments cover; less than all is unresolved context."""
    hit = overlap_join(anchors, segments, keys)
    part = hit.groupBy(*keys, "start", "end").agg(F.sum(F.least("end", "end_b") - F.greatest("start", "start_b")).alias("covered"))
    return anchors.join(part, [*keys, "start", "end"], "left").select(*keys, "start", "end", F.coalesce("covered", F.lit(0)).alias("covered"))


def expand_hits(hits: DataFrame, nodes: DataFrame, above: DataFrame, notes: tuple[str, ...]) -> DataFrame:
    """(hit_id, node_id, relation): the hit itself, its scopes (above: hit_id, node_id, distance) and its siblings of the
    kinds `notes`; a node that comes in several ways keeps the first of these."""
    scope = above.select("hit_id", "node_id", F.when(F.col("distance") == 0, 0).otherwise(1).alias("rank"))
    family = nodes.join(hits, "node_id", "left_semi").select(F.col("node_id").alias("hit_id"), "parent_id")
    side = nodes.where(F.col("kind").isin(*notes)).select("node_id", "parent_id").join(family, "parent_id").select("hit_id", "node_id", F.lit(2).alias("rank"))
    first = scope.unionByName(side).groupBy("hit_id", "node_id").agg(F.min("rank").alias("rank"))
    names = F.array(*[F.lit(n) for n in ("hit", "scope", "note")])
    return first.select("hit_id", "node_id", F.element_at(names, F.col("rank") + 1).alias("relation"))


def expand_rows(hits: DataFrame, cells: DataFrame) -> DataFrame:
    """What stands for hits on rows of tables (hit_id, table_id, row): hit_id, table_id, row, col and relation of the cells
    with text that go with them.

    These are: the row's own data (hit); that of the rows next to it whose subject begins like its own, or goes on where
    it ends (table); cells above that span into one of these rows (scope); and all headers and notes of the table. A cell
    that comes in several ways keeps the first of these. cells: as for `row_context`.
    """
    c = F.col
    said = lambda x: F.trim(x["text"]) != ""
    spots = lambda name, rank: F.transform(F.filter(name, said), lambda x: F.struct(c("row").alias("row"), x["col"].alias("col"), F.lit(rank).alias("rank")))
    lines = lines_in_roles(cells)
    # rows, hits and spanning cells meet in windows over a table's rows, not in joins
    rows = lines.select("table_id", "row", subject(F.get("data", F.lit(0))["text"]).alias("subject"), spots("data", 0).alias("own"), F.concat(spots("heads", 3), spots("notes", 4)).alias("around"))
    rows = rows.unionByName(hits.select("table_id", "row", "hit_id").distinct(), allowMissingColumns=True)
    here, spans = Window.partitionBy("table_id", "row"), []
    if "row_span" in cells.columns:
        into = lines.select("table_id", "row", F.explode(F.filter("data", lambda x: (x["row_span"] > 1) & said(x))).alias("x"))
        into = into.select("table_id", F.explode(F.sequence(c("row") + 1, c("row") + c("x.row_span") - 1)).alias("at"), F.struct("row", "x.col", F.lit(2).alias("rank")).alias("span"))
        rows = rows.unionByName(into.withColumnRenamed("at", "row"), allowMissingColumns=True).withColumn("spans", F.collect_list("span").over(here))
        spans = ["spans"]
    rows = rows.withColumn("data", F.when(c("subject").isNotNull(), F.struct("row", "subject", "own", *spans)))  # a row without data has no subject
    beside = lambda way: F.expr(f"{way}(data) ignore nulls over (partition by table_id order by row)")
    rows = rows.withColumns({"_before": beside("lag"), "_after": beside("lead")})
    alike = lambda other: F.when(word_prefix(c(f"{other}.subject"), c("data.subject")), c(other))
    rows = rows.withColumn("near", F.when(c("data").isNotNull(), F.array_compact(F.array(alike("_before"), alike("_after")))))
    rows = rows.withColumns({x: F.first(x, ignorenulls=True).over(here) for x in ("data", "near")}).where("hit_id is not null or size(around) > 0")
    rows = rows.withColumn("around", F.flatten(F.collect_list("around").over(Window.partitionBy("table_id")))).where("hit_id is not null")
    some = lambda x: F.coalesce(x, F.slice("around", 1, 0))
    ranked = lambda xs, rank: F.transform(xs, lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), F.lit(rank).alias("rank")))
    found = [some(c("data.own")), some(F.flatten(F.transform("near", lambda x: ranked(x["own"], 1)))), *[some(x) for x in spans and (c("spans"), F.flatten(F.transform("near", lambda x: x["spans"])))], c("around")]
    names = F.array(*[F.lit(n) for n in ("hit", "table", "scope", "header", "note")])
    first = rows.select("hit_id", "table_id", F.inline(F.concat(*found))).groupBy("hit_id", "table_id", "row", "col").agg(F.min("rank").alias("rank"))
    return first.select("hit_id", "table_id", "row", "col", F.element_at(names, F.col("rank") + 1).alias("relation"))
