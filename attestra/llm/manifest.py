"""Merkle manifest of a table: a digest for every row, a tree of digests for each language, and a root over all.

Levels are built by grouping runs of FAN nodes and are stored as rows that name their parent. A recursive query then
ascends from every leaf: each step joins the parent's row, yields the siblings of that level and folds the (tampered)
digest with them. The rows of a leaf's steps are put together at the end, so a step does not carry the earlier ones.

Near a root all leaves of a language ask for the same node. So leaves lie in blocks of BLOCK neighbours, and a node is
stored once for each block below it: a step joins on block and node, at most BLOCK rows meet one row, and nothing is
broadcast. That adds a row for each block and level above the blocks. Order within a language comes from a range
partitioning written to a table, with counts for each of its parts: no window runs over the rows of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.urls import LOWER, UPPER
from attestra.plans.staging import in_groups, spent, staged

FAN = 8
BLOCK = FAN**4
ROWS_PER_PART = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a recursive query may give; Spark's default would end it.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

CLIMB = """
WITH RECURSIVE climb (tree, ord, block, step, up, pos, folded, siblings, doc_id, leaf, subroot) AS (
  SELECT tree, ord, block, 0, up, pos, unhex(tampered), CAST('' AS BINARY), doc_id, leaf, subroot FROM {leaves}
  UNION ALL
  SELECT c.tree, c.ord, c.block, c.step + 1, n.up, n.pos,
    unhex(sha2(concat(lower(hex(substring(n.kids, 1, 32 * c.pos))), lower(hex(c.folded)), lower(hex(substring(n.kids, 32 * c.pos + 33)))), 256)),
    concat(substring(n.kids, 1, 32 * c.pos), substring(n.kids, 32 * c.pos + 33)), CAST(NULL AS {id_type}), CAST(NULL AS STRING), n.subroot
  FROM climb c JOIN {nodes} n ON n.block = c.block AND n.node = c.up
)
SELECT max(doc_id) AS doc_id, max(leaf) AS leaf, max(subroot) AS subroot, lower(hex(max_by(folded, step))) AS folded_root, sort_array(collect_list(struct(step, siblings))) AS steps
FROM climb GROUP BY tree, ord
"""


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of fields, each `-` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _in_order(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree (number of the language, null first), ord (from 0, by doc_id and digest), size (leaves of the
    language) and block; and the languages."""
    order = ("lang", "doc_id", "leaf")
    rows = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("place", 33))
    per = staged(rows.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)  # a row for each language
    langs = per.groupBy("lang").agg(F.sum("n").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    langs = staged(langs.select("lang", "size", (F.row_number().over(Window.orderBy("lang")) - 1).cast("long").alias("tree"), F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("block0")))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select(F.col("lang").alias("_lang"), F.col("part").alias("_part"), (ahead - F.col("first")).alias("shift"))
    starts = starts.join(langs, F.col("_lang").eqNullSafe(F.col("lang"))).drop("lang")
    placed = rows.join(starts, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("part") == F.col("_part"))).withColumn("ord", F.col("place") + F.col("shift"))
    placed = staged(placed.select("tree", "ord", "size", (F.col("block0") + F.floor(F.col("ord") / BLOCK)).alias("block"), "doc_id", "leaf", "tampered"))
    spent(rows, per)
    return placed, langs


def _levels(level: DataFrame, most: int) -> list[DataFrame]:
    """The levels above `level` (tree, level, ord, size, digest, first, last); `most`: the largest size of a tree."""
    out = []
    while not out or most > 1:
        runs = level.where("size > 1").groupBy("tree", "level", F.expr(f"ord div {FAN}").alias("ord")).agg(
            F.max("size").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "digest"))), lambda x: x["digest"]), "").alias("kids"),
            F.min("first").alias("first"), F.max("last").alias("last"),
        )
        level = staged(runs.select("tree", (F.col("level") + 1).alias("level"), "ord", F.ceil(F.col("size") / FAN).alias("size"), F.unhex("kids").alias("kids"), F.sha2("kids", 256).alias("digest"), "first", "last"))
        out.append(level)
        most = -(-most // FAN)
    return out


def _linked(level: DataFrame, trees: int) -> DataFrame:
    """`level` with up (the parent: tree, level and ord; null at the root), pos (place among its children) and subroot."""
    inner, over = F.col("size") > 1, (F.col("tree") >= 0) & F.lit(trees > 1)
    node = lambda tree, height, n: F.struct(tree.alias("tree"), height.alias("level"), n.alias("ord"))
    up = F.when(inner, node(F.col("tree"), F.col("level") + 1, F.expr(f"ord div {FAN}"))).when(over, node(F.lit(-1).cast("long"), F.lit(1), F.expr(f"tree div {FAN}")))
    return level.withColumns({
        "node": node(F.col("tree"), F.col("level"), F.col("ord")), "up": up,
        "pos": F.when(inner, F.col("ord") % FAN).otherwise(F.col("tree") % FAN).cast("int"), "subroot": F.when(~inner & (F.col("tree") >= 0), F.col("digest")),
    })


def manifest(df: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of `df`: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the digest of `fields`; the first of them is the id, `lang` among them parts the leaves into trees. In a
    tree leaves ascend by id, then by digest; null ids come first, and equal rows are interchangeable leaves of their
    own. While a level has several nodes, every FAN neighbours become the digest of their digests as hex text, the last
    run fewer, even one. Subroots, by language (null first, then by bytes), become the root in the same way. `tampered`
    is a boolean column of `df`: rows whose text is lower-cased (A-Z) before the proof is checked; null: not. Proofs are
    the siblings from the leaf to the root, left to right. An empty table gives no rows. Null fields and empty texts are
    fields like others; columns of `df` besides `fields` are not read.
    """
    spark, id_col = df.sparkSession, fields[0]
    leaf = leaf_digest(*[df[c] for c in fields])
    bad = leaf_digest(*[F.translate(df[c], UPPER, LOWER) if c == "text" else df[c] for c in fields])
    rows = df.select(df[id_col].alias("doc_id"), df["lang"].cast("string").alias("lang"), leaf.alias("leaf"), F.when(tampered, bad).alias("tampered"))
    leaves, langs = _in_order(rows.withColumn("tampered", F.coalesce("tampered", "leaf")), in_groups(df.count(), ROWS_PER_PART))
    trees, most = langs.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()

    ground = leaves.withColumns({"level": F.lit(0), "digest": F.col("leaf")})
    columns = ("tree", "level", "ord", "size", "digest", "first", "last")
    own = _levels(ground.withColumns({"first": F.col("block"), "last": F.col("block")}).select(*columns), most)
    subroots = ground.where("size = 1").withColumns({"first": F.col("block"), "last": F.col("block")}).select(*columns)
    for level in own:
        subroots = subroots.unionByName(level.where("size = 1").select(*columns))
    subroots = subroots.select(F.lit(-1).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("ord"), F.lit(trees).cast("long").alias("size"), "digest", "first", "last")
    above = _levels(subroots, trees)
    nodes = own[0]
    for level in [*own[1:], *above]:
        nodes = nodes.unionByName(level)
    nodes = _linked(nodes, trees).withColumn("block", F.explode(F.sequence("first", "last"))).select("block", "node", "kids", "up", "pos", "subroot")
    tops = (above[-1].where("size = 1") if trees > 1 else subroots).select("digest").take(1)
    root = tops[0].digest if tops else None

    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        climb = spark.sql(CLIMB.replace("{id_type}", leaves.schema["doc_id"].dataType.simpleString()), leaves=_linked(ground, trees), nodes=nodes)
        proof = F.aggregate("steps", F.lit(b""), lambda a, x: F.concat(a, x["siblings"]))
        out = climb.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(F.lower(F.hex(proof)), 256).alias("proof_sha256"), "folded_root")
        out = staged(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)
    spent(leaves, langs, *own, *above)
    return out


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, F.crc32(docs["doc_id"].cast("string")) % 3 == 0)


def _sql(levels: int) -> str:
    """SQL with each level spelt out: whole for trees of up to FAN ** `levels` leaves; deeper ones give no rows."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = "WITH RECURSIVE bits AS (SELECT n AS i, 0 AS k, n AS c FROM range(256) t(n) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8), crc AS (SELECT i, c FROM bits WHERE k = 8)"
    out = [crc, """ids AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents
  UNION ALL SELECT ids.doc_id, s, ids.k + 1, xor(ids.c // 256, crc.c) FROM ids JOIN crc ON crc.i = xor(ids.c % 256, ascii(substr(s, ids.k + 1, 1))) WHERE ids.k < length(s))""",
           "bad AS (SELECT doc_id FROM ids WHERE k = length(s) AND xor(c, 4294967295) % 3 = 0)",
           f"l0 AS (SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN {leaf(lower)} ELSE {leaf('text')} END AS t FROM documents)",
           "n0 AS (SELECT doc_id, lang, h, t, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS size FROM l0)"]
    for k in range(levels):
        out.append(f"n{k + 1} AS (SELECT lang, i // 8 AS i, (max(size) + 7) // 8 AS size, list(h ORDER BY i) AS kids, sha256(string_agg(h, '' ORDER BY i)) AS h FROM n{k} WHERE size > 1 GROUP BY lang, i // 8)")
    out.append("s0 AS (SELECT h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, lang, count(*) OVER () AS size FROM (" + " UNION ALL ".join(f"SELECT lang, h FROM n{k} WHERE size = 1" for k in range(levels + 1)) + "))")
    for k in range(2):
        out.append(f"s{k + 1} AS (SELECT i // 8 AS i, (max(size) + 7) // 8 AS size, list(h ORDER BY i) AS kids, sha256(string_agg(h, '' ORDER BY i)) AS h FROM s{k} WHERE size > 1 GROUP BY i // 8)")
    out.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM s{k} WHERE size = 1" for k in range(3)) + ")")
    fold = lambda up: f"CASE WHEN {up}.kids IS NULL THEN c.t ELSE sha256(array_to_string({up}.kids[1:c.i % 8], '') || c.t || array_to_string({up}.kids[c.i % 8 + 2:], '')) END AS t"
    seen = lambda up: f"c.p || CASE WHEN {up}.kids IS NULL THEN '' ELSE array_to_string({up}.kids[1:c.i % 8], '') || array_to_string({up}.kids[c.i % 8 + 2:], '') END AS p"
    out.append("c0 AS (SELECT doc_id, lang, h AS leaf, t, i, '' AS p FROM n0)")
    for k in range(levels):
        out.append(f"c{k + 1} AS (SELECT c.doc_id, c.lang, c.leaf, {fold('u')}, c.i // 8 AS i, {seen('u')} FROM c{k} c LEFT JOIN n{k + 1} u ON u.lang IS NOT DISTINCT FROM c.lang AND u.i = c.i // 8)")
    out.append(f"d0 AS (SELECT c.doc_id, c.leaf, c.t, c.p, s0.i, s0.h AS subroot FROM c{levels} c JOIN s0 ON s0.lang IS NOT DISTINCT FROM c.lang)")
    for k in range(2):
        out.append(f"d{k + 1} AS (SELECT c.doc_id, c.leaf, c.subroot, {fold('u')}, c.i // 8 AS i, {seen('u')} FROM d{k} c LEFT JOIN s{k + 1} u ON u.i = c.i // 8)")
    return ",\n".join(out) + "\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, t AS folded_root, t = root AS verified FROM d2, root"


SQL = _sql(6)
