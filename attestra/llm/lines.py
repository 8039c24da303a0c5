"""Lines that many documents share, dropped from all but one of them.

Normalised lines are exploded and hashed; the distinct documents of each hash are counted; lines of hashes over the
threshold go, except in the document with the largest id that holds them; what is left is put together by position.

No key gathers its rows in one task. Counting dedups (hash, document) pairs before it counts them by hash, both with
map-side combining. Marking joins lines with counted keys in two ways: keys with more than 1 / HEAVY of all counted
lines, fewer than HEAVY keys by arithmetic, are broadcast; every other key has at most that share. Rows of equal id
and text are worked on once and come back as many times as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.urls import LOWER, UPPER
from attestra.plans.staging import spent, staged

SPACE = " \t\n\x0b\x0c\r"
HEAVY = 10_000


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z lower-cased."""
    ends = F.lit(False)  # most lines need no trimming, which is dear for long ones
    for c in SPACE:
        ends = ends | line.startswith(c) | line.endswith(c)
    bare = F.when(ends, F.btrim(line, F.lit(SPACE))).otherwise(line)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _two(*of: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*of), F.xxhash64(F.lit(1), *of)]


def _marked(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """r1, r2 (hashes of id and text) and `dropped`, the positions of the lines that a text loses, where it loses any."""
    lines = rows.select("r1", "r2", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    k1, k2 = _two(F.col("key"))
    lines = lines.where(F.char_length("key") >= min_chars).select("r1", "r2", "doc_id", "pos", k1.alias("k1"), k2.alias("k2"))
    pairs = lines.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("n"))
    keys = pairs.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.max("doc_id").alias("owner"))
    keys = staged(keys.where(F.col("n") >= min_docs))  # fewer rows are fewer documents
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") * HEAVY > total
    common = F.col("docs") >= min_docs
    hot = keys.where(heavy).select("k1", "k2", F.when(common, F.col("owner")).alias("hot_owner"), common.alias("hot"))
    cold = keys.where(common & ~heavy).select("k1", "k2", "owner")
    lines = lines.join(F.broadcast(hot), ["k1", "k2"], "left")
    of = ("r1", "r2", "doc_id", "pos")
    found = lines.where("hot").select(*of, F.col("hot_owner").alias("owner")).unionByName(lines.where("hot is null").join(cold, ["k1", "k2"]).select(*of, "owner"))
    # a set, not a list: rows of equal id and text mark the same positions
    marks = staged(found.where(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("r1", "r2").agg(F.collect_set("pos").alias("dropped")))
    spent(keys)
    return marks


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of `df`: doc_id, text without the dropped lines, n_lines (before) and n_dropped.

    Texts are split at line feeds. A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased. Keys of at least `min_chars` code points that at least `min_docs` documents hold lose all their lines,
    repeats within a document too, except in the document with the largest id; all other lines stay as they are.

    A null or empty text is one empty line, and its text comes back empty. A document is its id: rows that share an id
    count once and keep or lose a line alike; rows with a null id are one document together, below all others. An empty
    table gives no rows. Other columns of `df` are not read. Lines of any length, and texts of any number of lines, are
    read whole.
    """
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    r1, r2 = _two(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))
    rows = rows.withColumns({"r1": r1, "r2": r2})
    marks = _marked(rows, min_chars, min_docs)
    once = rows.groupBy("r1", "r2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    out = once.join(marks, ["r1", "r2"], "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    out = out.withColumn("lines", F.when(F.col("dropped").isNotNull(), lines))
    out = out.select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"), (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM s
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.owner AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
