"""Originals, artifacts, greedy batches and idempotent batch writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.plans.staging import spent, staged

BUCKETS = 64
LEDGER = "batch_id long, rows long, outcome string, print string, write string"


def scan_originals(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Files under `path` against the registry (key, size, sha256): verdict of each as a row, never an exception."""
    files = spark.read.format("binaryFile").load(path)
    seen = files.select(F.element_at(F.split("path", "/"), -1).alias("key"), "length", F.sha2("content", 256).alias("seen"), F.substring("content", 1, 5).alias("start"))
    rows = registry.join(seen, "key", "left")
    verdict = F.when(F.col("seen").isNull(), "missing").when(F.col("length") != F.col("size"), "size").when(F.col("seen") != F.col("sha256"), "sha256").when(F.col("start") != F.lit(b"%PDF-"), "not_pdf").otherwise("ok")
    return rows.select("key", verdict.alias("verdict"))


PAGE = "pdf_page INT, width DOUBLE, height DOUBLE"
BLOCK = "block_id STRING, pdf_page INT, text STRING, bbox ARRAY<DOUBLE>"
NODE = "id STRING, parent_id STRING, node_type STRING, own_body STRING"
ARTIFACT = f"doc_id STRING, digest STRING, pages ARRAY<STRUCT<{PAGE.replace(' INT', ':INT').replace(' DOUBLE', ':DOUBLE')}>>, blocks ARRAY<STRUCT<block_id:STRING, pdf_page:INT, text:STRING, bbox:ARRAY<DOUBLE>>>, nodes ARRAY<STRUCT<id:STRING, parent_id:STRING, node_type:STRING, own_body:STRING>>"


def scan_artifacts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Canonical parse artifacts (a JSON file each): frames of pages, blocks, nodes and of rejected files, among them those
    without a digest of their blocks."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", ARTIFACT).alias("a"))
    good = F.col("a").isNotNull() & F.col("a.doc_id").isNotNull() & (F.sha2(F.to_json("a.blocks"), 256) == F.col("a.digest"))
    fine = rows.where(good)
    part = lambda name: fine.select(F.col("a.doc_id").alias("doc_id"), F.inline(F.col(f"a.{name}")))
    return {"pages": part("pages"), "blocks": part("blocks"), "nodes": part("nodes"), "rejected": rows.where(~F.coalesce(good, F.lit(False))).select("file")}


def greedy_batches(df: DataFrame, group: str, order: str, most_items: int, most_tokens: int, most_bytes: int) -> DataFrame:
    """Adds batch: ordered items of a group are batched until one more would pass a cap; an item over a cap alone has
    batch null. The cut depends on all items before it, so a group's sizes (a document's chunks, bounded by the indexer)
    are folded in order as one array."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col("tokens").cast("long").alias("t"), F.col("bytes").cast("long").alias("b"))))
    none = F.array().cast("array<struct<k:bigint,batch:bigint>>")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("batch", "items", "tokens", "size")], none.alias("out"))

    def step(s, x):
        over = (x["t"] > most_tokens) | (x["b"] > most_bytes)
        full = (s["items"] > 0) & ((s["items"] + 1 > most_items) | (s["tokens"] + x["t"] > most_tokens) | (s["size"] + x["b"] > most_bytes))
        batch = s["batch"] + F.when(full, 1).otherwise(0)
        held = lambda c: F.when(full, F.lit(0).cast("long")).otherwise(s[c])
        next_ = F.struct(batch.alias("batch"), (held("items") + 1).alias("items"), (held("tokens") + x["t"]).alias("tokens"), (held("size") + x["b"]).alias("size"), F.array_append(s["out"], F.struct(x["k"].alias("k"), batch.alias("batch"))).alias("out"))
        alone = F.struct(*[s[c].alias(c) for c in ("batch", "items", "tokens", "size")], F.array_append(s["out"], F.struct(x["k"].alias("k"), F.lit(None).cast("long").alias("batch"))).alias("out"))
        return F.when(over, alone).otherwise(next_)

    folded = df.select(group, F.col(order).cast("long").alias(order), "tokens", "bytes").groupBy(group).agg(items.alias("xs"))
    return folded.select(group, F.explode(F.aggregate("xs", zero, step, lambda s: s["out"])).alias("o")).select(group, F.col("o.k").alias(order), F.col("o.batch").alias("batch"))


def batch_prints(df: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """Payload hash and count of each batch."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, payload))).alias("xs"))
    return rows.select(*keys, F.sha2(F.to_json("xs"), 256).alias("print"), F.size("xs").cast("long").alias("rows"))


def _known(spark: SparkSession, ledger_path: str, write: str) -> DataFrame:
    """Prints of the batches that the ledger has from other writes."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = spark.createDataFrame([], LEDGER)
    return ledger.where((F.col("outcome") == "written") & (F.col("write") != write)).select("batch_id", F.col("print").alias("known"))


def commit_batches(df: DataFrame, ledger_path: str, out_path: str, order: str, payload: str, write: str) -> None:
    """Writes the batches (batch_id) of `df` that no other write has to out_path, and then all their outcomes to the
    ledger: written, replay (known with the same payload) or conflict.

    Both are folders of their own for each `write`, so a write that failed halfway replaces what it left when it runs
    again under its name, and `committed` sees rows only once their ledger is there. Within a write rows lie in BUCKETS
    folders by a hash of the batch, however many batches there are. A batch comes whole within one write.
    """
    rows = batch_prints(df, ["batch_id"], order, payload).join(_known(df.sparkSession, ledger_path, write), "batch_id", "left")
    outcome = F.when(F.col("known").isNull(), "written").when(F.col("known") == F.col("print"), "replay").otherwise("conflict")
    rows = staged(rows.select("batch_id", "rows", outcome.alias("outcome"), "print"))
    fresh = df.join(rows.where("outcome = 'written'").select("batch_id"), "batch_id", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("batch_id"), F.lit(BUCKETS)).cast("int"))
    fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out_path}/write={write}")
    rows.write.mode("overwrite").parquet(f"{ledger_path}/write={write}")
    spent(rows)


def committed(spark: SparkSession, ledger_path: str, out_path: str) -> DataFrame:
    """The rows of all batches that the ledger has as written."""
    ledger = spark.read.schema(LEDGER).parquet(ledger_path).where("outcome = 'written'").select("batch_id", "write")
    rows = spark.read.parquet(out_path).withColumn("write", F.col("write").cast("string"))
    return rows.join(ledger, ["batch_id", "write"], "left_semi").drop("write", "bucket")


def write_index_batches(df: DataFrame, ledger_path: str, out_path: str, order: str, payload: str) -> DataFrame:
    """`commit_batches` of a whole table, and the outcome of each of its batches.

    The write is named by a digest of the batches, so that the same table written again after a failure replaces what
    the first attempt left.
    """
    prints = batch_prints(df, ["batch_id"], order, payload)
    a, b, n = prints.agg(*[F.coalesce(F.bit_xor(F.xxhash64(F.lit(k), "batch_id", "print")), F.lit(0)) for k in (1, 2)], F.count("*")).first()
    name = f"w{a & (2**64 - 1):016x}{b & (2**64 - 1):016x}{n:x}"
    mine = f"{ledger_path}/write={name}"
    try:  # committed before: its batches are replays now
        done = df.sparkSession.read.parquet(mine)
        done.count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        commit_batches(df, ledger_path, out_path, order, payload, name)
        return df.sparkSession.read.parquet(mine).select("batch_id", "rows", "outcome")
    return done.select("batch_id", "rows", F.when(F.col("outcome") == "written", "replay").otherwise(F.col("outcome")).alias("outcome"))


def index_sink(ledger_path: str, out_path: str, order: str, payload: str) -> Callable[[DataFrame, int], None]:
    """`commit_batches` for foreachBatch: a micro-batch is a write, which a restarted stream repeats under its number."""

    def write(df: DataFrame, number: int) -> None:
        commit_batches(df, ledger_path, out_path, order, payload, f"m{number:010d}")

    return write


def encode_evidence(units: DataFrame, fields: list[str], interned: str) -> DataFrame:
    """Lossless dictionary encoding of packs: distinct values of `interned` by first use, and rows with their numbers."""
    rows = units.where("pack_id is not null").groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("position", interned, *fields))).alias("rows"))
    rows = rows.withColumn("values", F.array_distinct(F.col("rows")[interned]))
    numbered = F.transform("rows", lambda x: F.struct(x["position"].alias("position"), (F.array_position("values", x[interned]).cast("int") - 1).alias("number"), *[x[f].alias(f) for f in fields]))
    body = rows.select("pack_id", "values", F.sort_array(numbered).alias("rows"))
    return body.select("pack_id", F.to_json(F.struct(F.array(F.lit("number"), *[F.lit(f) for f in fields]).alias("fields"), F.col("values"), F.col("rows"))).alias("encoded"))
