"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, target over size. The whole part is taken at once.
The fractions are rounded in pairs: words move at random from one document of the pair to the other until one of
them holds a whole number, with chances that keep each document's expectation and, at every step, the source's words.
A task rounds one hashed chunk of a source, of ROWS_PER_CHUNK documents on average, and leaves one fractional document;
these meet in a tree of groups of FAN_IN chunks, and the last one of a source is rounded alone. So a source misses its target by less than one document.
Equal rows (id, source and text) are counted first and rounded as one, and then share their copies out evenly.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.plans.staging import in_groups, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 20240607
ROWS_PER_CHUNK = 1_000
FAN_IN = 256
WORDS = r"[^\x20\x09-\x0D]+"
STATE = "source string, chunks long, chunk long, doc_id long, h long, size long, n long, whole long, part double"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_rows, source_size and target of every source. The windows hold a row for each source, not for each document.

    Weights go round over the sources by code point, null last. Targets in proportion to the weights share `share`
    of all words; those above `cap` times their source stop there and the others share the excess: the sources are
    filled in order of cap over weight, and the level at which the rest fits decides.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = slim.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size")).withColumns({"weight": weight, "most": F.col("source_size") * cap})
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    full, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("most").over(full), F.lit(0.0))) / F.sum("weight").over(rest)
    fits = F.when(level * F.col("weight") <= F.col("most"), F.struct(F.row_number().over(order).alias("place"), level.alias("level")))
    table = table.withColumn("fits", fits).withColumn("level", F.min("fits").over(whole)["level"])
    return table.select("source", "source_rows", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def chance(seed: int, *ids: int) -> float:
    return xxhash.xxh64_intdigest(struct.pack(f"<{len(ids)}q", *ids), seed) / 2**64


def pivotal(part: list[float], size: list[int], ids: list[tuple[int, int]], seed: int) -> list[float]:
    """Rounds all but at most one of `part`, keeping the sum of part times size."""
    part, held = list(part), -1
    for j, p in enumerate(part):
        if not 0 < p < 1:
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        up, down = min(a * (1 - part[i]), b * p), min(a * part[i], b * (1 - p))
        if chance(seed, *ids[i], *ids[j]) * (up + down) < down:  # words go from j to i
            fills, empties = a * (1 - part[i]) <= b * p, a * (1 - part[i]) >= b * p
            part[i], part[j] = 1.0 if fills else part[i] + up / a, 0.0 if empties else p - up / b
        else:
            empties, fills = a * part[i] <= b * (1 - p), a * part[i] >= b * (1 - p)
            part[i], part[j] = 0.0 if empties else part[i] - down / a, 1.0 if fills else p + down / b
        held = next((k for k in (i, j) if 0 < part[k] < 1), -1)
    return part


def _round(seed: int):
    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("h", "ascending"), ("size", "ascending")])
        ids = [(-1 if i is None else i, h) for i, h in zip(rows["doc_id"].to_pylist(), rows["h"].to_pylist(), strict=True)]
        part = pivotal(rows["part"].to_pylist(), rows["size"].to_pylist(), ids, seed)
        if rows["chunks"][0].as_py() == 1:  # all of the source
            part = [float(chance(seed, *ids[k]) < p) if 0 < p < 1 else p for k, p in enumerate(part)]
        return rows.set_column(rows.schema.get_field_index("part"), "part", pa.array(part, pa.float64()))

    return group


def _mixed_units(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, **kind) -> DataFrame:
    """doc_id, source, h, size, source_size, target, n (equal rows) and copies (of all of them together)."""
    slim = staged(df.select(df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"), F.xxhash64(df[text_col]).alias("h"), words(df[text_col]).alias("size")))
    goal = staged(targets(slim, **kind))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    all_ = F.when(F.col("size") > 0, rate * F.col("n")).otherwise(F.lit(0.0))
    units = slim.groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("n"))
    rows = units.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("chunks", F.ceil(F.col("source_rows") / ROWS_PER_CHUNK).cast("long"))
    rows = rows.select("source", "chunks", F.pmod(F.xxhash64("doc_id", "h"), "chunks").alias("chunk"), "doc_id", "h", "size", "n", F.floor(all_).cast("long").alias("whole"), (all_ - F.floor(all_)).alias("part"))

    now, settled = staged(rows.groupBy("source", "chunk").applyInArrow(_round(seed), STATE)), None
    open_ = (F.col("part") > 0) & (F.col("part") < 1)
    chunks = in_groups(goal.agg(F.coalesce(F.max("source_rows"), F.lit(0))).first()[0], ROWS_PER_CHUNK)
    while chunks > 1:
        chunks = in_groups(chunks, FAN_IN)
        settled = now.where(~open_) if settled is None else settled.unionByName(now.where(~open_))
        up = now.where(open_).withColumn("chunks", F.ceil(F.col("chunks") / FAN_IN).cast("long")).withColumn("chunk", F.pmod("chunk", "chunks"))
        now = staged(up.groupBy("source", "chunk").applyInArrow(_round(seed), STATE))
    settled = now if settled is None else settled.unionByName(now)
    return settled.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "h", "size", "source_size", "target", "n", (F.col("whole") + F.col("part")).cast("long").alias("copies"),
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **kind) -> DataFrame:
    """One row per row of `df`: doc_id, source, h (hash of the text), size, source_size, target, copies and taken.

    Size counts words. taken is size times copies, and copies are 0 to `cap`. A source's taken words differ from its
    target by less than one document. Null texts and texts without words have size 0 and take 0; a null source is a
    source; rows with equal ids are separate documents. The same rows give the same copies in any order and
    partitioning, as chunks and chances depend on keyed hashes of ids. An empty table gives no rows.
    """
    units = _mixed_units(df, id_col, text_col, source_col, seed, **kind)
    rows = units.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = (F.floor(F.col("copies") / F.col("n")) + (F.col("k") <= F.col("copies") % F.col("n")).cast("int")).cast("int")
    return rows.select("doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix: each row of `docs` as often as `mix` takes it, with the columns of `docs`.

    Equal rows (id, source and text) share their copies out evenly. Rows without words are not taken.
    """
    got = _mixed_units(docs, "doc_id", "text", "source", seed).select("doc_id", "source", "h", F.col("copies").alias("sum"), F.col("n").alias("rows")).where("sum > 0")
    keyed = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), docs["source"].cast("string").alias("from"), F.xxhash64(docs["text"]).alias("key"))
    rows = keyed.join(got, (F.col("key") == F.col("h")) & F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")))
    turn = F.row_number().over(Window.partitionBy("key", "id", "from").orderBy("key"))
    times = F.floor(F.col("sum") / F.col("rows")) + (turn <= F.col("sum") % F.col("rows")).cast("int")
    return rows.withColumn("times", times.cast("int")).select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
