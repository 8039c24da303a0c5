"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Each shingle is hashed once; low bits of the hash choose one of BINS bins and the rest compete for the bin's minimum.
An empty bin takes the minimum of a non-empty one, chosen by hashing the pair of bins (optimal densification), so
equal choices are made for sets with the same non-empty bins. Of every minimum the low BITS bits are kept and packed as
hex. Likeness is the share of equal codes, corrected for codes that are equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.plans.staging import staged

BINS = 128
BITS = 8
WIDTH = 5
SPACES = " \t\n\x0b\f\r"
#: Documents of a bucket of neighbouring ids, on average; of 2 ** 31 documents on, so many that borders, which each task
#: holds, are no more than 2 ** 21 (64 MB).
ROWS_PER_BUCKET = 1_024
BORDERS = 1 << 21


def add_fingerprint(df: DataFrame, text: str, name: str, width: int = WIDTH) -> DataFrame:
    """`df` with column `name`: the fingerprint of column `text`; empty where there are no words, null never.

    Words are split at ASCII white space and lower-cased; fewer words than `width` are one shingle. Each helper
    column is read more than once below, so that the optimiser leaves it in a projection of its own and a lambda
    looks it up instead of computing it again for each element.
    """
    own = lambda x: f"_{name}_{x}"
    hexes = F.array(*[F.lit(f"{k:0{BITS // 4}X}") for k in range(1 << BITS)])
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACES))
    df = df.withColumn(own("some"), trimmed != "").withColumn(own("words"), F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    words = F.col(own("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))  # past the end: null, which adds nothing
    entries = F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(BINS - 1), 48) + F.shiftrightunsigned(h, 16))
    df = df.withColumn(own("sorted"), F.when(F.col(own("some")), F.sort_array(entries)).otherwise(F.array().cast("array<long>"))).drop(own("words"), own("some"))
    order = F.col(own("sorted"))
    bin_of = lambda e: F.shiftright(e, 48)
    df = df.withColumn(own("least"), F.filter(order, lambda e, i: (i == 0) | (bin_of(e) != bin_of(F.get(order, i - 1))))).drop(own("sorted"))
    least = F.col(own("least"))
    code = lambda e: e.bitwiseAND((1 << BITS) - 1)
    empty = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), F.transform(least, bin_of))
    lent = lambda b: F.array_min(F.transform(least, lambda e: F.shiftleft(F.shiftrightunsigned(F.xxhash64(b, bin_of(e)), 24), BITS) + code(e)))
    filled = F.when(F.size(least) == BINS, least).otherwise(F.sort_array(F.concat(least, F.transform(empty, lambda b: F.shiftleft(b, 48) + code(lent(b))))))
    packed = F.array_join(F.transform(filled, lambda e: F.get(hexes, code(e).cast("int"))), "")
    return df.withColumn(name, F.when(F.size(least) > 0, packed).otherwise(F.lit(""))).drop(own("least"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; two empty ones are alike, one is like nothing."""
    n = BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, i * n + 1, F.lit(n)) == F.substr(b, i * n + 1, F.lit(n)))) / BINS
    chance = 2.0**-BITS
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_buckets(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, h and others) with bucket: numbers in the order of (doc_id, h), null first.

    Borders are rows of the table itself, sampled by hash. A row looks its bucket up in two steps: among the first
    borders of all groups of borders, then within one group. `tie` splits rows that are equal in id and text.
    """
    n, = docs.agg(F.count("*")).first()
    rate = max(ROWS_PER_BUCKET, n // BORDERS)
    at = F.struct("doc_id", "h", "tie")
    docs = docs.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    borders = staged(docs.where(F.pmod(F.xxhash64("doc_id", "h", "tie"), F.lit(rate)) == 0).select(at.alias("border")).distinct())
    many = borders.count()
    if not many:
        return docs.withColumn("bucket", F.lit(0).cast("long"))
    per_group = max(1, round(many**0.5))
    place = F.row_number().over(Window.orderBy("border")) - 1  # a row for each border
    groups = borders.withColumn("place", place).groupBy(F.floor(F.col("place") / per_group).alias("group")).agg(F.sort_array(F.collect_list("border")).alias("borders"))
    groups = staged(groups)
    firsts = groups.agg(F.sort_array(F.collect_list(F.element_at("borders", 1))).alias("firsts")).select(F.lit(0).alias("one"), "firsts")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= at)).cast("long")
    docs = docs.withColumn("one", F.lit(0)).join(F.broadcast(firsts), "one").withColumn("group", below(F.col("firsts")) - 1).drop("one", "firsts")
    docs = docs.join(F.broadcast(groups), "group", "left")
    return docs.withColumn("bucket", F.when(F.col("group") < 0, F.lit(0)).otherwise(F.col("group") * per_group + below(F.col("borders")))).drop("group", "borders")


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """`docs` (doc_id, h and `carried`) with next_* of `carried`: of the row after it by descending (doc_id, h).

    The last row's next is the first. Rows go once to hashed buckets of neighbouring ids; the first row of each
    bucket also goes, as a guest, to the bucket before it. Null ids come last.
    """
    docs = with_buckets(docs)
    heads = docs.groupBy("bucket").agg(F.max(F.struct("doc_id", "h", "tie")).alias("head"))  # a row for each bucket
    order = Window.orderBy(F.col("bucket").desc())
    last = F.min("bucket").over(Window.partitionBy())
    heads = staged(heads.select("bucket", "head", F.coalesce(F.lag("bucket").over(order), last).alias("before")))
    is_head = F.struct("doc_id", "h", "tie").eqNullSafe(F.col("head"))
    stay, visit = F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    sent = docs.join(F.broadcast(heads), "bucket").withColumn("to", F.explode(F.when(is_head, F.array(stay, visit)).otherwise(F.array(stay))))
    line = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("tie").desc())
    sent = sent.select("to.bucket", "to.guest", "doc_id", "h", "tie", *carried)
    return sent.withColumns({f"next_{c}": F.lead(c).over(line) for c in carried}).where("not guest").drop("bucket", "guest", "tie")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document,
    by descending doc_id. Null texts are empty. Rows with equal ids follow each other by the hash of their text; a
    single row is its own next. An empty table gives no rows. Other columns are not read.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    docs = add_fingerprint(docs.withColumn("h", F.xxhash64("text")), "text", "fingerprint")
    rows = with_next(docs, "text", "fingerprint")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))})
    rows = add_fingerprint(rows.drop("text", "next_text"), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
