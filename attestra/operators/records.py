"""Rules over JSON records, logs and encoded payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_json(col: Column, spec: dict[str, Column | None]) -> Column:
    """Exactly the named keys, each passing its own check where it has one."""
    keys = F.json_object_keys(col)
    names = F.array(*[F.lit(k) for k in spec])
    fine = (F.size(F.array_except(keys, names)) == 0) & (F.size(F.array_except(names, keys)) == 0) & (F.size(keys) == len(spec))
    for check in spec.values():
        fine = fine if check is None else fine & check
    return F.coalesce(fine, F.lit(False))


def valid_source_metadata(col: Column, types: tuple[str, ...], title_length: int = 500) -> Column:
    """Only known keys, a title that is neither blank nor too long, a known type, dates that exist, in order."""
    key = lambda k: F.get_json_object(col, f"$.{k}")
    known = F.size(F.array_except(F.json_object_keys(col), F.array(*[F.lit(k) for k in ("title", "document_type", "number", "effective_from", "effective_to")]))) == 0
    day = lambda k: F.when(key(k).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(key(k), "yyyy-MM-dd"))
    dates = reduce(lambda a, b: a & b, (key(k).isNull() | day(k).isNotNull() for k in ("effective_from", "effective_to")))
    order = key("effective_to").isNull() | key("effective_from").isNull() | (day("effective_to") >= day("effective_from"))
    fine = known & (F.trim(key("title")) != "") & (F.char_length(key("title")) <= title_length) & key("document_type").isin(*types) & dates & order
    return F.coalesce(fine, F.lit(False))


def valid_spans(col: Column) -> Column:
    """Every span of an array: page from 1, a block, end not before start, and four ordered numbers from 0 as box."""
    box = lambda s: (F.size(s["bbox"]) == 4) & F.forall(s["bbox"], lambda v: v >= 0) & (s["bbox"][0] <= s["bbox"][2]) & (s["bbox"][1] <= s["bbox"][3])
    one = lambda s: F.coalesce((s["pdf_page"] >= 1) & (F.trim(s["block_id"]) != "") & (s["start_offset"] >= 0) & (s["end_offset"] >= s["start_offset"]) & box(s), F.lit(False))
    return F.coalesce(F.forall(col, one), F.lit(False))


def spans_outside_pages(spans: DataFrame, first: Column, last: Column) -> DataFrame:
    return spans.where(~F.col("page").between(first, last))


def safe_projection(df: DataFrame, key: str, rules: dict[str, tuple[Column, object]]) -> DataFrame:
    """Only the named fields, each null unless it passes its rule; all else is dropped."""
    return df.select(key, *[F.when(rule(c), c).alias(n) for n, (c, rule) in rules.items()])


def credential_scan(df: DataFrame, payload: str, secrets: list[str]) -> DataFrame:
    """Adds leaks: the payload has a known secret, as it is or as JSON writes it."""
    forms = sorted({f for s in secrets for f in (s, s.replace("\\", "\\\\").replace('"', '\\"'))})
    return df.withColumn("leaks", reduce(lambda a, b: a | b, (F.contains(payload, F.lit(f)) for f in forms)))


def public_evidence_guard(df: DataFrame, bound: Column, payload: str, most_bytes: int) -> DataFrame:
    return df.where(bound & (F.octet_length(payload) <= most_bytes))


def embedding_text_guard(df: DataFrame, text: Column, tokens: Column, most: int, prefixes: tuple[str, ...]) -> DataFrame:
    """Adds fits: not blank, no model prefix, and within the token limit."""
    prefixed = reduce(lambda a, b: a | b, (text.startswith(p) for p in prefixes))
    return df.withColumn("fits", (F.trim(text) != "") & ~prefixed & (tokens <= most))


def call_metadata(df: DataFrame, key: str, payload: str, fields: list[str]) -> DataFrame:
    """Named fields of a call's payload with its size and digest, without the payload."""
    return df.select(key, *[F.get_json_object(payload, f"$.{f}").alias(f) for f in fields], F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("hash"))


def registry_slice(blocks: DataFrame, requests: DataFrame, most_chars: int = 2_000_000) -> DataFrame:
    """Exactly the requested blocks of each request, a missing one as a row with found false; too_big flags a request
    whose texts are too long together."""
    rows = requests.join(blocks.select("block_id", "text"), "block_id", "left")
    total = rows.groupBy("request_id").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))
    return rows.join(total, "request_id").select("request_id", "block_id", F.col("text").isNotNull().alias("found"), (F.col("chars") > most_chars).alias("too_big"))


def referenced_blocks(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Distinct block ids that a row's span arrays name."""
    ids = [F.transform(a, lambda s: s["block_id"]) for a in arrays]
    return df.select(key, F.explode(F.array_distinct(F.concat(*ids))).alias("block_id"))


def set_binding(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two sets has, and which one."""
    return a.select(*keys).exceptAll(b.select(*keys)).withColumn("only_in", F.lit("a")).unionByName(b.select(*keys).exceptAll(a.select(*keys)).withColumn("only_in", F.lit("b")))
