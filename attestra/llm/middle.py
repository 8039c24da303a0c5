"""Fill-in-middle: texts cut twice at tokens and put together anew, so that a model learns to fill in the middle.

A text's bytes lie in fixed blocks. A Fenwick tree over the blocks holds how many tokens end in them and how many code
points begin; a descent by halved steps finds the block in which a given token ends, with the counts of all that lies
before it, and the place within the block is then looked up there. The trees of a batch are one flat array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.words import SPACE, slices

BLOCK = 1024  # bytes
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Trees:
    """Fenwick trees over the blocks of some texts: of ends of tokens, and of code points.

    A token is ASCII white space and the word after it; white space at a text's end is a token of its own. `units`
    has the number of tokens of each text.
    """

    def __init__(self, texts: pa.Array):
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        x = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.at = at = at - at[0]
        word = ~SPACE[x]
        self.ends = word.copy()  # of a word's bytes, the last ends its token
        self.ends[:-1] &= ~word[1:]
        last = at[1:][np.diff(at) > 0] - 1
        self.ends[last] = True
        self.leads = (x & 0xC0) != 0x80
        self.blocks = -(-np.diff(at) // BLOCK)
        self.base = np.cumsum(self.blocks) - self.blocks  # of a text's tree; its own numbers count from 1
        local = np.arange(self.blocks.sum()) - np.repeat(self.base, self.blocks)
        starts = np.repeat(at[:-1], self.blocks) + local * BLOCK
        counts = [np.add.reduceat(flags, starts, dtype=np.int64) if len(starts) else np.empty(0, np.int64) for flags in (self.ends, self.leads)]
        self.sums = np.stack([*counts], axis=1)
        step, place, most = 1, local + 1, int(self.blocks.max(initial=0))
        while step <= most:
            up = np.flatnonzero(place % (2 * step) == 0)
            self.sums[up] += self.sums[up - step]
            step *= 2
        self.top = step
        self.units = self.before(self.blocks)[:, 0]

    def before(self, n: np.ndarray) -> np.ndarray:
        """Sums over the first n blocks of each text."""
        n, out = n.copy(), np.zeros((len(n), 2), np.int64)
        while (some := np.flatnonzero(n)).size:
            out[some] += self.sums[self.base[some] + n[some] - 1]
            n[some] &= n[some] - 1
        return out

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Code points before the end of token k (from 1; 0: none) of each text."""
        pos, seen, step = np.zeros_like(k), np.zeros((len(k), 2), np.int64), self.top
        while step:
            to = pos + step
            may = np.flatnonzero(to <= self.blocks)
            own = self.sums[self.base[may] + to[may] - 1]
            ok = seen[may, 0] + own[:, 0] < k[may]
            pos[may[ok]] = to[may[ok]]
            seen[may[ok]] += own[ok]
            step //= 2
        out = seen[:, 1]
        for t in np.flatnonzero(k):
            a = self.at[t] + pos[t] * BLOCK
            ends = np.flatnonzero(self.ends[a : min(a + BLOCK, self.at[t + 1])])
            out[t] += np.count_nonzero(self.leads[a : a + ends[k[t] - seen[t, 0] - 1] + 1])
        return np.where(k > 0, out, 0)


def _cut_batches(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, h1, h2 in batches:
        h1, h2, parts = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), [np.empty((3, 0), np.int64)]
        for k, some in slices(texts):
            trees = Trees(some)
            own = slice(k, k + len(some))
            a, b = h1[own] % (trees.units + 1), h2[own] % (trees.units + 1)
            parts.append(np.stack([trees.units, trees.cut(np.minimum(a, b)), trees.cut(np.maximum(a, b))]))
        yield pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], ["n", "first", "second"])


def cuts(text: Column, h1: Column, h2: Column) -> Column:
    """Struct of n, the tokens of a text, and first and second, the code points before its two cuts, by two draws."""
    return F.arrow_udf(_cut_batches, "struct<n: long, first: long, second: long>")(text, h1, h2)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of `fill_in_middle` was made of."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row per row of `df`: doc_id, n (tokens), form, prefix_chars, middle_chars and output.

    Draws come from the sha256 of seed and id, so reruns agree and rows of one id are cut by the same draws. Of 100
    texts `rate` are cut, `spm` of 100 cut ones in the form with the suffix first. A text that is empty or holds a
    marker stays plain: its output is the text, its lengths are null. A null text is empty; a null id draws as an empty
    one. Repeated rows give equal results, an empty table none; other columns are not read. No shuffle.
    """
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.withColumn("cut", cuts(F.col("text"), draw[0], draw[1]))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (draw[2] % 100 >= rate), "plain").when(draw[3] % 100 < spm, "spm").otherwise("psm")
    a, b = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    rows = rows.withColumn("form", form).withColumns({
        "prefix": F.substr("text", F.lit(1), a), "middle": F.substr("text", a + 1, b - a), "suffix": F.substr("text", b + 1),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(psm)
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "cut.n", "form", F.when(cut, F.col("cut.first")).alias("prefix_chars"), F.when(cut, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, sha256('42:' || doc_id) AS d FROM documents
), b AS (
  SELECT *, len(tokens) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM a
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM b
), e AS (
  SELECT *, array_to_string(tokens[1:i], '') AS p, array_to_string(tokens[i + 1:j], '') AS m, array_to_string(tokens[j + 1:n], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM e
"""
