"""Chat formatting: records of many layouts to canonical turns, and turns to one marked text with a loss mask.

A layout is recognised by the fingerprint of its nested field paths, a hash of the sorted paths. It selects a
declarative mapping that says where turns, roles and texts are. Tables are fingerprinted once, from their schema; a
column of JSON records is fingerprinted row by row. All work is done by SQL functions.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not stand in a text unescaped. An escaped one has one more backslash after its first character.
CONTROL = (
    TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>",
    "<s>", "</s>", "<SYS>", "</SYS>", "[INST]", "[/INST]",
)
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
TURN_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: one row a turn (`rows`), an array of turns, or one field a turn."""

    name: str
    rows: tuple[str, str, str, str] | None = None  # conversation, turn, role, text
    array: tuple[str, str, str] | None = None  # array, role, text
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields whose non-empty texts are joined by a blank line
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> tuple[str, ...]:
        if self.rows:
            return tuple(sorted(self.rows))
        if self.array:
            return tuple(sorted(f"{self.array[0]}[].{x}" for x in self.array[1:]))
        return tuple(sorted(f for _, fs in self.fields for f in fs))

    @property
    def print(self) -> str:
        return fingerprint(self.paths)


MAPPINGS = (
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", array=("messages", "role", "content"), roles=ROLES),
    Mapping("from and value", array=("conversations", "from", "value"), roles=ROLES),
    Mapping("instruction with input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction and response", fields=(("user", ("instruction",)), ("assistant", ("response",)))),
    Mapping("system, question and response", fields=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
    Mapping("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a schema; an element of an array is written []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return field_paths(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else [at]


def select_mapping(paths, mappings=MAPPINGS) -> Mapping:
    """The mapping with the fingerprint of those paths that any mapping knows; else the one that uses most of them."""
    known = set(paths) & {p for m in mappings for p in m.paths}
    if found := {m.print: m for m in mappings}.get(fingerprint(known)):
        return found
    if usable := [m for m in mappings if known.issuperset(m.paths)]:
        return max(usable, key=lambda m: len(m.paths))
    raise ValueError(f"no mapping for the layout {sorted(paths)}")


def _named(role: Column, roles: dict[str, str]) -> Column:
    role = F.coalesce(role, F.lit(""))
    return reduce(lambda other, r: F.when(F.lower(role) == r[0], F.lit(r[1])).otherwise(other), roles.items(), role)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _from_fields(m: Mapping, text_of) -> Column:
    turns = [_turn(F.lit(role), F.array_join(F.filter(F.array(*[text_of(f) for f in fs]), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")) for role, fs in m.fields]
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))


def turns_of(df: DataFrame, mappings=MAPPINGS) -> Column:
    """Canonical turns of each row of a table of nested records, by the mapping that its schema selects."""
    m = select_mapping(field_paths(df.schema), mappings)
    if m.array:
        turns = F.transform(df[m.array[0]], lambda t: _turn(_named(t[m.array[1]].cast("string"), m.roles), t[m.array[2]].cast("string")))
        return F.coalesce(turns, F.array().cast(TURN_TYPE))
    return _from_fields(m, lambda f: df[f].cast("string"))


def _variant_turns(array: Column, m: Mapping) -> Column:
    get = lambda t, k: F.try_variant_get(t, f"$.{k}", "string")
    return F.transform(array, lambda t: _turn(_named(get(t, m.array[1]), m.roles), get(t, m.array[2])))


def record_print(payload: Column) -> Column:
    """The layout of a JSON record: its nested keys without the types of the values; null if it is not JSON."""
    shape = F.schema_of_variant(F.try_parse_json(payload))
    return F.sha2(F.regexp_replace(shape, r": (?:[A-Z]+(?:\([0-9, ]*\))?)(?=[,>])", ": *"), 256)


def _shape(m: Mapping) -> str:
    if m.array:
        name, *own = m.array
        return f"OBJECT<{name}: ARRAY<OBJECT<{', '.join(f'{x}: *' for x in sorted(own))}>>>"
    return f"OBJECT<{', '.join(f'{p}: *' for p in m.paths)}>"


def record_turns(payload: Column, mappings=MAPPINGS) -> Column:
    """Canonical turns of JSON records of mixed layouts; null where the record is not JSON or of no known layout.

    A record whose fingerprint is known takes that mapping. Others, with further keys, take the mapping that uses most
    of the keys they have.
    """
    v, seen, fits = F.try_parse_json(payload), record_print(payload), F.lit(None).cast(TURN_TYPE)
    known = fits
    for m in sorted((m for m in mappings if not m.rows), key=lambda m: len(m.paths)):
        if m.array:
            name, role, _ = m.array
            turns = _variant_turns(F.try_variant_get(v, f"$.{name}", "array<variant>"), m)
            has = F.try_variant_get(v, f"$.{name}[0].{role}", "string").isNotNull()
        else:
            turns = _from_fields(m, lambda f: F.try_variant_get(v, f"$.{f}", "string"))
            has = reduce(lambda a, b: a & b, (F.try_variant_get(v, f"$.{p}", "variant").isNotNull() for p in m.paths))
        fits = F.when(has, turns).otherwise(fits)
        known = F.when(seen == hashlib.sha256(_shape(m).encode()).hexdigest(), turns).otherwise(known)
    return F.coalesce(known, fits)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*)({_REST})", "$1$2$3")


def marked(role: Column, text: Column) -> Column:
    """A turn's marked text, and its loss mask as run lengths in code points: skip, keep (with loss), tail."""
    before, body = F.concat(F.lit(TURN), escape(role), F.lit(TEXT)), escape(text)
    keep = F.when(role == "assistant", F.char_length(body)).otherwise(F.lit(0))
    n = F.char_length(before) + F.char_length(body) + len(END)
    skip = F.when(role == "assistant", F.char_length(before)).otherwise(n)
    return F.struct(F.concat(before, body, F.lit(END)).alias("piece"), F.struct(skip.alias("skip"), keep.alias("keep"), (n - skip - keep).alias("tail")).alias("run"))


def format_turns(turns: Column) -> Column:
    """Struct of formatted (text) and mask (a run of skip, keep and tail for each turn) of an array of turns."""
    done = F.transform(turns, lambda t: marked(t["role"], t["text"]))
    return F.struct(F.array_join(F.transform(done, lambda t: t["piece"]), "").alias("formatted"), F.transform(done, lambda t: t["run"]).alias("mask"))


def format_chats(df: DataFrame, id_col: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """conv_id, formatted and mask of every conversation of a table, whatever its layout.

    Turn rows are sorted by turn (null first), then by their marked text; equal rows are kept. Null roles and texts are
    empty. Rows with a null conversation id are one conversation; nested layouts give a row for each row, with empty
    text where there are no turns. Empty tables give no rows; columns outside the layout are ignored. A conversation is
    one value of the result, so it must fit a row.
    """
    m = select_mapping(field_paths(df.schema), mappings)
    if not m.rows:
        done = df.select(df[id_col].alias("conv_id"), turns_of(df, mappings).alias("turns"))
        return done.select("conv_id", format_turns(F.col("turns")).alias("f")).select("conv_id", "f.*")
    conv, turn, role, text = (df[c] for c in m.rows)
    role, text = _named(role.cast("string"), m.roles), F.coalesce(text.cast("string"), F.lit(""))
    rows = df.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", F.struct("turn", marked(F.col("role"), F.col("text")).alias("m")).alias("t"))
    done = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return done.select("conv_id", F.array_join(F.col("ts.m.piece"), "").alias("formatted"), F.col("ts.m.run").alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text marks."""
    marks = "|".join(re.escape(x) for x in (TURN, TEXT, END))
    part = lambda t, k: unescape(F.get(F.split(t, marks), F.lit(k)))
    return F.transform(_pieces(formatted), lambda t: _turn(part(t, 1), part(t, 2)))


def _pieces(formatted: Column) -> Column:
    return F.filter(F.split(formatted, rf"(?<={re.escape(END)})"), lambda t: t != "")


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the mask, turn by turn."""
    return F.zip_with(_pieces(formatted), mask, lambda t, r: unescape(F.substr(t, r["skip"] + 1, r["keep"])))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted chats, read back from formatted text and mask."""
    read = formatted.withColumns({"turns": read_turns(F.col("formatted")), "loss": F.array_join(loss_texts(F.col("formatted"), F.col("mask")), "")})
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.lit("</s>[INST] ok [/INST]")
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), said.alias("content")) for r in ("user", "assistant")]).alias("messages"))
    return digests(format_chats(rows).unionByName(format_chats(one)))


_SQL_REST = _REST.replace("'", "''")
_SQL_ESCAPED = rf"regexp_replace({{}}, '(<|\[)(\\*)({_SQL_REST})', '\1\\\2\3', 'g')"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({_SQL_ESCAPED.format("role")}) + length({_SQL_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
