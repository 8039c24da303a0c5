"""Document structure: headings, parents, paths, ancestors and checks of the tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.plans.staging import staged

# How headings, appendices, clauses, lettered items and notes begin.
HEADING = r"(?iu)^(Раздел|Глава|Статья)\s+([0-9]+(?:\.[0-9]+)*|[IVXLCDM]+)\b"
APPENDIX = r"(?iu)^Приложение(?:\s+№?\s*([0-9]+|[А-ЯA-Z]))?(?:\s|$)"
CLAUSE = r"^(\d{1,4}(?:\.\d{1,4}){0,9})[.)]\s+"
LETTER = r"(?iu)^([а-яa-z])\)\s+"
NOTE = r"(?iu)^(Примечани[ея]|Сноска)(?:\s|[.:])"


def classify_headings(df: DataFrame, col: str = "text") -> DataFrame:
    """Adds kind and number of a line; a line that opens in no known way is a paragraph without number."""
    word = F.lower(F.regexp_extract(col, HEADING, 1))
    number = lambda p, k: F.nullif(F.regexp_extract(col, p, k), F.lit(""))
    clause = number(CLAUSE, 1)
    kind = (
        F.when(F.col(col).rlike(APPENDIX), "appendix").when(word == "раздел", "section").when(word == "глава", "chapter").when(word == "статья", "article")
        .when(clause.contains("."), "subclause").when(clause.isNotNull(), "clause").when(F.col(col).rlike(LETTER), "letter").when(F.col(col).rlike(NOTE), "footnote").otherwise("paragraph")
    )
    value = F.when(kind == "appendix", number(APPENDIX, 1)).when(kind.isin("section", "chapter", "article"), number(HEADING, 2)).when(kind.isin("clause", "subclause"), clause).when(kind == "letter", number(LETTER, 1))
    return df.withColumns({"kind": kind, "number": value})


def assign_parents(lines: DataFrame) -> DataFrame:
    """Parent line (0: the document) of every classified line (doc_id, line from 1, kind, number), and a warning where
    its number has no parent or repeats.

    A heading closes the lower ones and all numbers, an appendix closes everything: so an open heading is the last one
    of its kind if nothing that closes it came later. Dotted numbers find their stem among the numbers of the same
    stretch between closing lines, where numbers and stems are sorted together. Two windows, no fold.
    """
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda *kinds: F.coalesce(F.last(F.when(F.col("kind").isin(*kinds), F.col("line")), ignorenulls=True).over(before), F.lit(0)).cast("long")
    seen = {"scope": last("appendix"), "section": last("section"), "chapter": last("chapter"), "article": last("article"), "clause": last("clause", "subclause")}
    rows = lines.select("doc_id", F.col("line").cast("long").alias("line"), "kind", "number").withColumns(seen)
    c = F.col
    rows = rows.withColumn("stretch", F.greatest("scope", "section", "chapter", "article"))
    open_ = lambda name, *over: F.when(c(name) > F.greatest(F.lit(0).cast("long"), *over), c(name))
    section, chapter, article = open_("section", "scope"), open_("chapter", "scope", "section"), open_("article", "scope", "section", "chapter")
    stem = F.when(c("number").contains("."), F.regexp_replace("number", r"\.[^.]*$", ""))
    numbered = c("kind").isin("clause", "subclause")

    keys = rows.where(numbered).select("doc_id", "line", "stretch", F.explode(F.array(F.struct(c("number").alias("key"), F.lit(True).alias("own")), F.struct(stem.alias("key"), F.lit(False).alias("own")))).alias("k"))
    same = Window.partitionBy("doc_id", "stretch", "k.key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.where("k.key is not null").withColumn("found", F.last(F.when(c("k.own"), c("line")), ignorenulls=True).over(same))
    keys = keys.groupBy("doc_id", "line").agg(F.max(F.when(c("k.own"), c("found"))).alias("twin"), F.max(F.when(~c("k.own"), c("found"))).alias("stem_line"))

    rows = rows.join(keys, ["doc_id", "line"], "left")
    around = F.coalesce(article, chapter, section, c("scope"))
    parent = (
        F.when(c("kind").isin("appendix", "section"), F.lit(0).cast("long")).when(c("kind") == "chapter", F.coalesce(section, c("scope"))).when(c("kind") == "article", F.coalesce(chapter, section, c("scope")))
        .when(numbered, F.coalesce("stem_line", around)).when(c("clause") > c("stretch"), c("clause")).when(c("kind") == "footnote", c("scope")).otherwise(around)
    )
    warning = F.when(numbered & stem.isNotNull() & c("stem_line").isNull(), "UNRESOLVED_NUMBER_PARENT").when(numbered & c("twin").isNotNull(), "REPEATED_NUMBER_IN_SCOPE")
    return rows.select("doc_id", "line", parent.alias("parent"), warning.alias("warning"))


def tree_paths(nodes: DataFrame, most_levels: int = 100) -> DataFrame:
    """Level and path (ids from the root) of every node (doc_id, node_id, parent_id), a level of the tree at a time.

    A loop over levels, not over nodes: each round joins the frontier with its children, both hashed by parent.
    """
    level = nodes.where("parent_id is null").select("doc_id", "node_id", F.lit(0).alias("level"), F.array("node_id").alias("path"))
    edges = nodes.where("parent_id is not null").select("node_id", "parent_id")
    out = level = staged(level)
    for depth in range(1, most_levels + 1):
        up = level.select("doc_id", F.col("node_id").alias("parent_id"), "path")
        level = staged(edges.join(up, "parent_id").select("doc_id", "node_id", F.lit(depth).alias("level"), F.concat("path", F.array("node_id")).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def tree_validate(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Faults of a tree: several roots, a missing or later parent, or a node that no root reaches."""
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("ordinal").alias("parent_ordinal"))
    rows = nodes.join(parent, "parent_id", "left").join(paths.select("node_id", "level"), "node_id", "left")
    roots = nodes.where("parent_id is null").groupBy("doc_id").agg(F.count("*").alias("roots"))
    fault = (
        F.when(F.col("parent_id").isNotNull() & F.col("parent_ordinal").isNull(), "missing_parent").when(F.col("parent_ordinal") >= F.col("ordinal"), "parent_after_child")
        .when(F.col("level").isNull(), "unreachable")
    )
    faults = rows.select("doc_id", "node_id", fault.alias("fault")).where("fault is not null")
    return faults.unionByName(roots.where("roots <> 1").select("doc_id", F.lit(None).cast("long").alias("node_id"), F.lit("several_roots").alias("fault")))


def ancestry(nodes: DataFrame, hits: DataFrame, most: int = 32) -> DataFrame:
    """(hit_id, node_id, distance) of the ancestors of hit nodes, themselves included; loops end at `most` steps."""
    up = nodes.select("node_id", "parent_id")
    level = staged(hits.select(F.col("node_id").alias("hit_id"), "node_id", F.lit(0).alias("distance")))
    out = level
    for distance in range(1, most + 1):
        level = staged(level.join(up, "node_id").where("parent_id is not null").select("hit_id", F.col("parent_id").alias("node_id"), F.lit(distance).alias("distance")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def required_context(nodes: DataFrame, seeds: DataFrame, kinds: tuple[str, ...] = ("table", "footnote")) -> DataFrame:
    """Distinct ancestors of seed nodes and those of their children that are tables or notes."""
    above = ancestry(nodes, seeds).select("hit_id", "node_id").distinct()
    below = nodes.where(F.col("kind").isin(*kinds)).select(F.col("node_id").alias("child"), F.col("parent_id").alias("node_id"))
    return above.unionByName(above.join(below, "node_id").select("hit_id", F.col("child").alias("node_id"))).distinct()


def tree_children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of given parents (a null parent: the roots), and whether they have children themselves."""
    inner = nodes.select(F.col("parent_id").alias("node_id"), F.lit(True).alias("has_children")).where("node_id is not null").distinct()
    asked = parents.select(F.col("parent_id").alias("_p")).distinct()
    kids = nodes.join(asked, F.col("parent_id").eqNullSafe(F.col("_p")), "left_semi")
    return kids.join(inner, "node_id", "left").select("node_id", "parent_id", F.coalesce("has_children", F.lit(False)).alias("has_children"))


def header_path(paths: DataFrame, labels: DataFrame, most_chars: int) -> DataFrame:
    """Header of a node: the labels of its path, without the farthest ones as long as it is over `most_chars`."""
    steps = paths.select("node_id", F.posexplode("path").alias("pos", "step")).join(labels.select(F.col("node_id").alias("step"), "label"), "step").where("label <> ''")
    parts = steps.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("parts"))
    joined = lambda k: F.array_join(F.slice("parts", k, F.size("parts")), " / ")
    fits = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.char_length(joined(k)) <= most_chars)
    return parts.select("node_id", F.when(F.size(fits) > 0, joined(fits[0])).otherwise(F.left(F.element_at("parts", -1), F.lit(most_chars))).alias("header"))


def merge_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines joined to the clause or paragraph that they continue: paragraphs directly after a clause or paragraph of
    the same page are one piece, texts joined by a space."""
    w = Window.partitionBy("doc_id").orderBy("line")
    joins = (F.col("kind") == "paragraph") & F.lag("kind").over(w).isin("clause", "paragraph") & (F.lag("page").over(w) == F.col("page"))
    rows = lines.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("doc_id", "piece").agg(F.min("line").alias("first"), F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ts"))
    return whole.select("doc_id", "first", "lines", F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("text"))


# Words that are not left at the end of a piece, of one part and of two.
INTRODUCERS, PAIRS = ("не", "если"), (("при", "условии"), ("за", "исключением"))
#: What does not begin a piece: marks, variation selectors, the zero-width joiner, skin tones.
CLINGS = r"^[\p{M}\x{FE0E}\x{FE0F}\x{200D}\x{1F3FB}-\x{1F3FF}]"
#: A part: a word with the white space after it, up to the end of a line and an empty line; or white space alone.
PART = r"(?U)\S*[^\S\n]*\n(?:[ \t]*\n)?|\S+[^\S\n]*|[^\S\n]+"
TOO_LONG = "ATOMIC_CONTEXT_OR_TEXT_TOO_LONG"
_MARK = "struct<at:int,tokens:bigint,chars:bigint>"
_RANKS = ("paragraph", "sentence", "space", "letter")  # ends of parts, best first

#: White space by its Unicode property.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words": lambda part: F.when(F.ascii(part).isin(*map(ord, BLANKS)), 0).otherwise(1).cast("long"),  # a part begins with its word
    "code points": lambda part: F.char_length(part).cast("long"),
}


def parts_of(text: Column, budget: int, count: Callable[[Column], Column]) -> Column:
    """The parts of a text as structs: part, tokens, chars, rank of its end (0: no cut) and back, the parts of an
    introducer that ends here. A part over the budget is given in extended grapheme clusters."""
    words = F.regexp_extract_all(text, F.lit(PART), F.lit(0))
    small = F.flatten(F.transform(words, lambda p: F.when(count(p) > budget, F.regexp_extract_all(p, F.lit(r"\X"), F.lit(0))).otherwise(F.array(p))))
    word = lambda p: F.lower(F.ltrim(F.btrim(p, F.lit(BLANKS)), F.lit("(«[\"")))

    def described(all_parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            clings = (F.ascii(F.get(all_parts, i + 1)) >= 0x300) & F.get(all_parts, i + 1).rlike(CLINGS)
            plain = p.endswith(" ") & ~p.endswith("  ") & ~p.endswith("\t ") & ~p.endswith("\u00a0 ")  # the commonest ends, without a pattern
            stop = p.endswith(". ") | p.endswith("; ") | p.endswith("! ") | p.endswith("? ")
            odd = F.when(p.rlike(r"(?U)[.!?;]\s+$"), 2).when(p.rlike(r"(?U)\s$"), 3).otherwise(4)
            rank = F.when(clings | p.endswith("\u200d"), 0).when(p.endswith("\n"), 1).when(plain & stop, 2).when(plain, 3).otherwise(odd)
            back = F.when(word(p).isin(*INTRODUCERS), 1)
            for x, y in PAIRS:
                back = back.when((word(p) == y) & (F.coalesce(word(F.get(all_parts, i - 1)), F.lit("")) == x), 2)
            back = F.when((F.octet_length(p) <= 40) & (F.octet_length(p) > F.char_length(p)), F.coalesce(back, F.lit(0))).otherwise(0)
            return F.struct(p.alias("part"), count(p).alias("tokens"), F.char_length(p).cast("long").alias("chars"), rank.alias("rank"), back.alias("back"))

        return F.transform(all_parts, one)

    return F.element_at(F.transform(F.array(small), described), 1)  # binds the parts, so that they are made once


def cuts_of(parts: Column, budget: int, atomic: Column | None = None) -> Column:
    """Ends of the pieces of a text as structs (at: parts, chars, over), by one fold over its parts.

    The fold keeps the running tokens and, of each rank, the last place in the open piece where a cut may be. When a
    part does not fit, the piece ends at the best of these places, or before the introducer that would end it, until the
    part fits. A piece without such a place runs on over the budget. `atomic`: ranges in which no cut may be.
    """
    none = F.lit(None).cast(_MARK)
    zero = F.struct(
        F.lit(0).alias("at"), *[F.lit(0).cast("long").alias(c) for c in ("tokens", "chars")], F.lit(0).alias("begin"), F.lit(0).cast("long").alias("begin_tokens"),
        *[none.alias(r) for r in _RANKS], F.array().cast("array<struct<at:int,chars:bigint,over:boolean>>").alias("out"),
    )

    def end_piece(s: Column, x: Column) -> Column:
        best = F.coalesce(*[s[r] for r in _RANKS])

        def cut(m: Column) -> Column:
            one, two = F.get(parts, m["at"] - 1), F.get(parts, m["at"] - 2)  # an introducer, and its first word
            back = F.when(m["at"] - one["back"] > s["begin"], one["back"]).otherwise(0)
            less = lambda c: m[c] - F.when(back == 2, one[c] + two[c]).when(back == 1, one[c]).otherwise(0)
            at, tokens = m["at"] - back, less("tokens")
            done = F.struct(at.alias("at"), less("chars").alias("chars"), (tokens - s["begin_tokens"] > budget).alias("over"))
            return F.struct(
                *[s[c].alias(c) for c in ("at", "tokens", "chars")], at.alias("begin"), tokens.alias("begin_tokens"),
                *[F.when(s[r]["at"] > at, s[r]).alias(r) for r in _RANKS], F.array_append(s["out"], done).alias("out"),
            )

        full = (s["tokens"] + x["tokens"] - s["begin_tokens"] > budget) & best.isNotNull()
        return F.when(full, F.element_at(F.transform(F.array(best), cut), 1)).otherwise(s)

    def step(s: Column, x: Column) -> Column:
        def add(s: Column) -> Column:
            at, tokens, chars = s["at"] + 1, s["tokens"] + x["tokens"], s["chars"] + x["chars"]
            mark = F.struct(at.alias("at"), tokens.alias("tokens"), chars.alias("chars"))
            free = F.lit(True) if atomic is None else ~F.coalesce(F.exists(atomic, lambda r: (r["start"] < chars) & (chars < r["end"])), F.lit(False))
            return F.struct(
                at.alias("at"), tokens.alias("tokens"), chars.alias("chars"), s["begin"].alias("begin"), s["begin_tokens"].alias("begin_tokens"),
                *[F.when((x["rank"] == k) & free, mark).otherwise(s[r]).alias(r) for k, r in enumerate(_RANKS, 1)], s["out"].alias("out"),
            )

        # a cut uses up a place; there are two for each rank at most
        fitted = F.aggregate(F.sequence(F.lit(1), F.lit(2 * len(_RANKS))), s, lambda t, _: end_piece(t, x))
        full = s["tokens"] + x["tokens"] - s["begin_tokens"] > budget
        return F.when(full, F.element_at(F.transform(F.array(fitted), add), 1)).otherwise(add(s))

    last = lambda s: F.struct(s["at"].alias("at"), s["chars"].alias("chars"), (s["tokens"] - s["begin_tokens"] > budget).alias("over"))
    return F.aggregate(parts, zero, step, lambda s: F.array_append(s["out"], last(s)))


def chunk_body(nodes: DataFrame, most_tokens: int = 512, count: str | Callable[[Column], Column] = "words") -> DataFrame:
    """Zero-overlap chunks of node texts (node_id, text, and atomic: ranges of a text that stay whole, if there are any)
    within a token budget: node_id, ordinal, start, end, text and fault.

    Each chunk is as long as it may be, and ends at the end of a line, else of a sentence, else of a word, else of an
    extended grapheme cluster. It does not end in an introducing word if something is left before it. Chunks of a node
    concatenate to its text. `fault` tells of a chunk over the budget, as nothing in it may be cut, and of a blank one.
    `count` is one of COUNTERS or gives the tokens of a column of parts of text, such as a caller's model by an Arrow
    UDF; a chunk counts as the sum of its parts. Null and blank texts give no chunks.
    """
    has = "atomic" in nodes.columns
    rows = nodes.select("node_id", "text", *[F.col("atomic").cast("array<struct<start:bigint,end:bigint>>").alias("atomic")] * has).where(F.col("text").rlike(r"(?U)\S"))
    rows = rows.withColumn("parts", parts_of(F.col("text"), most_tokens, COUNTERS[count] if isinstance(count, str) else count))
    rows = rows.withColumn("cuts", cuts_of(F.col("parts"), most_tokens, F.col("atomic") if has else None))
    before = lambda i, c: F.coalesce(F.get(F.col("cuts"), i - 1)[c], F.lit(0))
    text = lambda x, i: F.array_join(F.transform(F.slice("parts", before(i, "at") + 1, x["at"] - before(i, "at")), lambda p: p["part"]), "")
    pieces = F.transform("cuts", lambda x, i: F.struct(i.alias("ordinal"), before(i, "chars").cast("int").alias("start"), x["chars"].cast("int").alias("end"), text(x, i).alias("text"), x["over"].alias("over")))
    rows = rows.select("node_id", F.inline(pieces))
    fault = F.when(F.col("over") | ~F.col("text").rlike(r"(?U)\S"), TOO_LONG)
    return rows.select("node_id", "ordinal", "start", "end", "text", fault.alias("fault"))


def fitting_prefix(text: Column, budget: int, count: str | Callable[[Column], Column] = "words") -> Column:
    """The longest beginning of a text within a token budget, to whole extended grapheme clusters; empty if none fits.

    Parts are added while they fit; the first that does not is taken by its clusters, and nothing after it.
    """
    counted = COUNTERS[count] if isinstance(count, str) else count
    zero = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("chars"), F.lit(True).alias("open"))

    def add(s: Column, p: Column) -> Column:
        fits = s["open"] & (s["tokens"] + counted(p) <= budget)
        return F.struct((s["tokens"] + F.when(fits, counted(p)).otherwise(0)).alias("tokens"), (s["chars"] + F.when(fits, F.char_length(p)).otherwise(0)).alias("chars"), fits.alias("open"))

    def step(s: Column, p: Column) -> Column:
        letters = F.aggregate(F.regexp_extract_all(p, F.lit(r"\X"), F.lit(0)), s, add)
        stopped = F.element_at(F.transform(F.array(letters), lambda t: t.withField("open", F.lit(False))), 1)
        return F.when(~s["open"], s).when(s["tokens"] + counted(p) <= budget, add(s, p)).otherwise(stopped)

    return F.left(text, F.aggregate(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), zero, step, lambda s: s["chars"]).cast("int"))


def label_of(kind: Column, text: Column, chars: int = 30) -> Column:
    return F.when(kind.isin("section", "clause"), F.left(text, F.lit(chars))).otherwise(F.lit(""))
