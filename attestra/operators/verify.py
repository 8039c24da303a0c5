"""Answer verification: claims against the evidence that they cite, and the publication policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import normalised, numeric_literals, numeric_value, textual_subject
from attestra.plans.staging import staged  # noqa: F401  nothing is staged here any more, which a test counts

SAFE_ISSUES = ("missing_condition", "incomplete_support")
SAFE_REASONS = ("MISSING_CONDITION", "INCOMPLETE_SUPPORT")


def cited(claims: DataFrame) -> DataFrame:
    """One row for each claim and cited id."""
    return claims.select("pack_id", "claim_id", F.explode("evidence_ids").alias("evidence_id"))


def claims_bound(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Citations of ids that the pack does not have."""
    return cited(claims).join(units.select("pack_id", "evidence_id"), ["pack_id", "evidence_id"], "left_anti")


def repeated_claims(claims: DataFrame) -> DataFrame:
    """Texts that come more than once in a pack with the same set of citations."""
    key = F.array_sort(F.array_distinct("evidence_ids"))
    return claims.groupBy("pack_id", "text", key.alias("ids")).agg(F.count_distinct("claim_id").alias("claims"), F.min("claim_id").alias("first_claim")).where("claims > 1")


def numeric_support(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Per claim, its numbers that stand in none of its own cited excerpts."""
    own = claims.select("pack_id", "claim_id", numeric_literals(F.col("text")).alias("numbers"), "evidence_ids")
    rows = own.select("pack_id", "claim_id", "numbers", F.explode_outer("evidence_ids").alias("evidence_id")).withColumn("excerpt", F.lit(None).cast("string"))
    kind = lambda c: own.schema[c].dataType
    given = units.select("pack_id", F.lit(None).cast(kind("claim_id")).alias("claim_id"), F.lit(None).cast("array<string>").alias("numbers"), "evidence_id", "excerpt")
    # what a claim cites meets the excerpts in a window, not in a join: rows that are dealt by pack stay where they are
    same = Window.partitionBy("pack_id", "evidence_id")
    rows = rows.unionByName(given).withColumn("there", F.collect_list("excerpt").over(same)).where("claim_id is not null")
    there = F.flatten(F.collect_list(F.when(F.col("evidence_id").isNotNull(), F.flatten(F.transform("there", numeric_literals)))))
    rows = rows.groupBy("pack_id", "claim_id", "numbers").agg(there.alias("there"))
    missing = F.array_sort(F.array_except("numbers", "there"))
    return rows.select("pack_id", "claim_id", missing.alias("missing"), (F.size(missing) == 0).alias("supported"))


def citation_groups(cells: DataFrame, scopes: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Per data cell with text, the units that must be cited with it, in the pack's order; cells that need none are left out.

    These are: all headers and units of measure above it in one of its columns; the textual subjects of its row that
    stand wholly to its left; and the deepest of `scopes` (pack_id, evidence_id, position, path) whose path the table's
    path goes on from. cells: pack_id, evidence_id, row, col, excerpt, and where they differ from the defaults table_id
    (0), role (row 0: header, else data), row_span and col_span (1), position (by row and column) and path (none).
    `only` (pack_id, evidence_id), such as the units that are cited, are the cells asked for, if not all are.
    """
    has = cells.columns
    given = lambda name, default: F.col(name) if name in has else default
    role = given("role", F.when(F.col("row") == 0, "header").otherwise("data"))
    table = ["pack_id", *["table_id"] * ("table_id" in has)]
    position, col_span = given("position", F.col("row") * 100_000 + F.col("col")), given("col_span", F.lit(1))
    said = (role == "data") & (F.trim("excerpt") != "")
    unit = F.struct(position.alias("position"), "evidence_id", F.col("col").cast("long").alias("begin"), (F.col("col") + col_span).cast("long").alias("end"))
    path = ["path"] if scopes is not None and "path" in has else []
    rows = cells.select(*table, "row", "col", unit.alias("unit"), *path, F.when(role.isin("header", "unit"), "head").when(said & textual_subject(F.col("excerpt")), "subject").when(said, "value").alias("as"), given("row_span", F.lit(1)).alias("row_span"))
    rows = rows.where("as is not null").withColumn("own", F.lit(True))
    if "row_span" in has:  # a subject stands in each of its rows
        more = F.transform(F.sequence(F.lit(0), F.when(F.col("as") == "subject", F.col("row_span") - 1).otherwise(0)), lambda k: F.struct((F.col("row") + k).alias("row"), (k == 0).alias("own")))
        rows = rows.withColumn("_at", F.explode(more)).withColumns({"row": F.col("_at.row"), "own": F.col("_at.own")})

    asked = F.lit(True)
    if only is not None:
        rows = rows.withColumn("_id", F.col("unit.evidence_id")).unionByName(only.select("pack_id", F.col("evidence_id").alias("_id"), F.lit(True).alias("_only")), allowMissingColumns=True)
        rows = rows.withColumn("_only", F.coalesce(F.max("_only").over(Window.partitionBy("pack_id", "_id")), F.lit(False))).where("`as` is not null")
        asked = F.col("_only")
    units = lambda test: F.collect_list(F.when(test, F.col("unit")))
    data = F.struct("col", "unit", *path)
    lines = rows.groupBy(*table, "row").agg(units(F.col("as") == "head").alias("heads"), units(F.col("as") == "subject").alias("subjects"), F.collect_list(F.when(asked & F.col("own") & (F.col("as") != "head"), data)).alias("data"))
    above = Window.partitionBy(*table).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("heads", F.flatten(F.collect_list(F.when(F.size("heads") > 0, F.col("heads"))).over(above)))
    out = lines.select(*table, F.col("row").alias("data_row"), "heads", "subjects", F.explode("data").alias("d"))
    d = F.col("d.unit")
    needed = [F.filter("heads", lambda u: (u["begin"] < d["end"]) & (d["begin"] < u["end"])), F.filter("subjects", lambda u: (u["end"] <= d["begin"]) & (u["evidence_id"] != d["evidence_id"]))]
    if path:
        out = out.withColumn("path", F.col("d.path"))
        about = scopes.select("pack_id", F.struct("position", "evidence_id").alias("unit"), F.col("path").alias("scope"))
        tables = out.select(*table, "path").distinct().join(about, "pack_id").where((F.size("scope") < F.size("path")) & (F.slice("path", 1, F.size("scope")) == F.col("scope")))
        deepest = tables.groupBy(*table, "path").agg(F.max(F.size("scope")).alias("depth"))
        around = tables.join(deepest, [*table, "path"]).where(F.size("scope") == F.col("depth"))
        out = out.join(around.groupBy(*table, "path").agg(F.collect_list("unit").alias("around")), [*table, "path"], "left")
        out = out.withColumn("around", F.transform(F.coalesce("around", F.array().cast(out.schema["around"].dataType)), lambda u: F.struct(u["position"].alias("position"), u["evidence_id"].alias("evidence_id"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end"))))
        needed.append(F.col("around"))
    out = out.withColumn("required", F.array_distinct(F.sort_array(F.concat(*needed))["evidence_id"])).where(F.size("required") > 0)
    return out.select("pack_id", F.col("d.unit.evidence_id").alias("trigger"), F.col("data_row").alias("row"), F.col("d.col").alias("col"), "required")


def row_options(cells: DataFrame) -> DataFrame:
    """Per table row with a subject and a value: its subjects, its numeric values and the complete citation set."""
    rows = cells.where("row > 0").withColumns({"v": numeric_value(F.col("excerpt")), "s": textual_subject(F.col("excerpt"))})
    last = Window.partitionBy("pack_id", "row")
    rows = rows.withColumn("s", F.col("s") & (F.col("col") < F.max(F.when(F.col("v"), F.col("col"))).over(last)))
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("col", "evidence_id")))), lambda x: x["evidence_id"])
    out = rows.groupBy("pack_id", "row").agg(ids(F.col("s")).alias("subjects"), ids(F.col("v") & ~F.col("s")).alias("values"))
    return out.where((F.size("subjects") > 0) & (F.size("values") > 0)).withColumn("complete", F.array_distinct(F.concat("subjects", "values")))


def numeric_table_context(claims: DataFrame, units: DataFrame, groups: DataFrame) -> DataFrame:
    """Claims that state a number of a cited table cell without citing the context that the cell needs."""
    asked = claims.select("pack_id", "claim_id", "evidence_ids", numeric_literals(F.col("text")).alias("said"))
    asked = asked.withColumn("trigger", F.explode("evidence_ids"))
    rows = asked.unionByName(groups.select("pack_id", "trigger", "required"), allowMissingColumns=True).unionByName(units.select("pack_id", F.col("evidence_id").alias("trigger"), "excerpt"), allowMissingColumns=True)
    same = Window.partitionBy("pack_id", "trigger")  # in place of two joins: rows that are dealt by pack stay where they are
    rows = rows.withColumns({"groups": F.collect_list("required").over(same), "excerpts": F.collect_list("excerpt").over(same)}).where("claim_id is not null and trigger is not null and size(groups) > 0")
    hit = rows.select("pack_id", "claim_id", "trigger", "evidence_ids", "groups", F.explode(F.filter("excerpts", lambda x: F.arrays_overlap("said", numeric_literals(x)))))
    hit = hit.select("pack_id", "claim_id", "trigger", "evidence_ids", F.explode("groups").alias("required"))
    return hit.withColumn("missing", F.array_sort(F.array_except("required", "evidence_ids"))).where(F.size("missing") > 0).select("pack_id", "claim_id", "trigger", "missing")


def critic_flags() -> dict[str, Column]:
    """Aggregates of the verdicts of one draft."""
    partial = F.col("verdict") == "partially_supported"
    safe = F.col("issue_type").isin(*SAFE_ISSUES) & F.col("reason_code").isin(*SAFE_REASONS)
    return {
        "refused": F.coalesce(F.bool_or(F.col("verdict").isin("unsupported", "contradicted")), F.lit(False)),
        "partial": F.coalesce(F.bool_or(partial), F.lit(False)), "unsafe": F.coalesce(F.bool_or(partial & ~safe), F.lit(False)),
    }


def critic_policy(verdicts: DataFrame, critics: DataFrame) -> DataFrame:
    """render, repair or refuse for each pack. critics: pack_id, question_match, missing_parts, global_issues (counts)."""
    flags = verdicts.groupBy("pack_id").agg(*[c.alias(n) for n, c in critic_flags().items()])
    rows = critics.join(flags, "pack_id", "left").fillna(False, ["refused", "partial", "unsafe"])
    refuse = F.col("refused") | (F.col("question_match") == "no") | (F.col("global_issues") > 0) | F.col("unsafe")
    repair = (F.col("question_match") == "partial") | (F.col("missing_parts") > 0) | F.col("partial")
    return rows.withColumn("action", F.when(refuse, "refuse").when(repair, "repair").otherwise("render"))


def decide(flagged: DataFrame) -> DataFrame:
    """Adds status, action and reason to rows of critic_policy with repairs (attempts) and variants (missing)."""
    c = F.col
    incomplete = c("partial") | (c("question_match") == "partial") | (c("missing_parts") > 0) | (c("variants") > 0)
    reason = (
        F.when(c("refused"), "UNSUPPORTED_CLAIM").when(c("question_match") == "no", "QUESTION_MISMATCH").when(c("global_issues") > 0, "GLOBAL_ISSUE").when(c("unsafe"), "UNSAFE_PARTIAL")
        .when(incomplete & (c("variants") > 0), "INCOMPLETE_TABLE_VARIANT").when(incomplete & (c("repairs") > 0), "REPAIR_EXHAUSTED").when(incomplete, "INCOMPLETE_ANSWER").otherwise("SUPPORTED")
    )
    hard = c("reason").isin("UNSUPPORTED_CLAIM", "QUESTION_MISMATCH", "GLOBAL_ISSUE", "UNSAFE_PARTIAL")
    status = F.when(hard, "hallucinated").when(c("reason") == "SUPPORTED", "confirmed").otherwise("partially_confirmed")
    action = F.when(c("reason") == "SUPPORTED", "render").when(hard | (c("repairs") > 0), "refuse").otherwise("repair")
    return flagged.withColumn("reason", reason).withColumns({"status": status, "action": action})


def verdict_consistency(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """Per claim or verdict, what is wrong: no verdict, no claim, a verdict that contradicts its reason or issue, or
    ids that the claim does not cite. Consistent claims give no row."""
    v = verdicts.select("pack_id", "claim_id", "verdict", "reason_code", "issue_type", F.col("evidence_ids").alias("verdict_ids"))
    both = claims.select("pack_id", "claim_id", F.col("evidence_ids").alias("claim_ids")).join(v, ["pack_id", "claim_id"], "full")
    supported = F.col("verdict") == "supported"
    fault = (
        F.when(F.col("verdict").isNull(), "missing_verdict").when(F.col("claim_ids").isNull(), "unknown_claim")
        .when(supported != (F.col("reason_code") == "SUPPORTED"), "reason").when(supported != (F.col("issue_type") == "none"), "issue")
        .when(supported & (F.size("verdict_ids") == 0), "no_evidence").when(F.size(F.array_except("verdict_ids", "claim_ids")) > 0, "foreign_evidence")
    )
    return both.select("pack_id", "claim_id", fault.alias("fault")).where("fault is not null")


def claim_source_view(claims: DataFrame, options: DataFrame) -> DataFrame:
    """Per claim and table row that it touches: the cited part of the row's complete set, and whether it is whole."""
    touched = claims.select("pack_id", "claim_id", "evidence_ids").join(options.select("pack_id", "row", "complete"), "pack_id").where(F.arrays_overlap("complete", "evidence_ids"))
    part = F.array_sort(F.array_intersect("complete", "evidence_ids"))
    return touched.select("pack_id", "claim_id", "row", part.alias("cited"), (F.size(part) == F.size("complete")).alias("whole"))


def citation_numbers(claims: DataFrame) -> DataFrame:
    """Citation labels C001, C002, … of a pack's ids by their first use across its claims."""
    used = claims.select("pack_id", "claim_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    first = used.groupBy("pack_id", "evidence_id").agg(F.min(F.struct("claim_id", "pos")).alias("first"))
    number = F.row_number().over(Window.partitionBy("pack_id").orderBy("first"))
    return first.select("pack_id", "evidence_id", F.concat(F.lit("C"), F.lpad(number.cast("string"), 3, "0")).alias("label"))


def render_answer(claims: DataFrame) -> DataFrame:
    """Per pack, the claims in order with their citation marks, and the number of citations."""
    marks = claims.select("pack_id", "claim_id", "text", F.posexplode("evidence_ids").alias("pos", "evidence_id")).join(citation_numbers(claims), ["pack_id", "evidence_id"])
    line = marks.groupBy("pack_id", "claim_id", "text").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    line = line.withColumn("line", F.concat("text", F.lit(" ["), F.array_join("labels", ", "), F.lit("]")))
    whole = line.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "line"))).alias("lines"), F.size(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("citations"))
    return whole.select("pack_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"), F.col("citations").cast("long").alias("citations"))


def unit_required_ids(groups: DataFrame) -> DataFrame:
    """Per trigger unit, the union of what its groups require, sorted."""
    ids = F.array_distinct(F.flatten(F.collect_list("required")))
    return groups.where(F.size("required") > 0).groupBy("pack_id", "trigger").agg(F.sort_array(F.array_compact(ids)).alias("required"))


def contrast_rows(subjects: DataFrame) -> DataFrame:
    """Pairs of neighbouring data rows of a table whose subjects begin alike (pack_id, row, subject)."""
    from attestra.functions.text import word_prefix

    w = Window.partitionBy("pack_id").orderBy("row")
    near = subjects.withColumns({"next_row": F.lead("row").over(w), "next_subject": F.lead("subject").over(w)})
    return near.where(word_prefix(F.col("subject"), F.col("next_subject"))).select("pack_id", "row", "next_row")


DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9\u2070-\u2079\u2080-\u2089]"


def _with(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def citation_closures(units: DataFrame, groups: DataFrame, options: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Sets of citations that go together (pack_id, start, ids): what a numeric trigger, or a row of `options`, requires.

    A trigger is a unit of the pack that has a group and a digit in its excerpt. A closure has its start, all that is
    required by the triggers among its ids, and so on: only triggers lead further, other ids end the way. Ids come in
    the order of the pack, those that are subjects of a trigger's row first, other triggers next. Closures of more than
    `most` ids, the start counted, are dropped whole, and so are those without a trigger; equal ones are given once,
    under the first start, triggers before rows. units: pack_id, evidence_id, excerpt, position; groups: pack_id,
    trigger, required and, where there are any, subjects; options: pack_id, row, values, complete.

    A pack, whose ids are unique, is gathered to one row in which its ids are places, and its closures grow there, so rows
    that are dealt by pack stay in their tasks and no round is written. A closure that is too long already, or has
    nothing ahead of it, rests: each round adds an id at least, so `most` rounds do for all that are kept.
    """
    c, none = F.col, F.array().cast("array<string>")
    given = lambda rows, name: F.coalesce(name, none).alias(name) if name in rows.columns else none.alias(name)
    unit = F.struct("position", F.col("evidence_id").alias("id"), F.coalesce(F.col("excerpt").rlike(DIGIT), F.lit(False)).alias("digit"))
    rows = units.select("pack_id", unit.alias("unit")).unionByName(groups.select("pack_id", F.struct("trigger", given(groups, "required"), given(groups, "subjects")).alias("group")), allowMissingColumns=True)
    more = []
    if options is not None:
        some = options.groupBy("pack_id", "row").agg(F.collect_list(F.struct(given(options, "values"), given(options, "complete"))).alias("sets"))
        rows = rows.unionByName(some.select("pack_id", F.struct("row", "sets").alias("option")), allowMissingColumns=True)
        more = [F.collect_list("option").alias("options")]
    packs = rows.groupBy("pack_id").agg(F.sort_array(F.collect_list("unit")).alias("units"), F.collect_list("group").alias("groups"), *more)

    packs = packs.withColumns({"names": F.transform("units", lambda u: u["id"]), "triggers": F.transform("groups", lambda g: g["trigger"])})
    packs = packs.withColumn("once", F.size(F.array_distinct("triggers")) == F.size("triggers"))
    place = lambda x, of: F.coalesce(F.array_position(of, x).cast("int"), F.lit(0))
    places = lambda ids: F.array_remove(F.array_distinct(F.transform(ids, lambda x: place(x, "names"))), 0)
    one = lambda k: F.slice("groups", F.greatest(k, F.lit(1)), F.when(k > 0, 1).otherwise(0))
    own = lambda u: F.when(~u["digit"], F.slice("groups", 1, 0)).when(c("once"), _with(place(u["id"], "triggers"), one)).otherwise(F.filter("groups", lambda g: g["trigger"] == u["id"]))
    packs = packs.withColumn("own", F.transform("units", own))
    every = lambda name: F.transform("own", lambda gs: places(F.flatten(F.transform(gs, lambda g: g[name]))))
    packs = packs.withColumns({"is": F.transform("own", lambda gs: F.size(gs) > 0), "to": every("required"), "subjects": every("subjects")})

    numeric = lambda i: F.element_at("is", i)
    ahead = lambda ids: F.filter(ids, numeric)
    reach = lambda ids, name: F.flatten(F.transform(ids, lambda i: F.element_at(name, i)))
    state = lambda ids, front: F.struct(ids.alias("ids"), front.alias("front"))
    step = lambda s: _with(F.array_except(reach(s["front"], "to"), s["ids"]), lambda new: state(F.concat(s["ids"], new), ahead(new)))
    rests = lambda s: (F.size(s["front"]) == 0) | (F.size(s["ids"]) > most)
    grown = lambda ids: F.aggregate(F.sequence(F.lit(1), F.lit(most)), state(ids, ahead(ids)), lambda s, _: F.when(rests(s), s).otherwise(step(s)))["ids"]
    begin = lambda kind, at, start, ids: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"), start.alias("start"), grown(ids).alias("ids"))
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.size("units")), numeric), lambda i: _with(F.element_at("units", i), lambda u: begin(0, u["position"], u["id"], F.array(i))))
    if options is not None:
        counts = lambda x: F.exists(places(x["values"]), numeric)
        complete = lambda o: F.array_distinct(F.flatten(F.transform(F.filter(o["sets"], counts), lambda x: places(x["complete"]))))
        label = lambda o: F.concat(F.lit("row "), o["row"].cast("string"))
        starts = F.concat(starts, F.transform("options", lambda o: begin(1, o["row"], label(o), complete(o))))
    packs = packs.withColumn("starts", F.when(F.size("units") > 0, starts))
    fits = lambda x: (F.size(x["ids"]) <= most) & F.exists(x["ids"], numeric)
    rest = lambda ids: F.concat(ahead(ids), F.filter(ids, lambda i: ~numeric(i)))
    order = lambda ids: _with(reach(ahead(ids), "subjects"), lambda subjects: _with(F.sort_array(ids), lambda ids: F.concat(F.array_intersect(ids, subjects), rest(F.array_except(ids, subjects)))))
    packs = packs.withColumn("found", F.sort_array(F.transform(F.filter("starts", fits), lambda x: F.struct(order(x["ids"]).alias("ids"), x["kind"].alias("kind"), x["at"].alias("at"), x["start"].alias("start")))))
    first = F.filter("found", lambda x, i: F.coalesce(F.get(c("found"), i - 1)["ids"] != x["ids"], F.lit(True)))  # equal ones are neighbours
    named = F.transform(first, lambda x: F.struct(x["start"].alias("start"), F.transform(x["ids"], lambda i: F.element_at("names", i)).alias("ids")))
    return packs.select("pack_id", F.inline(named))


def artifact_lineage(artifacts: DataFrame, failed: str) -> DataFrame:
    """Artifacts (artifact_id, run_id, status, parents) with a parent that is missing, of another run, or failed."""
    rows = artifacts.select("artifact_id", "run_id", F.explode("parents").alias("parent"))
    up = artifacts.select(F.col("artifact_id").alias("parent"), F.col("run_id").alias("parent_run"), F.col("status").alias("parent_status"))
    fault = F.when(F.col("parent_run").isNull(), "missing_parent").when(F.col("parent_run") != F.col("run_id"), "other_run").when(F.col("parent_status") == failed, "failed_parent")
    return rows.join(up, "parent", "left").select("artifact_id", fault.alias("fault")).where("fault is not null")


def plain_words(text: Column) -> Column:
    """The words of a text in compatibility form, case folded, ё as е."""
    return F.regexp_extract_all(comparable(text), F.lit(r"(?U)\w+"), F.lit(0))


def comparable(text: Column) -> Column:
    return F.translate(normalised(text, "NFKC", fold=True), "ё", "е")


BUCKET = ("source", "path", "table_id", "columns")


def variant_groups(options: DataFrame) -> DataFrame:
    """Per pack, row options (option, subject) whose words hold those of a shorter one, the base, as a run: base and
    members, the base among them.

    Only options of one source, path, table and set of value columns (those of BUCKET that `options` has) are compared.
    Subjects of one word are no base, and neither is a member of another base's group. Candidates share the base's first
    word: each subject is listed under every one of its words, so the join is on (bucket, word), not on all pairs.
    """
    bucket = ["pack_id", *[c for c in BUCKET if c in options.columns]]
    rows = options.select(*bucket, "option", plain_words(F.col("subject")).alias("w")).where(F.size("w") >= 2).dropna(subset=bucket)
    same = Window.partitionBy(*bucket, "word")
    rows = rows.repartition("pack_id").withColumn("word", F.explode(F.array_distinct("w")))
    rows = rows.withColumn("bases", F.collect_list(F.when(F.col("word") == F.col("w")[0], F.struct("option", "w"))).over(same))
    run = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    held = F.filter("bases", lambda x: (F.size("w") > F.size(x["w"])) & F.contains(run(F.col("w")), run(x["w"])))
    hit = rows.select("pack_id", "option", F.explode(held["option"]).alias("base"))
    # a hit counts for its base, and shows that its option is a member
    hit = hit.select("pack_id", F.inline(F.array(F.struct(F.col("base").alias("base"), F.col("option").alias("refined")), F.struct(F.col("option").alias("base"), F.lit(None).cast(options.schema["option"].dataType).alias("refined")))))
    groups = hit.groupBy("pack_id", "base").agg(F.collect_set("refined").alias("refined"), F.bool_or(F.col("refined").isNull()).alias("inner")).where("not inner")
    return groups.select("pack_id", "base", F.array_sort(F.array_append("refined", F.col("base"))).alias("members"))


def missing_variants(questions: DataFrame, claims: DataFrame, options: DataFrame, groups: DataFrame, most: int = 12) -> DataFrame:
    """What an answer lacks of the table rows that its question selects: pack_id, number, row and the ids to cite.

    A group counts if the answer cites a value of one of its members. Of its members the question (pack_id, question)
    selects those whose subject it quotes, and those, but for the base, that have words no other member has, all of which
    the question has too; if there are none, all count. A member whose complete set is not cited lacks its uncited
    subjects and values, or else the rest of the set. The first `most` of a pack are given, by group and member.
    options: pack_id, option, row, subject, subjects, values, complete; groups: as `variant_groups` gives them.
    """
    none = F.array().cast("array<string>")
    cited = claims.groupBy("pack_id").agg(F.array_distinct(F.flatten(F.collect_list("evidence_ids"))).alias("cited"))
    asked = questions.select("pack_id", plain_words(F.col("question")).alias("asked"), F.regexp_extract_all(comparable(F.col("question")), F.lit('["«“](.*?)["»”]'), F.lit(1)).alias("quoted"))
    rows = options.select("pack_id", "option", "row", "subject", "subjects", "values", "complete").withColumn("base", F.lit(None).cast(groups.schema["base"].dataType))
    rows = rows.unionByName(groups.where(F.size("members") > 1).select("pack_id", "base", F.explode("members").alias("option")), allowMissingColumns=True)
    rows = rows.withColumn("bases", F.collect_list("base").over(Window.partitionBy("pack_id", "option"))).where("base is null").withColumn("base", F.explode("bases")).drop("bases")
    rows = rows.withColumns({"words": F.array_distinct(plain_words(F.col("subject"))), "said": comparable(F.col("subject"))}).join(cited, "pack_id").join(asked, "pack_id")
    group = Window.partitionBy("pack_id", "base")
    rows = rows.withColumn("touched", F.max(F.arrays_overlap("cited", "values")).over(group)).where("touched")
    plain = [c for c in rows.columns if c not in ("pack_id", "base", "option", "touched")]
    rows = rows.withColumn("word", F.explode_outer("words")).withColumn("n", F.count("*").over(Window.partitionBy("pack_id", "base", "word")))
    rows = rows.groupBy("pack_id", "base", "option").agg(*[F.first(c).alias(c) for c in plain], F.collect_list(F.when(F.col("n") == 1, F.col("word"))).alias("own"))
    by_words = (F.col("option") != F.col("base")) & (F.size("own") > 0) & (F.size(F.array_except("own", "asked")) == 0)
    chosen = F.coalesce(((F.col("said") != "") & F.array_contains("quoted", F.col("said"))) | by_words, F.lit(False))
    rows = rows.withColumn("chosen", chosen).withColumn("some", F.max("chosen").over(group)).where("chosen or not some")
    lacks, rest = F.array_except(F.concat("subjects", "values"), "cited"), F.array_except("complete", "cited")
    rows = rows.withColumn("missing", F.when(F.size(rest) == 0, none).when(F.size(lacks) > 0, lacks).otherwise(rest)).where(F.size("missing") > 0)
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("pack_id").orderBy("base", "option")))
    return rows.where(F.col("number") <= most).select("pack_id", "number", "row", "missing")


def refusal_check(results: DataFrame, artifacts: DataFrame, packs: DataFrame) -> DataFrame:
    """Per refused run (run_id, code), whether an artifact (role, outcome) or the missing pack proves the code: the
    router for out of scope, no evidence for not found, a refusing critic for verification, a failed model for schema."""
    has = lambda role, outcome: F.coalesce(F.bool_or((F.col("role") == role) & (F.col("outcome") == outcome)), F.lit(False))
    flags = artifacts.groupBy("run_id").agg(has("router", "out_of_scope").alias("router"), has("critic", "refuse").alias("critic"), has("drafter", "failed").alias("model"))
    found = packs.where("units > 0").select("run_id").distinct().withColumn("evidence", F.lit(True))
    rows = results.join(flags, "run_id", "left").join(found, "run_id", "left")
    c = lambda n: F.coalesce(n, F.lit(False))
    proven = F.when(F.col("code") == "OUT_OF_SCOPE", c("router")).when(F.col("code") == "EVIDENCE_NOT_FOUND", ~c("evidence")).when(F.col("code") == "VERIFICATION_FAILED", c("critic")).when(F.col("code") == "OUTPUT_SCHEMA_INVALID", c("model")).otherwise(F.lit(False))
    return rows.select("run_id", proven.alias("proven"))
