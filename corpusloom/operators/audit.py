"""Audit rules over document blocks: sections, locating tasks, table rules, values across sections, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.retrieve import ranked
from corpusloom.operators.sizes import small

#: Fixed values, limits of an evidence group, and the gap under which two groups are ambiguous.
MOST_BLOCKS, MOST_CHARS, GAP = 50, 6000, 0.06
#: Fixed value: a positive number of persons.
HEADCOUNT = r"^\s*([1-9]\d*)\s*(?:人|名|位)?\s*$"
#: Words of rows that are notes.
NOTES = ("说明", "注：", "签字", "盖章", "日期", "示例")
#: Entries that every directory has.
FIXED_ENTRIES = ("目录", "第一章", "第二章", "第三章", "第四章", "第五章", "附录A", "附录B", "附录C", "附录D", "附录E")


def section_paths(blocks: DataFrame, level: Column, title: Column, deepest: int = 6) -> DataFrame:
    """blocks (document_id, ordinal) with section: the titles above each block and its own, where level tells a heading.

    A heading of level k is live until one of a level up to k follows: the stack of headings as one segmented scan.
    """
    w = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    out = blocks.withColumns({f"h{k}": F.last(F.when(level == k, F.struct("ordinal", title.alias("text"))), ignorenulls=True).over(w) for k in range(1, deepest + 1)})
    live = [F.when(F.col(f"h{k}.ordinal") > (F.greatest(*[F.coalesce(F.col(f"h{j}.ordinal"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) if k > 1 else F.lit(-1)), F.col(f"h{k}.text")) for k in range(1, deepest + 1)]
    return out.withColumn("section", F.array_compact(F.array(*live))).drop(*[f"h{k}" for k in range(1, deepest + 1)])


def sections(blocks: DataFrame, deepest: int = 6) -> DataFrame:
    """blocks (document_id, ordinal, block_type, level, text) with section: the headings above each, and their own.

    TOC entries are no headings.
    """
    return section_paths(blocks, F.when(F.col("block_type") == "heading", F.col("level")), F.col("text"), deepest)


#: Locators too weak to stand in plain text, shares of a group's score and its ceiling.
WEAK = ("施工方案", "工序", "控制措施", "→")
BASE, IN_REGION, HEADING, OTHER, MATCH, MOST_MATCH, CEILING = 0.42, 0.32, 0.16, 0.06, 0.02, 0.08, 0.99
#: Blocks that hold no content of their own.
NO_CONTENT = ("toc_entry", "header", "footer")


def located(blocks: DataFrame, tasks: DataFrame, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """Best group of each task in each document: its anchor, score and status (located, ambiguous, not_located).

    tasks has task_id, locators and regions (none: anywhere). Texts, sections, locators and regions are compared by
    their match keys. A block with locators counts in one of the task's regions or as a heading, and a heading in a
    region counts without any; weak locators alone count in headings and tables only. Blocks of one section are a
    group, whose locators are those of all its blocks; its anchor is a heading first, then the block with most
    locators. Two groups of nearly equal score are ambiguous if the first lies outside the regions or both have the
    same locators. Blocks without content, of digits or of page heads and feet do not count.
    """
    keyed = blocks.where(~F.col("block_type").isin(*NO_CONTENT)).withColumns({"key": tx.match_key(F.col("text")), "place": tx.match_key(F.concat_ws(" ", F.concat_ws(" ", "section"), "text"))})
    usable = keyed.where((F.col("key") != "") & ~F.col("key").rlike(r"^\d+$"))
    each = lambda column, name: tasks.select("task_id", F.posexplode_outer(column).alias("n", name))
    locators = each("locators", "term").where("term is not null").withColumn("k", tx.match_key(F.col("term"))).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("n", "term", "k"))).alias("terms"))
    regions = each("regions", "term").where("term is not null").withColumn("k", tx.match_key(F.col("term"))).groupBy("task_id").agg(F.collect_list("k").alias("region_keys"))
    told = tasks.select("task_id").join(locators, "task_id", "left").join(regions, "task_id", "left")
    heading, table = F.col("block_type") == "heading", F.col("block_type") == "table"
    exact = F.col("region_keys").isNull() | F.exists("region_keys", lambda k: F.contains(F.col("place"), k))
    found = F.transform(F.filter(F.coalesce("terms", F.expr("cast(array() as array<struct<n:int,term:string,k:string>>)")), lambda t: F.contains(F.col("key"), t["k"])), lambda t: t["term"])
    both = usable.join(small(told)).withColumns({"exact": exact, "found": found}).withColumn("matches", F.size("found"))
    strong = F.size(F.array_except("found", F.array(*[F.lit(w) for w in weak]))) > 0
    both = both.where(((F.col("matches") > 0) & (F.col("exact") | heading) | (heading & F.col("exact"))) & (strong | heading | table))
    group = F.when(F.size("section") > 0, F.array_join("section", "/")).otherwise(F.concat(F.lit("block:"), F.col("ordinal").cast("string")))
    first = F.min(F.struct((~heading).alias("plain"), (-F.col("matches")).alias("fewer"), "ordinal", "exact"))
    groups_ = both.groupBy("document_id", "task_id", group.alias("group")).agg(first.alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("found"))
    score = BASE + F.when(F.col("a.exact"), IN_REGION).otherwise(0.0) + F.when(F.col("a.plain"), OTHER).otherwise(HEADING) + F.least(F.lit(MOST_MATCH), MATCH * F.size("found"))
    scored = groups_.select("document_id", "task_id", "found", F.col("a.ordinal").alias("ordinal"), F.col("a.exact").alias("exact"), F.round(F.least(score, F.lit(CEILING)), 3).alias("score"))
    w = W.partitionBy("document_id", "task_id").orderBy(F.desc("score"), "ordinal")
    best = scored.withColumns({"place": F.row_number().over(w), "next_score": F.lead("score").over(w), "next_found": F.lead("found").over(w), "n_groups": F.count("*").over(W.partitionBy("document_id", "task_id"))}).where("place = 1")
    every = blocks.select("document_id").distinct().join(small(tasks.select("task_id")))
    out = every.join(best.select("document_id", "task_id", "ordinal", "score", "next_score", "n_groups", (~F.col("exact") | F.coalesce(F.col("found") == F.col("next_found"), F.lit(False))).alias("close")), ["document_id", "task_id"], "left")
    status = F.when(F.col("score").isNull(), "not_located").when(F.col("close") & F.coalesce(F.round(F.col("score") - F.col("next_score"), 3) < GAP, F.lit(False)), "ambiguous").otherwise("located")
    return out.select("document_id", "task_id", F.col("ordinal").alias("anchor"), "score", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), status.alias("status"))


def region_rows(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks from each anchor heading up to the next heading of its level or above, within the group's limits.

    A range join on (document, ordinal) with the end found once by a grouped minimum; truncated tells a cut.
    """
    heads = blocks.where("block_type = 'heading'").select("document_id", F.col("ordinal").alias("end"), F.col("level").alias("end_level"))
    ends = anchors.join(heads, "document_id", "left").groupBy("document_id", "task_id", "anchor").agg(F.min(F.when((F.col("end") > F.col("anchor")) & (F.col("end_level") <= F.col("anchor_level")), F.col("end"))).alias("end"))
    inside = ends.join(blocks, "document_id").where((F.col("ordinal") >= F.col("anchor")) & (F.col("end").isNull() | (F.col("ordinal") < F.col("end"))))
    w = W.partitionBy("document_id", "task_id", "anchor").orderBy("ordinal")
    out = inside.withColumns({"n": F.row_number().over(w), "so_far": F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    kept = (F.col("n") <= MOST_BLOCKS) & (F.col("so_far") <= MOST_CHARS)
    out = out.withColumns({"kept": kept, "truncated": F.max(~kept).over(W.partitionBy("document_id", "task_id", "anchor"))})
    return out.where("kept").select("document_id", "task_id", "anchor", "ordinal", "n", "so_far", "truncated")


def column_index(header: Column, field: Column | str) -> Column:
    """Place (from 1) of the first header cell that holds a field; 0 without."""
    return F.array_position(F.transform(header, lambda h: F.contains(h, field if isinstance(field, Column) else F.lit(field))), F.lit(True))


def value_at(row: Column, place: Column) -> Column:
    return F.when(place > 0, F.coalesce(F.try_element_at(row, place.cast("int")), F.lit(""))).otherwise(F.lit(""))


def missing_columns(tables: DataFrame, required: list[str]) -> DataFrame:
    """table_id and the required columns that no header cell holds."""
    fields = F.array(*[F.lit(f) for f in required])
    return tables.select("table_id", F.filter(fields, lambda f: column_index(F.col("header"), f) == 0).alias("missing"))


def missing_values(tables: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """Business rows of tables (table_id, header, rows) and how often each required field has no meaningful value.

    A business row has a meaningful key and none of the note words.
    """
    rows = tables.select("table_id", "header", F.explode("rows").alias("row"))
    named = F.lit(False)
    for k in keys:
        named = named | tx.is_meaningful(value_at(F.col("row"), column_index(F.col("header"), k)))
    noted = F.exists(F.array(*[F.lit(n) for n in NOTES]), lambda n: F.contains(F.array_join("row", " "), n))
    business = rows.where(named & ~noted)
    blank = lambda f: F.count_if(~tx.is_meaningful(value_at(F.col("row"), column_index(F.col("header"), f))))
    return business.groupBy("table_id").agg(F.count("*").alias("n_rows"), *[blank(f).alias(f"missing_{f}") for f in required])


def is_positive_headcount(value: Column) -> Column:
    return F.coalesce(value.rlike(HEADCOUNT), F.lit(False))


def missing_labels(text: Column, labels: tuple[str, ...]) -> Column:
    """Labels that a text without spaces does not hold."""
    compact = F.replace(text, F.lit(" "), F.lit(""))
    return F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: ~F.contains(compact, F.replace(x, F.lit(" "), F.lit(""))))


def missing_fixed_entries(text: Column) -> Column:
    return missing_labels(text, FIXED_ENTRIES)


#: Endings that say nothing, by the kind of a value.
ENDINGS = {"project_name": ("施工作业方案", "施工方案", "施工"), "location": ("平台", "井场", "站场"), "organization": ("，", ",", "。")}


def plain_value(value: Column) -> Column:
    """A value without white space, colons of one kind."""
    return F.replace(F.regexp_replace(value, r"(?U)\s+", ""), F.lit("："), F.lit(":"))


def value_of_kind(value: Column, kind: Column) -> Column:
    """plain_value() without the endings of its kind, each cut once in their order."""
    plain = plain_value(value)
    out = F.when(F.lit(False), plain)
    for name, endings in ENDINGS.items():
        cut = plain
        for e in endings:
            cut = F.regexp_replace(cut, e + "$", "")
        out = out.when(kind == name, cut)
    return out.otherwise(plain)


def labelled_values(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct document_id, label, value and ordinal of labels (label, kind) in four places.

    These are: "label: value" in a text; the texts of a section whose heading holds the label; the next text after
    such a heading, if no other heading comes first; the cell beside one that holds the label. blocks have
    document_id, ordinal, block_type, text, section (array) and rows (arrays of cells, or null).
    """
    labels = small(labels.select("label", "kind", plain_value(F.col("label")).alias("_label")))
    quoted = F.concat(F.lit(r"\Q"), F.col("label"), F.lit(r"\E\s*[：:]\s*([^\n|；;]{2,80})"))
    # what is compared is made plain once a block, before it meets the labels
    blocks = blocks.select("document_id", "ordinal", "block_type", "text", "section", "rows")
    told = blocks.join(labels, F.contains("text", F.col("label"))).select("document_id", "label", "kind", F.call_function("regexp_extract", F.col("text"), quoted, F.lit(1)).alias("value"), "ordinal")
    heading = F.col("block_type") == "heading"
    sections_ = blocks.where(~heading & (F.size("section") > 0)).select("document_id", "ordinal", "text", F.transform("section", plain_value).alias("_sections"))
    under = sections_.join(labels, F.exists("_sections", lambda s: F.contains(s, F.col("_label")))).select("document_id", "label", "kind", F.col("text").alias("value"), "ordinal")
    w = W.partitionBy("document_id").orderBy("ordinal")
    lead = blocks.where(heading | F.col("text").rlike(r"(?U)\S")).withColumns({"_type": F.lead("block_type").over(w), "_text": F.lead("text").over(w), "_at": F.lead("ordinal").over(w)})
    heads = lead.where(heading & (F.col("_type") != "heading")).select("document_id", "_text", "_at", plain_value(F.col("text")).alias("_plain"))
    below = heads.join(labels, F.contains("_plain", F.col("label"))).select("document_id", "label", "kind", F.col("_text").alias("value"), F.col("_at").alias("ordinal"))
    cells = blocks.where("rows is not null").select("document_id", "ordinal", F.explode("rows").alias("row")).select("document_id", "ordinal", "row", F.posexplode("row").alias("i", "cell")).where(F.col("i") + 1 < F.size("row"))
    cells = cells.select("document_id", "ordinal", F.get("row", F.col("i") + 1).alias("value"), plain_value(F.col("cell")).alias("_plain"))
    beside = cells.join(labels, F.contains("_plain", F.col("_label"))).select("document_id", "label", "kind", "value", "ordinal")
    # a generator: a filter below it would find each value again for every expression that reads it
    plain = F.filter(F.transform(F.array("value"), lambda v: value_of_kind(v, F.col("kind"))), lambda v: v != "")
    parts = [rows.select("document_id", "label", F.explode(plain).alias("value"), "ordinal") for rows in (told, under, below, beside)]
    return reduce(DataFrame.union, parts).distinct()


def conflicts(values: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one distinct value, with the places of each."""
    per = values.groupBy(*keys, "value").agg(F.array_sort(F.collect_set("ordinal")).alias("places"))
    told = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return per.where(told).withColumn("n_values", F.count("*").over(W.partitionBy(*keys))).where("n_values > 1").select(*keys, "value", "places", "n_values")


def item_key(name: Column) -> Column:
    """An item's name without white space, brackets and commas, and without a last word that says nothing."""
    return F.regexp_replace(F.regexp_replace(name, r"[\s（）()【】\[\]、,，]", ""), "(?:工器具|等)$", "")


def coverage(plan: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Planned items (keys, name, quantity) against present ones: covered, missing or quantity_mismatch.

    A name that holds another covers it. A planned name with members in brackets is also covered by present items
    that hold every member. Items are compared within their keys only; quantities where one item alone matches.
    """
    a = plan.select(*keys, "name", "quantity", item_key(F.col("name")).alias("norm"))
    b = present.select(*keys, F.col("quantity").alias("_quantity"), item_key(F.col("name")).alias("_norm"))
    both = a.join(b, keys, "left").withColumn("hit", F.coalesce(F.contains("norm", F.col("_norm")) | F.contains("_norm", F.col("norm")), F.lit(False)))
    out = both.groupBy(*keys, "name", "quantity").agg(F.count_if("hit").alias("n_matches"), F.max(F.when(F.col("hit"), F.col("_quantity"))).alias("_q"))
    inside = F.flatten(F.transform(F.regexp_extract_all("name", F.lit(r"[（(]([^）)]+)[）)]"), F.lit(1)), lambda x: F.split(x, "[、，,]")))
    members = a.select(*keys, "name", F.explode(F.filter(inside, lambda m: (m != "") & (m != "等"))).alias("member")).distinct().withColumn("_member", item_key(F.col("member")))
    held = members.join(b, keys, "left").groupBy(*keys, "name", "member").agg(F.max(F.coalesce(F.contains("_norm", F.col("_member")), F.lit(False))).alias("held"))
    split = held.groupBy(*keys, "name").agg(F.min("held").alias("members_held"))
    out = out.join(split, [*keys, "name"], "left")
    status = (
        F.when((F.col("n_matches") == 0) & F.coalesce("members_held", F.lit(False)), "covered")
        .when(F.col("n_matches") == 0, "missing")
        .when((F.col("n_matches") == 1) & (F.col("_q") != F.col("quantity")), "quantity_mismatch")
        .otherwise("covered")
    )
    return out.select(*keys, "name", "quantity", "n_matches", status.alias("status"))


def work_codes(texts: DataFrame, catalogue: DataFrame, pattern: str) -> DataFrame:
    """Codes in a document's texts (document_id, ordinal, text), in capitals, each once: the first place and the catalogue's entry or none."""
    found = texts.select("document_id", "ordinal", F.explode(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.upper)).alias("code"))
    return found.groupBy("document_id", "code").agg(F.min("ordinal").alias("ordinal")).join(catalogue, "code", "left")


def code_decision(codes: DataFrame, documents: DataFrame) -> DataFrame:
    """Result of each document (document_id, not_involved, confirmed).

    No code is an issue unless the text says that none is involved; a code that the catalogue lacks needs a review
    until it is confirmed.
    """
    c = codes.groupBy("document_id").agg(F.count("*").alias("n_codes"), F.count_if(F.col("work_type").isNull()).alias("n_unknown"))
    out = documents.join(c, "document_id", "left").fillna(0, ["n_codes", "n_unknown"])
    result = (
        F.when((F.col("n_codes") == 0) & F.col("not_involved"), "no_issue").when(F.col("n_codes") == 0, "issue_found").when((F.col("n_unknown") > 0) & ~F.col("confirmed"), "manual_review").otherwise("no_issue")
    )
    return out.withColumn("result", result)


def field_results(evidence: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results of tasks (document_id, task_id, required) by the rule of required fields, from evidence (document_id, task_id, text).

    A field names alternatives between "或" or "/". A task without evidence or with a field of which no alternative
    stands in the evidence is an issue, with the missing fields; one with all fields is left to a reviewer.
    """
    text = evidence.groupBy("document_id", "task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("_text"))
    both = tasks.join(text, ["document_id", "task_id"], "left").withColumn("_text", F.replace(F.coalesce("_text", F.lit("")), F.lit(" "), F.lit("")))
    parts = lambda f: F.filter(F.split(F.replace(f, F.lit("专业"), F.lit("")), "或|/"), lambda p: p != "")
    missing = F.filter("required", lambda f: (F.size(parts(f)) > 0) & ~F.exists(parts(f), lambda p: F.contains(F.col("_text"), p)))
    out = both.withColumn("missing", missing)
    result = F.when(~F.col("_text").rlike(r"(?U)\S") | (F.size("missing") > 0), "issue_found").otherwise("manual_review")
    return out.select("document_id", "task_id", "missing", result.alias("result"))


def dispatched(tasks: DataFrame, rules: dict[str, DataFrame], selected: DataFrame | None = None) -> DataFrame:
    """tasks (document_id, task_id, route, handler) with result and execution_status.

    A deterministic task takes its result from the rule of its handler (document_id, task_id, result), and fails if
    no such rule is registered; offline and later tasks keep the status of their route. With selected (task_id) all
    other tasks stay pending.
    """
    given = None
    for name, rows in rules.items():
        one = rows.select("document_id", "task_id", "result", F.lit(name).alias("handler"))
        given = one if given is None else given.unionByName(one)
    out = tasks.join(given, ["document_id", "task_id", "handler"], "left")
    if selected is not None:
        out = out.join(selected.withColumn("_in", F.lit(True)), "task_id", "left")
    chosen = F.lit(True) if selected is None else F.coalesce("_in", F.lit(False))
    runs_ = chosen & (F.col("route") == "deterministic")
    out = out.withColumn("result", F.when(runs_, F.col("result")))
    status = (
        F.when(runs_ & ~F.col("handler").isin(*rules), "failed").when(runs_ & F.col("result").isNotNull(), "completed").when(F.col("route") == "offline", "offline").otherwise("pending")
    )
    return out.withColumn("execution_status", status).select(*tasks.columns, "result", "execution_status")


def violations(results: DataFrame, statuses: tuple[str, ...] = ("completed", "pending", "offline", "failed"), outcomes: tuple[str, ...] = ("issue_found", "manual_review", "no_issue")) -> DataFrame:
    """Results outside the domains, or completed without a result."""
    bad = ~F.col("execution_status").isin(*statuses) | (F.col("result").isNotNull() & ~F.col("result").isin(*outcomes)) | ((F.col("execution_status") == "completed") & F.col("result").isNull())
    return results.where(bad)


def report(results: DataFrame) -> DataFrame:
    """Tasks by their result, else by their execution status."""
    return results.groupBy(F.coalesce("result", "execution_status").alias("status")).agg(F.count("*").alias("n_tasks"), F.count_distinct("document_id").alias("n_documents"))


def task_evidence(rows: DataFrame) -> DataFrame:
    """One row per task with its evidence texts in order, each block once, cut for a sheet's cells."""
    blocks = F.array_sort(F.collect_set(F.struct("ordinal", "text")))
    text = F.array_join(F.transform(blocks, lambda x: x["text"]), "\n")
    return rows.groupBy("document_id", "task_id").agg(F.size(blocks).cast("long").alias("n_blocks"), tx.short_cell(text).alias("evidence"))


def confirmed_against_detected(context: DataFrame) -> DataFrame:
    """Differences of confirmed and detected sets in both directions."""
    return context.select("*", F.array_sort(F.array_except("confirmed", "detected")).alias("not_detected"), F.array_sort(F.array_except("detected", "confirmed")).alias("not_confirmed"))


def snapshot(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every task of the library for every run, pending; the library is a small dimension."""
    return runs.join(small(tasks)).withColumn("status", F.lit("pending"))


def step_rows(tables: DataFrame, step: str, hazard: str) -> DataFrame:
    """Steps and hazards of job-safety tables, chains of steps cut, each step once per table in first-seen order."""
    rows = tables.select("table_id", "header", F.posexplode("rows").alias("n", "row"))
    got = rows.select("table_id", "n", F.posexplode(tx.steps(value_at(F.col("row"), column_index(F.col("header"), step)))).alias("k", "step"), value_at(F.col("row"), column_index(F.col("header"), hazard)).alias("hazard"))
    first = ranked(got, ["table_id", "step"], [F.col("n"), F.col("k")], "_n").where("_n = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy("table_id").orderBy("n", "k"))).select("table_id", "place", "step", "hazard")


def toc_region(blocks: DataFrame) -> DataFrame:
    """Directory entries of each document: anchor, last ordinal and their number."""
    return blocks.where("block_type = 'toc_entry'").groupBy("document_id").agg(F.min("ordinal").alias("anchor"), F.max("ordinal").alias("last"), F.count("*").alias("n_blocks"))


def cover_region(blocks: DataFrame, most: int = 12) -> DataFrame:
    """The first blocks of each document up to the next heading, most at most."""
    w = W.partitionBy("document_id").orderBy("ordinal")
    body = blocks.where("block_type <> 'toc_entry'").withColumn("n", F.row_number().over(w))
    first = body.where(F.col("n") <= most)
    stop = first.where((F.col("block_type") == "heading") & (F.col("n") > 1)).groupBy("document_id").agg(F.min("n").alias("stop"))
    kept = first.join(stop, "document_id", "left").where(F.col("stop").isNull() | (F.col("n") < F.col("stop")))
    return kept.groupBy("document_id").agg(F.min("ordinal").alias("anchor"), F.max("ordinal").alias("last"), F.count("*").alias("n_blocks"))


def appendix_region(blocks: DataFrame, title: str, any_title: str) -> DataFrame:
    """Blocks from the last block that holds a title (lists of appendices come before) to the next block that starts one."""
    body = blocks.where("block_type <> 'toc_entry'")
    start = body.where(F.contains("text", F.lit(title))).groupBy("document_id").agg(F.max("ordinal").alias("anchor"))
    after = body.where(F.col("text").rlike(any_title)).join(start, "document_id").where("ordinal > anchor").groupBy("document_id").agg(F.min("ordinal").alias("stop"))
    inside = body.join(start, "document_id").join(after, "document_id", "left").where((F.col("ordinal") >= F.col("anchor")) & (F.col("stop").isNull() | (F.col("ordinal") < F.col("stop"))))
    return inside.groupBy("document_id", "anchor").agg(F.max("ordinal").alias("last"), F.count("*").alias("n_blocks"))


def flat_results(outputs: DataFrame) -> DataFrame:
    """One row per output (document_id, task_id, kind, summary, candidates), one per candidate where there are any."""
    rows = outputs.withColumn("total", F.size("candidates")).select("document_id", "task_id", "kind", "summary", "total", F.posexplode_outer("candidates").alias("place", "candidate"))
    return rows.select("document_id", "task_id", "kind", "summary", F.nullif("total", F.lit(0)).alias("candidate_total"), (F.col("place") + 1).alias("place"), "candidate")


#: Kinds of supplied suggestions, and candidates that one may hold.
SUGGESTION_KINDS = ("missing_jsa_step", "missing_hazard_group", "missing_control_measure")
MOST_CANDIDATES = 8


def advisories(suggestions: DataFrame) -> DataFrame:
    """suggestions (kind, step, total, returned, candidates) as advisories, or with the rule of the contract they break."""
    group = F.col("kind") == "missing_hazard_group"
    n = F.size("candidates")
    broken = F.when(~F.col("kind").isin(*SUGGESTION_KINDS), "unknown_kind").when(
        group & F.coalesce((n > MOST_CANDIDATES) | (F.col("returned") != n) | (F.col("total") < F.col("returned")) | (n < 0), F.lit(True)), "invalid_group"
    )
    summary = F.when(F.col("kind") == "missing_jsa_step", F.concat(F.lit("step not covered: "), F.coalesce("step", F.lit("-")))).when(
        group, F.concat(F.coalesce("step", F.lit("-")), F.lit(": "), F.col("total").cast("string"), F.lit(" candidates, "), F.col("returned").cast("string"), F.lit(" shown"))
    ).otherwise(F.concat(F.lit("control measure: "), F.coalesce("step", F.lit("-"))))
    return suggestions.withColumns({"broken": broken, "summary": F.when(broken.isNull(), summary)})
