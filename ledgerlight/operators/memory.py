"""Session memory: candidates of many sessions merged into a base, and memory as Markdown text, both ways.

The merge is defined as a fold over sessions in order: a candidate whose section and normalised text are known is an observation
of that item, unless its session has been seen there; one whose text stands in another section isn't added but makes an open
question; any other becomes an item. What a text's candidates can meet follows from three facts about it alone: its base items,
its first candidate and when an open question of this text came, so the fold is a grouped join here and no group is held in one
task. Open questions are texts of their own; where one is made, its text is decided anew, until no new ones come.

Parsing and rendering are folds in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import new_path

# Sections in order with the category that leads there, ranks of confidence, the mark of an empty section.
SECTIONS = {
    "stable_fact": "Stable Project Facts",
    "user_preference": "User Preferences",
    "working_rule": "Working Rules",
    "recurring_issue": "Recurring Issues",
    "successful_pattern": "Successful Patterns",
    "open_question": "Open Questions",
    "deprecated": "Deprecated / Superseded",
}
CONFIDENCE = ("low", "medium", "high")
NOTHING = "(none yet)"
OPEN = "Open Questions"

ORDER = list(SECTIONS.values())
#: Items: place is their order in the base; sources, paths and tasks are in order and distinct.
ITEM = "section string, text string, place long, sources array<string>, confidence string, observed_at string, last_updated_at string, id string, source_hint string, verified_at string, verification_status string, stale_after string, related_paths array<string>, related_tasks array<string>"
#: Candidates: at is (session number, number in the session); category as above.
CANDIDATE = "at struct<session:long,number:long>, session string, category string, text string, confidence string, observed_at string, source_hint string, verified_at string, verification_status string, stale_after string, related_paths array<string>, related_tasks array<string>"


def _pick(values: list[str], x: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), x).cast("int")


def section_rank(section: Column) -> Column:
    return _pick(ORDER, section)


def confidence_rank(confidence: Column) -> Column:
    """1 to 3; 0 for anything else."""
    return F.coalesce(_pick(list(CONFIDENCE), confidence), F.lit(0))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def usable(candidates: DataFrame) -> DataFrame:
    """Candidates of a known category with a text, with their section, norm and text without outer spaces."""
    names = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    text = T.strip(T.text_of("text"))
    rows = candidates.withColumn("section", names[F.col("category")]).withColumn("text", text).filter("section IS NOT NULL AND text <> ''")
    return rows.withColumn("norm", T.normalize(F.col("text"))).drop("category")


def _placed(base: DataFrame) -> DataFrame:
    """Base items with their norm; of items that share section and norm the last one is updated, the others stay as they are."""
    return base.withColumn("norm", T.normalize(F.col("text")))


EVENT = "norm string, at struct<session:long,number:long>, text string, session string"


def _decided(base: DataFrame, found: DataFrame, questions: DataFrame) -> DataFrame:
    """Candidates with ``known`` (whether their item exists when they come) and the item that they would contradict."""
    rank = lambda s: section_rank(s)
    of_base = base.groupBy("norm").agg(F.sort_array(F.collect_set(F.struct(rank(F.col("section")).alias("rank"), "section"))).alias("held"), F.min(F.struct(rank(F.col("section")).alias("rank"), "place", "text")).alias("b"))
    first = found.groupBy("norm").agg(F.min(F.struct("at", "section", "text")).alias("first"))
    asked = questions.groupBy("norm").agg(F.min(F.struct("at", "text")).alias("q"))
    facts = first.join(of_base, "norm", "left").join(asked, "norm", "left").select("norm", "first", F.col("held.section").alias("held"), "b", "q")
    met = found.join(facts, "norm")
    # What a text has before a question of this text came: its base, or else the section of its first candidate.
    own_first = F.col("b").isNull() & (F.col("q").isNull() | (F.col("first.at") < F.col("q.at")))
    before = F.when(F.col("b").isNotNull(), F.col("held")).when(own_first, F.array("first.section")).otherwise(F.array().cast("array<string>"))
    asked_before = F.col("q").isNotNull() & (F.col("q.at") < F.col("at"))
    now = F.when(asked_before, F.array_union(before, F.array(F.lit(OPEN)))).otherwise(before)
    starts = own_first & (F.col("first.at") == F.col("at"))
    known = F.array_contains(now, F.col("section")) & ~starts
    # The first item of another section, by the order of sections.
    base_text, base_rank = F.col("b.text"), F.col("b.rank")
    own_text = F.when(F.col("b").isNotNull(), base_text).when(own_first, F.col("first.text"))
    own_rank = F.when(F.col("b").isNotNull(), base_rank).when(own_first, rank(F.col("first.section")))
    open_rank = ORDER.index(OPEN) + 1
    open_first = asked_before & (own_rank.isNull() | (own_rank > open_rank))
    against = F.struct(F.when(open_first, F.lit(OPEN)).otherwise(F.element_at(F.array(*[F.lit(s) for s in ORDER]), own_rank)).alias("section"), F.when(open_first, F.col("q.text")).otherwise(own_text).alias("text"))
    fresh = starts | (F.size(now) == 0)
    return met.select(*found.columns, known.alias("known"), fresh.alias("fresh"), F.when(~known & ~fresh, against).alias("against"))


def _asked(decided: DataFrame) -> DataFrame:
    """The open questions that conflicts make, each with the first event of its text."""
    text = F.concat(F.lit("Resolve: "), "text", F.lit(" vs "), "against.text")
    made = decided.filter("against IS NOT NULL").select(T.normalize(text).alias("norm"), "at", text.alias("text"), "session")
    return made.groupBy("norm").agg(F.min(F.struct("at", "text", "session")).alias("e")).select("norm", "e.at", "e.text", "e.session")


def decide(base: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates as ``_decided`` has them, and the open questions made. A question's text may meet candidates of its own, so rounds follow until none are new."""
    spark = base.sparkSession
    base, found = _placed(base), _stored(usable(candidates), "memory-candidates")
    questions = spark.createDataFrame([], EVENT)
    while True:
        decided = _stored(_decided(base, found, questions), "memory-decided")
        now = _stored(_asked(decided), "memory-questions")
        if questions.exceptAll(now).isEmpty() and now.exceptAll(questions).isEmpty():
            return decided, now
        questions = now


def _joined(values: Column) -> Column:
    return F.array_join(values, "; ")


def merge(base: DataFrame, candidates: DataFrame, cap: int) -> DataFrame:
    """All items after the merge: the base's and the new ones, in order, with ``kept`` false beyond ``cap`` items of a section.

    Further columns say what happened: change is base, updated or added. A base item of a section and norm that a later base item
    shares isn't updated. Observed and other dates are compared as text, year first. Sources, hints, paths and tasks keep
    the order in which they came; lists are as long as what they hold, and made of distinct rows before they are gathered.
    """
    decided, questions = decide(base, candidates)
    key = ["section", "norm"]
    base = _placed(base)
    last = base.groupBy(*key).agg(F.max("place").alias("last"))
    old = base.join(last, key).withColumn("live", F.col("place") == F.col("last")).drop("last")
    opened = questions.withColumn("section", F.lit(OPEN)).join(old.select(*key).distinct(), key, "left_anti")
    # A question whose item a candidate had made before it came changes nothing.
    created = decided.filter("fresh").groupBy(*key).agg(F.min("at").alias("since"))
    opened = opened.join(created, key, "left").filter("since IS NULL OR at < since").drop("since")
    blank = lambda: F.lit("").alias
    none = F.array().cast("array<string>")
    question_items = opened.select(
        *key, "text", "at", F.array("session").alias("sources"), F.lit("low").alias("confidence"), blank()("observed_at"), blank()("last_updated_at"),
        T.short_id(F.col("section"), F.col("norm")).alias("id"), blank()("source_hint"), blank()("verified_at"), F.lit("unverified").alias("verification_status"), blank()("stale_after"), none.alias("related_paths"), none.alias("related_tasks"),
    )
    fill = lambda c, v: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(v)).alias(c)
    fresh = decided.filter("fresh").join(created, key).filter(F.col("at") == F.col("since"))
    new_items = fresh.select(
        *key, "text", "at", F.array("session").alias("sources"), fill("confidence", "medium"), F.coalesce("observed_at", F.lit("")).alias("observed_at"), F.coalesce("observed_at", F.lit("")).alias("last_updated_at"),
        T.short_id(F.col("section"), F.col("norm")).alias("id"), F.coalesce(F.when(F.col("source_hint") != "", F.col("source_hint")), F.col("session")).alias("source_hint"),
        fill("verified_at", ""), fill("verification_status", "unverified"), fill("stale_after", ""), F.coalesce(F.array_distinct("related_paths"), none).alias("related_paths"), F.coalesce(F.array_distinct("related_tasks"), none).alias("related_tasks"),
    )
    at = F.struct(F.lit(None).cast("long").alias("session"), F.lit(None).cast("long").alias("number"))
    items = old.withColumn("at", at).unionByName(new_items.unionByName(question_items).withColumns({"place": F.lit(None).cast("long"), "live": F.lit(True)}))

    # Observations: the first candidate of each session that the item doesn't name already.
    seen = items.filter("live").select(*key, F.explode("sources").alias("session"))
    again = decided.filter("known OR fresh").join(fresh.select(*key, "at"), [*key, "at"], "left_anti")
    once = again.groupBy(*key, "session").agg(F.min_by(F.struct(*[c for c in again.columns if c not in (*key, "session")]), "at").alias("c")).select(*key, "session", "c.*")
    observed = once.join(seen, [*key, "session"], "left_anti")
    changed = observed.groupBy(*key).agg(
        F.count("*").alias("n_new"), F.max(confidence_rank(F.coalesce("confidence", F.lit("medium")))).alias("rank"), F.max("observed_at").alias("seen_at"), F.max("verified_at").alias("checked_at"),
        F.max(F.col("verification_status") == "verified").alias("verified"), F.max("stale_after").alias("stale_at"),
    )
    lists = _gathered(observed, key)
    met = items.join(changed.join(lists, key), key, "left")
    hit = F.col("live") & F.col("n_new").isNotNull()
    later = lambda new, old: F.when(hit & (F.coalesce(new, F.lit("")) > F.coalesce(old, F.lit(""))), new).otherwise(old)
    union = lambda new, old: F.when(hit, F.array_union(F.coalesce(old, none), F.coalesce(new, none))).otherwise(old)
    hints = F.array_distinct(F.concat(F.filter(F.split(F.coalesce("source_hint", F.lit("")), "; "), lambda h: h != ""), F.coalesce("hints", none)))
    out = met.select(
        "section", "text", "place", "at", union(F.col("sessions"), F.col("sources")).alias("sources"),
        F.when(hit & (F.col("rank") > confidence_rank(F.col("confidence"))), F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.greatest("rank", F.lit(1)))).otherwise(F.col("confidence")).alias("confidence"),
        later(F.col("seen_at"), F.col("observed_at")).alias("observed_at"),
        F.when(hit & (F.col("seen_at") > F.coalesce("observed_at", F.lit(""))), F.col("seen_at")).otherwise(F.col("last_updated_at")).alias("last_updated_at"), "id",
        F.when(hit, _joined(hints)).otherwise(F.col("source_hint")).alias("source_hint"), later(F.col("checked_at"), F.col("verified_at")).alias("verified_at"),
        F.when(hit & F.col("verified"), "verified").otherwise(F.col("verification_status")).alias("verification_status"), later(F.col("stale_at"), F.col("stale_after")).alias("stale_after"),
        union(F.col("paths"), F.col("related_paths")).alias("related_paths"), union(F.col("tasks"), F.col("related_tasks")).alias("related_tasks"),
        F.when(F.col("place").isNull(), "added").when(hit, "updated").otherwise("base").alias("change"),
    )
    return capped(_stored(out, "memory-merged"), cap)


def _gathered(observed: DataFrame, key: list[str]) -> DataFrame:
    """Sessions, hints, paths and tasks of observations in order, each once."""
    hint = F.coalesce(F.when(F.col("source_hint") != "", F.col("source_hint")), F.col("session"))
    parts = {"sessions": F.array("session"), "hints": F.array(hint), "paths": F.coalesce("related_paths", F.array().cast("array<string>")), "tasks": F.coalesce("related_tasks", F.array().cast("array<string>"))}

    def marked(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("value"), i.alias("i")))

    flat = [marked(k, v) for k, v in parts.items()]
    rows = observed.select(*key, "at", F.inline(F.concat(*flat))).filter("value <> ''")
    once = rows.groupBy(*key, "kind", "value").agg(F.min(F.struct("at", "i")).alias("at"))
    pick = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "value"))))["value"].alias(k)
    return once.groupBy(*key).agg(*[pick(k) for k in parts])


def capped(items: DataFrame, cap: int) -> DataFrame:
    """Adds kept: whether an item is among the first ``cap`` of its section, base items first. Only those are ranked, the rest is compared with the last of them."""
    order = F.struct(F.col("place").isNull().alias("new"), F.coalesce("place", F.lit(0)).alias("place"), F.col("at.session").alias("session"), F.col("at.number").alias("number"), F.col("text").alias("text"))
    placed = items.withColumn("order", order)
    w = Window.partitionBy("section").orderBy("order")
    edge = placed.select("section", "order").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).groupBy("section").agg(F.max("order").alias("edge"))
    return placed.join(F.broadcast(edge), "section", "left").withColumn("kept", F.col("edge").isNotNull() & (F.col("order") <= F.col("edge"))).drop("edge")  # one row a section


# Markdown

FIELDS = ("id", "summary", "source_hint", "confidence", "observation_sessions", "observed_at", "last_updated_at", "verified_at", "verification_status", "stale_after", "related_paths", "related_tasks")
LISTS = ("observation_sessions", "related_paths", "related_tasks")
RENDERED = {"summary": "text", "observation_sessions": "sources"}


def _quoted(x: Column) -> Column:
    """A text as a quoted scalar on one line."""
    y = F.coalesce(x, F.lit(""))
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        y = F.replace(y, F.lit(raw), F.lit(mark))
    return F.concat(F.lit('"'), y, F.lit('"'))


def _plain(x: Column) -> Column:
    """The text of a scalar, quoted or plain."""
    inner = F.substring(x, F.lit(2), F.length(x) - 2)
    for mark, raw in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        inner = F.replace(inner, F.lit(mark), F.lit(raw))
    single = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("''"), F.lit("'"))
    return F.when(x.rlike(r'(?s)^".*"$') & (F.length(x) >= 2), inner).when(x.rlike(r"(?s)^'.*'$") & (F.length(x) >= 2), single).otherwise(x)


def render(items: DataFrame, by: list[str], order: str = "place") -> DataFrame:
    """A memory text (``memory``) for each group: all sections, each item a bullet with its date and indented fields."""
    head = F.concat(F.lit("- "), "text", F.when(F.coalesce("last_updated_at", F.lit("")) != "", F.concat(F.lit(" (updated: "), "last_updated_at", F.lit(")"))).otherwise(""))
    lines = []
    for f in FIELDS:
        x = F.col(RENDERED.get(f, f))
        value = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(x, F.array().cast("array<string>")), _quoted), ", "), F.lit("]")) if f in LISTS else _quoted(x)
        lines.append(F.concat(F.lit(f"  {f}: "), value))
    block = F.concat_ws("\n", head, *lines)
    grouped = items.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("section", order, block.alias("block")))).alias("b"))
    of = lambda s: F.filter("b", lambda x: x["section"] == s)["block"]
    whole = [F.concat(F.lit(f"## {s}\n\n"), F.when(F.size(of(s)) == 0, F.lit(f"- {NOTHING}")).otherwise(F.array_join(of(s), "\n")), F.lit("\n")) for s in ORDER]
    title = F.lit("# Project Memory\n\nProposed consolidated memory (review before promote).\n")
    return grouped.select(*by, F.concat_ws("\n", title, *whole).alias("memory"))


DATE = r"^(.*?)\s*\(updated:\s*(\d{4}-\d{2}-\d{2})\)\s*$"
LINES = "array<struct<section:string,raw:string,meta:array<string>>>"


def _items(lines: Column) -> Column:
    """Bullets with their section and indented lines. The fold carries the section and whether the last bullet is still open."""
    start = F.struct(F.lit(None).cast("string").alias("section"), F.lit(False).alias("open"), F.array().cast(LINES).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        title = T.strip(F.substring(line, F.lit(4), F.length(line)))
        raw = T.strip(F.substring(line, F.lit(3), F.length(line)))
        is_section = line.startswith("## ")
        bullet = ~is_section & acc["section"].isNotNull() & line.startswith("- ")
        item = bullet & (raw != "") & (raw != NOTHING)
        meta = ~is_section & ~bullet & acc["open"] & line.startswith("  ") & (T.strip(line) != "")
        n = F.size(acc["out"])
        tail = F.get(acc["out"], n - 1)
        longer = F.concat(F.slice(acc["out"], F.lit(1), n - 1), F.array(F.struct(tail["section"].alias("section"), tail["raw"].alias("raw"), F.array_append(tail["meta"], F.substring(line, F.lit(3), F.length(line))).alias("meta"))))
        out = F.when(item, F.array_append(acc["out"], F.struct(acc["section"].alias("section"), raw.alias("raw"), F.array().cast("array<string>").alias("meta")))).when(meta, longer).otherwise(acc["out"])
        section = F.when(is_section, F.when(title.isin(*ORDER), title)).otherwise(acc["section"])
        # Other lines end what is indented below a bullet, but not the bullet itself.
        return F.struct(section.alias("section"), F.when(is_section, F.lit(False)).when(bullet, item).otherwise(acc["open"]).alias("open"), out.cast(LINES).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def _values(meta: Column) -> Column:
    """(field, values) of indented lines: a scalar, a list in brackets, or the dashes below a field."""
    shape = "array<struct<field:string,values:array<string>>>"

    def step(acc: Column, line: Column) -> Column:
        field = F.regexp_extract(line, r"^([A-Za-z_]+):", 1)
        rest = T.strip(F.regexp_extract(line, r"(?s)^[A-Za-z_]+:(.*)$", 1))
        listed = F.transform(F.regexp_extract_all(F.substring(rest, F.lit(2), F.length(rest) - 2), F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\s][^,]*)"""), 1), lambda x: _plain(T.strip(x)))
        values = F.when(rest == "", F.array().cast("array<string>")).when(rest.rlike(r"(?s)^\[.*\]$"), listed).otherwise(F.array(_plain(rest)))
        dash = T.strip(line).startswith("- ") & (F.size(acc) > 0)
        tail = F.get(acc, F.size(acc) - 1)
        more = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(tail["field"].alias("field"), F.array_append(tail["values"], _plain(T.strip(F.substring(T.strip(line), F.lit(3), F.length(line))))).alias("values"))))
        return F.when(dash, more).when(field != "", F.array_append(acc, F.struct(field.alias("field"), values.alias("values")))).otherwise(acc).cast(shape)

    return F.aggregate(meta, F.array().cast(shape), step)


def parse(texts: DataFrame, by: list[str], text: str = "memory") -> DataFrame:
    """The items of memory texts, in order (place, from 0 in the text). A field that is missing or empty has its default."""
    lines = texts.select(*by, F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]").alias("lines"))
    rows = lines.select(*by, F.posexplode(_items(F.col("lines"))).alias("place", "i")).select(*by, F.col("place").cast("long").alias("place"), "i.section", "i.raw", _values(F.col("i.meta")).alias("f"))
    dated = rows.withColumn("updated", F.regexp_extract("raw", DATE, 2)).withColumn("text", F.when(F.col("updated") != "", T.strip(F.regexp_extract("raw", DATE, 1))).otherwise(F.col("raw")))
    of = lambda name: F.filter(F.coalesce(F.get(F.reverse(F.filter("f", lambda x: x["field"] == name)), F.lit(0))["values"], F.array().cast("array<string>")), lambda v: T.strip(v) != "")
    one = lambda name, default: F.coalesce(F.get(of(name), F.lit(0)), default)
    own = T.short_id(F.col("section"), T.normalize(F.col("text")))
    empty = F.lit("")
    return dated.select(
        *by, "section", "text", "place", F.array_distinct(of("observation_sessions")).alias("sources"), one("confidence", F.lit("medium")).alias("confidence"), one("observed_at", empty).alias("observed_at"),
        one("last_updated_at", F.col("updated")).alias("last_updated_at"), one("id", own).alias("id"), one("source_hint", empty).alias("source_hint"), one("verified_at", empty).alias("verified_at"),
        one("verification_status", F.lit("unverified")).alias("verification_status"), one("stale_after", empty).alias("stale_after"), F.array_distinct(of("related_paths")).alias("related_paths"), F.array_distinct(of("related_tasks")).alias("related_tasks"),
    )
