"""What kind of transcript a file is, by its text, its records or its name, and what to do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of speakers, of files and of kinds, in the order in which they are tried, and of what may be done.
ASKING, ANSWERING = ("user", "human"), ("assistant", "claude", "codex", "gemini", "cursor")
NAME = r"(?i)^(?:(?:codex|claude|cursor|gemini)-session-|rollout-|(?:chat|conversation)[-_](?:export|dump)|transcript[-_])"
DATED = r"^\d{4}-\d{2}-\d{2}[-_]\d{6}(?:[-_]|$)"
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
KINDS = ("dialogue-markers", "claude-terminal-dialogue", "message-record", "session-metadata", "filename-only-review-required")
OPTIONS = ("ingest_summary", "discard", "keep")

_MESSAGE = "struct<role:string,content:string,text:string>"
RECORD = f"role string, content string, text string, type string, message {_MESSAGE}, payload {_MESSAGE}"


def _spoken(text: Column, names: tuple[str, ...]) -> Column:
    """Whether a line begins with one of the names, as a heading or in bold or plainly, and goes on as a mark of a speaker does."""
    return text.rlike(rf"(?im)^\s*(?:#{{1,6}}\s+|\*\*)?(?:{'|'.join(names)})(?:\*\*)?\s*(?::|$|\[|\()")


def records(text: Column) -> Column:
    """The records of a JSON text: its list of messages, its list, itself, or, where it isn't JSON as a whole, those of its lines that are."""
    whole, several = F.try_parse_json(text), f"array<struct<{_ddl()}>>"
    wrapped = F.get_json_object(text, "$.messages")
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\r\n]"), lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, RECORD))), lambda r: r.isNotNull())
    one = F.when(wrapped.startswith("["), F.from_json(wrapped, several)).otherwise(F.from_json(text, several))
    return F.coalesce(F.when(whole.isNotNull(), one).otherwise(lines), F.array().cast(several))


def _ddl() -> str:
    return ",".join(f"{f.split(' ', 1)[0]}:{f.split(' ', 1)[1]}" for f in RECORD.split(", "))


def _record_kind(r: Column) -> Column:
    fits = lambda m: m["role"].isin("user", "assistant") & (m["content"].isNotNull() | m["text"].isNotNull())
    message = F.when(r["message"].isNotNull(), fits(r["message"])).when(r["payload"].isNotNull(), fits(r["payload"])).otherwise(fits(r))
    return F.when(F.coalesce(message, F.lit(False)), "message-record").when((r["type"] == "session_meta") & r["payload"].isNotNull(), "session-metadata")


def kind(name: Column, text: Column) -> Column:
    """The first kind that fits a file, or null. Records count in files that end with .json or .jsonl, names in all but .json.

    A null text is empty, a null name fits nothing. Fields that are null count as missing.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), ANSI, "")
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)
    suffix = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    spoken = _spoken(plain, ASKING) & _spoken(plain, ANSWERING)
    terminal = plain.rlike(r"(?m)^\s*[>❯]\s+\S") & plain.rlike(r"(?m)^\s*●\s+\S")
    of_records = F.get(F.filter(F.transform(records(plain), _record_kind), lambda k: k.isNotNull()), F.lit(0))
    by_record = F.when(suffix.isin(".json", ".jsonl"), of_records)
    named = (suffix != ".json") & (stem.rlike(NAME) | stem.rlike(DATED))
    return F.when(spoken, KINDS[0]).when(terminal, KINDS[1]).otherwise(F.coalesce(by_record, F.when(named, KINDS[4])))


def routed(files: DataFrame, least_age: int) -> DataFrame:
    """The files that are transcripts, with kind, action and why. ``files`` has name, text, age_days and tracked; young and tracked ones are kept."""
    found = files.withColumn("kind", kind(F.col("name"), F.col("text"))).filter("kind IS NOT NULL")
    young, tracked = F.col("age_days") < least_age, F.coalesce("tracked", F.lit(False))
    why = F.when(young, f"younger than {least_age} days").when(tracked, "tracked").otherwise(F.concat(F.lit("untracked transcript ("), "kind", F.lit("), "), F.col("age_days").cast("string"), F.lit("d old")))
    return found.withColumn("action", F.when(young | tracked, "keep").otherwise("decide")).withColumn("why", why)
