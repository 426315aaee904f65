"""Document tree of plain and Markdown texts: headings, sections, paragraphs and their locators.

Everything happens inside the row: headings are folded out of a text's lines, section ends and parents come from one fold
each over the headings, which carry what each level has seen last, paragraphs from the regions between headings. Line numbers are carried along.
No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Line ends as str.splitlines sees them; the end stays with its line.
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
#: Levels of headings; those of plain texts are 1 and 2.
LEVELS = 6
#: line is the number of line ends before the start, end_line before the end.
HEADINGS = "array<struct<start:int,end:int,level:int,title:string,line:int,end_line:int>>"


def text_lines(text: Column) -> Column:
    """The lines of a text with their ends."""
    return F.filter(F.split(text, LINE_END), lambda x: x != "")


def plain_headings(lines: Column) -> Column:
    """Headings of the lines of a plain text: a line of 80 characters at most over a line of = or -, or one in capitals.

    An underlined heading takes two lines. The fold carries the offset and whether a line is taken. Every line
    looks at the next one, so ``lines`` has to be a column of its own: an expression would be computed for each line.
    """
    rows = F.transform(lines, lambda x, i: F.struct(x.alias("line"), T.strip(x).alias("title"), F.coalesce(T.strip(F.get(lines, i + 1)), F.lit("")).alias("next"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("after")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(False).alias("taken"), F.array().cast(HEADINGS).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        title = row["title"]
        fits = (F.length(title) > 0) & (F.length(title) <= 80)
        level = F.when(row["next"].rlike("^=+$"), 1).when(row["next"].rlike("^-+$"), 2)
        letters = F.regexp_replace(title, r"[^\p{L}]", "")
        capitals = (F.length(title) >= 4) & (F.length(letters) > 0) & ~letters.rlike(r"[^\p{Lu}]")
        under = ~acc["taken"] & fits & level.isNotNull()
        alone = ~acc["taken"] & ~under & fits & capitals
        size = F.length(row["line"])
        own_end = acc["at"] + F.length(F.regexp_replace(row["line"], r"(?U)\s+$", ""))
        under_end = acc["at"] + size + F.length(F.regexp_replace(row["after"], r"(?U)\s+$", ""))
        new = F.struct(acc["at"].alias("start"), F.when(under, under_end).otherwise(own_end).alias("end"), F.when(under, level).otherwise(F.lit(1)).alias("level"), title.alias("title"), acc["line"].alias("line"), (acc["line"] + F.when(under, T.newlines(row["line"])).otherwise(0)).alias("end_line"))
        out = F.when(under | alone, F.array_append(acc["out"], new)).otherwise(acc["out"])
        return F.struct((acc["at"] + size).alias("at"), (acc["line"] + T.newlines(row["line"])).alias("line"), F.coalesce(under, F.lit(False)).alias("taken"), out.cast(HEADINGS).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def markdown_headings(text: Column, fences: bool = False) -> Column:
    """Headings of a Markdown text: up to six # at the start of a line, white space, and a title, which may follow after blank lines.

    With ``fences``, lines between ``` or ~~~ are left alone; without, as in a plain search for headings, they count.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(0).alias("level"), F.lit(0).alias("from"), F.lit(0).alias("from_line"), F.lit("").alias("fence"), F.array().cast(HEADINGS).alias("out"),
    )

    def step(acc: Column, line: Column) -> Column:
        blank = T.strip(line) == ""
        mark = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1) if fences else F.lit("")
        # A fence ends with a mark of its kind that is at least as long and stands alone.
        closes = (acc["fence"] != "") & (mark != "") & (F.substring(mark, 1, 1) == F.substring(acc["fence"], 1, 1)) & (F.length(mark) >= F.length(acc["fence"])) & (T.strip(line) == mark)
        fence = F.when(acc["fence"] != "", F.when(closes, F.lit("")).otherwise(acc["fence"])).otherwise(mark)
        inside = (acc["fence"] != "") | (mark != "")
        hashes = F.length(F.regexp_extract(line, r"(?U)^(#{1,6})(\s|$)", 1))
        waiting = (acc["level"] > 0) & ~blank & ~inside
        titled = ~waiting & ~inside & (hashes > 0) & ~F.substring(line, hashes + 1, F.length(line)).rlike(r"(?U)^\s*$")
        opens = ~waiting & ~inside & (hashes > 0) & ~titled
        title = F.when(waiting, T.strip(line)).otherwise(T.strip(F.substring(line, hashes + 1, F.length(line))))
        end = acc["at"] + F.length(F.regexp_replace(line, r"(?U)\s+$", ""))
        new = F.struct(
            F.when(waiting, acc["from"]).otherwise(acc["at"]).alias("start"), end.alias("end"), F.when(waiting, acc["level"]).otherwise(hashes).alias("level"), title.alias("title"),
            F.when(waiting, acc["from_line"]).otherwise(acc["line"]).alias("line"), acc["line"].alias("end_line"),
        )
        out = F.when(waiting | titled, F.array_append(acc["out"], new)).otherwise(acc["out"])
        keep = (acc["level"] > 0) & blank & ~inside
        return F.struct(
            (acc["at"] + F.length(line) + 1).alias("at"), (acc["line"] + 1).alias("line"), F.when(opens, hashes).when(keep, acc["level"]).otherwise(F.lit(0)).alias("level"),
            F.when(opens, acc["at"]).otherwise(acc["from"]).alias("from"), F.when(opens, acc["line"]).otherwise(acc["from_line"]).alias("from_line"), fence.alias("fence"), out.cast(HEADINGS).alias("out"),
        )

    def finish(acc: Column) -> Column:
        # A mark before nothing but white space to the end has an empty title, if a blank is left for it after the first character.
        rest = F.substring(text, acc["from"] + acc["level"] + 1, F.length(text))
        last = F.struct(acc["from"].alias("start"), F.length(text).alias("end"), acc["level"].alias("level"), F.lit("").alias("title"), acc["from_line"].alias("line"), (acc["line"] - 1).alias("end_line"))
        return F.when((acc["level"] > 0) & rest.rlike(r"(?s)^.\n*[^\n]"), F.array_append(acc["out"], last).cast(HEADINGS)).otherwise(acc["out"])

    return F.aggregate(F.split(text, "\n"), start, step, finish)


SECTIONS = "array<struct<number:int,start:int,end:int,level:int,title:string,line:int,end_line:int,section_end:int,parent:int,body_end:int>>"


def _from_level(seen: Column, level: Column, value: Column) -> Column:
    """What each level has seen, after a heading: it counts for its level and the deeper ones."""
    return F.transform(seen, lambda v, i: F.when(i + 1 >= level, value).otherwise(v))


def sections(heads: Column, size: Column) -> Column:
    """Headings with their number (from 1), their section's end, their parent's number and their own body's end.

    One fold from the end carries, for each level, where the next heading of it or a higher one starts; one from the start carries the
    last such heading's number.
    """
    ends = F.struct(F.array_repeat(size, LEVELS).alias("next"), F.lit(None).cast("int").alias("after"), F.array().cast("array<struct<end:int,body:int>>").alias("out"))

    def end(acc: Column, h: Column) -> Column:
        section_end = F.get(acc["next"], h["level"] - 1)
        pair = F.struct(section_end.cast("int").alias("end"), F.coalesce(acc["after"], section_end).cast("int").alias("body"))
        return F.struct(_from_level(acc["next"], h["level"], h["start"]).alias("next"), h["start"].alias("after"), F.array_append(acc["out"], pair).alias("out"))

    closed = F.reverse(F.aggregate(F.reverse(heads), ends, end, lambda acc: acc["out"]))
    both = F.zip_with(heads, closed, lambda h, e: F.struct(*[h[c].alias(c) for c in ("start", "end", "level", "title", "line", "end_line")], e["end"].alias("section_end"), e["body"].alias("body_end")))
    first = F.struct(F.lit(0).alias("number"), F.array_repeat(F.lit(0), LEVELS).alias("last"), F.array().cast(SECTIONS).alias("out"))

    def number(acc: Column, h: Column) -> Column:
        own = acc["number"] + 1
        parent = F.when(h["level"] > 1, F.get(acc["last"], h["level"] - 2)).otherwise(F.lit(0))
        new = F.struct(own.alias("number"), *[h[c].alias(c) for c in ("start", "end", "level", "title", "line", "end_line", "section_end")], parent.alias("parent"), h["body_end"].alias("body_end"))
        return F.struct(own.alias("number"), _from_level(acc["last"], h["level"], own).alias("last"), F.array_append(acc["out"], new).cast(SECTIONS).alias("out"))

    return F.aggregate(both, first, number, lambda acc: acc["out"])


def _with_plain(docs: DataFrame) -> DataFrame:
    lines = docs.withColumn("lines", text_lines(F.col("text")))
    return lines.withColumn("plain", plain_headings(F.col("lines"))).drop("lines")


def _with_headings(docs: DataFrame, markdown: bool, fences: bool) -> DataFrame:
    return docs.withColumn("plain", markdown_headings(F.col("text"), fences)) if markdown else _with_plain(docs)


def with_sections(docs: DataFrame, markdown: bool = False, fences: bool = False) -> DataFrame:
    """Adds heads, the sections of every text, by one pass inside the row."""
    return _with_headings(docs, markdown, fences).withColumn("heads", sections(F.col("plain"), F.length("text"))).drop("plain")


def headings(docs: DataFrame, markdown: bool = False, fences: bool = False) -> DataFrame:
    """doc_id and every heading: number, start, end, level and title, with its section's end, its parent and its body's end.

    The rows come out of an expression: of a column, its size would be tested below all that makes it, which makes it again.
    """
    found = _with_headings(docs.select("doc_id", "text"), markdown, fences)
    return found.select("doc_id", F.inline(sections(F.col("plain"), F.length("text"))))


def _paragraphs(region: Column, offset: Column, line: Column) -> Column:
    """(start, end, line) of the blocks between blank lines of a region, trimmed; ``line`` counts the line ends before the region."""
    bodies = F.split(region, r"\n\s*\n")
    gaps = F.concat(F.regexp_extract_all(region, F.lit(r"(\n\s*\n)"), 1), F.array(F.lit("")))
    cells = F.arrays_zip(bodies.alias("b"), gaps.alias("g"))
    spans = "array<struct<start:int,end:int,line:int>>"

    def step(acc: Column, c: Column) -> Column:
        lead = F.length(c["b"]) - F.length(F.regexp_replace(c["b"], r"(?U)^\s+", ""))
        inner = F.length(T.strip(c["b"]))
        start = acc["at"] + lead
        new = F.struct((offset + start).cast("int").alias("start"), (offset + start + inner).cast("int").alias("end"), (line + acc["line"] + T.newlines(F.substring(c["b"], F.lit(1), lead))).cast("int").alias("line"))
        out = F.when(inner > 0, F.array_append(acc["out"], new)).otherwise(acc["out"])
        gap = F.coalesce(c["g"], F.lit(""))
        return F.struct((acc["at"] + F.length(c["b"]) + F.length(gap)).alias("at"), (acc["line"] + T.newlines(c["b"]) + T.newlines(gap)).alias("line"), out.cast(spans).alias("out"))

    return F.aggregate(cells, F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.array().cast(spans).alias("out")), step, lambda acc: acc["out"])


def node_arrays(docs: DataFrame, markdown: bool = False, fences: bool = False) -> DataFrame:
    """doc_id and the nodes of every text that isn't empty, in order, made inside the row: nothing is shuffled.

    The root comes first, then the headings, then all paragraphs. Text before the first heading has no
    paragraph. A node's id follows from its locator, heading and content; a paragraph's also from its
    order, so that it never equals the root's.
    """
    texts = docs.select("doc_id", T.text_of("text").alias("text")).filter("text <> ''")
    df, text = with_sections(texts, markdown, fences), F.col("text")
    root = F.array(F.struct(F.lit("Document").alias("heading"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0).alias("kind"), F.lit(0).alias("line")))
    heads = F.transform("heads", lambda h: F.struct(h["title"].alias("heading"), h["level"].alias("depth"), h["parent"].alias("parent"), h["start"].alias("start"), h["section_end"].alias("end"), F.lit(1).alias("kind"), h["line"].alias("line")))
    one = F.array(F.struct(F.lit(0).alias("number"), F.lit(0).alias("end"), F.lit(0).alias("level"), F.length("text").alias("body_end"), F.lit(0).alias("end_line")))
    regions = F.when(F.size("heads") == 0, one).otherwise(F.transform("heads", lambda h: F.struct(h["number"].alias("number"), h["end"].alias("end"), h["level"].alias("level"), h["body_end"].alias("body_end"), h["end_line"].alias("end_line"))))
    paragraphs = F.flatten(F.transform(regions, lambda r: F.transform(_paragraphs(T.piece(text, r["end"], r["body_end"]), r["end"], r["end_line"]), lambda p: F.struct(
        _label(T.piece(text, p["start"], p["end"])).alias("heading"), (r["level"] + 1).alias("depth"), r["number"].alias("parent"), p["start"].alias("start"), p["end"].alias("end"), F.lit(2).alias("kind"), p["line"].alias("line"),
    ))))
    return df.select("doc_id", "text", F.concat(root, heads, paragraphs).alias("nodes"))


def nodes(docs: DataFrame, markdown: bool = False, fences: bool = False) -> DataFrame:
    """The nodes of ``node_arrays`` as rows, with their locators, digests and ids."""
    text = F.col("text")

    def whole(n: Column, i: Column) -> Column:
        content = T.piece(text, n["start"], n["end"])
        return F.struct(
            i.alias("document_order"), n["heading"].alias("heading"), n["depth"].alias("depth"), n["parent"].alias("parent_order"), n["start"].alias("char_start"), n["end"].alias("char_end"),
            (n["line"] + 1).alias("line_start"), (n["line"] + 1 + T.newlines(F.substring(content, F.lit(1), F.length(content) - 1))).alias("line_end"),
            T.digest(content).alias("content_digest"), F.greatest(F.lit(1), F.size(T.tokens(content))).alias("token_estimate"), n["kind"].alias("kind"),
        )

    out = node_arrays(docs, markdown, fences).select("doc_id", F.inline(F.transform("nodes", whole)))
    salt = F.when(F.col("kind") == 2, F.col("document_order").cast("string")).otherwise("")
    name = F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("char_start").cast("string"), F.col("char_end").cast("string"), "heading", "content_digest", salt)
    return out.withColumn("node_id", T.uuid5(name)).drop("kind")


def _leaves() -> Column:
    without = F.array_except(F.sequence(F.lit(0), F.size("nodes") - 1), F.transform("nodes", lambda n: n["parent"]))
    node = lambda i: F.get("nodes", i)
    return F.transform(without, lambda i: F.struct(i.alias("document_order"), node(i)["heading"].alias("heading"), (node(i)["end"] - node(i)["start"]).alias("size")))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id and an array of (document_order, heading, size) of the nodes without children."""
    return node_arrays(docs).select("doc_id", _leaves().alias("leaves"))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """The same as rows; taken out of an expression, as a filter on a column's size would be moved below and make it again."""
    return node_arrays(docs).select("doc_id", F.inline(_leaves()))


def _label(body: Column) -> Column:
    first = T.collapse(body)
    return F.concat(F.substring(first, 1, 72), F.when(F.length(first) > 72, "…").otherwise(""))
