"""Markdown and plain trees against a search by pattern and a walk over headings, on random texts."""

import random
import re

import pytest

from ledgerlight.operators import tree

HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.MULTILINE)


def markdown(text):
    return [(m.start(), len(m[1]), m[2].strip()) for m in HEADING.finditer(text)]


def unfenced(text):
    """Headings outside of fences, line by line, for texts whose titles stand on the line of their mark."""
    out, at, fence = [], 0, ""
    for line in text.split("\n"):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and line.strip() == mark[1]:
                fence = ""
        elif mark:
            fence = mark[1]
        elif m := re.match(r"(#{1,6})\s+(\S.*?)\s*$", line):
            out.append((at, len(m[1]), m[2]))
        at += len(line) + 1
    return out


def made(rng, lines):
    parts = ["# One", "## Two  ", "### Three ###", "#", "  ", "", "text", "#no", "####### seven", " # indented", "a # b", "######\tSix", "##   ", "Ünï \U0001f600", "```", "~~~~", "# ```"]
    return "\n".join(rng.choice(parts) for _ in range(lines))


def walk(text, heads):
    """(heading, depth, parent's number, start, end) of the root and of all sections."""
    out = [("Document", 0, None, 0, len(text))]
    for i, (start, level, title) in enumerate(heads):
        end = next((s for s, other, _ in heads[i + 1 :] if other <= level), len(text))
        parent = next((j + 1 for j in range(i - 1, -1, -1) if heads[j][1] < level), 0)
        out.append((title, level, parent, start, end))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [(i, made(rng, rng.randint(0, 25))) for i in range(150)] + [(200, "#"), (201, "# "), (202, "#\n\n \nLate"), (203, "# a\n# b"), (204, "\n\n# a\n\n\n\nb\n\n"), (205, None), (206, ""), (207, "# x\n" * 300)]


def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


def test_markdown_headings(spark, texts):
    got = {}
    for r in tree.headings(frame(spark, texts), markdown=True).collect():
        got.setdefault(r.doc_id, []).append((r.number, r.start, r.level, r.title))
    for i, text in texts:
        assert [x[1:] for x in sorted(got.get(i, []))] == markdown(text or ""), text


def test_fences(spark, texts):
    fixed = [(i, re.sub(r"(?m)^#{1,6}\s*$", "x", t)) for i, t in texts if t]
    got = {}
    for r in tree.headings(frame(spark, fixed), markdown=True, fences=True).collect():
        got.setdefault(r.doc_id, []).append((r.number, r.start, r.level, r.title))
    for i, text in fixed:
        assert [x[1:] for x in sorted(got.get(i, []))] == unfenced(text), text


def test_markdown_nodes(spark, texts):
    """Sections, paragraphs, parents, locators and line numbers; ids are distinct in a text."""
    got = {}
    for r in tree.nodes(frame(spark, texts), markdown=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        if not text:
            assert i not in got
            continue
        rows = sorted(got[i], key=lambda r: r.document_order)
        want = walk(text, markdown(text))
        assert [(r.heading, r.depth, r.parent_order, r.char_start, r.char_end) for r in rows[: len(want)]] == want
        assert len({r.node_id for r in rows}) == len(rows)
        for r in rows:
            assert r.line_start == text.count("\n", 0, r.char_start) + 1 and r.line_end == text.count("\n", 0, max(r.char_start, r.char_end - 1)) + 1
        for r in rows[len(want) :]:
            body = text[r.char_start : r.char_end]
            assert body == body.strip() != "" and not re.search(r"\n\s*\n", body) and r.depth == rows[r.parent_order].depth + 1


def test_ids_follow_from_content(spark):
    """The same text has the same ids, another one others; they don't depend on partitions."""
    rows = [(1, "TITLE\n\nbody one\n\nbody one"), (2, "TITLE\n\nbody one\n\nbody two")]
    ids = lambda n: sorted((r.doc_id, r.document_order, r.node_id) for r in tree.nodes(frame(spark, rows).repartition(n)).collect())
    found = ids(1)
    assert found == ids(4) and len({x[2] for x in found}) == len(found) == 8
