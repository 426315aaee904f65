"""The memory merge against a fold over all candidates one by one, and memory texts there and back."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import memory

NAMES = [f.split()[0] for f in memory.ITEM.split(", ")]
CANDIDATE = [c for c in ("at", "session", "category", "text", "confidence", "observed_at", "source_hint", "verified_at", "verification_status", "stale_after", "related_paths", "related_tasks")]


def norm(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def fold(base, candidates, cap):
    """Items by section, each a dict, after all candidates in order; kept says which are within the cap."""
    sections = {s: [dict(i, change="base") for i in base if i["section"] == s] for s in memory.ORDER}
    index = {(i["section"], norm(i["text"])): i for s in memory.ORDER for i in sections[s]}
    for c in sorted(candidates, key=lambda c: c["at"]):
        section, text = memory.SECTIONS.get(c["category"]), (c["text"] or "").strip()
        if not section or not text:
            continue
        new = {
            "section": section, "text": text, "sources": [c["session"]], "confidence": c["confidence"] or "medium", "observed_at": c["observed_at"] or "", "last_updated_at": c["observed_at"] or "",
            "source_hint": c["source_hint"] or c["session"], "verified_at": c["verified_at"] or "", "verification_status": c["verification_status"] or "unverified", "stale_after": c["stale_after"] or "",
            "related_paths": list(dict.fromkeys(c["related_paths"] or [])), "related_tasks": list(dict.fromkeys(c["related_tasks"] or [])), "change": "added",
        }
        key = (section, norm(text))
        old = index.get(key)
        if old:
            if c["session"] in old["sources"]:
                continue
            for k in ("sources", "related_paths", "related_tasks"):
                old[k] = list(dict.fromkeys([*old[k], *new[k]]))
            hints = [h for h in old["source_hint"].split("; ") if h]
            old["source_hint"] = "; ".join(dict.fromkeys([*hints, new["source_hint"]]))
            rank = lambda x: memory.CONFIDENCE.index(x) + 1 if x in memory.CONFIDENCE else 0
            if rank(new["confidence"]) > rank(old["confidence"]):
                old["confidence"] = new["confidence"]
            for k in ("verified_at", "stale_after"):
                old[k] = max(old[k], new[k])
            if new["verification_status"] == "verified":
                old["verification_status"] = "verified"
            if new["observed_at"] > old["observed_at"]:
                old["observed_at"] = old["last_updated_at"] = new["observed_at"]
            if old["change"] == "base":
                old["change"] = "updated"
            continue
        other = next((i for s in memory.ORDER if s != section for i in sections[s] if norm(i["text"]) == norm(text)), None)
        if other:
            asked = f"Resolve: {text} vs {other['text']}"
            if (memory.OPEN, norm(asked)) not in index:
                item = {**dict.fromkeys(new, ""), "section": memory.OPEN, "text": asked, "sources": [c["session"]], "confidence": "low", "verification_status": "unverified", "related_paths": [], "related_tasks": [], "change": "added"}
                sections[memory.OPEN].append(item)
                index[memory.OPEN, norm(asked)] = item
            continue
        sections[section].append(new)
        index[key] = new
    out = []
    for s in memory.ORDER:
        for i, item in enumerate(sections[s]):
            out.append((s, item["text"], tuple(item["sources"]), item["confidence"], item["observed_at"], item["last_updated_at"], item["source_hint"], item["verified_at"], item["verification_status"], item["stale_after"], tuple(item["related_paths"]), tuple(item["related_tasks"]), item["change"], i < cap))
    return sorted(out)


def merged(spark, base, candidates, cap):
    items = spark.createDataFrame([tuple(b[n] for n in NAMES) for b in base], memory.ITEM)
    found = spark.createDataFrame([tuple(c[n] for n in CANDIDATE) for c in candidates], memory.CANDIDATE).repartition(3)
    rows = memory.merge(items, found, cap).collect()
    columns = ("section", "text", "sources", "confidence", "observed_at", "last_updated_at", "source_hint", "verified_at", "verification_status", "stale_after", "related_paths", "related_tasks", "change", "kept")
    return sorted(tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in columns) for r in rows)


def item(section, text, place, **more):
    return {**dict.fromkeys(NAMES, ""), "section": section, "text": text, "place": place, "sources": [], "confidence": "medium", "verification_status": "unverified", "related_paths": [], "related_tasks": [], **more}


def candidate(at, category, text, session=None, **more):
    return {**dict.fromkeys(CANDIDATE), "at": at, "session": session or f"s{at[0]}", "category": category, "text": text, **more}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_equals_fold(spark, seed):
    """Few texts in many sections, so that observations, conflicts and questions about questions all occur; one text has a third of all."""
    rng = random.Random(seed)
    texts = ["Use tabs", "use  TABS!", "Run it", "ok", "resolve use tabs vs use tabs", "Resolve: Use tabs vs use tabs", "Resolve resolve use tabs vs use tabs vs resolve: use tabs vs use tabs", "ß ß", "12"]
    dates = [None, "", "2024-01-02", "2024-03-01", "2023-12-31"]
    base = [item(rng.choice(memory.ORDER), rng.choice(texts), i, sources=rng.sample(["s0", "s1", "old"], rng.randint(0, 2)), source_hint=rng.choice(["", "a", "a; b"]), confidence=rng.choice(["low", "medium", "high"])) for i in range(seed * 2)]
    base = list({(b["section"], norm(b["text"])): b for b in base}.values())
    found = []
    for session in range(14):
        for number in range(rng.randint(0, 6)):
            found.append(candidate(
                (session, number), rng.choice([*memory.SECTIONS, "unknown", None]), rng.choice([*texts, *["Use tabs"] * 5, "", None, "  "]), confidence=rng.choice([None, "low", "high"]), observed_at=rng.choice(dates), verified_at=rng.choice(dates),
                verification_status=rng.choice([None, "verified", "failed"]), stale_after=rng.choice(dates), source_hint=rng.choice([None, "hint", "a"]), related_paths=rng.choice([None, [], ["p", "q", "p"]]), related_tasks=rng.choice([None, ["t1"], ["t2"]]),
            ))
    for cap in (100, 3):
        assert merged(spark, base, found, cap) == fold(base, found, cap)


def test_merge_of_nothing(spark):
    assert merged(spark, [], [], 5) == []
    base = [item("Working Rules", "x", 0)]
    assert merged(spark, base, [], 5) == fold(base, [], 5)


def test_text_and_back(spark):
    odd = ['a "b" \\ c', "line\nnext", "tab\there", "it's: a # [list], {x}", "- dash", "## no section", "ends (updated: soon)", "\U0001f600 ß", "x" * 5000]
    rows = [item(s, t, i, id=f"mem-{i}", sources=["s, 1", 'q"', "\\"], observed_at="2024-01-01", last_updated_at="2024-02-02" if i % 2 else "", source_hint=t, related_paths=["a/b c", "]"]) for i, (s, t) in enumerate(zip(memory.ORDER * 2, odd)) if "\n" not in t]
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], memory.ITEM).withColumn("doc", F.lit(1))
    back = memory.parse(memory.render(df, ["doc"]), ["doc"]).drop("doc", "place")
    assert sorted(map(repr, (r.asDict() for r in back.collect()))) == sorted(map(repr, (r.asDict() for r in df.select(back.columns).collect())))


def test_parse_by_hand(spark):
    text = "\n".join([
        "preamble", "- no section", "## Working Rules", "", "- (none yet)", "  id: lost", "- Keep it  (updated: 2024-05-06) ", "  id: mem-1", "  observation_sessions:", "  - one", "  - 'two''s'", "    - three", "", "  confidence: high",
        "prose", "## Unknown", "- skipped", "## Stable Project Facts", "-", "- Plain", "  related_paths: [a, \"b, c\"]", "  bad line", "## Deprecated / Superseded", "- (none yet)",
    ])
    got = {r.text: r for r in memory.parse(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, memory string"), ["doc"]).collect()}
    assert set(got) == {"Keep it", "Plain"}
    rule = got["Keep it"]
    assert (rule.section, rule.id, rule.last_updated_at, rule.sources, rule.confidence) == ("Working Rules", "mem-1", "2024-05-06", ["one", "two's", "three"], "high")
    assert got["Plain"].related_paths == ["a", "b, c"] and got["Plain"].id.startswith("mem-") and got["Plain"].confidence == "medium"
