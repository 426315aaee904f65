"""Kinds of transcripts by text, records and names."""

import json

from pyspark.sql import functions as F

from ledgerlight.operators import transcripts

MESSAGE = {"role": "user", "content": "hi"}
FILES = [
    ("a.md", "## User\nhi\n**Assistant**: yo", "dialogue-markers"), ("a.md", "user: a\nhuman: b", None), ("a.md", "\x1b[1mHuman:\x1b[0m a\n Claude (x)", "dialogue-markers"), ("a.txt", "users: a\nassistants: b", None),
    ("t.txt", "❯ run\n● done", "claude-terminal-dialogue"), ("t.txt", "> only", None),
    ("r.jsonl", "bad\n" + json.dumps(MESSAGE), "message-record"), ("r.json", json.dumps({"messages": [{"x": 1}, MESSAGE]}), "message-record"), ("r.json", json.dumps([MESSAGE]), "message-record"), ("r.JSON", json.dumps(MESSAGE), "message-record"),
    ("r.txt", json.dumps(MESSAGE), None), ("r.json", json.dumps({"role": "tool", "content": "x"}), None), ("r.json", json.dumps({"role": "user"}), None), ("r.json", json.dumps({"message": {"role": "assistant", "text": "x"}}), "message-record"),
    ("r.json", json.dumps({"payload": {"role": "user", "content": [1, {"a": 2}]}}), "message-record"), ("r.json", json.dumps({"type": "session_meta", "payload": {"id": 1}}), "session-metadata"), ("r.json", json.dumps({"type": "session_meta", "payload": 3}), None),
    ("r.json", json.dumps({"message": {"role": "tool"}, "role": "user", "content": "x"}), None), ("r.json", "[1, 2]", None), ("r.jsonl", "", None), ("r.json", "{", None),
    ("d/rollout-1.jsonl", "{}", "filename-only-review-required"), ("rollout-1.json", "{}", None), ("Claude-session-x.txt", "", "filename-only-review-required"), ("2024-05-06_123456.md", "x", "filename-only-review-required"), ("chat_export.log.md", "x", "filename-only-review-required"),
    ("my-rollout-1.md", "x", None), (None, None, None), ("", "", None),
]


def test_kinds(spark):
    df = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(FILES)], "i int, name string, text string").repartition(2)
    got = {r.i: r.k for r in df.select("i", transcripts.kind(F.col("name"), F.col("text")).alias("k")).collect()}
    assert [(FILES[i][:2], got[i]) for i in range(len(FILES))] == [(f[:2], f[2]) for f in FILES]


def test_routes(spark):
    text = "user: a\nclaude: b"
    df = spark.createDataFrame([("a.md", text, 3, True, "x"), ("b.md", text, 20, True, "x"), ("c.md", text, 20, None, "x"), ("d.md", "x", 20, False, "x")], "name string, text string, age_days int, tracked boolean, other string")
    got = {r.name: (r.action, r.why) for r in transcripts.routed(df, 14).collect()}
    assert got == {"a.md": ("keep", "younger than 14 days"), "b.md": ("keep", "tracked"), "c.md": ("decide", "untracked transcript (dialogue-markers), 20d old")}
