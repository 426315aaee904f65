"""Links, frontmatter, fences and flattened records."""

import time

from ledgerlight.operators import markdown as M

TEXT = """See [a](one.md) and [b](<two words.md>), [c](path(with)parens.md "title"), [d](../up.md#x).
\\[no\\](escaped.md) [e](https://example.org/x) [f](#anchor) ![img](pic\\_1.png)
```
[fenced](hidden.md)
```
~~~~
~~~
[still](hidden.md)
~~~~
[g](/root.md?q=1) [open](never"""


def test_links():
    found = M.links(TEXT)
    assert found == ["one.md", "two words.md", "path(with)parens.md", "../up.md#x", "https://example.org/x", "#anchor", "pic_1.png", "/root.md?q=1"]
    assert [M.resolve(t, "docs/page.md") for t in found] == [
        ("local", "docs/one.md"), ("local", "docs/two words.md"), ("local", "docs/path(with)parens.md"), ("local", "up.md"),
        ("skipped", ""), ("skipped", ""), ("local", "docs/pic_1.png"), ("local", "root.md"),
    ]
    assert M.resolve("../../x.md", "docs/page.md") == ("escaped", "")


def test_long_runs():
    began = time.time()
    for unit in ("[", "](", "[a](", "```\n", "\\"):
        M.links(unit * 20_000)
    assert time.time() - began < 30


def test_frontmatter():
    assert M.frontmatter('---\ntitle: "A: b"\nlist:\n  - x\n# no\n---\nbody: x') == {"title": "A: b", "list": ""}
    assert M.frontmatter("title: x\n---\n") == {}


def test_flatten():
    assert M.flatten('{"a": {"b": [1, {"c": true}]}, "api_token": {"x": 1}, "d": null}') == "a.b: 1\na.b.c: True\napi_token: [REDACTED:value]\nd: None"
    assert M.flatten("{") is None


def test_frames(spark):
    df = spark.createDataFrame([("docs/a.md", TEXT), ("b.md", None), (None, "[x](y)")], "path string, text string")
    assert M.link_table(df).filter("kind = 'local'").count() == 6
    meta = M.with_frontmatter(spark.createDataFrame([("---\nk: v\n---\n",), (None,)], "text string")).collect()
    assert [r.meta for r in meta] == [{"k": "v"}, None]
