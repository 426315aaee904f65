"""The Merkle manifest against a tree built whole, on odd rows and on groups of more than one stretch."""

import hashlib
import zlib
from collections import Counter

import pytest

from ledgerlight.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, node string, id int"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(doc, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], text)))


def tree(nodes):
    """The top node, and the (place, run) steps of every leaf."""
    steps, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, joined = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for i in groups[a + k]:
                    steps[i].append((k, run))
            above.append(h(*run))
            joined.append(sum(groups[a : a + 8], []))
        nodes, groups = above, joined
    return nodes[0], steps


def brute(docs):
    by_lang = {}
    for doc in docs:
        by_lang.setdefault(doc[2], []).append(doc)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    roots, below = [], {}
    for lang in order:
        rows = sorted(by_lang[lang], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        top, steps = tree([leaf(d, d[1]) for d in rows])
        roots.append(top)
        below[lang] = (rows, steps)
    root, over = tree(roots)
    out = []
    for top, up, lang in zip(roots, over, order):
        for doc, own in zip(*below[lang]):
            steps = own + up
            text = doc[1]
            if doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate({i: i + 32 for i in range(65, 91)})
            node = leaf(doc, text)
            for k, run in steps:
                node = h(*run[:k], node, *run[k + 1 :])
            proof = h(*(x for k, run in steps for j, x in enumerate(run) if j != k))
            out.append((doc[0], leaf(doc, doc[1]), top, root, proof, node, node == root))
    return Counter(out)


def found(spark, docs, parts=3):
    got = merkle.manifest(spark.createDataFrame(docs, SCHEMA).repartition(parts))
    return Counter(tuple(r) for r in got.collect())


def doc(i, text, lang="en", source="s", n=1):
    return (i, text, lang, source, n, "x", "y", 1)


def test_odd_rows(spark):
    rows = [doc(i, f"Text {i}", "en" if i % 3 else None) for i in range(70)]
    rows += [doc(100, None), doc(101, ""), doc(102, "Ä \U0001f600 日本", "de", None, None), doc(103, "Z" * 300_000), doc(None, "No id"), doc(None, None, None, None, None)]
    rows += [doc(104, "A"), doc(104, "B"), doc(104, "A"), doc(7, "Text 7"), doc(200, "alone", "é"), doc(201, "last", "z")]
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, 1) == want


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65])
def test_sizes(spark, count):
    rows = [doc(i, f"T{i}") for i in range(count)]
    assert found(spark, rows) == brute(rows)


def test_more_than_one_stretch(spark):
    """A group of more than 8^4 leaves, one row of which is there 5,000 times, beside one of a stretch and a leaf."""
    rows = [doc(i, f"T{i}", "big") for i in range(4200)] + [doc(9_000, "Same", "big")] * 5_000
    rows += [doc(20_000 + i, f"S{i}", "next") for i in range(merkle.STRETCH + 1)] + [doc(50_000, "x", None)]
    assert found(spark, rows, 5) == brute(rows)


def test_many_groups(spark):
    """More groups than a stretch holds, so that the groups' own tree has two levels of packs."""
    rows = [doc(i, f"T{i}", f"g{i}") for i in range(merkle.STRETCH + 9)]
    assert found(spark, rows, 4) == brute(rows)


def test_empty(spark):
    got = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 0


def test_frontier_extends_witnesses():
    tree_now = merkle.Frontier()
    for i in range(9):
        tree_now.append(h(str(i)))
    # The first run is complete: its leaves have one step each, the ninth has none yet.
    assert [len(w) for w in tree_now.witnesses] == [1] * 8 + [0]
    top = tree_now.close(2)
    assert all(merkle.folded(h(str(i)), w) == top for i, w in enumerate(tree_now.witnesses))
