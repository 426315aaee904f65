"""The corpus operators against brute force, on small fixtures with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from ledgerlight.llm import bpe, components, line_dedup, packing, quality_rules, queries, sharding, simhash, substring_dedup, token_counts, topk, warc
from ledgerlight.llm.oracles import ORACLES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdefghij klmnop qrstu vwxyz"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, cell string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, one hot source, clashing names."""
    rng = random.Random(7)
    line = "This line is found in many documents"
    rows = [(i, "\n".join([sentence(rng, 30), line, f"  {line.upper()}\t", sentence(rng, 40)]), "en", "hot", 1, "x", "y") for i in range(30)]
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1].replace("e", "é", 3), None, f"s{i % 3}", None, None, None) for i in range(12)]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "hot", 0, None, None), (202, " \n\t\n", "en", "hot", 0, None, None)]
    rows += [(203, sentence(rng, 30_000), "en", "long", 0, None, None), (204, "a" * 20_000, "en", "long", 0, None, None)]
    rows += [(205, "Öl İΣσς 日本語 \U0001f600 it's <|endoftext|> x</w> 12³", "de", "hot", 0, None, None), (None, rows[0][1], "en", "hot", 1, None, None)]
    rows += [rows[3], rows[3], (206, "of " * 200, "en", "hot", 0, None, None), (207, "of " * 150, "en", "hot", 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], ORACLES[name])


# Quality rules


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_counts(text):
    text = text or ""
    w = words_of(text)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(odd):
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.scores(odd).collect())
    assert got == sorted((r.doc_id is None, r.doc_id, *quality_counts(r.text)) for r in odd.collect())
    kept = {r.doc_id for r in quality_rules.scores(odd).collect() if r.kept}
    out = quality_rules.keep_good(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == kept and kept.isdisjoint({200, 201, 206})
    assert quality_rules.scores(empty(odd)).count() == 0


# Sharding


def test_sharding(odd):
    rows = sharding.interleave(odd, shards=4, cell_rows=5).collect()
    n = odd.count()
    assert len(rows) == n and sorted(r.place for r in rows) == list(range(n))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(x) for x in by.values()]
    assert len(by) == 4 and max(sizes) - min(sizes) <= 1
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
        assert abs(sum(r.source == "hot" for r in x) - sum(r.source == "hot" for r in rows) / 4) <= 2
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    again = sharding.interleave(odd.repartition(5), shards=4, cell_rows=5).collect()
    assert sorted((r.place, r.doc_id or -1) for r in rows) == sorted((r.place, r.doc_id or -1) for r in again)
    assert sharding.interleave(empty(odd)).count() == 0


# Line dedup


def test_lines(odd):
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    rows = odd.collect()
    rank = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(rank(r.doc_id))
    gone = lambda x, i: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != rank(i)
    expect = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = "\n".join(x for x in lines if not gone(x, r.doc_id))
        expect.append((rank(r.doc_id), len(lines), sum(gone(x, r.doc_id) for x in lines), hashlib.sha256(kept.encode()).hexdigest(), kept))
    maps = line_dedup.keep_bitmaps(odd)
    got = [(rank(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(odd, maps).collect()]
    assert sorted(got) == sorted(x[:4] for x in expect)
    out = line_dedup.drop_lines(odd, maps)
    assert out.schema == odd.schema and sorted((rank(r.doc_id), r.text or "") for r in out.collect()) == sorted((x[0], x[4]) for x in expect)
    assert line_dedup.digests(empty(odd), line_dedup.keep_bitmaps(empty(odd))).count() == 0


# WARC


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 7))]
        merged = [(runs[r][i], r) for r, i in warc.merge_order(runs)]
        assert merged == sorted((x, r) for r, xs in enumerate(runs) for x in xs)


def test_warc(spark):
    tricky = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60
    pages = [(i, f"http://host{i % 3}.example.org/{i % 5}?q={i}", ("x" * 1500 + "é") if i % 3 == 0 else "y" * i) for i in range(40)]
    pages += [(None, None, None), (50, "http://a b\r\nc", tricky), (51, "http://[::bad", ""), (52, "", "z" * 999), (53, "", "z" * 999), (54, "x", "z" * 1000), (54, "x", "z" * 1000), (None, "n", tricky)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rows = warc.archive_and_index(df).collect()
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    expect = []
    for i, _, h in pages:
        body = (h or "").encode()
        best = max((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(body) >= 1000 and best is not None and best != i
        expect.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", str(best if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows) == sorted(expect)
    order = [(r.url_key, r.captured) for r in rows]
    assert order == sorted(order)
    assert warc.archive_and_index(empty(df)).count() == 0


# BPE and packing


def test_bpe_words():
    lib, own, by_lib = Tokenizer.from_file(WORD_BPE), bpe.BacktrackingBpe(WORD_BPE), bpe.BacktrackingBpe(WORD_BPE, by_library=True)
    rng = random.Random(2)
    alphabet = "abcdefghij ABC 012'stdm\n\t!?éüßñİΣςσ́  日本語한\U0001f600½²/w>\x1c\x85ǅ€ſK"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += ["", "a" * 4000, "ab" * 2000, "x</w>", "<|endoftext|><|startoftext|> hi", "</w></w>"]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        for e in (own, by_lib):
            packed = e.encode(t)
            assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed).decode() == lib.decode(ids, skip_special_tokens=False)
    # Where the library has the merges, a worker doesn't hold them again.
    assert not {"trie", "ranks", "parts", "names"} & vars(by_lib).keys()


def test_bpe(odd):
    lib = Tokenizer.from_file(WORD_BPE)
    expect = []
    for r in odd.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        expect.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(odd, WORD_BPE).collect()) == sorted(expect)
    assert bpe.encode_decode(empty(odd), WORD_BPE).count() == 0


def test_packing(odd):
    lib = Tokenizer.from_file(WORD_BPE)
    docs = odd.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    ids = {r.doc_id: np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in docs.collect()}
    pieces = packing.pack(docs.coalesce(1), WORD_BPE).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert of.keys() == ids.keys()
    for doc, ps in of.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc]) // 4 and p.ids_crc32 == zlib.crc32(ids[doc][4 * at : 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids[doc])
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert len(sequences) == -(-total // 2048)
    assert packing.pack(empty(odd), WORD_BPE).count() == 0
    assert {p.doc_tokens for p in packing.pack(odd.filter("doc_id = 200"), WORD_BPE).collect()} == {1}


def test_balance_prefers_low_cost():
    pieces, count = packing.balance(np.array([900, 800, 700, 600, 500, 400, 150, 46]), 2048, 1.0, 1 / 2048)
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 2048
    assert count == 2 and max(cost.values()) < 1.25 * min(cost.values())


# SimHash and components


@pytest.mark.parametrize("covering", [simhash.Covering(4, 3), simhash.Covering(11, 4), *map(simhash.covering_for, (1, 1 << 24, 1 << 30))])
def test_covering(covering):
    rng = np.random.default_rng(1)
    for _ in range(150):
        u = int(rng.integers(0, 2**63))
        v = u
        for b in rng.choice(64, rng.integers(0, covering.threshold + 1), replace=False):
            v ^= 1 << int(b)
        both = zip(simhash._anchored(covering, np.array([u], np.uint64), simhash.HOME), simhash._anchored(covering, np.array([v], np.uint64), simhash.VISITOR))
        assert any(home[0] in anchors for (_, home), (_, anchors) in both)


@pytest.mark.parametrize("rows", [1, 1 << 20, 1 << 26, 1 << 30])
def test_visits_find_what_homes_lose(rows):
    """Many near fingerprints have no home in common, and meet as one visits the other's."""
    rng, c, apart, lost = np.random.default_rng(3), simhash.covering_for(rows), 0, 0
    for _ in range(200):
        u = int(rng.integers(0, 2**63))
        v = u
        for b in rng.choice(64, 4, replace=False):
            v ^= 1 << int(b)
        home, other, visits = ({int(a) for _, anchors in simhash._anchored(c, np.array([x], np.uint64), kind) for a in anchors} for x, kind in ((u, simhash.HOME), (v, simhash.HOME), (v, simhash.VISITOR)))
        apart += not home & other
        lost += not home & visits
    assert apart >= 10 and lost == 0


def test_comparisons_stay_few():
    """A row meets few others while the rows grow: visits times homes, over the anchors. The words tolerate a bit."""
    for rows, most in ((1 << 17, 60), (1 << 18, 120), (1 << 20, 120), (1 << 23, 800), (1 << 26, 300), (1 << 28, 900), (1 << 30, 500)):
        c = simhash.covering_for(rows)
        prints = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
        met = sum(len(anchors) / len(prints) / 2 ** (sum(size for _, size in word) - 4) for word, (_, anchors) in zip(c.words(), simhash._anchored(c, prints, simhash.VISITOR)))
        assert c.within == 1 and rows * met < most


def simhash_brute(rows, threshold=4):
    prints = []
    for i, text in rows:
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = {i: i for i, _ in prints if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [x for x in prints if x[0] is not None]
    for k, (i, f) in enumerate(known):
        for j, g in known[:k]:
            if (f ^ g).bit_count() <= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((str(i), f"{f:016x}", str(None if i is None else root(i))) for i, f in prints)


def test_simhash(spark, odd):
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.digests(odd).collect()) == simhash_brute([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.digests(empty(odd)).count() == 0
    kept = simhash.keep_one(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(None) == 1 and ids.count(3) == 1 and 101 not in ids and 203 in ids


def test_simhash_hot_cell(spark, monkeypatch):
    """Homes of one cell over several tasks: no link is lost."""
    monkeypatch.setattr(simhash, "CELL_HOMES", 7)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    rows = []
    for i in range(300):
        f = base if i % 3 == 0 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            f ^= 1 << b
        rows.append((i, f - (1 << 64) if f >> 63 else f, 0))
    df = spark.createDataFrame(rows, "node long, f1 long, f2 long")
    found = {r.node: r.component for r in components.components(simhash.near_links(df, simhash.Covering(4, 3))).collect()}
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f, _ in rows:
        for j, g, _ in rows[:i]:
            if ((f ^ g) & (1 << 64) - 1).bit_count() <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert found == {i: root(i) for i in range(300) if root(i) != i}


def test_keep_one_by_shingles(spark):
    """Against the components of exact five-word Jaccard >= 0.8, with pairs on both sides of it and texts of few words."""
    rng, rows = random.Random(11), []
    for n in (7, 9, 14, 40, 200, 500):
        for rate in (0.004, 0.01, 0.02, 0.025, 0.03, 0.04, 0.06):
            for _ in range(4):
                base = sentence(rng, n).split()
                near = [w if rng.random() > rate else "x" + w for w in base]
                tail = base + sentence(rng, rng.randint(1, max(1, n // 3))).split()
                rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((base, near, tail))]
    loop = "a b c d e " * 150
    rows += [(5000, loop + sentence(rng, 100)), (5001, loop + sentence(rng, 100)), (5002, "one two"), (5003, "One  TWO")]
    sets = {i: (w := t.lower().split()) and {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in parent:
        for j in parent:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    expect = {i for i in parent if root(i) == i}
    assert 5001 in expect and 5003 not in expect and 100 < len(expect) < 450
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == expect
    assert {r.doc_id for r in simhash.keep_one(df, most=None).collect()} == expect


def test_anchors_find_near_copies(spark, monkeypatch):
    """Near-dedup's links come from the anchors: without the exact check nearly all are found, none that isn't one; hot cells lose none."""
    rng, rows, near = random.Random(12), [], []
    for i in range(300):
        base = sentence(rng, 150).split()
        other = list(base)
        for at in rng.sample(range(5, 140), 1 + i % 5):
            other[at] = "x" + other[at]
        a, b = ({tuple(w[k : k + 5]) for k in range(146)} for w in (base, other))
        near.append(5 * len(a & b) >= 4 * len(a | b))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    gone = lambda **more: {i for i, _ in rows} - {r.doc_id for r in simhash.keep_one(df, **more).collect()}
    expect, found = {2 * i + 1 for i, x in enumerate(near) if x}, gone(whole=False)
    assert 150 < len(expect) < 290 and found <= expect and len(found) >= 0.95 * len(expect)
    assert gone() == expect
    for name in ("CELL_HOMES", "PAIRS_HELD", "COMPARED"):
        monkeypatch.setattr(simhash, name, 3)
    assert gone(whole=False) == found and gone() == expect


def test_near_dedup_in_small_batches(spark, monkeypatch):
    """What a worker of near-dedup gets and gives at once is bounded by bytes, whatever the sizes of texts and packs."""
    rng = np.random.default_rng(14)
    n, size = 6000, 480
    packs = [rng.integers(0, 1 << 40, simhash.visit_prefix(np.int64(size)), np.uint64).tobytes() for _ in range(n)]
    column = lambda: pa.array(rng.integers(0, 1 << 62, n))
    names = ["node", "f1", "f2", "size", "tokens", "label"]
    batch = pa.record_batch([pa.array(range(n)), column(), column(), pa.array([size] * n, pa.int32()), pa.array(packs, pa.binary()), column()], names)
    packed = list(simhash._copy_replicas(512)([batch]))
    assert max(x.nbytes for x in packed) < 8 << 20
    rows = np.concatenate([simhash.unplaned(p.as_py(), simhash.COPY) for x in packed for p in x.column(1)])
    assert len(rows) == sum(map(len, packs)) // 8 and (np.bincount(rows["node"], minlength=n) == len(packs[0]) // 8).all()

    texts = [(i, sentence(random.Random(i // 2), 150) + (" more" if i % 2 else "")) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    expect = {r.doc_id for r in simhash.keep_one(df).collect()}

    def bounded(of):
        def checked(*args):
            run = of(*args)

            def each(batches):
                for b in batches:
                    assert len(b) == 1 or b.nbytes < most * 3 // 2, b.nbytes
                    yield b

            return lambda batches: run(each(batches))

        return checked

    most = 1 << 17
    monkeypatch.setattr(simhash, "AT_ONCE", most)
    for name in ("_copy_pairs", "_copy_meetings", "_prefixes"):
        monkeypatch.setattr(simhash, name, bounded(getattr(simhash, name)))
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(x, None) for x in names]
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == expect == set(range(0, 600, 2))
    assert [spark.conf.get(x, None) for x in names] == before


def test_anchors_meet_few(spark):
    """Candidates are near by bits, each node brings few, and equal fingerprints meet their smallest node."""
    rng = random.Random(13)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    base = [rng.getrandbits(64), rng.getrandbits(64)]
    rows = [(i, *(signed(f ^ (1 << rng.randrange(64)) if i % 2 else f) for f in base)) for i in range(200)]
    rows += [(1000 + i, signed(rng.getrandbits(64)), signed(rng.getrandbits(64))) for i in range(200)]
    pairs = {(r.a, r.b) for r in simhash.copy_candidates(spark.createDataFrame(rows, "node long, f1 long, f2 long")).collect()}
    assert all(b < a < 200 for a, b in pairs) and {(2 * i, 0) for i in range(1, 100)} <= pairs and len(pairs) < 100 * 50
    joined = {r.node: r.component for r in components.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert joined == {i: 0 for i in range(1, 200)}


def test_components(spark):
    rng = random.Random(3)
    edges = {(max(a, b), min(a, b)) for a, b in ((rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)) if a != b}
    edges |= {(i + 1, i) for i in range(1000, 1040)} | {(i, 500) for i in range(501, 560)}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


# Top-k


def topk_brute(rows, k=10, every=100):
    fine = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, q in fine:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fine if j != i)
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_topk(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.05, 1, 4]) for _ in range(rng.choice([8, 8, 8, 5]))]) for i in range(900)]
    rows += [(i, [1.0] * 8) for i in range(900, 1400)] + [rows[5], (None, [1.0]), (5000, None), (5100, [float("nan")]), (5200, [None, 1.0]), (5300, []), (5400, [0.0] * 8), (5500, [float("inf")]), (-100, [0.5] * 8), (6000, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    small = [r for r in rows if r[0] != 6000]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.filter("vec_id IS NULL OR vec_id <> 6000")).collect()}
    assert got == topk_brute(small)
    assert topk.top_k(df).count() > 0  # products beyond 64 bits are clipped, not wrapped
    assert topk.top_k(empty(df)).count() == 0


# Token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, odd, rule):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    docs = odd.filter("doc_id <> 203 AND doc_id <> 204").union(spark.createDataFrame([(900, "a\n\n\nb 日本\U0001f600\U0001f9d1‍\n語 x\n", *[None] * 5)], SCHEMA)).dropDuplicates(["doc_id"])
    got = defaultdict(list)
    for r in token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule).collect():
        got[r.doc_id].append((r.section, r.start_char, r.end_char, round(r.n_tokens, 9)))
    for r in docs.collect():
        text, at, sections = r.text or "", 0, []
        for i, line in enumerate(parts := text.split("\n")):
            end = at + len(line) + (i < len(parts) - 1)
            sections.append([i, at, end, 0.0])
            at = end
        for a, b in lib.encode(text, add_special_tokens=False).offsets:
            share = [max(0, min(b, e) - max(a, s)) for _, s, e, _ in sections]
            if rule == "start":
                share = [float(s <= a < e) for _, s, e, _ in sections]
            elif rule == "most":
                share = [float(i == int(np.argmax(share))) for i in range(len(share))]
            else:
                share = [x / (b - a) for x in share]
            for s, x in zip(sections, share):
                s[3] += x
        assert sorted(got[r.doc_id]) == [(*s[:3], round(s[3], 9)) for s in sections]
    assert token_counts.count_tokens(empty(odd), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_crossing_tokens():
    start, end = np.array([0, 3, 6]), np.array([3, 6, 9])
    a, b = np.array([0, 4]), np.array([4, 9])
    assert [token_counts.allocate(start, end, a, b, r)[0].tolist() for r in ("start", "most")] == [[2, 1], [1, 2]]
    counts, crossing = token_counts.allocate(start, end, a, b, "share")
    assert np.allclose(counts, [4 / 3, 5 / 3]) and crossing.tolist() == [1, 1]


# Substring dedup


def test_chain_is_best():
    rng, o = random.Random(6), substring_dedup.Settings(max_gap=10**6)
    for _ in range(200):
        points = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(1, 14))})
        x, y = map(np.array, zip(*points))
        best = [float(o.k)] * len(x)
        for j in range(len(x)):
            for i in range(j):
                if x[i] < x[j] and y[i] < y[j]:
                    best[j] = max(best[j], o.k + best[i] - o.gap_cost * (x[j] - x[i] + y[j] - y[i]))
        chains = substring_dedup.chain(x, y, o)
        assert sorted(i for c in chains for i in c) == list(range(len(x)))
        c = chains[0]
        assert abs(o.k * len(c) - o.gap_cost * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) - max(best)) < 1e-9


def test_common_length():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        assert substring_dedup.common_length(a, b) == t[-1][-1]


def test_passages(spark):
    rng = random.Random(9)
    shared = sentence(rng, 60).split()
    fuzzy = list(shared)
    fuzzy[20] = "changed"
    del fuzzy[41]
    short = sentence(rng, 30)
    rows = []
    for i in range(60):
        words = sentence(rng, 200).split()
        if i % 3 == 0:
            at = rng.randint(0, 200)
            words[at:at] = shared if i % 2 else fuzzy
        if i % 5 == 1:
            words[100:100] = short.split()
        rows.append((i, " ".join(words) if i % 4 else "\n".join(words)))
    rows += [(100, None), (101, ""), (None, " ".join(shared)), (102, "of " * 120), (103, "of " * 90), (104, "one two"), rows[9], rows[10]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = substring_dedup.passages(df).collect()
    assert {i for r in found for i in (r.doc_id, r.other_id)} == {i for i in range(0, 60, 3)} | {102, 103}
    text = {i: t.split() for i, t in rows if i is not None and t}
    for r in found:
        assert r.doc_id > r.other_id and r.matched >= 0.8 * r.aligned and max(r.end_word - r.start_word, r.other_end - r.other_start) >= 50
        assert text[r.doc_id][r.start_word] == text[r.other_id][r.other_start] and text[r.doc_id][r.end_word - 1] == text[r.other_id][r.other_end - 1]
    left = {r.doc_id: r.text for r in substring_dedup.drop_passages(df, substring_dedup.passages(df)).collect()}
    assert [i for i in range(0, 60, 3) if shared[5] in left[i].split()] == [0]
    assert all(left[i] == dict(rows)[i] for i in range(60) if i % 3)
    assert left[100] is None and left[101] == ""
    assert substring_dedup.passages(empty(df)).count() == 0


def test_passage_of_common_sentences(spark):
    """A passage that two documents share is found though smaller documents hold each of its sentences."""
    rng, rows, pairs = random.Random(12), [], []
    for group in range(40):
        parts = [sentence(rng, 16 + group % 15) for _ in range(4)]
        at = group * 10
        rows += [(at + i, f"{sentence(rng, 60)} {p} {sentence(rng, 60)}") for i, p in enumerate(parts)]
        rows += [(at + i, f"{sentence(rng, 60)} {' '.join(parts)} {sentence(rng, 60)}") for i in (5, 6)]
        pairs.append((at + 6, at + 5))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {(r.doc_id, r.other_id) for r in substring_dedup.passages(df).collect()}
    assert found == set(pairs)


def test_passages_follow_from_the_rows(spark, monkeypatch):
    """One partition or many, hot seeds or none: the same passages. Verbatim ones of 62 words or more against brute force."""
    rng = random.Random(21)
    sentences = [sentence(rng, n) for n in (9, 14, 20, 23, 31, 40, 45, 49) for _ in range(5)]
    rows = []
    for i in range(150):
        parts = [rng.choice(sentences) if rng.random() < 0.7 else sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(2, 8))]
        rows.append((i, " ".join(parts)))
    rows += [(150 + i, f"{sentence(rng, 20)} {rows[3][1]} {sentences[-1]}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda d: sorted(tuple(r) for r in substring_dedup.passages(d).collect())
    one = result(df.coalesce(1))
    assert result(df.repartition(16)) == one
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    assert result(df.coalesce(1)) == one
    first: dict[tuple, int] = {}
    due = set()
    for i, text in rows:
        w = text.split()
        for k in range(len(w) - 61):
            if first.setdefault(tuple(w[k : k + 62]), i) < i:
                due.add((i, k))
    covered = defaultdict(set)
    for doc, _, a, b, *_ in one:
        covered[doc] |= set(range(a, b))
    assert len(due) > 500 and all(len(covered[i] & set(range(k, k + 62))) >= 50 for i, k in due)


def test_fuzzy_passages(spark):
    """Passages with substituted words against the words that agree by construction, which no alignment can better much."""
    rng, rows, near = random.Random(13), [], {0.82: [], 0.85: [], 0.9: []}
    for share, pairs in near.items():
        for i in range(60):
            words = sentence(rng, 60 + 20 * (i % 2)).split()
            other = list(words)
            for p in rng.sample(range(1, len(words) - 1), round((1 - share) * len(words))):
                other[p] = sentence(rng, 1) + "z"
            k = len(rows)
            rows += [(k + j, f"{sentence(rng, 80)} {' '.join(w)} {sentence(rng, 80)}") for j, w in enumerate((words, other))]
            pairs.append((k + 1, k))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {(r.doc_id, r.other_id) for r in substring_dedup.passages(df).collect()}
    recall = {share: len(found & set(pairs)) / len(pairs) for share, pairs in near.items()}
    print(recall)
    assert found <= {p for pairs in near.values() for p in pairs}
    assert recall[0.9] >= 0.98 and recall[0.85] >= 0.93 and recall[0.82] >= 0.85


def test_word_codes_and_minimizers(monkeypatch):
    """Words of texts side by side against bytes.split, minimizers against windows taken one by one."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 64)
    rng = random.Random(3)
    words = ["a", "B", "bb", "Abc", "x\u00e9", "of", "\0q", "w" * 300]
    texts = [(rng.choice([" ", "\n", "  ", "\t\x0b"]).join(rng.choices(words, k=rng.choice([0, 1, 4, 6, 9, 40, 200]))) + rng.choice(["", " "])).encode() for _ in range(200)]
    data, at = substring_dedup.texts_of(pa.array([b"skipped", *texts], pa.binary()).slice(1))
    starts, codes = substring_dedup.word_codes(data[at[0] : at[-1]], at[:-1] - at[0])
    first = np.searchsorted(starts, at - at[0])
    seen: dict[bytes, int] = {}
    for i, text in enumerate(texts):
        mine = codes[first[i] : first[i + 1]].tolist()
        assert len(mine) == len(text.split()) and all(seen.setdefault(w, c) == c for w, c in zip(text.lower().split(), mine))
    assert len(set(seen.values())) == len(seen)
    of, place, _ = substring_dedup.minimizers(codes, first, 1, 3)
    for i in range(len(texts)):
        key = [int(substring_dedup.minimizers(codes[j : j + 1], np.array([0, 1]), 1, 1)[2][0]) for j in range(first[i], first[i + 1])]
        windows = [key[j : j + 3] for j in range(max(1, len(key) - 2))] if key else []
        assert place[of == i].tolist() == sorted({j + w.index(min(w)) for j, w in enumerate(windows)})


def test_runs_of_equal_words_are_one():
    assert substring_dedup.joined([(2, 2, 2, 2), (3, 3, 3, 3), (1, 1, 0, 1), (1, 1, 1, 1), (1, 2, 1, 2), (4, 4, 4, 4)]) == [
        (5, 5, 5, 5), (1, 1, 0, 1), (1, 1, 1, 1), (1, 2, 1, 2), (4, 4, 4, 4),
    ]


def test_without_words():
    assert substring_dedup.without_words(b" a bb\n ccc d ", [(1, 3)]) == b" a d "
    assert substring_dedup.without_words(b"a b c", [(1, 3), (0, 1)]) == b""
    assert substring_dedup.without_words(b"a b", [(5, 9)]) == b"a b"


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from ledgerlight.llm.common import stored

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, "/root/testdata/sf0.001"), name.replace(" ", "-"))
        counts.append(now.count())
        if name != "packing":
            assert now.columns == docs.columns
    assert len(counts) == 5 and counts[0] < docs.count() and counts[2] <= counts[1] == counts[0] and counts[3] == counts[2]
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert whole.columns == now.columns and whole.count() == now.count()
