"""The record's checks, running budgets and the export policy against plain loops."""

import fnmatch
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import audit, policy
from ledgerlight.plans.audit import validate_record


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def faults_of(records):
    out, claims, held = Counter(), set(), set()
    for r in records:
        claims |= {c for c, _ in r["claims"] or []}
        held |= {e[1] for e in r["evidence"] or []}
    needs, ends = set(), set()
    for r in records:
        if r["stored"] is None:
            out["missing_source_bytes", r["revision"]] += 1
        elif sha(r["stored"]) != r["digest"]:
            out["source_digest_mismatch", r["revision"]] += 1
        for e, c, a, b, q in r["evidence"] or []:
            if a is None or b is None or not 0 <= a < b <= len(r["text"]):
                out["invalid_locator", e] += 1
            elif r["text"][a:b] != q:
                out["evidence_quote_mismatch", e] += 1
            if c not in (r["dependencies"] or []):
                out["missing_dependency", e] += 1
        for p, d, content in r["pages"] or []:
            if content is None:
                out["rendered_page_missing", p] += 1
            elif sha(content) != d:
                out["render_conflict", p] += 1
        needs |= {("reviewed_claim_without_evidence", c) for c, s in r["claims"] or [] if s == "reviewed" and c not in held}
        ends |= {("invalid_contradiction", i) for i, *both in r["contradictions"] or [] if any(x not in claims for x in both)}
    return out + Counter(needs | ends)


def test_validate(spark):
    rng = random.Random(1)
    records = []
    for i in range(80):
        text = f"text of record {i}"
        pick = lambda f, most=2: rng.choice([None, []]) if rng.random() < 0.2 else [f() for _ in range(rng.randint(1, most))]  # noqa: B023, E731
        claim = lambda: f"c{rng.randrange(60)}"
        records.append({
            "revision": f"r{i % 75}", "digest": sha(text), "stored": rng.choice([text, text, text, text + "x", None]), "text": text,
            "claims": pick(lambda: (claim(), rng.choice(["reviewed", "candidate", None]))),  # noqa: B023
            "evidence": pick(lambda: (f"e{rng.randrange(99)}", claim(), *rng.choice([(0, 4, "text"), (0, 4, "Text"), (5, 99, "x"), (None, 3, "x"), (4, 4, ""), (0, 4, None)]))),  # noqa: B023
            "dependencies": pick(claim, 9), "pages": pick(lambda: (f"p{rng.randrange(99)}", *rng.choice([(sha("a"), "a"), (sha("a"), "b"), (sha("a"), None)]))),
            "contradictions": pick(lambda: (f"o{rng.randrange(40)}", claim(), rng.choice([claim(), "c999", None]))),  # noqa: B023
        })
    columns = [c for c in records[0]]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in records], audit.RECORD).repartition(3)
    got = Counter((r.fault, r.key) for r in audit.validate(df).collect())
    assert got == faults_of(records) and {f for f, _ in got} == set(audit.FAULTS)
    assert audit.validate(df.limit(0)).count() == 0


def test_validate_reads_documents_once(spark):
    plan = validate_record(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("text#" in line and "Relation" in line for line in plan.splitlines()) == 1 and plan.count("Relation") == 2


def test_running(spark):
    """Many cells, ties, null groups and sizes; a third of the rows in one group."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(300), rng.choice([None, 1, 5, 100]), "x") for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, size long, _x string").repartition(3)
    got = Counter(tuple(r) for r in audit.running(df, "g", "at", "size", 7).collect())
    assert got == Counter((*r, sum(x[2] or 0 for x in rows if x[0] == r[0] and x[1] <= r[1])) for r in rows)


def test_globs(spark):
    globs = ["**/*.md", "*.py", "a?c", "[ab]*", "[!ab]*", "[a-c]x", "[]x]", "[!]x]y", "[", "a[", "VERSION", "**/.env.*", "x+(y)|z", "a\\b", "[a\\]", "é*", "a.b"]
    paths = ["a.md", "d/e.md", "x.py", "d/x.py", "abc", "ac", "abd", "bx", "cx", "]", "xy", "[", "a[", "VERSION", "d/VERSION", ".env.local", "d/.env.x", "x+(y)|z", "a\\b", "é1", "a\nb", "a.b", "axb", "\\", "A.MD"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for g in globs:
        got = {r.p for r in df.filter(F.col("p").rlike(policy.pattern_of(g))).collect()}
        assert got == {p for p in paths if fnmatch.fnmatchcase(p, g)}, g


def walk(files, rules):
    """(id: verdict) file by file; duplicates are known beforehand, and only accepted files count."""
    norm = lambda p: "/".join(x for x in (p or "").strip().split("/") if x not in ("", "."))
    copies = Counter((f[1], norm(f[2])) for f in files)
    out, n, used = {}, Counter(), Counter()
    hit = lambda path, globs: any(fnmatch.fnmatchcase(x, g) for g in globs for x in (path, path.split("/")[-1])) or any(g.startswith("**/") and fnmatch.fnmatchcase(path, g[3:]) for g in globs)
    for i, host, path, size in sorted(files):
        raw, p = (path or "").strip(), norm(path)
        tests = [
            ("empty", not p), ("absolute", raw[:1] in ("/", "~")), ("traversal", ".." in raw.split("/")), ("glob", any(c in raw for c in "*?[]")), ("duplicate", copies[host, p] > 1), ("denied", hit(p, rules.denied)),
            ("credential name", p.lower().split("/")[-1] in policy.NAMES or any(x in p.lower() for x in policy.PARTS)), ("not allowed", bool(rules.allowed) and not hit(p, rules.allowed)),
        ]
        verdict = next((k for k, bad in tests if bad), None)
        if verdict is None:
            n[host] += 1
            used[host] += size or 0
            verdict = "too many files" if rules.max_files and n[host] > rules.max_files else "over budget" if rules.max_total_bytes and used[host] > rules.max_total_bytes else None
        out[i] = verdict
    return out


@pytest.mark.parametrize("rules", [policy.Policy(), policy.Policy(("**/*.key", "x*"), ("**/*.md", "*.txt"), 12, 0), policy.Policy(("*.env",), (), 0, 900)])
def test_policy(spark, rules):
    rng = random.Random(3)
    made = ["a.md", "d/b.md", "./d//b.md", "/etc/x", "~/x", "a/../b", "a*.md", "", "  ", None, "t.key", "d/t.key", "My_Token.md", "kubeconfig", "x.env", "n.txt"]
    files = [(i, rng.choice(["h", "h", "g", None]), rng.choice([*made, *[f"f{i}.md"] * 9, f"d/{i}.txt"]), rng.choice([None, 10, 70])) for i in range(200)]
    df = spark.createDataFrame(files, "id long, host string, path string, size long").repartition(3)
    got = {r.id: r.verdict for r in policy.judged(df, rules, "host", "id", cell=9).collect()}
    assert got == walk(files, rules)
