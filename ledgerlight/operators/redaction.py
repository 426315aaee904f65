"""Masking of credentials and personal data, and the check of what is left.

Both follow one table of steps: what a step looks for, which matches it spares, what it puts in their place,
and the name under which an unspared match counts as left over. The order of the steps matters. Masks
depend on the match, so texts pass through Arrow once; a search in the JVM keeps those away that hold
nothing a step could find. Identity terms are parameters and never read from the host.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import detection as D

# Tags of injected blocks, words of secret keys, schemes before a credential, masks and labels.
TAGS = (
    "manually_attached_skills", "system[-_]reminder", "environment_context", "INSTRUCTIONS", "available_subagent_types",
    "available_subagent_models", "dynamic_tools", "dynamic_tool_namespaces", "command-[a-z]+", "local-command-[a-z]+",
)
KEY_WORDS = ("key", "token", "secret", "pass", "password", "passwd", "pwd", "credential", "auth")
SCHEMES = ("bearer", "basic", "token", "digest", "negotiate")
PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?(?:-----END [A-Z0-9 ]*PRIVATE KEY-----|\Z)"
USER_FOLDER = r"(?<![A-Za-z])(?P<before>[A-Z]:[\\/]+Users[\\/]+|/home/|/Users/)[^\\/\s\"'`<]+"
RANDOM_LENGTH, RANDOM_ALPHABET = 32, "[0-9a-f]+"

# Name, sign and value are searched one after the other: one pattern for all would look for the closing mark anew from every name
# of a long line, which a test of four such lines forbids.
#: A name that holds a key word, up to its colon or equals sign and the blanks behind; the length of names is bounded.
NAME = re.compile(rf"(?<![\w.-])(?:export\s+)?\\?[\"']?[\w.-]{{0,60}}(?:{'|'.join(KEY_WORDS)})[\w.-]{{0,60}}\\?[\"']?[ \t]*[:=][ \t]*", re.I)
#: What may stand between an opening mark and the same closing one.
QUOTED = {'\\"': re.compile(r'(?:[^"\\\n]|\\[^"\n])*'), '"': re.compile(r'(?:[^"\\\n]|\\.)*'), "'": re.compile(r"[^'\n]*")}
LINE = re.compile(r"[^\n]+")
ONLY_MASKS = re.compile(r"(?:\[REDACTED:[^\]\n]*\][\s,;]*)+")


def assignments(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, mark around it) of the value of each assignment to a name that holds a key word."""
    at = 0
    while (name := NAME.search(text, at)) is not None:
        at = name.end()
        for mark, inside in QUOTED.items():
            if text.startswith(mark, name.end()):
                end = inside.match(text, name.end() + len(mark)).end()
                if text.startswith(mark, end):
                    yield name.end() + len(mark), end, mark
                    at = end + len(mark)
                    break
        else:
            # To the end of the line; where only blanks follow the sign, the last one is the value.
            start = name.end() - (text[name.end() - 1] in " \t" and text[name.end() : name.end() + 1] in ("", "\n"))
            if (rest := LINE.match(text, start)) is not None:
                yield start, rest.end(), ""
                at = rest.end()


def looks_random(token: str) -> bool:
    token = token.strip("=")
    kinds = [any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token)]
    if len(token) < RANDOM_LENGTH or not all(kinds) or re.fullmatch(RANDOM_ALPHABET, token):
        return False
    counts = Counter(token).values()
    return math.log2(len(token)) - sum(n * math.log2(n) for n in counts) / len(token) >= D.LOWEST_ENTROPY


@dataclass(frozen=True)
class Step:
    """A search for (start, end) places, the text put there, and the name of what is left if it is found again."""

    find: Callable[[str], Iterator[tuple[int, int, str]]]
    left: str | None = None

    def mask(self, text: str) -> str:
        out, at = [], 0
        for start, end, new in self.find(text):
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]) if out else text


def by_pattern(pattern: str, new: str, spare: Callable[[re.Match], bool] = lambda m: False, group: int | str = 0, flags: int = 0) -> Callable:
    """Places of a group of all matches that aren't spared; ``new`` may name groups of the match."""
    compiled = re.compile(pattern, flags)

    def find(text: str) -> Iterator[tuple[int, int, str]]:
        for m in compiled.finditer(text):
            if not spare(m):
                yield m.start(group), m.end(group), new.format(**m.groupdict())

    return find


def _credentials() -> Iterator[Step]:
    placeholder = re.compile(D.PLACEHOLDER).search
    for label, pattern in D.TOKENS.items():
        yield Step(by_pattern(pattern, f"[REDACTED:{label}]", lambda m: bool(placeholder(m[0].strip()))), label)
    label = "Suspicious assignment"
    yield Step(by_pattern(D.ASSIGNMENT, f"[REDACTED:{label}]", lambda m: bool(placeholder(m[1].strip())), 1), label)


def _values(text: str) -> Iterator[tuple[int, int, str]]:
    return ((a, b, "[REDACTED:assignment]") for a, b, _ in assignments(text) if not ONLY_MASKS.fullmatch(text[a:b].strip()))


def _ways(home: str) -> set[str]:
    """How a home folder may be written."""
    return {home, home.replace("\\", "/"), home.replace("\\", "\\\\")} - {""}


def _folders(home: str) -> Iterator[Step]:
    yield from (Step(by_pattern(re.escape(x), "<USER_HOME>", flags=re.I)) for x in sorted(_ways(home), key=len, reverse=True))
    yield Step(by_pattern(USER_FOLDER, "{before}<USER>", flags=re.I))


def _terms(terms: tuple[str, ...]) -> Iterator[Step]:
    """Terms of five characters or more count anywhere, shorter ones as words."""
    for term in sorted(terms, key=len, reverse=True):
        edges = ("", "") if len(term) >= 5 else ("(?<![A-Za-z0-9])", "(?![A-Za-z0-9])")
        yield Step(by_pattern(re.escape(term).join(edges), "<USER>", flags=re.I), "local identity term")


def _random(text: str) -> Iterator[tuple[int, int, str]]:
    return ((m.start(), m.end(), "[REDACTED:high-entropy]") for m in re.finditer(D.CANDIDATE, text) if looks_random(m[0]))


def steps(terms: tuple[str, ...] = (), home: str = "") -> list[Step]:
    masked = lambda m: m["value"].startswith("[REDACTED")
    return [
        Step(by_pattern(rf"<(?P<tag>{'|'.join(TAGS)})\b[^>]*>.*?(?:</(?P=tag)\s*>|\Z)", "[REDACTED:{tag} block]", flags=re.I | re.S)),
        Step(by_pattern(PRIVATE_KEY, "[REDACTED:private key block]", flags=re.S), "Private key block"),
        *_credentials(),
        Step(by_pattern(rf"\b(?:{'|'.join(SCHEMES)})[ \t]+[\"']?(?P<value>[A-Za-z0-9._~+/=-]{{6,}})", "[REDACTED:credential]", masked, "value", re.I), "credential after an auth scheme"),
        Step(_values, "unmasked secret assignment"),
        *_folders(home),
        Step(by_pattern(r"(?<![A-Za-z0-9._%+-])" + D.EMAIL, "<EMAIL>")),
        *_terms(terms),
        Step(by_pattern(D.PRIVATE_IP, "<PRIVATE_IP>")),
        Step(_random, "high-entropy token(s)"),
    ]


def redact_text(text: str, terms: tuple[str, ...] = (), home: str = "") -> str:
    for step in steps(terms, home):
        text = step.mask(text)
    return text


def residual_of(text: str, terms: tuple[str, ...] = ()) -> list[str]:
    """What is still risky in a redacted text: known shapes by name, then the other checks."""
    found = Counter()
    for step in steps(terms):
        if step.left:
            found[step.left] += sum(1 for _ in step.find(text))
    shapes = sorted(k for k in found if found[k] and (k in D.TOKENS or k == "Suspicious assignment"))
    others = ("local identity term", "Private key block", "credential after an auth scheme", "unmasked secret assignment")
    n = found["high-entropy token(s)"]
    return list(dict.fromkeys([*shapes, *(k for k in others if found[k])])) + ([f"{n} high-entropy token(s)"] if n else [])


#: In small letters, what every match of a step but the random runs has somewhere.
PIECES = (
    "key", "token", "secret", "pass", "pwd", "credential", "auth", "bearer", "basic", "digest", "negotiate", "manually_attached_skills", "reminder", "environment_context", "instructions",
    "available_subagent", "dynamic_tool", "command-", "users", "/home/", "://", "@", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "aiza", "eyj", "10.", "127.", "192.168", "172.",
)
#: Characters that a search without case takes for i, s or k, though they have other small letters.
ODD_CASE = "[\u0130\u0131\u017f\u212a]"


def may_hold(text: Column, terms: tuple[str, ...] = (), home: str = "") -> Column:
    """Whether a step could find anything. Plain pieces are looked for in small letters; only runs of characters take a pattern."""
    pieces = [*PIECES, *(t.lower() for t in (*terms, *_ways(home)) if t)]
    low = lambda x: T.any_of([F.contains(x, F.lit(p)) for p in pieces])
    # An array of one binds the small letters, so that they are made once.
    plain = F.get(F.transform(F.array(F.lower(text)), low), F.lit(0))
    return plain | text.rlike(ODD_CASE) | text.rlike(D.CANDIDATE)


def _masking(terms: tuple[str, ...], home: str):
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        table = steps(terms, home)

        def one(text: str) -> str:
            for step in table:
                text = step.mask(text)
            return text

        return texts.map(one, na_action="ignore")

    return masked


def _checking(terms: tuple[str, ...]):
    @F.pandas_udf("string")
    def left(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "; ".join(residual_of(t, terms)), na_action="ignore")

    return left


def redacted(text: Column, terms: tuple[str, ...] = (), home: str = "") -> Column:
    """The masked text; a null text stays null."""
    return F.coalesce(_masking(terms, home)(F.when(may_hold(text, terms, home), text)), text)


def residual(text: Column, terms: tuple[str, ...] = ()) -> Column:
    """What is left in a text, joined by ``; ``; a null text stays null."""
    return F.coalesce(_checking(terms)(F.when(may_hold(text, terms), text)), F.when(text.isNotNull(), ""))


def redact(rows: DataFrame, key: str, text: str = "text", terms: tuple[str, ...] = (), home: str = "") -> DataFrame:
    """key, redacted and residual of every row."""
    out = rows.select(F.col(key), redacted(F.col(text), terms, home).alias("redacted"))
    return out.select(key, "redacted", residual(F.col("redacted"), terms).alias("residual"))
