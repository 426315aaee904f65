"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

An encoding is right exactly if every two neighbours in it are compatible, that is, if merging their
joined symbols gives back the two. The encoder walks a word from the left, takes the longest token
that starts there (all matches come from one Aho-Corasick pass), checks it against the token before in
the pair table, falls back to shorter ones, and steps back where none fits; a place that failed once
is never tried again, so the work is linear in the word. Vocabularies whose last symbol of a word
carries an end mark are covered by writing the mark as one more character.

Defined cases: a null or empty text has no ids and decodes to an empty text; very long words take the
same path as short ones; repeated rows are encoded one by one; an empty table gives an empty table;
further columns are ignored. The vocabulary file is a parameter and must be at the same path on every
executor.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import text_or_empty

#: Stands for the end mark in token strings: no byte is written as a space.
END = " "
#: Bounds of what a worker keeps: words or chunks with their ids, and pairs; the bytes of texts that are looked up at once,
#: and the unknown words of one text for the library.
KEPT, KEPT_PAIRS, AT_ONCE, JOINED = 400_000, 1_000_000, 2 << 20, 200
NEVER = 1 << 60
#: Below this, characters have one spelling, fixed classes and a fixed lower case in every Unicode version.
STABLE = "ɐ"
#: Characters from there on, one whose lower case is two, and those that Arrow's split takes for spaces and the library doesn't.
UNSTABLE = re.compile(f"[{STABLE}-\U0010ffff\u0130\x1c-\x1f]")
# The classes of the word pattern in that range, as the inside of a character class.
STABLE_CLASSES = {r"[\p{L}]": r"[a-zª\xb5ºß-öø-ɏ]", r"[\p{N}]": "[0-9²³¹¼-¾]", r"\s\p{L}\p{N}": r"\t-\r\x20\x85\xa0a-zª\xb5ºß-öø-ɏ0-9²³¹¼-¾"}


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else the next unused one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Kept:
    """Strings with their ids: those of number i are ids[at[i] : at[i + 1]]."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def number(self, strings: list[str], encode) -> np.ndarray:
        """The number of each string; ``encode`` gives the ids of unknown ones, and how many ids each has."""
        if len(self.numbers) > KEPT:
            self.__init__()
        found = list(map(self.numbers.get, strings))
        if None in found:
            fresh = list(dict.fromkeys(s for s, n in zip(strings, found) if n is None))
            self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh))))
            ids, sizes = encode(fresh)
            self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            found = [self.numbers[s] if n is None else n for s, n in zip(strings, found)]
        return np.array(found, np.int64)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings one after the other, and where each string's ids end."""
        starts, sizes = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], ends


class BacktrackingBpe:
    """The encoder of one vocabulary file of the tokenizers library (word-splitting BPE)."""

    def __init__(self, path: str, by_library: bool = False):
        """by_library: chunks that aren't kept go to the library's model, for callers that only need the ids; of words with an end mark no merges are held."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores already
        self.by_library = by_library
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        suffix = model["end_of_word_suffix"] or ""
        own = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
        self.end = END if suffix else ""
        self.letters = byte_characters()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if added else None
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        for unicode_class, in_range in STABLE_CLASSES.items():
            split = split.replace(unicode_class, in_range)
        self.words = re.compile(split).findall
        #: Words, and the chunks between spaces.
        self.words_kept, self.chunks_kept = Kept(), Kept()
        self.last = {i for t, i in model["vocab"].items() if suffix and t.endswith(suffix)}
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[list(self.last)] = True
        if by_library and self.end:
            return  # the library has the merges
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in self.ids.items()}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        merges = [(self.ids[own(a)], self.ids[own(b)], self.ids[own(a) + own(b)]) for a, b in pairs]
        self.ranks = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts = {t: (a, b) for a, b, t in merges}
        if len(self.parts) < len(merges) or any(self.ranks.get(self.parts.get(x), -1) >= r for r, ab in enumerate(self.ranks) for x in ab):
            raise ValueError("each merge must make a new token of earlier ones")
        self.sizes = {i: len(t) for i, t in self.names.items()}
        self.trie = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.trie.add_word(token, i)
        self.trie.make_automaton()
        self.pair_table: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.whole: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        # The offset table: the text of id i is blob[at[i] : at[i + 1]].
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        parts = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.cumsum([0, *map(len, parts)])

    def _crossed(self, left: int, right: int) -> bool:
        """Whether a merge joins symbols of both tokens before both are complete.

        Merges run in order of rank, so the symbols at the border are followed up the right edge of
        ``left`` and the left edge of ``right``; of equal merges the leftmost goes first.
        """
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while i + 1 < len(a) or j + 1 < len(b):
            next_a = a[i + 1][1] if i + 1 < len(a) else NEVER
            next_b = b[j + 1][1] if j + 1 < len(b) else NEVER
            rank = self.ranks.get((a[i][0], b[j][0]), NEVER)
            if rank < next_a and rank <= next_b:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        return False

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while it is merged, and the rank that makes each."""
        if (known := self.edges[side].get(token)) is None:
            parts = self.parts.get(token)
            known = [*(self._edge(parts[side], side) if parts else []), (token, self.ranks[parts] if parts else -1)]
            self.edges[side][token] = known
        return known

    def _is_whole(self, token: int) -> bool:
        """Whether merging a token's own symbols gives that token; others never occur."""
        if (known := self.whole.get(token)) is None:
            parts = self.parts.get(token)
            known = self.whole[token] = not parts or self._is_whole(parts[0]) and self._is_whole(parts[1]) and not self._crossed(*parts)
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (known := self.shorter.get(token)) is None:
            name = self.names[token]
            known = self.shorter[token] = next((self.ids[p] for i in range(len(name) - 1, 0, -1) if (p := name[:i]) in self.ids), -1)
        return known

    def _check_pair(self, left: int, right: int) -> bool:
        """Fills the pair table; left is -1 at the start of a word."""
        if len(self.pair_table) >= KEPT_PAIRS:
            self.pair_table.clear()
        known = self._is_whole(right) and (left < 0 or left not in self.last and (left, right) not in self.ranks and not self._crossed(left, right))
        self.pair_table[left, right] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word that is written in byte characters."""
        word += self.end
        n, sizes, pairs = len(word), self.sizes, self.pair_table
        longest = [-1] * (n + 1)
        for end, token in self.trie.iter(word):
            longest[end + 1 - sizes[token]] = token  # later matches from the same start are longer
        out: list[int] = []
        last, at, token, dead = -1, 0, longest[0], bytearray(n + 1)
        while at < n:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    fits = pairs.get((last, token))
                    if self._check_pair(last, token) if fits is None else fits:
                        break
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                last, at = token, at + sizes[token]
                token = longest[at]
            elif out:
                dead[at] = 1
                token = out.pop()
                last, at = out[-1] if out else -1, at - sizes[token]
                token = self._next_shorter(token)
            else:
                raise ValueError("the vocabulary can't spell this word")
        return out

    def _encoded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, and how many each has."""
        if self.by_library and self.end:
            # Spaces bound words, and a word's last id alone has the end mark.
            texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
            ids = np.fromiter(chain.from_iterable(x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
            return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        letters, encode_word = self.letters, self.encode_word
        found = [encode_word("".join([letters[b] for b in w.encode()])) for w in words]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found])

    def _encoded_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks without spaces, and how many each has."""
        words = [self.words(c) for c in chunks]
        ids, ends = self.words_kept.joined(self.words_kept.number(list(chain.from_iterable(words)), self._encoded_words))
        return ids, np.diff(np.r_[0, ends][np.cumsum([len(w) for w in words])], prepend=0)

    def _mapped(self, text: str) -> list[int]:
        """The ids of a text of any characters, by the library's own normalizer and word split, whatever its Unicode version."""
        if self.by_library:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [i for w, _ in words for i in self.encode_word(w)]

    def _looked_up(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of plain characters: each distinct chunk between spaces is looked up once."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        chunks = split.flatten().dictionary_encode()
        numbers = self.chunks_kept.number(chunks.dictionary.to_pylist(), self._encoded_chunks)
        ids, ends = self.chunks_kept.joined(numbers[chunks.indices.to_numpy()])
        return np.split(ids, np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()][1:-1])

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        held: list[str] = []
        size = 0
        for text in texts:
            plain = UNSTABLE.search(text) is None and not any(x in text for x in self.special)
            if plain:
                held.append(text)
                size += len(text)
            if held and (size >= AT_ONCE or not plain):
                yield from self._looked_up(held)
                held, size = [], 0
            if not plain:
                yield self._whole(text)
        if held:
            yield from self._looked_up(held)

    def _whole(self, text: str) -> np.ndarray:
        parts = self.cut.split(text) if self.cut else [text]
        return np.array([i for x in parts for i in ([self.special[x]] if x in self.special else self._mapped(x))], np.uint32)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text])).astype("<u4").tobytes()

    def decode(self, packed: bytes) -> bytes:
        """The tokens' texts joined by spaces, in UTF-8, as the library does where the file names no decoder."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        sizes = self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(sizes + 1)
        out = np.full(ends[-1] - 1, 32, np.uint8)
        source = np.repeat(self.at[ids] - (ends - sizes - 1 - np.arange(len(ids))), sizes) + np.arange(sizes.sum())
        target = np.arange(sizes.sum()) + np.repeat(np.arange(len(ids)), sizes)
        # source counts bytes of the blob; without the joining spaces they run on from token to token.
        out[target] = self.blob[source]
        return out.tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, by_library: bool = False) -> BacktrackingBpe:
    """One encoder for each Python worker and file."""
    return BacktrackingBpe(path, by_library)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text_ids in bpe.encode_all(text.as_py() for text in batch.column(1)):
                packed = text_ids.astype("<u4").tobytes()
                counts.append(len(packed) // 4)
                ids.append(sha256(packed).hexdigest())
                decoded.append(sha256(bpe.decode(packed)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
