"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a pre-token has one BPE encoding, so one last token. A token that ends a
prefix is its last token exactly when it can stand beside the last token of what lies before
it, that is when no merge would reach across their border. An automaton over the
vocabulary gives the tokens that end at each byte, the longest first; the first that is
compatible is stored, and following the stored tokens back from the end gives the ids. The
work is linear in the length of a pre-token, whatever it holds.
"""

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import slices, text_or_empty, without

#: Pre-tokens that a task remembers, in each of two generations.
CACHED = 250_000
#: Scripts whose letters and digits are the same in all Unicode tables in use; other texts are split by the library.
SETTLED = regex.compile(r"[\x00-ԯ　-鿿가-힣]*")
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPLIT_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if any((model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"), spec["normalizer"])):
            raise ValueError("not a plain byte-level vocabulary")
        vocabulary = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocabulary.values(), *added.values()])
        self.bytes: list[bytes] = [b""] * self.size
        for word, i in vocabulary.items():
            self.bytes[i] = bytes(map(letters.__getitem__, word))
        for word, i in added.items():
            self.bytes[i] = word.encode()
        #: Token made by a pair, and for each token its parts and the place of its merge in the order of merges.
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, both = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if both in self.parts:
                raise ValueError("a token with two merges has no single history")
            self.made[left, right], self.parts[both], self.rank[both] = both, (left, right), rank
        self.length = [len(b) for b in self.bytes]
        self.single = {b: vocabulary[c] for c, b in letters.items()}
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.values():
            self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        # Added tokens are cut out of the text first, the leftmost and longest.
        self.added = added
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.beside: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # --- compatibility of neighbours

    def _edge(self, token: int, side: int) -> list[int]:
        """The pieces that stand at the right (1) or left (0) end while a token is built, from its byte to itself."""
        out = [token]
        while token in self.parts:
            token = self.parts[token][side]
            out.append(token)
        return out[::-1]

    def first_across(self, left: int, right: int) -> tuple[int, bool] | None:
        """The first merge across the border of two tokens as (token made, both were whole); none if they stay apart.

        Both tokens are built in the order of merges; at each moment the pieces at the border
        may merge if that merge comes before the next one of either side. Of equal merges the
        left one goes first.
        """
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        never = len(self.rank)
        while True:
            next_a = self.rank[a[i + 1]] if i + 1 < len(a) else never
            next_b = self.rank[b[j + 1]] if j + 1 < len(b) else never
            both = self.made.get((a[i], b[j]))
            if both is not None and self.rank[both] < next_a and self.rank[both] <= next_b:
                return both, next_a == never and next_b == never
            if next_a == never and next_b == never:
                return None
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """True if BPE keeps the two tokens apart."""
        key = left * self.size + right
        out = self.beside.get(key)
        if out is None:
            if len(self.beside) > 4 * CACHED:
                self.beside.clear()
            out = self.beside[key] = self.first_across(left, right) is None
        return out

    def stands(self, token: int) -> bool:
        """True if BPE makes this token out of its own bytes."""
        out = self.alone.get(token)
        if out is None:
            out = token not in self.parts
            if not out:
                a, b = self.parts[token]
                out = self.stands(a) and self.stands(b) and self.first_across(a, b) == (token, True)
            self.alone[token] = out
        return out

    # --- one pre-token

    def last_tokens(self, word: bytes) -> list[int]:
        """The last token of every prefix of a pre-token (place 0: none)."""
        last = [-1] * (len(word) + 1)
        length, size, beside = self.length, self.size, self.beside
        for end, token in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if not start:
                    if self.stands(token):
                        last[end] = token
                else:
                    before = last[start]
                    fits = beside.get(before * size + token)
                    if self.compatible(before, token) if fits is None else fits:
                        last[end] = token
        return last

    def ids_of(self, word: bytes) -> list[int]:
        last, at, out = self.last_tokens(word), len(word), []
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        return out[::-1]

    # --- whole texts

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text, as the library's."""
        if text.isascii():
            return SPLIT_ASCII.findall(text)
        if SETTLED.fullmatch(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _encode_plain(self, text: str) -> bytes:
        words, known = self.split(text), self.known
        for word in set(words).difference(known):
            ids = self.older.get(word)
            known[word] = np.array(self.ids_of(word.encode()), "<u4").tobytes() if ids is None else ids
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED:
            self.older, self.known = self.known, {}
        if self.cut is None or not self.cut.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, ids that nothing has are left out."""
        return b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist() if i < self.size]).decode("utf-8", "replace")


def _columns(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Add `ids`, `n_tokens` and `decoded` for the whole text of every row.

    `ids` are the tokenizers library's, without special tokens around the text, as
    little-endian unsigned 32-bit integers; added tokens that a text spells out keep theirs.
    `decoded` is the text of these ids. A null text counts as an empty one: no ids, the empty
    text. Rows are judged one by one, so null or repeated ids and repeated rows give a row
    each, and an empty table none. Other columns stay, but for those of the added names, in
    any case.
    """
    docs = without(docs, "ids", "n_tokens", "decoded")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixBpe(path)
        for part in slices(batches, "text_"):
            ids = [coder.encode(t) for t in part.column(len(names)).to_pylist()]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            decoded = pa.array([coder.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(ids, pa.binary()), counts, decoded], names=[*names, "ids", "n_tokens", "decoded"])

    return docs.withColumn("text_", text_or_empty()).mapInArrow(run, f"{_columns(docs)}ids binary, n_tokens long, decoded string")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Add `decoded`, the text of the binary `ids`; null ids give a null text."""
    rows = without(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PrefixBpe(path)
        for part in batches:
            ids = part.column(part.schema.get_field_index("ids")).to_pylist()
            texts = pa.array([None if i is None else coder.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{_columns(rows)}decoded string")
