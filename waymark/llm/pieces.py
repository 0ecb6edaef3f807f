"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A word's symbols start as characters; an agenda holds every adjacent pair that forms a
piece, best score first, then leftmost. A popped candidate is skipped when a keyed hash
of (seed, document, place of the word in the text, begin, middle, end) falls below the
dropout rate, so every occurrence of a word is cut on its own. The same seed and document
give the same ids again, on any executor. No word is remembered: texts are split and their
words cut in arrays, so the cost does not depend on how often words repeat.

Space is the mark of word starts. Characters outside the vocabulary become byte pieces,
so decoding gives back every text exactly. One space goes before each text and is taken
off by decoding.
"""

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame

from waymark.llm.common import U64, mix, slices, without

#: Words longer than this go through the heap, shorter ones through arrays, many at a time.
ARRAY_CHARS = 128
#: Places of characters and words that go through the arrays at once, so that these stay in the processor's cache.
BATCH_CHARS = 1 << 15
BATCH_WORDS = 1 << 12
#: Bits of a place in a word, below the rank in a candidate's number.
PLACE = 8
NONE = np.int32(2**31 - 1)


class Pieces:
    """Vocabulary and merges of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.size = n
        self.byte_id = [-1] * 256
        self.texts: list[bytes] = [b""] * n
        scores = np.zeros(n)
        ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.texts[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece.replace("▁", " ")] = i
                self.texts[i] = piece.replace("▁", " ").encode()
                scores[i] = sp.get_score(i)
        if min(self.byte_id) < 0:
            raise ValueError("the model has no byte pieces")
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.chars = {ord(t): i for t, i in ids.items() if len(t) == 1}
        merges = {}
        for text, i in ids.items():
            for k in range(1, len(text)):
                if (a := ids.get(text[:k])) is not None and (b := ids.get(text[k:])) is not None:
                    merges[a * n + b] = i
        self.keys = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.keys], np.int32)
        self.row, self.slots = displaced(self.keys, self.merged, n)
        if any(re.search(r"[^ ] ", t) for t in ids):
            raise ValueError("pieces run across word starts")
        #: No merge happens between words: no piece runs on into a space, a line's end or, after other characters, these marks.
        self.line = not any("\n" in t and len(t) > 1 for t in ids)
        self.marks = np.zeros(128, bool)
        marks = r"!-@\[-`{-~"
        if not any(re.search(rf"[^ {marks}][{marks}]", t) for t in ids):
            self.marks[[i for i in range(128) if re.match(f"[{marks}]", chr(i))]] = True

    def word_starts(self, points: np.ndarray) -> np.ndarray:
        """Whether a word starts at each code point: spaces, then marks, then others; a line's end is a word of its own."""
        space, line = points == 32, (points == 10) & self.line
        after_line = np.r_[True, line[:-1]]
        out = line | after_line | (space & ~np.r_[False, space[:-1]])
        if self.marks.any():
            mark = self.marks[np.minimum(points, 127)] & (points < 128)
            out |= mark & ~np.r_[False, (mark | space)[:-1]]
        return out

    @property
    def of_char(self) -> np.ndarray:
        """Piece of each code point, or -1; built where it is used."""
        if "_of_char" not in self.__dict__:
            self._of_char = np.full(0x110000, -1, np.int32)
            self._of_char[list(self.chars)] = list(self.chars.values())
        return self._of_char

    @property
    def pairs(self) -> dict[int, int]:
        """Piece of each pair that forms one; built where it is used."""
        if "_pairs" not in self.__dict__:
            self._pairs = dict(zip(self.keys.tolist(), self.merged.tolist()))
        return self._pairs

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_of_char", "_pairs")}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols forms, or -1; `size` and `size + 1` stand for symbols that form none."""
        got = self.slots[self.row[left] + right]
        return np.where(got >> 32 == left, got & 0xFFFFFFFF, -1)

    def bytes_of(self, symbol: int) -> list[int]:
        """Ids of a symbol; unknown characters are held as -1 - code point."""
        return [symbol] if symbol >= 0 else [self.byte_id[b] for b in chr(-1 - symbol).encode()]

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        return b"".join(map(self.texts.__getitem__, ids)).decode(errors="replace")[1:]


def displaced(keys: np.ndarray, merged: np.ndarray, size: int, window: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The pairs as one table: the pair (a, b) lies at row[a] + b, as a << 32 | piece; rows lie over each other's gaps."""
    row, used = np.zeros(size + 2, np.int64), np.zeros(2 * (len(keys) + size) + window, bool)
    lefts, first, counts = np.unique(keys // size, return_index=True, return_counts=True)
    rights = keys % size
    at = 0
    for k in np.argsort(-counts, kind="stable").tolist():
        mine = rights[first[k] : first[k] + counts[k]]
        while True:
            if at + window + size > len(used):
                used = np.r_[used, np.zeros(len(used), bool)]
            taken = used[np.arange(at, at + window)[:, None] + mine].any(axis=1)
            if not taken.all():
                break
            at += window
        at += int(taken.argmin())
        row[lefts[k]] = at
        used[at + mine] = True
    slots = np.full(at + size + 2, -1, np.int64)
    slots[row[keys // size] + rights] = keys // size << 32 | merged
    return row, slots


FACTORS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def below(drop: float) -> int:
    """Hashes of 53 bits less than this are skipped."""
    return math.ceil(min(max(drop, 0.0), 1.0) * 2**53)


def skipped(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, drop: float) -> np.ndarray:
    """Whether the keyed hash skips these candidates."""
    with np.errstate(over="ignore"):
        x = key + begin * U64(FACTORS[0]) + middle * U64(FACTORS[1]) + end * U64(FACTORS[2])
    return (mix(x) >> U64(11)) < U64(below(drop))


def skipped_one(key: int, begin: int, middle: int, end: int, drop: float) -> bool:
    """`skipped` for a single candidate."""
    x = (key + begin * FACTORS[0] + middle * FACTORS[1] + end * FACTORS[2]) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return (x ^ (x >> 31)) >> 11 < below(drop)


def place_keys(first: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit key for each word, by the key of its document and its place among the words there (from 0)."""
    with np.errstate(over="ignore"):
        return mix(first + (place.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))


def document_keys(seed: int, documents: list[int]) -> np.ndarray:
    return mix(np.array([(seed * 0x9E3779B1 + d * 0x85EBCA77C2B2AE63) & (2**64 - 1) for d in documents], U64))


def word_keys(words: list[str], seed: int, document: int) -> np.ndarray:
    """A 64-bit key for each word of a document, by its place among them."""
    return place_keys(document_keys(seed, [document]), np.arange(len(words)))


def with_heap(pieces: Pieces, word: str, key: int, drop: float) -> list[int]:
    """One word through the agenda."""
    sym = [s if (s := int(pieces.of_char[ord(c)])) >= 0 else -1 - ord(c) for c in word]
    n = len(sym)
    after, before, end = [*range(1, n), -1], [-1, *range(n - 1)], list(range(1, n + 1))
    agenda: list[tuple] = []
    known = pieces.pairs

    def offer(a: int) -> None:
        b = after[a] if a >= 0 else -1
        if b < 0 or sym[a] < 0 or sym[b] < 0:
            return
        new = known.get(sym[a] * pieces.size + sym[b], -1)
        if new >= 0:
            heapq.heappush(agenda, (int(pieces.rank[new]), a, b, end[b], sym[a], sym[b], new))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, a, b, stop, left, right, new = heapq.heappop(agenda)
        if after[a] != b or sym[a] != left or sym[b] != right or end[b] != stop:
            continue
        if drop and skipped_one(key, a, b, stop, drop):
            continue
        sym[a], end[a], after[a] = new, stop, after[b]
        after[b] = -2
        if after[a] >= 0:
            before[after[a]] = a
        offer(before[a])
        offer(a)
    out, i = [], 0
    while 0 <= i < n:
        out += pieces.bytes_of(sym[i])
        i = after[i]
    return out


def with_arrays(pieces: Pieces, words: list[str], keys: np.ndarray, drop: float) -> list[bytes]:
    """Many words at once."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    ids, counts = cut_words(pieces, points, np.cumsum(lens) - lens, lens, keys, drop)
    return blobs_of(ids, counts)


def blobs_of(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    blob = ids.astype("<u4").tobytes()
    ends = (np.cumsum(counts) * 4).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


def cut_words(
    pieces: Pieces, points: np.ndarray, begins: np.ndarray, lens: np.ndarray, keys: np.ndarray, drop: float, batch: int = BATCH_WORDS
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words that begin at these places of `points`, in their order, and each word's number of ids.

    Words of about equal length are cut together; the longest go through the heap.
    """
    counts = np.zeros(len(lens), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(np.minimum(lens, ARRAY_CHARS + 1).astype(np.uint8), kind="stable")
    short = int((lens <= ARRAY_CHARS).sum())
    sym = np.r_[pieces.of_char[points], np.full(ARRAY_CHARS, -1, np.int32)]
    a = 0
    while a < short:
        b = min(a + min(batch, max(1, BATCH_CHARS // max(1, int(lens[order[a]])))), short)
        while b - a > 1 and int(lens[order[b - 1]]) * (b - a) > 2 * BATCH_CHARS:
            b = (a + b) // 2
        which = order[a:b]
        parts.append((which, cut_block(pieces, sym, points, begins[which], lens[which], keys[which], drop, which, counts)))
        a = b
    for w in order[short:].tolist():
        word = points[begins[w] : begins[w] + lens[w]].astype("<u4").tobytes().decode("utf-32-le")
        ids = np.array(with_heap(pieces, word, int(keys[w]), drop), np.int32)
        counts[w] = len(ids)
        parts.append((np.array([w]), ids))
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for which, ids in parts:
        n = counts[which]
        out[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, counts


def cut_block(pieces: Pieces, sym_of: np.ndarray, points: np.ndarray, begins, lens, keys, drop: float, which, counts: np.ndarray) -> np.ndarray:
    """Ids of some words, one column each; each round takes the best candidate left in every word.

    A row is a place in the word; a symbol stands at its first place. The row past the last one takes the links that lead out of a word.
    """
    n, size = len(lens), max(1, int(lens.max()))
    unknown, outside = pieces.size, pieces.size + 1
    places = np.arange(size + 1)
    sym = sym_of[begins + places[:, None]].astype(np.int64)
    sym[sym < 0] = unknown
    sym[places[:, None] >= lens] = outside
    after = np.repeat(np.minimum(places + 1, size), n)
    before = np.repeat(np.where(places, places - 1, size), n)
    new = np.full((size + 1, n), -1, np.int64)
    number = np.full((size + 1, n), NONE, np.int32)
    if size > 1:
        got = pieces.pair(sym[:-2], sym[1:-1])
        on = got >= 0
        if drop:
            at = places[: size - 1, None].astype(U64)
            on &= ~skipped(keys, at, at + U64(1), at + U64(2), drop)
        new[:-2] = got
        number[:-2] = np.where(on, pieces.rank[got] << PLACE | places[: size - 1, None], NONE)
    sym, new, flat = sym.ravel(), new.ravel(), number.ravel()
    while True:
        best = number[:-1].min(axis=0)
        act = np.flatnonzero(best != NONE)
        if not act.size:
            break
        m = len(act)
        i_at = (best[act] & ((1 << PLACE) - 1)).astype(np.int64)
        i = i_at * n + act
        j = after[i] * n + act
        k_at = after[j]
        k = k_at * n + act
        h_at = before[i]
        h = h_at * n + act
        made = new[i]
        sym[i], sym[j], flat[j] = made, -1, NONE
        after[i], before[k] = k_at, i_at
        # Its pairs with the symbols before and after it.
        left, right = np.concatenate((sym[h], made)), np.concatenate((made, sym[k]))
        cell, begin = np.concatenate((h, i)), np.concatenate((h_at, i_at))
        flat[cell] = NONE
        got = pieces.pair(left, right)
        on = np.flatnonzero(got >= 0)
        if drop and on.size:
            middle, end = np.concatenate((i_at, k_at))[on], np.concatenate((k_at, after[k]))[on]
            key = keys[act[np.where(on < m, on, on - m)]]
            on = on[~skipped(key, begin[on].astype(U64), middle.astype(U64), end.astype(U64), drop)]
        cell, got = cell[on], got[on]
        new[cell] = got
        flat[cell] = pieces.rank[got] << PLACE | begin[on]
    rows = np.ascontiguousarray(sym.reshape(size + 1, n)[:-1].T).ravel()
    on = np.flatnonzero((rows >= 0) & (rows != outside))
    ids, wid = rows[on], on // size
    if (odd := ids == unknown).any():
        wide = [pieces.bytes_of(-1 - c) for c in points[begins[wid[odd]] + on[odd] % size].tolist()]
        times = np.ones(ids.size, np.int64)
        times[odd] = [len(x) for x in wide]
        odd, wid, ids = (np.repeat(x, times) for x in (odd, wid, ids))
        ids[odd] = [x for of in wide for x in of]
    counts[which] = np.bincount(wid, minlength=n)
    return ids


class Encoder:
    """Encodes texts; `batch` is the most words that go through the arrays at once."""

    def __init__(self, pieces: Pieces, drop: float, seed: int, batch: int = BATCH_WORDS):
        self.pieces, self.drop, self.seed, self.batch = pieces, drop, seed, batch

    def document(self, key) -> int:
        return xxhash.xxh3_64_intdigest(repr(key).encode(), seed=self.seed & (2**64 - 1))

    def encode(self, keys: list, texts: list[str | None]) -> list[bytes | None]:
        ids, counts = self.arrays(keys, texts)
        return [None if t is None else b for t, b in zip(texts, blobs_of(ids, counts))]

    def arrays(self, keys: list, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of ids; a null or empty one has none."""
        full = np.array([bool(t) for t in texts], bool)
        counts = np.zeros(len(texts), np.int64)
        if not full.any():
            return np.empty(0, np.int32), counts
        points = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), "<u4").view("<i4")
        sizes = np.fromiter((len(t) + 1 for t in texts if t), np.int64)
        starts = self.pieces.word_starts(points)
        starts[np.cumsum(sizes) - sizes] = True
        begins = np.flatnonzero(starts)
        lens = np.diff(np.r_[begins, len(points)])
        first = np.searchsorted(begins, np.cumsum(sizes) - sizes)
        n_words = np.diff(np.r_[first, len(begins)])
        mine = document_keys(self.seed, [self.document(k) for k, t in zip(keys, texts) if t])
        marks = place_keys(np.repeat(mine, n_words), np.arange(len(begins)) - np.repeat(first, n_words))
        ids, each = cut_words(self.pieces, points, begins, lens, marks, self.drop, self.batch)
        counts[full] = np.add.reduceat(each, first)
        return ids, counts


def decoded_lists(pieces: Pieces, table: pa.Array, lists: pa.ListArray) -> pa.Array:
    """`Pieces.decode` of many lists at once; `table` holds the pieces' texts."""
    spelt = pa.ListArray.from_arrays(lists.offsets, table.take(lists.values), mask=lists.is_null())
    joined = pa.compute.binary_join(spelt, b"")
    try:
        return pa.compute.binary_replace_slice(joined, 0, 1, b"").cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([pieces.decode(x) for x in lists.to_pylist()], pa.string())


def encode(docs: DataFrame, model_file: str, drop: float = 0.1, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds `piece_ids` (array<int>), `n_pieces` and `decoded` to each row of `docs`.

    A null text has null ids, no count and a null decoded text; an empty one has no ids.
    A null key is a key like any other. Repeated rows get equal answers. Columns of these
    names in the input are replaced. Merges are skipped by a hash of (seed, key, place of the
    word in the text, place in the word); no shuffle takes place.
    """
    base = without(docs, "piece_ids", "n_pieces", "decoded")
    pieces = Pieces(model_file)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema.fields)}, piece_ids array<int>, n_pieces int, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, drop, seed)
        table = pa.array(pieces.texts, pa.binary())
        for part in slices(batches, text):
            at = part.schema.get_field_index
            texts = part.column(at(text))
            none = np.asarray(texts.is_null())
            ids, counts = encoder.arrays(part.column(at(key)).to_pylist(), texts.to_pylist())
            ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, lists, pa.array(counts.astype(np.int32), mask=none), decoded_lists(pieces, table, lists)],
                names=[*part.schema.names, "piece_ids", "n_pieces", "decoded"],
            )

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, ids: str = "piece_ids") -> DataFrame:
    """Adds `decoded` (null where the ids are null) to rows that hold piece ids."""
    base = without(encoded, "decoded")
    pieces = Pieces(model_file)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema.fields)}, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = [pieces.decode(x) for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, "decoded"])

    return base.mapInArrow(run, schema)
