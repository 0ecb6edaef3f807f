"""Token ids in files: one zstandard frame per document, with a shared dictionary.

A shard file holds documents in ascending order of id:

    magic "WIDS0001" | sha256 of the dictionary (32 bytes) | frames | index | n (u64) | index offset (u64)

The index has, for each document, its row in the manifest's order, the offset of its frame
(u64), the frame's length (u32) and its number of ids (u32). Frames hold the ids as
little-endian unsigned 32-bit integers. The dictionary lies beside the shards under its
hash. Any document can be read with its own offset, without its neighbours.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, slices, text_or_empty

MAGIC = b"WIDS0001"
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u4")])
#: Runs of letters or marks that a task remembers, in each of two generations.
CACHED = 250_000
#: str.split() parts words at these, the tokenizer does not; all other white space is the same.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
WORD = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def words_of(text: str) -> list[str]:
    """Words between the tokenizer's white space."""
    return WORD.findall(text) if any(c in text for c in NOT_SPACE) else text.split()


class WordCache(dict):
    """Ids of each white-space separated word of some texts.

    The tokenizer's pre-tokens never cross its white space, so a text's ids are those of its
    words. Words of plain letters and marks are pre-tokens side by side, runs of either;
    these are asked for many at a time, in one text, where the mark of word ends parts them.
    Stretches of such words are parted into runs all at once.
    """

    #: Words whose pre-tokens are their runs of letters and of marks; no digits, apostrophes or composing characters.
    PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]+")
    TEXT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~ \t\n\x0b\x0c\r]*")
    #: Other words, from their first character on.
    ODD = re.compile(
        r"((?<![^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]*+"
        r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+)"
    )
    RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")

    #: Of the bytes of such texts: white space 0, letters 1 (all above ASCII are parts of such), marks 2; and their lower case.
    KIND = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if b > 127 or chr(b).isalpha() else 2 for b in range(256)], np.uint8)
    LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> None:
        for a in range(0, len(words), 2_000):  # an encoding takes a kilobyte and more
            part = words[a : a + 2_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self[w] = np.array(e.ids, "<u4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        for a in range(0, len(runs), 20_000):
            part = runs[a : a + 20_000]
            (e,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):
                raise ValueError("the tokenizer does not mark the end of each pre-token")
            blob = ids.tobytes()
            self.runs.update((w, blob[i:j]) for w, i, j in zip(part, [0, *stops.tolist()], stops.tolist()))

    def _know(self, runs: set[str]) -> None:
        runs = runs.difference(self.runs)
        self.runs.update((r, self.older[r]) for r in runs & self.older.keys())
        self._learn_runs(list(runs.difference(self.older)))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that `TEXT` matches: all runs at once, each distinct one looked up once."""
        coded = [t.encode() for t in texts]
        data = b" ".join(coded).translate(self.LOWER)
        raw = np.frombuffer(data, np.uint8)
        kind = self.KIND[raw]
        starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if data else np.empty(0, np.int64)
        inked = kind[starts] > 0
        sizes = np.diff(np.r_[starts, len(data)])[inked]
        starts = starts[inked]
        buffers = [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(raw[kind > 0].tobytes())]
        runs = pa.Array.from_buffers(pa.large_utf8(), len(starts), buffers).dictionary_encode()
        distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._know(set(distinct))
        ids = pa.array([self.runs[r] for r in distinct], pa.large_binary()).take(runs.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(starts) + 1] if len(starts) else np.zeros(1, np.int64)
        blob = ids.buffers()[2].to_pybytes() if len(starts) else b""
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        begin = np.cumsum(lengths + 1) - lengths - 1
        edges = (ends[np.searchsorted(starts, x)] for x in (begin, begin + lengths))
        return [blob[a:b] for a, b in zip(*(e.tolist() for e in edges))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.runs) > CACHED:
            self.older, self.runs = self.runs, {}
        self.clear()  # runs repeat more than words, so these are kept
        # Texts are plain ones and words that are not in turn; where a space or a special token keeps them from that, words.
        known = [not any(x in t for x in self.special) for t in texts]
        parted = [([t] if self.TEXT.fullmatch(t) else self.ODD.split(t)) if k else [] for t, k in zip(texts, known)]
        parted = [x if all(map(self.TEXT.fullmatch, x[::2])) else [] for x in parted]
        done = iter(self._plain([t for x in parted for t in x[::2]]))
        split = [[] if x else words_of(t) for t, x in zip(texts, parted)]
        words = set().union(*split, *(x[1::2] for x in parted))
        parts = {w: self.RUN.findall(w.lower()) for w in words if self.PLAIN.fullmatch(w) and not any(x in w for x in self.special)}
        self._know(set().union(*parts.values()))
        self._whole(list(words.difference(parts)))
        self.update((w, b"".join(map(self.runs.__getitem__, rs))) for w, rs in parts.items())
        return [b"".join([self[w] if k % 2 else next(done) for k, w in enumerate(x)] if x else map(self.__getitem__, ws)) for x, ws in zip(parted, split)]


def train_dictionary(docs: DataFrame, tokenizer: str, max_docs: int = 2_000, max_bytes: int = 64 << 10) -> bytes:
    """A dictionary from the serialized ids of `max_docs` documents of up to 64 KiB, those with the smallest hash of the id.

    It serves short documents, so it is trained on such. Only the sample's ids reach the
    driver. Too few ids for a trained dictionary give an empty one; frames are then plain.
    """
    import zstandard

    short = docs.where(F.octet_length("text") <= 64 << 10)
    # The sample is chosen by ids alone, then its texts are fetched: at most `max_docs` rows are broadcast.
    chosen = short.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(max_docs).select("doc_id").distinct()
    sample = short.join(F.broadcast(chosen), "doc_id").select("doc_id", text_or_empty().alias("text")).limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cache.encode(part.column(1).to_pylist()), pa.binary())], names=["ids"])

    rows = sorted(bytes(r["ids"]) for r in sample.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(max_bytes, [r for r in rows if r]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _put(folder: str, name: str, content: bytes) -> None:
    """Write under another name, then rename: a retried task leaves no half file."""
    import uuid

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, f"{root}/{name}")


def _get(folder: str, name: str) -> bytes:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        return f.read()


def _uri(path: str) -> str:
    return path if "://" in path else "file:" + path if path.startswith("//") else f"file://{path.removeprefix('file:')}"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write the ids of every whole text below `folder`; gives the manifest, one row per file.

    (shard, name, n_docs, n_ids, dictionary). Documents are dealt by ranges of doc_id, about
    `shard_bytes` of text to a file; a null text is empty, and `end_id` ends every document.
    Rows without a doc_id come first; rows that repeat one stand side by side in any order.
    An empty table gives an empty manifest.
    """
    folder = _uri(folder)
    dictionary = train_dictionary(docs, tokenizer)
    mark = hashlib.sha256(dictionary).digest()
    _put(folder, f"{mark.hex()}.dict", dictionary)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id").sortWithinPartitions("doc_id")
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, pack = WordCache(tokenizer), _compressor(dictionary)
        frames, index, offset, total = [MAGIC, mark], [], len(MAGIC) + len(mark), 0
        for part in slices(batches):
            for doc, ids in zip(part.column(0).to_pylist(), cache.encode(part.column(1).to_pylist())):
                frame = pack.compress(ids + last)
                n = len(ids) // 4 + 1
                index.append((doc or 0, doc is not None, offset, len(frame), n))
                frames.append(frame)
                offset, total = offset + len(frame), total + n
        if not index:
            return
        shard = TaskContext.get().partitionId()
        name = f"{shard:08d}.ids"
        _put(folder, name, b"".join([*frames, np.array(index, ENTRY).tobytes(), np.array([len(index), offset], "<u8").tobytes()]))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "n_docs": len(index), "n_ids": total, "dictionary": mark.hex()}], SCHEMA)

    return Scratch(docs.sparkSession, "manifest").write(rows.mapInArrow(run, "shard int, name string, n_docs long, n_ids long, dictionary string"))


SCHEMA = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("dictionary", pa.string())])


def open_shard(blob: bytes, dictionary: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a shard file."""
    if blob[: len(MAGIC)] != MAGIC or blob[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")
    n, at = np.frombuffer(blob[-16:], "<u8").tolist()
    unpack = _decompressor(dictionary)
    for doc, known, offset, length, n_ids in np.frombuffer(blob, ENTRY, n, at).tolist():
        ids = np.frombuffer(unpack.decompress(blob[offset : offset + length]), "<u4")
        if len(ids) != n_ids:
            raise ValueError("frame and index differ")
        yield (doc if known else None), ids


def read_document(folder: str, name: str, place: int) -> np.ndarray:
    """Ids of one document of a shard file, by its place in the index; reads its frame only."""
    folder = _uri(folder)
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        mark = f.read_at(32, len(MAGIC)).hex()
        n, at = np.frombuffer(f.read_at(16, f.size() - 16), "<u8").tolist()
        if not 0 <= place < n:
            raise IndexError(place)
        _, _, offset, length, _ = np.frombuffer(f.read_at(ENTRY.itemsize, at + place * ENTRY.itemsize), ENTRY)[0].tolist()
        frame = f.read_at(length, offset)
    return np.frombuffer(_decompressor(_get(folder, f"{mark}.dict")).decompress(frame), "<u4")


def read(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, read back from the files.

    `start` counts the ids of all documents before it; the sum over earlier files comes from
    the manifest, which has one row per file. Without `with_ids`, `ids` is null.
    """
    folder = _uri(folder)
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", "name", "dictionary", before.alias("before"))

    def batch(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        plain = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        if with_ids:
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)))
        else:
            lists = pa.nulls(len(rows), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*plain, lists], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                rows, held, start, size = [], [], row["before"], 0
                for doc, ids in open_shard(_get(folder, row["name"]), _get(folder, f"{row['dictionary']}.dict")):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    held.append(ids)
                    start, size = start + len(ids), size + len(ids)
                    if size > 1 << 20:
                        yield batch(rows, held)
                        rows, held, size = [], [], 0
                yield batch(rows, held)

    return files.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
