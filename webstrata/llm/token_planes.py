"""Token-id files with byte or bit planes, and the tokenizer that feeds them.

A shard holds the ids of consecutive documents.  Blocks of a fixed number of ids are transposed
into planes (all first bytes, all second bytes, ...; or all first bits, ...), each plane is
compressed with zstandard, and a chunk index says where each block's planes lie, so any id range
is read by decoding its blocks alone.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_tree import byte_of_char
from .common import PYTHON_ONLY_SPACE, export_files, new_folder, stored, text_column

# Fixed value: first bytes of a shard.
MAGIC = b"BPLN0001"
#: Ids of a block.
BLOCK = 1 << 15
#: A shard ends with the document that brings it to this many ids.
SHARD_IDS = 1 << 22
#: Words whose ids a worker remembers, bytes of all of them with their ids, and of one.
CACHE_WORDS, CACHE_BYTES, LONG_WORD = 700_000, 1 << 26, 100
#: Bytes of texts that are encoded at once.
CHUNK = 1 << 24
# Fixed value: the split pattern of the tokenizer file, for lower-case words.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Fixed value: the same for words of ASCII characters without white space.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def runs_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges that hold about ``limit`` each, one item at least."""
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


class WordEncoder:
    """Exact ids of a tokenizer that drops white space, word by word, with a bounded memory of words.

    White space always separates this tokenizer's pieces, so a text's ids are the concatenation of
    its words' ids; words end at ASCII white space.  Arrow cuts words and finds those that are known,
    numpy puts their ids together, so that only words not met before are handled one by one.  Words
    of characters below U+0250 (all in normal form C, with plain lower case) are split into pieces
    here and each piece goes to the library's model; other words, and words that may hold special
    strings or separators that not all take for space, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.chars = {b: c for c, b in byte_of_char().items()}
        self.pieces: dict[str, bytes] = {}

        # little-endian ids, as wide as the vocabulary needs
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")

        # known words; of each, where its ids start in the table, how many they are, and whether it came again
        self.words = pa.array([], pa.string())
        self.starts, self.sizes, self.again = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.table = np.zeros(0, self.dtype)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            shown = text if text.isascii() and text.isprintable() else "".join(map(self.chars.__getitem__, text.encode()))
            found = self.pieces[text] = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def word(self, w: str) -> bytes:
        """Ids of one word."""
        low = w.lower()
        if w.isascii():
            if low.isalpha():
                return self.piece(low)
            split = ASCII_PIECES
        elif max(w) < "ɐ":
            split = PIECES
        else:
            return self.whole(w)
        if "<|" in w or PYTHON_ONLY_SPACE.search(w):
            return self.whole(w)
        return b"".join(map(self.piece, split.findall(low)))

    def learn(self, words: pa.Array) -> None:
        """Add words that aren't known."""
        made = list(map(self.word, words.to_pylist()))
        sizes = np.fromiter(map(len, made), np.int32, len(made)) // self.dtype.itemsize
        starts = len(self.table) + np.cumsum(sizes, dtype=np.int32) - sizes
        self.words = pa.concat_arrays([self.words, words])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.again = np.concatenate([self.again, np.zeros(len(made), bool)])
        self.table = np.concatenate([self.table, np.frombuffer(b"".join(made), self.dtype)])

    def forget(self) -> None:
        """Keep words that came again, or none where these are too many; long words go."""
        stay = self.again & (pc.binary_length(self.words).to_numpy() <= LONG_WORD)
        stay &= bool(stay.sum() <= CACHE_WORDS // 2)
        self.table = self.table[np.repeat(stay, self.sizes)]
        self.words, self.sizes = self.words.filter(pa.array(stay)), self.sizes[stay]
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.again = np.zeros(len(self.sizes), bool)

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """Ids of each text, of ``dtype``."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string())
        for a, b in runs_of(pc.binary_length(texts).to_numpy(), CHUNK):
            split = pc.ascii_split_whitespace(texts.slice(a, b - a))
            found = split.flatten().dictionary_encode()
            at = pc.index_in(found.dictionary, self.words)
            new = at.is_null()
            self.again[at.drop_null().to_numpy()] = True
            before = len(self.words)
            self.learn(found.dictionary.filter(new))
            unknown = new.to_numpy(zero_copy_only=False)
            place = at.fill_null(0).to_numpy().copy()
            place[unknown] = np.arange(before, len(self.words))
            place = place[found.indices.to_numpy()]

            # the ids of a word lie together in the table
            sizes = self.sizes[place]
            ends = np.zeros(len(place) + 1, np.int64)
            np.cumsum(sizes, out=ends[1:])
            ids = self.table[np.repeat(self.starts[place] - ends[:-1], sizes) + np.arange(ends[-1])]
            offsets = split.offsets.to_numpy()
            cuts = ends[offsets - offsets[0]].tolist()
            for i in range(b - a):
                yield ids[cuts[i] : cuts[i + 1]].tobytes()
            if len(self.words) > CACHE_WORDS or self.words.nbytes + self.table.nbytes > CACHE_BYTES:
                self.forget()


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker process, so that its tasks share what it remembers."""
    return WordEncoder(path)


def to_planes(block: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of unsigned little-endian ids, lowest first."""
    rows = block.view(np.uint8).reshape(len(block), block.itemsize).T
    if kind == "byte":
        return [np.ascontiguousarray(r).tobytes() for r in rows]
    return [np.packbits((block >> np.array(b, block.dtype)) & np.array(1, block.dtype)).tobytes() for b in range(8 * block.itemsize)]


def from_planes(planes: list[bytes], n: int, kind: str, dtype: np.dtype) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view(dtype).reshape(n)
    out = np.zeros(n, dtype)
    for b, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(dtype) << np.array(b, dtype)
    return out


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], kind: str = "byte", block: int = BLOCK, level: int = 1) -> bytes:
    """magic | header length | header JSON | document table | planes; the header holds the chunk index."""
    z = zstandard.ZstdCompressor(level=level)
    table = z.compress(np.array(lengths, "<u4").tobytes()), z.compress(json.dumps(doc_ids).encode())
    chunks, body, at = [], [], 0
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        planes = [z.compress(p) for p in to_planes(part, kind)]
        chunks.append([at, len(part), *map(len, planes)])
        body += planes
        at += sum(map(len, planes))
    head = json.dumps({"ids": len(ids), "docs": len(lengths), "width": ids.itemsize, "kind": kind, "block": block, "tables": [len(t) for t in table], "chunks": chunks}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(table) + b"".join(body)


class Shard:
    """Reader of one shard: document table at once, id ranges on demand."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a plane shard")
        (n,) = struct.unpack("<I", data[8:12])
        self.head = json.loads(data[12 : 12 + n])
        a, b = self.head["tables"]
        z = zstandard.ZstdDecompressor()
        self.lengths = np.frombuffer(z.decompress(data[12 + n : 12 + n + a]), "<u4").astype(np.int64)
        self.doc_ids: list[int | None] = json.loads(z.decompress(data[12 + n + a : 12 + n + a + b]))
        self.base, self.data, self.z = 12 + n + a + b, data, z
        self.dtype = np.dtype(f"<u{self.head['width']}")

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.head["chunks"][k]
        at, planes = at + self.base, []
        for s in sizes:
            planes.append(self.z.decompress(self.data[at : at + s]))
            at += s
        return from_planes(planes, n, self.head["kind"], self.dtype)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop; only the chunks that hold them are decoded."""
        stop, block = self.head["ids"] if stop is None else stop, self.head["block"]
        if stop <= start:
            return np.zeros(0, self.dtype)
        parts = [self.chunk(k) for k in range(start // block, (stop - 1) // block + 1)]
        return np.concatenate(parts)[start - start // block * block :][: stop - start]


def to_shards(docs: DataFrame, path: str, end_id: int = 1, kind: str = "byte") -> DataFrame:
    """Documents encoded in ascending doc_id order, as shards: (part, seq, part_start, n_ids, blob).

    Order: doc_id with nulls first, equal ids by a hash of their text, then by the text.  Null texts
    count as empty; every document gets the end id.  A document is never split: one longer than a
    shard is a shard of its own length.  Only a document's own ids and one shard are held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        ids, doc_ids, lengths, seq, start, size = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            blob = encode_shard(np.frombuffer(b"".join(ids), encoder.dtype), doc_ids, lengths, kind)
            row = {"part": part, "seq": seq, "part_start": start, "n_ids": size, "blob": blob}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            for doc_id, one in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids += [one, end]
                doc_ids.append(doc_id)
                lengths.append(len(one) // encoder.dtype.itemsize + 1)
                size += lengths[-1]
                if size >= SHARD_IDS:
                    yield shard()
                    ids, doc_ids, lengths, seq, start, size = [], [], [], seq + 1, start + size, 0
        if lengths:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # rows of one id spread by their texts
    ordered = ordered.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").drop("text_hash")
    return ordered.mapInArrow(run, "part long, seq long, part_start long, n_ids long, blob binary")


def write_planes(docs: DataFrame, path: str, root: str, end_id: int = 1, kind: str = "byte") -> DataFrame:
    """Write the shards of documents as files below ``root`` (a path or URI that pyarrow opens) and give them as ``open_planes`` does.

    An action.  A file's name holds its task, its place in the task's sequence, the ids of the task
    before it and its own, so names sort in document order.  Files appear when the whole job has
    succeeded.  No documents give an empty folder.  Shards are stored as rows first: a task that both
    encodes and writes files has two Python workers, each with its own encoder and words.
    """
    name = F.format_string("shard-%08d-%08d-%d-%d.bpln", "part", "seq", "part_start", "n_ids")
    shards = stored(to_shards(docs, path, end_id, kind), "planes", compression="none")
    export_files(shards.select(name.alias("name"), "blob"), root)
    return open_planes(docs.sparkSession, root)


def open_planes(spark: SparkSession, root: str) -> DataFrame:
    """Shard files below ``root`` as (part, seq, part_start, n_ids, blob); without the blob only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bpln").load(root)
    number = lambda i: F.regexp_extract("path", r"shard-(\d+)-(\d+)-(\d+)-(\d+)\.bpln$", i).cast("long")
    return files.select(*(number(i + 1).alias(c) for i, c in enumerate(("part", "seq", "part_start", "n_ids"))), F.col("content").alias("blob"))


def read_planes(shards: DataFrame) -> DataFrame:
    """One row a document, from shards: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids)."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select(F.col("part").alias("of_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard(blob.as_py())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(starts + begin), pa.array(s.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    # one row a partition of the writing job, 16 bytes each
    placed = shards.join(F.broadcast(offsets), F.col("part") == F.col("of_part")).select((F.col("part_start") + F.col("offset")).alias("begin"), "blob")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_planes(docs: DataFrame, path: str | None = None, end_id: int = 1, kind: str = "byte", root: str | None = None) -> DataFrame:
    """Documents to shard files and back; ``root`` is a new folder below the shared one unless it is given."""
    root = root or new_folder(docs.sparkSession, "planes")
    return read_planes(write_planes(docs, path or public_tokenizers.path("word_bpe_49k.json"), root, end_id, kind))
