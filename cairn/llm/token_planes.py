"""Token ids in files of byte or bit planes.

Ids are cut into chunks of a fixed number. Of a chunk, the lowest bytes (or bits) of all ids are stored together, then
the next ones, each plane compressed by itself: the high planes of small ids are nearly constant and vanish. A file is

    magic | planes of chunk 0 | planes of chunk 1 | ... | index | footer

The index (zstandard) holds for each chunk its number of ids and the length of every plane, and for each document its
id and its number of ids, so any chunk or document can be read by itself. The footer holds the place of the index.

Documents are range-partitioned by id before they are encoded; file names sort as the ids do. A file is written under
a name of the task's attempt and then moved, so a task that runs again finds or writes the same files.
Files roll over at ``FILE_BYTES``. They are read back through Spark, from wherever they are.

Defined cases: a null text is the empty one and has the end id only; null ids come first; rows with the same id are
ordered by a hash of the text and each has its own entry; an empty table gives no file and no rows; further columns
are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from cairn.llm.bytescan import slices
from cairn.llm.common import map_batches, table, text_of
from cairn.llm.registry import query
from cairn.session import cut, shared_dir

MAGIC = b"IDPLANE1"
END_ID = 0
CHUNK_IDS = 1 << 16
FILE_BYTES = 64 << 20
#: Words of a generation that a task's process remembers the ids of.
KNOWN_WORDS = 300_000
#: New words that are encoded in a row.
ROW_WORDS = 4096


#: Two line breaks and more white space are one unit of the pre-tokenizer, two before a visible character are two.
_BREAKS = re.compile(r"\n\n(?=\s|\Z)")


class Encoder:
    """Ids of texts by the tokenizer, each distinct word encoded once.

    The byte-level pre-tokenizer parts a text before a space or single line break that a visible character follows,
    and between a letter or digit and the marks behind it; nothing reaches over such a place. So a text is the
    sequence of its first word, of " word" and of "\\nword" for the others, and of what stands behind a word. A text in
    which white space meets white space in any other way, or with a token of the tokenizer's own, is encoded as a whole.

    Words are remembered in two generations: when the young one is full it becomes the old one, and an old word that
    comes up again is young again, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space or line break
        self.begins[[i for t, i in vocabulary.items() if t.startswith(("\u0120", "\u010a"))]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space or line break before each: encoded in a row, parted at the tokens that begin with one."""
        out = []
        for i in range(0, len(words), ROW_WORDS):
            some = words[i: i + ROW_WORDS]
            row = "".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([row], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(some) or any(a in row for a in self.added):
                out += self._encode(some)
                continue
            packed, places = ids.tobytes(), [*(first * 4).tolist(), 4 * len(ids)]
            out += [packed[a:b] for a, b in zip(places, places[1:], strict=False)]
        return out

    def _learn(self, parts: list[str]) -> None:
        known, old, tails = self.known, self.old, self.tails
        if len(tails) > KNOWN_WORDS:
            tails.clear()
        whole, split = {}, []
        for p in parts:
            if (ids := old.get(p)) is not None:
                known[p] = ids
                continue
            if p.isalnum():
                whole[p] = " " + p
                continue
            word = p[1:] if p[:1] == "\n" else p
            if word and not word[0].isspace() and not word[-1].isspace():
                head = p.rstrip(punctuation)
                if len(head) < len(p) and head[-1:].isalnum():
                    split.append((p, head, p[len(head):]))
                    if head not in known and head not in whole:
                        if (ids := old.get(head)) is not None:
                            known[head] = ids
                        else:
                            whole[head] = head if head[0] == "\n" else " " + head
                else:
                    whole[p] = p if p[0] == "\n" else " " + p
            elif p == "\n":
                known[p] = self._encode([p])[0]
        known.update(zip(whole, self._encode_words(list(whole.values())), strict=True))
        new = list({t for _, _, t in split} - tails.keys())
        tails.update(zip(new, self._encode(new), strict=True))
        for p, head, tail in split:
            known[p] = known[head] + tails[tail]

    def __call__(self, texts: list[str]) -> list[bytes]:
        lists = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = self._encode([ps[0] for ps in lists])
        if len(self.known) > KNOWN_WORDS:
            self.known, self.old = {}, self.known
        known = self.known
        self._learn(list({p for ps in lists for p in ps[1:] if p not in known}))
        out = []
        for text, ps, head in zip(texts, lists, heads, strict=True):
            if ps[0][-1:].isspace() or _BREAKS.search(text) or any(a in text for a in self.added):
                out.append(self._encode([text])[0])
                continue
            try:
                out.append(head + b"".join(map(known.__getitem__, ps[1:])))
            except KeyError:
                out.append(self._encode([text])[0])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process, so that the words it knows serve all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of the ids, lowest first, as many as the largest id needs."""
    if bits:
        width = max(1, int(ids.max()).bit_length())
        return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(width)]
    width = max(1, (int(ids.max()).bit_length() + 7) // 8)
    return [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]]


def from_planes(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(parts):
        plane = np.frombuffer(p, np.uint8)
        out |= (np.unpackbits(plane, count=n) if bits else plane).astype(np.uint32) << np.uint32(k if bits else 8 * k)
    return out


class PlaneFile:
    """Writes one file chunk by chunk; of the ids, only those of the open chunk are held."""

    def __init__(self, out, chunk_ids: int, bits: bool, level: int = 3):
        self.out, self.chunk_ids, self.bits, self.press = out, chunk_ids, bits, zstandard.ZstdCompressor(level)
        self.held, self.n_held, self.at = [], 0, len(MAGIC)
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[int, bool, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.chunk_ids:
            every = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(every) - len(every) % self.chunk_ids
            for i in range(0, whole, self.chunk_ids):
                self._chunk(every[i: i + self.chunk_ids])
            self.held, self.n_held = [every[whole:].tobytes()], len(every) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.press.compress(p) for p in planes(ids, self.bits)]
        for p in packed:
            self.out.write(p)
        self.at += sum(map(len, packed))
        self.chunks.append([len(ids), *map(len, packed)])

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        sizes = np.array([len(c) for c in self.chunks], "<i8")
        parts = [sizes, np.array([x for c in self.chunks for x in c], "<i8"),
                 *(np.array([d[k] for d in self.docs], "<i8") for k in range(3))]
        index = self.press.compress(b"".join(p.tobytes() for p in parts))
        self.out.write(index)
        self.out.write(struct.pack("<QQQQB", self.at, len(index), len(sizes), len(self.docs), self.bits) + MAGIC)
        self.out.close()


def read_file(content: bytes) -> tuple[list[tuple[int | None, int]], Iterator[np.ndarray]]:
    """(doc_id, number of ids) of every document of a file, and its chunks of ids one after the other."""
    at, size, n_chunks, n_docs, bits = struct.unpack("<QQQQB", content[-33 - len(MAGIC): -len(MAGIC)])
    if content[: len(MAGIC)] != MAGIC or content[-len(MAGIC):] != MAGIC:
        raise ValueError("not a file of id planes")
    opened = zstandard.ZstdDecompressor()
    index = np.frombuffer(opened.decompress(content[at: at + size]), "<i8")
    sizes, docs = index[:n_chunks], index[len(index) - 3 * n_docs:].reshape(3, n_docs)
    flat = index[n_chunks: len(index) - 3 * n_docs]

    def chunks() -> Iterator[np.ndarray]:
        place, k = len(MAGIC), 0
        for s in sizes.tolist():
            n, *lengths = flat[k: k + s].tolist()
            k += s
            parts = []
            for length in lengths:
                parts.append(opened.decompress(content[place: place + length]))
                place += length
            yield from_planes(parts, n, bool(bits)) if lengths else np.zeros(0, np.uint32)

    return [(None if gone else d, n) for d, gone, n in docs.T.tolist()], chunks()


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark would use for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full if "://" in full else full.replace("file:/", "file:///", 1)


def write_planes(docs: DataFrame, folder: str, tokenizer: str, chunk_ids: int = CHUNK_IDS, bits: bool = False) -> DataFrame:
    """Writes the files of ``docs`` (doc_id, text) and returns their manifest: file, n_docs, n_ids."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    uri = _qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get()
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        end, file, number, made = struct.pack("<I", END_ID), None, 0, []

        def finish() -> None:
            file.close()
            name = f"part-{task.partitionId():06d}-{number:04d}.ids"
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                store.move(f"{root}/{temporary}", f"{root}/{name}")
            else:  # an earlier attempt of this task has left the same bytes
                store.delete_file(f"{root}/{temporary}")
            made.append((name, len(file.docs), sum(d[2] for d in file.docs)))

        for whole in batches:
            for batch in slices(whole):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                    if file is None:
                        temporary = f"_writing-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}"
                        file = PlaneFile(store.open_output_stream(f"{root}/{temporary}"), chunk_ids, bits)
                    file.add(doc_id, ids + end)
                    if file.at >= FILE_BYTES:
                        finish()
                        file, number = None, number + 1
        if file is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), *(pa.array([m[k] for m in made], pa.int64()) for k in (1, 2))],
            names=["file", "n_docs", "n_ids"])

    return cut(map_batches(ranged, write, "file string, n_docs long, n_ids long"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            docs, chunks = read_file(content.as_buffer().to_pybytes())
            rows, start, held = [], 0, np.zeros(0, np.uint32)
            for doc_id, n in docs:
                crc, left = 0, n
                while left:
                    if not len(held):
                        held = next(chunks)
                    crc = zlib.crc32(held[:left].astype("<u4").tobytes(), crc)
                    taken = min(left, len(held))
                    held, left = held[taken:], left - taken
                rows.append((path.rsplit("/", 1)[-1], doc_id, start, n, crc))
                start += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5))],
                names=["file", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    The manifest gives each file its start: one row per file is windowed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    found = cut(map_batches(files, _digests, "file string, doc_id long, within long, n_tokens long, ids_crc32 long"))
    before = F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    starts = manifest.select("file", F.coalesce(before, F.lit(0)).alias("first"))
    return found.join(starts, "file").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, chunk_ids: int = CHUNK_IDS, bits: bool = False) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    manifest = write_planes(docs, folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), chunk_ids, bits)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_digests(spark, folder, manifest)


@query("op7_token_planes")
def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))
