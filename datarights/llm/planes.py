"""Token ids in files of shuffled bit planes.

A file holds the ids of consecutive documents in chunks of a fixed number of ids. A chunk is transposed:
all lowest bits (or bytes) of its ids, then all next ones, and so on. Every plane is compressed
by itself with zstandard; planes of zeros take no room. Behind the chunks stand the documents, then the
chunk index with every plane's size, then a trailer that tells where these begin, so any range of ids is
read by decoding the chunks that hold it and no others.

    magic | planes of chunk 0 | planes of chunk 1 | ... | documents | chunk index | trailer

Files are written by tasks under names of their own attempt, and only files named in the manifest, which
Spark commits, count: a task that is run again leaves an unnamed file and nothing twice.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datarights.llm.common import column_bytes, kept, slices
from datarights.operators.ordered import in_order
from datarights.session import scratch_path, stage_unsized as stage

CHUNK = 1 << 16
FILE_IDS = 1 << 24
PARTITION = 32 << 20
MAGIC = b"IDPLANE1"
#: bits or bytes, ids, documents, chunks, ids of a chunk, where the documents begin, where the chunk index begins, magic
_TRAILER = struct.Struct("<IQQQQQQ8s")
MANIFEST = "shard int, file int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 32 bit planes or four byte planes of unsigned 32-bit ids, the lowest first; b'' for those above the largest id."""
    width, n = (1, 32) if bits else (8, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    planes = []
    for i in range(n):
        if i * width >= top:
            planes.append(b"")
        else:
            row = (ids >> np.uint32(i * width)).astype(np.uint8)
            planes.append((np.packbits(row & 1, bitorder="little") if bits else row).tobytes())
    return planes


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    ids = np.zeros(n, "<u4")
    for i, plane in enumerate(planes):
        if plane:
            row = np.frombuffer(plane, np.uint8)
            ids |= (np.unpackbits(row, count=n, bitorder="little") if bits else row).astype("<u4") << np.uint32(i if bits else 8 * i)
    return ids


class PlaneWriter:
    """Writes documents one after the other to a binary stream; holds one chunk and one document at most."""

    def __init__(self, stream, bits: bool = True, chunk: int = CHUNK, level: int = 3):
        self.stream, self.bits, self.chunk = stream, bits, chunk
        self.pack = zstandard.ZstdCompressor(level=level)
        self.sizes: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.held: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.at = stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= self.chunk:
            rows = np.concatenate(self.held)
            whole = len(rows) // self.chunk * self.chunk
            for i in range(0, whole, self.chunk):
                self._put(rows[i: i + self.chunk])
            self.held, self.waiting = [rows[whole:].copy()], len(rows) - whole

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.pack.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
        self.at += self.stream.write(b"".join(packed))
        self.sizes.append([len(p) for p in packed])

    def close(self) -> int:
        """Ends the file and gives its size."""
        if self.waiting:
            self._put(np.concatenate(self.held))
        docs_at = self.at
        known = np.array([d is not None for d, _ in self.docs], np.uint8).tobytes()
        table = np.array([(d or 0, n) for d, n in self.docs], "<i8").reshape(-1, 2).T.tobytes()
        self.at += self.stream.write(self.pack.compress(known + table))
        index_at = self.at
        self.at += self.stream.write(self.pack.compress(np.array(self.sizes, "<u4").tobytes()))
        trailer = (1 if self.bits else 8, self.n_ids, len(self.docs), len(self.sizes), self.chunk, docs_at, index_at, MAGIC)
        self.at += self.stream.write(_TRAILER.pack(*trailer))
        return self.at


class PlaneFile:
    """Reads a file of planes: its documents in order, or any range of ids."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        tail = self._read(size - _TRAILER.size, _TRAILER.size)
        width, self.n_ids, n_docs, n_chunks, self.chunk, docs_at, index_at, magic = _TRAILER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        self.bits, self.unpack = width == 1, zstandard.ZstdDecompressor()
        docs = self.unpack.decompress(self._read(docs_at, index_at - docs_at))
        ids, self.lengths = np.frombuffer(docs, "<i8", offset=n_docs).reshape(2, n_docs)
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), docs[:n_docs])]
        sizes = self.unpack.decompress(self._read(index_at, size - _TRAILER.size - index_at))
        self.sizes = np.frombuffer(sizes, "<u4").reshape(n_chunks, 32 if self.bits else 4).astype(np.int64)
        self.offsets = len(MAGIC) + np.append(0, np.cumsum(self.sizes.sum(1)))

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def decode(self, chunk: int) -> np.ndarray:
        data = self._read(int(self.offsets[chunk]), int(self.offsets[chunk + 1] - self.offsets[chunk]))
        planes, at = [], 0
        for size in self.sizes[chunk].tolist():
            planes.append(self.unpack.decompress(data[at: at + size]) if size else b"")
            at += size
        return from_planes(planes, min(self.chunk, self.n_ids - chunk * self.chunk), self.bits)

    def ids(self, first: int, n: int) -> np.ndarray:
        """`n` ids from the `first` on; only chunks that hold some are read."""
        if not n:
            return np.zeros(0, "<u4")
        chunks = range(first // self.chunk, (first + n - 1) // self.chunk + 1)
        return np.concatenate([self.decode(c) for c in chunks])[first - chunks[0] * self.chunk:][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids) in order; every chunk is decoded once."""
        rest, chunk, first = np.zeros(0, "<u4"), 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.decode(chunk))
                have += len(parts[-1])
                chunk += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, first, rest[:n]
            rest, first = rest[n:], first + n


_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: White space, to some engines, other than blank and line break; the first byte is kept for texts' first words.
_OTHER_SPACE = re.compile(b"[\0\t\v\f\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MAYBE_SPACE = np.isin(np.arange(256), [0, 9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3])


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Encoder:
    """Ids of texts by a byte-level BPE file, parts between blanks encoded once and then looked up.

    No token spans a blank or line break between two other characters: a blank belongs to the word behind
    it, a line break is a token. A part is therefore a word, led by a line break or by `\\0` where no
    blank stands before it. Parts of letters go to the file's BPE model as they are, a last stop or comma
    is a token of its own; other parts share a call and are told apart by their lengths, a token's name
    having one character per byte. Texts with other white space, or that name a special token, are
    encoded whole, and so are all texts if the file is of another kind.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for name, i in vocab.items():
            self.size[i] = len(name)
        with open(path) as file:
            steps = json.load(file)
        before = steps["pre_tokenizer"] or {}
        self.by_parts = steps["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.names = dict(enumerate(_byte_names()))
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _of_letters(self, parts: list[str]) -> Iterator[bytes]:
        tokenize, blank, ids, ends = self.tokenizer.model.tokenize, self.names[32], [], [0]
        line = self._ids("\n").tolist()
        for part in parts:
            lead, word = ("", part) if part[0] > "\n" else (part[0], part[1:])
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.names)
            if lead == "\n":
                ids += line
            ids += [t.id for t in tokenize(word if lead else blank + word)]
            ends.append(len(ids))
        data, ends = np.array(ids, self.kind).tobytes(), [e * self.kind.itemsize for e in ends]
        return (data[a:b] for a, b in zip(ends, ends[1:]))

    def _together(self, parts: list[str], per_call: int = 2000) -> Iterator[bytes]:
        for i in range(0, len(parts), per_call):
            some = [p if p[0] == "\n" else " " + p for p in parts[i: i + per_call]]
            code = self._ids("x" + "".join(some))
            ends = np.cumsum(self.size[code])
            want = np.cumsum([1] + [len(p.encode()) for p in some])
            at = np.searchsorted(ends, want)
            if not np.array_equal(ends[at], want):
                raise RuntimeError("a token spans two parts of a text; the file is not byte-level BPE")
            data, at = code.tobytes(), (self.kind.itemsize * (at + 1)).tolist()
            yield from (data[a:b] for a, b in zip(at, at[1:]))

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of parts not seen before, which are kept; a word is not encoded again for the stop or comma behind it."""
        marks = [p[-1] if p[-1] in ".," and p[-2:-1].isalnum() and p[-2].isascii() else "" for p in parts]
        stems = [p[:-1] if m else p for p, m in zip(parts, marks)]
        bare = [s for s, m in zip(stems, marks) if m]
        known = {s: code for s in bare if (code := self.new.get(s) or self.old.get(s))}
        letters, firsts, others = [], [], []
        for s in dict.fromkeys(stems):
            if s not in known:
                (letters if _LETTERS.fullmatch(s, s[0] <= "\n") else firsts if s[0] == "\0" else others).append(s)
        known.update(zip(letters, self._of_letters(letters), strict=True))
        known.update(zip(others, self._together(others), strict=True))
        known.update((s, self._ids(s[1:]).tobytes()) for s in firsts)
        mark = {c: self._ids(c).tobytes() for c in ".,"} | {"": b""}
        found = [known[s] + mark[m] for s, m in zip(stems, marks)]
        self.new.update(zip(parts, found))
        return found

    def _plain(self, text: bytes) -> bool:
        """Whether the text's white space is single blanks and line breaks between words."""
        if not self.by_parts or not text:
            return False
        data = np.frombuffer(text, np.uint8)
        blank = (data == 32) | (data == 10)
        if blank[0] or blank[-1] or (blank[1:] & blank[:-1]).any():
            return False
        return not (_MAYBE_SPACE[data].any() and _OTHER_SPACE.search(text)) and not any(s in text for s in self.special)

    def _of_parts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain texts: their distinct parts are looked up, then all parts are put together at once."""
        texts = [b"\0" + t.replace(b"\n", b" \n") + b" " for t in texts]
        data = b"".join(texts)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
        starts = pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes())
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, starts, pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary
        parts = distinct.buffers()[2].slice(0, int(np.frombuffer(distinct.buffers()[1], np.int32)[len(distinct)])).to_pybytes().decode().split(" ")[:-1]
        if len(self.new) + len(parts) > self.most:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        found, fresh = list(map(new.get, parts)), []
        for i in [i for i, code in enumerate(found) if code is None]:
            code = old.get(parts[i])
            if code is None:
                fresh.append(i)
            else:
                new[parts[i]] = found[i] = code
        for i, code in zip(fresh, self._learn([parts[i] for i in fresh]), strict=True):
            found[i] = code
        pool, width = np.frombuffer(b"".join(found), self.kind), self.kind.itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // width
        which = coded.indices.to_numpy()
        lengths, firsts = size[which], (np.cumsum(size) - size)[which]
        upto = np.cumsum(lengths)
        ids = pool[np.repeat(firsts - (upto - lengths), lengths) + np.arange(upto[-1])]
        last = np.searchsorted(ends, np.cumsum([len(t) for t in texts]))
        return np.split(ids, upto[last][:-1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        plain = [self._plain(t) for t in texts]
        by_parts = iter(self._of_parts([t for t, p in zip(texts, plain) if p]) if any(plain) else [])
        return [next(by_parts) if p else self._ids(t.decode()) for t, p in zip(texts, plain)]


def _open(path: str):
    files, name = fs.FileSystem.from_uri(path)
    return files, name


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, end_id: int = 2, bits: bool = True,
              chunk: int = CHUNK, file_ids: int = FILE_IDS, partitions: int | None = None) -> DataFrame:
    """Writes every text's ids and `end_id` in ascending doc_id order; gives the manifest, one row per file, with each file's `start`.

    Rows are dealt by ranges of doc_id of some 32 MB of text, at most 20,000 of them, beyond which ranges
    grow and are sorted on disk; rows of one doc_id, were they a third of all, are parted by their place
    in the scan. A range is written to files of about `file_ids` ids; a document is in one file.
    `folder` must be reachable from all executors: a path or any address that pyarrow's file systems know.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.monotonically_increasing_id().alias("place"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = partitions or min(20_000, size // PARTITION + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, files, done = TaskContext.get().partitionId(), None, []
        writer = stream = path = None

        def end() -> None:
            n_bytes = writer.close()
            stream.close()
            done.append((shard, len(done), path, len(writer.docs), writer.n_ids, n_bytes))

        memory = kept("byte tokens")
        encoder = memory.get(tokenizer_path) or memory.setdefault(tokenizer_path, Encoder(tokenizer_path))
        for batch in slices(batches, keep="byte tokens"):
            texts = [t or b"" for t in column_bytes(batch)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                if writer is None:
                    files, top = _open(folder)
                    files.create_dir(top)
                    name = f"{shard:06d}-{len(done):04d}-{uuid.uuid4().hex}.planes"
                    path, stream = f"{folder}/{name}", files.open_output_stream(f"{top}/{name}")
                    writer = PlaneWriter(stream, bits, chunk)
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                if writer.n_ids >= file_ids:
                    end()
                    writer = None
        if writer is not None:
            end()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["shard", "file", "path", "n_docs", "n_ids", "n_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

    dealt = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place")
    written = stage(dealt.mapInArrow(write, MANIFEST))
    upto = in_order(written.withColumn("all", F.lit(0)), ["all"], ["shard", "file"], F.floor(F.col("shard") / 128), sums={"upto": F.col("n_ids")})
    return stage(upto.withColumn("start", F.col("upto") - F.col("n_ids")).drop("upto", "all"))


def _spread(manifest: DataFrame) -> DataFrame:
    """The files dealt to tasks, one or a few to each."""
    return manifest.repartition(max(1, min(manifest.count(), 20_000)), "path")


def read_documents(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, and with `with_ids` its ids."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                files, name = _open(path)
                with files.open_input_file(name) as stream:
                    yield from _rows(PlaneFile(stream), start)

    def _rows(file: PlaneFile, start: int) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.int64()) for c in list(zip(*rows))[:4]]
            if with_ids:
                columns.append(pa.array([r[4].astype(np.int64) for r in rows], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

        for doc_id, first, ids in file.documents():
            rows.append((doc_id, start + first, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
            held += len(ids) if with_ids else 1
            if held > CHUNK:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return _spread(manifest.select("path", "start")).mapInArrow(read, schema)


def read_range(manifest: DataFrame, first: int, n: int) -> np.ndarray:
    """Ids `first` to `first + n` of the whole corpus, for a trainer that seeks; decodes only chunks that hold some."""
    holding = manifest.where((F.col("start") < first + n) & (F.col("start") + F.col("n_ids") > first)).orderBy("start").collect()
    parts = [np.zeros(0, "<u4")]
    for row in holding:
        files, name = _open(row["path"])
        with files.open_input_file(name) as stream:
            low = max(0, first - row["start"])
            parts.append(PlaneFile(stream).ids(low, min(row["n_ids"], first + n - row["start"]) - low))
    return np.concatenate(parts)


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2, bits: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files written for it.

    A null text is empty and becomes `end_id` alone. Null ids come first; rows of one id, also a row given
    twice, follow in the order of the scan, each with ids of its own. Extra columns are ignored; an empty
    table gives an empty one and no file.
    """
    return read_documents(write_ids(docs, tokenizer_path, folder, end_id=end_id, bits=bits))
