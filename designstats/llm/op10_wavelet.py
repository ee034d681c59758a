"""Token ids in wavelet-matrix files: one compressed file per shard, with access, counting and lookup.

A file holds blocks of at most ``BLOCK`` ids and a directory. A block is a wavelet matrix: one bit-plane
per bit of the largest id, highest first; each plane keeps the ids in the order in which the plane above
leaves them, zeros before ones. Rank uses ones counted before each 64-bit word. Layout:

    8 bytes   magic
    ...       per block and plane: the packed bits, compressed by zstandard
    ...       directory: JSON, compressed by zstandard
    ...       documents: id (0 where null), null flag, number of ids; 64-bit each, compressed by zstandard
    24 bytes  lengths of the directory and of the document table, number of documents

A document may run over several blocks, so memory is bounded by the block and the longest text.
"""

import json
import os
import posixpath
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from designstats.llm.common import parts_of, stored, totals_before
from designstats.llm.tokens import worker_encoder
from designstats.session import scratch_path

MAGIC = b"WAVEIDS1"
BLOCK = 1 << 20


class WaveletMatrix:
    """Bit-planes over one block of ids."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.n, self.bits = n, planes
        self.words = [np.concatenate([[0], np.cumsum(np.bitwise_count(p.view("<u8")), dtype=np.int64)]) for p in planes]
        self.zeros = [n - int(w[-1]) for w in self.words]

    @staticmethod
    def planes_of(ids: np.ndarray) -> list[np.ndarray]:
        planes, x = [], np.asarray(ids, dtype=np.uint32)
        width = max(1, int(x.max(initial=0)).bit_length())
        if width <= 16:
            x = x.astype(np.uint16)  # half the memory to move
        for level in reversed(range(width)):
            bit = (x & x.dtype.type(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)]))
            if level:
                x = np.concatenate([x[~bit], x[bit]])
        return planes

    @classmethod
    def of(cls, ids):
        return cls(cls.planes_of(ids), len(ids))

    def _bit(self, k, at):
        return (self.bits[k][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, k, at):
        """Ones of plane k before each position."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        whole = np.append(self.bits[k].view("<u8"), np.uint64(0))[word]
        return self.words[k][word] + np.bitwise_count(whole & ((np.uint64(1) << low) - np.uint64(1)))

    def access(self, at) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        for k in range(len(self.bits)):
            bit, ones = self._bit(k, at), self._ones(k, at)
            out = out << np.uint32(1) | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up: each plane says how the one below interleaves."""
        out = np.zeros(self.n, dtype=np.uint16 if len(self.bits) <= 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.bits), reversed(self.zeros))):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[~bit] = out[:zeros]
            above[bit] = out[zeros:] | out.dtype.type(1 << level)
            out = above
        return out.astype(np.uint32)

    def _range(self, token, lo, hi):
        if token < 0 or token >> len(self.bits):
            return 0, 0
        for k in range(len(self.bits)):
            a, b = self._ones(k, np.array([lo, hi]))
            if token >> (len(self.bits) - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return int(lo), int(hi)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of the id in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """Positions of all occurrences, ascending: each is carried back up through the planes by select."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b)
        for k in reversed(range(len(self.bits))):
            bit = token >> (len(self.bits) - 1 - k) & 1
            flags = np.unpackbits(self.bits[k], count=self.n, bitorder="little")
            at = np.flatnonzero(flags == bit)[at - (self.zeros[k] if bit else 0)] if len(at) else at
        return at


def _file(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Ids are added document by document; the file appears under its name when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _file(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.at, self.blocks, self.docs, self.held, self.n_held = len(MAGIC), [], [], [], 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int):
        ids = np.concatenate(self.held)
        lo = 0
        while len(ids) - lo >= least:
            part = ids[lo:lo + BLOCK]
            planes = [self.pack.compress(p.tobytes()) for p in WaveletMatrix.planes_of(part)]
            self.blocks.append({"n": len(part), "at": self.at, "planes": [len(p) for p in planes]})
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            lo += len(part)
            if lo == len(ids):
                break
        self.held, self.n_held = [ids[lo:].copy()], len(ids) - lo

    def close(self) -> int:
        if self.n_held:
            self._flush(1)
        directory = self.pack.compress(json.dumps(self.blocks).encode())
        docs = self.pack.compress(np.array(self.docs, dtype="<i8").tobytes())
        self.out.write(directory + docs + np.array([len(directory), len(docs), len(self.docs)], dtype="<i8").tobytes())
        self.out.close()
        self.fs.move(self.temp, self.path)
        return sum(b["n"] for b in self.blocks)


class Reader:
    """Opens a file; blocks are read as they are needed, and the last one is kept."""

    def __init__(self, uri: str):
        files, path = _file(uri)
        self.file = files.open_input_file(path)
        unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        d, t, self.n_docs = np.frombuffer(self.file.read_at(24, size - 24), dtype="<i8").tolist()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no wavelet file")
        self.blocks = json.loads(unpack(self.file.read_at(d, size - 24 - d - t)))
        self.docs = np.frombuffer(unpack(self.file.read_at(t, size - 24 - t)), dtype="<i8").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum([b["n"] for b in self.blocks], dtype=np.int64)])
        self.n = int(self.starts[-1])
        self._last = (-1, None)

    def block(self, i: int) -> WaveletMatrix:
        if self._last[0] != i:
            b, at, planes = self.blocks[i], self.blocks[i]["at"], []
            for size in b["planes"]:
                raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, at))
                planes.append(np.frombuffer(raw, dtype=np.uint8))
                at += size
            self._last = (i, WaveletMatrix(planes, b["n"]))
        return self._last[1]

    def access(self, at: int) -> int:
        i = int(np.searchsorted(self.starts, at, "right")) - 1
        return int(self.block(i).access(np.array([at - self.starts[i]]))[0])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        hi = self.n if hi is None else hi
        total = 0
        for i, (a, b) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist())):
            if a < hi and lo < b:
                total += self.block(i).count(token, max(lo - a, 0), min(hi, b) - a)
        return total

    def occurrences(self, token: int):
        for i, a in enumerate(self.starts[:-1].tolist()):
            yield from (self.block(i).occurrences(token) + a).tolist()

    def documents(self):
        """(doc id, ids) in order, block by block."""
        held, block, have = [], 0, 0
        for doc, null, n in self.docs.tolist():
            while have < n:
                held.append(self.block(block).decode())
                have += len(held[-1])
                block += 1
            ids = held[0] if len(held) == 1 else np.concatenate(held or [np.zeros(0, dtype=np.uint32)])
            yield (None if null else doc), ids[:n]
            held, have = [ids[n:]], have - n


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, shards: int | None = None,
                 docs_per_shard: int = 16384, end_id: int = 0) -> DataFrame:
    """Encode the documents and write them in ascending doc_id order; (shard, path, n_docs, n_tokens, start).

    A null text is empty and still gets its end id; a null id comes first; repeated rows are written again;
    an empty table gives no file. A repeated task writes the same file again under the same name.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "wavelet")
    shards = shards or parts_of(docs.count(), docs_per_shard)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, encoder, writer = TaskContext.get().partitionId(), None, None
        uri, n_docs = f"{folder}/shard-{shard:06d}.wm", 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                encoder, writer = worker_encoder(tokenizer, "byte"), Writer(uri)
            end = np.array([end_id], dtype=np.uint32)
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for lo in range(0, len(texts), 512):
                for doc, x in zip(ids[lo:lo + 512], encoder.ids(texts[lo:lo + 512])):
                    writer.add(doc, np.concatenate([x, end]))
            n_docs += len(texts)
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [n_docs], "n_tokens": [writer.close()]})

    made = stored(rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "shards")
    made = made.withColumn("cell", F.floor(F.col("shard") / 1024))
    return totals_before(made, "cell", ["shard"], F.col("n_tokens"), "start").drop("cell")


def read_shards(files: DataFrame) -> DataFrame:
    """Every document back from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    n = max(1, files.count())

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                rows, size = [], 0
                for doc, ids in Reader(path).documents():
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + len(rows[-1][3])
                    if size > 1 << 22:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path", "start").repartition(n, "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows):
    doc, start, n, ids = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids"])


