"""Token ids in files: fixed-size blocks cut into byte planes, each compressed, behind a chunk index."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import save, scratch, table
from corpusloom.llm.piece_cache import library_encoder

#: Ids of a block; the last block of a file may hold fewer.
BLOCK_IDS = 65_536
LEVEL = 1
#: File: MAGIC, blocks, zstandard-compressed index (JSON), index length (8 bytes), MAGIC.
MAGIC = b"IDPLANE1"


def to_planes(ids: bytes) -> list[bytes]:
    """The four byte planes of little-endian unsigned 32-bit ids, lowest byte first."""
    import numpy as np

    a = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    return [a[:, k].tobytes() for k in range(4)]


def from_planes(planes: list[bytes], n: int) -> bytes:
    import numpy as np

    a = np.zeros((n, 4), dtype=np.uint8)
    for k, p in enumerate(planes):
        if p:
            a[:, k] = np.frombuffer(p, dtype=np.uint8)
    return a.tobytes()


class PlaneWriter:
    """Appends documents to an open binary stream; close() writes the chunk index.

    A plane of zeros alone is left out (length 0 in the index), so ids below 2 ** 16 cost two planes.
    """

    def __init__(self, out):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=LEVEL).compress
        self.buffer, self.blocks, self.docs, self.lengths, self.at, self.n = bytearray(), [], [], [], len(MAGIC), 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n += len(ids) // 4
        self.buffer += ids
        while len(self.buffer) >= 4 * BLOCK_IDS:
            self._block(bytes(self.buffer[: 4 * BLOCK_IDS]))
            del self.buffer[: 4 * BLOCK_IDS]

    def _block(self, ids: bytes) -> None:
        planes = [self.pack(p) if p.count(0) < len(p) else b"" for p in to_planes(ids)]
        self.blocks.append([self.at, len(ids) // 4, *map(len, planes)])
        for p in planes:
            self.out.write(p)
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.buffer:
            self._block(bytes(self.buffer))
        index = self.pack(json.dumps({"docs": self.docs, "lengths": self.lengths, "blocks": self.blocks}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


def read_planes(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a file in its order, from a seekable stream; one block is held at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    source.seek(0)
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of id planes")
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - 16)
    (n,), magic = struct.unpack("<Q", source.read(8)), source.read(8)
    if magic != MAGIC:
        raise ValueError("the file has no end mark")
    source.seek(end - 16 - n)
    index = json.loads(unpack(source.read(n)))
    blocks, held, at = iter(index["blocks"]), b"", 0
    for doc, length in zip(index["docs"], index["lengths"], strict=True):
        parts, need = [], 4 * length
        while need:
            if at == len(held):
                start, count, *sizes = next(blocks)
                source.seek(start)
                held, at = from_planes([unpack(source.read(s)) if s else b"" for s in sizes], count), 0
            take = min(need, len(held) - at)
            parts.append(held[at : at + take])
            at, need = at + take, need - take
        yield doc, b"".join(parts)


def open_store(address: str):
    """pyarrow's file system for an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, root: str) -> DataFrame:
    """Ids of docs (doc_id, text), each followed by end_id, in files under root, in ascending doc_id order.

    Returns the manifest: part, file, n_docs, n_ids; parts are in doc_id order. A task writes
    its file under a name of its own attempt and reports it in the manifest, so a lost
    executor leaves at most a file that no manifest names. Null ids come first; a null text
    counts as empty; rows that repeat an id stay, ordered by a hash of their texts.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa

        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.idp"
        encoder, writer, out = _encoder(tokenizer), None, None
        end = struct.pack("<I", end_id)
        for batch in batches:
            for part, encoded in encoder.batches(batch):
                if writer is None:
                    store, path = open_store(root)
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}")
                    writer = PlaneWriter(out)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return save(ordered.mapInArrow(run, "part int, file string, n_docs bigint, n_ids bigint"), f"{root}-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files."""
    # The manifest has a row a file, so its sums are small enough for the driver.
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["file"], start))
        start += r["n_ids"]
    listed = spark.createDataFrame(files, "file string, start bigint").repartition(max(1, len(files)), "file")

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            store, path = open_store(root)
            for file, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                with store.open_input_file(f"{path}/{file}") as source:
                    for doc, ids in read_planes(source):
                        rows.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        _encoders[path] = library_encoder(path)
    return _encoders[path]


#: The id that ends a document in op5.
END_ID = 2


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = scratch(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, root)
    return read_token_files(spark, manifest, root)
