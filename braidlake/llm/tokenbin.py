"""Token-ID output: files of separately compressed documents under one shared zstandard dictionary.

A shard file holds a header (magic, SHA-256 of the dictionary, bytes per id), one zstandard frame for each document in
ascending doc_id order, and an index (doc_id, null flag, place, tokens) found through a fixed footer. One document is
read with two short reads and one frame. `dictionary.zdict` lies beside the shards.

Defined results: a null text is an empty text (it has the end id alone); null doc_ids come first; rows that repeat a
doc_id are all written, in the order of their texts' hashes; very long texts are encoded in chunks; an empty table
gives no shard; other columns are ignored, whatever their names.
A shard is written under another name and moved when whole, so an attempt that is lost or runs twice leaves no harm.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm._common import file_system, share_of, slices, write_file
from braidlake.llm.tokens import default_tokenizer, encoder

MAGIC, FOOT = b"BTOKENS1", struct.Struct("<QQ8s")
HEAD = struct.Struct("<8s32sI")
DICTIONARY_BYTES = 1 << 16
#: The dictionary is trained on at most about so many documents, by the hash of their id, and so many bytes of each.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 2_000, 4_096


def train_dictionary(docs: DataFrame, tokenizer: str, id_bytes: int) -> bytes:
    """A zstandard dictionary for serialized id arrays, from a bounded sample. Empty if there is too little to train on."""
    import zstandard

    n = docs.count()
    if not n:
        return b""

    def serialized(batches):
        e = encoder(tokenizer)
        for b in slices(batches):
            out = []
            for text in b.column(0).to_pylist():
                raw = np.frombuffer(e.encode(text), "<u4").astype(f"<u{id_bytes}").tobytes()
                at = zlib.crc32(raw) % max(1, len(raw) - SAMPLE_BYTES) // id_bytes * id_bytes
                out.append(raw[at : at + SAMPLE_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["raw"])

    sample = docs.where(share_of(F.col("doc_id"), SAMPLE_DOCUMENTS / n)).select("text").mapInArrow(serialized, "raw binary")
    rows = sorted(bytes(r[0]) for r in sample.limit(2 * SAMPLE_DOCUMENTS).collect())
    rows = [r for r in rows if len(r) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _shard(rows, dictionary: bytes, id_bytes: int, tally: list):
    """The bytes of a shard file, part by part. rows: (doc_id, ids as bytes of 32-bit integers)."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(dictionary), write_content_size=True).compress
    yield HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), id_bytes)
    at, index = HEAD.size, []
    for doc_id, ids in rows:
        ids = np.frombuffer(ids, "<u4")
        frame = compress(ids.astype(f"<u{id_bytes}").tobytes())
        index.append((doc_id or 0, doc_id is None, at, len(ids)))
        at += len(frame)
        yield frame
    columns = list(zip(*index, strict=True)) or [()] * 4
    tally += [len(index), int(sum(columns[3])), at]
    for column, kind in zip(columns, ("<i8", "u1", "<u8", "<u4"), strict=True):
        yield np.array(column, kind).tobytes()
    yield FOOT.pack(at, len(index), MAGIC)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Encodes (doc_id, text) and writes shards in ascending doc_id order. Returns the manifest, one entry a shard."""
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select("doc_id", "text")
    id_bytes = 2 if encoder(tokenizer).vocab_size <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, id_bytes)
    write_file(f"{folder}/dictionary.zdict", [dictionary])
    end = np.array([end_id], "<u4").tobytes()
    ordered = docs.repartitionByRange(shards or max(1, docs.rdd.getNumPartitions()), F.asc_nulls_first("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def write(batches):
        from pyspark import TaskContext

        e, tally, shard = encoder(tokenizer), [], TaskContext.get().partitionId()
        rows = ((i, e.encode(t) + end) for b in slices(batches) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(rows, None)
        if first is not None:
            name = f"shard-{shard:07d}.btok"
            write_file(f"{folder}/{name}", _shard((r for part in ([first], rows) for r in part), dictionary, id_bytes, tally))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "documents": [tally[0]], "tokens": [tally[1]]}, schema=manifest)

    manifest = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
    rows = sorted(r.asDict().items() for r in ordered.mapInArrow(write, "shard long, name string, documents long, tokens long").collect())
    rows = sorted((dict(r) for r in rows), key=lambda r: r["shard"])
    start = 0
    for r in rows:
        r["start"] = start
        start += r["tokens"]
    write_file(f"{folder}/manifest.json", [json.dumps(rows).encode()])
    return rows


class TokenReader:
    """Random access to the documents of one shard file."""

    def __init__(self, folder: str, name: str):
        import zstandard

        fs, path = file_system(folder)
        with fs.open_input_stream(f"{path}/dictionary.zdict", compression=None) as f:
            dictionary = f.read()
        self.file = fs.open_input_file(f"{path}/{name}")
        magic, digest, self.id_bytes = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was not written with this dictionary")
        size = self.file.size()
        self.end, n, magic = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is cut short")
        raw, at, self.columns = self._read(self.end, n * 21), 0, []
        for kind in ("<i8", "u1", "<u8", "<u4"):
            width = np.dtype(kind).itemsize * n
            self.columns.append(np.frombuffer(raw[at : at + width], kind))
            at += width
        self.doc_id, self.null, self.place, self.tokens = self.columns
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.place)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard."""
        end = self.place[k + 1] if k + 1 < len(self.place) else self.end
        return np.frombuffer(self.decompress(self._read(int(self.place[k]), int(end - self.place[k]))), f"<u{self.id_bytes}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray:
        """The ids of a document by its id; the index is in ascending order."""
        k = int(self.null.sum()) + int(np.searchsorted(self.doc_id[int(self.null.sum()) :], doc_id))
        if k >= len(self) or self.doc_id[k] != doc_id:
            raise KeyError(doc_id)
        return self.ids(k)


def read_tokens(spark: SparkSession, folder: str, manifest: list[dict], digest_only: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32 and, unless digest_only, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(r["shard"], r["name"], r["start"]) for r in manifest], "shard long, name string, start long")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    out = pa.schema(fields + ([] if digest_only else [("ids", pa.list_(pa.int32()))]))

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                reader, at = TokenReader(folder, row["name"]), row["start"]
                for i in range(0, len(reader), 1024):
                    rows = {f.name: [] for f in out}
                    for k in range(i, min(i + 1024, len(reader))):
                        ids = reader.ids(k)
                        values = (None if reader.null[k] else int(reader.doc_id[k]), at, len(ids), zlib.crc32(ids.tobytes()), ids.astype("i4"))
                        for f, v in zip(rows.values(), values, strict=False):
                            f.append(v)
                        at += len(ids)
                    yield pa.RecordBatch.from_pydict(rows, schema=out)

    return shards.repartitionByRange(len(manifest), "shard").mapInArrow(read, schema)
