"""Best-fit decreasing packing of documents into sequences of a fixed length.

Pieces of equal length are interchangeable, so the packing is decided on the histogram of lengths: at most `capacity`
rows, whatever the size of the corpus. It takes the lengths in decreasing order; a segment tree over the remaining
capacities finds the tightest open bin in logarithmic time, and a run of equal bins takes a run of equal pieces at once.
That gives the very bins that best-fit decreasing makes one piece after another over the whole corpus. The result is a
short list of segments (length, first rank, bins, place); every piece gets a rank among its equals, in salted buckets so
that a common length doesn't meet in one task, and looks its segment up.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are packed each; very long texts are
encoded in chunks and cut into pieces of the capacity; no documents give no pieces; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace, slices
from braidlake.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
#: Pieces of one length that one task ranks.
RANKED_AT_ONCE = 1 << 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tightest:
    """A segment tree over remaining capacities; each leaf holds runs of bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = bytearray(2 * self.size)
        self.runs: list[deque] = [deque() for _ in range(capacity + 1)]

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            k = room + self.size
            while k and not self.full[k]:
                self.full[k] = 1
                k >>= 1

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].popleft()
        if not self.runs[room]:
            k = room + self.size
            self.full[k] = 0
            while k > 1 and not self.full[k ^ 1]:
                k >>= 1
                self.full[k] = 0
        return run

    def find(self, least: int) -> int | None:
        """The smallest room of at least `least` that some bin has."""
        k = least + self.size
        if self.full[k]:
            return least
        while k > 1:
            if not k & 1 and self.full[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return None
        while k < self.size:
            k = 2 * k if self.full[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, pieces, first bin, pieces a bin, offset of the first) for {length: pieces}.

    Their number depends on the capacity, not on the number of pieces: a length meets each run of bins once, and adds
    two runs at most.
    """
    tree, bins, out = Tightest(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = tree.take(room)
            each = room // length
            whole = min(n, left // each)
            if whole:
                out.append((length, rank, whole * each, first, each, capacity - room))
                tree.put(room - each * length, first, whole)
                rank, left, first, n = rank + whole * each, left - whole * each, first + whole, n - whole
            if left and n:
                if left < each:
                    out.append((length, rank, left, first, left, capacity - room))
                    tree.put(room - left * length, first, 1)
                    left, first, n = 0, first + 1, n - 1
            if room < capacity:
                tree.put(room, first, n)
    return out


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of (doc_id, text): only documents over the capacity are cut, and then the first piece may be shorter."""
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def pieces(batches):
        e = encoder(tokenizer)
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = e.encode(text) + end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (i, j) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    part = ids[4 * i : 4 * j]
                    rows.append((doc_id, k, i, j - i, zlib.crc32(part), np.frombuffer(part, "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, start, length, ids_crc32)."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    segments = np.array(best_fit_decreasing(histogram, capacity) or np.zeros((0, 6)), "i8").reshape(-1, 6)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    segments = pieces.sparkSession.sparkContext.broadcast(segments)
    salts = max(1, -(-max(histogram.values(), default=0) // RANKED_AT_ONCE), min(64, sum(histogram.values()) // 256))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    among = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(among) - 1).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rn")).alias("rank"))

    def place(batches):
        s = segments.value
        keys = s[:, 0] << 44 | s[:, 1]
        for b in batches:
            if b.num_rows:
                length, rank = (np.asarray(b.column(k)) for k in (3, 5))
                at = s[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
                k = rank - at[:, 1]
                sequence, offset = at[:, 3] + k // at[:, 4], at[:, 5] + k % at[:, 4] * length
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with Workspace(docs.sparkSession, "packing") as ws:
        pieces = ws.table(cut(docs, capacity, tokenizer, end_id), "pieces", keep=True)
        return pack(pieces, ws, capacity)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and lengths of the pieces in order. Rows that repeat a doc_id, as
    mixing makes them, are told apart by their pieces' places and checksums."""
    name = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = cut(docs, capacity, tokenizer, end_id, with_ids=True).dropDuplicates(name).withColumnsRenamed({c: f"_{c}" for c in name})
    same = packed.doc_id.eqNullSafe(ids._doc_id)
    for c in name[1:]:
        same = same & (packed[c] == ids[f"_{c}"])
    rows = packed.join(ids, same).select("sequence_id", "offset", "length", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
