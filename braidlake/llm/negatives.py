"""Hard negatives by a pivot table: for an anchor and each of its nearest rows of the same label, the best-scoring rows of other labels whose score lies in a band below.

Scores are inner products of integer vectors (floor(256 x)). A vector x becomes (x, sqrt(M - |x|^2)) with M the greatest
squared length, an anchor a becomes (a, 0): then the squared distance is |a|^2 + M - 2 a.x, and inner products are ordered
as distances are. Pivots are chosen farthest first from a bounded sample. Every row stores its distances to pivots; by the
triangle inequality these bracket its score with an anchor. Rows lie in chunks of one nearest pivot and neighbouring
distances, anchors in blocks likewise, so a bracket of intervals rules out a chunk for a block before anything is moved,
then brackets of single rows do within a chunk, and what is left is checked by exact products. Each search first visits a
block's nearest chunks, whose best scores are bounds for the search over all chunks; nothing that could be better is skipped.

Equal vectors of one label are one class with the few smallest ids that could be wanted, whatever the number of copies.

Defined results: rows take no part whose vec_id, label or vector is null, that hold a null or non-finite component, or whose
squared length exceeds 2^62 (their scores are no longs); missing components of a shorter vector count as zeros; an empty
vector scores 0 with all; rows that repeat wholly count once, rows of one vec_id that differ each; ties go by the smaller
vec_id; an anchor's own row is none of its positives; a positive of negative score has no negatives, as its band is empty;
an empty table gives none; other columns are ignored, whatever their names; labels of any type are compared as strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace, share_of

#: Pivots are chosen among about so many classes, by the hash of their vector; there are a quarter of the square root of
#: the number of classes, at most MOST_PIVOTS. Each row stores its distances to the first TABLE of them.
SAMPLE, MOST_PIVOTS, TABLE = 4_096, 512, 8
#: Rows and bytes of a chunk, anchors of a block.
CHUNK_ROWS, CHUNK_BYTES, BLOCK = 4_096, 1 << 20, 256
#: Chunks that give a block its first bounds.
NEAREST = 4
#: Found rows that a task holds before it hands them on.
HELD = 1_000_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
FOUND = "block long, slot int, ceiling long, score long, id long, own boolean"


def integer_vectors(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Which vectors take part, their components as bytes (a byte of width, then integers), and their squared lengths."""
    if not len(column):
        return np.zeros(0, bool), [], np.zeros(0, np.int64)
    width, values = np.asarray(column.value_lengths().fill_null(0)), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at, used = np.cumsum([0, *width])[:-1], np.zeros(len(column), bool)
    coded, squares = [b""] * len(column), np.zeros(len(column), np.int64)
    for n in np.unique(width):
        rows = np.flatnonzero((width == n) & np.asarray(column.is_valid()))
        with np.errstate(all="ignore"):
            x = np.floor(256 * values[at[rows][:, None] + np.arange(n)])
            good = np.isfinite(x).all(1) & (np.square(x).sum(1) <= 2.0**62)
        rows, x = rows[good], x[good].astype(np.int64)
        used[rows], squares[rows] = True, np.square(x).sum(1)
        most = np.abs(x).max(1, initial=0)
        for k, low, high in ((2, -1, 1 << 15), (4, 1 << 15, 1 << 31), (8, 1 << 31, 1 << 62)):
            of = np.flatnonzero((most >= low) & (most < high))
            for i, data in zip(rows[of], x[of].astype(f"<i{k}"), strict=True):
                coded[i] = bytes([k]) + data.tobytes()
    return used, coded, squares


def matrix(vectors: list[bytes]) -> np.ndarray:
    """The rows of integers again, shorter ones filled with zeros."""
    if len({(len(v), v[0]) for v in vectors}) == 1:
        k = vectors[0][0]
        return np.frombuffer(b"".join(v[1:] for v in vectors), f"<i{k}").reshape(len(vectors), len(vectors[0]) // k).astype(np.int64)
    rows = [np.frombuffer(v, f"<i{v[0]}", offset=1) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows; bound: the greatest that one could be."""
    d = min(a.shape[1], x.shape[1])
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return a[:, :d].astype(kind) @ x[:, :d].T.astype(kind)


class Pivots:
    """Points of the augmented space, and distances to them."""

    def __init__(self, vectors: list[bytes], longest: int, n: int):
        self.longest = float(longest)
        x = matrix(vectors).astype(np.float64) if vectors else np.zeros((1, 0))
        lift = self.lift(np.square(x).sum(1))
        chosen, nearest = [0], None
        while len(chosen) < min(n, len(x)):  # the point farthest from all chosen, again and again
            k = chosen[-1]
            squared = 2 * self.longest - 2 * (x @ x[k] + lift * lift[k])
            nearest = squared if nearest is None else np.minimum(nearest, squared)
            chosen.append(int(np.argmax(nearest)))
        self.x, self.up = x[chosen], lift[chosen]
        #: More than rounding moves a distance, in 32 bits too.
        self.slack = 1e-6 * np.sqrt(self.longest) + 1e-9

    def lift(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - squares, 0))

    def distances(self, x: np.ndarray, squares: np.ndarray, lifted: bool, n: int | None = None) -> np.ndarray:
        """From rows (lifted) or anchors (not) to the first n pivots."""
        d = min(x.shape[1], self.x.shape[1])
        inner = x[:, :d].astype(np.float64) @ self.x[:n, :d].T
        squared = 2 * self.longest - 2 * (inner + self.lift(squares)[:, None] * self.up[:n]) if lifted else (squares + self.longest)[:, None] - 2 * inner
        return np.sqrt(np.maximum(squared, 0))


def _place(table: DataFrame, pivots, lifted: bool) -> DataFrame:
    """Adds each class's nearest pivot, its distance and the stored distances."""

    def place(batches):
        for b in batches:
            if b.num_rows:
                x, squares = matrix(b.column("vec").to_pylist()), np.asarray(b.column("sq")).astype(np.float64)
                d = pivots.value.distances(x, squares, lifted)
                home = d.argmin(1).astype(np.int32)
                near = [row.tobytes() for row in d[:, :TABLE].astype("<f4")]
                more = [pa.array(home), pa.array(d[np.arange(len(d)), home]), pa.array(near, pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "home", "dist", "near"])

    return table.mapInArrow(place, "label string, vec binary, sq long, ids array<long>, home int, dist double, near binary")


PACKED = "number long, home int, lo double, hi double, n int, payload binary"


def _pack(placed: DataFrame, rows: int) -> DataFrame:
    """Neighbours in one row of bytes each: of one nearest pivot, in order of distance. Dealt by range, so a pivot with many rows is many tasks'."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["number", "home", "lo", "hi", "n", "payload"]

    def pack(batches):
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def packed():
            batch = pa.RecordBatch.from_pylist([{k: r[k] for k in ("label", "vec", "ids", "near")} for r in held], INSIDE)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, INSIDE) as out:
                out.write_batch(batch)
            values = (number, held[0]["home"], held[0]["dist"], held[-1]["dist"], len(held), sink.getvalue().to_pybytes())
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for b in batches:
            for row in b.to_pylist():
                if held and (len(held) >= rows or size >= CHUNK_BYTES or held[0]["home"] != row["home"]):
                    yield packed()
                    held, size, number = [], 0, number + 1
                held.append(row)
                size += len(row["vec"])
        if held:
            yield packed()

    order = ["home", "dist", F.xxhash64("label", "vec")]
    return placed.repartitionByRange(n, *order).sortWithinPartitions("home", "dist", "label", "vec").mapInArrow(pack, PACKED)


INSIDE = pa.schema([("label", pa.string()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("near", pa.binary())])


def _unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(payload)) as found:
        return found.read_next_batch()


class _Side:
    """A chunk or block as arrays."""

    def __init__(self, payload: bytes, codes: dict[str, int]):
        b = _unpack(payload)
        self.x = matrix(b.column("vec").to_pylist())
        self.exact = np.square(self.x).sum(1)
        self.squares = self.exact.astype(np.float64)
        self.near = np.frombuffer(b"".join(b.column("near").to_pylist()), "<f4").reshape(b.num_rows, -1)
        labels = b.column("label").dictionary_encode()
        code = np.array([codes.setdefault(x, len(codes)) for x in labels.dictionary.to_pylist()], np.int64)
        self.label = code[np.asarray(labels.indices)]
        ids = b.column("ids")
        width = np.asarray(ids.value_lengths())
        self.ids = np.full((b.num_rows, max(1, width.max(initial=0))), HIGHEST)
        self.ids[np.arange(self.ids.shape[1]) < width[:, None]] = np.asarray(ids.flatten())


def survivors(rows: _Side, anchors: _Side, pivots: Pivots, need: float, most: float) -> np.ndarray:
    """Rows that the stored distances don't rule out for all anchors of a block: their score could lie in [need, most]."""
    from_ = pivots.distances(anchors.x, anchors.squares, False, TABLE)
    least, greatest = from_.min(0), from_.max(0)
    gap = np.maximum(rows.near - greatest, least - rows.near).max(1) - pivots.slack
    reach = (rows.near + greatest).min(1) + pivots.slack
    highest = (anchors.squares.max() + pivots.longest - np.square(np.maximum(gap, 0))) / 2
    lowest = (anchors.squares.min() + pivots.longest - np.square(reach)) / 2
    room = 1 + 1e-9 * pivots.longest
    return np.flatnonzero((highest + room >= need) & (lowest - room <= most))


def best_pairs(s: np.ndarray, wanted: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the wanted pairs within [floor, ceiling] of each anchor, without those below an anchor's k-th best."""
    if s.dtype != np.int64:
        floor, ceiling = floor.astype(np.float64), ceiling.astype(np.float64)
    ok = wanted & (s >= floor[:, None]) & (s <= ceiling[:, None])
    many = np.flatnonzero(ok.sum(1) > k)
    if len(many):
        kth = np.partition(np.where(ok[many], s[many], LOWEST if s.dtype == np.int64 else -np.inf), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        ok[many] &= s[many] >= kth[:, None]
    return np.nonzero(ok)


class _Found:
    """The best of one block so far: for each (anchor, ceiling) the first k by descending score and ascending id."""

    def __init__(self, floor: np.ndarray, ceiling: np.ndarray, k: int):
        self.floor, self.ceiling, self.k = floor.copy(), ceiling, k
        self.rows = np.zeros((0, 4), np.int64)  # key, score, id, own

    def add(self, s, wanted, own, ids) -> None:
        parts, c = [self.rows], self.floor.shape[1]
        for j in range(c):
            i, r = best_pairs(s, wanted, self.floor[:, j], self.ceiling[:, j], self.k)
            if len(i):
                of = ids[r]
                a, b = np.nonzero(of != HIGHEST)
                parts.append(np.stack([i[a] * c + j, s[i, r].astype(np.int64)[a], of[a, b], own[i, r][a]], axis=1))
        if len(parts) > 1:
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
            first = np.searchsorted(rows[:, 0], rows[:, 0])
            rank = np.arange(len(rows)) - first
            self.rows = rows[rank < self.k]
            last = rows[rank == self.k - 1]
            self.floor[last[:, 0] // c, last[:, 0] % c] = last[:, 1]


def _visit(pairs: DataFrame, tasks: DataFrame, chunks: DataFrame, pivots, same: bool, k: int) -> DataFrame:
    """The best rows of each block's anchors among the chunks that it is paired with."""
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = chunks.join(pairs.select(F.col("chunk").alias("number")).distinct(), "number", "left_semi")
    there = there.select(F.col("number").alias("chunk"), F.lit(-1).cast("long").alias("block"), "payload", F.lit(None).cast("array<long>").alias("floors"), F.lit(None).cast("array<long>").alias("ceilings"))
    asked = pairs.select("chunk", "block").join(tasks, "block").select("chunk", "block", "payload", "floors", "ceilings")
    schema = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("ceiling", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("own", pa.bool_())])

    def visit(batches):
        rows, codes, found = None, {}, {}

        def hand_on():
            for block, f in found.items():
                if len(f.rows):
                    slot, j = np.divmod(f.rows[:, 0], f.floor.shape[1])
                    columns = (np.full(len(slot), block), slot.astype(np.int32), f.ceiling[slot, j], f.rows[:, 1], f.rows[:, 2], f.rows[:, 3].astype(bool))
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(columns, schema, strict=True)], schema=schema)
            found.clear()

        for b in batches:
            for block, payload, floors, ceilings in zip(*(b.column(c) for c in range(1, 5)), strict=True):
                if not floors.is_valid:
                    rows = _Side(payload.as_buffer(), codes)
                    continue
                anchors, block = _Side(payload.as_buffer(), codes), block.as_py()
                if block not in found:
                    shape = (len(anchors.x), -1)
                    found[block] = _Found(np.asarray(floors.values).reshape(shape), np.asarray(ceilings.values).reshape(shape), k)
                f = found[block]
                live = survivors(rows, anchors, pivots.value, float(f.floor.min()), float(f.ceiling.max()))
                if len(live):
                    s = products(anchors.x, rows.x[live], np.sqrt(anchors.squares.max() * rows.squares[live].max()) + 1)
                    wanted = anchors.label[:, None] == rows.label[live]
                    square = anchors.exact[:, None]
                    own = wanted & (s == square.astype(s.dtype)) & (rows.exact[live] == square)  # a.x = a.a = x.x only if x = a
                    f.add(s, wanted if same else ~wanted, own, rows.ids[live])
            if sum(len(f.rows) for f in found.values()) > HELD:
                yield from hand_on()
        yield from hand_on()

    merged = there.unionByName(asked).repartition(n, "chunk").sortWithinPartitions("chunk", "block").mapInArrow(visit, FOUND)
    w = Window.partitionBy("block", "slot", "ceiling").orderBy(F.desc("score"), "id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(tasks: DataFrame, chunks: DataFrame, pivots, nearest: int | None = None) -> DataFrame:
    """(block, chunk) whose interval of distances allows a wanted score; the nearest few of each block if asked for."""

    def spread(batches):
        for b in batches:
            for block, payload, floors, ceilings in zip(*(b.column(c) for c in range(4)), strict=True):
                a = _Side(payload.as_buffer(), {})
                d = pivots.value.distances(a.x, a.squares, False)
                n = d.shape[1]
                need, most = float(np.asarray(floors.values).min()), float(np.asarray(ceilings.values).max())
                columns = [np.full(n, block.as_py()), np.arange(n, dtype=np.int32), d.min(0), d.max(0), *(np.full(n, v) for v in (a.squares.min(), a.squares.max(), need, most))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "home", "closest", "farthest", "shortest", "longest", "need", "most"])

    schema = "block long, home int, closest double, farthest double, shortest double, longest double, need double, most double"
    slack, m = F.lit(pivots.value.slack), F.lit(pivots.value.longest)
    gap = F.greatest(F.col("lo") - F.col("farthest"), F.col("closest") - F.col("hi"), slack) - slack
    reach, room = F.col("hi") + F.col("farthest") + slack, F.lit(1 + 1e-9 * pivots.value.longest)
    highest, lowest = (F.col("longest") + m - gap * gap) / 2 + room, (F.col("shortest") + m - reach * reach) / 2 - room
    met = tasks.select("block", "payload", "floors", "ceilings").mapInArrow(spread, schema).join(chunks.select(F.col("number").alias("chunk"), "home", "lo", "hi"), "home")
    met = met.where((highest >= F.col("need")) & (lowest <= F.col("most"))).select("block", "chunk", gap.alias("gap"))
    if nearest is None:
        return met.select("block", "chunk")
    w = Window.partitionBy("block").orderBy("gap", "chunk")
    return met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= nearest).select("block", "chunk")


def _asked(tasks: DataFrame, found: DataFrame, bounds) -> DataFrame:
    """Tasks with other floors and ceilings. bounds: (rows found of a block, its anchors, floors, ceilings) -> floors, ceilings."""
    of = found.groupBy("block").agg(F.collect_list(F.struct("slot", "ceiling", "score", "own", "rank")).alias("of"))  # some BLOCK x ceilings x k rows

    def bound(batches):
        for b in batches:
            out = [bounds(rows or [], n, np.array(low), np.array(high)) for n, low, high, rows in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
            arrays = [pa.array([np.ravel(o[j]) for o in out], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *arrays], ["block", "payload", "n", "floors", "ceilings"])

    return tasks.join(of, "block", "left").select("block", "payload", "n", "floors", "ceilings", "of").mapInArrow(bound, ASKED)


ASKED = "block long, payload binary, n int, floors array<long>, ceilings array<long>"


def _raised(k: int):
    """Floors at the k-th best found, where there are so many."""

    def bounds(rows, n, floors, ceilings):
        c = len(floors) // n
        of = {(i, ceilings[i * c + j]): i * c + j for i in range(n) for j in range(c)}
        for r in rows:
            if r["rank"] == k:
                floors[of[r["slot"], r["ceiling"]]] = r["score"]
        return floors, ceilings

    return bounds


def _bands(k: int, low: int):
    """A band below the score of each positive that an anchor could have. If one row alone is the anchor's vector, it is the
    anchor itself, or the last of k rows, which is not needed then."""

    def bounds(rows, n, floors, ceilings):
        scores = [set() for _ in range(n)]
        own = [0] * n
        for r in rows:
            own[r["slot"]] += r["own"]
        for r in rows:
            if r["score"] >= 0 and (not r["own"] or own[r["slot"]] > 1):
                scores[r["slot"]].add(r["score"])
        width = max(1, max(map(len, scores)))
        floors, ceilings = np.full((n, width), HIGHEST), np.full((n, width), LOWEST)
        for i, found in enumerate(scores):
            for j, score in enumerate(sorted(found)):
                floors[i, j], ceilings[i, j] = -(-low * score // 100), score
        return floors, ceilings

    return bounds


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """Negatives of the rows (vec_id, label, embedding) where `anchors` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    low: percent of the positive's score that a negative reaches at least; it never exceeds that score.
    """
    spark, k = vectors.sparkSession, positives + 1
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    plain = plain.where("vec_id is not null and label is not null and embedding is not null")

    def code(batches):
        for b in batches:
            used, coded, squares = integer_vectors(b.column(2))
            keep, columns = pa.array(used), [b.column(0), b.column(1), b.column(3), pa.array(coded, pa.binary()), pa.array(squares)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["vec_id", "label", "anchor", "vec", "sq"])

    with Workspace(spark, "negatives") as ws:
        coded = plain.mapInArrow(code, "vec_id long, label string, anchor boolean, vec binary, sq long")
        members = ws.table(coded.groupBy("label", "vec", "vec_id").agg(F.max("anchor").alias("anchor"), F.max("sq").alias("sq")), "members", keep=True)
        w = Window.partitionBy("label", "vec").orderBy("vec_id")
        few = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(k, negatives))
        classes = few.groupBy("label", "vec").agg(F.max("sq").alias("sq"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
        classes = ws.table(classes, "classes")
        size = classes.agg(F.count("*").alias("n"), F.max("sq").alias("longest")).first()
        sample = classes.where(share_of(F.col("vec"), SAMPLE / max(1, size.n))).select("vec").limit(2 * SAMPLE).collect()
        chosen = Pivots(sorted({bytes(r[0]) for r in sample}), size.longest or 0, min(MOST_PIVOTS, max(TABLE, int(size.n**0.5) // 4)))
        pivots = spark.sparkContext.broadcast(chosen)  # at most MOST_PIVOTS vectors

        def packed(table: DataFrame, lifted: bool, rows: int, name: str) -> DataFrame:
            placed = ws.table(_place(table, pivots, lifted), f"placed{name}")
            return ws.table(_pack(placed, rows), name)

        chunks = packed(classes, True, CHUNK_ROWS, "chunks")
        asking = members.where("anchor").groupBy("label", "vec").agg(F.max("sq").alias("sq")).withColumn("ids", F.array().cast("array<long>"))
        blocks = packed(asking, False, BLOCK, "blocks").withColumnRenamed("number", "block")
        ws.drop("placedchunks", "placedblocks", "classes")

        def search(tasks: DataFrame, same: bool, k: int, name: str) -> DataFrame:
            """First the nearest chunks of each block, then all that the bounds found there allow."""
            visit = lambda tasks, nearest: _visit(_pairs(tasks, chunks, pivots, nearest), tasks, chunks, pivots, same, k)
            first = ws.table(visit(tasks, NEAREST), f"first{name}", at_once=16)
            raised = ws.table(_asked(tasks, first, _raised(k)), f"raised{name}", at_once=16)
            return ws.table(visit(raised, None), f"best{name}", at_once=16)

        all_ = [F.array_repeat(F.lit(v).cast("long"), F.col("n")).alias(name) for v, name in ((LOWEST, "floors"), (HIGHEST, "ceilings"))]
        tasks = blocks.select("block", "payload", "n", *all_)
        same = search(tasks, True, k, "same")
        bands = ws.table(_asked(tasks, same, _bands(k, low)), "bands", at_once=16)
        other = search(bands, False, negatives, "other")

        def keys(batches):
            for b in batches:
                for block, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    a = _unpack(payload.as_buffer())
                    columns = [pa.array([block] * a.num_rows, pa.int64()), pa.array(range(a.num_rows), pa.int32()), a.column("label"), a.column("vec")]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "slot", "label", "vec"])

        named = blocks.select("block", "payload").mapInArrow(keys, "block long, slot int, label string, vec binary")
        found = same.groupBy("block", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id", "own"))).alias("pos"))
        hard = other.groupBy("block", "slot", "ceiling").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("neg"))
        hard = hard.groupBy("block", "slot").agg(F.map_from_entries(F.collect_list(F.struct("ceiling", "neg"))).alias("neg"))
        mined = ws.table(named.join(found, ["block", "slot"]).join(hard, ["block", "slot"]).select("label", "vec", "pos", "neg"), "mined", keep=True, at_once=16)
    rows = members.where("anchor").join(mined, ["label", "vec"])  # of many anchors that are copies Spark splits the side that has them
    others = F.slice(F.filter("pos", lambda p: ~(p["own"] & (p["id"] == F.col("vec_id")))), 1, positives)
    rows = rows.select("vec_id", F.explode(others).alias("p"), "neg")
    rows = rows.select(F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(F.element_at("neg", F.col("p.score"))).alias("q"))
    return rows.select("anchor_id", "positive_id", F.col("q.rank").alias("rank"), F.col("q.id").alias("negative_id"), "positive_score", F.col("q.score").alias("negative_score"))
