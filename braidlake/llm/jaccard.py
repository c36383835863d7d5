"""Near-duplicates by a parity-sketch join over sets of word shingles: exact links at a Jaccard threshold.

A set's sketch has P parts of 2^24 bits; every shingle flips one bit of one part, so two sketches differ in no more bits,
and no more parts, than the sets differ in shingles. Sizes lie in bands; a set of n shingles uses the parts of its own band
and, if it can have larger partners there, those of the next. In a band a set differs from any partner that it links with
in at most k shingles, k by its own size, and keeps its k + 1 fullest parts, in one order for all: of the parts that are
equal in both sets the last in that order is kept by both. The parts, kept sparse as 64-bit codes of their bits, are join
keys; of what shares a key, pairs whose dense sketches allow a link are verified on whole sets.

Sets that are equal are one class from the start. Of the classes that share a key, each is first compared with the one
that shares most keys with others (a star, not all pairs); what that links is contracted, and only classes of different
components that still share a key are compared further, in another star and then with each other. In that last round all of these meet, key by key in blocks of a
bounded size, as dense parity sketches of about four bits a shingle: a pair whose Hamming distance is over what a link
allows is left there, and only the others become rows. No pair over the threshold can be missed: its members are in one
component already, or they meet.

Rows of a class are found again by doc_id and a hash of the text together. Joins of large tables are merge joins at every
size, and whole sets lie dealt out by class, so that they are never moved to be compared.

Defined results: a text without words (or null) has an empty set, no links, and is a component of its own; rows that
repeat, and equal texts, are linked (equal sets); a null doc_id never names a component that has another, but its rows
link as others do; a doc_id may stand for several texts; an empty table gives no rows. Very long texts are hashed one at a
time, and a block of a key is bounded by its shingles as well as its classes. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace, remove
from braidlake.llm.components import components
from braidlake.llm.words import byte_chunks, mix, shingle_set, word_hashes

WORDS, PERCENT = 5, 80
SPARE = 0.3
STAR_ROUNDS = 2
#: Classes of one key, and shingles of theirs, that meet in one task; larger groups meet block by block.
BLOCK, BLOCK_SHINGLES = 2_048, 8_000_000


class Bands:
    """Bands of set sizes for links at `percent`, each as wide as three steps of the threshold."""

    def __init__(self, percent: int, most: int):
        self.percent, self.bounds = percent, [1]
        while self.bounds[-1] <= most:
            upper = self.bounds[-1]
            for _ in range(3):
                upper = upper * 100 // percent + 1
            self.bounds.append(upper)

    def apart(self, total: int) -> int:
        """The most shingles in which two sets of so many together differ if they link."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, parts kept) for a set of n shingles: its own band, and the next if partners can be there."""
        b, most, out = int(np.searchsorted(self.bounds, n, side="right")) - 1, n * 100 // self.percent, []
        for band in (b, b + 1):
            if band == b or (band + 1 < len(self.bounds) and most >= self.bounds[band]):
                upper = self.bounds[band + 1] - 1
                k = self.apart(n + min(upper, most))
                if k:
                    out.append((band, int(np.ceil((1 + SPARE) * (self.apart(2 * upper) + 1))), k + 1))
        return out


_BANDS: dict[tuple[int, int], Bands] = {}


def bands(percent: int, n: int) -> Bands:
    most = 1 << max(16, n.bit_length() + 1)
    if (percent, most) not in _BANDS:
        _BANDS[percent, most] = Bands(percent, most)
    return _BANDS[percent, most]


def sketch_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set: codes of the parts of its sketches, with their band and number."""
    out = []
    for band, parts, keep in bands(percent, len(tokens)).of(len(tokens)):
        part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending, as the tokens
        bit = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFF)
        count = np.bincount(part, minlength=parts)
        code = np.zeros(parts, np.uint64)
        used = np.flatnonzero(count)
        starts = np.concatenate(([0], np.cumsum(count[used])[:-1]))
        code[used] = np.bitwise_xor.reduceat(mix(bit + (part.astype(np.uint64) << np.uint64(24)) + np.uint64(1)), starts)
        kept = np.argsort(count, kind="stable")[parts - keep :]
        out.append(mix(code[kept] ^ mix(kept.astype(np.uint64) + np.uint64((band + 1) << 32))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(tokens ^ np.uint64(0xA5A5)), dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, column: int, k: int):
    hashes, at = word_hashes(batch.column(column))
    for i in range(batch.num_rows):
        yield shingle_set(hashes[at[i] : at[i + 1]], k)


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of documents (kind 0: doc_id, text_hash, n, id) and of keys (kind 1: id, key). id: a hash of the set, null for empty ones."""
    schema = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "id", "key")]])

    def rows(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                ids, sizes, keys = [], [], []
                for tokens in _sets(b, 1, k):
                    sizes.append(len(tokens))
                    ids.append(_set_id(tokens) if len(tokens) else None)
                    keys.append(sketch_keys(tokens, percent).view(np.int64))
                n, m = b.num_rows, [len(x) for x in keys]
                own = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), b.column(0), b.column(2), pa.array(sizes, pa.int64()), own, pa.nulls(n, pa.int64())], schema=schema)
                if sum(m):
                    none = pa.nulls(sum(m), pa.int64())
                    repeated = own.take(pa.array(np.repeat(np.arange(n), m)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(sum(m), np.int32)), none, none, none, repeated, pa.array(np.concatenate(keys))], schema=schema)

    return _rows(docs).mapInArrow(rows, "kind int, doc_id long, text_hash long, n long, id long, key long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def dense_sketch(tokens: np.ndarray) -> np.ndarray:
    """A parity sketch of four to eight bits a shingle, as 64-bit words. Halves XORed are the sketch of half the size."""
    bits = 64
    while bits < 4 * len(tokens):
        bits *= 2
    at = (mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def packed(tokens: np.ndarray) -> bytes:
    """The high 48 bits of each token, ascending: enough to tell the shingles of two texts apart, and a quarter less to move."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = data.reshape(-1, 6)
    return out.view("<u8")[:, 0]


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _tokens(texts: DataFrame, k: int) -> DataFrame:
    """(id, n, sketch, tokens) of (id, text): the whole sets, packed, and their dense sketches. Rows that repeat an id one after another are one."""

    def rows(batches):
        last = None
        for whole in batches:
            for b in byte_chunks(whole, 1):
                ids = b.column(0).to_numpy()
                new = np.concatenate(([last is None or ids[0] != last], ids[1:] != ids[:-1]))
                last = ids[-1]
                b = b.filter(pa.array(new))
                sets = list(_sets(b, 1, k))
                columns = [pa.array([len(t) for t in sets], pa.int64()), pa.array([dense_sketch(t).tobytes() for t in sets], pa.binary()), pa.array([packed(t) for t in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "n", "sketch", "tokens"])

    return texts.select("id", "text").mapInArrow(rows, "id long, n long, sketch binary, tokens binary")


def _near(ids, component, n, side, sketches: list[bytes], percent: int, within: bool):
    """Pairs of different components whose sketches allow a link: all pairs, or those of a row of each side."""
    words = min(map(len, sketches)) // 8
    grid = np.stack([folded(np.frombuffer(s, np.uint64), words) for s in sketches])
    first = np.arange(len(ids)) if within else np.flatnonzero(side == 0)
    for i in first.tolist():
        others = np.arange(i + 1, len(ids)) if within else np.flatnonzero(side == 1)
        total = n[others] + n[i]
        fits = (component[others] != component[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
        others, total = others[fits], total[fits]
        if len(others):
            apart = np.bitwise_count(grid[others] ^ grid[i]).sum(axis=1, dtype=np.int64)
            others = others[apart * (100 + percent) <= total * (100 - percent)]
            if len(others):
                yield np.stack([np.full(len(others), ids[i]), ids[others]])


def _meetings(members: DataFrame, sets: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """Pairs (a, b) of classes that share a key, are of different components, and may link by their dense sketches."""
    sized = ws.table(members.select("key", "id", "component").hint("merge").join(sets.select("id", "n"), "id"), "sized")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    rows = sized.hint("merge").join(sized.groupBy("key").agg(blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component").hint("merge").join(sets.select("id", "n", "sketch"), "id")

    def compared(table: pa.Table):
        key, i, j, own, ids, component, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "own", "id", "component", "n"))
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        sketch, out, pairs = table.column("sketch").to_pylist(), [], 0

        def made():
            pairs = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
            if b - a > 1:
                part = slice(a, b)
                for found in _near(ids[part], component[part], n[part], (own[part] == j[part]).astype(int), sketch[part], percent, i[a] == j[a]):
                    out.append(found)
                    pairs += found.shape[1]
                    if pairs >= 100_000:
                        yield made()
                        pairs = 0
        if out:
            yield made()

    def meet(batches):
        held, n = [], 0
        for batch in batches:
            for b in (batch.slice(k, BLOCK) for k in range(0, batch.num_rows, BLOCK)):
                held.append(b)
                n += b.num_rows
                if n >= 2 * BLOCK:
                    table = pa.Table.from_batches(held)
                    last = [table.column(c).to_numpy() for c in ("key", "i", "j")]
                    whole = int(np.argmax((last[0] == last[0][-1]) & (last[1] == last[1][-1]) & (last[2] == last[2][-1])))
                    if whole:
                        yield from compared(table.slice(0, whole))
                    held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield from compared(pa.Table.from_batches(held))

    group = ["key", "i", "j"]
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(meet, "a long, b long").distinct()


def _allowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and dense sketches allow to link."""
    a, b = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def near(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                keep[i] = apart * (100 + percent) <= (na[i] + nb[i]) * (100 - percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.hint("merge").join(a, "a").hint("merge").join(b, "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    a, b = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")

    def linked(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (unpacked(np.frombuffer(v.as_buffer(), np.uint8)) for v in (x, y))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.hint("merge").join(a, "a").hint("merge").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(linked, "a long, b long")


def _stars(members: DataFrame, round_: int) -> DataFrame:
    """Pairs of each key's members (key, id, w, component) with one of another component: first with the one of most shared
    keys, in later rounds with the first in an order of that round."""
    first = F.col("w") if round_ == 0 else F.xxhash64("id", F.lit(round_))
    centre = members.groupBy("key").agg(F.max(F.struct(first.alias("o"), "id", "component")).alias("m"))
    pairs = members.select("key", "id", "component").hint("merge").join(centre.select("key", F.col("m.id").alias("centre"), F.col("m.component").alias("own")), "key")
    return pairs.where("component <> own").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def link_classes(docs: DataFrame, k: int, percent: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, id) of every row, id null for empty sets, and (id, component) of the classes that link with others. Written."""
    spark = docs.sparkSession
    made = ws.write(sketches(docs, k, percent), "sketches", by="kind")
    read = spark.read.schema("doc_id long, text_hash long, n long, id long, key long, kind int").parquet(made)
    heads, keys = read.where("kind = 0").select("doc_id", "text_hash", "n", "id"), read.where("kind = 1").select("key", "id")
    multi = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    multi = ws.table(multi, "multi")
    shared = ws.table(keys.hint("merge").join(multi, "key", "left_semi").distinct(), "shared")
    remove(spark, f"{made}/kind=1")
    n = shared.count()
    ws.drop("multi")
    owners = heads.groupBy("id").agg(F.max(F.struct("doc_id", "text_hash")).alias("row"))
    weights = ws.table(shared.groupBy("id").agg(F.count("*").alias("w")), "weights", rows=n)
    owners = owners.hint("merge").join(weights, "id", "left_semi").select("id", F.col("row.doc_id").alias("owner"), F.col("row.text_hash").alias("owner_hash"))
    texts = _rows(docs).where(F.length("text") > 0)
    chosen = texts.hint("merge").join(owners, texts["doc_id"].eqNullSafe(owners["owner"]) & (texts["text_hash"] == owners["owner_hash"]))
    sets = ws.bucketed(_tokens(chosen, k), "sets", "id")
    members = ws.table(shared.hint("merge").join(weights, "id").select("key", "id", "w", F.col("id").alias("component")), "members0", rows=n)
    ws.drop("shared")
    tested = edges = spark.createDataFrame([], "a long, b long")
    groups = spark.createDataFrame([], "id long, component long")
    for round_ in range(STAR_ROUNDS + 1):
        pairs = _stars(members, round_) if round_ < STAR_ROUNDS else _meetings(members, sets, percent, ws)
        pairs = ws.table(pairs.hint("merge").join(tested, ["a", "b"], "left_anti"), "pairs", rows=n)
        tested = tested.unionByName(pairs)
        near = ws.table(_allowed(pairs, sets, percent), "near", rows=n) if round_ < STAR_ROUNDS else pairs
        edges = ws.table(edges.unionByName(_verify(near, sets, percent)), "links", rows=n)
        groups = components(edges, ws)
        if round_ < STAR_ROUNDS:
            members = members.drop("component").hint("merge").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
            members = ws.table(members, f"labelled{round_}", rows=n)
            spread = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
            members = ws.table(members.hint("merge").join(spread, "key", "left_semi"), f"members{round_ + 1}", rows=n)
            ws.drop(f"labelled{round_}", f"members{round_}")
            if members.isEmpty():
                break
    return heads, groups


def link_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (equal sets), component_id (the least doc_id reachable by links). Written."""
    with Workspace(docs.sparkSession, "jaccard") as ws:
        heads, groups = link_classes(docs, k, percent, ws)
        named = _class_components(heads, groups).groupBy("id", "component").agg(F.min("doc_id").alias("first"))
        named = ws.table(named, "named")
        least = named.groupBy("component").agg(F.min("first").alias("least"))
        named = named.hint("merge").join(least, "component").select("id", "least")
        some = heads.where("id is not null").hint("merge").join(named, "id")
        none = heads.where("id is null").withColumn("least", F.col("doc_id"))
        out = some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("least").alias("component_id"))
        return ws.table(out, "result", keep=True)


def _class_components(heads: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with words, and the component of each: its class, if that links with no other."""
    return heads.where("id is not null").hint("merge").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: that of the least doc_id (null last), and of rows that repeat both
    doc_id and text any one. Rows without words all stay."""
    with Workspace(docs.sparkSession, "jaccard") as ws:
        heads, groups = link_classes(docs, k, percent, ws)
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        rows = _class_components(heads, groups).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("times"))
        first = rows.groupBy("component").agg(F.min(order).alias("row"), F.min_by("times", order).alias("times"))
        empty = heads.where("id is null").select("doc_id", "text_hash").distinct().withColumn("times", F.lit(1).cast("long"))
        first = first.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"), "times").unionByName(empty)
        first = ws.table(first, "first", keep=True)
        repeated = not first.where("times > 1").isEmpty()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"))
    kept = rows.hint("merge").join(first, rows["own_id"].eqNullSafe(first["doc_id"]) & (rows["own_hash"] == first["text_hash"]))
    if repeated:
        kept = kept.where("times = 1").unionByName(kept.where("times > 1").dropDuplicates(["own_id", "own_hash"]))
    return kept.select("document.*")
