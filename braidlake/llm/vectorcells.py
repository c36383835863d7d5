"""Near-duplicate vectors through cells around sampled hubs, for each label, searched by blocks of vectors at once.

This takes the place of small-world graphs walked by beams: in numpy a walk of many queries in step costs more than fifty
times the products with a whole shard that it saves (README has the figures), so a label has no graph but two layers: hubs (a
bounded sample of its classes by hash), and all its classes, each in the cell of its nearest hub. Equal vectors of a label are
one class with a count. Every class is a query: it is compared with all hubs, and with the cells of every hub within a margin
of its nearest one. An audit sets the margin: sampled classes are turned by just the greatest angle that still links, at
random and towards other classes, and the margin is what leads from all but a few of these to the hub of the class, and back.
Labels of more than SHARD classes lie in files of some cells each, which blocks of queries read in turn.

A pair counts for both of its classes if either leads to the other: who finds it looks whether the other would find it too,
and counts for both if not. Whether a class follows a hub is decided in double precision where single precision leaves a
doubt, so both ends decide alike.

Links are verified in double precision where single precision leaves a doubt. A block returns sums of links and the edges of
a spanning forest of what it linked, never all pairs of a group.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without a label, have no
links and are kept; rows that repeat are links of each other; labels may be of any type that can be written as text; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.llm._common import Workspace, file_system, write_file
from braidlake.llm.components import components

COSINE = 0.93
#: Classes of a file, and of a block of queries.
SHARD, BLOCK = 8_192, 16_384
#: A label of n classes has sqrt(SPREAD * n) hubs, up to so many and so many bytes.
SPREAD, HUBS, HUB_BYTES = 16, 8_192, 1 << 25
#: The audit: so many classes beside the hubs, and the part of the hardest links that must be followed from either end.
AUDITED, RECALL = 512, 0.995
#: Hubs that a block follows in one pass over the files, elements of a product, and edges held before they become a forest.
FOLLOWED, PRODUCT, EDGES = 1_000_000, 1 << 19, 100_000


def hub_count(n: int, d: int) -> int:
    return max(1, min(n, int((SPREAD * n) ** 0.5), HUBS, HUB_BYTES // (4 * max(1, d))))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over a power of two that leaves their components below 1: their squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of scaled ones."""
    out = np.empty(vectors.shape, np.float32)
    for i in range(0, len(out), 2048):
        v = vectors[i : i + 2048]
        norms = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
        np.multiply(v, (1 / norms).astype(np.float32)[:, None], out=out[i : i + 2048], casting="same_kind")
    return out


def pack(column: pa.Array, double: bool) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists of numbers and their bytes after scaling; none for those that can link with nothing."""
    kind = np.dtype("<f8" if double else "<f4")
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int32)
    out = np.empty(len(lengths), object)
    for d in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == d)
        v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)  # null: not a number
        usable = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
        data, size = _scaled(v[usable]).tobytes(), d * kind.itemsize
        out[at[usable]] = [data[i : i + size] for i in range(0, len(data), size)]
    return lengths, pa.array(out, pa.binary())


def _matrix(column, at: np.ndarray, d: int) -> np.ndarray:
    """Those rows of a column of d packed numbers each."""
    data = column.take(pa.array(at)).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.take(pa.array(at))
    width = len(data[0].as_buffer()) if len(data) else 4 * d
    begin = np.frombuffer(data.buffers()[1], np.int32, 1, 4 * data.offset)[0] if len(data) else 0
    return np.frombuffer(data.buffers()[2], f"<f{width // d}", len(at) * d, begin).reshape(len(at), d)


def audit(hubs: np.ndarray, sample: np.ndarray, cosine: float, recall: float = RECALL) -> float:
    """The margin that leads from a sampled unit vector's hardest links to its hub, and from it to theirs."""
    if len(sample) < 64:
        return 4.0
    rng, x, far = np.random.default_rng(6), sample.astype(np.float64), (1 - cosine * cosine) ** 0.5
    scores = sample @ hubs.T
    home, top, row, margins = scores.argmax(axis=1), scores.max(axis=1), np.arange(len(x)), []
    for aside in (rng.normal(size=x.shape), np.roll(x, 1, axis=0), -np.roll(x, len(x) // 2, axis=0)):
        aside = aside - (aside * x).sum(axis=1, keepdims=True) * x
        aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-12)
        turned = (cosine * x + far * aside).astype(np.float32) @ hubs.T
        margins += [turned.max(axis=1) - turned[row, home], top - scores[row, turned.argmax(axis=1)]]
    return max(float(np.quantile(m, recall)) for m in margins) + 1e-5


def layer(vectors: np.ndarray, ids: np.ndarray, n: int, cosine: float) -> tuple[np.ndarray, float]:
    """Unit vectors of the hubs of n classes and the margin, from all of the classes or a sample by hash."""
    order = np.argsort(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    k = min(hub_count(n, vectors.shape[1]), len(order))
    hubs = _unit(vectors[order[:k]])
    return hubs, audit(hubs, _unit(vectors[order[k : k + AUDITED]]), cosine)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, the same whatever rows they stand among."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=1)


#: Single precision may err by less on products of unit vectors.
DOUBT = 1e-5


def homes(unit: np.ndarray, hubs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest hub of each unit vector, and the score with it."""
    step, home, top = max(16, PRODUCT // len(hubs)), [], []
    for i in range(0, len(unit), step):
        part = unit[i : i + step]
        home.append((part @ hubs.T).argmax(axis=1).astype(np.int32))
        top.append(exact(part, hubs[home[-1]]))
    return np.concatenate(home), np.concatenate(top)


def passes(unit: np.ndarray, top: np.ndarray, hubs: np.ndarray, margin: float):
    """The hubs that queries follow, as (queries sorted by hub, where each hub's begin), a bounded number at a time."""
    step, whole, queries, followed, n = max(16, PRODUCT // len(hubs)), hubs.T.copy(), [], [], 0
    for i in range(0, len(unit), step):
        scores, least = unit[i : i + step] @ whole, top[i : i + step, None] - margin
        q, h = np.divmod(np.flatnonzero(scores >= (least - DOUBT).astype(np.float32)), len(hubs))
        unsure = np.flatnonzero(scores[q, h] < least[q, 0] + DOUBT)
        keep = np.ones(len(q), bool)
        for k in range(0, len(unsure), 20_000):
            u = unsure[k : k + 20_000]
            keep[u] = exact(unit[q[u] + i], hubs[h[u]]) >= least[q[u], 0]
        q, h = q[keep], h[keep]
        queries.append((q + i).astype(np.int32))
        followed.append(h.astype(np.uint16))
        n += len(q)
        if n > FOLLOWED or i + step >= len(unit):
            h = np.concatenate(followed)
            order = np.argsort(h, kind="stable")
            yield np.concatenate(queries)[order], np.concatenate([[0], np.cumsum(np.bincount(h, minlength=len(hubs)))])
            queries, followed, n = [], [], 0


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the edges as connect what all of them connect: components hook onto a lower neighbour in rounds."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, kept = at[: len(a)], at[len(a) :], []
    label, edge = np.arange(len(nodes)), np.arange(len(a))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = np.flatnonzero(low != high)
        if not len(apart):
            break
        apart = apart[np.argsort(-low[apart], kind="stable")]
        x, y, edge, low, high = x[apart], y[apart], edge[apart], low[apart], high[apart]
        last = np.full(len(nodes), -1)
        last[high] = np.arange(len(high))  # the lowest neighbour is written last
        chosen = last[last >= 0]
        kept.append(edge[chosen])
        up = np.arange(len(nodes))
        up[high[chosen]] = low[chosen]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a[kept], b[kept]


class Links:
    """Sums of links of a block of queries, and a forest of these links."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray, home: np.ndarray, top: np.ndarray, hubs: np.ndarray, margin: float, cosine: float):
        self.vectors, self.unit, self.ids, self.counts, self.home, self.top = vectors, _unit(vectors), ids, counts, home, top
        self.hubs, self.margin, self.cosine = hubs, margin, cosine
        self.sums, self.a, self.b, self.held = np.zeros(len(ids)), [], [], 0
        self.others, self.other_links = [], []

    def follow(self, queries: np.ndarray, vectors: np.ndarray, unit: np.ndarray, ids: np.ndarray, counts: np.ndarray, tops: np.ndarray) -> None:
        """Compares queries with the classes of a cell."""
        doubt, n = 1e-4 + 1.2e-7 * unit.shape[1], len(unit)
        for i in range(0, n, PRODUCT):
            part = slice(i, min(n, i + PRODUCT))
            other, step = unit[part].T, max(1, PRODUCT // (part.stop - i))
            for k in range(0, len(queries), step):
                q = queries[k : k + step]
                scores = (self.unit[q] @ other).ravel()
                hits = np.flatnonzero(scores >= np.float32(self.cosine - doubt))
                if not len(hits):
                    continue
                near, (at, j) = scores[hits], np.divmod(hits, part.stop - i)
                at, j = q[at], j + i
                take = self.ids[at] != ids[j]
                unsure = np.flatnonzero(take & (near < self.cosine + doubt))
                for s in range(0, len(unsure), 10_000):
                    u = unsure[s : s + 10_000]
                    v, w = self.vectors[at[u]].astype(np.float64), vectors[j[u]].astype(np.float64)
                    take[u] = (v * w).sum(axis=1) / np.sqrt((v * v).sum(axis=1) * (w * w).sum(axis=1)) >= self.cosine
                at, j = at[take], j[take]
                if len(at):
                    np.add.at(self.sums, at, counts[j])
                    back = np.concatenate([exact(unit[j[s : s + 20_000]], self.hubs[self.home[at[s : s + 20_000]]]) for s in range(0, len(at), 20_000)])
                    alone = back < tops[j] - self.margin  # the other end does not lead here
                    if alone.any():
                        self.others.append(ids[j[alone]])
                        self.other_links.append(self.counts[at[alone]])
                    self.a.append(self.ids[at])
                    self.b.append(ids[j])
                    self.held += len(at)
                    if self.held > EDGES:
                        self._shrink()

    def _shrink(self) -> None:
        if self.a:
            a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.held = [a], [b], 0
        if self.others:
            ids, at = np.unique(np.concatenate(self.others), return_inverse=True)
            self.others, self.other_links = [ids], [np.bincount(at, np.concatenate(self.other_links)).astype(np.int64)]

    def rows(self) -> tuple[list, list, list]:
        """id, links and other: links of an id, or an edge."""
        self._shrink()
        linked = np.flatnonzero(self.sums)
        a, b = (self.a[0].tolist(), self.b[0].tolist()) if self.a else ([], [])
        more, links = (self.others[0].tolist(), self.other_links[0].tolist()) if self.others else ([], [])
        counted = self.ids[linked].tolist() + more
        return counted + a, self.sums[linked].astype(np.int64).tolist() + links + [None] * len(a), [None] * len(counted) + b


def search_label(vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray, cosine: float) -> Links:
    """All links of a label whose classes are at hand."""
    hubs, margin = layer(vectors, ids, len(ids), cosine)
    home, top = homes(_unit(vectors), hubs)
    links = Links(vectors, ids, counts, home, top, hubs, margin, cosine)
    unit = links.unit
    below = np.argsort(home, kind="stable")
    begin = np.searchsorted(home[below], np.arange(len(hubs) + 1))
    for queries, starts in passes(unit, top, hubs, margin):
        for h in np.flatnonzero((np.diff(starts) > 0) & (np.diff(begin) > 0)).tolist():
            at = below[begin[h] : begin[h + 1]]
            links.follow(queries[starts[h] : starts[h + 1]], vectors[at], unit[at], ids[at], counts[at], top[at])
    return links


def _save(path: str, **parts: np.ndarray) -> None:
    head = json.dumps([(k, v.dtype.str, v.shape) for k, v in parts.items()]).encode()
    write_file(path, [len(head).to_bytes(8, "little"), head, *(np.ascontiguousarray(v).tobytes() for v in parts.values())])


def _load(path: str) -> dict[str, np.ndarray]:
    fs, path = file_system(path)
    with fs.open_input_stream(path, compression=None) as f:
        data = f.read()
    at, parts = 8 + int.from_bytes(data[:8], "little"), {}
    for k, kind, shape in json.loads(data[8:at]):
        parts[k] = np.frombuffer(data, kind, math.prod(shape), at).reshape(shape)
        at += parts[k].nbytes
    return parts


def _place(folder: str, label: str, d: int, shard: int | str) -> str:
    return f"{folder}/{hashlib.sha1(label.encode()).hexdigest()}-{d}-{shard}"


def search_block(folder: str, label: str, d: int, shards: list[int], asked: list[int], cosine: float) -> Links:
    """The links of the classes of some shards of a label among all of its shards."""
    above = _load(_place(folder, label, d, "hubs"))
    own = [_load(_place(folder, label, d, s)) for s in asked]
    parts = [np.concatenate([p[name] for p in own]) for name in ("vectors", "ids", "counts", "home", "top")]
    del own
    links = Links(*parts, above["hubs"], above["margin"][0], cosine)
    for queries, starts in passes(links.unit, links.top, above["hubs"], above["margin"][0]):
        for s in shards:
            lo, hi = np.searchsorted(above["shards"], [s, s + 1])
            if starts[lo] == starts[hi]:
                continue
            p = _load(_place(folder, label, d, s))
            unit, begin = _unit(p["vectors"]), np.searchsorted(p["home"], np.arange(lo, hi + 1))
            for h in np.flatnonzero((np.diff(starts[lo : hi + 1]) > 0) & (np.diff(begin) > 0)).tolist():
                at = slice(begin[h], begin[h + 1])
                links.follow(queries[starts[lo + h] : starts[lo + h + 1]], p["vectors"][at], unit[at], p["ids"][at], p["counts"][at], p["top"][at])
    return links


FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label). Written."""
    spark, double = rows.sparkSession, dict(rows.dtypes)["embedding"] != "array<float>"
    shard_rows, block_shards = SHARD, max(1, BLOCK // SHARD)
    with Workspace(spark, "vectors") as ws:
        rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>" if double else "array<float>"))
        kinds = [rows.schema["vec_id"], *T.StructType().add("label", "string").add("d", "integer").add("vector", "binary")]

        def packed(batches):
            for b in batches:
                d, vector = pack(b.column("embedding"), double)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(d), vector], ["vec_id", "label", "d", "vector"])

        name = F.when(F.col("label").isNotNull() & F.col("vector").isNotNull(), F.xxhash64("label", "vector")).alias("id")
        whole = ws.table(rows.mapInArrow(packed, T.StructType(kinds)).select("vec_id", name, "label", "d", "vector"), "packed")
        named = ws.table(whole.select("vec_id", "id"), "named")
        classes = ws.table(whole.where("id is not null").groupBy("id", "label", "d", "vector").agg(F.count("*").alias("c")), "classes")
        ws.drop("packed")
        counts = ws.table(classes.select("id", "c"), "counts")
        sizes = ws.table(classes.groupBy("label", "d").agg(F.count("*").alias("n")), "sizes")  # vectors of other lengths can't be compared
        folder = ws.path("graphs")

        def small(key, table):
            d = key[1].as_py()
            vectors = _matrix(table.column("vector"), np.arange(table.num_rows), d)
            links = search_label(vectors, table.column("id").to_numpy(), table.column("c").to_numpy(), cosine)
            return pa.table([pa.array(x, pa.int64()) for x in links.rows()], schema=FOUND)

        def sample(key, table):
            label, d, n = (k.as_py() for k in key)
            vectors = _matrix(table.column("vector"), np.arange(table.num_rows), d)
            hubs, margin = layer(vectors, table.column("id").to_numpy(), n, cosine)
            shards = np.arange(len(hubs)) * -(-n // shard_rows) // len(hubs)
            _save(_place(folder, label, d, "hubs"), hubs=hubs, margin=np.array([margin]), shards=shards)
            return pa.table({"hubs": pa.array([len(hubs)], pa.int64())})

        def link(batches):
            """Each class with its nearest hub."""
            known, size = {}, 0

            def linked(part):
                nonlocal size
                b = pa.Table.from_batches(part).combine_chunks()
                names = pc.dictionary_encode(b.column("label")).combine_chunks()
                code, ds, column = names.indices.to_numpy(), b.column("d").to_numpy(), b.column("vector")
                home, top, shard = np.zeros(len(code), np.int32), np.zeros(len(code)), np.zeros(len(code), np.int64)
                for c, d in set(zip(code.tolist(), ds.tolist(), strict=True)):
                    key = (names.dictionary[c].as_py(), d)
                    if key not in known:
                        if size > 2 * HUB_BYTES:
                            known.clear()
                            size = 0
                        above = _load(_place(folder, *key, "hubs"))
                        known[key] = above["hubs"], above["shards"]
                        size += above["hubs"].nbytes
                    hubs, shards = known[key]
                    at = np.flatnonzero((code == c) & (ds == d))
                    home[at], top[at] = homes(_unit(_matrix(column, at, d)), hubs)
                    shard[at] = shards[home[at]]
                b = b.append_column("home", pa.array(home)).append_column("top", pa.array(top)).append_column("shard", pa.array(shard))
                yield from b.to_batches(max_chunksize=1000)

            part, n = [], 0
            for b in batches:
                part.append(b)
                n += b.nbytes
                if n > 1 << 22:
                    yield from linked(part)
                    part, n = [], 0
            if part:
                yield from linked(part)

        def store(key, table):
            label, d, shard = (k.as_py() for k in key)
            home, ids = table.column("home").to_numpy(), table.column("id").to_numpy()
            order = np.lexsort((ids, home))
            vectors = _matrix(table.column("vector"), order, d)
            _save(_place(folder, label, d, shard), vectors=vectors, ids=ids[order], counts=table.column("c").to_numpy()[order], home=home[order], top=table.column("top").to_numpy()[order])
            return pa.table({"label": [label], "d": pa.array([d], pa.int32()), "shard": pa.array([shard], pa.int64())})

        def search(batches):
            for b in batches:
                for job in b.to_pylist():
                    links = search_block(folder, job["label"], job["d"], job["shards"], job["asked"], cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links.rows()], schema=FOUND)

        result = "id long, links long, other long"
        few = classes.join(sizes.where(F.col("n") <= shard_rows).drop("n"), ["label", "d"])
        found = ws.table(few.groupBy("label", "d").applyInArrow(small, result), "found")
        big = sizes.where(F.col("n") > shard_rows)
        if not big.isEmpty():
            many = classes.join(big, ["label", "d"])
            wanted = F.least(F.sqrt(SPREAD * F.col("n")), F.lit(HUBS), HUB_BYTES / (4 * F.col("d"))) + AUDITED
            sampled = many.where(F.pmod(F.xxhash64("id"), F.col("n")) < wanted).select("label", "d", "n", "id", "vector")
            ws.table(sampled.groupBy("label", "d", "n").applyInArrow(sample, "hubs long"), "hubs")
            many = many.select("label", "d", "id", "c", "vector")
            dealt = many.mapInArrow(link, f"label string, d int, id long, c long, vector binary, home int, top double, shard long")
            shards = ws.table(dealt.groupBy("label", "d", "shard").applyInArrow(store, "label string, d int, shard long"), "shards")
            ws.drop("classes")
            every = shards.groupBy("label", "d").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
            block = F.floor(F.col("shard") / block_shards).alias("block")
            asked = shards.groupBy("label", "d", block).agg(F.sort_array(F.collect_list("shard")).alias("asked"))
            jobs = ws.table(asked.join(every, ["label", "d"]).select("label", "d", "shards", "asked"), "jobs")
            spread = jobs.repartition(max(1, min(4096, jobs.count())))
            found = found.unionByName(ws.table(spread.mapInArrow(search, result), "linked"))
        groups = components(found.where("other is not null").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")), ws)
        links = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
        facts = counts.join(links, "id", "left").join(groups, "id", "left")
        facts = facts.select("id", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
        named = ws.table(named.join(facts, "id", "left"), "facts")
        least = named.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
        out_rows = named.join(least, "component", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
        return ws.table(out_rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "result", keep=True)
