"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix array here holds locally chosen suffixes: in every window of 200 bytes the least 8-byte gram among its first 128
places is an anchor, so equal strings of 200 bytes have an anchor at the same distance from their start, whatever stands
around them, and share the 72 bytes from it on. An array is a table sorted by those: by their first eight bytes, then by a
digest of all 72. Suffixes that agree in them are one entry with their number and the place of one.

The corpus comes in batches. A batch gets such an array, which is merge-scanned with each array that is there already
(both lie sorted and dealt out alike, so nothing is shuffled): an entry that is found, or that occurs twice in the batch,
is a hit. Then it becomes a level itself, and two levels of one size class merge into the next, so n batches leave at most
log2(n) + 1 levels.

Suffixes that begin like a hit are then compared by the up to 327 bytes of their text around the anchor, which hold every
window of 200 bytes that contains the 72. Those that agree in all of them are a class, known by a digest, and wholly
repeated; one member of a class is read from the texts and its windows are compared with those of the other classes of its
hit, by a 64-bit hash with random coefficients at every offset. Classes of one hit meet in blocks of a bounded number; of a
hit with more blocks than one, the distinct windows of each block are counted once more over all blocks. What is marked is
a property of the whole input: overlaps count, and nothing depends on the order of the batches.

Suffixes are equal by 128 bits of digests. A text is found again by doc_id and a hash of it together, and what is read
there is checked against the digest.

Defined results: a null text is empty; rows that repeat, and equal texts, are copies of each other and go wholly if they
have the length; texts shorter than it have no repeats; an empty table gives no rows. Very long texts are hashed one at a
time; their anchors and spans are one row each text. Other columns pass through `remove` unread, whatever their names; it
drops rows of which nothing is left (but not rows that were empty), and with a character that a cut falls into all its
bytes go. `dedup_report` counts bytes as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace
from braidlake.llm.words import byte_chunks, mix, text_bytes

LENGTH = 200
#: An anchor's place among a window's first bytes, and the bytes from it on that any such window holds.
REACH, GRAM = 128, 8
PREFIX = LENGTH - REACH
#: Batches of a one-shot run.
BATCHES = 4
#: Classes of a hit that are compared at once; those of larger hits meet in blocks.
AT_ONCE = 1 << 17

_COEFFICIENTS = mix(np.arange(1, LENGTH + REACH + 64, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: Places of the eight-byte words, from the anchor, that make up the context; the last two overlap in a byte.
_AROUND = np.array([*range(1 - REACH, LENGTH - 8, 8), LENGTH - 8])


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with zeros around each, where each begins, and how long it is."""
    data, at = text_bytes(column)
    size, gap = np.diff(at), REACH + LENGTH + GRAM
    begin = at[:-1] + gap * np.arange(len(size)) + REACH
    out = np.zeros(len(data) + gap * (len(size) + 1), np.uint8)
    for b, i, j in zip(begin.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[b : b + j - i] = data[i:j]
    return out, begin, size


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    w = np.concatenate((data, np.zeros(GRAM, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):
        w[:-k] |= w[k:] << np.uint64(8 * k)
    return w[: len(data)]


def gram_order(w: np.ndarray) -> np.ndarray:
    """The numbers by which grams are compared; none is 0."""
    h = (w ^ (w >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def anchors(w: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all anchors of padded texts."""
    n = len(w)
    starts = np.zeros(n + 1, np.int32)
    long_ = np.flatnonzero(size >= LENGTH)
    if not len(long_):
        return np.zeros(0, np.int64)
    np.add.at(starts, begin[long_], 1)
    np.add.at(starts, begin[long_] + size[long_] - LENGTH + 1, -1)
    begins = np.cumsum(starts[:n]) > 0
    h = gram_order(w)
    least = np.concatenate((h, np.full(REACH, 0xFFFFFFFF, np.uint32)))
    k = 1
    while k < REACH:
        least[:-k] = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.where(begins, least[:n], np.uint32(0))
    best = np.concatenate((np.zeros(REACH, np.uint32), least))
    k = 1
    while k < REACH:
        best[k:] = np.maximum(best[k:], best[:-k].copy())
        k *= 2
    return np.flatnonzero(best[REACH:] == h)


def digests(w: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the words at each place and these offsets."""
    out = np.zeros(len(places), np.uint64)
    for i in range(0, len(places), 1 << 14):
        part = places[i : i + (1 << 14), None] + offsets
        out[i : i + (1 << 14)] = mix(w[part] + _COEFFICIENTS[: len(offsets)]).sum(axis=1)
    return mix(out + np.uint64(len(offsets)))


def context_digests(w: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of all bytes around each place, `left` before it and `right` from it on; what lies further off is 0 in w's bytes."""
    return mix(digests(w, places, _AROUND) ^ mix((left * 4096 + right).astype(np.uint64)))


_ENTRY = "head long, key long, ctx long, doc_id long, row long, pos int, right int, batch int"


def suffix_entries(texts: DataFrame, batches: int) -> DataFrame:
    """The suffixes of (doc_id, text, row) at anchors: first eight bytes in order, digest of the first 72, digest of all around."""
    names = [c.split()[0] for c in _ENTRY.split(", ")]

    def entries(stream):
        for whole in stream:
            for b in byte_chunks(whole, 1, 2 << 20):
                data, begin, size = padded(b.column(1))
                w = words8(data)
                places = anchors(w, begin, size)
                row = np.searchsorted(begin, places, side="right") - 1
                left, right = np.minimum(places - begin[row], REACH - 1), np.minimum(begin[row] + size[row] - places, LENGTH)
                head = (w[places].byteswap() ^ np.uint64(1 << 63)).view(np.int64)
                key, ctx = digests(w, places, np.arange(0, PREFIX, 8)), context_digests(w, places, left, right)
                at = pa.array(row)
                ids = b.column(2).take(at)
                batch = (ids.to_numpy().view(np.uint64) % np.uint64(batches)).astype(np.int32)
                columns = [pa.array(head), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), b.column(0).take(at), ids]
                columns += [pa.array(x.astype(np.int32)) for x in (places - begin[row], right, batch)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.where(F.octet_length("text") >= LENGTH).select("doc_id", "text", "row").mapInArrow(entries, _ENTRY)


class SuffixFamily:
    """Levels of suffix arrays; appending a batch merges levels of equal size classes."""

    def __init__(self, ws: Workspace):
        self.ws, self.levels, self.made = ws, [], 0  # (size class, name, table), largest first

    def _array(self, entries: DataFrame, number) -> tuple[str, DataFrame]:
        """Sorted by the suffixes' first bytes; equal beginnings are one entry with their number and the place of one."""
        array = entries.groupBy("head", "key").agg(number.alias("n"), F.min("row").alias("row"), F.min_by("pos", "row").alias("pos"))
        self.made += 1
        name = f"level{self.made}"
        return name, self.ws.bucketed(array, name, "head", "key", dealt=True)

    def append(self, entries: DataFrame) -> DataFrame:
        """Adds the suffixes of a batch; returns the keys of those that occur at another place too, there or in any level. Written."""
        name, new = self._array(entries, F.count("*"))
        hits = new.where("n > 1").select("key")
        for _, _, level in self.levels:
            hits = hits.unionByName(new.hint("merge").join(level.select("head", "key"), ["head", "key"], "left_semi").select("key"))
        hits = self.ws.table(hits, "hits")
        self.levels.append((0, name, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, first), (_, b, second) = self.levels.pop(), self.levels.pop()
            name, merged = self._array(first.unionByName(second), F.sum("n"))
            self.ws.drop(a, b)
            self.levels.append((size + 1, name, merged))
        return hits


def _contexts(texts: DataFrame) -> DataFrame:
    """(key, ctx, block, blocks, left, context) of (doc_id, text, row, anchors), where the bytes around an anchor have its digest."""

    def rows(stream):
        last = None
        for whole in stream:
            for b in byte_chunks(whole, 1, 1 << 20):
                same = []
                for name in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    same.append(name == last)  # rows that repeat come one after another
                    last = name
                b = b.filter(pa.array([not x for x in same]))
                data, begin, size = padded(b.column(1))
                w, blob = words8(data), data.tobytes()
                row = np.repeat(np.arange(b.num_rows), [len(a) for a in b.column(3)])
                flat = b.column(3).flatten()
                key, ctx, pos, blocks = (flat.field(k).to_numpy() for k in range(4))
                ok = pos < size[row]
                row, key, ctx, pos, blocks = (x[ok] for x in (row, key, ctx, pos, blocks))
                place = begin[row] + pos
                left, right = np.minimum(pos, REACH - 1), np.minimum(size[row] - pos, LENGTH)
                ok = context_digests(w, place, left, right).view(np.int64) == ctx
                key, ctx, blocks, place, left, right = (x[ok] for x in (key, ctx, blocks, place, left, right))
                context = pa.array([blob[i:j] for i, j in zip((place - left).tolist(), (place + right).tolist(), strict=True)], pa.binary())
                block = (ctx.view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)
                columns = [pa.array(key), pa.array(ctx), pa.array(block), pa.array(blocks), pa.array(left.astype(np.int32)), context]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ctx", "block", "blocks", "left", "context"])

    return texts.select("doc_id", "text", "row", "anchors").mapInArrow(rows, "key long, ctx long, block long, blocks long, left int, context binary")


def _grid(left: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts below each other, anchors in one column, and the bytes from the anchor on that each has."""
    grid, right = np.zeros((len(left), REACH - 1 + LENGTH), np.uint8), np.zeros(len(left), np.int64)
    for i, (c, skip) in enumerate(zip(contexts, (REACH - 1 - left).tolist(), strict=True)):
        grid[i, skip : skip + len(c)] = np.frombuffer(c, np.uint8)
        right[i] = len(c) - left[i]
    return grid, right


def designated(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The offsets before the anchor, first and last, of the windows among whose first places the anchor's gram is a least one."""
    m, zero = len(grid), REACH - 1
    first, last = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i in range(0, m, 1024):
        part = grid[i : i + 1024]
        w = words8(part.ravel()).reshape(part.shape)[:, : zero + REACH]
        h = gram_order(w)
        less = h < h[:, zero : zero + 1]
        before, after = less[:, :zero][:, ::-1], less[:, zero + 1 :]
        last[i : i + 1024] = np.where(before.any(axis=1), before.argmax(axis=1), REACH - 1)
        first[i : i + 1024] = np.where(after.any(axis=1), REACH - 1 - after.argmax(axis=1), 0)
    return first, last


def repeats(key: np.ndarray, left: np.ndarray, contexts: list[bytes], more: bool = False):
    """The least and the greatest offset before the anchor at which each row's window occurs in another row too, -1 if none.

    more: also the distinct windows at offsets for which their anchor is designated: hash, offset, one row, in how many rows.
    """
    grid, right = _grid(left, contexts)
    m, width = grid.shape
    if more:
        first, last = designated(grid)
    grid = np.ascontiguousarray(grid.T)
    c, zero = _COEFFICIENTS[:width], REACH - 1
    low, high, windows = np.full(m, -1, np.int64), np.full(m, -1, np.int64), []
    v = mix(key.view(np.uint64))
    for i in range(zero, zero + LENGTH):
        v = v + grid[i] * c[i]
    for o in range(REACH):
        can = (left >= o) & (right >= LENGTH - o)
        rows = np.flatnonzero(can & (first <= o) & (last >= o) if more else can)
        if len(rows):
            order = rows[np.argsort(v[rows])]
            new = np.concatenate(([True], v[order[1:]] != v[order[:-1]]))
            number = np.diff(np.append(np.flatnonzero(new), len(order)))
            hit = order[np.repeat(number, number) > 1]
            high[hit] = o
            low[hit[low[hit] < 0]] = o
            if more:
                windows.append((mix(v[order[new]] + _COEFFICIENTS[o]), np.full(len(number), o), order[new], number))
        if o + 1 < REACH:
            v = v + grid[zero - o - 1] * c[zero - o - 1] - grid[zero - o + LENGTH - 1] * c[zero - o + LENGTH - 1]
    return low, high, windows


_FOUND = "kind int, key long, ctx long, low int, high int, window long, n long"


def _compared(contexts: DataFrame) -> DataFrame:
    """Of classes with windows that occur in others of their block: offsets (kind 0). Of blocks that are not the only one of
    their hit: all distinct windows (kind 1), with the class of those that occur once."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def batch(kind, key, ctx, low, high, window, n):
        columns = [pa.array(np.full(len(key), kind, np.int32)), pa.array(key), ctx, *(pa.array(x.astype(np.int32)) for x in (low, high)), window, pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def compared(table: pa.Table):
        key, ctx, block, blocks, left = (table.column(k).to_numpy() for k in range(5))
        context = table.column(5).to_pylist()
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        split = np.flatnonzero(blocks[np.concatenate(([0], edges))] > 1).tolist()
        spans = list(zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True))
        alone = np.ones(len(key), bool)
        for i, j in (spans[k] for k in split):
            alone[i:j] = False
        parts = [(np.flatnonzero(alone), False)] + [(np.arange(*spans[k]), True) for k in split]
        for rows, more in parts:
            if not len(rows):
                continue
            low, high, windows = repeats(key[rows], left[rows].astype(np.int64), [context[i] for i in rows.tolist()], more)
            hit = rows[high >= 0]
            none = pa.nulls(len(hit), pa.int64())
            yield batch(0, key[hit], pa.array(ctx[hit]), low[high >= 0], high[high >= 0], none, np.zeros(len(hit), np.int64))
            for window, o, row, n in windows:
                own = pa.array(ctx[rows[row]], mask=n > 1)
                yield batch(1, key[rows[row]], own, o, o, pa.array(window.view(np.int64)), n)

    def rows(stream):
        held, n = [], 0
        for b in stream:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= AT_ONCE:
                table = pa.Table.from_batches(held)
                key, block = table.column(0).to_numpy(), table.column(2).to_numpy()
                whole = int(np.argmax((key == key[-1]) & (block == block[-1])))  # the last group may go on
                if whole:
                    yield from compared(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                n -= whole
        if n:
            yield from compared(pa.Table.from_batches(held))

    return contexts.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(rows, _FOUND)


def find_repeats(docs: DataFrame, ws: Workspace, batches: int = BATCHES, keep: bool = True) -> DataFrame:
    """(doc, row, spans): of each text with repeated parts, the doc_id, the hash of both and the parts. Written."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))
    made = ws.write(suffix_entries(texts, batches), "entries", by="batch")
    entries = spark.read.schema(_ENTRY).parquet(made)
    family, hits = SuffixFamily(ws), None
    for k in range(batches):
        found = family.append(entries.where(F.col("batch") == k))
        hits = found if hits is None else hits.unionByName(found)
    ws.drop(*[name for _, name, _ in family.levels])
    hits = ws.table(hits.distinct(), "keys")
    suffixes = entries.select("key", "ctx", "doc_id", "row", "pos", "right").hint("merge").join(hits, "key", "left_semi")
    suffixes = ws.table(suffixes, "suffixes")
    ws.drop("entries", "hits", "keys")
    classes = suffixes.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min_by("doc_id", "row").alias("doc_id"), F.min_by("pos", "row").alias("pos"))
    classes = ws.table(classes, "classes")
    mixed = classes.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    mixed = mixed.select("key", F.ceil(F.col("m") / AT_ONCE).alias("blocks"))
    members = classes.hint("merge").join(mixed, "key").select("doc_id", "row", F.struct("key", "ctx", "pos", "blocks").alias("a"))
    wanted = members.groupBy(F.col("doc_id").alias("doc"), F.col("row").alias("in_row")).agg(F.collect_list("a").alias("anchors"))
    same = texts["doc_id"].eqNullSafe(wanted["doc"]) & (texts["row"] == wanted["in_row"])
    found = ws.write(_compared(_contexts(texts.hint("merge").join(wanted, same))), "found", by="kind")
    found = spark.read.schema(_FOUND).parquet(found)
    ranges = found.where("kind = 0").select("key", "ctx", "low", "high")
    windows = found.where("kind = 1")
    again = windows.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window")
    ranges = ranges.unionByName(windows.where("ctx is not null").hint("merge").join(again, "window", "left_semi").select("key", "ctx", "low", "high"))
    ranges = ranges.groupBy("key", "ctx").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    once = classes.where("n = 1").select("key", "ctx").hint("merge").join(ranges, ["key", "ctx"])
    marks = once.unionByName(classes.where("n > 1").select("key", "ctx", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high")))
    high = F.coalesce("high", F.least("pos", F.lit(REACH - 1)))
    low = F.coalesce("low", F.greatest(F.lit(0), LENGTH - F.col("right")))
    span = F.struct((F.col("pos") - high).alias("start"), (F.col("pos") - low + LENGTH).alias("end"))
    marked = suffixes.hint("merge").join(marks, ["key", "ctx"])
    spans = marked.groupBy(F.col("doc_id").alias("doc"), "row").agg(F.collect_set(span).alias("spans"))
    return ws.table(spans, "spans", keep=keep)


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the bytes, and the maximal runs that were removed."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)), [tuple(r) for r in runs]


def _cut(text: str | None, spans) -> tuple[bytes, list[tuple[int, int]], int]:
    data = (text or "").encode()
    kept, runs = cut_out(data, [(s["start"], s["end"]) for s in spans or ()])
    return kept, runs, len(data)


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The columns of docs, and last the parts of each text."""
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(columns.alias("document"), F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("own_row"))
    joined = rows.hint("merge").join(spans, rows["own_id"].eqNullSafe(spans["doc"]) & (rows["own_row"] == spans["row"]), "left")
    name = "spans"
    while name in map(str.lower, docs.columns):
        name += "_"
    return joined.select("document.*", F.col("spans").alias(name))


def dedup_report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, runs and kept_sha256 of every document."""
    with Workspace(docs.sparkSession, "suffix") as ws:
        spans = find_repeats(docs, ws, batches)
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(stream):
        for whole in stream:
            for b in byte_chunks(whole, 1):
                cuts = [_cut(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                ints = [[n for _, _, n in cuts], [n - len(k) for k, _, n in cuts], [len(r) for _, r, _ in cuts]]
                runs = pa.array([[{"start": i, "end": j} for i, j in r] for _, r, _ in cuts], run)
                columns = [b.column(0), *(pa.array(x, pa.int64()) for x in ints), runs, pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in cuts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "runs", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, runs array<struct<start:bigint,end:bigint>>, kept_sha256 string"
    return _joined(docs.select("doc_id", "text"), spans).mapInArrow(rows, schema)


def remove(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with the repeated parts cut out of text; documents of which nothing is left go. All other columns stay."""
    with Workspace(docs.sparkSession, "suffix") as ws:
        spans = find_repeats(docs, ws, batches)
    joined = _joined(docs, spans)
    at, last, names = docs.columns.index("text"), len(docs.columns), list(docs.columns)

    def rows(stream):
        for whole in stream:
            for b in byte_chunks(whole, at):
                cuts = b.column(last).is_valid()
                texts = [_cut(t, s)[0].decode(errors="ignore") if cut else t for t, s, cut in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), cuts.to_pylist(), strict=True)]
                stays = pa.array([not cut or bool(t) for t, cut in zip(texts, cuts.to_pylist(), strict=True)], pa.bool_())
                columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(last)]
                yield pa.RecordBatch.from_arrays(columns, names).filter(stays)

    return joined.mapInArrow(rows, docs.schema)
