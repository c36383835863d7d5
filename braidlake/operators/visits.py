"""Visits of paths to oriented nodes, in the order of what came before them, and paths kept as their first visit.

A sequence is a path read in one direction: (seq, idx, handle) with consecutive idx. The visits to a handle are ordered by
the sequence read backwards from there: first by the handle before, then by the one before that, and so on; the start of a
sequence comes before all handles, and starts are in the order of seq. `offset` is a visit's place among those to its
handle, from 0. So a sequence is known by its first (handle, offset), and equal contexts lie side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators._shared import ensure_checkpoint
from braidlake.schema import flipped_path


def both_directions(steps: DataFrame) -> DataFrame:
    """(seq, idx, handle) of all paths forwards (seq is twice the path, idx the step) and backwards (one more, minus the step)."""
    path, step, handle = F.col("path_handle"), F.col("step"), F.col("handle")
    forms = F.array(F.struct((2 * path).alias("seq"), step.alias("idx"), handle.alias("handle")), F.struct((2 * path + 1).alias("seq"), (-step).alias("idx"), handle.bitwiseXOR(F.lit(1)).alias("handle")))
    return steps.select(F.explode(forms).alias("v")).select("v.*")


#: Steps of a sequence whose prefixes one task names in a row; sequences that are ranked in a row in a class.
STEPS_AT_ONCE, SEQUENCES_AT_ONCE = 1 << 16, 1 << 20
#: Sequences of up to so many handles have their contexts written out; a task takes some sequences of up to so many visits.
HANDLES_AT_ONCE, VISITS_AT_ONCE = 512, 1 << 22
PREFIX = ["name", "check"]


def _with_prefixes(sequences: DataFrame) -> DataFrame:
    """Adds pos, the place in the sequence from 0, and (name, check): what the handles up to there are called.

    A prefix is called by the sums (xor) of 64 and 32 bits of hashes of its handles with their places. So a sequence can be
    named in bins, each with the sums of the bins before it, and a prefix less its last handle is a known sum.
    """
    ends = sequences.groupBy("seq").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    longest = ends.agg(F.max(F.col("last") - F.col("first")).alias("n")).first().n or 0
    rows = sequences.select("seq", "idx", "handle").join(ends.select("seq", "first"), "seq").withColumn("pos", F.col("idx") - F.col("first")).drop("first")
    key = ["seq"] if longest < STEPS_AT_ONCE else ["seq", "bin"]
    if len(key) > 1:
        rows = rows.withColumn("bin", F.floor(F.col("pos") / STEPS_AT_ONCE)).repartition(*key)
    upto = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumns({c: F.bit_xor(own).over(upto) for c, own in zip(PREFIX, _own("handle", "pos"), strict=True)})
    if len(key) == 1:
        return named
    before = Window.partitionBy("seq").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key).agg(*[F.bit_xor(own).alias(c) for c, own in zip(PREFIX, _own("handle", "pos"), strict=True)])
    sums = sums.select(*key, *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in PREFIX])
    return named.join(sums, key).select("seq", "idx", "handle", "pos", *[F.col(c).bitwiseXOR(F.col(f"{c}_before")).alias(c) for c in PREFIX])


def _own(handle: str, pos: str) -> list:
    return [F.xxhash64(handle, pos), F.hash(pos, handle)]


def visit_offsets(sequences: DataFrame) -> DataFrame:
    """Adds offset to (seq, idx, handle).

    Visits that all handles from the start lead to alike are a class, ordered by seq; classes are ordered by their contexts.
    Sequences of up to `HANDLES_AT_ONCE` handles are ranked as arrays (`_array_offsets`), others in rounds.
    """
    ensure_checkpoint(sequences.sparkSession)
    longest = _longest(sequences, "seq", "idx")
    if longest > min(HANDLES_AT_ONCE, STEPS_AT_ONCE):
        return _long_offsets(sequences)
    arrays = _arrays(sequences, "seq", "idx", "handle").select("seq", F.col("own")[0]["idx"].alias("first"), F.col("own.handle").alias("handles"))
    found = _array_offsets(arrays.select("seq", "handles"), longest).join(arrays, "seq")
    rows = found.select("seq", "first", F.posexplode(F.arrays_zip("handles", "offsets")).alias("k", "v"))
    return rows.select("seq", (F.col("first") + F.col("k")).alias("idx"), F.col("v.handles").alias("handle"), F.col("v.offsets").alias("offset"))


def _longest(rows: DataFrame, key: str, order: str) -> int:
    """How many rows the longest sequence has."""
    return rows.groupBy(key).agg((F.max(order) - F.min(order) + 1).alias("n")).agg(F.max("n").alias("n")).first().n or 0


def _arrays(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, own): the rows of each key as an array of columns, in the order of the first of them."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("own"))


def _array_offsets(arrays: DataFrame, longest: int) -> DataFrame:
    """(seq, offsets) of (seq, handles): the places of a sequence's visits, as an array.

    Sequences that follow each other by seq are a part, and one task's. A class has one row for each part that it is in: its
    context, which is its handles read backwards, and how many visits it has there; so copies in a part add no rows. A
    class in a part begins after the visits to its handle that smaller contexts have, and equal ones in the parts before
    (`_places`); the visits of a part are then counted on from there. Handles are shipped as arrays, to their part alone.
    """
    width = min(SEQUENCES_AT_ONCE, max(1, VISITS_AT_ONCE // max(longest, 1)))
    parts = arrays.select(F.floor(F.col("seq") / width).alias("part"), "seq", "handles")
    pairs = parts.groupBy("part").applyInArrow(_classes_of, "handle long, context binary, part long, class int, n long")

    def counted(sequences: pa.Table, bases: pa.Table) -> pa.Table:
        base = np.zeros(bases.num_rows, np.int64)
        base[bases["class"].to_numpy()] = bases["base"].to_numpy()
        seqs, starts, handles = _in_order(sequences)
        offsets = np.empty(len(handles), np.int64)
        for _, _, at, own, _, rank, first in _levels(starts, handles):
            offsets[at] = base[first + own] + rank
        return pa.table({"seq": seqs, "offsets": pa.LargeListArray.from_arrays(starts, offsets).cast(pa.list_(pa.int64()))})

    return parts.groupBy("part").cogroup(_places(pairs).groupBy("part")).applyInArrow(counted, "seq long, offsets array<long>")


def _places(pairs: DataFrame) -> DataFrame:
    """(part, class, base): how many visits come before those of a class in a part, (handle, context, part, class, n)."""
    before = Window.partitionBy("handle").orderBy("context", "part").rowsBetween(Window.unboundedPreceding, -1)
    return pairs.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _in_order(sequences: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seqs, starts, handles): a part's sequences by seq, all their handles in a row, and where each begins there."""
    rows = sequences.select(["seq", "handles"]).sort_by("seq").combine_chunks()
    lists = rows["handles"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return rows["seq"].to_numpy(), starts, lists.flatten().to_numpy()


def _levels(starts: np.ndarray, handles: np.ndarray):
    """For each place in sequences, from 0: the (handle, parent) of the classes of visits there, parent being the number of a
    class of the place before; where the visits lie, each one's class, the visits of the classes, each visit's rank in its
    class, and how many classes places before have. Classes are numbered alike whenever a part is read."""
    lengths, first = np.diff(starts), 0
    live = np.flatnonzero(lengths > 0)
    parent, k = np.zeros(len(live), np.int64), 0
    while len(live):
        at = starts[live] + k
        known, code = np.unique(handles[at], return_inverse=True)
        classes, own, n = np.unique(parent * len(known) + code, return_inverse=True, return_counts=True)
        order = np.argsort(own, kind="stable")  # visits are by seq, and stay so in a class
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        yield known[classes % len(known)], classes // len(known), at, own, n, rank, first
        first, k = first + len(classes), k + 1
        on = lengths[live] > k
        live, parent = live[on], own[on]


def _difference(d: int) -> bytes:
    """A handle less the one after it, in bytes that are ordered as the numbers are; none begins with 0, which is the start."""
    if -100 <= d <= 100:
        return bytes((128 + d,))
    n = (abs(d).bit_length() + 7) // 8
    return bytes((240 + n,)) + d.to_bytes(n) if d > 0 else bytes((20 - n,)) + (d + (1 << 8 * n)).to_bytes(n)


def _classes_of(sequences: pa.Table) -> pa.Table:
    """The classes of a part: (handle, context, part, class, n). A context is the handles before, the last first, each as
    its difference from the one after it: of one handle, contexts in their order are visits in theirs."""
    _, starts, handles = _in_order(sequences)
    columns, contexts, before, above, known = [], [], None, None, {}
    for handle, parent, _, _, n, _, first in _levels(starts, handles):
        if before is None:
            above = [b"\0"] * len(handle)
        else:
            steps = (before[parent] - handle).tolist()
            for d in set(steps) - known.keys():
                known[d] = _difference(d)
            above = [known[d] + above[p] for d, p in zip(steps, parent.tolist(), strict=True)]
        columns.append((handle, np.arange(first, first + len(handle), dtype=np.int32), n))
        contexts.append(pa.array(above, pa.binary()))
        before = handle
    handle, number, n = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else (np.empty(0, t) for t in (np.int64, np.int32, np.int64))
    part = np.full(len(handle), sequences["part"][0].as_py(), np.int64)
    table = pa.table({"handle": handle, "context": pa.chunked_array(contexts, pa.binary()), "part": part, "class": number, "n": n})
    return pa.Table.from_batches(table.combine_chunks().to_batches(max_chunksize=1 << 14), table.schema)


def _long_offsets(sequences: DataFrame) -> DataFrame:
    """`visit_offsets` of sequences of any length: classes are ordered among themselves in rounds (`_long_places`), which
    write classes and not visits. Ranks in a class are counted bin by bin of sequences, so a handle that all sequences start
    with is no single task's.
    """
    ensure_checkpoint(sequences.sparkSession)
    rows = _with_prefixes(sequences).withColumn("some", F.floor(F.col("seq") / SEQUENCES_AT_ONCE))
    counts = rows.groupBy("handle", "pos", *PREFIX, "some").agg(F.count("*").alias("n")).checkpoint()
    earlier = Window.partitionBy(*PREFIX).orderBy("some").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*PREFIX, "some", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    bases = bases.join(_long_places(counts.groupBy("handle", "pos", *PREFIX).agg(F.sum("n").alias("n"))), PREFIX)
    bases = bases.select(*PREFIX, "some", (F.col("offset") + F.col("earlier")).alias("base"))
    among = Window.partitionBy(*PREFIX, "some").orderBy("seq")
    ranked = rows.drop("pos").withColumn("rank", F.row_number().over(among) - 1).join(bases, [*PREFIX, "some"])
    return ranked.select("seq", "idx", "handle", (F.col("base") + F.col("rank")).cast("long").alias("offset"))


def _long_places(classes: DataFrame) -> DataFrame:
    """(name, check, offset) of classes (handle, pos, name, check, n): how many visits to the handle are in smaller classes.

    After k rounds classes are told apart by the 2^k handles that end there; a round orders those still equal by the place
    that the class 2^k handles before has. A class that is told apart is settled and is written no more; the rounds are as
    many as the logarithm of the longest context that two classes share. Equal contexts are counted before they are ordered,
    so a handle is ordered by its different contexts, not by its visits.
    """
    of_handle = classes.groupBy("handle").agg((F.count("*") == 1).alias("settled"))
    # what a class goes back to: its prefix less the last handle, or nothing at the start
    back = [F.col(c).bitwiseXOR(own).alias(f"{c}_back") for c, own in zip(PREFIX, _own("handle", "pos"), strict=True)]
    columns = ["handle", "pos", *PREFIX, "n", "offset", "name_back", "check_back"]
    rows = classes.join(of_handle, "handle").select("handle", "pos", *PREFIX, "n", F.lit(0).cast("long").alias("offset"), *back, "settled").checkpoint()
    settled, active, reach = [rows.where("settled").select(columns)], rows.where("not settled").select(columns), 1
    while not active.isEmpty():
        known = active
        for part in settled:
            known = known.unionByName(part)
        before = known.select(*[F.col(c).alias(f"{c}_back") for c in PREFIX], F.col("handle").alias("handle_before"), F.col("offset").alias("offset_before"), *[F.col(f"{c}_back").alias(f"{c}_far") for c in PREFIX])
        # the context of an active class is longer than what is known of it, or ends just there
        further = active.where(F.col("pos") >= reach).join(before, ["name_back", "check_back"])
        start = active.where(F.col("pos") < reach).withColumns({"handle_before": F.lit(-1).cast("long"), "offset_before": F.lit(0).cast("long"), "name_far": F.col("name_back"), "check_far": F.col("check_back")})
        asked = further.unionByName(start)
        key = ["handle", "offset", "handle_before", "offset_before"]
        equal = asked.groupBy(*key).agg(F.sum("n").alias("visits"), (F.count("*") == 1).alias("settled"))
        smaller = Window.partitionBy("handle", "offset").orderBy("handle_before", "offset_before").rowsBetween(Window.unboundedPreceding, -1)
        equal = equal.select(*key, (F.col("offset") + F.coalesce(F.sum("visits").over(smaller), F.lit(0))).alias("place"), "settled")
        rows = asked.join(equal, key).select("handle", "pos", *PREFIX, "n", F.col("place").alias("offset"), F.col("name_far").alias("name_back"), F.col("check_far").alias("check_back"), "settled").checkpoint()
        settled.append(rows.where("settled").select(columns))
        active, reach = rows.where("not settled").select(columns), 2 * reach
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*PREFIX, "offset")


def with_offsets(steps: DataFrame) -> DataFrame:
    """Adds offset and flip_offset to steps: the places of the visits of a step forwards, and backwards at the flipped handle."""
    steps = steps.drop("offset", "flip_offset")
    longest = _longest(steps, "path_handle", "step")
    if longest <= min(HANDLES_AT_ONCE, STEPS_AT_ONCE):
        return _with_array_offsets(steps, longest)
    found = visit_offsets(both_directions(steps.select("path_handle", "step", "handle")))
    path = F.shiftright("seq", 1).alias("path_handle")
    rev = F.col("seq").bitwiseAND(F.lit(1)) == 1
    places = found.select(path, F.abs("idx").alias("step"), F.when(~rev, F.col("offset")).alias("offset"), F.when(rev, F.col("offset")).alias("flip_offset"))
    places = places.groupBy("path_handle", "step").agg(F.max("offset").alias("offset"), F.max("flip_offset").alias("flip_offset"))
    return steps.join(places, ["path_handle", "step"])


def _with_array_offsets(steps: DataFrame, longest: int) -> DataFrame:
    """`with_offsets` of short paths: a path's steps and their places meet as arrays, a row a path."""
    path, handles, columns = F.col("path_handle"), F.col("own.handle"), [c for c in steps.columns if c not in ("path_handle", "step")]
    forms = F.array(F.struct((2 * path).alias("seq"), handles.alias("handles")), F.struct((2 * path + 1).alias("seq"), flipped_path(handles).alias("handles")))
    found = _array_offsets(_arrays(steps, "path_handle", "step", "handle").select(F.explode(forms).alias("f")).select("f.*"), longest)
    rev = F.col("seq").bitwiseAND(F.lit(1)) == 1
    places = found.groupBy(F.shiftright("seq", 1).alias("path_handle")).agg(
        F.first(F.when(~rev, F.col("offsets")), True).alias("offset"), F.first(F.when(rev, F.reverse("offsets")), True).alias("flip_offset"))
    whole = _arrays(steps, "path_handle", "step", *columns).join(places, "path_handle")
    rows = whole.select("path_handle", F.explode(F.arrays_zip("own", "offset", "flip_offset")).alias("v"))
    return rows.select("path_handle", *[F.col(f"v.own.{c}").alias(c) for c in ("step", *columns)], "v.offset", "v.flip_offset")


def successors(visits: DataFrame, in_a_row: bool = False) -> DataFrame:
    """(handle, offset, next_handle, next_offset): from each visit to the next of its sequence; the last of one has no row.

    in_a_row: sequences are so short that one task may take each; visits that lie by sequence are then not moved.
    """
    if in_a_row:
        after = F.lead(F.struct("idx", "handle", "offset")).over(Window.partitionBy("seq").orderBy("idx"))
        rows = visits.select("idx", "handle", "offset", after.alias("after")).where(F.col("after.idx") == F.col("idx") + 1)
        return rows.select("handle", "offset", F.col("after.handle").alias("next_handle"), F.col("after.offset").alias("next_offset"))
    following = visits.select("seq", (F.col("idx") - 1).alias("idx"), F.col("handle").alias("next_handle"), F.col("offset").alias("next_offset"))
    return visits.join(following, ["seq", "idx"]).select("handle", "offset", "next_handle", "next_offset")


def jumps(visits: DataFrame) -> DataFrame:
    """(level, handle, offset, next_handle, next_offset): from visits to those 2^level steps on.

    A level holds the visits at multiples of twice its stride, so all levels together have no more rows than there are
    visits. idx counts from 0.
    """
    idx = F.col("idx")
    zeros = F.when(idx == 0, 62).otherwise(F.length(F.bin(idx)) - F.length(F.rtrim(F.translate(F.bin(idx), "0", " "))))
    last = visits.groupBy("seq").agg(F.max("idx").alias("last"))
    levels = F.sequence(F.lit(0), F.least(zeros - 1, F.floor(F.log2(F.greatest(F.col("last") - idx, F.lit(1)))).cast("int")))
    some = visits.join(last, "seq").where((zeros > 0) & (idx < F.col("last"))).select("seq", "handle", "offset", idx.alias("from"), F.explode(levels).alias("level"))
    some = some.withColumn("idx", F.col("from") + F.expr("shiftleft(1L, level)"))
    there = visits.select("seq", "idx", F.col("handle").alias("next_handle"), F.col("offset").alias("next_offset"))
    return some.join(there, ["seq", "idx"]).select("level", "handle", "offset", "next_handle", "next_offset")


def restore(starts: DataFrame, jump_rows: DataFrame, levels: int, keys: list[str], explode: bool = False) -> DataFrame:
    """The paths that begin at (keys, handle, offset): keys and path, or one row a step (pos, handle) if asked.

    From the highest level down, each known visit finds the one that lies its stride ahead: all paths double their known
    visits together, in as many joins as the logarithm of the longest has digits. A join meets one level only.
    """
    known = starts.select(*keys, F.lit(0).cast("long").alias("pos"), "handle", "offset")
    for level in range(levels - 1, -1, -1):
        here = jump_rows.where(F.col("level") == level).drop("level")
        both = known.join(here, ["handle", "offset"], "left")
        own = F.struct("pos", "handle", "offset")
        ahead = F.struct((F.col("pos") + (1 << level)).alias("pos"), F.col("next_handle").alias("handle"), F.col("next_offset").alias("offset"))
        known = both.select(*keys, F.explode(F.when(F.col("next_handle").isNull(), F.array(own)).otherwise(F.array(own, ahead))).alias("v")).select(*keys, "v.*")
    if explode:
        return known.drop("offset")
    return known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "handle")))["handle"].alias("path"))


def levels_of(visits: DataFrame) -> int:
    """How many levels of jumps the longest sequence needs."""
    longest = visits.agg(F.max("idx").alias("last")).first().last or 0
    return int(longest).bit_length()
