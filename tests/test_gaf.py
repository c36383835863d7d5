"""Alignment records: parsing, difference strings, typed fields, mappings, clipping, sorting, stores, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from braidlake.functions import cs, gaf, mapping, seq
from braidlake.operators import cigar, locate
from braidlake.operators._shared import numbered
from braidlake.operators import reads as R
from braidlake.sources import store, text
from braidlake.sources.names import GraphName, require_reference

T = "\t"
GOOD = [
    "forward\t100\t5\t90\t+\t>10>12<14>15\t120\t10\t100\t80\t93\t60\tAS:i:57\tbq:Z:IIII\tcs:Z::20*AC*GT:20-GATTACAT:20+CAT:20\tpd:b:1",
    "reverse\t100\t5\t90\t-\t>10>12<14>15\t120\t20\t110\t80\t93\t60",
    "no_mapq\t100\t5\t90\t+\t>10>12\t120\t10\t100\t80\t93\t255",
    "missing\t*\t*\t*\t*\t*\t*\t*\t*\t*\t*\t*",
    "unaligned\t10\t0\t10\t+\t*\t0\t0\t0\t0\t10\t0\tcs:Z:+GATTACAGAT\tfn:Z:next\tpd:b:1\txx:i:-5",
    "fallback\t100\t5\t90\t+\t>10>12<14>15\t120\t10\tx\t80\t93\t60\tcs:Z::80",
]
BAD = {
    "too few fields": "a\t1\t0\t1\t+\t>1\t1\t0\t1\t1\t1", "bad query interval": "a\tx\t0\t1\t+\t>1\t1\t0\t1\t1\t1\t1", "bad strand": "a\t1\t0\t1\t?\t>1\t1\t0\t1\t1\t1\t1",
    "bad path": "a\t1\t0\t1\t+\t>1-2\t1\t0\t1\t1\t1\t1", "duplicate field": "a\t1\t0\t1\t+\t>1\t1\t0\t1\t1\t1\t1\tcs:Z::1\tcs:Z::1", "bad difference string": "a\t1\t0\t1\t+\t>1\t1\t0\t1\t1\t1\t1\tcs:Z:~1",
    "bad optional field": "a\t1\t0\t1\t+\t>1\t1\t0\t1\t1\t1\t1\tAS:i:x", "bad target interval": "a\t1\t0\t1\t+\t>1\t1\tx\t1\t1\t1\t1",
}


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "aln_id long, value string")


def test_good_records(spark):
    got = {r.name: r for r in gaf.parse_lines(frame(spark, GOOD)).collect()}
    assert all(r.error is None for r in got.values())
    f = got["forward"]
    assert (f.path, f.path_start, f.path_end, f.matches, f.edits, f.mapq, f.score, f.seq_end, f.pair_name) == ([20, 24, 29, 30], 10, 100, 80, 13, 60, 57, 90, None)
    r = got["reverse"]
    assert (r.path, r.path_start, r.path_end) == ([31, 28, 25, 21], 10, 100) and got["no_mapq"].mapq is None
    m = got["missing"]
    assert (m.path, m.seq_len, m.mapq, m.diff) == ([], 0, 0, [])
    u = got["unaligned"]
    assert (u.path, u.edits, u.pair_name, u.pair_is_next, u.pair_is_proper, [tuple(x) for x in u.optional]) == ([], 10, "next", True, True, [("xx", "i", "-5")])
    assert (got["fallback"].path_start, got["fallback"].path_end, got["fallback"].seq_end) == (10, 90, 85)
    assert all(r.v is None for r in gaf.parse_lines(frame(spark, GOOD[:1])).select(gaf.validation_error().alias("v")).collect())


def test_bad_records(spark):
    got = gaf.parse_lines(frame(spark, list(BAD.values()))).orderBy("aln_id").collect()
    assert [r.error for r in got] == list(BAD)


def test_typed_fields(spark):
    good = ["AB:A:x", "AB:Z:", "AB:Z:a:b", "AB:i:-12", "AB:i:+3", "AB:f:1.5e-3", "AB:f:2", "AB:b:0", "AB:b:1"]
    bad = ["", "AB:A", "AB:A:", "AB:A:xy", "AB:i:", "AB:i:1.5", "AB:f:x", "AB:b:2", "AB:b:", "AB:x:1", "ABxi:1", "AB:ix1"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", gaf.typed_field_is_valid(F.col("x")).alias("v")).collect()
    assert [r.v for r in rows] == [True] * len(good) + [False] * len(bad)


def test_difference_strings(spark):
    rng, target = random.Random(1), "ACGTACGTACGTACGTACGTACGTACGT"
    texts = []
    for _ in range(60):
        at, out = 0, ""
        for _ in range(rng.randint(0, 7)):
            kind, n = rng.choice(":*+-"), rng.randint(1, 3)
            out += {":": f":{n}", "*": f"*{target[at]}G", "+": "+" + "GAT"[:n], "-": "-" + target[at : at + n]}[kind]
            at += {":": n, "*": 1, "+": 0, "-": n}[kind]
        texts.append(out)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", cs.parse(F.col("t")))
    rows = df.select("i", "t", cs.to_text(F.col("d"), F.lit(target)).alias("back"), cs.normalize(F.col("d")).alias("n"), cs.query_len(F.col("d")).alias("q"), cs.query_len(cs.normalize(F.col("d"))).alias("qn"), cs.target_len(F.col("d")).alias("g"), cs.target_len(cs.normalize(F.col("d"))).alias("gn")).collect()
    for r in rows:
        assert r.back == r.t and r.q == r.qn and r.g == r.gn
        assert all(a.op != b.op or a.op == "*" for a, b in zip(r.n, r.n[1:], strict=False))
    assert spark.range(1).select(cs.normalize(cs.parse(F.lit(":2:0:3+A+CT-A*AC*AC"))).alias("n")).first().n == [(":", 5, None), ("+", 3, "ACT"), ("-", 1, None), ("*", 1, "C"), ("*", 1, "C")]


def test_ops_and_mappings(spark):
    ops = spark.range(1).select(F.explode(cs.parse(F.lit(":2:0*AC+GA-T"))).alias("d"))
    got = ops.select(mapping.op_len(F.col("d")), mapping.op_query_len(F.col("d")), mapping.op_target_len(F.col("d")), mapping.op_is_empty(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(2, 2, 2, False), (0, 0, 0, True), (1, 1, 1, False), (2, 2, 0, False), (1, 0, 1, False)]
    rows = spark.createDataFrame([(0, 0, 0, 0, 0, 3), (4, 1, 3, 3, 3, 5), (4, 0, 1, 3, 5, 6)], "handle long, node_start long, node_end long, node_len long, query_start long, query_end long")
    before = F.struct(F.lit(4).alias("handle"), F.lit(1).alias("node_end"))
    got = rows.select(mapping.query_len(), mapping.target_len(), mapping.is_unaligned(), mapping.is_at_start(), mapping.is_at_end(), mapping.follows(before)).collect()
    assert [tuple(r) for r in got] == [(3, 0, True, True, True, False), (2, 2, False, False, True, True), (1, 1, False, True, False, False)]


def test_paths_of_reads_that_have_none(spark):
    reads = spark.createDataFrame([(0, [4], 2, 4, 4), (1, None, 0, None, None), (2, [], 0, None, None), (3, None, 0, None, None)], "aln_id long, path array<bigint>, path_len long, min_handle long, max_handle long")
    paths = spark.createDataFrame([(0, [9, 8], 7), (1, [9, 8], 7), (2, [9], 7)], "aln_id long, path array<bigint>, path_len long")
    got = R.with_paths(reads, paths).orderBy("aln_id")
    assert [tuple(r) for r in got.collect()] == [(0, [4], 2, 4, 4), (1, [9, 8], 7, 8, 9), (2, [], 0, None, None), (3, None, 0, None, None)]
    assert [r.h for r in got.select(R.has_path().alias("h")).collect()] == [True, True, False, None]


NODES = {1: "AA", 2: "CCC", 3: "GGGG", 4: "T", 5: "ACGT"}


def by_hand(path, start, diff):
    """Mappings of one read, an op and a node at a time."""
    out, k, at, q, used = [], 0, start, 0, start
    size = lambda h: len(NODES[h >> 1])
    while path and at >= size(path[k]):
        at -= size(path[k])
        k += 1
    for n, (op, length) in enumerate(diff):
        left = length
        if op == "+":
            out.append((n, k, path[k] if path else 0, at if path else 0, q, op, length))
            q += length
            continue
        while left:
            if at >= size(path[k]):
                k, at = k + 1, 0
            step = min(left, size(path[k]) - at)
            out.append((n, k, path[k], at, q, op, step))
            left, at, used = left - step, at + step, used + step
            q += step if op in ":*" else 0
    return out


def random_reads(seed, n=60):
    rng, out = random.Random(seed), []
    for i in range(n):
        path = [2 * rng.randint(1, 5) + rng.randint(0, 1) for _ in range(rng.randint(1, 6))]
        total = sum(len(NODES[h >> 1]) for h in path)
        start = rng.randint(0, min(total - 1, len(NODES[path[0] >> 1]) - 1))
        at, diff = start, []
        while at < total and len(diff) < 8:
            op = rng.choice(":*+-:")
            if diff and diff[-1][0] == op and op != "*":
                continue
            length = 1 if op == "*" else rng.randint(1, 3) if op == "+" else rng.randint(1, min(4, total - at))
            at += 0 if op == "+" else length
            diff.append((op, length))
        out.append((i, path, total, start, at, diff))
    return out


def as_frame(spark, reads):
    rows = []
    for i, path, total, start, end, diff in reads:
        q = sum(n for op, n in diff if op in ":*+")
        ops = [(op, n, "G" * n if op in "*+" else None) for op, n in diff]
        rows.append((i, f"r{i}", q, 0, q, path, total, start, end, sum(n for op, n in diff if op == ":"), sum(n for op, n in diff if op != ":"), 60, None, "", ops, None, None, None, [("xx", "Z", "y")]))
    schema = f"aln_id long, name string, seq_len long, seq_start long, seq_end long, path array<bigint>, path_len long, path_start long, path_end long, matches long, edits long, mapq long, score long, base_quality string, diff {cs.OPS}, pair_name string, pair_is_next boolean, pair_is_proper boolean, optional {gaf.FIELD}"
    nodes = spark.createDataFrame([(n, s, len(s)) for n, s in NODES.items()], "node_id long, sequence string, seq_len long")
    return spark.createDataFrame(rows, schema).cache(), nodes


def test_mappings_and_clipping(spark):
    reads = random_reads(4)
    df, nodes = as_frame(spark, reads)
    got = {}
    for r in R.mappings(df, nodes).orderBy("aln_id", "op_no", "pos").collect():
        got.setdefault(r.aln_id, []).append((r.op_no, r.pos, r.handle, r.node_start, r.query_start, r.op, r.len))
    want = {i: by_hand(path, start, diff) for i, path, _, start, _, diff in reads}
    assert got == {i: m for i, m in want.items() if m}
    inside = {1, 3, 5}
    clipped = {}
    ids = spark.createDataFrame([(n,) for n in inside], "node_id long")
    for r in R.clip(df, nodes, ids).orderBy("aln_id", "seq_start", "fragment").collect():
        clipped.setdefault(r.aln_id, []).append((r.seq_start, r.seq_end, r.path, r.path_start, r.path_end, sum(d.len for d in r.diff), any(f.tag == "fi" for f in r.optional)))
    for i, _path, _total, start, end, diff in reads:
        q = sum(n for op, n in diff if op in ":*+")
        runs, run = [], None
        for m in want[i] if q and end > start else []:
            if m[2] >> 1 in inside:
                if run is None:
                    run = []
                    runs.append(run)
                run.append(m)
            else:
                run = None
        expected = []
        for run in runs:
            ends = [(m[4], m[4] + (0 if m[5] == "-" else m[6])) for m in run]
            places = dict((m[1], m[2]) for m in run)
            length = sum(len(NODES[h >> 1]) for h in places.values())
            last = run[-1]
            tail = last[3] + (0 if last[5] == "+" else last[6])
            path_end = length - len(NODES[last[2] >> 1]) + tail
            expected.append((ends[0][0], max(e for _, e in ends), [places[k] for k in sorted(places)], run[0][3], path_end, sum(m[6] for m in run)))
        alone = len(expected) == 1 and expected[0][:2] == (0, q)
        assert sorted(clipped.get(i, [])) == sorted((*e, not alone) for e in expected), i


def test_selection_blocks_and_ranks(spark, monkeypatch):
    reads = random_reads(9, 40)
    df, nodes = as_frame(spark, reads)
    ids = spark.createDataFrame([(1,), (3,)], "node_id long")
    assert {r.aln_id for r in R.select(df, ids).collect()} == {i for i, p, *_ in reads if {h >> 1 for h in p} & {1, 3}}
    assert {r.aln_id for r in R.select(df, ids, R.CONTAINED).collect()} == {i for i, p, *_ in reads if {h >> 1 for h in p} <= {1, 3}}
    flags = df.withColumn("is_unaligned", F.col("aln_id").between(10, 12))
    got = [r.block_id for r in R.blocks(flags, 4).orderBy("aln_id").collect()]
    want, block, size = [], -1, 0
    for i in range(40):
        if i == 0 or size == 4 or (10 <= i <= 12) != (10 <= i - 1 <= 12):
            block, size = block + 1, 0
        want.append(block)
        size += 1
    assert got == want
    assert [r.block_id for r in R.blocks(flags, 0).orderBy("aln_id").collect()] == list(range(40))
    with pytest.raises(ValueError):
        R.blocks(flags, -1)
    starts = {i: p[0] for i, p, *_ in reads}
    ranks = [(i, h, sum(starts[j] == h for j in range(i))) for i, h in starts.items()]
    empty = df.limit(1).withColumn("aln_id", F.lit(99).cast("long")).withColumn("path", F.array().cast("array<bigint>"))
    for at_once in (1 << 16, 7):  # also with counts carried over bins
        monkeypatch.setattr(R, "READS_AT_ONCE", at_once)
        assert [r.block_id for r in R.blocks(flags, 4).orderBy("aln_id").collect()] == want
        assert sorted(map(tuple, R.start_ranks(df.unionByName(empty)).collect())) == sorted([*ranks, (99, None, None)])


def test_store_and_export(spark, tmp_path):
    lines = ["@HD\tVN:Z:1.0", "@RN\tx", *GOOD, "@late\theader"]
    (tmp_path / "in.gaf").write_text("\n".join(lines) + "\n")
    numbered = text.read_lines(spark, f"{tmp_path}/in.gaf")
    assert [(r.line_no, r.value) for r in numbered.orderBy("line_no").collect()] == list(enumerate(lines))
    assert [r.value for r in text.headers(numbered).orderBy("line_no").collect()] == lines[:2]
    reads = text.read_gaf(spark, f"{tmp_path}/in.gaf")
    path = f"{tmp_path}/reads"
    store.write_alignments(reads, path, store.AlignmentParams(block_size=2))
    opened = store.open_alignments(spark, path)
    assert opened.params.block_size == 2 and opened.tags["alignments"] == str(len(GOOD)) and opened.blocks.count() == opened.alignments.select("block_id").distinct().count()
    assert opened.rows(0, 1).count() <= 2 and opened.n_alignments == len(GOOD) and opened.n_blocks() == opened.blocks.count() and opened.size() > 0 and not opened.bidirectional
    assert opened.graph_name() == GraphName() and R.column_bytes(opened.alignments).first().name_bytes == sum(len(x.split(T)[0]) for x in GOOD)
    near = opened.meeting(spark.createDataFrame([(15, 15)], "cluster_min long, cluster_max long"))
    assert {r.name for r in near.collect()} >= {"forward", "reverse", "fallback"} and near.count() < len(GOOD)
    back = opened.alignments.where("name in ('reverse', 'no_mapq', 'missing')").select("name", gaf.to_line().alias("line"))
    assert {r.name: r.line for r in back.collect()}["no_mapq"] == GOOD[2]
    with pytest.raises(ValueError):
        store.write_alignments(reads, path + "2", store.AlignmentParams(reference_free=True))
    (tmp_path / "bad.gaf").write_text(BAD["bad path"] + "\n" + GOOD[1] + "\n")
    assert text.read_gaf(spark, f"{tmp_path}/bad.gaf", "drop").count() == 1
    with pytest.raises(Exception, match="bad path"):
        text.read_gaf(spark, f"{tmp_path}/bad.gaf").collect()
    assert text.identify_source(f"{tmp_path}/in.gaf") == "gaf" and text.identify_source(path) == "store:alignments 1"


def test_sorting(spark):
    lines = spark.createDataFrame([(i, "\t".join(["r", "1", "0", "1", "+", p])) for i, p in enumerate([">5<10>15", "*", ">1>2>3", ">1>2>3", "bad"])], "line_no long, value string")
    assert [r.line_no for r in R.sort_lines(lines).collect()] == [2, 3, 0, 1, 4]
    hashed = R.sort_lines(lines, by_hash=True).select(F.xxhash64("value").alias("h"), "line_no").collect()
    assert hashed == sorted(hashed, key=lambda r: (r.h, r.line_no)) and sorted(r.line_no for r in hashed) == [0, 1, 2, 3, 4]
    assert [r.line_no for r in R.sort_lines(lines, partitions=2).collect()] == [2, 3, 0, 1, 4]
    assert [(r.line_no, r.at) for r in sorted(numbered(R.sort_lines(lines), "at").collect(), key=lambda r: r.at)] == [(2, 0), (3, 1), (0, 2), (1, 3), (4, 4)]
    with pytest.raises(ValueError):
        R.sort_lines(lines, partitions=0)


def test_lines_are_split_once(spark):
    """However a line is made, no filter or column of a parsed record computes it again."""
    made = spark.range(5).select(F.col("id").alias("aln_id"), F.concat_ws("\t", *[F.concat(F.lit("x"), F.col("id").cast("string"))] * 12).alias("value"))
    plan = gaf.parse_lines(made).where("error is null").select("name", "path", "matches")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and len(plan) < 40_000


def test_gzip_is_known_by_its_bytes(spark, tmp_path):
    import gzip

    (tmp_path / "a.gaf").write_bytes(gzip.compress("\n".join(GOOD[:2]).encode() + b"\n") + gzip.compress(GOOD[2].encode()))
    (tmp_path / "b.gaf").write_text(GOOD[3] + "\n")
    got = text.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == list(enumerate(GOOD[:4]))
    assert text.identify_source(f"{tmp_path}/a.gaf", spark) == "gzip" and text.identify_source(f"{tmp_path}/b.gaf", spark) == "gaf" and text.identify_source(f"{tmp_path}/c", spark) == "missing"


def test_streaming_ingest(spark, tmp_path):
    from braidlake.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gaf").write_text("@HD\n" + "\n".join(GOOD[:3]) + "\n" + BAD["bad path"] + "\n")
    args = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    ingest(spark, *args).awaitTermination()
    (tmp_path / "in" / "b.gaf").write_text("\n".join(GOOD[3:]) + "\n")
    ingest(spark, *args).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/reads").collect()
    assert sorted(r.name for r in got) == sorted(x.split(T)[0] for x in GOOD) and len({r.aln_id for r in got}) == len(GOOD)
    assert [r.error for r in spark.read.parquet(f"{tmp_path}/out/bad").collect()] == ["bad path"]


def test_cigars():
    table = {1: "A", 2: "B", 3: "AA", 4: "BB", 5: "ABA", 6: "BAB"}
    s = lambda h: table[h >> 1]
    assert cigar.cigar([2, 4], [2, 4], s) == "2M" and cigar.cigar([2], [6], s) == "1M1D" and cigar.cigar([], [6], s) == "2D" and cigar.cigar([6], [], s) == "2I"
    assert cigar.cigar([2, 10, 2], [2, 12, 2], s) == "5M"
    rng = random.Random(8)
    for _ in range(80):
        a, b = ([2 * rng.randint(1, 6) for _ in range(rng.randint(0, 9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + len(s(a[i])) if a[i] == b[j] else 0)
        got = cigar.weighted_lcs(a, b, lambda h: len(s(h)))
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert sum(len(s(a[i])) for i, _ in got) == best[-1][-1]


def test_weighted_lcs_of_walks_that_repeat_nodes():
    rng = random.Random(5)
    for n in (30, 60):
        for letters in (2, 5, 40):
            a, b = ([rng.randrange(letters) for _ in range(n)] for _ in "ab")
            weight = lambda h: 1 + h % 3
            best = [[0] * (n + 1) for _ in range(n + 1)]
            for i in range(n):
                for j in range(n):
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight(a[i]) if a[i] == b[j] else 0)
            got = cigar.weighted_lcs(a, b, weight)
            assert sum(weight(a[i]) for i, _ in got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_long_walks_are_aligned_in_little_memory():
    """Walks of 50,000 nodes, of which a table would take 10 GB. With weight 1 the rest of a permutation is a rising run."""
    import tracemalloc
    from bisect import bisect_left

    rng, n = random.Random(6), 50_000
    b = list(range(n))
    a = [x for k in range(0, n, 50) for x in rng.sample(b[k : k + 50], 50)]
    tails = []
    for x in a:
        tails[bisect_left(tails, x) : bisect_left(tails, x) + 1] = [x]
    tracemalloc.start()
    got = cigar.weighted_lcs(a, b, lambda h: 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(tails) and peak < 100 << 20


def test_small_functions():
    for n in range(30):
        dna = ("ACGTNACGGT" * 3)[:n]
        assert seq.unpack(seq.pack(dna)) == dna and len(seq.pack(dna)) == -(-n // 3)
    assert seq.unpack(seq.pack("AXG")) == "ANG" and seq.human_size(2048) == "2.000 KiB" and seq.parse_size("10k") == 10_000 and seq.parse_size("7") == 7
    assert seq.parse_interval("3..9") == (3, 9) and seq.parse_oriented("12-") == 25 and seq.parse_between("3:4-") == (6, 9)
    for bad in (lambda: seq.parse_interval("9..3"), lambda: seq.parse_oriented("x+"), lambda: seq.parse_between("34")):
        with pytest.raises(ValueError):
            bad()


def test_graph_names():
    a, b = GraphName("a"), GraphName("b")
    require_reference(a, GraphName())
    require_reference(GraphName(), b)
    require_reference(GraphName("a", (("a", "c"),)), GraphName("b", (("c", "b"),)))
    with pytest.raises(ValueError):
        require_reference(a, GraphName("b", (("b", "a"),)))
    both = a.subgraph_of(GraphName("b", (("b", "c"),)))
    assert both == GraphName("a", (("b", "c"), ("a", "b"))) and a.subgraph_of(a) == a
    assert GraphName.from_tags(both.tags()) == both and GraphName.from_headers(both.gaf_headers()) == both and GraphName.from_headers(["H\tVN:Z:1.1", *both.gfa_headers()]) == both
    assert GraphName.from_tags({"graph_name": "a", "graph_subgraphs": "x"}) == GraphName()
    with pytest.raises(ValueError):
        GraphName.from_tags({"graph_subgraphs": "x"}, strict=True)


def test_clusters(spark):
    rng = random.Random(3)
    ids = sorted({rng.randint(0, 20_000) for _ in range(60)})
    want, run = [], [ids[0]]
    for a, b in zip(ids, ids[1:], strict=False):
        if b - a > 500:
            want.append(run)
            run = []
        run.append(b)
    want.append(run)
    got = locate.clusters(spark.createDataFrame([(i,) for i in ids + ids[:5]], "node_id long"), 500).collect()
    assert sorted(map(tuple, got)) == [(r[0], r[-1], len(r)) for r in want]


def test_as_of_and_offsets_over_bins(spark, monkeypatch):
    rng = random.Random(6)
    facts = sorted({(k, rng.randint(0, 300)) for k in (1, 2, None) for _ in range(12)}, key=str)
    queries = [(i, rng.choice([1, 2, 3, None]), rng.randint(-5, 320)) for i in range(80)]
    want = {i: max((f for q, f in facts if q == k and f <= at), default=None) for i, k, at in queries}
    steps = [(p, s, 2 * rng.randint(1, 5)) for p in (1, 2) for s in range(40)]
    nodes = spark.createDataFrame([(n, s, len(s)) for n, s in NODES.items()], "node_id long, sequence string, seq_len long")
    offsets, at = {}, {1: 0, 2: 0}
    for p, s, h in steps:
        offsets[p, s] = (at[p], at[p] + len(NODES[h >> 1]))
        at[p] = offsets[p, s][1]
    index = []
    for p in (1, 2):
        last = None
        for s in range(40):
            if last is None or offsets[p, s][0] >= last + 9:
                last = offsets[p, s][0]
                index.append((p, last, s))
    f, q = spark.createDataFrame(facts, "k long, v long"), spark.createDataFrame(queries, "i long, k long, at long")
    for width in (1 << 20, 40):
        monkeypatch.setattr(locate, "OFFSETS_AT_ONCE", width)
        monkeypatch.setattr(locate, "STEPS_AT_ONCE", width)
        assert {r.i: r.v for r in locate.as_of(q, f, ["k"], "at", "v", ["v"]).collect()} == want
        got = locate.step_offsets(spark.createDataFrame(steps, "path_handle long, step long, handle long"), nodes).cache()
        assert {(r.path_handle, r.step): (r.step_start, r.step_end) for r in got.collect()} == offsets
        paths = spark.createDataFrame([(1, True), (2, True), (3, True)], "path_handle long, is_indexed boolean")
        assert sorted((r.path_handle, r.path_offset, r.step) for r in locate.reference_index(got, paths, 9).collect()) == index
    with pytest.raises(ValueError):
        locate.indexed_paths(spark.createDataFrame([(1, False, 3)], "path_handle long, is_indexed boolean, path_len long"))
