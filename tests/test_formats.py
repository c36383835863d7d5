"""Sources by byte ranges and the ordered writer, against the whole text read at once."""

import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from braidlake.sources import formats, members, text


def owned(data: bytes, split: int, zipped: bool) -> list[list[bytes]]:
    blocks = members.gzip_blocks if zipped else members.plain_blocks
    ranges = [(a, min(a + split, len(data))) for a in range(0, len(data), split)]
    return [[x for some in members.lines(blocks(io.BytesIO(data), a, b), a == 0) for x in some] for a, b in ranges]


def made(seed: int, n: int) -> list[bytes]:
    rng = random.Random(seed)
    return [rng.choice(["", "ä", "a\tb", "x" * rng.randrange(300), "z" * rng.randrange(5_000)]).encode() * rng.randrange(1, 3) for _ in range(n)]


@pytest.mark.parametrize("ends", [True, False])
def test_every_line_is_owned_by_one_range(ends, monkeypatch):
    monkeypatch.setattr(members, "BLOCK", 64)
    for seed in range(6):
        whole = made(seed, 40)
        data = b"\n".join(whole) + (b"\n" if ends else b"!\n")
        expected = data.split(b"\n")[:-1]
        for split in (1, 7, 100, 1_000, len(data)):
            assert [x for part in owned(data, split, False) for x in part] == expected
        cuts = sorted(random.Random(seed).sample(range(len(data)), 12))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        for level in (0, 6):  # level 0 stores the text as it is
            zipped = b"".join(gzip.compress(p, level) for p in pieces) + gzip.compress(b"") + b"\0" * 100
            for split in (11, 150, 1_000, len(zipped)):
                assert [x for part in owned(zipped, split, True) for x in part] == expected
        sized = b"".join(members.member(p) for p in pieces)
        assert gzip.decompress(sized) == data and [x for part in owned(sized, 97, True) for x in part] == expected


def test_a_last_line_without_an_end_and_no_text():
    assert [x for p in owned(b"a\nb", 1, False) for x in p] == [b"a", b"b"]
    assert owned(gzip.compress(b""), 10, True)[0] == [] and owned(b"", 10, False) == []
    assert [x for p in owned(b"\n\n\n", 1, False) for x in p] == [b"", b"", b""]


def test_broken_members_are_errors():
    data = b"".join(gzip.compress(f"line {i}\n".encode() * 50) for i in range(9))
    for broken in (data[:-3], data[:-30], data[:-1] + b"\xff", data[:112] + b"\0\1" + data[114:], data + b"junk"):
        for split in (20, 90, 10_000):
            with pytest.raises((EOFError, ValueError, zlib.error)):
                owned(broken, split, True)


def test_a_text_that_does_not_shrink():
    noise = bytes(random.Random(1).randrange(256) for _ in range(members.MEMBER))
    assert len(members.member(noise)) <= 1 << 16 and gzip.decompress(members.member(noise)) == noise


@pytest.fixture
def many_parts(spark):
    """So that even a small sorted text is in several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def written(spark, tmp_path, n, name):
    rows = spark.range(n).select(F.concat(F.lit("S\t"), (n - F.col("id")).cast("string"), F.lit("\tACGTÄ")).alias("value"), F.col("id").alias("k"))
    heads = spark.createDataFrame([("H\tVN:Z:1.1", -2), ("L\t1\t+\t2\t+\t0M", 1 << 40)], "value string, k long")
    ordered = heads.unionByName(rows).repartition(5).orderBy("k").select("value")
    path = f"{tmp_path}/{name}"
    assert text.write_document(ordered, path) == (tmp_path / name).stat().st_size
    return path, ["H\tVN:Z:1.1", *[f"S\t{n - i}\tACGTÄ" for i in range(n)], "L\t1\t+\t2\t+\t0M"]


@pytest.mark.parametrize("name", ["a.gfa", "a.gfa.gz"])
def test_document_is_written_in_parts_and_read_by_ranges(spark, tmp_path, many_parts, name):
    path, expected = written(spark, tmp_path, 20_000, name)
    raw = open(path, "rb").read()
    assert (gzip.decompress(raw) if name.endswith("gz") else raw).decode().splitlines() == expected
    assert len(list((tmp_path / f"{name}.parts").glob("part-*"))) > 1
    size = len(raw) // 6
    rows = spark.read.format("gfa").option("splitBytes", size).load(path)
    got = rows.orderBy("file", "split", "at").collect()
    assert [r.value for r in got] == expected and rows.select("split").distinct().count() > 3
    assert [r.value for r in text.read_lines(spark, path).orderBy("line_no").collect()] == expected
    assert [r.value for r in spark.read.format("gfa").load(f"{path}.parts").orderBy("file", "split", "at").collect()] == expected


def test_filters_are_pushed(spark, tmp_path):
    path, expected = written(spark, tmp_path, 300, "b.gfa")
    rows = spark.read.format("gfa").load(path)
    one = rows.where("kind = 'S' and name in ('5', '7', 'no') and length(value) > 3")
    assert sorted(r.value for r in one.collect()) == ["S\t5\tACGTÄ", "S\t7\tACGTÄ"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "length(value" in plan and "(kind#" not in plan and "(name#" not in plan  # what is left for Spark to filter
    assert rows.where("name like '1%'").count() == sum(x.startswith(("S\t1", "L\t1")) for x in expected)
    assert rows.where("kind != 'S'").count() == 2 and rows.where("kind is null").count() == 0
    assert sorted(r.at for r in rows.where("kind in ('H', 'L')").collect()) == [0, 301]


def test_reads_of_gaf_lines(spark, tmp_path):
    (tmp_path / "x.gaf").write_bytes(b"@HD\tVN:Z:1.0\r\nr1\t*\n@PG\tx\nr2\t*")
    formats.register(spark)
    rows = spark.read.format("gaf").option("splitBytes", 5).load(str(tmp_path))
    assert sorted((r.kind, r.name, r.value) for r in rows.collect()) == [("@", "HD", "@HD\tVN:Z:1.0"), ("@", "PG", "@PG\tx"), ("r", "r1", "r1\t*"), ("r", "r2", "r2\t*")]
    assert [r.name for r in rows.where("kind = 'r' and name = 'r2'").collect()] == ["r2"]


def test_a_sorted_text_is_not_added_to(spark, tmp_path):
    formats.register(spark)
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    save = lambda df, mode: df.write.format("gaf").mode(mode).save(f"{tmp_path}/out")
    save(frame("a", "b"), "append")
    with pytest.raises(Exception, match="not added to"):
        save(frame("c"), "append")
    back = lambda: sorted(r.value for r in spark.read.format("gaf").load(f"{tmp_path}/out").collect())
    assert back() == ["a", "b"]
    save(frame("c"), "overwrite")
    assert back() == ["c"] and not list((tmp_path / "out").glob("_[0-9a-f]*"))
    save(frame("x").where("value = 'y'"), "overwrite")
    assert back() == [] and formats.assemble(spark, f"{tmp_path}/out", f"{tmp_path}/empty") == 0


def test_a_task_that_fails_leaves_nothing_to_read(spark, tmp_path):
    formats.register(spark)
    rows = spark.range(0, 1_000, 1, 4).select(F.when(F.col("id") < 900, "ok").otherwise(F.raise_error(F.lit("lost"))).alias("value"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format("gaf").mode("append").save(f"{tmp_path}/out")
    assert not list(tmp_path.glob("out/part-*"))
