import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from braidlake.llm import bpe, fim, queries

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [(1, "a <P> b c d e f g"), (2, "  "), (3, "\n\n x"), (4, "é日 \x1c\xa0\x85 b \U0001f600 c "), (5, "one"), (6, "<<S <M P> < > word " * 9), (-8, "neg ative id s " * 5), (7, "x <M>"), (7, "y z" * 40)]


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def plain_rewrite(doc_id, text):
    units = UNIT.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def both(spark, docs, rows):
    """More odd texts, many ids, and columns whose names the operators use."""
    extra = ODD + [(k, f"w{k} and some <words> of number {k}") for k in range(7000, 7060)]
    more = spark.createDataFrame([(i, t, 3, "q", "z") for i, t in extra], "doc_id long, text string, n int, form string, ids string")
    return docs.select("doc_id", "text", F.lit(3).alias("n"), F.lit("q").alias("form"), F.lit("z").alias("ids")).unionByName(more), [(r[0], r[1] or "") for r in rows] + extra


def test_every_document_is_cut_by_its_ranks(both, empty):
    df, plain = both
    made = fim.transform(df).withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:-1] for r in made) == Counter((i, *plain_rewrite(i, t)) for i, t in plain)
    assert Counter((r.doc_id, r.restored) for r in made) == Counter(plain)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.transform(empty).count() == 0
    assert {r.form for r in fim.transform(df, rate=100, spm_rate=0).collect()} == {"plain", "psm"}


@pytest.mark.parametrize("window", [1, 7, 1 << 20])
def test_units_of_long_texts(monkeypatch, window):
    monkeypatch.setattr(fim, "WINDOW", window)
    for text in ["", " ", "a" * 50, " " * 50, "ab  c\t\nd " * 30, "日本 \xa0\x1c\x00x" * 20 + "  ", *(t for _, t in ODD)]:
        assert fim.unit_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_very_long_units():
    text = "x" * 3_000_000 + " " * 3_000_000 + "y z" + " " * 3_000_000
    assert fim.unit_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_fill_in_middle_equals_its_sql(spark):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.execute(queries.oracle_sql()["op11_fill_in_middle"])
    got = queries.op11_fill_in_middle(spark, SF)
    assert got.columns == [c[0] for c in want.description]
    rows = Counter(want.fetchall())
    assert Counter(tuple(r) for r in got.collect()) == rows and rows.total() >= 100
    assert all(r.restored_sha256 == sha(t or "") for r, t in ((r, r.text) for r in got.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_ranks(), bpe.default_pattern())


def test_ids_are_the_library_s(both, empty, codec):
    df, plain = both
    coded = bpe.decode(bpe.encode(df)).collect()
    ids = Counter((r.doc_id, tuple(r.ids), bytes(r.data)) for r in coded)
    assert ids == Counter((i, tuple(codec.encoding.encode_ordinary(t)), t.encode()) for i, t in plain)
    assert bpe.encode(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


@pytest.mark.parametrize(("window", "wide"), [(1, 2), (5, 3), (40, 9), (1 << 16, 1 << 12)])
def test_cuts_change_no_id(monkeypatch, codec, window, wide):
    monkeypatch.setattr(bpe, "WINDOW", window)
    monkeypatch.setattr(bpe, "_RUN", re.compile(bpe._RUN.pattern.replace(str(bpe.WIDE), str(wide))))
    texts = ["it's we'll I'D x'9 'sa ''s", "a1b22 c,d;e' f's", "x  \t\n  y   z \n\n", "   ", " \x1c \x1c  \x85\xa0\xa0a   b", "日本、語1。ab　　c", "​​ a﻿  ﻿", "é́ x́  1²³½ ", *(t for _, t in ODD)]
    for text in [*texts, *(a + b for a in texts for b in texts), *(t.replace(" ", "    ") for t in texts)]:
        ids = codec.encode(text).tolist()
        assert ids == codec.encoding.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_texts_that_exhaust_the_pattern(codec):
    """A million spaces are more than the library's own splitting takes: they are the pattern's matches all the same."""
    space, ids = " " * 1_000_000, codec.encode
    assert ids(space + "x").tolist() == codec.encoding._encode_single_piece(space[1:]) + codec.encoding.encode_ordinary(" x")
    assert ids("y" + space).tolist() == codec.encoding.encode_ordinary("y") + codec.encoding._encode_single_piece(space)
    for text in ("a" * 300_000, "日" * 200_000, "ab, c1" * 60_000):
        assert ids(text).tolist() == codec.encoding.encode_ordinary(text)


def test_byte_bpe_query(spark, codec):
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_byte_bpe(spark, SF).collect():
        ids = codec.encoding.encode_ordinary(want.pop(r.doc_id))
        text = codec.decode(ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert not want


def test_bytes_that_are_no_text(spark, codec):
    """Cut ids give raw bytes, null ids none."""
    ids = codec.encoding.encode_ordinary("日")
    assert len(ids) > 1
    got = bpe.decode(spark.createDataFrame([(1, ids[:1], "x"), (2, None, "x"), (None, [], "x")], "doc_id long, ids array<int>, data string")).collect()
    assert {r.doc_id: bytes(r.data) for r in got} == {1: codec.encoding.decode_single_token_bytes(ids[0]), 2: b"", None: b""}
