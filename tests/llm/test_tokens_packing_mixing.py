import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidlake.llm import mixing, packing, tokenbin
from braidlake.llm._common import Workspace
from braidlake.llm.tokens import default_tokenizer, encoder


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(plain, rows):
    e = encoder(default_tokenizer())
    odd = ["  a  b \n c", "\t x \n\ny ' s don't  ", "a\x1c b!\x1c c", "x  y　 12,3", "\n\n a", "a\n", "it's, été.\nB", "\U0001f600 \U0001f600,"]
    for text in odd + [r[1] for r in rows]:
        assert [*np.frombuffer(e.encode(text), "<u4").tolist(), 0] == plain(text)


def test_token_files(spark, docs, rows, plain, empty):
    with Workspace(spark, "t") as ws:
        folder = ws.path("files")
        manifest = tokenbin.write_tokens(docs, folder, shards=3)
        got = tokenbin.read_tokens(spark, folder, manifest).collect()
        got.sort(key=lambda r: r.start)
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(plain(r[1]))) for r in rows)
        at = 0
        for before, r in zip([None, *got], got, strict=False):
            assert before is None or (before.doc_id is None) or before.doc_id <= r.doc_id
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == digest(r.ids)
            at += r.n_tokens
        reader = tokenbin.TokenReader(folder, next(m["name"] for m in manifest if m["documents"]))
        k = len(reader) - 1
        assert reader.find(int(reader.doc_id[k])).tolist() == plain(dict((r[0], r[1]) for r in rows)[int(reader.doc_id[k])])
        with pytest.raises(KeyError):
            reader.find(10**9)
        folder = ws.path("none")
        assert tokenbin.read_tokens(spark, folder, tokenbin.write_tokens(empty, folder)).count() == 0


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: the room left in each bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 2048])
def test_best_fit_decreasing_equals_one_by_one(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 5, 60, 400):
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 5)) for _ in range(n)]
        segments = packing.best_fit_decreasing(Counter(lengths), capacity)
        bins, ranks = defaultdict(list), Counter()
        for length, rank, pieces, first, each, offset in segments:
            assert rank == ranks[length]
            ranks[length] += pieces
            for k in range(pieces):
                bins[first + k // each].append((offset + k % each * length, length))
        assert ranks == Counter(lengths)
        for found in bins.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == one_by_one(lengths, capacity)


def test_packing(docs, rows, plain, empty):
    got = packing.pack_documents(docs, capacity=512).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = plain(text)
        n = len(ids)
        starts = [0, *range(n % 512 or 512, n, 512)] if n > 512 else [0]
        for k, (i, j) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
            want[doc_id, k, i, j - i, digest(ids[i:j])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) == len(one_by_one([r.length for r in got], 512))
    assert packing.pack_documents(empty).count() == 0
    single = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack_documents(single, capacity=512)
    assert packing.sequences(single, packed, capacity=512).selectExpr("sum(size(ids))").first()[0] == packed.selectExpr("sum(length)").first()[0]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.shares([sizes[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.passes * r.size and 0 <= r.passes <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0


def test_shares_are_capped_and_shared_again():
    assert mixing.shares([10, 1000], [1, 1]) == [30.0, 980.0]
    assert mixing.shares([0, 0], [1, 2]) == [0.0, 0.0]
    got = mixing.shares([1, 10, 10_000], [1, 2, 3])
    assert got[0] == 3.0 and got[1] == 30.0 and sum(got) == 10_011
