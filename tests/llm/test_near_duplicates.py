import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidlake.llm import jaccard, suffix, vectorcells
from braidlake.llm._common import Workspace
from braidlake.llm.components import components


def shingle_sets(rows, k):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def linked(ids, edges):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    least = {g: min((i for i in m if i is not None), default=None) for g, m in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def near_copies(seed):
    """Groups of copies with a few words changed, some in chains, some at the threshold, and short ones."""
    rng, out = random.Random(seed), []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 9, 30, 80, 300]))]
        for _ in range(rng.choice([2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 10**6)}"
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    return [(5000 + i, t, "en", "s") for i, t in enumerate(out)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, rows, k, percent):
    every = rows + near_copies(k)
    sets = shingle_sets(every, k)
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = linked([r[0] for r in every], edges)
    df = spark.createDataFrame(every, "doc_id long, text string, id string, key string")
    got = jaccard.link_components(df, k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((r[0], len(s), c) for r, s, c in zip(every, sets, want, strict=True))


def test_jaccard_of_null_and_repeated_ids(spark):
    """A null doc_id that has near copies, one doc_id on two texts that have others, and rows that repeat."""
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "pqr"]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in base]
    rows = [(None, base[0]), (3, near[0]), (3, base[1]), (4, near[1]), (5, base[2]), (5, base[2]), (6, "alone"), (None, near[2]), (None, "x y"), (None, "x y"), (7, None), (7, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect())
    assert got == Counter([(None, 56, 3), (3, 56, 3), (3, 56, 3), (4, 56, 3), (5, 56, 5), (5, 56, 5), (6, 1, 6), (None, 56, 5), (None, 1, None), (None, 1, None), (7, 0, 7), (7, 0, 7)])
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(df).collect())
    assert kept == Counter([(3, near[0]), (3, base[1]), (5, base[2]), (6, "alone"), (None, "x y"), (7, None), (7, None)])


def test_jaccard_keeps_one(spark, docs, empty):
    kept = [r[0] for r in jaccard.keep_one(docs).select("doc_id").collect()]
    want = {(r.component_id) for r in jaccard.link_components(docs).collect()}
    assert set(kept) == want and jaccard.keep_one(docs).columns == docs.columns
    assert jaccard.link_components(empty).count() == 0


def test_stars_lose_no_link(spark, monkeypatch):
    """With no star rounds all that share a key are compared; the result is the same."""
    df = spark.createDataFrame(near_copies(3), "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, jaccard.link_components(df).collect()))
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    assert got == sorted(map(tuple, jaccard.link_components(df).collect()))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)]
    with Workspace(spark, "t") as ws:
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    want = linked(list(range(500)), edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}


def removed(texts, length=200):
    """Which bytes of each text are covered by strings of that length that start anywhere else too."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def repeated_passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcde fghé") for _ in range(n))
    passages = [text(n) for n in (190, 199, 200, 201, 230, 700)]
    out = [text(rng.randint(0, 90)) + p[: rng.randint(150, 700)] + text(rng.randint(0, 300)) for p in passages for _ in range(4)]
    return out + ["ab" * 300, "x" * 450, text(150) + passages[4] + text(9) + passages[4], passages[3], passages[3][1:]]


def test_suffix_repeats_equal_all_windows(spark, rows, monkeypatch):
    texts = [r[1] or "" for r in rows[:90]] + repeated_passages(1) + ["", "short"]
    ids = list(range(len(texts)))
    want = {}
    for i, t, gone in zip(ids, texts, removed([t.encode() for t in texts]), strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(int)) == 1)
        want[i] = (len(data), int(gone.sum()), len(edges), hashlib.sha256(data[~gone].tobytes()).hexdigest())
    df = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, tid int")
    for batches, at_once in ((suffix.BATCHES, suffix.AT_ONCE), (7, 3)):  # also with all hits compared in blocks
        monkeypatch.setattr(suffix, "AT_ONCE", at_once)
        got = suffix.dedup_report(df, batches).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    kept = {r.doc_id: r.text for r in suffix.remove(df).collect()}
    assert all((i in kept) == (want[i][0] == 0 or want[i][1] < want[i][0]) for i in ids)
    assert suffix.remove(df).columns == ["doc_id", "text", "tid"]


def test_suffix_edges(spark, docs, empty):
    assert suffix.dedup_report(empty).count() == 0
    got = suffix.dedup_report(docs).where("doc_id in (1000, 1001)").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got] == [(0, 0, 0)] * 2


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for label in (0, 1, 2):
        centres = rng.normal(size=(60, 16))
        for c in centres:
            for _ in range(int(rng.integers(1, 6))):
                out.append((c + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35]), label))
    hot = rng.normal(size=16)
    out += [(hot, 1)] * 30 + [(hot + rng.normal(size=16) * 0.02, 1) for _ in range(150)]
    rows = [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(out)]
    n = len(rows)
    return rows + [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [float("inf")] + [1.0] * 15, 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), rows[0], rows[0]]


def test_vectors_equal_all_pairs(spark, monkeypatch):
    rows = vectors()
    usable = [v is not None and lab is not None and None not in v and all(map(np.isfinite, v)) and any(v) for _, v, lab in rows]
    edges, n_links = [], Counter()
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    edges.append((i, j))
                    n_links.update((i, j))
    want = linked([r[0] for r in rows], edges)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, id int")
    for shard in (8192, 100):
        monkeypatch.setattr(vectorcells, "SHARD", shard)
        got = vectorcells.near_vectors(df).collect()
        assert Counter((r.vec_id, r.component_id, r.kept) for r in got) == Counter((r[0], c, r[0] == c) for r, c in zip(rows, want, strict=True))
        assert sum(r.n_links for r in got) >= 0.99 * sum(n_links.values())
        assert sum(r.n_links for r in got) <= sum(n_links.values())
    assert vectorcells.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize(("clusters", "size", "noise"), [(60, 100, 0.28), (20, 300, 0.28), (60, 100, 0.25)])
def test_links_count_at_both_ends(clusters, size, noise):
    """Clusters whose vectors are near the least cosine of each other: what is found from one end only counts for both."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(clusters, 1, 64))
    x = x / np.linalg.norm(x, axis=2, keepdims=True) + noise / 8 * rng.normal(size=(clusters, size, 64))
    v = x.reshape(-1, 64).astype(np.float32)
    n = len(v)
    ids, links, other = vectorcells.search_label(v, np.arange(n) * 31, np.ones(n, np.int64), 0.93).rows()
    have, unit = np.zeros(n, np.int64), v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    for i, m in zip(ids, links, strict=True):
        if m is not None:
            have[i // 31] += m
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    assert have.sum() % 2 == 0 and (have <= want).all() and want.sum() > 100_000
    assert have.sum() >= 0.99 * want.sum()
    some = want > 0
    share = np.sort(have[some] / want[some])
    assert share[: len(share) // 10].mean() >= 0.9
    ends = {x // 31 for pair in zip(ids, other, strict=True) if pair[1] is not None for x in pair}
    assert all(have[i] > 0 for i in ends)


def test_large_label_is_not_compared_with_all(monkeypatch):
    """A label of 20,000 vectors, a fifth of them turned by up to the angle that still links: links, sums and the work done."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(16_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside, cosine = rng.normal(size=(4000, 64)), rng.uniform(0.93, 1, size=(4000, 1))
    aside -= (aside * x[:4000]).sum(axis=1, keepdims=True) * x[:4000]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    v = np.concatenate([x, cosine * x[:4000] + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)
    ids, counts = (rng.permutation(20_000) - 5000) * 7919, rng.integers(1, 4, 20_000)
    met, follow = [], vectorcells.Links.follow
    monkeypatch.setattr(vectorcells.Links, "follow", lambda self, queries, vectors, *rest: met.append(len(queries) * len(vectors)) or follow(self, queries, vectors, *rest))
    got, links, other = vectorcells.search_label(v, ids, counts, 0.93).rows()
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want, pairs = np.zeros(20_000, np.int64), []
    for i in range(0, 20_000, 1000):
        near = unit[i : i + 1000] @ unit.T >= 0.93
        near[np.arange(1000), np.arange(i, i + 1000)] = False
        want[i : i + 1000] = near @ counts
        pairs += [(i + int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]
    have = {a: n for a, n in zip(got, links, strict=True) if n is not None}
    assert all(n <= m for n, m in zip(map(have.get, ids.tolist(), [0] * len(ids)), want.tolist(), strict=True))
    assert sum(have.values()) >= 0.98 * want.sum() > 0
    at = {int(x): i for i, x in enumerate(ids)}
    edges = [(at[a], at[b]) for a, b in zip(got, other, strict=True) if b is not None]
    assert linked(ids.tolist(), edges) == linked(ids.tolist(), pairs)
    assert sum(met) < 0.5 * len(v) ** 2
