"""The dealt parts of operators against plain versions of them."""

import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from braidlake.llm import langid, license, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    h = [spark_hash(w) for w in WORD.findall(text or "")]
    return [g % quality.BUCKETS for g in h + [spark_hash(a, b) for a, b in zip(h, h[1:], strict=False)]]


def test_quality_ratio(spark, docs, rows):
    trusted = [(r[0], 1, 0) for r in rows[::3] if r[0] is not None] + [(rows[1][0], 1, 1), (rows[2][0], 0, 0), (999_999, 1, 0), (None, 1, 0), (rows[0][0], 1, 0)]
    good = {i for i, q, t in trusted if q == 1 and t == 0 and i is not None}
    got = quality.judge(docs, spark.createDataFrame(trusted, "doc_id long, quality int, toxic int")).collect()
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in good:
            target.update(grams(r[1]))
    n, m = sum(raw.values()), sum(target.values())
    prior = quality.SMOOTHING * m / n

    def ratio(g, own):
        a = math.log((max(target[g] - own, 0) + prior) / (m + prior * quality.BUCKETS))
        return a - math.log((max(raw[g] - 1, 0) + quality.SMOOTHING) / (n + quality.SMOOTHING * quality.BUCKETS))

    want = Counter()
    for r in rows:
        g = grams(r[1])
        want[r[0], round(sum(ratio(x, int(r[0] in good)) for x in g) / max(1, len(g)), 9)] += 1
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want


def test_mixing_takes_hashes_in_order(docs):
    """What a source's rest is filled with: documents by ascending hash, the last one if that comes nearer."""
    got = mixing.mix(docs).collect()
    size, h = mixing._keyed(docs, 7)
    keyed = docs.select("doc_id", "source", size.alias("size"), h.alias("h")).collect()
    by, targets = defaultdict(list), {}
    for r in keyed:
        by[r.source].append(r)
    for r in got:
        targets[r.source] = r.target
    want = Counter()
    for source, members in by.items():
        n = sum(r.size for r in members)
        passes = min(int(targets[source] // n), 3) if n else 0
        left, extra, words = targets[source] - passes * n, set(), Counter()
        for r in members:
            words[r.h] += r.size
        for value in sorted(words) if left > 0 else ():
            if words[value] > left:
                if 2 * left > words[value]:
                    extra.add(value)
                break
            extra.add(value)
            left -= words[value]
        for r in members:
            want[r.doc_id, (passes + (r.h in extra)) * r.size] += 1
    assert Counter((r.doc_id, r.taken) for r in got) == want


def plain_scan(text):
    """Labels, score and spans of a text by its words."""
    w, labels, best, spans = license.template_words(text or ""), set(), 0.0, []
    all_, _ = license._templates()
    for label, template, base in all_:
        t = license.template_words(template)
        runs = [tuple(t[q : q + 3]) for q in range(len(t) - 2)]
        diagonals = defaultdict(set)
        for p in range(len(w) - 2):
            for q, run in enumerate(runs):
                if tuple(w[p : p + 3]) == run:
                    diagonals[p - q].add(q)
        near, least = (license.NEAR, license.COVERED) if len(t) >= license.LONG else (0, 1.0)
        group = []
        for d in [*sorted(diagonals), None]:
            if group and (d is None or d - group[-1] > near):
                covered = len(set().union(*(diagonals[x] for x in group))) / len(runs)
                if covered >= least:
                    labels.add(label)
                    best = max(best, covered)
                    spans.append((label, max(group[0], 0), len(t), round(covered, 9)))
                group = []
            group.append(d)
    return ",".join(sorted(labels)), round(best, 9), sorted(spans)


def test_license_spans(spark, docs, rows):
    mit, apache = license.TEMPLATES[0][1], license.TEMPLATES[1][1]
    extra = [
        (1, f"x {mit} y {mit.replace('without', 'with no')} {apache}"), (2, " ".join(mit.split()[10:40])), (3, "of the software " * 60), (4, " ".join(apache.split()[:24])),
        (5, mit.replace("charge, to any", "charge to nearly any").replace("sell copies", "sell, copies")), (6, "gnu general public license " * 3), (7, "under the mit under the mit license"),
    ]
    got = license.scan(docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect()
    have = Counter((r.doc_id, r.labels, round(r.score, 9), tuple(sorted((s.label, s.start, s.words, round(s.covered, 9)) for s in r.spans))) for r in got)
    want = Counter((i, labels, score, tuple(spans)) for i, (labels, score, spans) in ((r[0], plain_scan(r[1])) for r in [*rows, *extra]))
    assert have == want
    assert plain_scan(extra[2][1])[0] == "" and plain_scan(extra[4][1])[0] == "mit"


def cuts(word, pieces):
    """All ways to cut a word, as lists of piece numbers; -1 is a letter that is no piece."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        piece = pieces.get(word[:n], -1 if n == 1 else None)
        if piece is not None:
            yield from ([piece, *rest] for rest in cuts(word[n:], pieces))


def test_language_training(spark):
    """Expected counts over all segmentations, and the table after two rounds, from enumeration."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=langid.default_vocabulary())
    names = [sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    pieces = {p: n for n, p in enumerate(dict.fromkeys(names))}
    texts = [(1, "the cat sat on a mat", "en"), (2, "der hund und die katze", "de"), (3, "the end", "en"), (4, "öl ist da", "de"), (5, None, "en"), (6, "x", None)]
    model = langid.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    size, languages = len(pieces), ["de", "en"]
    assert model.languages == languages
    start = [1 / (i + 100) for i in range(size)]
    rows = {lang: [x / sum(start) for x in start] for lang in languages}
    for _ in range(langid.ROUNDS):
        counts = {lang: Counter() for lang in languages}
        for _, text, lang in texts:
            for word in (text or "").split() if lang else ():
                ways = [(math.prod(rows[lang][p] if p >= 0 else langid.FLOOR for p in way), way) for way in cuts("▁" + word, pieces)]
                total = sum(p for p, _ in ways)
                for p, way in ways:
                    for piece in way:
                        if piece >= 0:
                            counts[lang][piece] += p / total
        pooled = [sum(counts[lang][i] for lang in languages) + 0.01 for i in range(size)]
        pooled = [x / sum(pooled) for x in pooled]
        rows = {lang: [(counts[lang][i] + langid.PSEUDO * pooled[i]) / (sum(counts[lang].values()) + langid.PSEUDO) for i in range(size)] for lang in languages}
    for k, lang in enumerate(languages):
        assert list(model.table[:-1, k]) == pytest.approx(rows[lang], rel=1e-3)  # counts are rounded to six places
    got = langid.predict(spark.createDataFrame([(1, "the hund")], "doc_id long, text string"), model).select("score", F.col("lang_pred")).first()
    logs = [sum(math.log(sum(math.prod(rows[lang][p] if p >= 0 else langid.FLOOR for p in way) for way in cuts("▁" + w, pieces))) for w in ("the", "hund")) for lang in languages]
    assert got.lang_pred == languages[logs.index(max(logs))] and got.score == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), rel=1e-3)


NAMES = "id key h n row rows words trusted good b start piece rank salt size passes spans document own_id own_hash own_row doc text_hash times w component blocks label template pos uid ids length kind ctx anchors __row__ __pass__ __text__ __scores__".split()


def test_other_columns_change_nothing(spark, docs):
    """Operators give the same beside columns whose names also occur inside them, and pass these on where they pass columns on."""
    from braidlake.llm import jaccard, packing, suffix, tokenbin
    from braidlake.llm._common import Workspace

    few = docs.select("doc_id", "text", "lang", "source").where("doc_id < 40 or doc_id >= 1000 or doc_id is null")
    more = few.withColumns({c: F.lit(f"x{k}") for k, c in enumerate(NAMES)})
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in NAMES})
    rows = lambda df: Counter(map(str, df.collect()))
    for run in (lambda d: quality.judge(d, labels), mixing.mix, license.scan, packing.pack_documents, jaccard.link_components, suffix.dedup_report):
        assert rows(run(few)) == rows(run(more))
    with Workspace(spark, "t") as ws:
        for k, d in enumerate((few, more)):
            folder = ws.path(f"files{k}")
            got = rows(tokenbin.read_tokens(spark, folder, tokenbin.write_tokens(d, folder, shards=2), digest_only=True))
            assert k == 0 or got == before
            before = got
    for run in (jaccard.keep_one, suffix.remove, mixing.mixed_documents, lambda d: langid.predict(d, langid.train(few.where("lang = 'en'"))).drop("lang_pred", "score")):
        got = run(more)
        assert got.columns == more.columns and {(r["key"], r["__row__"]) for r in got.collect()} == {(f"x{NAMES.index('key')}", f"x{NAMES.index('__row__')}")}
        assert rows(got.select("doc_id", "text")) == rows(run(few).select("doc_id", "text"))


def test_conversations_beside_other_columns(spark):
    from braidlake.llm import chat
    from braidlake.llm._common import Workspace

    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b" * 300_000), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    more = turns.withColumns({c: F.lit(1) for c in ("tree_id", "node_id", "parent_id", "score", "rank", "depth", "up", "leaf", "path", "id", "key", "n")})
    with Workspace(spark, "t") as ws:
        got = [sorted(map(str, chat.format_trees(ws.table(chat.from_turns(t), f"m{k}"), ws).collect())) for k, t in enumerate((turns, more))]
    assert got[0] == got[1] and len(got[0]) == 2
