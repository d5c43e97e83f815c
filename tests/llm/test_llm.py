"""The training-data operators: edge cases, brute force, round trips and held-out accuracy on small tables."""

import base64
import gzip
import io
import random
import re
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernlake.llm import bpe_codec, chain_dedup, entropy_mix, html_extract, kneser_ney, license_scan, media_sniff, quality_rules, secret_scan, simhash_dedup
from fernlake.llm.common import pick
from fernlake.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = [a + b + c for a in ("ba", "du", "ki", "lo", "me", "sa", "ti", "vo") for b in ("ran", "lin", "mo", "tek", "pu") for c in ("", "da", "no", "ri", "sel")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Rows (doc_id, text) as documents with a further column that differs from another only by case."""
    full = [(i, t, "en", "s", None if t is None else len(t), "clash") for i, t in rows]
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(full, SCHEMA)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "x y " * 60_000), (6, "same text of words here"), (6, "same text of words here"), (None, "no id at all"), (7, "emoji \U0001f600 İß text")]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# 1 quality rules


def test_rules_edges(spark, edges):
    rule = quality_rules.Rule((("n_words", True, 1000.0),))
    got = {(r["doc_id"], r["rule_id"]) for r in quality_rules.decide(edges, [rule]).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, -1), (5, 1), (6, -1), (None, -1)} <= got
    assert quality_rules.decide(edges, [rule]).count() == len(EDGES)
    kept = quality_rules.keep(edges, [rule])
    assert kept.columns == edges.columns and kept.count() == 5
    assert quality_rules.keep(edges.limit(0), []).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(edges, none) == []


def test_rules_match_brute_force_and_held_out(docs, labels, spark):
    wide = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality_rules.fit(wide[0].filter("doc_id % 2 = 0"), wide[1])
    assert rules
    got = quality_rules.decide(wide[0].filter("doc_id % 2 = 1"), rules).join(wide[1], "doc_id").select("keep", "quality", "doc_id", "rule_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() > 0.97 and (~bad.keep).mean() > 0.75
    stats = quality_rules.with_statistics(wide[0].filter("doc_id % 2 = 1")).select("doc_id", *[F.col(f"__fl_{k}").alias(k) for k in quality_rules.NAMES]).toPandas()
    x = stats[list(quality_rules.NAMES)].to_numpy(float)
    want = np.full(len(x), -1)
    for k, r in reversed(list(enumerate(rules, 1))):
        want[r.covers(list(quality_rules.NAMES), x)] = k
    by = dict(zip(stats.doc_id, want))
    assert all(by[i] == k for i, k in zip(got.doc_id, got.rule_id))


def test_grow_and_prune():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] < 0.5)
    rules = quality_rules.learn(["a", "b", "c"], x, bad)
    hit = np.any([r.covers(["a", "b", "c"], x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.95
    assert quality_rules.learn(["a"], x[:, :1], np.zeros(600, bool)) == []


def test_rules_bound_the_rows_that_teach(spark):
    many = spark.createDataFrame([(1, f"some words {i}", 1) for i in range(500)] + [(2, "!!! ??? !!!", 1)] * 5, "doc_id long, text string, x int")
    labels_ = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    learn, seen = quality_rules.learn, []
    quality_rules.learn = lambda names, x, bad, **o: seen.append(len(x)) or learn(names, x, bad, **o)
    try:
        quality_rules.fit(many, labels_, max_labelled=40)
        quality_rules.fit(many, labels_)
    finally:
        quality_rules.learn = learn
    assert seen == [40, 505]


# 2 secret scans


def test_secrets_match_brute_force(spark):
    """Every maximal run of the characters of secrets, judged on its own; the query's findings over a whole table."""
    t, p = secret_scan.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken"), re.compile(secret_scan.RUN % secret_scan.MIN_CHARS)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"], a, b, n, round(x, 6)) for r in rows if r["text"] for a, b, n, x in secret_scan.find(r["text"], t, p))
    got = sorted((r["doc_id"], r["start"], r["end"], r["n_tokens"], r["chars_per_token"]) for r in secret_scan.scan(docs).collect())
    assert got == want and want
    for i, a, b, n, x in want:
        run = next(r["text"] for r in rows if r["doc_id"] == i)[a:b]
        assert len(t.encode_ordinary(run)) == n and round(len(run) / n, 6) == x and not re.fullmatch(r"[0-9]+|[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", run)


def test_secrets():
    t = secret_scan.encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    p = re.compile(secret_scan.RUN % secret_scan.MIN_CHARS)
    find = lambda s: [s[a:b] for a, b, *_ in secret_scan.find(s, t, p)]
    secret = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    assert find(f'token = "{secret}" x') == [secret]
    assert find(f"commit {secret} x") == []  # a known digest
    assert find("id 123e4567-e89b-42d3-a456-426614174000") == []
    assert find("card 45296034611351470000000") == []
    assert find("key: xK9vQ2mZ7pL4wR8tB3nY6cD1") == ["xK9vQ2mZ7pL4wR8tB3nY6cD1"]
    assert find("see /usr/local/share/documents/readme") == []
    assert find("internationalization-of-things-everywhere") == []
    assert find("integrity sha256-47DEQpj8HBSa-/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=") == []


def test_secrets_edges(spark, edges):
    assert secret_scan.scan(edges).count() == 0
    hot = frame(spark, [(1, 'a token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" b'), *EDGES])
    out = secret_scan.redact(hot)
    assert out.columns == hot.columns and out.count() == len(EDGES) + 1
    first = [r for r in out.collect() if r[1] and "[SECRET]" in r[1]]
    assert len(first) == 1 and first[0][1] == 'a token = "[SECRET]" b' and first[0][4] == len(first[0][1])
    assert secret_scan.redact(edges.limit(0)).count() == 0


# 3 substring dedup


def test_chains_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(2, 9)
        blocks = np.array(sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(n)}))
        blocks = np.column_stack([blocks, blocks[:, 0], np.ones(len(blocks), int)])
        best = chain_dedup.chained(blocks, 3)[0]

        def score(c):
            s = chain_dedup.WORTH
            for u, v in zip(c, c[1:]):
                da, db = blocks[v, 0] - blocks[u, 0] - 3, blocks[v, 1] - blocks[u, 1] - 3
                if da < 0 or db < 0:
                    return -1e9
                s += chain_dedup.WORTH - chain_dedup.GAP * (da + db)
            return s

        all_ = [[i for i in range(len(blocks)) if m >> i & 1] for m in range(1, 1 << len(blocks))]
        assert score(best) == pytest.approx(max(map(score, all_)))


def test_alignment():
    x, y = "z a b c d e f g h i j k l".split(), "z a b c X d e f g i j k l".split()
    xs, xe, ys, ye, equal, columns = chain_dedup.align(x, y, np.array([[4, 5, 4]]))  # d e f g
    assert (xs, xe, ys, ye) == (0, 13, 0, 13) and equal == 12 and columns == 14
    assert chain_dedup.distance(list("kitten"), list("sitting")) == (4, 7)


def test_repeats(spark):
    rng = random.Random(2)
    passage = [rng.choice(WORDS) + str(i % 7) for i in range(80)]
    edited = list(passage)
    for i in (20, 45, 66):
        edited[i] = "changed"
    rows = [(1, prose(rng, 100) + " " + " ".join(passage) + " " + prose(rng, 50)), (2, prose(rng, 30) + " " + " ".join(edited).upper() + ". " + prose(rng, 120)), (3, prose(rng, 300))]
    copy = prose(rng, 90)
    rows += [(10 + i, copy) for i in range(12)] + [(10, copy)] + EDGES
    got = chain_dedup.repeats(frame(spark, rows)).collect()
    pairs = {(r["doc_id"], r["partner_id"]) for r in got}
    assert (1, 2) in pairs and (2, 1) in pairs and not any(3 in p for p in pairs)
    assert {i for p in pairs for i in p} >= set(range(10, 22))
    r = next(r for r in got if (r["doc_id"], r["partner_id"]) == (2, 1))
    assert r["n_words"] >= 78 and r["identity"] > 0.9
    assert rows[1][1][r["start"] : r["end"]].lower().startswith(edited[0])
    assert chain_dedup.repeats(frame(spark, rows).limit(0)).count() == 0


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(41)
    texts = ["", "a b", "One, two three four five", "\u0130stanbul x\u00b2 y_z \U0001f600 \U00010400 k l m n o p", *[prose(rng, n) for n in (3, 4, 5, 70, 300)], "x y " * 400]
    h, counts = chain_dedup.hashes(texts, 50)
    assert counts.tolist() == [len(chain_dedup.WORD.findall(t)) for t in texts]
    words = [w for t in texts for w in chain_dedup.WORD.findall(t)]
    lower = lambda w: "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
    assert len({lower(w) for w in words}) == len(set(h.tolist())) == len(set(zip(map(lower, words), h.tolist())))
    assert (chain_dedup.hashes(texts)[0] == h).all()
    whole = chain_dedup.Seeds(texts)
    every = np.arange(len(whole.keys))
    rows = list(zip(whole.owner.tolist(), whole.pos.tolist(), whole.keys.tolist(), whole.ahead(every).tolist(), whole.near(every).tolist()))
    for i, t in enumerate(texts):
        one = chain_dedup.Seeds([t])
        every = np.arange(len(one.keys))
        assert [r[1:] for r in rows if r[0] == i] == list(zip(one.pos.tolist(), one.keys.tolist(), one.ahead(every).tolist(), one.near(every).tolist()))
        assert len(set(one.keys.tolist())) == len(one.keys)


def test_repeats_with_edits(spark):
    rng, rows, kinds = random.Random(8), [], {}
    for words, share in ((50, 0.1), (50, 0.15), (60, 0.2), (80, 0.2)):
        for _ in range(40):
            i = len(rows)
            q = [f"q{i}x{j}" for j in range(words)]
            v = list(q)
            for j in rng.sample(range(1, words - 1), round(words * share)):
                v[j] = f"r{i}x{j}"
            for t in (q, v):
                kinds[len(rows)] = words, share
                rows.append((len(rows), " ".join([f"a{len(rows)}w{j}" for j in range(30)] + t + [f"b{len(rows)}w{j}" for j in range(30)])))
    got = {r["doc_id"] for r in chain_dedup.repeats(frame(spark, rows)).collect()}
    for kind in set(kinds.values()):
        of = [i for i, x in kinds.items() if x == kind]
        assert len(got.intersection(of)) >= 0.85 * len(of), (kind, len(got.intersection(of)), len(of))


def test_repeats_of_overlapping_quotes(spark):
    rng = random.Random(31)
    popular = [f"p{i}" for i in range(400)]
    rows, at = [], []
    for i in range(1500):
        n = rng.choice([13, 16, 20, 55])
        s = rng.randrange(len(popular) - n)
        fill = [f"d{i}w{j}" for j in range(20)]
        rows.append((i, " ".join(fill[:10] + popular[s : s + n] + fill[10:])))
        at.append((s, s + n))
    got = {r["doc_id"]: r["c"] for r in chain_dedup.repeats(frame(spark, rows)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("c")).collect()}
    docs = words = found = covered = 0
    for i, (s, e) in enumerate(at):
        shared = set()
        for j, (x, y) in enumerate(at):
            if j != i and min(e, y) - max(s, x) >= 50:
                shared |= set(range(max(s, x), min(e, y)))
        if not shared:
            continue
        docs, words, found = docs + 1, words + len(shared), found + (i in got)
        for m in re.finditer(r"\bp(\d+)\b", rows[i][1]):
            covered += int(m[1]) in shared and any(r["start"] <= m.start() and m.end() <= r["end"] for r in got.get(i, ()))
    assert docs > 300 and found == docs and covered >= 0.99 * words, (docs, found, words, covered)


@pytest.mark.parametrize(("pieces", "share"), [(3, 0.0), (30, 0.0), (60, 0.0), (200, 0.0), (60, 0.15), (200, 0.15)])
def test_repeats_behind_partial_copies(spark, pieces, share):
    """80 words in two texts, exactly or with edits, while many others hold 20 words of the same passage."""
    rng, rows = random.Random(17), []
    for i in range(20):
        q = [f"q{i}x{j}" for j in range(80)]
        v = [f"r{i}x{j}" if rng.random() < share else w for j, w in enumerate(q)]
        for t in (q, v):
            rows.append((len(rows), " ".join([f"a{len(rows)}w{j}" for j in range(20)] + t + [f"b{len(rows)}w{j}" for j in range(20)])))
    for i in range(20):
        for m in range(pieces):
            s = rng.randrange(61)
            fill = [f"c{i}m{m}w{j}" for j in range(20)]
            rows.append((len(rows), " ".join(fill[:10] + [f"q{i}x{j}" for j in range(s, s + 20)] + fill[10:])))
    got = {(r["doc_id"], r["partner_id"]) for r in chain_dedup.repeats(frame(spark, rows)).collect()}
    found = sum((2 * i, 2 * i + 1) in got for i in range(20))
    assert found >= (20 if share == 0 else 18) and not any(i >= 40 for p in got for i in p), found


def test_repeats_match_brute_force(spark):
    """All pairs of texts by local alignment: every text with a passage is found, its words are covered, and nothing else is returned."""
    rng = random.Random(23)
    rows = [[rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(20, 200))] for _ in range(90)]
    for _ in range(60):  # plant stretches of other texts, edited or not
        a, b = rng.sample(range(90), 2)
        n = rng.randint(10, 100)
        at = rng.randrange(max(1, len(rows[a]) - n))
        new = [w for w in rows[a][at : at + n] if rng.random() >= 0.03]
        new = [rng.choice(WORDS) if rng.random() < rng.choice([0, 0.1, 0.15]) else w for w in new]
        put = rng.randrange(len(rows[b]) + 1)
        rows[b][put:put] = new
    numbers = {w: i for i, w in enumerate({w for r in rows for w in r})}

    def local(x, y):  # best local alignment, 1 for equal words and -2 for others: ends, length, equal words
        best, table = (0, 0, 0, 0, 0), [(0, 0, 0, 0)] * (len(y) + 1)  # score, start in x, start in y, equal
        for i, u in enumerate(x, 1):
            new = [(0, i, 0, 0)]
            for j, v in enumerate(y, 1):
                d, l, t = table[j - 1], new[j - 1], table[j]
                if d[0] == 0:
                    d = (0, i - 1, j - 1, 0)
                c = max((d[0] + (1 if u == v else -2), *d[1:3], d[3] + (u == v)), (l[0] - 2, *l[1:]), (t[0] - 2, *t[1:]))
                if c[0] <= 0:
                    c = (0, i, j, 0)
                new.append(c)
                if c[0] > best[0]:
                    best = (c[0], c[1], i, j - c[2], c[3])
            table = new
        return best

    want = {}
    coded = [[numbers[w] for w in r] for r in rows]
    sets = [set(zip(c, c[1:], c[2:])) for c in coded]
    for a in range(90):
        for b in range(90):
            if a != b and len(sets[a] & sets[b]) >= 3:
                _, s, e, m, equal = local(coded[a], coded[b])
                if min(e - s, m) >= chain_dedup.MIN_WORDS and equal >= 0.85 * max(e - s, m):
                    want.setdefault(a, set()).update(range(s, e))
    got: dict[int, set] = {}
    for r in chain_dedup.repeats(frame(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])).collect():
        at = [m.start() for m in re.finditer(r"\S+", " ".join(rows[r["doc_id"]]))]
        got.setdefault(r["doc_id"], set()).update(k for k, p in enumerate(at) if r["start"] <= p < r["end"])
        assert len(sets[r["doc_id"]] & sets[r["partner_id"]]) >= 3 and r["n_words"] >= chain_dedup.MIN_WORDS and r["identity"] >= chain_dedup.MIN_IDENTITY
    assert len(want) > 20 and len(want.keys() & got.keys()) >= 0.95 * len(want)
    assert sum(len(w & got.get(i, set())) for i, w in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_repeats_reach_beyond_the_margin(spark):
    rng = random.Random(29)
    long = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(600)]
    edited = [w if i % 9 else "other" + str(i) for i, w in enumerate(long)]
    rows = [(1, "x1 y1 z1 " + " ".join(long)), (2, " ".join(edited) + " x2 y2"), (3, prose(rng, 200))]
    get = lambda **o: sorted(tuple(r) for r in chain_dedup.repeats(frame(spark, rows), **o).collect())
    assert get(margin=0) == get(margin=4, broadcast_rows=0) == get() and len(get()) == 2 and get()[0][6] > 570


def test_long_texts_with_unrelated_middles(spark):
    import time

    rng = random.Random(37)
    flanks = [[rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(20_000)] for _ in range(2)]
    middles = [[f"m{i}w{j}" for j in range(4_000)] for i in range(2)]
    texts = [" ".join(flanks[0] + m + flanks[1]) for m in middles]
    x, y = (chain_dedup.Seeds([t]) for t in texts)
    _, i, j = np.intersect1d(x.keys, y.keys, return_indices=True)
    blocks = chain_dedup.merged(x.pos[i], y.pos[j], chain_dedup.REACH)
    began = time.perf_counter()
    chains = [p for c in chain_dedup.chained(blocks, chain_dedup.K) for p in chain_dedup.parted(blocks[c], chain_dedup.K)]
    for c in chains:
        chain_dedup.align(*(t.split() for t in texts), np.column_stack([c[:, 0], c[:, 1], c[:, 2] - c[:, 0] + chain_dedup.K]))
    assert time.perf_counter() - began < 1
    got = chain_dedup.repeats(frame(spark, list(enumerate(texts)))).collect()
    assert sorted((r["doc_id"], r["n_words"]) for r in got) == [(0, 20_000)] * 2 + [(1, 20_000)] * 2


def test_classes_lose_no_link(spark, edges):
    """Against all pairs of texts: classes connect every link, also behind many texts that share most of a passage with either text (neighbours alone lost 8 of 17)."""
    rng, texts = random.Random(2), []
    for i in range(20):
        q = [f"q{i}x{j}" for j in range(60)]
        v = [f"r{i}x{j}" if rng.random() < 0.2 else w for j, w in enumerate(q)]
        for t in (q, v):
            texts.append(" ".join([f"a{len(texts)}w{j}" for j in range(20)] + t + [f"b{len(texts)}w{j}" for j in range(20)]))
        for m in range(50):
            s = rng.randrange(60 - 34)
            fill = [f"c{i}m{m}w{j}" for j in range(20)]
            texts.append(" ".join(fill[:10] + (q if m % 2 else v)[s : s + 34] + fill[10:]))
    of = [chain_dedup.Seeds([t]) for t in texts]
    links = []
    for a in range(len(texts)):
        for b in range(a + 1, min(len(texts), a // 52 * 52 + 52)):  # only those of one i share words
            _, i, j = np.intersect1d(of[a].keys, of[b].keys, return_indices=True)
            if len(i) < 2:
                continue
            blocks = chain_dedup.merged(of[a].pos[i], of[b].pos[j], chain_dedup.REACH)
            for c in (p for c in chain_dedup.chained(blocks, chain_dedup.K) for p in chain_dedup.parted(blocks[c], chain_dedup.K)):
                if c[:, 3].sum() >= 2 and c[:, 5].max() - c[:, 4].min() >= 26:
                    xs, xe, ys, ye, equal, columns = chain_dedup.align(texts[a].split(), texts[b].split(), np.column_stack([c[:, 0], c[:, 1], c[:, 2] - c[:, 0] + chain_dedup.K]))
                    if min(xe - xs, ye - ys) >= chain_dedup.MIN_WORDS and equal >= chain_dedup.MIN_IDENTITY * columns:
                        links.append((a, b))
    rows = list(enumerate(texts)) + [(10_000, texts[0]), (10_000, texts[0]), (None, texts[3])]
    for crowd in (3, chain_dedup.CROWD):
        got = chain_dedup.classes(frame(spark, rows), crowd=crowd).collect()
        assert len(got) == len(rows)
        classes = {r["doc_id"]: r["class_id"] for r in got}
        assert len(links) > 10 and all(classes[a] == classes[b] for a, b in links)
        assert classes[10_000] == classes[0] and classes[None] == classes[3]
        sizes = {r["class_id"]: r["class_size"] for r in got}
        assert all(sizes[c] == sum(r["class_id"] == c for r in got) for c in sizes) and sum(sizes.values()) == len(rows)
        assert sum(r["class_size"] == 1 for r in got) > 0.9 * len(rows)
    assert all(r["class_size"] == 1 and r["class_id"] == r["doc_id"] for r in chain_dedup.classes(edges).collect() if r["doc_id"] != 5)
    assert chain_dedup.classes(edges.limit(0)).count() == 0


def test_crossing_sends_matches_once(spark):
    """Texts with many popular seeds in common: their matches are those of all twos, in a few rows for each pair (a row for each match of each two before)."""
    rng, span = random.Random(7), (22, 52)
    texts = {}
    for n in range(40):
        kept = sorted(rng.sample(range(60), 45))
        texts[n] = [(1 + (x + 1) * 0x9E3779B97F4A7C15 % 2**64, x + 5 * n) for x in kept]
    runs = spark.createDataFrame([(n, np.array([k for k, _ in r], "<u8").tobytes() + np.array([p for _, p in r], "<i4").tobytes()) for n, r in texts.items()], "node long, blocks binary")
    roots = spark.createDataFrame([(n, n // 4) for n in range(0, 40, 2)], "node long, root long")
    want = {}
    for a in texts:
        for b in range(a + 1, 40):
            if a % 2 == b % 2 == 0 and a // 4 == b // 4:
                continue
            place = dict(texts[b])
            for i, (x, p) in enumerate(texts[a]):
                for y, q in texts[a][i:]:
                    if span[0] <= q - p < span[1] and x in place and y in place:
                        want.setdefault((a, b), []).extend([(p, place[x]), (q, place[y])])
    # roots are numbers of texts here too, so odd texts up to 9 may share a class with others: those pairs are left out
    same = {n: n // 4 if n % 2 == 0 else n for n in texts}
    want = {p: sorted(m) for p, m in want.items() if same[p[0]] != same[p[1]]}
    rows = chain_dedup.crossing(runs, roots, span, "all").collect()
    got = {}
    for r in rows:
        x, far, many = np.frombuffer(r["matches"], "<i4").reshape(3, -1)
        got.setdefault((r["a"], r["b"]), []).extend((int(p), int(p + d)) for p, d, n in zip(x, far, many) for _ in range(n))
    assert {p: sorted(m) for p, m in got.items()} == want
    assert len(want) > 500 and len(rows) < sum(map(len, want.values())) / 20


def test_pieces_of_a_text_are_shared(spark, monkeypatch):
    """What overlapping chains want of a text is one piece in each cell (one for each chain before), and classes don't depend on the cells."""
    texts = {n: " ".join(f"t{n}w{j}" for j in range(300)) for n in range(3)}
    docs = spark.createDataFrame([(n, n, t) for n, t in texts.items()], "node long, doc_id long, text string")
    rows, chunk, _ = chain_dedup.dealt(docs, 1_000_000, 1_000_000)
    wanted = spark.createDataFrame([(n, c, 100 + i, 130 + 2 * i) for n in texts for c in range(2) for i in range(20)] + [(0, 0, 290, 300)], "node long, cell long, from int, to int")
    got = chain_dedup.cut_out_once(rows, wanted.select(chunk, "*"), 10).collect()
    assert sorted((r["node"], r["cell"], r["first"], r["more"]) for r in got) == sorted([(n, c, 90, True) for n in texts for c in range(2)] + [(0, 0, 280, False)])
    for r in got:
        words = texts[r["node"]].split()
        assert r["piece"].split() == (words[90:178] if r["first"] == 90 else words[280:])
    rng = random.Random(3)
    quotes = [[f"q{i}x{j}" for j in range(50)] for i in range(6)]
    many = [(n, " ".join([f"a{n}w{j}" for j in range(rng.randrange(90))] + (quotes[n % 6] if n % 5 else quotes[n % 6][:30]) + [f"b{n}w{j}" for j in range(rng.randrange(90))])) for n in range(120)]
    get = lambda: sorted(tuple(r) for r in chain_dedup.classes(frame(spark, many), crowd=8).collect())
    usual = get()
    monkeypatch.setattr(chain_dedup, "CELL_TEXTS", 2)
    assert get() == usual
    assert sorted({c for _, c, size in usual if size > 1}) == sorted({min(n for n in range(i, 120, 6) if n % 5) for i in range(6)})
    assert all((size == 1) == (n % 5 == 0) for n, _, size in usual)


def test_best_alignment_is_a_bound():
    rng = random.Random(5)
    for _ in range(200):
        x, y = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        (equal, columns), (most, least) = chain_dedup.distance(x, y), chain_dedup.at_best(x, y)
        assert most >= equal and least <= columns


# 4 byte-level BPE


def test_bpe_round_trip(spark, edges, docs):
    from tokenizers import Tokenizer

    both = docs.limit(60).select("doc_id", "text").union(pick(edges, "doc_id", "text"))
    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    out = bpe_codec.decode(bpe_codec.encode(both.withColumn("copy", F.col("text")), keep=True, chunk_bytes=20_000)).collect()
    assert len(out) == both.count()
    for r in out:
        assert r["decoded"] == r["text"] == r["copy"]
        if r["text"] is None:
            assert r["token_ids"] is None
        else:
            assert r["token_ids"] == reference.encode(r["text"], add_special_tokens=False).ids
    staged = bpe_codec.stage(spark, edges, SF)
    assert staged.columns == [*edges.columns, "token_ids", "decoded", "n_tokens"] and staged.count() == len(EDGES)
    assert bpe_codec.stage(spark, edges.limit(0), SF).count() == 0


def test_bpe_stage_decodes(spark):
    df = spark.createDataFrame([(1, "some words, some more"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["decoded"] for r in bpe_codec.stage(spark, df, SF).select("doc_id", "decoded").collect()}
    assert got == {1: "some words, some more", 2: None, 3: ""}


def test_bpe_by_merges_and_unknown_ids(spark):
    rank = bpe_codec.ranks("/opt/tokenizers/byte_bpe_50k.tiktoken")
    encoded = bpe_codec.word_encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")

    def merge(word):  # by definition: the adjacent pair of the lowest rank, the first of equals
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            known = [(rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in rank]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [rank[p] for p in parts]

    rng = random.Random(3)
    for _ in range(80):
        w = "".join(rng.choice("abcdethe snré\U0001f600") for _ in range(rng.randint(1, 150))).encode()
        assert encoded(w) == merge(w) or w in rank


def test_bpe_splits_alike():
    import regex

    full, split = regex.compile(bpe_codec.PATTERN).findall, bpe_codec.splitter()
    for c in [*range(0x300), 0x2167, 0x2009, 0x1F600, 0x3000, 0x661]:
        for s in (chr(c), f"a{chr(c)}b", f" {chr(c)} x", f"{chr(c)}{chr(c)}1", f"1{chr(c)}\n "):
            assert split(s) == full(s)


def test_bpe_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe_codec.decode(spark.createDataFrame([([99_999_999],)], "token_ids array<int>")).collect()


# 5 Kneser-Ney


def test_kneser_ney_is_a_distribution_and_matches_brute_force(spark):
    texts = ["abab abc", "abca bc", "cab bac abab", "aabb ccab"]
    order = 3
    top: dict[int, int] = {}
    for t in texts:
        for p, at, _ in kneser_ney.stretches([t], order):
            for k in kneser_ney.keys(p, order)[-1][at]:
                top[int(k)] = top.get(int(k), 0) + 1
    model = kneser_ney.train(spark.createDataFrame([("en", k, n) for k, n in top.items()], "lang string, k long, n long"), order).collect()
    local = {}
    for n in range(order + 1):
        rows = sorted((r["key"], np.nan if r["p"] is None else r["p"], np.nan if r["g"] is None else r["g"]) for r in model if r["n"] == n)
        local[n] = tuple(np.array(c) for c in zip(*rows))
    chars = sorted({c for t in texts for c in t})

    def prob(context, c):
        p = np.array([kneser_ney.START] * (order - 1) + [ord(x) for x in context + c], np.uint32)
        ks = kneser_ney.keys(p, order)
        return float(np.exp(kneser_ney.log_probabilities([k[-1:] for k in ks], [k[-2:-1] for k in ks[:-1]], local))[0])

    for context in ("ab", "ca", "zz", ""):
        assert sum(prob(context, c) for c in chars) + prob(context, "?") == pytest.approx(1, abs=1e-5)

    # the same by definition
    grams = {order: {}}
    for k, n in top.items():
        grams[order][tuple(k >> 16 * i & 0xFFFF for i in range(order - 1, -1, -1))] = n
    for n in range(order - 1, 0, -1):
        grams[n] = {}
        for g in grams[n + 1]:
            grams[n][g[1:]] = grams[n].get(g[1:], 0) + 1

    def discounts(n):
        c = [sum(v == i for v in grams[n].values()) for i in range(1, 5)]
        out = []
        for i in (1, 2, 3):
            d = i - (i + 1) * (c[0] / (c[0] + 2 * c[1])) * c[i] / c[i - 1] if c[0] and c[i - 1] else 0.5 * i
            out.append(min(max(d, 0.05 * i), 0.95 * i))
        return out

    def brute(g):
        n = len(g)
        if n == 0:
            kinds = grams[1]
            d = discounts(1)
            return sum(d[min(v, 3) - 1] for v in kinds.values()) / sum(kinds.values()) / (len(kinds) + 1)
        d = discounts(n)
        inside = {k: v for k, v in grams[n].items() if k[:-1] == g[:-1]}
        if not inside:
            return brute(g[1:])
        total, c = sum(inside.values()), inside.get(g, 0)
        left = sum(d[min(v, 3) - 1] for v in inside.values()) / total
        lower = brute(g[1:]) if n == 1 else left * brute(g[1:])
        return (c - d[min(c, 3) - 1] if c else 0) / total + lower

    for context, c in (("ab", "a"), ("ca", "b"), ("bc", "c"), ("zz", "a")):
        assert prob(context, c) == pytest.approx(brute(tuple(map(ord, context + c))), rel=1e-5)


def test_classifier(spark, docs, labels, edges):
    got = kneser_ney.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.9
    assert got[got.quality == 0].perplexity.median() > got[got.quality == 1].perplexity.median()
    out = kneser_ney.classify(edges, labels.filter("doc_id = 6")).collect()
    assert len(out) == len(EDGES) and sum(r["perplexity"] is None and not r["keep"] for r in out) == 3
    nothing = kneser_ney.classify(edges, labels.limit(0)).collect()
    assert len(nothing) == len(EDGES) and all(r["perplexity"] is None for r in nothing)
    assert kneser_ney.classify(edges.limit(0), labels).count() == 0


def test_stretches_cut_by_characters():
    texts = ["", "ab", None, "a b\U0001f600c " * 50, "xyz", "q" * 37]
    whole = [[] for _ in texts]
    for p, at, owner in kneser_ney.stretches(texts, 4, 10**9):
        for k, i in zip(kneser_ney.keys(p)[-1][at].tolist(), owner.tolist()):
            whole[i].append(k)
    assert [len(w) for w in whole] == [0, 2, 0, 299, 3, 37]
    for most in (3, 7, 50):
        parts = [[] for _ in texts]
        for p, at, owner in kneser_ney.stretches(texts, 4, most):
            assert len(p) < 2 * most + 3 * len(texts) + 3
            for k, i in zip(kneser_ney.keys(p)[-1][at].tolist(), owner.tolist()):
                parts[i].append(k)
        assert parts == whole


def test_classifier_long_texts_and_null_ids(spark, docs, labels):
    rng = random.Random(19)
    rows = [(None, prose(rng, 20 + i % 5), "en") for i in range(600)] + [(10_000 + i, prose(rng, 60_000), "en") for i in range(2)] + [(10_002, "same words", None)] * 3
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(extra)
    few = {(r["doc_id"], round(r["perplexity"] or 0, 6), r["keep"]) for r in kneser_ney.classify(both, labels, chunk_bytes=40_000).collect()}
    one = kneser_ney.classify(both, labels).collect()
    assert {(r["doc_id"], round(r["perplexity"] or 0, 6), r["keep"]) for r in one} == few and len(one) == both.count()
    assert sum(r["doc_id"] is None for r in one) == 600 and sum(r["doc_id"] == 10_002 and r["perplexity"] is None and r["keep"] for r in one) == 3
    d = extra.select("doc_id", "text", "lang")
    sizes = kneser_ney.dealt(d, labels.select("doc_id").limit(0), 2_000)[0].groupBy("chunk").count().count()
    assert sizes > 20  # rows without doc_id are spread


# 6 licence scans


def test_licenses(spark, edges):
    names = lambda s: [license_scan.rules()[d[3]][0] for d in license_scan.detect(s)]
    assert len(license_scan.rules()) > 200
    assert names("Licensed under the Apache License,\n * Version 2.0 (the") == ["Apache-2.0"]
    assert names("GNU Lesser General Public License v2.1 and the MIT License") == ["LGPL-2.1-only", "MIT"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("submit licensed materials") == []
    for name, _, expression, keyword in license_scan.rules():  # the gate holds a literal of every match
        assert keyword and keyword == keyword.lower()
    text = " ".join(["This is under the MIT license", "SPDX-License-Identifier: ISC", "see gnu.org/licenses/gpl-3.0.html"])
    brute = license_scan.resolve([(m.start(), m.end(), r[1], i) for i, r in enumerate(license_scan.rules()) for m in r[2].finditer(text)])
    assert license_scan.detect(text) == brute
    assert license_scan.scan(edges).count() == 0
    assert license_scan.scan(frame(spark, [(1, text), (1, text)])).count() == 2 * len(brute)


def test_resolving_by_brute_force():
    def slow(found):
        kept = []
        for start, end, priority, rule in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
            if not any(start < b and a < end and (p > priority or (a <= start and end <= b)) for a, b, p, _ in kept):
                kept.append((start, end, priority, rule))
        return sorted(kept)

    rng = random.Random(43)
    for _ in range(400):
        found = [(a, a + rng.randint(1, 12), rng.randint(1, 4), rng.randint(0, 5)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 40)))]
        assert license_scan.resolve(found) == slow(found)
    import time

    many = [(i * 3, i * 3 + 9, i % 3, i % 50) for i in range(40_000)]
    began = time.perf_counter()
    license_scan.resolve(many)
    assert time.perf_counter() - began < 2


# 7 entropy balancing


def test_mixing(spark, edges):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 300)), s) for i in range(300) for s in ("abc"[min(i % 7, 2)],)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = entropy_mix.rates(df, {"a": 1, "b": 1, "c": 2}, temperature=1).toPandas()
    t = (r.rate * r.tokens).groupby(r.source).sum() / r.tokens.sum()
    assert t["a"] == pytest.approx(0.25, abs=1e-6) and t["c"] == pytest.approx(0.5, abs=1e-6)
    z = np.log(r.tokens)
    assert (r.rate * r.tokens * z).sum() / (r.rate * r.tokens).sum() == pytest.approx((r.tokens * z).sum() / r.tokens.sum(), abs=1e-6)
    # log-rates are affine in (source, log length): the exponential tilt of the optimum
    a = np.column_stack([(r.source == s) for s in "abc"] + [z]).astype(float)
    assert np.abs(a @ np.linalg.lstsq(a, np.log(r.rate), rcond=None)[0] - np.log(r.rate)).max() < 1e-8
    assert abs((r.copies * r.tokens).sum() / r.tokens.sum() - 1) < 0.15
    assert entropy_mix.mix(df, {"a": 1, "b": 1, "c": 2}).count() == r.copies.sum()
    out = entropy_mix.mix(edges)
    assert out.columns == edges.columns
    assert entropy_mix.rates(edges).count() == len(EDGES) and entropy_mix.mix(edges.limit(0)).count() == 0
    assert {x["rate"] for x in entropy_mix.rates(df, {"zz": 1}).collect()} == {0.0}


def test_mixing_many_sources_and_targets_out_of_reach(spark):
    rows = [(i, "w " * (1 + i % 7), f"host{i % 900}") for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    s = entropy_mix.solve(entropy_mix.statistics(df))
    by = entropy_mix.rates(df).toPandas()
    small = entropy_mix.with_rate(entropy_mix.statistics(df), s, F.col("source"), F.col("tokens"), "rate", broadcast_rows=10).toPandas()
    assert np.allclose(by.sort_values("doc_id").rate, small.sort_values("doc_id").rate)
    t = (by.rate * by.tokens).groupby(by.source).sum()
    old = by.tokens.groupby(by.source).sum() ** entropy_mix.TEMPERATURE
    assert np.allclose(t / t.sum(), old / old.sum(), atol=1e-7)
    # each source's documents are of one length: the shares settle the mean
    flat = spark.createDataFrame([(i, "w " * (100 if i % 2 else 10), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    r = entropy_mix.rates(flat, {"a": 3, "b": 1}).toPandas()
    t = (r.rate * r.tokens).groupby(r.source).sum()
    assert t["a"] / t.sum() == pytest.approx(0.75)
    steps, entropy_mix.MAX_STEPS = entropy_mix.MAX_STEPS, 1
    try:
        with pytest.raises(ArithmeticError):
            entropy_mix.solve(entropy_mix.statistics(df), {"host1": 1, "host2": 50})
    finally:
        entropy_mix.MAX_STEPS = steps


# 8 media


def png():
    c = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + c(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + c(b"IDAT", zlib.compress(b"\0\1\2\3")) + c(b"IEND", b"")


def test_media(spark):
    z, w = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "x")
    with wave.open(w, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"\0\1" * 50)
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\0\x08\1\1\0\0?\0\x12\xff\0\x34\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"
    gz, frame_ = gzip.compress(b"abc" * 30), b"\xff\xfb\x90\0" + b"\0" * 413
    cases = {png(): "image/png", gif: "image/gif", jpeg: "image/jpeg", bmp: "image/bmp", pdf: "application/pdf", gz: "application/gzip", w.getvalue(): "audio/wav", frame_ * 3: "audio/mpeg", b"plain words": "text/plain", b"\0\1\2\xff": "application/octet-stream", b"<svg xmlns='x'/>": "image/svg+xml"}
    for blob, kind in cases.items():
        assert media_sniff.sniff(blob)[0] == kind
        if media_sniff.sniff(blob)[1] == len(blob) and not kind.startswith(("text", "image/svg")):
            assert media_sniff.sniff(blob[:-2])[0] != kind or kind in ("application/pdf",)
            found = [x for x in media_sniff.sniff(b"junk junk " + blob + b" tail")[2]]
            assert (kind, 10, len(blob), "bytes") in found
    assert media_sniff.sniff(z.getvalue())[0].endswith("wordprocessingml.document")
    page = b'<!DOCTYPE html><img src="data:image/gif;base64,' + base64.b64encode(png()) + b'">'
    assert media_sniff.sniff(page)[2] == [("image/png", page.index(b"iVBOR"), len(png()), "data address")]
    df = spark.createDataFrame([(1, bytearray(png()), "image/jpeg"), (2, bytearray(png()), "image/png; x=1"), (3, None, None), (4, bytearray(b""), "a/b"), (4, bytearray(b""), "a/b")], "k long, content binary, declared string")
    got = {r["k"]: (r["detected"], r["corrected"]) for r in media_sniff.sniff_column(df, "k").collect()}
    assert got == {1: ("image/png", True), 2: ("image/png", False), 3: (None, False), 4: ("empty", False)}
    assert media_sniff.sniff_column(df.limit(0), "k").count() == 0


def test_media_clashing_names(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame([(1, bytearray(png()), "image/jpeg", "x", b"y", "z")], "k long, content binary, declared string, K string, Content binary, detected string")
    spark.conf.set("spark.sql.caseSensitive", "false")
    twice = df.toDF("k", "content", "declared", "k", "content", "declared")
    for d in (df, twice):
        r = media_sniff.sniff_column(d, "k").first()
        assert (r["k"], r["declared"], r["detected"], r["corrected"]) == (1, "image/jpeg", "image/png", True)


def test_media_signatures_by_brute_force():
    """Every place of a blob tried for itself finds what one pass of the automaton finds."""
    rng = random.Random(47)
    parts = [png(), b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;", gzip.compress(b"abc" * 30), b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"]
    for _ in range(30):
        blob, want = b"\1junk", set()
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(parts)
            want.add((len(blob), len(p)))
            blob += p + bytes(rng.randrange(1, 9) for _ in range(rng.randint(1, 30)))
        one = {(o, n) for _, o, n, how in media_sniff.sniff(blob)[2] if how == "bytes"}
        each = {(i, media_sniff.sniff(blob[i:])[1]) for i in range(1, len(blob)) if media_sniff.sniff(blob[i:])[0] not in ("application/octet-stream", "text/plain", "empty") and media_sniff.sniff(blob[i:])[1]}
        assert want <= one and want <= each


def test_media_inside_containers():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/media/a.png", png())
        f.writestr("word/media/b.png", png())
    blob = z.getvalue()
    kind, n, inside = media_sniff.sniff(blob)
    assert kind.endswith("wordprocessingml.document") and n == len(blob)
    assert [(k, m) for k, _, m, _ in inside] == [("image/png", len(png()))] * 2
    page = b"<html><img src='data:application/zip;base64," + base64.b64encode(blob) + b"'><img src=\"data:image/svg+xml,%3Csvg xmlns=''/%3E\"><img src='data:image/svg+xml,%3Csvg/%3E'>"
    found = [(k, how) for k, _, _, how in media_sniff.sniff(page)[2]]
    assert found.count(("image/png", "inside data address")) == 2 and found.count(("image/svg+xml", "data address")) == 2
    assert ("image/svg+xml", page.index(b"%3Csvg"), len("<svg xmlns=''/>"), "data address") in media_sniff.sniff(page)[2]


# 9 SimHash


def test_ball_meets_in_the_middle():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 40, 40, dtype=np.int64)
    for flips in range(5):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(40, flips, replace=False):
                y[i] ^= 1 << int(b)
        meet = [bool(set(a) & set(b)) for a, b in zip(simhash_dedup.ball(x).tolist(), simhash_dedup.ball(y).tolist())]
        assert all(meet) if flips <= simhash_dedup.RADIUS else not any(meet)


def test_packed_variants_match_brute_force(spark):
    rng = np.random.default_rng(61)
    sigs = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    near = np.repeat(sigs, rng.integers(1, 14, 40), axis=0)
    for s in near:
        for b in rng.choice(256, 3, replace=False):
            s[b // 8] ^= 1 << b % 8
    nodes = spark.createDataFrame([(7 * i + 10**12 * (i % 3), bytearray(s.tobytes())) for i, s in enumerate(near)], "node long, sig binary")
    by: dict[int, list] = {}
    variants = simhash_dedup.ball(simhash_dedup.fingerprints(near, simhash_dedup.drawn())).reshape(len(near), -1)
    for i, vs in enumerate(variants.tolist()):
        for v in vs:
            by.setdefault(v, []).append(7 * i + 10**12 * (i % 3))
    want = {tuple(sorted((a, b))) for m in by.values() if len(m) <= simhash_dedup.CROWD for a in m for b in m if a != b}
    crowds = {tuple(sorted(m)) for m in by.values() if len(m) > simhash_dedup.CROWD}
    assert crowds and len(want) > 50
    for size in (1_000, 10_000_000):
        got = simhash_dedup.links(nodes, shard_variants=size).collect()
        assert {tuple(sorted((r["a"], r["b"]))) for r in got if not r["crowd"]} == want
        sets: dict[int, list] = {}
        for r in got:
            if r["crowd"]:
                sets.setdefault(r["a"], []).append(r["b"])
        assert {tuple(sorted(m)) for m in sets.values()} == crowds


def test_components(spark):
    e = [(1, 2), (3, 2), (4, 5), (7, 7)] + [(100 + i, 101 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got[3] == 1 and got[5] == 4 and got[7] == 7 and got[150] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_buckets(spark):
    rng = np.random.default_rng(12)
    own = simhash_dedup.drawn(1)[0]
    rest = np.setdiff1d(np.arange(simhash_dedup.BITS), own)
    rows = []
    for pairs in (3, 40, 1):  # of one fingerprint: 6, 80 and 2 members, near in pairs only
        template = rng.integers(0, 2, simhash_dedup.BITS, np.uint8)
        for _ in range(pairs):
            x = template.copy()
            x[rest] = rng.integers(0, 2, len(rest))
            y = x.copy()
            y[rng.choice(rest, 30, replace=False)] ^= 1
            rows += [np.packbits(x), np.packbits(y)]
    cluster = rng.integers(0, 2, simhash_dedup.BITS, np.uint8)
    for i in range(30):  # near to the one before only
        cluster[rest[i * 7 % len(rest)]] ^= 1
        cluster[rng.choice(rest, 15, replace=False)] ^= 1
        rows.append(np.packbits(cluster))
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(rows)], "doc_id long, sig binary")
    ids = {s.tobytes(): i for i, s in enumerate(rows)}
    got = {ids[bytes(r["sig"])]: (r["group_id"], r["group_size"]) for r in simhash_dedup.decide_signed(df, tables=1).collect()}
    assert all(got[i] == (i // 2 * 2, 2) for i in range(88))
    assert all(got[i] == (88, 30) for i in range(88, 118))


def test_rows_without_words(spark):
    texts = ["\u2764\ufe0f", "\U0001f468\u200d\U0001f469", "\u0301\u0301", "\u203f", "\u00bd", "\u00bd", "words here", None, "", "words here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "\u00bd"), (9, "\ufe0f")]
    got = simhash_dedup.decide(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    groups = {(r["doc_id"], r["group_id"], r["group_size"], r["keep"]) for r in got}
    assert {(4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (9, 6, 2, False), (9, 9, 1, True)} <= groups
    assert {(i, i, 1, True) for i in (0, 1, 2, 3, 7, 8)} | {(None, None, 1, True)} <= groups
    kept = [(r[0], r[1]) for r in simhash_dedup.dedup(frame(spark, rows)).collect()]
    assert len(kept) == len(rows) - 2 and (9, "\ufe0f") in kept


def test_near_duplicates(spark):
    rng = random.Random(6)
    rows, pairs = [], []
    for i in range(40):
        words = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(80, 400))]
        near = [("changed" + str(rng.randint(0, 999)) if rng.random() < 0.03 else w) for w in words]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
        pairs.append((2 * i, 2 * i + 1))
    copies = [(1000 + i, "an exact copy of some words, again and again") for i in range(30)]
    df = frame(spark, rows + copies + [(1000, copies[0][1])] + [(9000 + (i or 0), t) for i, t in EDGES if i] + [(None, "no id at all")])
    got = simhash_dedup.decide(df).collect()
    assert len(got) == df.count()
    group = {r["doc_id"]: r["group_id"] for r in got}
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert len({group[a] for a, _ in pairs}) >= len(pairs) - 1
    assert {group[1000 + i] for i in range(30)} == {1000}
    kept = simhash_dedup.dedup(df)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == df.columns and ids.count(1000) == 1 and not set(range(1001, 1030)) & set(ids)
    assert {9001, 9002, 9003, None} <= set(ids)
    assert simhash_dedup.dedup(df.limit(0)).count() == 0


def test_dedup_matches_brute_force(spark):
    """Groups against all pairs of signatures, and the rows kept against the groups, ids repeated or not, broadcast or shuffled."""
    rng = random.Random(53)
    rows = []
    for i in range(60):
        words = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 200))]
        rows.append((i, " ".join(words)))
        for _ in range(rng.randint(0, 3)):
            rows.append((rng.choice([len(rows) + 100, i]), " ".join("new" + str(rng.randint(0, 99)) if rng.random() < 0.01 else w for w in words)))
    rows += [rows[0], rows[0], rows[5], (None, rows[0][1]), (9007, None), (9007, None)]
    df = frame(spark, rows)
    signer = simhash_dedup.Signer()
    sigs = [(i, t, signer(t)) for i, t in rows if i is not None and t]
    far = lambda a, b: np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum()
    root = list(range(len(sigs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sigs)):
        for y in range(x):
            if far(sigs[x][2], sigs[y][2]) <= simhash_dedup.MAX_DISTANCE:
                root[find(x)] = find(y)
    groups: dict[int, list] = {}
    for x, (i, t, _) in enumerate(sigs):
        groups.setdefault(find(x), []).append((i, t))
    got = {(r["doc_id"], r["group_id"], r["group_size"]) for r in simhash_dedup.decide(df).collect()}
    want = {(i, min(j for j, _ in g), len(g)) for g in groups.values() for i, _ in g}
    assert len(want & got) >= 0.9 * len(want)
    for limit in (0, 1_000_000):
        kept = [(r[0], r[1]) for r in simhash_dedup.dedup(df, broadcast_rows=limit).collect()]
        assert kept.count((None, rows[0][1])) == 1 and kept.count((9007, None)) == 2
        assert len(kept) - 3 == len({(g, n) for i, g, n in got if i is not None and g != 9007})
        assert len(set(kept)) == len(kept) - 1  # only the two rows without text are equal


# 10 HTML


def test_html_decoding_is_optimal_among_closed_choices():
    """Of all choices of nodes that keep each kept node's ancestors, the one with the greatest sum."""
    rng = np.random.default_rng(59)
    for _ in range(40):
        html, n = "", 0
        for _ in range(int(rng.integers(3, 9))):
            html += rng.choice(["<div>", "<p>", "</div>", "</p>", "<b>x</b>"]) + rng.choice(["", "some text "])
        nodes = html_extract.parse(html)
        n = len(nodes)
        if not 0 < n <= 12:
            continue
        odds, chars = rng.normal(size=n), np.array([len(html_extract.own_text(v)) for v in nodes], float)
        keep = html_extract.decode(nodes, odds, chars)
        at = {id(v): k for k, v in enumerate(nodes)}
        closed = lambda c: all(c[at[id(v.parent)]] for k, v in enumerate(nodes) if c[k] and v.parent is not None and id(v.parent) in at)
        gain = odds * np.log1p(chars)
        worth = lambda c: float(sum(g for g, k in zip(gain, c) if k))
        best = max(worth(c) for c in (tuple(m >> k & 1 for k in range(n)) for m in range(1 << n)) if closed(c))
        assert closed(keep) and worth(keep) == pytest.approx(best, abs=1e-6), html


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{x:'</p>'}</style></head><body><nav><ul>%s</ul></nav><div class='ad'>Buy now %d</div><article><h1>Title %d</h1>%s</article><footer>&copy; host</footer></body></html>"


def test_html(spark):
    rng = random.Random(7)
    pages = [(i, PAGE % ("".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 6)), i, i, "".join(f"<p>{prose(rng, rng.randint(8, 60))} &amp; more.{'<br><p>' if rng.random() < 0.2 else '</p>'}" for _ in range(6)))) for i in range(60)]
    trees = html_extract.fit(spark.createDataFrame(pages[:40], "page_id long, html string"))
    x = [html_extract.parse(h) for _, h in pages[40:]]
    right = [(trees.log_odds(html_extract.features(n))[k] > 0) == v.label for n in x for k, v in enumerate(n) if v.label is not None and html_extract.own_text(v)]
    assert np.mean(right) > 0.95
    rows = pages[40:42] + [(None, pages[40][1]), (70, None), (71, ""), (72, "<p>unclosed <a href='x"), (73, "<div>" * 3000 + "deep"), (70, None)]
    got = html_extract.apply(spark.createDataFrame(rows, "page_id long, html string"), trees).collect()
    assert len(got) == len(rows)
    text = next(r["text"] for r in got if r["page_id"] == 40)
    assert text.startswith("Title 40") and "Buy now" not in text and "host" not in text and "& more." in text
    assert [r["text"] for r in got if r["page_id"] == 70] == [None, None] and next(r["text"] for r in got if r["page_id"] == 71) == ""
    nodes = html_extract.parse(pages[0][1])
    keep = html_extract.decode(nodes, np.random.default_rng(0).normal(size=len(nodes)), html_extract.features(nodes)[:, 1])
    at = {id(v): k for k, v in enumerate(nodes)}
    assert all(keep[at[id(v.parent)]] for v, k in zip(nodes, keep) if k and v.parent)
    assert html_extract.fit(spark.createDataFrame([], "page_id long, html string")) is None


def test_html_learns_from_rare_pages(spark):
    plain = [(i, f"<div><p>{i} plain</p></div>") for i in range(300)]
    marked = [(300 + i, f"<nav><p>menu {i}</p></nav><article><p>Text of {i}, which goes on.</p></article>") for i in range(3)]
    pages = spark.createDataFrame(plain + marked, "page_id long, html string")
    assert sorted(r[0] for r in html_extract.teaching(pages).collect()) == [300, 301, 302]
    assert html_extract.fit(pages, max_pages=5) is not None
    assert html_extract.fit(pages.filter("page_id < 300"), max_pages=5) is None


# the pipeline


def test_pipeline_stages(spark, edges, docs):
    names = docs.columns
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == names, name
    out = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert out.columns == [*names, "token_ids", "decoded", "n_tokens"] and out.count() == d.count() > 0
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == out.columns
    as_rows = lambda df: sorted((r["doc_id"], r["text"], tuple(r["token_ids"]), r["n_tokens"]) for r in df.collect())
    assert as_rows(ran) == as_rows(out)
    # by brute force: what was kept is what each stage's decisions say, on its own input
    d, labels_ = docs, spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.fit(d, labels_)
    kept = [r for r in d.collect() if r["doc_id"] in {x["doc_id"] for x in quality_rules.decide(d, rules).collect() if x["keep"]}]
    d = spark.createDataFrame(kept, docs.schema)
    ids = {r["doc_id"] for r in simhash_dedup.decide(d).collect() if r["keep"]}
    d = secret_scan.redact(spark.createDataFrame([r for r in kept if r["doc_id"] in ids], docs.schema))
    copies = {r["doc_id"]: r["copies"] for r in entropy_mix.rates(d).collect()}
    want = sorted((r["doc_id"], r["text"]) for r in d.collect() for _ in range(copies[r["doc_id"]]))
    assert [x[:2] for x in as_rows(ran)] == want
    assert all(r["decoded"] == r["text"] for r in ran.collect())


def test_pipeline_edges(spark, edges):
    """Nulls, blank and very long texts, repeated rows, clashing names and empty tables, stage by stage."""
    blank = {1, 2, 3}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, edges, SF)
        assert rows.columns[: len(edges.columns)] == edges.columns, name
        kept[name] = sorted((r[0] is not None, r[0] or 0) for r in rows.collect())
        assert stage(spark, edges.limit(0), SF).count() == 0, name
    every = sorted((i is not None, i or 0) for i, _ in EDGES)
    rules = quality_rules.fit(edges, spark.read.parquet(f"{SF}/labels.parquet"))
    assert not rules and kept["quality rules"] == [x for x in every if x[1] not in blank]
    once = list(every)
    once.remove((True, 6))
    assert kept["SimHash near-dedup"] == once
    assert kept["secret scans"] == kept["mixing sources"] == kept["byte-level BPE"] == every


def test_checkpoint_folder_of_a_cluster():
    from types import SimpleNamespace

    from fernlake.llm import common

    def session(master, named):
        context = SimpleNamespace(master=master, at=None)
        context.getCheckpointDir = lambda: context.at
        context.setCheckpointDir = lambda x: setattr(context, "at", x)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: named))

    assert common.with_checkpoints(session("spark://x:1", "file:///shared")) == "file:///shared"
    assert common.with_checkpoints(session("local[4]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.with_checkpoints(session("spark://x:1", None))
