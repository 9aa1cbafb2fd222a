"""Resampling, covering SimHash and vector codes against plain versions."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from loomspark.llm import resample, simhash, vector_codes

DOCS = "doc_id long, text string, score string, rank boolean, fingerprint int, row int"


def words(n, seed, size=50):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, 7, 1) for i, t in rows], DOCS).repartition(3)


TEXTS = [(1, None), (2, ""), (3, "one"), (None, words(40, 1)), (None, words(40, 1)), (4, words(40, 1)), (5, words(40, 1)), (5, words(40, 1)), (5, words(30, 2)), (-9, words(25, 3)), (2**62 + 5, words(25, 4)), (-(2**63), words(25, 5)), (2**63 - 1, words(21, 6)), (6, words(19, 7)), (7, "É漢 ÀB-c.d_9 " * 30), (8, words(50_000, 8, 5000)), (9, "a b\x0bc " * 12)]


def plain_features(text):
    own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(own), own + [f"{a} {b}" for a, b in zip(own, own[1:])]


def plain_draw(docs, target, percent, least):
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % 10000 for t in texts for f in plain_features(t)[1]], minlength=10000)
    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10000) / ((int(a) + 1) * (int(t.sum()) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        n, f = plain_features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        rows.append((i, len(f), weight, weight + resample.gumbel(i), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {}
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r, []).append(place)
    return sorted(((*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=repr)


@pytest.mark.parametrize("percent", [25, 60, 100, 0])
def test_draw(spark, percent):
    docs = TEXTS + [(100 + i, words(20 + i % 9, i // 3)) for i in range(120)]
    target = [words(60, 3), None, words(10, 99), words(10, 99)]
    got = resample.draw(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_draw(docs, target, percent, 20)


def test_draw_ties_across_slices(spark, monkeypatch):
    monkeypatch.setattr(resample, "noise", lambda doc_id, seed: resample.F.lit(0))
    docs = [(i * 2**50 - 2**59, words(30, 1)) for i in range(300)] + [(None, words(30, 1))]
    target = spark.createDataFrame([], "text string")
    got = {r.doc_id: r.rank for r in resample.draw(frame(spark, docs), target, 50).collect()}
    assert got == {i: (k + 1 if k < 150 else None) for k, (i, _) in enumerate(docs)}
    kept = resample.resample(frame(spark, docs), target, 50)
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in docs[:150]]


def test_resample_rows(spark):
    docs = frame(spark, TEXTS + [(100 + i, words(25, i)) for i in range(60)])
    target = spark.createDataFrame([(words(60, 3),)], "text string")
    drawn = sorted(repr(r.doc_id) for r in resample.draw(docs, target, 30).where("rank is not null").collect())
    rows = resample.resample(docs, target, 30).collect()
    assert sorted(repr(r.doc_id) for r in rows) == drawn and all(r.score == "x" and r.row == 1 for r in rows)
    none = frame(spark, [])
    assert resample.draw(none, target).count() == 0 and resample.resample(none, target).count() == 0


def plain_fingerprint(text):
    own = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(own[i : i + 3]).encode(), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(nodes):
    """The least node reachable from each."""
    above = {n: n for n in nodes}

    def root(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_texts():
    out = list(TEXTS)
    for i in range(250):
        own = words(400, i % 7, 5000).split()
        for k in range(i % 5):
            own[(k * 37 + i) % 400] = f"z{i}"
        out.append((1000 - i, " ".join(own)))
    return out


@pytest.mark.parametrize("large", [1024, 1])
def test_simhash(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    docs = near_texts()
    prints = {t: plain_fingerprint(t) for t in {t for _, t in docs}}
    group = plain_groups(set(prints.values()))
    least = {}
    for i, t in docs:
        if i is not None:
            least[group[prints[t]]] = min(i, least.get(group[prints[t]], i))
    got = simhash.near_duplicates(frame(spark, docs))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = sorted(((i, f"{prints[t]:016x}", least.get(group[prints[t]])) for i, t in docs), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len(set(group.values())) < len(group)  # some are linked at a distance
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_covering_masks():
    every = [*combinations(range(64), 2), *((i,) for i in range(64))]
    for tables in (simhash.TABLES, [outer | m for outer, masks in zip(simhash.TABLES, simhash.INNER) for m in masks]):
        assert all(any(not any(m >> b & 1 for b in bits) for m in tables) for bits in every)
    for outer, masks in zip(simhash.TABLES, simhash.INNER):
        free = [b for b in range(64) if not outer >> b & 1]
        assert outer.bit_count() >= 36 and all((outer | m).bit_count() >= 52 for m in masks)
        assert all(any(not any(m >> b & 1 for b in bits) for m in masks) for bits in combinations(free, 2))


def test_links_in_a_large_ball(spark):
    """Thousands of fingerprints around one, most of which meet in the same buckets."""
    r = random.Random(5)
    centre = r.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in r.sample(range(64), r.choice([3, 4, 5]))) for _ in range(3000)}
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in ball], "node long")
    pairs = [(a % 2**64, b % 2**64) for a, b in simhash.links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs) and len(pairs) < 49 * len(ball)
    above = {n: n for n in ball}

    def root(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    assert {n: root(n) for n in ball} == plain_groups(ball)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: vec_id, vector of whole numbers."""
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            to = {}
            for own in cut:
                to.setdefault(near(own[p], books[p])[1], []).append(own[p])
            for e, group in to.items():
                books[p][e] = [sum(x) // len(group) for x in zip(*group)]
    found = [[near(own[p], books[p]) for p in range(parts)] for own in cut]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found], sha


def coded(spark, rows, schema="vec_id long, embedding array<float>, label int, code string, error int"):
    return vector_codes.compress(spark.createDataFrame([(*r, "x", None) for r in rows], schema).repartition(3))


@pytest.mark.parametrize("d", [8, 10])
def test_vector_codes(spark, d):
    r = random.Random(d)
    good = [(r.choice([None, 3, k, -k, 2**62 + k]), [r.choice([-1.5, 0.0, 0.25, 1 / 3, -0.0004, 7.7]) for _ in range(d)], r.choice([None, 1, 2])) for k in range(400)]
    bad = [(1, None, 1), (2, [None] + [1.0] * (d - 1), 1), (3, [float("nan")] * d, 1), (4, [float("inf")] * d, 1), (5, [-float("inf")] * d, None), (6, [1.0] * (d - 2), 1), (7, [], 1)]
    f32 = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (-d % 4)) for i, v, _ in good]
    want, sha = plain_codes(f32)
    codes = coded(spark, good + bad)
    assert vector_codes.digest(codes.codebooks) == sha
    got = vector_codes.with_label_errors(codes.rows).collect()
    total = {}
    for (_, _, label), (_, error) in zip(good, want):
        total[label] = total.get(label, 0) + error
    assert sorted(((x.vec_id, x.label, x.code, x.error, x.label_error) for x in got), key=repr) == sorted(((i, label, code, e, total[label]) for (i, _, label), (code, e) in zip(good, want)), key=repr)


def test_vector_codes_small_tables(spark):
    none = coded(spark, [])
    assert none.rows.count() == 0 and vector_codes.with_label_errors(none.rows).count() == 0
    assert coded(spark, [(1, None, None), (2, [float("nan")], 1)]).rows.count() == 0
    few = coded(spark, [(5, [1.0, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, 3.0, 4.0], None), (6, [1e30, -1e30, 0.0, 0.0], 1)])
    assert sorted(map(tuple, few.rows.select("vec_id", "code", "error").collect())) == [(5, "00000000", 0), (5, "00000000", 0), (6, "02020202", 0)]


def test_partial_distance_search():
    r = np.random.default_rng(1)
    for n, k, d, spread in ((300, 256, 16, 3), (300, 256, 16, 400), (50, 1, 5, 3), (50, 7, 1, 2), (50, 20, 3, 2)):
        x, book = r.integers(-spread, spread, (n, d)), r.integers(-spread, spread, (k, d))
        full = ((x[:, None] - book) ** 2).sum(2)
        entry, error = vector_codes.nearest(x, book)
        assert (entry == full.argmin(1)).all() and (error == full.min(1)).all()
