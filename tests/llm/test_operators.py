"""Operators against brute force, exact round trips and held-out accuracy, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from itertools import pairwise

import numpy as np
import pytest

from loomspark.llm import chat, decontaminate, exact_dedup, near_dedup, packing, repeats, secrets, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, kept boolean, n_words int, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "x") for i, t in rows], SCHEMA).repartition(3)


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


DOCS = [(1, None), (2, ""), (3, "a"), (4, words(300, 1)), (5, words(300, 1)), (6, words(300, 1) + " tail end"), (7, "é " * 40), (8, words(20000, 2)), (9, words(60, 3)), (9, words(60, 3)), (None, words(30, 4)), (10, words(300, 5)[:900] + words(80, 1)), (11, "  \n\t ")]


def test_exact_dedup(spark):
    got = exact_dedup.exact_groups(frame(spark, DOCS)).collect()
    groups = {}
    for i, t in DOCS:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(DOCS)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    for i, t in DOCS:
        own = groups[t or ""]
        r = by[i, hashlib.sha256((t or "").encode()).hexdigest()]
        best = max((x for x in own if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(own), i == best)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    kept = exact_dedup.drop_copies(frame(spark, DOCS))
    assert kept.columns == ["doc_id", "text", "kept", "n_words", "label"] and {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, 8, 9, None, 10, 11}


def brute_components(docs):
    """Shingle sets, and the least id reachable, by comparing all pairs."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets, par = {}, {}
    for i, t in docs:
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        par[i] = i

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                par[max(x, y)] = min(x, y)
    return sets, root


def test_near_dedup(spark):
    rng = random.Random(3)
    base = words(200, 9, 5000).split()
    docs = list(DOCS)
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 3, 8, 14, 25])):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
        docs.append((100 + i, " ".join(own)))
    sets, root = brute_components(docs)
    got = near_dedup.near_duplicates(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id))
        assert r.kept == (r.component_id == r.doc_id)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def _removed(docs):
    seen, out = {}, {}
    for i, t in sorted(((x if x is not None else 2**63), t) for x, t in docs):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            first = seen.setdefault(b[p : p + 50], i)
            if first < i:
                cover[p : p + 50] = b"\1" * 50
        out[i, t or ""] = cover
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(5)
    docs = [(i, t) for i, t in DOCS if i != 8] + [(30, words(900, 2)), (31, "a" * 300), (32, "b" + "a" * 120 + "c")]
    line = words(14, 77)
    for i in range(25):
        docs.append((40 + i, words(30, 100 + i) + line + words(rng.randrange(40), 200 + i) + words(200, 2)[100:400]))
    want = _removed(docs)
    groups = repeats.Group
    import pyarrow as pa

    # the steps in this process, so that the changed limit is the one that is used
    t = [(i, (x or "").encode(), (i or 0) % 3) for i, x in docs]
    tables = [pa.table({"doc_id": pa.array([r[0] for r in t if r[2] == g], pa.int64()), "raw": pa.array([r[1] for r in t if r[2] == g], pa.binary()), "grp": pa.array([g] * sum(r[2] == g for r in t), pa.int32())}) for g in range(3)]

    def by(rows, key):
        return {k: rows.filter(pa.compute.equal(rows.column(key), k)) for k in set(rows.column(key).to_pylist())}

    import pyarrow.compute  # noqa: F401

    windows = pa.concat_tables([repeats.send_windows(x, 4) for x in tables])
    verdicts = pa.concat_tables([repeats.judge_windows(x) for x in by(windows, "bucket").values()])
    told = by(verdicts, "grp")
    strings = pa.concat_tables([repeats.send_strings(x, told.get(g, verdicts.slice(0, 0)), 8) for g, x in enumerate(tables)])
    answers = pa.concat_tables([repeats.judge_strings(x) for x in by(strings, "bucket").values()] or [verdicts.slice(0, 0)])
    both = by(pa.concat_tables([verdicts, answers]), "grp")
    rows = [r for g, x in enumerate(tables) for r in repeats.settle(x, both.get(g, verdicts.slice(0, 0)), True).to_pylist()]
    assert groups is repeats.Group and len(rows) == len(docs)
    counts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"], r["kept_sha256"]) for r in rows)
    expected = sorted((i is None, i or 0, sum(c), hashlib.sha256(bytes(x for x, m in zip((t or "").encode(), c) if not m)).hexdigest()) for i, t in docs for c in [want[i if i is not None else 2**63, t or ""]])
    assert counts == expected
    if hot > 1:
        got = repeats.remove_repeats(frame(spark, docs)).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.kept_sha256) for r in got) == expected
        assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_with_equal_short_hashes(monkeypatch):
    import pyarrow as pa

    real = repeats.super_windows

    def clash(raw, ends):
        first, last, anchor, short = real(raw, ends)
        return first, last, anchor, np.r_[short[:-1], short[:1]]

    monkeypatch.setattr(repeats, "super_windows", clash)
    table = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "raw": pa.array([words(300, 61, 10**6).encode(), words(300, 62, 10**6).encode()], pa.binary()), "grp": pa.array([0, 0], pa.int32())})
    g = repeats.Group(table)
    assert sorted(g.heads.tolist()) == list(range(len(g.first))) and (g.least == g.doc).all()
    assert [r["n_removed"] for r in repeats.settle(table, repeats._rows([])).to_pylist()] == [0, 0]


def test_suffix_order():
    raw = np.frombuffer((words(400, 1, 3) + "a" * 200).encode(), np.uint8)
    at = np.arange(len(raw) - 49)
    order, group = repeats.classes(raw, at)
    strings = [raw[p : p + 50].tobytes() for p in order]
    assert strings == sorted(strings) and all((a == b) == (g == h) for (a, g), (b, h) in pairwise(zip(strings, group)))
    assert repeats.blind_trie([b"aab", b"aaa", b"aab", b"aac"], 2) == [[1], [0, 2], [3]]


def test_packing_plan_is_whole():
    for seed in range(12):
        r = np.random.default_rng(seed)
        cap = int(r.choice([16, 100, 1000]))
        lengths = np.clip(r.lognormal(np.log(cap * 0.3), 0.9, 2000).astype(int) + 1, 1, cap)
        h = np.bincount(lengths, minlength=cap + 1)
        seen, bins = set(), {}
        for s, first, t, m, q, o in packing.plan(h).tolist():
            for j in range(m):
                for i in range(t):
                    assert (s, first + j * t + i) not in seen
                    seen.add((s, first + j * t + i))
                    bins.setdefault(q + j, []).append((o + i * s, s))
        assert len(seen) == len(lengths)
        for own in bins.values():
            end = 0
            for o, s in sorted(own):
                assert o == end
                end += s
            assert end <= cap
        assert len(bins) <= 1.06 * -(-int(lengths.sum()) // cap) + 2


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = [*DOCS, (50, "Don't\x1cstop \x85 <|endoftext|>x ﬁ ½ Ünïcode, İΣ."), (51, words(9000, 8))]
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, x in docs:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i is None, i or 0, p, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for p, k in enumerate(range(0, len(ids), 4096))]
    got = packing.pack(frame(spark, docs)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 4096
    assert packing.pack(frame(spark, [])).count() == 0


def test_decontaminate(spark):
    items = [(1, words(30, 1)), (2, words(6, 2)), (3, None), (4, "!!"), (5, words(30, 1)), (6, words(12, 3)), (None, words(300, 5))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = decontaminate.words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    want = []
    for i, t in DOCS:
        w, hit, own = decontaminate.words(t), set(), set()
        for p in range(len(w)):
            for n in {len(x) for x in windows}:
                if p + n <= len(w) and (f := windows.get(tuple(w[p : p + n]))):
                    hit.update(range(p, p + n))
                    own |= f
        want.append((i is None, i or 0, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    for block in (decontaminate.MAX_BLOCK_BYTES, 400):
        got = decontaminate.decontaminate(frame(spark, DOCS), bench, max_block=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert decontaminate.decontaminate(frame(spark, DOCS), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(frame(spark, DOCS), bench).count() == sum(not x[-1] for x in want)


def test_warc_round_trip(spark):
    rows = [(1, "http://a.org/x", "p" * 200), (2, "http://b.org/y?z", "p" * 200), (3, None, None), (4, "http://a.org/x", "short"), (5, "x y\r\n", "short"), (6, "http://A.org:80/", "é" * 80), (6, "http://A.org:80/", "é" * 80), (None, "u://v", "p" * 200)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    archive = warc.write_archive(pages, warc.new_folder(spark), block=3)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive.read().collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {(i, len((h or "").encode()), sha(h), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows}
    assert archive.read().count() == len(rows)
    assert sorted(r["page_id"] for r in archive.lookup(["http://a.org/x"])) == [1, 4]
    assert archive.lookup(["http://a.org/x"])[0]["payload"] == b"p" * 200
    assert warc.write_archive(pages.limit(0), warc.new_folder(spark)).read().count() == 0


def test_chat_round_trip(spark):
    hostile = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (1, 2, "assistant", "\\\\ </turn>é\n"), (2, 0, None, None), (2, 0, "a: b", "<|endoftext|>"), (None, None, "assistant", "x" * 5000)]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string").repartition(3)
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_turns(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x))
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_conversations(chat.format_turns(turns.limit(0))).count() == 0


def test_url_filter(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = [None, "", "example.org/es/", "http://EXAMPLE.org/es/x#y", "http://a.example.org/en/19?q", "http://notexample.org/es/", "https://com/de/", "u://x.com?/de/", "ftp://é.com/fr/", "http://org", "http://org/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for block in (1000, 2):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, max_block=block).collect()}
        for i, u in enumerate(urls):
            host, path = url_filter.split_url(u)
            fits = sorted((len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
            assert got[i] == (host, path, fits[-1][2] if fits else None, fits[-1][3] if fits else "allow")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = r.random() < 0.3
        rows.append((i, words(40, i) + (" " + r.choice(["idiotic", "moronic", "scummy"]) if bad else "") + (" " + r.choice(["women", "muslims"]) if r.random() < 0.5 else "")))
        labels.append((i, int(bad)))
    docs = frame(spark, [*rows, (None, None), (999, "")])
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i, _ in labels)
    assert sum(got[i].predicted == y for i, y in labels if i in held) >= 0.95 * len(held)
    assert 0 <= got[999].score <= 1 and got[999].score == got[None].score
    weights = [abs(model.weights.get(toxicity._features(w)[0], 0.0)) for w in (b"women", b"muslims")]
    assert max(weights) < 0.5
    assert toxicity.drop_toxic(docs, model).count() == sum(not x.predicted for x in got.values())
    none = toxicity.train(docs, lab.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0


def test_secrets(spark):
    known = secrets.language([])
    forest = secrets.train(secrets.generated_findings(), known)
    test = secrets.generated_findings(600, seed=77)
    x = np.array([secrets.features(t, a, b, next((k for s, e, k in secrets.candidates(t) if (s, e) == (a, b)), False), known) for t, a, b, _ in test])
    assert ((forest.predict(x) >= 0.5) == np.array([y == 1 for *_, y in test])).mean() > 0.97
    text = "note é password=da6a7d4f67f2203943 and commit da39a3ee5e6b4b0d3255bfef95601890afd80709 end"
    got = {r.start: r for r in secrets.scan(frame(spark, [(1, text), (2, None), (3, "")]), forest, known=known).collect()}
    assert {text[s : s + r.length]: r.is_secret for s, r in got.items()} == {"da6a7d4f67f2203943": True, "da39a3ee5e6b4b0d3255bfef95601890afd80709": False}
    assert secrets.scan(frame(spark, []), forest).count() == 0


def test_secrets_of_any_length(spark):
    r = random.Random(4)
    run = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    values = {1: ("aws_session_token=", run(5000)), 2: ("see ", run(3000)), 3: ("see ", f"eyJ{run(900)}.{run(4000)}.{run(700)}"), 4: ("see ", "ghp_" + run(300)), 5: ("see ", "xoxe-" + run(300)), 6: ("see ", "sk-proj-" + run(300)), 7: ("password=", "p#" + run(201) + "&x" * 2000)}
    got = secrets.scan(frame(spark, [(i, a + v + " end") for i, (a, v) in values.items()])).collect()
    assert sorted((x.doc_id, x.start, x.length, x.value_sha256) for x in got) == [(i, len(a), len(v), hashlib.sha256(v.encode()).hexdigest()) for i, (a, v) in values.items()]
    assert {x.doc_id for x in got if x.is_secret} >= {1, 3}
