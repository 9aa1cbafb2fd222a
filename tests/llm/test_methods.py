"""What the methods promise beyond their results: filters in ranges, cells of blocks, the swap penalty at work, planted secrets, searches in the index."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bloom, chat, decontaminate, exact_dedup, near_dedup, packing, secrets, toxicity, url_filter, warc
from test_operators import DOCS, brute_components, frame, words


def test_bloom_filter_in_ranges(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    known = rows.where("id % 3 = 0").select("h")
    for most in (None, 2048):
        made = bloom.bitmaps(known, 1667, max_bytes=most)
        assert (made.ranges > 1) == (most is not None)
        got = bloom.probed(rows, F.col("h"), made, "hit").collect()
        assert len(got) == 5000 and all(r.hit for r in got if r.id % 3 == 0) and sum(r.hit for r in got) < 1667 + 0.05 * 5000
    twice = bloom.bitmaps(rows.select("h").union(rows.where("id < 10").select("h")), 5010, 2, 2048)
    got = bloom.probed(rows, F.col("h"), twice, "hit").where("hit").collect()
    assert {r.id for r in got} >= set(range(10)) and len(got) < 300


def test_bloom_filter_is_one_broadcast(spark):
    rows = spark.range(400).select(F.xxhash64("id").alias("h"), "id")
    known = rows.where("id % 3 = 0").select("h")
    for made in (bloom.bitmaps(known, 134), bloom.bitmaps(known, 134, distinct=True)):
        got = bloom.probed(rows, F.col("h"), made, "hit")
        assert got._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
        assert all(r.hit for r in got.collect() if r.id % 3 == 0) and got.where("hit").count() < 134 + 20
    assert bloom.bitmaps(known, 134, distinct=True).maps.collect() == bloom.bitmaps(known.union(known), 134).maps.collect()


def test_exact_dedup_in_ranges(spark):
    one = exact_dedup.exact_groups(frame(spark, DOCS)).collect()
    many = exact_dedup.exact_groups(frame(spark, DOCS), max_bytes=2048).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_exact_dedup_passes_unique_texts_through(spark):
    plan = exact_dedup.drop_copies(frame(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "MapInArrow" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("block", [512, 4])
def test_near_dedup_around_the_threshold(spark, monkeypatch, block):
    """Variants so far from their pivots that trees are joined in cells."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MANY", 2)
    r = random.Random(8)
    docs = []
    for g in range(3):
        base = words(120, 90 + g, 9000).split()
        for i in range(60):
            own = list(base)
            for at in r.sample(range(len(own)), r.choice([1, 3, 4, 5, 6])):
                own[at] = f"z{r.randrange(10**6)}"
            docs.append((1000 * g + i, " ".join(own)))
    sets, root = brute_components(docs)
    got = near_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: root(i) for i in sets}
    assert len({root(i) for i in sets}) > 6


def test_blocks_are_planned_once_without_large_bands(spark, monkeypatch):
    """Bands of few cells need no pass over the diagonal, and what was planned for it serves the rest."""
    told, plain = [], near_dedup._blocks
    monkeypatch.setattr(near_dedup, "_blocks", lambda rows, sizes: told.append(rows) or plain(rows, sizes))
    r, docs = random.Random(8), []
    for g in range(2):
        base = words(120, 90 + g, 9000).split()
        for i in range(60):
            own = list(base)
            for at in r.sample(range(len(own)), r.choice([1, 3, 4, 5, 6])):
                own[at] = f"z{r.randrange(10**6)}"
            docs.append((1000 * g + i, " ".join(own)))
    sets, root = brute_components(docs)
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(frame(spark, docs)).collect()} == {i: root(i) for i in sets}
    assert len(told) == 2  # for the signatures, and for the sets


def test_training_reads_features_in_place():
    own = [np.array(x, np.uint32) for x in ([3, 5, 9], [], [7])]
    rows = pa.table({"doc_id": [8, -2, 4], "toxic": [1, 0, 1], "features": pa.array([x.tobytes() for x in own], pa.binary()), "named": pa.array([b"gay a", None, b"men"], pa.binary())})
    sets, named, labels = toxicity._in_order(rows)
    assert [x.tolist() for x in sets] == [[], [7], [3, 5, 9]] and named == [[b"men"], [b"gay", b"a"]] and labels.tolist() == [0.0, 1.0, 1.0]
    data = np.frombuffer(rows.column("features").chunk(0).buffers()[2], np.uint8)
    assert all(np.shares_memory(x, data) for x in sets if len(x))


def test_cells_give_fewer_links_than_members():
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(r.choice(pool, 60, replace=False)) for _ in range(40)] + [np.unique(pool[:60]) for _ in range(5)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for size in (64, 8192):
        near_dedup.COLUMNS, old = size, near_dedup.COLUMNS
        assert (near_dedup.intersections(sets, sets) == want).all()
        near_dedup.COLUMNS = old
    side = [(i, len(s), s) for i, s in enumerate(sets)]
    links = near_dedup.joining_links([side, side])
    assert len(links) == 4 and {x for link in links for x in link} == set(range(40, 45))
    assert near_dedup.joining_links([side[:3], side[3:6]]) == []


def labelled(seed, group_share):
    """Texts whose label follows an insult; toxic ones often name one group too, clean ones seldom; some toxic ones have no insult."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.4
        t = words(30, 5000 * seed + i, 900)
        if bad and r.random() < 0.6:
            t += " " + r.choice(["idiotic", "moronic", "scummy"])
        if r.random() < (group_share if bad else 0.02):
            t += " muslims"
        elif r.random() < 0.2:
            t += " " + r.choice(["women", "christians", "immigrants"])
        rows.append((i, t))
        labels.append((i, int(bad)))
    return rows, labels


def test_swap_penalty_spares_neutral_mentions():
    rows, labels = labelled(1, 0.8)
    said = [sorted(set(toxicity.words(t))) for _, t in rows]
    y = np.array([v for _, v in labels], float)
    neutral = [words(30, 77_000 + i, 900) + " muslims" for i in range(200)]
    insults = [words(30, 88_000 + i, 900) + " idiotic moronic" for i in range(200)]
    rate = {}
    for penalty in (0.0, toxicity.SWAP_PENALTY):
        score = toxicity.fit(said, y, penalty=penalty).scorer()
        rate[penalty] = np.mean([score(t) >= toxicity.THRESHOLD for t in neutral])
        assert np.mean([score(t) >= toxicity.THRESHOLD for t in insults]) > 0.9
    assert rate[0.0] > 0.9 and rate[toxicity.SWAP_PENALTY] < 0.02


def test_terms_are_a_parameter():
    rows, labels = labelled(2, 0.8)
    said = [sorted(set(toxicity.words(t.replace("muslims", "blorps")))) for _, t in rows]
    y = np.array([v for _, v in labels], float)
    weight = lambda m: m.weights.get(toxicity._features(b"blorps")[0], 0.0)
    assert weight(toxicity.fit(said, y, terms=("blorps", "women"))) < 0.3 < weight(toxicity.fit(said, y))


def test_toxicity_of_few_labels_and_odd_rows(spark):
    rows, labels = [], []
    r = random.Random(4)
    for i in range(300):
        bad = r.random() < 0.12
        rows.append((i, words(200, 900 + i, 4000) + (" " + " ".join(r.sample(["trash", "idiotic", "scum", "moronic", "loser", "vile"], 2)) if bad else "")))
        labels.append((i, int(bad)))
    docs = frame(spark, [*rows, *rows[:20], (None, None), (998, "x " * 200_000), (999, "")])
    lab = spark.createDataFrame([*labels, *labels[:9], (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    assert len(got) == 323 and all(0 <= x.score <= 1 for x in got)
    held = {x.doc_id: x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 300}
    truth = dict(labels)
    assert all(held[i].predicted == truth[i] for i in held)
    assert len({x.score for x in got if x.doc_id in (None, 999)}) == 1


def planted(seed):
    """Documents with one secret or look-alike each, written apart from what the forest learns from."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    mixed = low + low.upper() + digits
    lines = "\n".join(some(mixed + "+/", 64) for _ in range(25))
    good = [
        lambda: ("aws_secret_access_key = ", some(mixed + "/+", 40), "\n[default]"), lambda: ("push with ", "ghp_" + some(mixed, 36), " from here"), lambda: ("DATABASE_URL=postgresql://svc_app:", some(mixed + "!*", 14), "@db.internal:5432/main"),
        lambda: ("", f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----", "\n"), lambda: ("Authorization: Bearer ", some(mixed, 40) + "7", "\n"), lambda: ("//registry.npmjs.org/:_authToken=", some(hexa, 8) + some(mixed, 28), "\n"),
        lambda: ('"client_secret": "', some(mixed, 32), '", "grant": 1'), lambda: ("passwd = '", "T!" + some(mixed, 9) + "#4", "'"), lambda: ("key ", "eyJ" + some(mixed, 33) + "." + some(mixed, 90) + "." + some(mixed, 43), ""), lambda: ("slack ", "xoxp-" + some(digits, 12) + "-" + some(mixed, 30), ""),
        lambda: ("DB_PASSWORD_FOR_THE_REPORTING_SERVICE_IN_PRODUCTION   =   ", some(mixed + "!#", 10), ""), lambda: ("pwd=", some(mixed, 3) + "!" + some(digits, 2), ""),
    ]
    bad = [
        lambda: ("commit ", some(hexa, 40), "\nAuthor: someone"), lambda: ("FROM base@sha256:", some(hexa, 64), "\nRUN make"), lambda: ("request id ", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), " failed"), lambda: ("src='data:image/png;base64,", "iVBORw0KGgo" + some(mixed + "/+", 120), "'"),
        lambda: ('integrity="', "sha384-" + some(mixed + "/+", 64), '"'), lambda: ("password = ", "<your_password_here>"[1:-1], " # change"), lambda: ("see https://host/", "archive/2024/11/" + some(digits, 9) + "/index", " for more"), lambda: ("", some(hexa, 32), "  release-1.2.tar.gz"),
        lambda: ("tracking ", some(digits, 22), " arrived"), lambda: ("token = ", "config.get_value(name)", ""),
        lambda: ("password: ", r.choice(("yes", "none", "required", "string", "optional")), ""), lambda: ("max_token=", some(digits, 4), ""),
    ]
    out = []
    for i in range(480):
        prefix, value, suffix = (good if i % 2 else bad)[(i // 2) % 12]()
        lead = words(40, 10_000 * seed + i) + " " + prefix
        out.append((i, lead + value + suffix + " " + words(40, 20_000 * seed + i), len(lead), value, i % 2))
    return out


def test_planted_secrets(spark):
    rows = planted(3)
    got = {}
    for x in secrets.scan(frame(spark, [(i, t) for i, t, *_ in rows])).collect():
        if x.is_secret:
            got.setdefault(x.doc_id, []).append((x.start, x.length, x.value_sha256))
    found = sum((a, len(v), hashlib.sha256(v.encode()).hexdigest()) in got.get(i, []) for i, _, a, v, y in rows if y)
    false = sum(i in got for i, *_, y in rows if not y)
    proposed = sum(any(s < a + len(v) and e > a for s, e, _ in secrets.candidates(t)) for _, t, a, v, y in rows if not y)
    assert found >= 0.9 * 240 and false <= 0.1 * 240 and proposed > 0.7 * 240  # whole values; most look-alikes are proposed and then rejected


def test_secrets_in_odd_rows(spark):
    long = "x" * 300_000 + "1"
    rows = [(1, long), (1, long), (None, "token=" + "k3" * 40), (4, "-----BEGIN RSA PRIVATE KEY----- and no end"), (5, "a" * 100)]
    got = secrets.scan(frame(spark, rows)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.length) for x in got) == [(False, 1, 300_001), (False, 1, 300_001), (False, 4, 31), (True, 0, 80)]


def test_texts_are_read_once_a_range_for_both_filters(spark, tmp_path):
    """R ranges read the texts R times for the rows that stay and R times for the few that are looked up, not R x R."""
    rows = [(i, f"text {i % 900}") for i in range(3000)] + [(None, "text 5"), (7, "text 7")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    judged = exact_dedup.exact_groups(docs, keep="min").selectExpr("doc_id", "unhex(text_sha256) as sha", "not kept as gone")
    judged.write.parquet(str(tmp_path / "judged"))
    kept = bloom.keep_decided(docs, spark.read.parquet(str(tmp_path / "judged")), max_bytes=1 << 12)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    ranges = plan.count("text#") and kept._jdf.queryExecution().sparkPlan().toString().count(str(tmp_path / "docs"))
    want = {}
    for i, t in rows:
        if i is not None:
            want[t] = min(i, want.get(t, i))
    assert sorted(kept.collect()) == sorted((i, t) for t, i in want.items())
    first = bloom.bitmaps(docs.selectExpr("xxhash64(text) as h"), 3000, max_bytes=1 << 12)
    assert first.ranges > 1 and 0 < ranges <= 2 * first.ranges
    with pytest.raises(ValueError, match="together"):
        bloom.probed_all(docs, docs.doc_id, {"a": first, "b": first._replace(ranges=1)})


def test_near_dedup_takes_any_id(spark):
    a, b = words(100, 1), words(100, 2)
    near = lambda t: t.replace(t.split()[50], "changed")
    rows = [(2**62 + 5, a), (2**63 - 1, near(a)), (-(2**63), b), (None, near(b)), (None, words(90, 3)), (None, words(90, 3) + " "), (2**62 + 9, None), (2**62 + 7, words(80, 4)), (2**62 + 7, words(80, 5)), (2**62 + 8, near(words(80, 5)))]
    got = {}
    for r in near_dedup.near_duplicates(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert got[2**62 + 5] == [(2**62 + 5, True)] and got[2**63 - 1] == [(2**62 + 5, False)] and got[-(2**63)] == [(-(2**63), True)] and got[2**62 + 9] == [(2**62 + 9, True)]
    assert sorted(got[None], key=repr) == [(-(2**63), False), (None, False), (None, True)]
    assert {c for c, _ in got[2**62 + 7]} == {2**62 + 7}
    assert near_dedup.drop_near_copies(frame(spark, rows)).count() in (6, 7)


def test_keys_of_many_words():
    """Keys wrap around alike in both places, whatever the number of words."""
    r = np.random.default_rng(3)
    for base in (50, 3_000_000, 2**40):
        ids = r.integers(1, min(base, 2**62), 60)
        index = decontaminate.Index({})
        index.vocabulary = type("Many", (dict,), {"__len__": lambda self: base - 1})()
        at, keys = decontaminate._shingles(ids, np.array([60]), 3, base)
        assert [index.key(ids[i : i + 3]) for i in at] == keys.tolist() and len(at) == 58


def test_secrets_have_no_upper_bound():
    forms = {
        "x" * 31 + '_password = "hunter2!x"': "hunter2!x", 'my_password     \t=    "hunter2!x"': "hunter2!x", 'password_for_the_production_database = "hunter2!x"': "hunter2!x", f"postgres://{'u' * 65}:pa55word!@h": "pa55word!",
        "redis://:pa55word!@h": "pa55word!", "pwd=a1!": "a1!", "aws_secret_access_key=>zzzzzz9": "zzzzzz9", "x" * 100_000 + "token" + "y" * 100_000 + "=" + "k3" * 50_000: "k3" * 50_000,
    }
    for text, value in forms.items():
        assert [(text[a:b], assigned) for a, b, assigned in secrets.candidates(f"{text} end")] == [(value, True)]
    assert not list(secrets.candidates("pwd=a1")) and not list(secrets.candidates("token.name = foobar1")) and not list(secrets.candidates("token\n= foobar1"))
    first, last = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = f"{first}\nabc\n{last}"
    text = f"{first}\n! {body} {last} {first} {first}\nx\n{last}"
    got = [text[a:b] for a, b, _ in secrets.candidates(text)]
    assert got == [first, body, f"{first} {first}\nx\n{last}"]


def test_secrets_take_linear_time():
    """Texts that make a search begin anew at each place: ten times the text takes no more than some twenty times as long."""
    forms = ("-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN RSA PRIVATE KEY-----\n!", "-----BEGIN ", "token", "token ", "-eyJaaaaaaaaaa", "eyJaaaaaaaaaa.", "://a:", "password= ", "api_", "sk-", "ghp_", "password \t")
    for form in forms:
        took = []
        for n in (10_000, 100_000):
            text = form * n
            began = time.perf_counter()
            sum(1 for _ in secrets.candidates(text))
            took.append(time.perf_counter() - began)
        assert took[1] < 20 * took[0] + 0.5, form


def test_common_words_are_counted_over_all_rows(spark):
    rows = [(i, f"alpha beta{'x' * (i % 2)} {'rare' if i == 7 else 'thing'}") for i in range(50)]
    assert secrets.common_words(frame(spark, rows), 0.2) == ["alpha", "beta", "betax", "thing"]


def test_index_is_searched(spark):
    rows = [(i, f"http://h{i % 40}.org/p{i % 7}", f"page {i} " * 20) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archive = warc.write_archive(pages, warc.new_folder(spark), block=5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert archive.directory.count() > 60 and archive.directory.select("file").distinct().count() > 1
    for url in ("http://h0.org/p0", "http://h39.org/p4", "http://h17.org/p3", "http://nowhere.org/", "http://a.aa/", "http://zz.zz/"):
        assert sorted(r["page_id"] for r in archive.lookup([url])) == [i for i, u, _ in rows if u == url]
    assert archive.read().count() == 400
    runs = list(warc._neighbours([["k", 0, "f", 0, 10], ["k", 1, "f", 12, 5], ["k", 2, "f", 10**6, 5], ["k", 3, "g", 10**6 + 5, 1]]))
    assert [[x[1] for x in run] for run in runs] == [[0, 1], [2], [3]]


def test_url_rules_from_a_table(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), *(("block", f"h{i}.net", "/") for i in range(50))]
    urls = [None, "http://EXAMPLE.org/es/x", "http://a.h7.net/", "x://com/de/z", "x://com/" + "y" * 100_000, "http://h7.net/", "http://h7.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(map(repr, url_filter.filter_urls(pages, rules).collect()))
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for most in (1000, 9):
        assert sorted(map(repr, url_filter.filter_urls(pages, table, max_block=most).collect())) == want
    assert {r.verdict for r in url_filter.filter_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_decontaminate_with_clashing_names(spark):
    docs = frame(spark, DOCS).withColumnRenamed("kept", "__hit").withColumnRenamed("label", "__items")
    bench = spark.createDataFrame([(i % 3, words(30, 1)) for i in range(50)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(DOCS) - 4
    marked = decontaminate.decontaminate(docs, bench, max_block=200).collect()
    assert {r.n_items for r in marked if r.contaminated} == {3} and len(marked) == len(DOCS)


def test_reserved_ids_are_free(tmp_path):
    import json

    raw = json.load(open(chat.default_tokenizer()))
    raw["model"]["vocab"]["zzzz"] = chat.FIRST_RESERVED + 1
    (tmp_path / "t.json").write_text(json.dumps(raw))
    with pytest.raises(ValueError, match="reserved"):
        chat._codec(str(tmp_path / "t.json"))


def test_words_of_letters_through_the_merger():
    from tokenizers import Tokenizer

    r = random.Random(6)
    said = ["".join(r.choice("aeiouéñüßthrnsl") for _ in range(r.randrange(1, 16))) + r.choice(["", ".", ",", "!?"]) for _ in range(4000)]
    texts = [" ".join(said[i : i + 50]).capitalize() for i in range(0, 4000, 50)]
    t = Tokenizer.from_file(packing.default_tokenizer())
    cache = packing.WordCache(packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_likely_classes_are_told_in_the_least_band_that_they_share():
    a, b, c = (near_dedup.signatures([np.arange(k, k + 50, dtype=np.uint64)], near_dedup.FINE).astype(np.uint8)[0].tobytes() for k in (0, 1, 1))
    side = [[1, 1, 50, a, [3, -8, 5]], [2, 2, 50, b, [5, 3]], [3, 3, 50, c, [5, 9]]]
    told = {band: sorted(set(near_dedup._likely(band, [m for m in side if band in m[4]], [m for m in side if band in m[4]]))) for band in (-8, 3, 5, 9)}
    assert told == {-8: [], 3: [(3, 1), (3, 2)], 5: [(5, 1), (5, 2), (5, 3)], 9: []}
    assert sorted(set(near_dedup._likely(5, side[:2], side[:2]))) == []
