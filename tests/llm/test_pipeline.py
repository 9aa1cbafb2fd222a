"""Every stage of the corpus pipeline against a brute-force version, on whole small tables, and with odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import decontaminate, packing, toxicity
from loomspark.llm._common import documents
from test_operators import brute_components

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def hits(text, windows):
    w = decontaminate.words(text)
    return any(tuple(w[p : p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1))


def benchmark_windows(items):
    return {tuple(w[k : k + 10]) for t in items if (w := decontaminate.words(t)) for k in range(max(1, len(w) - 9))}


def test_stages_against_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    run = lambda name, before: corpus_pipeline.materialize(stages[name](spark, before, SF), "test")

    score = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    want = {i for i, r in rows.items() if score(r.text) < toxicity.THRESHOLD}
    kept = run("toxicity", docs)
    assert sorted(i for i, _ in texts_of(kept)) == sorted(want)

    last = {}
    for i in want:
        last[rows[i].text or ""] = max(i, last.get(rows[i].text or "", i))
    kept = run("exact_dedup", kept)
    assert sorted(i for i, _ in texts_of(kept)) == sorted(last.values())

    sets, root = brute_components([(i, rows[i].text) for i in last.values()])
    want = {i for i in sets if root(i) == i}
    kept = run("near_dedup", kept)
    assert sorted(i for i, _ in texts_of(kept)) == sorted(want)

    windows = benchmark_windows(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    want = {i for i in want if not hits(rows[i].text, windows)}
    kept = run("decontaminate", kept)
    assert sorted(i for i, _ in texts_of(kept)) == sorted(want) and kept.columns == corpus_pipeline.COLUMNS
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in kept.select(*docs.columns).collect())  # rows go on as they were

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = []
    for i in want:
        ids = np.array([*tokenizer.encode(rows[i].text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces += [(i, p, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for p, k in enumerate(range(0, len(ids), 4096))]
    got = run("pack", kept).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 4096
    assert len(bins) <= 1.06 * -(-sum(p[3] for p in pieces) // 4096) + 2
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece").collect())) == sorted((r.doc_id, r.piece) for r in got)


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd(spark, []), SF).count() == 0
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None), (None, None), (None, "alone"), (None, near), (None, near + " end"), (3, near), (3, near), (4, "alone"), (5, None), (6, ""), (7, "x " * 30_000)]
    got = stage(spark, odd(spark, rows), SF)
    assert got.columns == (corpus_pipeline.COLUMNS if name != "pack" else got.columns)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    whole = sorted((i is None, i or 0) for i, _ in rows)
    if name in ("toxicity", "decontaminate"):
        assert ids == whole
    elif name == "pack":
        assert {x for x in ids} == set(whole)
    elif name == "exact_dedup":  # one row of each text: the largest id, a null below all
        assert ids == [(False, 3), (False, 4), (False, 6), (False, 7), (True, 0)]
        assert got.where("doc_id is null").first().text == near + " end"
    else:  # a component with ids is told by the least; texts without words stand for themselves, rows that repeat id and text once
        assert ids == [(False, 3), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]
    if name == "toxicity":
        assert got.where(F.col("text").isNull()).count() == 3
