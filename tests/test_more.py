"""The queries over real texts, audits, baselines and counters against SQL; sinks, the model client and the stream's index against plain versions."""

import math
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomspark import more_queries, queries, study_queries
from loomspark.functions import discourse, regex
from loomspark.operators import checks, classifier, index, ranking, tables
from loomspark.sinks import writers
from loomspark.sources import readers
from loomspark.streaming import index as stream_index
from loomspark.streaming import stages

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem documents embeddings pages labels conversations".split()


def rounded(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


EVERY = more_queries.QUERIES | study_queries.QUERIES
SQL = more_queries.SQL | study_queries.SQL


@pytest.mark.parametrize("name", list(SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = EVERY[name](spark, SF)
    cols = sorted(got.columns)
    named = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"select {named} from ({SQL[name]})").fetchall()
    assert rounded(map(tuple, got.select(*cols).collect())) == rounded(want)


def test_registry():
    assert set(EVERY) - set(SQL) == {"whole_cleaning", "embedder_comparison"}
    assert set(EVERY) <= set(entry.queries()) and not set(EVERY) & set(queries.QUERIES)


def test_whole_cleaning_of_real_texts(spark):
    texts = {r.comment_id: r.text for r in more_queries.said(spark, SF).collect()}
    got = more_queries.whole_cleaning(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.clean == discourse.clean_comment(texts[r.comment_id]) and r.n_quotes == len(discourse.quotes(texts[r.comment_id])[0])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ranking_keeps_repeated_rows(spark):
    rows = [(1, "A", "the wording was misunderstood"), (1, "A", "the wording was misunderstood"), (2, "A", "unclear language"), (3, "H", "x"), (4, None, None), (5, "C", "")]
    df = spark.createDataFrame(rows, "comment_id long, code string, text string").repartition(2).cache()
    known = ranking.candidate_vectors(spark).cache()
    known.count()
    from loomspark.functions.embedding import hashed_vector

    vector = hashed_vector(F.col("text"))
    for got in (ranking.top_causes(df, spark), ranking.blended_causes(df, spark)):
        own = sorted((tuple(r) for r in got.select("comment_id", "code", "text", "top", "status").collect()), key=repr)
        assert len(own) == len(rows) and sum(r[0] == 1 for r in own) == 2
        assert all(len({x.cause_id for x in r[3]}) == len(r[3]) and len(r[3]) <= 3 for r in own)
        assert {r[4] for r in own if r[1] in ("H", None)} == {"no_candidates"}
    near = ranking.nearest_causes(df, known, vector).collect()
    assert len(near) == len(rows) and all(len({x.cause_name for x in r.microcauses}) == len(r.microcauses) == (0 if r.code in ("H", None) else 3) for r in near)
    assert len(ranking.legacy_causes(df, known, vector).collect()) == len(rows)
    flat = ranking.nearest_causes(df, known.select("*"), vector)
    assert exchanges(flat) <= 1  # the catalog's own


def test_quantiles_are_exact(spark):
    r = random.Random(1)
    for xs in ([], [0.5], [0.0, 1.0], [round(r.random(), 9) for _ in range(501)], [r.choice([0.25, 0.250000001, 0.9]) for _ in range(100)]):
        df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
        for p, got in zip((0.33, 0.66, 0.0, 1.0), index.quantiles(df, "x", (0.33, 0.66, 0.0, 1.0))):
            want = None
            if xs:
                s, at = sorted(xs), (len(xs) - 1) * p
                low, high = s[math.floor(at)], s[math.ceil(at)]
                want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
            assert got == want or abs(got - want) < 1e-15


def test_rank_within_labels(spark):
    rows = [("a" if i % 3 else "b" if i % 2 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = tables.spread_rank(df, "g", "k", 42).collect()
    assert len(got) == 500
    for g in ("a", "b", None):
        own = [r for r in got if r.g == g]
        assert sorted(r.__getitem__("__rank") for r in own) == list(range(1, len(own) + 1)) and {r["__n"] for r in own} == {len(own)}
    split = tables.stratified_split(df, "g", "k").groupBy("g").agg(F.count_if("is_test").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    assert all(r.n == round(r.m * 0.3) for r in split)


def test_first_of_key_and_missing(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, o int, v string")
    assert sorted(map(tuple, tables.first_of_key(df, ["k"], ["o"]).collect()), key=repr) == [("a", 1, "y"), (None, 3, "z")]
    known, used = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["a", "b", None], ["b", "c"]))
    assert sorted(map(tuple, tables.missing_keys(known, used, "k").collect())) == [("a", "unused"), ("c", "unknown")]
    assert tables.random_rows(df, "o", 2).count() == 2 and tables.distinct_counts(df, ["k", "v"]).first()[:] == (1, 4)


def test_labels_and_notes(spark):
    df = spark.createDataFrame([("a",), (" COMMUNICATION and shared  understanding breakdowns",), ("x",), (None,)], "t string")
    assert [r.c for r in df.select(checks.label_to_code(F.col("t")).alias("c")).collect()] == ["A", "A", None, None]
    rows = spark.createDataFrame([("A", "A", "0,9"), ("b", "A", "0.9"), ("x", "A", "0.2"), (None, "A", None)], "gold string, code string, conf string")
    got = [(r.evaluable, r.match, r.review) for r in checks.gold(rows, "gold", "code", "conf").collect()]
    assert got == [(True, True, False), (True, False, True), (False, None, True), (False, None, True)]


def test_bucket_keeps_to_its_budget():
    now = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = classifier.Bucket(600, clock=lambda: now[0], sleep=sleep)
    for _ in range(12):
        b.acquire(100)
    assert abs(now[0] - 60) < 1e-6  # 1200 tokens: 600 at once, the rest at 10 a second
    b.acquire(10_000)  # more than a minute's budget takes the whole of it
    assert now[0] <= 121


def test_client_failures_stay_with_their_rows(spark):
    df = spark.createDataFrame([(1, "there is a bug"), (2, "hello"), (3, None), (4, "  ")], "id long, text string")
    got = {r.id: r for r in classifier.classified(classifier.asked(df, "text", more_queries.fake_client, "p", 10**9, retries=1, tasks=1), "text").collect()}
    assert (got[1].status, got[1].code, got[1].confidence) == ("API_ERROR", "H", 0.0) and got[1].error == "TimeoutError: no answer"
    assert got[2].answer == "F|0.5" and got[2].error is None and got[3].status == got[4].status == "EMPTY_TEXT"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', ["x", " ", None, "y "]), (2, None, None)], "id long, text string, tags array<string>")
    writers.write_results(df, df.select("id"), str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r/comments")).collect())[1] == '{"id":2,"text":null,"tags":null}'
    assert writers.verify(spark, str(tmp_path / "r/issues_metrics"), "json", 2) == 2
    writers.write_csv(df, str(tmp_path / "c"))
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert (back[0].text, back[0].tags) == ('a "b"\nc', "x\ny") and writers.verify(spark, str(tmp_path / "c"), "csv", 2) == 2
    with pytest.raises(ValueError):
        writers.verify(spark, str(tmp_path / "c"), "csv", 3)
    log = str(tmp_path / "jobs")
    writers.update_job(spark, log, "j1", status="queued", total=5)
    writers.update_job(spark, log, "j1", status="done")
    writers.update_job(spark, log, "j2", status="queued")
    assert writers.job(spark, log, "j1").first().fields == {"status": "done", "total": "5"} and writers.job(spark, log, "no").count() == 0


def test_csv_with_another_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a|b\n1|x\n2|y\n3|z\n")
    assert readers.read_sniffed_csv(spark, str(tmp_path / "a.csv")).columns == ["a", "b"]
    assert readers.without_predictions(spark.sql("select 1 as a, 2 as code"), ["code", "nope"]).columns == ["a"]


def test_index_over_a_stream(spark, tmp_path, monkeypatch):
    """Deltas, full tables, a restart and a repeated batch give what the batch plan gives."""
    monkeypatch.setattr(stream_index, "FULL", 2)
    rows = queries._index_input(spark, SF).withColumn("part", F.pmod(F.xxhash64("row_ord"), F.lit(5)))
    names = ["issue_number", "comment_count", *(f"dominant_{k}" for k in index.COUNTED), "social_debt_index", "social_debt_level"]
    said = lambda df: sorted((str(r[0]), r[1], str([[(x["name"], round(x["value"], 6)) for x in c] for c in r[2:6]]), round(r[6], 6), r[7]) for r in df.select(names).collect())

    def more(parts):
        for i in parts:
            rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream_index.start_index(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination(240)
        own = rows.where(F.col("part") <= max(parts))
        return said(index.with_index(index.issue_features(own)))

    want = more([0, 1, 2])
    assert said(spark.read.parquet(str(tmp_path / "out/index-2"))) == want
    want = more([3, 4])
    assert said(spark.read.parquet(str(tmp_path / "out/index-4"))) == want
    left = {p.name for p in (tmp_path / "out").iterdir()}
    assert {n for n in left if not n.startswith("index")} == {"full-3", "features-4"} and {n for n in left if n.startswith("index")} == {"index-3", "index-4"}
    again = spark.read.parquet(str(tmp_path / "out/features-4"))
    ranked = [again.select("issue_number", F.lit(k).alias("kind"), F.posexplode(f"dominant_{k}").alias("r", "x"), F.col("comment_count").cast("double").alias("total")) for k in index.COUNTED]
    batch = ranked[0]
    for df in ranked[1:]:
        batch = batch.unionByName(df)
    batch = batch.select("issue_number", "kind", (F.col("r") + 1).alias("r"), "x.name", "x.value", "total")
    batch = spark.createDataFrame(batch.collect())
    stream_index.index_of_each_batch(str(tmp_path / "out"))(batch, 4)
    assert said(spark.read.parquet(str(tmp_path / "out/index-4"))) == want
    assert spark.conf.get(stream_index._PROVIDER).endswith("HDFSBackedStateStoreProvider")


def test_stages_clean_like_the_plan(spark):
    from loomspark.plans import comments as plans

    df = spark.createDataFrame([(1, "Thanks @bob"), (2, "> quoted\nsee #12"), (3, None)], "id long, text string")
    got = {r.id: r.clean for r in stages.annotate(df).collect()}
    assert got == {r.id: r.clean for r in plans.classify(df, "text").collect()}


def test_empty_tables(spark):
    none = queries._index_input(spark, SF).limit(0)
    assert index.with_index(index.issue_features(none)).count() == 0
    c = queries.comments(spark, SF).limit(0)
    assert ranking.top_causes(c, spark).count() == 0 and checks.residual(c.withColumn("level", F.lit("useful")), "text", "level").count() == 0
    assert checks.consistency(c.withColumn("label", F.lit("")).withColumn("status", F.lit("")), "code", "label", "code", "status").first().rows == 0


def test_columns_and_json(spark, tmp_path):
    df = spark.sql("select 1 as a, 2 as b, 3 as c")
    assert readers.move_column_after(df, "a", "b").columns == ["b", "a", "c"]
    df.write.json(str(tmp_path / "x.json"))
    assert readers.read_comments(spark, str(tmp_path / "x.json")).first()[:] == (1, 2, 3)


def test_vectors_and_importance(spark):
    from loomspark.operators import models

    rows = [(i, [float(i % 2), 1.0], float(i % 2), 0.5, "Low" if i % 2 else "High") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, vector array<double>, f double, g double, level string")
    fitted = models.vector_logistic(df, "level")
    assert models.predict(fitted, df, "vector").where("predicted != level").count() == 0
    got = {r.feature: r["mean"] for r in models.importance_by_fold(df, "level", "k", ("f", "g"), 2).collect()}
    assert got == {"f": 1.0, "g": 0.0}


def test_repeated_texts_are_searched_once(monkeypatch):
    seen, plain = [], regex.pc.match_substring_regex
    monkeypatch.setattr(regex.pc, "match_substring_regex", lambda texts, *a, **b: seen.append(len(texts)) or plain(texts, *a, **b))
    texts = pa.array(["a bug", None, "", "fine", "a BUG", "a bug"] * 50)
    got = regex._searched(texts, ["bug", "^$"], True)
    assert [x.to_pylist() for x in got] == [[True, None, False, False, True, True] * 50, [False, None, True, False, False, False] * 50]
    assert seen == [4, 4]
