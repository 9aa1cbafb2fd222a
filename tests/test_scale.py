"""What large inputs ask of the comment analytics: linear passes before pattern lists, no group or task with a whole text."""

from __future__ import annotations

import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from loomspark import constants as C
from loomspark import more_queries
from loomspark.functions import discourse, regex
from loomspark.functions import text as T
from loomspark.operators import causes, embedders, noise, ranking

BLANKS = (" ", "  ", "\n", " ", " \t", "\x1c")
SAYINGS = (
    "follow up pr", "Needs Rebase", "a red build", "the label x cannot be applied", "codecov y report", "split it in prs", "python 3.10", "can't", "BUG", "test", "attest", "étest", "test́", "logs",
    "frustrated by review", "mısunderstood", "ſecret", "Kubernetes ticKet flags", "MİLESTONE", "closes url_reference", "thanks !", "!cat image url_reference", "a github user is mentioned. x",
    "see #٣ now", "x/y#12", "٣ ns/op", "2 µs/op", "Visible: 3% - 5%", "Cı: x", "at place", "https:/a", "<BR>", "index 0a..1b 100644", "/gif x", "ab", "a b", "abcd", "",
)


def test_linear_pass_never_misses(spark):
    """Whatever the pattern lists find, the pass before them has let through; ordinary texts are let through by none."""
    texts = [left + said.replace(" ", blank) + right for said, blank, left, right in itertools.product(SAYINGS, BLANKS, ("", "x ", "x\n", "_"), ("", " x", "s", "\nx"))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    lists = causes.SIGNS | {f"f_{k}": p for k, p in T.FLAGS.items()} | {"phrase": C.HARD_PHRASE_PATTERNS}
    squeezed = regex.squeeze(F.col("t"))
    found = {k: regex.has_any(squeezed, p) for k, p in causes.SIGNS.items()} | {f"f_{k}": F.col("t").rlike("(?Ud)" + "|".join(f"(?:{p})" for p in v)) for k, v in T.FLAGS.items()}
    found["phrase"] = regex.has_any(regex.strip(F.col("t")), C.HARD_PHRASE_PATTERNS, False)
    may = regex.may_match(F.col("t"), causes.SIGNS), regex.may_match(F.col("t"), {k: p for k, p in lists.items() if k.startswith("f_")}, False), regex.may_match(regex.strip(F.col("t")), {"phrase": lists["phrase"]}, False)
    of = lambda k: may[0][k] if k in causes.SIGNS else may[1][k] if k.startswith("f_") else may[2][k]
    got = rows.agg(*(F.count_if(found[k]).alias(k) for k in found), *(F.count_if(found[k] & ~of(k)).alias(f"missed_{k}") for k in found)).first()
    assert [k for k in found if got[f"missed_{k}"]] == []
    assert sum(got[k] > 0 for k in found) >= 20
    plain = spark.createDataFrame([("Reoush hewh and onon of that. Ing that\nthinen ouél.",)], "t string")
    assert not any(plain.select(regex.may_match(F.col("t"), causes.SIGNS).alias("m")).first()["m"])


def test_noise_without_second_search(spark):
    """The residue is told from a text's shape where no placeholder can be in it."""
    texts = ["ab", "a  b", "a b c", "abc", "abcd", "a \n b", " abc ", "/gif", "!gif ab", "!gif abcd", "/url_reference ab", "ééé", "", "/retest\n/test all", "/retest\nplease do", "x /retest"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.lower(regex.strip(F.col("t")))
    plain = regex.matches_any(t, C.HARD_EXACT_PATTERNS) | noise.only_commands(t) | regex.has_any(t, C.HARD_PHRASE_PATTERNS, False) | (F.length(noise.residue(t)) <= 3)
    assert [r[0] for r in rows.select((noise.is_hard(F.col("t")) != plain).alias("x"), "i").orderBy("i").collect()] == [False] * len(texts)


def test_squeeze_and_strip(spark):
    texts = [" a  b ", "a b", "a\nb", "a \nb", " a b\x1c", "", "   ", "a\t\tb  c d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(regex.squeeze(F.col("t"))).collect()] == [" ".join(t.split()) for t in texts]


def test_words_and_first_words(spark):
    """The bytewise forms are those of the regular expressions, which cost a match a word."""
    texts = ["Ab, c-d  é\x1c1", " ! a ", "! !", "", None, "a\n\nb\x0b c", "é a é", "x" * 30 + " y", "one two three  four", " lead", "a b \u0085c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.coalesce("t", F.lit(""))
    name = F.regexp_replace(F.regexp_replace(regex.strip(F.lower(t)), r"[^a-z0-9\s]", ""), r"\s+", " ")
    match = regex.squeeze(F.regexp_replace(F.lower(t), r"[^a-z0-9\s-]", " "))
    first = F.array_join(F.slice(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""), 1, 2), " ")
    got = rows.select(T.normalize_name(F.col("t")), name, ranking.match_text(F.col("t")), match, T.first_words(F.col("t"), 2), first).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in got)
    plan = rows.select(T.normalize_name(F.col("t")), ranking.match_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_counted_terms_of_spread_texts(spark):
    """Terms of a text whose parts lie in many tasks, without the text."""
    rows = [(k, i, f"cause{'AB'[i % 2]} x M{i * i % 7}" if i % 5 else "") for k in (1, 2, 3) for i in range(40 if k < 3 else 1)]
    parts = spark.createDataFrame(rows, "k int, o int, t string")
    width = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = embedders.term_counts(parts.repartition(3), "k", ["o"], "t").localCheckpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", width)
    whole = {k: Counter(embedders.terms(" ".join(t for j, _, t in rows if j == k))) for k in (1, 2, 3)}
    got = {k: {} for k in (1, 2, 3)}
    for k, term, n in counts.collect():
        got[k][term] = n
    assert got == whole
    keys = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "k int, fold int")
    texts = keys.join(spark.createDataFrame([(k, " ".join(t for j, _, t in rows if j == k)) for k in (1, 2, 3)], "k int, t string"), "k")
    a, b = embedders.vocabulary_of_counts(keys, counts, "k", [0, 1]), embedders.vocabulary(texts, "t", [0, 1])
    assert a.terms == b.terms and (a.idf == b.idf).all()
    one = {r["k"]: dict(zip(*r["terms"])) for r in embedders.known_counts(counts, "k", a).collect()}
    other = {r["k"]: dict(zip(*r["c"])) for r in texts.select("k", embedders.counted_terms(F.col("t"), b).alias("c")).collect()}
    assert one == {k: v for k, v in other.items() if v}


def test_cleaning_looks_for_what_patterns_need():
    """A pattern that can be found is never left out, and ordinary words meet few patterns."""
    said = ["Codecov", "ſtale", "MERGİFY", "[bot]", "ERROR: x", "FAıL: x", "panic: runtime error", "== FAIL:", "exitcode 3", "5 ns/op", "3 Iterationſ/s", "@a/b", "Line 3 in /haſh_reference(x)", "[a](http://b)", "HTTPS:/x.y", "#3",
            "<BR>", "Viſible: 1% - 2%", "a \t b", "a \n b", "ındex 0a..1b 100644", "diff --git a", "@@ -1 +1 @@", ":D", "XDD", "=)", "^^", "T_T", ":'(", "D:<", "o_O", ":\\\\", "O.o", ";)", "XP", ":eyes:", "\r\n", "\n\n\n", "dependabot", "review_bot"]
    for text in said:
        for pattern in discourse.NEEDED:
            found = re.search(pattern if pattern.startswith("(?") else f"(?m){pattern}", text)
            # a single blank or break is put in its own place
            assert discourse._can(pattern, text) or not found or found[0] in (" ", "\n"), (pattern, text)
    met = [p for p in discourse.NEEDED if discourse._can(p, "Reoush hewh and onon of that. Ing thinen ouél.")]
    assert len(met) <= 3


def test_equal_comments_are_compared_once(spark, tmp_path, monkeypatch):
    """However often a text comes with a code, it is ranked once and counted as often as it comes."""
    spark.range(3 * 1040).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    ranked = []
    plain = ranking.argmax_baseline
    monkeypatch.setattr(ranking, "argmax_baseline", lambda c, *rest: (ranked.append(c.count()), plain(c, *rest))[1])
    found = more_queries.compared_causes(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in found) == 3 * 1040 and ranked == [104]
