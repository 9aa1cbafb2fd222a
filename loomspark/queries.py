"""Queries of the comment analytics, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import cases
from loomspark import constants as C
from loomspark.functions import discourse, embedding
from loomspark.functions import text as T
from loomspark.operators import causes, diagnosis, embedders, index, models, noise, ontology, ranking, tables
from loomspark.plans import comments as plans
from loomspark.plans.lineage import written
from loomspark.streaming import stages

#: Comments of a few kinds; the tables have none, so orders are given one each.
TEMPLATES = (
    "LGTM.", "/lgtm", "ok", "yes.", "/automated_bot_message please rerun", "The secret is loaded from configuration.", "Can you review?", "External tests ran successfully: /url_reference",
    "Sorry, I misunderstood your comment. I've made the correction.", "Thank you for this PR! Code looks good, did you run the perf dash to check it works as intended?", "I gotcha a GitHub user, updated the pr description",
    "Resolved trival conflict to another feature gate. Please review again, thanks.", "Here's a minimal reproduction /url_reference", "/workflow_ci", "maybe we should split this into smaller PRs, not sure", "This is blocked by the approval process and the release branch",
    "The documentation is unclear and confusing", "feedback was ignored, this feels unfair", "I disagree, the implementation cannot work with sqlite, there is a bug", "ASAP please, this is blocking the cluster", "can you help me understand the runtime error in the package", "thanks!", "any update?", "needs rebase", "waiting for review feedback, no response since last week", "/retest\n/test all",
)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comment_id, issue_number, text, code, confidence, made from orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("o_orderkey") % len(TEMPLATES) + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, "ABCDEFGH")), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return orders.select(F.col("o_orderkey").alias("comment_id"), (F.col("o_custkey") % 50).alias("issue_number"), text.alias("text"), code.alias("code"), ((F.col("o_orderkey") % 10) / 10).alias("confidence"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(TEMPLATES))
SQL_COMMENTS = f"""tpl(i, text) AS (VALUES {_VALUES}),
comments AS (SELECT o_orderkey AS comment_id, o_custkey % 50 AS issue_number, text, substr('ABCDEFGH', CAST(o_orderkey % 8 + 1 AS INT), 1) AS code, (o_orderkey % 10) / 10.0 AS confidence FROM orders JOIN tpl ON i = o_orderkey % {len(TEMPLATES)})"""


def _any(patterns, of: str = "t", how: str = "regexp_matches", options: str = "is") -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"{how}({of}, {_quoted(joined)}, '{options}')"


# -- queries


def comment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    return c.select("comment_id", *(v.alias(k) for k, v in T.signals(F.col("text")).items()))


def noise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments(spark, sf_dir).select("comment_id", noise.noise_level(F.col("text")).alias("noise_level"))


def priority_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = causes.with_rules(comments(spark, sf_dir), "text", F.col("code"), F.col("confidence"), "r")
    return c.select("comment_id", F.col("r.code").alias("final_code"), F.round("r.confidence", 4).alias("final_confidence"), F.col("r.rule").alias("rule"))


ANSWERS = ((1, "G|0.90"), (2, "answer: B"), (3, "I think B or A"), (4, "G|1,0"), (5, "G|10"), (6, None), (7, " 'c' | 0,7 or 0.8 "), (8, ""))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model said of each order, one of ANSWERS by its key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    raw = F.get(F.array(*(F.lit(a) for _, a in ANSWERS)), (F.col("id") % len(ANSWERS)).cast("int"))
    return o.select("id", causes.answer_code(raw).alias("code"), causes.answer_confidence(raw).alias("confidence"))


def useful_comments_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    return tables.loss(c, c.where(noise.noise_level(F.col("text")) == "useful"), "issue_number")


def _index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount")
    one = F.struct(F.concat(F.lit("M"), F.col("l_partkey") % 9).alias("cause_name"), F.round(F.col("l_discount") * 100, 0).cast("double").alias("similarity"), F.array(F.concat(F.lit("S"), F.col("l_partkey") % 4)).alias("community_smells"), F.array(F.concat(F.lit("R"), F.col("l_suppkey") % 3)).alias("risks"))
    return li.select((F.col("l_orderkey") % 200).alias("issue_number"), F.struct("l_orderkey", "l_linenumber").alias("row_ord"), F.element_at(F.array(*map(F.lit, "ABCDEFGH")), (F.col("l_suppkey") % 8 + 1).cast("int")).alias("code"), F.array(one).alias("microcauses"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features are written once; the index reads them several times."""
    return index.with_index(written(index.issue_features(_index_input(spark, sf_dir)), "features"))


def issue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _indexed(spark, sf_dir)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",").alias(c)
    return out.select("issue_number", "comment_count", "macro_diversity", "micro_diversity", "smell_diversity", "risk_diversity", "top_macro_frequency", "top_micro_score", "top_smell_frequency", "top_risk_frequency", names("dominant_macrocauses"), names("dominant_microcauses"), F.round("social_debt_index", 6).alias("social_debt_index"), "social_debt_level")


def lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir).where("code != 'H'").select("comment_id", "code", "text")
    top = ranking.top_causes(c, spark, comment_similarity=lambda x: F.lit(0.3))
    return top.select("comment_id", F.array_join(F.transform("top", lambda x: x["cause_id"]), ",").alias("cause_ids"), F.round(F.get("top", F.lit(0))["score"], 6).alias("best_score"), "status")


def ontology_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ontology tells of each order's cause, one of the catalog's by its key; the cause without any has no row."""
    known = ontology.enrichment(ontology.triples(spark)).where(F.col("cause_id").isin(*C.CAUSE_KEYWORDS))
    ids = F.array(*map(F.lit, sorted(C.CAUSE_KEYWORDS)))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.get(ids, (F.col("o_orderkey") % len(C.CAUSE_KEYWORDS)).cast("int")).alias("cause_id"))
    return o.join(F.broadcast(known), "cause_id").select("o_orderkey", "cause_id", *(F.array_join(r, ",").alias(r) for r in ontology.LISTS))


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each label: the mean of its vectors; labels as causes of two codes."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null")
    each = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("vector")
    return each.groupBy("label").agg(vector).select((F.col("label") % 2).cast("string").alias("code"), F.format_string("L%03d", "label").alias("cause_id"), "vector")


def cosine_to_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))  # one vector for each label
    p = e.join(first, ["label", "vec_id"]).select("label", F.col("embedding").alias("p"))
    return e.join(p, "label").select("vec_id", F.round(ranking.cosine(F.col("embedding"), F.col("p")), 5).alias("similarity"))


def similarity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_discount") * 10).cast("double").alias("x"))
    return tables.value_counts(li.select(tables.bins(F.round("x", 4)).alias("bin")), "bin")


def cause_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir).select("code", noise.noise_level(F.col("text")).alias("level"))
    return tables.crosstab(c, "code", "level", ["hard_noise", "operational_noise", "useful"])


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    r = tables.class_report(labels, "quality", "toxic", [0, 1])
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def html_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    clean = T.replace_html(F.col("html"))
    return p.select("page_id", F.regexp_count(clean, F.lit("/html_link_reference")).alias("n_links"), F.md5(clean.cast("binary")).alias("clean_md5"))


def lost_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    return c.select("text").distinct().exceptAll(c.where("code = 'B'").select("text").distinct())


def annotated_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = lambda t: T.anonymize_mentions(T.replace_raw_urls(T.clean_inline_code(T.normalize_breaks(t))))
    a = stages.annotate(comments(spark, sf_dir).select("comment_id", "text"), clean=native)
    return a.groupBy("noise_level", "cause").agg(F.count(F.lit(1)).alias("n"))


def duplicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicate_count(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_partkey", "l_suppkey"])


def _case(items: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.col(key) % len(items) + 1).cast("int"))


def cleaned_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cleaning, over a raw comment for each order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("comment_id"))
    return o.select("comment_id", discourse.cleaned(_case([raw for raw, _ in cases.CLEANED], "comment_id")).alias("clean"))


def comment_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("comment_id"))
    text = _case([t for t, _, _ in cases.EMOTIONS], "comment_id")
    return o.select("comment_id", discourse.emotion_count(text).alias("n"), F.array_join(discourse.emotion_types(text), ",").alias("tags"))


def bot_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    author = F.element_at(F.array(*map(F.lit, BOT_AUTHORS)), (F.col("turn") % len(BOT_AUTHORS) + 1).cast("int"))
    return c.select("conv_id", "turn", discourse.bot(author, F.lit("")).alias("bot")).groupBy("bot").agg(F.count(F.lit(1)).alias("n"))


BOT_AUTHORS = ("alice", "dependabot", "triage-robot", "ci_robot", "welcome-bot")


def _issues_with_strategies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _index_input(spark, sf_dir)
    listed = rows.select("issue_number", "row_ord", F.array(F.concat(F.lit("P"), F.col("row_ord.l_orderkey") % 7)).alias("preventive_strategies"), F.array(F.concat(F.lit("K"), F.col("row_ord.l_orderkey") % 5)).alias("corrective_strategies"))
    return _indexed(spark, sf_dir), diagnosis.top_strategies(listed)


def issue_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnosis.diagnosis(*_issues_with_strategies(spark, sf_dir))
    return found.select("issue_number", diagnosis.report().alias("report"), diagnosis.report(listed=True).alias("interpretation"))


def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.level_summary(written(_indexed(spark, sf_dir), "indexed"))


def classification_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = causes.with_rules(comments(spark, sf_dir), "text", F.col("code"), F.col("confidence"), "r")
    return c.groupBy(causes.status(F.col("text"), F.col("r.confidence"), F.col("r.rule")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.md5(embedding.embedding_text(F.col("text")).cast("binary")).alias("embedding_md5"), F.md5(embedding.short_text(F.col("text")).cast("binary")).alias("short_md5"))


def online_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir).where("code != 'H'").select("comment_id", "code", "text")
    near = ranking.nearest_causes(c, ranking.candidate_vectors(spark), embedding.hashed_vector(F.col("text")))
    return near.select("comment_id", F.array_join(F.transform("microcauses", lambda m: m["cause_name"]), ",").alias("cause_ids"), F.round(F.get("microcauses", F.lit(0))["similarity"], 6).alias("best"))


def cause_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cause_pairs(prototypes(spark, sf_dir))


def item_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_discount"])
    return s.select("column_name", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")))


def order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = lambda n: li.where(F.col("l_linenumber") == n).select("l_orderkey", F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("double").alias("x"))
    return tables.agreement(one(1), one(2), "l_orderkey", "label", "x").select("n", "percent_equal", F.round("mean_gap", 6).alias("mean_gap"), "largest_gap")


def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") % 9).alias("micro"), "l_returnflag", F.col("l_quantity").cast("double").alias("score"))
    p = tables.pivot_mean(li, "micro", "l_returnflag", ["A", "N", "R", "X"], "score")
    return p.select("micro", *(F.round(c, 6).alias(f"mean_{c.lower()}") for c in "ANRX"))


def changed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comments(spark, sf_dir)
    a, b = (c.where(f"code = '{code}'").select((F.col("comment_id") % 5003).alias("k")) for code in "AB")
    return tables.differences(a, b, "k")


def null_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.null_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def classified_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from raw comments to causes; the raw ones are the literal cases."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("comment_id"))
    raw = o.select("comment_id", _case([t for t, _ in cases.CLEANED], "comment_id").alias("body"))
    return plans.classify(raw, "body").groupBy("noise_level", "code", "status").agg(F.count(F.lit(1)).alias("n"))


def level_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well an issue's level is learned from its causes' names and from its features."""
    rows = _index_input(spark, sf_dir)
    words = rows.select("issue_number", "row_ord.*", F.concat_ws(" ", F.concat(F.lit("cause"), F.col("code")), F.col("microcauses")[0]["cause_name"]).alias("t"))
    counts = written(embedders.term_counts(words, "issue_number", ["l_orderkey", "l_linenumber"], "t"), "term-counts")
    return models.holdout(_indexed(spark, sf_dir), "social_debt_level", "issue_number", counts=counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (comment_signals, noise_levels, priority_rules, model_answers, useful_comments_loss, issue_index, lexical_ranking, ontology_enrichment, cosine_to_prototypes, similarity_bins, cause_crosstab, class_report, html_flags, lost_texts, annotated_comments, duplicate_parts, cleaned_comments, comment_emotions, bot_kinds, issue_reports, level_summary, classification_status, embedding_texts, online_causes, cause_pairs, item_summary, order_agreement, mean_scores, changed_issues, null_cells, classified_comments, level_models)
}


# -- the SQL

# the look-arounds of one signal, said without them
_SIGNALS = T.SIGNALS | {"has_agreement_signal": r"(?:^|\W)\+1(?:\W|$)|\bIIUC\b"}
_residue = "t"
for _p in C.PLACEHOLDERS_TO_REMOVE:
    _residue = f"replace({_residue}, {_quoted(_p)}, ' ')"
for _p in (*C.GENERIC_USER_PLACEHOLDERS, *C.LOW_VALUE_VISUAL_PATTERNS):
    _residue = f"regexp_replace({_residue}, {_quoted(_p)}, ' ', 'g')"
_HARD = f"""(regexp_matches(t, {_quoted('^(?:' + '|'.join(C.AUTOMATED_PREFIX_MARKERS) + ')')}) OR {_any(C.HARD_EXACT_PATTERNS, how='regexp_full_match', options='s')} OR len(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(trim(x), '/[a-zA-Z0-9_-]+(\\s+[a-zA-Z0-9_.-]+)?'))) = 0
  OR {_any(C.HARD_PHRASE_PATTERNS, options='s')} OR length(trim(regexp_replace({_residue}, '\\s+', ' ', 'g'))) <= 3)"""
_OPERATIONAL = _any((*C.OPERATIONAL_EXACT_PATTERNS, *C.OPERATIONAL_PHRASE_PATTERNS), how="regexp_full_match", options="s")
SQL_NOISE_OF_COMMENTS = f"low AS (SELECT *, lower(trim(text)) AS t FROM comments), noise AS (SELECT comment_id, issue_number, code, CASE WHEN {_HARD} THEN 'hard_noise' WHEN {_OPERATIONAL} THEN 'operational_noise' ELSE 'useful' END AS noise_level FROM low)"
SQL_NOISE = f"{SQL_COMMENTS}, {SQL_NOISE_OF_COMMENTS}"
_E = {name: _any(p) for _, _, name, p in causes.RULES}
_EVIDENCE = " OR ".join(_E.values())
_CASES = " ".join(f"WHEN {_E[name]} THEN {{'code': '{code}', 'conf': {conf}, 'rule': '{name}'}}" for code, conf, name, _ in causes.RULES)
_H = "{{'code': 'H', 'conf': 0.95, 'rule': '{}'}}"
SQL_RULE = f"""CASE WHEN {_any(C.BOT_TEMPLATE_PATTERNS)} AND NOT ({_EVIDENCE}) THEN {_H.format('H_bot_template_without_evidence')} WHEN {_any(C.MINIMAL_H_PATTERNS)} AND NOT ({_EVIDENCE}) THEN {_H.format('H_minimal_without_evidence')} {_CASES} END"""
SQL_ALLOWED = f"""CASE r.code WHEN 'C' THEN {_E['C_technical_evidence']} AND {_any(C.TECHNICAL_PROBLEM_PATTERNS)} WHEN 'G' THEN {_E['G_validation_tooling_evidence']} AND {_any(C.VALIDATION_PROBLEM_PATTERNS)} WHEN 'F' THEN {_E['F_documentation_evidence']} ELSE NOT {_any(C.SOCIAL_OR_MINIMAL_CONTEXT_PATTERNS)} END"""
SQL_DECIDED = f"""ruled AS (SELECT *, {SQL_RULE} AS r FROM sq), decided AS (SELECT *, CASE WHEN r IS NULL THEN {{'code': code, 'conf': confidence, 'rule': 'none'}} WHEN r.code = 'H' THEN {{'code': 'H', 'conf': greatest(confidence, r.conf), 'rule': r.rule}}
  WHEN code = 'H' AND ({SQL_ALLOWED}) THEN {{'code': r.code, 'conf': greatest(confidence, r.conf), 'rule': r.rule || '_override_H'}} WHEN code = 'H' THEN {{'code': code, 'conf': confidence, 'rule': 'override_rejected_keep_H'}}
  WHEN confidence < 0.7 AND r.code <> code THEN {{'code': r.code, 'conf': greatest(confidence, r.conf), 'rule': r.rule || '_low_conf_override'}} WHEN r.code = code THEN {{'code': code, 'conf': greatest(confidence, r.conf), 'rule': r.rule || '_confirmed'}} ELSE {{'code': code, 'conf': confidence, 'rule': 'none_llm_kept'}} END AS d FROM ruled)"""
SQL_INDEX_TABLES = """
WITH li AS (SELECT l_orderkey % 200 AS issue, l_orderkey, l_linenumber, substr('ABCDEFGH', CAST(l_suppkey % 8 + 1 AS INT), 1) AS macro, 'M' || (l_partkey % 9) AS micro, CAST(round(l_discount * 100, 0) AS DOUBLE) AS sim, 'S' || (l_partkey % 4) AS smell, 'R' || (l_suppkey % 3) AS risk FROM lineitem),
items AS (SELECT issue, 'macro' AS kind, macro AS name, 1.0 AS v, l_orderkey AS a, l_linenumber AS b FROM li UNION ALL SELECT issue, 'micro', micro, sim, l_orderkey, l_linenumber FROM li UNION ALL SELECT issue, 'smell', smell, 1.0, l_orderkey, l_linenumber FROM li UNION ALL SELECT issue, 'risk', risk, 1.0, l_orderkey, l_linenumber FROM li),
sums AS (SELECT issue, kind, name, CAST(sum(v) AS DOUBLE) AS v, min((a, b)) AS p FROM items GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY issue, kind ORDER BY v DESC, p, name) AS r FROM sums QUALIFY r <= 5),
f AS (SELECT issue AS issue_number,
  count(*) FILTER (kind = 'macro') AS macro_diversity, count(*) FILTER (kind = 'micro') AS micro_diversity, count(*) FILTER (kind = 'smell') AS smell_diversity, count(*) FILTER (kind = 'risk') AS risk_diversity,
  max(v) FILTER (kind = 'macro') AS top_macro_frequency, max(v) FILTER (kind = 'micro') AS top_micro_score, max(v) FILTER (kind = 'smell') AS top_smell_frequency, max(v) FILTER (kind = 'risk') AS top_risk_frequency,
  string_agg(name, ',' ORDER BY r) FILTER (kind = 'macro') AS dominant_macrocauses, string_agg(name, ',' ORDER BY r) FILTER (kind = 'micro') AS dominant_microcauses, string_agg(name, ',' ORDER BY r) FILTER (kind = 'smell') AS dominant_smells, string_agg(name, ',' ORDER BY r) FILTER (kind = 'risk') AS dominant_risks FROM top GROUP BY issue),
g AS (SELECT f.*, c.comment_count FROM f JOIN (SELECT issue AS issue_number, count(*) AS comment_count FROM li GROUP BY 1) c USING (issue_number)),
s AS (SELECT *, round((MEAN) / 6.0, 9) AS x FROM g),
q AS (SELECT round(quantile_cont(x, 0.33), 9) AS q1, round(quantile_cont(x, 0.66), 9) AS q2 FROM s)
""".replace("MEAN", " + ".join(f"coalesce(({c} - min({c}) OVER ())::DOUBLE / nullif((max({c}) OVER () - min({c}) OVER ())::DOUBLE, 0), 0)" for c in index.FEATURES))
SQL_INDEX = f"""{SQL_INDEX_TABLES}
SELECT issue_number, comment_count, macro_diversity, micro_diversity, smell_diversity, risk_diversity, top_macro_frequency, top_micro_score, top_smell_frequency, top_risk_frequency, dominant_macrocauses, dominant_microcauses, round(x, 6) AS social_debt_index,
  CASE WHEN x <= q1 THEN 'Low Social Debt' WHEN x <= q2 THEN 'Medium Social Debt' ELSE 'High Social Debt' END AS social_debt_level FROM s, q
"""
SQL_LEVELLED = f"""{SQL_INDEX_TABLES}, lv AS (SELECT *, CASE WHEN x <= q1 THEN 'Low Social Debt' WHEN x <= q2 THEN 'Medium Social Debt' ELSE 'High Social Debt' END AS social_debt_level FROM s, q)"""


def _said(template: str, listed: bool) -> str:
    """A paragraph of a report as SQL: names are columns <kind>_1 to <kind>_3."""
    scalars = {"issue": "issue_number::VARCHAR", "level": "social_debt_level", "level_words": f"CASE social_debt_level {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in diagnosis.LEVEL_WORDS.items())} END", "index": "round(x, 3)::VARCHAR", "count": "comment_count::VARCHAR"}
    three = lambda k: [f"coalesce(nullif(split_part({k}, ',', {i}), ''), 'None')" for i in (1, 2, 3)]
    joins = ("chr(10) || '1) '", "',' || chr(10) || '2) '", "', y' || chr(10) || '3) '") if listed else ("''", "', '", "' y '")
    for kind in diagnosis.KINDS | diagnosis.STRATEGIES:
        scalars[kind] = " || ".join(x for pair in zip(joins, three(kind)) for x in pair)
    out = _quoted(template)
    for key, sql in scalars.items():
        out = out.replace("{" + key + "}", f"' || {sql} || '")
    return out


SQL_REPORTS = f"""{SQL_LEVELLED}, st AS (SELECT l_orderkey % 200 AS issue_number, 'P' || (l_orderkey % 7) AS p, 'K' || (l_orderkey % 5) AS k, (l_orderkey, l_linenumber) AS o FROM lineitem),
ps AS (SELECT issue_number, string_agg(p, ',' ORDER BY r) FILTER (r <= 3) AS preventive_strategy FROM (SELECT issue_number, p, row_number() OVER (PARTITION BY issue_number ORDER BY count(*) DESC, min(o)) AS r FROM st GROUP BY 1, 2) GROUP BY 1),
ks AS (SELECT issue_number, string_agg(k, ',' ORDER BY r) FILTER (r <= 3) AS corrective_strategy FROM (SELECT issue_number, k, row_number() OVER (PARTITION BY issue_number ORDER BY count(*) DESC, min(o)) AS r FROM st GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT *, dominant_macrocauses AS macrocause, dominant_microcauses AS microcause, dominant_smells AS community_smell, dominant_risks AS risk FROM lv JOIN ps USING (issue_number) JOIN ks USING (issue_number))
SELECT issue_number, {" || chr(10) || chr(10) || ".join(_said(t, False) for t in diagnosis.REPORT)} AS report, {" || chr(10) || chr(10) || ".join(_said(t, True) for t in diagnosis.INTERPRETATION)} AS interpretation FROM d"""
_TOPS = ", ".join(f"string_agg(name || ' (' || {'round(v, 3)::VARCHAR' if k == 'micro' else 'v::BIGINT::VARCHAR'} || ')', '; ' ORDER BY r) FILTER (kind = '{k}' AND r <= 3) AS top_{c}" for k, c in (("macro", "macrocauses"), ("micro", "microcauses"), ("smell", "community_smells"), ("risk", "risks")))
SQL_LEVEL_SUMMARY = f"""{SQL_LEVELLED}, ll AS (SELECT issue_number AS issue, social_debt_level FROM lv),
c AS (SELECT social_debt_level, kind, name, sum(v) AS v, row_number() OVER (PARTITION BY social_debt_level, kind ORDER BY sum(v) DESC, min((issue, r))) AS r FROM top JOIN ll USING (issue) GROUP BY 1, 2, 3),
t AS (SELECT social_debt_level, {_TOPS} FROM c GROUP BY 1),
m AS (SELECT social_debt_level, count(*) AS issue_count, round(avg(x), 3) AS mean_sdi, round(avg(comment_count), 3) AS mean_comments, round(avg(macro_diversity), 3) AS mean_macro_diversity,
  round(avg(top_macro_frequency), 3) AS mean_top_macro_frequency, round(avg(top_micro_score), 3) AS mean_top_micro_score, round(avg(top_smell_frequency), 3) AS mean_top_smell_frequency, round(avg(top_risk_frequency), 3) AS mean_top_risk_frequency FROM lv GROUP BY 1)
SELECT * FROM m JOIN t USING (social_debt_level)"""
_CANDIDATES = ", ".join(f"('{code}', {i}, {_quoted(cause)}, {'[' + ', '.join(map(_quoted, C.LEXICAL_SIGNALS.get(cause, []))) + ']'}::VARCHAR[], {C.GENERIC_CAUSE_PENALTY.get(cause, 0.0)})" for code, label in C.CAUSES.items() for i, cause in enumerate(sorted(C.MACRO_TO_CANDIDATE_INDIVIDUALS.get(label, []))))
_LANGUAGE = "[" + ", ".join(map(_quoted, C.LANGUAGE_TERMS)) + "]"
SQL_RANKING = f"""
WITH {SQL_COMMENTS}, cand(code, pos, cause_id, signals, penalty) AS (VALUES {_CANDIDATES}),
m AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM comments WHERE code <> 'H'),
s AS (SELECT comment_id, pos, cause_id, greatest(0.0, least(1.0, 0.27::DOUBLE + 0.2::DOUBLE * least(1.0, len(list_filter(signals, lambda x: contains(t, x))) / 3.0::DOUBLE) - (penalty::DOUBLE + CASE WHEN cause_id LIKE 'CO-001%' AND len(list_filter({_LANGUAGE}, lambda x: contains(t, x))) = 0 THEN 0.1::DOUBLE ELSE 0 END))) AS score FROM m JOIN cand USING (code)),
o AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY score DESC, pos) AS r, max(score) OVER (PARTITION BY comment_id) AS best FROM s)
SELECT comment_id, string_agg(cause_id, ',' ORDER BY r) AS cause_ids, round(max(best), 6) AS best_score, CASE WHEN max(best) >= 0.28 THEN 'mapped' ELSE 'mapped_low_confidence' END AS status FROM o
WHERE (best >= 0.28 AND score >= 0.28 AND best - score <= 0.18 AND r <= 3) OR (best < 0.28 AND r = 1) GROUP BY comment_id
"""
_TRIPLES = ", ".join(f"({_quoted(s)}, {_quoted(p)}, {_quoted(o)})" for s, p, o in ontology.sample_triples())
_ROLES = ", ".join(f"('{p}', '{r}')" for r, ps in ontology.ROLES.items() for p in ps)
SQL_ENRICHMENT = f"""
WITH g(s, p, o) AS (VALUES {_TRIPLES}), role(p, role) AS (VALUES {_ROLES}), n AS (SELECT s, regexp_replace(s, '.*[#/]', '') AS id, regexp_replace(p, '.*[#/]', '') AS p, o, regexp_replace(o, '.*[#/]', '') AS name FROM g),
f AS (SELECT DISTINCT id, role, name FROM n JOIN role USING (p) UNION SELECT DISTINCT a.id, 'corrective_strategies', b.name FROM n a JOIN n b ON a.p = 'generatesEffect' AND b.s = a.o AND b.p IN ({', '.join(map(_quoted, ontology.CORRECTIVE))}))
SELECT id AS cause_id, {', '.join(f"coalesce(string_agg(name, ',' ORDER BY name) FILTER (role = '{r}'), '') AS {r}" for r in ontology.LISTS)} FROM f WHERE id IN ({', '.join(map(_quoted, C.CAUSE_KEYWORDS))}) GROUP BY id
"""
_WORDS = ", ".join(f"({_quoted(k)}, {_quoted(k.replace('_', ' ').replace('-', ' ') + ' ' + v)})" for k, v in C.CAUSE_KEYWORDS.items())


def _vector(text: str) -> str:
    """The hashed vector as SQL."""
    cells = f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::INT % {embedding.DIMENSIONS})"
    return f"(SELECT list(n ORDER BY i) FROM (SELECT i, len(list_filter({cells}, lambda c: c = i))::DOUBLE AS n FROM range({embedding.DIMENSIONS}) r(i)))"


SQL_VECTORS = f"kw(cause_id, words) AS (VALUES {_WORDS}), cv(code, pos, cause_id) AS (SELECT code, pos, cause_id FROM (VALUES {_CANDIDATES}) c(code, pos, cause_id, signals, penalty)), known AS (SELECT code, pos, cause_id, {_vector('words')} AS vector FROM cv JOIN kw USING (cause_id))"
SQL_PROTOTYPES = """each AS (
  SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL) GROUP BY label, i),
known AS (SELECT (label % 2)::VARCHAR AS code, printf('L%03d', label) AS cause_id, list(x ORDER BY i) AS vector FROM each GROUP BY label)"""
SQL_ONLINE = f"""
WITH {SQL_COMMENTS}, {SQL_VECTORS}, tv AS (SELECT i, text, {_vector('text')} AS v FROM tpl), c AS (SELECT comment_id, code, v FROM comments JOIN tv USING (text) WHERE code <> 'H'),
s AS (SELECT comment_id, pos, cause_id, round(coalesce(list_cosine_similarity(v, vector), 0), 9) AS s FROM c JOIN known USING (code)), o AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY s DESC, pos) AS r FROM s)
SELECT comment_id, string_agg(cause_id, ',' ORDER BY r) AS cause_ids, round(max(s), 6) AS best FROM o WHERE r <= 3 GROUP BY 1"""
_HTML = "coalesce(html, '')"
for _p, _tag in T.HTML_STEPS:
    _HTML = f"regexp_replace({_HTML}, {_quoted(_p)}, {_quoted(_tag)}, 'g')"
_SPACE = r"[\s\x1c-\x1f\x{85}\pZ]+"
_STRIPPED = f"regexp_replace(t, '\\A{_SPACE}|{_SPACE}\\z', '', 'g')"
_EMBEDDED = "coalesce(text, '')"
for _p, _tag in embedding.EMBEDDING_STEPS:
    _EMBEDDED = f"regexp_replace({_EMBEDDED}, {_quoted(_p)}, {_quoted(_tag)}, 'g')"
_FIRST = r"array_to_string(list_slice(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''), 1, {}), ' ')"
_SHORT = r"regexp_replace(regexp_replace(coalesce(text, ''), 'http\S+', ' ', 'g'), '/[\pL\pN\pM_]+', ' ', 'g')"
SQL = {
    "classification_status": f"""WITH {SQL_COMMENTS}, sq AS (SELECT comment_id, code, confidence::DOUBLE AS confidence, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t
      FROM comments), {SQL_DECIDED} SELECT CASE WHEN d.rule LIKE 'none%' THEN CASE WHEN d.conf < 0.7 THEN 'REVIEW'
      ELSE 'ACCEPTED' END WHEN d.rule LIKE '%override%' THEN 'RULE_OVERRIDE' WHEN d.rule LIKE '%confirmed%' THEN 'RULE_CONFIRMED'
      ELSE 'RULE_APPLIED' END AS status, count(*) AS n FROM decided GROUP BY 1""",
    "embedding_texts": f"SELECT conv_id, turn, md5({_FIRST.format(_EMBEDDED, 120)}) AS embedding_md5, md5({_FIRST.format(_SHORT, 60)}) AS short_md5 FROM conversations",
    "online_causes": SQL_ONLINE,
    "cause_pairs": f"""
WITH {SQL_PROTOTYPES}
SELECT a.code, a.cause_id AS cause_1, b.cause_id AS cause_2, round(list_cosine_similarity(a.vector, b.vector), 6) AS similarity
FROM known a JOIN known b ON a.code = b.code AND a.cause_id < b.cause_id""",
    "item_summary": 'SELECT column_name, count(x) AS "count", ' + ", ".join(f"round({e}, 6) AS {n}" for n, e in (("mean", "avg(x)"), ("std", "stddev_samp(x)"), ("min", "min(x)"), ("p25", "quantile_cont(x, 0.25)"), ("p50", "quantile_cont(x, 0.5)"), ("p75", "quantile_cont(x, 0.75)"), ("max", "max(x)"))) + " FROM (SELECT 'l_quantity' AS column_name, l_quantity::DOUBLE AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount::DOUBLE FROM lineitem) GROUP BY 1",
    "order_agreement": """WITH a AS (SELECT l_orderkey, max({'l': l_returnflag, 'x': l_quantity::DOUBLE}) AS m FROM lineitem WHERE l_linenumber = 1
      GROUP BY 1), b AS (SELECT l_orderkey, max({'l': l_returnflag, 'x': l_quantity::DOUBLE}) AS m FROM lineitem
      WHERE l_linenumber = 2 GROUP BY 1) SELECT count(*) AS n, round(100 * avg((a.m.l = b.m.l)::INT), 2) AS percent_equal,
      round(avg(abs(a.m.x - b.m.x)), 6) AS mean_gap, max(abs(a.m.x - b.m.x)) AS largest_gap FROM a JOIN b USING (l_orderkey)""",
    "mean_scores": "SELECT l_partkey % 9 AS micro, " + ", ".join(f"round(coalesce(avg(l_quantity::DOUBLE) FILTER (l_returnflag = '{f}'), 0), 6) AS mean_{f.lower()}" for f in "ANRX") + " FROM lineitem GROUP BY 1",
    "changed_issues": f"""WITH {SQL_COMMENTS}, a AS (SELECT DISTINCT comment_id % 5003 AS k FROM comments WHERE code = 'A'), b AS (SELECT DISTINCT comment_id % 5003 AS k
      FROM comments WHERE code = 'B') SELECT k, 'before' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL
      SELECT k, 'after' FROM b WHERE k NOT IN (SELECT k FROM a)""",
    "null_cells": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "classified_comments": f"""WITH v(i, text) AS (VALUES {', '.join(f'({i}, {_quoted(want)})' for i, (_, want) in enumerate(cases.CLEANED))}),
      comments AS (SELECT o_orderkey AS comment_id, 0 AS issue_number, text, 'H' AS code FROM orders JOIN v ON i = o_orderkey % {len(cases.CLEANED)}), {SQL_NOISE_OF_COMMENTS},
      sq AS (SELECT comment_id, 'H' AS code, 0.5::DOUBLE AS confidence, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t
      FROM comments), {SQL_DECIDED}, j AS (SELECT n.noise_level, n.noise_level = 'useful' AS u, d, t FROM noise n
      JOIN decided USING (comment_id)) SELECT noise_level, CASE WHEN u THEN d.code ELSE 'H' END AS code, CASE WHEN t = '' THEN 'EMPTY_TEXT'
      WHEN NOT u THEN 'ACCEPTED' WHEN d.rule LIKE 'none%' THEN CASE WHEN d.conf < 0.7 THEN 'REVIEW' ELSE 'ACCEPTED' END
      WHEN d.rule LIKE '%override%' THEN 'RULE_OVERRIDE' WHEN d.rule LIKE '%confirmed%' THEN 'RULE_CONFIRMED' ELSE 'RULE_APPLIED' END AS status,
      count(*) AS n FROM j GROUP BY 1, 2, 3""",
    "comment_signals": f"WITH {SQL_COMMENTS} SELECT comment_id, {', '.join(f'regexp_matches(text, {_quoted(p)}, {_quoted("i")}) AS {k}' for k, p in _SIGNALS.items())} FROM comments",
    "noise_levels": f"WITH {SQL_NOISE} SELECT comment_id, noise_level FROM noise",
    "priority_rules": f"""WITH {SQL_COMMENTS}, sq AS (SELECT comment_id, code, confidence::DOUBLE AS confidence, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t
      FROM comments), {SQL_DECIDED} SELECT comment_id, d.code AS final_code, round(d.conf::DOUBLE, 4) AS final_confidence, d.rule AS rule
      FROM decided""",
    "model_answers": """
WITH t(i, code, confidence) AS (VALUES (0, 'G', 0.9::DOUBLE), (1, 'B', 0.5), (2, 'A', 0.5), (3, 'G', 1.0), (4, 'G', 0.5), (5, 'H', 0.0), (6, 'C', 0.8), (7, 'H', 0.5))
SELECT o_orderkey AS id, code, confidence FROM orders JOIN t ON i = o_orderkey % 8""",
    "useful_comments_loss": f"""WITH {SQL_NOISE} SELECT issue_number, count(*) AS n_before, count(*) FILTER (noise_level = 'useful') AS n_after,
      count(*) FILTER (noise_level <> 'useful') AS n_lost, round_even(100.0 * count(*) FILTER (noise_level <> 'useful') /
      count(*), 2)::DOUBLE AS percent_lost FROM noise GROUP BY 1""",
    "issue_index": SQL_INDEX,
    "lexical_ranking": SQL_RANKING,
    "ontology_enrichment": f"""
WITH known AS ({SQL_ENRICHMENT}), ids AS (SELECT list_sort([{', '.join(map(_quoted, C.CAUSE_KEYWORDS))}]) AS l)
SELECT o_orderkey, known.* FROM orders, ids JOIN known ON known.cause_id = l[o_orderkey % {len(C.CAUSE_KEYWORDS)} + 1]""",
    "cosine_to_prototypes": """WITH p AS (SELECT label, arg_min(embedding, vec_id) AS p FROM embeddings GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], p::DOUBLE[]), 5) AS similarity
      FROM embeddings JOIN p USING (label)""",
    "similarity_bins": """WITH b AS (SELECT round((l_discount * 10)::DOUBLE, 4) AS x FROM lineitem), v AS (SELECT CASE WHEN x > -0.001 AND x <= 0.3 THEN 'Muy baja'
      WHEN x > 0.3 AND x <= 0.5 THEN 'Baja' WHEN x > 0.5 AND x <= 0.7 THEN 'Media' WHEN x > 0.7 AND x <= 1.0 THEN 'Alta' END AS value
      FROM b) SELECT value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percentage
      FROM v GROUP BY value""",
    "cause_crosstab": f"""WITH {SQL_NOISE} SELECT code, count(*) FILTER (noise_level = 'hard_noise') AS hard_noise, count(*) FILTER (noise_level = 'operational_noise') AS operational_noise,
      count(*) FILTER (noise_level = 'useful') AS useful FROM noise GROUP BY code""",
    "class_report": """WITH l AS (SELECT * FROM (VALUES (0), (1)) v(label)), n AS (SELECT label, count(*) FILTER (quality = label AND toxic = label) AS tp,
      count(*) FILTER (quality <> label AND toxic = label) AS fp, count(*) FILTER (quality = label AND toxic <> label) AS fn
      FROM l, labels GROUP BY label) SELECT label, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support
      FROM n""",
    "html_flags": f"""WITH h AS (SELECT page_id, {_STRIPPED} AS clean FROM (SELECT page_id, {_HTML} AS t FROM pages)) SELECT page_id, len(regexp_extract_all(clean, '/html_link_reference'))::INT AS n_links, md5(clean) AS clean_md5
      FROM h""",
    "lost_texts": f"WITH {SQL_COMMENTS} SELECT DISTINCT text FROM comments EXCEPT SELECT text FROM comments WHERE code = 'B'",
    "annotated_comments": f"""WITH {SQL_NOISE}, sq AS (SELECT comment_id, 'H' AS code, 0.5::DOUBLE AS confidence, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t
      FROM comments), {SQL_DECIDED} SELECT n.noise_level, CASE WHEN n.noise_level = 'useful' THEN d.code ELSE 'H' END AS cause,
      count(*) AS n FROM noise n JOIN decided USING (comment_id) GROUP BY 1, 2""",
    "duplicate_parts": "SELECT (count(*) - count(DISTINCT (l_partkey, l_suppkey)))::BIGINT AS duplicates FROM lineitem",
    "cleaned_comments": f"""WITH v(i, clean) AS (VALUES {', '.join(f'({i}, {_quoted(want)})' for i, (_, want) in enumerate(cases.CLEANED))})
      SELECT o_orderkey AS comment_id, clean FROM orders JOIN v ON i = o_orderkey % {len(cases.CLEANED)}""",
    "comment_emotions": f"""WITH v(i, n, tags) AS (VALUES {', '.join(f'({i}, {n}, {_quoted(tags)})' for i, (_, n, tags) in enumerate(cases.EMOTIONS))})
      SELECT o_orderkey AS comment_id, n, tags FROM orders JOIN v ON i = o_orderkey % {len(cases.EMOTIONS)}""",
    "bot_kinds": """SELECT CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN 'other_bot' WHEN 2 THEN 'triage_bot' WHEN 3 THEN 'retest_flaky_bot'
      ELSE 'onboarding_bot' END AS bot, count(*) AS n FROM conversations GROUP BY 1""",
    "issue_reports": SQL_REPORTS,
    "level_summary": SQL_LEVEL_SUMMARY,
}
