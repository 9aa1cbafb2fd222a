"""Causes A to H: answers of a model, and the rules that override them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark import constants as C
from loomspark.functions.regex import has_any, may_match, squeeze

UNKNOWN, LOW_CONFIDENCE = "H", 0.70
# Order, confidence and names of the rules.
RULES = (
    ("A", 0.90, "A_communication_evidence", C.COMMUNICATION_EVIDENCE_PATTERNS),
    ("F", 0.88, "F_documentation_evidence", C.DOCUMENTATION_EVIDENCE_PATTERNS),
    ("G", 0.88, "G_validation_tooling_evidence", C.VALIDATION_EVIDENCE_PATTERNS),
    ("E", 0.88, "E_interpersonal_tension_evidence", C.INTERPERSONAL_EVIDENCE_PATTERNS),
    ("D", 0.85, "D_procedural_workflow_evidence", C.PROCEDURAL_EVIDENCE_PATTERNS),
    ("B", 0.85, "B_coordination_workflow_evidence", C.COORDINATION_EVIDENCE_PATTERNS),
    ("C", 0.82, "C_technical_evidence", C.TECHNICAL_EVIDENCE_PATTERNS),
)


def _rule(code: str, confidence: float, name: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(confidence).alias("confidence"), F.lit(name).alias("rule"))


SIGNS = {name: p for _, _, name, p in RULES} | {"bot": C.BOT_TEMPLATE_PATTERNS, "minimal": C.MINIMAL_H_PATTERNS, "social": C.SOCIAL_OR_MINIMAL_CONTEXT_PATTERNS, "technical_problem": C.TECHNICAL_PROBLEM_PATTERNS, "validation_problem": C.VALIDATION_PROBLEM_PATTERNS}


def rule_candidate(sign: dict[str, Column]) -> Column:
    """Struct code, confidence, rule from the signs found; null without a rule."""
    evidence = reduce(lambda a, b: a | b, (sign[name] for _, _, name, _ in RULES))
    out = F.when(sign["bot"] & ~evidence, _rule("H", 0.95, "H_bot_template_without_evidence")).when(sign["minimal"] & ~evidence, _rule("H", 0.95, "H_minimal_without_evidence"))
    for code, confidence, name, _ in RULES:
        out = out.when(sign[name], _rule(code, confidence, name))
    return out


def override_allowed(sign: dict[str, Column], code: Column) -> Column:
    """Whether a rule's evidence is strong enough against an answer of H."""
    ok = F.when(code == "C", sign["C_technical_evidence"] & sign["technical_problem"]).when(code == "G", sign["G_validation_tooling_evidence"] & sign["validation_problem"])
    return ok.when(code == "F", sign["F_documentation_evidence"]).otherwise(~sign["social"])


def with_rules(df: DataFrame, text: str, code: Column, confidence: Column, out: str) -> DataFrame:
    """Adds a struct code, confidence, rule: the model's answer after the rules.

    A linear pass tells which pattern lists a text can match at all; only those are searched, each once, in a projection of its own, which keeps the
    generated code small."""
    own = df.columns
    seen = df.select(*own, F.when(code.isin(*C.CAUSES), code).otherwise(UNKNOWN).alias("__code"), F.coalesce(confidence.cast("double"), F.lit(0.0)).alias("__conf"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__raw"))
    seen = seen.withColumn("__may", may_match(F.col("__raw"), SIGNS))
    some = reduce(lambda a, b: a | b, (F.col("__may")[k] for k in SIGNS))
    seen = seen.select(*own, "__code", "__conf", "__may", F.when(some, squeeze(F.col("__raw"))).otherwise("").alias("__t"))
    seen = seen.select(*own, "__code", "__conf", *(F.when(F.col("__may")[k], has_any(F.col("__t"), p)).otherwise(False).alias(f"__{k}") for k, p in SIGNS.items()))
    sign = {k: F.col(f"__{k}") for k in SIGNS}
    ruled = seen.withColumn("__rule", rule_candidate(sign))
    code, confidence, rule = F.col("__code"), F.col("__conf"), F.col("__rule")
    most = F.greatest(confidence, rule["confidence"])
    result = lambda c, k, n: F.struct(c.alias("code"), k.alias("confidence"), n.alias("rule"))
    named = lambda end: F.concat(rule["rule"], F.lit(end))
    decided = (
        F.when(rule.isNull(), result(code, confidence, F.lit("none")))
        .when(rule["code"] == "H", result(F.lit("H"), most, rule["rule"]))
        .when((code == "H") & override_allowed(sign, rule["code"]), result(rule["code"], most, named("_override_H")))
        .when(code == "H", result(code, confidence, F.lit("override_rejected_keep_H")))
        .when((confidence < LOW_CONFIDENCE) & (rule["code"] != code), result(rule["code"], most, named("_low_conf_override")))
        .when(rule["code"] == code, result(code, most, named("_confirmed")))
        .otherwise(result(code, confidence, F.lit("none_llm_kept")))
    )
    return ruled.select(*own, decided.alias(out))


def answer_code(raw: Column) -> Column:
    """The letter before `|`, else the alphabetically first letter that stands alone, else H."""
    t = squeeze(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[\"']", ""))
    first = squeeze(F.split(t, r"\|")[0])
    out = F.when(first.isin(*C.CAUSES), first)
    for code in C.CAUSES:
        out = out.when(t.rlike(rf"(?<![A-Z]){code}(?![A-Z])"), code)
    return out.otherwise("H")


def answer_confidence(raw: Column, default: float = 0.5) -> Column:
    """The last number from 0 to 1; 0 without an answer."""
    found = F.regexp_extract_all(F.replace(F.coalesce(raw, F.lit("")), F.lit(","), F.lit(".")), F.lit(r"(?<!\d)(?:0(?:\.\d+)?|1(?:\.0+)?)(?!\d)"), F.lit(0))
    return F.when(raw.isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(found, F.lit(-1)).cast("double"), F.lit(default)))


def status(text: Column, confidence: Column, rule: Column) -> Column:
    """How an answer came about; a kept H that a rule spoke against counts as an override."""
    kept = F.when(confidence < LOW_CONFIDENCE, "REVIEW").otherwise("ACCEPTED")
    out = F.when(F.length(squeeze(F.coalesce(text, F.lit("")))) == 0, "EMPTY_TEXT").when(rule.startswith("none"), kept)
    return out.when(rule.contains("override"), "RULE_OVERRIDE").when(rule.contains("confirmed"), "RULE_CONFIRMED").otherwise("RULE_APPLIED")
