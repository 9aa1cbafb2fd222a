"""Audits of classified comments: codes and labels, gold labels, notes for reviewers, left-over noise, and the ranked causes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark import constants as C
from loomspark.functions.regex import squeeze
from loomspark.operators.causes import LOW_CONFIDENCE, UNKNOWN

# Words of left-over noise, and the notes for each code with the words that call for them.
RESIDUAL_KEYWORDS = (
    "html_details_block", "html_image_reference", "html_meta_comment", "automated_bot_message", "automated_cla_check", "approval_notification", "codecov", "label has been added", "label has been removed",
    "pull-request has been approved", "verify that this patch is reasonable to test", "i will not automatically test new commits in this pr", "cat image", "please rerun", "pipeline be triggered", "checks are going now", "test link:", "ci:",
    "ci is green", "passed in", "lgtm", "ptal", "rebased", "force-pushed", "amended the commit",
)
NOTES = (
    ("A", ("unclear", "confusing", "what do you mean", "more specifics", "clarify", "ambiguous"), "La predicción A puede estar justificada por ambigüedad o falta de claridad."),
    ("B", ("back and forth", "conflicting", "same page", "handoff", "remaining comments", "coordination"), "La predicción B puede estar justificada por desalineación de coordinación o flujo de trabajo."),
    ("C", ("compatibility", "third-party", "api", "migration", "async", "database", "sqlite", "oracle", "implementation"), "La predicción C puede estar justificada por complejidad técnica, compatibilidad o restricciones del sistema."),
    ("D", ("triage", "approval", "ticket", "needs tests", "patch", "merge", "rebase", "status"), "La predicción D puede estar justificada por restricción procedimental o de workflow."),
    ("E", ("unfair", "exhausting", "civil", "code of conduct", "frustrat"), "La predicción E puede estar justificada por tensión interpersonal o percepción de trato injusto."),
    ("F", ("docs", "documentation", "release notes", "versionchanged", "deprecation", "tutorial"), "La predicción F puede estar justificada por documentación o transferencia de conocimiento."),
    ("G", ("review", "validate", "confirm", "can you", "permission", "access", "ci", "help move"), "La predicción G puede estar justificada por dependencia de validación, acceso, herramientas o recursos."),
    ("H", (), "La predicción H indica que no se identificó causa sociotécnica clara. Revisar si el comentario solo confirma, agradece o informa."),
)
OTHER_NOTE = "Revisar manualmente."


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def label_to_code(value: Column) -> Column:
    """A code or a cause's name, in any case and spacing, as its code; null for anything else."""
    own = squeeze(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.upper(own).isin(*C.CAUSES), F.upper(own)).otherwise(_map({label.lower(): code for code, label in C.CAUSES.items()})[F.lower(own)])


def code_to_label(value: Column) -> Column:
    """A code or a cause's name as the cause's name; null for anything else."""
    return _map(C.CAUSES)[label_to_code(value)]


def is_unknown_cause(code: Column, label: Column) -> Column:
    """Whether a row has no cause: code H, or a label that says so."""
    said = F.lower(squeeze(F.coalesce(label.cast("string"), F.lit(""))))
    return (F.upper(squeeze(F.coalesce(code.cast("string"), F.lit("")))) == UNKNOWN) | said.startswith("no identifiable")


def consistency(df: DataFrame, code: str, label: str, model_code: str, status: str) -> DataFrame:
    """One row of counts: codes outside the catalog, labels that are codes, labels of another code, codes that rules changed, calls that failed."""
    own, said = F.col(code), squeeze(F.coalesce(F.col(label).cast("string"), F.lit("")))
    counts = {
        "rows": F.lit(True), "codes_outside": ~F.coalesce(own.isin(*C.CAUSES), F.lit(False)), "labels_are_codes": F.upper(said).isin(*C.CAUSES),
        "labels_differ": ~F.col(label).eqNullSafe(_map(C.CAUSES)[own]), "rule_changed": ~own.eqNullSafe(F.col(model_code)), "api_errors": F.coalesce(F.col(status) == "API_ERROR", F.lit(False)),
    }
    return df.agg(*(F.count_if(c).alias(k) for k, c in counts.items()))


def gold(df: DataFrame, truth: str, code: str, confidence: str) -> DataFrame:
    """Adds true_code, evaluable, match (null where it cannot be told), review and review_state: rows below the least confidence or against the gold label are reviewed."""
    number = F.coalesce(F.expr(f"try_cast(replace(cast(`{confidence}` as string), ',', '.') as double)"), F.lit(0.0))
    out = df.withColumn("true_code", label_to_code(F.col(truth)))
    out = out.withColumn("evaluable", F.col("true_code").isNotNull()).withColumn("match", F.when(F.col("evaluable"), F.col("true_code").eqNullSafe(F.col(code))))
    review = (number < LOW_CONFIDENCE) | F.coalesce(~F.col("match"), F.lit(False))
    return out.withColumn("review", review).withColumn("review_state", F.when(F.col("review"), "REVIEW").otherwise("ACCEPTED"))


def gold_scores(evaluated: DataFrame) -> DataFrame:
    """One row: rows, evaluable ones, errors, doubtful ones, accuracy (null without evaluable rows)."""
    match = F.col("match").cast("int")
    return evaluated.agg(F.count(F.lit(1)).alias("rows"), F.count_if("evaluable").alias("evaluable"), F.coalesce(F.sum(1 - match), F.lit(0)).alias("errors"), F.count_if("review").alias("to_review"), F.avg(match).alias("accuracy"))


def review_note(text: Column, code: Column) -> Column:
    """What may speak for a prediction that the gold label denies."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for own, words, note in NOTES:
        has = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words), F.lit(not words))
        out = (F.when if out is None else out.when)((code == own) & has, note)
    return out.otherwise(OTHER_NOTE)


def residual(df: DataFrame, text: str, level: str) -> DataFrame:
    """Rows that count as useful though they have words of left-over noise."""
    return df.where((F.col(level) == "useful") & F.coalesce(F.col(text).rlike("(?iUd)" + "|".join(RESIDUAL_KEYWORDS)), F.lit(False)))


def ranked_problems(df: DataFrame, top: str, primary: str, most: int = 3) -> DataFrame:
    """One row of counts over rows with a ranked list of (cause_id, score): lists that are empty or too long, a first cause other than the primary one,
    causes that repeat, scores outside 0 to 1, scores that rise."""
    scores = F.transform(top, lambda x: x["score"])
    ids = F.transform(top, lambda x: x["cause_id"])
    rises = F.exists(F.sequence(F.lit(1), F.greatest(F.size(top) - 1, F.lit(1))), lambda i: F.coalesce(F.get(scores, i) > F.get(scores, i - 1), F.lit(False)))
    counts = {
        "rows": F.lit(True), "without_list": F.col(top).isNull() | (F.size(top) <= 0), "too_long": F.size(top) > most, "other_primary": ~F.get(ids, F.lit(0)).eqNullSafe(F.col(primary)),
        "repeated": F.size(F.array_distinct(ids)) < F.size(ids), "out_of_range": F.exists(scores, lambda s: s.isNull() | (s < 0) | (s > 1)), "rising": rises,
    }
    return df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()))
