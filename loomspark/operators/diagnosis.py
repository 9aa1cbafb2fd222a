"""Diagnosis of issues: leading causes and strategies side by side, summaries of levels, and reports in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.index import most_common

KINDS = {"macrocause": "dominant_macrocauses", "microcause": "dominant_microcauses", "community_smell": "dominant_community_smells", "risk": "dominant_risks"}
STRATEGIES = {"preventive_strategy": "preventive_strategies", "corrective_strategy": "corrective_strategies"}
LEVELS = ("Low Social Debt", "Medium Social Debt", "High Social Debt")
TOP = 3
# The words of the two reports.
LEVEL_WORDS = {"High Social Debt": "alta deuda social", "Medium Social Debt": "deuda social media", "Low Social Debt": "baja deuda social"}
NOT_FOUND = "No se encontró el issue {issue} en el diagnóstico final."
REPORT = (
    "El issue {issue} presenta un nivel de {level_words}, con un Social Debt Index de {index} y {count} comentarios analizados.",
    "El diagnóstico adaptativo indica que las principales macrocausas asociadas al issue son: {macrocause}. Estas macrocausas sugieren que la deuda social del issue se relaciona con una combinación de factores técnicos, comunicativos y organizacionales.",
    "A nivel de microcausas, las señales más relevantes son: {microcause}. Esto permite identificar con mayor precisión los factores específicos que explican la acumulación de deuda social en el issue.",
    "Los community smells dominantes son: {community_smell}. Estos patrones indican posibles desconexiones entre actores, tareas, decisiones y dependencias técnicas dentro de la comunidad de desarrollo.",
    "Los principales riesgos asociados son: {risk}. Por tanto, el issue puede derivar en problemas de documentación, mantenimiento, compatibilidad, retrabajo o pérdida de coordinación, según las evidencias observadas.",
    "Como estrategias preventivas, el modelo recomienda priorizar: {preventive_strategy}. Estas estrategias buscan reducir la probabilidad de que las causas identificadas se repitan o se intensifiquen.",
    "Como estrategias correctivas, el modelo recomienda considerar: {corrective_strategy}. Estas acciones están orientadas a mitigar los efectos ya presentes y apoyar la recuperación del issue.",
    "En síntesis, el issue {issue} evidencia una acumulación de señales sociotécnicas que justifican una intervención adaptativa. El diagnóstico integra causas, community smells, riesgos y estrategias, permitiendo pasar de una clasificación de deuda social a una recomendación accionable.",
)
INTERPRETATION = (
    "El issue {issue} presenta un nivel de {level} con un Social Debt Index de {index} y {count} comentarios analizados.",
    "El diagnóstico indica que las principales macrocausas asociadas al issue son:{macrocause}.",
    "A nivel de microcausas, las señales más fuertes son:{microcause}.",
    "Los community smells dominantes son:{community_smell}.",
    "Los principales riesgos asociados son:{risk}.",
    "Como estrategias preventivas, el modelo recomienda priorizar:{preventive_strategy}.",
    "Como estrategias correctivas, el modelo recomienda considerar:{corrective_strategy}.",
    "En síntesis, este issue refleja una acumulación de deuda social asociada con problemas sociotécnicos recurrentes, donde las causas, smells, riesgos y estrategias sugieren la necesidad de intervención adaptativa tanto preventiva como correctiva.",
)


def side_by_side(df: DataFrame, column: str, name: str, n: int = TOP) -> DataFrame:
    """<name>_1 .. <name>_n and <name>_<i>_value from an array of structs (name, value); null where the array ends."""
    at = lambda i, f: F.get(F.col(column), F.lit(i))[f]
    return df.select("*", *(c for i in range(n) for c in (at(i, "name").alias(f"{name}_{i + 1}"), at(i, "value").alias(f"{name}_{i + 1}_value"))))


def top_strategies(rows: DataFrame, n: int = TOP) -> DataFrame:
    """rows: issue_number, row_ord and the two lists. Each issue's most frequent strategies, first seen first on ties."""
    out = rows.select("issue_number").distinct()
    for column in STRATEGIES.values():
        each = rows.select("issue_number", "row_ord", F.posexplode(column).alias("i", "name")).select("issue_number", "name", F.lit(1).alias("v"), F.struct("row_ord", "i").alias("p"))
        out = out.join(most_common(each, ["issue_number"], "name", "v", "p", n, column), "issue_number", "left")
    return out


def diagnosis(indexed: DataFrame, strategies: DataFrame) -> DataFrame:
    """One row an issue: level, index, count, and the three leading names of each kind; issues without strategies stay."""
    out = indexed.join(strategies, "issue_number", "left")
    for name, column in (KINDS | STRATEGIES).items():
        out = side_by_side(out, column, name)
    names = [f"{k}_{i}{end}" for k in KINDS | STRATEGIES for i in range(1, TOP + 1) for end in ("", "_value")]
    return out.select("issue_number", "social_debt_index", "social_debt_level", "comment_count", *names)


def _filled(template: str, parts: dict[str, Column]) -> Column:
    pieces, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        key, rest = rest.split("}", 1)
        pieces += [F.lit(before), parts[key]]
    return F.concat(*pieces, F.lit(rest))


def _parts(listed: bool) -> dict[str, Column]:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    words = F.create_map(*[F.lit(x) for pair in LEVEL_WORDS.items() for x in pair])
    parts = {"issue": said("issue_number"), "level": said("social_debt_level"), "level_words": F.coalesce(words[F.col("social_debt_level")], said("social_debt_level")), "index": F.round("social_debt_index", 3).cast("string"), "count": F.col("comment_count").cast("long").cast("string")}
    for kind in KINDS | STRATEGIES:
        a, b, c = (said(f"{kind}_{i}") for i in (1, 2, 3))
        parts[kind] = F.concat(F.lit("\n1) "), a, F.lit(",\n2) "), b, F.lit(", y\n3) "), c) if listed else F.concat(a, F.lit(", "), b, F.lit(" y "), c)
    return parts


def report(listed: bool = False) -> Column:
    """A diagnosis in words; listed gives the second form."""
    parts = _parts(listed)
    return F.concat_ws("\n\n", *(_filled(t, parts) for t in (INTERPRETATION if listed else REPORT)))


def report_of(found: DataFrame, issue_numbers: DataFrame, listed: bool = False) -> DataFrame:
    """issue_number, report for each number asked for; unknown ones get a sentence that says so."""
    told = found.select("issue_number", report(listed).alias("report"))
    missing = _filled(NOT_FOUND, {"issue": F.col("issue_number").cast("string")})
    return issue_numbers.select("issue_number").join(told, "issue_number", "left").select("issue_number", F.coalesce("report", missing).alias("report"))


def by_level(indexed: DataFrame, column: str, n: int) -> DataFrame:
    """social_debt_level, name, value, rank: sums over the issues' leading names; ties by the first issue and place."""
    each = indexed.select("social_debt_level", "issue_number", F.posexplode(column).alias("i", "item")).select("social_debt_level", F.col("item.name").alias("name"), F.col("item.value").alias("v"), F.struct("issue_number", "i").alias("p"))
    sums = each.groupBy("social_debt_level", "name").agg(F.sum("v").alias("value"), F.min("p").alias("p"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("social_debt_level").orderBy(F.desc("value"), "p"))).where(F.col("rank") <= n).drop("p")


def level_summary(indexed: DataFrame) -> DataFrame:
    """A row a level: issues, seven means (3 places) and the leading names as text."""
    leads = ("top_macro_frequency", "top_micro_score", "top_smell_frequency", "top_risk_frequency")
    means = {"mean_sdi": "social_debt_index", "mean_comments": "comment_count", "mean_macro_diversity": "macro_diversity"} | {f"mean_{c}": c for c in leads}
    out = indexed.groupBy("social_debt_level").agg(F.count(F.lit(1)).alias("issue_count"), *(F.round(F.avg(c), 3).alias(k) for k, c in means.items()))
    for name, column in KINDS.items():
        value = F.round("value", 3) if name == "microcause" else F.col("value").cast("long")
        text = F.struct("rank", F.concat("name", F.lit(" ("), value.cast("string"), F.lit(")")).alias("t"))
        top = by_level(indexed, column, TOP).groupBy("social_debt_level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["t"]), "; ").alias(f"top_{column.removeprefix('dominant_')}"))
        out = out.join(top, "social_debt_level", "left")
    return out
