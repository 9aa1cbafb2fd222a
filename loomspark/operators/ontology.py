"""The ontology as a table of triples, and what it tells of a cause in one and two steps."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from xml.etree.ElementTree import Element, iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import constants as C
from loomspark.functions.text import local_name, normalize_name

BASE = "http://www.example.org/causes#"
# Predicates by what they tell.
ROLES = {
    "preventive_strategies": ("hasAdministrativePreventiveStrategy", "hasCommunicationStrategy", "hasCoordinationStrategy", "hasCollaborationStrategy", "hasCongruenceStrategy"),
    "effects": ("generatesEffect",),
    "indicators": ("isIndicatedByCause", "isMonitoredByIndicator"),
    "metrics": ("isMeasuredByMetric",),
    "risks": ("leadsToRisk", "generatesRisk"),
    "community_smells": ("hasRelatedCommunitySmell", "hasCauseCommunitySmell"),
}
CORRECTIVE = ("hasCorrectiveStrategy", "hasAdministrativeStrategy", "hasGroupStrategy", "hasIndividualStrategy", "hasProjectManagementStrategy", "hasTechnicalStrategy")
CAUSE_TYPES = ("AdministrativeCause", "CommunicationCause", "CoordinationCause", "CollaborationCause", "CongruenceCause")
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
LISTS = ("preventive_strategies", "effects", "corrective_strategies", "indicators", "metrics", "risks", "community_smells")


def sample_triples() -> list[tuple[str, str, str]]:
    """An invented ontology over the 39 causes: one has no enrichment, one repeats an object, one object has no `#`."""
    out = []
    for i, cause in enumerate(sorted(C.CAUSE_KEYWORDS)):
        if i == 7:
            continue
        s = BASE + cause
        out += [(s, BASE + ROLES["preventive_strategies"][i % 5], f"{BASE}PS-{i % 11:03d}"), (s, BASE + "generatesEffect", f"{BASE}EF-{i % 6:03d}"), (s, BASE + ROLES["risks"][i % 2], f"{BASE}RI-{i % 9:03d}"), (s, BASE + ROLES["community_smells"][i % 2], f"{BASE}CS-{i % 4:03d}")]
        if i % 3 == 0:
            out += [(s, BASE + "isMonitoredByIndicator", f"{BASE}IN-{i:03d}"), (s, BASE + "isMeasuredByMetric", f"http://www.example.org/metrics/ME-{i % 5:03d}")]
        if i % 10 == 0:
            out += [(s, BASE + "leadsToRisk", f"{BASE}RI-000"), (s, BASE + "generatesRisk", f"{BASE}RI-000")]
    return out + [(f"{BASE}EF-{e:03d}", BASE + CORRECTIVE[e], f"{BASE}ST-{k:03d}") for e in range(6) for k in (e, (e * 3) % 7)]


def triples(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else sample_triples(), "subject string, predicate string, object string")


def enrichment(graph: DataFrame) -> DataFrame:
    """cause_id and a sorted list of distinct names for each role; a subject without any has no row."""
    facts = graph.select("subject", local_name(F.col("predicate")).alias("p"), "object")
    role = F.create_map(*[F.lit(x) for r, ps in ROLES.items() for p in ps for x in (p, r)])
    one = facts.select("subject", role[F.col("p")].alias("role"), local_name(F.col("object")).alias("name")).where("role is not null")
    effect = facts.where("p = 'generatesEffect'").select("subject", F.col("object").alias("effect"))
    cure = facts.where(F.col("p").isin(*CORRECTIVE)).select(F.col("subject").alias("effect"), local_name(F.col("object")).alias("name"))
    two = effect.join(cure, "effect").select("subject", F.lit("corrective_strategies").alias("role"), "name")
    lists = [F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("name")))).alias(r) for r in LISTS]
    return one.unionByName(two).groupBy("subject").agg(*lists).withColumn("cause_id", local_name(F.col("subject"))).select("cause_id", *LISTS)


def enrich(rows: DataFrame, ids: str, known: DataFrame, key: str) -> DataFrame:
    """Union of the lists of all causes in an array column, for each key."""
    each = rows.select(key, F.explode_outer(ids).alias("cause_id")).join(known, "cause_id", "left")
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(r, F.array().cast("array<string>")))))).alias(r) for r in LISTS]
    return each.groupBy(key).agg(*merged)


def described(root: Element) -> Iterator[tuple[str, str, str]]:
    """Triples of one described resource and of those within its properties. Literals lose their type and language; a resource without any name is a blank
    node of its own, by its place."""
    name = lambda tag: tag[1:].replace("}", "")
    own = lambda node, kind: node.get(f"{{{RDF}}}{kind}")
    waiting = [(root, own(root, "about") or own(root, "ID") or "_:" + (own(root, "nodeID") or uuid.uuid4().hex))]
    while waiting:
        node, subject = waiting.pop()
        if name(node.tag) != RDF + "Description":
            yield subject, RDF + "type", name(node.tag)
        for key, value in node.attrib.items():  # properties as attributes
            if key.startswith("{") and not key.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/")):
                yield subject, name(key), value
        for p in node:
            inner = list(p)
            if own(p, "resource") is not None:
                yield subject, name(p.tag), own(p, "resource")
            elif own(p, "nodeID") is not None:
                yield subject, name(p.tag), "_:" + own(p, "nodeID")
            elif own(p, "parseType") == "Resource":
                blank = "_:" + uuid.uuid4().hex
                yield subject, name(p.tag), blank
                part = Element(f"{{{RDF}}}Description")
                part.extend(inner)
                waiting.append((part, blank))
            elif inner and own(p, "parseType") != "Literal":
                for x in inner:
                    at = own(x, "about") or own(x, "ID") or "_:" + (own(x, "nodeID") or uuid.uuid4().hex)
                    yield subject, name(p.tag), at
                    waiting.append((x, at))
            else:
                yield subject, name(p.tag), "".join(p.itertext()).strip()


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML files (a file, a folder or a pattern) in any file system that Spark reads; a task parses a file, resource by resource."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for batch in batches for c in batch.column(0)):
            rows: list[tuple[str, str, str]] = []
            depth, root = 0, None
            for event, node in iterparse(io.BytesIO(content.as_py()), ("start", "end")):
                root = node if root is None else root
                depth += 1 if event == "start" else -1
                if event == "end" and depth == 1:
                    rows += described(node)
                    root.clear()
                if rows and (len(rows) >= 5000 or depth == 0):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["subject", "predicate", "object"])
                    rows = []

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "subject string, predicate string, object string")


def causes(graph: DataFrame) -> DataFrame:
    """A row for each subject of a cause's type: ids, name, description (the least object if there are several) and their normal forms."""
    facts = graph.select("subject", local_name(F.col("predicate")).alias("p"), "object")
    kind = F.max(F.when((F.col("p") == "type") & local_name(F.col("object")).isin(*CAUSE_TYPES), local_name(F.col("object")))).alias("cause_type")
    least = lambda p: F.min(F.when(F.col("p") == p, F.col("object")))
    found = facts.groupBy("subject").agg(kind, least("hasCauseID").alias("id"), least("hasCauseName").alias("name"), least("hasCauseDescription").alias("text")).where("cause_type is not null")
    own = local_name(F.col("subject"))
    out = found.select(F.col("subject").alias("ontology_uri"), own.alias("ontology_id"), F.coalesce("id", own).alias("cause_id"), F.coalesce("name", F.replace(own, F.lit("_"), F.lit(" "))).alias("cause_name"), F.coalesce("text", F.lit("")).alias("cause_description"), "cause_type")
    return out.select("*", normalize_name(F.col("cause_name")).alias("cause_name_clean"), normalize_name(F.col("cause_description")).alias("cause_description_clean"))


def classes(graph: DataFrame) -> DataFrame:
    """Sorted distinct local names of the classes."""
    return graph.where(F.col("predicate").endswith("#type") & F.col("object").endswith("#Class")).select(local_name(F.col("subject")).alias("name")).distinct().orderBy("name")
