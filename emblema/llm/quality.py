"""Quality classifier: a sparse rule ensemble over statistics of a text.

Trees grown on labelled documents give conjunctive rules, one for each path from a root. A lasso logistic regression
over the rules keeps few of them, and these become one Spark expression over the statistics.

Defined cases: a null or empty text has statistics of 0 and a score like any other; a null id is scored and belongs to
no held-out fold; repeated rows are scored alike; labels that are null are left aside; without labels of both kinds the
score is the share of label 1, or 0.5 without any; an empty table gives an empty result; further columns are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emblema.session import settled

from .common import fold, only

STATISTICS = (
    "n_words", "word_bytes", "unique_words", "repeated_words", "upper", "digits", "marks", "markless_words",
    "lines", "line_bytes", "repeated_lines", "other_bytes",
)
#: The bound on labelled rows that the classifier is fitted on; chosen by a hash of the id.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5


def text_statistics(text: str) -> tuple[float, ...]:
    words, lines = text.split(), [line for line in text.split("\n") if line]
    n, size = len(words), len(raw := text.encode())
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5) / max(1, size)
    same = sum(map(str.__eq__, words, words[1:]))
    return (
        float(n), size / max(1, n), len(set(words)) / max(1, n), same / max(1, n), kinds[1], kinds[2], kinds[3], sum(map(_LONE.__contains__, words)) / max(1, n),
        float(len(lines)), size / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), kinds[4],
    )


#: Kind of each byte: 1 upper case, 2 digit, 3 mark, 4 beyond ASCII, 0 any other.
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b > 127 else 3 if 32 < b < 127 and not chr(b).isalpha() else 0 for b in range(256)])
_LONE = set("|-*#.,;:/\\_+=~&%$!?<>")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), *((name, pa.float64()) for name in STATISTICS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(text.as_py() or "") for text in batch.column(1)]
            table = np.array(rows, float).reshape(len(rows), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(table[:, j]) for j in range(len(STATISTICS)))], schema=schema)

    return only(docs, "doc_id", "text").mapInArrow(measure, "doc_id bigint, " + ", ".join(f"{name} double" for name in STATISTICS))


def tree_rules(description: str) -> set[tuple[tuple[int, str, float], ...]]:
    """The paths of trees as printed by Spark: for each, conditions (statistic, <= or >, value) from the root on."""
    rules, path = set(), []
    for line in description.splitlines():
        if found := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(found[1])
            path = [step for step in path if step[0] < depth] + [(depth, (int(found[2]), found[3], float(found[4])))]
            rules.add(tuple(step for _, step in path))
    return rules


def shortest(rule: tuple[tuple[int, str, float], ...]) -> tuple[tuple[int, str, float], ...]:
    """One condition for each statistic and side, the tightest."""
    tight: dict[tuple[int, str], float] = {}
    for statistic, side, value in rule:
        known = tight.get((statistic, side), value)
        tight[statistic, side] = min(known, value) if side == "<=" else max(known, value)
    return tuple(sorted((statistic, side, value) for (statistic, side), value in tight.items()))


def condition(rule: tuple[tuple[int, str, float], ...]) -> Column:
    terms = [F.col(STATISTICS[s]) <= v if side == "<=" else F.col(STATISTICS[s]) > v for s, side, v in rule]
    all_of = terms[0]
    for term in terms[1:]:
        all_of = all_of & term
    return all_of


class RuleEnsemble:
    """Rules with weights; ``score`` is a Spark expression over the statistics."""

    def __init__(self, bias: float, rules: list[tuple[tuple, float]]):
        self.bias, self.rules = bias, rules

    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, trees: int = 30, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """``labelled``: the statistics and ``label``, a bounded number of rows."""
    counts = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (total + 1) if total else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="statistics").transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(featuresCol="statistics", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted({shortest(rule) for rule in tree_rules(forest.toDebugString)})
    names = [f"rule_{k}" for k in range(len(rules))]
    held = labelled.select(F.col("label").cast("double"), *[condition(rule).cast("double").alias(name) for rule, name in zip(rules, names, strict=True)])
    matrix = VectorAssembler(inputCols=names, outputCol="rules").transform(held).select("label", "rules")
    model = LogisticRegression(featuresCol="rules", regParam=penalty, elasticNetParam=1.0, maxIter=100, standardization=False).fit(matrix)
    return RuleEnsemble(model.intercept, [(rule, w) for rule, w in zip(rules, model.coefficients, strict=True) if w])


def train(statistics: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> RuleEnsemble:
    """Fitted on at most ``rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).select("doc_id", F.col("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "label").limit(rows)
    return fit(settled(chosen.join(statistics, "doc_id"), "quality-training").repartition(4))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The query: a score for every document."""
    statistics = settled(with_statistics(docs), "statistics")
    model = train(statistics, labels)
    return statistics.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns. The model is fitted on ``docs`` that have labels;
    statistics are then computed beside the text, so no text is shuffled."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_labelled")).distinct()
    # texts of labelled rows only are measured for training
    chosen = known.where(fold(F.col("_labelled"), FOLDS) != 0).orderBy(F.xxhash64("_labelled")).limit(TRAINING_ROWS)
    training = only(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"), "left_semi")
    model = train(settled(with_statistics(training), "statistics"), labels)
    return filtered(docs, model, threshold)


def filtered(docs: DataFrame, model: RuleEnsemble, threshold: float) -> DataFrame:
    names = docs.columns
    at = names.index("text")
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(text.as_py() or "") for text in batch.column(at)]
            table = np.array(rows, float).reshape(len(rows), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(table[:, j]) for j in range(len(STATISTICS)))], [*batch.schema.names, *STATISTICS])

    full = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema.fields), *(f"{s} double" for s in STATISTICS)])
    scored = wide.mapInArrow(measure, full).where(model.score() >= threshold)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
