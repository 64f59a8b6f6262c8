"""Toxicity: a counterfactual-regularised classifier.

A sparse logistic regression over the words of a text. In labelled sentences, identity terms are swapped for others of
their group, and the change of score is penalised, so that a neutral mention of a group doesn't raise the score.

Defined cases: a null or empty text gets the score of no words; a null id is scored and belongs to no held-out fold;
repeated rows are scored alike; null labels are left aside; without labels of both kinds the score is the share of
label 1, or 0.5 without any; an empty table gives an empty result; further columns are left aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emblema.session import settled

from .common import fold, only

#: The bound on labelled rows that the classifier is fitted on; chosen by a hash of the id, toxic and other rows alike.
TRAINING_ROWS = 6_000
#: Training documents that a word must occur in.
LEAST_DOCUMENTS = 5
#: Features that may enter the regression.
FEATURES = 400
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Groups of terms that may stand for one another; a parameter.
IDENTITY_TERMS = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "latino", "indigenous"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("immigrants", "refugees", "foreigners", "citizens", "people"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
BEGINNINGS = (4, 5, 6)
_IDENTITY = {term for group in IDENTITY_TERMS for term in group}
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"[^.!?\n]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def swaps(text: str, groups: tuple = IDENTITY_TERMS) -> Counter:
    """For each sentence with an identity term: (term, other term of its group, times it stands there), counted."""
    member = {term: group for group in groups for term in group}
    found: Counter = Counter()
    for sentence in _SENTENCES.findall(text.lower()):
        for term, times in Counter(w for w in _WORDS.findall(sentence) if w in member).items():
            for other in member[term]:
                if other != term:
                    found[term, other, times] += 1
    return found


def features_of(word: str) -> list[str]:
    """The word and its beginnings, as an insult is inflected and compounded; an identity term is itself alone, so that a swap
    exchanges one feature for another."""
    return [word] if word in _IDENTITY else [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]


def bag_of(text: str) -> Counter:
    bag: Counter = Counter()
    for word, times in Counter(words_of(text)).items():
        for feature in features_of(word):
            bag[feature] += times
    return bag


class WordModel:
    """Features with weights; a document's score is the logistic of the bias and the weights times log(1 + count)."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.known = bias, weights, {}

    def score(self, text: str) -> float:
        counts: Counter = Counter()
        if len(self.known) > 300_000:
            self.known = {}
        for word in words_of(text):
            found = self.known.get(word)
            if found is None:
                found = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
            for feature in found:
                counts[feature] += 1
        total = self.bias + sum(self.weights[w] * np.log1p(c) for w, c in counts.items())
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit(bags: list[dict[str, int]], labels: np.ndarray, pairs: Counter, fairness: float = 1.0) -> WordModel:
    """The features whose documents differ most between the labels enter; a penalty on absolute weights chooses among
    them, and the weights of the chosen are then fitted with hardly any, so that scores can be read as chances."""
    unique = {(frozenset(bag.items()), y): n for n, (bag, y) in enumerate(zip(bags, labels, strict=True))}
    chosen = sorted(unique.values())  # a copied text counts once
    bags, labels = [bags[n] for n in chosen], labels[chosen]
    terms = {t for a, b, _ in pairs for t in (a, b)}
    words = set(telling(bags, labels)) | terms
    bags = [{w: c for w, c in bag.items() if w in words} for bag in bags]
    words = set(descend(bags, labels, pairs, fairness, sparsity=0.002, ridge=0.0).weights) | terms
    return descend([{w: c for w, c in bag.items() if w in words} for bag in bags], labels, pairs, fairness, sparsity=0.0, ridge=0.0002)


def telling(bags: list[dict[str, int]], labels: np.ndarray, features: int = FEATURES) -> list[str]:
    """The features with the largest likelihood ratio statistic between the documents of either label."""
    toxic, other = Counter(), Counter()
    for bag, y in zip(bags, labels, strict=True):
        (toxic if y else other).update(bag.keys())
    n1, n0 = max(1.0, float(labels.sum())), max(1.0, float(len(labels) - labels.sum()))

    def gain(a: float, b: float) -> float:
        p, q, r = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 0.5) / (n1 + n0 + 1)
        return sum(k * np.log(x / r) + (n - k) * np.log((1 - x) / (1 - r)) for k, n, x in ((a, n1, p), (b, n0, q)))

    ranked = sorted(((-gain(toxic[w], other[w]), w) for w in toxic.keys() | other.keys() if toxic[w] + other[w] >= LEAST_DOCUMENTS))
    return [w for _, w in ranked[:features]]


def descend(bags: list[dict[str, int]], labels: np.ndarray, pairs: Counter, fairness: float, sparsity: float, ridge: float, rounds: int = 800) -> WordModel:
    """Proximal gradient descent on logistic loss + ``sparsity`` * |weights| + ``ridge`` * weights squared + ``fairness`` * mean
    squared change of score under swaps."""
    total, positive = len(labels), float(np.sum(labels))
    if not 0 < positive < total:
        share = (positive + 0.5) / (total + 1) if total else 0.5
        return WordModel(float(np.log(share / (1 - share))), {})
    documents: Counter = Counter()
    for bag in bags:
        documents.update(bag.keys())
    named = {t for a, b, _ in pairs for t in (a, b)}
    vocabulary = {w: j for j, w in enumerate(sorted({w for w, n in documents.items() if n >= LEAST_DOCUMENTS} | named))}
    kept = [[(vocabulary[w], c) for w, c in bag.items() if w in vocabulary] for bag in bags]
    row = np.repeat(np.arange(total), [len(k) for k in kept])
    column = np.array([j for k in kept for j, _ in k], np.int64)
    value = np.log1p(np.array([c for k in kept for _, c in k], float))
    # each word's values at a mean square of 1, so that rare and frequent words move alike
    spread = np.sqrt(np.bincount(column, value**2, minlength=len(vocabulary)) / total) if len(column) else np.ones(len(vocabulary))
    spread[spread == 0] = 1.0
    value = value / spread[column]
    swapped = [(vocabulary[a], vocabulary.get(b), np.log1p(t), n) for (a, b, t), n in pairs.items() if a in vocabulary]
    first = np.array([s[0] for s in swapped], np.int64)
    second = np.array([s[1] for s in swapped], np.int64)
    times, weight = np.array([s[2] for s in swapped]), np.array([float(s[3]) for s in swapped])
    weight = weight / weight.sum() if len(weight) else weight
    w, bias, size = np.zeros(len(vocabulary)), float(np.log(positive / (total - positive))), len(vocabulary)
    curve = np.ones(size + 1)  # the largest curvature of the loss, by power iteration
    for _ in range(40):
        curve = curve / np.linalg.norm(curve)
        through = np.bincount(row, value * curve[column], minlength=total) + curve[-1]
        curve = np.append(np.bincount(column, value * through[row], minlength=size), through.sum())
    unfair = 4 * fairness * float(np.sum(weight * times**2 / np.minimum(spread[first], spread[second]) ** 2)) if len(first) else 0.0
    step = 1.0 / (0.3 * np.linalg.norm(curve) / total + 2 * ridge + unfair)
    seen, momentum, ahead, ahead_bias = w, 1.0, w, bias
    for _ in range(rounds):
        margin = np.bincount(row, value * ahead[column], minlength=total) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) / total
        gradient = np.bincount(column, value * error[row], minlength=size) + 2 * ridge * ahead
        if len(first):
            moved = 2 * fairness * weight * times**2 * (ahead[first] / spread[first] - ahead[second] / spread[second])
            gradient += np.bincount(first, moved / spread[first], minlength=size) - np.bincount(second, moved / spread[second], minlength=size)
        new = ahead - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparsity, 0)
        new_bias = ahead_bias - step * float(error.sum())
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_bias = new + (momentum - 1) / faster * (new - seen), new_bias + (momentum - 1) / faster * (new_bias - bias)
        if np.dot(ahead - new, new - seen) < 0:  # start the momentum anew
            faster = 1.0
        seen, bias, momentum = new, new_bias, faster
    return WordModel(bias, {word: float(seen[j] / spread[j]) for word, j in vocabulary.items() if seen[j]})


def screened(sample: DataFrame, features: int = FEATURES) -> list[str]:
    """The features of ``label, text`` with the largest likelihood ratio statistic between the labels, counted by Spark."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(bag_of(t.as_py() or "")) for t in batch.column(1)]
            marks = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.string()), pa.array(marks)], ["feature", "toxic"])

    sizes = sample.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n1, n = float(sizes["toxic"] or 0), float(sizes["n"])
    n0 = n - n1
    counted = sample.mapInArrow(split, "feature string, toxic bigint").groupBy("feature").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("all"))
    counted = counted.where(F.col("all") >= LEAST_DOCUMENTS).withColumn("b", F.col("all") - F.col("a"))
    mean = (F.col("all") + 0.5) / (n + 1)

    def part(k, size: float):
        share = (F.col(k) + 0.5) / (size + 1)
        return F.col(k) * F.log(share / mean) + (size - F.col(k)) * F.log((1 - share) / (1 - mean))

    gain = part("a", n1) + part("b", n0)
    return [row["feature"] for row in counted.orderBy(gain.desc_nulls_last(), "feature").limit(features).collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, fairness: float = 1.0) -> WordModel:
    """Fitted on at most ``rows`` labelled documents outside the held-out fold; their words alone come to the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "label").limit(rows))  # at most ``rows`` ids and labels
    texts = only(docs, "doc_id", "text").join(chosen, "doc_id").select("label", "text").dropDuplicates(["label", "text"])
    sample = settled(texts, "toxicity-sample")
    words = frozenset(screened(sample)) | _IDENTITY
    schema = "label int, words array<string>, counts array<int>, swaps array<struct<a:string,b:string,times:int,n:int>>"

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("times", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            counts = [{w: c for w, c in bag_of(t).items() if w in words} for t in texts]
            pairs = [[{"a": a, "b": b, "times": t, "n": n} for (a, b, t), n in swaps(text).items()] for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), pa.array(pairs, pair)],
                ["label", "words", "counts", "swaps"],
            )

    found = sample.mapInArrow(bags, schema).toArrow().combine_chunks()
    labels_found, pairs = np.array(found.column("label").to_pylist(), float), Counter()
    words, counts = found.column("words").to_pylist(), found.column("counts").to_pylist()
    for row in found.column("swaps").to_pylist():
        for s in row:
            pairs[s["a"], s["b"], s["times"]] += s["n"]
    return fit([dict(zip(w, c, strict=True)) for w, c in zip(words, counts, strict=True)], labels_found, pairs, fairness=fairness)


def scored(docs: DataFrame, model: WordModel) -> DataFrame:
    """``doc_id, score`` for every whole text. The model is a few hundred words, sent along with the function."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(score, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The query: a score for every document."""
    model = train(docs, labels)
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
