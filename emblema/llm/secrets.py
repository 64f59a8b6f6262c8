"""Secret scans: a random forest on what a candidate looks like and what stands beside it removes false positives.

Candidates are runs of 16 and more characters of keys, tokens and digests with a digit among them. Features are their
length, transitions between kinds of characters, the share that dictionary words cover, path characters, and words on
either side. The forest is trained on labelled findings and compiled into a Spark expression; all work is DataFrame
operations.

Defined cases: a null or empty text has no candidates; a null id is carried; repeated rows give repeated findings; an
empty table gives an empty result; further columns are carried along by ``redacted`` and left aside by ``findings``; a
very long text is searched whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .forest import forest_column

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Characters looked at before and after a candidate.
BEFORE, AFTER = 64, 24
#: Words whose letters count as covered; a parameter.
DICTIONARY = (
    "the", "and", "ing", "tion", "ment", "able", "ness", "port", "ation", "image", "photo", "page", "file", "data", "index", "release",
    "version", "report", "chapter", "section", "product", "order", "item", "user", "name", "date", "test", "example", "content", "document",
)
SECRET_WORDS = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private|bearer|client[_-]?key)"
DIGEST_WORDS = r"(?:commit|sha-?\d*|md5|checksum|digest|hash|etag|revision|uuid|isbn|order|invoice|phone|card|account|doi|build)"
FEATURES = (
    "length", "transitions", "digits", "upper", "distinct", "covered", "hex", "letters_only_runs", "path_marks", "assigned", "quoted",
    "secret_word", "digest_word", "path_before", "known_prefix",
)


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """In the order of ``FEATURES``, as doubles."""
    size = F.greatest(F.length(value), F.lit(1))

    def share(pattern: str, of: Column = value) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / size

    low = F.lower(before)
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    uncovered = F.regexp_replace(F.lower(value), words, "")
    made = [
        F.length(value),
        share(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"),
        share("[0-9]"),
        share("[A-Z]"),
        F.size(F.array_distinct(F.split(F.lower(value), ""))) / size,
        1 - F.length(uncovered) / size,
        F.lower(value).rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"),
        F.length(F.regexp_extract(value, "[A-Za-z]{6,}", 0)) / size,
        share("[/_-]"),
        before.rlike(r"[=:]\s*[\"']?$"),
        before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"),
        low.rlike(SECRET_WORDS + r"[^a-z]{0,6}(?:is|was|for|of)?[^a-z]{0,4}$"),
        low.rlike(DIGEST_WORDS + r"[^a-z]{0,6}$"),
        before.rlike(r"[/.\\]$"),
        value.rlike("^(?:AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk_live|sk-|eyJ|AIza)"),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in made]


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """``value, before, after, label``: labelled findings of known forms. Each row's digest makes its characters, so the table is
    the same every time; ``rows`` bounds it."""
    key = F.col("id").cast("string")
    hexes, second = F.sha1(key.cast("binary")), F.sha1(F.concat(F.lit("b"), key).cast("binary"))
    mixed_case = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, second))), "[+/=\r\n]", "x")
    digits = F.regexp_replace(F.conv(F.substring(hexes, 1, 15), 16, 10), "^", "4")
    cut = F.pmod(F.xxhash64("id"), F.lit(24)).cast("int")
    secret = ['token = "', "api_key: ", "secret='", 'password = "', "Authorization: Bearer ", "access_key=", 'TOKEN = "', "client_key: "]
    plain = ["commit ", "sha256 ", "checksum: ", "etag=", "order ", "see images/", "revision ", "the ", "build-", "invoice "]
    word = F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64(key), F.lit(len(DICTIONARY))) + 1).cast("int"))
    name = F.concat(word, F.lit("_"), F.reverse(word), F.lit("-"), F.substring(digits, 1, 4), F.lit("-"), word)
    path = F.concat(F.lit("static/"), word, F.lit("/"), F.substring(digits, 1, 4), F.lit("/"), word, F.substring(hexes, 1, 6))

    def chosen(values: list[str], salt: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))

    forms = [  # value, is a secret if said so or by its form alone
        (hexes, None), (F.upper(hexes), None), (F.substring(hexes, 1, 32), None), (F.substring(mixed_case, 1, 40), None), (mixed_case.substr(F.lit(1), 20 + cut), None),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), 1), (F.concat(F.lit("ghp_"), F.substring(mixed_case, 1, 36)), 1), (F.concat(F.lit("eyJ"), mixed_case), 1),
        (F.substring(digits, 1, 16), 0), (name, 0), (path, 0), (F.regexp_replace(F.substring(F.concat(hexes, second), 1, 32), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), 0),
    ]
    form = F.pmod(F.col("id"), F.lit(len(forms)))
    said = F.pmod(F.xxhash64(F.lit("said"), "id"), F.lit(2)) == 1
    value, own = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (made, label) in enumerate(forms):
        value = F.when(form == k, made).otherwise(value)
        own = F.when(form == k, F.lit(label).cast("int")).otherwise(own)
    noise = F.concat(word, F.lit(" was the "))
    before = F.concat(noise, F.when(said, chosen(secret, "s")).otherwise(chosen(plain, "p")))
    after = F.when(before.endswith('"'), F.lit('" of the')).when(before.endswith("'"), F.lit("' of the")).otherwise(F.lit(" of the"))
    return spark.range(rows).select(value.alias("value"), before.alias("before"), after.alias("after"), F.coalesce(own, said.cast("int")).alias("label"))


def train(findings: DataFrame, trees: int = 12, depth: int = 5, seed: int = 5) -> Callable[[Column, Column, Column], Column]:
    """A function of value, text before and text after to the chance that the value is a secret. ``findings`` are bounded, labelled rows."""
    made = findings.select(*[c.alias(n) for c, n in zip(features(F.col("value"), F.col("before"), F.col("after")), FEATURES, strict=True)], F.col("label").cast("double"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)

    def chance(value: Column, before: Column, after: Column) -> Column:
        # the features are bound once and then read by every tree
        bound = F.array(F.array(*features(value, before, after)))
        return F.element_at(F.transform(bound, lambda f: forest_column(forest, [f[k] for k in range(len(FEATURES))])), 1)

    return chance


def with_findings(docs: DataFrame, model: Callable) -> DataFrame:
    """Adds ``_values``, ``_gaps`` (the text between them) and ``_scores`` for the documents that have candidates."""
    found = docs.withColumn("_values", F.regexp_extract_all(F.col("text"), F.lit(CANDIDATE), F.lit(0)))
    found = found.withColumn("_gaps", F.when(F.size("_values") > 0, F.split("text", CANDIDATE, -1)))

    def score(value: Column, at: Column) -> Column:
        before, after = F.element_at("_gaps", at + 1), F.element_at("_gaps", at + 2)
        return model(value, F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER)))

    return found.withColumn("_scores", F.when(F.size("_values") > 0, F.transform("_values", score)))


def findings(docs: DataFrame, model: Callable, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: where it stands (code points from 0), its length, digest and score, and whether it is held for a
    secret. The secret itself isn't shown."""
    scored = with_findings(docs.select("doc_id", "text"), model).where(F.size("_values") > 0)
    begun = F.aggregate(
        F.sequence(F.lit(1), F.size("_values")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda state, k: F.struct(
            (state["at"] + F.length(F.element_at("_gaps", k)) + F.length(F.element_at("_values", k))).alias("at"),
            F.array_append(state["starts"], state["at"] + F.length(F.element_at("_gaps", k))).alias("starts"),
        ),
        lambda state: state["starts"],
    )
    rows = scored.select("doc_id", F.explode(F.arrays_zip(F.col("_values").alias("value"), begun.alias("start"), F.col("_scores").alias("score"))).alias("f"))
    return rows.select(
        "doc_id",
        F.col("f.start").alias("start"),
        F.length("f.value").cast("bigint").alias("length"),
        F.sha2("f.value", 256).alias("value_sha256"),
        F.col("f.score").alias("score"),
        (F.col("f.score") >= threshold).alias("secret"),
    )


def redacted(docs: DataFrame, model: Callable, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with each secret replaced by a mask, and ``n_chars`` after it where that column is there; other columns as they are."""
    scored = with_findings(docs, model)
    masked = F.transform(
        F.sequence(F.lit(1), F.size("_values")),
        lambda k: F.concat(F.element_at("_gaps", k), F.when(F.element_at("_scores", k) >= threshold, F.lit(MASK)).otherwise(F.element_at("_values", k))),
    )
    any_secret = F.exists("_scores", lambda s: s >= threshold)
    text = F.when(F.coalesce(any_secret, F.lit(False)), F.concat(F.array_join(masked, ""), F.element_at("_gaps", -1))).otherwise(F.col("text"))
    changed = scored.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.coalesce(any_secret, F.lit(False)), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def scan(docs: DataFrame) -> DataFrame:
    """The query: every candidate of every document."""
    return findings(docs, train(labelled_findings(docs.sparkSession)))
