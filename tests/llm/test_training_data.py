"""The training-data operators beside brute force, and on rows that are null, empty, repeated or long."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from emblema.llm import fingerprints, licences, minhash, mixing, packing, quality, repeats, search, secrets, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, rank string, score string, term string"
WORDS = [a + b + c for a in "bdfgkl" for b in "aeiou" for c in ("n", "r", "st", "x")]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + ("." if pick.random() < 0.1 else "") for _ in range(n))


def rows_of(texts, ids=None):
    return [(k if ids is None else ids[k], t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "x", "y", "z", "t") for k, t in enumerate(texts)]


def edited(text: str, *places: int) -> str:
    words = text.split(" ")
    for p in places:
        words[p] = "changed"
    return " ".join(words)


BASE = prose(1, 120)
TEXTS = [
    None, "", " \n\t ", "one", "one", BASE, BASE, edited(BASE, 30), edited(BASE, 30, 60), BASE.upper(), prose(2, 300) + "\n" + BASE[:400], prose(3, 8000),
    "It's <|endoftext|> ünïcode 漢字 \U0001f600 text", 'token = "' + "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1" + '" of the 4929963689861572', "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.\nidiot clown women", prose(4, 3), "a" * 700, prose(5, 60), prose(6, 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    ids = [None if k == 18 else k * 5 for k in range(len(TEXTS))]
    rows = rows_of(TEXTS, ids)
    return spark.createDataFrame([*rows, rows[5]], SCHEMA)  # one row stands twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k * 5, k % 2, int(k == 15)) for k in range(len(TEXTS))] + [(5, None, None)], "doc_id bigint, quality int, toxic int")


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_repeats_against_brute_force(docs, empty):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    held = [(i, (t or "").encode()) for i, t in texts_of(docs)]
    windows = Counter(raw[s : s + 200] for _, raw in held for s in range(len(raw) - 199))
    want = []
    for i, raw in held:
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - 199):
            if windows[raw[s : s + 200]] > 1:
                covered[s : s + 200] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        want.append((i or -1, len(raw), int(covered.sum()), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest()))
    assert got == sorted(want)
    assert repeats.remove_repeats(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=30))
def test_deep_shallow_sorts_and_measures(strings):
    order, shared = repeats.deep_shallow(strings, depth=3)
    assert [strings[k] for k in order] == sorted(strings)
    for n in range(1, len(order)):
        a, b = strings[order[n - 1]], strings[order[n]]
        assert shared[n] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeats_in_slices(spark, docs, monkeypatch):
    whole = sorted(map(str, repeats.remove_repeats(docs).collect()))
    monkeypatch.setattr(repeats, "SLICE", 1)
    assert sorted(map(str, repeats.remove_repeats(docs).collect())) == whole


def components_by_force(texts, words):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for _ in parent:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    return sets, parent


@pytest.mark.parametrize("block", [2048, 1])
def test_minhash_against_brute_force(docs, empty, block):
    held = texts_of(docs)
    sets, parent = components_by_force([t for _, t in held], 4)
    least = {}
    for (i, _), p in zip(held, parent):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = sorted((i if i is not None else -1, len(s), least.get(p, -1)) for (i, _), s, p in zip(held, sets, parent))
    found = minhash.near_duplicates(docs, block=block).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in found) == want
    assert minhash.label_documents(empty).count() == 0


def test_near_dedup_keeps_one_row_of_a_group(docs):
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns
    texts = [r.text for r in left.collect()]
    assert texts.count(BASE) == 1 and BASE.upper() not in texts and edited(BASE, 30) not in texts
    assert texts.count("one") == 1 and None in texts and "" in texts


def test_best_fit_is_best_and_bounded():
    pick, bins, space = random.Random(3), packing.BestFit(100, 4), {}
    for _ in range(2000):
        size = pick.randint(1, 100)
        fitting = [100 * 0 + left for left in bins.by_space for _ in bins.by_space[left] if left >= size]
        sequence, offset = bins.place(size)
        assert offset == space.get(sequence, 0)
        if fitting:
            assert 100 - offset == min(fitting)
        space[sequence] = offset + size
        assert space[sequence] <= 100 and bins.n_open <= 4


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_paths()[0])
    want = Counter()
    for i, t in texts_of(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, pieces_per_task=7).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_fast_and_plain_encoder_agree():
    path, ranks = packing.default_paths()
    fast, plain = packing.encoder(path, ranks), packing.encoder(path)
    for text in [*[t or "" for t in TEXTS], "don't  stop\n\n 12,345 é  ", " x y", "a\tb  \n c"]:
        assert fast(text) == plain(text)


def test_mixing_comes_near_its_targets(docs, empty):
    rows = mixing.mix_words(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    by_source = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in by_source.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s for s, t in by_source.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_words(docs).collect()))
    assert mixing.mix_words(empty).count() == 0


def test_mixing_with_importance(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows_of([prose(k, 50) for k in range(300)]), SCHEMA)
    rows = mixing.mix(frame, importance=F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(1.0)).select("row.doc_id", "row.source", "size", "target", "copies").collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.copies * r.size for r in own) == pytest.approx(own[0].target, abs=50)
        assert np.mean([r.copies for r in own if r.doc_id % 2 == 0]) >= np.mean([r.copies for r in own if r.doc_id % 2])


def test_fingerprints_against_brute_force(docs, empty):
    got = {r.doc_id: r for r in fingerprints.compared(docs.where("doc_id is not null")).dropDuplicates(["doc_id"]).collect()}
    held = dict(x for x in texts_of(docs) if x[0] is not None)
    ids = sorted(held, reverse=True)
    units = re.compile(fingerprints.PARAGRAPH)
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        if i == 25:
            continue  # stands twice: its own successor once
        text, following = held[i] or "", held[after] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].near_edited == pytest.approx(near(set(units.findall(text)), set(units.findall(new))))
        assert got[i].near_next == pytest.approx(near(set(units.findall(text)), set(units.findall(following))))
    assert got[15].fingerprint == got[20].fingerprint != got[25].fingerprint
    assert fingerprints.compared(docs).count() == docs.count() and fingerprints.compared(empty).count() == 0


def test_fingerprint_ranges_of_uneven_equal_and_null_ids(spark):
    """One far id, one id on a third of all rows and rows without an id: no range is much larger than meant, and every
    document is followed by the next one in the whole order."""
    ids = [*range(-9000, 0), 1 << 62, *[7] * 6000, *[None] * 6000, -(1 << 63), (1 << 63) - 1]
    docs = spark.createDataFrame([(i, f"text {k}.") for k, i in enumerate(ids)], "doc_id bigint, text string")
    parts = fingerprints.with_part(docs.selectExpr("*", "xxhash64(text) AS text_key"), docs.select("doc_id"))
    assert parts.where("part IS NULL").count() == 0
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 1.2 * fingerprints.ORDERED
    order = parts.orderBy(parts.doc_id.desc_nulls_last(), parts.text_key.desc()).collect()
    assert [r.part for r in order] == sorted((r.part for r in order), reverse=True)
    following = {r.text: r.next_text for r in fingerprints.with_next(docs).collect()}
    assert following == {a.text: b.text for a, b in zip(order, [*order[1:], order[0]])}


def test_search_against_brute_force(docs, empty):
    held = texts_of(docs)
    bags = [Counter(search.words_of(t)) for _, t in held]
    mean, n, df = sum(map(sum, (b.values() for b in bags))) / len(bags), len(bags), Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    asking = docs.where("doc_id % 20 = 0").select(docs.doc_id.alias("query_id"), "text")
    got = search.top_k(docs, asking, k=3, shard=4, per_task=2).collect()
    for query, text in texts_of(asking.selectExpr("query_id doc_id", "text")):
        own = Counter(search.words_of(text))
        terms = sorted((w for w in own if df[w] > 1), key=lambda w: (-own[w] * idf[w], w))[: search.QUERY_TERMS]
        scores = []
        for (i, _), bag in zip(held, bags):
            score = sum(idf[w] * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)) for w in terms if w in bag)
            if score > 0:
                scores.append((-round(score, 9), i if i is not None else 10**9))
        mine = [(-round(r.score, 9), r.doc_id if r.doc_id is not None else 10**9) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == query]
        assert mine == sorted(scores)[:3]
    assert search.search_documents(empty).count() == 0


def test_secrets(spark, docs, empty):
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.findings(docs, model).collect()
    text = TEXTS[13]
    assert {(text[r.start : r.start + r.length], r.secret) for r in found if r.doc_id == 65} == {("3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1", True), ("4929963689861572", False)}
    masked = secrets.redacted(docs, model)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    row = masked.where("doc_id = 65").first()
    assert row.text == text.replace("3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1", secrets.MASK) and row.n_chars == len(row.text)
    assert secrets.findings(empty, model).count() == 0


def test_licences(docs, empty):
    model = licences.train(licences.training_rows(docs))
    found = {(r.doc_id, r.paragraph): (r.licence, r.confirmed) for r in licences.findings(docs, model).collect()}
    assert found[70, 0] == ("mit", True) and found[75, 0] == ("cc-by-nc", True) and (75, 1) not in found
    assert licences.findings(empty, model).count() == 0


def test_quality_rules(docs, empty, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.kept(docs, labels).columns == docs.columns


def test_toxicity(docs, empty, labels):
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_swaps_hold_scores_together():
    # toxic sentences mention one group more often than neutral ones do
    texts = [f"the women met {w}" for w in WORDS[:40]] + [f"idiot women {w}" for w in WORDS[:60]] + [f"the men met {w}" for w in WORDS[:90]]
    y = np.array([0] * 40 + [1] * 60 + [0] * 90, float)
    pairs = Counter()
    for t in texts:
        pairs.update(toxicity.swaps(t))
    bags = [toxicity.bag_of(t) for t in texts]
    gap = {}
    for fairness in (0.0, 50.0):
        model = toxicity.fit(bags, y, pairs, fairness=fairness)
        gap[fairness] = abs(model.score("the women met today") - model.score("the men met today"))
        assert model.score("idiot people") > 0.5
    assert gap[50.0] < gap[0.0] / 2 + 1e-9 or gap[50.0] < 0.01


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    import os

    if not os.path.isdir(sf_dir):
        pytest.skip("needs the given tables")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        rows = module.classify(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", column).collect()
        assert np.mean([r[0] == r[1] for r in rows]) > 0.95


def test_pipeline_stages_take_effect(spark, tmp_path, docs):
    rows = docs.collect()
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, str(tmp_path))
        assert after.columns == frame.columns
        frame = after
    assert packed.groupBy("doc_id").count().count() == frame.select("doc_id").distinct().count() > 5
