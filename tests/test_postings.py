"""The stored word index beside search that reads the texts, through additions, removals and merges."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emblema.operators import lexical, postings
from emblema.plans import legal
from emblema.session import fresh_path, settled

WORDS = ["the", "of", *[f"w{k}" for k in range(60)]]


def texts(seed, ids):
    pick = random.Random(seed)
    return [(i, " ".join(pick.choices(WORDS, [200, 100, *range(60, 0, -1)], k=pick.randint(0, 40))), f"n{i}") for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, name string")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "the w3 w9"), (2, "w0 of the the"), (3, "nowhere"), (4, ""), (5, " ".join(WORDS)), (6, "W59 w58-w57"), (7, "the")]
    return spark.createDataFrame(rows, "query_id int, query_text string")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def same_as_scan(index, docs, queries, k=7):
    got = rows_of(postings.bm25_stored(index, queries, k))
    assert got == rows_of(lexical.bm25(docs, queries, k))
    return got


def test_answers_through_additions_removals_and_merges(spark, queries):
    first, second = texts(1, range(0, 300)), texts(2, range(200, 400))
    index = postings.temporary_postings(frame(spark, [*first, (900, None, "null"), (901, "", "empty")]), shard_chars=3000, keep=["name"])
    docs = frame(spark, [*first, (901, "", "empty")])
    assert index.texts == 301 and len(index.segments) == 1
    same_as_scan(index, docs, queries)

    grown = postings.add_texts(index, frame(spark, second), shard_chars=5000, keep=["name"])
    now = {i: (i, t, n) for i, t, n in [*first, (901, "", "empty"), *second]}
    same_as_scan(grown, frame(spark, list(now.values())), queries)
    same_as_scan(index, docs, queries)  # an earlier version answers as before

    gone = spark.createDataFrame([(i,) for i in range(150, 350)], "doc_id bigint")
    less = postings.remove_texts(grown, gone)
    left = [r for i, r in now.items() if not 150 <= i < 350]
    same_as_scan(less, frame(spark, left), queries)
    assert less.texts == len(left)
    stored = {tuple(r) for r in postings.stored_statistics(less).select("term", "texts", "total_words").collect()}
    assert stored == {tuple(r) for r in lexical.word_statistics(frame(spark, left)).select("term", "texts", "total_words").collect()}

    merged = postings.merge_segments(less, shard_chars=4000)
    assert len(merged.segments) == 1 and merged.texts == len(left)
    same_as_scan(merged, frame(spark, left), queries)
    again = postings.add_texts(merged, frame(spark, first[150:200]), keep=["name"])  # back as they were
    same_as_scan(again, frame(spark, left + first[150:200]), queries)
    opened = postings.open_postings(spark, index.path)
    assert (opened.version, opened.segments) == (again.version, again.segments)


def test_texts_are_split_into_words_once(spark, queries, monkeypatch):
    index = postings.temporary_postings(frame(spark, texts(3, range(100))), shard_chars=1000, keep=["name"])

    def never(*_):
        raise AssertionError("texts were read again")

    monkeypatch.setattr(postings, "words", never)  # queries' words come from `lexical`
    found = postings.bm25_stored(postings.merge_segments(index), queries, 3, keep=["name"])
    assert all(r["name"] == f"n{r.doc_id}" for r in found.collect())
    scans = found._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in scans and "CartesianProduct" not in scans and "BroadcastNestedLoopJoin" not in scans


def test_a_version_that_was_not_finished_does_not_count(spark, queries):
    docs = frame(spark, texts(4, range(50)))
    index = postings.temporary_postings(docs)
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    counted, _ = postings._read_texts(frame(spark, texts(5, range(50))), "doc_id", "text", None, [])
    postings._write_segment(spark, index.path, counted, "doc_id", size, 1000, None, None)  # and no version that names it
    same_as_scan(postings.open_postings(spark, index.path), docs, queries)
    with pytest.raises(Exception, match="(?i)already exists"):
        postings.build_postings(docs, index.path)


def test_empty_corpus_and_many_blocks_of_queries(spark, queries, monkeypatch):
    empty = postings.temporary_postings(frame(spark, []))
    assert postings.bm25_stored(empty, queries, 3).count() == 0 and postings.stored_statistics(empty).count() == 0
    docs = frame(spark, texts(6, range(120)))
    index = postings.add_texts(postings.temporary_postings(docs, shard_chars=900), frame(spark, texts(7, range(40))), shard_chars=900)
    now = frame(spark, texts(7, range(40)) + texts(6, range(120))[40:])
    whole = same_as_scan(index, now, queries)
    monkeypatch.setattr(postings, "QUERIES_PER_BLOCK", 2)
    monkeypatch.setattr(postings, "SENT_TERMS", 1)
    assert rows_of(postings.bm25_stored(index, queries, 7)) == whole


def shard(lists):
    rows = [{"shard": 0, "number": n, "length": sum(c.values()), "terms": list(c), "counts": list(c.values())} for n, c in enumerate(lists)]
    kinds = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("length", pa.int64()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])
    return postings.shard_postings(pa.Table.from_pylist(rows, kinds))


def test_passing_over_postings_changes_no_answer():
    pick = random.Random(9)
    lists = [{w: pick.randint(1, 5) for w in {"the"} | {f"w{min(int(pick.expovariate(0.2)), 59)}" for _ in range(8)}} for _ in range(6000)]
    rows = shard(lists)
    average = float(np.mean([sum(c.values()) for c in lists]))
    saved = []
    for trial in range(60):
        dead = np.array(sorted(pick.sample(range(6000), 50)))
        scorer = postings.ShardScorer(rows, (1.5, 0.75, average) if trial % 3 else None, dead)
        asked = sorted({"the", *(f"w{pick.randint(0, 40)}" for _ in range(pick.randint(0, 5)))} & set(scorer.numbers))
        weights = [float(np.log1p((6000 - len(scorer.numbers[t]) + 0.5) / (len(scorer.numbers[t]) + 0.5))) for t in asked]
        total = np.zeros(6000)
        for t, w in sorted(zip(asked, weights)):
            total[scorer.numbers[t]] += w * scorer.part(scorer.counts[t], scorer.lengths[t])
        total[dead] = 0
        rounded = postings.round_score(total)
        want = [(n, rounded[n]) for n in np.lexsort((np.arange(6000), -rounded))[:10] if total[n] > 0]
        numbers, scores = scorer.best(asked, weights, 10)
        assert [n for n, _ in want] == list(numbers) and np.allclose([s for _, s in want], scores, atol=1e-4)
        if trial % 3 and len(asked) > 2:
            saved.append(scorer.scored / sum(len(scorer.numbers[t]) for t in asked))
    assert np.mean(saved) < 0.6  # "the" stands in every text


def test_words_of_all_texts_are_cut_by_shard(spark):
    docs = frame(spark, [(i, "common " * 20 + f"rare{i}", "") for i in range(400)])
    index = postings.temporary_postings(docs, shard_chars=6000)
    (segment,) = index.segments
    held = index._read(segment, "postings").where("term = 'common'")
    sizes = [r[0] for r in held.select(F.size("gaps")).collect()]
    assert sum(sizes) == 400 and len(sizes) > 8 and max(sizes) < 60


def test_legal_index_is_read_instead_of_the_passages(spark):
    corpus = spark.createDataFrame(
        [("a", "Preface on bees\nArticle 1\nBees\n1. Hives under Article 2.\n2. Honey, see Article 3 and Article 2.\nArticle 2\nWax\nWax of bees.\nArticle 3\nStings\n1. Bees sting.\n"), ("b", "Article 2\nWax again, Article 1.\n")],
        "source string, text string",
    )
    asked = spark.createDataFrame([(1, "bees and wax"), (2, "stings"), (3, "none")], "query_id int, query_text string")
    passages = legal.split_passages(corpus)
    index = legal.build_legal_index(passages, fresh_path(spark, "legal"), shard_chars=40)
    for mode in legal.MODES:
        found, want = (sorted(tuple(r) for r in df.select("query_id", "rank", "passage_id", "score").collect()) for df in (legal.retrieve_stored(index, asked, mode, 5), legal.retrieve(passages, asked, mode, 5)))
        assert found == want
    with pytest.raises(ValueError, match="mode"):
        legal.retrieve_stored(index, asked, "other")


def test_paragraphs_do_not_carry_the_text_of_their_article(spark, capsys):
    corpus = spark.createDataFrame([("a", "Article 1\nBees\n1. Hives.\n2. Honey.\n3.  \n")], "source string, text string")
    passages = legal.split_passages(corpus)
    passages.explain()
    (cut,) = (line for line in capsys.readouterr().out.splitlines() if "Generate" in line and "_p#" in line)
    carried = cut[cut.index("), [") :]
    assert "heading#" in carried and "_s#" not in carried
    held = [tuple(r) for r in passages.select("article", "heading", "text").orderBy("passage_id").collect()]
    assert held == [(1, "Article 1", "Bees"), (1, "Article 1", "1. Hives."), (1, "Article 1", "2. Honey."), (1, "Article 1", "3.")]


def test_words_are_not_shuffled_to_find_replaced_texts(spark, monkeypatch):
    index = postings.temporary_postings(frame(spark, texts(5, range(60))), shard_chars=1000, keep=["name"])
    plans = []

    def written(df, name="step"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return settled(df, name)

    monkeypatch.setattr(postings, "settled", written)
    places, lost = postings._dead(index, frame(spark, texts(6, range(40, 70))))
    assert sorted(plans)[0][0] == "postings-dead" and "terms#" not in sorted(plans)[0][1]
    assert sum(len(r["numbers"]) for r in places.collect()) == lost.count() == 20
    assert lost.columns == ["segment", "shard", "number", "length", "terms"]


def test_postings_of_a_small_index_are_written_by_all_cores(spark, monkeypatch):
    monkeypatch.setattr(postings, "BUCKET_CHARS", 4000)
    index = postings.temporary_postings(frame(spark, texts(7, range(300))), shard_chars=400, keep=["name"])
    (segment,) = index.segments
    at = F.input_file_name()
    files = index._read(segment, "postings").select("bucket", at.alias("file"), "shard").distinct().groupBy("bucket", "file").agg(F.collect_set("shard").alias("shards")).collect()
    pieces = -(-2 * spark.sparkContext.defaultParallelism // segment.buckets)
    assert segment.buckets > 1 and len(files) == segment.buckets * pieces
    for bucket in range(segment.buckets):
        held = [s for r in files if r["bucket"] == bucket for s in r["shards"]]
        assert len(held) == len(set(held))


def test_texts_are_not_shuffled_to_their_shards(spark, monkeypatch):
    made, number = [], postings.number_texts
    monkeypatch.setattr(postings, "number_texts", lambda *a: made.append(number(*a)) or made[0])
    docs = frame(spark, texts(11, range(200))).repartition(3)
    index = postings.temporary_postings(docs, shard_chars=600, keep=["name"])
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the one of docs
    held = index._all("documents").select("shard", "number", "doc_id").collect()
    by = {}
    for r in sorted(held, key=lambda r: (r["shard"], r["number"])):
        by.setdefault(r["shard"], []).append(r["doc_id"])
    assert len(by) > 6 and all(ids == sorted(ids) for ids in by.values())
    assert {(r["shard"], r["number"]) for r in held} == {(s, n) for s, ids in by.items() for n in range(len(ids))}


@pytest.mark.parametrize("longest", [40, 70_000])
def test_packed_postings_are_what_they_were(longest):
    rows = shard([Counter({f"w{k}": 1 + k % 3 for k in range(n % 7)}) + Counter({"all": 1}) for n in range(500)] + [Counter({"long": longest})])
    packed = postings.pack(rows, 3)
    assert packed.column("wide").to_pylist() == [longest >= 1 << 16] * rows.num_rows and set(packed.column("piece").to_pylist()) == {3}
    batch = pa.concat_tables([packed, postings.pack(shard([Counter({"all": 2})]), 1)]).combine_chunks().to_batches()[0].slice(1)
    got = {r["term"]: r for b in postings.unpack(batch.slice(0, rows.num_rows - 1), ["shard", "term"]) for r in b.to_pylist()}
    assert got == {r["term"]: r for r in rows.to_pylist()[1:]}
    assert sum(b.num_rows for b in postings.unpack(batch, ["term"])) == batch.num_rows
