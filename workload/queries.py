"""The registered queries: each reads the given tables whole and runs one operator or plan of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emblema.constants import DEMO_BANDS
from emblema.functions.numbers import rounded
from emblema.functions.keys import cache_key, encoder_text
from emblema.functions.letters import format_letter
from emblema.functions.names import band, letter_similarity, name_similarity, sound_key, transliterate
from emblema.functions.text import calendar_date, field_list, iso_date, status_from_wording
from emblema.operators import celltree, filters, lexical, nearest, postings, soundalike, upsert
from emblema.operators.encode import cache_plan, embed_column, fill_cache, ngram_encoder
from emblema.operators.encode import embed_marks as marks_with_vectors
from emblema.operators.encode import embed_one as encode_one
from emblema.operators.encode import embed_with_cache as cached_vectors
from emblema.operators.pages import stitch_pages
from emblema.plans import bulletin, clearance, ingest, legal, office_action, recommend, search, stats
from emblema.schema import conform
from emblema.session import fresh_path, settled
from emblema.sources import textfiles, texts
from emblema.sources.register import append_records, create_register, current_register, open_register, read_changes
from emblema.streaming import watch

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        "application_number",
        "mark_name",
        F.array_join("nice_classes", ",").alias("nice_classes"),
        "applicant_name",
        "applicant_country",
        "filing_date",
        "status",
    )


# --- filters ----------------------------------------------------------------------------------------------
@query
def search_text_like(spark, sf_dir):
    return flat(filters.filter_register(views.register(spark, sf_dir), query_text="red"))


@query
def search_all_classes(spark, sf_dir):
    return flat(filters.filter_register(views.register(spark, sf_dir), nice_classes=[9, 35]))


@query
def search_any_class(spark, sf_dir):
    return flat(filters.filter_register(views.register(spark, sf_dir), any_classes=[9, 35, 37, 42]))


@query
def search_contains_list(spark, sf_dir):
    return flat(views.register(spark, sf_dir).where(filters.contains_list([12, 20])))


@query
def search_filters_combined(spark, sf_dir):
    return flat(
        filters.filter_register(
            views.register(spark, sf_dir),
            query_text="ring",
            status="registered",
            country="NATION_7",
            filing_date_after="2019-06-01",
        )
    )


@query
def search_in_list(spark, sf_dir):
    return flat(filters.filter_register(views.register(spark, sf_dir), statuses=["registered", "published"]))


@query
def search_where_clause(spark, sf_dir):
    clause = "applicant_name LIKE '%#1%' AND status <> 'refused' AND filing_date < '2021-01-01'"
    return flat(filters.where_clause(views.register(spark, sf_dir), clause))


@query
def lookup_application_number(spark, sf_dir):
    return flat(filters.by_application_number(views.register(spark, sf_dir), "000000042"))


@query
def search_json(spark, sf_dir):
    rows = filters.filter_register(views.register(spark, sf_dir), any_classes=[9, 42])
    return search.as_json(rows.select("id", "mark_name", "nice_classes", "filing_date", "status", F.expr("nullif(status, 'registered')").alias("note")))


@query
def search_response(spark, sf_dir):
    rows = filters.filter_register(views.register(spark, sf_dir), status="opposed")
    return search.response(rows.select("application_number", "id", "mark_name", "nice_classes"))


@query
def hybrid_search_text(spark, sf_dir):
    return flat(search.hybrid_search(views.register(spark, sf_dir), "blue", status="registered"))


# --- vectors ----------------------------------------------------------------------------------------------
_VECTORS = dict(item_id="vec_id", vector="embedding", keep=["vec_id", "label"])


@query
def knn_cosine_topk(spark, sf_dir):
    marks, asked = views.table(spark, sf_dir, "embeddings"), views.vector_queries(spark, sf_dir)
    return nearest.nearest(marks, asked, 10, **_VECTORS)


@query
def knn_prefilter(spark, sf_dir):
    marks, asked = views.table(spark, sf_dir, "embeddings"), views.vector_queries(spark, sf_dir)
    return nearest.nearest(marks, asked, 10, where=F.col("label") >= 6, **_VECTORS)


@query
def knn_postfilter(spark, sf_dir):
    marks, asked = views.table(spark, sf_dir, "embeddings"), views.vector_queries(spark, sf_dir)
    return nearest.nearest(marks, asked, 10, where=F.col("label") >= 6, prefilter=False, **_VECTORS)


def _mean_vector(spark, sf_dir) -> list[float]:
    """Mean of all vectors: as many numbers as a vector has dimensions."""
    parts = views.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return [row["m"] for row in mean.orderBy("i").collect()]


@query
def hybrid_search_vector_and_filter(spark, sf_dir):
    found = search.hybrid_search(
        views.vector_register(spark, sf_dir),
        "ignored",
        _mean_vector(spark, sf_dir),
        status="registered",
        filing_date_after="2018-02-01",
    )
    return found.select("id", "application_number", "mark_name", "status", "similarity_score")


@query
def hybrid_search_in_cells(spark, sf_dir):
    """The search before, through the cell index with all cells probed."""
    marks = views.vector_register(spark, sf_dir)
    index = nearest.build_index(marks, fresh_path(spark, "cells"))
    found = search.hybrid_search(
        marks,
        "ignored",
        _mean_vector(spark, sf_dir),
        status="registered",
        filing_date_after="2018-02-01",
        index=index,
        nprobe=len(index.centres),
    )
    return found.select("id", "application_number", "mark_name", "status", "similarity_score")


@query
def knn_mixed_sizes(spark, sf_dir):
    """Queries of several vector sizes: those of the size asked for are answered, the others named with a reason."""
    asked = views.bare_candidates(spark, sf_dir)
    found = nearest.nearest(views.table(spark, sf_dir, "embeddings"), asked, 5, dim=64, **_VECTORS)
    answered = found.select("query_id", "vec_id", "similarity_score", "rank", F.lit(None).cast("string").alias("reason"))
    return answered.unionByName(nearest.unusable_queries(asked, 64), allowMissingColumns=True)


@query
def image_search(spark, sf_dir):
    marks = views.vector_register(spark, sf_dir).withColumnRenamed("text_vector", "image_vector")
    found = search.image_search(marks, views.vector_queries(spark, sf_dir), 5, keep=["id", "mark_name"])
    return found


def _in_cells(spark, sf_dir, nprobe):
    marks, asked = views.table(spark, sf_dir, "embeddings"), views.vector_queries(spark, sf_dir)
    index = nearest.build_index(marks, fresh_path(spark, "cells"), item_id="vec_id", vector="embedding")
    return nearest.nearest_in_cells(
        index, asked, 10, nprobe or len(index.centres), item_id="vec_id", keep=["vec_id", "label"]
    )


@query
def knn_cells(spark, sf_dir):
    return _in_cells(spark, sf_dir, 2)


@query
def knn_cells_all_probed(spark, sf_dir):
    return _in_cells(spark, sf_dir, None)


@query
def knn_cells_recall(spark, sf_dir):
    return nearest.recall(_in_cells(spark, sf_dir, 2), knn_cosine_topk(spark, sf_dir), item_id="vec_id")


def _mean_centres(spark, sf_dir):
    """Centres that SQL can compute, too: the mean of each label, and under it the means of its four parts by id."""
    each = views.table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4).alias("part"), F.posexplode("embedding").alias("d", "x"))

    def means(*keys):
        averages = each.groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
        return averages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c"))

    tops = [r["c"] for r in means("label").select(F.col("c.m").alias("c"), "label").orderBy("label").collect()]  # one for each label
    leaf = (F.col("label") * 4 + F.col("part")).cast("int")
    return tops, means("label", "part").select(F.col("label").cast("int").alias("top"), leaf.alias("leaf"), F.col("c.m").alias("centre"))


_TREE = dict(item_id="vec_id", vector="embedding")


@query
def knn_tree(spark, sf_dir):
    """Two levels of given centres: three cells of the first level and six leaves are probed."""
    tree = celltree.build_tree(views.table(spark, sf_dir, "embeddings"), fresh_path(spark, "tree"), centres=_mean_centres(spark, sf_dir), **_TREE)
    return celltree.search_tree(tree, views.vector_queries(spark, sf_dir), 10, 6, beam=3, keep=["vec_id", "label"])


def _kept_up_tree(spark, sf_dir):
    """An index built while some vectors were others and some were missing, brought up to date since."""
    marks = views.table(spark, sf_dir, "embeddings")
    stale = marks.where("label <> 7").withColumn("embedding", F.when(F.col("label") % 2 == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    gone = marks.where("label = 2").withColumn("vec_id", -F.col("vec_id") - 1)
    tree = celltree.build_tree(stale.unionByName(gone), fresh_path(spark, "tree"), **_TREE)
    tree = celltree.upsert_rows(tree, marks.where("label % 2 = 1"))
    return celltree.remove_rows(tree, gone)


@query
def knn_after_upsert(spark, sf_dir):
    tree = _kept_up_tree(spark, sf_dir)
    return celltree.search_tree(tree, views.vector_queries(spark, sf_dir), 10, tree.leaf_count, keep=["vec_id", "label"])


@query
def knn_tree_recall(spark, sf_dir):
    """Recall beside the share of rows read, two thirds of the leaves of a trained tree probed."""
    marks, asked = views.table(spark, sf_dir, "embeddings"), views.vector_queries(spark, sf_dir)
    tree = celltree.build_tree(marks, fresh_path(spark, "tree"), **_TREE)
    nprobe = -(-tree.leaf_count * 2 // 3)
    found = celltree.search_tree(tree, asked, 10, nprobe, keep=["vec_id"])
    recall = nearest.recall(found, nearest.nearest(marks, asked, 10, **_VECTORS), item_id="vec_id")
    return recall.join(celltree.share_read(tree, asked, nprobe), "query_id")


@query
def vector_norms(spark, sf_dir):
    from emblema.functions.vectors import dot, norm, unit

    v = F.col("embedding")
    return views.table(spark, sf_dir, "embeddings").select(
        "vec_id", rounded(norm(v), 4).alias("norm"), rounded(dot(unit(v), v), 4).alias("unit_dot")
    )


# --- words ------------------------------------------------------------------------------------------------
@query
def word_statistics(spark, sf_dir):
    return lexical.word_statistics(views.text_table(spark, sf_dir, "documents"))


@query
def bm25_search(spark, sf_dir):
    return lexical.bm25(views.text_table(spark, sf_dir, "documents"), views.text_queries(spark, sf_dir), 10)


@query
def rrf_fusion(spark, sf_dir):
    docs, vectors = views.text_table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "embeddings")
    both = docs.join(vectors, docs.doc_id == vectors.vec_id, "left")
    return search.fused_search(
        both, views.vector_queries(spark, sf_dir), 10, depth=50, item_id="doc_id", text="text", vector="embedding"
    )


@query
def nice_recommend(spark, sf_dir):
    asked = views.candidates(spark, sf_dir).select("query_id", F.replace("candidate_name", F.lit("y"), F.lit("i")).alias("query_text"))
    return recommend.recommend_classes(views.register(spark, sf_dir), asked, 5)


# --- words from stored postings ---------------------------------------------------------------------------
@query
def bm25_stored(spark, sf_dir):
    index = postings.temporary_postings(views.text_table(spark, sf_dir, "documents"))
    return postings.bm25_stored(index, views.text_queries(spark, sf_dir), 10)


def _grown_index(spark, sf_dir):
    """Texts come in three additions; those in French come twice, first with another text."""
    docs = views.text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stale = docs.where("lang = 'fr'").withColumn("text", F.concat_ws(" ", "lang", F.reverse("text")))
    others = docs.where("lang NOT IN ('de', 'fr')")
    index = postings.temporary_postings(others.unionByName(stale))
    index = postings.add_texts(index, docs.where("lang = 'de'"))
    return postings.add_texts(index, docs.where("lang = 'fr'"))


@query
def bm25_stored_segments(spark, sf_dir):
    return postings.bm25_stored(_grown_index(spark, sf_dir), views.text_queries(spark, sf_dir), 10)


@query
def bm25_stored_merged(spark, sf_dir):
    merged = postings.merge_segments(_grown_index(spark, sf_dir))
    return postings.bm25_stored(merged, views.text_queries(spark, sf_dir), 10)


@query
def word_statistics_stored(spark, sf_dir):
    return postings.stored_statistics(_grown_index(spark, sf_dir))


@query
def rrf_fusion_stored(spark, sf_dir):
    docs, vectors = views.text_table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "embeddings")
    both = docs.join(vectors, docs.doc_id == vectors.vec_id, "left")
    index = postings.temporary_postings(docs)
    return search.fused_search(
        both, views.vector_queries(spark, sf_dir), 10, depth=50, item_id="doc_id", text="text", vector="embedding", postings=index
    )


@query
def nice_recommend_stored(spark, sf_dir):
    asked = views.candidates(spark, sf_dir).select("query_id", F.replace("candidate_name", F.lit("y"), F.lit("i")).alias("query_text"))
    index = postings.temporary_postings(views.register(spark, sf_dir), doc_id="id", text="goods_text", keep=["nice_classes"])
    return recommend.recommend_classes(None, asked, 5, postings=index)


# --- names ------------------------------------------------------------------------------------------------
@query
def sound_similarity(spark, sf_dir):
    return views.word_marks(spark, sf_dir).select(
        "doc_id",
        "mark_name",
        "other_name",
        rounded(name_similarity(F.col("mark_name"), F.col("other_name")), 4).alias("sound"),
    )


@query
def similar_names(spark, sf_dir):
    """Marks that sound like a candidate, wherever their vectors lie."""
    return soundalike.similar_names(views.register(spark, sf_dir), views.candidates(spark, sf_dir), 0.6)


@query
def transliterate_names(spark, sf_dir):
    name = F.col("mark_name")
    return views.word_marks(spark, sf_dir).select(
        "doc_id", transliterate(name).alias("transliterated"), sound_key(name).alias("sound_key")
    )


@query
def visual_similarity(spark, sf_dir):
    pair = views.register(spark, sf_dir).select(
        "id", sound_key(F.col("mark_name")).alias("a"), sound_key(F.col("goods_text")).alias("b")
    )
    return pair.select("id", rounded(letter_similarity(F.col("a"), F.col("b")), 4).alias("visual"))


@query
def similarity_bands(spark, sf_dir):
    score = F.col("p_size") / F.lit(50.0)
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", band(score).alias("pair_band"), band(score, DEMO_BANDS, ("high", "medium", "low")).alias("demo_band")
    )


@query
def absolute_grounds(spark, sf_dir):
    marks = views.register(spark, sf_dir).select("id", F.col("mark_name").alias("candidate_name"))
    return clearance.absolute_grounds(marks, terms=("red", "blue", "ring", "small"))


@query
def absolute_grounds_words(spark, sf_dir):
    marks = views.word_marks(spark, sf_dir).select("doc_id", F.col("other_name").alias("candidate_name"))
    return clearance.absolute_grounds(marks)


# --- clearance --------------------------------------------------------------------------------------------
def _report(spark, sf_dir, **options):
    return clearance.clearance_report(views.vector_register(spark, sf_dir), views.candidates(spark, sf_dir), **options)


@query
def clearance_report(spark, sf_dir):
    return _report(spark, sf_dir).drop("nice_classes")


@query
def clearance_report_identical(spark, sf_dir):
    return _report(spark, sf_dir, include_identical=True).drop("nice_classes")


@query
def clearance_summary(spark, sf_dir):
    return clearance.clearance_summary(
        _report(spark, sf_dir), views.register(spark, sf_dir), views.candidates(spark, sf_dir)
    )


@query
def clearance_summary_unsearched(spark, sf_dir):
    """Candidates without a usable vector among the others: never LOW, as nothing was compared with them."""
    asked, dim = views.bare_candidates(spark, sf_dir), 64
    report = clearance.clearance_report(views.vector_register(spark, sf_dir), asked, dim=dim)
    return clearance.clearance_summary(report, views.register(spark, sf_dir), asked, dim=dim)


@query
def clearance_high_risk(spark, sf_dir):
    return clearance.high_risk(_report(spark, sf_dir)).drop("nice_classes")


@query
def identical_conflicts(spark, sf_dir):
    return clearance.identical_marks(views.register(spark, sf_dir), views.candidates(spark, sf_dir))


# --- counts -----------------------------------------------------------------------------------------------
@query
def register_stats(spark, sf_dir):
    return stats.register_stats(views.register(spark, sf_dir))


@query
def status_distribution(spark, sf_dir):
    return stats.status_distribution(views.register(spark, sf_dir))


@query
def class_listing(spark, sf_dir):
    return stats.class_listing(views.register(spark, sf_dir))


@query
def class_counts(spark, sf_dir):
    return stats.class_counts(views.register(spark, sf_dir))


# --- detail pages and upserts -----------------------------------------------------------------------------
@query
def parse_detail_page(spark, sf_dir):
    parsed = ingest.parse_detail_pages(views.detail_pages(spark, sf_dir), scraped_at="2026-04-20T00:00:00")
    return parsed.select(
        "id",
        "application_number",
        "registration_number",
        "mark_name",
        "mark_type",
        F.array_join("nice_classes", ",").alias("nice_classes"),
        F.array_join("goods_services", "|").alias("goods_services"),
        "applicant_name",
        "applicant_country",
        "filing_date",
        "status",
        "jurisdiction",
        "source",
        "raw_url",
        "scraped_at",
        "reject_reason",
    )


@query
def normalise_status(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", status_from_wording(F.expr(views.PAGE_STATUS)).alias("status")
    )


@query
def convert_dates(spark, sf_dir):
    text = F.expr(
        f"CASE WHEN p_size % 5 = 0 THEN '31-2-' || CAST(2000 + p_size AS VARCHAR(4)) ELSE {views.PAGE_DATE} END"
    )
    dated = views.table(spark, sf_dir, "part").select("p_partkey", iso_date(text).alias("iso"))
    return dated.select("p_partkey", "iso", calendar_date(F.col("iso")).alias("day"))


@query
def ingest_totals(spark, sf_dir):
    return ingest.ingest_totals(ingest.parse_detail_pages(views.detail_pages(spark, sf_dir)))


@query
def ingest_urls(spark, sf_dir):
    """A URL per lineitem; parts beyond the register have no page."""
    urls = views.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 100).alias("p_partkey"))
    parsed = ingest.ingest_urls(
        urls.select(F.expr(views.PAGE_URL).alias("url")), views.detail_pages(spark, sf_dir)
    )
    return parsed.select("raw_url", "application_number", "mark_name", "reject_reason", "requests")


def _changes(spark, sf_dir):
    """A change per lineitem: half of the numbers are new."""
    return views.table(spark, sf_dir, "lineitem").select(
        F.expr("concat('l', CAST(l_partkey * 2 AS VARCHAR(20)))").alias("id"),
        F.expr("lpad(CAST(l_partkey * 2 AS VARCHAR(20)), 9, '0')").alias("application_number"),
        F.expr("concat('mark ', CAST(l_orderkey AS VARCHAR(20)))").alias("mark_name"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'refused' WHEN 'A' THEN 'registered' ELSE 'published' END").alias("status"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
    )


_CHANGE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]


@query
def upsert_register(spark, sf_dir):
    base = views.register(spark, sf_dir).select("id", "application_number", "mark_name", "status")
    return upsert.upsert(base, _changes(spark, sf_dir), order=_CHANGE_ORDER)


@query
def upsert_null_keys(spark, sf_dir):
    """Changes of which every fifth has no number: those are handed back, each of them."""
    base = views.register(spark, sf_dir).select("id", "application_number", "mark_name", "status")
    number = F.when(F.col("l_orderkey") % 5 != 0, F.col("application_number"))
    changes = _changes(spark, sf_dir).withColumn("application_number", number)
    placed = upsert.upsert(base, changes, order=_CHANGE_ORDER).withColumn("placed", F.lit(True))
    return placed.unionByName(upsert.without_key(changes).select(*base.columns, F.lit(False).alias("placed")))


@query
def delete_by_key(spark, sf_dir):
    base = views.register(spark, sf_dir).select("id", "application_number", "mark_name", "status")
    refused = _changes(spark, sf_dir).where("status = 'refused' AND l_linenumber = 1")
    return upsert.delete_keys(base, refused)


@query
def delete_where(spark, sf_dir):
    base = views.register(spark, sf_dir).select("id", "application_number", "mark_name", "status")
    return upsert.delete_where(base, F.col("status").isin("expired", "withdrawn"))


# --- bulletins --------------------------------------------------------------------------------------------
@query
def extract_links(spark, sf_dir):
    return bulletin.extract_links(views.text_table(spark, sf_dir, "pages"))


@query
def bulletin_links(spark, sf_dir):
    return bulletin.bulletin_links(views.bulletin_pages(spark, sf_dir)).drop("scraped_at")


@query
def bulletin_items(spark, sf_dir):
    return bulletin.bulletin_items(views.bulletin_pages(spark, sf_dir)).drop("scraped_at", "source", "id")


@query
def bulletin_items_nested(spark, sf_dir):
    """Items within items: each ends at its own closing tag."""
    return bulletin.bulletin_items(views.nested_pages(spark, sf_dir)).drop("scraped_at", "source", "id")


@query
def bulletin_links_nested(spark, sf_dir):
    return bulletin.bulletin_links(views.nested_pages(spark, sf_dir)).drop("scraped_at")


@query
def bulletin_items_with_records(spark, sf_dir):
    items = bulletin.bulletin_items(views.bulletin_pages(spark, sf_dir))
    joined = bulletin.items_with_records(items, views.register(spark, sf_dir))
    return joined.select("page_id", "position", "application_number", "record_id", "registered_name", "status")


@query
def items_to_clearance(spark, sf_dir):
    """Bulletin items, the detail pages of their numbers, the register and the clearance of each, in one plan."""
    register = views.register(spark, sf_dir)
    watched = settled(marks_with_vectors(register.where("status = 'registered'"), ngram_encoder(64)), "watched")
    details = ingest.accepted(ingest.parse_detail_pages(views.detail_pages(spark, sf_dir).where("markdown LIKE '%Origin: FR%'")))
    items = bulletin.bulletin_items(views.bulletin_pages(spark, sf_dir))
    found = watch.clear_items(items, details, register, watched, ngram_encoder(64), k=3)
    return found.select("item", "origin", "candidate_name", "rank", "application_number", "mark_name", "semantic", "sound", "overall", "risk")


@query
def first_crawled(spark, sf_dir):
    items = bulletin.first_crawled(bulletin.bulletin_items(views.bulletin_pages(spark, sf_dir)))
    return items.select("page_id", "position", "application_number", "mark_name")


@query
def bulletin_alerts(spark, sf_dir):
    """Every bulletin item cleared against the whole register, vectors from the stand-in encoder."""
    encoder = ngram_encoder(64)
    watched = settled(embed_column(views.register(spark, sf_dir), "mark_name", encoder), "watched")
    items = bulletin.bulletin_items(views.bulletin_pages(spark, sf_dir))
    found = watch.alerts(items, watched, encoder, levels=("HIGH", "MEDIUM"))
    return found.select(F.col("item").alias("query_id"), "candidate_name", "rank", "id", "mark_name", "semantic", "sound", "overall", "risk")


@query
def crawl_statistics(spark, sf_dir):
    return bulletin.crawl_statistics(bulletin.bulletin_items(views.bulletin_pages(spark, sf_dir)))


# --- letters and law --------------------------------------------------------------------------------------
@query
def letter_format(spark, sf_dir):
    return views.text_table(spark, sf_dir, "documents").select("doc_id", format_letter(F.col("text")).alias("markdown"))


@query
def letter_format_letters(spark, sf_dir):
    return office_action.formatted_letters(views.letters(spark, sf_dir))


@query
def page_stitch(spark, sf_dir):
    return stitch_pages(views.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query
def page_stitch_parts(spark, sf_dir):
    return stitch_pages(views.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", pages_per_part=3)


@query
def letter_header(spark, sf_dir):
    return office_action.letter_header(views.letters(spark, sf_dir))


@query
def objections(spark, sf_dir):
    return office_action.objections(views.letters(spark, sf_dir))


@query
def citations(spark, sf_dir):
    return office_action.letter_citations(views.letters(spark, sf_dir))


@query
def cited_articles(spark, sf_dir):
    return office_action.cited_articles(
        views.letters(spark, sf_dir), legal.split_passages(views.statutes(spark, sf_dir))
    )


@query
def article_index(spark, sf_dir):
    return legal.article_index(legal.split_passages(views.statutes(spark, sf_dir)))


@query
def structured_letters(spark, sf_dir):
    read = office_action.structured_letters(views.letters(spark, sf_dir))
    lists = {c: F.array_join(c, "|") for c in ("objections_found", "citations", "guidelines", "decisions")}
    return read.withColumns(lists).drop("markdown")


@query
def legal_passages(spark, sf_dir):
    return legal.split_passages(views.statutes(spark, sf_dir)).withColumn("cites", F.array_join("cites", ","))


@query
def citation_degree(spark, sf_dir):
    return legal.citation_degree(legal.split_passages(views.statutes(spark, sf_dir)))


def _retrieve(mode):
    def run(spark, sf_dir):
        passages = settled(legal.split_passages(views.statutes(spark, sf_dir)), "passages")
        return legal.retrieve(passages, views.text_queries(spark, sf_dir), mode)

    return run


def _retrieve_stored(mode):
    def run(spark, sf_dir):
        passages = legal.split_passages(views.statutes(spark, sf_dir))
        index = legal.build_legal_index(passages, fresh_path(spark, "legal"))
        return legal.retrieve_stored(index, views.text_queries(spark, sf_dir), mode)

    return run


for _mode in legal.MODES:
    QUERIES[f"legal_retrieval_{_mode}"] = _retrieve(_mode)
    QUERIES[f"legal_stored_{_mode}"] = _retrieve_stored(_mode)


# --- files ------------------------------------------------------------------------------------------------
@query
def corpus_from_files(spark, sf_dir):
    """A file for each document, some in sub-folders, written and read back as a corpus."""
    home = fresh_path(spark, "corpus")
    docs = views.text_table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("lang") == "en", "").otherwise(F.concat("lang", F.lit("/"))), F.col("doc_id").cast("string"), F.lit(".txt"))
    textfiles.write_texts(docs.select(name.alias("name"), F.translate("text", "\r", "").alias("text")), home)
    return texts.read_corpus(spark, home)


@query
def letters_as_files(spark, sf_dir):
    """Letters written as Markdown files, a file each, and read back."""
    home = fresh_path(spark, "letters")
    texts.write_letter_files(views.letters(spark, sf_dir), home)
    read = texts.read_letters(spark, home, "*.md")
    return read.select(F.regexp_extract("doc_id", r"([0-9]+)\.md$", 1).cast("bigint").alias("doc_id"), F.col("text").alias("markdown"))


@query
def stream_of_letters(spark, sf_dir):
    """Letters landed as files and read by a stream that reads each once."""
    home = fresh_path(spark, "letters")
    letters = views.letters(spark, sf_dir).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    textfiles.write_texts(letters, f"{home}/in")
    stream = textfiles.stream_texts(spark, f"{home}/in")
    number = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("bigint")
    formatted = office_action.formatted_letters(stream.select(number.alias("doc_id"), "text"))
    run = formatted.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint")
    with textfiles.many_small_files(spark):
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id bigint, markdown string").parquet(f"{home}/out")


@query
def ingest_landed_files(spark, sf_dir):
    """Pages that landed twice, the older copy with another name, through the library's reader: the latest is read."""
    home = fresh_path(spark, "landed")
    pages = views.detail_pages(spark, sf_dir)
    pages.withColumn("landed_at", F.to_timestamp(F.lit("2026-04-20 00:00:00"))).write.parquet(home)
    stale = pages.select("url", F.replace("markdown", F.lit("ark:"), F.lit("ark: old ")).alias("markdown"))
    stale.withColumn("landed_at", F.to_timestamp(F.lit("2026-04-19 00:00:00"))).write.mode("append").parquet(home)
    urls = views.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 100).alias("p_partkey"))
    parsed = ingest.ingest_urls(urls.select(F.expr(views.PAGE_URL).alias("url")), texts.read_landed_pages(spark, home))
    return parsed.select("raw_url", "application_number", "mark_name", "reject_reason", "requests")


@query
def export_json(spark, sf_dir):
    home = fresh_path(spark, "json")
    texts.write_json(views.register(spark, sf_dir).select("id", "mark_name", "nice_classes", "filing_date", F.expr("nullif(status, 'registered')").alias("status")), home)
    read = spark.read.schema("id string, mark_name string, nice_classes array<int>, filing_date string, status string").json(home)
    return read.withColumn("nice_classes", F.array_join("nice_classes", ","))


@query
def export_csv(spark, sf_dir):
    home = fresh_path(spark, "csv")
    texts.write_csv(views.register(spark, sf_dir).select("id", "mark_name", "nice_classes", "filing_date", "status"), home)
    return spark.read.schema("id string, mark_name string, nice_classes string, filing_date string, status string").option("header", "true").csv(home)


# --- encoding ---------------------------------------------------------------------------------------------
@query
def labelled_numbers(spark, sf_dir):
    """Every number behind a label, from the whole letter."""
    every = field_list(F.col("text"), r"[a-z]+: *([0-9]+)")
    return views.letters(spark, sf_dir).select("doc_id", F.array_join(every, "|").alias("numbers"))


@query
def encoder_inputs(spark, sf_dir):
    marks = views.register(spark, sf_dir)
    text = encoder_text(F.col("mark_name"), F.col("nice_classes"))
    return marks.select(
        "id", text.alias("encoder_text"), cache_key(F.lit("passage"), text).alias("cache_key")
    )


@query
def embed_cache_plan(spark, sf_dir):
    """Texts to encode when the cache already holds the marks of registered status."""
    marks = views.register(spark, sf_dir).withColumn("text", encoder_text(F.col("mark_name"), F.col("nice_classes")))
    held = marks.where("status = 'registered'").select(
        cache_key(F.lit("passage"), F.col("text")).alias("key"), F.lit("passage").alias("prefix"), "text"
    )
    return cache_plan(marks, held, "text")


@query
def embed_hashed(spark, sf_dir):
    docs = embed_column(views.text_table(spark, sf_dir, "documents"), "text", ngram_encoder(64))
    return (
        docs.select("doc_id", F.posexplode("text_vector").alias("dim", "x"))
        .where("x <> 0")
        .select("doc_id", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("x").cast("double"), 4).alias("x"))
    )


@query
def embed_with_cache(spark, sf_dir):
    path = fresh_path(spark, "embed-cache")
    marks = views.register(spark, sf_dir)
    fill_cache(marks.where("status = 'registered'"), path, "mark_name", ngram_encoder(64))
    return _numbers(cached_vectors(marks, path, "mark_name", ngram_encoder(64)))


def _numbers(marks: DataFrame) -> DataFrame:
    """The numbers of the vectors that are not zero."""
    each = marks.select("id", "mark_name", F.posexplode("text_vector").alias("dim", "x")).where("x <> 0")
    return each.select("id", "mark_name", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("x").cast("double"), 4).alias("x"))


@query
def embed_marks(spark, sf_dir):
    """Every mark with its classes, as the register stores its vector."""
    return _numbers(marks_with_vectors(views.register(spark, sf_dir), ngram_encoder(64)))


@query
def embed_one(spark, sf_dir):
    """The longest mark name as a query, alone."""
    longest = views.register(spark, sf_dir).orderBy(F.length("mark_name").desc(), "mark_name").select("mark_name").first()[0]
    one = encode_one(spark, longest, ngram_encoder(64), is_query=True)
    each = one.select(F.posexplode("vector").alias("dim", "x")).where("x <> 0")
    return each.select(F.col("dim").cast("bigint").alias("dim"), rounded(F.col("x").cast("double"), 4).alias("x"))


@query
def ingest_with_vectors(spark, sf_dir):
    """Detail pages read, encoded through the cache and put into a register that holds half of their numbers."""
    base = conform(views.register(spark, sf_dir).where("p_partkey % 2 = 0"))
    parsed = ingest.parse_detail_pages(views.detail_pages(spark, sf_dir))
    path = fresh_path(spark, "embed-cache")
    stored = ingest.ingest_with_vectors(base, parsed, path, ngram_encoder(64))
    return stored.select(
        "application_number", "mark_name", "status", F.size("text_vector").cast("bigint").alias("numbers"),
        F.size(F.filter("text_vector", lambda x: x != 0)).cast("bigint").alias("not_zero"),
    )


# --- stream -----------------------------------------------------------------------------------------------
def _watched(spark, sf_dir, home, register=None):
    part = views.table(spark, sf_dir, "part")
    landed = watch.stream_pages(spark, sf_dir, part.schema, name_pattern="part.parquet").select(
        F.col("p_partkey").alias("page_id"),
        F.expr(views.BULLETIN_HTML).alias("html"),
        F.expr("timestamp '2026-04-20 00:00:00'").alias("landed_at"),
    )
    items = watch.first_items(watch.stream_items(landed))
    run = watch.watch_register(
        items, f"{home}/changes", f"{home}/checkpoint", register=register, known_path=f"{home}/known"
    )
    run.awaitTermination()
    return read_changes(spark, f"{home}/changes")


@query
def watch_stream(spark, sf_dir):
    """The part table as a stream of landed bulletin pages, written as change batches of the register."""
    changes = _watched(spark, sf_dir, fresh_path(spark, "watch"))
    return changes.select("application_number", "mark_name", "status", "source")


@query
def watch_stream_into_register(spark, sf_dir):
    """The same stream over a register that has half of the numbers: full records stay as they are."""
    home = fresh_path(spark, "watch")
    create_register(spark, f"{home}/register")
    append_records(views.register(spark, sf_dir), f"{home}/register")
    changes = _watched(spark, sf_dir, home, lambda: open_register(spark, f"{home}/register"))
    current = current_register(open_register(spark, f"{home}/register"), changes)
    return current.select(
        "application_number", "mark_name", "status", "filing_date", F.array_join("nice_classes", ",").alias("nice_classes")
    )
