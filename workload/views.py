"""Views derived from the given tables: a register, candidates, pages, letters and statutes.

Text-building expressions are written once, in SQL that Spark and the checking database both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emblema.session import spread

# --- expressions shared by both engines --------------------------------------------------------------
NUMBER = "lpad(CAST(p_partkey AS VARCHAR(20)), 9, '0')"
STATUS = (
    "CASE p_partkey % 8 WHEN 0 THEN 'application' WHEN 1 THEN 'published' WHEN 2 THEN 'registered' "
    "WHEN 3 THEN 'opposed' WHEN 4 THEN 'refused' WHEN 5 THEN 'withdrawn' WHEN 6 THEN 'expired' ELSE 'registered' END"
)
CANDIDATE_NAME = "replace(p_name, 'i', 'y')"


def two_digits(number: str) -> str:
    return f"lpad(CAST({number} AS VARCHAR(2)), 2, '0')"


PAGE_DAY = f"{two_digits('p_size % 28 + 1')}"
PAGE_MONTH = f"{two_digits('p_partkey % 12 + 1')}"
PAGE_DATE = f"{PAGE_DAY} || '/' || {PAGE_MONTH} || '/20' || {two_digits('p_size % 25')}"
PAGE_ISO = f"'20' || {two_digits('p_size % 25')} || '-' || {PAGE_MONTH} || '-' || {PAGE_DAY}"
PAGE_STATUS = (
    "CASE p_partkey % 7 WHEN 0 THEN 'Registered' WHEN 1 THEN 'Application published' WHEN 2 THEN 'Surrendered' "
    "WHEN 3 THEN 'Filed' WHEN 4 THEN 'Opposed, pending' WHEN 5 THEN 'REGISTRATION expired' ELSE 'Unknown' END"
)
PAGE_COUNTRY = "CASE p_size % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' ELSE 'it' END"
NL = "chr(10)"

# A detail page in Markdown: label variants, bold and plain, and pages without a number or a name.
MARKDOWN = (
    f"'# Trade mark details' || {NL} || "
    f"CASE p_partkey % 3 WHEN 0 THEN '**Mark name:** ' WHEN 1 THEN 'Trade mark: ' ELSE '**Mark:** ' END || "
    f"CASE WHEN p_size = 3 THEN '' ELSE p_name END || ' ' || {NL} || {NL} || "
    f"CASE WHEN p_size = 7 THEN 'Number: ' WHEN p_size > 25 THEN '**Application number:** ' ELSE 'App. No.: ' END || {NUMBER} || {NL} || "
    f"CASE WHEN p_size > 40 THEN 'Reg. No.: 7' || {NUMBER} || {NL} ELSE '' END || "
    f"'**Filing date:** ' || {PAGE_DATE} || {NL} || "
    f"'Nice classes: ' || CAST(p_size AS VARCHAR(5)) || ', ' || CAST(p_partkey % 45 + 1 AS VARCHAR(5)) || ', 0' || {NL} || "
    f"'Holder: ' || p_brand || {NL} || 'Origin: ' || {PAGE_COUNTRY} || {NL} || "
    f"'Status: ' || {PAGE_STATUS} || {NL} || "
    f"'List of goods: ' || p_name || ' ; ;' || p_type || {NL}"
)
PAGE_URL = f"'https://register.example/trademarks/' || {NUMBER}"

SECOND_NUMBER = "'9' || lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0')"


def item_html(number: str, name: str) -> str:
    """One bulletin item; the form depends on p_size."""
    return (
        "CASE p_size % 8 "
        f"WHEN 0 THEN '<div class=\"bulletin-item\"><a href=\"/eSearch/trademarks/' || {number} || '\">Application No. ' || {number} || ' - ' || {name} || '</a><time datetime=\"' || {PAGE_ISO} || '\">day</time></div>' "
        f"WHEN 1 THEN '<div class=\"row search-result-item\"><a href=\"https://office.example/trademarks/' || {number} || '\">App. No: ' || {number} || ' : ' || {name} || '</a><span class=\"date\">' || {PAGE_ISO} || '</span></div>' "
        f"WHEN 2 THEN '<p class=\"result-item\"><a href=\"/d\">' || {number} || ' ' || {name} || '</a><b class=\"published-date\"> ' || {PAGE_ISO} || '</b></p>' "
        f"WHEN 3 THEN '<section data-testid=\"bulletin-item\"><a href=\"/trademarks/' || {number} || '\"><b>' || {name} || '</b></a><i data-date=\"' || {PAGE_ISO} || '\"></i></section>' "
        f"WHEN 4 THEN '<li class=\"bulletin-entry\"><a href=\"/x\">Application No ' || {number} || '</a></li>' "
        f"WHEN 5 THEN '<tr class=\"bulletin-row\"><td><a href=\"/trademarks/' || {number} || '\"></a></td><td class=\"bulletin-date\">' || {PAGE_ISO} || '</td></tr>' "
        f"WHEN 6 THEN '<p><a href=\"/bulletin/' || {number} || '\">' || {number} || ' ' || {name} || '</a></p>' "
        "ELSE '' END"
    )


BULLETIN_HTML = (
    "'<html><body><!-- <a href=\"/bulletin/hidden\">hidden</a> --><nav><a href=\"/home\">Home</a></nav><ul>' || "
    f"{item_html(NUMBER, 'p_name')} || {item_html(SECOND_NUMBER, 'lower(p_type)')} || "
    "'</ul><footer><a href=\"/about\">About</a></footer></body></html>'"
)

# An item within an item: the outer one's date stands after the inner one.
NESTED_HTML = (
    f"'<ul><li class=\"bulletin-item\"><a href=\"/trademarks/' || {NUMBER} || '\">' || {NUMBER} || ' ' || p_name || '</a>"
    f"<ul><li class=\"bulletin-item sub\"><a href=\"/trademarks/' || {SECOND_NUMBER} || '\">' || {SECOND_NUMBER} || ' ' || lower(p_type) || '</a></li></ul>"
    f"<time datetime=\"' || {PAGE_ISO} || '\">day</time><a href=\"/more\">More</a></li></ul><p>end</p>'"
)

LETTER_NUMBER = "lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '0')"
ORDER_DATE = (
    f"{two_digits('day(o_orderdate)')} || '/' || {two_digits('month(o_orderdate)')} || '/' || CAST(year(o_orderdate) AS VARCHAR(4))"
)
DEADLINE = (
    f"CASE WHEN o_orderpriority = '1-URGENT' THEN '31/02/' ELSE '20/07/' END || CAST(year(o_orderdate) + 1 AS VARCHAR(4))"
)
# An office-action letter; grounds depend on status and priority.
LETTER = (
    f"{NL} || 'EUROPEAN UNION INTELLECTUAL PROPERTY OFFICE' || {NL} || {NL} || 'Application Number: ' || {LETTER_NUMBER} || {NL} || "
    f"'Trade Mark: Mark-' || CAST(o_custkey AS VARCHAR(20)) || '  ' || {NL} || 'Applicant: Customer ' || CAST(o_custkey AS VARCHAR(20)) || {NL} || "
    f"'Filing Date: ' || {ORDER_DATE} || {NL} || {NL} || "
    f"CASE o_orderstatus WHEN 'F' THEN 'Article 7(1)(b) EUTMR: distinctive character' WHEN 'O' THEN 'Art. 7(1)(c) EUTMR: descriptive sign' ELSE 'Article 8(1)(b) EUTMR: earlier mark' END || {NL} || "
    f"'The sign is objectionable under Article 7(1)(b) as well, see Guidelines, Part B, Section 4' || "
    f"CASE WHEN o_totalprice > 200000 THEN ' and decision R ' || CAST(o_orderkey % 9000 AS VARCHAR(5)) || '/2020-1.' ELSE '.' END || {NL} || "
    f"CASE WHEN o_orderpriority = '2-HIGH' THEN 'Art. 8(5) is invoked.' || {NL} ELSE '' END || "
    f"CASE WHEN o_orderkey % 5 = 0 THEN 'See Articles 7(1)(d), 8 (4) and 7(1)(b), Art 7 (1) (g) and Article 94(1).' || {NL} ELSE '' END || "
    f"'DEADLINE FOR RESPONSE: ' || {DEADLINE} || {NL}"
)


# --- Spark side -----------------------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are read at length: over all cores even if it is one small file."""
    return spread(table(spark, sf_dir, name))


def classes():
    return F.expr("array_sort(array_distinct(array(CAST(p_size % 45 + 1 AS INT), CAST(p_partkey % 45 + 1 AS INT))))")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    return part.join(nation, nation.n_nationkey == part.p_partkey % 25).select(
        F.expr("concat('p', CAST(p_partkey AS VARCHAR(20)))").alias("id"),
        F.expr(NUMBER).alias("application_number"),
        F.col("p_name").alias("mark_name"),
        classes().alias("nice_classes"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("goods_text"),
        F.col("p_brand").alias("applicant_name"),
        F.col("n_name").alias("applicant_country"),
        F.date_format(F.expr("date_add(DATE '2018-01-01', CAST(p_partkey % 3000 AS INT))"), "yyyy-MM-dd").alias(
            "filing_date"
        ),
        F.expr(STATUS).alias("status"),
        "p_partkey",
    )


def vector_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows with their vector; most have none."""
    vectors = table(spark, sf_dir, "embeddings")
    marks = register(spark, sf_dir)
    return marks.join(vectors, vectors.vec_id == marks.p_partkey, "left").withColumnRenamed("embedding", "text_vector").drop(
        "p_partkey", "vec_id"
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per benchmark item: a register name in another spelling, with its classes and vector."""
    items = table(spark, sf_dir, "benchmark")
    part, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings")
    return (
        items.join(part, part.p_partkey == items.item_id)
        .join(vectors, vectors.vec_id == items.item_id)
        .select(
            F.col("item_id").alias("query_id"),
            F.expr(CANDIDATE_NAME).alias("candidate_name"),
            classes().alias("candidate_classes"),
            F.col("embedding").alias("query_vector"),
        )
    )


def bare_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates, of which some lack a vector, some have one of another size and some one of zeros."""
    vector = F.col("query_vector")
    form = F.col("query_id") % 7
    changed = F.when(form == 3, None).when(form == 4, F.slice(vector, 1, 3)).when(form == 5, F.transform(vector, lambda x: x * 0))
    return candidates(spark, sf_dir).withColumn("query_vector", F.when(form.isin(3, 4, 5), changed).otherwise(vector))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return items.join(vectors, vectors.vec_id == items.item_id).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), F.col("embedding").alias("query_vector")
    )


def word_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark per document: the longest word of the whole text, and the alphabetically last one beside it."""
    lettered = text_table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\p{L}"))
    runs = lettered.select(
        "doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("runs")
    )
    by_length = F.transform("runs", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return runs.select(
        "doc_id", F.array_max(by_length)["w"].alias("mark_name"), F.array_max("runs").alias("other_name")
    )


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "part").select(F.expr(PAGE_URL).alias("url"), F.expr(MARKDOWN).alias("markdown"))


def bulletin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(BULLETIN_HTML).alias("html"))


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(NESTED_HTML).alias("html"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(LETTER).alias("text"))


def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article per document; each line of the text is a numbered paragraph that refers to another article."""
    numbered = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". "),
            line,
            F.lit(" See Article "),
            ((F.col("doc_id") + i + 1) % 97 + 1).cast("string"),
        ),
    )
    return text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source"),
        F.concat(
            F.lit("Article "),
            (F.col("doc_id") % 97 + 1).cast("string"),
            F.lit(" - "),
            F.col("source"),
            F.lit("\n\n"),
            F.array_join(numbered, "\n"),
        ).alias("text"),
    )


