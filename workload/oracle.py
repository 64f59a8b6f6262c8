"""SQL that gives the same rows as the registered queries, for the checking database."""

from __future__ import annotations

from . import views

# Written out here, not taken from the library, so that an error in its lists shows.
TRANSLITERATION = dict(zip("äöüßéèêëàâçñ", "ae oe ue ss e e e e a a c n".split(), strict=True))
DESCRIPTIVE_TERMS = "solar eco green smart digital cloud fast".split()
STATUS_WORDING = (
    "registered application published opposed refused withdrawn expired surrendered registration=registered filed=application"
).split()
LABELS = {
    "7(1)(b)": "Devoid of distinctive character", "7(1)(c)": "Descriptive sign", "7(1)(d)": "Customary in the trade",
    "7(1)(g)": "Deceptive sign", "8(1)(b)": "Likelihood of confusion",
    "8(4)": "Earlier sign used in the course of trade", "8(5)": "Earlier mark with a reputation",
}

_CLASSES = "list_sort(list_distinct([CAST(p_size % 45 + 1 AS INT), CAST(p_partkey % 45 + 1 AS INT)]))"

REGISTER = f"""register AS (
  SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS id, {views.NUMBER} AS application_number, p_name AS mark_name,
         {_CLASSES} AS nice_classes, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS goods_text,
         p_brand AS applicant_name, n_name AS applicant_country,
         CAST(DATE '2018-01-01' + CAST(p_partkey % 3000 AS INT) AS VARCHAR) AS filing_date, {views.STATUS} AS status,
         p_partkey
  FROM part JOIN nation ON n_nationkey = p_partkey % 25)"""
VECTOR_REGISTER = "vreg AS (SELECT register.*, embedding AS v FROM register JOIN embeddings ON vec_id = p_partkey)"
CANDIDATES = f"""cand AS (
  SELECT item_id AS query_id, {views.CANDIDATE_NAME} AS candidate_name, {_CLASSES} AS candidate_classes, embedding AS qv
  FROM benchmark JOIN part ON p_partkey = item_id JOIN embeddings ON vec_id = item_id)"""
WORD_MARKS = r"""words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
wm AS (
  SELECT doc_id, list_max(list_transform(w, lambda x: struct_pack(n := length(x), w := x))).w AS mark_name,
         list_max(w) AS other_name
  FROM words WHERE len(w) > 0)"""


def transliterated(name: str) -> str:
    out = f"lower({name})"
    for letter, plain in TRANSLITERATION.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return out


def sound_key(name: str) -> str:
    return rf"regexp_replace({transliterated(f'trim({name})')}, '[^\p{{L}}\p{{N}}]', '', 'g')"


def sound(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE len(list_filter(range(1, least(length({a}), length({b})) + 1), "
        f"lambda i: {a}[i] = {b}[i]))::DOUBLE / greatest(length({a}), length({b})) END"
    )


def visual(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


FLAT = """SELECT id, application_number, mark_name, array_to_string(nice_classes, ',') AS nice_classes, applicant_name,
 applicant_country, filing_date, status FROM register"""


def register_rows(where: str, tail: str = "") -> str:
    return f"WITH {REGISTER} {FLAT} WHERE {where} {tail}"


COSINE = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
ASKED = "asked AS (SELECT item_id AS query_id, text AS query_text, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id)"


def ranked(source: str, asked: str, item: str, keep: str, k: int, vector: str = "embedding", where: str = "TRUE") -> str:
    """CTE ``hits``: top k of ``source`` per query by cosine."""
    return f"""scored AS (
  SELECT query_id, {keep}, {item} AS _item, round({COSINE.format(a=vector, b='qv')}, 4) AS s FROM {source}, {asked} WHERE {where}),
hits AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, _item) AS INT) AS rank FROM scored)
  WHERE rank <= {k})"""


def knn(where: str = "TRUE", after: str = "TRUE") -> str:
    return f"""WITH {ASKED}, {ranked('embeddings', 'asked', 'vec_id', 'vec_id, label', 10, where=where)}
SELECT query_id, vec_id, label, s AS similarity_score, rank FROM hits WHERE {after}"""


def bm25(docs: str, queries: str, k: int, prefix: str = "", item: str = "id") -> str:
    """CTEs ``<prefix>hits`` (qid, id, score, rank) from CTEs docs(id, text) and queries(qid, qtext)."""
    p = prefix
    return rf"""{p}tok AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {docs}),
{p}qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(qtext), '[\p{{L}}\p{{N}}]+')) AS term FROM {queries}),
{p}one AS (SELECT id, len(w) AS n, unnest(w) AS term FROM {p}tok),
{p}tf AS (SELECT id, n, term, count(*) AS tf FROM {p}one WHERE term IN (SELECT term FROM {p}qt) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}c AS (SELECT count(*)::DOUBLE AS total, sum(len(w))::DOUBLE / count(*) AS mean FROM {p}tok),
{p}sc AS (
  SELECT qid, id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 4) AS score
  FROM {p}tf JOIN {p}df USING (term) JOIN {p}qt USING (term), {p}c GROUP BY qid, id),
{p}hits AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INT) AS rank FROM {p}sc) WHERE rank <= {k})"""


TEXT_QUERIES = "queries AS (SELECT item_id AS qid, text AS qtext FROM benchmark)"

# by query_id: no vector, one of another size, one of zeros
UNSEARCHED = """CASE query_id % 7 WHEN 3 THEN 'no vector' WHEN 4 THEN 'vector of another size' WHEN 5 THEN 'vector of length zero' END"""


def report(asked: str, searched: str) -> str:
    return f"""{REGISTER}, {VECTOR_REGISTER}, {asked},
{ranked('vreg', 'cand', 'id', 'id, application_number, mark_name, status, applicant_name, applicant_country, candidate_name', 10, 'v', searched)},
keyed AS (SELECT *, {sound_key('candidate_name')} AS a, {sound_key('mark_name')} AS b FROM hits),
compared AS (SELECT *, {sound('a', 'b')} AS snd, {visual('a', 'b')} AS vis FROM keyed),
full_report AS (
  SELECT query_id, candidate_name, rank, id, application_number, mark_name, status, applicant_name, applicant_country,
    s AS semantic, round(snd, 4) AS sound, round(vis, 4) AS visual, round(0.5::DOUBLE * s + 0.5::DOUBLE * snd, 4) AS overall,
    CASE WHEN 0.5::DOUBLE * s + 0.5::DOUBLE * snd > 0.80::DOUBLE THEN 'HIGH'
         WHEN 0.5::DOUBLE * s + 0.5::DOUBLE * snd > 0.65::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM compared),
report AS (SELECT * FROM full_report WHERE mark_name <> candidate_name)"""


_ASKED = CANDIDATES.replace("embedding AS qv", "embedding AS qv, NULL AS not_searched")
_BARE = CANDIDATES.replace("embedding AS qv", f"embedding AS qv, {UNSEARCHED.replace('query_id', 'item_id')} AS not_searched")
REPORT, REPORT_BARE = report(_ASKED, "TRUE"), report(_BARE, "not_searched IS NULL")


def identical(source: str) -> str:
    return f"""same AS (
  SELECT query_id, candidate_name,
    (SELECT count(*) FROM {source} r WHERE r.mark_name = candidate_name) AS identical_count,
    (SELECT count(DISTINCT c) FROM (SELECT unnest(candidate_classes) AS c) WHERE c IN (
       SELECT unnest(nice_classes) FROM {source} r WHERE r.mark_name = candidate_name AND r.status = 'registered')) AS clashing_classes
  FROM cand)"""


_TERMS = "[" + ", ".join(f"'{t}'" for t in DESCRIPTIVE_TERMS) + "]"


def grounds(source: str, key: str, terms: str) -> str:
    return f"""SELECT {key}, candidate_name, '7(1)(c)' AS ground_code, term FROM (
  SELECT *, unnest({terms}) AS term FROM {source}) WHERE contains(lower(candidate_name), term)
UNION ALL SELECT {key}, candidate_name, '7(1)(b)', '' FROM {source} WHERE length(candidate_name) <= 3"""


SUMMARY = f"""{identical('register')},
pairs AS (
  SELECT query_id, count(*) AS similar_count, count(*) FILTER (risk = 'HIGH') AS high_count, max(overall) AS top_overall,
    arg_max(mark_name, overall * 100000000 - rank) AS top_conflict,
    max(CASE risk WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS level FROM report GROUP BY query_id)
SELECT query_id, same.candidate_name, CASE WHEN not_searched IS NULL THEN coalesce(similar_count, 0) END AS similar_count,
  CASE WHEN not_searched IS NULL THEN coalesce(high_count, 0) END AS high_count, top_conflict, top_overall,
  identical_count, clashing_classes, len(list_filter({_TERMS}, lambda t: contains(lower(same.candidate_name), t))) > 0 AS descriptive,
  length(same.candidate_name) <= 3 AS short_mark, not_searched,
  CASE WHEN clashing_classes > 0 THEN 'CRITICAL' WHEN not_searched IS NOT NULL THEN 'NOT SEARCHED'
    ELSE ['LOW', 'MEDIUM', 'HIGH'][coalesce(level, 0) + 1] END AS risk_level
FROM same JOIN cand USING (query_id) LEFT JOIN pairs USING (query_id)"""


def status_of(text: str) -> str:
    pairs = (w.split("=") for w in STATUS_WORDING)
    cases = " ".join(f"WHEN contains(lower({text}), '{w[0]}') THEN '{w[-1]}'" for w in pairs)
    return f"CASE {cases} ELSE 'application' END"


_NAME = "CASE WHEN p_size = 3 THEN '' ELSE trim(p_name) END"
PARSED = f"""parsed AS (
  SELECT CASE WHEN p_size = 7 THEN sha256('euipo:') ELSE sha256('euipo:' || {views.NUMBER}) END AS id,
    CASE WHEN p_size = 7 THEN '' ELSE {views.NUMBER} END AS application_number,
    CASE WHEN p_size > 40 THEN '7' || {views.NUMBER} END AS registration_number,
    CASE WHEN p_size = 3 THEN '' ELSE p_name END AS mark_name,
    'word' AS mark_type,
    array_to_string(list_filter([CAST(p_size AS INT), CAST(p_partkey % 45 + 1 AS INT), 0], lambda c: c BETWEEN 1 AND 45), ',') AS nice_classes,
    p_name || '|' || p_type AS goods_services, p_brand AS applicant_name, {views.PAGE_COUNTRY} AS applicant_country,
    {views.PAGE_ISO} AS filing_date, {status_of(views.PAGE_STATUS)} AS status, 'EU' AS jurisdiction, 'euipo' AS source,
    {views.PAGE_URL} AS raw_url, '2026-04-20T00:00:00' AS scraped_at,
    CASE p_size WHEN 7 THEN 'missing application_number' WHEN 3 THEN 'missing mark_name' END AS reject_reason
  FROM part)"""

CHANGES = """changes AS (
  SELECT concat('l', CAST(l_partkey * 2 AS VARCHAR)) AS id, lpad(CAST(l_partkey * 2 AS VARCHAR), 9, '0') AS application_number,
    concat('mark ', CAST(l_orderkey AS VARCHAR)) AS mark_name,
    CASE l_returnflag WHEN 'R' THEN 'refused' WHEN 'A' THEN 'registered' ELSE 'published' END AS status,
    l_shipdate, l_orderkey, l_linenumber FROM lineitem)"""

_ANCHORS = r"""links AS (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
    '(?is)<a\s[^>]*>.*?</a>') AS a FROM pages),
each_link AS (SELECT page_id, unnest(a) AS a, generate_subscripts(a, 1) - 1 AS position FROM links)"""


def _decoded(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


def items() -> str:
    """Bulletin items as the pages were built: two per page, their fields by form."""
    one = """SELECT p_partkey AS page_id, {pos} AS position, p_size % 8 AS form, {num} AS num, {name} AS name, {iso} AS iso FROM part WHERE p_size % 8 <> 7"""
    first = one.format(pos=0, num=views.NUMBER, name="p_name", iso=views.PAGE_ISO)
    second = one.format(pos=1, num=views.SECOND_NUMBER, name="lower(p_type)", iso=views.PAGE_ISO)
    host = "'https://euipo.europa.eu'"
    return f"""raw AS ({first} UNION ALL {second}),
items AS (
  SELECT page_id, CAST(position AS BIGINT) AS position,
    CASE form WHEN 0 THEN 'Application No. ' || num || ' - ' || name WHEN 1 THEN 'App. No: ' || num || ' : ' || name
      WHEN 2 THEN num || ' ' || name WHEN 3 THEN name WHEN 4 THEN 'Application No ' || num WHEN 5 THEN ''
      ELSE num || ' ' || name END AS title,
    num AS application_number,
    CASE form WHEN 4 THEN 'Application No ' || num WHEN 5 THEN 'Unknown Mark' ELSE name END AS mark_name,
    CASE form WHEN 0 THEN {host} || '/eSearch/trademarks/' || num WHEN 1 THEN 'https://office.example/trademarks/' || num
      WHEN 2 THEN {host} || '/d' WHEN 4 THEN {host} || '/x' WHEN 6 THEN {host} || '/bulletin/' || num
      ELSE {host} || '/trademarks/' || num END AS url,
    CASE WHEN form NOT IN (4, 6) THEN iso END AS bulletin_date
  FROM raw)"""


LETTERS = f"letters AS (SELECT o_orderkey AS doc_id, {views.LETTER} AS text, o_orderdate, o_orderpriority FROM orders)"

_TITLE_CASE = r"""array_to_string(list_transform(range(1, length(l) + 1), lambda i:
  CASE WHEN i > 1 AND regexp_matches(l[i - 1], '[\p{Lu}\p{Ll}\p{Lt}]') THEN lower(l[i]) ELSE upper(l[i]) END), '')"""


def formatted(source: str, key: str) -> str:
    return rf"""WITH lines AS (
  SELECT {key}, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
stripped AS (SELECT {key}, i, regexp_replace(raw, '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g') AS l FROM lines),
done AS (SELECT {key}, i, CASE
    WHEN regexp_matches(l, '\p{{Lu}}') AND NOT regexp_matches(l, '[\p{{Ll}}\p{{Lt}}]') AND length(l) < 100 THEN '## ' || {_TITLE_CASE}
    WHEN l LIKE 'Article%' OR l LIKE 'Art.%' OR l LIKE 'Section%' THEN '**' || l || '**' ELSE l END AS l FROM stripped)
SELECT {key}, string_agg(l, chr(10) ORDER BY i) AS markdown FROM done GROUP BY {key}"""


_REF = r"\d+(?:\s*\(\d+\))?(?:\s*\([a-z]\))?"
_MENTION = rf"\bArticles\s*{_REF}(?:\s*(?:,\s*and|,\s*or|,|and|or|&)\s*{_REF})*|\b(?:Article|Art\.?)\s*{_REF}"
CODES = f"""mentions AS (
  SELECT doc_id, unnest(m) AS mention, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_MENTION}') AS m FROM letters)),
refs AS (
  SELECT doc_id, replace(unnest(r), ' ', '') AS ref, i * 1000 + generate_subscripts(r, 1) AS spot FROM (
    SELECT doc_id, i, regexp_extract_all(mention, '{_REF}') AS r FROM mentions)),
codes AS (SELECT doc_id, ref AS code, min(spot) AS first FROM refs WHERE ref LIKE '7(%' OR ref LIKE '8(%' GROUP BY doc_id, ref)"""
TYPES = "types(code, label) AS (VALUES " + ", ".join(f"('{c}', '{l}')" for c, l in LABELS.items()) + ")"
CITED = rf"""cited AS (
  SELECT doc_id, 'Article ' || ref AS citation FROM refs
  UNION SELECT doc_id, unnest(regexp_extract_all(text, '(Part\s+[A-Z],\s*Section\s+\d+)', 1)) FROM letters
  UNION SELECT doc_id, unnest(regexp_extract_all(text, '\b(R\s\d{{1,4}}/\d{{4}}-\d)\b', 1)) FROM letters)"""
HEADER = f"""{views.LETTER_NUMBER} AS application_number, 'Mark-' || CAST(o_custkey AS VARCHAR) AS mark_name,
  'Customer ' || CAST(o_custkey AS VARCHAR) AS applicant_name"""

PASSAGES = """paras AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
passages AS (
  SELECT doc_id::VARCHAR || '#0#' || i AS passage_id, doc_id::VARCHAR AS source, CAST(doc_id % 97 + 1 AS INT) AS article,
    'Article ' || (doc_id % 97 + 1) || ' - ' || source AS heading, CAST(i AS INT) AS paragraph,
    i || '. ' || line || ' See Article ' || ((doc_id + i) % 97 + 1) AS text,
    CAST((doc_id + i) % 97 + 1 AS INT) AS cite
  FROM paras)"""
RETRIEVAL = f"""{PASSAGES}, pdocs AS (SELECT passage_id AS id, text FROM passages), {TEXT_QUERIES}"""
SEEDS = f"""{RETRIEVAL}, {bm25('pdocs', 'queries', 50)},
related AS (SELECT passage_id, unnest(list_distinct([article, cite])) AS art FROM passages),
weights AS (SELECT qid, art, count(*) AS w FROM hits JOIN related ON id = passage_id GROUP BY qid, art),
lscore AS (SELECT qid, passage_id, sum(w)::DOUBLE AS score FROM weights JOIN related USING (art) GROUP BY qid, passage_id),
lrank AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage_id) AS INT) AS rank FROM lscore),
degree AS (SELECT cite AS article, count(*) AS cited_by FROM passages GROUP BY cite),
gscore AS (
  SELECT qid, passage_id, coalesce(cited_by, 0)::DOUBLE AS score, rank AS r
  FROM hits JOIN passages ON id = passage_id LEFT JOIN degree USING (article)),
grank AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, r) AS INT) AS rank FROM gscore)"""

ENCODER_TEXT = "mark_name || ' | ' || array_to_string(list_transform(list_sort(nice_classes), lambda c: 'Class ' || c), ', ')"




def ngram_vector(text: str) -> str:
    """SQL for the stand-in encoder: hashed character trigrams, unit length, single precision."""
    return f"""(SELECT list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT) FROM (
  SELECT list_transform(range(0, 64), lambda d: len(list_filter(g, lambda x: x = d))::DOUBLE) AS v FROM (
    SELECT list_transform(range(1, len(u) - 1), lambda i: (u[i] * 961 + u[i + 1] * 31 + u[i + 2]) % 64) AS g FROM (
      SELECT list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT) AS u))))"""


ALERTS = f"""{REGISTER}, {items()},
cn AS (SELECT name, {ngram_vector("'query: ' || name")} AS v FROM (SELECT DISTINCT mark_name AS name FROM items)),
mn AS (SELECT name, {ngram_vector("'passage: ' || name")} AS v FROM (SELECT DISTINCT mark_name AS name FROM register)),
names AS (
  SELECT cn.name AS candidate_name, mn.name AS mark_name, round({COSINE.format(a='cn.v', b='mn.v')}, 4) AS s,
    {sound_key('cn.name')} AS a, {sound_key('mn.name')} AS b FROM cn, mn),
pairs AS (
  SELECT items.application_number AS query_id, candidate_name, id, names.mark_name, s, a, b FROM items
  JOIN names ON candidate_name = items.mark_name JOIN register ON register.mark_name = names.mark_name),
best AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INT) AS rank FROM pairs)
  WHERE rank <= 10),
compared AS (SELECT *, {sound('a', 'b')} AS snd FROM best),
alerts AS (
  SELECT query_id, candidate_name, rank, id, mark_name, s AS semantic, round(snd, 4) AS sound,
    0.5::DOUBLE * s + 0.5::DOUBLE * snd AS o FROM compared)"""

ORACLE: dict[str, str] = {
    "search_text_like": register_rows("mark_name LIKE '%red%'"),
    "search_all_classes": register_rows("list_contains(nice_classes, 9) AND list_contains(nice_classes, 35)"),
    "search_any_class": register_rows("list_has_any(nice_classes, [9, 35, 37, 42])"),
    "search_contains_list": register_rows("list_has_all(nice_classes, [12, 20])"),
    "search_filters_combined": register_rows(
        "mark_name LIKE '%ring%' AND status = 'registered' AND applicant_country = 'NATION_7' AND filing_date >= '2019-06-01'"
    ),
    "search_in_list": register_rows("status IN ('registered', 'published')"),
    "search_where_clause": register_rows(
        "applicant_name LIKE '%#1%' AND status <> 'refused' AND filing_date < '2021-01-01'"
    ),
    "lookup_application_number": register_rows("application_number = '000000042'", "ORDER BY id LIMIT 1"),
    "hybrid_search_text": register_rows(
        "mark_name LIKE '%blue%' AND status = 'registered'", "ORDER BY application_number, id LIMIT 20"
    ),
    "knn_cosine_topk": knn(),
    "knn_prefilter": knn(where="label >= 6"),
    "knn_postfilter": knn(after="label >= 6"),
    "knn_cells_all_probed": knn(),
    "hybrid_search_vector_and_filter": f"""WITH {REGISTER}, {VECTOR_REGISTER},
m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
q AS (SELECT list(m ORDER BY i) AS qv FROM m)
SELECT id, application_number, mark_name, status, round({COSINE.format(a='v', b='qv')}, 4) AS similarity_score
FROM vreg, q WHERE status = 'registered' AND filing_date >= '2018-02-01' ORDER BY 5 DESC, id LIMIT 20""",
    "knn_mixed_sizes": f"""WITH {CANDIDATES}, asked AS (SELECT * FROM cand WHERE query_id % 7 NOT IN (3, 4, 5)),
{ranked('embeddings', 'asked', 'vec_id', 'vec_id', 5)}
SELECT query_id, vec_id, s AS similarity_score, rank, NULL AS reason FROM hits
UNION ALL SELECT query_id, NULL, NULL, NULL, {UNSEARCHED} FROM cand WHERE query_id % 7 IN (3, 4, 5)""",
    "image_search": f"""WITH {REGISTER}, {VECTOR_REGISTER}, {ASKED}, {ranked('vreg', 'asked', 'id', 'id, mark_name', 5, 'v')}
SELECT query_id, id, mark_name, s AS similarity_score, rank FROM hits""",
    "vector_norms": """SELECT vec_id, round(sqrt(d), 4) AS norm, round(d / sqrt(d), 4) AS unit_dot FROM (
SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS d FROM embeddings)""",
    "word_statistics": r"""WITH tok AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT term, count(*) AS texts, 0::BIGINT AS total_words FROM (SELECT unnest(list_distinct(w)) AS term FROM tok) GROUP BY term
UNION ALL SELECT '', count(*), sum(len(w))::BIGINT FROM tok""",
    "bm25_search": f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {TEXT_QUERIES}, {bm25('docs', 'queries', 10)}
SELECT qid AS query_id, id AS doc_id, score, rank FROM hits""",
    "rrf_fusion": f"""WITH {ASKED}, joined AS (SELECT * FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
{ranked('joined', 'asked', 'doc_id', 'doc_id', 50, where='embedding IS NOT NULL')},
docs AS (SELECT doc_id AS id, text FROM joined), queries AS (SELECT query_id AS qid, query_text AS qtext FROM asked),
{bm25('docs', 'queries', 50, 'l')},
votes AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS v FROM hits UNION ALL SELECT qid, id, 1.0::DOUBLE / (60 + rank) FROM lhits),
fused AS (SELECT query_id, doc_id, round(sum(v), 6) AS fused_score, count(*) AS lists FROM votes GROUP BY query_id, doc_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, doc_id) AS INT) AS rank FROM fused) WHERE rank <= 10""",
    "nice_recommend": f"""WITH {REGISTER}, {CANDIDATES}, docs AS (SELECT id, goods_text AS text FROM register),
queries AS (SELECT query_id AS qid, replace(candidate_name, 'y', 'i') AS qtext FROM cand), {bm25('docs', 'queries', 50)},
votes AS (SELECT qid, unnest(nice_classes) AS nice_class, score FROM hits JOIN register USING (id)),
total AS (SELECT qid AS query_id, nice_class, count(*) AS votes, round(sum(score), 4) AS weight FROM votes GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, nice_class) AS INT) AS rank FROM total) WHERE rank <= 5""",
    "sound_similarity": f"""WITH {WORD_MARKS}, k AS (SELECT *, {sound_key('mark_name')} AS a, {sound_key('other_name')} AS b FROM wm)
SELECT doc_id, mark_name, other_name, round({sound('a', 'b')}, 4) AS sound FROM k""",
    "transliterate_names": f"""WITH {WORD_MARKS} SELECT doc_id, {transliterated('mark_name')} AS transliterated, {sound_key('mark_name')} AS sound_key FROM wm""",
    "visual_similarity": f"""WITH {REGISTER}, k AS (SELECT id, {sound_key('mark_name')} AS a, {sound_key('goods_text')} AS b FROM register)
SELECT id, round({visual('a', 'b')}, 4) AS visual FROM k""",
    "similarity_bands": """SELECT p_partkey,
CASE WHEN s > 0.80::DOUBLE THEN 'HIGH' WHEN s > 0.65::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS pair_band,
CASE WHEN s > 0.85::DOUBLE THEN 'high' WHEN s > 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS demo_band
FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS s FROM part)""",
    "absolute_grounds": f"WITH {REGISTER}, m AS (SELECT id, mark_name AS candidate_name FROM register) "
    + grounds("m", "id", "['red', 'blue', 'ring', 'small']"),
    "absolute_grounds_words": f"WITH {WORD_MARKS}, m AS (SELECT doc_id, other_name AS candidate_name FROM wm) "
    + grounds("m", "doc_id", _TERMS),
    "clearance_report": f"WITH {REPORT} SELECT * FROM report",
    "clearance_report_identical": f"WITH {REPORT} SELECT * FROM full_report",
    "clearance_high_risk": f"WITH {REPORT} SELECT * FROM report WHERE risk = 'HIGH'",
    "clearance_summary": f"""WITH {REPORT}, {SUMMARY}""",
    "clearance_summary_unsearched": f"""WITH {REPORT_BARE}, {SUMMARY}""",
    "identical_conflicts": f"WITH {REGISTER}, {CANDIDATES}, {identical('register')} SELECT * FROM same",
    "register_stats": f"WITH {REGISTER} SELECT status, count(*) AS count, (SELECT count(*) FROM register) AS total_records FROM register GROUP BY status",
    "status_distribution": f"WITH {REGISTER} SELECT status, count(*) AS count FROM register GROUP BY status",
    "class_listing": f"WITH {REGISTER} SELECT unnest(nice_classes) AS nice_class, application_number, mark_name FROM register WHERE status = 'registered'",
    "class_counts": f"WITH {REGISTER} SELECT nice_class, count(*) AS registered_marks FROM (SELECT unnest(nice_classes) AS nice_class FROM register WHERE status = 'registered') GROUP BY nice_class",
    "parse_detail_page": f"WITH {PARSED} SELECT * FROM parsed",
    "normalise_status": f"SELECT p_partkey, {status_of(views.PAGE_STATUS)} AS status FROM part",
    "convert_dates": f"""SELECT p_partkey, iso, try_cast(iso AS DATE) AS day FROM (
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN (2000 + p_size) || '-02-31' ELSE {views.PAGE_ISO} END AS iso FROM part)""",
    "ingest_totals": f"WITH {PARSED} SELECT count(*) AS total, count(*) FILTER (reject_reason IS NULL) AS success, count(*) FILTER (reject_reason IS NOT NULL) AS failed FROM parsed",
    "ingest_urls": f"""WITH {PARSED}, u AS (
  SELECT {views.PAGE_URL} AS url, count(*) AS requests FROM (SELECT l_partkey + 100 AS p_partkey FROM lineitem) GROUP BY url)
SELECT url AS raw_url, requests, application_number, mark_name, CASE WHEN parsed.raw_url IS NULL THEN 'no page' ELSE reject_reason END AS reject_reason
FROM u LEFT JOIN parsed ON parsed.raw_url = url""",
    "upsert_register": f"""WITH {REGISTER}, {CHANGES}
SELECT id, application_number, mark_name, status FROM register WHERE application_number NOT IN (SELECT application_number FROM changes)
UNION ALL SELECT id, application_number, mark_name, status FROM (
  SELECT *, row_number() OVER (PARTITION BY application_number ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM changes) WHERE n = 1""",
    "upsert_null_keys": f"""WITH {REGISTER}, {CHANGES}, kept AS (SELECT * FROM changes WHERE l_orderkey % 5 <> 0)
SELECT id, application_number, mark_name, status, TRUE AS placed FROM register WHERE application_number NOT IN (SELECT application_number FROM kept)
UNION ALL SELECT id, application_number, mark_name, status, TRUE FROM (
  SELECT *, row_number() OVER (PARTITION BY application_number ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM kept) WHERE n = 1
UNION ALL SELECT id, NULL, mark_name, status, FALSE FROM changes WHERE l_orderkey % 5 = 0""",
    "delete_by_key": f"""WITH {REGISTER}, {CHANGES} SELECT id, application_number, mark_name, status FROM register
WHERE application_number NOT IN (SELECT application_number FROM changes WHERE status = 'refused' AND l_linenumber = 1)""",
    "delete_where": f"WITH {REGISTER} SELECT id, application_number, mark_name, status FROM register WHERE status NOT IN ('expired', 'withdrawn')",
    "extract_links": f"""WITH {_ANCHORS}
SELECT page_id, position, trim({_decoded("regexp_replace(a, '<[^>]*>', '', 'g')")}) AS title,
  {_decoded(r"regexp_extract(a, '(?is)^<a[^>]*?\shref\s*=\s*" + '"([^"]*)"' + "', 1)")} AS href FROM each_link""",
    "bulletin_links": f"""WITH {items()}
SELECT items.page_id, items.position, title, url FROM items JOIN raw USING (page_id, position)
WHERE form IN (0, 6) AND title <> '' """,
    "bulletin_items": f"WITH {items()} SELECT * FROM items",
    "bulletin_items_with_records": f"""WITH {REGISTER}, {items()}
SELECT page_id, position, items.application_number, id AS record_id, register.mark_name AS registered_name, status
FROM items LEFT JOIN register USING (application_number)""",
    "first_crawled": f"WITH {items()} SELECT page_id, position, application_number, mark_name FROM items ORDER BY page_id, position LIMIT 20",
    "bulletin_alerts": f"""WITH {ALERTS}
SELECT query_id, candidate_name, rank, id, mark_name, semantic, sound, round(o, 4) AS overall,
CASE WHEN o > 0.80::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM alerts WHERE o > 0.65::DOUBLE""",
    "search_json": f"""WITH {REGISTER} SELECT to_json(struct_pack(id := id, mark_name := mark_name, nice_classes := nice_classes,
filing_date := filing_date, status := status, note := nullif(status, 'registered')))::VARCHAR AS json FROM register WHERE list_has_any(nice_classes, [9, 42])""",
    "search_response": f"""WITH {REGISTER}, first AS (
  SELECT struct_pack(application_number := application_number, id := id, mark_name := mark_name, nice_classes := nice_classes) AS r
  FROM register WHERE status = 'opposed' ORDER BY application_number, id LIMIT 20)
SELECT to_json(struct_pack(success := true, count := count(*), results := list(r ORDER BY r)))::VARCHAR AS json FROM first""",
    "labelled_numbers": f"""WITH {LETTERS}
SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)[a-z]+: *([0-9]+)', 1), '|') AS numbers FROM letters""",
    "crawl_statistics": f"WITH {items()} SELECT 'euipo_bulletin' AS source, count(*) AS items, count(application_number) AS with_number FROM items",
    "letter_format": formatted("documents", "doc_id"),
    "letter_format_letters": formatted(f"(SELECT o_orderkey AS doc_id, {views.LETTER} AS text FROM orders)", "doc_id"),
    "page_stitch": r"""SELECT conv_id, 0::BIGINT AS part, string_agg('## Page ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text,
count(*) AS pages FROM conversations WHERE regexp_matches(text, '\S') GROUP BY conv_id""",
    "page_stitch_parts": r"""SELECT conv_id, turn // 3 AS part, string_agg('## Page ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text,
count(*) AS pages FROM conversations WHERE regexp_matches(text, '\S') GROUP BY conv_id, turn // 3""",
    "letter_header": f"""SELECT o_orderkey AS doc_id, {HEADER}, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, due AS response_deadline,
try_cast(due AS DATE) AS deadline_day FROM (
SELECT *, (year(o_orderdate) + 1) || CASE WHEN o_orderpriority = '1-URGENT' THEN '-02-31' ELSE '-07-20' END AS due FROM orders)""",
    "objections": f"""WITH {LETTERS}, {CODES}, {TYPES}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS position, code, label,
CASE WHEN code LIKE '7%' THEN 'absolute' ELSE 'relative' END AS kind FROM codes LEFT JOIN types USING (code)""",
    "citations": f"WITH {LETTERS}, {CODES}, {CITED} SELECT doc_id, citation FROM cited",
    "cited_articles": rf"""WITH {LETTERS}, {CODES}, {PASSAGES},
a AS (SELECT DISTINCT doc_id, CAST(regexp_extract(ref, '^\d+') AS INT) AS article FROM refs)
SELECT a.article, a.doc_id, heading, passages, first_passage FROM a LEFT JOIN
(SELECT article, arg_min(heading, passage_id) AS heading, count(*) AS passages, min(passage_id) AS first_passage FROM passages GROUP BY article) p ON p.article = a.article""",
    "article_index": f"""WITH {PASSAGES} SELECT article, arg_min(heading, passage_id) AS heading, count(*) AS passages, min(passage_id) AS first_passage
FROM passages GROUP BY article""",
    "structured_letters": rf"""WITH {LETTERS}, {CODES}, {CITED}
SELECT o_orderkey AS doc_id, {HEADER}, {views.ORDER_DATE} AS filing_date, {views.DEADLINE} AS response_deadline,
  (SELECT string_agg(code, '|' ORDER BY first) FROM codes WHERE codes.doc_id = o_orderkey) AS objections_found,
  (SELECT string_agg(citation, '|' ORDER BY citation) FROM cited WHERE cited.doc_id = o_orderkey) AS citations,
  'Part B, Section 4' AS guidelines,
  CASE WHEN o_totalprice > 200000 THEN 'R ' || o_orderkey % 9000 || '/2020-1' ELSE '' END AS decisions FROM orders""",
    "legal_passages": rf"""WITH {PASSAGES} SELECT passage_id, source, article, heading, paragraph,
regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, cite::VARCHAR AS cites FROM passages""",
    "citation_degree": f"WITH {PASSAGES} SELECT cite AS article, count(*) AS cited_by FROM passages GROUP BY cite",
    "legal_retrieval_naive": f"WITH {RETRIEVAL}, {bm25('pdocs', 'queries', 10)} SELECT qid AS query_id, id AS passage_id, score, rank FROM hits",
    "legal_retrieval_local": f"WITH {SEEDS} SELECT qid AS query_id, passage_id, score, rank FROM lrank WHERE rank <= 10",
    "legal_retrieval_global": f"WITH {SEEDS} SELECT qid AS query_id, passage_id, score, rank FROM grank WHERE rank <= 10",
    "legal_retrieval_hybrid": f"""WITH {SEEDS},
votes AS (SELECT qid, passage_id, 1.0::DOUBLE / (60 + rank) AS v FROM lrank WHERE rank <= 50 UNION ALL SELECT qid, passage_id, 1.0::DOUBLE / (60 + rank) FROM grank WHERE rank <= 50),
fused AS (SELECT qid AS query_id, passage_id, round(sum(v), 6) AS score FROM votes GROUP BY qid, passage_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS INT) AS rank FROM fused) WHERE rank <= 10""",
    "encoder_inputs": f"""WITH {REGISTER}, t AS (SELECT id, {ENCODER_TEXT} AS t FROM register)
SELECT id, t AS encoder_text, substr(sha256('passage:' || t), 1, 16) AS cache_key FROM t""",
    "embed_cache_plan": f"""WITH {REGISTER}, t AS (SELECT status, {ENCODER_TEXT} AS t FROM register)
SELECT DISTINCT substr(sha256('passage:' || t), 1, 16) AS key, 'passage' AS prefix, t AS text FROM t
WHERE t NOT IN (SELECT t FROM t WHERE status = 'registered')""",
    "embed_hashed": """WITH c AS (SELECT doc_id, list_transform(string_split('passage: ' || text, ''), lambda x: unicode(x)::BIGINT) AS u FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(u) - 1), lambda i: (u[i] * 961 + u[i + 1] * 31 + u[i + 2]) % 64)) AS dim FROM c),
n AS (SELECT doc_id, dim, count(*) AS n FROM g GROUP BY doc_id, dim),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM n GROUP BY doc_id)
SELECT doc_id, dim, round((n / l)::FLOAT::DOUBLE, 4) AS x FROM n JOIN l USING (doc_id)""",
    "embed_with_cache": f"""WITH {REGISTER}, n AS (SELECT DISTINCT mark_name FROM register),
e AS (SELECT mark_name, {ngram_vector("'passage: ' || mark_name")} AS v FROM n),
x AS (SELECT id, mark_name, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM register JOIN e USING (mark_name))
SELECT id, mark_name, dim, round(x::DOUBLE, 4) AS x FROM x WHERE x <> 0""",
    "ingest_with_vectors": f"""WITH {REGISTER}, {PARSED}, good AS (SELECT * FROM parsed WHERE reject_reason IS NULL),
texts AS (SELECT application_number AS n, mark_name || ' | ' || array_to_string(list_transform(list_sort(
  list_transform(string_split(nice_classes, ','), lambda c: CAST(c AS INT))), lambda c: 'Class ' || c), ', ') AS t FROM good),
grams AS (SELECT n, unnest(list_transform(range(1, length(u) - 1),
  lambda i: (unicode(u[i]) * 961 + unicode(u[i + 1]) * 31 + unicode(u[i + 2])) % 64)) AS g FROM (SELECT n, 'passage: ' || t AS u FROM texts))
SELECT application_number, mark_name, status, 64::BIGINT AS numbers, (SELECT count(DISTINCT g) FROM grams WHERE n = application_number) AS not_zero FROM good
UNION ALL SELECT application_number, mark_name, status, NULL, NULL FROM register
WHERE p_partkey % 2 = 0 AND application_number NOT IN (SELECT application_number FROM good)""",
    "watch_stream_into_register": f"""WITH {REGISTER}, {items()}
SELECT application_number, mark_name, status, filing_date, array_to_string(nice_classes, ',') AS nice_classes FROM register
UNION ALL SELECT application_number, mark_name, 'published', NULL, '' FROM items WHERE application_number NOT IN (SELECT application_number FROM register)""",
    "watch_stream": f"""WITH {items()} SELECT application_number, mark_name, 'published' AS status, 'euipo_bulletin' AS source FROM items""",
}

ORACLE["hybrid_search_in_cells"] = ORACLE["hybrid_search_vector_and_filter"]
# the same answers from stored postings
ORACLE |= {name: ORACLE["bm25_search"] for name in ("bm25_stored", "bm25_stored_segments", "bm25_stored_merged")}
ORACLE |= {"word_statistics_stored": ORACLE["word_statistics"], "rrf_fusion_stored": ORACLE["rrf_fusion"], "nice_recommend_stored": ORACLE["nice_recommend"]}
ORACLE |= {f"legal_stored_{mode}": ORACLE[f"legal_retrieval_{mode}"] for mode in ("naive", "local", "global", "hybrid")}
ORACLE["knn_after_upsert"] = ORACLE["knn_cosine_topk"]
ORACLE["knn_tree"] = f"""WITH {ASKED}, each AS (
  SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
tops AS (SELECT label AS top, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS m FROM each GROUP BY ALL) GROUP BY label),
leaves AS (SELECT label AS top, label * 4 + part AS leaf, list(m ORDER BY d) AS c
  FROM (SELECT label, vec_id % 4 AS part, d, avg(x) AS m FROM each GROUP BY ALL) GROUP BY label, part),
topped AS (SELECT * FROM (
  SELECT vec_id, label, embedding, top, row_number() OVER (PARTITION BY vec_id ORDER BY round({COSINE.format(a='embedding', b='c')}, 4) DESC, top) AS n
  FROM embeddings, tops) WHERE n = 1),
placed AS (SELECT * FROM (
  SELECT vec_id, label, embedding, leaf, row_number() OVER (PARTITION BY vec_id ORDER BY round({COSINE.format(a='embedding', b='c')}, 4) DESC, leaf) AS m
  FROM topped JOIN leaves USING (top)) WHERE m = 1),
beam AS (SELECT * FROM (
  SELECT query_id, qv, top, row_number() OVER (PARTITION BY query_id ORDER BY round({COSINE.format(a='c', b='qv')}, 4) DESC, top) AS n
  FROM asked, tops) WHERE n <= 3),
probes AS (SELECT * FROM (
  SELECT query_id, qv, leaf, row_number() OVER (PARTITION BY query_id ORDER BY round({COSINE.format(a='c', b='qv')}, 4) DESC, leaf) AS m
  FROM beam JOIN leaves USING (top)) WHERE m <= 6),
scored AS (SELECT query_id, vec_id, label, round({COSINE.format(a='embedding', b='qv')}, 4) AS similarity_score FROM placed JOIN probes USING (leaf))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, vec_id) AS INT) AS rank FROM scored) WHERE rank <= 10"""
ORACLE["bulletin_items_nested"] = f"""SELECT p_partkey AS page_id, 0::BIGINT AS position, {views.NUMBER} || ' ' || p_name AS title, {views.NUMBER} AS application_number,
  p_name AS mark_name, 'https://euipo.europa.eu/trademarks/' || {views.NUMBER} AS url, {views.PAGE_ISO} AS bulletin_date FROM part
UNION ALL SELECT p_partkey, 1, {views.SECOND_NUMBER} || ' ' || lower(p_type), {views.SECOND_NUMBER}, lower(p_type),
  'https://euipo.europa.eu/trademarks/' || {views.SECOND_NUMBER}, NULL FROM part"""
ORACLE["bulletin_links_nested"] = f"""SELECT p_partkey AS page_id, 0::BIGINT AS position, {views.NUMBER} || ' ' || p_name AS title, 'https://euipo.europa.eu/trademarks/' || {views.NUMBER} AS url FROM part
UNION ALL SELECT p_partkey, 1, {views.SECOND_NUMBER} || ' ' || lower(p_type), 'https://euipo.europa.eu/trademarks/' || {views.SECOND_NUMBER} FROM part
UNION ALL SELECT p_partkey, 2, 'More', 'https://euipo.europa.eu/more' FROM part"""
ORACLE["similar_names"] = f"""WITH {REGISTER}, {CANDIDATES},
asked AS (SELECT query_id, candidate_name, {sound_key('candidate_name')} AS a FROM cand),
marks AS (SELECT id, mark_name, {sound_key('mark_name')} AS b FROM register),
pairs AS (SELECT query_id, candidate_name, id, mark_name, {sound('a', 'b')} AS s FROM asked, marks)
SELECT query_id, candidate_name, id, mark_name, round(s, 4) AS sound FROM pairs WHERE s >= 0.6 - 1e-12"""
ORACLE["corpus_from_files"] = r"""SELECT CASE WHEN lang = 'en' THEN '' ELSE lang || '/' END || doc_id || '.txt' AS source, replace(text, chr(13), '') AS text FROM documents
WHERE regexp_matches(text, '[^\s\x{85}\x{a0}]')"""
ORACLE["letters_as_files"] = ORACLE["stream_of_letters"] = ORACLE["letter_format_letters"]
ORACLE["ingest_landed_files"] = ORACLE["ingest_urls"]
ORACLE["export_json"] = f"""WITH {REGISTER} SELECT id, mark_name, array_to_string(nice_classes, ',') AS nice_classes, filing_date, nullif(status, 'registered') AS status FROM register"""
ORACLE["export_csv"] = f"""WITH {REGISTER} SELECT id, mark_name, '[' || array_to_string(nice_classes, ',') || ']' AS nice_classes, filing_date, status FROM register"""
ORACLE["embed_marks"] = f"""WITH {REGISTER}, t AS (SELECT id, mark_name, 'passage: ' || {ENCODER_TEXT} AS t FROM register),
e AS (SELECT t, {ngram_vector("t")} AS v FROM (SELECT DISTINCT t FROM t)),
x AS (SELECT id, mark_name, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM t JOIN e USING (t))
SELECT id, mark_name, dim, round(x::DOUBLE, 4) AS x FROM x WHERE x <> 0"""
ORACLE["embed_one"] = f"""WITH {REGISTER}, t AS (SELECT 'query: ' || mark_name AS t FROM register ORDER BY length(mark_name) DESC, mark_name LIMIT 1),
x AS (SELECT unnest(range(0, 64)) AS dim, unnest({ngram_vector("t")}) AS x FROM t)
SELECT dim, round(x::DOUBLE, 4) AS x FROM x WHERE x <> 0"""
_CLASS_TEXT = "array_to_string(list_transform(list_sort({c}), lambda c: 'Class ' || c), ', ')"
ORACLE["items_to_clearance"] = f"""WITH {REGISTER}, {PARSED}, {items()},
numbered AS (SELECT application_number AS item, min(mark_name) AS title FROM items GROUP BY application_number),
details AS (SELECT application_number AS item, mark_name AS name, mark_name || ' | ' || {_CLASS_TEXT.format(c="list_transform(string_split(nice_classes, ','), lambda c: CAST(c AS INT))")} AS t
  FROM parsed WHERE reject_reason IS NULL AND applicant_country = 'FR' AND application_number IN (SELECT item FROM numbered)),
listed AS (SELECT application_number AS item, mark_name AS name, {ENCODER_TEXT} AS t FROM register
  WHERE application_number IN (SELECT item FROM numbered) AND application_number NOT IN (SELECT item FROM details)),
cands AS (SELECT *, 'detail' AS origin FROM details UNION ALL SELECT *, 'register' FROM listed
  UNION ALL SELECT item, title, title, 'item' FROM numbered WHERE item NOT IN (SELECT item FROM details) AND item NOT IN (SELECT item FROM listed)),
cv AS (SELECT t, {ngram_vector("'query: ' || t")} AS v, row_number() OVER () AS n FROM (SELECT DISTINCT t FROM cands)),
marks AS (SELECT id, application_number, mark_name, {ENCODER_TEXT} AS t FROM register WHERE status = 'registered'),
mv AS (SELECT t, {ngram_vector("'passage: ' || t")} AS v FROM (SELECT DISTINCT t FROM marks)),
texts AS (SELECT cv.t AS ct, mv.t AS mt, round({COSINE.format(a='cv.v', b='mv.v')}, 4) AS s FROM cv, mv),
first AS (SELECT * FROM (
  SELECT item, origin, name AS candidate_name, id, application_number, mark_name, s, row_number() OVER (PARTITION BY item ORDER BY s DESC, id) AS n
  FROM cands JOIN texts ON ct = cands.t JOIN marks ON mt = marks.t) WHERE n <= 4),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY n) AS INT) AS rank FROM first WHERE item <> application_number) WHERE rank <= 3),
keyed AS (SELECT *, {sound_key('candidate_name')} AS a, {sound_key('mark_name')} AS b FROM best),
compared AS (SELECT *, {sound('a', 'b')} AS snd FROM keyed),
scored AS (SELECT *, 0.5::DOUBLE * s + 0.5::DOUBLE * snd AS o FROM compared)
SELECT item, origin, candidate_name, rank, application_number, mark_name, s AS semantic, round(snd, 4) AS sound, round(o, 4) AS overall,
  CASE WHEN o > 0.80::DOUBLE THEN 'HIGH' WHEN o > 0.65::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM scored"""
