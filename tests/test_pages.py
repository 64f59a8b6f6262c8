"""Bulletin pages, letters, statutes and text sources."""

import pytest
from pyspark.sql import functions as F

from emblema.functions import html
from emblema.functions.letters import format_letter
from emblema.operators.pages import stitch_pages
from emblema.plans import bulletin, legal, office_action
from emblema.session import fresh_path
from emblema.sources import texts

LETTER = """
BOARD OF EXAMINERS

Application Number: 019123456
Trade Mark: Ventiva
Applicant:  Wind & Sons
Filing Date: 20/04/2026

THE APPLICANT'S "CASE" (2ND ROUND)

   Article 7(1)(b) EUTMR: no character
Art. 7(1)(c) and Article 8(1)(b), Art. 7(1)(b) again.
Section 4 applies. See Guidelines, Part B, Section 4, Part C, Section 12; R 12/2019-4, R 1234/2020-1.
DEADLINE FOR RESPONSE: 31/02/2027
Signed,
"""
FORMATTED = """
## Board Of Examiners

Application Number: 019123456
Trade Mark: Ventiva
Applicant:  Wind & Sons
Filing Date: 20/04/2026

## The Applicant'S "Case" (2Nd Round)

**Article 7(1)(b) EUTMR: no character**
**Art. 7(1)(c) and Article 8(1)(b), Art. 7(1)(b) again.**
**Section 4 applies. See Guidelines, Part B, Section 4, Part C, Section 12; R 12/2019-4, R 1234/2020-1.**
## Deadline For Response: 31/02/2027
Signed,
"""


def test_letter_layout(evaluate):
    assert evaluate({"t": LETTER}, format_letter(F.col("t"))) == FORMATTED
    long_heading = "A" * 100
    assert evaluate({"t": long_heading}, format_letter(F.col("t"))) == long_heading
    assert evaluate({"t": "2026\nÉTÉ ÀÇ\nSTRAßE"}, format_letter(F.col("t"))) == "2026\n## Été Àç\nSTRAßE"


def test_letter_contents(spark):
    letters = spark.createDataFrame([(1, LETTER), (2, "nothing")], ["doc_id", "text"])
    header = office_action.letter_header(letters).orderBy("doc_id").first()
    assert tuple(header) == (1, "019123456", "Ventiva", "Wind & Sons", "2026-04-20", "2027-02-31", None)
    found = office_action.objections(letters).orderBy("position").collect()
    assert [(r["code"], r["kind"]) for r in found] == [("7(1)(b)", "absolute"), ("7(1)(c)", "absolute"), ("8(1)(b)", "relative")]
    assert all(r["label"] for r in found)
    cited = sorted(r["citation"] for r in office_action.letter_citations(letters).collect())
    assert cited == [
        "Article 7(1)(b)", "Article 7(1)(c)", "Article 8(1)(b)", "Part B, Section 4", "Part C, Section 12", "R 12/2019-4", "R 1234/2020-1",
    ]
    whole = office_action.structured_letters(letters).where("doc_id = 1").first()
    assert whole["decisions"] == ["R 12/2019-4", "R 1234/2020-1"] and whole["markdown"] == FORMATTED


STATUTE = """Preamble text, see Article 9.
Article 7 — Grounds

1. Not registered:
(a) signs which do not conform to Article 4;
3. Paragraph 1 shall not apply.
Article 8 — Earlier marks
1. See Article 7 and Article 7(2).
"""


def test_passages(spark):
    corpus = spark.createDataFrame([("s", STATUTE)], ["source", "text"])
    rows = [(r["article"], r["paragraph"], r["heading"], r["cites"]) for r in legal.split_passages(corpus).orderBy("passage_id").collect()]
    assert rows == [
        (None, 0, None, [9]),
        (7, 1, "Article 7 — Grounds", [4]),
        (7, 3, "Article 7 — Grounds", []),
        (8, 1, "Article 8 — Earlier marks", [7]),
    ]
    letters = spark.createDataFrame([(1, "Article 7(1)(b) and Art. 99")], ["doc_id", "text"])
    cited = {r["article"]: (r["heading"], r["passages"]) for r in office_action.cited_articles(letters, legal.split_passages(corpus)).collect()}
    assert cited == {7: ("Article 7 — Grounds", 2), 99: (None, None)}


def test_retrieval_modes(spark):
    texts_ = ["apple pie Article 2", "apple tree", "pear tree Article 2", "plum Article 1", "stone"]
    corpus = spark.createDataFrame([("x", "\n".join(f"Article {i + 1} - h\n1. {t}" for i, t in enumerate(texts_)))], ["source", "text"])
    passages = legal.split_passages(corpus)
    asked = spark.createDataFrame([(1, "apple")], ["query_id", "query_text"])

    def found(mode):
        return [r["passage_id"] for r in legal.retrieve(passages, asked, mode, 3).orderBy("rank").collect()]

    assert set(found("naive")) == {"x#0#1", "x#1#1"}
    # both apples are about article 2, which the pear cites, too
    assert found("local")[:2] == ["x#0#1", "x#1#1"] and found("local")[2] == "x#2#1"
    assert found("global")[0] == "x#1#1"
    assert set(found("hybrid")) >= {"x#0#1", "x#1#1"}
    with pytest.raises(ValueError):
        legal.retrieve(passages, asked, "other")


def test_stitching(spark):
    pages = [("a", 2, "two"), ("a", 1, "one"), ("a", 3, " \n"), ("a", 12, "twelve"), ("b", 1, "only")]
    df = spark.createDataFrame(pages, ["doc_id", "page_no", "text"])
    whole = {r["doc_id"]: r["text"] for r in stitch_pages(df).collect()}
    assert whole == {"a": "## Page 1\n\none\n\n## Page 2\n\ntwo\n\n## Page 12\n\ntwelve", "b": "## Page 1\n\nonly"}
    parts = stitch_pages(df, pages_per_part=2).where("doc_id = 'a'").orderBy("part").collect()
    assert [r["part"] for r in parts] == [0, 1, 6] and "\n\n".join(r["text"] for r in parts) == whole["a"]


PAGE = """<html><head><script>var a = '<a href="/bulletin/s">s</a>';</script></head><body>
<!-- <div class="bulletin-item"><a href="/hidden">h</a></div> -->
<div class="old bulletin-item new"><div><span class=pub-date>x</span></div><a class='t' href='/trademarks/0123456'>Ben &amp; <b>Sons</b></a>
 <span class="published-date"> 2026-01-02 </span></div>
<DIV CLASS="bulletin-item"><a href="http://o.example/1">App No 7654321 -: Alpha 2</a><time>not a date but a very long remark</time><i data-date="2026-02-03"></i></DIV>
<div class="bulletin-items"><a href="/no">no</a></div>
<div class="bulletin-item">019999999 Beta</div>
<footer><a href="/end">End</a> <time datetime="1999-01-01">x</time></footer></body></html>"""


def items(spark, page):
    df = spark.createDataFrame([(1, page)], ["page_id", "html"])
    rows = bulletin.bulletin_items(df, base_url="https://h.example").orderBy("position").collect()
    return [(r["title"], r["application_number"], r["mark_name"], r["url"], r["bulletin_date"]) for r in rows]


def test_bulletin_items(spark):
    assert items(spark, PAGE) == [
        ("Ben & Sons", "0123456", "Ben & Sons", "https://h.example/trademarks/0123456", "2026-01-02"),
        ("App No 7654321 -: Alpha 2", "7654321", "Alpha 2", "http://o.example/1", "2026-02-03"),
        ("019999999 Beta", "019999999", "Beta", "", None),
    ]


def test_bulletin_fallback(spark):
    page = '<a href="/x">x</a><a href="/bulletin/1">Application No. 019123456 - SolarFlux</a><a href="/application?a=1&amp;b=2"></a>'
    assert items(spark, page) == [
        ("Application No. 019123456 - SolarFlux", "019123456", "SolarFlux", "https://h.example/bulletin/1", None),
        ("", None, "Unknown Mark", "https://h.example/application?a=1&b=2", None),
    ]
    assert items(spark, "<p>nothing</p>") == []


def test_selectors_in_order(spark):
    page = '<li class="bulletin-entry"><a href="/a">A</a><li class="bulletin-entry"><a href="/b">B</a></ul><a href="/c">C</a>'
    assert [i[0] for i in items(spark, page)] == ["A", "B"]
    page = '<p class="result-item"><a href="/a">A</a></p><div class="search-result-item"><a href="/b">B</a></div>'
    assert [i[0] for i in items(spark, page)] == ["B"]


def test_links(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, '<a href="/bulletin/1"> One </a><a href="/bulletin/2"></a><a href=/bulletin/3>Three</a>')], ["page_id", "html"])
    every = bulletin.extract_links(pages).where("page_id = 1").orderBy("position").collect()
    assert [(r["title"], r["href"]) for r in every] == [
        ("Ben & Sons", "/trademarks/0123456"), ("App No 7654321 -: Alpha 2", "http://o.example/1"), ("no", "/no"), ("End", "/end"),
    ]
    listed = bulletin.bulletin_links(pages, base_url="https://h.example").orderBy("page_id", "position").collect()
    assert [(r["title"], r["url"]) for r in listed] == [
        ("Ben & Sons", "https://h.example/trademarks/0123456"),
        ("App No 7654321 -: Alpha 2", "http://o.example/1"),
        ("One", "https://h.example/bulletin/1"),
        ("Three", "https://h.example/bulletin/3"),
    ]
    assert bulletin.bulletin_links(pages, max_pages=0).count() == 0


def test_element_counts_its_own_tags(evaluate):
    page = "<div>a<div>b</div><p>c</p></div>d"
    assert evaluate({"h": page}, html.element(F.col("h"))) == "<div>a<div>b</div><p>c</p>"
    assert evaluate({"h": "<li>open"}, html.element(F.col("h"))) == "<li>open"


def test_text_sources(spark, tmp_path):
    for name, content in {"a.txt": "one\ntwo\n", "blank.txt": " \n", "note.md": "x", "sub/b.txt": "three", "sub/deep/c.txt": "no"}.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
    rows = {r["source"]: r["text"] for r in texts.read_corpus(spark, str(tmp_path / "corpus")).collect()}
    assert rows == {"a.txt": "one\ntwo\n", "sub/b.txt": "three"}
    letters = texts.read_letters(spark, str(tmp_path / "corpus" / "sub"))
    out = fresh_path(spark, "letters")
    texts.write_formatted_letters(letters, out)
    assert spark.read.parquet(out).count() == 2


def test_outputs(spark):
    rows = spark.createDataFrame([(1, "é", [9, 35])], "id int, name string, classes array<int>")
    path = fresh_path(spark, "out")
    texts.write_json(rows, path + "/json")
    texts.write_csv(rows, path + "/csv")
    assert spark.read.schema(rows.schema).json(path + "/json").first() == rows.first()
    assert spark.read.option("header", "true").option("escape", '"').csv(path + "/csv").first()["classes"] == "[9,35]"
