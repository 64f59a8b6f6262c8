"""Names that sound alike beside all pairs, and elements within elements beside an HTML parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from emblema.functions import html
from emblema.operators import soundalike


def alike(a, b):
    return 1.0 if a == b else sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


@pytest.mark.parametrize("least", [0.5, 0.7, 0.8, 1.0])
def test_keys_against_all_pairs(spark, least):
    pick = random.Random(int(least * 10))
    words = ["".join(pick.choice("abc") for _ in range(pick.randint(1, 13))) for _ in range(150)]
    words += [w[:-1] for w in words[:30] if len(w) > 1] + [w + "ab" for w in words[:30]]
    left, right = dict.fromkeys(words[::2]), dict.fromkeys(words[1::2] + words[:40])
    one, two = (spark.createDataFrame([(w,) for w in ws], f"{c} string") for c, ws in (("a", left), ("b", right)))
    rows = [tuple(r) for r in soundalike.alike_keys(one, two, least).collect()]
    assert len(rows) == len(set(rows))
    assert sorted(rows) == sorted((a, b, alike(a, b)) for a in left for b in right if alike(a, b) >= least)


def test_names(spark):
    marks = spark.createDataFrame([("1", "Königsblau"), ("2", "koenigs-blau"), ("3", "Koenigsgrau"), ("4", None), ("5", "!!"), ("6", ""), ("7", "Blau")], "id string, mark_name string")
    asked = spark.createDataFrame([(1, "KOENIGSBLAU"), (2, None), (3, "?"), (1, "Blaues")], "query_id int, candidate_name string")
    rows = {(r.query_id, r.candidate_name, r.id): r.sound for r in soundalike.similar_names(marks, asked, 0.8).collect()}
    assert rows == {(1, "KOENIGSBLAU", "1"): 1.0, (1, "KOENIGSBLAU", "2"): 1.0, (1, "KOENIGSBLAU", "3"): round(9 / 11, 4)}
    with pytest.raises(ValueError):
        soundalike.similar_names(marks, asked, 0)


def test_a_name_that_a_third_of_the_register_has_meets_once(spark):
    marks = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'Murmelstein', concat('x', id)) AS mark_name")
    asked = spark.createDataFrame([(k, "Murmelbein") for k in range(20)], "query_id int, candidate_name string")
    met = []
    stretches = soundalike.stretches

    def counted(keys, *rest, **options):
        met.append(keys.where(f"{keys.columns[0]} LIKE 'murmel%'").count())
        return stretches(keys, *rest, **options)

    soundalike.stretches = counted
    try:
        assert soundalike.similar_names(marks, asked, 0.5).count() == 20 * 1000
    finally:
        soundalike.stretches = stretches
    assert set(met) == {1}


class Items(HTMLParser):
    """Per element of class ``i``: the text within it, in the order of the first tags."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        mine = None
        if "i" in (dict(attrs).get("class") or "").split():
            mine = len(self.found)
            self.found.append("")
        self.open.append((tag, mine))

    def handle_endtag(self, tag):
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        for _, mine in self.open:
            if mine is not None:
                self.found[mine] += data


def page(pick, depth=0):
    out = ""
    for _ in range(pick.randint(0, 3) if depth < 4 else 0):
        tag = pick.choice(["div", "li", "p1"])
        css = pick.choice(['class="i"', "class='j i'", 'class="ii"', ""])
        out += f"t{pick.randint(0, 99)}<{tag} {css}>{page(pick, depth + 1)}</{tag}>"
    return out + f"e{pick.randint(0, 99)}"


def test_elements_within_elements(spark):
    pick = random.Random(4)
    pages = [(k, page(pick)) for k in range(150)] + [(900, ""), (901, "<div class=i>"), (902, "<b class='i'>open<b class='i'>two</b>")]
    df = spark.createDataFrame(pages, "k int, h string")
    selector = ("", "i", "", "")
    got = df.select("k", F.transform(html.blocks(F.col("h"), selector), html.inner_text).alias("t"), F.transform(html.outer_blocks(F.col("h"), selector), html.inner_text).alias("o"))
    nested = 0
    for row in got.where("k < 900").collect():
        reader = Items()
        reader.feed(dict(pages)[row.k])
        assert row.t == reader.found
        assert sum(len(t) for t in row.o) <= sum(len(t) for t in row.t) and set(row.o) <= set(row.t)
        nested += row.o != row.t
    assert nested > 20
    last = {r.k: r.t for r in got.where("k >= 900").collect()}
    assert last == {900: [], 901: [], 902: ["open", "two"]}  # what is not closed ends where the next begins
