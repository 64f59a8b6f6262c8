"""WARC archives, whitening and spelling variants beside brute force, and on rows that are null, empty, repeated or long."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from emblema.llm import spelling, warc, whitening

# --- spelling


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def brute_forms(words: dict[str, int], ratio: int = 10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return out


def as_set(forms):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in forms.collect()}


def variants(seed: int, many: int, alphabet: str, lengths=(7, 12)) -> dict[str, int]:
    pick = random.Random(seed)
    words = {}
    while len(words) < many:
        w = "".join(pick.choice(alphabet) for _ in range(pick.randint(*lengths)))
        for _ in range(pick.randint(1, 6)):
            words[w] = 2 * 10 ** pick.randint(0, 6) + pick.randint(0, 3)
            p, c = pick.randrange(len(w)), pick.choice(alphabet)
            w = pick.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]]) or w
    return words


@pytest.mark.parametrize(
    ("alphabet", "lengths", "crowd"),
    [("ab", (5, 9), 256), ("ab", (5, 9), 2), ("abcdé", (7, 9), 256), ("abcdefghÿ", (1, 6), 3), ("a", (1, 30), 1)],
)
def test_spelling_forms_against_all_pairs(spark, alphabet, lengths, crowd):
    words = variants(3, 25 if alphabet == "a" else 250, alphabet, lengths)
    got = as_set(spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n bigint"), crowd=crowd))
    assert got == brute_forms(words)


def test_near_words_of_great_length_and_common_beginnings(spark):
    pick = random.Random(5)
    long = "".join(pick.choice("abc") for _ in range(511))
    words = [long, long + "a", long + "ab", "b" + long, long[:300] + long[301:], long[:-1] + "é", "x" + long + "y"]
    words += ["a" * k for k in range(505, 517)]
    words += ["zqzq" + "".join(pick.choice("xy") for _ in range(6)) for _ in range(60)]  # many words under one rare beginning
    table = spark.createDataFrame([(w, 2) for w in dict.fromkeys(words)], "word string, n bigint")
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    for crowd in (256, 4):
        rows = spelling.near_words(table, crowd=crowd).collect()
        assert {(r.word, r.near) for r in rows} == want
        assert len(rows) == len(want)


def test_pivots_are_the_cheapest_disjoint_bigrams():
    pick = random.Random(1)
    for _ in range(300):
        word = "".join(pick.choice("abc") for _ in range(pick.randint(4, 12)))
        counts = [0] * spelling.GRAM_CELLS
        for a in "abc":
            for b in "abc":
                counts[spelling._cell(a + b)] = pick.randint(1, 5)
        grams = spelling.prefix(word, counts)
        price = {p: f for f, _, p in grams}
        found = spelling.pivots(grams)
        pairs = [(a, b) for a in price for b in price if b - a >= 2]
        assert tuple(sorted(found)) in pairs
        assert sum(price[p] for p in found) == min(price[a] + price[b] for a, b in pairs)


def test_spelling_query_against_brute_force(spark):
    pick = random.Random(8)
    vocabulary = ["strength", "Mötörheads", "colours", "behaviour", "naïveté", "kitchen", "kitchens", "ÉCLAIRS", "short", "weight×less"]
    texts = [" ".join(pick.choice(vocabulary) + pick.choice(["", ".", ",", "9"]) for _ in range(pick.randint(0, 400))) for _ in range(60)]
    texts += [None, "", "a" * 3000 + " " + "a" * 3000, "x " + "q" * 600 + " " + "q" * 600, texts[0], "ſtrength K strength漢字 kitcheńs"]
    rows = [(None if k in (3, 5) else k, t, k, "c") for k, t in enumerate(texts)] + [(0, texts[0], 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, word string")
    counts: Counter[str] = Counter()
    for i, t, _, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = spelling.group_documents(docs)
    assert as_set(got) == brute_forms(words)
    assert any(r.form for r in got.collect())
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.group_documents(docs.limit(0)).count() == 0


def test_words_are_counted_the_same_when_tables_are_sent_on_early(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"chapter number{chr(97 + k % 26)} heading") for k in range(300)], "doc_id bigint, text string")
    whole = {(r.word, r.n) for r in spelling.count_words(docs).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    assert {(r.word, r.n) for r in spelling.count_words(docs).collect()} == whole
    assert ("chapter", 300) in whole


# --- whitening


def exact_covariance(x: list[list[int]]) -> np.ndarray:
    n, d = len(x), len(x[0])
    means = [Fraction(sum(r[k] for r in x), n) for k in range(d)]
    return np.array([[float(sum((r[i] - means[i]) * (r[j] - means[j]) for r in x) / n) for j in range(d)] for i in range(d)])


def check_whitening(spark, rows, **options):
    schema = "vec_id bigint, embedding array<float>, label int, x string, n string"
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "x", "n") for i, v in rows], schema), **options).collect()
    usable = [(i, [np.float32(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in usable), default=0)
    clip = lambda c: max(-(2**63), min(2**63 - 1, int(np.floor(256.0 * float(c)))))
    x = [(i, [clip(c) for c in v] + [0] * (d - len(v))) for i, v in usable]
    fit = [list(t) for t in dict.fromkeys(tuple(v) for _, v in x)]
    n, many = len(fit), min(4, d)
    assert len(got) == len(x) * many
    if not got:
        return got
    sums = [sum(r[k] for r in fit) for k in range(d)]
    variance = exact_covariance(fit)
    values, vectors = np.linalg.eigh(variance)
    order = np.argsort(-values)[:many]
    deviations = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in x]
    want = Counter((i, v if v < 10**38 else None, v if v < 2**63 else None) for i, v in deviations)
    whole = lambda v: None if v is None else int(v)
    assert Counter((r.vec_id, whole(r.deviation_decimal), r.deviation) for r in got if r.component == 1) == want
    for r in got:
        assert r.n == n
        k = order[r.component - 1]
        if variance.trace() > 0:
            assert r.explained == pytest.approx(values[k] / variance.trace(), rel=1e-6, abs=1e-9)
    if values[order].min() > 1e-9 * values.max():
        by = {(i, tuple(v)): (np.array(v) - np.array([s / n for s in sums])) @ vectors[:, order] / np.sqrt(values[order]) for i, v in x}
        assert got[0].identity_error < 1e-6
        for component in range(1, many + 1):
            found = sorted(r.whitened for r in got if r.component == component)
            expected = np.array([w[component - 1] for w in (by[i, tuple(v)] for i, v in x)])
            assert min(np.abs(np.sort(sign * expected) - found).max() for sign in (1, -1)) < 1e-6
    return got


def test_whitening_against_exact_covariances(spark):
    pick = np.random.default_rng(4)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(pick.normal(size=(300, 7)) * [3, 2, 1.5, 1, 0.5, 0.2, 0.1] + [5, 0, 0, -3, 0, 0, 1])]
    rows += [(None, rows[0][1]), (0, rows[0][1]), (900, None), (901, [None] * 7), (902, [float("nan")] * 7), (903, [1.0, 2.0, float("-inf"), 0.0, 0.0, 0.0, 0.0])]
    check_whitening(spark, rows)


def test_whitening_of_few_short_flat_and_huge_vectors(spark):
    check_whitening(spark, [])
    check_whitening(spark, [(1, None)])
    assert all(r.whitened is None and r.identity_error is None for r in check_whitening(spark, [(1, [1.0, 2.0, 3.0])]))
    check_whitening(spark, [(1, []), (2, [])])
    check_whitening(spark, [(1, [1.0]), (2, [2.0, 1.0, 7.0]), (3, []), (4, [0.5, 2.5])])
    flat = check_whitening(spark, [(k, [1.0, float(k), 2.0]) for k in range(5)])
    assert all((r.whitened is None) == (r.component > 1) for r in flat)
    pick = np.random.default_rng(1)
    for size in (1e9, 1e15, 3e38):  # 64-bit sums, then numbers without bound
        check_whitening(spark, [(k, [float(c) for c in v]) for k, v in enumerate(pick.normal(size=(40, 3)) * size)] if size < 1e38 else [(k, [3e38 * (-1) ** k, float(k), 1e20]) for k in range(6)])


def test_square_sums_are_exact():
    pick = random.Random(2)
    for bits in (10, 40, 61):
        rows = [[pick.randint(-(2**bits), 2**bits) for _ in range(3)] for _ in range(500)]
        want = [sum(r[k] ** 2 for r in rows) for k in range(3)]
        assert whitening.square_sums(np.array(rows, np.int64)) == want
        assert whitening.square_sums(np.array(rows, object)) == want


# --- archives

PAGES = [
    (1, "http://a.example/1", "<p>" + "é" * 600), (2, "http://a.example/2", "x" * 999), (3, None, "x" * 999), (4, "http://a.example/4 b\r\nX: y", "y" * 1000), (5, "http://a.example/5", "y" * 1000),
    (6, "http://a.example/6", "y" * 1000), (7, "http://a.example/7", None), (8, "http://a.example/8", ""), (9, "http://a.example/ü", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100), (None, "http://a.example/n", "y" * 1000),
    (6, "http://a.example/6", "y" * 1000), (10, "http://a.example/10", "z" * 3_000_000), (11, "http://a.example/11", "z" * 3_000_000), (None, None, "w" * 2000), (None, None, "w" * 2000),
]


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], "page_id bigint, url string, html string, payload string, digest string, shard string").repartition(parts)


def brute_records(rows):
    keeper = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            keeper[h] = max(i, keeper.get(h, i))
    out = Counter()
    for i, _, h in rows:
        raw, of = (h or "").encode(), keeper.get(h)
        revisit = of is not None and (i is None or i < of)
        out[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", of if revisit else None] += 1
    return out


def as_records(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_archives_against_brute_force(spark):
    assert as_records(warc.archived(pages_of(spark, PAGES))) == brute_records(PAGES)
    assert warc.archived(pages_of(spark, PAGES).limit(0)).count() == 0


def test_archives_are_the_same_however_pages_are_partitioned_and_files_roll(spark, tmp_path):
    rows = PAGES + [(100 + k, f"http://b.example/{k}", hashlib.sha256(b"%d" % k).hexdigest() * 40) for k in range(200)]
    found = []
    for parts in (1, 7):
        path = f"file://{tmp_path}/at-{parts}"
        manifest = warc.write_archives(pages_of(spark, rows, parts), path, shard_bytes=100_000, roll_bytes=1_500)
        files = {r.name: (r.shard, r.sequence, r.records, r.bytes, r.sha256) for r in manifest.collect()}
        folder = tmp_path / f"at-{parts}"
        assert {p.name for p in (folder / "archive").iterdir() if not p.name.startswith(".")} == set(files)
        for name, (_, _, _, size, digest) in files.items():
            raw = (folder / "archive" / name).read_bytes()
            assert len(raw) == size and hashlib.sha256(raw).hexdigest() == digest
            assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert not [p for p in folder.iterdir() if p.name.startswith("_temporary")]
        found.append(files)
    assert found[0] == found[1]
    shards = {shard for shard, *_ in found[0].values()}
    assert len(shards) > 5 and any(sequence > 0 for _, sequence, *_ in found[0].values())
    back = warc.read_archives(spark, path, with_payload=True).collect()
    got = Counter((r.page_id, r.url, r.record_type, bytes(r.payload).decode() if r.payload is not None else None) for r in back)
    expected = Counter()
    for (i, u, h), kind in zip(rows, (next(k[3] for k in brute_records(rows) if k[:3] == (i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())) for i, _, h in rows), strict=True):
        address = None if u is None else u.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A")
        expected[None if i is None else str(i), address, kind, (h or "") if kind == "response" else None] += 1
    assert got == expected
    assert len({r.record_id for r in back}) == len(back) == len(rows)
    order = [r.page_id for r in sorted(back, key=lambda r: (r.file, r.place))]
    assert order == [None if i is None else str(i) for i in sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))]


def test_unfinished_and_damaged_archives_are_not_read(spark, tmp_path):
    path = str(tmp_path / "one")
    pages = pages_of(spark, PAGES[:3], 1)
    warc.write_archives(pages, path)
    with pytest.raises(ValueError, match="finished archive"):
        warc.write_archives(pages, path)
    (file,) = [p for p in (tmp_path / "one" / "archive").iterdir() if p.name.endswith(".gz")]
    parts = list(warc.members(io.BytesIO(file.read_bytes())))
    file.write_bytes(b"".join(warc._member(p.replace(b"xxxx", b"xxxy", 1)) for p in parts))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, path).collect()
    (tmp_path / "one" / "COMMIT").unlink()
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, path)


def test_members_are_read_in_any_chunks():
    data = [b"a" * 10, b"", b"b" * 5000, b"c"]
    packed = b"".join(warc._member(d) for d in data)
    for chunk in (1, 7, 100_000):
        assert list(warc.members(io.BytesIO(packed), chunk)) == data
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(io.BytesIO(packed[:-3]), 64))


def test_open_sides_share_a_hash_exactly_when_one_edit_apart():
    pick = random.Random(6)
    words = ["".join(pick.choice("abé") for _ in range(pick.randint(0, 9))) for _ in range(400)] + ["\U0001f600x" * 300]
    starts = np.array([pick.randint(0, len(w)) for w in words])
    stops = np.array([pick.randint(s, len(w)) for s, w in zip(starts, words)])
    rows, hashes = spelling.open_sides(words, starts, stops)
    found = [set() for _ in words]
    for r, h in zip(rows, hashes):
        found[r].add(int(h))
    sides = [w[s:e] for w, s, e in zip(words, starts, stops)]
    kinds = {}
    for side, own in zip(sides, found):
        variants = {side, *(side[:p] + side[p + 1 :] for p in range(len(side)))}
        assert len(own) == len(variants)
        assert kinds.setdefault(side, own) == own  # wherever the side stands in its word
    names = list(kinds)
    for x in range(len(names)):
        for y in range(x):
            if one_edit(names[x], names[y]):
                assert kinds[names[x]] & kinds[names[y]]
