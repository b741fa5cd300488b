import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from golode.llm import html_text, licenses, quality, topk, warc
from golode.llm.common import scratch, table


def brute_top(ids, x, queries, k):
    out = set()
    for q in queries:
        scores = sorted(((-int(sum(a * b for a, b in zip(x[q], x[c], strict=True))), ids[c]) for c in range(len(ids)) if ids[c] != ids[q]))
        out |= {(ids[q], r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("dim,n", [(3, 400), (16, 300)])
def test_dual_tree_exact(spark, monkeypatch, dim, n):
    for name, value in (("BLOCK", 64), ("QUERY_BLOCK", 8), ("PIVOTS", 4), ("LEAF", 4), ("CHUNK", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[50:120] = v[50]
    rows = [(i, [float(a) for a in r], 0) for i, r in enumerate(v)] + [(n, None, 0), (n + 1, [None] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [float("inf")] * dim, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in topk.top_k(df, F.col("id") % 10 == 0).collect()}
    x = np.floor(v.astype(np.float64) * 1024).astype(int).tolist()
    assert got == brute_top(list(range(n)), x, range(0, n, 10), 10)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(12, dim)) * 5
    return (spots[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.01, 0.3], (n, 1))).astype(np.float32)


@pytest.mark.parametrize("cells", [1, 4, 50])
def test_search_of_clusters(spark, monkeypatch, cells):
    """Cells cut by planes, bounds on cells and blocks, kth scores carried on; ids that repeat."""
    for name, value in (("BLOCK", 32), ("QUERY_BLOCK", 8), ("PIVOTS", cells), ("LEAF", 4), ("CHUNK", 16)):
        monkeypatch.setattr(topk, name, value)
    v = clustered(500, 4, 3)
    ids = [i if i < 450 else i - 450 for i in range(500)]
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 25 == 0).collect())
    x = np.floor(v.astype(np.float64) * 1024).astype(int).tolist()
    want = []
    for q in range(500):
        if ids[q] % 25 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x[q], x[c], strict=True)), ids[c]) for c in range(500) if ids[c] != ids[q])
            want += [(ids[q], r + 1, c, -s) for r, (s, c) in enumerate(scores[:10])]
    assert got == sorted(want)


def test_cover_trees():
    """Nesting, covering and separation hold at every node, and blocks of clusters have levels."""
    x = clustered(3000, 6, 8).astype(np.float64)
    tree = topk.Tree(x)
    assert sorted(tree.order.tolist()) == list(range(3000)) and (tree.kids > 0).sum() > 10
    for n in range(len(tree.centre)):
        rows = tree.order[tree.lo[n] : tree.hi[n]]
        assert tree.centre[n] in rows and np.sqrt(((x[rows] - x[tree.centre[n]]) ** 2).sum(1)).max() <= tree.radius[n] + 1e-9
        below = range(tree.first[n], tree.first[n] + tree.kids[n])
        if len(below):
            centres = tree.centre[below.start : below.stop]
            assert tree.centre[n] in centres
            assert sorted(np.concatenate([tree.order[tree.lo[m] : tree.hi[m]] for m in below]).tolist()) == sorted(rows.tolist())
            assert all(tree.radius[m] <= tree.radius[n] / 2 + 1e-9 for m in below)
            apart = np.sqrt(((x[centres][:, None] - x[centres][None]) ** 2).sum(2))[np.triu_indices(len(below), 1)]
            assert (apart > tree.radius[n] / 2).all()
    again = topk.Tree.unpacked(x, *tree.packed())
    assert (again.shape == tree.shape).all() and (again.order == tree.order).all() and (again.radius == tree.radius).all()
    # Without clusters, in many dimensions, a cover would be the points themselves.
    assert len(topk.Tree(np.random.default_rng(1).normal(size=(500, 64))).centre) == 1


def test_scores_beyond_a_long(spark):
    big = 3e38
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 5.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("id") == 0).orderBy("rank").collect()]
    top = 2**63 - 1
    assert got == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 2, -top)]
    huge = spark.createDataFrame([(0, [1e135]), (1, [1e308]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(huge, F.col("id") >= 0).orderBy("query_id", "rank").collect()] == [(0, 1, 2, top), (2, 1, 0, top)]


def test_top_few_and_none(spark):
    df = spark.createDataFrame([(10, [1.0]), (20, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df, F.col("id") % 10 == 0).collect()} == {(10, 1, 20, 2097152), (20, 1, 10, 2097152)}
    assert topk.top_k(df.where("false"), F.col("id") % 10 == 0).count() == 0


def test_common_subsequence():
    random.seed(3)
    for _ in range(1500):
        a, b = ([random.randrange(4) for _ in range(random.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, k in np.ndindex(len(a), len(b)):
            best[i + 1][k + 1] = best[i][k] + 1 if a[i] == b[k] else max(best[i][k + 1], best[i + 1][k])
        kept = [x for x, y in zip(a, html_text.shared_lines(np.array(a, np.int64), np.array(b, np.int64)), strict=True) if y]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">cookies</div><aside>side</aside>
<article><h1>Title &amp; more</h1><p><b>One
 two.<br><p>Three&nbsp;four &lt;x&gt;.</p><ul><li>item a<li>item b</ul><div class="ad">buy</div><form>f</form><div id="comments"><p>reader</p></div></article>
<footer>&copy; foot</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(html_text.blocks(PAGE)) == "Title & more\nOne two.\nThree four <x>.\nitem a\nitem b"
    assert html_text.blocks("") == [] and html_text.blocks("<p title=it's>x")[0][1] == "x"
    assert [t for _, t in html_text.blocks("a <b>b</b> c<br>d<p>e")] == ["a b c d", "e"]


def test_differencing_without_article(spark):
    shell = "<body><div>Welcome to the site</div>{}<div>All rights kept</div></body>"
    rows = [(i, f"http://h.example/{i}", shell.format(f"<p>Own text {i}.</p>")) for i in range(5)] + [(9, None, None), (10, "http://h.example/3", PAGE)]
    got = {r["id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert {i: got[i] for i in range(5)} == {i: f"Own text {i}." for i in range(5)}
    assert got[9] == "" and got[10].startswith("Title & more")
    assert html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).count() == 0


def test_article_copies_keep_their_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE) for i in range(4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len({r["text"] for r in got}) == 1 and got[0]["text"].startswith("Title & more\nOne two.")


def test_copies_without_article_keep_their_text(spark):
    shell = "<body><div>Welcome to the site</div><p>Own text {}.</p><div>All rights kept</div></body>"
    rows = [(i, f"http://h.example/{i // 3}?print={i}", shell.format(i // 3)) for i in range(9)] + [(9 + i, f"http://k.example/{i}", shell.format(7)) for i in range(3)]
    got = {r["id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in range(9)} == {i: f"Own text {i // 3}." for i in range(9)}
    assert {got[i] for i in range(9, 12)} == {"Welcome to the site\nOwn text 7.\nAll rights kept"}


def page_texts(spark, rows):
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    return {r["id"]: r["text"] for r in got}


def test_groups_do_not_change_the_result(spark, monkeypatch):
    """Pages of a large host meet their neighbours across the cuts of groups and partitions."""
    shell = "<body><div>Section {0}</div><p>Own text {1}.</p></body>"
    rows = [(i, f"http://h.example/{i // 4:03}/{i:03}", shell.format(i // 4, i)) for i in range(80)]
    # A host of one path with many queries, and articles with a notice that all of them carry.
    shell = "<body><article><p>{}</p><p>Subscribe to us</p><p>The end.</p></article></body>"
    own = {i: f"Own text {i}, of which there is more than of what pages share." for i in range(80, 160)}
    rows += [(i, f"http://k.example/view?id={i}", shell.format(own[i])) for i in range(80, 160)]
    whole = {i: f"Own text {i}." for i in range(80)} | own
    for group in (7, 16, 1000):
        monkeypatch.setattr(html_text, "GROUP", group)
        assert page_texts(spark, rows) == whole


def test_lines_inside_articles(spark):
    """Only what all the pages around carry goes; what some articles share, and small hosts, stay."""
    page = "<body><nav>menu {0}</nav><article><h1>Title {0}</h1><p>{1}</p><p>{2}</p><p>Like and share us</p></article></body>"
    rows = [(i, f"http://h.example/{i:02}", page.format(i, "A saying." if i % 3 else "Another.", f"Text {i} of its own.")) for i in range(20)]
    rows += [(30 + i, f"http://few.example/{i}", page.format(i, "Once.", f"Text {i} of its own.")) for i in range(3)]
    got = page_texts(spark, rows)
    for i in range(20):
        assert got[i] == f"Title {i}\n{'A saying.' if i % 3 else 'Another.'}\nText {i} of its own."
    for i in range(3):
        assert got[30 + i] == f"Title {i}\nOnce.\nText {i} of its own.\nLike and share us"


def brute_page_texts(rows, needed=html_text.EVIDENCE):
    """The rules of differencing by plain loops: neighbours by a sort, subsequences by a table."""

    def common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, k in np.ndindex(len(a), len(b)):
            best[i + 1][k + 1] = best[i][k] + 1 if a[i] == b[k] else max(best[i][k + 1], best[i + 1][k])
        i, k, out = len(a), len(b), set()
        while i and k:
            if a[i - 1] == b[k - 1]:
                i, k = i - 1, k - 1
                out.add(i)
            elif best[i - 1][k] >= best[i][k - 1]:
                i -= 1
            else:
                k -= 1
        return out

    pages, out = [], {}
    for page, url, raw in rows:
        host, _, rest = url.split("://")[1].partition("/")
        pages.append((host, rest.split("?")[0], rest, page, html_text.blocks(raw)))
    pages.sort(key=lambda p: p[:3])
    for at, (host, _, _, page, found) in enumerate(pages):
        article = any(r == html_text.ARTICLE for r, _ in found)
        mine = {i: t for i, (r, t) in enumerate(found) if r == (html_text.ARTICLE if article else html_text.PLAIN)}
        total, met = sum(map(len, mine.values())), []
        for away in range(1, len(pages)):
            for k in (at - away, at + away):
                if 0 <= k < len(pages) and pages[k][0] == host and len(met) < (needed if article else 2):
                    shared = common([t for _, t in found], [t for _, t in pages[k][4]])
                    left = sum(len(t) for i, t in mine.items() if i not in shared)
                    if left > (0.5 if article else 0.05) * total:
                        met.append(shared)
        gone = set()
        if met and (not article or len(met) == needed):
            gone = set.intersection(*met) if article else set.union(*met)
        out[page] = "\n".join(t for i, t in mine.items() if i not in gone)
    return out


def test_differencing_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(html_text, "GROUP", 5)
    rng = random.Random(5)
    rows = []
    for i in range(60):
        own = [f"Line {rng.randrange(10**6)} of text." for _ in range(rng.randrange(1, 6))]
        body = [f"Site {i // 20}", "Read more", *own, *(["A saying of many."] if rng.random() < 0.5 else []), "Kept for you"]
        inner = "".join(f"<p>{x}</p>" for x in body)
        rows.append((i, f"https://{'abc'[i // 20]}.example/{rng.randrange(40):02}?n={i:02}", f"<nav>menu</nav><article>{inner}</article>" if i % 4 else inner))
    rows += [(60 + i, f"{url}&again=1", raw) for i, (_, url, raw) in enumerate(rows[:12])]
    assert page_texts(spark, rows) == brute_page_texts(rows)


def test_attributes_and_names_inside_articles():
    text = lambda x: html_text.main_text(html_text.blocks(x))
    assert text("<article><p title=it's>one two</p><p>it's three</p><p>four</p>") == "one two\nit's three\nfour"
    assert text("<article><p data-x='a>b' title=\"c>d\">one</p><p>two") == "one\ntwo"
    for name in ("class='more-text'", "class='legal'", "id='share-of-the-market'", "class='header-note'", "class='comment-free zone'"):
        assert text(f"<article><p>a</p><div {name}>b</div></article>") == "a\nb", name
    for name in ("class='ad'", "class='x share-buttons'", "id=comments", "class='commentList'", "class='cookie-notice'", "class='related-posts'", "role=navigation"):
        assert text(f"<article><p>a</p><div {name}>b</div></article>") == "a", name


def test_long_and_empty_pages(spark):
    """Thousands of lines in another order take moments and little memory; a long page loses nothing."""
    import tracemalloc

    lines = [f"line {i}" for i in range(4000)]
    mixed = lines[:]
    random.Random(1).shuffle(mixed)
    a, b = (np.array([hash(x) & (2**62 - 1) for x in y], np.uint64) for y in (lines, mixed))
    tracemalloc.start()
    assert 80 < html_text.shared_lines(a, b).sum() < 140
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    long = "<article>" + "".join(f"<p>{x}</p>" for x in lines * 10) + "</article>"
    rows = [(1, "http://h/1", long), (1, "http://h/1", long), (2, "http://h/2", ""), (3, "http://h/3", None), (None, None, "<p>x"), (4, "http://h/4", "<p")]
    got = page_texts(spark, rows)
    assert got == {1: "\n".join(lines * 10), 2: "", 3: "", None: "x", 4: ""}


def test_halved_tables_give_longest_subsequences(monkeypatch):
    monkeypatch.setattr(html_text, "TABLE_BITS", 12)
    test_common_subsequence()


@pytest.mark.parametrize("width", [3, 12])
def test_wrapped_license_notices(spark, width):
    texts = []
    for _, notice in licenses.TEMPLATES:
        words = ["other"] * len(texts) * 5 + notice.split() + ["words"] * 90
        texts.append("\n * ".join(" ".join(words[i : i + width]) for i in range(0, len(words), width)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in licenses.scan(df).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, (i, got[i])


def test_capitals_of_all_tokens_count():
    for text, share in (("a BB CC d", 0.5), ("AA b c d", 0.25), ("a b c d", 0.0)):
        assert quality.structure(text, text.split())[11] == 10 * share


def test_warc_round_trip(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "http://b/\r\nX: y", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (5, "", ""), (6, "u", "a" * 100_000)]
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path)
    found = warc.read(spark, path)
    assert found.count() == 18
    got = {r["metadata"]["page_id"]: r for r in warc.assemble(found).collect()}
    for page, _, html in rows:
        r = got[page]["response"]
        if page not in (2, 5):
            assert bytes(r["payload"]) == (html or "").encode() and r["record_type"] == "response"
        assert r["payload_bytes"] == len((html or "").encode()) and got[page]["request"]["record_type"] == "request"
    assert got[2]["response"]["refers_to"] == got[1]["capture_id"] and got[5]["response"]["refers_to"] == got[3]["capture_id"]
    empty = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").where("false"), empty)
    assert warc.read(spark, empty).count() == 0 and warc.assemble(warc.read(spark, empty)).count() == 0
    assert warc.parse(b"WARC/1.1\r\nbroken", True).__next__ is not None and list(warc.parse(b"WARC/1.0\r\n\r\n", True)) == []


def test_warc_members_sizes_and_repeats(spark, tmp_path, monkeypatch):
    """Archives of a member a record; large payloads in files of their own; frequent and repeated captures."""
    monkeypatch.setattr(warc, "LARGE", 1000)
    rows = [(i % 150, f"http://a/{i}", "" if i < 90 else f"<p>{i % 120}</p>" if i < 190 else "x" * (900 + i)) for i in range(300)] + [(None, None, None)]
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    for form in ("single", "members"):
        found = warc.assemble(warc.read(spark, path)).collect()
        assert len(found) == 301, form
        by_digest: dict = {}
        for r in found:
            by_digest.setdefault(r["response"]["payload_digest"], []).append(r)
        for group in by_digest.values():
            (first,) = [r for r in group if r["response"]["record_type"] == "response"]
            assert all(r["response"]["refers_to"] == first["capture_id"] for r in group if r is not first)
            ids = [r["metadata"]["page_id"] for r in group]
            assert first["metadata"]["page_id"] == (None if None in ids else min(ids))
        want = Counter((hashlib.sha1((html or "").encode()).hexdigest(), len((html or "").encode())) for _, _, html in rows)
        assert Counter((base64.b32decode(r["response"]["payload_digest"]).hex(), r["response"]["payload_bytes"]) for r in found) == want
        if form == "single":
            plain = b"".join(warc.inflated(f.read_bytes()) for f in sorted((tmp_path / "warc").glob("part-*")))
            records = [b"WARC/1.1\r\n" + x for x in plain.split(b"WARC/1.1\r\n")[1:]]
            path = str(tmp_path / "many")
            (tmp_path / "many").mkdir()
            (tmp_path / "many" / "part-0.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert warc.inflated(gzip.compress(b"whole") + gzip.compress(b"broken" * 999)[:20]).startswith(b"whole")


def test_warc_query_on_repeats(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (3, "w", None), (4, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("named", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in warc.op9(spark, str(tmp_path)).select("page_id", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
    assert got == [(1, "response", -1), (1, "revisit", 1), (2, "revisit", 1), (3, "response", -1), (4, "revisit", 3)]


def brute_license(text):
    lower = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
    labels = set()
    for line in lower.split("\n"):
        have = set(licenses.words_of(line))
        labels |= {r["label"] for r in licenses.template_rows() if len(have & set(r["words"])) >= r["overlap"]}
    words = licenses.words_of(text or "")
    places = sorted(i for p, _ in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), places, labels


def test_license_scan(spark):
    texts = [
        None, "", "...", "MIT License", "x mit license mit-license, Apache  License\nend", "general public licence", "the GNU General Public License here",
        "Released under the MIT Licence.", "Licensed under CC BY-NC 4.0.", "MİT license éé mit license", "word " * 5000 + "mit license",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("labels", F.lit("x"))
    got = {r["id"]: r for r in licenses.scan(df).collect()}
    for i, text in enumerate(texts):
        n, places, labels = brute_license(text)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places)), text
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None)), text
        base = {label for p, label in licenses.PHRASES if f" {p} " in " " + " ".join(licenses.words_of(text or "")) + " "}
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | labels))
    assert licenses.scan(df.where("false")).count() == 0


def test_machine_learns_and_scores(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "stone", "river"]) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(240)] + [(998, None), (999, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)] + [(5000, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    machine = quality.fit(docs, labels)
    got = quality.scored(docs, machine).collect()
    held = [r for r in got if r["held_out"] and r["id"] < 240]
    assert len(got) == 242 and len(held) > 40 and sum(r["predicted"] == int(r["id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality.good_only(docs, machine).where("doc_id < 240").count() == sum(r["predicted"] for r in got if r["id"] < 240)
    nothing = quality.fit(docs, labels.where("false"))
    assert {r["score"] for r in quality.scored(docs, nothing).collect()} == {0.5}


def test_interactions_equal_pairs():
    machine = quality.Machine()
    machine.v[:] = np.random.default_rng(0).normal(size=machine.v.shape)
    starts, ids, weights, stats = quality.features(["alpha beta beta gamma, 12"])
    x = np.concatenate([weights, machine.scaled(stats)[0]])
    v = np.concatenate([machine.v[ids], machine.v[quality.BUCKETS :]])
    pairs = sum(v[i] @ v[k] * x[i] * x[k] for i in range(len(x)) for k in range(i))
    assert abs(machine.margins(starts, ids, weights, stats)[0] - pairs) < 1e-2 * max(1, abs(pairs))


def brute_score(machine, text):
    """A score from the model's numbers alone: every pair of features, one by one."""
    tokens = re.findall(r"[^\W_]+|[^\w\s]+|_+", text)
    counts = Counter(zlib.crc32(t.lower().encode()) & (quality.BUCKETS - 1) for t in tokens)
    x = {b: math.sqrt(n / len(tokens)) for b, n in counts.items()}
    stats = (np.array(quality.structure(text, tokens)) - machine.mean) / machine.sd
    x |= {quality.BUCKETS + i: v for i, v in enumerate(np.clip(stats, -4, 4) / 2)}
    z = float(machine.bias) + sum(float(machine.w[i]) * v for i, v in x.items())
    keys = list(x)
    v = machine.v[keys].astype(np.float64) * np.array([x[k] for k in keys])[:, None]
    z += sum(float(v[i] @ v[:i].sum(0)) for i in range(1, len(keys)))
    return 1 / (1 + math.exp(-z))


def test_op8_over_the_whole_table(spark):
    """The query as registered against scores by brute force, and how well it does on rows held out."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    machine = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.op8(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for doc, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5)
        if doc % 7 == 0:
            assert abs(r["score"] - brute_score(machine, texts[doc])) < 2e-3, doc
    held = [(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if r["quality"] is not None and got[r["doc_id"]]["held_out"]]
    good, bad = ([s for q, s in held if q == k] for k in (1, 0))
    assert good and bad and np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.98


def test_quality_edges(spark, monkeypatch):
    """Nulls, repeated rows, long texts, an empty table, a sample bounded by its features."""
    rows = [(i, "stone river and the hill " * (i % 5 + 1) if i % 2 else "BUY!! NOW$$ " * (i % 5 + 1)) for i in range(60)]
    rows += [(3, "stone river and the hill"), (70, None), (None, "stone river"), (71, "the hill and stone " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "known_id", "drawn", "y", "id")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    got = quality.scored(docs, machine)
    assert got.count() == len(rows) and got.where("id = 71 and predicted = 1").count() == 1
    assert quality.scored(docs.where("false"), machine).count() == 0 and quality.good_only(docs.where("false"), machine).count() == 0
    assert quality.good_only(docs, machine).columns == docs.columns
    monkeypatch.setattr(quality, "TRAIN_FEATURES", 40)
    assert 0 < quality.scored(docs, quality.fit(docs, labels)).where("predicted = 1").count() <= len(rows)


def test_licenses_of_repeated_and_long_texts(spark):
    long = "word " * 30_000 + "mit license " + "x " * 30_000
    rows = [(1, long), (1, long), (2, "MIT License"), (2, "apache license"), (None, "general public license")]
    got = sorted((r["id"] or 0, r["n_words"], r["n_base"], r["base_labels"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 3, 1, "gpl"), (1, 60_002, 1, "mit"), (1, 60_002, 1, "mit"), (2, 2, 1, "apache"), (2, 2, 1, "mit")]
