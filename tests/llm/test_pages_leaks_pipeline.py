import html
import re
import time

import corpus_pipeline
from tidemark.llm import decontaminate_lsa as D, html_tree as H, queries as Q
from tidemark.llm.simhash_bk import fingerprint

import numpy as np

SF = "/root/testdata/sf0.01"
PROSE = ("<p>First para, with commas, and enough length to count as prose here.</p>"
         "<p>Second para &amp; more text, that goes on for a while, yes it does.</p>")
TEXT = "First para, with commas, and enough length to count as prose here.\nSecond para & more text, that goes on for a while, yes it does."


def test_every_page_equals_its_article(spark):
    rows = Q.op6_html_tree(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_tags_that_nothing_closes():
    """Time linear in the page, and the text of such tags is kept."""
    for piece in ("<a ", "<a", '<a "', "<a '\"", '<a <b "', "<b>"):
        start = time.process_time()
        H.parse(piece * (1_000_000 // len(piece)))
        assert time.process_time() - start < 30, piece
    texts = H.parse("<p>1 <a 2</p><p x='<b>'>3 < 4</p><i \"open").parts
    assert [p.tag if not isinstance(p, str) else p for p in texts] == ["p", "p", '<i "open'] and texts[1].attrs == {"x": "<b>"}
    assert texts[1].parts == ["3 < 4"]


def test_layouts():
    def page(before, after=""):
        return f"<html><body><header><h1>Site</h1></header>{before}{PROSE}{after}<footer>foot</footer></body></html>"

    comments = f"<div class='reader-comments'><h3>2 comments</h3>{PROSE}</div>"
    assert H.main_text(page("<nav><a href=1>Home</a></nav><div class=main><h2>Title</h2>", f"</div>{comments}")) == "Title\n" + TEXT
    assert H.main_text(page("<div id='cookie-notice'>We use cookies</div><article>", f"<aside>x, y, z</aside><form><input><button>Go</button></form></article>{comments}")) == TEXT
    assert H.main_text(f"<article class='post'>{PROSE}<section class='comments'><article class='comment'>{PROSE}</article></section></article>") == TEXT
    assert H.main_text(f"<form id=all><div id=header><a href=x>Logo</a></div><div id=main>{PROSE}</div></form>") == TEXT
    assert H.main_text(f"<table><tr><td><a href=1>m1</a><br><a href=2>m2</a></td><td>{PROSE}</td></tr></table>") == TEXT
    assert H.main_text(f"<div style='display:none'>{PROSE}</div><div>{PROSE}</div>") == TEXT
    assert H.main_text(f"<div>{PROSE}<ul><li>One, item<li>Two</ul><table><tr><td>a<td>b</table></div>") == TEXT + "\nOne, item\nTwo\na\nb"


def test_sectioned_pages_keep_every_section():
    def prose(name):
        return f"{name} " + "word " * 58 + "end."

    for n, size, tag in ((2, 2, "div"), (3, 1, "div"), (3, 1, "section"), (4, 2, "section"), (6, 3, "div")):
        for head in ("", "<h2>Title</h2>"):
            parts = [[prose(f"s{i}p{j}") for j in range(size)] for i in range(n)]
            inner = "".join(f"<{tag}>{head}" + "".join(f"<p>{p}</p>" for p in ps) + f"</{tag}>" for ps in parts)
            got = H.main_text(f"<html><body><nav><a href=1>Home</a></nav>{inner}<footer>foot</footer></body></html>")
            assert got == "\n".join(x for ps in parts for x in (["Title"] if head else []) + ps)


def test_broken_pages():
    assert [H.main_text(x) for x in (None, "", "   ", "<", "<div>", "<script>x", "<!-- open")] == ["", "", "", "<", "", "", ""]
    assert H.main_text("just text &lt; here") == "just text < here"
    assert H.main_text("<p>a</b></i></div><p>b&#233;&nbsp; c") == "a\nbé c"
    assert H.main_text("x<script>var a='</p>'</script>y<style>p{}</style><!-- <p> -->z") == "xyz"
    assert H.main_text("<div>" * 20_000 + "deep" + "</b></p>" * 20_000) == "deep"
    assert H.main_text("<p>" + "long, words " * 100_000) == " ".join(["long, words"] * 100_000)


def test_pages_with_odd_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, f"<p>{TEXT}", None), (3, f"<p>{TEXT}", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(r.text for r in H.extract(pages).collect()) == ["", "", TEXT.replace("\n", " "), TEXT.replace("\n", " ")]
    assert H.extract(pages.limit(0)).collect() == []


def words(text):
    return [x.decode() for x in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())]


def test_every_leak_is_found_and_nothing_else(spark):
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        line = f" {' '.join(words(r.text))} "
        want |= {(r.doc_id, i) for i, t in items.items() if f" {t} " in line}
    got = Q.op2_decontaminate_lsa(spark, SF).collect()
    assert len(want) > 20 and {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.overlap == 1.0 and r.answer_found for r in got)


def test_paraphrases(spark):
    """Items with every fifth word replaced, but for their ends, within other documents; unrelated ones are left alone."""
    rng = np.random.default_rng(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text.split() for r in bench.collect() if len(r.text.split()) >= 20}
    other = [w for _, t in docs[:50] for w in t.split()]
    planted = {}
    for n, (i, text) in enumerate(items.items()):
        close = [w if k % 5 or k >= len(text) - 6 else other[int(rng.integers(len(other)))] for k, w in enumerate(text)]
        planted[10_000 + n] = i
        docs.append((10_000 + n, " ".join(other[60 * n:60 * n + 50] + close + other[60 * n + 50:60 * n + 60])))
    found = {(r.doc_id, r.item_id): r for r in D.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), bench).collect()}
    hits = [found.get(pair) for pair in planted.items()]
    assert sum(h is not None for h in hits) >= 0.9 * len(planted)
    assert all(h.overlap >= D.CLOSE and h.answer_found for h in hits if h and h.overlap < D.EXACT)
    assert not [p for p in found if p[0] >= 10_000 and planted[p[0]] != p[1]]


def test_leaks_edge_cases(spark):
    stock = [f"w{k % 701}" for k in range(3000)]
    item = [f"item{k}" for k in range(40)]
    far = [w if k % 2 else f"other{k}" for k, w in enumerate(item)]
    rows = [(1, " ".join(stock[500:700] + item + stock[700:900]).upper(), "x"), (3, " ".join(stock[1100:1200] + far + stock[1200:1300]), "x"), (4, None, "x"),
            (5, "", "x"), (6, " ".join(stock * 100), None), (7, " ".join(item), "x"), (7, " ".join(item), "x"), (None, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item), "y"), (11, None, "y"), (12, "", "y"), (13, "!!", "y")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in D.find(docs, bench).collect()}
    assert set(got) == {(1, 10), (7, 10)} and got[1, 10].overlap == 1.0
    assert sorted(r.doc_id or 0 for r in D.clean(docs, bench).collect()) == [0, 3, 4, 5, 6]
    assert D.clean(docs, bench).columns == docs.columns
    # an item goes without an id too, and a clean text stays beside one that shares its id
    more = docs.union(spark.createDataFrame([(None, " ".join(item), "z"), (7, "clean text", "z")], docs.schema))
    left = [(r.doc_id, r.text) for r in D.clean(more, bench).collect()]
    assert sorted(i or 0 for i, _ in left) == [0, 3, 4, 5, 6, 7] and (7, "clean text") in left and (None, "a b") in left
    assert D.find(docs.limit(0), bench).collect() == [] and D.find(docs, bench.limit(0)).collect() == []


def test_subsequence_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 20).tolist()
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert D.lcs(a, b) == row[-1]


def test_passage_counts_equal_sets():
    rng = np.random.default_rng(1)
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 30, n)) for n in (0, 5, 8, 9, 100, 24, 25, 0, 300)]
    _, term, bounds = D.terms_of(texts)
    start, end, text = D.parts_of(bounds)
    want = np.zeros(D.TERMS, int)
    for i in range(len(start)):
        last = max(j for j in range(i, min(len(start), i + D.SPAN)) if text[j] == text[i])
        for k in set(term[start[i]:end[last]].tolist()):
            want[k] += 1
    assert (D.passage_counts(term, start, end, text) == want).all()


def test_pipeline_stage_by_stage(spark):
    """Every stage against a plain version on its own input, then the whole run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "simhash", "decontamination", "sentencepiece"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    gone = ids[0] - ids[1]
    assert len(gone & toxic) > 0.6 * len(toxic) and len(gone - toxic) < 0.02 * len(ids[0]) + len(toxic)
    assert ids[1] == ids[2]  # all texts have letters and a language
    texts = {r.doc_id: r.text for r in kept[2].collect()}
    from tests.llm.helpers import near_components
    assert ids[3] == set(near_components(list(texts), [fingerprint(t.encode()) for t in texts.values()], 2).values())
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[4] == {i for i in ids[3] if not any(f" {t} " in f" {' '.join(words(texts[i]))} " for t in items)}
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(whole) == ids[4] and all(r.exact and r.n_pieces == len(r.ids) for r in whole.values())


def test_pipeline_edge_cases(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "s", 0), (3, "the the of and", "en", "s", 9), (3, "the the of and", "en", "s", 9), (4, "12", "en", "s", 2),
            (None, "the and of to", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, expected in ((docs, [None, 3]), (docs.limit(0), [])):
        got = frame
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, SF)
        assert sorted((r.doc_id for r in got.collect()), key=lambda i: i or 0) == expected
