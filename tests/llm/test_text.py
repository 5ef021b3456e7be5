"""Page extraction, the quality classifier, token counts and the pipeline."""

import math
import random

import pytest

from plinth.llm import common, counts, pages, quality, queries

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b>  text&nbsp;here.<br>Second line.<p>Third &lt;one&gt; &copy;</p><ul><li>item one<li>item two</ul>"
TEXT = "Title & more\n\nFirst bold text here. Second line.\n\nThird <one> ©\n\nitem one\n\nitem two"
PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
    '<!-- note --><div class="ad banner">Buy now</div><div id="cookie-notice">We use cookies</div><form><label>Mail</label><input></form><{0}>{1}</{0}><aside>Related</aside>'
    '<section class="comments"><article class="comment">I disagree</article></section><footer>&copy; site</footer></body></html>'
)


def test_article_is_found():
    lines = pages.lines_of(PAGE.format("article", ARTICLE))
    assert "\n\n".join(x for x, own in lines if own) == TEXT and all(own for _, own in lines)
    assert "\n\n".join(x for x, _ in pages.lines_of(PAGE.format("div", ARTICLE))) == TEXT


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []),
        ("", []),
        ("plain words", ["plain words"]),
        ("a &amp;amp; b &#65; &unknown; &lt", ["a &amp; b A &unknown; <"]),
        ("1 < 2 and <b>x</b>y", ["1 < 2 and xy"]),
        ("<p>open <i>never closed<p>next", ["open never closed", "next"]),
        ("<script>no</script><p>yes</p><script>unclosed", ["yes"]),
        ("<p hidden>no</p><p style='display:none'>no</p><p>yes</p>", ["yes"]),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", ["a b", "c"]),
        ("</div></p>stray<div>end", ["stray", "end"]),
        ("<!-- unclosed <p>x</p>", []),
    ],
)
def test_markup(html, want):
    assert [x for x, _ in pages.lines_of(html)] == want


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(12))], [rng.randrange(5) for _ in range(rng.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = pages.common_lines(a, b)
        assert found == sorted(set(found)) and len(found) == best[-1][-1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in found)


def test_differencing_removes_what_neighbours_share(spark):
    own = [f"<p>Own text of page {i} about {w}.</p><p>A second own paragraph, {i}.</p><p>And one more {i * 7}.</p>" for i, w in enumerate(("rivers", "stones", "clouds", "winter"))]
    site = lambda x: f"<div>Home of things</div><div>Sections of the site</div>{x}<div>Written by the editors</div>"
    rows = [(i, f"https://www.site.example/a/{i}", site(x)) for i, x in enumerate(own)]
    rows += [(10, "http://other.example/a/1", site("<p>Lone page.</p>")), (11, None, "<p>No address</p>"), (12, "http://site.example/a/9", None), (13, "http://[bad", "<p>x</p>"), (0, rows[0][1], rows[0][2])]
    out = [tuple(r) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    text = {r[0]: r[2] for r in out}
    assert len(out) == len(rows) and text[1] == "Own text of page 1 about stones.\n\nA second own paragraph, 1.\n\nAnd one more 7."
    assert text[10].startswith("Home of things") and text[12] == "" and text[11] == "No address"
    assert all(r[3] == len(r[2]) for r in out)


def test_differencing_decides_outside_an_article_too(spark):
    html = lambda i: f"<div>Home</div><h1>Title {i}</h1><article><p>Shared.</p><p>Own {i}.</p></article><div>Imprint</div>"
    rows = [(i, f"http://t.example/{i}", html(i)) for i in range(3)]
    text = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert text == {i: f"Title {i}\n\nShared.\n\nOwn {i}." for i in range(3)}


def test_differencing_where_site_text_dominates(spark):
    menu = "".join(f"<div>Section number {k}</div>" for k in range(10))
    page = lambda i: f"{menu}<p>First of page {i}.</p><p>Second of page {i}.</p>"
    rows = [(i, f"http://m.example/{i}", page(i)) for i in range(4)] + [(4, "http://m.example/3x", page(3))]  # a copy beside 3
    text = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [text[i] for i in (1, 2)] == [f"First of page {i}.\n\nSecond of page {i}." for i in (1, 2)]


def test_a_page_beside_its_copy_is_compared_with_the_next(spark):
    html = lambda i: f"<div>Home</div><div>Sections</div><p>First of page {i}.</p><p>Second of page {i}.</p>"
    rows = [(i, f"http://c.example/{i}", html(i)) for i in range(3)] + [(3, "http://c.example/2/copy", html(2))]
    text = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert text[2] == "First of page 2.\n\nSecond of page 2."


@pytest.mark.parametrize("name", ["site has-sidebar", "post no-comments", "entry-content share-enabled", "login-guide-article", "page", "content"])
def test_names_of_wrappers_leave_the_article(name):
    for attribute in ("class", "id"):
        html = f'<div {attribute}="{name}"><h1>A title</h1><p>The text of the page, which is its main part.</p></div><div class="cookie-notice">Cookies!</div>'
        assert [x for x, _ in pages.lines_of(html)] == ["A title", "The text of the page, which is its main part."]


def test_a_name_does_not_drop_most_of_the_text():
    text = "<p>All that the page has to say, at some length, is in here.</p>"
    assert len(pages.lines_of(f'<form id="f"><nav>Menu</nav>{text}</form>')) == 1
    assert len(pages.lines_of(f'<div class="widget">{text}</div><div class="ad">Buy</div>')) == 1
    comments = f'<div class="comments">{text * 5}</div>'
    assert [x for x, _ in pages.lines_of(f"<article><p>Short.</p></article>{comments}")] == ["Short."]


def plain_extract(rows):
    """The query by plain loops: every page against its nearest other page of the host, by a table of all prefixes."""

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    hosts = {}
    for _, url, html in rows:
        host, path = pages.place_of(url)
        lines = tuple(pages.all_lines(html))
        own = hosts.setdefault(host, {})
        own[lines] = min(path, own.get(lines, path))
    out = []
    for page, url, html in rows:
        host, _ = pages.place_of(url)
        lines = tuple(pages.all_lines(html))
        order = sorted(hosts[host].items(), key=lambda x: x[1])
        at = [k for k, (x, _) in enumerate(order) if x == lines][0]
        beside = sorted((order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)), key=lambda x: -pages._nearness(x[1], order[at][1]))
        may = {i for i, (_, own, out_) in enumerate(lines) if not own and not out_}
        found = [lcs([x[0] for x in lines], [x[0] for x in other]) & may for other, _ in beside]
        gone = found[0] if found else set()
        if len(gone) > pages.COPY * len(may):
            gone &= found[1] if len(found) > 1 else set()
        text = "\n\n".join(x for i, (x, _, out_) in enumerate(lines) if not out_ and i not in gone)
        out.append((page, url, text, len(text)))
    return out


def test_query_of_pages_is_the_plain_one(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        menu = "".join(f"<div>Section {k} of host {i % 4}</div>" for k in range(rng.randrange(2, 8)))
        wrap = rng.choice(["article", "div", "main", "div class='site has-sidebar'"])
        body = "".join(f"<p>Paragraph {rng.randrange(10**6)} of page {i}.</p>" for _ in range(rng.randrange(0, 5)))
        html = f"<html><nav>Nav {i}</nav>{menu}<{wrap}>{body}<p>A passage of all.</p></{wrap.split()[0]}><div>Imprint of host {i % 4}</div><footer>End</footer></html>"
        rows.append((i, f"https://www.h{i % 4}.example/{rng.choice('abc')}/{i}", html))
    rows += [(100, rows[0][1] + "/copy", rows[0][2]), (101, None, "<p>x"), (102, "http://z.example/", None), (103, "http://z.example/a", ""), rows[5], (104, "http://z.example/long", "<p>long text &amp; more</p>" * 60_000)]
    table = spark.createDataFrame([(a, b, c, "clash", 1) for a, b, c in rows], "page_id long, url string, html string, text string, row int")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op1_page_differencing(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(got, key=key) == sorted(plain_extract(rows), key=key)


def test_shared_passages_of_articles_stay(spark):
    rows = [(i, f"http://s.example/{i}", PAGE.format("article", f"<p>Shared passage.</p><p>Own {i}</p>")) for i in range(4)]
    out = pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert sorted(r.text for r in out) == [f"Shared passage.\n\nOwn {i}" for i in range(4)]
    assert pages.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


def junk(i):
    rng = random.Random(i)
    return [" ".join(["same"] * 40), " | ".join(str(rng.random()) for _ in range(30)), " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in "some words with many symbols in them".split() * 4)][i % 3]


def test_factorisation_identity():
    rng = quality.np.random.default_rng(0)
    m = quality.Model(0.1, rng.normal(size=quality.DIM), rng.normal(size=(quality.DIM, quality.FACTORS)) * 0.1)
    slots, x = quality.np.array([3, 9, 40, 77]), quality.np.array([0.5, 1.0, -0.2, 0.7])
    z = m.bias + m.weights[slots] @ x + sum(m.factors[slots[i]] @ m.factors[slots[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert math.isclose(m.score(slots, x), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality_on_held_out_rows(spark, documents, prose):
    rows = [(i, prose(i, 60 + i % 50) if i % 3 else junk(i // 3)) for i in range(450)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = documents(rows)
    model = quality.train(docs, labels)
    out = quality.score(docs, model).withColumn("held_out", quality.held_out()).collect()
    held = [r for r in out if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out) and len(held) > 50
    assert sum((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    kept = quality.score(docs, model, least=0.7)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.score >= 0.7}


def test_quality_odd_rows(spark, odd, documents):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(out) == 9 and {r.score for r in out} == {0.5}
    assert quality.score(documents([]), quality.train(documents([]), labels)).collect() == []


def plain_count(trie, word):
    """Best segmentation by trying all cuts, from the end."""
    from functools import lru_cache

    @lru_cache(None)
    def best(end):
        if end == 0:
            return (0.0, 0)
        options = []
        for a in range(end):
            if (s := trie.scores.get(word[a:end])) is not None:
                t, n = best(a)
                options.append((t + s, -(n + 1)))
        if not options:
            n = len(word[end - 1].encode())
            t, m = best(end - 1)
            options.append((t + n * trie.byte_score, -(m + n)))
        s, n = max(options)
        return (s, -n)

    return best(len(word))


def test_trie_counts(prose):
    trie = counts.load(counts.default_path())
    words = sorted({w for i in range(6) for w in prose(i, 40).split()}) + ["日本", "naïve", "😀😀", "x" * 60, "don't", "y" * 1500]
    for w, found in zip(words, trie.of([w.encode() for w in words]), strict=True):
        s, n = plain_count(trie, counts.MARK + w)
        assert found[0] == n and math.isclose(found[1], s, rel_tol=1e-9)
    nodes = len(trie.best)
    trie.known.clear()
    trie.old.clear()
    trie.of([w.encode() for w in words[:-1]])
    assert len(trie.best) == nodes == len(trie.next) + 1  # prefixes are scored once


def test_query_of_counts_gives_whole_documents(spark, documents, prose, odd, tmp_path):
    trie = counts.load(counts.default_path())
    long = " ".join([prose(3, 900)] * 160) + "\u2003tail"
    for n, table in enumerate((documents([(i, prose(i, 30 * i) + "\x1c\u3000 a") for i in range(12)] + [(99, long)]), odd)):
        table.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = sorted((r.doc_id or -1, r.n_words, r.n_tokens, round(r.score, 3)) for r in queries.op8_trie_token_counts(spark, f"{tmp_path}/{n}").collect())
        want = []
        for r in table.collect():
            words = (r.text or "").split()
            seen = {w: plain_count(trie, counts.MARK + w) for w in set(words) if len(w) < 900}
            if any(len(w) >= 900 for w in words):
                seen |= {w: (f := trie.of([w.encode()])[0])[::-1] for w in words if len(w) >= 900}
            want.append((r.doc_id or -1, len(words), sum(seen[w][1] for w in words), round(math.fsum(seen[w][0] for w in words), 3)))
        for a, b in zip(got, sorted(want), strict=True):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-6, abs_tol=1e-2)


def test_trie_starts_anew_with_the_same_results(prose, monkeypatch):
    texts = [list({w.encode(): 1 for w in prose(i, 100).split()}) for i in range(8)]
    trie = counts.Trie(list(counts.load(counts.default_path()).scores.items()), -20.0)
    whole = [trie.of(t) for t in texts]
    monkeypatch.setattr(counts, "NODES", 50)
    monkeypatch.setattr(counts, "KNOWN", 20)
    assert [trie.of(t) for t in texts] == whole


def test_counts_odd_rows(odd, documents):
    rows = counts.token_counts(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 9 and by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 0
    assert by[8].n_words == 3000 and by[8].n_tokens % 3000 == 0 and by[7].n_words == 1
    assert counts.token_counts(documents([])).collect() == []


def test_pipeline(spark, documents, prose, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    bench = [(0, prose(900, 30)), (1, prose(901, 25))]
    rows = [(i, "\n".join(prose(1000 + 10 * i + k, 30) for k in range(3))) if i % 3 else (i, junk(i // 3)) for i in range(240)]
    rows += [(300, rows[1][1]), (301, prose(5000, 40) + " " + bench[0][1] + "\n" + prose(5001, 30))]
    w = prose(6000, 200).split()
    rows += [(302, " ".join(w)), (303, " ".join([*w[:90], "edited", *w[91:]]))]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = common.table(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in seen[name].values())
    good = {i for i in range(240) if i % 3} | {300, 301, 302, 303}
    assert len(set(seen["quality_classifier"]) ^ good) <= 3
    assert 300 not in seen["line_dedup"] and 303 not in seen["line_dedup"] and 302 in seen["line_dedup"]
    assert set(seen["simhash_near_dedup"]) == set(seen["line_dedup"])
    assert set(seen["simhash_near_dedup"]) - set(seen["decontamination"]) == {301}
    assert set(seen["packing"]) == set(seen["decontamination"])
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert total.count() == docs.count() and total.columns == docs.columns
