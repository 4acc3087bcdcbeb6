import math
import random
import time

import pytest

from colonnade.llm import html_text, licenses, url_filter

SF = "/root/testdata/sf0.01"


def test_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/x?q=1", "https://a.example.com/en/", "https://example.com/english", "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/#a", "nothing",
            None, "http://com", "http://notcom/x", "ftp://É.ORG:80?x", "http://a.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judged(pages, url_filter.UrlModel(None, {}, 0.0)).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("www.example.com", "/en/x", "www.example.com/en/"), ("a.example.com", "/en/", "example.com/en/"), ("example.com", "/english", "com/"), ("x.net", "/es/1", "net/es/"),
        ("x.net", "/fr", None), ("x.net", "/fr/", "net/fr/"), ("", "", None), ("", "", None), ("com", "", None), ("notcom", "/x", None), ("É.org:80", "", None), ("a.com", "/", "com/")]


def test_trees_find_seeded_hosts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seeded = url_filter.seeded(pages)
    rows = url_filter.judged(pages, url_filter.fit(seeded)).join(pages.join(seeded, "url").select("page_id", "label"), "page_id").filter("rule IS NULL").collect()
    assert sum((r.verdict == "block") == r.label for r in rows) >= 0.97 * len(rows)


def test_suffix_counts_cover_every_suffix(spark):
    # 400 hosts of equal shape, one half blocked: only their suffixes tell them apart, and the sample holds few of them
    rows = [(f"http://www.{draw}.org/p{k}", int(i % 2)) for i, draw in enumerate(random.Random(6).sample([f"{a}{b}{c}" for a in "bcdf" for b in "ghjkl" for c in "mnpqrstvwx"] + [f"{a}{b}{c}" for a in "mnpq" for b in "rstvw" for c in "bcdfghjklz"], 400)) for k in range(12)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.fit(labelled, bound=1200)
    pages = spark.createDataFrame([(i, url.replace("/p", "/q")) for i, (url, _) in enumerate(rows)] + [(-1, "http://www.zzz.org/q1")], "page_id long, url string")
    got = {r.page_id: r for r in model.featured(pages).collect()}
    assert len(got) == len(rows) + 1
    for i, (_, label) in enumerate(rows):
        assert got[i].suffix_share == pytest.approx((12 * label + 1) / 14) and got[i].suffix_seen == pytest.approx(math.log(13)) and got[i].top_share == pytest.approx(0.5)
    assert (got[-1].suffix_share, got[-1].suffix_seen) == (0.5, 0.0)
    verdicts = {r.page_id: r.verdict for r in url_filter.judged(pages, model, ()).collect()}
    assert sum((verdicts[i] == "block") == label for i, (_, label) in enumerate(rows)) >= 0.99 * len(rows)


def test_entropy(spark):
    rows = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "url string").select(url_filter.entropy(url_filter._text(url_filter.F.col("url"))).alias("e")).collect()
    assert [r.e for r in rows] == pytest.approx([1.0, 0.0, 2.0])


def text_of(source, trees=None):
    return html_text.extracted([source], trees)[0]


def test_tree_building():
    page = html_text.Page("<p>a<b>b<p>c</b>d<ul><li>e<li>f</ul><div>g</p>h<table><tr><td>i<td>j</table>&amp;&eacute;&#x41;&nosuch; 1 < 2<!-- x --><script>var s='</p>'</script>k<br>l")
    assert [n.tag for n in page.nodes] == ["html", "p", "p", "ul", "li", "li", "div", "table", "tr", "td", "td"]
    assert text_of("<p>a<b>b</b>c<p>d &lt;x&gt; <3 e") == "abc d <x> <3 e"
    assert text_of("<title>t</title><style>s</style><p>x <span>y</span></p><script>z") == "x y"
    assert [text_of(x) for x in ("", "plain", "<", "<p", "<div class='", "</", "<p>a &am")] == ["", "plain", "<", "", "", "</", "a &am"]


@pytest.mark.parametrize("source", ["<div></section>" * 20000, "<div>" * 20000 + "x", "<object>" * 20000, "<div>" * 10000 + "<li></li>" * 10000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000])
def test_broken_pages_take_linear_time(source):
    begun = time.process_time()
    small = html_text.extracted([source], None)
    once = time.process_time() - begun
    assert small == ["x" if source.endswith("x") else ""] and once < 5


def test_closing_tags_that_match_nothing():
    page = html_text.Page("<div><p>a</section></b>b</p><b>c<div>d</b>e</div>f</div>g<td>h</table>i")
    assert [(n.tag, n.parent) for n in page.nodes] == [("html", -1), ("div", 0), ("p", 1), ("div", 1), ("td", 0)]
    assert [(node, text) for node, text, _ in page.pieces] == [(2, "a"), (2, "b"), (1, "c"), (3, "d"), (3, "e"), (1, "f"), (0, "g"), (4, "h"), (4, "i")]


def test_tree_text_form():
    trees = html_text.trees_of("GBT\n  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 1 <= 2.0)\n      Predict: -1.0\n     Else (feature 1 > 2.0)\n      Predict: 0.25\n"
                               "    Else (feature 3 > 0.5)\n     Predict: 2.0\n  Tree 1 (weight 0.1):\n    Predict: 10.0\n")
    x = html_text.np.zeros((3, 4))
    x[1, 1], x[2, 3] = 5, 1
    assert trees.margin(x).tolist() == [0.0, 1.25, 3.0]


def test_decoding_is_consistent_and_best():
    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 9)
        parent = html_text.np.array([-1] + [draw.randrange(i) for i in range(1, n)])
        margin = html_text.np.array([draw.uniform(-1, 1) for _ in range(n)])
        text = html_text.np.array([float(draw.randint(0, 5)) for _ in range(n)])
        keep = html_text.decoded(parent, margin, text)
        gain = margin * (text + 0.1)
        options = [k for k in range(1 << n) if k & 1 and all(not k >> i & 1 or k >> int(parent[i]) & 1 for i in range(1, n))]
        best = max(sum(gain[i] for i in range(n) if k >> i & 1) for k in options)
        assert all(not keep[i] or keep[parent[i]] for i in range(1, n))
        assert sum(gain[keep]) == pytest.approx(best)


PAGE = ('<html><head><title>T</title></head><body><header><a href="/">Home</a></header><div class="cookie-notice"><p>We use cookies on this site.</p></div><nav><ul><li><a>One</a></li></ul></nav>'
        '{open}<h1>Head line</h1><p>First paragraph of the story, with enough words to read.</p><div class="ad">Buy things now.</div><p>Second <a href="#">linked</a> paragraph, which goes on for a while.</p>'
        '<section id="comments"><p>Nice one, thanks a lot for this.</p></section>{close}<aside class="sidebar"><p>Other stories</p></aside><form><p>Your mail</p></form><footer>&copy; Someone</footer></body></html>')
MAIN = "Head line First paragraph of the story, with enough words to read. Second linked paragraph, which goes on for a while."


def test_learned_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = html_text.fit(pages)
    for box in ("article", "main", "div class='content'", "div class='post'"):
        assert text_of(PAGE.format(open=f"<{box}>", close=f"</{box.split()[0]}>"), trees) == MAIN
    src = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    for key, source in src.items():
        inside = html_text.ARTICLE.search(source)[1]
        assert got[key] == " ".join(html_text.html.unescape(html_text.re.sub(r"<(?!/?b>)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())


def test_held_out_pages_and_layouts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = html_text.fit(pages.filter("page_id % 2 = 0"))
    held = [r.html for r in pages.filter("page_id % 2 = 1").collect()]
    right = seen = 0.0
    for seed, source in enumerate(held[:60]):
        for page, label in html_text.layouts(source, seed + 1000):
            x, parent, text = html_text.features([page])
            use = label >= 0
            keep = html_text.decoded(parent, trees.margin(x), text)
            right += text[use & (keep == (label == 1))].sum()
            seen += text[use].sum()
    assert right >= 0.98 * seen
    whole = [" ".join(html_text.html.unescape(html_text.re.sub(r"<(?!/?b>)[^>]*>", " ", html_text.ARTICLE.search(h)[1]).replace("<b>", "").replace("</b>", "")).split()) for h in held]
    assert html_text.extracted(held, trees) == whole


def test_labels_follow_from_the_place():
    page, label = html_text._labelled('<nav>a</nav><article><p>b</p><div class="ad"><p>c</p></div><div class="x" data-made="1"><p>d</p></div></article><div>e</div>', "article")
    got = {text: int(label[node]) for node, text, _ in page.pieces}
    assert got == {"a": 0, "b": 1, "c": -1, "d": 0, "e": 0}


def dice(a, b):
    from collections import Counter
    x, y = Counter(a), Counter(b)
    return 2 * sum((x & y).values()) / (len(a) + len(b))


def test_licences_match_brute_force(spark):
    draw = random.Random(8)
    some = ["licensed", "under", "the", "mit", "license", "apache", "version", "2", "0", "released", "cc", "by", "nc", "4", "x"]
    texts = [" ".join(draw.choices(some, k=draw.randint(0, 25))) for _ in range(80)] + ["Foo.\nLicensed under the Apache License,\nVersion 2.0. Bar", None, "", "Released UNDER the MIT-License!"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text or "").split()
        grams, best, names = list(zip(w, w[1:])), 0.0, set()
        for name, template in licenses.TEMPLATES:
            t = "".join(c.lower() if c.isalnum() else " " for c in template).split()
            t = list(zip(t, t[1:]))
            top = max((dice(grams[a:b], t) for a in range(len(grams)) for b in range(a + 1, min(len(grams), a + 2 * len(t)) + 1)), default=0.0)
            best = max(best, top if top >= licenses.LIMIT else 0.0)
            if top >= licenses.LIMIT:
                names.add(name)
        assert (got[i].dice or 0.0) == pytest.approx(best) and (got[i].licenses or "") == ",".join(sorted(names))


def test_licences_that_share_sentences(spark):
    gnu = "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
           "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n")
    name = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    end = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES"
    gpl3, agpl = gnu.format("This program", ":", "General", ",", "3"), gnu.format("This program", ":", "Affero General", ",", "3")
    cases = [
        (agpl, "AGPL-3.0"), (gpl3, "GPL-3.0"), (gnu.format("This program", ";", "General", ";", "2"), "GPL-2.0"), (gnu.format("This library", ";", "Lesser General", ";", "2.1"), "LGPL-2.1"),
        (agpl + " Some other words between. " * 9 + gpl3, "AGPL-3.0,GPL-3.0"), (bsd + end, "BSD-2-Clause"), (bsd + name.format("Foo Inc.") + end, "BSD-3-Clause"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", "CC-BY-4.0,CC-BY-SA-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [names for _, names in cases]
