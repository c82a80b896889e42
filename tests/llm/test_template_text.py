import random
import time
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")


def extract(spark, rows):
    from tessera.llm.html import extract_text

    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_text_and_wrappers(spark):
    def page(i):
        return f"<html><body class='has-sidebar menu'><article class='post has-comments'><p>Own text number {i} of this page</p><div class=zz>Follow our daily letter</div><div>Read it all</div></article></body></html>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(8)]
    # Copies of one page, and a host of two pages, do not make their text a template.
    rows += [(20 + i, f"http://copies/{i}", page(99)) for i in range(8)] + [(30 + i, f"http://few/{i}", "<article><p>Same</p></article>" + " " * i) for i in range(2)]
    got = extract(spark, rows)
    assert all(got[i] == f"Own text number {i} of this page" for i in range(8))
    assert all(got[20 + i] == "Own text number 99 of this page\nFollow our daily letter\nRead it all" for i in range(8))
    assert got[30] == got[31] == "Same"


def test_mirrored_articles_are_kept(spark):
    def page(note, article):
        return f"<html><body><nav><ul><li><a>Menu</a></li></ul></nav><!-- {note} --><article><h1>Title</h1><div class=lead>Lead</div><p>{article}</p></article><footer>Foot</footer></body></html>"

    whole = "Title\nLead\nThe same article"
    for n in (2, 3, 4, 5, 9):
        assert set(extract(spark, [(i, "http://m/", page(i, "The same article")) for i in range(n)]).values()) == {whole}
    # Beside other pages too: one more page does not flip the others.
    rows = [(i, None, page(i, "The same article")) for i in range(5)]
    rows.append((5, None, "<html><body><article><h1>Other</h1><div class=text>More</div></article></body></html>"))
    got = extract(spark, rows)
    assert all(got[i] == whole for i in range(5)) and got[5] == "Other\nMore"
    # A paragraph that all pages of a host share is the article's.
    shared = extract(spark, [(i, "http://s/", f"<article><p>Own {i}</p><p>Shared paragraph</p></article>") for i in range(6)])
    assert all(shared[i] == f"Own {i}\nShared paragraph" for i in range(6))


def test_words_in_classes(spark):
    rows = [
        (1, "http://a/1", "<body><section class='search-and-rescue'>Found at sea</section></body>"),
        (2, "http://b/2", "<article><p>One</p><div class='social-history'>Two</div></article>"),
        (3, "http://c/3", "<body><div class='post share-story'>A long story</div><div>x</div></body>"),
        (4, "http://d/4", "<article><p>One</p><div class='ad-banner'>Buy</div><div class='post-comments'>Me too</div><section id=related-articles>Next</section><div role=navigation>Go</div></article>"),
        (5, "http://e/5", None), (6, "http://f/6", ""), (7, None, "<p>No host"), (7, None, "<p>No host"), (8, "http://g/8", "plain &amp; simple  text"),
    ]
    from tessera.llm.html import extract_text

    got = extract(spark, rows)
    assert got == {1: "Found at sea", 2: "One\nTwo", 3: "A long story", 4: "One", 5: "", 6: "", 7: "No host", 8: "plain & simple text"}
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, size int")
    assert extract_text(frame).count() == len(rows) and extract_text(frame.limit(0)).count() == 0


def test_deep_and_long_pages_take_linear_time():
    from tessera.llm.html import main_text, page_tokens

    began = time.time()
    deep = "<div>a" * 100_000
    assert main_text(deep, {}).count("a") == 100_000 and len(page_tokens(deep)[1]) >= 100_000
    for page in ("<div>" * 100_000 + "</p>" * 100_000, "<p>x</p>" * 100_000, "<" * 200_000, "<article>" + "word " * 200_000, "<div class=a>" * 50_000 + "</div>" * 50_000):
        main_text(page, {})
    assert time.time() - began < 30


def plain_template(pages):
    """Classes of one host's pages by their definition."""
    from tessera.llm.html import page_tokens

    different = {}
    for page in pages:
        name, tokens = page_tokens(page)
        different[name] = tokens
    pages = list(different.values())
    classes = {}
    for token in {t for p in pages for t in p}:
        vector = tuple(p[token][0] if token in p else 0 for p in pages)
        if all(vector):
            classes.setdefault(vector, set()).add(token)
    of = {t: v for v, members in classes.items() for t in members}
    kept = {}
    for vector, members in classes.items():
        orders = {tuple(sorted(members, key=lambda t: (p[t][1], t))) for p in pages}
        parents = {max(p[t][2] for p in pages) for t in members}
        outer = {x for x in parents if of.get(x) != vector}
        if len(orders) == 1 and len(outer) <= 1:
            kept.update(dict.fromkeys(members, vector))
    return kept


def test_classes_equal_their_definition(spark):
    from tessera.llm.html import host_templates

    rng = random.Random(3)
    hosts = {}
    for h in range(12):
        parts = [f"<div class=c{i}>" + rng.choice(["fixed", "<p>x</p>", "<span>in</span>", "<ul><li>a<li>b</ul>"]) + "</div>" for i in range(6)]
        pages = []
        for n in range(rng.randint(1, 6)):
            mine = [p for p in parts if rng.random() < rng.choice([0.8, 1.0])]
            if rng.random() < 0.3:
                rng.shuffle(mine)
            pages.append("<body>" + "".join(mine) + f"<div>own {n if rng.random() < 0.7 else 0}</div>" * rng.randint(1, 2) + "</body>")
        hosts[f"h{h}"] = pages + pages[:1]
    frame = spark.createDataFrame([(h, p) for h, pages in hosts.items() for p in pages] + [(None, "<p>x"), ("e", None)], "host string, html string")
    got = {r.host: dict(r.tokens) for r in host_templates(frame).collect()}
    shapes = Counter()
    for h, pages in hosts.items():
        want = plain_template(pages)
        mine = {bytes(t): c for t, c in got.get(h, {}).items()}
        assert set(mine) == set(want)
        groups = lambda x: {frozenset(t for t in x if x[t] == c) for c in x.values()}
        assert groups(mine) == groups(want)
        shapes[len(groups(want))] += 1
    assert len(shapes) > 2
