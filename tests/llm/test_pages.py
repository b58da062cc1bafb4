import html
import random
import re
import time

import pytest

from tallyloom.llm import pages as p

LEAD = "It was in the middle of the night that she went out of the house and into the garden with her brother. "


def test_furniture_goes_and_the_article_stays():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header>Site name of the day</header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies to give you the best of all that is on this site and so on.</div>
    <article><h1>A title</h1><p>{LEAD}<b>Bo</b>ld &amp; free&nbsp;&lt;x&gt;.</p><div class=ad>Buy the thing that is in all of the shops.</div><p>Short.<br>Line</p>
    <form><input value=x><p>Give us the name of the place that you are in.</p></form><script>var a = "</p>";</script>
    <section id="comments"><p>{LEAD}</p></section></article><aside><p>{LEAD}</p></aside><footer>&copy; all of it</footer></body></html>"""
    assert p.main_text(page) == f"A title {LEAD}Bold & free <x>. Short. Line"


def test_pages_without_article_use_the_two_passes():
    body = LEAD * 3
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><h2>Head</h2><p>{body}</p><p>Yes.</p><p>{body}</p><p>List of words only: apple banana cherry dates elder figs grape hazel iris juniper kiwi lemon.</p><div><a>x</a></div>"
    assert p.main_text(page) == f"Head {body.strip()} Yes. {body.strip()}"


def test_broken_markup():
    assert p.main_text(None) == p.main_text("") == ""
    assert p.main_text("<article><p>One < two & three<p>Four</article") == "One < two & three Four"
    assert p.main_text("<article>a<!-- never closed <p>b") == "a"
    assert p.main_text("<article>a</div></section><p title='>'>b</p>") == "a b"
    assert p.main_text("<article>&amp;amp; &eacute; &#x41;</article>") == "&amp; é A"
    assert len(p.main_text("<article>" + "<p>word</p>" * 50000)) == 5 * 50000 - 1


def test_edges(spark):
    rows = [(1, "u", "<article>x</article>", "a"), (None, None, None, "b"), (2, "u", "", "c"), (2, "u", "", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in p.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "x", 1), (None, "", 0), (2, "", 0), (2, "", 0)], key=str)
    assert p.extract_pages(df.limit(0)).count() == 0


def test_articles_of_the_pages_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in p.op8_html_extraction(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        text = re.sub(r"<[^>]*>", "", re.sub(r"<br>|</?p>|</h\d>", " ", inner[1] if inner else ""))
        assert got[r.page_id] == " ".join(html.unescape(text).split())


STOPS = frozenset("the of and to in a is that it was for on are as with his they at be this".split())


def brute(blocks):
    """Kept texts by the stated rules; a block is (text, characters in links, article or 0, furniture, heading)."""
    articles = any(b[2] and not b[3] for b in blocks)

    def share(text):
        words = re.findall(r"\w+", text.lower())
        return sum(w in STOPS for w in words), len(words)

    def first(text, linked, inside, furniture, heading):
        if furniture or linked / max(1, sum(not c.isspace() for c in text)) > 0.2:
            return "bad"
        if len(text) < 70:
            return "bad" if articles and not inside else "short"
        stops, words = share(text)
        votes = [1] * (stops / words >= 0.32) + [-1] * (stops / words < 0.3) + [1] * (len(text) >= 200) + [1] * bool(inside) + [-2] * bool(articles and not inside)
        return "good" if sum(votes) > 0 else "near" if sum(votes) == 0 else "weak"

    labels = [first(*b) for b in blocks]
    undecided = [i for i, x in enumerate(labels) if x not in ("good", "bad")]
    if undecided and "good" not in labels:
        most = max(share(blocks[i][0])[0] for i in undecided)
        if most:
            best = [i for i in undecided if share(blocks[i][0])[0] == most]
        else:
            best = undecided if {labels[i] for i in undecided} == {"short"} else []
        if best:
            labels[max(best, key=lambda i: len(blocks[i][0]))] = "good"
    kept = []
    for i, b in enumerate(blocks):
        label = labels[i]
        if label not in ("good", "bad"):
            near = [j for j in range(len(blocks)) if labels[j] in ("good", "bad") and not blocks[j][3]]
            sides = []
            for here in ([j for j in near if j < i][-1:], [j for j in near if j > i][:1]):
                if here and blocks[here[0]][2] == b[2]:
                    sides.append((abs(here[0] - i), labels[here[0]]))
                else:
                    sides.append((10**9, "good") if b[2] else None)
            told = [x for x in sides if x]
            if not told:
                label = "good" if label == "near" else "bad"
            elif len({x[1] for x in told}) == 1:
                label = told[0][1]
            elif label == "near":
                label = "good"
            elif b[4]:
                label = told[1][1]
            else:
                label = "good" if next(d for d, x in told if x == "good") < next(d for d, x in told if x == "bad") else "bad"
        if label == "good":
            kept.append(b[0])
    return kept


def random_page(rng):
    """(html, blocks) of a page of random blocks, some in an article, some in furniture."""
    out, blocks, articles = [], [], 0
    for _ in range(rng.randint(1, 5)):
        kind = rng.choice(["article", "div", "div", "nav", 'div class="ad"', 'div class="page has-sidebar"', "div id=site-footer", "section class=cookie-notice"])
        furniture = kind.split()[0] == "nav" or "class=\"ad" in kind or "footer" in kind or "notice" in kind
        articles += kind == "article"
        out.append(f"<{kind}>")
        for _ in range(rng.randint(1, 6)):
            share = rng.choice([0.0, 0.1, 0.28, 0.31, 0.33, 0.5])
            words = [rng.choice(sorted(STOPS)) if rng.random() < share else "".join(rng.choices("bcdfg", k=rng.randint(2, 9))) for _ in range(rng.choice([1, 3, 8, 14, 20, 40]))]
            n_linked = rng.choice([0, 0, 0, 1, 5, len(words)])
            tag, text = rng.choice(["p", "p", "h2"]), " ".join(words)
            linked = sum(map(len, words[:n_linked]))
            markup = f"<a href=x>{' '.join(words[:n_linked])}</a> {' '.join(words[n_linked:])}" if n_linked else text
            out.append(f"<{tag}>{markup}</{tag}>")
            blocks.append((text, linked, articles if kind == "article" else 0, furniture, tag == "h2"))
        out.append(f"</{kind.split()[0]}>")
    return "".join(out), blocks


def test_both_passes_equal_a_brute_force():
    rng = random.Random(6)
    pages = [random_page(rng) for _ in range(600)]
    got = [p.main_text(page, STOPS) for page, _ in pages]
    assert got == [" ".join(brute(blocks)) for _, blocks in pages]
    # Stop-word density, length and link density all decide something.
    assert sum(g != p.main_text(page, frozenset()) for g, (page, _) in zip(got, pages, strict=True)) > 100
    assert sum(g != p.main_text(re.sub("</?a[^>]*>", "", page), STOPS) for g, (page, _) in zip(got, pages, strict=True)) > 100
    assert sum(bool(g) for g in got) > 200


def without_articles(page):
    return re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page or "")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_densities_find_the_text_of_pages_without_articles(spark, size):
    """Page by page: with the article element renamed, the rules find what they find with it."""
    same = alike = unlike = n = 0
    for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").collect():
        whole, found = p.main_text(r.html), p.main_text(without_articles(r.html))
        words, rest = found.split(), iter(whole.split())
        assert all(w in rest for w in words), r.page_id  # nothing of menu, advert or footer, nothing out of order
        assert bool(found) == bool(whole), r.page_id
        n, same, alike = n + 1, same + (found == whole), alike + (len(found) >= 0.99 * len(whole))
        unlike += p.main_text(without_articles(r.html), frozenset()) != found
    assert alike >= 0.98 * n and unlike >= 0.9 * n


def test_each_rule_decides_on_pages_without_articles(spark, monkeypatch):
    pages = [without_articles(r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    want = [p.main_text(x) for x in pages]
    # Links alone tell a menu that isn't marked as one.
    unmarked = [x.replace("<nav>", "<div>").replace("</nav>", "</div>") for x in pages]
    assert sum(a == p.main_text(x) for a, x in zip(want, unmarked, strict=True)) > 0.7 * len(pages)
    for name, value in (("LINKS", 2.0), ("SHORT", 10**9)):
        monkeypatch.setattr(p, name, value)
        assert sum(a != p.main_text(x) for a, x in zip(want, unmarked, strict=True)) > 0.3 * len(pages), name
        monkeypatch.undo()


def test_pages_without_a_good_block():
    assert p.main_text("<div>x</div>") == "x"
    assert p.main_text("<nav>menu</nav><div>one of the two</div><div>zzz zzz zzz zzz</div>") == "one of the two zzz zzz zzz zzz"
    listed = "apple banana cherry dates elder figs grape hazel iris juniper kiwi lemon mango nectarine orange"
    assert p.main_text(f"<div>{listed}</div>") == "" and p.main_text(f"<article><p>{listed}</p></article>") == listed
    assert p.main_text(f"<div>{listed} of</div>") == f"{listed} of"


def test_whole_names_of_elements_name_furniture():
    for name in ("ad", "cookie-notice", "site-header", "Comments", "main nav", "post_comments", "user-comments", "related-articles", "newsletter form", "sidebar_left"):
        assert p.names_furniture(f' class="{name}"', False)[0], name
    for name in ("has-sidebar", "page has-sidebar", "adder", "content", "no-comments", "article-body", "navigate", "with-sidebar", "sidebar-open", "main-content", "post content"):
        assert not p.names_furniture(f" class='{name}'", False)[0], name
    assert p.main_text(f'<div class="page has-sidebar"><article><p>{LEAD}</p></article></div>') == LEAD.strip()


def test_broken_nesting_takes_linear_time():
    start = time.process_time()
    for page in ("<div>" * 20000 + "x" + "</section>" * 20000, "<button>" * 20000, "<section>" + "<div></section>" * 20000, "<iframe>" * 20000 + LEAD):
        p.main_text(page)
    assert time.process_time() - start < 4


def test_very_long_and_repeated_pages(spark):
    page = "<article>" + "".join(f"<p>{LEAD}{i}</p>" for i in range(20000)) + "</article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "u", page[:100])], "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars) for r in p.extract_pages(df).collect())
    n = len(p.main_text(page))
    assert n > 20000 * len(LEAD) and got[:2] == [(1, n)] * 2
