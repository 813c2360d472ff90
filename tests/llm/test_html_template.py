import html
import random
import re

from inkwell.llm import html_template as H


def page(title, paragraphs, extra="", comments="", body=""):
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:"</p>"}}</style><script>var t="</p><article>";</script></head><body><header class="top">Site name</header>'
        f'<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p> --><div class="ad">Buy {title}</div><article><h1>{title}</h1>{"".join(f"<p>{p}" for p in paragraphs)}{extra}</article>'
        f'<aside>More</aside><form>Mail <input></form><div id="comments">{comments}</div><footer>&copy; x</footer>{body}</body></html>'
    )


def test_article_only(spark):
    r = random.Random(2)
    words = lambda n: " ".join(r.choice(["ab", "c&amp;d", "<b>é</b>f", "&quot;g&quot;\n"]) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        paragraphs = [words(r.randint(1, 30)) for _ in range(r.randint(1, 5))]
        rows.append((i, f"https://h{i % 3}.example/{i}", page(f"T {i}", paragraphs, comments="nice"), "x"))
        want[i] = " ".join(html.unescape(re.sub("</?b>", "", " ".join([f"T {i}", *paragraphs]))).split())
    rows += [(100, None, None, "x"), (101, "", "", "x"), (102, "https://one.example", "plain a<br>b &am", "x"), (103, "https://two.example", "<div id=main><p>Long text of it all</p><div class='share'>x</div></div>", "x"), (0, *rows[0][1:])]
    want |= {100: "", 101: "", 102: "plain a b &am", 103: "Long text of it all"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_main(df).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.text == want[x.page_id], x.page_id
    assert H.extract_main(df.limit(0)).count() == 0


def plain_page(r, i, notice):
    """A page without article, main or telling classes: what is the frame shows only over several pages."""
    words = lambda n: " ".join(r.choice(["ab", "cde", "fg", "hij", "klm", "no"]) + str(r.randrange(999)) for _ in range(n))
    paragraphs = [words(r.randint(20, 60)) for _ in range(3)]
    body = f"<div class=x1><span>Site</span> of all</div><div class=x2>{notice}</div><table class=x3><tr><td>One<td>Two</table><div class=x4><h1>T {i}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class=x5>{notice}</div></div><div class=x6>Copyright 2020 by us</div>"
    return f"<html><body class='page has-sidebar comments-open'>{body}</body></html>", f"T {i} {' '.join(paragraphs)}"


def test_only_the_template_shows_the_frame(spark):
    r = random.Random(3)
    notice = "All that is said here is said without any warranty, and is repeated on every page of this host for all to read it again. " * 3
    rows, want = [], {}
    for h, n in (("a", 3), ("b", 7), ("c", 8), ("d", 50), ("e", 1)):
        for i in range(n):
            page, text = plain_page(r, i, notice)
            rows.append((len(rows), f"http://{h}.example/{i}", page))
            want[rows[-1][0]] = text if n > 2 else None
    rows += [(1000, "http://d.example/e", ""), (1001, "http://d.example/n", None), (1002, "http://d.example/x", "<html><body><p>An error, of no form at all</body></html>")]
    want |= {1000: "", 1001: "", 1002: "An error, of no form at all"}
    got = {x.page_id: x.text for x in H.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in want.items():
        assert got[i] == text or text is None, i
        if text and i < 1000:
            assert H.main_text(rows[i][2]) != text  # the page alone does not tell


def test_copies_on_a_host_keep_their_text(spark):
    html_text = "<html><body><div class=q>Same text for all</div></body></html>"
    rows = [(i, "http://a.example", html_text) for i in range(9)]
    assert {x.text for x in H.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same text for all"}


def test_names_are_hints():
    for mark in ("class='page has-sidebar'", "class=sidebar", ""):
        assert H.main_text(f"<body {mark}><article class='post comments-open'>A<p class=ad>Buy</p><p>B <span class=ad>x</span>y</p><div id=comments>c</div></article></body>") == "A B y"
    assert H.main_text("<form id=f class=login><div><p>All of the page is in a form, and more than half of it</div></form><nav>M</nav>") == "All of the page is in a form, and more than half of it"
    assert H.main_text("<div class=sidebar><main><p>Text</main></div>") == "Text"


def test_template_has_the_frame(spark):
    rows = [("h", i, page(f"T {i}", ["x y"] * (1 + i % 3))) for i in range(10)]
    df = spark.createDataFrame(rows, "host string, key long, html string")
    (row,) = H.templates(df).collect()
    tokens = {x.token for x in row.template}
    assert row["all"] == 10
    assert H._number(">html>body>article") in tokens and H._number("/>html>body>article") in tokens
    order = [x.token for x in row.template]
    assert order.index(H._number(">html>body")) < order.index(H._number(">html>body>article")) < order.index(H._number("/>html>body>article"))


def test_very_long_and_broken():
    t = H.main_text("<article>" + "<p>word " * 50_000)
    assert t == " ".join(["word"] * 50_000)
    assert H.main_text("<<<>>a<b") == "<<<>>a<b" or H.main_text("<<<>>a<b")
    assert H.main_text("<article><script>x") == ""
