import pytest

from vecindario.llm import html_text as H

WORDS = "The ferry crossed the bay in calm weather and landed before noon with all its passengers."


def page(middle, before="", after=""):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}<article>{middle}</article>{after}</body></html>"


def test_article_without_the_rest():
    html = page(f"<h1>Title &amp; more</h1><p>{WORDS}<br>Second&nbsp;line<p>Third <b>bold</b>\n word<div class='ad'>Buy {WORDS}</div><p>End.</p>"
                f"<section id='comments'><p>Nice {WORDS}</p></section><form><p>Name</p></form>",
                "<nav><ul><li><a href='/'>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>",
                "<aside>More</aside><!-- x --><footer>&copy; us</footer>")
    assert H.main_text(html) == f"Title & more\n{WORDS} Second line\nThird bold word\nEnd."


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words only", "plain words only"), ("a < b and c > d", "a < b and c > d"),
    ("<nav>Home</nav>", ""), ("<p>open <b>never closed", "open never closed"), ("<p>x</p><!-- never closed <p>y", "x"),
    ("<p>text<script>if (a<b) {", "text"), ("<p>&lt;b&gt; &#233; &am", "<b> é &am"), ("<p title='a>b'>ok</p>", "ok"), ("<p>cut<a href=\"x", "cut")])
def test_cases(html, text):
    assert H.main_text(html) == text


def test_page_without_article_element():
    html = (f"<div class='has-sidebar'><div class='menu'><a>One</a><a>Two</a></div><div><h2>Head</h2><p>{WORDS}</p><p>{WORDS}</p></div>"
            "<div class='sidebar'><ul><li><a>Older</a></li><li><a>Newer</a></li></ul></div><div id='footer'>Imprint</div></div>")
    assert H.main_text(html) == f"Head\n{WORDS}\n{WORDS}"


def test_best_run_equals_brute_force():
    import random
    random.seed(4)
    for _ in range(300):
        x = [random.randint(-5, 5) for _ in range(random.randint(0, 12))]
        i, j = H.best(x)
        top = max([sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1)], default=0)
        assert sum(x[i:j]) == max(top, 0)


def test_weights_follow_the_labelled_pages():
    weights = H.fit([("<nav><a>x y</a></nav>", "<p>many good words here</p>", "")])
    assert weights["word", "text"] > 0 > weights["tag", "p"] > weights["tag", "a"] and weights["word", "menu"] < 0


def test_long_and_adversarial_pages_are_linear():
    assert H.main_text("<p>" + "word " * 400_000).count("word") == 400_000
    H.main_text("<a href=\"" * 20_000)
    H.main_text("<div><p><b>" * 100_000 + "x" + "</i></div>" * 50_000)


def test_table(spark):
    rows = [(1, "u", None, "t"), (2, "u", page(f"<p>{WORDS}</p>"), "t"), (2, "u", page(f"<p>{WORDS}</p>"), "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "text"] and sorted(r.text for r in out.collect()) == ["", WORDS, WORDS]
    assert H.extract(df.limit(0)).count() == 0
