import math
import random

from tidemark.llm import html_text

BODY = "<p>First paragraph, with some words in it.</p><p>Second &amp; last,\n one.</p>"


def test_articles():
    page = f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><!-- x --><article><h1>Title</h1>{BODY}<aside>more</aside></article><div class='comments'><p>A long comment, by a reader, that says something.</p></div><footer>&copy; x</footer></body></html>"
    assert html_text.main_blocks(page) == ["Title", "First paragraph, with some words in it.", "Second & last, one."]


def test_pages_without_an_article_element():
    page = f"<body><div id=menu>Menu</div><div class='wrap'><div class='content'><h1>Title</h1>{BODY}</div><div class='sidebar-left'><p>Links, and links, and links.</p></div></div><div class=ad>Buy</div></body>"
    assert html_text.main_blocks(page) == ["Title", "First paragraph, with some words in it.", "Second & last, one."]


def test_tag_soup():
    assert html_text.main_blocks("<article><p><b>Lead text.<br><p>Next 1 < 2 text.</article>") == ["Lead text.", "Next 1 < 2 text."]
    assert html_text.main_blocks("<p>a <span>b</span>c<p>d <a href='x>y'>e</a>") == ["a bc", "d e"]
    assert html_text.main_blocks("<article>cut off <b") == ["cut off"]
    for nothing in (None, "", "   ", "<p></p>", "<script>x", "<nav>only</nav>"):
        assert html_text.main_blocks(nothing) == []


def test_blocks_outside_the_chosen_element():
    text = [f"Sentence number {i}, with some words, and some more." for i in range(40)]
    paragraphs = "".join(f"<p>{t}</p>" for t in text)
    assert html_text.main_blocks(f"<body><h1>Title</h1><div>{paragraphs}</div></body>") == ["Title", *text]
    assert html_text.main_blocks(f"<body><div>{''.join(f'<p>{t}</p>' for t in text[:38])}</div><div>{''.join(f'<p>{t}</p>' for t in text[38:])}</div></body>") == text


def test_hint_words_on_a_wrapper():
    want = ["Title", "First paragraph, with some words in it.", "Second & last, one."]
    for name in ("layout has-sidebar", "no-sidebar", "with-menu", "social-science", "related sidebar"):
        page = f"<body><div class='menu'>Menu</div><div class='{name}'><div class='content'><h1>Title</h1>{BODY}</div><div class='sidebar'>Links</div></div></body>"
        assert html_text.main_blocks(page) == want, name
    # Hints still count beside an article, and in what is hidden or navigation anyway.
    long = "<p>A comment, by a reader.</p>" * 20
    assert html_text.main_blocks(f"<body><article><h1>Title</h1>{BODY}</article><div class='comments'>{long}</div></body>") == want
    assert html_text.main_blocks("<nav><div class='menu'>only</div></nav><div class='menu' hidden>x</div><div class='menu'><nav>y</nav></div>") == []
    two = "<div class='social-a'><p>One half, here.</p></div><div class='social-b'><p>Two half, here.</p></div>"
    assert html_text.main_blocks(f"<body>{two}</body>") == ["One half, here.", "Two half, here."]


def test_query_shape(spark):
    rows = [(1, "u", "<p>x"), (2, None, None), (None, "u", ""), (1, "u", "<p>x")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in html_text.extract_text(table).collect()), key=repr)
    assert got == sorted([(1, "u", "x", 1, 1), (1, "u", "x", 1, 1), (2, None, "", 0, 0), (None, "u", "", 0, 0)], key=repr)
    assert html_text.extract_text(table.limit(0)).collect() == []


def test_very_long_page():
    blocks = html_text.main_blocks("<article>" + "<p>some words, here.</p>" * 20_000 + "</article>")
    assert len(blocks) == 20_000


def sentence(rng, least=6):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + rng.choice(("", "", ",")) for _ in range(rng.randint(least, 30))) + "."


def made_page(rng, wrapper):
    """(page, its article's blocks), the article in wrapper; what is beside it is marked by name or by class, or is short."""
    blocks = [("h1", " ".join(sentence(rng).split()[:5]))] + [("p", sentence(rng)) for _ in range(rng.randint(3, 25))]
    inner = [f"<{t}>{x.replace('gamma', '<i>gamma</i>')}</{t}>" for t, x in blocks]
    for extra in ("<aside>{}</aside>", "<div class='share-buttons'>{}</div>", "<script>var x = '{}';</script>", "<form><label>{}</label></form>"):
        if rng.random() < 0.5:
            inner.insert(rng.randint(1, len(inner)), extra.format(sentence(rng)))
    around = ["<div class='ad'>{}</div>", "<nav><ul><li>{}</li></ul></nav>", "<div><a>Home</a></div>", "<div id='comments'><p>{}</p></div>", "<footer>{}</footer>", "<div class='cookie-notice'>{}</div>"]
    rng.shuffle(around)
    cut = rng.randint(0, len(around))
    before, after = ("".join(x.format(sentence(rng)) for x in part) for part in (around[:cut], around[cut:]))
    return f"<html><body>{before}<{wrapper}>{''.join(inner)}</{wrapper.split()[0]}>{after}</body></html>", [x for _, x in blocks]


def test_made_pages_with_and_without_an_article_element():
    rng = random.Random(1)
    for k in range(200):
        page, want = made_page(rng, ("article", "main", "div", "div class='post'", "section")[k % 5])
        assert html_text.main_blocks(page) == want, page


def test_scores_equal_the_formula():
    """Ratios, smoothing, fusion and the lowering of hints, worked out one path at a time."""
    rng = random.Random(2)
    for k in range(30):
        blocks = html_text.Page(made_page(rng, "div" if k % 2 else "article")[0]).blocks
        weight = lambda i, j: math.exp(-((i - j) ** 2) / (2 * html_text.SIGMA**2)) if abs(i - j) <= 2 * html_text.SIGMA else 0.0
        marks = lambda t: sum(c in ".,;:!?" for c in t)
        ratio = {}
        for path in {e.path for e, _ in blocks}:
            mine = [t for e, t in blocks if e.path == path]
            low = html_text.HINTED if next(e for e, _ in blocks if e.path == path).hinted else 1
            ratio[path] = low * sum(map(len, mine)) / len(mine), low * sum(map(marks, mine)) / len(mine)
        want = {}
        for path in ratio:
            at = [i for i, (e, _) in enumerate(blocks) if e.path == path]
            total = 0.0
            for i in at:
                smooth = [sum(weight(i, j) * ratio[e.path][side] for j, (e, _) in enumerate(blocks)) / sum(weight(i, j) for j in range(len(blocks))) for side in (0, 1)]
                length, mark = map(min, smooth, ratio[path])
                total += math.log(1 + length) * (1 + math.log(1 + mark))
            want[path] = total / len(at) * (html_text.HINTED if blocks[at[0]][0].hinted else 1)
        got = html_text.path_scores(blocks)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_scores_decide(monkeypatch):
    """With one score for every path, adverts and link lists come through: it is the scores that leave them out."""
    rng = random.Random(3)
    pages = [made_page(rng, "div") for _ in range(20)]
    monkeypatch.setattr(html_text, "path_scores", lambda blocks: {e.path: 1.0 for e, _ in blocks})
    assert all(html_text.main_blocks(page) != want for page, want in pages)


def test_deep_pages_take_time_in_proportion():
    n = 30_000
    assert len(html_text.main_blocks("<div>word, word" * n)) == n
    assert html_text.main_blocks("<b>" * n + "x" + "</i>" * n) == ["x"]
    assert html_text.main_blocks("<div class='ad'>" * n + "x") == ["x"]
