import random

from geoquarry.llm.html_text import SURGE, WIDTH, extract_pages, main_text, story


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
    <header>Site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">Buy <b>now</b></div>
    <article><h1>Head&amp;line</h1><p><b>First
      words.<br><p>O.<p>Caf&eacute; &#x41;&am</p><div class='sponsored box'>advert <div>nested</div> more</div><p>Last <a href=x>link</a>ed.</p>
    <section id="comments"><p>a reader says much more than the article does, and at length</p></section></article>
    <aside>side</aside><form>mail</form><footer>&copy; us</footer>"""
    assert main_text(page) == "Head&line First words. O. Café A&am Last linked."


def test_without_article():
    long = "Many words of the story that go on for long enough to be a surge of text in this window of lines."
    page = f"<body><ul><li><a>Home</a><li><a>News</a></ul><div>short</div><div id=top class=header>x</div><p>{long}<p>Short one.<p>{long}</p><div class=cookie-notice>{long}</div><p>{long}</p><p><a>next</a></p></body>"
    assert main_text(page) == f"{long} Short one. {long} {long}"


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>x", 1), (3, "u", "<nav>only menu", 1), (4, "u", "<article>" + "<p>word</p>" * 30_000, 1), (4, "u", "a < b <unclosed 'x", 1), (5, "u", "<nav>menu<article>text", 1), (5, "u", "<!-- never closed", 1)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in got] == ["", "", "x", "", " ".join(["word"] * 30_000), "a < b <unclosed 'x", "text", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_left_out_end_tags_end_a_skip():
    assert main_text('<ul><li class="nav-item">Home<li class="nav-item">News</ul><article><p>Text.</article>') == "Text."
    assert main_text('<article><p>One.<p class="notice">Buy<p>Two.<div><p class=ad>x</div>Three.</article>') == "One. Two. Three."
    assert main_text('<div class="menu"><article>Four.</article><div class="comments"><article>reader</article></div>') == "Four."
    assert main_text('<article><h2 id="search">Search</h2><section id="social-policy">Policy.</section></article>') == "Search Policy."


def test_story_goes_on_behind_stripped_parts():
    long = "Many words of the story that go on for long enough to be a surge of text in this window of lines."
    story = " ".join([long] * 9)
    page = f"<body><div>menu</div><div class=ad>a</div><p>{story}</p><aside>b</aside><p>Short.<p><a>mostly a link</a> x<p>{long}<div class=ad>c</div><p>The end.</p><p><a>next</a></p></body>"
    assert main_text(page) == f"{story} Short. mostly a link x {long} The end."
    assert main_text(f"<article>{story}</article><p>between</p><article>Brief.</article>") == f"{story} Brief."


def brute_story(lines, surge, ends):
    """The rule by trying all starts and ends."""
    size = [len(t) if 2 * k <= len(t) else 0 for t, k in lines]
    starts = [i for i in range(len(lines)) if size[i] and sum(size[i : i + WIDTH]) >= surge]
    if not starts:
        return []
    solid = [i for i, (t, _) in enumerate(lines) if t]
    last = starts[-1]
    for i in solid:  # on to a line with length that fewer than WIDTH lines without part from the last one
        if i > last and size[i] and sum(last < j < i for j in solid) < WIDTH:
            last = i
    before, behind = [i for i in solid if i < starts[0]], [i for i in solid if i > last]
    first = before[0] if ends and before and len(before) < WIDTH else starts[0]
    last = behind[-1] if ends and behind and len(behind) < WIDTH else last
    return [lines[i][0] for i in solid if first <= i <= last]


def test_lines_against_brute_force():
    rnd = random.Random(8)
    for _ in range(3000):
        lines = [rnd.choice([("", 0), ("x" * rnd.randrange(1, 60), 0), ("link" * rnd.randrange(1, 20), 99), ("y" * 20, 5)]) for _ in range(rnd.randrange(25))]
        for surge, ends in ((SURGE, False), (1, True), (1, False)):
            assert story(lines, surge, ends) == brute_story(lines, surge, ends)


def test_windows_decide_inside_articles():
    menu, text = "".join(f"<li><a href=/{i}>Other story {i}</a></li>" for i in range(5)), "<p>Words of the story.</p>"
    assert main_text(f"<article><ul>{menu}</ul><h1><a href=/s>Title</a></h1>{text}<ul>{menu}</ul>{text}<p><a href=/q>Source</a></p></article>").startswith("Title Words of the story. Other story 0")
    assert main_text(f"<article>{text}<p><a href=/q>Source</a></p></article>") == "Words of the story. Source"
    assert main_text(f"<article>{text}<ul>{menu}</ul></article>") == "Words of the story."
    assert main_text(f"<article><ul>{menu}</ul></article>").count("Other story") == 5  # nothing but links: all of it


def test_marks_inside_articles_are_whole_classes():
    assert main_text('<article><div class="alert-story">Alert.</div><div class="related-work">Work.</div><div class="ad-box">Buy</div><p class="cookie-notice">Cookies</article>') == "Alert. Work."
    assert main_text('<body><p class=notice>Cookies<p>Story goes on.<p>And ends.') == "Story goes on. And ends."
    assert main_text('<body><div class="ad"><article><p>Text.</p></article>') == "Text."
    long, short = "Many words of a story. " * 90, "A second article of some length. " * 6
    assert main_text(f"<article>{long}</article><article>{short}</article>") == f"{long}{short}".strip()
