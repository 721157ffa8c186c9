"""The small labelled table that the block classifier is trained on.

Each row is a page and the texts of those of its blocks that are main text; all other blocks
are boilerplate. The pages are made up for this purpose.
"""

_LONG = "The river rose for three days and the lower fields stood under water until the wind turned and the dikes held again at last."
_MID = "Nobody in the village had seen such a flood before that spring."
_SHORT = "It held."
_QUOTE = "We carried sand all night, said the mayor, and nobody went home."



def _any_lengths(start: str, end: str, linked: bool) -> tuple[str, list[str]]:
    """A zone whose paragraphs have every length next to every other one, within links or not."""
    lengths = (1, 2, 5, 12, 30, 70, 250)
    texts = [" ".join(["sand"] * n) + f" {i}" if n > 1 else f"clay{i}" for i, n in enumerate(n for a in lengths for b in lengths for n in (a, b))]
    return start + "".join(f"<p><a href='/{i}'>{t}</a></p>" if linked else f"<p>{t}</p>" for i, t in enumerate(texts)) + end, texts


def _zones() -> list[tuple[str, list[str]]]:
    """In an article every block is main text, in boilerplate and beside an article none is, whatever its length and
    its neighbours'."""
    pages = []
    for linked in (False, True):
        for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-body'>", "</div>")):
            article, texts = _any_lengths(start, end, linked)
            pages.append((f"<body><header>Daily Post</header>{article}<p>Made in May</p><footer><p>{_LONG}</p></footer></body>", texts))
        for start, end in (("<footer>", "</footer>"), ("<nav>", "</nav>"), ("<div class='comments'>", "</div>"), ("<article><aside>", "</aside></article>"), ("<div>", "</div>")):
            pages.append((f"<body>{_any_lengths(start, end, linked)[0]}<article><p>{_MID}</p></article></body>", [_MID]))
    return pages


def _bare() -> list[tuple[str, list[str]]]:
    """Pages without a word on what is what: short lines beside links are not main text, short lines among
    paragraphs are."""
    pages = []
    names = ("Water board", "Daily Post of the valley", "The home of all who watch the river", "Levels", "A page for boatmen and their guests")
    for i, name in enumerate(names):
        links = " ".join(f"<a href='/{w}'>{w}</a>" for w in "Levels Maps Contact News Sport".split()[: 2 + i % 3])
        texts = [f"{_LONG} {i}", f"{_MID} {i}", f"{_SHORT} {i}", f"{_QUOTE} {i}", f"{_LONG} {_MID} {_LONG} {i}"]
        texts = texts[i % 3 :] + texts[: i % 3]
        main = "".join(f"<p>{t}</p>" for t in texts)
        pages.append((f"<body><div>{name}</div><div>{links}</div><div>{main}</div><div>{links}</div><div>{name}, May</div></body>", texts))
    return pages


PAGES = [
    (
        f"""<html><head><title>Flood</title></head><body><header><div>Daily Post</div><p>Independent since 1901 and still printed every morning</p></header>
        <nav><ul><li><a href="/">Home</a></li><li><a href="/w">World news</a></li><li><a href="/s">Sport</a></li></ul></nav>
        <article><h1>River floods the fields</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MID}</p><p>{_LONG} {_MID}</p></article>
        <footer>&copy; Daily Post, all rights reserved</footer></body></html>""",
        ["River floods the fields", _LONG, _SHORT, _MID, f"{_LONG} {_MID}"],
    ),
    (
        f"""<body><nav><a href="/a">a</a> <a href="/b">b</a></nav><div class="ad">Buy one lamp and get the second one free today.</div>
        <article><h1>Dikes</h1><p>{_MID}</p><div class="advert"><p>{_MID} Order now and save.</p></div><p>{_SHORT}</p>
        <aside><h2>More</h2><p>{_LONG}</p></aside><blockquote>{_QUOTE}</blockquote><ul><li>sand</li><li>clay</li></ul></article>
        <section id="comments"><h3>Comments</h3><p>{_LONG}</p><p>Me too.</p></section><footer><p>{_MID}</p></footer></body>""",
        ["Dikes", _MID, _SHORT, _QUOTE, "sand", "clay"],
    ),
    (
        f"""<body><form action="/x"><div id="cookie-notice">{_MID} We use cookies.</div><div id="header"><h1>Site</h1></div><ul class="menu"><li><a href="/">Start</a></li></ul>
        <main><h2>Night watch</h2><p>{_LONG}</p><p>Sand <a href="/s">bags</a> were <b>few</b>.</p><p>{_SHORT}</p><table><tr><td>bags</td><td>4,000</td></tr></table>
        <div class="share"><a href="/f">Share this page</a></div><form><label>Your mail address</label></form></main>
        <div class="sidebar"><h3>Popular</h3><article><p>{_LONG}</p></article></div></form></body>""",
        ["Night watch", _LONG, "Sand bags were few.", _SHORT, "bags", "4,000"],
    ),
    (
        f"""<body><div>Home page of the water board</div><div><a href="/1">Levels</a> <a href="/2">Maps</a> <a href="/3">Contact us here</a></div>
        <div><p>{_LONG}</p><p>{_MID}</p><p>{_LONG} {_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p></div>
        <div><a href="/4">Previous report</a></div><div>Page made in May</div></body>""",
        [_LONG, _MID, f"{_LONG} {_LONG}", _SHORT],
    ),
    (
        f"""<body><div class="nav"><p>{_MID}</p></div><div id="content"><h1>Report</h1><p>{_MID}</p><p>{_SHORT}</p><p><a href="/r">The whole report is here</a></p><p>{_LONG}</p>
        <div class="related"><a href="/q">Other reports</a><p>{_LONG} {_LONG}</p></div></div>
        <ol class="comment-list"><li class="comment"><article class="comment"><p>{_LONG}</p></article></li></ol><div id="footer"><p>{_LONG}</p></div></body>""",
        ["Report", _MID, _SHORT, "The whole report is here", _LONG],
    ),
    (
        f"""<body><article><header><h1>Pumps</h1><p>By the editors</p></header><p>{_LONG}</p><h2>Later</h2><p>{_SHORT}</p><footer>Filed under water</footer></article>
        <div role="complementary"><p>{_LONG}</p></div><div class="newsletter">{_MID}</div></body>""",
        ["Pumps", "By the editors", _LONG, "Later", _SHORT],
    ),
    (f"<p>{_LONG}</p><p>{_LONG}</p><p>{_SHORT}</p><p>{_MID}</p>", [_LONG, _SHORT, _MID]),
    ("<p>One.</p>", ["One."]),
    ("<p>A line of text.</p><p>And the next line.</p>", ["A line of text.", "And the next line."]),
    ("<p>Five words make a line.</p><h2>A head</h2><p>Six words make a longer line.</p>", ["Five words make a line.", "A head", "Six words make a longer line."]),
    ("<p>Only one line of text stands here.</p>", ["Only one line of text stands here."]),
    (f"<p>{_LONG}</p>", [_LONG]),
    ("<article><p>One.</p></article>", ["One."]),
    ("<body><nav><a href='/'>Home</a></nav><article></article><footer>The end of it</footer></body>", []),
    ("<div><a href='/'>Home</a></div><div><a href='/m'>Map of the site</a> | <a href='/n'>News</a></div>", []),
    (f"<nav><p>{_LONG}</p></nav><main><p>{_SHORT}</p><p><a href='/x'>{_MID}</a></p></main>", [_SHORT, _MID]),
    # Wrappers whose classes have words of boilerplate.
    (
        f"""<body><div class="layout search"><div class="nav"><a href="/">Home</a></div><article><div class="article-header"><h1>Sluices</h1></div><p>{_LONG}</p><p>{_SHORT}</p>
        <div class="share"><p>{_MID}</p></div></article><div class="comments"><div class="content"><p>{_LONG}</p></div></div></div></body>""",
        ["Sluices", _LONG, _SHORT],
    ),
    (
        f"""<body><div class="content has-sidebar"><article class="post no-comments"><h1>Locks</h1><p>{_MID}</p><p>{_SHORT}</p></article></div>
        <div class="sidebar"><div class="widget"><div class="content"><p>{_QUOTE}</p></div></div></div></body>""",
        ["Locks", _MID, _SHORT],
    ),
    (
        f"""<body><div id="header"><p>{_LONG}</p></div><div class="page widget"><main><h1>Weirs</h1><p>{_SHORT}</p><p>{_MID}</p></main></div><p>{_LONG} {_LONG}</p></body>""",
        ["Weirs", _SHORT, _MID],
    ),
] + _zones() + _bare()
