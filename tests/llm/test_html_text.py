import math
import random
import time

import pytest

from basalt.llm import html_text as H
from basalt.llm.html_text import extract, main_text, smooth, two_means

P = "<p>" + "Words of the article go on and on, sentence after sentence. " * 4 + "</p>"
T = ("Words of the article go on and on, sentence after sentence. " * 4).strip()
PAGES = {
    "article": (f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><header><h1>Site</h1></header><article><h1>Title</h1>{P}<p>Short.</p></article><aside>{P}</aside><footer>&copy; x</footer>", f"Title\n{T}\nShort."),
    "inline": ("<article><p>A <b>bold</b>\n  word &amp; &eacute;&#33;<br>next</p></article>", "A bold word & é! next"),
    "unclosed": ("<article><p><b>One.<br><p>Two.<p>Three</article>", "One.\nTwo.\nThree"),
    "divs": (f"<body><div class='sidebar-left'>{P}</div><div id=content>{P}<p>End.</p></div><div class=comments>{P}</div><form>{P}<input></form>", f"{T}\nEnd."),
    "links": (f"<body><div><a href=a>{'link text ' * 3}</a> <a href=b>{'more links ' * 3}</a></div><div id=main>{P}{P}</div>", f"{T}\n{T}"),
    "list": (f"<main>{P}<ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main>", f"{T}\none\ntwo\na\nb"),
    "script": (f"<article><script>var t = '</p>';</script>{P}<!-- <p>no</p> --></article>", T),
    "broken": ("<article><p>Cut off in the mid", "Cut off in the mid"),
    "plain": ("just text", "just text"),
    "empty": ("", ""),
    "none": (None, ""),
    "blank": ("<html><body><p> </p></body></html>", ""),
    "short": ("<html><head><meta charset=utf-8></head><body><div><p>ok</p></div></body></html>", "ok"),
    "only menus": (f"<body><nav>{P}</nav><div class=sidebar>x</div><footer>{P}{P}</footer></body>", "x"),
    "wrapped": (f"<body class=has-nav><div class='layout sidebar-left'><nav>{P}</nav><main><article>{P}</article></main></div></body>", T),
    "marked whole": (f"<body><div class='widget'>{P}<p>End.</p></div><nav><a href=/>Home</a></nav></body>", f"{T}\nEnd."),
    "talk": (f"<article>{P}</article><section class=comments><article class=comment>{P}{P}{P}</article></section>", T),
    "table page": (f"<table><tr><td><a href=/>Home</a><br><a href=/b>About us</a></td><td>{P}{P}<p>End.</p></td></tr></table>", f"{T}\n{T}\nEnd."),
    "inline mark": ("<article><p>One <span class=ad>Buy now</span>two three four.</p></article>", "One two three four."),
    "beside": (f"<body><div class='page has-sidebar'>{P}{P}</div><div id=pageFooter>{P}</div>", f"{T}\n{T}"),
    "ads": (f"<article><div class='ad'>Buy</div>{P}<div class=cookie-notice>Accept</div></article>", T),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, text = PAGES[name]
    assert main_text(html or "") == text


def test_table(spark):
    rows = spark.createDataFrame([(n, html, "u", "clash") for n, (html, _) in enumerate(PAGES.values())] + [(None, "<p>" + "long " * 300_000, None, "c")], "page_id long, html string, url string, text string")
    found = extract(rows, keep=("url",)).collect()
    assert {r["id"]: r["text"] for r in found if r["id"] is not None} == {n: text for n, (_, text) in enumerate(PAGES.values())}
    assert extract(rows.where("false")).count() == 0


def test_smoothing_and_threshold():
    import numpy as np

    assert abs(smooth(np.ones(9), 1.0) - 1).max() < 1e-9 and smooth(np.array([0.0, 0, 9, 0, 0]), 1.0).argmax() == 2
    assert 1 < two_means(np.array([0.0, 0, 1, 8, 9])) < 8


def brute_levels(lines, sigma=1.0):
    """lines: (text, tags, link characters)."""
    level = [math.log(1 + max(0, len(t) - links) / max(1, tags)) for t, tags, links in lines]
    reach, n = max(1, int(3 * sigma)), len(level)
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [sum(w * level[min(max(i + k, 0), n - 1)] for k, w in zip(range(-reach, reach + 1), weight)) / sum(weight) for i in range(n)]


def test_ratios_smoothing_and_cut_against_brute_force():
    parser = H.BlockParser()
    parser.feed(f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a> x</ul>{P}<p>Short <b>line</b></p>{P}<p>By <i>me</i> <a href=c>and others</a></p>")
    parser.close()
    lines = [(b, b.text()) for b in parser.blocks if b.text()]
    assert [(t, b.tags, b.links) for b, t in lines] == [("One", 4, 3), ("Two x", 4, 3), (T, 2, 0), ("Short line", 3, 0), (T, 3, 0), ("By me and others", 5, 10)]
    want = brute_levels([(t, b.tags, b.links) for b, t in lines])
    import numpy as np

    sizes = np.array([len(t) for _, t in lines], float)
    got = smooth(np.log1p(H.ratios(sizes, np.array([b.tags for b, _ in lines]), np.array([b.links for b, _ in lines]))), 1.0)
    assert np.allclose(got, want)
    # the cut lies halfway between the means of both parts
    cut = two_means(got)
    low, high = [x for x in want if x < cut], [x for x in want if x >= cut]
    assert abs(cut - (sum(low) / len(low) + sum(high) / len(high)) / 2) < 1e-9
    assert H.content_region(got, 0.0).tolist() == [x >= cut for x in want] == [False, False, True, True, True, True]


def brute_main_text(lines, sigma=1.0):
    """lines: (text, tags, link characters, container, whether it counts) of a page without main parts; container names are paths like /div/div."""
    worth = [max(0, len(t) - links) / max(1, tags) if counts else 0 for t, tags, links, _, counts in lines]
    level = brute_levels([(t, tags, links if counts else len(t)) for t, tags, links, _, counts in lines], sigma)
    real = [x for x, w in zip(level, worth) if w > 0]
    low, high = min(real), max(real)
    for _ in range(20):
        under, over = [x for x in real if x < (low + high) / 2], [x for x in real if x >= (low + high) / 2]
        if not under:
            break
        low, high = sum(under) / len(under), sum(over) / len(over)
    cut = (low + high) / 2 if high >= 1.5 * low else low
    region = [w > 0 and x >= cut for x, w in zip(level, worth)]
    weigh = lambda c: sum(len(t) for (t, _, _, own, _), r in zip(lines, region) if r and (own + "/").startswith(c + "/"))
    paths = {own[: k] for *_, own, _ in lines for k in range(len(own) + 1) if own[k : k + 1] in ("", "/")}
    content = max((p for p in paths if weigh(p) >= 0.7 * weigh("")), key=lambda p: p.count("/"))
    keep = []
    for n, (t, _, links, own, _) in enumerate(lines):
        if content in ("", "/body"):
            joins = any(region[m] and lines[m][3] == own for m in range(max(0, n - 3), min(len(lines), n + 4)) if m != n)
        else:
            joins = (own + "/").startswith(content + "/")
        keep.append(region[n] or joins and worth[n] > 0 and links <= 0.6 * len(t))
    return "\n".join(t for (t, *_), k in zip(lines, keep) if k)


def test_main_text_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        lines, html = [], "<body>"
        for block in range(rng.randrange(1, 6)):
            where = rng.choice(["/body", f"/body/div{block}", f"/body/div{block}/section", "nav"])
            open_, close = {"/body": ("", ""), "nav": ("<nav>", "</nav>")}.get(where, ("<div><section>", "</section></div>") if where.endswith("section") else ("<div>", "</div>"))
            html += open_
            extra = open_.count("<")
            for _ in range(rng.randrange(1, 5)):
                t = " ".join(rng.choices(["word", "other", "longer", "x"], k=rng.choice([1, 2, 30, 80])))
                linked = rng.random() < 0.2
                html += f"<p><a href=x>{t}</a></p>" if linked else f"<p>{t}</p>"
                # the tags since the last text, of the line before too
                lines.append([t, 1 + linked + extra, len(t) if linked else 0, "/body" if where == "nav" else where, where != "nav"])
                extra = 1 + linked
            html += close
            closing = extra + close.count("<")
            for line in lines[-1:]:
                line.append(closing)
        # tags between two texts belong to the later one
        fixed, carry = [], 1
        for line in lines:
            fixed.append((line[0], line[1] + carry, *line[2:5]))
            carry = line[5] if len(line) > 5 else 0
        parser = H.BlockParser()
        parser.feed(html)
        parser.close()
        assert [(b.text(), b.tags, b.links) for b in parser.blocks if b.text()] == [(t, tags, links) for t, tags, links, _, _ in fixed]
        if any(len(t) > links and counts for t, _, links, _, counts in fixed):
            assert main_text(html) == brute_main_text(fixed)


NEUTRAL = {
    "menu and advert": (f"<body><div><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></div><div>Buy now, cheap.</div><div><h1>Title</h1>{P}<p>Short.</p>{P}</div><div><a href=/c>Contact</a> <a href=/t>Terms</a> us</div></body>", f"Title\n{T}\nShort.\n{T}"),
    "no division": (f"<body>Skip this<br><table><tr><td><a href=/>Home</a></table><h2>Title</h2>{P}<p>Short.</p>{P}</body>", f"Title\n{T}\nShort.\n{T}"),
}


def test_ratios_smoothing_and_clusters_decide_where_tags_say_nothing(monkeypatch):
    import numpy as np

    for html, text in NEUTRAL.values():
        assert text in main_text(html)
    html, text = NEUTRAL["menu and advert"]
    assert main_text(html) == text
    with monkeypatch.context() as m:  # without ratios every line is content
        m.setattr(H, "ratios", lambda sizes, tags, links, worth=1.0: np.full(len(sizes), 50.0))
        assert sum(main_text(h or "") != t for h, t in [*PAGES.values(), NEUTRAL["menu and advert"]]) >= 10
    with monkeypatch.context() as m:  # without clusters the advert and the last line are too
        m.setattr(H, "content_region", lambda levels, floor: np.ones(len(levels), bool))
        assert main_text(html) == f"Buy now, cheap.\n{text}\nContact Terms us"
    with monkeypatch.context() as m:  # the region is more than its highest line
        m.setattr(H, "content_region", lambda levels, floor: levels >= levels.max())
        m.setattr(H, "_near", lambda containers, region: region)
        assert main_text(html.replace("<div>", "").replace("</div>", "")) != text


@pytest.mark.parametrize("junk", ['<a href="' * 110_000, "<!--" * 250_000, "<!-- > " * 100_000, "</" * 300_000, "<![CDATA[" * 60_000, "<![CDATA[ > " * 60_000, "<p " * 200_000, "<a b='>" * 100_000, "<?" * 200_000, "<!x" * 200_000], ids=lambda junk: junk[:7])
def test_markup_that_never_ends_takes_linear_time(junk):
    began = time.perf_counter()
    assert main_text(f"<article>{P}" + junk).startswith(T)
    assert time.perf_counter() - began < 5


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert main_text("<div>" * 50_000 + P) == T
    assert main_text("<div><p>x" * 20_000).count("\n") == 19_999
    assert main_text("<ul><li>" * 20_000 + P) == T
    assert time.perf_counter() - began < 10


def test_kept_names(spark):
    rows = spark.createDataFrame([(1, "<p>Some text</p>", "t", 2)], "page_id long, html string, text string, id int")
    assert extract(rows, keep=("text", "id")).collect()[0].asDict() == {"id": 1, "_text": "t", "_id": 2, "text": "Some text"}
