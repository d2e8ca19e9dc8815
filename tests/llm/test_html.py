"""Page text: hand-made pages, the given table by its own markup, and the style tree."""

import html
import math
import re
from itertools import groupby

from geoevents.llm import html_text as H
from geoevents.llm.common import table
from geoevents.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text int, host string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "h") for i, u, h in rows], SCHEMA)


def texts(frame):
    return {r.page_id: r.text for r in frame.collect()}


def test_given_pages(spark, sf):
    rows = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    got = QUERIES["op7_html_text"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        article = rows[r.page_id].html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_structure_alone(spark):
    page = ('<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div id="content"><h1>Head &amp; more</h1>'
            '<p>a<p>b <b>x</b>y<br>z<ul><li>1<li>2</ul><div class="user-comments"><p>c</div><form>q<p>r</form><table><tr><td>k<td>l</table></div>'
            '<div class="cookie-notice">n</div><aside>s</aside><script>if (a</b) "</p>"</script><style>p{}</style><!-- no --><div style="display: none">h</div>'
            '<div class="adBox">ad</div><p>&nbsp;end&#33;\n two  spaces &lt;b&gt;</p><footer>f</footer>')
    assert texts(H.extract(pages(spark, [(1, "http://a/", page)])))[1] == "Head & more\na\nb xy z\n1\n2\nk\nl\nend! two spaces <b>"


def test_article_wins(spark):
    page = '<div><p>around</p></div><article><header><h1>Title</h1></header><p>one<p>two<div class="related">r</div></article><p>after</p>'
    assert texts(H.extract(pages(spark, [(1, None, page)])))[1] == "Title\none\ntwo"


def test_names_alone_drop_no_article(spark):
    body = "<h1>Title</h1><p>first words of the text<p>second words of the text"
    want = "Title\nfirst words of the text\nsecond words of the text"
    ads = '<div class="sidebar">s</div><div class="widget-ad">a</div>'
    wraps = ['<main class="content has-sidebar">{}</main>', '<article class="post has-comments">{}</article>', '<article class="related">{}</article>',
             '<div role="main" class="menu-layout">{}</div>', '<div class="widget Blog">{}</div>', '<div class="elementor-widget-text-editor">{}</div>',
             '<div class="layout hasSidebar">{}</div>', '<div class="page-search"><div class="share-layout">{}</div></div>',
             '<div class="sidebar-layout"><article>{}</article></div>', '<div class="menu"><main>{}</main></div>']
    rows = [(i, f"http://h{i}/", "<body>" + ads + w.format(body) + ads) for i, w in enumerate(wraps)]
    # the only article, in an element with less than half of the text; comments around other articles stay dropped
    rows.append((50, "http://h/", f'<p>{"teaser " * 30}</p><div class="menu-layout"><article>{body}</article></div>'))
    rows.append((51, "http://h/", f'<article>{body}</article><div class="comments"><article>c</article></div>'))
    assert texts(H.extract(pages(spark, rows))) == dict.fromkeys([*range(len(wraps)), 50, 51], want)


def test_tree_decides_on_kept_names(spark):
    """An element that holds most of the text on every page, the same on all, goes by the tree and not by its name."""
    box = f'<div class="sidebar"><p>{"same words " * 40}</p></div>'
    rows = [(i, f"http://site.example/{i}", f"{box}<div class=text><p>Own words {i}</p></div>") for i in range(12)]
    assert texts(H.extract(pages(spark, rows)))[3] == "Own words 3"
    rows = [(i, f"http://site.example/{i}", f'<div class="sidebar-page"><p>{f"Own words {i} " * 9}</p></div><p>same') for i in range(12)]
    assert texts(H.extract(pages(spark, rows)))[3].startswith("Own words 3")


def test_inline_noise_does_not_cut_a_block(spark):
    page = '<p>one <span class="share-button">s</span>two <script>x</script>three<nav>n</nav><p>four'
    assert texts(H.extract(pages(spark, [(1, "u", page)])))[1] == "one two three\nfour"


def test_edges(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a/", "<p>t"), (3, "http://a/", "<p>t"), (3, "http://a/", "<p>t"), (4, "u", "no markup &am text"),
            (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<p" ), (7, "u", "<p>" + "w " * 50_000)]
    got = H.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[None] == by[3] == "t" and by[4] == "no markup &am text" and by[5] == "deep" and len(by[7]) == 99_999
    assert H.extract(pages(spark, [])).count() == 0


def test_style_tree_prunes_what_all_pages_share(spark):
    """Twelve pages without an article element: the same box everywhere goes, what differs stays; a lone page keeps all."""
    rows = [(i, f"http://site.example/{i}", f"<div class=box><p>Same words everywhere</p></div><div class=text><p>Own words {i}</p><p>more {i * 7}</p></div>")
            for i in range(12)]
    rows.append((99, "http://other.example/", "<div class=box><p>Same words everywhere</p></div><div class=text><p>x</p></div>"))
    got = texts(H.extract(pages(spark, rows)))
    assert got[3] == "Own words 3\nmore 21" and got[99] == "Same words everywhere\nx"
    tree = {r.importance for r in H.style_tree(pages(spark, rows)).filter("host = 'site.example' and size(above) = 1").collect()}
    assert min(tree) < 0.01 and max(tree) > 0.99


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://site.example/", "<nav>m</nav><article><p>one and the same</p></article>") for i in range(20)]
    assert set(texts(H.extract(pages(spark, rows))).values()) == {"one and the same"}


def test_reader_comments_go_however_long(spark):
    long = "<p>reader words " * 40
    rows = [(1, "u", f'<article><p>short</p><div class="comments">{long}</div></article>'),
            (2, "u", f'<main><h1>T</h1><p>short</p><section id="comments-list">{long}</section></main>'),
            (3, "u", f'<div><p>short</p></div><div class="disqus">{long}</div>'),
            (4, "u", f'<div class="comments-enabled"><p>all there is</p></div>')]
    assert texts(H.extract(pages(spark, rows))) == {1: "short", 2: "T\nshort", 3: "short", 4: "all there is"}


def test_story_beside_teasers(spark):
    story = "".join(f"<p>Paragraph {k} of the story</p>" for k in range(40))
    want = "\n".join(f"Paragraph {k} of the story" for k in range(40))
    teasers = "<ul><li><article>Teaser one</article><li><article>Teaser two</article></ul>"
    rows = [(1, "http://h1/", f"<div id=story>{story}</div><div>{teasers}</div>"), (2, "http://h2/", f"<div>{story}</div><article>Lone teaser</article>"),
            (3, "http://h3/", f"<main>{story}{teasers}</main>"),
            (4, "http://h4/", f"<article><h2>First</h2>{story}</article><article><h2>Second</h2>{story}</article><p>around</p>")]
    got = texts(H.extract(pages(spark, rows)))
    assert got[1] == got[2] == want and got[3] == want + "\nTeaser one\nTeaser two" and got[4] == f"First\n{want}\nSecond\n{want}"


def plain_tree(pages_of_host, decay=0.9):
    """A site style tree by recursion over whole pages: {(style path): (pages, importance)} of the places that two pages or more show."""
    found = {}

    def full(e):
        e.children = [c for c in e.children if c.text or full(c)]
        return bool(e.children)

    def entropy(counts, m):
        return -sum(n / m * math.log(n / m, m) for n in counts)

    def importance(place, pages):
        """``pages``: for each page its elements at this place."""
        styles, texts = {}, {}
        for page, same in enumerate(pages):
            for e in same:
                runs = [e] if e.text else e.children
                shown = tuple(s for s, _ in groupby(c.style for c in runs))
                if e.text or shown == (0,):
                    shown = (0,)
                    for c in runs:
                        texts.setdefault(c.text, set()).add(page)
                else:
                    for k, (_, run) in enumerate(groupby(e.children, key=lambda c: c.style)):
                        styles.setdefault(shown, {}).setdefault(page, {}).setdefault(k, []).extend(run)
                styles.setdefault(shown, {}).setdefault(page, {})
        m = sum(map(len, styles.values()))
        if m == 1:
            return 1.0
        content = 1 - sum(math.log(len(p), m) for p in texts.values()) / len(texts) if texts else 0.0
        below = 0.0
        for shown, by_page in styles.items():
            worth = content if shown == (0,) else sum(
                importance((*place, shown, k), [p[k] for p in by_page.values()]) for k in range(len(shown))) / len(shown)
            below += len(by_page) / m * worth
        damp = decay ** len(styles)
        value = content if set(styles) == {(0,)} else (1 - damp) * entropy(map(len, styles.values()), m) + damp * below
        found[place] = m, value
        return value

    roots = [H.read_page(h)[1] for h in pages_of_host]
    for r in roots:
        full(r)
    importance((), [[r] for r in roots])
    return sorted((m, round(v, 9)) for place, (m, v) in found.items() if place)


def test_style_tree_equals_a_plain_one(spark):
    """Pages with an article and with none, several styles at a place, runs of like children, text beside elements, comments and scripts."""
    rows = []
    for i in range(30):
        menu = "".join(f"<li>item {k}" for k in range(2 + i % 2))
        tail = ["", "<div class=box><p>tail</p>loose text</div>", f"<table><tr><td>{i // 4}<td>x</table>"][i % 3]
        body = "".join(f"<p>Words {i * k % 11}" for k in range(1 + i % 5))
        inner = f"<h1>Title {i // 2}</h1>{body}{tail}"
        main = f"<article>{inner}</article>" if i % 4 else f"<div id=a{i}>{inner}</div>"
        rows.append((i, f"http://h{i % 3 // 2}/", f"<html><body><nav><ul>{menu}</ul><script>s()</script></nav>{main}<footer>f {i % 2}</footer>"))
    tree = H.style_tree(pages(spark, rows)).collect()
    for host in ("h0", "h1"):
        want = plain_tree([h for _, u, h in rows if u == f"http://{host}/"])
        assert sorted((r.pages, round(r.importance, 9)) for r in tree if r.host == host) == want and len(want) > 10


def test_tree_prunes_inside_articles(spark):
    """What half of a host's articles show goes; headings and what few pages share stay, however it repeats."""
    box = "<section><p>Read us daily</p></section>"
    rows = [(i, "http://a.example/", f"<article><h1>News</h1><p>Own words {i} of a story</p><p>more words {i * 7}</p>{box}</article>") for i in range(12)]
    rows += [(100 + i, "http://b.example/", f"<article><h1>Other {i}</h1><p>Own words {i}</p>{box if i < 9 else ''}</article>") for i in range(30)]
    rows += [(150 + i, "http://b.example/", f"<div>Page {i} of a list</div>") for i in range(30)]
    rows += [(300 + i, "http://a.example/", f"<div>Page {i} of a list</div>") for i in range(30)]
    rows += [(200 + i, "http://c.example/", f"<article><h1>Copy {i}</h1><p>one and the same long text</p></article>") for i in range(12)]
    got = texts(H.extract(pages(spark, rows)))
    assert got[3] == "News\nOwn words 3 of a story\nmore words 21"
    assert got[103] == "Other 3\nOwn words 3\nRead us daily" and got[203] == "Copy 3\none and the same long text"


def test_deep_pages_are_leaves(spark):
    rows = [(i, "http://a.example/", "<div>" * 300 + f"deep {i}<p>same") for i in range(9)]
    assert H.style_tree(pages(spark, rows)).selectExpr("max(size(above))").first()[0] == H.TREE_DEPTH - 1
    assert texts(H.extract(pages(spark, rows)))[4] == "deep 4\nsame"
