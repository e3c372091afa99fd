"""Pages that are no template: neutral and misleading names, broken tags, and time linear in the page."""

import time

import pytest

from millrace.llm import html_extract

MANY = " ".join(f"u{i} p-{i}" for i in range(40))


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div><div class="txt"><p>First para of the story is long enough.</p></div><div class="c2"><p>Second</p></div></div>', "First para of the story is long enough.\nSecond"),
        ('<article><h1>T</h1><div class="cookie-recipe"><p>Mix the flour and the sugar with the butter.</p></div><p>Serve it warm.</p></article>', "T\nMix the flour and the sugar with the butter.\nServe it warm."),
        ('<p class="a"">one two</p>', "one two"),
        ('<p title="x>one</p>', "one"),
        ("<p title='a>b'>one</p><p data-x=a\"b>two</p>", "one\ntwo"),
        ("<p/><p>a < b and 3<4</p>", "a < b and 3<4"),
        ("<p>text</p><a hre", "text"),
        ("<p>one<!-- <p>two</p> --></p><![CDATA[ x ]]><?php y ?><!DOCTYPE z>", "one"),
        (f'<div class="{MANY} sidebar"><p>Buy some stuff now.</p></div><main><p>Hello there, this is the text of the story. It goes on.</p></main>', "Hello there, this is the text of the story. It goes on."),
        ("<div id=a><div id=b><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div id=c><p>The council met on Monday, and it agreed to build a bridge.</p><p>Work begins in May.</p></div></div>", "The council met on Monday, and it agreed to build a bridge.\nWork begins in May."),
        ("<p>&lt;b&gt; &amp;amp; &#x41;&nbsp;z</p>", "<b> &amp; A z"),
    ],
)
def test_main_text(model, page, text):
    assert "\n".join(html_extract.main_blocks(page, model)) == text


@pytest.mark.parametrize("piece", ["<a ", "<p ", '<p class="', "<!--", "</y>", "<x>", "<h1>", "<div>", "<li>", "< ", "<p title='x", "<p><x></p>", "<td><x><p>"])
def test_a_megabyte_of_broken_tags_in_little_time(model, piece):
    source = "<p>one</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_extract.parse(source)
    assert time.process_time() - began < 5


def test_edges_depend_on_the_kind_of_the_child(model):
    assert len({tuple(model.edge[kind, i, j] for i in (0, 1) for j in (0, 1)) for kind in ("text", "box", "side", "group")}) == 4


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "u", "<p>Some text.</p>", 7, "c")], "page_id long, url string, html string, n_chars int, text string")
    assert [tuple(r) for r in html_extract.extract_text(df, model, carry=("url",)).collect()] == [(1, "u", "Some text.", 10)]


SAID, MORE = "The council met on Monday and agreed to build a bridge over the river. Work begins in May.", "Nobody had expected the decision, said the mayor."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><body><div id=nav><a href=/>Home</a> <a href=/a>About</a></div><div id=x>{SAID} {MORE}</div></body></html>", f"{SAID} {MORE}"),
        (f"<html><body><div id=nav><a href=/>Home</a> <a href=/a>About</a></div><div id=x>{SAID}<br><br>{MORE}</div><div>© 2020 The Paper</div></body></html>", f"{SAID} {MORE}"),
        (f"<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td><td><p>{SAID}</p><p>{MORE}</p></td></tr></table>", f"{SAID}\n{MORE}"),
        (f"<table><tr><td>Home News</td><td>{SAID} {MORE}</td></tr></table>", f"{SAID} {MORE}"),
        ("<article><h1>Ten places</h1><ul><li><a href=/1>The old bridge of the town</a></li><li><a href=/2>The market hall behind the church</a></li><li><a href=/3>The garden by the sea</a></li></ul></article>", "Ten places\nThe old bridge of the town\nThe market hall behind the church\nThe garden by the sea"),
        (f"<div><h1>News of the day</h1><p>{SAID}</p></div><div>3 Comments</div><div>I liked this very much. Thanks.</div><div>Me too, great work.</div>", f"News of the day\n{SAID}"),
        (f"<div><h1>News of the day</h1><p>{SAID}</p><div><h3>3 Comments</h3><div>Ann</div><div>I liked this very much. Thanks.</div></div></div>", f"News of the day\n{SAID}"),
    ],
)
def test_bare_text_link_lists_layout_tables_and_unnamed_comments(model, page, text):
    assert "\n".join(html_extract.main_blocks(page, model)) == text


@pytest.mark.parametrize(("kind", "most"), [("article", 0.01), ("bare", 0.01), ("links", 0.02), ("table", 0.01), ("talk", 0.01)])
def test_error_by_kind_of_page(model, kind, most):
    """Share of the elements with text that are judged wrong, on pages that the model has not seen."""
    wrong = seen = 0
    for k in range(100):
        source, content = html_extract.labelled_page(900_000 + k, kind)
        nodes, marks = html_extract.marked_nodes(source)
        p, _ = model.marginals(nodes)
        for node, mark, x in zip(nodes, marks, p, strict=True):
            if mark and "".join(part for part in node.parts if isinstance(part, str)).strip():
                seen += 1
                wrong += (x > 0.5) != (mark in content)
    assert seen > 500 and wrong / seen <= most


def plain_blocks(source, content):
    """Blocks of the elements marked as content, by the parser of the standard library: no tree, no model."""
    from html.parser import HTMLParser

    blocks, run, open_ = [], [], [True]

    class Reader(HTMLParser):
        hidden = 0

        def handle_starttag(self, tag, attrs):
            if tag in html_extract.INLINE:
                run.extend([" "] * (open_[-1] and tag in ("br", "img")))
                return
            self.flush()
            if tag in html_extract.VOID:
                return
            mark = dict(attrs).get("data-n")
            open_.append(mark in content if mark else open_[-1])
            self.hidden += tag in html_extract.HIDDEN

        def handle_endtag(self, tag):
            if tag not in html_extract.INLINE and tag not in html_extract.VOID:
                self.flush()
                open_.pop()
                self.hidden -= tag in html_extract.HIDDEN

        def handle_data(self, data):
            if open_[-1] and not self.hidden:
                run.append(data)

        def flush(self):
            if text := " ".join("".join(run).split()):
                blocks.append(text)
            run.clear()

    reader = Reader()
    reader.feed(source)
    reader.close()
    reader.flush()
    return blocks


def test_blocks_against_a_plain_version():
    """Parsing and joining of blocks, the labels given: every kind of page, references and hidden parts among the text."""

    class Given:
        def __init__(self, content):
            self.content = content

        def marginals(self, nodes):
            p = []
            place = {id(n): i for i, n in enumerate(nodes)}
            for n in nodes:
                mark = next((v for k, v in n.attrs if k == "data-n"), None)
                p.append(float(mark in self.content) if mark else p[place[id(n.parent)]] if n.parent is not None else 1.0)
            return p, []

    for k in range(300):
        source, content = html_extract.labelled_page(950_000 + k)
        source = source.replace("e ", "&eacute; ", 2).replace("</p>", "<script>var x = '<p>';</script></p>", 1).replace("<li", "<!-- <li> --><li", 1)
        assert html_extract.main_blocks(source, Given(content)) == plain_blocks(source, content), k
