"""What counts as template on a host of several templates, of long tables and of many pages."""

from __future__ import annotations

from usagelens.llm import html_text


def texts(pages):
    wrapper = html_text.Node("page")
    for page in pages:
        html_text.merge(wrapper, html_text.read(page)[0])
    wrapper = html_text.Node.unpacked(wrapper.packed())
    content = html_text.content_nodes(wrapper)
    return ["\n".join(html_text.main_blocks(wrapper, content, page)) for page in pages]


def test_pages_without_an_article_on_a_host_that_marks_articles():
    marked = [f"<body><div>Welcome</div><article><p>Story {n}</p></article></body>" for n in range(20)]
    plain = [f"<body><div>Welcome</div><div class=post><p>Post {n}</p></div></body>" for n in range(20)]
    assert texts(marked + plain) == [f"Story {n}" for n in range(20)] + [f"Post {n}" for n in range(20)]


def test_repeated_cells_of_one_page_are_no_template():
    table = "<body><p>Table of all</p><table>" + "<tr><td>yes</td></tr>" * 40 + "</table></body>"
    found = texts([table] + [f"<body><p>Page {n}</p><table><tr><td>cell {n}</td></tr></table></body>" for n in range(40)])
    assert found[0].count("yes") == 40


def test_headings_of_a_finite_vocabulary_stay_at_any_number_of_pages():
    page = "<body><article><h2>Heading {h}</h2><p>Notice on every page</p><p>Text {n}</p></article></body>"
    for many in (20, 4000):
        assert texts([page.format(h=n % 5, n=n) for n in range(many)]) == [f"Heading {n % 5}\nText {n}" for n in range(many)]


def test_constant_texts_among_many_on_a_page():
    page = lambda n: "<body><div>" + "".join(f"<p>Item {n} {i}</p>" for i in range(300)) + "<p>All rights</p></div></body>"
    assert not any("All rights" in text or text.count("Item") != 300 for text in texts([page(n) for n in range(40)]))
