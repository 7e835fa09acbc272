"""Elements by tag and class: hand-worked pages, and drawn pages against the standard library's parser."""

import random
from html.parser import HTMLParser

from tributary.operators import markup

PAGE = """<!DOCTYPE html><title>no <a href=x>link</a></title><script>var a = "<ul class='list'>"</script><!-- <ul class=list> -->
<ul class="other list"><li><a href="/1">One</a><li><a title="a > b href='no'" href='/2?x=1&amp;y=2'>T<b>w</b>o &amp; more</a>
<ul class=list><li><a href=/3>Three</a></ul></ul></div><ul class="listing"><a href="/4">Four</a></ul>
<UL CLASS="list">empty</UL><ul class="list"><a name=x>no address</a><a href="/5">open <a href="/6">Six"""


def test_links_and_texts_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no markup < here")], "page_id long, html string")
    found = [tuple(r) for r in markup.links(pages, "ul", "list").orderBy("page_id", "element", "link").collect()]
    three = ("/3", "Three")
    inner = [("/1", "One"), ("/2?x=1&y=2", "Two & more"), three]
    want = [(1, 1, k + 1, *x) for k, x in enumerate(inner)] + [(1, 2, 1, *three), (1, 4, 1, "/5", "open "), (1, 4, 2, "/6", "Six")]
    assert found == want
    said = {r["element"]: r["text"] for r in markup.texts(pages, "ul", "list").collect()}
    assert said == {1: "OneTwo & more\nThree", 2: "Three", 3: "empty", 4: "no addressopen Six"}
    assert markup.links(pages, "ol").count() == 0
    assert [r["link"] for r in markup.links(pages, "ul", "listing").collect()] == [1]


class Plain(HTMLParser):
    """Links of each selected element by a list of the open ones."""

    def __init__(self):
        super().__init__()
        self.stack, self.out, self.n = [], [], 0

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "div":
            chosen = "pick" in (values.get("class") or "").split()
            self.n += chosen
            self.stack.append(self.n if chosen else None)
        elif tag == "a":
            self.out += [(k, values["href"]) for k in self.stack if k]

    def handle_endtag(self, tag):
        if tag == "div" and self.stack:
            self.stack.pop()


def test_drawn_pages_equal_a_parser(spark):
    rng = random.Random(3)
    pages = []
    for k in range(60):
        parts = [rng.choice(["<div class=pick>", "<div class='x pick'>", "<div>", "<div class=picked>", "</div>", "<p>", "</p>", "some text", f"<a href='/{i}'>t</a>"]) for i in range(rng.randrange(60))]
        # As many starts as ends before any place, but for elements that stay open.
        depth, kept = 0, []
        for x in parts:
            depth += x.startswith("<div") - (x == "</div>" and depth > 0)
            if x != "</div>" or depth >= 0:
                kept.append(x)
        pages.append((k, "".join(kept)))
    want = []
    for k, html in pages:
        plain = Plain()
        plain.feed(html)
        want += [(k, *x) for x in plain.out]
    found = markup.links(spark.createDataFrame(pages, "page_id long, html string"), "div", "pick")
    assert sorted(tuple(r) for r in found.select("page_id", "element", "href").collect()) == sorted(want)
