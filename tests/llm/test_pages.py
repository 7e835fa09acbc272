"""Main text of pages: names of parts, votes of a host and the choice of containers, by a plain version."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm import html

SCHEMA = "page_id long, url string, html string"


def said(k: int, n: int) -> str:
    return " ".join(f"word{chr(97 + k % 26)}{chr(97 + i % 26)}" for i in range(n)) + "."


@pytest.mark.parametrize("name", "post-comments entry-comments story-replies page-comments comments-container comments-wrap layout-sidebar comments postComments page__comments comment-content".split())
def test_long_comments_leave_a_short_article_alone(name):
    for article in ("<article><h1>Head</h1><p>{}</p></article>", "<div class=post><p>Head</p><p>{}</p></div>"):
        page = html.Page(f"<body>{article.format(said(1, 12))}<div class='{name}'>" + f"<p>{said(2, 40)}</p>" * 8 + "</div></body>")
        assert page.text_of(page.chosen([])[0]) == f"Head\n{said(1, 12)}"


@pytest.mark.parametrize("name", ["post has-comments", "content no-sidebar", "ad-free story", "post-with-comments", "layout-with-sidebar", "article social-news", "page-without-menu"])
def test_parts_that_an_article_has_or_lacks_do_not_drop_it(name):
    for tag in ("div", "article"):
        page = html.Page(f"<body><{tag} class='{name}'><p>{said(1, 30)}</p></{tag}><div class=comments><p>{said(2, 9)}</p></div></body>")
        assert page.text_of(page.chosen([])[0]) == said(1, 30)


def test_a_host_decides_for_a_page_that_looks_otherwise(spark):
    page = lambda k, more="": f"<body><div class=wrap><div class='post'><p>{said(k, 40)}</p></div>{more}</div></body>"
    pages = [(k, "http://h.example/", page(k)) for k in range(20)]
    pages += [(20, "http://h.example/", page(20, f"<div class=thoughts><p>{said(3, 90)}</p></div>")), (21, "http://h.example/", page(21, f"<div class=post-comments><p>{said(4, 90)}</p></div>"))]
    pages += [(22, "http://h.example/", f"<body><section><p>{said(22, 30)}</p></section></body>"), (23, "http://other.example/", pages[20][2])]
    found = {r["page_id"]: r for r in html.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(found[k]["text"] == said(k, 40) and found[k]["by_vote"] for k in range(22))
    assert found[22]["text"] == said(22, 30) and not found[22]["by_vote"]
    assert found[23]["text"] == f"{said(20, 40)}\n{said(3, 90)}"


def test_signs_in_class_names(spark):
    page = lambda k, more="": f"<body><div class='a>b'><p>{said(k, 40)}</p></div>{more}</body>"
    pages = [(k, "http://h.example/", page(k)) for k in range(12)] + [(12, "http://h.example/", page(12, f"<div class=x><p>{said(5, 70)}</p></div>"))]
    assert {r["page_id"]: (r["text"], r["by_vote"]) for r in html.extract(spark.createDataFrame(pages, SCHEMA)).collect()} == {k: (said(k, 40), True) for k in range(13)}


def test_winning_paths_of_a_host_with_many(spark):
    counted = spark.range(6000).selectExpr("if(id % 2 = 0, 'h', '') as host", "array('body', concat('p', id)) as path", "if(id < 40, id + 1, 1) * 400 as pages", "cast(id % 7 as double) as weight")
    rows = sorted(counted.collect(), key=lambda r: (-r["pages"], -round(r["weight"], 3), r["path"]))
    for share in (0.0005, 0.002, 0.1):
        votes = {h: sum(r["pages"] for r in rows if r["host"] == h) for h in ("h", "")}
        want = {h: [r["path"] for r in rows if r["host"] == h and r["pages"] >= share * votes[h]] for h in votes}
        assert {r["host"]: r["paths"] for r in html.winning_paths(counted, share).collect()} == want


def test_tied_votes_for_different_paths(spark):
    kind = lambda k, name: f"<body><div class={name}><p>{said(k, 30)}</p></div></body>"
    pages = [(k, "http://t.example/", kind(k, "one" if k % 2 else "two")) for k in range(10)]
    both = f"<body><p><b>x</b></p><div class=one><p>{said(1, 30)}</p></div><div class=two><p>{said(1, 30)}</p></div></body>"
    rows = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([*pages, (10, "http://t.example/", both), (11, "http://t.example/", both)], SCHEMA)).collect()}
    assert all(rows[k] == said(k, 30) for k in range(10)) and rows[10] == rows[11]


def test_a_very_long_block(spark):
    long = said(1, 400_000)
    page = f"<body><div class=menu><p>x</p></div><div class=post><p>{long}</p></div></body>"
    row = html.main_texts(spark.createDataFrame([(1, "http://l.example/", page)], SCHEMA)).select(F.sha2("text", 256).alias("h"), "n_chars").first()
    assert row["n_chars"] == len(long) and row["h"] == __import__("hashlib").sha256(long.encode()).hexdigest()


#: What names say: left out, may be excused, comments, added score.
NAMES = {
    "": (False, False, False, 0.0),
    "plain": (False, False, False, 0.0),
    "post": (False, False, False, 0.25),
    "part-7": (False, False, False, 0.0),
    "side-menu": (True, False, False, 0.0),
    "share story": (True, False, False, 0.25),
    "social-news story": (True, True, False, 0.25),
    "post-comments": (True, False, True, 0.25),
    "has-notice": (False, False, False, 0.0),
}


def made_page(rng: random.Random):
    """A tree of (tag, name, children or (text, linked))."""

    def element(depth):
        if depth > 3 or rng.random() < 0.25:
            return ("p", "", (said(rng.randrange(26), rng.randrange(1, 30)), rng.random() < 0.15))
        return (rng.choice(["div", "div", "section", "article"]), rng.choice(list(NAMES)), [element(depth + 1) for _ in range(rng.randrange(1, 4))])

    return ("body", "", [element(0) for _ in range(rng.randrange(1, 4))])


def written(node) -> str:
    tag, name, below = node
    if tag == "p":
        return f"<p><a href=x>{below[0]}</a></p>" if below[1] else f"<p>{below[0]}</p>"
    return f"<{tag} class='{name}'>{''.join(map(written, below))}</{tag}>"


def plain_containers(tree):
    """(path, depth, score, text) of every container in document order, by walking the tree for each sum anew."""

    def leaves(node):
        return [node[2]] if node[0] == "p" else [x for b in node[2] for x in leaves(b)]

    def free(node):
        return sum(0 if linked else len(text) for text, linked in leaves(node))

    def suspect(node):
        left_out = NAMES[node[1]][0]
        # An article is one only by its own list of words: of these names, comments alone.
        return NAMES[node[1]][2] if node[0] == "article" else left_out

    order, at, starts = [], [0], {}

    def walk(node, path, depth):
        starts[id(node)] = at[0]
        if node[0] == "p":
            at[0] += 1
            return
        name = node[1].replace("7", "#")
        path = [*path, node[0] + "".join(f".{c}" for c in sorted(name.split()))]
        order.append((node, path, depth))
        for b in node[2]:
            walk(b, path, depth + 1)

    walk(tree, [], 0)
    landmarks = [starts[id(n)] for n, _, _ in order if n[0] == "article" and not suspect(n)]
    gone = set()
    for n, _, _ in order:
        if suspect(n) and n is not tree:
            inside = range(starts[id(n)], starts[id(n)] + len(leaves(n)))
            stays = 2 * free(n) > free(tree) and not NAMES[n[1]][2] and (NAMES[n[1]][1] or any(k in inside for k in landmarks))
            if not stays:
                gone |= set(inside)
    everything = leaves(tree)
    if not any(not linked and k not in gone for k, (_, linked) in enumerate(everything)):
        gone = set()
    out = []
    for n, path, depth in order:
        mine = [k for k in range(starts[id(n)], starts[id(n)] + len(leaves(n))) if k not in gone]
        good, bound = sum(len(everything[k][0]) for k in mine), sum(len(everything[k][0]) for k in mine if everything[k][1])
        bonus = max(0.5 if n[0] == "article" else 0.0, NAMES[n[1]][3])
        out.append((path, depth, max(0, good - 2 * bound) * (1 + bonus), mine, good))
    return out, everything


def test_score_vote_and_choice_equal_a_plain_version(spark):
    rng = random.Random(5)
    trees = [(k, f"http://h{min(4, int(rng.expovariate(0.7)))}.example/", made_page(rng)) for k in range(150)]
    # Half of the pages of a host are alike but for their texts.
    alike = ("body", "", [("div", "side-menu", [("p", "", (said(1, 9), False))]), ("div", "part-7", [("p", "", (said(2, 20), False)), ("p", "", (said(3, 25), False))])])
    trees += [(150 + k, f"http://h{k % 3}.example/", alike) for k in range(60)]
    pages = {k: plain_containers(t) for k, _, t in trees}
    votes = defaultdict(Counter)
    weights = defaultdict(float)
    own = {}
    for k, url, _ in trees:
        usable = [(-score, -depth, i) for i, (_, depth, score, _, good) in enumerate(pages[k][0]) if good]
        best = pages[k][0][min(usable)[2]] if usable else None
        own[k] = best
        if best and best[2] > 0:
            votes[url][tuple(best[0])] += 1
            weights[url, tuple(best[0])] += math.log1p(best[2])
    want = {}
    for k, url, _ in trees:
        total = sum(votes[url].values())
        ways = sorted((p for p, n in votes[url].items() if n >= 0.1 * total), key=lambda p: (-votes[url][p], -round(weights[url, p], 3), p))
        held = {p: [c for c in pages[k][0] if tuple(c[0]) == p and c[4]] for p in ways}
        if own[k] and own[k][2] > 0 and tuple(own[k][0]) in ways:
            chosen = held[tuple(own[k][0])]
        else:
            chosen = next((held[p] for p in ways if sum(c[2] for c in held[p]) > 0), [own[k]] if own[k] else [])
        mine = sorted({b for c in chosen for b in c[3]})
        want[k] = "\n".join(pages[k][1][b][0] for b in mine)
    rows = html.main_texts(spark.createDataFrame([(k, url, written(t)) for k, url, t in trees], SCHEMA)).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert sum(1 for k, _, _ in trees if own[k] and want[k] != "\n".join(pages[k][1][b][0] for b in own[k][3])) > 5
