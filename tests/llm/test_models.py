"""Operators whose results are learned or extracted: held-out accuracy, fixtures with known text, known alignments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import html, media, registry, toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.op3_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert held and sum(p == y for p, y in held) / len(held) >= 0.9


def test_toxicity_of_odd_rows(spark, odd, none):
    few = spark.createDataFrame([(7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.judged(odd, few).count() == odd.count()
    assert toxicity.judged(none, few).count() == 0
    assert toxicity.without_toxic(odd, few.where("toxic > 5")).columns == odd.columns


def test_levenshtein_automaton_agrees_with_the_table():
    import random

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    draw = random.Random(4)
    terms = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(1, 9))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(500):
        word = "".join(draw.choice("abcd") for _ in range(draw.randrange(1, 10)))
        for edits in (0, 1, 2):
            best = min((distance(word, t), k) for k, t in enumerate(terms))
            assert trie.nearest(word, edits) == (best if best[0] <= edits else None)


def test_matches_survive_a_full_memo(monkeypatch):
    monkeypatch.setattr(toxicity, "_MEMO", 2)
    found = toxicity.Matcher(["stupid", "clown"]).matches("you stupid clown, what a stupyd and endless lot of other words, clown")
    assert [(d, t) for d, t, _ in found] == [(0, 0), (0, 1), (1, 0), (0, 1)]


def test_balanced_labels_and_a_large_lexicon(spark):
    import random

    draw = random.Random(6)
    spell = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, bad = [spell(7) for _ in range(300)], [spell(8) for _ in range(600)]
    source, marks = [], []
    for k in range(1600):
        text = [draw.choice(common) for _ in range(60)]
        if k % 2:
            text += draw.sample(bad, 40)
        draw.shuffle(text)
        source.append((k, " ".join(text)))
        marks.append((k, k % 2))
    model = toxicity.fit(spark.createDataFrame(source, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert set(bad) == set(model.terms)
    matcher = toxicity.Matcher(model.terms, model.fuzzy)
    scores = [(model.probability(matcher.matches(t)) >= 0.5) == bool(k % 2) for k, t in source]
    assert all(scores)


def test_misspellings_with_digits_and_insertions():
    find = lambda text: [(d, t) for d, t, _ in toxicity.Matcher(["stupid", "clownish", "abcdefg"]).matches(text)]
    assert find("so st0pid a man of 2024 and stupid123, 5tupid") == [(1, 0), (0, 0), (1, 0)]
    assert find("abxcdexfg") == [(2, 2)] and find("cl0wn1sh") == [] and find("cl0wnish") == [(1, 1)]


def slow_score(model, text: str) -> float:
    """The score by comparing every word with every term."""
    import math
    import re

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def whole(word: str):
        if word in model.terms:
            return 0, model.terms.index(word)
        edits = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
        d, k = min(((distance(word, t), k) for k, t in enumerate(model.terms)), default=(9, 0))
        return (d, k) if edits and d <= edits and model.fuzzy[k] else None

    low = text.lower()
    places = [m.span() for m in re.finditer(r"(?<![^\W_])\d*+[^\W\d_][^\W_]*", low)]
    words = [low[a:b] for a, b in places]
    sums = [0.0, 0.0, 0.0]
    for k, w in enumerate(words):
        hit = whole(w) or (None if w.isalpha() else min(filter(None, map(whole, re.findall(r"[^\W\d_]+", w))), default=None))
        if hit:
            a, b = max(0, k - 6), min(len(words), k + 7)
            near = min([abs(j - k) for j in range(a, b) if words[j] in toxicity.REPORTING], default=7)
            q = 1.0 if _enclosed(low, *places[k]) else 1 - max(0, near - 1) / 6
            sums[int(hit[0] > 0)] += 1 - q
            sums[2] += q
    z = model.weights[0] + sum(w * math.floor(2 * math.log2(1 + x) + 0.5) / 2 for w, x in zip(model.weights[1:], sums, strict=True))
    return 1 / (1 + math.exp(-z))


def _enclosed(text: str, start: int, end: int) -> bool:
    """Whether a pair of marks of one kind stands around a stretch, in its line."""
    first, last = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    line, x, y = text[first : last if last >= 0 else len(text)], start - first, end - first
    for marks in ('"“”„', "«»", "‘’", "`"):
        opened = None
        for at, c in enumerate(line):
            inside = 0 < at < len(line) - 1 and line[at - 1].isalnum() and line[at + 1].isalnum()
            if c in marks and not inside:
                if opened is not None:
                    if opened < x and y <= at:
                        return True
                    opened = None
                elif c != "’":
                    opened = at
    return False


def test_scores_by_comparing_every_word_with_every_term(spark):
    import random

    draw = random.Random(9)
    model = toxicity.Model(["stupid", "clownish", "rat", "idiotface"], [True, True, True, False], [-2.0, 1.7, 1.1, -0.4])
    parts = ["stupid", "stupyd", "stpid", "clownissh", "clwnish", "rat", "rats", "idiotface", "idiotfaces", "st0pid", "said", "word", '"', "“", "the", "of", "man", "7", "stupid7", ",", "Clownish"]
    source = [(k, " ".join(draw.choice(parts) for _ in range(draw.randrange(40)))) for k in range(200)] + [(900, None), (901, ""), (902, "stupid " * 3000), (903, "x" * 20_000), (0, "stupid")]
    found = sorted((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(spark.createDataFrame(source, "doc_id long, text string"), model).collect())
    assert found == sorted((k, round(slow_score(model, t or ""), 9)) for k, t in source)


def test_a_match_counts_as_quotation_the_nearer_a_word_of_reporting_stands():
    scores = [q for *_, q in toxicity.Matcher(["stupid"]).matches(" ".join(["stupid", *["x"] * 20, "stupid", "said", *["x"] * 20, "said", "a", "b", "stupid", *["x"] * 20, '"', "stupid", '"', "end"]))]
    assert [round(q, 2) for q in scores[:3]] == [0, 1, 0.67] and scores[3] in (0, 1)


def test_main_text_of_pages(spark):
    frame = "<html><head><title>T</title><script>x='<p>'</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>{}<div id=comments><p>Reader says hello to all of you here</p></div><aside>More</aside><form>Name <input></form><footer>&copy; us</footer></body></html>"
    body = "<div class='post-{}'><h1>Head &amp; tail</h1><p>First  para\n graph with <b>bold</b> words that go on.<p>Second&nbsp;one<br>goes on for some time as well.</p><ul><li>a<li>b</ul></div>"
    pages = [(k, f"http://h.example/{k}", frame.format(body.format(k))) for k in range(5)] + [(10, None, None), (11, "x", ""), (12, "http://h.example/", "<p>open <i>markup & more text")]
    found = {r["page_id"]: r for r in html.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[k]["text"] == "Head & tail\nFirst para graph with bold words that go on.\nSecond one goes on for some time as well.\na\nb" for k in range(5))
    assert found[10]["text"] == found[11]["text"] == "" and found[12]["text"] == "open markup & more text"
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_articles_in_several_containers_are_whole(spark):
    part = "<div class='{}'><p>{}</p></div>"
    say = lambda k, n: f"{' '.join(f'word{chr(97 + k)}{chr(97 + i % 26)}' for i in range(n))}."
    one = lambda k: f"<html><body><div class='wrap'>{part.format('post', say(k, 80))}</div></body></html>"
    two = f"<html><body><div class='wrap'>{part.format('post', say(20, 60))}{part.format('post', say(21, 50))}</div></body></html>"
    numbered = [f"<html><body><div>{''.join(part.format(f'part-{i}', say(k + i, 60)) for i in range(n))}</div></body></html>" for k, n in ((1, 1), (2, 1), (3, 1), (4, 3))]
    other = f"<html><body><div class='wrap'>{part.format('post', say(5, 40))}<div class='more'><p>{say(6, 60)}</p></div></div></body></html>"
    pages = [(k, "http://a.example/", one(k)) for k in range(5)] + [(10, "http://a.example/", two), (11, "http://a.example/", other)] + [(20 + k, "http://b.example/", h) for k, h in enumerate(numbered)]
    found = {r["page_id"]: r for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[0]["text"] == say(0, 80) and found[0]["by_vote"]
    assert found[10]["text"] == f"{say(20, 60)}\n{say(21, 50)}" and found[10]["by_vote"]
    assert found[11]["text"] == f"{say(5, 40)}\n{say(6, 60)}"
    assert found[23]["text"] == "\n".join(say(4 + i, 60) for i in range(3))


def test_markup_that_is_broken_or_misleading(spark):
    made = {
        "<p>a<![foo b": "a",
        "<p>x<![foo b]>yes": "xyes",
        "<!--unclosed <p>a": "",
        "<p>k<a href='x><p>abc": "k",
        "<div class='no-sidebar content'><p>Some long text</p></div>": "Some long text",
        "<div class='layout-with-sidebar'><h1>H</h1><p>Some long text here</p><div class=sidebar>side</div></div>": "H\nSome long text here",
        "<div class='page has-notice'><p>Some text</p></div>": "Some text",
        "<div class='article social-news'><p>Some text</p></div>": "Some text",
        "<body><form><p>All in a form</p><input></form></body>": "All in a form",
        "<p>a text</p><div id=comments>" + "<p>so says a reader</p>" * 30 + "</div>": "a text",
        "<ul><li>a<li>b</ul><table><tr><td>x<td>y</table>": "a\nb\nx\ny",
        "a < b &amp; c": "a < b & c",
    }
    source = [(k % 3, "http://x.example/", h, k) for k, h in enumerate(made)]
    df = spark.createDataFrame(source, "page_id long, url string, html string, text int").withColumn("path", F.lit(1)).withColumn("host", F.lit("h"))
    found = sorted((r["page_id"], r["text"]) for h in made for r in html.extract(df.where(F.col("html") == h)).collect())
    assert found == sorted((k % 3, t) for k, t in enumerate(made.values()))
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_pages_take_no_longer_than_their_length():
    import time

    for html_of in (lambda n: "<div class=a>" * n + "".join(f"<p>w {i}" for i in range(n)) + "</div>" * n, lambda n: "<b>" * n + "<p>x</b>" * n, lambda n: "<div>" * n + "</x>" * n, lambda n: "<" * n + "a='" * n):
        took = []
        for n in (3_000, 30_000):
            began = time.perf_counter()
            page = html.Page(html_of(n))
            page.text_of([page.scored()[0][1]] if page.scored() else [])
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * took[0] + 1


def test_ties_and_rows_that_repeat(spark):
    page = "<body><div class=a1><p>{0}</p></div><div class=b1><p>{0}</p></div></body>"
    source = [(k, "http://t.example/", page.format("same words here in both")) for k in (1, 1, 2)]
    rows = html.extract(spark.createDataFrame(source, "page_id long, url string, html string")).collect()
    assert len(rows) == 3 and len({(r["text"], r["path"]) for r in rows}) == 1


def test_recordings_align_at_their_offset(spark):
    draw = np.random.default_rng(1)
    time = np.arange(2000) / media.RATE

    def play(seed: int) -> np.ndarray:
        notes = np.random.default_rng(seed).integers(0, 24, size=40)
        return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * time) for n in notes])

    one, two = play(1), play(2)
    shifted = one[20 * media.HOP :] + draw.normal(0, 100, len(one) - 20 * media.HOP)
    source = [(k, x.astype("<i2").tobytes()) for k, x in ((0, one), (1, shifted), (2, two))] + [(3, None), (4, b"")]
    prints = media.fingerprints(spark.createDataFrame(source, "rec_id long, pcm binary"))
    found = {r["rec_id"]: {m["query"]: m["offset"] for m in r["matches"]} for r in media.align(prints, prints.where("rec_id = 0")).collect()}
    assert found == {0: {0: 0}, 1: {0: -20}, 2: {}, 3: {}, 4: {}}


def every_offset(queries, x):
    """query -> (least share of differing bits, offset) over all offsets that overlap by half."""
    out = {}
    for q, other in queries:
        tried = []
        for shift in range(1 - len(other), len(x)):
            a, b = max(0, shift), min(len(x), len(other) + shift)
            if 2 * (b - a) >= min(len(x), len(other)):
                tried.append((float(np.bitwise_count(x[a:b] ^ other[a - shift : b - shift]).sum()) / (32 * (b - a)), abs(shift), shift))
        if tried and min(tried)[0] <= media.BIT_ERRORS:
            out[q] = (min(tried)[0], min(tried)[2])
    return out


def test_alignment_finds_what_every_offset_finds():
    draw = np.random.default_rng(3)
    queries = [(q, draw.integers(0, 1 << 32, 110, dtype=np.uint32)) for q in range(40)]
    index = media.Index([(q, x.astype("<u4").tobytes()) for q, x in queries])
    for rate, least in ((0.0, 1.0), (0.1, 1.0), (0.2, 0.99), (0.23, 0.95)):
        want, same = 0, 0
        for q, x in queries:
            flip = np.packbits(draw.random((110, 32)) < rate, axis=1).view(">u4").ravel().astype(np.uint32)
            heard = (x ^ flip)[q:]
            brute = every_offset(queries, heard)
            found = {k: (e, at) for k, at, e in index.align(heard)}
            assert found.items() <= brute.items()
            want, same = want + len(brute), same + len(found)
        assert want >= 35 and same >= least * want, (rate, same, want)


def test_short_recordings_are_compared_by_spectra_and_align_as_by_the_index(monkeypatch):
    draw = np.random.default_rng(6)

    def flipped(x: np.ndarray, rate: float) -> np.ndarray:
        return x ^ np.packbits(draw.random((len(x), 32)) < rate, axis=1).view(">u4").ravel().astype(np.uint32)

    prints = [draw.integers(0, 1 << 32, int(n), dtype=np.uint32) for n in draw.integers(1, 700, 40)] + [np.zeros(n, dtype=np.uint32) for n in (1, 2, 60, 512, 513)]
    heard = [flipped(x[len(x) // 5 :], rate) for x in prints for rate in (0.0, 0.1, 0.22, 0.25)] + [prints[0][:0], prints[3], prints[3]]
    queries = [(k, x.astype("<u4").tobytes()) for k, x in enumerate(prints)]
    index = media.Index(queries)
    want = [index.align(x) for x in heard]
    assert [sorted(x) for x in media.Block(queries).align(heard)] == [sorted(x) for x in want] and sum(map(len, want)) > 100
    short = [(k, x) for k, x in queries if len(x) <= 4 * media.SHORT]
    assert len(short) < len(queries)
    monkeypatch.setattr(media.Index, "_histogram", lambda *_: 1 / 0)
    assert sum(map(len, media.Block(short).align([x for x in heard if len(x) <= media.SHORT]))) > 50


def test_filters_of_a_fingerprint_are_quantised_together(monkeypatch):
    """Each filter's few numbers were quantised by themselves before, which took as long as the spectra."""
    calls, plain = [], np.digitize
    monkeypatch.setattr(np, "digitize", lambda *given: calls.append(1) or plain(*given))
    sound = np.random.default_rng(5).normal(0, 3000, 32_768)
    found = media.fingerprint(sound)
    assert len(calls) == 1 and len(found) == 110 and len(set(found.tolist())) > 50
    assert (media.fingerprint(sound[20 * media.HOP :]) == found[20:]).all()


def test_silence_takes_no_longer_than_its_length(spark):
    import time

    took = []
    for n in (4_000, 64_000):
        silence = np.zeros(n, dtype=np.uint32)
        index = media.Index([(1, silence.astype("<u4").tobytes()), (2, np.random.default_rng(2).integers(0, 1 << 32, n, dtype=np.uint32).astype("<u4").tobytes())])
        began = time.perf_counter()
        assert index.align(silence) == [(1, 0, 0.0)]
        took.append(time.perf_counter() - began)
    assert took[1] < 60 * took[0] + 1
    part = np.zeros(500, dtype=np.uint32)
    part[100:200] = np.random.default_rng(1).integers(0, 1 << 32, 100, dtype=np.uint32)
    assert media.Index([(5, part.astype("<u4").tobytes())]).align(part[60:460]) == [(5, -60, 0.0)] == [(q, at, e) for q, (e, at) in every_offset([(5, part)], part[60:460]).items()]
    empty = spark.createDataFrame([], "rec_id long, pcm binary")
    odd = spark.createDataFrame([(1, bytes(20_000), 3), (1, bytes(20_000), 3), (2, None, 4)], "rec_id long, pcm binary, fingerprint int").withColumn("matches", F.lit(1))
    prints = media.fingerprints(odd)
    assert media.fingerprints(empty).count() == 0 == media.align(media.fingerprints(empty), prints).count()
    assert sorted((r["rec_id"], len(r["matches"])) for r in media.align(prints, prints).collect()) == [(1, 1), (1, 1), (2, 0)]


def test_rows_with_repeated_or_null_ids_stay_apart_in_any_number_of_blocks(spark):
    draw = np.random.default_rng(4)
    one, two, three = (draw.integers(0, 1 << 32, 60, dtype=np.uint32).astype("<u4").tobytes() for _ in range(3))
    prints = spark.createDataFrame([(1, one), (1, two), (None, one), (None, three), (2, b""), (3, three)], "rec_id long, fingerprint binary")
    said = lambda block: sorted((str(r["rec_id"]), [m["query"] for m in r["matches"]]) for r in media.align(prints, prints.where("rec_id in (1, 3)"), block).collect())
    assert said(1) == said(1 << 20) == [("1", [1]), ("1", [1]), ("2", []), ("3", [3]), ("None", [1]), ("None", [3])]


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline
    import plain

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    left = {r["doc_id"]: r["text"] for r in toxic.collect()}
    assert toxic.columns == docs.columns and all(source[k] == t for k, t in left.items())
    near = {k for k, (_, _, kept) in plain.near_copies(list(left.items()), size=5).items() if kept}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= near
    second = corpus_pipeline.STAGES[1][1](spark, toxic, sf_dir)
    assert {r["doc_id"] for r in second.collect()} == near
