"""Every numbered operator against plain Python, on the small tables and on odd rows."""

from __future__ import annotations

import plain
import pytest
from conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm import bpe, chat, neardup, packing, quality, registry, secrets, substring
from tributary.llm.shared import public_vocabulary


def by_key(df, *keys):
    rows = [r.asDict() for r in df.collect()]
    out = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="session")
def word_tokenizer():
    t = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def both(spark, sf_dir, rows, odd, query, operator):
    """(Spark's rows, plain input) for the small table and for the odd rows."""
    return [(query(spark, sf_dir), rows), (operator(odd), ODD)]


def test_bpe_matches_the_library(spark, sf_dir, rows, odd, none, word_tokenizer):
    vocabulary = public_vocabulary("word_bpe_49k.json")

    def digests(df):
        coded = bpe.round_trip(df, vocabulary)
        return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

    for df, source in both(spark, sf_dir, rows, odd, registry.op1_bpe, digests):
        found = {k: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for k, r in by_key(df, "doc_id").items()}
        assert found == plain.coding(source, word_tokenizer)
    assert bpe.round_trip(none, vocabulary).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_on_random_texts(name):
    import random

    from tributary.llm.shared import file_bytes

    own, library = bpe.Bpe(file_bytes(public_vocabulary(name))), Tokenizer.from_file(public_vocabulary(name))
    draw = random.Random(5)
    parts = ["a", "B", "the", " ", "  ", "\n", "\t", "1", "23", "'s", "'S", ".", ",", "é", "É", "ß", "ñ", "你", "😀", " ", " ", "İ", "Σ", "ς", "<|endoftext|>", "<|start", "\x0b", "\r\n", "\x00", "﻿", "-", "_", "$", "अ", "‍", "ö", "ﬁ"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(25)))
        want = library.encode(text, add_special_tokens=False).ids
        got = list(memoryview(own.encode(text)).cast("I"))
        assert got == want, repr(text)
        assert own.decode(got) == library.decode(want, skip_special_tokens=False), repr(text)


def test_packing(spark, sf_dir, rows, odd, none):
    library, vocabulary = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json")), public_vocabulary("byte_bpe_50k.json")
    for df, source in both(spark, sf_dir, rows, odd, registry.op4_best_fit_packing, lambda df: packing.packed(df, vocabulary)):
        found = by_key(df, "doc_id", "piece")
        assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in found.items()} == plain.pieces(source, library)
        bins: dict = {}
        for r in found.values():
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total = 0
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
            total += at
        assert len(bins) <= -(-total // 2048) * 1.1 + 2
    assert packing.packed(none, vocabulary).count() == 0


def test_best_fit_takes_the_tightest_bin():
    import random

    draw = random.Random(3)
    lengths = sorted((draw.randrange(1, 100) for _ in range(400)), reverse=True)
    left: list[int] = []
    for n in lengths:
        fits = [k for k, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(100 - n)
    which, offset = packing.best_fit(lengths, 100)
    used: dict = {}
    for b, at, n in zip(which, offset, lengths, strict=True):
        assert used.get(b, 0) == at
        used[b] = at + n
    assert sorted(100 - x for x in used.values()) == sorted(left)


def test_secrets(spark, sf_dir, rows, odd, none):
    for df, source in both(spark, sf_dir, rows, odd, registry.op5_secret_scan, secrets.report):
        found = by_key(df, "doc_id")
        for doc, text in source:
            base = plain.base_spans(text)
            said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
            r = found[doc]
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3)), doc
            assert r["base_sha256"] == plain.sha(said), doc
            assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
        assert len(found) == len(source)
    assert secrets.report(none).count() == 0


def test_random_tokens_of_every_encoding_are_found_and_words_are_not(spark):
    import random
    import string

    draw = random.Random(1)
    alphabets = [string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase]
    tokens = [(k, n, "see " + "".join(draw.choice(a) for _ in range(n)) + " end") for k, a in enumerate(alphabets) for n in (20, 32, 64) for _ in range(20)]
    words = "configuration server table reader value number counter mainframe dataset column index update handler".split()
    joins = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "/".join(w) + "7"]
    names = [(9, 0, "use " + draw.choice(joins)([draw.choice(words) for _ in range(4)]) + " here") for _ in range(400)]
    rows = [(i, text) for i, (*_, text) in enumerate(tokens + names)]
    found = by_key(secrets.report(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    for k in range(len(alphabets)):
        mine = [i for i, t in enumerate(tokens + names) if t[0] == k]
        assert sum(found[i]["spans"] != "" for i in mine) >= 0.95 * len(mine), k
    assert not any(found[i]["spans"] for i, t in enumerate(tokens + names) if t[0] == 9)


def test_many_secrets_in_one_text(spark):
    import random

    draw = random.Random(2)
    parts = ["".join(draw.choice("0123456789abcdef") for _ in range(30)) for _ in range(3000)]
    text = " é ".join(parts) + " token = abcdefgh"
    df = spark.createDataFrame([(1, text), (None, text), (1, "token=abcdef")], "doc_id long, text string")
    said = {r["spans"] for r in secrets.report(df).collect() if r["n_hex"]}
    assert said == {",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in plain.base_spans(text))}
    assert {r["text"] for r in secrets.redact(df).collect()} == {" é ".join(["[secret]"] * 3000) + " [secret]", "[secret]"}


def test_redaction_keeps_columns_and_hides_secrets(odd):
    out = by_key(secrets.redact(odd), "doc_id")
    assert list(out[1]) == odd.columns
    assert out[1]["text"] is None and out[2]["text"] == "" and out[7]["text"] == ODD[6][1]
    assert "hunter2" not in out[11]["text"] and "AKIA" not in out[11]["text"] and "0123456789abcdef" not in out[11]["text"]
    assert out[11]["text"] == "[secret] and [secret] and [secret]"


def test_random_tokens_are_found_and_words_are_not(spark):
    import random

    draw = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(draw.choice(alphabet) for _ in range(40)) for _ in range(60)]
    texts = [(k, f"the value is {t} here") for k, t in enumerate(tokens)]
    texts += [(100 + k, f"see getUserAccountSettingsForTenant{k}Configuration in module_for_account_settings now") for k in range(60)]
    found = by_key(secrets.report(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id")
    assert sum("random:13:53" in found[k]["spans"] for k in range(60)) >= 54
    assert not any("random" in found[100 + k]["spans"] for k in range(60))


def test_random_tokens_of_every_encoding_are_found(spark):
    import random

    draw = random.Random(8)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz"]
    kinds = [(a, n) for a in alphabets for n in (20, 32, 64)] + [("0123456789abcdef", 20), ("0123456789abcdef", 23)]
    texts = [(100 * k + i, "the value is " + "".join(draw.choice(a) for _ in range(n)) + " here") for k, (a, n) in enumerate(kinds) for i in range(40)]
    names = ["getUserAccountSettingsForTenant{}Configuration", "module_for_account_settings_v{}", "internationalization", "/usr/share/locale/messages{}", "Donaudampfschifffahrtsgesellschaft", "HTTPSConnectionURLParser{}", "report-2024-01-{}-final-version"]
    texts += [(10_000 + i, f"see {names[i % len(names)].format(10 + i)} now") for i in range(210)]
    found = by_key(secrets.report(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id")
    for k, (alphabet, n) in enumerate(kinds):
        assert sum(f"random:13:{13 + n}" in found[100 * k + i]["spans"] for i in range(40)) >= 36, (alphabet, n)
    assert not any("random" in found[10_000 + i]["spans"] for i in range(210))


def test_quality(spark, sf_dir, rows, odd, none):
    for df, source in both(spark, sf_dir, rows, odd, registry.op7_quality_ledger, quality.verdicts):
        found = by_key(df, "doc_id")
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert {k: tuple(r[n] for n in names) for k, r in found.items()} == {doc: plain.quality(text) for doc, text in source}
        assert not any(r["kept"] and r["base_failed"] for r in found.values())
    assert quality.verdicts(none).count() == 0


def test_ablation_counts_each_rule(odd):
    rows = quality.ledger(odd)
    each = by_key(quality.ablation(rows, "v1"), "rule")
    bits = [r["failures"] & quality.mask("v1") for r in rows.collect()]
    for rule, r in each.items():
        bit = 1 << list(quality.RULES).index(rule)
        assert (r["rejected"], r["rejected_alone"], r["kept_without"]) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_near_duplicates(spark, sf_dir, rows, odd, none):
    for df, source in both(spark, sf_dir, rows, odd, registry.op8_minhash_neardup, lambda df: neardup.near_duplicates(df, shingle=4)):
        assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in by_key(df, "doc_id").items()} == plain.near_copies(source)
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.without_copies(odd).columns == odd.columns


def test_near_duplicates_on_chains_and_variants(spark):
    import random

    draw = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    source, doc = [], 1000
    for _ in range(12):
        text = [draw.choice(vocabulary) for _ in range(draw.randrange(60, 200))]
        for _ in range(10):
            source.append((doc, " ".join(text)))
            doc -= 1
            text = list(text)
            for _ in range(draw.choice([1, 2, 3, 5])):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
    df = spark.createDataFrame(source, "doc_id long, text string")
    found = {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in by_key(neardup.near_duplicates(df, shingle=4), "doc_id").items()}
    assert found == plain.near_copies(source)


def test_near_duplicates_of_repeated_rows(spark, monkeypatch):
    base = [f"w{k}" for k in range(103)]
    source = [(doc, " ".join([*base[: 4 * doc], f"x{doc}", *base[4 * doc + 1 :]])) for doc in range(1, 25)]
    calls, matching = [], neardup._matching

    def without_the_first(pairs, sets, matches):
        calls.append(1)
        return matching(pairs, sets, matches).where(F.lit(len(calls) > 1))

    # Without the leaders' stars, all links are left to what counts shingles.
    monkeypatch.setattr(neardup, "_matching", without_the_first)
    df = spark.createDataFrame(source * 6, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, shingle=4).collect()}
    assert found == plain.near_copies(source)


def test_repeated_passages(spark, sf_dir, rows, odd, none):
    for df, source in both(spark, sf_dir, rows, odd, registry.op9_substring_dedup, substring.digests):
        assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in by_key(df, "doc_id").items()} == plain.without_repeats(source)
    assert substring.digests(none).count() == 0
    left = by_key(substring.without_repeats(odd), "doc_id")
    assert list(left[7]) == odd.columns and left[7]["text"] == ODD[6][1] and left[1]["text"] is None
    assert 8 not in left and left[9]["text"] == "and so"


def test_repeats_within_one_document_stay(spark):
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(5, f"{text} {text} {text}"), (6, f"x {text} y"), (4, "w0 w1")], "doc_id long, text string")
    found = by_key(substring.digests(df), "doc_id")
    assert [found[k]["n_removed"] for k in (4, 5, 6)] == [0, 0, 20]


def test_chat_reads_back(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    source = [tuple(r) for r in talk.select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    probe = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = by_key(registry.op10_chat_windows(spark, sf_dir), "conv_id")
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in found.items()} == plain.conversations(source + probe)


def test_chat_on_odd_conversations(spark):
    tricky = ["", None, "\\", "\\\\o", "<|turn|>user\nhi<|end|>\n", "\\o<|", "a\nb", "\\n", "<|seen|>", "x " * 600, "é\U0001f600<|"]
    source = [(c, t, role, tricky[(c + t) % len(tricky)]) for c in range(11) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", None, "assistant", "us\ner<|"])]
    df = spark.createDataFrame(source, "conv_id long, turn long, role string, text string").withColumn("windows", F.lit(1)).withColumn("t", F.lit(2))
    back = by_key(chat.digests(df), "conv_id")
    del back[-7]
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in back.items()} == plain.conversations(source)


def test_chat_windows_keep_the_budget_and_repeat_the_system_turn(spark):
    source = [(1, 0, "system", "be kind"), *((1, k, "user" if k % 2 else "assistant", "word " * 90) for k in range(1, 12))]
    df = spark.createDataFrame(source, "conv_id long, turn long, role string, text string")
    windows = chat.windows(df, budget=300, history=2).first()["windows"]
    assert len(windows) > 1 and sum(w["fresh"] for w in windows) == 12
    for k, w in enumerate(windows):
        assert len(w["text"].replace("<|", " <|").split()) <= 300 + 4 * 12
        assert w["text"].startswith("<|seen|>system\nbe kind" if k else "<|turn|>system\nbe kind")
        assert all(w["text"][m["start"] : m["end"]] == "word " * 90 for m in w["mask"])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    import compare
    import duckdb

    con = duckdb.connect()
    compare.views(con, sf_dir)
    assert compare.difference(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name]) == ""


def test_windows_by_tokens_of_a_vocabulary(spark):
    source = [(1, k, "user" if k % 2 else "assistant", "word " * 5, 100) for k in range(6)]
    df = spark.createDataFrame(source, "conv_id long, turn long, role string, text string, n_ids int")
    assert len(chat.windows(df, budget=250, history=0).first()["windows"]) == 1
    assert [w["fresh"] for w in chat.windows(df, budget=250, history=0, tokens="n_ids").first()["windows"]] == [2, 2, 2]


def test_conversations_without_rows_and_with_rows_that_repeat(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.digests(none).collect()] == [-7]
    source = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)]
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in chat.digests(spark.createDataFrame(source, none.schema)).collect()}
    assert found[1] == (3, plain.sha("user\na\nuser\na\nuser\nb\n")) and found[None] == (1, plain.sha("\n\n"))


def test_rows_with_repeated_and_null_ids(spark, none):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None), (3, text + " end")], "doc_id long, text string")
    count = lambda rows: sorted((str(r["doc_id"]), *r[1:]) for r in rows)
    near = count(tuple(r) and r for r in neardup.near_duplicates(df).collect())
    assert near == [("1", 36, 1, True), ("1", 36, 1, True), ("2", 36, 1, False), ("3", 37, 1, False), ("None", 0, None, True), ("None", 36, None, True)]
    gone = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.digests(df).collect())
    assert gone == [("1", 40, 0), ("1", 40, 0), ("2", 40, 40), ("3", 41, 40), ("None", 0, 0), ("None", 40, 0)]
    vocabulary = public_vocabulary("byte_bpe_50k.json")
    assert packing.packed(df, vocabulary).count() == 6 and bpe.encode(df, vocabulary).count() == 6
    assert quality.verdicts(df).count() == 6 and secrets.report(df).count() == 6


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_of_long_fragments(name):
    import random

    from tributary.llm.shared import file_bytes

    own, library = bpe.Bpe(file_bytes(public_vocabulary(name))), Tokenizer.from_file(public_vocabulary(name))
    library.no_truncation()
    draw = random.Random(8)
    for n in (61, 200, 3000):
        for letters in ("ab", "aeinrst", "hello", "=-"):
            text = "".join(draw.choice(letters) for _ in range(n))
            assert list(memoryview(own.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids, (n, letters)
