"""Cleaning of contexts and extraction of items: results worked out by hand, a case for each rule, and properties of drawn texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tributary.functions import items as I
from tributary.functions import text as T
from tributary.operators import subjects

#: A line of 86 characters, as wide as a page; many words, more than a line may have.
WIDE = "x" * 60 + " tato řádka je dlouhá a plná"
MANY = "slovo " * 35


def of_lines(found):
    return lambda t: found(T.lines(t))


STEPS = {
    "wrapped": I.wrapped_lines_joined,
    "wrapped at any width": lambda t: I.wrapped_lines_joined(t, 0),
    "long": I.long_lines_split,
    "structure": of_lines(I.items_by_structure),
    "character": of_lines(I.items_by_first_character),
    "two": of_lines(I.items_by_two_characters),
    "header": of_lines(I.items_under_header),
    "quoted": of_lines(I.quoted_names_of),
    "structured": of_lines(I.structured_names_of),
}

#: (step, what the case shows, text, result).
TABLE = [
    ("wrapped", "no line is wide", "krátké\nřádky", "krátké\nřádky"),
    ("wrapped", "full lines go on until a sentence ends", f"{WIDE}\n{WIDE}\nkonec věty.", f"{WIDE} {WIDE} konec věty. \n"),
    ("wrapped", "a blank line between full ones is no break", f"{WIDE}\n\n{WIDE}", f"{WIDE} {WIDE} "),
    ("wrapped", "the line before a full one in lower case goes on", f"{WIDE}\nNová věta na řádce.\n{WIDE}", f"{WIDE} Nová věta na řádce. {WIDE} "),
    ("wrapped", "an unended line behind a full one goes on", f"{WIDE}\n{WIDE[:40]}\n{WIDE}", f"{WIDE} {WIDE[:40]} {WIDE} "),
    ("wrapped", "blank lines behind a full line go", f"{WIDE}\n{WIDE}\n\n\n\ndál.", f"{WIDE} {WIDE} dál. \n"),
    ("wrapped at any width", "two short lines", "jedna dvě\ntři", "jedna dvě tři "),
    ("wrapped at any width", "three lines of one width", "dlouhá řádka bez konce\ndalší dlouhá řádka tu\nZde konec.", "dlouhá řádka bez konce další dlouhá řádka tu Zde konec. \n"),
    ("long", "short lines stay", "- krátká\n- druhá", "- krátká\n- druhá"),
    ("long", "before each hyphen, spaces and prices too", f"- úvod {MANY}- první bod - druhý bod - 5 Kč", f"- úvod {MANY}\n- první bod \n- druhý bod \n- 5 Kč"),
    ("long", "not within quotation marks", f'* úvod {MANY}* první "citát * uvnitř" * druhý', f"* úvod {MANY.rstrip()}\n * první \"citát * uvnitř\"\n * druhý"),
    ("long", "attributes move behind the lines", f"<ITEM>x<ITEM/>\n- {MANY}{MANY}", f"- {MANY}{MANY}\n<ITEM>x<ITEM/>"),
    ("long", "no bullet, no place to split at", f"bez odrážky {MANY}{MANY}", f"bez odrážky {MANY}{MANY}"),
    ("structure", "lines between blank lines, with what follows the heading's colon", "Položky:.\n\nčerpadlo\n\nhadice\n\nventil\n\n", ["", "čerpadlo", "hadice", "ventil"]),
    ("structure", "two are no enumeration", "\n\nčerpadlo\n\nhadice\n\n", []),
    ("structure", "tabs: lines without one go", "Seznam:.\n\nA\tčerpadlo\n\nB\thadice\n\nbez znaku\n\nC\tventil\n\n", ["A\tčerpadlo", "B\thadice", "C\tventil"]),
    ("structure", "a line in capitals above belongs to the heading", "Zboží:.\n\nNADPIS VELKÝ\n\nčerpadlo\n\nhadice\n\nventil\n\n", ["", "NADPIS VELKÝ", "čerpadlo", "hadice", "ventil"]),
    ("structure", "one long line among short ones is an item", "Zboží:.\n\nčerpadlo\n\n" + "d" * 120 + "\n\nventil\n\n", ["", "čerpadlo", "d" * 120, "ventil"]),
    ("structure", "a very long line ends an enumeration", "Zboží:.\n\nčerpadlo\n\n" + "e" * 160 + "\n\nventil\n\n", []),
    ("character", "lines of one bullet, with the rest of the heading", "Dodávka:. čerpadel\n- jedno\n- druhé;\n- třetí.\nkonec", ["čerpadel", "jedno", "druhé", "třetí"]),
    ("character", "two are no enumeration", "- jedno\n- druhé\njiné", []),
    ("character", "no delimiter above: items alone; another bullet ends them", "úvod je zde\n* a.\n* b,\n* c\n- d", ["a", "b", "c"]),
    ("character", "too long a line above is no heading", "x" * 120 + "\n* jedno\n* druhé\n* třetí", ["jedno", "druhé", "třetí"]),
    ("character", "letters are no bullets", "slova\nbez\nodrážek", []),
    ("two", "four lines or more; the longest run", "ks kolo\nks rám\nks sedlo\nks řetěz\njiné\nks pozdě", ["kolo", "rám", "sedlo", "řetěz"]),
    ("two", "three are too few", "ks kolo\nks rám\nks sedlo", []),
    ("two", "first letters of plain sentences", "Vy jeden\nVy druhý\nVy třetí\nVy čtvrtý", []),
    ("header", "until a line of fewer than five characters", "Předmět smlouvy je\nčerpadlo velké\nhadice malá.\nok\nzávěr", ["čerpadlo velké", "hadice malá"]),
    ("header", "more than twenty characters between", "Předmět této dlouhé smlouvy o dodávce zboží je\nčerpadlo velké", []),
    ("header", "a few characters may follow", "předmět díla je :\nstavba mostu\n\nkonec", ["stavba mostu"]),
    ("quoted", "short, but called a name", 'smlouva s názvem "Krátké"', ["Krátké"]),
    ("quoted", "long", 'a "Oprava mostu přes řeku Jizeru" podle plánu', ["Oprava mostu přes řeku Jizeru"]),
    ("quoted", "an attachment", 'příloha "Oprava mostu přes řeku Jizeru"', []),
    ("quoted", "short", 'slovo "Krátké"', []),
    ("quoted", "an abbreviation", 'dále jen "Oprava mostu přes řeku Jizeru"', []),
    ("structured", "behind the delimiter", "Název projektu:. Oprava mostu přes řeku Jizeru", ["Oprava mostu přes řeku Jizeru"]),
    ("structured", "on the next line", "Stavba:.\nModernizace školní jídelny a kuchyně", ["Modernizace školní jídelny a kuchyně"]),
    ("structured", "another word before", "Místo plnění:. Oprava mostu přes řeku Jizeru", []),
    ("structured", "words that no name has", "Předmět:. dále jen Oprava mostu přes řeku Jizeru", []),
    ("structured", "short and nothing behind it", "Projekt:. krátké", []),
]

#: (what the case shows, text, result of the whole chain).
CHAIN = [
    ("items behind a colon are tagged", "druh zboží: čerpadla a hadice do zahrady", "druh zboží:. čerpadla a hadice do zahrady \n\n\n<ITEM>čerpadla a hadice do zahrady<ITEM/>"),
    ("page marks, numbers and addresses go", "Předmět smlouvy je\nčerpadlo ponorné velké\nstrana 2\n12345\nTel: 123\nwww.firma.cz\nmail@firma.cz", "Předmět smlouvy je čerpadlo ponorné velké \n\n"),
    ("quotation marks become one kind, brackets and article numbers go, a name is tagged", "Dodávka s názvem „Oprava mostu přes řeku Jizeru“ (dále smlouva)\n 1.2 odstavec smlouvy", 'Dodávka s názvem "Oprava mostu přes řeku Jizeru".\nodstavec smlouvy\n\n\n<CONTRACT_NAME>Oprava mostu přes řeku Jizeru<CONTRACT_NAME/>'),
    ("a comma before a sentence is a full stop", "x, Anna šla domů. y, Být doma", "x. Anna šla domů. y, Být doma \n\n"),
]


def results(spark, texts, step):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", step(F.col("text")).alias("x"))
    return [x for _, x in sorted((r["k"], r["x"]) for r in rows.collect())]


@pytest.mark.parametrize("name", STEPS)
def test_cases_of_each_rule(spark, name):
    cases = [c for c in TABLE if c[0] == name]
    found = results(spark, [c[2] for c in cases], STEPS[name])
    assert [(c[1], x) for c, x in zip(cases, found, strict=True)] == [(c[1], c[3]) for c in cases]


def test_the_default_chain(spark):
    source = spark.createDataFrame([(k, c[1]) for k, c in enumerate(CHAIN)], "k long, text string")
    found = {r["k"]: r["text"] for r in subjects.preprocessed(source).collect()}
    assert [(c[0], found[k]) for k, c in enumerate(CHAIN)] == [(c[0], c[2]) for c in CHAIN]


@pytest.fixture(scope="module")
def drawn():
    draw = random.Random(11)
    parts = ["\n", "\n\n", "\n", " ", ", ", ". ", ": ", ":.", "- ", "* ", '"', "(", ")", "\t", "1", "23", "Název ", "Předmět je", "zboží", "čerpadlo", "Hadice tlaková", "ks ", "ks kolo", "názvem ", "příloha ", "x" * 90, "s délkou textu přes celou šířku řádku a ještě kousek navíc aby to stačilo", "VELKÝ NADPIS", "é"]
    words = ["čerpadlo", "Hadice tlaková", "kolo;", "rám.", "Předmět je", "zboží: ventily a kolena", "x" * 90, ""]
    lists = ["\n".join(draw.choice(["* ", "* ", "* ", "ks ", "ks ", "ks ", ""]) + draw.choice(words) for _ in range(draw.randrange(4, 30))) for _ in range(60)]
    return ["", "\n", *lists, *("".join(draw.choice(parts) for _ in range(draw.randrange(1, 80))) for _ in range(150))]


@pytest.mark.parametrize("name", ["wrapped", "wrapped at any width", "long"])
def test_lines_change_but_no_word_is_lost(spark, drawn, name):
    for text, out in zip(drawn, results(spark, drawn, STEPS[name]), strict=True):
        assert Counter(re.sub(r"\s", "", out)) == Counter(re.sub(r"\s", "", text)), text
        if name != "long":
            assert out.split() == text.split()
            assert "\n\n\n" not in out


def test_long_lines_break_nowhere_else(spark, drawn):
    for text, out in zip(drawn, results(spark, drawn, STEPS["long"]), strict=True):
        assert out.replace("\n", "") == text.replace("\n", "")
        short = [x for x in text.split("\n") if len(x) <= 200]
        assert not Counter(short) - Counter(out.split("\n"))


@pytest.mark.parametrize("name", ["structure", "character", "two", "header", "quoted", "structured"])
def test_every_item_is_part_of_a_line(spark, drawn, name):
    marks = " \t.,;"
    some = 0
    for text, out in zip(drawn, results(spark, drawn, STEPS[name]), strict=True):
        bare = [re.sub(r"\s", "", x) for x in text.split("\n")]
        for item in out:
            some += 1
            left = re.sub(r"\s", "", item.strip(marks))
            assert any(left in x or left in x.replace("ks", "").replace("*", "") for x in bare), item
    assert some


def test_items_of_contexts(spark):
    said = CHAIN[0][1]
    rows = spark.createDataFrame([(1, 0, said), (1, 9, "nic"), (2, 0, "")], "doc_id long, start int, context string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    found = {r["doc_id"]: r["items"] for r in subjects.extracted(docs, rows, "doc_id").collect()}
    assert found == {1: "čerpadla a hadice do zahrady", 2: "", 3: ""}
    both = {r["doc_id"]: r["items"] for r in subjects.extracted(docs, rows, "doc_id", lambda d: d.withColumn("text", F.lit("věta"))).collect()}
    assert both[1].endswith("věta") and both[2] == "věta" and both[3] == ""
