import random
import time

import pytest

from tidemark.llm import truncation
from tidemark.llm.truncation import examine, judged_documents, kind_of_text, truncation_by_source

PY = '''import os
from x import y


def first(alpha, beta):
    """does a thing"""
    total = {"k": 1, "n": [1, 2]}
    for i in range(3):
        work(i, alpha)
    return alpha


def second(gamma, delta):
    # a comment
    if gamma > 3:
        delta = other(gamma, "text (with")
    return gamma
'''
JS = '''import a from './a';

// a comment with an apostrophe's quote
export function one(alpha, beta) {
  logger.note(`x ${alpha}`, beta);
  if (alpha > 3) {
    beta = [alpha, 'it\\'s', "}"];
  }
  return alpha;
}

export function two(gamma) {
  /* block { */
  return gamma.map((x) => f(x, 1));
}
'''
JAVA = '''class G {
    int one(int a) {
        log.note("x", a);
        return a;
    }

    int two(int b) {
        return b;
    }

}
'''
JSON = '{\n  "a": {\n    "n": 1,\n    "note": "b c"\n  }\n}\n'
YAML = 'first:\n  n: 1\n  note: "a b"\nsecond:\n  n: 2\n  note: "c d"\n'
PROSE = "# Head line\n\nSome words stand here and end. Others follow them.\n\nA last paragraph closes the text.\n"
MIN = "import{a}from './a';function f(x){// note no end for(let i=0;i<3;i++){g(x[i]);}return x;}\n"
FOREIGN = "static int part(int a) {\n    if (a > 3) {\n        b = a;\n"
ALL = {"python": PY, "brace": JS, "java": JAVA, "json": JSON, "yaml": YAML, "prose": PROSE, "min": MIN}


@pytest.mark.parametrize("name", sorted(ALL))
def test_whole_texts_are_whole(name):
    t = ALL[name]
    for x in (t, t.rstrip("\n"), t.replace("\n", "\r\n"), t + "\n\n"):
        kind, cut, usual, _, _ = examine(x)
        assert (cut, usual) == ("", True), (name, kind, cut, x[-40:])


@pytest.mark.parametrize("note", ["# TODO: rest", "# to be continued...", "# see the other half in"])
def test_notes_at_the_end_prove_nothing(note):
    for name in ("python", "yaml"):
        assert examine(ALL[name] + note + "\n")[1:3] == ("", True)
    for name in ("brace", "java"):
        assert examine(ALL[name] + note.replace("#", "//") + "\n")[1:3] == ("", True)


def test_passages_of_other_files_within_a_text_do_not_count():
    assert examine(PY.replace("\n\n\ndef second", "\n\n" + FOREIGN + "\ndef second"))[1:3] == ("", True)
    assert examine(PROSE.replace("\n\nA last", "\n\n" + FOREIGN + "\nA last"))[1:3] == ("", True)
    assert examine(YAML + "\n" + FOREIGN + "\nthird:\n  n: 3\n  note: \"e f\"\n")[1:3] == ("", True)


@pytest.mark.parametrize("name", sorted(ALL))
def test_cuts_in_the_middle(name):
    """Of all places where a text can be cut, few leave a text that looks whole."""
    t = ALL[name].rstrip("\n")
    # Before the first construct is under way there is nothing that could be open.
    places = range(len(t) // 4, len(t) - 1)
    missed = [n for n in places if (e := examine(t[:n]))[1] == "" and e[2]]
    assert len(missed) <= 0.12 * len(places), [t[:n][-25:] for n in missed]


def test_marks_of_cutting_and_broken_characters():
    for mark in ("\n[... cut]", "[truncated]", "..."):
        assert examine(PY[:300] + mark)[1] != "" or examine(PY[:300] + mark)[2] is False
    assert examine(JS[:120] + "�")[1] == "broken character"
    assert examine('{"a": "x\\u00')[1] in ("open {", "broken escape", "open quote")


def test_odd_texts():
    assert examine("")[0] == "empty" and examine(" \n\t")[1] == "" and kind_of_text("word") == "prose"
    assert examine("}" * 5000 + ";")[1] == "" and examine("(" * 200000)[1] == "open (" or examine("(" * 200000)[0] == "prose"
    assert examine("x" * 1_000_000)[1] == ""


@pytest.mark.parametrize("text", [
    "def f(a):\n    x = '" + "A" * 3_000_000 + "'\n    return a\n", "x" * 3_000_000 + "!", "\n" * 300_000 + "word.\n", " " * 1_000_000 + "]", "a /* b\n" * 100_000, "f({\n" * 100_000, "... " * 300_000,
    "return 1;" + " " * 1_000_000 + "}\n}\n", "\"'`" * 200_000, "- a: b\n" * 200_000, "é" * 1_000_000, "\r\n" * 200_000 + "}",
])
def test_very_long_texts_take_seconds(text):
    began = time.monotonic()
    examine(text)
    assert time.monotonic() - began < 20


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", False) for r in rows], "doc_id long, text string, source string, kind string, truncated boolean")


def test_baselines_over_all_documents(spark):
    rng = random.Random(3)
    rows = [(i, PY + f"\n\ndef f{i}(a):\n" + "    x = a\n" * rng.randrange(1, 60) + "    return a\n", rng.choice(["big", "Big "])) for i in range(120)]
    # A field of 400 characters: one text happens to be cut after a whole function.
    whole = (PY + "\n\ndef g(long_name):\n    return long_name\n")
    pad = lambda t, n: t.replace("a comment", "a comment" + "x" * (n - len(t)))
    rows += [(1000 + i, (PY + f"\n\ndef h{i}(a):\n" + f"    call(a, {i})\n" * 60)[:620], "field") for i in range(12)]
    rows += [(1100, pad(whole.rstrip("\n"), 620), "field"), (1101, pad(whole, 620), "field")]
    rows += [(1200 + i, PY, "field") for i in range(30)]
    rows += [(2000, None, "big"), (2001, "", "big"), (2002, PROSE[:-20], None)]
    judged = {r["doc_id"]: r for r in judged_documents(docs(spark, rows)).collect()}
    assert 2000 not in judged and not judged[2001]["truncated"]
    assert judged[2002]["truncated"] and judged[2002]["source"] == ""
    assert all(judged[1000 + i]["truncated"] for i in range(12))
    assert judged[1100]["reason"] == "full field" and not judged[1101]["truncated"]
    assert not any(judged[i]["truncated"] for i in range(120))
    by = {r["source"]: r for r in truncation_by_source(judged_documents(docs(spark, rows))).collect()}
    assert by["field"]["n_truncated"] == 13 and by["big"]["n_documents"] == 121


@pytest.mark.parametrize("n", [1, 19, 20, 60])
@pytest.mark.parametrize("others", [0, 40])
def test_a_source_that_cuts_much_is_found_at_any_size(spark, n, others):
    text = lambda i: PROSE.replace("Head", f"Head{i}")
    n_cut = (n + 1) // 2
    rows = [(i, text(i)[:-12] if i < n_cut else text(i), "cutter") for i in range(n)]
    rows += [(1000 + i, text(i), "clean") for i in range(others)]
    judged = {r["doc_id"] for r in judged_documents(docs(spark, rows)).where("truncated").collect()}
    assert judged == set(range(n_cut))


@pytest.mark.parametrize("others", [0, 40])
def test_a_kind_that_really_ends_otherwise_is_not_cut(spark, others):
    text = lambda i: f"# Head{i}\n\nSome words stand here and end.\n\n- a last point\n"
    rows = [(i, text(i), "here") for i in range(40)] + [(1000 + i, text(i), "there") for i in range(others)]
    assert judged_documents(docs(spark, rows)).where("truncated").count() == 0


@pytest.mark.parametrize("longer", [PY + "\n\ndef g(a):\n    return a\n" * 40, PY[:300] + "x" * 400 + "\n[... cut]"])
def test_one_longer_text_does_not_hide_a_field_limit(spark, longer):
    whole = lambda i: f"# {i:04d}\n" + PY.replace("a comment", "a comment" + "x" * 100).rstrip("\n")
    rows = [(i, whole(i), "field") for i in range(12)] + [(100, longer, "field")]
    judged = {r["doc_id"]: r["reason"] for r in judged_documents(docs(spark, rows)).collect()}
    assert all(judged[i] == "full field" for i in range(12))


def test_empty_table(spark):
    assert judged_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text,cut", [
    ("<?xml version='1.0'?>\n<a x=\"1>2\"><b/>t</a>\n", ""), ("<?xml version='1.0'?>\n<a><b>t</b>\n", "open markup"), ("<?xml version='1.0'?><a><b x='1", "open markup"), ("<svg><g/><!-- end", "open comment"),
    ("<!DOCTYPE html><html><body><p>x<br><ul><li>y</ul></body></html>\n", ""), ("<html><body><div><p>x", "open markup"), ("<html><script>if (a < b) {", "open markup"), ("<html><script>if (a < b) { c('<i>') }</script></html>", ""),
    ("# T\n\nText.\n\n<details>\n<summary>s</summary>\n\nMore text.\n", "open markup"), ("# T\n\nWrite `<details>` first.\n\n```\n<table>\n```\nDone.\n", ""), ("# T\n\n```\ncode\n", "open markup"),
])
def test_markup_is_closed_or_open(text, cut):
    assert truncation.examine(text)[1] == cut


def test_stored_bytes(spark):
    rows = [(1, "Whole é.\n".encode()), (2, "Cut é".encode()[:-1]), (3, b"Latin \xe9.\n"), (4, None), (5, b"")]
    got = {r["doc_id"]: r["cut"] for r in truncation.signs_of_truncation(spark.createDataFrame([(i, bytearray(t) if t is not None else None, "s") for i, t in rows], "doc_id long, text binary, source string")).collect()}
    assert got == {1: "", 2: "broken character", 3: "", 5: ""}


def test_very_long_markup_is_read_in_linear_time():

    began = time.perf_counter()
    assert truncation.examine("<html>" + "<div>" * 200_000)[1] == "open markup"
    assert truncation.examine("<html>" + "<div>x</div>" * 100_000 + "</html>")[1] == ""
    assert time.perf_counter() - began < 20
