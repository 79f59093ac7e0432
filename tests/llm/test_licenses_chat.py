"""Operators 7 and 8 against plain Python, and odd rows."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import op07_licenses as op7
from tallyspark.llm import op08_chat as op8
from tallyspark.llm.common import table

PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    places = sorted((i, lab) for p, lab in PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


CASES = [None, "", "MIT License", "mit-license MIT  LICENSE mit license license", "xmit license", "cc_by CC BY-NC 4.0", "cc by cc by cc",
         "The GNU General\nPublic License, the gnu general public licenses", "é apache license é", "Apache\x00License", "[`~cc~`]by{", "日本 mit license"]


def test_license_cases(make_docs):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(2, CASES[2]), (None, "cc by"), (50, "mit license " * 20_000)]
    got = op7.licenses(make_docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "cc by" if r["doc_id"] is None else "mit license " * 20_000 if r["doc_id"] == 50 else CASES[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert op7.licenses(make_docs([])).count() == 0


def test_license_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    text = dict(docs.select("doc_id", "text").collect())
    for r in op7.licenses(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text[r["doc_id"]])
        assert (r["score"] == 1.0) == ("licensed under" in text[r["doc_id"]].lower() or "released under" in text[r["doc_id"]].lower())


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", {"mit-notice"}), ("This work is licensed under the terms of the MIT license", {"mit-notice"}),
    ("licensed under the Apache License, Version 2.0 (the License)", {"apache-2.0-notice"}), ("licensed under the Apache License, Version 3", set()),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-notice"}), ("licensed under an MIT license", set()),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"gpl-notice"}),
    ("This program is free software: you can redistribute it and/or change it under the terms of the GNU General Public License", set()),
])
def test_templates(text, labels):
    auto = op7.Automaton()
    w, n = op7.spaced(("x y " + text + " z").encode())
    got = auto.matches(w)
    assert {x for x, _, _ in got} == labels
    assert all(0 <= a < b <= n for _, a, b in got)


def test_automaton_against_regex():
    """Random templates over three words, against a regular expression of the same language."""
    rnd = random.Random(4)
    for _ in range(150):
        bits, pat = [], ""
        for k in range(rnd.randint(1, 5)):
            kind, w = rnd.choice("wwoa") if k else "w", rnd.choice("abc")
            if kind == "w":
                bits.append(w)
                pat += f" {w}"
            elif kind == "o":
                bits.append(f"[[{w} {w}]]")
                pat += f"(?: {w} {w})?"
            else:
                bits.append("<<1-2>>")
                pat += "(?: \\w){1,2}"
        auto = op7.Automaton([("t", " ".join(bits))])
        text = " ".join(rnd.choices("abcd", k=25))
        got = {(a, b) for _, a, b in auto.matches(op7.spaced(text.encode())[0])}
        ends = {}
        for a in range(25):
            for b in range(a + 1, 26):
                if re.fullmatch(pat, "".join(" " + x for x in text.split()[a:b])):
                    ends[a] = b
        assert got == set(ends.items())


BITS = ["\\", "### ", "###", "#", ": ", ":", "</turn>", "<", "/turn>", "\n", "user", "é", " ", "x", "\\\\", "</turn>\n### user: "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(BITS), max_size=4).map("".join), st.lists(st.sampled_from(BITS), max_size=10).map("".join)), max_size=4))
def test_any_text_survives(turns):
    t = op8.Template()
    whole = "".join(p for role, text in turns for p, _ in t.segments(role, text))
    at, back = 0, []
    while m := t.turn.match(whole, at):
        back.append(tuple(map(t.unescape, m.groups())))
        at = m.end()
    assert at == len(whole) and back == turns


def expected(turns):
    own = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(own.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op8.chat_digests(df).collect()}


def test_chat_table(spark):
    conv = table(spark, "/root/testdata/sf0.01", "conversations")
    want = {}
    for r in sorted(conv.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    assert digests(conv) == {k: expected(v) for k, v in want.items()}


def test_chat_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string, word string, loss int"
    rows = [(1, 0, "user", None), (1, 1, "assistant", "</turn>\n### user: x"), (1, 1, "assistant", "</turn>\n### user: x"), (None, 0, None, "a"),
            (None, 3, "assistant", ""), (2, 5, "odd: role\\", "y"), (3, 0, "assistant", "z " * 200_000), (4, None, "user", "first"), (4, 0, "assistant", "b")]
    rows += [(9, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(5000)]
    got = digests(spark.createDataFrame([(*r, "w", 1) for r in rows], schema))
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r[2:])
    want[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    assert got == {k: expected(v) for k, v in want.items()}
    empty = op8.chat_digests(spark.createDataFrame([], schema)).collect()
    assert [r["conv_id"] for r in empty] == [-7]


def test_turn_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "u")]
    got = op8.read_back(op8.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r["conv_id"]: r["order_ok"] for r in got} == {1: True, 2: False, 3: False}


def test_places_of_many_licences_in_one_text():
    """Places are counted on from the hit before, so twice the hits take about twice the time, not four times."""
    import time
    seconds = []
    for n in (100_000, 400_000):
        words, count = op7.spaced(b"mit license " * n)
        t0 = time.perf_counter()
        places = op7.base_places(words)
        seconds.append(time.perf_counter() - t0)
        assert count == 2 * n and places == [(2 * k, "mit") for k in range(n)]
    assert seconds[1] < 10 * seconds[0] + 0.5
