import random
import re

import numpy as np

from factloom.llm import licenses, queries

from . import cases

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEXTS = [
    "Released under the MIT License. MIT  license, mit-license; permit license",
    "Apache License apache license general public general public license GENERAL PUBLIC LICENSE",
    licenses.TEMPLATES[0][1] + " é and then other words",
    "x " + licenses.TEMPLATES[3][1].replace("Unless", "Unless otherwise odd words") + " y",
    licenses.TEMPLATES[5][1][:90],
    "the the the of and",
]


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_query_has_the_base_places(spark, tmp_path):
    data = cases.rows() + [(1000 + i, t, "en", "s", None) for i, t in enumerate(TEXTS)]
    cases.docs(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op4_licenses(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, r)
    for doc_id, text, *_ in data:
        words, places, labels = words_of(text), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[1002].labels == "mit" and got[1002].score == 1 and got[1002].base_labels == ""
    assert got[1003].labels == "apache" and got[1003].score > 0.9
    assert got[1005].score == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    strings = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(6)]
    automaton = licenses.SuffixAutomaton(strings)
    inside = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(40):
        text, state, length = [rng.randrange(4) for _ in range(40)], 0, 0
        for i, c in enumerate(text):
            state, length = automaton.step(state, length, c)
            want = next((n for n in range(i + 1, 0, -1) if tuple(text[i + 1 - n : i + 1]) in inside), 0)
            assert length == want
            if length:
                match = text[i + 1 - length : i + 1]
                ends = {k: [e for e in range(length, len(s) + 1) if s[e - length : e] == match] for k, s in enumerate(strings)}
                assert automaton.ends[state] == {k: e for k, e in ends.items() if e}


def test_empty_table(spark):
    assert licenses.scan(cases.empty(spark)).collect() == []
    assert licenses.Scanner().scan(np.zeros(0, np.uint8), np.zeros(1, np.int64)) == []


def test_licenses_in_use_have_labels_of_their_own():
    wanted = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
        "Licensed under CC BY 4.0": {"cc-by"},
        "text CC-BY-NC-SA-3.0 text": {"cc-by-nc-sa"},
        "under the Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa"},
        "CC0 1.0 Universal": {"cc0"},
        "the GNU Lesser General Public License as published by": {"lgpl"},
        "the GNU Affero General Public License": {"agpl"},
        "the Mozilla Public License, v. 2.0.": {"mpl"},
        "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": {"isc"},
        "BSD 2-Clause License": {"bsd-2-clause"},
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form": {"unlicense"},
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY": {"mit"},
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY": set(),
        "the GNU General Public License": set(),
        "cc by hand": set(),
        licenses.TEMPLATES[6][1]: {"bsd"},
        licenses.TEMPLATES[4][1]: {"gpl"},
    }
    raw = [t.encode() for t in wanted]
    found = licenses.Scanner().scan(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [{s["label"] for s in x["spans"]} for x in found] == list(wanted.values())


def scanned(*texts):
    raw = [t.encode() for t in texts]
    return licenses.Scanner().scan(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))


def test_edited_texts_are_covered():
    mit, apache, bsd = licenses.TEMPLATES[0][1], licenses.TEMPLATES[3][1], licenses.TEMPLATES[5][1]
    phrase = "you may not use this file except in compliance"
    edited = [
        apache.replace(phrase, f"{phrase} {phrase}"),
        mit.replace("without restriction", "without restriction in the Software without restriction"),
        bsd.replace("with or without modification", "with or without any modification").replace("this list of conditions", "that list of terms", 1),
        f"before {apache} between {apache} after",
    ]
    for text, label in zip(edited, ["apache", "mit", "bsd", "apache"]):
        (found,) = scanned(text)
        assert found["score"] >= 0.9 and {s["label"] for s in found["spans"]} == {label}, text
    n = len(words_of(apache))
    assert [(s["start"], s["end"]) for s in sorted(scanned(edited[3])[0]["spans"], key=lambda s: s["start"])] == [(1, 1 + n), (2 + n, 2 + 2 * n)]


def test_chains_equal_brute_force():
    rng = random.Random(8)
    scanner = licenses.Scanner(gap=3)
    for _ in range(60):
        matches = sorted({(e := rng.randint(2, 30), rng.randint(2, 14), e - (n := rng.randint(1, 2)), n) for _ in range(rng.randint(1, 9))})

        def best(j):
            end, place, start, length = matches[j]
            gains = [best(i) + min(length, place - p, end - e) for i, (e, p, _, _) in enumerate(matches) if e < end and p < place and e >= start - 3]
            return max([length, *gains])

        chains = list(scanner._chains(matches))
        assert chains[0][0] == max(best(j) for j in range(len(matches)))
        covered = sorted((a, b) for _, a, b in chains)
        assert all(x[1] <= y[0] for x, y in zip(covered, covered[1:]))


def test_query_with_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    cases.docs(spark).withColumns({"score": F.lit("x"), "base": F.lit(1), "labels": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op4_licenses(spark, str(tmp_path)).count() == len(cases.rows())
