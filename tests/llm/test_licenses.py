import re

import pytest
from rows import AWKWARD, FOLDER, frame, table_docs

from voxlake.llm import licenses
from voxlake.llm.catalog import op9_license_templates

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def test_query_is_brute_force(spark):
    got = {r.doc_id: r for r in op9_license_templates(spark, FOLDER).collect()}
    for d, t in table_docs():
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert len(got) == len(table_docs()) and any(r.n_base for r in got.values())


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", {"mit"}), ("under the terms of the MIT license", {"mit"}), ("under the terms of MIT license", set()),
    ("Copyright (c) 2020 Some One. All rights reserved.", {"copyright"}), ("copyright a b c d e f g all rights reserved", set()),
    ("SPDX-License-Identifier: MIT", {"spdx"}), ("GNU General Public License, version 3", {"gpl-version"}), ("Licensed under CC BY-NC 4.0", {"cc-by-nc"}),
])
def test_templates(text, labels):
    assert {a for a, _, _ in licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES).scan(text)[2]} == labels


def test_markup():
    auto = licenses.compile_template("a <<optional>>b <<var 2>><</optional>> c")
    ends = lambda s: auto.longest([w.encode() for w in s.split()], 0)
    assert [ends(s) for s in ("a c", "a b c", "a b x c", "a b x y c", "a b x y z c", "a x c", "a b c c c")] == [2, 3, 4, 5, -1, -1, 5]
    for bad in ("a <<optional>> b", "a <</optional>> b"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)


def test_awkward_rows(spark):
    more = [(20, "All rights reserved. " * 500, "s"), (21, "CC-BY cc by K CCéby", "s")]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, AWKWARD + more)).collect()}
    for d, t, _ in AWKWARD + more:
        n, places, first, last, _ = brute(t)
        assert got[d].n_words == n and len(got[d].places) == places
    assert licenses.scan_licenses(frame(spark).limit(0)).count() == 0
