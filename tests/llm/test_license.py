import time
from re import _parser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.license_rules import TEXT, all_rules
from spanloom.llm.license_scan import UNNAMED, lowered, resolve, scan, scanner, uncontained
from tests.llm.helpers import clashing, docs, odd

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the "Software")'


def names(text):
    return [(d[2], text[d[0] : d[1]]) for d in scanner().scan(text)]


def test_rules():
    assert len(all_rules()) >= 200
    assert all(kw and all(k == k.lower() for k in kw) for _, _, kw, _ in all_rules())


def test_known_notices():
    assert names("/*\n * " + MIT)[0][0] == "MIT"
    assert names("SPDX-License-Identifier: Apache-2.0\ncode")[0][0] == "Apache-2.0"
    assert names("Licensed under the Apache License, Version 2.0")[0][0] == "Apache-2.0"
    assert names("see the MIT License.")[0] == ("MIT", "the MIT License")
    assert names("the GNU General Public License version 3 or later")[0][0] == "GPL-3.0-or-later"
    assert names("the cat admits defeat; a limit on bread") == []


def test_prefilter_loses_nothing(spark, data):
    """Every rule on every text against the rules whose keywords occur."""
    s = scanner()
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert s.scan(r.text) == resolve(s.matches(r.text))


def alternatives(tree):
    """Texts that a parsed pattern matches: each branch, spelling and optional part at least once."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = [chr(v if k == "LITERAL" else v[0]) if (k := str(kind)) in ("LITERAL", "RANGE") else "a" for kind, v in arg if str(kind) != "NEGATE"]
            some = ["x"] if str(arg[0][0]) == "NEGATE" else some
        elif name in ("ANY", "NOT_LITERAL"):
            some = ["x"]
        elif name == "BRANCH":
            some = [t for b in arg[1] for t in alternatives(b)]
        elif name == "SUBPATTERN":
            some = alternatives(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            some = [t * n for n in (arg[0], max(1, arg[0])) for t in alternatives(arg[2])]
        elif name == "ASSERT" and arg[0] < 0:
            some = alternatives(arg[1])  # what a lookbehind asks for stands before the rest
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT"), name
            continue
        out = [out[i % len(out)] + some[i % len(some)] for i in range(max(len(out), len(some)))]
    return list(dict.fromkeys(out))


def test_prefilter_keeps_every_alternative():
    s = scanner()
    for i, (name, _, _, pattern) in enumerate(all_rules()):
        texts = [t for t in alternatives(_parser.parse(pattern)) if s.rules[i][3].search(t)]
        assert texts, (name, pattern)
        for t in texts:
            assert i in s.wanted(lowered(t)), (name, t)


def test_prefilter_on_notices():
    s = scanner()
    for text in ("Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission", "released under Ms-PL", "BigScience Open RAIL-M", "under the \u017fimplified B\u017fD License", "G\u0130thub: M\u0130T L\u0130CENSE"):
        found = s.matches(text)
        assert found and s.scan(text) == uncontained(found), text


def test_resolution():
    got = resolve([(0, 10, "a", 50, 1), (2, 8, "b", 60, 2), (20, 30, "c", 50, 3), (20, 25, "d", 50, 4), (40, 45, "e", 10, 5), (45, 46, "f", 10, 6)])
    assert [d[2] for d in got] == ["b", "c", "e", "f"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.integers(1, 3)), max_size=12))
def test_resolution_by_definition(raw):
    found = [(a, a + n, "x", p, i) for i, (a, n, p) in enumerate(raw)]
    kept = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[4])):
        if all(d[1] <= k[0] or d[0] >= k[1] for k in kept):
            kept.append(d)
    assert resolve(found) == sorted(kept)


def test_partial_overlap_stays():
    """The NCSA grant shares words with the end of the MIT one."""
    ncsa = MIT + ', to deal with the Software without restriction, including without limitation the rights to use'
    assert [n for n, _ in names(ncsa)] == ["MIT", "NCSA"]
    assert [d[2] for d in uncontained([(0, 10, "a", 50, 1), (8, 20, "b", 50, 2), (2, 8, "c", 50, 3), (9, 19, "d", 60, 4), (0, 10, "e", 50, 5)])] == ["a", "b", "d"]
    assert [d[2] for d in uncontained([(0, 10, UNNAMED, 20, 1), (8, 12, "a", 50, 2), (20, 30, UNNAMED, 20, 3)])] == ["a", UNNAMED]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.integers(1, 3), st.sampled_from(["x", "y", UNNAMED])), max_size=12))
def test_containment_by_definition(raw):
    found = [(a, a + n, name, p, i) for i, (a, n, p, name) in enumerate(raw)]
    kept = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[4])):
        inside = any(k[0] <= d[0] and d[1] <= k[1] for k in kept)
        if not inside and (d[2] != UNNAMED or all(d[1] <= k[0] or d[0] >= k[1] for k in kept)):
            kept.append(d)
    assert uncontained(found) == sorted(kept)


APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
"""
BSD = """Neither the name of the University of
California, Inc. nor the names of its contributors may be used to endorse
or promote products derived from this software"""
MS_PL = """Microsoft Public License (Ms-PL)

This license governs use of the accompanying software. If you use the
software, you accept this license."""
BUSL = """Effective on the Change Date, or the fourth anniversary of the first publicly
available distribution of a specific version of the Licensed Work"""
MIT_0 = """to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is
furnished to do so."""


@pytest.mark.parametrize("lead", ["", " * ", "# ", "          // "])
@pytest.mark.parametrize(("name", "text"), [("Apache-2.0", APACHE), ("BSD-3-Clause", BSD), ("Ms-PL", MS_PL), ("BUSL-1.1", BUSL), ("MIT-0", MIT_0)])
def test_wrapped_texts(name, text, lead):
    got = scanner().scan("".join(lead + line + "\n" for line in text.split("\n")))
    assert (name, TEXT) in [(d[2], d[3]) for d in got]


def test_gaps_end():
    apart = BSD.replace(" nor the names", ".\nThis software is provided as is.\nnor the names")
    assert "BSD-3-Clause" not in [n for n, _ in names(apart)]
    head, terms = "Apache License, Version 2.0, January 2004. ", "Terms and conditions for use, reproduction, and distribution"
    assert [d[3] for d in scanner().scan(head + terms)] == [TEXT] and TEXT not in [d[3] for d in scanner().scan(head + "1. Definitions. " + terms)]
    assert TEXT not in [d[3] for d in scanner().scan("Microsoft Public License.\nMicrosoft Reciprocal License (Ms-RL)\nThis license governs use of the accompanying software")]


def test_gaps_are_linear():
    start = time.time()
    for text in (BSD[:21], APACHE[:86], "microsoft public license this license governs use of the accompanying software ", "licensed work will be made available change date "):
        scanner().scan(text.replace("change", "chang") + "x " * 200_000)
        scanner().scan((text.replace("change", "chang") + " x\n") * 5_000)
    assert time.time() - start < 60


def test_table(spark):
    df = clashing(odd(spark).unionByName(docs(spark, [(50, "é\U0001f600 " + MIT), (None, "MIT License"), (51, "MIT License"), (51, "MIT License")])))
    got = scan(df).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "MIT"), (50, "MIT"), (51, "MIT"), (51, "MIT")]
    one = next(r for r in got if r.doc_id == 50)
    assert one.start == 3 and ("é\U0001f600 " + MIT)[one.start : one.end] == one.matched
    assert scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath OR MIT", ["GPL-2.0-only", "MIT"]),
        ("Dual licensed under MIT and GPL-2.0", ["MIT", "GPL-2.0-only"]),
        ("licensed under MIT/Apache-2.0", ["MIT", "Apache-2.0"]),
        ("Released under the ISC, Zlib or BSL-1.0", ["ISC", "Zlib", "BSL-1.0"]),
        ("licensed under mitigation plans, or curling", []),
    ],
)
def test_expressions_and_lists(text, want):
    """Every licence of an SPDX expression or of a list is found, each at its own place."""
    got = scanner().scan(text)
    assert [d[2] for d in got if d[2] != UNNAMED] == want
    assert scanner().matches(text) and {d[:3] for d in got} == {d[:3] for d in uncontained(scanner().matches(text))} if want else True
