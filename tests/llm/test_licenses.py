import dataclasses
import random
import re

from cohortry.llm.licenses import BASE, Rule, detections, scan_licenses, signature_rules
from cohortry.llm.registry import QUERIES

PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_of(text):
    words = words_of(text)
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def settle(spans):
    """Brute force of the suppression: (start, end, rank) triples that stay."""
    inner = {x for x in spans for y in spans if x != y and y[0] <= x[0] and x[1] <= y[1]
             and ((y[0], y[1]) != (x[0], x[1]) or y[2] < x[2])}
    left = sorted(set(spans) - inner)
    return {x for i, x in enumerate(left) if not any(
        y[0] < x[1] and x[0] < y[1] and y[2] < x[2] for y in left[max(0, i - 1):i] + left[i + 1:i + 2])}


def labels_of(text):
    joined = " " + " ".join(words_of(text)) + " "
    spans = []
    rules = signature_rules()
    for rank, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined):
            start = joined[:m.start()].count(" ") - 1
            spans.append((start, start + m[0].count(" ") + 1, rank))
    return {rules[r].label for _, _, r in settle(spans)} | {x for x in base_of(text)[4].split(",") if x}


TEXTS = [
    None, "", " \t\n", "no rights at all", "CC BY", "cc-by-sa 4.0 and cc by! CC_BY", "xcc by", "cc byx", "All rights reserved.",
    "All\x00rights/reserved all rights reserved", "Licensed under the Apache License, Version 2.0 (the License)",
    "GNU General Public License version 3 or later; general  public license", "é cc by é", "İ all rıghts reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Copyright (c) 2019 Someone. All Rights Reserved. MIT License", "word " * 30000 + "cc by " * 5000 + "mit license",
    "released under the terms of the GNU Lesser General Public License v2.1", "Neither the name of the Foo Group nor the names of its contributors",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
]


def test_against_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(4, "CC BY", "x", "y"), (None, "cc by", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, row string")
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
                 for r in scan_licenses(df).collect())
    want = sorted((str(i), *base_of(t), ",".join(sorted(labels_of(t)))) for i, t, _, _ in rows)
    assert got == want
    scores = {r.doc_id: r.score for r in scan_licenses(df).collect()}
    assert scores[0] == 0.0 and scores[10] == 0.95 and all(0 <= s <= 1 for s in scores.values())


def test_suppression_and_spans(spark):
    rules = [Rule("a", "one two three", "two"), Rule("b", "two", "two"), Rule("c", "three four", "three"), Rule("d", "one two three", "one")]
    df = spark.createDataFrame([(1, "zero one two three four two")], "doc_id long, text string")
    got = {(r.label, r.start, r.end, r.stays) for r in detections(df, rules=rules).collect()}
    assert got == {("a", 1, 4, True), ("b", 2, 3, False), ("b", 5, 6, True), ("c", 3, 5, False), ("d", 1, 4, False)}


def settled(cores):
    """Brute force over whole texts: (core, end, rank) in order of rank, each that nothing kept overlaps without lying in it."""
    kept = []
    for x in sorted(cores, key=lambda x: (x[2], x)):
        hit = [k for k in kept if k[0] < x[1] and x[0] < k[1]]
        if all(x[0] <= k[0] and k[1] <= x[1] and k[:2] != x[:2] for k in hit):
            kept = [k for k in kept if k not in hit] + [x]
    return set(kept)


def test_lists_of_licenses(spark):
    """Every license of a list has its label, whatever stands beside it."""
    lists = {"MIT License, ISC License, Zlib License": "isc,mit,zlib", "MIT License, Apache License 2.0": "apache-2.0,mit",
             "Zlib License; MIT License; X11 license; ISC License; PostgreSQL License; OpenSSL License": "isc,mit,openssl,postgresql,x11,zlib",
             "CC0 1.0, Universal Permissive License": "cc0-1.0,upl-1.0", "License: the BSD License or licensed under the MIT License": "bsd,mit",
             "MIT License " * 3 + "ISC License " * 3: "isc,mit"}
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in scan_licenses(df).collect()} == dict(enumerate(lists.values()))


def test_common_statements(spark):
    """What licenses are commonly stated by has its label."""
    stated = {"SPDX-License-Identifier: MIT": "mit", "License: MIT": "mit", "licensed under MIT": "mit", "License: ISC": "isc", "released under Zlib": "zlib",
              "// SPDX-License-Identifier: (X11 OR NCSA)": "ncsa,x11", "SPDX-License-Identifier: OFL-1.1": "ofl-1.1", "released under the GPL": "gpl",
              "GNU GPL": "gpl", "Apache License": "apache", "the Mozilla Public License": "mpl", "Eclipse Public License - v 2.0": "epl-2.0",
              "Mozilla Public License, v. 2.0": "mpl-2.0", "Apache License, v. 2.0": "apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
              "SPDX-License-Identifier: BSD-3-Clause-Clear": "bsd-3-clause-clear", "License: BSD 3-Clause": "bsd-3-clause",
              "Apache License, 2-Clause BSD License": "apache,bsd-2-clause",
              "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version":
              "gpl,gpl-3.0", "You may not use this file except in compliance with the License.": "apache-2.0", "published by MIT, under MIT rules": ""}
    df = spark.createDataFrame(list(enumerate(stated)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in scan_licenses(df).collect()} == dict(enumerate(stated.values()))


def test_leads_begin_their_patterns():
    assert all(r.pattern.startswith(r.lead) and re.compile(r.lead).groups == 0 for r in signature_rules())


def test_settled_over_whole_groups(spark):
    words = "abcdefgh"
    rng = random.Random(5)
    for _ in range(3):
        spans = [(i, i + n) for i in range(8) for n in (1, 2, 3, 4) if i + n <= 8]
        rules = [Rule(str(k), " ".join(words[a:b]), words[a]) for k, (a, b) in enumerate(rng.sample(spans, 12))]
        rows = [(i, " ".join(words[:i])) for i in range(9)]
        got = sorted((r.id, r.core, r.end, r.rank - len(BASE)) for r in detections(spark.createDataFrame(rows, "doc_id long, text string"), rules=rules)
                     .where("stays").collect())
        found = {i: [(t.index(r.pattern) // 2, (t.index(r.pattern) + len(r.pattern) + 1) // 2, k) for k, r in enumerate(rules) if r.pattern in t]
                 for i, t in rows}
        assert got == sorted((i, *x) for i, cores in found.items() for x in settled(cores))


def test_every_rule_holds_its_keyword():
    assert len(signature_rules()) > 200
    for r in [*BASE, *signature_rules()]:
        re.compile(r.pattern)
        assert r.keyword


def test_gate_loses_nothing(spark):
    """With keywords and needed words that every text holds, each rule runs on each text: the same detections."""
    texts = ["under the GPLv3", "GPL2, MIT", "governed by the Apache License, Version 2.0", "License type is the ISC", "covered under an expat",
             "relicensed under the terms of the OFL 1.1; licence: artistic", "zzz GNU GPL", "MS PL, MS-PL", "cc-by-nc 4.0 all  rights\treserved.",
             "SPDX-License-Identifier: GPL-3.0-only OR (MIT AND X11)", "(c) by no one", "", " ", "beerware beer ware", "CC BY", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = signature_rules()
    open_rules = [dataclasses.replace(r, keyword="*", needs="") for r in rules]

    def rows(rules):
        return sorted(map(tuple, detections(df, rules=rules).drop("row").collect()), key=str)

    assert rows(rules) == rows(open_rules) and len(rows(rules)) > len(texts)
    assert all(w.isalnum() for r in rules for w in r.needs.split("|") if w)


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in QUERIES["op2_licenses"](spark, path).collect())
    assert got == sorted((r.doc_id, *base_of(r.text)) for r in docs)
    assert any(r[2] for r in got)


def test_expressions_of_any_length(spark):
    """Every identifier of an expression is found, however many stand before it; prose after the tag is not walked."""
    ids = ["MIT", "BSD-2-Clause", "Apache-2.0", "Zlib", "ISC"]
    many = " OR ".join(f"LicenseRef-{i}" for i in range(20_000))
    texts = [f"SPDX-License-Identifier: ({' AND '.join(ids)})", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND (Zlib OR MIT)",
             f"SPDX-License-Identifier: {many} OR ISC", "SPDX-License-Identifier: MIT " + "some more words of prose here " * 4 + "and isc",
             "SPDX-License-Identifier: or or or and SPDX-License-Identifier: Zlib"]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "apache-2.0,bsd-2-clause,isc,mit,zlib", 1: "gpl-2.0,mit,zlib", 2: "isc", 3: "mit", 4: "zlib"}


def test_holders_of_any_length(spark):
    holder = "a very long holder " * 30
    texts = [f"Neither the name of the {holder} nor the names of its contributors may be used", f"Except as contained in this notice, the name of the {holder} "
             "shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software",
             "No part may be reproduced " + "in any form or by any means " * 2000 + "without prior written permission", "may not be copied " * 20_000]
    texts[2] = texts[2].replace("No part may be", "This may not be")
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "bsd-3-clause", 1: "x11", 2: "proprietary", 3: ""}
