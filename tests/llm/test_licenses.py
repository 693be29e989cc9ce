import re
import textwrap

from delaylake.llm import licenses as op


def brute(text):
    known = {op.normalised(s): name for name, s in op.SENTENCES}
    parts = re.split("\n", re.sub(r"[.!?;]+([ \t\n\x0B\f\r]|\Z)", "\n", text or ""))
    ids = [(i, known[op.normalised(p)]) for i, p in enumerate(parts) if op.normalised(p) in known]
    sequence, at, found = [x for _, x in ids], 0, []
    while at < len(sequence):
        fits = [(len(r[1].split()), r[0]) for r in op.RULES if sequence[at : at + len(r[1].split())] == r[1].split()]
        longest = max(fits, key=lambda f: f[0], default=None)
        found += [longest[1]] if longest else []
        at += longest[0] if longest else 1
    return ids, found


BY = dict(op.SENTENCES)
TEXTS = [
    None, "", "no licence here", BY["A"] + ".", f"prose.\n{BY['E']}.\n{BY['L']}.", f"{BY['C']}\n\nCopyright someone.\n{BY['D']}.", f"{BY['D']}. {BY['C']}",
    f"{BY['F']};\n{BY['G']}.\n{BY['H']}", f"{BY['G']}. {BY['F']}.", BY["I"].upper() + "!!", BY["J"] + ". Other words. " + BY["K"] + ".", "x. " * 20_000 + BY["P"] + "\n" + BY["Q"],
    "Released   under\tthe MIT    License", "İ Released under the MIT License.", f"{BY['R']}. {BY['S']}", BY["E"] + "." + BY["A"],
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, "clash", ["x"]) for i, t in rows], "doc_id long, text string, sequence string, rules array<string>")
    got = op.scan_licenses(docs).collect()
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], [(s["number"], s["id"]) for s in r["sentences"]], r["licences"]) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    assert sum(len(brute(t)[1]) for _, t in rows) > 12
    assert op.scan_licenses(docs.limit(0)).count() == 0


def test_table():
    assert all(any(m in s.lower() for m in op.MARKS) for _, s in op.SENTENCES)
    names = [n for n, _ in op.SENTENCES]
    assert len(set(names)) == len(names) == len({op.normalised(s) for _, s in op.SENTENCES})
    assert all(set(r.split()) <= set(names) for _, r in op.RULES) and len({licence for licence, _ in op.RULES}) >= 25
    assert not any(c in n for n in names for c in ' <>')
    assert all(len(op._cut(s)) == 1 for n, s in op.SENTENCES if n != "R")
    assert len({r for _, r in op.RULES}) == len(op.RULES)


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
"""


def wrapped(text, width, prefix=""):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


def commented(text, prefix):
    return "\n".join((prefix + line).rstrip() for line in text.split("\n"))


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in op.scan_licenses(docs).collect()}
    return [([(s["number"], s["id"]) for s in rows[i]["sentences"]], rows[i]["sequence"], rows[i]["licences"]) for i in range(len(texts))]


def test_wrapped_notices(spark):
    notices = {"MIT": "C D", "GPL-3.0-or-later": "J K", "BSD-3-Clause": "P Q"}
    texts, want = [], []
    for licence, rule in notices.items():
        for prefix in ("", "# ", " * ", "// ", "dnl "):
            texts.append(f"{prefix}Title\n" + f"\n{prefix.rstrip()}\n".join(wrapped(BY[x] + ("" if BY[x].endswith(":") else "."), 60, prefix) for x in rule.split()))
            want.append((rule, [licence]))
    for prefix in ("", "# ", " * ", "REM "):
        texts.append(commented(APACHE, prefix))
        want.append(("F G H", ["Apache-2.0"]))
    texts += [APACHE.replace("\n", "\r\n"), BY["E"] + "\n(the \"License\")", "Notes\nMIT.\n" + BY["A"] + "\nmore words", "Licensed under\n\nthe MIT License", "Licensed under. the MIT License", "Licensed under\nthe MIT\nLicense of old"]
    want += [("F G H", ["Apache-2.0"]), ("F", []), ("A", ["MIT"]), ("", []), ("", []), ("", [])]
    assert [x[1:] for x in scanned(spark, texts)] == want


def test_numbers_of_wrapped_sentences(spark):
    text = f"One. Two\n{wrapped(BY['P'], 40)}\n\n{BY['A']}.\n{wrapped(BY['B'], 12)}"
    lines = wrapped(BY["P"], 40).count("\n")
    assert scanned(spark, [text])[0][0] == [(2, "P"), (2 + lines + 2, "A"), (2 + lines + 3, "B")]


def test_whole_table_is_found(spark):
    """Every sentence and rule, on one line each and wrapped."""
    texts, want = [], []
    for rule, licence in [(n, None) for n, _ in op.SENTENCES] + [(r, name) for name, r in op.RULES]:
        for width in (10_000, 50):
            texts.append("\n\n".join(wrapped(BY[x] + ("" if BY[x].endswith(":") else "."), width) for x in rule.split()))
            want.append((rule, licence))
    got = scanned(spark, texts)
    assert [x[1] for x in got] == [r for r, _ in want]
    assert all(x[2] == [name] for x, (_, name) in zip(got, want, strict=True) if name)


def test_mozilla_header(spark):
    header = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    texts = [header, commented(header, " * "), header.replace("v. 2.0", "v.\n2.0"), header.replace("v. 2.0", "v. 3.0")]
    assert [x[1:] for x in scanned(spark, texts)] == [("R S", ["MPL-2.0"])] * 3 + [("S", [])]


HEADERS = {
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free
Software Foundation; either version 2 of the License, or (at your option)
any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.""",
}


def test_standard_headers(spark):
    texts, want = [], []
    for licence, text in HEADERS.items():
        for prefix in ("", "# ", " * ", "// "):
            texts.append(commented(text, prefix))
            want.append([licence])
    assert [x[2] for x in scanned(spark, texts)] == want
