"""URL verdicts and licence sentences: DuckDB oracles, cases, edge rows."""

from __future__ import annotations

import duckdb

from tests.llm.conftest import by_id
from tidemark.llm import op7_urls, op9_licenses
from tidemark.llm.op7_urls import PatternRule, url_verdicts, url_verdicts_sql
from tidemark.llm.op9_licenses import SENTENCES, license_scan, license_scan_sql

URLS = [
    "https://a.example.net/en/1", "https://example.net/de/1", "HTTP://WWW.Example.COM/de/x?y", "http://example.com/DE/x",
    "https://x.org/fr/", "https://org/fr/z", "https://notexample.com/de/1", "https://m.free-bets.example.com/en/27#top",
    "https://cheap-pills.example.org", "https://cheap.example.org/pills.", "http://a.net?q=/en/", "http://a.net", None,
    "", "no scheme", "://", "x://h#f/de/", "https://a.example.com/x?affid=12", "https://a.example.com/x?aff_id=7",
    "https://big-casino.example.org/", "https://example.org/wp-login.php", "https://h:80/p://q", "a://b://c/d",
    "https://cheap-pills.example.net/en/ok", "https://x.example.com/" + "a/" * 50_000,
]


def same(df, sql, tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    want = con.execute(sql).fetchdf()
    cols = list(want.columns)
    key = lambda rows: sorted(repr(tuple(None if x != x else x for x in r)) for r in rows)
    assert sorted(df.columns) == sorted(cols)
    assert key(tuple(r[c] for c in cols) for r in df.collect()) == key(
        tuple(None if x is None or x != x else x for x in r) for r in want.astype(object).itertuples(index=False))


def test_urls_equal_oracle(spark):
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS})
    df = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS)],
                               "page_id long, url string, host int, rule string")
    same(url_verdicts(df), url_verdicts_sql(), {"pages": pages})
    got = by_id(url_verdicts(df), "page_id")
    assert got[0].rule == "example.net/en/" and got[0].verdict == "allow" and got[0].host == "a.example.net"
    assert got[1].rule == "net/" and got[1].verdict == "block"
    assert got[2].rule == "example.com/de/" and got[2].path == "/de/x"
    assert got[7].rule is None and got[7].verdict == "block"
    assert got[12].host == "" and got[12].path == "" and got[12].verdict == "allow"
    assert got[23].verdict == "allow"  # a fitting host rule decides before the patterns


def test_rules_are_indexed_by_their_rarest_literal(spark):
    df = spark.createDataFrame([(1, "https://a.b/cheap"), (2, "https://a.b/cheap/pills"), (3, None)],
                               "page_id long, url string")
    rows = df.selectExpr("page_id", "url")
    rules = (PatternRule("cheap.pills", ("cheap", "pills")), PatternRule("zzz", ()))
    assert op7_urls._index(rows, rules) == {"pills": ["cheap.pills"], "": ["zzz"]}
    plan = url_verdicts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_repeated_and_no_pages(spark):
    df = spark.createDataFrame([(1, "https://x.net/a")] * 3, "page_id long, url string")
    assert [r.verdict for r in url_verdicts(df).collect()] == ["block"] * 3
    assert url_verdicts(df.limit(0)).count() == 0


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
       "documentation files (the \"Software\"), to deal in the Software without restriction, including without\n"
       "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the\n"
       "Software, and to permit persons to whom the Software is furnished to do so, subject to the following\n"
       "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or\n"
       "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,\n"
       "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR\n"
       "PURPOSE AND NONINFRINGEMENT.\n")
TEXTS = [
    "Intro.\nReleased under the MIT License.\nMore.", "Text! Licensed under CC BY-NC 4.0. more", MIT,
    MIT.replace("THE SOFTWARE IS", "THE THING IS"), "Some words. This work is licensed under the GNU General Public "
    "License, version 3. End. Licensed under the Apache License, Version 2.0.", None, "", "license", "MIT License",
    "ALL RIGHTS RESERVED!\nAll rights reserved.", "word " * 30_000 + "\nAll rights reserved.",
    # sentences of one licence in the wrong order are no match
    "\n".join(SENTENCES[s] + "." for s in ("bsd_binary", "bsd_source", "bsd_use")),
    "\n".join(SENTENCES[s] + "." for s in ("bsd_use", "reserved", "bsd_source", "bsd_binary", "bsd_names")),
]


def test_licences_equal_oracle(spark):
    import pandas as pd

    docs = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS})
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, ids string, low int")
    same(license_scan(df), license_scan_sql(), {"documents": docs})
    got = by_id(license_scan(df))
    assert [got[i].licenses for i in range(10)] == [
        "MIT", "CC-BY-NC-4.0", "MIT", None, "Apache-2.0+GPL-3.0", None, None, None, None, "Proprietary"]
    assert got[9].n_license_sentences == 2 and got[10].licenses == "Proprietary"
    assert got[11].licenses is None and got[12].licenses == "BSD-3-Clause"
    assert license_scan(df.limit(0)).count() == 0
    assert op9_licenses.MAX_SENTENCES >= len(SENTENCES)


HEAD = "Copyright (c) 2024 Jane Doe"
BSD = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
       "the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice,\n"
       "   this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the "
       "above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or "
       "other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of "
       "its\n   contributors may be used to endorse or promote products derived from\n   this software without specific "
       "prior written permission.\n")
GPL = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
       "License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any "
       "later version.\n\nThis program is distributed in the hope that it will be useful.\n\nYou should have received a "
       "copy of the GNU General Public License\nalong with this program.  If not, see <https://www.gnu.org/licenses/>.\n")


def unwrapped(text):
    return "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))


def test_full_heads_wrapped_and_unwrapped(spark):
    bsd = "bsd_use,bsd_source,bsd_binary,bsd_names"
    want = {"MIT": (MIT, "mit_grant,as_is", "MIT"), "BSD": (BSD, bsd, "BSD-3-Clause"),
            "GPL": (GPL, "gpl3_head,gpl_copy", "GPL-3.0")}
    rows, hope = [], []
    for text, ids, name in want.values():
        for body in (text, unwrapped(text), "\n".join(unwrapped(text).split("\n\n"))):
            for full in (body, f"Head\n\n{HEAD}\n\n{body}", f"{HEAD}\n{body}",
                         "".join(f" * {x}\n" for x in f"{HEAD}\n\n{body}".split("\n"))):
                rows.append((len(rows), full))
                hope.append((ids, name))
    rows.append((len(rows), "Released under the\nMIT License.\n\n" + HEAD + "\n\nAll rights reserved.\nReleased under "
                 "the MIT license\n\nand more"))
    hope.append(("mit_short,reserved,mit_short", "MIT"))
    got = by_id(license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(got[i].sentence_ids, got[i].licenses) for i in range(len(rows))] == hope


def test_one_name_for_each_text(spark):
    """Shorter rules inside longer ones, bullets, heads, openings, negation."""
    two = BSD.split("3. Neither")[0]
    gnu = {"GPL-2.0": GPL.replace("version 3", "version 2"), "LGPL-3.0": GPL.replace("GNU General", "GNU Lesser General"),
           "LGPL-2.1": GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
           .replace("This program", "This library").replace("this program", "this library"),
           "AGPL-3.0": GPL.replace("GNU General", "GNU Affero General")}
    bullets = BSD.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    rights = "Copyright (c) 2020, Jane Doe. All rights reserved.\n\n"
    cases = [(two, "BSD-2-Clause"), (BSD, "BSD-3-Clause"), (bullets, "BSD-3-Clause"), (rights + BSD, "BSD-3-Clause"),
             (rights + unwrapped(two), "BSD-2-Clause"), (" ".join(BSD.split()), "BSD-3-Clause"),
             (two + "\n\n" + BSD, "BSD-2-Clause+BSD-3-Clause"), (BSD + "\n\n" + two, "BSD-2-Clause+BSD-3-Clause"),
             (rights, "Proprietary"), ("This project is released under the MIT license.", "MIT"),
             ("This project is\nreleased under the MIT license.", "MIT"),
             ("This text is not\nreleased under the MIT license.", None),
             ("It isn't\nlicensed under the MIT license.", None),
             ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the "
              "MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
             ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
              "hereby granted, provided that the above\ncopyright notice and this permission notice appear in all "
              "copies.", "ISC"),
             ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, "
              "and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of "
              "this software must not be misrepresented.", "Zlib"),
             *((text, name) for name, text in gnu.items())]
    got = by_id(license_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)],
                                                   "doc_id long, text string")))
    assert [(i, got[i].licenses) for i in range(len(cases))] == [(i, name) for i, (_, name) in enumerate(cases)]


def test_openings_stand_first_in_known_sentences():
    import re

    inside = op9_licenses.OPENING.replace("^", " ", 1)
    assert not [s for s in SENTENCES.values() if re.search(inside, s)]
