import re

from crawlens.llm import licenses
from crawlens.llm.license_rules import SIGNATURES, STEMS, fixed, kin, piece

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(text, items):
    """Words, places of every rule, and what suppression leaves."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP))
    padded = " " + " ".join(words) + " "
    found = []
    for n, r in enumerate(items):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", padded, re.IGNORECASE | re.ASCII):
            start = padded[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, r.priority, n))
    stays = [x for x in found if items[x[3]].base or not any((y[0] < x[0] or y[1] > x[1] or (y[2], y[3]) < (x[2], x[3])) and y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] for y in found)]
    base = [x for x in found if items[x[3]].base]
    join = lambda xs: ",".join(sorted({items[x[3]].label for x in xs}))
    return len(words), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), join(base), join(stays), max((items[x[3]].score for x in stays), default=0.0)


TEXTS = [
    None, "", "!!", "Released under the MIT License.", "under the mit license under the mit license", "CC-BY-NC 4.0 and cc by nc cc by nc-sa 3.0", "Licensed under the Apache License, Version 2.0",
    "SPDX-License-Identifier: GPL-3.0-or-later", "the licence of this is the GNU General Public License, version 3", "license license MIT licence mit", "Éunder the MIT license", "x" * 50000 + " mit license",
    "apache license version 2 0 " * 50, "Permission is hereby granted, free of charge, to any person obtaining a copy. BSD 3-clause license; see LICENSE MIT", "UNDER THE MİT LICENSE", "under the mit license",
]


def test_as_brute_force(spark):
    items = licenses.rules()
    assert len(SIGNATURES) > 200 and len({r.pattern for r in items}) > 400
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, rule int")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute(t, items), t


def test_edges(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = licenses.scan(spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in twice) == [("1", "mit"), ("1", "mit"), ("None", "")]


def test_sql_says_the_same(spark):
    import duckdb
    import pyarrow as pa

    items = licenses.rules()
    documents = pa.table({"doc_id": range(len(TEXTS)), "text": TEXTS})
    con = duckdb.connect()
    con.register("documents", documents)
    for r in con.sql(licenses.oracle_sql(items)).fetchall():
        assert r[1:] == brute(TEXTS[r[0]], items)


def shortest(parsed):
    """The texts that a parsed pattern matches, one for each choice of alternatives, without what is optional; a word
    that may be any is `zz`."""
    from re import _constants as c

    out = [""]
    for op, arg in parsed:
        if op is c.LITERAL:
            more = [chr(arg)]
        elif op is c.IN and arg[0][0] is c.NEGATE or op is c.NOT_LITERAL:
            more = ["z"]
        elif op is c.IN:
            more = [chr(x) for kind, y in arg for x in ([y] if kind is c.LITERAL else range(y[0], y[1] + 1))]
        elif op is c.BRANCH:
            more = [x for p in arg[1] for x in shortest(p)]
        elif op is c.SUBPATTERN:
            more = shortest(arg[3])
        else:
            assert op is c.MAX_REPEAT, op
            more = [x * arg[0] for x in shortest(arg[2])] if arg[0] else [""]
        out = [a + b for a in out for b in more]
    return out


def test_every_alternative_passes_its_gate():
    from re import _parser

    for r in licenses.rules():
        for text in shortest(_parser.parse(r.pattern)):
            assert re.fullmatch(r.pattern, text) and r.keyword in text and any(s in text for s in STEMS) and kin(r.pattern) in text and piece(r.pattern) in text, (r, text)


def test_names_without_the_usual_word(spark):
    texts = ["Licensed under the ASL 2.0", "released under the Expat terms", "distributed under the PSF terms", "Published under the Internet Systems Consortium license", "provided under the Open RAIL-M"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["apache-2", "mit", "python-2.0", "isc", "openrail"]
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute(texts[r["doc_id"]], licenses.rules())


#: Texts as they stand in files, with the labels that a reader gives them.
READ = [
    ("/*\n * Copyright (c) 2014 A. Person\n *\n * Permission is hereby granted, free of charge, to any person obtaining a copy of this\n * software and associated documentation files (the \"Software\"), to deal in the Software", "mit"),
    ("// Use of this source code is governed by an MIT-style\n// license that can be found in the LICENSE file.", "mit"),
    ("<a href='https://opensource.org/licenses/MIT'>terms</a>", "mit"),
    ("Dual-licensed under MIT or Apache-2.0.", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation; see COPYING", "gpl"),
    ("This program is free software; you can redistribute it and/or\n modify it under the terms of the GNU General Public License\n as published by the Free Software Foundation; either version 2\n of the License, or (at your option) any later version.", "gpl-2.0"),
    ("You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.", "gpl"),
    ("/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */", "gpl-2.0,gpl-exception-linux-syscall"),
    ("// SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "agpl-3.0"),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "gfdl-1.3"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "bsd"),
    ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3-clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")", "mpl-1.1"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "epl-1.0"),
    ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product ... Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0-1.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License", "cc-by-nc-nd"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("CC BY-SA 4.0 licensed", "cc-by-sa-4.0"),
    ("Perl modules: you can redistribute it. This module is free software; you can redistribute it and/or modify it under the same terms as Perl itself.", "perl"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"),
    ("This software is governed by the CeCILL-B license under French law", "cecill-b"),
    ("Contains public sector information licensed under the Open Government Licence v3.0.", "ogl-uk-3.0"),
    ("The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work.", "busl-1.1"),
    ("Use of this model is governed by the Meta Llama 3 Community License Agreement", "llama-3"),
    ("Released to the public domain by its author.", "public-domain"),
    ("You need a driver's license to rent a car; the permission slip lies under the door.", ""),
    ("The museum put the mit of the catcher under glass. A license to print money.", ""),
    ("apache helicopters were offered under contract", ""),
]


def test_texts_as_read(spark):
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(READ)], "doc_id long, text string")).collect()
    wrong = [(READ[r["doc_id"]][0][:70], READ[r["doc_id"]][1], r["labels"]) for r in got if r["labels"] != READ[r["doc_id"]][1]]
    assert not wrong, wrong


def test_fixed_pieces():
    assert fixed("a b(?: c)? d|licen[cs]e x") == [["a b", " d"], ["licen", "e x"]]
    assert fixed("open ?rail") == [["open", "rail"]] and fixed("f[^ ]{1,5} you") == [["f", " you"]]
