"""Genuine licence notices, unedited and wrapped as their publishers print them."""

import pytest

from tidemark.llm import licenses

MIT = '''MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
BSD = '''Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY.
'''
NAME = '''
3. Neither the name of %s nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
'''
GPL = '''Copyright (C) 2020  Jane Doe

This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
NOTICES = [
    (MIT, "MIT"), (BSD % "", "BSD-2-Clause"), (BSD % NAME % "the copyright holder", "BSD-3-Clause"), (BSD % NAME % "the University of\nNowhere", "BSD-3-Clause"),
    (APACHE, "Apache-2.0"), (GPL % (":", ", either", 3), "GPL-3.0"), (GPL % (";", "; either", 2), "GPL-2.0"), (MPL, "MPL-2.0"),
]
LEADS = [("", ""), ("# ", ""), (" * ", "\r")]


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [(f"{k}/{j}", "\n".join(lead + x + end for x in text.split("\n"))) for k, (text, _) in enumerate(NOTICES) for j, (lead, end) in enumerate(LEADS)]
    texts += [(f"{k}/no blank", text.replace("\n\n", "\n")) for k, (text, _) in enumerate(NOTICES)]
    return {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(texts, "doc_id string, text string")).collect()}


@pytest.mark.parametrize("k", range(len(NOTICES)))
def test_genuine_notices(scanned, k):
    assert {d: got for d, got in scanned.items() if d.startswith(f"{k}/")} == {f"{k}/{j}": NOTICES[k][1] for j in (*range(len(LEADS)), "no blank")}


def test_sentences_do_not_run_over_a_blank_line_or_start_in_the_middle(spark):
    texts = [("Released under\nthe MIT License", "MIT"), ("Released under\n\nthe MIT License", ""), ("not released under\nthe MIT License", ""), ("Released under the MIT License\nor not", "MIT"), ("x v. Released under the MIT License", "MIT"), ("\x01Released under\x02the MIT License", "MIT")]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licences for r in got} == {i: want for i, (_, want) in enumerate(texts)}
    assert licenses.scan(spark.createDataFrame([(1, "\n" * 100_000 + "? " * 100_000 + "\nReleased under the MIT License." + " v. " * 100_000)], "doc_id long, text string")).first().licences == "MIT"


FREE = "{0} is free software: you can redistribute it and/or modify\nit under the terms of the GNU {1} as published by\nthe Free Software Foundation, either version {2} of the License, or\n(at your option) any later version.\n\n{0} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {1} for more details.\n"
ISC = "Copyright (c) 2020, Some One <x@example.org>\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND\nFITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.\n"
MORE = {
    "AGPL-3.0": FREE.format("This program", "Affero General Public License", "3"),
    "LGPL-2.1": FREE.format("This library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": FREE.format("This program", "Lesser General Public License", "3"),
    "GPL-3.0": FREE.format("This program", "General Public License", "3"),
    "ISC": ISC,
    "0BSD": ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""),
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented.\n",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html\n",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n",
    "CC0-1.0": "To the extent possible under law, Some One has waived all copyright\nand related or neighboring rights to this work.\n",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.\n",
    "CC-BY-NC-ND-3.0": "Except where otherwise noted, this work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.\n",
}
TAGS = {"MIT": "SPDX-License-Identifier: MIT", "GPL-2.0": "SPDX-License-Identifier: GPL-2.0-only", "LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1-or-later", "Apache-2.0": "SPDX-License-Identifier: Apache-2.0", "MPL-2.0": "SPDX-License-Identifier: MPL-2.0", "BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause", "CC-BY-4.0": "SPDX-License-Identifier: CC-BY-4.0"}


def commented(text, mark, first="", last=""):
    return first + "".join(f"{mark}{line}".rstrip() + "\n" for line in text.split("\n")) + last


def test_more_notices_in_comments(spark):
    rows = []
    for name, text in [*MORE.items(), *TAGS.items()]:
        for form in (text, commented(text, "// "), commented(text, "# "), commented(text, " * ", "/*\n", " */\nint main() {}\n"), commented(text, "rem "), commented(text, "dnl "), "Some words before\n\n" + text + "\n\nand after."):
            rows.append((len(rows), form, name))
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r.licences for r in licenses.scan(df).collect()}
    wrong = [(want, text[:60], got[i]) for i, text, want in rows if got[i] != want]
    assert not wrong
    assert len({*MORE, *TAGS}) > 18


def test_near_misses_show_nothing(spark):
    texts = ["SPDX-License-Identifier: MIT OR Apache-2.0", "it is not released under the MIT license", MORE["ISC"].replace("hereby granted", "granted"), MORE["Zlib"].split("\n\n")[0], "see Licensed under CC-BY-4.0 for more", MORE["CC0-1.0"].replace("waived", "kept")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licenses.scan(df).collect()} == dict.fromkeys(range(len(texts)), "")


def test_notices_equal_the_sql(spark, tmp_path):
    import duckdb

    texts = [*MORE.values(), *TAGS.values(), *[commented(t, " * ", "/*", "*/") for t in MORE.values()], None, "", "v. 2.0\nMIT", "Released under the MIT License! v. \n. x", "1) Released under the MIT License\n(2) released under the ISC license.", "\x01\x02 public", "a\n\n\nThis work is in the public domain\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    rel = con.sql(licenses.scan_sql())
    assert sorted(rel.fetchall()) == sorted(tuple(r[c] for c in rel.columns) for r in licenses.scan(df).collect())
