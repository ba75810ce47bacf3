"""Licence recognition by sentence rules, with DataFrame functions only.

Each text becomes a line of words in which line and sentence ends are marked; known licence sentences are found between
the marks, and the sequence of identifiers is matched against ordered rules. Nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised (lower case, runs of other than letters and digits as one space).
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "mit-short": "released under the mit license",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-short": "licensed under cc by nc 4 0",
    "cc-by-short": "licensed under cc by 4 0",
    "cc-by-sa-short": "licensed under cc by sa 4 0",
    "bsd3-short": "released under the bsd 3 clause license",
    "mpl-short": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work is in the public domain",
    "apache-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
}
#: Licences by the ordered sentences that show them.
RULES = {
    "Apache-2.0": [["apache-short"], ["apache-grant", "apache-copy"]],
    "MIT": [["mit-short"], ["mit-grant", "mit-notice"]],
    "GPL-3.0": [["gpl3-short"], ["gpl-free", "gpl-warranty"]],
    "CC-BY-NC-4.0": [["cc-by-nc-short"]],
    "CC-BY-4.0": [["cc-by-short"]],
    "CC-BY-SA-4.0": [["cc-by-sa-short"]],
    "BSD-3-Clause": [["bsd3-short"], ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-name"]],
    "BSD-2-Clause": [["bsd-redistribute", "bsd-source", "bsd-binary", "as-is"]],
    "MPL-2.0": [["mpl-short"]],
    "Public-Domain": [["public-domain"]],
}

_AS_PUBLISHED = " as published by the free software foundation"
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu "
_LIBRARY = "this library is free software you can redistribute it and or modify it under the terms of the gnu "
_USEFUL = " is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"


def _version(n: str) -> list[str]:
    return [f" either version {n} of the license or at your option any later version", f" version {n} of the license", f" version {n}"]


#: Sentences of genuine notices, as they go on where SENTENCES stops or words them otherwise, and those of
#: more licences. "*" stands for 1 to 20 words (a holder's name).
WORDINGS = {
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-grant": [SENTENCES["mit-grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "as-is": [SENTENCES["as-is"] + " express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd-as-is": ["this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-name": [
        "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of * nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl-free": [SENTENCES["gpl-free"] + v for v in _version("3")],
    "gpl2-free": [*[SENTENCES["gpl-free"] + v for v in _version("2")], _FREE + "general public license version 2" + _AS_PUBLISHED],
    "gpl-warranty": ["this program" + _USEFUL],
    "agpl-free": [_FREE + "affero general public license" + _AS_PUBLISHED + v for v in _version("3")],
    "lgpl21-free": [_LIBRARY + "lesser general public license" + _AS_PUBLISHED + v for v in _version("2 1")],
    "lgpl3-free": [a + "lesser general public license" + _AS_PUBLISHED + v for a in (_LIBRARY, _FREE) for v in _version("3")],
    "library-warranty": ["this library" + _USEFUL],
    "isc-grant": [f"permission to use copy modify and {w}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for w in ("or ", "")],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-liable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsl-header": ["distributed under the boost software license version 1 0"],
    "bsl-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "epl1-terms": [f"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at {h} www eclipse org legal epl v10 html" for h in ("http", "https")],
    "epl2-terms": [f"this program and the accompanying materials are made available under the terms of the eclipse public license {v}2 0 which is available at {h} www eclipse org legal epl 2 0" for v in ("", "v ") for h in ("http", "https")],
    "mpl-copy": [f"if a copy of the mpl was not distributed with this file you can obtain one at {h} mozilla org mpl 2 0" for h in ("http", "https")],
    "cc0-waived": ["to the extent possible under law * has waived all copyright and related or neighboring rights to this work", "to the extent possible under law * has waived all copyright and related or neighboring rights to *"],
    "cc0-dedicated": ["to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "isc-short": ["released under the isc license"], "zlib-short": ["released under the zlib license"], "bsd2-short": ["released under the bsd 2 clause license"], "unlicense-short": ["released under the unlicense"],
}
#: More ways to show a licence, by the identifiers that only WORDINGS has.
WORDING_RULES = {
    "GPL-2.0": [["gpl2-free", "gpl-warranty"]],
    "BSD-2-Clause": [["bsd2-short"], ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-as-is"]],
    "AGPL-3.0": [["agpl-free", "gpl-warranty"]], "LGPL-2.1": [["lgpl21-free", "library-warranty"]], "LGPL-3.0": [["lgpl3-free", "library-warranty"], ["lgpl3-free", "gpl-warranty"]],
    "ISC": [["isc-short"], ["isc-grant", "isc-as-is"]], "0BSD": [["0bsd-grant", "isc-as-is"]], "Zlib": [["zlib-short"], ["zlib-as-is", "zlib-liable", "zlib-grant"]], "BSL-1.0": [["bsl-header"], ["bsl-grant"]],
    "Unlicense": [["unlicense-short"], ["unlicense-free", "unlicense-anyone"]], "EPL-1.0": [["epl1-terms"]], "EPL-2.0": [["epl2-terms"]], "CC0-1.0": [["cc0-waived"], ["cc0-dedicated"]],
}
#: The names that tags give licences whose versions may be "only" or "or later"; the parts of Creative Commons licences.
VERSIONED = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}


def _commons() -> tuple[dict[str, list[str]], dict[str, list[list[str]]]]:
    """Creative Commons notices, by their parts and versions."""
    wordings, rules = {}, {}
    for part, words in COMMONS.items():
        for version, kind in (("4.0", "international"), ("3.0", "unported")):
            name = f"CC-{part}-{version}"
            number = version.replace(".", " ")
            wordings[name.lower()] = [f"{head} is licensed under {a} creative commons {words} {number} {kind} license" for head in ("this work", "except where otherwise noted this work") for a in ("a", "the")]
            rules[name] = [[name.lower()]]
    return wordings, rules


def _tags(licences: list[str]) -> tuple[dict[str, list[str]], dict[str, list[list[str]]]]:
    """Tag lines that name one licence by its identifier."""
    wordings, rules = {}, {}
    for name in licences:
        ends = ["", "-only", "-or-later"] if name in VERSIONED else [""]
        wordings[f"spdx-{name.lower()}"] = ["spdx license identifier " + "".join(c if c.isalnum() else " " for c in (name + e).lower()) for e in ends]
        rules[name] = [[f"spdx-{name.lower()}"]]
    return wordings, rules


def _joined(*tables: dict[str, list]) -> dict[str, list]:
    return {k: [x for t in tables for x in t.get(k, [])] for k in dict.fromkeys(k for t in tables for k in t)}


_cc, _cc_rules = _commons()
_named = sorted({*RULES, *WORDING_RULES, *_cc_rules} - {"Public-Domain"})
_tag, _tag_rules = _tags(_named)
WORDINGS = _joined(WORDINGS, _cc, _tag)
WORDING_RULES = _joined(WORDING_RULES, _cc_rules, _tag_rules)
#: Marks of ends: a sentence must stop at HARD; at SOFT (a line end, the point of "v.") it may stop or go on.
HARD, SOFT = "\x01", "\x02"
#: Replacements that mark a lower-cased text, in order; they read the same to Java and RE2.
MARKS = (
    # what opens a line of a comment or of a list: marks, the words rem and dnl, and numbers or letters in brackets
    (r"\n[ \t#*/;%|<>!-]*(?:(?:rem|dnl)[ \t]+)?(?:\(?[0-9a-z]{1,2}\)[ \t]+)?", "\n"),
    (r"\bv[.!?]\s+", "v" + SOFT), (r"[.!?]\s+", HARD), (r"\n", SOFT), (f" *[^a-z0-9{HARD}{SOFT} ][^a-z0-9{HARD}{SOFT}]*|  +", " "),  # single spaces stand
    (f" ?{SOFT} ?{SOFT}[ {SOFT}]*", HARD),  # a line without words
    (f" ?{HARD}[ {HARD}{SOFT}]*", HARD), (f" ?{SOFT} ?", SOFT),
)


def marked(text: Column) -> Column:
    """Lower-case words of letters and digits with one space, SOFT or HARD between them, HARD at both ends."""
    t = F.concat(F.lit("\n"), F.translate(F.lower(text), HARD + SOFT, "  "))
    for pattern, to in MARKS:
        t = F.regexp_replace(t, pattern, to)
    return F.concat(F.lit(HARD), F.regexp_replace(t, f"^[ {HARD}{SOFT}]+|[ {HARD}{SOFT}]+$", ""), F.lit(HARD))


def _pattern(sentence: str, soft: str = f"[ {SOFT}]") -> str:
    gap = f"(?:[a-z0-9]+{soft}){{1,20}}?"
    last = f"[a-z0-9]+(?:{soft}[a-z0-9]+){{0,19}}"
    words = [("*", "") if w == "*" else (w, soft) for w in sentence.split(" ")]
    out = "".join((last if i + 1 == len(words) else gap) if w == "*" else w + (end if i + 1 < len(words) else "") for i, (w, end) in enumerate(words))
    return out


def _known(sentences: dict[str, str], wordings: dict[str, list[str]]) -> dict[str, str]:
    """Identifiers by sentence."""
    return {v: k for k, v in sentences.items()} | {v: k for k, vs in wordings.items() for v in vs}


def _every(known: dict[str, str], soft: str) -> str:
    """One pattern for all sentences, the longest first."""
    return "|".join(_pattern(v, soft) for v in sorted(known, key=lambda v: (-len(v), v)))


def _tree(sentences: list[list[str]], soft: str) -> str:
    """A pattern for sentences (lists of words) that share their first words, so that a text is tried once for those.

    At every fork the ways on come before the end, so the longest sentence is met first.
    """
    ends, ways = [] in sentences, {}
    for s in sentences:
        if s:
            ways.setdefault(s[0], []).append(s[1:])
    parts = []
    for word, rest in ways.items():
        run = [word]
        while [] not in rest and len({r[0] for r in rest}) == 1:
            run.append(rest[0][0])
            rest = [r[1:] for r in rest]
        on = _tree([r for r in rest if r], soft)
        tail = f"(?:{soft}{on})" + ("?" if [] in rest else "") if on else ""
        parts.append(soft.join(run) + tail)
    return ("(?:" + "|".join(parts) + ")" + ("?" if ends else "")) if parts else ""


def _ways(rules: dict, wording_rules: dict) -> dict[str, list[list[str]]]:
    return {k: rules.get(k, []) + wording_rules.get(k, []) for k in sorted({*rules, *wording_rules})}


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: dict[str, list[list[str]]] = RULES, wordings: dict[str, list[str]] = WORDINGS, wording_rules: dict[str, list[list[str]]] = WORDING_RULES) -> DataFrame:
    """One row per document: doc_id, n_known, sentence_ids, licences (both joined by commas, "" if there are none).

    docs: doc_id, text; other columns are ignored, whatever their names. A known sentence starts and ends where a line
    or a sentence does: at . ! or ? before white space, or at a line end. It may run over line ends and past "v." but not
    over a line without words; of sentences with one start the longest counts. Between the known sentences of a rule no
    other known sentence may stand, unknown ones may. Licences come in alphabetical order. A null or empty text has
    none; rows that repeat give rows that repeat; an empty table gives an empty result.
    """
    known = _known(sentences, wordings)
    plain = F.create_map(*[F.lit(x) for v, k in known.items() if "*" not in v for x in (v, k)])
    gapped = [(f"^(?:{_pattern(v)})$", k) for v, k in known.items() if "*" in v]
    soft = f"[ {SOFT}]"
    every = "|".join([_tree([v.split(" ") for v in sorted(known) if "*" not in v], soft), *[_pattern(v, soft) for v in sorted(known, key=len, reverse=True) if "*" in v]])
    found = F.regexp_extract_all(marked(F.coalesce("text", F.lit(""))), F.lit(f"(?<=[{HARD}{SOFT}])(?:{every})(?=[{HARD}{SOFT}])"), F.lit(0))

    def name(s: Column) -> Column:
        return F.coalesce(F.element_at(plain, F.translate(s, SOFT, " ")), *[F.when(s.rlike(p), k) for p, k in gapped])

    found = docs.select("doc_id", F.transform(found, name).alias("ids"))
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    shown = F.filter(
        F.array(*[F.when(_any(line, w), F.lit(name)) for name, w in _ways(rules, wording_rules).items()]),
        lambda x: x.isNotNull(),
    )
    return found.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(shown, ",").alias("licences"))


def scan_sql() -> str:
    """The scan in DuckDB's SQL, from the same tables. Its patterns look neither ahead nor back, so the marks stand twice."""
    known = _known(SENTENCES, WORDINGS)
    t = f"chr(10) || translate(lower(coalesce(text, '')), '{HARD}{SOFT}', '  ')"
    for pattern, to in MARKS:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    t = f"'{HARD}{HARD}' || regexp_replace(regexp_replace(regexp_replace({t}, '^[ {HARD}{SOFT}]+|[ {HARD}{SOFT}]+$', '', 'g'), '{HARD}', '{HARD}{HARD}', 'g'), '{SOFT}', '{SOFT}{SOFT}', 'g') || '{HARD}{HARD}'"
    soft = f"(?: |{SOFT}{SOFT})"
    lookup = "CASE " + " ".join(f"WHEN s = '{v}' THEN '{k}'" for v, k in known.items() if "*" not in v) + " " + " ".join(f"WHEN regexp_full_match(s, '{_pattern(v, ' ')}') THEN '{k}'" for v, k in known.items() if "*" in v) + " END"
    shown = ", ".join("CASE WHEN " + " OR ".join(f"contains(line, ',{','.join(w)},')" for w in ways) + f" THEN '{name}' END" for name, ways in _ways(RULES, WORDING_RULES).items())
    return f"""
WITH cut AS (SELECT doc_id, regexp_extract_all({t}, '[{HARD}{SOFT}]({_every(known, soft)})[{HARD}{SOFT}]', 1) AS parts FROM documents),
named AS (SELECT doc_id, [{lookup} FOR s IN [replace(p, '{SOFT}{SOFT}', ' ') FOR p IN parts]] AS ids FROM cut),
lines AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS line FROM named)
SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ',') AS licences FROM lines"""


def _any(line: Column, ways: list[list[str]]) -> Column:
    out = F.lit(False)
    for way in ways:
        out = out | line.contains("," + ",".join(way) + ",")
    return out
