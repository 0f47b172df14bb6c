"""Licence recognition from sentences, with DataFrame functions alone.

A text is cut into sentences; each is normalised (lower case, runs of anything but letters and digits to one space, the frame of a
notice and named persons to fixed words) and looked up among known licence sentences, which gives the text's sequence of sentence
identifiers with their places. A rule is an ordered list of identifiers; it matches where its identifiers stand in that order in
the sequence, with at most ``GAP`` unknown sentences between neighbours. A rule that has all identifiers of another and begins
like it takes the other's place where both begin at one sentence. Everything happens in one projection of each row: no shuffle,
no join, no Python. A text without any of ``MARKS`` has no known sentence and isn't cut at all.

Texts are cut twice: at line ends too, and as running text, where lines of a paragraph are joined. Rules are tried on both.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import fresh

#: Licence identifier -> its names. Each name, the identifier and the identifier with "License" may stand in a notice.
NAMES = {
    "MIT": ["MIT License", "MIT/X11 License", "Expat License", "MIT open source license"],
    "MIT-0": ["MIT No Attribution License"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD 2-Clause Simplified License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD 3-Clause New or Revised License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2 License", "Apache Software License, Version 2.0"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "EDL-1.0": ["Eclipse Distribution License, Version 1.0", "Eclipse Distribution License v1.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0"],
    "CDDL-1.1": ["Common Development and Distribution License, Version 1.1", "Common Development and Distribution License 1.1"],
    "CPL-1.0": ["Common Public License, Version 1.0", "Common Public License 1.0"],
    "IPL-1.0": ["IBM Public License, Version 1.0", "IBM Public License 1.0"],
    "EUPL-1.1": ["European Union Public Licence, Version 1.1", "European Union Public Licence 1.1"],
    "EUPL-1.2": ["European Union Public Licence, Version 1.2", "European Union Public Licence 1.2"],
    "CECILL-2.1": ["CeCILL Free Software License Agreement v2.1", "CeCILL License, Version 2.1"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"],
    "BUSL-1.1": ["Business Source License 1.1", "Business Source License, Version 1.1"],
    "SSPL-1.0": ["Server Side Public License, Version 1", "Server Side Public License v1"],
    "Elastic-2.0": ["Elastic License 2.0", "Elastic License v2"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Libpng": ["libpng License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["Do What The F*ck You Want To Public License", "Do What The Fuck You Want To Public License"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic License, Version 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License, Version 1.1"],
    "PostgreSQL": ["PostgreSQL License"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA Open Source License"],
    "ECL-2.0": ["Educational Community License, Version 2.0", "Educational Community License 2.0"],
    "AFL-3.0": ["Academic Free License, Version 3.0", "Academic Free License 3.0", "Academic Free License v3.0"],
    "OSL-3.0": ["Open Software License, Version 3.0", "Open Software License 3.0", "Open Software License v3.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "PSF-2.0": ["Python Software Foundation License, Version 2", "Python Software Foundation License"],
    "Ruby": ["Ruby License"],
    "Vim": ["Vim License"],
    "X11": ["X11 License"],
    "PHP-3.01": ["PHP License, Version 3.01", "PHP License 3.01"],
    "OpenSSL": ["OpenSSL License"],
    "curl": ["curl License"],
    "UPL-1.0": ["Universal Permissive License, Version 1.0", "Universal Permissive License v1.0"],
    "MulanPSL-2.0": ["Mulan Permissive Software License, Version 2", "Mulan PSL v2"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0"],
    "APSL-2.0": ["Apple Public Source License, Version 2.0", "Apple Public Source License 2.0"],
    "QPL-1.0": ["Q Public License, Version 1.0", "Q Public License 1.0"],
    "W3C": ["W3C Software Notice and License", "W3C License"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License v1.0", "Open Database License v1.0"],
    "ODC-By-1.0": ["Open Data Commons Attribution License v1.0", "Open Data Commons Attribution License"],
    "PDDL-1.0": ["Open Data Commons Public Domain Dedication and License v1.0", "Public Domain Dedication and License 1.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
}
#: Families whose members differ by version. (identifier, short name, long names, versions)
GNU = [
    ("GPL", "GNU GPL", ["GNU General Public License"], ["1.0", "2.0", "3.0"]),
    ("LGPL", "GNU LGPL", ["GNU Lesser General Public License", "GNU Library General Public License"], ["2.0", "2.1", "3.0"]),
    ("AGPL", "GNU AGPL", ["GNU Affero General Public License"], ["1.0", "3.0"]),
    ("GFDL", "GNU FDL", ["GNU Free Documentation License"], ["1.1", "1.2", "1.3"]),
]
#: The parts of Creative Commons names, and versions.
COMMONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
COMMONS_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal {} the Software without restriction'
MIT_RIGHTS = ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
GNU_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation"
#: Sentences of licence texts and notices, with their identifiers.
SENTENCES = {
    MIT_GRANT.format("in") + MIT_RIGHTS + ", subject to the following conditions:": "mit.grant",
    MIT_GRANT.format("in") + MIT_RIGHTS + ".": "mit0.grant",
    MIT_GRANT.format("with") + MIT_RIGHTS + ", subject to the following conditions:": "ncsa.grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit.notice",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.": "mit.notice",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc.grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc.grant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0bsd.grant",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.": "postgresql.grant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd.redistribution",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd.source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd.binary",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd.advertising",
    "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd.endorse",
    "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.": "bsd.endorse",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': "apache2.notice",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache2.copy",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "apache2.copy",
    '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.': "apache2.license",
    '"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.': "apache2.licensor",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gnu.warranty",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.": "gpl3.free",
    "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.": "gpl3.contrast",
    "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.": "gpl2.contrast",
    "The licenses for most software are designed to take away your freedom to share and change it.": "gpl2.most",
    "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.": "lgpl21.applies",
    "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.": "lgpl3.version",
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.": "agpl3.free",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v.": "mpl2.subject",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl2.copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl2.copy",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.": "epl2.notice",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.": "epl2.notice",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html": "epl1.notice",
    "This is free and unencumbered software released into the public domain.": "unlicense.free",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.": "cc0.dedicated",
    "This software is provided 'as-is', without any express or implied warranty.": "zlib.as-is",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib.grant",
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:': "bsl.grant",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.": "wtfpl.copies",
}
#: Fixed values: (licence, rule) with the rule's ordered sentence identifiers; notices by name have rules of their own.
RULES = [
    ("MIT", ["mit.grant", "mit.notice"]),
    ("MIT-0", ["mit0.grant"]),
    ("ISC", ["isc.grant"]),
    ("0BSD", ["0bsd.grant"]),
    ("PostgreSQL", ["postgresql.grant"]),
    ("NCSA", ["ncsa.grant"]),
    ("BSD-2-Clause", ["bsd.redistribution"]),
    ("BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.endorse"]),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-4-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.endorse"]),
    ("Apache-2.0", ["apache2.notice", "apache2.copy"]),
    ("Apache-2.0", ["apache2.license", "apache2.licensor"]),
    ("GPL-3.0", ["gpl3.free", "gpl3.contrast"]),
    ("GPL-2.0", ["gpl2.most", "gpl2.contrast"]),
    ("LGPL-2.1", ["lgpl21.applies"]),
    ("LGPL-3.0", ["lgpl3.version"]),
    ("AGPL-3.0", ["agpl3.free"]),
    ("MPL-2.0", ["mpl2.subject", "mpl2.copy"]),
    ("EPL-2.0", ["epl2.notice"]),
    ("EPL-1.0", ["epl1.notice"]),
    ("Unlicense", ["unlicense.free"]),
    ("CC0-1.0", ["cc0.dedicated"]),
    ("Zlib", ["zlib.as-is", "zlib.grant"]),
    ("BSL-1.0", ["bsl.grant"]),
    ("WTFPL", ["wtfpl.copies"]),
]
GAP = 3
#: Shorter sentences aren't looked up: "Under MIT" has 9 characters.
LEAST = 9
#: A sentence ends at a line end, or at one of . ! ? before white space.
CUT = r"(?<=[.!?])[ \t]+|[\r\n]+"
#: In running text it ends at . ! ? before white space, before a list of conditions, after a line that ends in an address, and at a
#: line without letters and digits unless an address follows.
RUNNING = r"(?<=[.!?])\s+|(?<=conditions:|are met:|restrictions:)\s+|\n(?<=https?://\S{1,300}\n)|\n[^\p{L}\p{N}\n]*\n(?![^\p{L}\p{N}]*https?://)"
NOT_WORD = "[^a-z0-9]+"
NOTICE = "licensed under"
#: What a normalised sentence becomes: frames of notices by name, what follows the name, and named persons and programs.
REWRITES = [
    ("^(?:this|the|our|all) (?:[a-z]+ )?(?:work|project|software|program|file|code|library|package|module|repository|crate|plugin|product|data|dataset|documentation) (?:is|are) (?:dual )?((?:licensed|released|distributed|made available|available|published|provided) under )", r"\1"),
    ("^(?:licensed|released|distributed|made available|available|published|provided) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", NOTICE + " "),
    ("^spdx license identifier ", NOTICE + " "),
    ("^licen[cs]e (?:type )?", NOTICE + " "),
    (" (?:please )?see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)(?: file| md| txt)*(?: for (?:more |further )?(?:details|information))?$", ""),
    ("^neither the names? of .{1,200}? nor the names of (?:its|their|any|the) contributors", "neither the name of x nor the names of its contributors"),
    ("^.{1,60}? is (free software you can redistribute it|distributed in the hope that it will be useful)", r"this program is \1"),
    ("^all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
]


def normalise(sentence: str) -> str:
    out = re.sub(NOT_WORD, " ", sentence.lower()).strip(" ")
    for old, new in REWRITES:
        out = re.sub(old, new, out)
    return out


def _normal(c: Column) -> Column:
    out = F.trim(F.regexp_replace(F.lower(c), NOT_WORD, " "))
    for old, new in REWRITES:
        out = F.regexp_replace(out, old, new.replace("\\", "$"))
    return out


def names() -> dict[str, list[str]]:
    """All licence identifiers with the names that may stand in a notice, those of families made from their parts."""
    out = {i: list(n) for i, n in NAMES.items()}
    for family, short, long, versions in GNU:
        for v in versions:
            w = v.removesuffix(".0")
            of = [f"{family}v{w}", f"{family} v{w}", f"{family}-{w}", f"{short} v{w}", f"{short} version {w}", f"{short} {w}"]
            of += [f"{x}{mid}{y}" for x in long for mid in (", version ", " version ", " v", " ") for y in dict.fromkeys([w, v])]
            out[f"{family}-{v}"] = [x + end for x in [*of, f"{family}-{v}"] for end in ("", " only", " or later", "+", " or any later version", ", or (at your option) any later version")]
    for kind in COMMONS_KINDS:
        full = "-".join(COMMONS[p] for p in kind.split("-"))
        for v in COMMONS_VERSIONS:
            out[f"CC-{kind}-{v}"] = [f"{x} {v}{end}" for x in (f"CC {kind}", f"Creative Commons {full}", f"Creative Commons {kind}") for end in ("", " International", " Unported", " Generic", " International License", " Unported License", " License")]
    return {i: [i, f"{i} License", *n] for i, n in out.items()}


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier: the sentences of ``SENTENCES``, notices of GNU licences, and notices by name."""
    out = {}
    for licence, of in names().items():
        for n in of:
            for one in {n, re.sub("License", "Licence", n), re.sub("Licence", "License", n)}:
                out.setdefault(normalise(f"Licensed under {one}"), f"notice.{licence}")
    for family, _, long, versions in GNU[:3]:
        for v in versions:
            w = v.removesuffix(".0")
            for x in long:
                for end in (f", either version {w} of the License, or (at your option) any later version.", f", version {w} of the License.", f", version {w}.", f" version {w} only.", f", either version {w} of the License, or any later version."):
                    out[normalise(GNU_FREE.format(x) + end)] = f"free.{family}-{v}"
    return out | {normalise(s): i for s, i in SENTENCES.items()}


def all_rules() -> list[tuple[str, list[str]]]:
    ids = dict.fromkeys(known_sentences().values())
    return RULES + [(i.split(".", 1)[1], [i]) for i in ids if i.split(".")[0] in ("notice", "free")]


def contained(rules: list[tuple[str, list[str]]]) -> list[list[int]]:
    """For each rule the numbers of the longer ones that begin like it and have its identifiers in order."""

    def within(a: list[str], b: list[str]) -> bool:
        rest = iter(b)
        return len(a) < len(b) and a[0] == b[0] and all(x in rest for x in a)

    return [[j for j, (_, b) in enumerate(rules) if within(a, b)] for _, a in rules]


#: Parts of words, of which every known sentence has one as it stands in a text; a text without any isn't cut.
MARKS = ["licen", "permission", "permitted", "redistribut", "software", "under", "freedom", "contrast", "distributed"]


HITS = "array<struct<license:string,ids:array<string>,nth:int,over:array<int>,at:array<int>>>"


def recognise(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, gap: int = GAP) -> DataFrame:
    """``docs`` with ``found`` array<struct<place int, id string>> and ``licenses`` array<string>, sorted and distinct.

    ``found`` has the known sentences in order, places counted from 0 over the sentences cut at line ends; one that goes over
    several lines has the place of its first. Of a null or empty text both are empty. A sentence that occurs twice is found
    twice. In running text places count sentences, and those without a letter (list numbers) don't count. Columns of these
    names in ``docs`` are replaced; other columns stay. ``sentences`` maps normalised sentences to identifiers.
    """
    sentences, rules = sentences or known_sentences(), rules or all_rules()
    least = LEAST
    lookup = F.from_json(F.lit(json.dumps(sentences)), "map<string,string>")
    table = [{"license": n, "ids": ids, "nth": i, "over": over} for i, ((n, ids), over) in enumerate(zip(rules, contained(rules), strict=True))]
    rows = F.from_json(F.lit(json.dumps(table)), "array<struct<license:string,ids:array<string>,nth:int,over:array<int>>>")
    taken = set(docs.columns) | {"found", "licenses"}
    lines_, raw_, running_, hits_, wide_ = (fresh(n, taken) for n in ("_lines", "_raw", "_running", "_hits", "_wide"))

    def known(parts: Column, *more: str) -> Column:
        near = F.transform(parts, lambda s: s.withField("id", F.when(F.length(s["s"]) >= least, _normal(s["s"]))))
        return F.transform(F.filter(near, lambda x: x["id"].isin(*sentences)), lambda x: F.struct(x["place"].alias("place"), F.element_at(lookup, x["id"]).alias("id"), *(x[m].alias(m) for m in more)))

    def numbered(parts: Column) -> Column:
        return F.transform(parts, lambda s, i: F.struct(i.alias("place"), s.alias("s"), i.alias("at")))

    def places(f: str, one: Column) -> Column:
        return F.transform(F.filter(f, lambda x: x["id"] == one), lambda x: x["place"])

    def begins(f: str, r: Column) -> Column:
        """Places at which a rule begins: those of its first identifier from which the others follow, found from the last back."""
        return F.aggregate(
            F.reverse(F.slice(r["ids"], 1, F.size(r["ids"]) - 1)),
            places(f, F.element_at(r["ids"], -1)),
            lambda after, one: F.filter(places(f, one), lambda p: F.exists(after, lambda q: (q > p) & (q - p <= gap + 1))),
        )

    def matched(f: str) -> Column:
        """The rules that match, with the places at which they begin."""
        some = F.filter(rows, lambda r: F.exists(f, lambda x: x["id"] == r["ids"][0]))
        return F.filter(F.transform(some, lambda r: r.withField("at", begins(f, r))), lambda r: F.size(r["at"]) > 0)

    def left(hits: str) -> Column:
        """Those that begin somewhere without a longer rule that has them."""
        return F.filter(hits, lambda r: F.exists(r["at"], lambda p: ~F.exists(hits, lambda o: F.array_contains(r["over"], o["nth"]) & F.array_contains(o["at"], p))))

    marked = F.coalesce(F.lower(text).rlike("|".join(MARKS)), F.lit(False))
    whole = F.when(marked, F.col(text)).otherwise(F.lit(""))
    out = docs.withColumn(lines_, known(numbered(F.split(whole, CUT)))).withColumn(raw_, F.split(F.regexp_replace(whole, r"\r\n?", "\n"), RUNNING))
    lettered = F.filter(numbered(F.col(raw_)), lambda x: x["s"].rlike(r"\p{L}"))
    out = out.withColumn(running_, known(F.transform(lettered, lambda x, i: x.withField("place", i)), "s", "at"))
    # the place by lines of a sentence of several lines: how many sentences the text before it has
    before = lambda x: F.when(x["at"] == 0, 0).otherwise(F.size(F.split(F.array_join(F.slice(raw_, 1, x["at"]), "\n"), CUT)))
    several = lambda x: F.size(F.filter(F.split(x["s"], "\n"), lambda line: _normal(line) != "")) > 1
    wrapped = F.transform(F.filter(running_, several), lambda x: F.struct(before(x).alias("place"), x["id"].alias("id")))
    out = out.withColumn("found", F.when(F.size(running_) == 0, F.col(lines_)).otherwise(F.array_sort(F.concat(lines_, wrapped))))
    none = F.array().cast(HITS)
    out = out.withColumn(hits_, F.when(F.size(lines_) > 0, matched(lines_)).otherwise(none)).withColumn(wide_, F.when(F.size(running_) > 0, matched(running_)).otherwise(none))
    by_line = F.filter(left(hits_), lambda r: ~F.exists(wide_, lambda o: F.array_contains(r["over"], o["nth"])))
    licences = F.transform(F.concat(by_line, left(wide_)), lambda r: r["license"])
    return out.withColumn("licenses", F.array_sort(F.array_distinct(licences))).drop(lines_, raw_, running_, hits_, wide_)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    out = recognise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """The same from sentences of one line: lists of identifiers are joined sentence by sentence."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in known_sentences().items())
    rules = all_rules()
    listed = ", ".join(f"({n}, {quote(name)}, [{', '.join(map(quote, ids))}], {over}::INT[])" for n, ((name, ids), over) in enumerate(zip(rules, contained(rules), strict=True)))
    normal = f"trim(regexp_replace(lower(s), '{NOT_WORD}', ' ', 'g'))"
    for old, new in REWRITES:
        normal = f"regexp_replace({normal}, '{old}', '{new}')"
    longest = max(len(ids) for _, ids in rules)
    chains = []
    for n in range(1, longest + 1):
        joins = "".join(f" JOIN found f{k} ON f{k}.doc_id = f1.doc_id AND f{k}.id = r.ids[{k}] AND f{k}.place > f{k - 1}.place AND f{k}.place - f{k - 1}.place <= {GAP + 1}" for k in range(2, n + 1))
        chains.append(f"SELECT DISTINCT f1.doc_id, r.nth, r.license, r.over_, f1.place AS at FROM rules r JOIN found f1 ON f1.id = r.ids[1]{joins} WHERE len(r.ids) = {n}")
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(nth, license, ids, over_) AS (VALUES {listed}),
parts AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n]+', chr(1), 'g'), '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(p))) AS place, unnest(p) AS s FROM parts),
found AS (SELECT doc_id, place, id FROM (SELECT doc_id, place, {normal} AS n FROM numbered WHERE length(s) >= {LEAST}) JOIN known ON n = sentence),
matched AS ({' UNION ALL '.join(chains)}),
kept AS (SELECT DISTINCT doc_id, license FROM matched m WHERE NOT EXISTS (SELECT 1 FROM matched o WHERE o.doc_id = m.doc_id AND o.at = m.at AND list_contains(m.over_, o.nth))),
per AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id),
listed AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS l FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(l, '') AS licenses FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN listed USING (doc_id)"""


ORACLE_SQL = _oracle()
