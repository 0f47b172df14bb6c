"""Operators on texts against brute force and the libraries, with nulls, empties, ties, repeats and long texts."""

import array
import hashlib
import itertools
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from sievelight.llm import bpe, common, decontaminate, license_scan, near_dedup, substring_dedup, textkit, token_counts, toxicity
from sievelight.llm.automaton import SuffixAutomaton
from sievelight.llm.components import components
from sievelight.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t", "one", "é" * 50, "x\x1cy\x85z  w"]


def corpus(seed, n, low, high, vocabulary=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))) for _ in range(vocabulary)]
    return rng, [" ".join(rng.choice(words) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def test_words_and_grams():
    texts = [*ODD, "a b\tc  d", "long " * 3000]
    got = []
    for w in textkit.words(pa.array(texts)):
        for r in range(w.rows):
            lo, hi = w.first[r], w.first[r + 1]
            got.append(w.text(lo, hi))
    assert got == [WORD.findall(t or "") for t in texts]
    w = next(textkit.words(pa.array(["a b c a b c"])))
    g = textkit.Grams(w.hash)
    assert g.of(np.array([0]), 3)[0] == g.of(np.array([3]), 3)[0] != g.of(np.array([1]), 3)[0]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(frame, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rng, texts = corpus(1, 12, 30, 120, 400)
    for i in range(60):  # chains of edits
        w = rng.choice(texts).split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), "a b c", "A b\nc", "a b c d", *ODD]
    rows = list(enumerate(texts, 10))
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(rows), num=85).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def thue_morse(letters):
    a = [0]
    while len(a) < letters:
        a += [1 - x for x in a]
    return "".join("ab"[x] for x in a[:letters]), "".join("ba"[x] for x in a[:letters])


def test_words_made_to_collide(frame):
    """Under polynomial hashes modulo a power of two these words, and these orders of two words, are equal."""
    for letters in (512, 2048):
        one, two = thue_morse(letters)
        w = next(textkit.words(pa.array([f"{one} {two}"])))
        assert w.hash[0] != w.hash[1] and w.other[0] != w.other[1]
        w = next(textkit.words(pa.array([" ".join(one), " ".join(two)])))
        g = textkit.Grams(w.hash)
        a, b = g.of(w.first[:-1], letters)
        assert a != b and g.of(w.first[:-1], np.diff(w.first)).tolist() == [a, b]
    one, two = thue_morse(512)
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}")]
    same = near_dedup.near_duplicates(frame(rows), num=99).collect()
    assert {r.doc_id: r.component_id for r in same} == {1: 1, 2: 2}
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(frame(rows), digest=True).collect())


def test_near_duplicates_without_a_common_hub(frame, monkeypatch):
    """Members of a bucket that aren't linked with its smallest one are, with each other; none of a big component is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    rng, base = corpus(21, 3, 90, 100, 5000)
    rows = []
    for t in base:
        w = t.split(" ")
        for i in range(12):  # variants that share 80 words of 90 with the base and differ from each other
            v = list(w)
            at = rng.randrange(len(v) - 12)
            v[at : at + 10] = [f"x{len(rows)}y{k}" for k in range(10)]
            rows.append((len(rows), " ".join(v)))
            rows.append((len(rows), " ".join([*v[:-1], "end"])))
    sets = {i: {tuple(t.split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)} for i, t in rows}
    want = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in sets}
    for _ in range(6):
        want = {i: min(want[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])) for i in sets}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(rows), num=85).collect()}
    assert got == want and len(set(want.values())) > 3


def test_near_duplicates_of_an_id_with_two_texts(frame):
    _, texts = corpus(22, 2, 60, 80, 900)
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " more"), (3, texts[1] + " more"), (4, "on its own")]
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_near_duplicates_empty_and_null_ids(frame):
    assert near_dedup.near_duplicates(frame([])).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(frame([(None, "a b c d e f"), (7, "a b c d e f")])).collect()] == [(7, 2, 7)]


def test_keep_first_keeps_null_ids(frame):
    rows = [(None, "a b c d e f"), (None, "quite another text than the rest"), (7, "a b c d e f"), (8, "a b c d e f"), (9, "x")]
    out = near_dedup.keep_first(frame(rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in out) == [(False, 0, rows[0][1]), (False, 0, rows[1][1]), (True, 7, rows[2][1]), (True, 9, "x")]


def test_packed_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.5, 0.85, 1.0):
        k = int(3000 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 3000 - k, dtype=np.uint64)])
        p = near_dedup.pack(near_dedup.minima([a, b]))
        assert abs(near_dedup.estimate(p[0], p[1:])[0] - share) < near_dedup.MARGIN


def test_automaton():
    rng = random.Random(2)
    refs = [([rng.choice("ab") for _ in range(rng.randrange(1, 25))], d) for d in range(8)]
    sam = SuffixAutomaton()
    for tokens, d in refs:
        sam.add(tokens, d)
    sam.finish()
    for _ in range(20):
        q = [rng.choice("abc") for _ in range(20)]
        joined = ["".join(t) for t, _ in refs]
        for i, n in enumerate(sam.matching(q)):
            s = "".join(q[: i + 1])
            assert n == max(k for k in range(i + 2) if any(s[len(s) - k :] in j for j in joined))
        for i, owner in enumerate(sam.owners(q, 4)):
            s = "".join(q[i : i + 4])
            assert owner == min((d for (_, d), j in zip(refs, joined, strict=True) if s in j), default=None)


def removed(rows, span=50):
    first, out = {}, {}
    rows = sorted(rows, key=lambda r: r[0])
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - span + 1):
            first.setdefault(tuple(w[k : k + span]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < i:
                keep[k : k + span] = [False] * span
        left = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out[i] = (len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("shard", "hot"), [(512, 128), (2, 128), (2, 2)])
def test_substring_dedup(frame, monkeypatch, shard, hot):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", shard)
    monkeypatch.setattr(common, "LEAST_HOT", hot)
    rng, texts = corpus(3, 14, 10, 160, 200)
    passage = texts[0].split(" ") + texts[1].split(" ")
    for _ in range(14):  # a passage in ever-changing surroundings
        k = rng.randrange(len(passage) - 30)
        texts.append(" ".join([*rng.choice(texts[2:14]).split(" ")[: rng.randrange(40)], *passage[k : k + rng.randrange(45, 120)], *rng.choice(texts[2:14]).split(" ")]))
    texts += [texts[4], texts[4].replace(" ", "\t "), "w " * 120, "w " * 90, *ODD]
    rows = list(enumerate(texts, 5))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(rows), digest=True).collect()}
    assert got == removed(rows)
    assert sum(x[1] for x in got.values()) > 300


def test_substring_dedup_keeps_rows(frame):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame([(1, text), (2, "x  " + text + " y"), (3, None), (None, text)])
    out = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs.selectExpr("*", "0L as n_chars")).collect()}
    assert out == {1: text, 2: "x y", 3: None, None: text}
    assert substring_dedup.remove_repeats(frame([])).count() == 0
    clash = docs.selectExpr("doc_id", "text", "9 as kept", "8 as n_removed", "7 as `a.b`")
    out = {r.doc_id: (r.text, r.kept, r.n_removed, r["a.b"]) for r in substring_dedup.without_repeats(clash).collect()}
    assert out[2] == ("x y", 9, 8, 7) and out[3] == (None, 9, 8, 7) and len(out) == 4


@pytest.fixture(scope="module")
def tok():
    return bpe.WordBPE(bpe.TOKENIZER), Tokenizer.from_file(bpe.TOKENIZER)


def test_bpe_equals_library(tok, frame):
    mine, lib = tok
    rng, texts = corpus(6, 30, 1, 80)
    texts += ["Hello's WORLD<|endoftext|>x <|startoftext|>", "İstanbul ΣΑΣ é a\x1cb\x85c　d ́x 123 ’s I'LL", "日本語テキスト です", "a" * 3000, "ab" * 2500, "!?" * 900]
    texts += ["".join(rng.choice(["in", "the", "ing", "tion", "an", "er", "s", "ha"]) for _ in range(1500)), *[t or "" for t in ODD]]
    want = {}
    for i, t in enumerate(texts):
        e = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(e), hashlib.sha256(array.array("I", e).tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in bpe.digests(frame(texts)).collect()} == want
    assert bpe.digests(frame([None])).first().n_tokens == 0 and bpe.digests(frame([])).count() == 0
    ids = bpe.decode(bpe.encode(frame(["Hello, Wörld", None]))).orderBy("doc_id").collect()
    assert ids[0].decoded == "hello , wörld " and ids[1].decoded == ""


def test_bpe_equals_library_on_every_character(tok, frame):
    """Through the query's path: all code points between letters, reordered marks, and texts over several blocks."""
    mine, lib = tok
    rng = random.Random(12)
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b " for c in points[lo : lo + 500]) for lo in range(0, len(points), 500)]
    marks = [c for c in points if unicodedata.combining(c)] + [chr(c) for c in (0x1ACC, 0x1AC5, 0x1B72, 0x558, 0x1C89, 0xA7CB, 0xA7DA)]
    texts += [" ".join("e" + "".join(rng.choice(marks) for _ in range(rng.randrange(1, 5))) for _ in range(300)) for _ in range(40)]
    texts += ["".join(rng.choice(points) for _ in range(2000)), "x" * 40000 + " y " * 20000, "Word " * 9000 + "<|endoftext|>" + " tail" * 9000, "\x00\x01 a\x02b"]
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(frame(texts)).collect()}
    for i, t in enumerate(texts):
        e = lib.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(e), hashlib.sha256(array.array("I", e).tobytes()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()), i


def test_bpe_parts_are_bounded(tok):
    mine, _ = tok
    chunk = mine.bpe.chunk
    for text in ("the " * 200_000, "the" * 300_000):
        assert max(len(ids) for ids in mine.stream(text)) <= bpe.BLOCK * 2
    assert mine.bpe.chunk == chunk and "".join(bpe.blocks("a b  c" * 9000)) == "a b  c" * 9000


def test_lookahead_bounds_the_stream(tok):
    mine, _ = tok
    rng = random.Random(9)
    for _ in range(6):
        s = [mine.alphabet[ord(rng.choice("inthanre"))] for _ in range(4000)]
        whole = mine.bpe.merge([*s[:-1], s[-1] + "</w>"])
        assert list(mine.bpe.tokens(iter(s))) == whole
    small = bpe.StreamingBPE([("a", "b"), ("ab", "a"), ("b", "a"), ("ba", "ba")], {})
    assert small.lookahead == 4 or small.lookahead > 0
    for _ in range(200):
        s = [rng.choice("ab") for _ in range(rng.randrange(1, 60))]
        assert list(small.tokens(iter(s))) == small.merge([*s[:-1], s[-1] + "</w>"])


def test_incremental_decoder(tok):
    mine, _ = tok
    ids = [i for w in "naïve 日本 \U0001f600".split() for i in mine.ids(w)]
    parts = list(mine.surfaces.text(ids))
    assert "".join(parts) == "naïve 日本 \U0001f600 "
    broken = next(i for i, b in enumerate(mine.surfaces.bytes) if b == b"\xe6")
    assert "".join(mine.surfaces.text([broken])) == "�"


def test_token_counts_equal_word_piece(frame):
    initial, later = token_counts.word_pieces(token_counts.VOCABULARY)
    a = token_counts.Automaton(initial, later)
    vocab = {}
    for p in [*initial, *("##" + x for x in later), "[UNK]"]:
        vocab.setdefault(p, len(vocab))
    lib = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**6)
    _, texts = corpus(8, 10, 50, 90, 500)
    words = {w for t in texts for w in t.split()} | {"日本", "x日", "unbelievable", "Straße", "ééé", "a" * 400, "\x00a"}
    for w in words:
        pieces = [t.value for t in lib.tokenize(w)]
        assert a.count(w) == (-1 if pieces == ["[UNK]"] else len(pieces)), w
    tiny = token_counts.Automaton(["ab", "a", "abcd"], ["c", "cd", "b", "x"])
    assert [tiny.count(w) for w in ("ab", "abc", "abcd", "abcx", "abce", "")] == [1, 2, 1, 3, -1, 0]
    rows = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(frame([None, "", "hello hello", "\x00"])).collect()}
    assert rows[0] == rows[1] == (0, 0, 0) and rows[2][0] == 2 and rows[3] == (1, 1, 1)


GRANT = next(s for s, i in license_scan.SENTENCES.items() if i == "mit.grant")
NOTE = next(s for s, i in license_scan.SENTENCES.items() if i == "mit.notice")


def test_license_scan(frame):
    texts = ["x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0. Released  under the MIT license!", GRANT + "\nA.\nB.\n" + NOTE, GRANT + "\na" * 5 + "\n" + NOTE, NOTE + "\n" + GRANT, *ODD[:4]]
    docs = frame(texts).selectExpr("*", "1 as _lines", "2 as found", "3 as _hits")
    rows = {r.doc_id: r for r in license_scan.recognise(docs).collect()}
    assert [rows[i].licenses for i in range(9)] == [["MIT"], ["Apache-2.0", "MIT"], ["MIT"], [], [], [], [], [], []]
    assert [f.id for f in rows[4].found] == ["mit.notice", "mit.grant"] and rows[4]["_lines"] == 1 and rows[4]["_hits"] == 3
    assert license_scan.recognise(frame([])).count() == 0


def test_license_sentences():
    known, rules = license_scan.known_sentences(), license_scan.all_rules()
    assert len(known) > 2000 and len({n for n, _ in rules}) > 90
    assert all(any(m in s for m in license_scan.MARKS) and len(s) >= license_scan.LEAST for s in known)
    assert {i for _, ids in rules for i in ids} <= set(known.values())
    for i in license_scan.names():
        assert known[license_scan.normalise(f"SPDX-License-Identifier: {i}")] == f"notice.{i}"


def test_license_notices_by_name(frame):
    said = {
        "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "This work is licensed under a thing of our own.": "",
        "Made available under the terms of the Eclipse Public License v2.0": "EPL-2.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This library is distributed under the GNU Lesser General Public License, version 2.1 or later.": "LGPL-2.1",
        "License: Apache-2.0": "Apache-2.0",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1",
        "You are licensed under no law.": "",
        "Released under GPLv3.": "GPL-3.0",
    }
    got = {r.doc_id: ",".join(r.licenses) for r in license_scan.recognise(frame(list(said))).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())


MIT_TEXT = """MIT License

Copyright (c) 2024 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
BSD_TEXT = """Copyright (c) 2024, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_TEXT = """/*
 * Copyright 2024 A. Person
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS.
 */
"""
GPL3_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
GPL2_TEXT = GPL3_TEXT.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL_TEXT = GPL2_TEXT.replace("This program", "Foo").replace("version 2 of", "version 2.1 of").replace("GNU General", "GNU Lesser General")
AGPL_TEXT = GPL3_TEXT.replace("GNU General", "GNU Affero General")
BSD2_TEXT = BSD_TEXT[: BSD_TEXT.index("3. Neither")] + "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS.\n"
BSD4_TEXT = BSD_TEXT.replace("3. Neither the name of the copyright holder", """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement: This product includes
   software developed by the Example.

4. Neither the name of the Example""")
ISC_TEXT = """Copyright (c) 2024 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
MPL_TEXT = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int x;
"""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software.
"""


def test_license_scan_of_whole_texts(frame):
    whole = [MIT_TEXT, BSD_TEXT, APACHE_TEXT, GPL3_TEXT, GPL2_TEXT, LGPL_TEXT, AGPL_TEXT, BSD2_TEXT, BSD4_TEXT, ISC_TEXT, MPL_TEXT, ZLIB_TEXT, UNLICENSE_TEXT]
    want = ["MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "AGPL-3.0", "BSD-2-Clause", "BSD-4-Clause", "ISC", "MPL-2.0", "Zlib", "Unlicense"]
    commented = ["".join(f"# {line}\n" for line in t.splitlines()) for t in whole]
    texts = [*whole, *commented, *(t.replace("\n", "\r\n") for t in whole), BSD_TEXT + "\n" + BSD2_TEXT, MIT_TEXT.replace("copies or substantial", "copies or large"), *(" ".join(t.split()) for t in (GPL3_TEXT, GPL2_TEXT))]
    rows = {r.doc_id: r for r in license_scan.recognise(frame(texts)).collect()}
    assert [rows[i].licenses for i in range(3 * len(whole))] == [[w] for w in want] * 3
    assert [rows[i].licenses for i in range(3 * len(whole), len(texts))] == [["BSD-2-Clause", "BSD-3-Clause"], [], ["GPL-3.0"], ["GPL-2.0"]]
    once = license_scan.recognise(frame(["a. |\nReleased under the MIT License."])).first()
    assert [f.id for f in once.found] == ["notice.MIT"]  # a line of marks before it isn't a line of the sentence
    assert [(f.place, f.id) for f in rows[4].found] == [(0, "free.GPL-2.0"), (4, "gnu.warranty")]


def test_item_words():
    texts = ["Hello, (WORLD)! a--b ... 'x' !?", "É,", None, "...", "a .b", "x, y"]
    got = []
    for w in decontaminate.item_words(pa.array(texts)):
        got += [w.text(w.first[r], w.first[r + 1]) for r in range(w.rows)]
        same = textkit.word_digests(np.frombuffer(b"worldx", np.uint8), np.array([5, 1]), None)
        assert w.hash[1] == same[0, 0] and w.hash[-2] == same[1, 0]
    assert got == [["hello", "world", "a--b", "x"], ["é"], [], [], ["a", "b"], ["x", "y"]]


def test_decontamination(frame, monkeypatch):
    rng, texts = corpus(11, 25, 60, 200, 900)
    items = [" ".join(rng.choice(texts).split(" ")[5 : 5 + n]) for n in (40, 25, 60)] + ["three short words", "solo", ""]
    extra = [f"{texts[3]} {items[0].upper()}, {texts[4]}", items[1].replace(" ", " \n"), "has three short, words inside", "alone", *ODD]
    w = items[2].split(" ")
    extra += [" ".join([*w[:30], "other", *w[31:]]), " ".join([*w[:20], "o", "p", "q", *w[35:]])]
    docs = [*texts, *extra]
    frame_items = frame(list(enumerate(items))).selectExpr("doc_id as item_id", "text")

    def norm(t):
        return WORD.findall(re.sub(r"(?<![^\x20\x09-\x0D])[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+(?![^\x20\x09-\x0D])", " ", (t or "").lower()))

    def bag(x):
        return Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) if x else Counter()

    want = {}
    for d, t in enumerate(docs):
        x = norm(t)
        for i, item in enumerate(items):
            y = norm(item)
            if x and y:
                best = max(decontaminate.similarity(bag(x[k : k + len(y)]), bag(y)) for k in range(max(1, len(x) - len(y) + 1)))
                if best >= 0.8:
                    want[(d, i)] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(frame(docs), frame_items).collect()}
    assert got == want and len(want) >= 6
    kept = {r.doc_id for r in decontaminate.without_benchmark(frame(docs), frame_items).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in want}
    monkeypatch.setattr(decontaminate, "ITEM_SIZES", 2)  # several passes give the same
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(frame(docs), frame_items).collect()} == want
    assert {r.doc_id for r in decontaminate.without_benchmark(frame(docs), frame_items).collect()} == kept
    odd = frame([(None, items[0]), (None, "clean"), (1, items[0]), (1, "clean")])
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.without_benchmark(odd, frame_items).collect()) == [("1", "clean"), ("None", "clean")]
    assert decontaminate.contaminated(frame(docs), frame([]).selectExpr("doc_id as item_id", "text")).count() == 0


def test_simhashes_of_all_windows(monkeypatch):
    h = np.random.default_rng(3).integers(0, 2**63, 700, dtype=np.uint64)
    for size in (1, 7, 40, 255, 256, 600):
        assert decontaminate.Votes(h).prints(size).tolist() == [decontaminate.simhash(h[a : a + size]) for a in range(len(h) - size + 1)]
    _, texts = corpus(5, 3, 300, 400, 900)
    index = decontaminate.build([1, 2], [" ".join(texts[0].split()[50:75]), " ".join(texts[1].split()[290:299])])
    found = []
    for stretch in (1 << 14, 40):  # whatever the stretches are
        monkeypatch.setattr(decontaminate, "STRETCH", stretch)
        found.append([decontaminate.verified(index, w) for w in decontaminate.item_words(pa.array(texts))])
    assert found[0] == found[1] == [{(0, 0): (1.0, 50), (1, 1): (1.0, 290)}]


def test_hamming_index_returns_all_within_radius():
    rng = random.Random(1)
    index = decontaminate.build(list(range(40)), [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(40)])
    sized = index.sized[30]
    prints = []
    for _ in range(300):
        p = int(sized.prints[rng.randrange(40)])
        for b in rng.sample(range(64), rng.randrange(20)):
            p ^= 1 << b
        prints.append(p)
    at, item = sized.within(np.array(prints, np.uint64))
    want = [(k, i) for k, p in enumerate(prints) for i in range(40) if (int(sized.prints[i]) ^ p).bit_count() <= decontaminate.RADIUS]
    assert sorted(zip(at.tolist(), item.tolist(), strict=True)) == want and len(want) > 150


def labelled(seed, n):
    rng, texts = corpus(seed, n, 20, 120, 3000)
    out = []
    for i, t in enumerate(texts):
        w = t.split(" ")
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vermlin", "quozzard", "snorkwit"]))
        out.append((". ".join([" ".join(w)]), int(i % 4 == 0)))
    return out


def test_toxicity_learns_and_tolerates_gaps(frame, spark):
    train, test = labelled(1, 400), labelled(2, 200)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    docs = frame([t for t, _ in test])
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((score[i] >= 0.5) == (y == 1) for i, (_, y) in enumerate(test))
    assert right >= 0.97 * len(test)
    clean = next(t for t, y in test if y == 0)
    odd = [clean + x for x in (" quozzard snorkwit quozzard", " q-u-o-z-z-a-r-d s.n.o.r.k.w.i.t", " q u o z z a r d, s n o r k w i t", " quoozzard snorrkwit vermmlin", "")]
    got = [r.score for r in toxicity.score(frame([*odd, None, ""]), model).orderBy("doc_id").collect()]
    assert min(got[:4]) > 0.5 > max(got[4:]) and got[5] == got[6]
    assert all(0 <= s <= 1 for s in got)
    long = toxicity.score(frame([clean * 300 + " quozzard snorkwit vermlin"]), model).first().score
    assert long > 0.5
    kept = toxicity.without_toxic(frame([*odd, None]), model).count()
    assert kept == 2


def test_toxicity_one_class_and_empty(frame):
    model = toxicity.fit(["a b", "c"], np.array([0, 0]))
    assert toxicity.score(frame(["x", None]), model).where("score < 0.5").count() == 2
    assert toxicity.fit([], np.array([])).table.sum() == 0


def test_toxicity_passes_over_texts_that_do_not_fit(frame, spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_CHARS", 4000)
    drawn = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: drawn.update(zip(texts, y, strict=True)))
    every = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for long in range(8):  # whichever comes first in hash order
        drawn.clear()
        texts = [(i, "z" * 5000 if i % 8 == long else f"text {i}") for i in range(40)]
        toxicity.train(frame(texts), every, held_out=False)
        assert drawn == {t: i % 2 for i, t in texts if i % 8 != long}
    with pytest.raises(ValueError):
        toxicity.train(frame([(i, "z" * 5000 if i % 2 else f"text {i}") for i in range(40)]), every, held_out=False)


def subsequence_vector(word):
    """All weighted subsequences of a unit, by the definition of the kernel."""
    s = [toxicity.OPEN, *(ord(c) - 96 for c in word), toxicity.CLOSE]
    out = Counter()
    for i in itertools.combinations(range(len(s)), toxicity.LENGTH):
        span = i[-1] - i[0] + 1
        if span <= toxicity.SPAN:
            out[tuple(s[k] for k in i)] += toxicity.DECAY**span
    return out


def test_kernel_is_the_normalised_subsequence_kernel():
    """Margins folded into a table, and the vectors of the machine, equal the kernel by its definition."""
    product = lambda a, b: sum(v * b[c] for c, v in a.items())
    words = ["idiot", "idxiot", "other", "iidiioot", "hahahaha", "aaaaaaaa", "x", "ab", "abc", "x" * toxicity.LONG, "abcdefghijklmnopqrst"]
    vectors = [subsequence_vector(w) for w in words]
    lengths = [product(v, v) ** 0.5 for v in vectors]
    u = toxicity.units(*toxicity.points_of([", ".join(words)]))
    assert np.allclose(toxicity.norms(u)[[n > 0 for n in lengths]], [n for n in lengths if n], rtol=1e-6)
    for k in (0, 4, 5):
        table = np.zeros(toxicity.CLASSES**toxicity.LENGTH, np.float32)
        for codes, v in vectors[k].items():
            table[sum(c * toxicity.CLASSES ** (toxicity.LENGTH - 1 - i) for i, c in enumerate(codes))] = v / lengths[k]
        want = [product(vectors[k], v) / lengths[k] / n if n else 0.0 for v, n in zip(vectors, lengths, strict=True)]
        assert np.allclose(toxicity.margins(u, table), want, rtol=1e-4, atol=1e-6) and abs(want[k] - 1) < 1e-9
    row, code, value = toxicity.sparse(u)
    for i in range(len(words)):
        for j in range(len(words)):
            if lengths[i] and lengths[j]:
                a, b = Counter(), Counter()
                for v, at in ((a, i), (b, j)):
                    for c, x in zip(code[row == at].tolist(), value[row == at].tolist(), strict=True):
                        v[c] += x
                assert abs(product(a, b) - product(vectors[i], vectors[j]) / lengths[i] / lengths[j]) < 1e-6


def test_long_units_lose_no_subsequence():
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghij") for _ in range(5 * toxicity.LONG + 3))
    u = toxicity.units(*toxicity.points_of([f"so {word} it"]))
    assert np.diff(u.first).max() == toxicity.LONG + 2 and set(u.row.tolist()) == {0}
    parts = ["".join(chr(96 + c) for c in u.chars[a + 1 : b - 1]) for a, b in zip(u.first[1:-2].tolist(), u.first[2:-1].tolist(), strict=True)]
    step = toxicity.LONG - toxicity.SPAN + 1
    assert parts == [word[k : k + toxicity.LONG] for k in range(0, len(word) - toxicity.LONG + step, step)]
    assert toxicity.units(*toxicity.points_of(["x" * 5_000_000])).first[-1] > 5_000_000


def test_toxicity_of_altered_insults(frame):
    train = labelled(1, 400)
    model = toxicity.fit([t for t, _ in train], np.array([y for _, y in train]))
    clean = next(t for t, y in labelled(2, 40) if y == 0)
    altered = ["quxozzxard snxorkwxit", "quoz zard snork wit", "qu-oz-zard sn*ork*wit", "QUOZZARD! SnOrKwIt?", "qquoozzzard snnorkkwit", "quxxozzard snorkxxwit"]
    got = [r.score for r in toxicity.score(frame([f"{clean} {x}" for x in [*altered, "", "qua zat snow wait"]]), model).orderBy("doc_id").collect()]
    assert min(got[: len(altered)]) > 0.5 > max(got[len(altered) :]), got


def test_op1_query(spark):
    """The query against the operator by hand: labels of the fitting rows alone, whole texts, every row once."""
    rows = QUERIES["op1_toxicity"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    used = sorted((r for r in labels.items() if labels[r[0]] is not None and r[0] in docs and not toxicity.held_out(r[0])))
    h = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i, _ in used], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    used.sort(key=lambda r: (h[r[0]], r[0]))
    model = toxicity.fit([docs[i] for i, _ in used], np.array([int(y > 0) for _, y in used]))
    want = dict(zip(docs, model.document_scores(toxicity.text_margins(model, list(docs.values()))).tolist(), strict=True))
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 and r.held_out == toxicity.held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in rows)
