"""Each operator against a plain version on whole small tables, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from tests.llm import brute as B
from wattspark.llm import common, crf, decontaminate, groupjoin, langid, licences, mixing, pii, queries as Q, suffixes, token_counts, token_files
from wattspark.llm.tokens import UnitEncoder

LONG = "word%d " * 4000 % tuple(range(4000))
ROWS = [(1, "The quick brown fox jumps over the lazy dog near a@b.example.org today", "en", "s1"), (2, "The quick brown fox jumps over the lazy dog near a@b.example.org today", "en", "s1"),
        (2, "The quick brown fox jumps over the lazy dog near a@b.example.org today", "en", "s1"), (3, None, "en", None), (4, "", None, "s1"), (5, " \n\t ", "de", "s2"), (6, LONG, "en", "s2"),
        (7, LONG + "end", None, "s1"), (None, "No id here, but some words to read anyway, more than ten of them", "en", "s1"), (8, "two words", "de", "s3"),
        (9, "Licensed under CC BY-NC 4.0.", "en", "s1"), (10, "é日本😀" * 300, "fr", "s3"), (11, "x" * 30000, None, None)]
#: names that the operators use inside
EXTRA = ["ids", "n", "sid", "g", "tokens", "h1", "k1", "at", "weight", "topic", "term", "item_id", "hub", "n_tokens", "kept", "held", "tie", "lang_pred"]


@pytest.fixture(scope="module")
def docs(spark):
    return Q.documents(spark, SF0001)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    common.ship(spark)
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# ------------------------------------------------------------------ 1: token files
def test_token_files_hold_the_librarys_ids(spark, docs, rows):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.QUERIES["op1_token_files"](spark, SF0001).collect()}
    assert got == B.token_rows(rows)


def test_token_files_round_trip(spark, odd, empty):
    path = token_files.write_token_files(odd, common.scratch(spark, "t"), Q.vocabulary())
    got = [r for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    tk = B.tokenizer()
    texts = {i: t for i, t, *_ in ROWS}
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.append(0, np.cumsum([r.n_tokens for r in got])[:-1]).tolist()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == tk.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
    path = token_files.write_token_files(empty, common.scratch(spark, "t"), Q.vocabulary())
    assert token_files.read_token_files(spark, path, digest=True).count() == 0


def test_byte_coding_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 9, rng.integers(1, 12))
        values = (rng.integers(0, 1 << 32, counts.sum(), dtype=np.uint64) >> rng.integers(0, 32, counts.sum()).astype(np.uint64)).astype(np.uint32)
        control, n_control, data, n_data = token_files.code(values, counts)
        assert n_control.sum() == len(control) and n_data.sum() == len(data)
        assert (token_files.decode(control, data, counts) == values).all()


# ------------------------------------------------------------------ 5: token counts
def test_units_of_half_a_million_words_are_encoded_once(monkeypatch):
    """The memory was emptied at 420,000 units, so rare words were encoded over and over; long units fill no memory."""
    import pyarrow as pa
    encoder = UnitEncoder(Q.vocabulary())
    made = []
    monkeypatch.setattr(encoder, "_unit", lambda u: made.append(u) or b"\1\0")
    texts = ["x " + " ".join(f"w{i}" for i in range(k, k + 10_000)) for k in range(0, 500_000, 10_000)]
    for _ in range(2):
        for t in texts:
            encoder.encode(pa.array([t]))
    assert len(made) == 500_000
    encoder.encode(pa.array(["x " + "y" * 1000]))
    assert len(made) == 500_001 and len(encoder.seen) == 500_000


def test_spliced_chunks_have_the_ids_of_the_whole_text():
    encoder, rng = UnitEncoder.get(Q.vocabulary()), random.Random(5)
    parts = ["的", "是不", "，", "a", "bc", "don't", "'s", "''ll", "12", "!", "?!", " ", "  ", "\n", "\n\n", "\t", "<|endoftext|>", "<|endof", "é", "e\u0301",
             "\u00a0", "\u3000", "नमस्ते", "🙂", "X" * 30, " the", " \n "]
    for k in range(1500):
        text = "".join(rng.choices(parts if k % 2 else rng.sample(parts, 4), k=rng.randint(0, 300)))
        got = [i for run in token_counts.spliced_ids(encoder, text, rng.choice([20, 33, 64, 200]), rng.choice([2, 4, 16])) for i in run]
        assert got == encoder.tk.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("unit", ["的一是不", "的一是不，", "x" * 3000 + " "])
def test_texts_without_spaces_are_encoded_a_bounded_number_of_times(unit):
    encoder, read = UnitEncoder.get(Q.vocabulary()), []

    class Counting:
        special = encoder.special

        class tk:
            @staticmethod
            def encode(text, add_special_tokens):
                read.append(len(text))
                return encoder.tk.encode(text, add_special_tokens=add_special_tokens)

    for n in (20_000, 80_000):
        text, read = unit * (n // len(unit)), []
        ids = [i for run in token_counts.spliced_ids(Counting, text, 1000, 16) for i in run]
        assert ids == encoder.tk.encode(text, add_special_tokens=False).ids
        assert sum(read) < 8 * n


def test_token_counts(spark, rows, odd, empty):
    want = {i: n - 1 for i, (_, n, _) in B.token_rows(rows).items()}
    got = Q.QUERIES["op5_token_counts"](spark, SF0001).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and {r.doc_id: r.n_bytes for r in got} == {i: len(t.encode()) for i, t in rows}
    small = token_counts.count_tokens(odd, Q.vocabulary(), chunk_chars=64, overlap=4).collect()
    tk = B.tokenizer()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in small) == Counter((i, len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)
    assert token_counts.count_tokens(empty, Q.vocabulary()).count() == 0
    assert token_counts.count_tokens(odd, Q.vocabulary("piece_bpe_32k.model")).count() == len(ROWS)


def test_units_and_splices_equal_the_library():
    encoder, tk = UnitEncoder.get(Q.vocabulary()), B.tokenizer()
    rng = random.Random(7)
    parts = ["foo", "Bar", "'s", " ", "  ", "\n", "\n\n", "\t", "<|endoftext|>", "x²", "Ⅷ", "é", "日本", "123", "_", "...", "don't", "'", "’", " ", " ", "\x1c", "\r\n", "<|", "a\n b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, count = encoder.encode(pa.array(texts))
    for t, got in zip(texts, np.split(ids, np.cumsum(count)[:-1])):
        want = tk.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want
        assert [i for run in token_counts.spliced_ids(encoder, t, 9, 4) for i in run] == want


# ------------------------------------------------------------------ 2: PII
def test_pii_base_spans(spark, rows):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x.com", "1.2.3.4", "300.1", "007", "+1 ", "(555)", "-", " ", "4111 1111 1111 1111", "378282246310005", ".", "_", "%", "é", "日", "😀", "\n", "+44 20 7946 0958", "12"]
    more = [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    rows = rows + more + [(20_000, None), (20_001, "")]
    got = {r.doc_id: r for r in pii.digest(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        spans, r = B.pii_spans(t), got[i]
        text = ",".join(sum(spans, []))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)


def test_pii_terms_that_disclose_an_entity(spark):
    rows = [(i, f"report by gardener Quillfeather for q.f@mail.example.org number {i}") for i in range(4)] + [(10 + i, f"the gardener wrote a report with number {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("kept"))
    terms = {x.term for r in pii.detect(docs).where(F.size("terms") > 0).collect() for x in r.terms}
    assert terms == {"quillfeather"}
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert out[0].text == "report by gardener  for [EMAIL] number 0" and out[10].text == rows[4][1] and out[0].h1 == "kept"
    softer = {r.doc_id: r.text for r in pii.sanitise(docs, remove=1.1).collect()}
    assert softer[0] == "report by gardener [TERM] for [EMAIL] number 0"


def test_pii_terms_at_any_distance(spark):
    far = "plain words about the weather and the harvest " * 3
    # near once and far once; twice in a text; a short name; a number; copies of one text are no evidence
    rows = [(i, f"Quillfeather wrote, {far} to q.f@mail.example.org no {i} {'Quillfeather' if i else far}, signed Kim, box 7714, quillfeather or kim, the rest") for i in range(3)]
    rows += [(10 + i, f"{far} the rest to no {i} signed wrote or box") for i in range(200)] + [(300 + i, f"Hapaxon {far} h@mail.example.org") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert {x.term for r in found.values() for x in r.terms} == {"quillfeather", "kim", "7714"}
    for i, t in rows[:3]:
        want = [(m.start(), m.end()) for m in re.finditer("quillfeather|kim|7714", t.lower())]
        assert [(x.s, x.e) for x in found[i].terms] == want and len(want) >= 5
    assert all(x in r.text.lower() for r in pii.sanitise(docs).where("doc_id >= 300").collect() for x in ("hapaxon", "[email]"))
    assert not any(x in r.text.lower() for r in pii.sanitise(docs).where("doc_id < 3").collect() for x in ("quillfeather", "kim", "7714"))
    alone = {x.term for r in pii.detect(docs, support=1).where("doc_id >= 300").collect() for x in r.terms}
    assert alone == {"hapaxon"}


def test_pii_awkward_rows(odd, empty):
    got = pii.digest(pii.detect(odd)).collect()
    assert len(got) == len(ROWS) and sum(r.n_email for r in got) == 3
    assert pii.digest(pii.detect(empty)).count() == 0
    assert pii.sanitise(odd).columns == odd.columns and pii.sanitise(odd).count() == len(ROWS) and pii.sanitise(empty).count() == 0


# ------------------------------------------------------------------ 3: quality rules
def test_quality_counts_and_accuracy(spark, rows):
    got = {r.doc_id: r for r in Q.QUERIES["op3_quality_lines"](spark, SF0001).collect()}
    for i, t in rows:
        r = got[i]
        n = B.quality_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    labels = [(x.quality, got[x.doc_id].kept) for x in spark.read.parquet(f"{SF0001}/labels.parquet").collect() if not got[x.doc_id].base_failed]
    assert sum((q == 1) == kept for q, kept in labels) >= 0.95 * len(labels)


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        x, step = rng.normal(size=(n, 1)), rng.normal(size=(2, 2))
        got = crf.viterbi(x, np.zeros(n, int), {"unary": [1.0], "step": step.tolist(), "content_only": False})
        score = lambda p: sum(x[i, 0] * s for i, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))
        best = max((tuple(k >> i & 1 for i in range(n)) for k in range(1 << n)), key=score)
        assert score(got.tolist()) == pytest.approx(score(best))


def test_quality_held_out_and_awkward_rows(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = crf.fit(docs, labels.where("doc_id % 2 = 0"))
    got = crf.judge(docs, model).where("NOT base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got) > 50
    assert crf.judge(odd, model).count() == len(ROWS) and crf.judge(empty, model).count() == 0
    assert not any(r.kept for r in crf.judge(odd, model).where("n_words < 10").collect())
    assert crf.keep_good(odd, model).columns == odd.columns and crf.keep_good(empty, model).count() == 0
    none = crf.fit(docs, labels.where("false"))
    assert none["content_only"] and crf.judge(odd, none).where("NOT base_failed AND NOT kept").count() == 0


# ------------------------------------------------------------------ 4, 9: against DuckDB
@pytest.mark.parametrize("name", ["op4_mixing", "op9_licences"])
def test_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    want = con.execute(Q.ORACLE[name])
    cols = [c[0] for c in want.description]
    got = Q.QUERIES[name](spark, SF0001).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 200


def test_mixing_meets_its_targets(spark, docs, odd, empty):
    targets = spark.createDataFrame([("lang", "en", 0.4), ("lang", "de", 0.3), ("lang", "fr", 0.2), ("lang", "es", 0.1), ("topic", "prose", 1.0)] + [("source", f"src{i}", 0.05) for i in range(20)], "dimension string, value string, share double")
    slim, weights = mixing.weigh(docs, sweeps=30, targets=targets)
    tokens = slim.join(weights, list(mixing.DIMENSIONS)).groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("t")).collect()
    total = sum(r.t for r in tokens)
    assert {r.lang: pytest.approx(r.t / total, abs=0.02) for r in tokens} == {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    out = mixing.calibrate(odd)
    assert out.count() == len(ROWS) and out.where("source = '(none)'").count() == 2 and out.where("weight IS NULL OR copies IS NULL").count() == 0
    assert mixing.sample(odd).columns == odd.columns and mixing.sample(empty).count() == 0 and mixing.calibrate(empty).count() == 0


def test_mixing_sample_meets_its_targets(spark):
    counts = {"big": 5000, "rare": 30, **{f"s{i}": 525 for i in range(19)}}
    names = [n for n, k in counts.items() for _ in range(k)]
    docs = spark.createDataFrame([(i, f"ten plain words stand in this text of number {i}", "en", n) for i, n in enumerate(names)], "doc_id long, text string, lang string, source string")
    drawn = mixing.sample(docs)
    got = {r.source: r["count"] for r in drawn.groupBy("source").count().collect()}
    whole, root = sum(got.values()), sum(k ** 0.5 for k in counts.values())
    want = {n: k ** 0.5 / root for n, k in counts.items()}
    assert got["big"] / whole == pytest.approx(want["big"], rel=0.1) and got["rare"] / whole == pytest.approx(want["rare"], rel=0.2)
    assert sum(abs(got[n] / whole - want[n]) for n in counts) < 0.05 and whole == pytest.approx(len(names), rel=0.05)
    copies = [r["count"] for r in drawn.where("source = 'rare'").groupBy("doc_id").count().collect()]
    assert len(copies) == 30 and set(copies) <= {5, 6}


def test_licences(odd, empty, spark):
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software."""
    got = [(r.sentence_ids, r.licences) for r in licences.scan(spark.createDataFrame([(1, grant), (2, "x. Released under the MIT License.\nAll rights reserved."), (3, "Licenses are fine")], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("<MITGrant><MITNotice>", "MIT"), ("<MITRef><AllRights>", "MIT,Proprietary"), ("", "")]
    got = {r.doc_id: r.licences for r in licences.scan(odd).collect()}
    assert got[9] == "CC-BY-NC-4.0" and got[3] == got[4] == "" and licences.scan(odd).count() == len(ROWS) and licences.scan(empty).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some Body

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
"""
ISC = """ISC License

Copyright (c) 2020 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD = """BSD 3-Clause License

Copyright (c) 2020, Some Body

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
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""
GPL3 = GPL2.replace("software;", "software:").replace("Foundation; either version 2", "Foundation, either version 3").replace(" * ", "# ").replace(" *\n", "#\n")
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
APACHE = """# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def scanned(spark, *texts):
    """Identifiers and licences of each text, which the SQL must give as well."""
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    assert sorted(db.execute(licences.oracle()).fetchall()) == [tuple(r) for r in rows]
    return [(r.sentence_ids, r.licences) for r in rows]


def test_published_licence_texts(spark):
    want = [("<MITGrant><MITNotice><MITAsIs><MITLiable>", "MIT"), ("<ISCGrant>", "ISC"), ("<BSDGrant><BSDSource><BSDBinary><BSDNames>", "BSD-3-Clause"),
            ("<GPL2Grant><GPLWarranty>", "GPL-2.0-or-later"), ("<GPL3Grant><GPLWarranty>", "GPL-3.0-or-later"), ("<MPL2Ref>", "MPL-2.0")]
    texts = [MIT, ISC, BSD, GPL2, GPL3, MPL]
    assert scanned(spark, *texts) == want
    assert scanned(spark, *[t.replace("\n", "\r\n") for t in texts]) == want
    # a mark that the published text does not have parts a sentence
    assert scanned(spark, "All rights. Reserved", "Licensed under the Apache License, Version 2.0.\nThe License: see there") == [("", ""), ("<ApacheRef>", "Apache-2.0")]



def test_licences_of_mixed_documents(spark):
    notices = "Licensed under CC BY-NC 4.0\nReleased under the MIT License\nLicensed under the GNU General Public License version 3\n"
    got = scanned(spark, APACHE, MIT + "\n" + notices, notices + MIT, "Some text.\nAll rights\nreserved", "All  rights  reserved.", "x. ALL RIGHTS\r\n * RESERVED. y")
    grant = "<MITGrant><MITNotice><MITAsIs><MITLiable>"
    lines = "<CCBYNC4Ref><MITRef><GPL3Ref>"
    assert got == [("<ApacheHead><ApacheComply><ApacheCopy><ApacheUrl><ApacheAsIs><ApacheSee>", "Apache-2.0"), (grant + lines, "MIT,GPL-3.0,CC-BY-NC-4.0"),
                   (lines + grant, "MIT,GPL-3.0,CC-BY-NC-4.0")] + [("<AllRights>", "Proprietary")] * 3
    assert all(any(t in word for t in licences.WORDS for word in s.split()) for s in licences.SENTENCES)

# ------------------------------------------------------------------ 6: decontamination
def test_leaks(spark, rows, odd, empty):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    rng = random.Random(11)
    more = []
    for k, (_, t) in enumerate(items[:60]):  # inserted, with a word changed, and shortened
        w = t.split()
        changed = list(w)
        changed[rng.randrange(len(w))] = "changed"
        more += [(50_000 + 3 * k, "before it " + t.upper() + " and after"), (50_001 + 3 * k, "x " * 9 + " ".join(changed)), (50_002 + 3 * k, " ".join(w[2:]))]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(9_000, None), (9_001, ""), (9_002, "just three words")], "item_id long, text string")
    want = B.leaks(rows + more, items)
    got = decontaminate.find(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 60
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {i for i, _ in rows + more} - {i for i, _ in want}
    short = spark.createDataFrame([(1, "there are just three words here"), (2, "just two words")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(short, bench).collect()] == [(1, 9_002)]
    assert decontaminate.find(odd, bench).count() == 0 and decontaminate.remove(odd, bench).columns == odd.columns
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.remove(odd, bench.where("false")).count() == len(ROWS)


# ------------------------------------------------------------------ 7: Jaccard classes
def near_copies(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        out.append((100_000 + i, " ".join(w)))
    return out


def test_jaccard_classes(spark, rows):
    rows = rows + near_copies(1, 150) + [(200_000 + i, t) for i, t in enumerate(["a b", "A  b", "a b c", "", None, "a b c d e", "A B C D E f"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in groupjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == B.jaccard_classes(rows)


def test_jaccard_awkward_rows(odd, empty):
    got = groupjoin.classes(odd).collect()
    assert len(got) == len(ROWS) and groupjoin.classes(empty).count() == 0
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[2] == (8, 1) and by[3] == (0, 3) and by[4] == (0, 4) and by[5] == (0, 5) and by[7][1] == 6 and by[None][1] is None
    kept = groupjoin.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, None, 8, 9, 10, 11])


# ------------------------------------------------------------------ 8: language
def test_language_held_out(spark):
    got = {r.doc_id: r for r in Q.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").collect()}
    truth = Q.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang").collect()
    held = [r for r in truth if got[r.doc_id].held_out]
    assert len(got) == 1000 and 150 < len(held) < 350
    assert sum(r.lang == got[r.doc_id].lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_phrases_are_longest_matches():
    rng = random.Random(5)
    train = "".join(rng.choice("abc ") for _ in range(300))
    number = {"a": 3, "b": 4, "c": 5}
    parser = langid.Parser({"alphabet": "abc", "langs": {"x": [number.get(c, langid.SPACE) for c in train]}})
    for _ in range(100):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 200)))
        count, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at:at + n + 1] in train:
                n += 1
            at, count = at + n, count + 1
        phrases, size, letter = parser.phrases([text])
        assert (phrases[0, 0], size[0], letter[0]) == (count, len(text), any(c.isalpha() for c in text))


def test_language_awkward_rows(odd, empty):
    model = langid.fit(odd)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[1].lang_pred == "en" and langid.predict(odd, model).count() == len(ROWS)
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"} and langid.predict(empty, model).count() == 0


# ------------------------------------------------------------------ 10: suffixes
def test_two_stage_sorting_finds_repeats():
    rng = random.Random(5)
    for _ in range(200):
        span = rng.choice([3, 5, 8, 11, 16, 20])
        letters = rng.choice([b"ab", b"abc", b"\x00\xff", bytes(range(256)), b"a"])
        base = bytes(rng.choice(letters) for _ in range(60))
        contexts = []
        for _ in range(rng.randint(1, 12)):
            i = rng.randint(0, 30)
            c = bytearray(base[i:i + rng.randint(span, span + 25)])
            if rng.random() < 0.5:
                c[rng.randrange(len(c))] = rng.choice(letters)
            if len(c) >= span:
                contexts.append(bytes(c))
        windows = [c[i:i + span] for c in contexts for i in range(len(c) - span + 1)]
        count = Counter(windows)
        assert suffixes.repeated(contexts, span).tolist() == [count[w] > 1 for w in windows] if contexts else True


def repeating_rows(rows):
    passage = "passage that stands in several documents, long enough to count. " * 9
    rng = random.Random(9)
    more = [(300_000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80))) + passage[i:] + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(30)]
    return rows + more + [(400_000, "ab" * 900), (400_001, None), (400_002, ""), (400_003, "é" * 500)]


@pytest.mark.parametrize("limit", [suffixes.LIMIT, 2])
def test_repeated_bytes(spark, rows, limit):
    rows = repeating_rows(rows[:120])
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    assert sorted(map(tuple, got)) == sorted(B.repeats(rows))


def test_runs_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    held, full = (rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (suffixes._SLICE - 88, suffixes._SLICE + suffixes.SPAN - 1))
    text, *both = suffixes.runs([held, full])
    alone = suffixes.runs([full])[1:]
    assert len(held) + len(full) > 1 << suffixes._LOW and all((x[text == 1] == y).all() if (text == 1).sum() == len(y) else False for x, y in zip(both, alone))


def test_repeated_bytes_awkward_rows(odd, empty):
    got = sorted(map(tuple, suffixes.dedup(odd, keep_text=True).drop("kept").collect()), key=str)
    assert got == sorted(B.repeats([(i, t) for i, t, *_ in ROWS]), key=str)
    assert suffixes.dedup(empty).count() == 0


# ------------------------------------------------------------------ the pipeline
def test_pipeline(spark, rows):
    import corpus_pipeline as P
    docs = Q.documents(spark, SF0001)
    got, stages = docs, {}
    for name, stage in P.STAGES[:-1]:
        got = common.settle(stage(spark, got, SF0001), name)
        assert got.schema == docs.schema
        stages[name] = [(r.doc_id, r.text) for r in got.collect()]
    kept = {r.doc_id for r in Q.QUERIES["op3_quality_lines"](spark, SF0001).where("kept").collect()}
    assert {i for i, _ in stages["quality"]} == kept
    one = {c for _, c in B.jaccard_classes(stages["quality"]).values()}
    assert sorted(i for i, _ in stages["near_duplicates"]) == sorted(one)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    dirty = {i for i, _ in B.leaks(stages["near_duplicates"], items)}
    assert {i for i, _ in stages["decontaminate"]} == one - dirty
    assert {i for i, _ in stages["mixing"]} <= one - dirty and stages["mixing"]
    last = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, SF0001).collect()}
    assert last == B.token_rows(stages["mixing"])
