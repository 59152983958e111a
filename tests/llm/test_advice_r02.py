"""Cases of the second review."""

import numpy as np
from pyspark.sql import functions as F

from tarmac.llm import common, langid, licenses, packing, queries, sharding, simhash

APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Some One

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
BSD = """Copyright (c) 2020, Some One
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

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""


def commented(text):
    return "#!/bin/sh\n" + "".join(f"# {line}".rstrip() + "\n" for line in text.splitlines()) + "run me\n"


def test_wrapped_standard_licences_are_found(spark):
    untitled = APACHE.replace('Licensed under the Apache License, Version 2.0 (the "License");\n', "")
    cases = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD-3-Clause"), (BSD.replace("All rights reserved.\n", ""), "BSD-3-Clause"),
             (BSD[:BSD.index("3. ")], "BSD-2-Clause"), (MIT.replace("MIT License\n\n", ""), "MIT"), (untitled, "Apache-2.0")]
    cases += [(commented(t), want) for t, want in cases] + [(t.replace("\n", "\r\n"), want) for t, want in cases]
    cases += [(" ".join(t.split()), want) for t, want in (cases[0], cases[2])]
    # A known line is found beside lines without a stop, as before.
    cases += [("some words\nMIT License\nmore words", "MIT"), ("***\nAll rights reserved\n***", "proprietary"), ("the\nmit\n\nlicense", "")]
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == [want for _, want in cases]
    assert [r.restricted for r in rows] == [want == "proprietary" for _, want in cases]
    assert rows[1].n_known == 3 and rows[-3].n_sentences == 3


def test_an_id_with_several_texts_keeps_each_group_once(spark):
    a, b = ["".join(f"{w}{i} " for i in range(60)) for w in "ab"]

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept([(5, a), (5, b), (7, b)]) == [(5, a), (5, b)]
    assert kept([(3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept([(5, a), (5, a), (5, b), (None, b), (None, None)]) == [(5, a), (5, b), (None, None)]


def test_stage_keeps_every_identified_language(spark):
    words = {"en": "the house", "de": "ÿber ÿaus", "fr": "ça çela", "es": "ño ñiña"}
    rows = [(i, f"{w} " * 40, lang) for i, (lang, w) in enumerate([*words.items()] * 30)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = [" ".join(f"{w} " * 30 for w in words.values()), "the house " + "Привет " * 40, "Привет мир", "123", None, ""]
    lang, score, _ = langid.predict(model, texts)
    assert 0 < score[0] < 0.3 and 0 < score[1] < 0.3 and lang[1] == "en"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.keep_identified(docs, model).collect()) == [0, 1]


def test_hashed_sample_counts_repeated_rows_once(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    again = spark.range(300_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("en").alias("lang"))
    assert common.hashed_sample(ids.unionByName(again), ["lang"], 1000, 5).count() == 1000


def test_added_tokens_are_the_tokenizers_own(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["page one <|endoftext|> page two", "<|startoftext|>a<|endoftext|><|ENDOFTEXT|> B", "plain text. <| x |>", None]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [2504, 637, 49407, 2504, 1237]
    rows = packing.tokenise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.tokenizer_path())
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in rows.collect()}
    assert got == {i: [*ids, packing.CLOSING] for i, ids in enumerate(want)}


def test_written_pages_of_equal_rows_fit_the_limit(spark, tmp_path):
    rows = [(1, "x" * 100, i) for i in range(55)] + [(2, "y" * 100, i) for i in range(25)] + [(3, "z", 0)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, page int").repartition(5), str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("f", F.input_file_name())
    assert sorted((r.doc_id, r.text, r.page) for r in back.collect()) == sorted(rows)
    files = back.groupBy("f").agg(F.sum(F.length("text")).alias("b"), F.max("doc_id").alias("id")).collect()
    assert all(r.b <= 1000 for r in files) and sorted(r.id for r in files) == [1] * 6 + [2] * 3 + [3]
