import duckdb

from auditlake.llm import licences
from llm_helpers import no_documents, odd_documents


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.n_sentences, r.licences) for r in licences.scan(docs).orderBy("doc_id").collect()]


def test_sentences_and_rules(spark):
    bsd = [licences.SENTENCES[x] for x in ("bsd-forms", "bsd-source", "bsd-binary", "bsd-names")]
    texts = [
        "Some text.\nReleased under the MIT License.", "text without a stop\nLicensed under the Apache License, Version 2.0.\nmore", "We like the MIT License.",
        ". ".join(bsd) + ".", ". Other words here. ".join(bsd[:3]) + ".", ". ".join(reversed(bsd)) + ".",
        "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.",
        "See. Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without fee is hereby granted, provided that\nthe above copyright notice and this permission notice appear in all copies.",
    ]
    assert found(spark, *texts) == [
        (1, "MIT"), (1, "Apache-2.0"), (0, ""), (4, "BSD-3-Clause"), (3, "BSD-2-Clause"), (4, ""), (3, "CC-BY-NC-4.0,GPL-3.0-only"), (1, "ISC"),
    ]


def test_odd_rows(spark):
    got = licences.scan(odd_documents(spark)).collect()
    assert len(got) == 11 and all((r.n_sentences, r.sentence_ids, r.licences) == (0, "", "") for r in got)
    assert licences.scan(no_documents(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licences.scan(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))

MIT = """MIT License

Copyright (c) 2020 Foo Bar

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
BSD_HEAD = """Copyright (c) 2019, The Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
APACHE = """Copyright 2021 Some Company

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
ISC = """ISC License

Copyright (c) 2018, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
GPL = """Copyright (C) 2015  A Name

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
PUBLISHED = {
    MIT: (4, "MIT"), BSD_HEAD + BSD_TAIL: (5, "BSD-2-Clause"), BSD_HEAD + BSD_NAMES + BSD_TAIL: (6, "BSD-3-Clause"), APACHE: (4, "Apache-2.0"), ISC: (3, "ISC"),
    GPL: (4, "GPL-3.0-or-later"),
}


def test_published_texts(spark):
    """Unaltered, without blank lines, as comments, with other line ends, between prose, and one after the other."""
    ways = [
        lambda t: t, lambda t: t.replace("\n\n", "\n"), lambda t: "".join(f"# {x}\n" for x in t.splitlines()), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */",
        lambda t: t.replace("\n", "\r\n"), lambda t: f"Some prose here. It goes on\n\n{t}\n\nand ends. Not with a full stop",
    ]
    texts = [way(t) for t in PUBLISHED for way in ways]
    got = found(spark, *texts)
    want = [x for x in PUBLISHED.values() for _ in ways]
    want[1] = (3, "MIT")  # without blank lines the two parts of the grant run together
    assert got == want
    assert found(spark, MIT + "\n" + APACHE, GPL + MIT) == [(8, "Apache-2.0,MIT"), (8, "GPL-3.0-or-later,MIT")]


def test_every_sentence_has_a_telling_word():
    assert all(any(x in sentence for x in licences._TELLING) for sentence in licences.SENTENCES.values())


def test_equals_its_sql(spark):
    texts = [*PUBLISHED, *(t.replace("\n\n", "\n") for t in PUBLISHED), None, "", "Released under the MIT License.\nmore", "a\n* Neither\n- This is free and unencumbered software released into the public domain."]
    texts += ["Line one\nReleased under the MIT License\nThis is free and\nunencumbered software released into the public domain.", "word " * 50_000 + "\n\n" + MIT]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    documents = docs.toArrow()  # noqa: F841, read by the SQL
    got = sorted(map(tuple, licences.scan(docs).collect()))
    assert got == sorted(duckdb.sql(licences.scan_sql()).fetchall()) and sum(r[1] for r in got) > 40
