"""Licence scans over whole licence texts, and against SQL."""

import textwrap

import pytest

from feedfold.llm import catalog, licenses
from checks.compare import compare, duck

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
software.

The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or
copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or
otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""


def scan(spark, *texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sentences string, rest int")
    rows = sorted(licenses.scanned(docs).collect(), key=lambda r: r.rest.doc_id)
    assert [r.rest.text for r in rows] == list(texts)
    return [(r.sentences, r.licenses, r.unmatched) for r in rows]


def test_texts(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
           "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
           "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
           "distribution.\n{}This software is provided by the copyright holders and contributors \"as is\" and any express or implied "
           "warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose "
           "are disclaimed.")
    endorse = ("3. Neither the name of the X Y nor the names of its contributors may be used to endorse or promote products derived "
               "from this software without specific prior written permission.\n").replace("3. ", "")
    got = scan(
        spark, MIT, MIT.replace("\n", "\r\n"), textwrap.fill(MIT.replace("Software", "software"), 40), bsd.format(""), bsd.format(endorse),
        "Some prose. Licensed under the Apache License, Version 2.0. More prose.\nAll rights reserved.\nlicensed under CC BY-NC 4.0",
        "Released under the MIT License.\nReleased under the MIT License.\nCopyright 2001 me", None, "", " \n ", "word " * 200_000,
        "License to kill. Rights.", "x\nLicensed under CC BY-NC 4.0.\ny" * 3, "SPDX-License-Identifier: Apache-2.0\n")
    assert got[0] == (["MITTitle", "Copyright", "MITGrant", "MITNotice", "MITWarranty", "MITLiability"], ["MIT"], ["MITTitle", "Copyright"])
    assert got[1][1] == ["MIT"] and got[3][1] == ["BSD-2-Clause"] and got[4][1] == ["BSD-3-Clause"] and got[4][2] == []
    assert got[5] == (["ApacheRef", "AllRightsReserved", "CCBYNC4Ref"], ["Apache-2.0", "CC-BY-NC-4.0", "Proprietary"], [])
    assert got[6] == (["MITRef", "MITRef", "Copyright"], ["MIT"], ["Copyright"])
    assert all(g == ([], [], []) for g in got[7:12])
    assert got[12][1] == ["CC-BY-NC-4.0"] and got[13][1] == ["Apache-2.0"]


APACHE = """   Copyright 2020 Someone

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
GPL3 = """    This program is free software: you can redistribute it and/or modify
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
GPL2 = GPL3.replace("version 3", "version 2").replace("""License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.""", """License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""")
MIT_TEXT = """MIT License

Copyright (c) 2020 Someone

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
BSD3 = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of Some Name, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
"""


def test_published_notices(spark):
    texts = [APACHE, GPL3, GPL2, MIT_TEXT, BSD3]
    marked = [m + t.replace("\n", f"\n{m}") for m in ("# ", " * ", "// ", "-- ") for t in texts]
    got = scan(spark, *texts, *(t.replace("\n", "\r\n") for t in texts), *marked)
    gpl = ["GPLWarranty", "GPLSee", "GPLCopy"]
    want = [
        (["Copyright", "ApacheRef", "ApacheComply", "ApacheCopy", "ApacheUrl", "ApacheWarranty", "ApacheSee"], ["Apache-2.0"], ["Copyright"]),
        (["GPL3Later", *gpl], ["GPL-3.0-or-later"], []),
        (["GPL2Later", *gpl], ["GPL-2.0-or-later"], []),
        (["MITTitle", "Copyright", "MITGrant", "MITNotice", "MITWarranty", "MITLiability"], ["MIT"], ["MITTitle", "Copyright"]),
        (["Copyright", "AllRightsReserved", "BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty"], ["BSD-3-Clause", "Proprietary"],
         ["Copyright"])]
    for at, (one, other) in enumerate(zip(got, want * 6)):
        assert one == other, at


def test_wrapped_runs(spark):
    known = {"a b c d": "ABCD", "b": "B", "b c": "BC", "x y": "XY"}
    docs = spark.createDataFrame([(t,) for t in (
        "A\nB\nC\nD", "A\nB\nC\nX\nY", "A\nB\n\nC\nD", "X\nX\nY\nB", "# A\n# B C\n#\n# D", "A\nA\nB\nC\nD")], "text string")
    got = [r.sentences for r in licenses.scanned(docs, known, [("n", ["N"])]).collect()]
    assert got == [["ABCD"], ["BC", "XY"], ["B"], ["XY", "B"], ["BC"], ["ABCD"]]


def test_every_rule_alone_and_order(spark):
    rules = [("ab", ["A", "B"]), ("a", ["A"]), ("bc", ["B", "C"])]
    known = {"say a": "A", "say b": "B", "say c": "C"}
    docs = spark.createDataFrame([("Say a. Say b. Other. Say c.",), ("Say b. Say a. Say c.",), ("Say a. Say b. Say a. Say b. Say c.",)], "text string")
    got = [(r.licenses, r.unmatched) for r in licenses.scanned(docs, known, rules).collect()]
    assert got == [(["ab"], ["C"]), (["a", "bc"], []), (["ab"], ["C"])]


def test_anchors_meet_every_sentence():
    words = licenses.anchors(licenses.SENTENCES)
    assert all(any(w in s for w in words) for s in licenses.SENTENCES)
    assert {i for _, run in licenses.RULES for i in run} <= set(licenses.SENTENCES.values())


def test_empty_table_and_plan(spark):
    empty = licenses.scanned(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents(spark, sf):
    name = "op1_license_scan"
    good, note = compare(spark, duck(f"/root/testdata/{sf}"), f"/root/testdata/{sf}", catalog.QUERIES[name], catalog.ORACLES[name])
    assert good, note
