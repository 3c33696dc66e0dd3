"""Licences of files that are not made from the templates: written here from other editions, and those of this machine."""

import os

import pytest

from seaward.llm import licences

COMMON = "/usr/share/common-licenses"

BSD = """Copyright (c) 2016-present, Some Network, Inc. and affiliates.
All rights reserved.

Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

 * Neither the name Some Network, nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.
"""
GPL_END = """            How to Apply These Terms to Your New Programs

    <one line to give the program's name and a brief idea of what it does.>

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

Also add information on how to contact you by electronic and paper mail.
"""
OLD_GPL = GPL_END.replace("either version 3", "either version 2").replace("free software: you", "free software; you").replace("If not, see <https://www.gnu.org/licenses/>.", "If not, write to the Free Software\n    Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package x;
"""
PSF = """A. HISTORY OF THE SOFTWARE
==========================

Python was created in the early 1990s by Guido van Rossum.

PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2
--------------------------------------------

1. This LICENSE AGREEMENT is between the Python Software Foundation
("PSF"), and the Individual or Organization ("Licensee").

CWI LICENSE AGREEMENT FOR PYTHON 0.9.0 THROUGH 1.2
--------------------------------------------------

Permission to use, copy, modify, and distribute this software and its
documentation for any purpose and without fee is hereby granted,
provided that the above copyright notice appear in all copies and that
both that copyright notice and this permission notice appear in
supporting documentation.

THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE, INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS, IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, INDIRECT OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
CASES = [
    (BSD, "BSD-3-Clause"), (GPL, "GPL-3.0"), (GPL_END, "GPL-3.0"), (OLD_GPL, "GPL-2.0"), (APACHE, "Apache-2.0"), (ASF, "Apache-2.0"), (PSF, "PSF-2.0"),
    ("# Copyright 2019 Some Company\n# Licensed under the Apache License, Version 2.0. See LICENSE for details.\nimport x\n", "Apache-2.0"),
    ("// Licensed under the MIT license\n", "MIT"),
    ("Copyright (c) 2020 Somebody. All rights reserved.\nAll rights reserved.\n", "Proprietary"),
]


def found(spark, texts, **more):
    df = spark.createDataFrame([(i, f"{i}/LICENSE", t) for i, t in enumerate(texts)], "id int, path string, text string")
    return [r.licence for r in licences.licences(df, "id", **more).orderBy("id").collect()]


def test_texts_of_other_editions(spark):
    assert found(spark, [t for t, _ in CASES]) == [n for _, n in CASES]


def test_rights_are_not_inherited(spark):
    df = spark.createDataFrame([(0, "a/x.c", "All rights reserved."), (1, "a/y.c", "int y;"), (2, "b/LICENSE", BSD), (3, "b/src/z.c", "All rights reserved.\n"), (4, "b/src/w.c", "")], "id int, path string, text string")
    got = {r.id: (r.licence, r.origin) for r in licences.licences(df, "id").collect()}
    assert got == {0: ("Proprietary", "own"), 1: (None, "none"), 2: ("BSD-3-Clause", "own"), 3: ("Proprietary", "own"), 4: ("BSD-3-Clause", "inherited")}


def test_whole_texts_as_parameter(spark, tmp_path):
    own = "You may feed the ducks at the pond on any day but never the geese nor any swan without asking the keeper first."
    (tmp_path / "Ducks-1.0.txt").write_text(own)
    templates = licences.with_texts(licences.read_texts(spark, str(tmp_path)))
    assert found(spark, [own, BSD, own[:60]], templates=templates) == ["Ducks-1.0", "BSD-3-Clause", None]


def test_bound_leaves_nothing_out(spark, monkeypatch):
    """The same units reach the threshold if all are compared."""
    texts = [t for t, _ in CASES] + [t for _, _, t in licences.TEMPLATES]
    want = found(spark, texts)
    monkeypatch.setattr(licences, "least_shared", lambda *_: [[]])
    assert found(spark, texts) == want


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts on this machine")
def test_common_licences_of_the_system(spark):
    want = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    names = [n for n in want if os.path.exists(f"{COMMON}/{n}")]
    texts = [open(f"{COMMON}/{n}", encoding="utf-8", errors="replace").read() for n in names]
    assert dict(zip(names, found(spark, texts), strict=True)) == {n: want[n] for n in names}
