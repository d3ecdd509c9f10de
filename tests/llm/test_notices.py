"""Notices as they stand in files, and columns that clash with inner names."""

import pytest

from curvesmith.llm import licenses, linededup
from curvesmith.llm.license_rules import NOTICES, cells, rules

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEXTS = {
    GPL.format("General Public License", "3"): {"gpl-3"},
    GPL.format("General Public License", "2"): {"gpl-2"},
    GPL.format("Lesser General Public License", "2.1"): {"lgpl-2.1"},
    GPL.format("Lesser General Public License", "3"): {"lgpl-3"},
    GPL.format("Affero General Public License", "3"): {"agpl-3"},
    "// SPDX-License-Identifier: (MIT OR Apache-2.0)": {"mit", "apache-2"},
    "# SPDX-License-Identifier: GPL-2.0-only AND BSD-3-Clause AND Zlib": {"gpl-2", "bsd-3", "zlib"},
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2"},
    "The contents of this file are subject to the Mozilla Public License Version 1.1": {"mpl-1.1"},
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0": {"epl-2"},
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0": set(),
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.': {"apache-2"},
    "http://www.apache.org/licenses/LICENSE-2.0": {"apache-2"},
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": {"mit"},
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": {"bsd"},
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived": {"bsd-3"},
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:": {"bsd-4"},
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": {"zlib"},
    "Distributed under the Boost Software License, Version 1.0.": {"bsl-1"},
    "This is free and unencumbered software released into the public domain.": {"unlicense"},
    "https://creativecommons.org/publicdomain/zero/1.0/": {"cc0"},
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": {"cc-by-nc-sa"},
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.": {"gpl"},
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed": {"wtfpl"},
    "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit.": {"openssl"},
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": {"ofl"},
    "a text of no licence at all, released by nobody, confidential or not": set(),
}


def test_notices(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.text: set(filter(None, r.labels.split(","))) for r in licenses.scan_licenses(rows).select("text", "labels").collect()}
    for text, want in TEXTS.items():
        assert want <= got[text], (text, got[text])
        if not want and "license" not in text.lower():
            assert not got[text]
        if "version 3" in text and "Lesser" in text:
            assert "gpl-3" not in got[text]  # contained in the longer notice


def test_every_notice_passes_the_first_filter():
    assert len(cells(NOTICES)) > 45 and all(len(c) == 5 for c in cells(NOTICES))
    for r in rules():
        plain = " " + r["regex"].removeprefix("(?<= )(?:").removesuffix(")(?= )") + " "
        assert r["keyword"].split()[0] in plain.replace("[sc]", "c").replace("?", "") or "spdx" in r["keyword"] or "|" in plain


@pytest.mark.parametrize("own", ["_norm", "_base", "_found", "_every", "_names", "_h", "_gone", "_doc0", "Labels"])
def test_columns_are_kept(spark, own):
    rows = spark.createDataFrame([(1, "MIT License\nx\n\n", "a"), (1, "MIT License\nx\n\n", "a"), (2, "x\ny", "b"), (None, None, "c"), (3, "", None)], f"doc_id long, text string, `{own}` string")
    for out in (licenses.scan_licenses(rows), linededup.dedup_units(rows)):
        assert out.columns[:3] == ["doc_id", "text", own]
        assert sorted(str(r[2]) for r in out.collect()) == ["None", "a", "a", "b", "c"]
        assert len(out.limit(0).collect()) == 0
