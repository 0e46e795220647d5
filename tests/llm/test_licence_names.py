"""Sentences that name a licence, in everyday forms."""

import re

from hepark.llm import license_rules as L

FORMS = {
    "This project is distributed under the MIT License.": "MIT",
    "Licensed under the MIT license (see LICENSE).": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
    "/* SPDX-License-Identifier: LGPL-2.1-only */": "LGPL-2.1",
    "Code released under the BSD 3-Clause license.": "BSD-3-Clause",
    "This work is available under CC0 1.0 Universal": "CC0-1.0",
    "Distributed under the terms of the GNU Lesser General Public License v2.1": "LGPL-2.1",
    "Released under the GNU AGPLv3.": "AGPL-3.0",
    "This work is licensed under the Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "licensed under CC-BY-NC-SA 3.0": "CC-BY-NC-SA-3.0",
    "This library is free software\n# distributed under the\n#  Mozilla Public License,\n# v. 2.0.": "MPL-2.0",
    "The software is published under the Apache License, Version 2.0, see the LICENSE file for details.": "Apache-2.0",
    "Released under the MIT License": "MIT",
    "It was released under pressure.": "",
    "The ferry is licensed under the maritime act.": "",
    "Read about the MIT license and the Apache license.": "",
    "not released under the MIT license": "",
}


def test_everyday_forms(spark):
    rows = [(i, f"Some text before.\n\n{form}\n\nand after.") for i, form in enumerate(FORMS)]
    got = {r.doc_id: r.licenses for r in L.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(FORMS))] == list(FORMS.values())


def test_every_name_is_recognised(spark):
    names = L.licence_names()
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", n) for n in names)
    rows = [(i, f"Foo.\nThis file is released under the {n} licence.\nBar") for i, n in enumerate(names)]
    got = {r.doc_id: r.licenses for r in L.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(names))] == list(names.values())
