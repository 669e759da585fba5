"""Whole licenses, statements within lines, and SPDX names."""

import pickle

import pytest

from quillon.llm import licenses

KNOWN = licenses.Templates()
WHOLE = dict(licenses.whole_texts())


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_licenses_are_found(name):
    for text in (WHOLE[name], "Copyright (c) 2020 Foo.\nAll rights reserved.\n\n" + WHOLE[name], "word " * 500 + "\n" + WHOLE[name].replace("\n", "\n * ")):
        assert KNOWN.scan(text)[0] == name
    assert KNOWN.scan(WHOLE[name])[3] > 0.95


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */ int x;", "GPL-2.0"),
        ("Copyright (c) 2020 Foo. All rights reserved.", "Proprietary"),
        ("The pictures of this book, but not its words, are Licensed under CC BY 4.0. See the list at its end for who made them.", "CC-BY-4.0"),
        ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n", "Apache-2.0"),
        ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License\nas published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "LGPL-3.0"),
        ("All rights reserved.\nReleased under the MIT License.", "MIT"),
        ("All rights are reserved for members of the club who know the license number of their car.", None),
        ("Das ist mit allem, was wir wissen, under the terms of our talk.", None),
    ],
)
def test_statements(text, name):
    assert KNOWN.scan(text)[0] == name


def test_part_of_a_license_and_an_edited_one():
    words = WHOLE["GPL-3.0"].split()
    assert KNOWN.scan(" ".join(words[1500:1900]))[0] == "GPL-3.0"
    assert KNOWN.scan(" ".join(w for i, w in enumerate(WHOLE["BSD-3-Clause"].split()) if i % 25))[0] == "BSD-3-Clause"


def test_workers_get_the_same_templates():
    assert pickle.loads(pickle.dumps(KNOWN)).scan(WHOLE["MIT"]) == KNOWN.scan(WHOLE["MIT"])
