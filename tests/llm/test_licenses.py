"""Licenses that are not there aren't named; edited ones are still found."""

import random

import pytest

from rankloom.llm import licenses

SCANNER = licenses.Scanner()
GPL2 = licenses.TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2")


@pytest.mark.parametrize(
    "text",
    [
        "Released under the BSD License.", "This was released under the new license.", "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-SA 4.0.",
        licenses.TEMPLATES["Apache-2.0-notice"].replace("2.0", "1.1"), "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
)
def test_names_that_are_not_there(text):
    assert SCANNER.every(text) == [] and SCANNER.every(f"some words before. {text} And some behind.") == []


def test_versions_and_families_are_told_apart():
    assert {x[0] for x in SCANNER.every(GPL2)} <= {"GPL-2.0-notice-full"}
    for name in ("GPL-2.0-notice-full", "GPL-3.0-notice-full", "LGPL-2.1-notice-full", "LGPL-3.0-notice-full", "AGPL-3.0-notice-full"):
        told = {x[0] for x in SCANNER.every(f"Copyright. {licenses.TEMPLATES[name]} End.")}
        assert name in told and {x.split("-notice")[0] for x in told} == {name.split("-notice")[0]}, (name, told)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_whole_and_edited_templates_are_found(name):
    rng = random.Random(name)
    words = licenses.TEMPLATES[name].split()
    assert name in {x[0] for x in SCANNER.every(" ".join(words))}
    if name not in licenses.NAMING:
        worn = [w if rng.random() > 0.08 or any(c.isdigit() for c in w) else rng.choice(("word", "other")) for w in words]
        assert name in {x[0] for x in SCANNER.every(" ".join(worn))}


def test_a_long_text():
    text = "word " * 200_000 + licenses.TEMPLATES["MIT-text"] + " word" * 200_000
    assert SCANNER.scan(text)[:2] == ("MIT-text", 1.0)
