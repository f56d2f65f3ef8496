"""Licence tags: every one of a text, however many a line holds."""

import random

from framequarry.llm import licenses


def labels_of(text):
    return licenses.scan_text(text)[5]


def test_two_tags_of_one_line():
    row = licenses.scan_text("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0-only")
    assert row[5] == ["gpl", "mit"] and [(e["text"], e["valid"], e["permissive"]) for e in row[6]] == [("MIT", True, True), ("GPL-2.0-only", True, False)]


def test_tags_in_a_row_and_at_the_end():
    assert labels_of("spdx license identifier spdx license identifier: (MIT OR ISC) spdx-license-identifier") == ["isc", "mit"]
    assert labels_of("SPDX-License-Identifier") == [] and labels_of("xspdx license identifier MIT") == [] and labels_of("Éspdx license identifier MIT") == []


def test_random_tags_on_one_line():
    rng = random.Random(8)
    known = {"MIT": "mit", "Apache-2.0": "apache-2", "GPL-2.0-or-later": "gpl", "BSD-3-Clause": "bsd-3-clause", "ISC": "isc", "CC0-1.0": "cc0"}
    for _ in range(300):
        text, want, count = "", set(), 0
        for _ in range(rng.randint(1, 8)):
            if rng.random() < 0.3:
                text += rng.choice(["été and more, ", "some words here. ", "\n", "日本 "])
            names = rng.sample(sorted(known), rng.randint(1, 3))
            want |= {known[n] for n in names}
            count += 1
            text += rng.choice(["SPDX-License-Identifier", "spdx license_identifier", "SPDX--License\tIdentifier"]) + rng.choice([": ", " ", "=", " : "]) + rng.choice([" OR ", " and "]).join(names) + rng.choice([" ", "\n", "; ", " */ "])
        row = licenses.scan_text(text)
        assert set(row[5]) == want and len(row[6]) == count and all(e["valid"] for e in row[6]), text
