"""Every licence by its text, its notice and its names; altered clauses; what stays unknown."""

import pytest

from siltworks.llm import licences
from siltworks.llm.licence_texts import DISCLAIMERS, NAMES, TEXTS

BSD2 = "\n".join(TEXTS["BSD-2-Clause"][0]) + "\n" + DISCLAIMERS[1]
BSD3 = "Copyright (c) 2020, Ember Mill. All rights reserved.\n" + "\n".join(TEXTS["BSD-3-Clause"][1]) + "\n" + DISCLAIMERS[1]
MIT = "Copyright (c) 2020 Ember Mill\n\n" + "\n\n".join(TEXTS["MIT"][1]) + "\n\n" + DISCLAIMERS[0]


@pytest.mark.parametrize("name, text", [(k, "\n".join(c)) for k, texts in TEXTS.items() for c in texts], ids=lambda x: x[:24])
def test_every_text_names_its_licence(name, text):
    assert licences.named(text)[:2] == ((name,), 1.0)
    comment = "# " + "\n# ".join(text[i : i + 70] for i in range(0, len(text), 70) if not text[i - 1 : i + 1].isalnum()) if len(text) < 70 else "# " + text.replace(". ", ".\n# ")
    assert licences.named(comment)[0] == (name,)


@pytest.mark.parametrize("name", sorted(NAMES))
def test_every_name(name):
    for form in NAMES[name]:
        assert licences.named(form)[0] == (name,)


def test_whole_files():
    assert licences.named(MIT) == (("MIT",), 1.0, "")
    assert licences.named(BSD2)[0] == ("BSD-2-Clause",) and licences.named(BSD3)[0] == ("BSD-3-Clause",)


def test_altered_clauses_are_told():
    names, coverage, notes = licences.named(BSD3.replace("without specific prior written permission", "without asking"))
    assert names == ("BSD-3-Clause",) and 0.9 < coverage < 1 and "BSD-3-Clause 4: -[specific prior written permission]" in notes
    names, coverage, notes = licences.named(MIT.replace("publish, distribute", "distribute").replace("OUT OF OR IN", "IN"))
    assert names == ("MIT",) and "MIT 1: -[publish]" in notes and "disclaimer 1" in notes
    assert licences.named(MIT.replace("and/or sell copies of the Software", "and, for a fee, sell copies of the Software"))[2].startswith("MIT 1:")


def test_what_is_no_licence():
    for t in ("Permission is hereby granted to enter the tower", "redistribute it as you like", "the terms of the ferry", "no licence yet", "# software for the ancient wheel\n# see the docs"):
        assert licences.named(t) == ((), 0.0, ""), t
    assert licences.named("All rights reserved.\n" + MIT)[0] == ("MIT",)
    assert licences.named("MIT or proprietary")[0] == ("MIT", "Private")
