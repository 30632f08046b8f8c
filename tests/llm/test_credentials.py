"""Lists, overlaps and subwords of credentials; redacted texts parse as before."""

import os

import pandas as pd
import pytest
from conftest import SMALL

from siltworks.llm import grammars as G
from siltworks.llm import secrets, tokens

AT = "/opt/tokenizers"


@pytest.fixture(scope="module")
def enc():
    if not os.path.isdir(AT):
        pytest.skip("no tokenizers here")
    return tokens.byte_bpe(AT)


def values(text, enc):
    return [text[a:b] for a, b, _ in secrets.spans(text, enc)]


def test_every_member_of_a_list(enc):
    t = 'password = ["Zk39vQx71pLm",  # first\n  "Rt88wYq20nBv", "Ab77" + "xTz19kPc"]\n'
    f = secrets.spans(t, enc)
    assert len(f) == 3
    r = secrets.redact(t, f)
    assert len(r) == len(t) and not any(x in r for x in ("Zk39", "Rt88", "Ab77", "xTz19"))


def test_subwords_judge_named_values(enc):
    assert values('token = "item_07"', enc) == [] and values('token = "level2"', enc) == []
    assert values('password = "hunter2"', enc) == ["hunter2"]
    assert values('token = "a8f3k2m9x1q7"', enc) == ["a8f3k2m9x1q7"]


def test_overlapping_values_are_one(enc):
    t = 'url = "https://u:ghp_0a1B2c3D4e5F6g7H8i9J0kLmNoPq@host.example/x"\n'
    f = secrets.spans(t, enc)
    assert all(a[1] <= b[0] for a, b in zip(f, f[1:]))
    assert "ghp_0a1B" not in secrets.redact(t, f)


def test_redacted_texts_parse_as_before(enc):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    for path, text in pd.read_parquet(f"{SMALL}/staged_files.parquet").dropna().itertuples(index=False):
        f = secrets.spans(text, enc)
        kind = {"gd": G.gdscript, "js": G.javascript, "json": G.json_strict, "cfg": G.godot_cfg}.get(path.rpartition(".")[2])
        if f and kind:
            plain = lambda x: x.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
            assert (kind(plain(text)) is None) == (kind(plain(secrets.redact(text, f))) is None), path
