"""Functions over single texts: scans, completions, mutations, prompts, byte tokens and frames."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks.functions import grams, scripts
from siltworks.functions.text import duration, short_path
from siltworks.operators import audit


def test_static_warnings():
    f = lambda t: [c for c, _ in scripts.static_warnings(t)]
    assert f("func a():\n\tpass\n") == []
    assert scripts.static_warnings("a(\nb[\n)\n") == [("unbalanced_delimiter", 3)]
    assert scripts.static_warnings("x = '('\ny = (1,\n") == [("unclosed_delimiter", 2)]
    assert f("<<<<<<< ours\n...\n \tx = 1\n") == ["merge_markers", "ellipsis_placeholder", "mixed_leading_indentation"]
    assert f("func a():\n\tpass\nfunc a():\n\tpass\n") == ["duplicate_top_level_function_name"]
    assert f("# func a( ) [\n") == [] and f("x = 1 �") == ["encoding_replacement"] and f("") == []
    assert f("x = 1\n" * 20_000) == ["very_large_script"]


def test_cut_repetition_against_brute_force():
    def plain(text):
        ls = text.split("\n")
        for size in range(min(len(ls) // 2, 64), 1, -1):
            for a in range(len(ls) - 2 * size + 1):
                if ls[a : a + size] == ls[a + size : a + 2 * size]:
                    return "\n".join(ls[: a + size])
        i = 0
        while i < len(ls):
            j = i
            while j < len(ls) and ls[j] == ls[i]:
                j += 1
            if ls[i].strip() and j - i >= (2 if ls[i].startswith("#") else 3):
                return "\n".join(ls[: i + 1])
            i = j
        return text

    rnd = random.Random(5)
    for _ in range(300):
        t = "\n".join(rnd.choice(["a", "b", "# c", "", "d"]) for _ in range(rnd.randrange(0, 14)))
        assert scripts.cut_repetition(t) == plain(t), t


def test_last_function_and_mutations():
    t = "extends Node\nfunc a(x):\n\treturn x + 1\n\nfunc b_c() -> int:\n\tvar k = 12\n\treturn k\n"
    prompt, rest, n = scripts.last_function(t, 100)
    assert prompt.endswith("func b_c() -> int:\n") and rest == "\tvar k = 12\n\treturn k\n" and n == len(rest)
    assert scripts.last_function("func a():\n\tx\n", 100) is None and scripts.last_function("", 9) is None
    m = dict(scripts.mutations(t))
    assert m["comment"].startswith("# verify") and "func bCImpl() -> int:" in m["rename"] and "func b_c(_unused: int = 0) -> int:" in m["parameter"]
    assert "func a(x, _unused: int = 0):" in dict(scripts.mutations("func a(x):\n\treturn x\n"))["parameter"]
    assert dict(scripts.mutations('"""\nfunc no():\n"""\n')).keys() == {"comment"}


def test_prompts_and_bytes():
    parts = [("h", "head ", True), ("a", "äää", False), ("b", "bbbb", False), ("t", "!", True)]
    got = {k: (t, n, lost) for k, t, n, lost in scripts.composed(parts, 14)}
    assert got["b"] == ("b", 1, 3) and got["a"] == ("äää", 6, 0)
    got = {k: (t, lost) for k, t, _, lost in scripts.composed(parts, 12)}
    assert got["a"] == ("ää", 2) and got["h"] == ("head ", 0)
    with pytest.raises(ValueError):
        scripts.composed(parts, 7)
    for t in ("", "a<bos>ß<eos>", "x" * 9 + "<task>"):
        assert scripts.decoded_bytes(grams.byte_ids(t).tolist()) == t
    assert scripts.decoded_bytes([1, 13 + 97, 2], skip=True) == "a"
    with pytest.raises(ValueError):
        scripts.decoded_bytes([13 + 256])


def test_frames_come_in_pieces():
    stream = 'data: {"a": 1}\n: ping\n\ndata: [DONE]\ndata: {"b": 2}\n'
    for size in (1, 3, 7, 100):
        rest, got = "", []
        for i in range(0, len(stream), size):
            x, rest = scripts.frames(rest, stream[i : i + size])
            got += x
        assert got == ['{"a": 1}', '{"b": 2}'] and rest == ""


def test_shown_values(spark):
    q = lambda c, v, t: spark.createDataFrame([(v,)], f"v {t}").select(c(F.col("v"))).first()[0]
    assert q(duration, 59, "long") == "00:59" and q(duration, 3600, "long") == "01:00:00" and q(duration, None, "long") is None
    s = lambda c: short_path(c, 20)
    assert q(s, "a/b.gd", "string") == "a/b.gd" and q(s, "first/second/third/name.gd", "string") == "first/se…/third/name.gd"


def test_fragments(spark):
    rows = {
        "func a():\n\tpass\n": "pass_only_stub,too_short",
        "extends Node\nvar a = '('\nfunc b():\n\treturn a\n": "",
        "extends Node\nvar a = (1\n# )\nvar long_name = 2\n": "unbalanced_delimiters",
        "func a_long_name():\n\t...\n\tvar b = 1\n": "placeholder_ellipsis",
        "using System;\npublic class A { }\n// and more of it\n": "non_gdscript_fragment",
        "var name = 'x' \x00 and some more text here": "encoding_damage",
    }
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = {r["text"]: r["f"] for r in df.select("text", F.array_join(audit.fragment_reasons(F.col("text")), ",").alias("f")).collect()}
    assert got == rows


def test_escalation(spark):
    rows = [("a", [], "accepted", "a", None, False, False), ("b", [], "accepted", "a", "a", False, False), ("c", [], "accepted", "c", "b", None, None), ("d", ["too_short"], "warning", "d", "a", False, None), ("e", [], "accepted", "e", None, None, True)]
    df = spark.createDataFrame(rows, "record_id string, reasons array<string>, quality string, first_id string, near_duplicate_of string, text_leaks boolean, group_leaks boolean")
    got = {r["record_id"]: (r["quality"], r["reasons"]) for r in audit.escalated(df).collect()}
    assert got == {
        "a": ("accepted", []), "b": ("quarantine", ["near_duplicate", "normalized_exact_duplicate"]), "c": ("warning", ["near_duplicate"]), "d": ("warning", ["near_duplicate", "too_short"]), "e": ("quarantine", ["split_leakage"]),
    }


def test_final_status_over_tables(spark, tmp_path):
    from siltworks.queries.corpus import audit_status_final

    body = "extends Node\n\nfunc open_gate(width: int) -> int:\n\tvar total = width * 2\n\treturn total\n"
    files = {"s/a": body, "s/b": "# copy\n" + body, "s/c": body.replace("total", "sum_of"), "s/d": "func x():\n\tpass\n"}
    rec = [(f"r{i}", "src", g, "godot_projects", p, p, sp, "MIT", "passed") for i, (p, g, sp) in enumerate([("s/a", "g1", "train"), ("s/b", "g2", "train"), ("s/c", "g3", "val"), ("s/d", "g3", "train")])]
    cols = "record_id string, source_id string, group_id string, kind string, original_path string, staged_path string, split string, license string, validation_status string"
    spark.createDataFrame(rec, cols).withColumn("ingested_at", F.lit(None).cast("timestamp")).write.parquet(str(tmp_path / "records.parquet"))
    spark.createDataFrame(list(files.items()), "staged_path string, text string").write.parquet(str(tmp_path / "staged_files.parquet"))
    spark.createDataFrame([("src", "MIT")], "id string, license string").write.parquet(str(tmp_path / "sources.parquet"))
    got = {r["record_id"]: (r["quality"], r["reasons"], r["duplicate_of"]) for r in audit_status_final(spark, str(tmp_path)).collect()}
    assert got["r0"] == ("accepted", "", None)
    assert got["r1"][0] == "quarantine" and "normalized_exact_duplicate" in got["r1"][1] and got["r1"][2] == "r0"
    assert got["r2"][0] == "quarantine" and "split_leakage" in got["r2"][1] and got["r3"][0] == "quarantine"


def test_round_trips_over_tables(spark, small):
    import os

    from siltworks.functions import subwords
    from siltworks.queries import script_ops as S

    assert S.byte_roundtrip(spark, small).where("not same").count() == 0
    if os.path.isdir(subwords.DEFAULT_DIR):
        assert S.subword_counts(spark, small).where("not same").count() == 0
        tok = subwords.Subwords(subwords.byte_bpe(subwords.DEFAULT_DIR))
        assert tok.decode(tok.encode("extends Node2D")) == "extends Node2D" and tok.count("") == 0
        with pytest.raises(ValueError):
            tok.decode([tok.size])
    w = S.shifted_windows(spark, small).collect()
    assert w and all(r["x"][1:] == r["y"][:-1] for r in w)


def test_blocks_by_indentation():
    from siltworks.functions.scan import function_blocks, rst_snippets

    t = "func a(x):\n\tif x:\n\t\treturn 1\n\n\treturn 2\n\nvar k = 1\nfunc b(\nfunc c() -> int:\n    pass\n    pass\n"
    assert [c.split("(")[0] for _, c in function_blocks(t)] == ["func a", "func c"]
    page = (
        "Title\n\n.. tabs::\n\n .. code-tab:: gdscript GDScript\n    :linenos:\n\n    var first = 1\n    var second = 2\n\n .. code-tab:: csharp\n\n    int x = 1; // and so on\n\n"
        ".. code:: GDScript\n\n\tfunc long_name():\n\t\treturn 12345\n\n.. code-block:: gdscript\n\n    # Output: 1 2 3 4 5 6 7 8 9\n\n.. code-block:: gdscript\n\n    var short = ... # and more of it\n"
    )
    assert rst_snippets(page) == [(1, "var first = 1\nvar second = 2"), (2, "func long_name():\n\treturn 12345")]
