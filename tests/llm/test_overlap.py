"""Overlaps against a brute-force comparison of all pairs."""

import random

from siltworks.llm import overlap


def script(rnd, n):
    words = ["ember", "vault", "stone", "river", "crate", "lever", "tower", "spark", "hatch", "wagon", "canvas", "ribbon"]
    w = lambda: f"{rnd.choice(words)}_{rnd.choice(words)}_{rnd.randrange(500)}"
    return ["extends Node2D"] + [f"func {w()}():\n\t{w()}.{w()}({rnd.randrange(900)}, \"{w()}\")\n\t{w()}({rnd.randrange(900)})" for _ in range(n)]


def tables(spark, tmp_path, items):
    recs = [(f"r{i:03d}", f"s/{i}.gd", sp, "src") for i, (sp, _) in enumerate(items)]
    spark.createDataFrame(recs, "record_id string, staged_path string, split string, source_id string").write.parquet(str(tmp_path / "records.parquet"))
    spark.createDataFrame([(f"s/{i}.gd", t) for i, (_, t) in enumerate(items)], "staged_path string, text string").write.parquet(str(tmp_path / "staged_files.parquet"))
    return str(tmp_path)


def test_found_against_planted(spark, tmp_path):
    rnd = random.Random(7)
    items, want = [], set()
    for k in range(30):
        base = script(rnd, 9)
        items.append(("val" if k % 2 else "test", "\n".join(base)))
        e = len(items) - 1
        twin = list(base)
        kind = k % 6
        if kind == 0:
            text = "\n".join(twin)
        elif kind == 1:  # comments and layout
            text = "# note\n" + "\n\n".join(twin).replace("\t", "    ") + "\n# end"
        elif kind == 2:  # a routine added
            text = "\n".join(twin + script(rnd, 1)[1:])
        elif kind == 3:  # moved and dropped
            text = "\n".join(twin[:1] + twin[3:] + twin[1:2])
        elif kind == 4:  # numbers
            text = "\n".join(twin).replace("(1", "(7")
        else:  # only one routine in common: no case
            text = "\n".join(script(rnd, 9) + twin[1:2])
        items.append(("train", text))
        if kind != 5:
            want.add((e, len(items) - 1))
    items += [("train", ""), ("val", "  "), ("train", None), (None, items[0][1]), ("train", items[0][1])]
    want.add((0, len(items) - 1))
    d = tables(spark, tmp_path, items)
    got = {(int(r[0][1:]), int(r[1][1:])) for r in overlap.found(spark, d).collect()}
    assert got == {tuple(sorted(x)) for x in want}
    rep = overlap.report(spark, d).collect()
    assert sum(r["pairs"] for r in rep) == len(want)
    cl = {r["record_id"]: r["class_id"] for r in overlap.classes_of(spark, d).collect()}
    assert cl["r000"] == cl[f"r{len(items) - 1:03d}"]


def test_hot_copies(spark, tmp_path):
    """Half of all rows are one text; every pair across the splits comes out."""
    rnd = random.Random(1)
    hot = "\n".join(script(rnd, 5))
    items = [("train", hot)] * 40 + [("val", hot)] * 10 + [("train", "\n".join(script(rnd, 5))) for _ in range(40)]
    assert overlap.found(spark, tables(spark, tmp_path, items)).count() == 400


def test_prefix_filter_loses_no_pair(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(120):
        h = sorted(rnd.sample(range(60), rnd.randrange(2, 14)))
        rows.append((f"{i:03d}", h, i % 3 == 0, i % 3 != 0, "x", len(h)))
    df = spark.createDataFrame(rows, "cls string, h array<long>, ev boolean, tr boolean, at string, n int")
    got = {(r["e"], r["t"]) for r in overlap.routed(df).collect()}
    for a, ha, ea, *_ in rows:
        for b, hb, _, tb, *_ in rows:
            if ea and tb and a != b and len(set(ha) & set(hb)) >= overlap.SHARE * max(len(ha), len(hb)):
                assert (a, b) in got


def test_short_lines_and_two_texts_of_a_path(spark, tmp_path):
    """Texts of lines under eight characters, lightly edited; a path delivered with two texts has one of them, for all steps."""
    lines = [f"v{i}={i}" for i in range(40)]
    items = [("train", "\n".join(lines)), ("val", "\n".join(lines[:18] + ["zz=1"] + lines[19:])), ("train", "\n".join(f"k{i}={i}" for i in range(40)))]
    d = tables(spark, tmp_path, items)
    spark.createDataFrame([("s/2.gd", "\n".join(lines))], "staged_path string, text string").write.mode("append").parquet(str(tmp_path / "staged_files.parquet"))
    got = {(r[0], r[1]) for r in overlap.found(spark, d).collect()}
    assert ("r000", "r001") in got
    cls = {r["record_id"]: r["class_id"] for r in overlap.classes_of(spark, d).collect()}
    assert (("r001", "r002") in got) == (cls["r002"] == cls["r000"])
