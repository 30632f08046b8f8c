"""Operators against brute force and fixtures."""

import random
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltworks.functions import grams, ident, scan, text
from siltworks.functions.paths import canonical_path, trimmed
from siltworks.operators import dedup, joins, packing, splits
from siltworks.queries import text_ops
from siltworks.sources import files
from siltworks.sources.tables import one_per_key, split_name


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_paths(spark):
    for raw, want in {
        " a/./b// ": "a/b", "a\\b\\c": "a/b/c", "a/tmp/../b": "a/b", "./a/": "a", "a/b/../../c": "c", "": None, "  ": None, "../a": "../a", ".": None,
    }.items():
        assert one(spark, canonical_path, raw) == want, raw
    assert one(spark, canonical_path, None) is None
    assert one(spark, trimmed, " \t") is None


def test_split_names(spark):
    got = [one(spark, split_name, x) for x in ("Train", " validation ", "TEST", "dev", "other", None)]
    assert got == ["train", "val", "test", "val", None, None]


def test_normalize(spark):
    assert one(spark, text.normalize_code, "a  \r\nb\x00\t\r\n\n\n") == "a\nb\n"
    assert one(spark, text.normalize_code, "") == "\n"
    assert one(spark, text.slug, "--Hello, World!--") == "hello-world"
    assert one(spark, text.slug, "!!!") == "item"
    assert one(spark, text.without_ansi, "\x1b[31mred\x1b[0m\r") == "red"
    assert one(spark, text.collapse_blank_lines, "a\n\n \n\nb") == "a\n\nb"


def test_stable_fraction(spark):
    import hashlib

    for s in ("", "abc", "ä🌑"):
        want = int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") / 2**64
        assert one(spark, ident.stable_fraction, s) == want


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "l string").agg(ident.multiset_fingerprint(F.col("l"))).first()[0]
    b = spark.createDataFrame([("y",), ("x",), ("y",)], "l string").agg(ident.multiset_fingerprint(F.col("l"))).first()[0]
    c = spark.createDataFrame([("y",), ("x",)], "l string").agg(ident.multiset_fingerprint(F.col("l"))).first()[0]
    assert a == b != c


def leaks(prompts, corpus, n=16, rare=2):
    """Brute force: present, distinctive and their ratio for each prompt."""
    cut = lambda x: {x[i : i + n] for i in range(len(x) - n + 1)}
    plain = lambda x: " ".join(x.split()).lower()
    held = [cut(x) for x in {plain(x) for x in corpus}]
    out = {}
    for k, x in prompts.items():
        c = [sum(g in h for h in held) for g in cut(plain(x))]
        few = [y for y in c if y <= rare]
        out[k] = (sum(y > 0 for y in few), len(few), round(sum(y > 0 for y in few) / len(few), 6) if few else 0.0)
    return out


def test_leaks_in_bodies(spark, small, tmp_path):
    body = "func spill_lantern(oil):\n\treturn oil * 3 + wick\n"
    rows = [
        (1, "Quiet harbour", "intro words\n" + body + "closing words", "train"), (2, "Other", "nothing of that kind stands here", "Train"), (3, "Third", "NOTHING of that  kind stands here", "train"), (4, "Prompt", body.upper(), "test"), (5, "Short", "abc", "test"), (6, "None", None, "test"),
        (7, "Free", "wholly new wording with ä and 🌑 in it", "TEST"), (8, "Dev", body, "val"), (9, "Blank", " ", "test"), (10, "Kind", "of that kind stands here, too", "test"),
        *[(20 + i, "Common", f"{i} a common header of many files {i}", "train") for i in range(3)], (30, "Header", "a common header of many files", "test"),
    ]
    spark.createDataFrame(rows, "doc_id long, title string, text string, split string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["present"], r["distinctive"], r["leak"]) for r in text_ops.text_leak_index(spark, str(tmp_path)).collect()}
    want = leaks({k: x for k, _, x, s in rows if s.lower() == "test" and x is not None}, [x for _, _, x, s in rows if s.lower() == "train"])
    assert got == want and got[4][2] == 1.0 and got[7][2] == 0.0 and got[5] == (0, 0, 0.0) and got[30][1] == 0
    docs = {r["doc_id"]: (r["text"], split_name_of(r["split"])) for r in spark.read.parquet(small + "/documents.parquet").collect() if r["text"] is not None}
    got = {r["doc_id"]: (r["present"], r["distinctive"], r["leak"]) for r in text_ops.text_leak_index(spark, small).collect()}
    assert got == leaks({k: x for k, (x, s) in docs.items() if s == "test"}, [x for x, s in docs.values() if s == "train"])


def test_leaks_shuffle_pieces_of_texts(spark, tmp_path):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäß🌑", k=r.randint(2, 9))) for _ in range(3000)]
    body = lambda n: " ".join(r.choices(words, k=n))
    shared = [body(60) for _ in range(12)]
    rows = [(i, " ".join([body(150), r.choice(shared), body(5), r.choice(shared)]), "test" if i % 8 == 0 else "train") for i in range(200)]
    rows += [(600, "x" * 15, "test"), (601, "", "test"), (602, "x" * 16, "test"), (603, "ab" * 40, "test"), (604, "ab" * 30 + " ab " + "ab" * 30, "train"), (605, "x" * 400, "train"), (606, "\0" * 20, "test")]
    spark.createDataFrame(rows, "doc_id long, text string, split string").write.parquet(str(tmp_path / "documents.parquet"))
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    written = lambda: sum(x.shuffleWriteBytes() for x in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())))
    before = written()
    got = {r["doc_id"]: (r["present"], r["distinctive"], r["leak"]) for r in text_ops.text_leak_index(spark, str(tmp_path)).collect()}
    assert got == leaks({k: x for k, x, s in rows if s == "test"}, [x for _, x, s in rows if s == "train"])
    assert 0 < written() - before < 4 * sum(len(x) for _, x, _ in rows)


def test_leaks_in_small_batches(monkeypatch):
    """Texts over many batches, and hashes of which a part tells nothing apart."""
    r = random.Random(6)
    texts = ["".join(r.choices("ab", k=r.randint(0, 90))) for _ in range(300)]
    train, test = list(dict.fromkeys(texts[:240])), dict(enumerate(texts[240:]))
    want = {k: x[:2] for k, x in leaks(test, train).items()}
    hashes = grams._hashes
    few = lambda codes, buckets=0: (hashes(codes, buckets)[0] & np.uint64(3), *hashes(codes, buckets)[1:])
    for rows, block, buckets, f in ((1, 1 << 15, 1, hashes), (40, 7, 5, hashes), (500, 64, 3, few), (100_000, 16, 9, few)):
        monkeypatch.setattr(grams, "ROWS", rows)
        monkeypatch.setattr(grams, "BLOCK", block)
        monkeypatch.setattr(grams, "_hashes", f)
        x = pd.concat([*grams.packed([pd.DataFrame({"text": train})], buckets, True), *grams.packed([pd.DataFrame({"doc_id": test.keys(), "text": test.values()})], buckets, False)])
        x = x.sort_values(["bucket", "train"])
        got = pd.concat(grams.leaks([x[:3], x[3:]])).groupby("doc_id").sum()
        assert {k: (y.present, y.distinctive) for k, y in got.iterrows()} == want


def split_name_of(x):
    return (x or "").strip().lower()


def test_byte_ids_of_texts(spark, tmp_path):
    rows = [(1, "aä<eos>\n<task></task>"), (2, ""), (3, None), (4, "<eos"), (5, "🌑" * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["ids"] for r in text_ops.text_byte_token_ids(spark, str(tmp_path)).collect()}
    raw = lambda x: [13 + b for b in x.encode()]
    assert got == {1: [*raw("aä"), 2, *raw("\n"), 4, 5], 2: [], 4: raw("<eos"), 5: raw("🌑" * 5000)}


def test_scanner():
    assert scan.strip_comments('a = "# no" # yes\nb') == 'a = "# no" \nb'
    assert scan.dedup_form("x  =  1 # c\n\n  y") == "x = 1\ny"
    assert not scan.unbalanced('f("(") # (') and scan.unbalanced("f((1)") and scan.unbalanced("a]")
    assert scan.function_blocks("func a():\n\tpass\n\treturn\n\nfunc b():\n\tpass\n") == [(0, "func a():\n\tpass\n\treturn")]
    page = "Text\n\n.. code-block:: gdscript\n   :linenos:\n\n    func a():\n        print(1234567890)\n\nEnd\n"
    assert scan.rst_snippets(page) == [(1, "func a():\n    print(1234567890)")]


def test_simhash():
    a = "func move ( delta ) : position += speed * delta".split()
    assert ident.simhash_of([]) == 0
    assert ident.simhash_of(a) == ident.simhash_of(list(a))
    assert bin((ident.simhash_of(a * 9) ^ ident.simhash_of(a * 9 + ["end"])) & (2**64 - 1)).count("1") < 20


def test_near_first_match(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(12)]
    data = []
    for k in range(160):
        h = rnd.choice(base)
        for _ in range(rnd.randrange(4)):
            h ^= 1 << rnd.randrange(48)
        data.append((f"{k:04d}", rnd.choice([100, 101, 110, 130]), h))
    want = {}
    for i, (a, n, h) in enumerate(data):
        for b, m, g in data[:i]:
            same = (h >> 48) ^ (n.bit_length() - 1) == (g >> 48) ^ (m.bit_length() - 1)
            if same and bin(h ^ g).count("1") <= 3 and min(n, m) >= 0.8 * max(n, m):
                want[a] = b
                break
    got = dedup.near_first_match(spark.createDataFrame(data, "id string, tokens long, simhash long"), "id").collect()
    assert {r["id"]: r["near_duplicate_of"] for r in got} == want


def test_first_wins_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("k", None, "b"), ("k", "s", "a"), ("k", None, "a2"), ("m", "s", "z")], "key string, src string, id string")
    got = {r["id"]: (r["first_id"], r["duplicate"]) for r in dedup.first_wins(df, "key", ["src", "id"], "id").collect()}
    assert got == {"a2": ("a2", False), "b": ("a2", True), "a": ("a2", True), "z": ("z", False)}


def test_forced_split_fills_empty_splits(spark):
    got = splits.forced(spark.createDataFrame([(f"u{k}",) for k in range(4)], "unit string")).collect()
    assert len(got) == 4 and {r["split"] for r in got} >= {"val", "test"}
    assert splits.forced(spark.createDataFrame([], "unit string")).count() == 0


def test_offsets_and_next_fit(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "b", None]), f"{k:03d}", rnd.randrange(1, 9)) for k in range(300)]
    df = spark.createDataFrame(data, "g string, k string, n long")
    off = {(r["g"], r["k"]): r["o"] for r in packing.offsets(df, "g", ["k"], "n", "o").collect()}
    fit = {(r["g"], r["k"]): (r["shard"], r["shard_offset"]) for r in packing.next_fit(df, "g", ["k"], "n", 10).collect()}
    for g in ("a", "b", None):
        total = shard = used = 0
        for _, k, n in sorted((x for x in data if x[0] == g), key=lambda x: x[1]):
            assert off[g, k] == total
            total += n
            if used and used + n > 10:
                shard, used = shard + 1, 0
            assert fit[g, k] == (shard, used)
            used += n


def test_as_of_and_range(spark):
    rnd = random.Random(2)
    left = [(rnd.randrange(4), rnd.randrange(100), k) for k in range(60)]
    right = [(rnd.randrange(4), rnd.randrange(100), k) for k in range(60)]
    a, b = spark.createDataFrame(left, "u long, t long, l long"), spark.createDataFrame(right, "u long, t long, r long")
    got = {x["l"]: x["r"] for x in joins.as_of(a, b, "u", "t", "l", "r").collect()}
    for u, t, k in left:
        before = [(y, r) for v, y, r in right if v == u and y <= t]
        assert got[k] == (max(before)[1] if before else None)
    n = {x["l"]: x["n"] for x in joins.range_count(a, b, "t", 7, "l", "n").collect()}
    for _, t, k in left:
        assert n[k] == sum(t - 7 <= y <= t for _, y, _ in right)


def test_one_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 0, "y")], "k string, n int, s string")
    assert [tuple(r) for r in one_per_key(df, "k", "n", "s").collect()] == [("a", 1, "x")]


def test_archives_and_json_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("p/a.gd", "extends Node")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", "x")
    (tmp_path / "broken.zip").write_bytes(b"no")
    e = files.archive_entries(spark, str(tmp_path))
    got = {r["archive"].rsplit("/", 1)[1]: r["ok"] for r in files.archive_preflight(e).collect()}
    assert got == {"good.zip": True, "bad.zip": False, "broken.zip": False}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    ok, bad = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r["a"] for r in ok.collect()) == [1, 2] and bad.count() == 1
    (tmp_path / "t.gd").write_bytes(b"\xef\xbb\xbfextends")
    (tmp_path / "u.GD").write_bytes(b"caf\xe9")
    got = {r["text"]: r["encoding"] for r in files.read_texts(spark, str(tmp_path), "gd").collect()}
    assert got == {"extends": "utf-8", "café": "cp1252"}
    assert files.discover(spark, str(tmp_path), "gd").count() == 2


def test_empty_tables(spark, small, tmp_path):
    """Core queries over tables without rows."""
    import glob
    import os

    from siltworks.queries import registry

    for p in glob.glob(small + "/*.parquet"):
        spark.read.parquet(p).limit(0).coalesce(1).write.parquet(str(tmp_path / os.path.basename(p)))
    skip = {"stream_event_windows", "stream_job_state"}
    for name, q in registry.queries().items():
        if name not in skip:
            q(spark, str(tmp_path)).collect()


def test_next_fit_over_many_chunks(spark):
    """Against the fold, with chunks of one and two shards, rows beyond the target and empty rows."""
    import random

    from siltworks.operators import packing

    rnd = random.Random(3)
    rows = [(i, g, 0 if rnd.random() < 0.05 else rnd.choice([rnd.randrange(1, 40), rnd.randrange(1, 40), 260])) for g in ("a", "b", None) for i in range(400 if g == "a" else 30)]
    df = spark.createDataFrame(rows, "i long, g string, n long")
    keep = packing.CHUNK
    try:
        for packing.CHUNK in (1, 2, 64):
            got = {(r["g"], r["i"]): (r["shard"], r["shard_offset"]) for r in packing.next_fit(df, "g", ["i"], "n", 100).collect()}
            for g in ("a", "b", None):
                shard, used = 0, 0
                for i, h, n in rows:
                    if h == g:
                        if used and used + n > 100:
                            shard, used = shard + 1, 0
                        assert got[g, i] == (shard, used), (packing.CHUNK, g, i)
                        used += n
    finally:
        packing.CHUNK = keep


def test_running_over_cut_groups(spark):
    """Sum, min, max and last of the rows before, with nulls, null groups and a group in several partitions."""
    import random

    from siltworks.operators.running import running

    rnd = random.Random(9)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, rnd.randrange(50)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v long")
    got = {r["i"]: (r["s"], r["lo"], r["hi"], r["la"]) for r in running(df, "g", ["i"], s=("sum", "v"), lo=("min", "v"), hi=("max", "v"), la=("last", "v")).collect()}
    for i, g, _ in rows:
        b = [v for j, h, v in rows if h == g and j < i and v is not None]
        assert got[i] == ((sum(b), min(b), max(b), b[-1]) if b else (None,) * 4), i


def test_sweep_removes_what_was_stored(spark):
    from siltworks import session

    x = session.stored(spark.range(3), "swept")
    assert x.count() == 3
    path = x._siltworks_path
    session.sweep(spark)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
