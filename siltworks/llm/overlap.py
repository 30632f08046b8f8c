"""Same or near-same records across splits.

Texts are normalised (comments, layout and, in code, the plain names dropped) into units: lines, or
pieces of long lines and of JSON cut at content-defined places. Two records of different splits are a
case when they share at least SHARE of the distinct units of the larger one and the passages of the
evaluation text cover it: Aho-Corasick automata over the sharded evaluation passages scan the training
texts that reach the shard, matched intervals are merged, and both the normalised coverage and, as the
exact check, the coverage with names kept must be high enough.

So that not every training text meets every shard, routing is by an exact prefix filter: units are
ordered by how many distinct texts hold them, and two texts that share k of their units must share one
among the first n - k + 1 of each. A unit that a third of all texts hold is last in that order and is
only ever looked at for texts that have nothing rarer; nothing is capped or dropped. Copies with the
same normalised text are one class before anything is joined, and pairs are expanded at the very end,
because the query asks for record pairs.

Defined cases: null, empty and blank texts are no text; records without a known split are in none;
texts that have no unit (fewer than UNIT characters) are compared by their whole normalised text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.session import discard, spread, stored
from siltworks.sources.tables import records, split_name, table

#: Share of the larger text's distinct units that both must have.
SHARE = 0.5
#: Coverage of the evaluation text's characters by passages found in the training text: names dropped, names kept.
COVERED, COVERED_EXACT = 0.5, 0.25
#: Least characters of a unit, and of one in JSON; those beyond which a line is cut, at places that its content gives.
UNIT, UNIT_JSON, LONG = 8, 4, 160
#: Evaluation characters for which one automaton is built, and training characters scanned with it in one
#: task; where more are routed to a shard, its automaton is built once per block of them.
SHARD_CHARS, BLOCK_CHARS = 4_000_000, 32_000_000

#: Texts in some pair up to which a hash of each, eight bytes, is broadcast; beyond, all texts are shuffled.
BROADCAST_TEXTS = 2_000_000

_QUOTED = r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
_COMMENT = r"(?m)" + _QUOTED + r"|(?:^|(?<=\s))(?:#|//|;)[^\n]*+"
_NAME = _QUOTED + r"""|(?<![.\w$"])[A-Za-z_]\w*+(?!\()"""
_JSON = r"^\s*(?:\{|\[\s*(?:[\"\d\-{\[\]]|true\b|false\b|null\b))"  # and not the [section] of a configuration
_CODE = r"(?m)^[ \t]*(?:func|var|const|let|function|extends|static|class_name|class|signal)\b"


def plain(text: Column) -> Column:
    """Comments gone, line ends as LF, no other white space; JSON on one line."""
    return _plain(_bare(text))


def nameless(text: Column) -> Column:
    """plain(), in code also without the names that are not called or reached by a dot."""
    return _nameless(_bare(text), text.rlike(_CODE))


def _bare(text: Column) -> Column:
    """Comments gone, line ends as LF."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "﻿", ""), "\r\n?", "\n"), _COMMENT, "$1")


def _plain(bare: Column) -> Column:
    return F.when(bare.rlike(_JSON), F.regexp_replace(bare, r"\s+", "")).otherwise(F.regexp_replace(bare, r"[^\S\n]+", ""))


def _nameless(bare: Column, code: Column) -> Column:
    return F.when(code, F.regexp_replace(F.regexp_replace(bare, _NAME, "$1"), r"[^\S\n]+", "")).otherwise(_plain(bare))


def units(norm: Column) -> Column:
    """The units of a normalised text, in order: one for every line, a line of more than LONG characters
    being cut; JSON is cut after each comma and bracket. A line shorter than UNIT is no unit of its own, as it
    stands in too many texts, but goes on over the lines that follow until it is that long, so that no line is
    left out and an edit changes only the units that begin just ahead of it."""
    json = norm.rlike(_JSON)
    pieces = lambda x: F.when(F.length(x) > LONG, F.regexp_replace(x, r"([;{}7Kz])", "$1\n")).otherwise(x)
    cut = F.when(norm.rlike(r"[^\n]{%d}" % (LONG + 1)), F.array_join(F.transform(F.split(norm, "\n"), pieces), "\n")).otherwise(norm)
    lines = F.regexp_replace(F.when(json, F.regexp_replace(norm, r"([,{}\[\]])", "$1\n")).otherwise(cut), r"\n\n+", "\n")
    from_here = lambda n: F.lit(r"(?md)^(?=([^\n][\s\S]{%d}[^\n]*+(?:\n[\s\S]{0,%d}\z)?))" % (n - 1, n - 1))
    return F.when(json, F.regexp_extract_all(lines, from_here(UNIT_JSON), F.lit(1))).otherwise(F.regexp_extract_all(lines, from_here(UNIT), F.lit(1)))


def normalised(t: DataFrame, *keep: str) -> DataFrame:
    """t(text, ...) -> keep, p (plain) and q (nameless); comments are taken out once for both."""
    b = t.select(*keep, _bare(F.col("text")).alias("b"), F.col("text").rlike(_CODE).alias("code"))
    return b.select(*keep, _plain(F.col("b")).alias("p"), _nameless(F.col("b"), F.col("code")).alias("q"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """staged_path and text, blank texts left out."""
    return spread(table(spark, d, "staged_files", "staged_path", "text").where(F.col("staged_path").isNotNull() & F.col("text").rlike(r"\S")))


def members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The records with text and a split (record_id, staged_path, source_id, split, text_id, cls), and the
    classes (cls, text_id, n, ev, tr, h): one row per distinct normalised text with its unit hashes."""
    r = records(spark, d, "staged_path", "split", "source_id").select("record_id", "staged_path", "source_id", split_name("split").alias("split"))
    r = r.where("split is not null and staged_path is not null")
    # Hashes are taken where the text is read: no text is shuffled.
    p = normalised(_texts(spark, d), "staged_path").select(
        "staged_path", F.md5("p").alias("text_id"), F.array_sort(F.array_distinct(F.transform(units(F.col("q")), lambda x: F.xxhash64(x)))).alias("h")
    )
    one = p.groupBy("staged_path").agg(F.min(F.struct("text_id", "h")).alias("b"))
    m = stored(r.join(one, "staged_path").select("record_id", "staged_path", "source_id", "split", "b.text_id", "b.h"), "members")
    # Classes get a short number: it is what every posting carries. It is fixed once the table is written.
    classes = m.groupBy("text_id").agg(
        F.min("h").alias("h"), F.max(F.col("split") != "train").alias("ev"), F.max(F.col("split") == "train").alias("tr"), F.min("staged_path").alias("at")
    )
    classes = stored(classes.withColumns({"n": F.size("h"), "cls": F.monotonically_increasing_id()}), "classes")
    out = stored(m.drop("h").join(classes.select("text_id", "cls"), "text_id"), "membership")
    discard(m)
    return out, classes


def routed(classes: DataFrame) -> DataFrame:
    """Pairs (e, t) of classes, evaluation and training side, that pass the prefix filter: no pair that
    shares SHARE of the larger one's units is missing."""
    post = classes.where("n > 0").select("cls", "n", "ev", "tr", F.explode("h").alias("u"))
    df = post.groupBy("u").agg(F.count("*").alias("df"), F.count_if(F.col("ev")).alias("de"), F.count_if(F.col("tr")).alias("dt")).where("df > 1 and de > 0 and dt > 0")
    shared = post.join(df.select("u", "df"), "u").groupBy("cls", "n", "ev", "tr").agg(F.sort_array(F.collect_list(F.struct("df", "u"))).alias("s"))
    keep = F.size("s") - F.ceil(F.col("n") * SHARE).cast("int") + 1
    pre = stored(
        shared.withColumns({"_k": keep, "m": F.size("s")}).where("_k > 0").select("cls", "n", "m", "ev", "tr", F.posexplode(F.slice("s", 1, F.col("_k"))).alias("at", "x")).select("cls", "n", "m", "at", "ev", "tr", "x.u"),
        "prefix",
    )
    e = pre.where("ev").select("u", F.col("cls").alias("e"), F.col("n").alias("ne"), (F.col("m") - F.col("at")).alias("me"))
    t = pre.where("tr").select("u", F.col("cls").alias("t"), F.col("n").alias("nt"), (F.col("m") - F.col("at")).alias("mt"))
    near = (F.col("e") != F.col("t")) & (F.col("ne") >= F.col("nt") * SHARE) & (F.col("nt") >= F.col("ne") * SHARE)
    # At the first unit that two texts have in common, both must still have enough units from there on; so a
    # common unit late in both prefixes, as a unit of nearly all texts is, makes no pair by itself.
    enough = F.least("me", "mt") >= F.greatest("ne", "nt") * SHARE
    out = stored(e.join(t, "u").where(near & enough).select("e", "t").distinct(), "pairs")
    discard(pre)
    return out


def _merged(spans: list[tuple[int, int]]) -> int:
    """Length of the union of intervals."""
    total, end = 0, -1
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def _scan(e: pd.DataFrame, t: pd.DataFrame, col: str) -> dict[tuple[int, int], tuple[float, float]]:
    """Coverage (of the evaluation text, of the training text) for each wanted pair of rows."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    where: dict[str, list[tuple[int, int, int]]] = {}
    whole: list[int] = []
    for i, us in enumerate(e[col]):
        at = 0
        for x in us:
            where.setdefault(x, []).append((i, at, at + len(x)))
            at += len(x)
        whole.append(max(1, at))
    for x in where:
        auto.add_word("\n" + x + "\n", x)
    auto.make_automaton()
    out: dict[tuple[int, int], tuple[float, float]] = {}
    for j, (us, wanted) in enumerate(zip(t[col], t["wanted"])):
        want = set(wanted)
        own: dict[int, list[tuple[int, int]]] = {i: [] for i in want}
        there: dict[int, list[tuple[int, int]]] = {i: [] for i in want}
        text = "\n\n".join(us)
        for end, x in auto.iter("\n" + text + "\n"):
            for i, a, b in where[x]:
                if i in want:
                    own[i].append((a, b))
                    there[i].append((end - len(x), end))
        size = max(1, sum(len(x) for x in us))
        for i in want:
            out[i, j] = (_merged(own[i]) / whole[i], _merged(there[i]) / size)
    return out


def _covered(key, ev: pd.DataFrame, tr: pd.DataFrame) -> pd.DataFrame:
    """Scan the training texts routed to one shard of evaluation passages."""
    if not len(ev) or not len(tr):
        return pd.DataFrame({"e": [], "t": [], "covered": [], "exact": []})
    ids = {c: i for i, c in enumerate(ev["e"])}
    tr = tr.rename(columns={"tu": "u", "tx": "x"}).assign(wanted=[[ids[c] for c in w if c in ids] for w in tr["es"]])
    soft, hard = _scan(ev, tr, "u"), _scan(ev, tr, "x")
    rows = [
        (ev["e"].iat[i], tr["t"].iat[j], min(a, b), min(hard[i, j]))
        for (i, j), (a, b) in soft.items()
        if min(a, b) >= COVERED and min(hard[i, j]) >= COVERED_EXACT
    ]
    return pd.DataFrame(rows, columns=["e", "t", "covered", "exact"])


def class_pairs(spark: SparkSession, d: str, classes: DataFrame) -> DataFrame:
    """(e, t, covered, exact): pairs of different classes that are near-same."""
    pairs = routed(classes)
    need = pairs.select(F.col("e").alias("cls")).union(pairs.select("t")).distinct()
    at = stored(classes.select("cls", "at", "text_id").join(need, "cls"), "wanted")
    t = _texts(spark, d)
    if at.count() <= BROADCAST_TEXTS:
        # Hashes of the paths are sent to the texts, so that the others aren't shuffled; the join below is exact.
        t = t.join(F.broadcast(at.select(F.xxhash64("at").alias("_p"))), F.xxhash64("staged_path") == F.col("_p"), "left_semi")
    # Only texts that are in some pair are normalised again and sent on; of several texts of one path, that
    # which the class was made of. The comparison is wrapped: a bare one would be taken as a filter on all texts.
    again = normalised(t.join(at, F.col("staged_path") == F.col("at")), "cls", "text_id").where(F.coalesce(F.md5("p") == F.col("text_id"), F.lit(False)))
    texts = stored(again.groupBy("cls").agg(F.min(F.struct("q", "p")).alias("b")).select("cls", units(F.col("b.q")).alias("u"), units(F.col("b.p")).alias("x")), "texts")
    discard(at)
    sizes = texts.select("cls", F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("size"))
    chars = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, int(chars // SHARD_CHARS) + 1)
    shard = F.pmod(F.xxhash64("e"), F.lit(shards)).cast("int")
    # Shards and blocks are settled over ids and sizes; texts are sent on once, to where they are scanned. The
    # set of a training text holds at most the evaluation texts of one shard, of SHARD_CHARS together.
    wanted = pairs.withColumn("shard", shard).groupBy("shard", "t").agg(F.collect_set("e").alias("es")).join(sizes, F.col("t") == F.col("cls")).drop("cls")
    blocks = wanted.groupBy("shard").agg(F.ceil(F.sum("size") / BLOCK_CHARS).alias("blocks"))
    wanted = wanted.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("t", F.lit(1)), F.col("blocks")).alias("block"), "t", "es")
    own = pairs.select("e").distinct().withColumn("shard", shard).join(blocks, "shard")
    own = own.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "e")
    ev = own.join(texts, F.col("e") == F.col("cls")).select("shard", "block", "e", "u", "x")
    tr = wanted.join(texts, F.col("t") == F.col("cls")).select("shard", "block", "t", "es", "u", "x").toDF("shard", "block", "t", "es", "tu", "tx")
    return ev.groupBy("shard", "block").cogroup(tr.groupBy("shard", "block")).applyInPandas(_covered, "e long, t long, covered double, exact double")


def links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(members, class links e-t with their coverage; a class linked to itself holds equal texts)."""
    m, classes = members(spark, d)
    near = class_pairs(spark, d, classes)
    same = classes.where("ev and tr").select(F.col("cls").alias("e"), F.col("cls").alias("t"), F.lit(1.0).alias("covered"), F.lit(1.0).alias("exact"))
    return m, stored(near.unionByName(same), "links")


def found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records, one in train, the other in val or test, with the same or nearly the same text."""
    m, k = links(spark, d)
    e = m.where("split != 'train'").select(F.col("record_id").alias("re"), F.col("cls").alias("e"))
    t = m.where("split = 'train'").select(F.col("record_id").alias("rt"), F.col("cls").alias("t"))
    return k.select("e", "t").join(e, "e").join(t, "t").select(F.least("re", "rt").alias("record_id_a"), F.greatest("re", "rt").alias("record_id_b")).distinct()


def report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: records with text, those with an equal or near-same train
    record, the number of such pairs and the mean coverage of the best link."""
    m, k = links(spark, d)
    nt = m.where("split = 'train'").groupBy(F.col("cls").alias("t")).agg(F.count("*").alias("nt"))
    per = k.join(nt, "t").groupBy("e").agg(F.sum("nt").alias("pairs"), F.max("covered").alias("covered"))
    ev = m.where("split != 'train'").select("record_id", "split", "source_id", F.col("cls").alias("e")).join(per, "e", "left")
    return ev.groupBy("split", "source_id").agg(
        F.count("*").alias("records"),
        F.count("pairs").alias("leaked"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.round(F.avg("covered"), 4).alias("mean_coverage"),
    )


def classes_of(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with text and split: its class and its number of near-same classes across
    the splits."""
    m, k = links(spark, d)
    n = k.select(F.explode(F.array_distinct(F.array("e", "t"))).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return m.join(n, "cls", "left").select("record_id", F.col("text_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p1_found": found, "p1_report": report, "p1_classes": classes_of}
SQL: dict[str, str] = {}
