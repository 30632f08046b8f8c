"""Reading level of each document.

Prose is what is left of a text without code blocks, code lines, logs, headings, inline code and markup.
Words are ranked by frequency over all prose of their language; a document's coverage rank is the size of
the smallest vocabulary, taken from the top of that ranking, that covers a fixed share of its words.
Coverage ranks and sentence complexity are calibrated against the labelled grades by ridge least squares,
once against the grade and once against being of the highest grade: the moments are sums in SQL over all
labelled documents, and only their matrix reaches the driver. Scores are SQL again; the highest grade is
where the second score passes a half. The most frequent words are ranked on every worker; a document whose
share isn't covered by those gets its ranks by a join with the whole ranking, so no rank has a ceiling.

Defined cases: null and blank texts, and texts without prose, have no grade; several raters of a document
count by their mean; grades are cut to 1..4; with fewer than MIN_LABELS labelled documents there is no
calibration and no grade; a repeated doc_id counts once, by its least text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.packing import offsets
from siltworks.session import spread, stored
from siltworks.sources.tables import table

#: Shares of a document's words that the vocabulary must cover.
COVER = (0.5, 0.8, 0.9)
#: Ranked words per language that are sent to the workers; ranks beyond are joined.
VOCABULARY = 50_000
#: Labelled documents that a calibration needs; weight of the ridge.
MIN_LABELS, RIDGE = 20, 1.0
#: Fewest words that are prose; score from which a document is of the highest grade.
MIN_WORDS, TOP = 1, 0.5
FEATURES = ["wps", "lpw", "cps", "longs", "c50", "c80", "c90"]

_FENCES = (("```", "```"), ("~~~", "~~~"), ("[code", "[/code"), ("<pre", "</pre"), ("<code", "</code"), ("{{{", "}}}"))
#: Lines of code, of logs and headings, without the blanks about them.
_SKIP = re.compile(
    r"(?:func |enum |static |var |const |extends |class_name |@\w|signal |return\b|print\(|emit_signal|await |import |def |[{}]"
    r"|(?:if|elif|for|while|match|else|class) ?[^.]*:$|[\w.]+\(.*\)[;:]?$|[\w.]+ ?[-+*/:]?= ?\S.*$"
    r"|\[?\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d:\d\d|\[?(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b|\[ *\d+ ?%\]|at \S+:\d+|(?:passed|failed|skipped|accepted) \S+://|\w+=\S+(?: \w+=\S+)*"
    r"|#{1,6} |\[b\].*\[/b\]$|=+ .* =+$|<h\d|\.\. |:\w+:)"
)
_RULE = re.compile(r"([=\-~^*\"+#_.])\1{2,}$")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)]) ")
_INLINE = re.compile(r"`[^`\n]*`|\[/?[a-z]+(?:=[^\]]*)?\]|</?\w[^>\n]*>")
#: A word with nothing but punctuation about it, and what follows it.
_WORD = re.compile(r"(?<!\S)[\"'(\[*_“„]*([^\W\d_]+(?:['’-][^\W\d_]+)*)([.,;:!?)\]\"'*_”“]*)(?!\S)")
#: Frequent words that tell German.
_GERMAN = frozenset("der die das und ist nicht ein eine einer des dem den von mit auf für sich wird werden bei nach auch als im zu dass oder wenn du wir".split())


def prose_counts(text: str) -> tuple[bool, int, int, int, int, int, Counter]:
    """(German, words, sentences, letters, commas, long words, words by count) of a text's prose. The end
    of a paragraph or list item ends a sentence."""
    kept: list[str] = []
    close, inside = "", -1
    for line in text.split("\n"):
        x = line.strip()
        if close:
            if close in x:
                close = ""
            continue
        if not x:
            if kept and kept[-1] and kept[-1][-1] not in ".!?:":
                kept[-1] += "."
            continue
        if inside >= 0:
            if len(line) - len(line.lstrip()) > inside:
                continue
            inside = -1
        c = x[0]
        if c in "`~[<{":
            for a, b in _FENCES:
                if x.startswith(a):
                    close = "" if b in x[len(a) :] else b
                    x = ""
                    break
            if not x:
                continue
        if c == "." and x.startswith(".. "):
            inside = len(line) - len(line.lstrip())
            continue
        if line[0] == "\t" or line.startswith("    "):
            continue
        if _RULE.match(x):
            if kept and not kept[-1].endswith("."):
                kept.pop()  # the rule underlines a heading
            continue
        if _SKIP.match(x):
            continue
        if _ITEM.match(x):
            if kept and kept[-1][-1:] not in (".", "!", "?", ":"):
                kept[-1] += "."
            x = x.split(" ", 1)[1]
        if "`" in x or "[" in x or "<" in x:
            x = _INLINE.sub(" ", x)
        kept.append(x)
    if kept and kept[-1][-1:] not in (".", "!", "?", ":"):
        kept[-1] += "."
    t = "\n".join(kept)
    words: Counter = Counter()
    sentences = commas = 0
    for w, tail in _WORD.findall(t):
        words[w.lower()] += 1
        if tail:
            if "." in tail or "!" in tail or "?" in tail or ":" in tail:
                sentences += 1
            elif "," in tail:
                commas += 1
    n = sum(words.values())
    german = sum(c for w, c in words.items() if w in _GERMAN) > 0.08 * n
    edge = 13 if german else 10
    return german, n, max(1, sentences), sum(len(w) * c for w, c in words.items()), commas, sum(c for w, c in words.items() if len(w) >= edge), words


_COUNTS = "doc_id long, de boolean, n long, sentences long, letters long, commas long, longs long, words array<string>, counts array<int>"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for k, text in zip(pdf["doc_id"], pdf["text"]):
            de, n, s, letters, commas, longs, words = prose_counts(text)
            if n >= MIN_WORDS:
                rows.append((k, de, n, s, letters, commas, longs, list(words), list(words.values())))
        yield pd.DataFrame(rows, columns=["doc_id", "de", "n", "sentences", "letters", "commas", "longs", "words", "counts"])


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Per document with prose: language, words, sentences, letters, commas, long words, and its words."""
    src = table(spark, d, "documents", "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    return stored(spread(src).mapInPandas(_count, _COUNTS), "prose")


def frequencies(counts: DataFrame) -> DataFrame:
    """de, w, c: how often each word occurs in the prose of a language."""
    return stored(counts.select("de", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("de", F.col("x.words").alias("w")).agg(F.sum("x.counts").alias("c")), "words")


def ranking(freq: DataFrame, most: int) -> dict[bool, dict[str, int]]:
    """The `most` most frequent words of each language with their ranks."""
    return {
        de: {r["w"]: i for i, r in enumerate(freq.where(F.col("de") == de).orderBy(F.desc("c"), "w").limit(most).select("w").collect(), 1)}
        for de in (False, True)
    }


def _covered(ranks: np.ndarray, counts: np.ndarray, n: int) -> list[int]:
    """The ranks up to which a document's words are covered, for each share of COVER."""
    o = np.argsort(ranks, kind="stable")
    upto = np.cumsum(counts[o])
    return [int(ranks[o[np.searchsorted(upto, math.ceil(q * n))]]) for q in COVER]


def _features(pdf: pd.DataFrame, cover: list[list[int]]) -> pd.DataFrame:
    logs = np.log(np.array(cover, dtype=float).reshape(len(pdf), len(COVER)))
    return pd.DataFrame(
        {
            "doc_id": pdf["doc_id"],
            "de": pdf["de"].astype(float),
            "n": pdf["n"],
            "wps": np.log1p(pdf["n"] / pdf["sentences"]),
            "lpw": pdf["letters"] / pdf["n"],
            "cps": np.log1p(pdf["commas"] / pdf["sentences"]),
            "longs": pdf["longs"] / pdf["n"],
            **{f"c{round(100 * q)}": logs[:, i] for i, q in enumerate(COVER)},
        }
    )


_SCHEMA = "doc_id long, de double, n long, wps double, lpw double, cps double, longs double, c50 double, c80 double, c90 double"


def features(spark: SparkSession, d: str, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, de, n and FEATURES: words per sentence, letters per word, commas per sentence, share of long
    words, and the logarithms of the coverage ranks."""
    counts = counted(spark, d)
    freq = frequencies(counts)
    ranks = spark.sparkContext.broadcast(ranking(freq, vocabulary))  # at most 2 * vocabulary words

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ranks.value
        for pdf in batches:
            got, over = [], []
            for de, n, words, cs in zip(pdf["de"], pdf["n"], pdf["words"], pdf["counts"]):
                rk = known[bool(de)]
                last = len(rk) + 1
                got.append(_covered(np.fromiter((rk.get(w, last) for w in words), dtype=np.int64, count=len(words)), np.asarray(cs), n))
                over.append(got[-1][-1] == last)  # the largest share: not covered by the known words
            yield _features(pdf, got).assign(over=over)

    least = lambda f: F.min(F.struct("de", "n", *FEATURES, *f)).alias("b")
    out = stored(counts.mapInPandas(cover, _SCHEMA + ", over boolean").groupBy("doc_id").agg(least(["over"])).select("doc_id", "b.*"), "features")
    if out.where("over").isEmpty():
        return out.drop("over")

    def cover_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _features(pdf, [_covered(np.array([x["r"] for x in rs]), np.array([x["c"] for x in rs]), n) for n, rs in zip(pdf["n"], pdf["ranks"])])

    rest = out.where("over").select("doc_id")
    whole = offsets(freq.withColumns({"less": -F.col("c"), "one": F.lit(1).cast("long")}), "de", ["less", "w"], "one", "before").select("de", "w", (F.col("before") + 1).alias("r"))
    keys = ["doc_id", "de", "n", "sentences", "letters", "commas", "longs"]
    x = counts.join(rest, "doc_id").select(*keys, F.xxhash64("words", "counts").alias("text"), F.explode(F.arrays_zip("words", "counts")).alias("x")).select(*keys, "text", F.col("x.words").alias("w"), F.col("x.counts").alias("c"))
    # As many ranks as a text has distinct words.
    x = x.join(whole, ["de", "w"]).groupBy(*keys, "text").agg(F.collect_list(F.struct("r", "c")).alias("ranks"))
    deep = x.drop("text").mapInPandas(cover_joined, _SCHEMA).groupBy("doc_id").agg(least([])).select("doc_id", "b.*")
    return stored(out.where("not over").drop("over").unionByName(deep), "features")


def design() -> list[str]:
    """SQL terms of the calibration: the features, their squares, and all of it again for German."""
    base = FEATURES + [f"{x} * {x}" for x in FEATURES]
    return base + ["de"] + [f"de * {x}" for x in base]


Model = tuple[list[float], list[float], list[float]]  # weights, the last being the constant; means; deviations


def calibrate(f: DataFrame, labels: DataFrame) -> tuple[Model, Model] | None:
    """Least squares with a ridge over the terms, of the grade and of being of the highest grade. None without
    labels."""
    terms = design()
    g = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("y"))
    z = f.join(g, "doc_id").selectExpr("y", "CASE WHEN y >= 3.5 THEN 1D ELSE 0D END AS top", *[f"{t} AS t{i}" for i, t in enumerate(terms)])
    k = len(terms)
    sums = [F.sum(f"t{i}").alias(f"s{i}") for i in range(k)] + [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(f"t{i}") * F.col(c)).alias(f"{c}{i}") for i in range(k) for c in ("y", "top")]
    m = z.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("top").alias("top"), *sums).first()
    n = m["n"]
    if n < MIN_LABELS:
        return None
    mean = np.array([m[f"s{i}"] for i in range(k)]) / n
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = m[f"p{i}_{j}"] / n - mean[i] * mean[j]
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    a = cov / np.outer(dev, dev) + RIDGE / n * np.eye(k)

    def fit(c: str) -> Model:
        mc = m[c] / n
        w = np.linalg.solve(a, (np.array([m[f"{c}{i}"] for i in range(k)]) / n - mean * mc) / dev)
        return [*map(float, w), float(mc)], list(map(float, mean)), list(map(float, dev))

    return fit("y"), fit("top")


def _linear(model: Model) -> str:
    w, mean, dev = model
    return f"({w[-1]!r}D) + " + " + ".join(f"({a!r}D) * ({t} - ({m!r}D)) / {s!r}D" for a, t, m, s in zip(w, design(), mean, dev))


def graded(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, words, coverage_rank (at 90 %), words_per_sentence, score, top (how far it is of the highest
    grade, from 0 to 1) and grade."""
    f = features(spark, d)
    models = calibrate(f, table(spark, d, "level_labels", "doc_id", "grade"))
    score, top = (f"least({hi}D, greatest({lo}D, {_linear(m)}))" for m, lo, hi in zip(models, (1, 0), (4, 1))) if models else ("CAST(NULL AS DOUBLE)",) * 2
    x = f.selectExpr("doc_id", "n AS words", "CAST(round(exp(c90)) AS BIGINT) AS coverage_rank", "round(exp(wps) - 1, 4) AS words_per_sentence", f"{score} AS score", f"{top} AS top")
    grade = F.when(F.col("top") >= TOP, 4).otherwise(F.least(F.round("score"), F.lit(3)))
    return x.withColumn("grade", grade.cast("int")).withColumns({"score": F.round("score", 4), "top": F.round("top", 4)})


def found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose prose is of the highest grade."""
    return graded(spark, d).where("grade = 4").select("doc_id")


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Per source and grade: documents, words and mean score; texts without prose have a null grade."""
    all_docs = table(spark, d, "documents", "doc_id", "source").where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    g = all_docs.join(graded(spark, d), "doc_id", "left").withColumn("source", F.lower(F.regexp_replace(F.trim("source"), "_", "-")))
    return g.groupBy("source", "grade").agg(F.count("*").alias("documents"), F.sum("words").alias("words"), F.round(F.avg("score"), 4).alias("mean_score"))


QUERIES = {"p9_found": found, "p9_grades": graded, "p9_profile": profile}
SQL: dict[str, str] = {}
