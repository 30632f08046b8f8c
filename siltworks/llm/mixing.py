"""Mixing sources to target weights.

Every document has a membership over the targeted sources. Where its source is written, in whatever
spelling, it belongs to that source; where it is null or unknown, a naive Bayes classifier over hashed
subwords, trained on the labelled documents, gives posterior probabilities. Nonnegative rates per document,
at most the repeats its source allows, are then fitted by projected gradient so that the expected tokens
per source match the targets in the least-squares sense. A document's rate follows from the gradients of all
rounds so far, each one number per source, so nothing but those goes back and forth: a round is one
aggregation in which every document takes its steps and is cut to its box after each. Rates become whole
repeats by systematic rounding in the order of size within a source, where the running count is off by one
document at most and therefore the tokens are off by one document's at most; of several starting points the
closest is taken.

The size of the mixture is the largest at which every source that has documents can supply its share
within its repeats; if no source has a cap, it is the least at which each could give all its documents once.
Targets of sources without documents cannot be met: their share is spread over the
others in proportion, and the report shows both.

Defined cases: null and blank texts have no tokens; a null max_repeats is no cap;
a target of zero or null chooses nothing; sources without a target are not used; without any usable
target the result is empty; a repeated doc_id counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import tokens
from siltworks.operators.packing import offsets
from siltworks.session import discard, spread, stored
from siltworks.sources.tables import table

#: Hashed features of the classifier, and its smoothing.
FEATURES, SMOOTH = 4096, 0.5
#: One labelled document in SAMPLE trains the classifier, more of a source that has few: about LEAST_ROWS, or all.
#: As many others, by the same hash, are held out to measure it; where all train, none is.
SAMPLE, LEAST_ROWS = 16, 64
#: Most rounds of the gradient; it ends earlier when the shares are met to TOLERANCE.
ROUNDS, TOLERANCE = 40, 1e-4
#: Fractions of rates are whole numbers of this many parts, so that their sums don't depend on order.
PARTS = 1_000_000_000
#: Starting points of the rounding that are tried for each source.
PHASES = 32


def spelled(c: Column) -> Column:
    """One spelling of a source: lower case, hyphens, no blanks around it."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[_\s]+", "-"), F.lit(""))


def goals(spark: SparkSession, d: str) -> DataFrame:
    """source, target_share, max_repeats: one row per targeted source."""
    t = table(spark, d, "mix_targets", "source", "target_share", "max_repeats").withColumn("source", spelled(F.col("source")))
    return t.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _read(at: str):
    """Token counts, and per batch the summed features of each labelled source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.byte_bpe(at)
        for pdf in batches:
            n, feats = [], []
            for text, role in zip(pdf["text"], pdf["role"]):
                ids = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
                n.append(len(ids))
                if role:
                    u, c = np.unique(ids * 2654435761 % 4294967291 % FEATURES, return_counts=True)
                    # A feature counts by the logarithm of how often it occurs: repeats tell less and less.
                    feats.append(list(map(int, np.repeat(u, 1 + np.log2(c).astype(np.int64)))))
                else:
                    feats.append(None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n, "f": feats, "role": pdf["role"]})

    return run


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source (one spelling, null where not known), tokens, role (train, held, asked where the source
    is not known, else null) and, where it has a role, hashed features."""
    known = [r["id"] for r in table(spark, d, "sources", "id").select(spelled(F.col("id")).alias("id")).where("id is not null").distinct().collect()]  # a fixed list
    known += [r["source"] for r in goals(spark, d).select("source").collect()]
    src = table(spark, d, "documents", "doc_id", "text", "source").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    s = spelled(F.col("source"))
    x = src.select("doc_id", "text", F.when(s.isin(known), s).alias("source"))
    # Labelled documents train the classifier, chosen by hash: a sample that grows with the data and leaves no source out.
    n = x.where("source is not null").groupBy("source").agg(F.count("*").alias("n")).collect()  # of the fixed list
    step = F.coalesce(*[F.when(F.col("source") == r["source"], max(1, min(SAMPLE, r["n"] // LEAST_ROWS))) for r in n], F.lit(1))
    at = F.pmod(F.xxhash64("doc_id"), step)
    x = x.withColumn("role", F.when(F.col("source").isNull(), "asked").when(at == 0, "train").when(at == 1, "held"))
    out = spread(x).mapInPandas(_read(tokens.folder(spark)), "doc_id long, source string, tokens long, f array<int>, role string")
    return stored(out.groupBy("doc_id").agg(F.min(F.struct("source", "tokens", "f", "role")).alias("b")).select("doc_id", "b.*").where("tokens > 0"), "documents")


def classifier(docs: DataFrame, sources: list[str]):
    """A function over batches with `f` that adds p: probabilities over `sources`, the rest of one being for
    those outside them."""
    spark = docs.sparkSession
    k = {s: i for i, s in enumerate(sources)}
    cls = F.when(F.col("source").isin(sources), F.col("source")).otherwise("")
    # FEATURES numbers per source at most.
    sums = docs.where("role = 'train'").select(cls.alias("c"), F.explode("f").alias("u")).groupBy("c", "u").agg(F.count("*").alias("n")).collect()
    prior = docs.where("source is not null").groupBy(cls.alias("c")).agg(F.count("*").alias("n")).collect()  # not of the sample, which differs by source
    m = np.full((len(sources) + 1, FEATURES), SMOOTH)
    for r in sums:
        m[k.get(r["c"], len(sources)), r["u"]] += r["n"]
    logp = np.log(m / m.sum(1, keepdims=True))
    pri = np.full(len(sources) + 1, SMOOTH)
    for r in prior:
        pri[k.get(r["c"], len(sources))] += r["n"]
    model = spark.sparkContext.broadcast((logp.astype(np.float32), np.log(pri / pri.sum())))
    width = len(sources)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lp, pr = model.value
        for pdf in batches:
            out = []
            for f in pdf["f"]:
                z = pr + lp[:, np.asarray(f, dtype=np.int64)].sum(1) if f is not None and len(f) else pr.copy()
                # Tempered: neighbouring tokens are not independent.
                z = z / math.sqrt(max(1, len(f) if f is not None else 1))
                z = np.exp(z - z.max())
                out.append((z / z.sum())[:width].tolist())
            yield pdf.drop(columns="f").assign(p=out)

    return score


def posteriors(docs: DataFrame, sources: list[str]) -> DataFrame:
    """doc_id, tokens, source and p: probabilities over `sources`, one-hot where the source is known, and
    nothing for sources outside them."""
    soft = docs.where("role = 'asked'").select("doc_id", "tokens", "f").mapInPandas(classifier(docs, sources), "doc_id long, tokens long, p array<double>")
    soft = soft.withColumn("source", F.lit(None).cast("string"))
    one = F.array(*[F.when(F.col("source") == s, 1.0).otherwise(0.0) for s in sources])
    hard = docs.where(F.col("source").isin(sources)).select("doc_id", "tokens", one.alias("p"), "source")
    return hard.unionByName(soft)


def _rates(p: np.ndarray, cap: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the given steps along the gradient, one row per round, each cut to 0 .. cap."""
    r = np.zeros(len(p))
    for v in steps:
        r = np.clip(r + p @ v, 0.0, cap)
    return r


def _matrix(pdf: pd.DataFrame, width: int) -> np.ndarray:
    return np.array(pdf["p"].tolist(), dtype=float).reshape(len(pdf), width)


def fitted(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, float, float]]]:
    """(doc_id, tokens, source, p, rate), and the goals as (source, share aimed at, cap)."""
    docs = documents(spark, d)
    g = {r["source"]: (float(r["target_share"]), float(r["max_repeats"] if r["max_repeats"] is not None else math.inf)) for r in goals(spark, d).collect()}
    have = {r["source"]: r["t"] for r in docs.where(F.col("source").isin(list(g))).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    sources = sorted(s for s in g if have.get(s) and g[s][1] > 0)
    schema = "doc_id long, tokens long, source string, p array<double>, rate double"
    if not sources:
        return spark.createDataFrame([], schema), []
    width = len(sources)
    share = np.array([g[s][0] for s in sources])
    share = share / share.sum()
    cap = np.array([g[s][1] for s in sources])
    whole = [have[s] / w for s, w in zip(sources, share)]
    size = float(min((n * c for n, c in zip(whole, cap) if c < math.inf), default=max(whole)))
    goal = share * size
    x = stored(posteriors(docs, sources), "members")
    discard(docs)
    total = np.array([have[s] for s in sources], dtype=float)
    caps = F.array(*[F.lit(float(c)) for c in cap])
    # A document may be repeated as often as its likeliest source allows, one of unknown source once.
    best = F.array_position(F.col("p"), F.array_max("p")).cast("int")
    x = x.withColumn("cap", F.when(F.col("source").isNull(), F.lit(1.0)).otherwise(F.element_at(caps, best)))

    def reach(steps: np.ndarray) -> np.ndarray:
        """Expected tokens per source at the rates that the steps lead to."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = np.zeros(width)
            for pdf in batches:
                p = _matrix(pdf, width)
                t += (_rates(p, pdf["cap"].to_numpy(), steps) * pdf["tokens"].to_numpy()) @ p
            yield pd.DataFrame({"s": range(width), "t": t})

        rows = x.select("tokens", "p", "cap").mapInPandas(run, "s int, t double").groupBy("s").agg(F.sum("t").alias("t")).collect()  # one number per source
        return np.array([t for _, t in sorted((r["s"], r["t"]) for r in rows)])

    # The gradient of half the squared distance is tokens * p . (got - goal) for a document; it is scaled by
    # the document's tokens and its sources' totals, the step that is exact where memberships are hard.
    steps = np.minimum(goal / total, np.minimum(cap, 1e9))[None, :]
    kept, least = steps, math.inf
    for _ in range(ROUNDS):
        got = reach(steps)
        err = float(np.abs(got - goal).max() / size)
        if err < least:
            kept, least = steps, err
        if err < TOLERANCE:
            break
        steps = np.vstack([steps, (goal - got) / total])

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(rate=_rates(_matrix(pdf, width), pdf["cap"].to_numpy(), kept)).drop(columns="cap")

    out = x.select("doc_id", "tokens", "source", "p", "cap").mapInPandas(rated, schema).where("rate > 0")
    return out, [(s, float(w), float(c)) for s, w, c in zip(sources, share, cap)]


def rounded(r: DataFrame) -> DataFrame:
    """r(doc_id, tokens, source, p, rate) with `repeats`, whole numbers next to the rates. A document gets
    one repeat more where the running sum of the fractions passes a whole number. The sum runs in the order
    of size, among the documents of one source, those of unknown source by their likeliest; it is taken per
    range of them and over the ranges' sums, so that a source which a third of all rows have is not one task.
    Of PHASES starting points each source takes that at which its tokens come closest to its rates'."""
    best = F.array_position(F.col("p"), F.array_max("p"))
    x = r.withColumns({"k": F.coalesce("source", F.concat(F.lit("?"), best.cast("string"))), "fr": F.round((F.col("rate") - F.floor("rate")) * PARTS).cast("long")})
    y = offsets(x, "k", ["tokens", "doc_id"], "fr", "before")
    at = lambda c, h: F.floor((c + h) / PARTS)
    more = lambda h: at(F.col("before") + F.col("fr"), h) - at(F.col("before"), h)
    phases = [PARTS * (2 * j + 1) // (2 * PHASES) for j in range(PHASES)]
    off = lambda h: F.sum(F.col("tokens") * (more(F.lit(h)) * PARTS - F.col("fr")))
    g = y.groupBy("k").agg(F.array(*[F.struct(F.abs(off(h)).alias("off"), F.lit(h).cast("long").alias("h")) for h in phases]).alias("a"))
    y = y.join(F.broadcast(g.select("k", F.array_min("a")["h"].alias("h"))), "k")  # two rows per targeted source
    return y.withColumn("repeats", (F.floor("rate") + more(F.col("h"))).cast("int")).where("repeats > 0")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, tokens, rate and repeats: the chosen documents and how often each is used."""
    r, _ = fitted(spark, d)
    return rounded(stored(r, "rates")).select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), "repeats")


def shares(spark: SparkSession, d: str) -> DataFrame:
    """Per targeted source: the share wanted, and as it is among the sources with documents (goal);
    documents of it, their tokens with repeats, most repeats and the cap; expected_tokens, which has the
    part of every document of unknown source that the classifier gives to it; and share, that of
    expected_tokens in all tokens of the mixture. One row more, with a null source, for documents of unknown
    source: their documents and tokens, and what of them belongs to no targeted source."""
    r, aims = fitted(spark, d)
    m = stored(rounded(stored(r, "rates")), "mixed")
    g = goals(spark, d)
    used = (F.col("tokens") * F.col("repeats")).alias("t")
    per = m.groupBy("source").agg(F.count("*").alias("documents"), F.sum(used).alias("tokens"), F.max("repeats").alias("most_repeats"))
    names = F.array(*[F.lit(s) for s, _, _ in aims]) if aims else F.array().cast("array<string>")
    part = F.posexplode(F.concat("p", F.array(F.greatest(F.lit(0.0), 1 - F.aggregate("p", F.lit(0.0), lambda a, q: a + q)))))
    e = m.select(used, part.alias("i", "q")).groupBy("i").agg(F.sum(F.col("t") * F.col("q")).alias("expected"))
    e = e.select(F.try_element_at(names, F.col("i") + 1).alias("source"), "expected")
    goal = spark.createDataFrame([(s, w) for s, w, _ in aims], "source string, goal double")
    total = m.agg(F.sum(used).alias("total"))
    rows = g.select("source").unionByName(spark.createDataFrame([(None,)], "source string"))
    same = lambda a, b: a.join(b.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    j = same(same(same(same(rows, g), goal), per), e)
    return j.crossJoin(F.broadcast(total)).select(  # one row
        "source",
        "target_share",
        F.round("goal", 6).alias("goal"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "max_repeats",
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.coalesce("expected", F.lit(0.0)), 1).alias("expected_tokens"),
        F.round(F.coalesce("expected", F.lit(0.0)) / F.col("total"), 6).alias("share"),
    )


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the labelled documents that were held out of the training: how many, and for how many
    the classifier's likeliest class was theirs. Sources without a target are one class, with an empty name."""
    docs = documents(spark, d)
    sources = sorted(r["source"] for r in goals(spark, d).select("source").collect())
    if not sources:
        return spark.createDataFrame([], "source string, held long, right long, accuracy double")
    held = docs.where("role = 'held'").select("doc_id", "tokens", "source", "f").mapInPandas(classifier(docs, sources), "doc_id long, tokens long, source string, p array<double>")
    rest = 1 - F.aggregate("p", F.lit(0.0), lambda a, q: a + q)
    names = F.array(*[F.lit(s) for s in sources])
    best = F.when(rest > F.array_max("p"), "").otherwise(F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))
    cls = F.when(F.col("source").isin(sources), F.col("source")).otherwise("")
    x = held.select(cls.alias("source"), best.alias("best"))
    right = F.count_if(F.col("source") == F.col("best"))
    return x.groupBy("source").agg(F.count("*").alias("held"), right.alias("right"), F.round(right / F.count("*"), 4).alias("accuracy"))


QUERIES = {"p8_mix": mixed, "p8_shares": shares, "p8_accuracy": accuracy}
SQL: dict[str, str] = {}
