"""Filling fixed-capacity containers with items.

A document longer than the capacity is cut into full pieces and a rest; everything else stays whole. What
matters for the packing is only how many items there are of each size, at most as many numbers as the
capacity has tokens, so the plan is made over this histogram, for any number of documents. It is made by
bin completion, a branch and bound: around the largest item left all fillings that no other dominates are
branches, each as often as it can be used, half as often and so on down to once; a branch is cut when its
waste exceeds what the incumbent allows, and the search goes back to the branches left. The first incumbent
is the best of a best-fit packing and a few greedy descents. The plan is optimal when it meets the lower bound or the search ends by itself; a
search that spends its budget leaves the best plan found. One step of the plan is a filling and how often it
is used. Documents are then numbered within their size, in two steps so that no size is gathered into one
task, and step and place follow from that number.

Defined cases: null and blank texts have no tokens and no container; a repeated doc_id counts once, by its
least token count; repeated texts under other ids are items of their own; profiles without a positive
capacity have no containers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.llm import tokens
from siltworks.session import discard, spread, stored
from siltworks.sources.tables import table

#: Nodes of the enumeration until the fillings found so far are tried, fullest first; nodes of one search.
ENUM_NODES, SEARCH_NODES = 2_000, 2_000_000
#: For the first incumbent only: fillings at hand, nodes of their enumeration, steps of all descents.
FILLINGS, NEAR_NODES, DESCENT_STEPS = 4, 2_000, 20_000
#: Hash buckets in which the items of one size are numbered, and rows for which there is one at least.
BUCKETS, BUCKET_ROWS = 256, 1_000_000


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and tokens of every document with text."""
    at = tokens.folder(spark)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.byte_bpe(at)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(x)) for x in pdf["text"]]})

    src = table(spark, d, "documents", "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    out = spread(src).mapInPandas(count, "doc_id long, tokens long")
    return stored(out.groupBy("doc_id").agg(F.min("tokens").alias("tokens")).where("tokens > 0"), "tokens")


# ---------------------------------------------------------------- the plan

Step = tuple[dict[int, int], int]  # sizes in one container with their counts; how many such containers


def best_fit(hist: dict[int, int], cap: int) -> list[Step]:
    """Best fit, largest first, over counts: a container is filled up with the largest items that fit,
    and the same filling is used as long as its items last."""
    left = Counter({s: n for s, n in hist.items() if n > 0})
    plan: list[Step] = []
    sizes = sorted(left)
    while sizes:
        room, fill = cap, Counter()
        i = len(sizes)
        while room > 0 and i:
            i = min(i, bisect_right(sizes, room))
            if not i:
                break
            s = sizes[i - 1]
            k = min(left[s], room // s)
            fill[s] += k
            room -= s * k
            i -= 1
        times = min(left[s] // k for s, k in fill.items())
        plan.append((dict(fill), times))
        for s, k in fill.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        sizes = sorted(left) if len(left) != len(sizes) else sizes
    return plan


def near_fillings(sizes: list[int], left: dict[int, int], room: int, least_fill: int) -> list[tuple[int, ...]]:
    """A few full ways to fill `room`, fullest first, each as a falling row of sizes: of one sum the first
    found, with the largest items."""
    out: list[tuple[int, tuple[int, ...]]] = []
    sums: set[int] = set()
    nodes = 0

    def go(i: int, room_left: int, row: tuple[int, ...], used: int) -> bool:
        nonlocal nodes
        nodes += 1
        if nodes > NEAR_NODES:
            return True
        i = min(i, bisect_right(sizes, room_left))
        if not i or not room_left:
            total = room - room_left
            if total >= least_fill and total not in sums:
                sums.add(total)
                out.append((total, row))
            return room_left == 0
        # An exact complement ends the search of this branch: it dominates whatever else has this sum.
        while i > 0:
            s = sizes[i - 1]
            same = used if row and row[-1] == s else 0
            if left[s] - same > 0:
                if go(i, room_left - s, (*row, s), same + 1):
                    return True
                if nodes > NEAR_NODES:
                    return True
            i -= 1
            if i and sizes[i - 1] * 8 < room_left and len(out) >= FILLINGS:
                break  # from here on only fillings of many small items, which better ones are at hand for
        return False

    go(len(sizes), room, (), 0)
    out.sort(key=lambda x: (-x[0], len(x[1])))
    return [r for _, r in out[:FILLINGS]]


def descents(hist: dict[int, int], cap: int, best: list[Step], bound: int) -> list[Step]:
    """The best of `best` and a few descents without a way back, as an incumbent for the search."""
    total, best_n = sum(s * n for s, n in hist.items()), sum(t for _, t in best)
    spent = 0

    def dive(skip: int) -> list[Step] | None:
        """One descent; at its first node the `skip`-th filling is taken instead of the best."""
        nonlocal spent
        left = dict(hist)
        sizes = sorted(left)
        steps: list[Step] = []
        used = waste = 0
        allowed = best_n * cap - total - cap  # beyond this waste the incumbent cannot be beaten
        first = True
        while sizes:
            spent += 1
            s = sizes[-1]
            left[s] -= 1
            if not left[s]:
                sizes.pop()
            ways = near_fillings(sizes, left, cap - s, 0) or [()]
            left[s] += 1
            if left[s] == 1:
                sizes.append(s)
            row = ways[min(skip if first else 0, len(ways) - 1)]
            first = False
            fill = Counter(row)
            fill[s] += 1
            times = min(left[x] // k for x, k in fill.items())
            lost = cap - sum(x * k for x, k in fill.items())
            if lost and times > 1 and len(sizes) > 1:
                # Waste is not repeated while other sizes could still change what fits.
                times = max(1, times // 2)
            waste += lost * times
            used += times
            if waste > allowed and used < best_n - 1:
                return None
            steps.append((dict(fill), times))
            for x, k in fill.items():
                left[x] -= k * times
                if not left[x]:
                    del left[x]
                    sizes.remove(x)
            if spent > DESCENT_STEPS:
                return None
        return steps

    for skip in range(FILLINGS):
        if best_n <= bound or spent > DESCENT_STEPS:
            break
        got = dive(skip)
        if got is not None and sum(t for _, t in got) < best_n:
            best, best_n = got, sum(t for _, t in got)
    return best


def lower_bound(hist: dict[int, int], cap: int) -> int:
    """Containers that are needed at least (Martello and Toth's L2): items above half the capacity share
    none, and those from k on fit only beside the ones that leave k."""
    best = -(-sum(s * n for s, n in hist.items()) // cap)
    half = [(s, n) for s, n in hist.items() if 2 * s > cap]
    large = sum(n for _, n in half)
    for k in {0} | {s for s in hist if 2 * s <= cap} | {cap - s + 1 for s, _ in half}:
        room = sum((cap - s) * n for s, n in half if s <= cap - k)
        small = sum(s * n for s, n in hist.items() if k <= s and 2 * s <= cap)
        best = max(best, large + max(0, -(-(small - room) // cap)))
    return best


class Spent(Exception):
    """The search has used up its nodes."""


class Search:
    """Bin completion over a histogram. `left` and `sizes` are the items of the present branch; a branch
    that is gone back to finds them as it left them."""

    def __init__(self, hist: dict[int, int], cap: int, best_n: int, nodes: int) -> None:
        self.left, self.sizes, self.cap, self.nodes = dict(hist), sorted(hist), cap, nodes
        self.total, self.best_n, self.waste = sum(s * n for s, n in hist.items()), best_n, 0
        self.spent = False

    def allowed(self) -> int:
        """The waste that is left to a plan with one container less than the incumbent."""
        return (self.best_n - 1) * self.cap - self.total - self.waste

    def take(self, fill: dict[int, int], times: int) -> None:
        for s, k in fill.items():
            self.left[s] = self.left.get(s, 0) - k * times
            if not self.left[s]:
                del self.left[s], self.sizes[bisect_left(self.sizes, s)]
            elif self.left[s] == -k * times:  # it had been used up and comes back
                insort(self.sizes, s)

    def fits(self, fill: dict[int, int], lo: int, hi: int) -> bool:
        """Whether an item of a size from lo to hi is left beside the filling."""
        return any(self.left[x] > fill.get(x, 0) for x in self.sizes[bisect_left(self.sizes, lo) : bisect_right(self.sizes, hi)])

    def dominated(self, fill: dict[int, int], top: int, room: int) -> bool:
        """Whether an item left out would still fit, or could take the place of one or two smaller ones."""
        if self.fits(fill, 1, room):
            return True
        rest = [s for s, k in fill.items() for _ in range(min(2, k - (s == top)))]
        if any(self.fits(fill, s + 1, s + room) for s in rest if room):
            return True
        return len(rest) <= 16 and any(self.fits(fill, x + y, x + y + room) for i, x in enumerate(rest) for y in rest[:i])

    def fillings(self, top: int) -> Iterator[tuple[int, dict[int, int]] | None]:
        """Every undominated filling around an item of size `top` with the room it leaves, larger items
        first; None for each node that gives no filling."""
        sizes, fill = list(self.sizes), {top: 1}
        under = [0, *accumulate(s * self.left[s] for s in sizes)]  # tokens of all sizes below the i-th

        def go(i: int, room: int) -> Iterator[tuple[int, dict[int, int]] | None]:
            self.nodes -= 1
            if self.nodes < 0:
                raise Spent
            i = min(i, bisect_right(sizes, room))
            ends = room <= self.allowed() and not self.dominated(fill, top, room)
            yield (room, dict(fill)) if ends else None
            while i and room - under[i] <= self.allowed():
                i -= 1
                s = sizes[i]
                before = fill.get(s, 0)
                for k in range(min(self.left[s] - before, room // s), 0, -1):
                    fill[s] = before + k
                    yield from go(i, room - k * s)
                fill[s] = before
                if not before:
                    del fill[s]

        return go(len(sizes), self.cap - top)

    def branches(self, top: int, least: tuple) -> Iterator[tuple[tuple, dict[int, int], int, int]]:
        """Fillings with how often to use each. Those of an enumeration's first nodes come fullest first,
        the rest as they are found. Of fillings around one size only falling rows are made: below `least`
        the same plan comes in another order."""
        found: list = []
        all_ways = self.fillings(top)
        n = 0

        def made(batch: list) -> Iterator[tuple[tuple, dict[int, int], int, int]]:
            for key, fill in sorted(batch, key=lambda x: x[0]):
                times = most = min(self.left[s] // k for s, k in fill.items())
                if key[0] and most > 1 and len(self.sizes) > 2:
                    times = most // 2  # waste is not repeated at first while other sizes could change what fits
                tried = set()
                for t in (times, most, *(most >> j for j in range(1, most.bit_length()))):
                    if t not in tried and key[0] * t <= self.allowed():
                        tried.add(t)
                        yield key, fill, t, key[0]

        for way in all_ways:
            n += 1
            if way is not None:
                key = (way[0], sum(way[1].values()), tuple(sorted(way[1].items(), reverse=True)))
                if key >= least:
                    found.append((key, way[1]))
            if found and (n >= ENUM_NODES or not found[-1][0][0]):
                batch, found = found, []
                yield from made(batch)
        yield from made(found)

    def run(self, bound: int) -> list[Step] | None:
        """The best plan below the incumbent, or None. Ends at the bound, when all branches are done, or
        when the nodes are spent."""
        best: list[Step] | None = None
        steps: list[Step] = []
        used, stack, lost = 0, [self.branches(self.sizes[-1], ())], []
        try:
            while stack and self.best_n > bound:
                got = next(stack[-1], None)
                if got is None:
                    stack.pop()
                    if steps:
                        fill, times = steps.pop()
                        self.take(fill, -times)
                        self.waste -= lost.pop()
                        used -= times
                    continue
                key, fill, times, room = got
                self.nodes -= 1
                if self.nodes < 0:
                    raise Spent
                top = self.sizes[-1]
                self.take(fill, times)
                steps.append((fill, times))
                lost.append(room * times)
                self.waste += room * times
                used += times
                if not self.sizes:
                    if used < self.best_n:
                        best, self.best_n = list(steps), used
                    stack.append(iter(()))
                elif self.allowed() < 0:
                    stack.append(iter(()))
                else:
                    stack.append(self.branches(self.sizes[-1], key if self.sizes[-1] == top else ()))
        except Spent:
            self.spent = True
        return best


def planned(hist: dict[int, int], cap: int, nodes: int = SEARCH_NODES) -> tuple[list[Step], int, bool]:
    """(fillings with how often each is used, containers needed at least, whether fewer are impossible) for
    hist(size -> count) and containers of capacity cap. A search that ends by itself without a better plan
    proves the one it began with."""
    hist = {int(s): int(n) for s, n in hist.items() if n > 0}
    full = hist.pop(cap, 0)
    head: list[Step] = [({cap: 1}, full)] if full else []
    if not hist:
        return head, full, True
    bound = lower_bound(hist, cap)
    best = descents(hist, cap, best_fit(hist, cap), bound)
    best_n = sum(t for _, t in best)
    proven = best_n == bound
    if not proven:
        search = Search(hist, cap, best_n, nodes)
        best = search.run(bound) or best
        proven = not search.spent
    return head + best, full + bound, proven


def plan(hist: dict[int, int], cap: int, nodes: int = SEARCH_NODES) -> list[Step]:
    """The fillings of planned()."""
    return planned(hist, cap, nodes)[0]


# ---------------------------------------------------------------- documents


def profiles(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """(profile, capacity) of the profiles, a fixed list of a few rows."""
    rows = table(spark, d, "train_profiles", "profile", "max_seq_len").where("profile is not null and max_seq_len > 0").groupBy("profile").agg(F.max("max_seq_len").alias("c"))
    return sorted((r["profile"], int(r["c"])) for r in rows.collect())


def items(counts: DataFrame, caps: list[tuple[str, int]]) -> DataFrame:
    """profile, doc_id, piece, size: whole documents, and the pieces of those beyond the capacity."""
    spark = counts.sparkSession
    p = spark.createDataFrame(caps, "profile string, cap long")
    x = counts.crossJoin(F.broadcast(p))  # the few rows of train_profiles
    return x.select(
        "profile",
        "doc_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / F.col("cap")))).alias("piece"),
        "tokens",
        "cap",
    ).select("profile", "doc_id", "piece", F.least("cap", F.col("tokens") - F.col("piece") * F.col("cap")).alias("size"))


def numbered(x: DataFrame, buckets: int) -> DataFrame:
    """Items with `rank`, from 0, within their profile and size, numbered in hash buckets and over these."""
    b = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    x = x.withColumn("b", b)
    n = x.groupBy("profile", "size", "b").agg(F.count("*").alias("n"))
    off = n.select("profile", "size", "b", (F.sum("n").over(W.partitionBy("profile", "size").orderBy("b")) - F.col("n")).alias("off"))
    r = F.row_number().over(W.partitionBy("profile", "size", "b").orderBy("doc_id", "piece"))
    return x.withColumn("r", r).join(off, ["profile", "size", "b"]).select("profile", "doc_id", "piece", "size", (F.col("off") + F.col("r") - 1).alias("rank"))


def segments(steps: list[Step], profile: str) -> list[tuple]:
    """(profile, size, first rank, past the last, items per container, first container) of a plan."""
    at: Counter = Counter()
    out, base = [], 0
    for fill, times in steps:
        for s, k in fill.items():
            out.append((profile, s, at[s], at[s] + k * times, k, base))
            at[s] += k * times
        base += times
    return out


_PLAN = "profile string, cap long, least long, proven boolean, steps array<struct<sizes:array<long>,counts:array<long>,times:long>>"


def _plan_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for profile, cap, h in zip(pdf["profile"], pdf["cap"], pdf["hist"]):
            steps, least, proven = planned({int(x["size"]): int(x["n"]) for x in h}, int(cap))
            rows.append((profile, cap, least, proven, [{"sizes": list(f), "counts": list(f.values()), "times": t} for f, t in steps]))
        yield pd.DataFrame(rows, columns=["profile", "cap", "least", "proven", "steps"])


def _plans(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, int, list[Step], int, bool]]]:
    """(items, [(profile, capacity, plan, least number of containers, proven)]). The profiles are searched side by
    side, each in a task of its own that gets its histogram, at most as long as the capacity; the plans, which
    are no longer than that either, come to the driver."""
    caps = profiles(spark, d)
    if not caps:
        return spark.createDataFrame([], "profile string, doc_id long, piece long, size long"), []
    counts = token_counts(spark, d)
    x = stored(items(counts, caps), "items")
    discard(counts)
    n = x.groupBy("profile", "size").agg(F.count("*").alias("n"))
    hist = n.groupBy("profile").agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("hist"))
    p = spark.createDataFrame(caps, "profile string, cap long").join(hist, "profile", "left").withColumn("hist", F.coalesce("hist", F.array().cast("array<struct<size:bigint,n:bigint>>")))
    one_each = stored(p.coalesce(1), "histograms").repartition(len(caps))  # in turn, so that each has one
    made = stored(one_each.mapInPandas(_plan_rows, _PLAN), "plan")
    plans = []
    for r in sorted(made.collect(), key=lambda r: r["profile"]):
        steps = [(dict(zip(s["sizes"], s["counts"])), s["times"]) for s in r["steps"]]
        plans.append((r["profile"], r["cap"], steps, r["least"], r["proven"]))
    return x, plans


def _placed(x: DataFrame, plans: list[tuple[str, int, list[Step], int, bool]]) -> DataFrame:
    spark = x.sparkSession
    seg = [s for p, _, steps, _, _ in plans for s in segments(steps, p)]
    s = F.broadcast(spark.createDataFrame(seg, "profile string, size long, lo long, hi long, per long, base long"))  # steps of the plans: bounded by the capacities
    most = max((hi for _, _, _, hi, _, _ in seg), default=0)  # items of the most frequent size
    y = numbered(x, max(BUCKETS, most // BUCKET_ROWS + 1)).join(s, ["profile", "size"]).where("rank >= lo and rank < hi")
    return y.select("profile", "doc_id", "piece", F.col("size").alias("tokens"), (F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).alias("container"))


def packed(spark: SparkSession, d: str) -> DataFrame:
    """profile, doc_id, piece, tokens, container: where every document, or piece of one, lies."""
    return _placed(*_plans(spark, d))


def fill(spark: SparkSession, d: str) -> DataFrame:
    """profile, container, items, tokens, room left."""
    caps = spark.createDataFrame(profiles(spark, d), "profile string, cap long")
    g = packed(spark, d).groupBy("profile", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return g.join(F.broadcast(caps), "profile").select("profile", "container", "items", "tokens", (F.col("cap") - F.col("tokens")).alias("room"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: documents, cut documents, containers, the number that is needed at least, whether it is
    proven that no plan has fewer containers, and the share filled."""
    x, plans = _plans(spark, d)
    p = stored(_placed(x, plans), "packed")
    discard(x)
    docs = p.groupBy("profile", "doc_id").agg(F.count("*").alias("pieces")).groupBy("profile").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") > 1).alias("cut"))
    c = p.groupBy("profile").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    least = spark.createDataFrame([(n, c, b, ok) for n, c, _, b, ok in plans], "profile string, cap long, least_containers long, proven boolean")
    return docs.join(c, "profile").join(F.broadcast(least), "profile").select(
        "profile", "documents", "cut", "containers", "least_containers", "proven", F.round(F.col("tokens") / (F.col("containers") * F.col("cap")), 6).alias("filled")
    )


QUERIES = {"p7_packing": packed, "p7_fill": fill, "p7_summary": summary}
SQL: dict[str, str] = {}
