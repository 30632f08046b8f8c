"""Splits that keep related records together.

Records that share a group or a project folder belong together, also through other records. The
bipartite graph of group keys and folder keys is contracted Boruvka-fashion: in every round each
component picks its least edge towards another component, the picked edges go into a spanning forest
that is written to shared storage, and the components joined by them become one. Edges are distinct
(group, folder) pairs, counted before the first shuffle, so a key that a third of all records carry is
one node and not a third of the rows. Roots are then dealt to the splits: the few that are large
against the whole one by one, the others stratified by size band, systematically along a hash order.

Defined cases: null or blank keys relate nothing; a record without keys is a component of its own; a
null or unknown split is none of the three and never makes a break by itself; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.paths import canonical_path, trimmed
from siltworks.session import discard, stored
from siltworks.sources.tables import records, split_name, table

#: A root above this share of all records is dealt one by one: at most 1 / LARGE_SHARE such roots.
LARGE_SHARE = 0.002
#: Hash buckets over which running sums are taken in two steps, and roots for which there is one at least.
DEAL_BUCKETS, BUCKET_ROOTS = 512, 1_000_000


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boruvka over edges(u STRING, v STRING), u != v.

    Returns (labels(node, root), tree(u, v, round)): the component of every node that has an edge,
    named by one of its nodes, and the spanning forest's edges. Each round at least halves the number
    of components that still have edges, so rounds are logarithmic. Both results are stored tables.
    """
    work = stored(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
        .select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")),
        "edges",
    )
    labels = stored(work.select(F.col("u").alias("node")).union(work.select("v")).distinct().withColumn("root", F.col("node")), "labels")
    tree: DataFrame | None = None
    k = 0
    while work.take(1):
        k += 1
        key = F.struct(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b"), "u", "v")
        ends = work.select(F.explode(F.array("cu", "cv")).alias("c"), key.alias("e"))
        pick = ends.groupBy("c").agg(F.min("e").alias("e"))
        hook = stored(
            pick.select("c", F.when(F.col("e.a") == F.col("c"), F.col("e.b")).otherwise(F.col("e.a")).alias("p"), F.col("e.u").alias("u"), F.col("e.v").alias("v")),
            "hook",
        )
        new = stored(hook.select("u", "v").distinct().withColumn("round", F.lit(k)), "tree")
        tree = new if tree is None else tree.unionByName(new)
        # The only cycles are pairs that picked the same edge; the lesser end is the root there.
        up = hook.select(F.col("c").alias("x"), F.col("p").alias("px"))
        par = stored(
            hook.join(up, F.col("p") == F.col("x"), "left").select(
                "c", F.when((F.col("px") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")
            ),
            "parent",
        )
        discard(hook)
        while True:  # pointer doubling: as many steps as the logarithm of the deepest chain
            above = par.select(F.col("c").alias("x"), F.col("p").alias("px"))
            nxt = stored(par.join(above, F.col("p") == F.col("x"), "left").select("c", "p", F.coalesce("px", "p").alias("q")), "parent")
            moved = nxt.where(F.col("p") != F.col("q")).take(1)
            discard(par)
            par = nxt.select("c", F.col("q").alias("p"))
            par._siltworks_path = nxt._siltworks_path
            if not moved:
                break
        m = par.select(F.col("c").alias("x"), F.col("p").alias("px"))
        nl = stored(labels.join(m, labels.root == F.col("x"), "left").select("node", F.coalesce("px", "root").alias("root")), "labels")
        ma, mb = par.select(F.col("c").alias("xa"), F.col("p").alias("pa")), par.select(F.col("c").alias("xb"), F.col("p").alias("pb"))
        nw = stored(
            work.join(ma, F.col("cu") == F.col("xa"), "left")
            .join(mb, F.col("cv") == F.col("xb"), "left")
            .select("u", "v", F.coalesce("pa", "cu").alias("cu"), F.coalesce("pb", "cv").alias("cv"))
            .where(F.col("cu") != F.col("cv")),
            "edges",
        )
        discard(labels), discard(work), discard(par)
        labels, work = nl, nw
    if tree is None:
        tree = edges.sparkSession.createDataFrame([], "u string, v string, round int")
    return labels, tree


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """record_id, split, g and p: the group and folder keys of each record, null where none."""
    r = records(spark, d, "group_id", "project_root", "split")
    g, p = canonical_path(trimmed(F.col("group_id"))), canonical_path(F.col("project_root"))
    return r.select("record_id", split_name("split").alias("split"), F.concat(F.lit("g:"), g).alias("g"), F.concat(F.lit("p:"), p).alias("p"))


def components(rec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rec with column `root`, the spanning forest). Each record hangs on one key, its group's
    or else its folder's; the graph is over keys only."""
    labels, tree = forest(rec.where(F.col("g").isNotNull() & F.col("p").isNotNull()).select(F.col("g").alias("u"), F.col("p").alias("v")))
    at = F.coalesce("g", "p", F.concat(F.lit("r:"), "record_id"))
    out = rec.withColumn("_at", at).join(labels, F.col("_at") == F.col("node"), "left")
    return out.select(*rec.columns, F.coalesce("root", "_at").alias("root")), tree


def broken(spark: SparkSession, d: str) -> DataFrame:
    """Records of a set of related records that lies in more than one split."""
    rec, _ = components(keyed(spark, d))
    rec = stored(rec.select("record_id", "split", "root"), "rooted")
    bad = rec.groupBy("root").agg(F.min("split").alias("a"), F.max("split").alias("b")).where(F.col("a") != F.col("b")).select("root")
    return rec.join(bad, "root", "left_semi").select("record_id")


def deal(roots: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """roots(root, n) -> (root, n, band, split) so that the sums of n follow `targets`.

    Roots larger than LARGE_SHARE of the whole, at most 1 / LARGE_SHARE of them, are placed one by one,
    largest first, where most is missing. What is then missing per split is dealt over the rest: within
    a band of sizes (a power of two) roots lie in hash order on a line of length sum(n), and the split
    of a root is where its midpoint falls among the cumulated shares. Running sums are taken per hash
    bucket and then within it, so no band is gathered into one task. Without targets no root gets a split.
    """
    spark = roots.sparkSession
    if not targets:
        return roots.select("root", "n", F.lit(0).alias("band"), F.lit(None).cast("string").alias("split"))
    sizes = roots.agg(F.sum("n").alias("n"), F.count("*").alias("roots")).first()
    total = sizes["n"] or 0
    buckets = max(DEAL_BUCKETS, sizes["roots"] // BUCKET_ROOTS + 1)
    names, want = [t[0] for t in targets], [max(0.0, t[1]) for t in targets]
    s = sum(want) or 1.0
    left = [total * w / s for w in want]
    big = roots.where(F.col("n") > LARGE_SHARE * total).orderBy(F.desc("n"), "root").collect()
    placed = []
    for r in big:
        k = max(range(len(left)), key=lambda i: (left[i], -i))
        left[k] -= r["n"]
        placed.append((r["root"], int(r["n"]), -1, names[k]))
    head = spark.createDataFrame(placed, "root string, n long, band int, split string")
    room = [max(0.0, x) for x in left]
    room = room if sum(room) else want
    rs, cum = sum(room) or 1.0, 0.0
    case = F.lit(names[-1])
    marks = []
    for nm, x in zip(names, room):
        cum += x / rs
        marks.append((cum, nm))
    for c, nm in reversed(marks[:-1]):
        case = F.when(F.col("_at") < c, nm).otherwise(case)
    rest = roots.where(~(F.col("n") > LARGE_SHARE * total)).withColumns(
        {"band": F.floor(F.log2(F.col("n").cast("double"))).cast("int"), "_h": F.xxhash64("root"), "_b": F.pmod(F.xxhash64("root"), F.lit(buckets))}
    )
    sums = rest.groupBy("band", "_b").agg(F.sum("n").alias("_s"))
    wb = W.partitionBy("band").orderBy("_b")
    sums = sums.select("band", "_b", (F.sum("_s").over(wb) - F.col("_s")).alias("_off"), F.sum("_s").over(W.partitionBy("band")).alias("_all"))
    wi = W.partitionBy("band", "_b").orderBy("_h", "root")
    tail = (
        rest.join(sums, ["band", "_b"])  # a row per band and bucket; whether it is sent around is left to the optimizer
        .withColumn("_at", (F.col("_off") + F.sum("n").over(wi) - F.col("n") / 2) / F.col("_all"))
        .select("root", "n", "band", case.alias("split"))
    )
    return tail.unionByName(head)


def targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    """The three rows of split_targets."""
    rows = table(spark, d, "split_targets", "split", "share").where("split is not null and share is not null")
    return sorted(((r["split"], float(r["share"])) for r in rows.collect()), key=lambda x: (-x[1], x[0]))


def assign(spark: SparkSession, d: str) -> DataFrame:
    """record_id, root, band, old_split, split: the new split, one per root."""
    rec, _ = components(keyed(spark, d))
    rec = stored(rec.select("record_id", "split", "root"), "rooted")
    dealt = stored(deal(rec.groupBy("root").agg(F.count("*").alias("n")), targets(spark, d)), "dealt")
    return rec.withColumnRenamed("split", "old_split").join(dealt, "root").select("record_id", "root", "band", "old_split", "split")


def shares(spark: SparkSession, d: str) -> DataFrame:
    """Per split: records, share reached, share wanted, roots and records that changed split."""
    a = assign(spark, d)
    t = table(spark, d, "split_targets", "split", "share").withColumnRenamed("share", "target_share")
    g = a.groupBy("split").agg(
        F.count("*").alias("records"), F.countDistinct("root").alias("roots"), F.count_if(~F.col("old_split").eqNullSafe(F.col("split"))).alias("moved")
    )
    total = g.agg(F.sum("records").alias("total"))
    return (
        t.join(g, "split", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "split",
            "target_share",
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("roots", F.lit(0)).alias("roots"),
            F.coalesce("moved", F.lit(0)).alias("moved"),
            F.round(F.coalesce("records", F.lit(0)) / F.col("total"), 6).alias("share"),
        )
    )


def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    """The forest over group and folder keys: u, v and the round that picked the edge."""
    return components(keyed(spark, d))[1]


_CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace('/' || trim({c}), '[\\/]+', '/', 'g'), '(/\.)+(/|$)', '/', 'g'), '/[^/]+/\.\.(/|$)', '/', 'g'), '^/+|/+$', '', 'g')"""

_SQL_KEYS = f"""rec AS (
  SELECT record_id, min(s) AS split, min(g) AS g, min(p) AS p FROM (
   SELECT record_id, CASE WHEN lower(trim(split)) IN ('train','training') THEN 'train'
      WHEN lower(trim(split)) IN ('val','valid','validation','dev') THEN 'val'
      WHEN lower(trim(split)) = 'test' THEN 'test' END AS s,
    'g:' || nullif({_CANON.format(c="group_id")}, '') AS g, 'p:' || nullif({_CANON.format(c="project_root")}, '') AS p
   FROM records WHERE record_id IS NOT NULL) GROUP BY record_id),
 e AS (SELECT DISTINCT g, p FROM rec WHERE g IS NOT NULL AND p IS NOT NULL),
 n AS (SELECT g AS a, p AS b FROM e UNION SELECT p, g FROM e),
 reach(x, y) AS (SELECT DISTINCT a, a FROM n UNION SELECT r.x, n.b FROM reach r JOIN n ON n.a = r.y),
 lab AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
 own AS (SELECT record_id, split, coalesce(lab.root, g, p, 'r:' || record_id) AS root
   FROM rec LEFT JOIN lab ON lab.x = coalesce(g, p))"""

QUERIES = {"p3_found": broken, "p3_assign": assign, "p3_shares": shares, "p3_forest": spanning_forest}
SQL = {
    "p3_found": f"""WITH RECURSIVE {_SQL_KEYS}
SELECT record_id FROM own WHERE root IN (SELECT root FROM own GROUP BY root HAVING count(DISTINCT split) > 1)""",
}
