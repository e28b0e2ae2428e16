"""Questions (prompts) and the domains cited for them; clusters of questions by shared domains."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.stages import scratch_keep


def question_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``qid``: record_id, else run_id, else "?"."""
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "run_id") if c in rows.columns]
    return rows.withColumn("qid", F.coalesce(*named, F.lit("?")))


def top_per(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, value, n, rank) of the k most frequent values of each key; ties by name."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def question_table(rows: DataFrame, k: int = 5) -> DataFrame:
    """Per question: cited, more-only, total, cite rate, most cited domains; prompt, intent and topic of its first row where there are any."""
    kept = [c for c in ("prompt", "intent", "topic") if c in rows.columns]
    place = F.struct(*[c for c in ("ord", "seq") if c in rows.columns]) if {"ord", "seq"} & set(rows.columns) else F.struct(F.lit(0), *kept)
    stats = rows.groupBy("qid").agg(F.count_if(F.col("cited") == 1).alias("n_cited"), F.count_if(F.col("cited") == 0).alias("n_more"), F.count("*").alias("n_total"), *[F.min_by(c, place).alias(c) for c in kept])
    top = top_per(rows.where("cited = 1"), "qid", "domain", k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "domain"))).alias("t"))
    named = F.coalesce(F.array_join(F.transform("t", lambda x: x["domain"]), ", "), F.lit(""))
    return stats.join(top, "qid", "left").select("qid", *kept, "n_cited", "n_more", "n_total", F.round(F.try_divide(F.col("n_cited"), F.col("n_total")), 4).alias("cite_rate"), named.alias("top_domains"))


def domain_sets(rows: DataFrame, group: str = "cited", key: str = "qid", item: str = "domain") -> DataFrame:
    """Distinct (qid, domain) of the group: cited, more_only, or all."""
    if group != "all":
        rows = rows.where(F.col("cited") == (1 if group == "cited" else 0))
    return rows.where(F.col(item).isNotNull() & (F.col(item) != "")).select(key, item).distinct()


def shared_pairs(sets: DataFrame, key: str = "qid", item: str = "domain") -> DataFrame:
    """(a, b, shared, either) of all pairs a < b that share an item: items of both, items of either.

    An inverted index: pairs meet at the items they share, so disjoint pairs (distance 1) cost
    nothing.  An item that very many keys share makes many pairs; that is the size of the result.
    """
    sizes = sets.groupBy(key).agg(F.count("*").alias("n"))
    left, right = sets.select(F.col(key).alias("a"), item), sets.select(F.col(key).alias("b"), item)
    shared = left.join(right, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.withColumnsRenamed({key: "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({key: "b", "n": "nb"}), "b")
    return out.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("either"))


def jaccard_pairs(sets: DataFrame, key: str = "qid", item: str = "domain") -> DataFrame:
    """(a, b, shared, jaccard) of all pairs a < b that share an item."""
    return shared_pairs(sets, key, item).select("a", "b", "shared", F.round(F.col("shared") / F.col("either"), 4).alias("jaccard"))


#: Similarities are whole numbers of this part, so sums over a cluster's pairs are exact.
UNIT = 1_000_000_000
#: Clusters that one task may hold: once so few are left, it merges them to the end.
LOCAL = 1000


def average_linkage(s: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
    """(i, j, mean similarity) of every merge, in order: the most similar clusters first, of ties the first
    pair; cluster j goes into i.  ``s``: sums of similarities over the pairs of two clusters (whole numbers,
    symmetric); what has no similarity to anything stays apart."""
    s, size, out = s.astype(np.int64).copy(), size.astype(np.int64).copy(), []
    np.fill_diagonal(s, 0)
    mean = s / np.multiply.outer(size, size)
    upper = np.triu(np.ones(s.shape, bool), 1)
    while len(s):
        look = np.where(upper, mean, 0.0)
        i, j = divmod(int(look.argmax()), len(s))
        if look[i, j] <= 0:
            break
        out.append((i, j, float(look[i, j])))
        s[i] += s[j]
        s[:, i] = s[i]
        size[i] += size[j]
        s[j] = s[:, j] = 0
        s[i, i] = 0
        mean[i] = mean[:, i] = s[i] / (size[i] * size)
        mean[j] = mean[:, j] = 0.0
    return out


#: Sets in a block of questions that meets others in one task, those of a tile that it compares at once, and the items it looks at together.
BLOCK, TILE, ITEMS = 2048, 1024, 4096


def _in_both(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each pair of sets shares."""
    out, common = np.zeros((len(left), len(right))), np.intersect1d(np.concatenate(left), np.concatenate(right))
    for at in range(0, len(common), ITEMS):
        some, has = common[at : at + ITEMS], []
        for sets in (left, right):
            items, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            place = np.minimum(np.searchsorted(some, items), len(some) - 1)
            hit = some[place] == items
            one = np.zeros((len(sets), len(some)), np.float32)
            one[row[hit], place[hit]] = 1
            has.append(one)
        out += has[0] @ has[1].T
    return out


def similarity_sums(left: tuple, right: tuple) -> np.ndarray:
    """Sums of Jaccard similarities, in parts of UNIT, over the pairs of a cluster of ``left`` and one of ``right``.
    A side: its sets, the cluster of each (0, 1, .. in order), and how many questions have the set."""
    (a, ca, na), (b, cb, nb) = left, right
    size_a, size_b = (np.array([len(s) for s in x], float) for x in (a, b))
    out = np.zeros((ca[-1] + 1, cb[-1] + 1), np.int64)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            x, y = slice(i, i + TILE), slice(j, j + TILE)
            shared = _in_both(a[x], b[y])
            unit = np.floor(UNIT * shared / (size_a[x, None] + size_b[None, y] - shared) + 0.5).astype(np.int64) * (na[x, None] * nb[None, y])
            rows, columns = (np.flatnonzero(np.diff(c, prepend=-1)) for c in (ca[x], cb[y]))
            part = np.add.reduceat(np.add.reduceat(unit, rows, axis=0), columns, axis=1)
            out[ca[i] : ca[i] + len(rows), cb[j] : cb[j] + len(columns)] += part
    return out


def _blocks_met(members: DataFrame, nearest: bool) -> DataFrame:
    """What clusters have in common, by blocks of them of which any two meet in one task.  ``members``: the sets of
    each cluster (q, n questions, set).  ``nearest``: (q, o, mean) of each cluster and the nearest one of a block,
    of equal ones the first; else (a, b, s, na, nb), the sums over the pairs of any two."""
    n = max(1, -(-members.count() // BLOCK))
    mine, other = F.pmod(F.xxhash64("q"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = members.select("q", "n", "set", mine.alias("mine"), other.alias("other")).select("q", "n", "set", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    kind = dict(members.dtypes)["q"]

    def side(pdf: pd.DataFrame) -> tuple:
        codes, labels = pd.factorize(pdf["q"], sort=True)
        order = np.argsort(codes, kind="stable")
        count = pdf["n"].to_numpy(np.int64)[order]
        sets = [np.asarray(s, np.int64) for s in pdf["set"].to_numpy()[order]]
        return np.asarray(labels), np.add.reduceat(count, np.flatnonzero(np.diff(codes[order], prepend=-1))) if len(order) else count, (sets, codes[order], count)

    def met(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        a, b = side(pdf[pdf["mine"] == i]), side(pdf[pdf["mine"] == j])
        if not len(a[0]) or not len(b[0]):
            s = np.zeros((len(a[0]), len(b[0])), np.int64)
        else:
            s = similarity_sums(a[2], b[2])
        if i == j:
            np.fill_diagonal(s, 0)
        if not nearest:
            x, y = np.nonzero(np.triu(s) if i == j else s)
            one, two = a[0][x], b[0][y]
            first = one < two
            return pd.DataFrame({"a": np.where(first, one, two), "b": np.where(first, two, one), "s": s[x, y], "na": np.where(first, a[1][x], b[1][y]), "nb": np.where(first, b[1][y], a[1][x])})
        out = []
        for one, two, sums in ((a, b, s), (b, a, s.T))[: 1 if i == j else 2]:
            if sums.size:
                mean = sums.astype(float) / np.multiply.outer(one[1], two[1]).astype(float)
                best = mean.argmax(1)
                top = mean[np.arange(len(best)), best]
                out.append(pd.DataFrame({"q": one[0], "o": two[0][best], "mean": top})[top > 0])
        return pd.concat(out) if out else pd.DataFrame({"q": a[0][:0], "o": a[0][:0], "mean": np.zeros(0)})

    return dealt.groupBy("i", "j").applyInPandas(met, f"q {kind}, o {kind}, mean double" if nearest else f"a {kind}, b {kind}, s long, na long, nb long")


def _mutual(best: DataFrame) -> DataFrame:
    """(a, b, mean) of the clusters that are nearest to each other.  The order of pairs is total (mean similarity,
    then the labels), so there is one at least; of equal ones a cluster's first neighbour makes the first pair."""
    back = best.select(F.col("q").alias("o"), F.col("o").alias("q"))
    return best.where("q < o").join(back, ["q", "o"]).select(F.col("q").alias("a"), F.col("o").alias("b"), "mean")


def _renamed(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """``df`` with the labels of clusters that have gone into others replaced."""
    gone = merges.select(F.col("b").alias("__old"), F.col("a").alias("__new"))
    return df.join(gone, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def linkage_merges(sets: DataFrame, keep: Callable) -> DataFrame:
    """(a, b, mean): every merge of average linkage over Jaccard similarities, down to clusters that share
    nothing; b goes into a, the smaller label; ``mean`` similarity in parts of UNIT.

    Two clusters that are nearest to each other stay so until they merge, whatever merges elsewhere (the
    mean similarity to a union is at most the greater one of its parts), so in every round all such pairs
    merge at once.  Questions with equal sets come first, as one set.  A round compares all sets, block by
    block, and keeps of each cluster the nearest one: time grows with the square of the different sets, what
    a task holds and what is written do not.  The last LOCAL clusters are merged by one task.  Ties go by the
    labels, as in a loop over all pairs; very many equal similarities between more than LOCAL clusters
    therefore make many rounds.
    """
    # The set itself, not a digest, tells equal ones apart; items have numbers from here on.
    items = keep("items", sets.select("domain").distinct().withColumn("item", F.monotonically_increasing_id()))
    whole = keep("whole", sets.join(items, "domain").groupBy("qid").agg(F.sort_array(F.collect_list("item")).alias("set")))
    first = whole.groupBy("set").agg(F.min("qid").alias("a"), F.count("*").alias("n"))
    equal = keep("equal", whole.join(first, "set").select(F.col("qid").alias("b"), "a", "n", "set"))
    done = [equal.where("a <> b").select("a", "b", F.lit(float(UNIT)).alias("mean"))]
    members = keep("members", equal.where("a = b").select(F.col("a").alias("q"), "n", "set"), 0)
    turn = 0
    while True:
        near = _blocks_met(members, True).groupBy("q").agg(F.min(F.struct((-F.col("mean")).alias("d"), "o")).alias("p"))
        best = keep("best", near.select("q", "p.o", (-F.col("p.d")).alias("mean")), turn)
        if best.count() <= LOCAL:
            break
        turn += 1
        merges = keep("merges", _mutual(best), turn)
        done.append(merges)
        members = keep("members", _renamed(members, "q", merges), turn)
    kind = dict(sets.dtypes)["qid"]

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {q: i for i, q in enumerate(ids)}
        s, size = np.zeros((len(ids), len(ids)), np.int64), np.ones(len(ids), np.int64)
        for a, b, v, na, nb in zip(pdf["a"], pdf["b"], pdf["s"], pdf["na"], pdf["nb"]):
            i, j = at[a], at[b]
            s[i, j] = s[j, i] = v
            size[i], size[j] = na, nb
        merged = average_linkage(s, size)
        return pd.DataFrame({"a": [ids[i] for i, _, _ in merged], "b": [ids[j] for _, j, _ in merged], "mean": [m for _, _, m in merged]})

    left = _blocks_met(members, False)
    done.append(left.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(rest, f"a {kind}, b {kind}, mean double"))  # LOCAL clusters at most
    return keep("all_merges", reduce(lambda x, y: x.unionByName(y), done))


def cluster_questions(rows: DataFrame, k: int, group: str = "cited") -> DataFrame:
    """(qid, cluster): average linkage over Jaccard distances until k clusters are left, numbered by their
    least question; questions without domains get -1.  Clusters that share nothing merge last, the
    first ones first."""
    keep = scratch_keep(rows.sparkSession)
    sets = keep("sets", domain_sets(rows, group))
    merges = linkage_merges(sets, keep)
    n, made = sets.select("qid").distinct().count(), merges.count()
    k = max(1, min(k, n))
    # The last merges are undone: as many as k clusters need, so k rows at most.
    undone = merges.orderBy("mean", F.desc("a"), F.desc("b")).limit(max(0, k - (n - made)))
    parents = keep("parents", merges.join(undone.select("b"), "b", "left_anti").select(F.col("b").alias("q"), F.col("a").alias("up")))
    turn = 0
    while True:  # each question's way up is halved
        turn += 1
        above = parents.select(F.col("q").alias("__q"), F.col("up").alias("__up"))
        parents = keep("parents", parents.join(above, F.col("up") == F.col("__q"), "left").select("q", F.coalesce("__up", "up").alias("up"), F.col("__up").isNotNull().alias("moved")), turn)
        if parents.where("moved").isEmpty():
            break
    asked = sets.select("qid").distinct()
    found = asked.join(parents.select(F.col("q").alias("qid"), "up"), "qid", "left").select("qid", F.coalesce("up", "qid").alias("root"))
    # What is left beyond k clusters shares nothing: all but the k - 1 greatest labels are one.
    apart = found.select("root").distinct().orderBy(F.desc("root")).limit(k - 1).select("root", F.lit(True).alias("apart")) if k > 1 else None
    if apart is not None:
        found = found.join(F.broadcast(apart), "root", "left")  # fewer than k rows
        found = found.withColumn("root", F.when(F.col("apart"), F.col("root"))).drop("apart")
    else:
        found = found.withColumn("root", F.lit(None).cast(dict(found.dtypes)["root"]))
    labels = found.select("root").distinct().withColumn("cluster", F.row_number().over(W.orderBy(F.asc_nulls_first("root"))).cast("long") - 1)  # k rows
    labels = labels.withColumnRenamed("root", "__root")
    found = found.join(F.broadcast(labels), F.col("root").eqNullSafe(F.col("__root"))).select("qid", "cluster")
    return rows.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def cluster_summary(rows: DataFrame, clusters: DataFrame, k: int = 8) -> DataFrame:
    """(cluster, n_questions, members, top_domains), and the clusters' topics where ``rows`` have them."""
    members = clusters.groupBy("cluster").agg(F.count("*").alias("n_questions"), F.array_join(F.sort_array(F.collect_list(F.col("qid").cast("string"))), ", ").alias("members"))
    top = top_per(rows.join(clusters, "qid"), "cluster", "domain", k).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", "domain"))).alias("t"))
    out = members.join(top, "cluster", "left").select("cluster", "n_questions", "members", F.array_join(F.transform("t", lambda x: x["domain"]), ", ").alias("top_domains"))
    return out.join(cluster_topics(rows, clusters), "cluster", "left") if "topic" in rows.columns else out


def cluster_topics(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, topics): the distinct topics of a cluster's questions, by name."""
    named = rows.join(clusters, "qid").where("topic <> ''").select("cluster", "topic").distinct()
    return named.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("topic")), ", ").alias("topics"))


def question_matrix(rows: DataFrame, k: int = 20) -> DataFrame:
    """Counts of the k most frequent domains by question, one column a domain."""
    top = [r["domain"] for r in rows.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k).collect()]
    return rows.groupBy("qid").pivot("domain", top).agg(F.count(F.lit(1))).na.fill(0)
