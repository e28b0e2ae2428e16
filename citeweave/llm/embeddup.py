"""Embedding near-dedup on a robust-pruned flat graph.

1. Vectors are scaled to unit length in double precision; equal ones are folded into one node with
   a weight, so a vector that a third of all rows repeat is one node.
2. Medoids: a bounded sample (``SAMPLE``) gives centres by farthest-first choice, up to ``CENTRES``.
   Every node goes to its ``OVERLAP`` nearest: overlapping cluster shards.  Shards of more than
   ``MOST`` members are dealt anew over centres of their own, again and again, until none is left.
3. Each shard builds adjacency lists by robust pruning over all its members, with some far edges so
   that tight groups are no islands, and the lists of a node's shards are united.
4. Every node is a query.  In a shard it starts from the shard's medoid (and from itself where it is
   a member), descends greedily with a list of ``BEAM`` nodes, and then expands the range: lists of
   all nodes within ``EXPAND`` are followed until nothing new is reached.
5. Nodes reached are verified by exact cosine in double precision, at least ``THRESHOLD``.  A united
   list goes on in other shards: a query visits the shards of all nodes it is linked with, and is
   visited back, round by round until no new visit arises.
6. A visit counts only nodes that are at home in the shard, so each link is counted once from each
   end; of the pairs themselves only spanning edges of connected parts leave a task.
7. ``audit_recall`` compares the links of the rows whose id is divisible by ``AUDIT`` with brute
   force over all rows, in blocks.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of different lengths do not link.  Repeated ids: each row keeps its own result.  Null ids: the row
is a node like any other but never names a component; alone, its component is null.  An empty table
gives an empty result.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import materialise, salted_join, small_side
from citeweave.llm.components import components

THRESHOLD, EXPAND = 0.95, 0.93
SAMPLE, SHARD, MOST, CENTRES, SUB, OVERLAP = 20_000, 1_000, 4_000, 1_024, 16, 3
DEGREE, FAR, ALPHA, APART = 24, 8, 1.2, 0.9
BEAM, STEP, BLOCK = 32, 8, 256
#: Queries of one shard that one task holds.
VISITS = 8_192
AUDIT = 100
#: Deals of a shard by its own centres; then, for vectors that no centre tells apart, by hash.
LEVELS = 6


def clean(v) -> np.ndarray | None:
    """Unit vector in double precision, or None for one that links with nothing."""
    if v is None or len(v) == 0:
        return None
    a = np.asarray(v, np.float64)  # a null component becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(a).max() if np.isfinite(a).all() else 0.0
        if not top > 0:
            return None
        a = a / top  # else tiny or huge components would leave the range of squares
        return a / np.sqrt((a * a).sum())


def padded(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one matrix, zeros behind the shorter ones, and their lengths."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = np.zeros((len(sizes), int(sizes.max(initial=1))))
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[at, :d] = np.stack([vectors[i] for i in at])
    return out, sizes


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of padded matrices of different widths."""
    d = min(x.shape[1], y.shape[1])
    return x[:, :d] @ y[:, :d].T


def centres(sample: np.ndarray, k: int) -> np.ndarray:
    """At most k spread-out medoids of the sample, by farthest-first choice: none within cosine ``APART``
    of another, so that a group of near copies is not cut among more of them than a node is dealt to."""
    picked, near = [0], sample @ sample[0]
    for _ in range(min(k, len(sample)) - 1):
        i = int(near.argmin())
        if near[i] >= APART:
            break
        picked.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[picked]


def _pruned(row: np.ndarray, cand: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Of the candidates, nearest first, those that no kept one covers ``alpha`` times better."""
    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * row[cand]))
    among = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[cand] @ x[cand].T)))
    alive, kept = np.ones(len(cand), bool), []
    for j in range(len(cand)):
        if alive[j]:
            kept.append(int(cand[j]))
            if len(kept) == degree:
                break
            alive &= alpha * among[j] > dist
    return kept


def robust_prune(x: np.ndarray, degree: int = DEGREE, far: int = FAR, alpha: float = ALPHA, pool: int = 96) -> list[np.ndarray]:
    """Adjacency lists over unit vectors.

    ``degree - far`` edges are pruned from the ``pool`` nearest, ``far`` more from members at even
    ranks behind them; then each edge is also laid back, to the ``degree`` nearest that ask for it.
    """
    n, out = len(x), []
    for i in range(0, n, BLOCK):
        sims = x[i : i + BLOCK] @ x.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2.0
        order = np.argsort(-sims, axis=1, kind="stable")[:, : n - 1]
        for row, cand in zip(sims, order):
            kept = _pruned(row, cand[:pool], x, degree - far, alpha)
            rest = cand[pool :: max(1, (n - pool) // (4 * far))]
            out.append(np.array(kept + _pruned(row, rest, x, far, alpha) if len(rest) else kept, np.int64))
    if not n:
        return out
    sizes = np.fromiter(map(len, out), np.int64, n)
    start, end = np.repeat(np.arange(n), sizes), np.concatenate(out)
    near = np.einsum("ij,ij->i", x[start], x[end]) if len(start) else np.zeros(0)
    back = np.lexsort((-near, end))
    place = np.arange(len(end)) - np.searchsorted(end[back], end[back])
    back = back[place < degree]
    pairs = np.unique(np.r_[start * n + end, end[back] * n + start[back]])
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def reach(q: np.ndarray, x: np.ndarray, lists: tuple[np.ndarray, np.ndarray], own: np.ndarray, medoid: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, reached) of a block of queries and all members, by range-expanding greedy search.

    ``lists``: ends of the members' lists and the lists end to end; ``own``: each query's place among
    the members, or -1.  A member's cosines are computed when some query of the block first reaches it.
    """
    b, m = len(q), len(x)
    ends, flat = lists
    size = np.diff(np.r_[0, ends])
    first = ends - size
    sims = np.full((b, m), -2.0)
    got, seen, done = np.zeros(m, bool), np.zeros((b, m), bool), np.zeros((b, m), bool)
    seen[:, medoid] = True
    seen[np.flatnonzero(own >= 0), own[own >= 0]] = True
    beam = min(BEAM, m)
    while True:
        new = np.flatnonzero(seen.any(axis=0) & ~got)
        if len(new):
            sims[:, new] = q @ x[new].T
            got[new] = True
        view = np.where(seen, sims, -3.0)
        floor = np.partition(view, m - beam, axis=1)[:, m - beam]
        todo = seen & ~done & (view >= floor[:, None])
        # The best STEP of the list at a time, and whatever lies in the range.
        if m > STEP:
            mine = np.where(todo, sims, -3.0)
            todo &= mine >= np.partition(mine, m - STEP, axis=1)[:, m - STEP][:, None]
        todo |= seen & ~done & (sims >= EXPAND)
        who, what = np.nonzero(todo)
        if not len(who):
            return sims, seen
        done[who, what] = True
        n = size[what]
        at = np.repeat(first[what] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        seen[np.repeat(who, n), flat[at]] = True


def _spans(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links, the first row of their connected part (-1: no link)."""
    n, far = len(met), len(met)
    row = np.where(met.any(axis=1), np.arange(n), far)
    while True:
        col = np.where(met, row[:, None], far).min(axis=0, initial=far)
        new = np.minimum(row, np.where(met, col[None, :], far).min(axis=1, initial=far))
        if (new == row).all():
            return np.where(row < far, row, -1), np.where(col < far, col, -1)
        row = new


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double> or null): unit vectors."""
    import citeweave.llm.embeddup as own

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [own.clean(v) for v in b["v"]]})

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInPandas(scale, "vec_id long, v array<double>")


def matrix(rows: DataFrame) -> np.ndarray:
    """The column ``v`` of a bounded number of rows on the driver, by Arrow."""
    return padded(rows.select("v").toArrow().column("v").combine_chunks().to_numpy(zero_copy_only=False))[0]


def _assign(nodes: DataFrame, medoids: np.ndarray) -> DataFrame:
    """(node, weight, v, cells, home): each node's nearest medoids, the nearest its home."""
    import citeweave.llm.embeddup as own

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-own.product(own.padded(b["v"].to_numpy())[0], medoids), axis=1, kind="stable")[:, : own.OVERLAP].astype(np.int64)
                yield b.assign(cells=list(near), home=near[:, 0])

    return nodes.mapInPandas(deal, "node long, weight long, v array<double>, cells array<long>, home long")


def _split(members: pd.DataFrame, own_centres: pd.DataFrame, by_hash: bool) -> pd.DataFrame:
    """(node, weight, v, at_home, sub): members of a part of a large shard, dealt over its centres."""
    import citeweave.llm.embeddup as own

    k = len(own_centres)
    if not len(members) or not k:
        return pd.DataFrame({"node": [], "weight": [], "v": [], "at_home": [], "sub": []})
    if by_hash:
        near = (members["node"].to_numpy(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        near = (near + np.arange(k) * (1 + near % max(1, k - 1))) % k
    else:
        near = np.argsort(-own.product(own.padded(members["v"].to_numpy())[0], own.padded(own_centres["v"].to_numpy())[0]), axis=1, kind="stable")
    home = members["at_home"].to_numpy(bool)
    i = np.repeat(np.arange(len(members)), np.where(home, min(own.OVERLAP, k), 1))
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return members.iloc[i][["node", "weight", "v"]].assign(at_home=home[i] & (nth == 0), sub=near[i, nth])


def deal(nodes: DataFrame) -> DataFrame:
    """(node, weight, v, cells, home) for nodes (node, weight, v): no shard has more than ``MOST`` members."""
    import citeweave.llm.embeddup as own

    n = nodes.count()
    # A bounded sample by hash: about SAMPLE rows at any size.
    share = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30))
    sample = nodes.where(share("node") < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))).limit(2 * SAMPLE)
    medoids = matrix(sample)
    if not len(medoids):
        medoids = matrix(nodes.limit(1)) if n else np.zeros((1, 1))
    dealt = materialise(_assign(nodes, centres(medoids, int(min(CENTRES, max(1, OVERLAP * n // SHARD))))))
    for level in range(1000):
        rows = dealt.select("node", "weight", "v", F.explode("cells").alias("shard"), "home").withColumn("at_home", F.expr("shard = home"))
        big = materialise(rows.groupBy("shard").agg(F.count("*").alias("m")).where(F.col("m") > MOST))
        if big.isEmpty():
            return dealt
        rows = rows.drop("home").join(small_side(big), "shard", "left")
        large = rows.where("m IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / MOST)).cast("int"))
        # The centres: SUB members with the least hashes, ranked among about 8 * SUB.
        h = share("node", "shard", F.lit(level))
        few = large.where(h < F.least(F.lit(1.0), F.lit(8.0 * SUB) / F.col("m")) * (1 << 30)).withColumn("h", h)
        few = few.withColumn("k", F.row_number().over(Window.partitionBy("shard").orderBy("h", "node"))).where(F.col("k") <= SUB)
        few = few.select(F.col("shard").alias("shard"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / MOST).cast("int") - 1)).alias("salt"), F.col("v").alias("v"))
        by_hash = level >= LEVELS
        split = lambda key, a, b: own._split(a, b, by_hash).assign(shard=key[0])
        new = large.groupBy("shard", "salt").cogroup(few.groupBy("shard", "salt")).applyInPandas(split, "node long, weight long, v array<double>, at_home boolean, sub long, shard long")
        new = new.withColumn("shard", F.xxhash64("shard", "sub", F.lit(level)))
        parts = rows.where("m IS NULL").select("node", "weight", "v", "at_home", "shard").unionByName(new.select("node", "weight", "v", "at_home", "shard"))
        packed = parts.groupBy("node").agg(F.first("weight").alias("weight"), F.first("v").alias("v"), F.collect_set("shard").alias("cells"), F.max(F.when(F.col("at_home"), F.col("shard"))).alias("home"))
        dealt = materialise(packed)
    raise RuntimeError("shards do not come down to their bound")


def _build(members: pd.DataFrame) -> pd.DataFrame:
    """(node, near): robust-pruned lists of one shard, vectors of each length apart."""
    import citeweave.llm.embeddup as own

    x, sizes = own.padded(members["v"].to_numpy())
    node, near = members["node"].to_numpy(), [None] * len(members)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        for i, found in zip(at, own.robust_prune(x[at])):
            near[i] = node[at[found]]
    return pd.DataFrame({"node": node, "near": near})


def flat_graph(dealt: DataFrame) -> DataFrame:
    """(node, weight, v, cells, home, near): every node's adjacency lists, united over its shards."""
    members = dealt.select(F.explode("cells").alias("shard"), "node", "v")
    lists = members.groupBy("shard").applyInPandas(_build, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return dealt.join(united, "node")


def _visit(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Queries that visit one shard: (kind, node, value).  Kind 0: the weight of the home nodes a query is
    linked with; 1: a node of its connected part; 2: a shard that the node is to visit."""
    import citeweave.llm.embeddup as own

    out = []
    if len(queries) and len(members):
        x, sizes = own.padded(members["v"].to_numpy())
        q, lengths = own.padded(queries["v"].to_numpy())
        for d in np.unique(lengths):
            a, b = np.flatnonzero(lengths == d), np.flatnonzero(sizes == d)
            if len(b):
                out += own._visit_equal(queries.iloc[a], q[a, :d], members.iloc[b], x[b, :d])
    columns = [np.concatenate([f[k] for f in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pd.DataFrame(dict(zip(("kind", "node", "value"), columns)))


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the entries of a series of lists."""
    lists = [np.asarray(a, np.int64) for a in lists]
    return np.repeat(np.arange(len(lists)), [len(a) for a in lists]), np.concatenate(lists)


def _visit_equal(queries: pd.DataFrame, q: np.ndarray, members: pd.DataFrame, x: np.ndarray) -> list[tuple]:
    """Parts (kind, node, value) of a visit, for vectors of one length."""
    import citeweave.llm.embeddup as own

    shard = queries["shard"].iloc[0]
    order = np.argsort(members["node"].to_numpy())
    members, x = members.iloc[order], np.ascontiguousarray(x[order])
    node = members["node"].to_numpy()
    # The united lists, as far as they stay in the shard.
    owner, end = _ragged(members["near"])
    at = np.minimum(np.searchsorted(node, end), len(node) - 1)
    inside = node[at] == end
    lists = (np.cumsum(np.bincount(owner[inside], minlength=len(node))), at[inside])
    medoid = int((x @ x.sum(axis=0)).argmax())
    weight = np.where(members["home"] == shard, members["weight"], 0).astype(np.float64)
    owner, cell = _ragged(members["cells"])
    others, cell = np.unique(cell, return_inverse=True)
    holds = np.zeros((len(node), len(others)), np.float32)
    holds[owner, cell] = 1
    ids = queries["node"].to_numpy()
    homes, home_at = np.unique(queries["home"].to_numpy(), return_inverse=True)
    back = np.zeros((len(node), len(homes)), bool)
    far, edges, visits = np.zeros(len(ids), np.int64), [], []
    for i in range(0, len(ids), own.BLOCK):
        mine = ids[i : i + own.BLOCK]
        place = np.minimum(np.searchsorted(node, mine), len(node) - 1)
        member = node[place] == mine
        sims, seen = own.reach(q[i : i + own.BLOCK], x, lists, np.where(member, place, -1), medoid)
        met = seen & (sims >= own.THRESHOLD)
        met[np.flatnonzero(member), place[member]] = False
        rows, cols = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
        if not len(rows):
            continue
        part, mine, homed = met[np.ix_(rows, cols)], mine[rows], home_at[i + rows]
        far[i + rows] = part @ weight[cols]
        row, col = own._spans(part)
        edges += [(mine, mine[row]), (node[cols], mine[col])]
        row, cell = np.nonzero(part.astype(np.float32) @ holds[cols] > 0)
        visits.append((mine[row], others[cell]))
        for h in np.unique(homed):  # links are met from both ends
            back[cols, h] |= part[homed == h].any(axis=0)
    row, h = np.nonzero(back)
    visits.append((node[row], homes[h]))
    linked = np.flatnonzero(far)
    out = [(np.zeros(len(linked), np.int64), ids[linked], far[linked])]
    for kind, pairs in ((1, edges), (2, visits)):
        if pairs:
            a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            a, b = np.unique(np.c_[a, b][b != (a if kind == 1 else shard)], axis=0).T
            out.append((np.full(len(a), kind, np.int64), a, b))
    return out


def search(graph: DataFrame) -> DataFrame:
    """(kind, node, value) of all visits: kind 0 parts of the linked weight, kind 1 spanning edges."""
    import citeweave.llm.embeddup as own

    visit = lambda a, b: own._visit(a, b)
    asked = materialise(graph.select("node", F.explode("cells").alias("shard")))
    visited, found = asked, None
    while True:
        parts = materialise(asked.groupBy("shard").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts")))
        few = small_side(parts)
        left = asked.join(graph.select("node", "v", "home"), "node").join(few, "shard")
        left = left.select("shard", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "v", "home")
        members = graph.select(F.explode("cells").alias("shard"), "node", "weight", "v", "home", "cells", "near").join(few, "shard")
        right = members.select(*[F.col(c).alias(c) for c in ("shard", "node", "weight", "v", "home", "cells", "near")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        got = materialise(left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(visit, "kind long, node long, value long"))
        found = got.where("kind < 2") if found is None else found.unionByName(got.where("kind < 2"))
        asked = materialise(got.where("kind = 2").select("node", F.col("value").alias("shard")).distinct().join(visited, ["node", "shard"], "left_anti"))
        if asked.isEmpty():
            return found
        visited = visited.unionByName(asked)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = materialise(_nodes(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("v")))
    good = rows.where("v IS NOT NULL")
    nodes = good.groupBy("h", "v").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = materialise(nodes)
    found = search(materialise(flat_graph(deal(nodes.select("node", "weight", "v")))))
    sums = found.where("kind = 0").groupBy("node").agg(F.sum("value").alias("far"))
    ends = F.least("node", "value").alias("a"), F.greatest("node", "value").alias("b")
    roots = components(found.where("kind = 1").select(*ends).distinct())
    named = materialise(nodes.select("h", "v", "node", "weight", "least").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = salted_join(named, least, ["root"], F.col("node")).select("h", "v", "component_id", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    # Only nodes with links need the join back; the others are their own component.
    facts = materialise(facts.where("n_links > 0"))
    met = salted_join(rows, facts, ["h", "v"], F.col("row"), "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, every: int = AUDIT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, true_links, n_links) of the rows whose id is divisible by ``every``, against all rows.

    The queries are dealt into blocks; each task compares its Arrow batches with one block at a time.
    """
    spark = vectors.sparkSession
    good = materialise(_nodes(vectors, id_col, vector_col).where("v IS NOT NULL"))
    asked = materialise(good.where(F.col("vec_id") % every == 0))
    blocks, total = -(-asked.count() // 4096), None
    for part in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part).toPandas()
        if not len(mine):
            continue
        ids, (q, lengths) = mine["vec_id"].to_numpy(), padded(mine["v"].to_numpy())

        def count(batches: Iterator[pd.DataFrame], ids=ids, q=q, lengths=lengths) -> Iterator[pd.DataFrame]:
            import citeweave.llm.embeddup as own

            for b in batches:
                if len(b):
                    x, sizes = own.padded(b["v"].to_numpy())
                    hit = (own.product(x, q) >= own.THRESHOLD) & (sizes[:, None] == lengths[None, :])
                    yield pd.DataFrame({"vec_id": ids, "n": hit.sum(axis=0)})

        one = good.select("vec_id", "v").mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("true_links"))
        total = one if total is None else total.unionByName(one)
    if total is None:
        total = spark.createDataFrame([], "vec_id long, true_links long")
    return total.join(result.select("vec_id", "n_links"), "vec_id")
