"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beam."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ceil_div, materialise
from lectern.llm.vectors import best, matrix, usable

#: Rows of a shard: a 64th of the table between these two, so that a search opens a smaller part of a shard the more rows there
#: are, and no more than fit into this many bytes. Queries that one task searches a shard for.
SHARD, LARGEST_SHARD, SHARD_BYTES = 16_384, 131_072, 128 << 20
QUERY_GROUP = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(top > 0, top, 1)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes nearest to each row of q (unit vectors) that a walk over the graph finds: (ids, distances), `beam` columns.

    All walks move together: each step opens the `expand` nearest unopened nodes of every beam and merges their neighbours
    in. Ids of unfilled places are len(x)."""
    n, m = len(x), len(q)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, n] = True
    ids = np.full((m, beam), n, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=np.float32)
    opened = np.ones((m, beam), dtype=bool)
    starts = starts[:beam]
    ids[:, : len(starts)], opened[:, : len(starts)] = starts, False
    dist[:, : len(starts)] = 1 - q @ x[starts].T
    seen[:, starts] = True
    order = np.argsort(dist, axis=1)
    ids, dist, opened = (np.take_along_axis(a, order, 1) for a in (ids, dist, opened))
    live = np.arange(m)
    while len(live):
        closed = opened[live]
        pick = np.argsort(closed, axis=1, kind="stable")[:, :expand]
        at = np.where(np.take_along_axis(closed, pick, 1), n, np.take_along_axis(ids[live], pick, 1))
        going = (at < n).any(axis=1)
        live, pick, at = live[going], pick[going], at[going]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        near = np.where(at[:, :, None] < n, graph[np.minimum(at, n - 1)], n).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        near.sort(axis=1)
        near = near[:, : max(1, int((near < n).sum(axis=1).max()))]
        d = np.full(near.shape, np.inf, dtype=np.float32)
        r, c = np.nonzero(near < n)
        d[r, c] = 1 - np.einsum("id,id->i", x[near[r, c]], q[live[r]])
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], near], axis=1)
        all_o = np.concatenate([opened[live], near == n], axis=1)
        top = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live], ids[live], opened[live] = (np.take_along_axis(a, top, 1) for a in (all_d, all_i, all_o))
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each node from its row of candidates (len(x): none): the nearest is kept, and drops every candidate
    that is nearer to it, by the factor alpha, than to the node; then the nearest that is left, up to `degree`."""
    n = len(x)
    out = np.full((len(nodes), degree), n, dtype=np.int64)
    for at in range(0, len(nodes), 256):
        own, cand = nodes[at : at + 256], np.sort(pool[at : at + 256], axis=1)
        cand[cand == own[:, None]] = n
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
        v = x[np.minimum(cand, n - 1)]
        d = np.where(cand < n, np.maximum(2 - 2 * np.einsum("icd,id->ic", v, x[own]), 0), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        cand, d, v = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        between = np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0)
        alive, rows = cand < n, np.arange(len(own))
        for k in range(degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[at + rows[some], k] = cand[rows[some], first[some]]
            alive &= ~(alpha * between[rows, first] <= d)
            alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts) of unit vectors: nodes enter in random order and in batches that double, each linked to what a search of
    the graph so far proposes, pruned, with edges back; a second pass links every node again."""
    n = len(x)
    graph = np.full((n, degree), n, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    middle = np.argmax(x @ x.mean(axis=0)) if n else 0
    order = np.concatenate([[middle], order[order != middle]]).astype(np.int64) if n else order
    starts = order[: min(n, 4)]  # the node nearest to the mean, and three at random

    def link(batch: np.ndarray, pool: np.ndarray) -> None:
        pool = np.concatenate([pool, graph[batch]], axis=1)
        graph[batch] = robust_prune(x, batch, pool, degree, alpha)
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target < n], target[target < n]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max(initial=0))), n, dtype=np.int64)
        place = np.arange(len(target)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(nodes)), count), place] = source
        pool = np.sort(np.concatenate([graph[nodes], wide], axis=1), axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = n
        pool.sort(axis=1)
        fits = (pool < n).sum(axis=1) <= degree
        padded = np.concatenate([pool, np.full((len(pool), max(0, degree - pool.shape[1])), n, dtype=np.int64)], axis=1)
        graph[nodes[fits]] = padded[fits, :degree]
        over = ~fits
        if over.any():
            widest = int((pool[over] < n).sum(axis=1).max())
            graph[nodes[over]] = robust_prune(x, nodes[over], pool[over, :widest], degree, alpha)

    done = min(n, 256)
    link(order[:done], np.broadcast_to(order[:done], (done, done)).copy())
    while done < n:
        batch = order[done : done + min(done, 1024)]
        link(batch, beam_search(x, graph, x[batch], starts, beam)[0])
        done += len(batch)
    for at in range(0, n, 1024):
        batch = order[at : at + 1024]
        link(batch, beam_search(x, graph, x[batch], starts, beam)[0])
    return graph, starts


def _build(degree: int, beam: int, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        dim = int(pdf["dim"].iloc[0])
        v, ids = matrix(pdf["v"], dim), pdf["vec_id"].to_numpy()
        # Rows with the same vector are one node, with all their ids, or they would only link to each other.
        node, member = np.unique(v, axis=0, return_inverse=True)
        member = member.ravel()
        graph, starts = build_graph(_unit(node), degree, beam, alpha)
        by = np.lexsort((ids, member))
        with np.errstate(over="ignore"):
            half = node.astype(np.float32)
        node = half if np.array_equal(half, node) else node  # vectors of single precision are kept as such
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iloc[0])], "dim": [dim], "kind": [node.dtype.str], "vectors": [node.tobytes()], "edges": [graph.astype("<i4").tobytes()], "starts": [starts.astype("<i4").tobytes()],
            "ids": [ids[by].tobytes()], "ends": [np.cumsum(np.bincount(member, minlength=len(node))).tobytes()],
        })

    return run


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with the same row of c, in double precision, the same number for the same two rows wherever they are."""
    qt, ct = np.abs(q).max(axis=1, keepdims=True), np.abs(c).max(axis=1, keepdims=True)
    q, c = np.where((qt > 1e100) | (qt < 1e-100), q / qt, q), np.where((ct > 1e100) | (ct < 1e-100), c / ct, c)
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def _search(k: int, beam: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.float64)})]
        for row in right.itertuples():  # one index, unless there are no queries
            if left.empty:
                break
            x = np.frombuffer(row.vectors, dtype=row.kind).reshape(-1, row.dim)
            graph = np.frombuffer(row.edges, dtype="<i4").reshape(len(x), -1).astype(np.int64)
            starts = np.frombuffer(row.starts, dtype="<i4").astype(np.int64)
            ids, ends = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.ends, dtype=np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            unit = _unit(x.astype(np.float64))
            for at in range(0, len(left), 512):
                part = left.iloc[at : at + 512]
                q, names = matrix(part["q"], row.dim), part["query_id"].to_numpy()
                found, _ = beam_search(unit, graph, _unit(q), starts, max(beam, k + 1))
                r, c = np.nonzero(found < len(x))
                nodes = found[r, c]
                score = cosines(q[r], x[nodes].astype(np.float64))
                # Of a node's ids the k + 1 smallest can be among the k best besides the query's own.
                take = np.minimum(ends[nodes] - begins[nodes], k + 1)
                rr, ss = np.repeat(r, take), np.repeat(score, take)
                step = np.arange(len(rr)) - np.repeat(np.cumsum(take) - take, take)
                ii = ids[np.repeat(begins[nodes], take) + step]
                other = ii != names[rr]
                rr, ss, ii = rr[other], ss[other], ii[other]
                by = np.lexsort((ii, -ss, rr))
                rr, ss, ii = rr[by], ss[by], ii[by]
                first = np.searchsorted(rr, rr, side="left")
                top = np.arange(len(rr)) - first < k
                out.append(pd.DataFrame({"query_id": names[rr[top]], "vec_id": ii[top], "score": ss[top]}))
        return pd.concat(out, ignore_index=True)

    return run


def build_index(rows: DataFrame, shards: int, degree: int = 32, build_beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """One row for each shard and length of vectors: its graph, its vectors and their ids. rows: vec_id, v, dim of vectors.usable()."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    schema = "shard int, dim int, kind string, vectors binary, edges binary, starts binary, ids binary, ends binary"
    return materialise(dealt.repartition(shards, "shard").groupBy("dim", "shard").applyInPandas(_build(degree, build_beam, alpha), schema), "graph")


def nearest(vectors: DataFrame, k: int = 5, query_step: int = 50, shard: int | None = None, degree: int = 32, build_beam: int = 64, beam: int = 96, alpha: float = 1.2) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `query_step` its k nearest other rows by cosine,
    as far as the search finds them, nearest first, ties to the smaller vec_id.

    Rows are dealt evenly over shards of about `shard` rows (by default more on a larger table); every row is in the graph of its shard
    and every query searches every shard; what is found is scored on the original vectors in double precision.

    - Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without vec_id.
    - Rows that repeat a vec_id count once. Vectors of different lengths are not compared. An empty table gives no rows.
    - Rows that share a vector are one node; of each node the k + 1 smallest ids are told, more cannot be among the best k.
    - Columns beside vec_id and embedding play no part."""
    rows = materialise(usable(vectors, nonzero=True), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_step == 0).alias("q"), F.max("dim").alias("dim")).first()
    shard = shard or min(max(SHARD, min(LARGEST_SHARD, size["n"] // 64)), max(1, SHARD_BYTES // (8 * (size["dim"] or 1))))
    shards, groups = ceil_div(size["n"], shard), ceil_div(size["q"], QUERY_GROUP)
    index = build_index(rows, shards, degree, build_beam, alpha)
    index = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = rows.where(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("qdim"))
    queries = queries.withColumn("qgrp", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = queries.groupBy("qdim", "qgrp", "at").cogroup(index.groupBy("dim", "grp", "shard")).applyInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    return best(found, k, F.col("score"))
