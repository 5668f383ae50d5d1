"""Embedding near-dedup: exact threshold pairs within a label by dual traversal of cover trees.

Equal vectors of a label are one representative with a count. Representatives of a label are
dealt into blocks of about ``BLOCK`` by their angle to one of them (cut at quantiles), so that
a hot label or a large near-copy group is many blocks; two blocks whose angle intervals are
further apart than the threshold's angle hold no link and are not compared. Each remaining pair
of blocks is a task: a cover tree of each (nested levels, radii halving from 2, actual covering
radii kept), traversed together. A reached pair of nodes is opened on both sides and only then are
the distances between their children's centres worked out; a pair of children is dropped if its
centres are further apart than threshold + both radii, taken whole if centres + both radii stay
within the threshold (its links are counted, not listed), and reached otherwise. Single vectors are
compared by cosine in double precision. Tasks return link counts and star edges, never pairs.

Defined results: null, empty, zero or non-finite vectors and null labels link with nothing;
vectors of different lengths don't link; rows with a null id link with nothing, have no
component and are kept; repeated rows count as further vectors; ties take the least id; very long
vectors and labels (their whole text counts) are compared like others; an empty table gives an
empty table; further columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved
from .components import components, local_stars

BLOCK, SLACK, STRIP = 2048, 1e-9, 1 << 20
U64 = np.uint64


class CoverTree:
    """Of unit vectors: node arrays centre, radius (to its furthest vector), first child, children; member has each node's vectors. ``distances`` counts those worked out."""

    def __init__(self, x: np.ndarray):
        self.x, self.distances = x, 0
        centre, radius, kids, member = [], [], [], []
        dots = x @ x[0]
        self.distances += len(x)
        queue = [(0, np.arange(len(x)), dots, 2.0)]
        at = 0
        while at < len(queue):
            c, m, near_c, r = queue[at]
            queue[at] = None  # its distances are done with
            at += 1
            wide = float(np.sqrt(max(0.0, 2 - 2 * near_c.min())))
            centre.append(c)
            radius.append(wide)
            member.append(m)
            kids.append([])
            if len(m) == 1:
                continue
            while r / 2 > wide > 0:
                r /= 2
            near = 1 - (r / 2) ** 2 / 2
            rest, dots, i = m, near_c, c  # nested: a node's centre is the first of its children
            while len(rest):
                inside = dots >= near if wide > 0 else rest == i
                inside |= rest == i
                kids[-1].append(len(queue))
                queue.append((i, rest[inside], dots[inside], r / 2))
                rest = rest[~inside]
                if len(rest):
                    i = int(rest[0])
                    dots = x[rest] @ x[i] if wide > 0 else np.ones(len(rest))
                    self.distances += len(rest) * (wide > 0)
        self.centre, self.radius = np.int64(centre), np.float64(radius)
        self.kids, self.member = [np.int64(k) for k in kids], member
        self.single = np.int64([len(m) == 1 for m in member]) > 0

    def opened(self, node: int) -> np.ndarray:
        return np.int64([node]) if self.single[node] else self.kids[node]


def dual(a: CoverTree, b: CoverTree, threshold: float, weight_a: np.ndarray, weight_b: np.ndarray):
    """(links of a's vectors, of b's, linked pairs that connect as all links do, distances worked out). With a is b, each pair of nodes is met once and a vector does not link with itself."""
    tau, same, worked = float(np.sqrt(2 - 2 * threshold)), a is b, 0
    links_a, links_b = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, 0)]
    while stack:
        n, m = stack.pop()
        if same and n == m and a.single[n]:
            continue
        every_p, q = a.opened(n), b.opened(m)
        step = max(1, STRIP // len(q))
        for at in range(0, len(every_p), step):
            p = every_p[at : at + step]
            d = a.x[a.centre[p]] @ b.x[b.centre[q]].T
            worked += d.size
            far = np.sqrt(np.maximum(0.0, 2 - 2 * d))
            radii = a.radius[p][:, None] + b.radius[q][None, :]
            leaf = a.single[p][:, None] & b.single[q][None, :]
            once = p[:, None] <= q[None, :] if same and n == m else np.ones_like(leaf)
            i, j = np.nonzero(leaf & once & (d >= threshold) & ((p[:, None] != q[None, :]) if same else True))
            if len(i):
                i, j = a.centre[p[i]], b.centre[q[j]]
                np.add.at(links_a, i, weight_b[j])
                np.add.at(links_b, j, weight_a[i])
                edges.append((i, j))
            whole = ~leaf & once & (far + radii <= tau - SLACK) & ((p[:, None] != q[None, :]) if same else True)
            for k, l in zip(*np.nonzero(whole)):
                i, j = a.member[p[k]], b.member[q[l]]
                links_a[i] += weight_b[j].sum()
                links_b[j] += weight_a[i].sum()
                edges.append((i, np.full(len(i), b.centre[q[l]])))
                edges.append((np.full(len(j), a.centre[p[k]]), j))
            go = ~leaf & ~whole & once & (far <= tau + radii + SLACK)
            stack.extend(zip(*(x.tolist() for x in (p[np.nonzero(go)[0]], q[np.nonzero(go)[1]]))))
    none = np.zeros(0, np.int64)
    pairs = tuple(np.concatenate([none, *x]) for x in zip(*edges)) if edges else (none, none)
    return links_a, links_b, pairs, worked


def _mixed(x):
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label (string), key (128 bits of the vector; null unless it can link), vec (unit, doubles as bytes)."""

    def read(batches):
        for b in batches:
            lists = b.column(1)
            lists = lists.fill_null([]) if lists.null_count else lists
            lens = lists.value_lengths().to_numpy().astype(np.int64)
            values = lists.flatten()
            bad = ~np.isfinite(x := values.fill_null(float("nan")).to_numpy().copy())
            x[bad] = 0.0
            offs = np.r_[0, np.cumsum(lens)]
            some = np.flatnonzero(lens)

            def each(v, best):
                out = np.zeros(len(lens), v.dtype)
                if len(some):
                    out[some] = best.reduceat(v, offs[some])
                return out

            top = each(np.abs(x), np.maximum)
            ok = (lens > 0) & (each(bad.astype(np.int64), np.add) == 0) & (top > 0) & b.column(0).is_valid().to_numpy(False) & b.column(2).is_valid().to_numpy(False)
            scale = np.where(ok & ((top > 1e150) | (top < 1e-150)), top, 1.0)  # squares that would overflow or vanish
            x = x / np.repeat(scale, lens)
            norm = np.sqrt(each(x * x, np.add))
            unit = x / np.repeat(np.where(norm > 0, norm, 1.0), lens)
            place = np.arange(len(x)) - np.repeat(offs[:-1], lens)
            bits = values.fill_null(0.0).to_numpy().view(U64)
            parts = [each(_mixed(bits ^ _mixed(place.astype(U64) + U64(s))), np.add) for s in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
            raw, keys = unit.tobytes(), np.stack(parts, 1).tobytes()
            yield (
                b.column(0), b.column(2), [keys[16 * i : 16 * i + 16] if o else None for i, o in enumerate(ok.tolist())],
                [raw[8 * s : 8 * e] if o else None for o, s, e in zip(ok.tolist(), offs[:-1].tolist(), offs[1:].tolist())],
            )

    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    return map_arrow(rows, read, "id long, label string, key binary, vec binary")


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark, limit = rows.sparkSession, float(np.arccos(threshold))
    units = unit_vectors(rows, id_col, vector_col, label_col)
    reps = units.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("vec").alias("vec")).withColumn("dim", F.octet_length("vec"))
    reps = saved(reps, "vectors")
    groups = reps.groupBy("label", "dim").agg(F.count("*").alias("m"), F.min_by("vec", "rep").alias("pivot"))
    groups = saved(groups, "groups")

    def angles(batches):
        for b in batches:
            x, p = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64) for c in (4, 7))
            size = np.int64(b.column(5).to_pylist()) // 8
            dots = np.add.reduceat(x * p, np.cumsum(size) - size)
            yield *(b.column(c) for c in range(7)), np.arccos(np.clip(dots, -1, 1))

    joined = reps.join(groups, ["label", "dim"]).select("label", "key", "rep", "n", "vec", "dim", "m", "pivot")
    placed = saved(map_arrow(joined, angles, "label string, key binary, rep long, n long, vec binary, dim int, m long, angle double"), "angles")
    share = F.ceil(F.col("m") / block).cast("int")
    cuts = placed.where(F.col("m") > block).groupBy("label", "dim").agg(F.max("m").alias("m"), F.percentile_approx("angle", F.lit([i / 256 for i in range(1, 256)]), F.lit(10000)).alias("q"))
    cuts = cuts.select("label", "dim", F.transform(F.sequence(F.lit(1), F.least(share, F.lit(256)) - 1), lambda i: F.element_at("q", F.ceil(i * 256 / F.least(share, F.lit(256))).cast("int"))).alias("cuts"))
    salt = F.when(F.col("m") > 256 * block, F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / (256 * block)))).otherwise(F.lit(0))
    blocks = placed.join(saved(cuts, "cuts"), ["label", "dim"], "left").select("label", "dim", "rep", "n", "vec", "angle", (F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("angle"))), F.lit(0)) + 256 * salt).cast("int").alias("block"))
    ranges = saved(blocks.groupBy("label", "dim", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high")), "ranges")
    x, y = ranges.alias("x"), ranges.alias("y")
    near = (F.col("x.low") <= F.col("y.high") + limit + SLACK) & (F.col("y.low") <= F.col("x.high") + limit + SLACK)
    meet = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.block") <= F.col("y.block")) & near)
    meet = meet.select(F.col("x.label").alias("label"), F.col("x.dim").alias("dim"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    meet = saved(meet.select("label", "dim", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "meet")
    work = blocks.join(meet, ["label", "dim", "block"]).select("label", "dim", "i", "j", "block", "rep", "n", "vec")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    work = work.repartition(parts, "label", "dim", "i", "j").sortWithinPartitions("label", "dim", "i", "j", "block", "rep")

    def compare(batches):
        def done(key, held):
            rep, n, blk = (np.concatenate([h[c].to_numpy() for h in held]) for c in (5, 6, 4))
            x = np.frombuffer(b"".join(v for h in held for v in h[7].to_pylist()), np.float64).reshape(len(rep), -1)
            if key[2] == key[3]:
                tree = CoverTree(x)
                la, lb, (a, b), _ = dual(tree, tree, threshold, n, n)
                links = la + lb
            else:
                one, two = np.flatnonzero(blk == key[2]), np.flatnonzero(blk == key[3])
                if not len(one) or not len(two):
                    return
                la, lb, (a, b), _ = dual(CoverTree(x[one]), CoverTree(x[two]), threshold, n[one], n[two])
                links = np.zeros(len(rep), np.int64)
                links[one], links[two] = la, lb
                a, b = one[a], two[b]
            o = np.argsort(rep, kind="stable")
            back = np.empty(len(o), np.int64)
            back[o] = np.arange(len(o))
            root = rep[o][local_stars(len(rep), back[a], back[b])][back]
            some = (links != 0) | (root != rep)
            if some.any():
                yield rep[some], links[some], root[some]

        key, held = None, []
        for b in batches:
            new = list(zip(*(b.column(c).to_pylist() for c in range(4))))
            cuts = [0] + [k for k in range(1, len(new)) if new[k] != new[k - 1]] + [len(new)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if new[s] != key and held:
                    yield from done(key, held)
                    held = []
                key = new[s]
                held.append([b.column(c).slice(s, e - s) for c in range(8)])
        if held:
            yield from done(key, held)

    found = saved(map_arrow(work, compare, "rep long, links long, root long"), "links")
    parts_of = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.select("label", "key", "rep", "n").join(links, "rep", "left").join(parts_of, F.col("rep") == F.col("node"), "left")
    of_rep = saved(of_rep.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "classes")
    out = units.select("id", "label", "key").join(of_rep, ["label", "key"], "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
