"""N-gram Jaccard join: documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

Method: chosen paths. Sets are known by ``HASHES`` min-wise samples; a token is a sample's place and value, so
two sets share a token at a place with the probability of their similarity. A run starts with all sets in one
bucket. A bucket samples 1 / threshold places on average (the same ones for all its sets), and each set goes on
into one child for every sampled place, together with the sets that share its token there. So a pair at the
threshold goes on in one child on average however deep the recursion. Buckets of up to ``SMALL`` sets are brute-
forced and go no further; larger ones are split again, down to ``DEPTH``, and then brute-forced in blocks. Runs are
made ``RUNS`` at a time. A further round leaves out buckets whose sets are connected already (so a large group of
near copies costs one round), and rounds end when the links that the last one added say that those still missing
are a share below 1 - ``recall`` (and no earlier than the chance of a pair at the threshold at full depth asks for).

Brute force in a bucket compares all samples of a pair and takes what could be a link (``least_equal``: 4.5
standard deviations below the threshold, one pair at the threshold in 200,000 is lost); only such pairs connect.
Every connected group is then compared exactly, by shingles, cut into blocks of bounded size, every pair of blocks a
task, so that a group of any size is spread. Links are counted there, and only star edges leave a task; classes
are closed over exact links alone. Equal sets are one representative with a count throughout.

Defined results: a text of one to four words has one shingle, all its words; a text without words (null, empty)
links with nothing and is its own class; rows with a null id have a null class and no links; rows that repeat an id
and text are one document twice and count as links of each other; ties take the least id; a very long text is a
slice of its own and its whole set is compared; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U64, WORD_POWERS, Texts, mix, prefix_hash, slices, span_hash
from .common import map_arrow, row_key, saved, small
from .components import components, local_stars

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 128
STEP, DEPTH, RUNS, RECALL, MOST_ROUNDS, SMALL = 2, 6, 4, 0.999, 12, 64  # STEP: splits between two looks at the buckets' sizes
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
XORS, ODDS = _SEEDS[:HASHES], _SEEDS[HASHES:] | U64(1)


def shingle_sets(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text one after another, offsets)."""
    t.words()
    n = np.diff(t.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.r_[0, np.cumsum(count)]
    start = np.arange(to[-1]) + np.repeat(t.first[:-1] - to[:-1], count)
    end = start + np.repeat(np.minimum(n, size), count)
    h = span_hash(prefix_hash(t.hashes(), WORD_POWERS), start, end, WORD_POWERS)
    new = np.ones(len(h), bool)
    for a, b in zip(to[:-1].tolist(), to[1:].tolist()):
        h[a:b].sort()
    new[1:] = h[1:] != h[:-1]
    lead = to[:-1][count > 0]
    new[lead] = True
    return h[new], np.r_[0, np.cumsum(new)][to]


def samples(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """HASHES min-wise samples (uint32) of every set; zeros for an empty one."""
    some = np.flatnonzero(np.diff(offs))
    out = np.zeros((len(offs) - 1, HASHES), np.uint32)
    step = 1 << 16
    cuts = [0]
    while cuts[-1] < len(some):  # pieces that stay in the processor's cache
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offs[some], offs[some[cuts[-1]]] + step))))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = offs[some[a:b]]
        x = sets[at[0] : offs[some[min(b, len(some)) - 1] + 1]]
        y = np.empty_like(x)
        for k in range(HASHES):
            np.bitwise_xor(x, XORS[k], out=y)
            np.multiply(y, ODDS[k], out=y)
            out[some[a:b], k] = np.minimum.reduceat(y, at - at[0]) >> U64(32)
    return out


def set_keys(sets: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """128 bits by which equal sets are found; None for an empty one."""
    some = np.flatnonzero(np.diff(offs))
    out: list[bytes | None] = [None] * (len(offs) - 1)
    if len(some):
        a, b = (np.add.reduceat(mix(sets ^ U64(s)), offs[some]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
        for i, x in zip(some.tolist(), np.stack([a, b], 1)):
            out[i] = x.tobytes()
    return out


def least_equal(threshold: float) -> int:
    """Equal samples of HASHES below which a pair isn't looked at."""
    return int(HASHES * threshold - 4.5 * np.sqrt(HASHES * threshold * (1 - threshold)))


def children(path: np.ndarray, row: np.ndarray, sample: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the children: a bucket takes 1 / threshold of the samples on average, the same ones for all its rows."""
    share = 1 / threshold
    first, stride = (path >> U64(20)).astype(np.int64), (path >> U64(40)).astype(np.int64) | 1  # odd: places don't repeat
    chance = (path & U64(0xFFFF)).astype(np.float64) / 65536
    out = []
    for k in range(min(HASHES, int(np.ceil(share)))):
        on = np.flatnonzero(chance < share - k)
        token = (first[on] + k * stride[on]) % HASHES
        value = sample[row[on], token].astype(U64)
        out.append((mix(path[on] ^ mix(value + (token.astype(U64) << U64(40)) + U64(1))), row[on]))
    return tuple(np.concatenate(x) for x in zip(*out))


def survival(threshold: float, depth: int) -> float:
    """The chance that two sets at the threshold share a bucket after depth splits of one run."""
    share, s = 1 / threshold, 1.0
    whole, rest = int(share), share - int(share)
    for _ in range(depth):
        apart = 1 - threshold * s
        s = 1 - ((1 - rest) * apart**whole + rest * apart ** (whole + 1))
    return s


def sketch_links(groups: DataFrame, threshold: float) -> DataFrame:
    """Star edges (a, b) of pairs within a bucket that agree in least_equal samples. groups: path, i, j, block, rep, component, low; i, j: the two blocks of this task."""
    least = least_equal(threshold)

    def agree(low, x, y):
        out = np.zeros(len(x), bool)
        for at in range(0, len(x), 1 << 16):
            p, q = x[at : at + 65536], y[at : at + 65536]
            out[at : at + 65536] = (low[p] == low[q]).sum(1) >= least
        return x[out], y[out]

    def done(path, i, j, block, rep, part, low):
        lead = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        size, found = np.diff(np.r_[lead, len(path)]), []
        plain = (size <= SMALL) & (i[lead] == j[lead])
        row = np.flatnonzero(np.repeat(plain, size))
        later = np.repeat(lead + size, size)[row] - row - 1  # each row with those behind it in its bucket
        x = np.repeat(row, later)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
        apart = part[x] != part[y]
        found.append(agree(low, x[apart], y[apart]))
        for a, n in zip(lead[~plain].tolist(), size[~plain].tolist()):
            own = np.arange(a, a + n)
            one, two = own[block[own] == i[a]], own[block[own] == j[a]]
            for at in range(0, len(one), 64):
                x, y = np.repeat(one[at : at + 64], len(two)), np.tile(two, len(one[at : at + 64]))
                apart = (part[x] != part[y]) & ((x < y) | (i[a] != j[a]))
                found.append(agree(low, x[apart], y[apart]))
        x, y = (np.concatenate(z) for z in zip(*found))
        root = local_stars(len(rep), x, y)
        far = np.flatnonzero(root != np.arange(len(rep)))
        both = np.unique(np.stack([np.maximum(rep[far], rep[root[far]]), np.minimum(rep[far], rep[root[far]])], 1), axis=0)
        return both[:, 0], both[:, 1]

    def run(batches):
        held = None
        for b in batches:
            new = [*(b.column(c).to_numpy() for c in range(6)), np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(-1, HASHES)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            path, i, j = held[:3]
            last = np.flatnonzero((path != path[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield done(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield done(*held)

    return map_arrow(groups, run, "a long, b long")


def round_links(reps: DataFrame, low: DataFrame, near: DataFrame | None, first_run: int, threshold: float) -> DataFrame:
    """Edges that RUNS runs add. reps: rep, sample; low: rep, low; near: node, component of what is connected so far."""
    component = F.coalesce("component", "rep") if near is not None else F.col("rep")

    def split(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sample = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
                lists = part.column(3)
                path, n = lists.flatten().to_numpy().view(U64), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                for _ in range(STEP):
                    path, row = children(path, row, sample, threshold)
                yield path.view(np.int64), part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]

    starts = mix(np.arange(first_run + 1, first_run + RUNS + 1, dtype=U64)).view(np.int64).tolist()
    of = reps.join(near.hint("merge"), F.col("rep") == F.col("node"), "left") if near is not None else reps
    active, buckets = of.select("rep", component.alias("component"), "sample", F.array(*map(F.lit, starts)).alias("paths")), []
    for depth in range(STEP, DEPTH + 1, STEP):
        rows = saved(map_arrow(active, split, "path long, rep long, component long"), "paths")
        sizes = rows.groupBy("path").agg(F.count("*").alias("m"), F.min("component").alias("low_one"), F.max("component").alias("high_one"))
        sizes = saved(sizes.where("m > 1 and low_one < high_one").select("path", "m"), "buckets")
        done = sizes if depth + STEP > DEPTH else sizes.where(F.col("m") <= SMALL)
        buckets.append(rows.join(small(done.withColumnRenamed("path", "of")), F.col("path") == F.col("of")).select("path", "rep", "component", "m"))
        if depth + STEP > DEPTH or sizes.where(F.col("m") > SMALL).isEmpty():
            break
        on = rows.join(small(sizes.where(F.col("m") > SMALL).select(F.col("path").alias("of"))), F.col("path") == F.col("of"))
        on = saved(on.groupBy("rep").agg(F.first("component").alias("component"), F.collect_list("path").alias("paths")), "split-again")
        active = reps.join(small(on.withColumnRenamed("rep", "on")), F.col("rep") == F.col("on")).select("rep", "component", "sample", "paths")
    rows = buckets[0]
    for more in buckets[1:]:
        rows = rows.unionByName(more)
    rows = saved(rows, "members")
    own = low.join(small(rows.select("rep").distinct()), "rep", "left_semi")
    blocks = F.ceil(F.col("m") / BLOCK_DOCS).cast("int")
    rows = rows.select("path", "rep", "component", blocks.alias("blocks")).join(own.hint("merge"), "rep")
    rows = rows.select("*", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "low")
    rows = rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "rep")
    return saved(sketch_links(rows, threshold).distinct(), "found")


def connected(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """node, component over the links of rounds of runs, until the target recall."""
    low = saved(map_arrow(reps.select("rep", "sample"), lambda batches: ((b.column(0), [np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]) for b in batches), "rep long, low binary"), "low")
    near, merged, missed = None, 0, 1.0
    miss = (1 - survival(threshold, DEPTH)) ** RUNS
    for k in range(MOST_ROUNDS):
        edges = round_links(reps, low, near, k * RUNS, threshold)
        if near is not None:
            edges = edges.unionByName(near.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        near = saved(components(edges), "near")
        now = near.where("node <> component").count()
        fresh, merged, missed = now - merged, now, missed * miss
        if missed <= 1 - recall and fresh * miss / (1 - miss) <= (1 - recall) * merged:
            break
    return near


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[i[k]] and sets[j[k]], exactly; dense groups by matrix products over their shared shingles."""
    out = np.zeros(len(i), np.int64)
    label = local_stars(len(sets), i, j)[i]
    o = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.r_[True, label[o][1:] != label[o][:-1], True]) if len(o) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = o[a:b]
        if len(own) <= 16:
            for k in own:
                x, y = sets[i[k]], sets[j[k]]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                out[k] = (y[at] == x).sum()
            continue
        docs, back = np.unique(np.r_[i[own], j[own]], return_inverse=True)
        p, q = back[: len(own)], back[len(own) :]
        every = np.concatenate([sets[d] for d in docs])
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(sets[d]) for d in docs])
        s = np.argsort(every, kind="stable")
        every, doc = every[s], doc[s]
        new = np.r_[True, every[1:] != every[:-1]]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1  # a shingle of one set alone meets none
        column, doc = np.cumsum(np.r_[True, column[shared][1:] != column[shared][:-1]]) - 1 if shared.any() else column[:0], doc[shared]
        total = np.zeros((len(docs), len(docs)), np.float32) if len(column) else np.zeros((len(docs), len(docs)), np.float32)
        wide = 4096
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            f, e = np.searchsorted(column, [c, c + wide])
            m = np.zeros((len(docs), wide), np.float32)
            m[doc[f:e], column[f:e] - c] = 1
            total += m @ m.T
        out[own] = total[p, q]
    return out


def linked(sets: list[np.ndarray], sample: np.ndarray, one: np.ndarray, two: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of one x two, or within one) at the threshold or above."""
    pairs_i, pairs_j, least = [], [], least_equal(threshold)
    other = one if two is None else two
    for at in range(0, len(one), 256):
        part = one[at : at + 256]
        same = np.zeros((len(part), len(other)), np.uint8)
        for k in range(HASHES):
            same += sample[part, k][:, None] == sample[other, k][None, :]
        x, y = np.nonzero(same >= least)
        if two is None:
            keep = x + at < y
            x, y = x[keep], y[keep]
        pairs_i.append(part[x])
        pairs_j.append(other[y])
    i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
    size = np.int64([len(s) for s in sets])
    near = np.minimum(size[i], size[j]) >= (threshold - 1e-9) * np.maximum(size[i], size[j])
    i, j = i[near], j[near]
    both = overlaps(sets, i, j)
    hit = both >= threshold * (size[i] + size[j] - both) - 1e-9
    return i[hit], j[hit]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (least id of the linked group), n_links (documents linked directly, copies included), kept, and key_a, key_b (row_key of id and text) for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row_key(F.col(id_col), F.col(text_col)))

    def sign(batches):
        for b in batches:
            for at, t in slices(b.column(1)):
                sets, offs = shingle_sets(t)
                low = samples(sets, offs)
                keys = set_keys(sets, offs)
                yield *(b.column(c).slice(at, t.n) for c in (0, 2, 3)), keys, np.diff(offs), [None if k is None else x.tobytes() for k, x in zip(keys, low)]

    signed = saved(map_arrow(rows, sign, "doc_id long, key_a long, key_b long, key binary, n_shingles int, sample binary"), "signed")
    real = signed.where("key is not null and doc_id is not null")
    reps = saved(real.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), F.any_value("sample").alias("sample")), "reps")
    near = connected(reps.select("rep", "sample"), threshold, recall)
    placed = reps.join(near, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "n_shingles", F.coalesce("component", "rep").alias("place"))
    placed = saved(placed, "placed")
    size = placed.groupBy("place").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w")).where("m > 1")
    size = saved(size.select("place", F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "sizes")
    todo = saved(placed.join(size, "place").select("key", "rep", "n", "place", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")), "todo")

    def expand(batches):
        for b in batches:
            for at, t in slices(b.column(1)):
                sets, offs = shingle_sets(t)
                part = b.slice(at, t.n)
                keys = set_keys(sets, offs)
                ok = np.flatnonzero([k == x for k, x in zip(keys, part.column(2).to_pylist())])  # not another text of the same id
                low = samples(sets, offs).astype(np.uint8)
                rest = part.take(ok)
                yield rest.column(0), rest.column(3), rest.column(4), rest.column(5), rest.column(6), [low[k].tobytes() for k in ok], [sets[offs[k] : offs[k + 1]].tobytes() for k in ok]

    texts = rows.select("doc_id", "text").join(small(todo), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "key", "n", "place", "blocks", "block")
    work = map_arrow(texts, expand, "rep long, n long, place long, blocks int, block int, sample binary, shingles binary")
    work = work.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    work = work.select("place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "sample", "shingles")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    work = work.repartition(parts, "place", "i", "j").sortWithinPartitions("place", "i", "j")

    def verify(batches):
        def done(key, held):
            block, rep, n = (np.concatenate([h[c].to_numpy() for h in held]) for c in (0, 1, 2))
            _, own = np.unique(rep, return_index=True)  # rows that repeat an id; in the ids' order
            block, rep, n = block[own], rep[own], n[own]
            if len(rep) < 2:
                return
            low = [x for h in held for x in h[3].to_pylist()]
            sets = [x for h in held for x in h[4]]
            low = np.frombuffer(b"".join(low[k] for k in own), np.uint8).reshape(-1, HASHES)
            sets = [np.frombuffer(sets[k].as_buffer(), U64) for k in own]
            one = np.flatnonzero(block == key[1])
            i, j = linked(sets, low, one, None if key[1] == key[2] else np.flatnonzero(block == key[2]), threshold)
            if not len(i):
                return
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            some = links > 0
            yield rep[some], links[some], rep[local_stars(len(rep), i, j)][some]

        key, held = None, []
        for b in batches:
            new = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            cuts = [0] + [k for k in range(1, len(new)) if new[k] != new[k - 1]] + [len(new)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if new[s] != key and held:
                    yield from done(key, held)
                    held = []
                key = new[s]
                held.append([b.column(c).slice(s, e - s) for c in range(3, 8)])
        if held:
            yield from done(key, held)

    found = saved(map_arrow(work, verify, "rep long, links long, root long"), "found")
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.join(links, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    of_rep = saved(of_rep.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("class_id")), "classes")
    out = signed.select("doc_id", "key_a", "key_b", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(of_rep, "key", "left")
    own = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", own.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"), "key_a", "key_b")
