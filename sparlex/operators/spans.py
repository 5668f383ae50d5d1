"""Half-open character spans: overlap algebra, interval joins, assembly and verification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n"
NEEDLE_CHARS = 1 << 18  # of needles that an automaton holds


def overlap_chars(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared characters as a share of the shorter span; 0 if that is empty."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, overlap_chars(a0, a1, b0, b1) / shorter).otherwise(F.lit(0.0))


def overlapping(left: DataFrame, right: DataFrame, key: str, how: str = "inner", right_start: str = "unit_start", right_end: str = "unit_end") -> DataFrame:
    """left (char_start, char_end) with the right rows of the same key that share a character: a hash join with a residual."""
    return left.join(right, (left[key] == right[f"{key}_"]) & (right[right_start] < left["char_end"]) & (right[right_end] > left["char_start"]), how)


def assemble(units: DataFrame, min_chars: int = 30) -> DataFrame:
    """unit_no, unit_id, char_start, char_end of the units kept, abstracts first and captions last. units: paper_id, pos, type, text (canonical)."""
    order = F.when(F.col("type") == "abstract", 0).when(F.col("type") == "section", 1).otherwise(2)
    kept = units.where((F.length("text") >= min_chars) & F.col("type").isin("abstract", "section", "caption"))
    w = Window.partitionBy("paper_id").orderBy(order, "pos")
    size = F.length("text") + len(SEPARATOR)
    to_here = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    no = F.row_number().over(w) - 1
    return kept.select("*", no.alias("unit_no"), F.format_string("u%03d", no).alias("unit_id"), (to_here - size).cast("int").alias("char_start"), (to_here - len(SEPARATOR)).cast("int").alias("char_end"))


def paper_texts(units: DataFrame) -> DataFrame:
    """paper_id, text: the assembled units joined by the separator."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "text"))), lambda x: x["text"])
    return units.groupBy("paper_id").agg(F.array_join(rows, SEPARATOR).alias("text"))


def unit_problems(papers: DataFrame, units: DataFrame) -> DataFrame:
    """paper_id, problem of every breach: digest, length, first and last place, gaps, slices. papers: paper_id, text, text_sha256, n_chars.

    A paper's units are one array beside its text, so that the text is read once, whatever the number of units.
    """
    listed = units.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("unit_no", "char_start", "char_end", "text"))).alias("units"))
    n, here = len(SEPARATOR), papers.withColumnRenamed("text", "full").join(listed, "paper_id", "left").withColumn("units", F.coalesce("units", F.array().cast(listed.schema["units"].dataType)))
    name = lambda c, text: F.when(c, text)

    def of_unit(u, i):
        before = F.get("units", i - 1)["char_end"]
        return F.array(
            name(u["char_end"] <= u["char_start"], "empty unit"),
            name(F.substr("full", u["char_start"] + 1, u["char_end"] - u["char_start"]) != u["text"], "slice differs"),
            name((i == 0) & (u["char_start"] != 0), "first unit not at 0"),
            name((i > 0) & (u["char_start"] != before + n), "gap"),
            name((i == F.size("units") - 1) & (u["char_end"] != F.col("n_chars")), "last unit not at the end"),
        )

    of_paper = F.array(name(F.sha2("full", 256) != F.col("text_sha256"), "digest differs"), name(F.length("full") != F.col("n_chars"), "length differs"))
    problems = F.filter(F.concat(of_paper, F.flatten(F.transform("units", of_unit))), lambda x: x.isNotNull())
    return here.select("paper_id", F.explode(problems).alias("problem"))


def sound(papers: DataFrame, units: DataFrame) -> DataFrame:
    """The papers without a problem: what spans may be looked up in."""
    return papers.join(unit_problems(papers, units).select("paper_id").distinct(), "paper_id", "left_anti")


def guarded(papers: DataFrame, units: DataFrame) -> DataFrame:
    """papers; a paper with a problem is an error as soon as its row is read."""
    wrong = unit_problems(papers, units).groupBy("paper_id").agg(F.array_sort(F.collect_set("problem")).alias("wrong"))
    fail = F.raise_error(F.concat(F.lit("offsets of paper "), F.col("paper_id").cast("string"), F.lit(": "), F.array_join("wrong", ", "))).cast("string")
    joined = papers.join(wrong, "paper_id", "left")
    return joined.select(*[F.when(F.col("wrong").isNull(), F.col(c)).otherwise(fail).alias(c) if c == "text" else F.col(c) for c in papers.columns])


def dominant_unit(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """Every chunk with the unit that shares most characters with it (the earliest of equals), or nulls, and whether any shared unit has an equation."""
    both = overlapping(chunks, units, "paper_id", "left")
    shared = overlap_chars(F.col("char_start"), F.col("char_end"), F.col("unit_start"), F.col("unit_end"))
    best = F.max_by(F.struct("unit_id", "section_heading", "parent_heading", "section_type"), F.struct(shared.alias("n"), (-F.col("unit_no")).alias("o")))
    return both.groupBy(*[chunks[c] for c in chunks.columns]).agg(F.when(F.max("unit_id").isNotNull(), best).alias("unit"), F.coalesce(F.bool_or("contains_equation"), F.lit(False)).alias("contains_equation"))


def blocks_of(rows: list, text: str) -> list[list]:
    """Rows in blocks of up to NEEDLE_CHARS characters."""
    out, size = [[]], 0
    for r in rows:
        n = len(r[text] or "")
        if out[-1] and size + n > NEEDLE_CHARS:
            out.append([])
            size = 0
        out[-1].append(r)
        size += n
    return out


def occurrences(needles: list[str]):
    """A function from a text to (needle's index, place) of all occurrences, overlapping ones too."""
    try:
        import ahocorasick
    except ImportError:

        def one_by_one(text):
            for k, needle in enumerate(needles):
                at = text.find(needle)
                while at >= 0:
                    yield k, at
                    at = text.find(needle, at + 1)

        return one_by_one
    every = ahocorasick.Automaton()
    for k, needle in enumerate(needles):
        every.add_word(needle, k)
    every.make_automaton()
    return lambda text: ((k, end + 1 - len(needles[k])) for end, k in every.iter(text))


def locate(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """qid, paper_id, char_start, char_end of all occurrences, overlapping ones too. needles: qid, needle, a stated set that the tasks hold in blocks; texts: paper_id, text.

    Every text is read once against a block's automaton, where it lies: nothing is shuffled.
    """
    rows = needles.where(F.length("needle") > 0).select("qid", "needle").distinct().collect()
    kinds, out = [needles.schema["qid"].dataType.simpleString(), texts.schema["paper_id"].dataType.simpleString()], None
    for block in blocks_of(rows, "needle"):
        part = _locate_block(block, texts.select("paper_id", "text"), *kinds)
        out = part if out is None else out.unionByName(part)
    return out


def _locate_block(block, texts: DataFrame, qid: str, paper: str) -> DataFrame:
    asked: dict[str, list] = {}
    for r in block:
        asked.setdefault(r.needle, []).append(r.qid)
    sent = texts.sparkSession.sparkContext.broadcast(asked)  # NEEDLE_CHARS characters at most, or one needle

    def run(frames):
        names = list(sent.value)
        find = occurrences(names) if names else lambda text: ()
        for f in frames:
            rows = [(q, i, at, at + len(names[k])) for i, text in zip(f["paper_id"].tolist(), f["text"].tolist()) if text for k, at in find(text) for q in sent.value[names[k]]]
            yield pd.DataFrame(rows, columns=["qid", "paper_id", "char_start", "char_end"])

    return texts.mapInPandas(run, f"qid {qid}, paper_id {paper}, char_start int, char_end int")


def longest_common(a: str, b: str) -> tuple[int, int]:
    """(place in b, length) of the longest run that a and b share; the earliest in a, then in b, of equals.

    A common run of some length holds common runs of all lengths below, so the length is a binary search.
    """
    low, high = 0, min(len(a), len(b))

    def runs(n: int) -> set[str]:
        return {a[i : i + n] for i in range(len(a) - n + 1)}

    while low < high:
        n = (low + high + 1) // 2
        have = runs(n)
        low, high = (n, high) if any(b[j : j + n] in have for j in range(len(b) - n + 1)) else (low, n - 1)
    if not low:
        return 0, 0
    have = {b[j : j + low] for j in range(len(b) - low + 1)}
    run = next(a[i : i + low] for i in range(len(a) - low + 1) if a[i : i + low] in have)
    return b.index(run), low


class CommonRuns:
    """The longest run that each of a block of needles shares with any of the texts read; of equals, that of the least id, then the earliest in its text.

    A suffix automaton of all needles is walked once by each text. A state keeps its longest match and the first text
    that reached it; at the end what a state has seen goes to the shorter runs that it ends with.
    """

    def __init__(self, needles: list[str]):
        self.next, self.link, self.size, self.needles = [{}], [-1], [0], needles
        for needle in needles:
            last = 0
            for c in needle:
                last = self._add(last, c)
        n = len(self.next)
        self.best, self.best_at = [0] * n, [None] * n  # longest run, its (id, end)
        self.seen = [None] * n  # the least (id, end) of any run

    def _state(self, size: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _add(self, last: int, c: str) -> int:
        following, link, size = self.next, self.link, self.size
        if c in following[last]:
            q = following[last][c]
            return q if size[q] == size[last] + 1 else self._split(last, q, c)
        new = self._state(size[last] + 1, 0, {})
        while last >= 0 and c not in following[last]:
            following[last][c] = new
            last = link[last]
        if last >= 0:
            q = following[last][c]
            link[new] = q if size[q] == size[last] + 1 else self._split(last, q, c)
        return new

    def _split(self, p: int, q: int, c: str) -> int:
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def read(self, key: int, text: str) -> None:
        following, link, size, best, best_at, seen = self.next, self.link, self.size, self.best, self.best_at, self.seen
        v = n = 0
        for end, c in enumerate(text, 1):
            to = following[v].get(c)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = following[v].get(c)
                n = size[v]
                if to is None:
                    continue
            v = to
            n += 1
            if n >= best[v] and (n > best[v] or key < best_at[v][0]):
                best[v], best_at[v] = n, (key, end)
            if seen[v] is None or key < seen[v][0]:
                seen[v] = (key, end)

    def found(self) -> list[tuple[int, int, int] | None]:
        """(length, id, place in its text) for every needle; None where no character is shared."""
        best = [(n, -at[0], -at[1]) if n else None for n, at in zip(self.best, self.best_at)]
        seen = list(self.seen)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up, at = self.link[v], seen[v]
            if up and at is not None:
                seen[up] = at if seen[up] is None else min(seen[up], at)
                here = (self.size[up], -at[0], -at[1])
                best[up] = here if best[up] is None else max(best[up], here)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):  # a run's longest suffix counts for it too
            up = best[self.link[v]]
            best[v] = up if best[v] is None else best[v] if up is None else max(best[v], up)
        out = []
        for needle in self.needles:
            v, top = 0, None
            for c in needle:
                v = self.next[v][c]
                top = best[v] if top is None else top if best[v] is None else max(top, best[v])
            out.append(top and (top[0], -top[1], -top[2] - top[0]))
        return out


def nearest(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, paper_id, char_start, n_chars: for every needle the longest run that it shares with any text (nulls and 0 if none). needles: item_id, needle, a stated set that the tasks hold in blocks; texts: paper_id, text.

    Every task reads all its texts against a block and sends a row a needle; of equal runs the least paper_id wins, then the earliest place.
    """
    out = None
    for block in blocks_of(needles.select("item_id", "needle").collect(), "needle"):
        part = _nearest_block([(r.item_id, r.needle or "") for r in block], texts.select("paper_id", "text"), needles.schema["item_id"].dataType.simpleString())
        out = part if out is None else out.unionByName(part)
    top = out.groupBy("item_id").agg(F.max_by(F.struct("paper_id", "char_start", "n_chars"), F.struct("n_chars", -F.col("paper_id"), -F.col("char_start"))).alias("b")).select("item_id", "b.*")
    every = needles.select("item_id").distinct().join(top, "item_id", "left")
    return every.select("item_id", "paper_id", "char_start", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def _nearest_block(block, texts: DataFrame, kind: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(frames):
        runs = CommonRuns([needle for _, needle in sent.value])
        for f in frames:
            for key, text in zip(f["paper_id"].tolist(), f["text"].tolist()):
                runs.read(key, text or "")
        rows = [(item, at[1], at[2], at[0]) for (item, _), at in zip(sent.value, runs.found()) if at]
        yield pd.DataFrame(rows, columns=["item_id", "paper_id", "char_start", "n_chars"])

    return texts.where("paper_id is not null").mapInPandas(run, f"item_id {kind}, paper_id long, char_start int, n_chars int")
