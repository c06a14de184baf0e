"""Near-duplicate documents by bottom-k sketches of one hash function (operator 4).

* A document's set holds the hashes of its distinct shingles; its sketch is the ``SKETCH`` least
  of them.  Equal sets merge to one class, named by its least id.
* Two sets with a Jaccard similarity of 0.8 share each of the least values of their union with
  probability 0.8, so sketches of 32 share under ``SHARED`` = 10 with probability 3e-10 (less for
  likelier pairs; never where a set is smaller than its sketch).  Hence it is enough to invert
  the ``32 - 10 + 1`` values of each sketch that the fewest classes retain: any two sketches
  with 10 values in common have one of those in common.  Values of frequent passages, and those
  of one class alone, drop out, and unrelated documents meet in no list.
* The estimate from the union of two sketches (shared values among its 32 least) drops pairs
  under ``SHARED``.  Each class meets the most central one of its lists; only in lists that this
  leaves in parts do the classes outside the largest part meet all, in blocks.  Classes so
  connected make a family, whose pairs that pass the estimate are counted exactly on full sets.
* A family of up to ``BLOCK`` classes is one unit of work.  A larger one first compares every
  class with its most central one; only what stays unlinked is compared with all, in blocks.
  Units emit the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattiq import scratch

from . import base
from lattiq.operators.components import components
from .words import grams, mix, slices, word_hashes

SKETCH, SHARED, BLOCK = 32, 10, 1024
#: Bits, as a power of two, of the table that picks texts to read again: 4 MB.
BITS = 25


def shingle_set(words: list[bytes], k: int, h: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of fewer words, the one of them all."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words) if h is None else h
    g = np.sort(grams(h, min(k, len(h))) ^ mix(np.array([min(k, len(h))], np.uint64)))
    return g[np.concatenate([[True], g[1:] != g[:-1]])]


def _sets(raw: list[bytes], k: int):
    for i, j in slices([len(x) for x in raw]):
        split = [x.lower().split() for x in raw[i:j]]  # of bytes: A-Z only
        h = word_hashes([w for x in split for w in x])
        at = 0
        for x in split:
            yield shingle_set(x, k, h[at : at + len(x)])
            at += len(x)


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    def make():
        def rows(columns):
            n, d1, d2, sketch = [], [], [], []
            for s in _sets(base.raw_texts(columns[1]), k):
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                d1.append(int.from_bytes(d[:8], "big", signed=True))
                d2.append(int.from_bytes(d[8:], "big", signed=True))
                sketch.append(s[:SKETCH].view(np.int64))
            yield [columns[0], n, d1, d2, sketch]

        return rows

    return base.mapped(docs.select("doc_id", "text"), make, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def _families(classes: DataFrame, block: int) -> DataFrame:
    """``rep, central`` and ``family`` of the classes that meet others in rare retained values
    and pass the estimate from the union of their sketches."""
    values = classes.select("rep", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    # sums are written before they are joined: the joins then read plain exchanges, and the rows of a
    # value that very many sketches retain can be split over tasks
    often = scratch.written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "often")
    common = values.join(often, "v").groupBy("rep", "n", "kept")
    common = common.agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("common"), F.sum("df").alias("weight"))
    least = F.least(F.lit(SHARED), F.ceil(F.col("n") * 0.8)).cast("int")
    room = F.greatest(F.lit(0), F.col("kept") - least + 1 - (F.col("kept") - F.size("common")))
    listed = common.withColumn("room", room).where("room > 0").select("rep", F.struct("weight", F.col("rep")).alias("central"), F.explode(F.slice("common", F.lit(1), F.col("room"))).alias("x"))
    every = scratch.written(listed.select("rep", "central", F.col("x.v").alias("v")), "lists")
    hubs = scratch.written(every.groupBy("v").agg(F.count("*").alias("m"), F.max("central")["rep"].alias("hub")).where("m > 1"), "hubs")
    listed = scratch.written(every.join(hubs, "v").select("v", "rep", "central", "hub"), "lists")
    scratch.dropped(often, every, hubs)

    # each class meets the most central one of its lists first
    pairs = listed.where("rep <> hub").select("rep", "hub").distinct()
    one = classes.select("rep", F.col("sketch").alias("s"))
    other = classes.select(F.col("rep").alias("hub"), F.col("sketch").alias("t"))
    need = lambda s: F.ceil(F.size(s) * 0.8)
    near = F.size(F.array_intersect("s", "t")) >= F.least(F.lit(SHARED), need("s"), need("t"))
    spokes = pairs.join(one, "rep").join(other, "hub").where(near).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    spokes = scratch.written(spokes, "spokes")

    # lists whose classes are not all in one family by now: those outside its largest meet all
    now = components(spokes)
    named = listed.join(now, F.col("rep") == F.col("node"), "left").select("v", "rep", F.coalesce("label", "rep").alias("label"))
    named = scratch.written(named, "named")
    parts = named.groupBy("v", "label").agg(F.count("*").alias("c"))
    open_lists = parts.groupBy("v").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_lists = scratch.written(open_lists.select("v", "m", (F.col("m") - F.col("main.c")).alias("l"), F.col("main.label").alias("main")), "open_lists")
    rows = scratch.written(named.join(open_lists, "v").select("v", "rep", "m", "l", (F.col("label") != F.col("main")).alias("far")), "open")
    scratch.dropped(named, open_lists)
    placed = crossed(rows, "v", [], block // 2).join(classes.select("rep", "sketch"), "rep")

    def meet(_, rows):
        sides = [{r: np.array(s, np.int64).view(np.uint64) for x, r, s in rows if x == side} for side in (0, 1)]
        names, sets = [list(x) for x in sides], [list(x.values()) for x in sides]
        return _forest(names[0], estimated(*sets), names[1]) if all(names) else []

    rest = base.streamed_groups(placed, ["v", "i", "j"], ["rep"], ["side", "rep", "sketch"], meet, "a long, b long")
    found = components(spokes.unionByName(rest.distinct())).withColumnRenamed("node", "rep").withColumnRenamed("label", "family")
    return found.join(listed.groupBy("rep").agg(F.first("central").alias("central")), "rep")


def crossed(rows: DataFrame, key: str, extra: list[str], half: int) -> DataFrame:
    """``key, i, j, side, rep``: blocks of the ``l`` far rows of a group (side 0) by blocks of all
    its ``m`` rows (side 1), each of about ``half`` rows."""
    blocks = lambda n: F.ceil(F.col(n) / half).cast("int")
    at = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = rows.where("far").select(key, at("l").alias("i"), each("m").alias("j"), F.lit(0).alias("side"), "rep", *extra)
    right = rows.select(key, each("l").alias("i"), at("m").alias("j"), F.lit(1).alias("side"), "rep", *extra)
    return left.unionByName(right)


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be in ``ids`` (``rep``), before any shuffle of texts.

    The ids set bits of a table of ``2 ** BITS``, at most ``2 ** (BITS - 6)`` rows however many
    there are, which is broadcast.  A row of another id passes only where hashes meet.
    """
    bit = lambda c: F.expr(f"xxhash64({c}) & {(1 << BITS) - 1}L")
    word = lambda c: F.shiftright(bit(c), 6)
    mask = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64({c}) & 63 as int))")
    table = ids.groupBy(word("rep").alias("_word")).agg(F.bit_or(mask("rep")).alias("_bits"))
    hit = (word("doc_id") == F.col("_word")) & (mask("doc_id").bitwiseAND(F.col("_bits")) != 0)
    return docs.join(F.broadcast(table), hit, "left_semi")


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets are similar: exact counts, as products of incidence matrices."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate([a, b]))
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    number = np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]))
    often = np.bincount(number)[number] > 1
    number, owner = number[often], owner[often]
    number = np.cumsum(np.concatenate([[False], number[1:] != number[:-1]])) if len(number) else number
    both = np.zeros((len(left), len(right)))
    width = 4096
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        i, j = np.searchsorted(number, [c, c + width])
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[owner[i:j], number[i:j] - c] = 1
        both += m[: len(left)] @ m[len(left) :].T
    return 100 * both >= percent * (a[:, None] + b[None, :] - both)


def estimated(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Pairs that the union of their sketches lets pass: shared values among its 32 least."""
    index: dict[int, list[int]] = {}
    for j, s in enumerate(right):
        for v in s[:SKETCH].tolist():
            index.setdefault(v, []).append(j)
    shared = np.zeros((len(left), len(right)), np.int32)
    for i, s in enumerate(left):
        for v in s[:SKETCH].tolist():
            if v in index:
                shared[i, index[v]] += 1
    need = lambda s: min(SHARED, -(-4 * len(s) // 5))
    return shared >= np.minimum(np.array([need(s) for s in left])[:, None], np.array([need(s) for s in right])[None, :])


def _forest(names: list[int], pairs: np.ndarray, other: list[int]):
    """Links of a spanning forest of the similar pairs, each node to its root."""
    ids = np.unique(np.array([*names, *other], np.int64))
    mine, theirs = np.searchsorted(ids, names), np.searchsorted(ids, other)
    label = np.arange(len(ids))
    for i in np.flatnonzero(pairs.any(1)):
        met = np.unique(np.append(label[theirs[pairs[i]]], label[mine[i]]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return [(int(ids[label[x]]), int(ids[x])) for x in np.flatnonzero(label != np.arange(len(ids)))]


def _links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int):
    a, b = [s for _, s in left], [s for _, s in right]
    passed = estimated(a, b)
    if not passed.any():
        return []
    rows, columns = passed.any(1), passed.any(0)
    left = [x for x, k in zip(left, rows, strict=True) if k]
    right = [x for x, k in zip(right, columns, strict=True) if k]
    exact = linked([s for _, s in left], [s for _, s in right], percent)
    return _forest([n for n, _ in left], exact, [n for n, _ in right])


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``a, b`` (``a < b``): links of a spanning forest of the similar classes' ids."""
    families = scratch.written(_families(classes, block), "families")
    sizes = scratch.written(families.groupBy("family").agg(F.count("*").alias("m"), F.max("central").alias("c")), "families")
    placed = families.join(sizes, "family").select("rep", "family", "m", F.col("c.rep").alias("center"))
    texts = among(docs, families).join(placed, F.col("doc_id") == F.col("rep")).select("rep", "family", "m", "center", "text")

    def make():
        def rows(columns):
            sets = [x.tobytes() for x in _sets(base.raw_texts(columns[4]), k)]
            yield [*columns[:4], sets]

        return rows

    sets = base.mapped(texts, make, "rep long, family long, m long, center long, shingles binary")
    sets = scratch.written(sets, "sets")
    scratch.released(docs.sparkSession)
    load = lambda raw: np.frombuffer(raw, np.uint64)

    def within(_, rows):
        members = list({r: load(s) for r, s in rows}.items())
        return _links(members, members, percent)

    small = base.streamed_groups(sets.where(F.col("m") <= block), ["family"], ["rep"], ["rep", "shingles"], within, "a long, b long")
    small = scratch.written(small, "links")

    large = sets.where(F.col("m") > block)
    middle = large.where("rep = center").select("family", F.col("shingles").alias("hub"))

    def star():
        def rows(columns):
            out = []
            for own, hub in zip(columns[3].to_pylist(), columns[4].to_pylist(), strict=True):
                x, y = load(own), load(hub)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield [columns[0], columns[1], columns[2], out]

        return rows

    seen = large.join(middle, "family").select("rep", "family", "center", "shingles", "hub")
    seen = scratch.written(base.mapped(seen, star, "rep long, family long, center long, near boolean"), "stars")
    spokes = seen.where("near and rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b"))
    far = seen.where("not near")
    left_over = far.groupBy("family").agg(F.count("*").alias("l"))
    every = large.join(left_over, "family").join(far.select("rep", F.lit(True).alias("far")), "rep", "left")
    every = every.select("family", "rep", "shingles", "m", "l", F.coalesce("far", F.lit(False)).alias("far"))

    def across(_, rows):
        sides = [list({r: load(s) for x, r, s in rows if x == side}.items()) for side in (0, 1)]
        return _links(*sides, percent) if all(sides) else []

    rest = base.streamed_groups(crossed(every, "family", ["shingles"], block // 2), ["family", "i", "j"], ["rep"], ["side", "rep", "shingles"], across, "a long, b long")
    return small.unionByName(spokes).unionByName(rest)


def classified(docs: DataFrame, k: int, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs``.

    Texts without words (null, empty) have an empty set and stay alone.  Rows without an id are
    linked with nothing and are kept, with a null component.  Rows that repeat an id share its
    least component if their texts are similar; each row is judged by its own text.
    """
    docs = docs.select("doc_id", "text")
    sketches = scratch.written(_sketches(docs, k), "sketches")
    real = sketches.where("n > 0 and doc_id is not null")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.written(classes, "classes")
    scratch.released(docs.sparkSession)
    found = components(links(docs, classes.select("rep", "n", "sketch"), k, percent, block))
    named = classes.select("d1", "d2", "rep").join(found, F.col("rep") == F.col("node"), "left")
    named = named.select("d1", "d2", F.coalesce("label", "rep").alias("label"))
    own = sketches.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("d1")).alias("d1"), "d2")
    joined = own.join(named, ["d1", "d2"], "left")
    component = F.coalesce("label", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of documents that are not kept.

    Rows with null or empty texts, and rows without an id, stay; of a group the least id stays,
    with all rows that repeat it and its text.  An empty table stays empty; columns are not read
    but for the id and the text.
    """
    gone = classified(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_lattiq_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_lattiq_gone"), "left_anti")
