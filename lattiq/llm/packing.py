"""Conflict-constrained best-fit packing of documents into sequences (operator 8)."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import base

CAPACITY = 2048
#: Documents and code points of a shard, about; shards are packed independently, so these bound a
#: task's memory, and each shard leaves its own last bins open.
SHARD, SHARD_CHARS = 4096, 1 << 23


def pack(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Best fit decreasing with conflicts.  ``items``: ``(size, source, cluster)``, sizes from 1
    to ``capacity``, largest first.  Returns ``(bin, offset)`` of each.

    Open bins are ordered by residual.  The search starts at the least residual that holds the
    item and goes on to the next larger one until a bin has neither the item's source nor its
    cluster in its bitmaps: the tightest compatible bin.  Else a new bin opens.
    """
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    used: list[int] = []
    placed = []
    has: dict[int, int] = {}  # open bins that hold a source
    for size, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1)) if has.get(source, 0) < len(order) else len(order)
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(used)
            sources.append(0), clusters.append(0), used.append(0)
        placed.append((b, used[b]))
        used[b] += size
        sources[b] |= s
        clusters[b] |= c
        if residual > size:
            insort(order, (residual - size, b))
        # counts of bins that are still open, by source; closed bins leave all counts
        gone = sources[b] if residual == size else 0
        if not gone:
            has[source] = has.get(source, 0) + 1
        else:
            rest = gone & ~s
            while rest:
                low = rest & -rest
                has[low.bit_length() - 1] -= 1
                rest ^= low
    return placed


def _rows(docs: DataFrame, text: str, key: str, source: str, cluster: str | None) -> DataFrame:
    """Ids, sources and clusters as hashes; without a column of clusters, texts that are equal up to
    case and white space are one."""
    low = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+", " "))
    named = F.xxhash64(low) if cluster is None else F.xxhash64(F.col(cluster).cast("string"))
    own = F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(source), F.lit("\0"))).alias("source"), named.alias("cluster")
    words = F.when(low == "", F.lit(0)).otherwise(F.length(low) - F.length(F.replace(low, F.lit(" "), F.lit(""))) + 1)
    return docs.select(*own, words.cast("long").alias("n"), base.text_or_empty(text).alias("text"))


def _dealt(rows: DataFrame, docs: DataFrame, text: str, shard: int) -> DataFrame:
    """Rows with a shard each: as many as keep a shard to about ``shard`` documents and
    ``SHARD_CHARS`` code points."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-size["n"] // shard), -(-size["chars"] // SHARD_CHARS))
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.lit("shard")), F.lit(shards)))


def _fitted(rows: list[tuple[int | None, int, int, int]], shard: int, capacity: int) -> list[tuple]:
    """``row, piece, n_words, bin_id, offset`` of the rows ``(doc_id, n, source, cluster)`` of a shard,
    which come in order.  Full pieces have bins of their own."""
    out, todo, full = [], [], 0
    bits: tuple[dict, dict] = ({}, {})
    first = shard << 32
    for i, (_, n, s, c) in enumerate(rows):
        if n == 0:
            out.append((i, 0, 0, None, None))
            continue
        whole, rest = divmod(n, capacity)
        for piece in range(whole):
            out.append((i, piece, capacity, first + full, 0))
            full += 1
        if rest:
            todo.append((-rest, i, whole, bits[0].setdefault(s, len(bits[0])), bits[1].setdefault(c, len(bits[1]))))
    todo.sort(key=lambda t: t[:2])
    for (rest, i, piece, _, _), (b, offset) in zip(todo, pack([(-t[0], t[3], t[4]) for t in todo], capacity), strict=True):
        out.append((i, piece, -rest, first + full + b, offset))
    return out


def assign(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None) -> DataFrame:
    """Place each document's words in bins of ``capacity`` words.

    Returns ``doc_id, piece long, n_words long, bin_id long, offset long``.  A document of more
    than ``capacity`` words is cut into full pieces, each a bin of its own, and a last piece that
    is packed.  Documents without words (null or empty texts) get one row with piece 0, no words
    and no bin (null).  A bin has at most one document of each source (null is a source) and of
    each duplicate cluster: a column such as the component of a near-duplicate operator, or else
    texts that are equal up to case and white space.

    Documents are dealt by a hash of id and cluster to shards of about ``shard``, so a hot source or
    cluster is spread over all of them; only sizes and hashes are shuffled.  Repeated rows are
    packed one by one (being one cluster, into different bins).
    """
    dealt = _dealt(_rows(docs, text, key, source, cluster).drop("text"), docs, text, shard)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "source", "n"], kind="stable")
        ids = pdf["doc_id"].array
        rows = list(zip(ids, pdf["n"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), strict=True))
        out = [(ids[i], *rest) for i, *rest in _fitted(rows, int(pdf["shard"].iloc[0]), capacity)]
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "n_words", "bin_id", "offset"])
        return frame.astype({k: "Int64" for k in frame.columns})

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, n_words long, bin_id long, offset long")


def sequences(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None) -> DataFrame:
    """The packed sequences themselves, a row a bin.

    Returns ``bin_id long, n_words long, doc_ids array<long>, pieces array<long>, offsets
    array<long>, text string``: the bin's documents in the order of their offsets (in words), and
    their words, joined by one space.  Rules are those of :func:`assign`; a document without words
    is a row with a null bin and an empty text, so none is lost.  Texts are shuffled once.
    """
    dealt = _dealt(_rows(docs, text, key, source, cluster).drop("n"), docs, text, shard)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "cluster", "source", "text"], kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"].array]
        texts = [t.encode() for t in pdf["text"].tolist()]
        rows = list(zip(ids, [len(t.split()) for t in texts], pdf["source"].tolist(), pdf["cluster"].tolist(), strict=True))
        bins: dict[int | None, list] = {}
        for i, piece, n, b, offset in _fitted(rows, int(pdf["shard"].iloc[0]), capacity):
            bins.setdefault((i if b is None else None, b), []).append((offset or 0, i, piece, n))
        out = []
        for (_, b), members in bins.items():
            members.sort()
            words = [texts[i].split()[piece * capacity : piece * capacity + n] for _, i, piece, n in members]
            joined = b" ".join(w for x in words for w in x).decode()
            out.append((b, sum(m[3] for m in members), [ids[m[1]] for m in members], [m[2] for m in members], [m[0] for m in members], joined))
        frame = pd.DataFrame(out, columns=["bin_id", "n_words", "doc_ids", "pieces", "offsets", "text"])
        return frame.astype({"bin_id": "Int64", "n_words": "Int64"})

    kind = "bin_id long, n_words long, doc_ids array<long>, pieces array<long>, offsets array<long>, text string"
    return dealt.groupBy("shard").applyInPandas(run, kind)
