"""Removal of word windows that also start earlier in the corpus (operator 1).

The reference of the whole corpus cannot be broadcast: it grows with the input, and streaming
every document past every shard would be quadratic.  So the reference is cut into shards by
content, and documents' parts are sent to the one shard that can match them:

* In each window of ``window`` words the run of ``anchor`` words with the least hash is its
  anchor.  Equal windows have equal anchors.  Windows in a row with the same anchor make a block.
* A block whose anchor occurs once has no repeated window.  The others are brought together by
  anchor; equal blocks are merged with map-side combination and leave their earliest place.
* A shard is an anchor's different blocks, in corpus order.  A suffix automaton over their words
  is built and the blocks are streamed through it: matching statistics give, for each window,
  the place of its first occurrence.  An anchor with over ``MANY`` different blocks is no shard of
  one task: its windows are aggregated by their very words, with map-side combination.
* What is known of a block goes back to its occurrences; a window that is not at its first place
  is removed, and windows that touch merge to maximal spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattiq import scratch

from . import base
from .automaton import SuffixAutomaton
from .words import Spans, grams, slices, word_hashes

ANCHOR = 8
MANY = 4096
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def blocks(h: np.ndarray, ends: np.ndarray, window: int, anchor: int):
    """Blocks of texts whose word hashes are joined in ``h``: anchor hash, content hash, text,
    start in the text, number of windows."""
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    begins = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - begins)[:n]
    g = grams(h, anchor)
    best, arg = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - anchor + 1):
        x = g[j : j + n]
        less = x < best
        best[less] = x[less]
        arg[less] = j
    start = np.arange(n)
    good = np.flatnonzero(start + window <= ends[text])
    if not len(good):
        return none, none, none, none, none
    where = (start + arg)[good]
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text[good][1:] != text[good][:-1])]))
    count = np.diff(np.append(new, len(good)))
    first = good[new]
    content = Spans(h).of(first, first + count + window - 1)
    return best[first].view(np.int64), content.view(np.int64), text[first], first - begins[text[first]], count


def _rows(docs: DataFrame, window: int, anchor: int, whole: bool) -> DataFrame:
    """Blocks of all documents: ``h`` and, if ``whole``, ``b, doc_id, p``; ``p`` packs the text's
    hash (32 bits), the start (27) and the number of windows less one (4), for windows less
    anchors of up to 15 words."""

    def make():
        def rows(columns):
            raw = base.raw_texts(columns[1])
            ids, th = columns[0], np.asarray(columns[2]).astype(np.int64)
            for i, j in slices([len(x) for x in raw]):
                split = [x.split() for x in raw[i:j]]
                ends = np.cumsum([len(x) for x in split])
                h, b, text, start, n = blocks(word_hashes([w for x in split for w in x]), ends, window, anchor)
                if len(h):
                    if whole:
                        yield [h, b, ids.slice(i, j - i).take(pa.array(text)), (th[i:j][text] << 32) | (start << 4) | (n - 1)]
                    else:
                        yield [h]

        return rows

    return base.mapped(docs, make, "h long, b long, doc_id long, p long" if whole else "h long")


def _place(p: str):
    """The packed value without the number of windows: text hash and start of a window."""
    return F.shiftright(p, 4)


def first_places(docs: DataFrame, window: int, anchor: int = ANCHOR, many: int = MANY) -> tuple[DataFrame, list[DataFrame]]:
    """``doc_id, th, spans array<struct<start, n>>``: the windows to remove (``n`` in a row from
    word ``start``) of each text that has some; and tables to drop after use."""
    if not 0 < anchor <= window <= anchor + 15:
        raise ValueError("the anchor must be at most 15 words shorter than the window")
    spark = docs.sparkSession
    named = docs.where("doc_id is not null").select("doc_id", "text", F.hash("text").alias("th"))
    repeated = _rows(named, window, anchor, False).groupBy("h").count().where("count > 1").select("h")
    repeated = scratch.written(repeated, "anchors")
    scratch.released(spark)
    seen = scratch.written(_rows(named, window, anchor, True).join(repeated, "h", "left_semi"), "blocks")
    scratch.dropped(repeated)
    scratch.released(spark)

    merged = seen.groupBy("h", "b").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.count("*").alias("times"))
    merged = scratch.written(merged.select("h", "b", "first.doc_id", "first.p", "times"), "merged")
    # written, so that the join reads two plain exchanges and a hot anchor can be split
    kinds = scratch.written(merged.groupBy("h").agg(F.count("*").alias("kinds")), "kinds")
    with_kinds = merged.join(kinds, "h")
    n_windows = (F.col("p").bitwiseAND(15) + 1).cast("int")
    # an anchor with one kind of block: its windows first start where that block first starts
    alone = with_kinds.where("kinds = 1 and times > 1").select("h", "b", F.lit(0).alias("j"), n_windows.alias("n"), F.col("doc_id").alias("at_doc"), _place("p").alias("at"))

    asked = with_kinds.where("kinds > 1").groupBy("doc_id", F.shiftright("p", 32).cast("int").alias("th"))
    asked = asked.agg(F.collect_list(F.struct("h", "b", "p", "times", "kinds")).alias("asked"))
    texts = named.join(asked, ["doc_id", "th"])
    cut = scratch.written(_cut(texts, window, many), "cut")
    by_shard = cut.where("alone is null").repartition(base.partitions(docs), "h").sortWithinPartitions("h", "doc_id", "p")
    in_shards = _shards(by_shard, window)
    windows = cut.where("alone is not null")
    earliest = windows.groupBy("alone").agg(F.min(F.struct("doc_id", F.expr("shiftright(p, 4) + j").alias("at"))).alias("first"), F.count("*").alias("k"))
    earliest = scratch.written(earliest, "earliest")  # as above, for a hot window
    one_each = windows.join(earliest, "alone").where("times > 1 or k > 1")
    one_each = one_each.select("h", "b", "j", F.lit(1).alias("n"), F.col("first.doc_id").alias("at_doc"), F.col("first.at").alias("at"))
    known = scratch.written(alone.unionByName(in_shards).unionByName(one_each), "known")
    scratch.dropped(merged, kinds, cut, earliest)
    scratch.released(spark)

    here = F.expr("shiftright(p, 4) + j")
    gone = seen.join(known, ["h", "b"]).where((F.col("at_doc") != F.col("doc_id")) | (F.col("at") != here))
    th = F.shiftright("p", 32).cast("int").alias("th")
    gone = gone.select("doc_id", th, (here.bitwiseAND((1 << 28) - 1)).cast("int").alias("start"), "n").groupBy("doc_id", "th")
    spans = scratch.written(gone.agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans")), "spans")
    scratch.dropped(known, seen)
    scratch.released(spark)
    return spans, [spans]


def _cut(texts: DataFrame, window: int, many: int) -> DataFrame:
    """The words of the blocks asked for; of anchors with too many kinds, those of each window alone."""
    kind = "h long, b long, times long, doc_id long, p long, j int, words string, alone string"

    def make():
        def rows(columns):
            ids, raw, lists = columns[0].to_pylist(), base.raw_texts(columns[1]), columns[2]
            out, held = [[] for _ in range(8)], 0
            for i, (doc, text) in enumerate(zip(ids, raw, strict=True)):
                words = text.split()
                for a in lists[i].as_py():
                    p, start, n = a["p"], a["p"] >> 4 & (1 << 28) - 1, (a["p"] & 15) + 1
                    if a["kinds"] <= many:
                        made = [(0, b" ".join(words[start : start + n + window - 1]).decode(), None)]
                    else:
                        made = [(j, None, b" ".join(words[start + j : start + j + window]).decode()) for j in range(n)]
                    for x in made:
                        held += len(x[1] or x[2])
                        for c, v in zip(out, (a["h"], a["b"], a["times"], doc, p, *x), strict=True):
                            c.append(v)
                    if held > base.BATCH_BYTES:
                        yield out
                        out, held = [[] for _ in range(8)], 0
            yield out

        return rows

    return base.mapped(texts.select("doc_id", "text", "asked"), make, kind)


def _shards(rows: DataFrame, window: int) -> DataFrame:
    """First places of the windows of blocks, shard by shard; rows come sorted by shard."""
    schema, arrow = base.arrow_schema("h long, b long, j int, n int, at_doc long, at long")

    def found(shard):
        automaton, bases, out, at = SuffixAutomaton(), [], [], 0
        for _, _, _, _, words in shard:
            automaton.add(words, at)
            bases.append(at)
            at += len(words)
        for (b, times, doc, p, words), own in zip(shard, bases, strict=True):
            first = automaton.matching(words, window)[window - 1 :]
            j = 0
            while j < len(first):
                n = 1
                k = bisect_right(bases, first[j] - window + 1) - 1
                end = bases[k + 1] if k + 1 < len(bases) else at
                while j + n < len(first) and first[j + n] == first[j] + n < end:
                    n += 1
                start = first[j] - window + 1
                if times > 1 or start != own + j:
                    out.append((b, j, n, shard[k][2], (shard[k][3] >> 4) + start - bases[k]))
                j += n
        return out

    def run(batches):
        h, shard, out = None, [], [[] for _ in range(6)]

        def closed():
            for x in found(shard):
                for c, v in zip(out, (h, *x), strict=True):
                    c.append(v)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

        for b in batches:
            for key, *rest, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != h:
                    if shard:
                        closed()
                    h, shard = key, []
                shard.append((*rest, words.split(" ")))
            if len(out[0]) > 20_000:
                yield batch()
                for c in out:
                    c.clear()
        if shard:
            closed()
        yield batch()

    return base.arrow_mapped(rows.select("h", "b", "times", "doc_id", "p", "words"), run, schema)


def covered(n_words: int, spans: list[dict], window: int) -> np.ndarray:
    """Which words the windows cover; ``spans`` as in :func:`first_places`."""
    depth = np.zeros(n_words + 1, np.int64)
    for s in spans:
        depth[s["start"]] += 1
        depth[min(n_words, s["start"] + s["n"] - 1 + window)] -= 1
    return np.cumsum(depth[:-1]) > 0


def digests(docs: DataFrame, window: int = 20, anchor: int = ANCHOR, many: int = MANY) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row of ``docs``.

    Null and empty texts have no words.  Rows that repeat an id and its text are one document
    (equal results); rows with one id and different texts are ordered by a hash of the text.  Rows
    without an id have no place in the order: nothing is removed from them or for them.
    """
    spans, _ = first_places(docs.select("doc_id", "text"), window, anchor, many)

    def make():
        def rows(columns):
            raw, lists = base.raw_texts(columns[1]), columns[2].to_pylist()
            n_words, n_removed, sha = [], [], []
            for text, s in zip(raw, lists, strict=True):
                words = text.split()
                n_words.append(len(words))
                n_removed.append(0)
                if s:
                    gone = covered(len(words), s, window)
                    n_removed[-1] = int(gone.sum())
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield [columns[0], n_words, n_removed, sha]

        return rows

    joined = docs.select("doc_id", "text", F.hash("text").alias("th")).join(spans, ["doc_id", "th"], "left")
    return base.mapped(joined.select("doc_id", "text", "spans"), make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = 20, anchor: int = ANCHOR, many: int = MANY, length: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated windows cut out of ``text``; rows and other columns stay.

    White space goes with the word before it; texts without repeats stay byte for byte.
    ``length``, if it is a column, gets the new number of code points of a changed text.  Null
    stays null, a text that repeats an earlier one whole becomes empty; rows without an id stay as
    they are, rows that repeat an id and its text change alike.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spans, _ = first_places(docs.select("doc_id", "text"), window, anchor, many)
    th, name = "_lattiq_th", "_lattiq_spans"
    found = spans.select(F.col("doc_id").alias("_lattiq_id"), F.col("th").alias(th + "2"), F.col("spans").alias(name))
    rows = docs.withColumn(th, F.hash("text"))
    joined = rows.join(found, (rows["doc_id"] == F.col("_lattiq_id")) & (rows[th] == F.col(th + "2")), "left").select(*docs.columns, name)
    arrow = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            lists = columns.pop(name).to_pylist()
            texts = columns["text"].to_pylist()
            sizes = columns[length].to_pylist() if length in columns else None
            for i, s in enumerate(lists):
                if s:
                    texts[i] = _without(texts[i], s, window)
                    if sizes:
                        sizes[i] = len(texts[i])
            columns["text"] = pa.array(texts, arrow.field("text").type)
            if sizes:
                columns[length] = pa.array(sizes, arrow.field(length).type)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)

    return base.arrow_mapped(joined, run, docs.schema)


def _without(text: str, spans: list[dict], window: int) -> str:
    raw = text.encode()
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    gone = covered(len(at), spans, window)
    out, pos = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(raw[pos : at[i][0]])
        pos = at[j][0] if j < len(at) else len(raw)
    return b"".join([*out, raw[pos:]]).decode()
