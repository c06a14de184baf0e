"""Chroma fingerprints of recordings, and their alignment (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window, functions as F

from lattiq import scratch

from . import base

FRAME, HOP = 1024, 256
#: A rule for sixteen filters over (time, pitch class): first class, height, width in frames, and
#: whether halves are compared by pitch, by time, in a chequer, or the middle with its sides.  None
#: is as high as the octave, over which a frame's energy is the same everywhere, and none so narrow
#: that noise outweighs it.
FILTERS = [(i * 5 % 12, 3 + (i + i // 4) % 3 * 3, 5 + i % 4 * 3, i % 4) for i in range(16)]
WIDTH = max(f[2] for f in FILTERS)
#: Three levels a filter, where none were fitted.
LEVELS = np.tile([-0.4, 0.0, 0.4], (len(FILTERS), 1))
#: Values of filters are whole numbers of steps, so many to 1; none is as large as 4.
STEPS, HALF = 1024, 4096
#: Bits of a term; codes of queries in a block, about; codes of a recording that are counted at a
#: time; stretches of so few codes may share no term, and are looked for at every offset.
BAND, BLOCK, PIECE, SHORT = 16, 1 << 18, 512, 8


def chroma(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes of energy, each frame of unit length (or zero)."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12))
    frames = sliding_window_view(pcm, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.arange(power.shape[1]) * rate / FRAME
    used = np.flatnonzero((hz >= 55) & (hz <= rate * 0.45))
    classes = np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12
    out = (power[:, used] @ np.eye(12, dtype=power.dtype)[classes]).astype(np.float64)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def filtered(frames: np.ndarray) -> np.ndarray:
    """A row per filter: the logarithms of its two sums, subtracted, at each start of ``WIDTH`` frames."""
    n = max(0, len(frames) - WIDTH + 1)
    wide = np.vstack([frames.T, frames.T])  # pitch classes go round
    image = np.zeros((25, len(frames) + 1))
    image[1:, 1:] = wide.cumsum(0).cumsum(1)

    def area(t0, t1, c0, c1):
        return image[c1, t1 : t1 + n] - image[c1, t0 : t0 + n] - image[c0, t1 : t1 + n] + image[c0, t0 : t0 + n]

    out = np.zeros((len(FILTERS), n))
    for i, (c, h, w, kind) in enumerate(FILTERS):
        m, k = h // 2, max(1, w // 2)
        whole = area(0, w, c, c + h)
        part = [lambda: area(0, w, c, c + m), lambda: area(0, k, c, c + h), lambda: area(0, k, c, c + m) + area(k, w, c + m, c + h), lambda: area(w // 3, w - w // 3, c, c + h)][kind]()
        out[i] = np.log1p(np.maximum(part, 0)) - np.log1p(np.maximum(whole - part, 0))
    return out


def stepped(frames: np.ndarray) -> np.ndarray:
    """:func:`filtered` in whole steps of 16 bits."""
    return np.rint(filtered(frames) * STEPS).astype("<i2")


def pack(steps: np.ndarray, levels: np.ndarray = LEVELS) -> np.ndarray:
    """A 32-bit integer per start of ``WIDTH`` frames: sixteen filters, two Gray-coded bits each."""
    out = np.zeros(steps.shape[1], np.uint32)
    for i, (v, limits) in enumerate(zip(steps, np.asarray(levels) * STEPS, strict=True)):
        level = ((v > limits[0]).astype(np.uint32) + (v > limits[1])) + (v > limits[2])
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * i)
    return out


def _samples(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw[: len(raw) // 2 * 2] if raw else b"", "<i2").astype(np.float32)


def filter_values(media: DataFrame, key: str = "media_id", pcm: str = "pcm", rate: str = "rate") -> DataFrame:
    """``key, steps binary`` of 16-bit little-endian samples: what the filters give at each place, a
    sixteenth of the sound's bytes.  Null, empty and too short recordings have no places; one row
    out per row in; no shuffle.  Other columns are not read."""

    def make():
        def rows(columns):
            sound = zip(columns[1].to_pylist(), columns[2].to_pylist(), strict=True)
            yield [columns[0], [stepped(chroma(_samples(raw), hz or 8000)).tobytes() for raw, hz in sound]]

        return rows

    return base.mapped(media.select(key, pcm, rate), make, f"{key} long, steps binary")


def _loaded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2").reshape(len(FILTERS), -1)


def levels_of(values: DataFrame) -> np.ndarray:
    """Levels that part each filter's values (:func:`filter_values`) evenly, so that codes spread
    over all their bits: the quartiles over every place of every recording.

    Tasks count values by steps; there are sixteen times 8192 counts at most, whatever the input.
    A quartile is the least step that a quarter, half or three quarters of the values do not pass.
    Without a place, ``LEVELS``.
    """
    schema, arrow = base.arrow_schema("filter int, step int, n long")

    def run(batches):
        counts = np.zeros((len(FILTERS), 2 * HALF), np.int64)
        for b in batches:
            if b.num_rows:
                for own, v in zip(counts, np.hstack([_loaded(raw) for raw in b.column(0).to_pylist()]), strict=True):
                    own += np.bincount(v + HALF, minlength=2 * HALF)
        i, step = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((i, step - HALF, counts[i, step]), arrow, strict=True)], schema=arrow)

    counted = base.arrow_mapped(values.select("steps"), run, schema).groupBy("filter", "step").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("filter")
    counted = counted.withColumns({"met": F.sum("n").over(whole.orderBy("step")), "all": F.sum("n").over(whole)})
    quartiles = [F.min(F.when(F.col("met") * 4 >= F.col("all") * q, F.col("step"))).alias(f"q{q}") for q in (1, 2, 3)]
    got = counted.groupBy("filter").agg(*quartiles).orderBy("filter").collect()
    return np.array([r[1:] for r in got]) / STEPS if got else LEVELS


def fitted_levels(media: DataFrame, key: str = "media_id", pcm: str = "pcm", rate: str = "rate") -> np.ndarray:
    """:func:`levels_of` recordings."""
    return levels_of(filter_values(media, key, pcm, rate))


def packed(values: DataFrame, levels: np.ndarray = LEVELS, key: str = "media_id") -> DataFrame:
    """``key, codes array<long>`` of :func:`filter_values`; one row out per row in; no shuffle.
    Only prints made with the same ``levels`` can be compared."""

    def make():
        return lambda columns: iter([[columns[0], [pack(_loaded(raw), levels).astype(np.int64) for raw in columns[1].to_pylist()]]])

    return base.mapped(values.select(key, "steps"), make, f"{key} long, codes array<long>")


def fingerprints(media: DataFrame, levels: np.ndarray = LEVELS, key: str = "media_id", pcm: str = "pcm", rate: str = "rate") -> DataFrame:
    """:func:`packed` codes of recordings."""
    return packed(filter_values(media, key, pcm, rate), levels, key)


class Index:
    """Codes of some queries by banded parts: every ``BAND`` bits of a code at a place are a term."""

    def __init__(self, queries: list[np.ndarray], window: int, votes: int, most_errors: float):
        self.window, self.votes, self.most_errors = window, votes, most_errors
        self.size = np.array([len(c) for c in queries])
        self.start = np.r_[0, self.size.cumsum()]
        self.codes = np.concatenate(queries)
        self.padded = np.pad(self.codes, (0, PIECE + window))
        self.query = np.repeat(np.arange(len(queries)), self.size)
        place = np.arange(len(self.codes)) - self.start[self.query]
        # a cell per query and offset of a piece of n codes: this, and n times the query, less the place
        self.back = self.start[self.query] + self.size[self.query] - 1 - place
        self.lists = []
        for shift in range(0, 32, BAND):
            term = self.codes >> np.uint32(shift) & np.uint32((1 << BAND) - 1)
            at = np.r_[0, np.bincount(term, minlength=1 << BAND).cumsum()]
            self.lists.append((shift, at, np.argsort(term, kind="stable")))

    def counted(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of a query and an offset that share ``votes`` terms, and how many they share; the
        cells of query i start at ``start[i] + i * n``, its offsets at ``1 - size[i]``."""
        n = len(piece)
        met = []
        for shift, at, order in self.lists:
            term = piece >> np.uint32(shift) & np.uint32((1 << BAND) - 1)
            met.append((at[term], at[term + np.uint32(1)] - at[term], order))
        size = self.start[-1] + n * len(self.size)

        def places(first, many, order, part):
            m = many[part]
            i = np.arange(m.sum()) + np.repeat(first[part] - (m.cumsum() - m), m)
            own = order[i]
            return self.back[own] + n * self.query[own] + np.repeat(part, m)

        if sum(int(many.sum()) for _, many, _ in met) < size // 8:  # few: sort them
            every = np.sort(np.concatenate([places(*x, np.arange(n)) for x in met]))
            new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(every)])
            good = count >= self.votes
            return every[new[good]], count[good]
        out = np.zeros(size, np.int64)
        for first, many, order in met:
            cuts = np.flatnonzero(np.diff(many.cumsum() // 4_000_000)) + 1  # memory, for terms in many places
            for part in np.split(np.arange(n), cuts):
                out += np.bincount(places(first, many, order, part), minlength=size)
        cell = np.flatnonzero(out >= self.votes)
        return cell, out[cell]

    def found(self, codes: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Per query with a stretch in ``codes``: the least share of wrong bits, minus the votes, and the offset."""
        best = {}
        for first in range(0, max(1, len(codes) - self.window + 1), PIECE):  # a stretch lies in one piece
            piece = codes[first : first + PIECE + self.window - 1]
            n = len(piece)
            cell, votes = self.counted(piece)
            least = np.minimum(self.window, np.minimum(self.size, len(codes)))
            begin = self.start[:-1] + n * np.arange(len(self.size))
            if (short := np.flatnonzero(least <= SHORT)).size:
                every = np.concatenate([np.arange(begin[i], begin[i] + self.size[i] + n) for i in short])
                more = np.setdiff1d(every, cell, assume_unique=True)
                cell, votes = np.r_[cell, more], np.r_[votes, np.zeros(len(more), np.int64)]
            q = np.searchsorted(begin, cell, "right") - 1
            offset = cell - begin[q] + 1 - self.size[q]
            least = least[q]
            s = np.maximum(0, -offset)
            shared = np.minimum(self.size[q] - s, n - s - offset)
            for w in np.unique(least):
                every = np.flatnonzero((least == w) & (shared >= w))
                for i in np.array_split(every, len(every) * n // 2_000_000 + 1):
                    if not len(i):
                        continue
                    most = shared[i].max()
                    x = sliding_window_view(self.padded, most)[self.start[q[i]] + s[i]]
                    y = sliding_window_view(np.pad(piece, (0, most)), most)[s[i] + offset[i]]
                    wrong = np.zeros((len(i), most + 1), np.int32 if n > 1000 else np.int16)
                    np.cumsum(np.bitwise_count(x ^ y), axis=1, out=wrong[:, 1:])
                    run = wrong[:, w:] - wrong[:, :-w]
                    run[np.arange(run.shape[1]) > (shared[i] - w)[:, None]] = 32 * w + 1
                    errors = run.min(1) / (32.0 * w)
                    for k in np.flatnonzero(errors <= self.most_errors):
                        hit = (float(errors[k]), -int(votes[i[k]]), int(offset[i[k]]) + first)
                        best[int(q[i[k]])] = min(best.get(int(q[i[k]]), hit), hit)
        return best


def stretches(rows: DataFrame, window: int, votes: int, most_errors: float) -> DataFrame:
    """``q, hit_id, offset, errors`` of ``block, shard, turn, class_id, codes`` dealt by block and
    shard and sorted: the queries of a block (turn 0), then the recordings of a shard (turn 1)."""
    schema, arrow = base.arrow_schema("q long, hit_id long, offset int, errors double")

    def run(batches):
        now, ids, queries, index = None, [], [], None
        for b in batches:
            out = []
            block, shard, turn, names = (b.column(i).to_pylist() for i in range(4))
            lists = b.column(4)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.uint32)
            for i, name in enumerate(names):
                if now != (block[i], shard[i]):
                    now, ids, queries, index = (block[i], shard[i]), [], [], None
                codes = flat[at[i] : at[i + 1]]
                if turn[i] == 0:
                    ids.append(name)
                    queries.append(codes)
                elif queries:
                    index = index or Index(queries, window, votes, most_errors)
                    out += [(ids[q], name, offset, errors) for q, (errors, _, offset) in index.found(codes).items() if ids[q] != name]
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return base.arrow_mapped(rows, run, schema)


def align(prints: DataFrame, queries, key: str = "media_id", votes: int = 2, most_errors: float = 0.2, window: int = 48) -> DataFrame:
    """Recordings that share a stretch with a query.

    A stretch is ``window`` codes in a row (all codes of a recording that has fewer) with at most
    ``most_errors`` of their bits wrong.  Equal code lists form a class, named by its least id;
    classes are aligned, copies are not expanded.  Parts of ``BAND`` bits of single codes are
    terms; every offset with ``votes`` shared terms (any, for stretches of up to ``SHORT`` codes) is
    checked, over all its runs of ``window`` codes, and the one with the fewest wrong bits is the hit's (ties: more votes, then the least).
    At 20% wrong bits no number of equal parts is certain, so recall is tested, not proved.
    Queries are indexed in blocks of bounded size, and each block meets each shard of the
    recordings in a task: the work grows with queries times recordings.
    ``queries``: a condition on the id.  Returns ``key, class_id, hit_id, offset, errors``: each
    row with its class; the hits (null if none) stand at the class's least member.
    """
    named = scratch.written(prints.select(F.col(key).alias("id"), "codes", F.sha2(F.array_join("codes", ","), 256).alias("h")), "prints")
    real = named.where("id is not null and size(codes) > 0")
    classes = scratch.written(real.groupBy("h").agg(F.min("id").alias("class_id"), F.max(queries(F.col("id"))).alias("asked"), F.first("codes").alias("codes")), "classes")
    shards = base.partitions(prints)
    blocks = (classes.where("asked").agg(F.sum(F.size("codes"))).first()[0] or 0) // BLOCK + 1
    part = lambda n, seed: F.pmod(F.xxhash64("class_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = classes.where("asked").select(part(blocks, 0).alias("block"), every(shards).alias("shard"), F.lit(0).alias("turn"), "class_id", "codes")
    others = classes.select(every(blocks).alias("block"), part(shards, 1).alias("shard"), F.lit(1).alias("turn"), "class_id", "codes")
    dealt = asked.unionByName(others).repartitionByRange(shards, "block", "shard").sortWithinPartitions("block", "shard", "turn", "class_id")
    hits = stretches(dealt.select("block", "shard", "turn", "class_id", "codes"), window, votes, most_errors)
    own = named.join(classes.select("h", "class_id"), "h", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    out = own.join(hits, (F.col("id") == F.col("class_id")) & (F.col("class_id") == F.col("q")), "left")
    return out.select(F.col("id").alias(key), "class_id", "hit_id", "offset", "errors")


RATE, NOTE = 4000, 480


def melody(vector: list[float] | None) -> bytes:
    """A tune of one note per component, within two octaves around A4, as 16-bit samples."""
    if not vector:
        return b""
    steps = np.clip(np.round(np.nan_to_num(np.array([x or 0.0 for x in vector])) * 40), -12, 12)
    hz = np.repeat(440 * 2 ** (steps / 12), NOTE)
    return (12000 * np.sin(2 * np.pi * np.cumsum(hz) / RATE)).astype("<i2").tobytes()


def tunes(vectors: DataFrame) -> DataFrame:
    """``media_id, pcm binary, rate int`` of ``vec_id, embedding``: the tables hold no sound, so
    each vector is played.  Null and empty vectors give empty recordings, null components a
    middle note; one row out per row in; no shuffle."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                pcm = [melody(v) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pcm, pa.binary()), pa.array([RATE] * len(pcm), pa.int32())], ["media_id", "pcm", "rate"])

    return base.arrow_mapped(vectors.select(F.col("vec_id").alias("media_id"), "embedding"), run, "media_id long, pcm binary, rate int")
