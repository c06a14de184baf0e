"""Toxicity of whole texts: boosted trees over dense features, calibrated (operator 7).

The lexicon has three parts: fixed insults, whole words learned from the labels, and learned
beginnings of words, each with the logarithm of how much likelier toxic documents are to have it.
Beginnings reach what a list of words misses: inflected and compounded forms, and languages that
the fixed list does not know.  Nothing is keyed by language; only the text is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lattiq import scratch

from . import base
from .gbt import Isotonic, Trees

#: Fixed word lists: common insults, and words that address a person.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown clowns dumb fool jerk "
    "imbecile garbage filth vermin ugly bastard bitch asshole retard cretin crétin abruti connard connasse salaud ordure "
    "débile imbécile minable dummkopf trottel arschloch abschaum mistkerl blödmann dreckskerl schwachkopf estúpido "
    "estúpida idiota imbécil basura escoria cabrón pendejo gilipollas asqueroso".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur youre you're tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
    "tú ti usted ustedes vosotros vuestro".split()
)
EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”‘’…¡¿"
#: Letters that digits and signs stand for.
LEET = str.maketrans("0134578@$!|+€", "oieastbasiite")
RUNS = re.compile(r"(.)\1+")
SPACED = re.compile(r"(?<!\S)(?:\w[ .*_-]){3,}\w(?!\S)")
UPPER, SIGNS, LOUD = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\w\s]"), re.compile(r"[!?]")
SHOUT, DRAWN, MIXED = re.compile(r"(?<!\S)[A-ZÀ-ÖØ-Þ]{3,}(?!\S)"), re.compile(r"([a-z])\1\1"), re.compile(r"[a-z][0-9@$!*|][a-z]")
FEATURES = (
    "log_words", "hit_density", "hits", "kinds", "learned_density", "learned", "hidden_density", "hidden",
    "near_second", "near_share", "second_density", "capitals", "shouts", "signs", "loud", "drawn", "mixed", "digits",
    "begun_density", "begun_hits", "begun_kinds", "begun_weight",
)
#: Lengths of learned beginnings.
BEGINNINGS = range(4, 8)


@dataclass(frozen=True)
class Lexicon:
    """Words learned whole, and beginnings with their weights."""

    words: frozenset[str] = frozenset()
    begun: tuple[tuple[str, float], ...] = ()

    @cached_property
    def stems(self) -> frozenset[str]:
        return _stems(INSULTS | self.words)

    @cached_property
    def weights(self) -> dict[str, float]:
        return dict(self.begun)

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(w[: BEGINNINGS[0]] for w, _ in self.begun)

    def weighed(self, words: set[str]) -> dict[str, float]:
        """Those of ``words`` with a known beginning, and the largest weight of one."""
        known, heads = self.weights, self.heads
        found = [w for w in words if w[: BEGINNINGS[0]] in heads]
        return {w: x for w in found if (x := max(known.get(w[:k], 0.0) for k in BEGINNINGS))}


def _stems(words: frozenset[str]) -> frozenset[str]:
    return frozenset(RUNS.sub(r"\1", w) for w in words)


def features(text: str, lexicon: Lexicon, near: int = 5) -> list[float]:
    """The values of ``FEATURES``; for an empty text all zero."""
    if not text or text.isspace():
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = [w.strip(EDGE) for w in low.split()]
    n, chars, kinds = len(words), len(text), set(words)
    listed = {w for w in kinds if w in INSULTS or w in lexicon.words}
    hits = [i for i, w in enumerate(words) if w in listed] if listed else []
    plain = sum(words[i] in INSULTS for i in hits)
    begun = lexicon.weighed(kinds)
    weights = [begun[w] for w in words if w in begun] if begun else []
    odd = [w for w in kinds if w and w not in INSULTS and (not w.isalpha() or DRAWN.search(w))]
    masked = {w for w in odd if RUNS.sub(r"\1", "".join(c for c in w.translate(LEET) if c.isalpha())) in lexicon.stems}
    hidden = [i for i, w in enumerate(words) if w in masked] if masked else []
    for m in SPACED.finditer(low):
        if RUNS.sub(r"\1", re.sub(r"\W|_", "", m[0])) in lexicon.stems:
            hidden.append(low.count(" ", 0, m.start()))
    found = hits + hidden
    close = sum(bool(set(words[max(0, i - near) : i + near + 1]) & SECOND_PERSON) for i in found)
    return [
        np.log1p(n), len(hits) / n, float(len(hits)), float(len({words[i] for i in hits})), (len(hits) - plain) / n, float(len(hits) - plain),
        len(hidden) / n, float(len(hidden)), float(close), close / max(1, len(found)), sum(map(SECOND_PERSON.__contains__, words)) / n,
        len(UPPER.findall(text)) / chars, len(SHOUT.findall(text)) / n, len(SIGNS.findall(text)) / chars, len(LOUD.findall(text)) / chars,
        len(DRAWN.findall(low)) / n, len(MIXED.findall(low)) / n, sum(map(low.count, "0123456789")) / chars,
        sum(weights) / n, float(len(weights)), len(begun) / n, max(weights, default=0.0),
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    curve: Isotonic | None
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return self.curve(self.trees.margin(x))


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, share: float = 0.02, lift: float = 6.0, kept: int = 2000) -> Model:
    """Learn from at most ``most`` labelled rows outside the held-out fold: those whose hashed
    ids come first, so the sample is the same for any layout of the tables.

    ``most`` bounds what is broadcast and collected.  A word, or a beginning of words, joins the
    lexicon if at least ``share`` of the toxic rows have it (three of them at least) and it is
    ``lift`` times likelier in them than in the others (shares smoothed by half a row); the
    ``kept`` most telling of each sort stay.  The trees see features made with a lexicon of the
    other half of the sample, so they learn how far a lexicon can be trusted on new rows.

    Labels that are null, or whose document is not there, teach nothing; of repeated labels of an
    id the largest counts, rows that repeat an id are each a row of the sample.  Three quarters
    of the sample fit the trees, one quarter the calibration.  A sample with one class, or of
    under 20 rows, gives its share of toxic rows (0 if empty) as every score.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = F.xxhash64("doc_id").alias("h")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).select("doc_id", "toxic", order)
    chosen = F.broadcast(chosen.orderBy("h", "doc_id").limit(most))
    half = F.xxhash64("doc_id", F.lit("half")).bitwiseAND(F.lit(1)).cast("int").alias("half")
    sample = scratch.written(docs.select("doc_id", base.text_or_empty().alias("text")).join(chosen, "doc_id").select("doc_id", "toxic", half, "text"), "toxic-sample")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, n = sum(x for (_, t), x in sizes.items() if t), sum(sizes.values())
    if n < 20 or not 0 < toxic < n:
        scratch.dropped(sample)
        return Model(Lexicon(), None, None, toxic / n if n else 0.0)
    lexicons = _lexicons(sample, sizes, share, lift, kept)

    def make():
        def rows(columns):
            halves, texts = columns[2].to_pylist(), columns[3].to_pylist()
            yield [columns[0], columns[1], [features(t, lexicons[1 - i]) for i, t in zip(halves, texts, strict=True)]]

        return rows

    got = base.mapped(sample, make, "doc_id long, toxic int, x array<double>").toPandas()
    scratch.dropped(sample)
    got["order"] = got["x"].map(tuple)
    got = got.sort_values(["doc_id", "order"], kind="stable")
    x, y = np.array(got["x"].tolist()), got["toxic"].to_numpy(float)
    part = np.random.default_rng(7).random(len(y)) < 0.75
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = np.ones(len(y), bool)
    trees = Trees().fit(x[part], y[part])
    rest = ~part if (~part).any() else part
    return Model(lexicons[2], trees, Isotonic().fit(trees.margin(x[rest]), y[rest]), toxic / n)


def _lexicons(sample: DataFrame, sizes: dict[tuple[int, int], int], share: float, lift: float, kept: int) -> list[Lexicon]:
    """Of half 0, of half 1 and of the whole sample, from one count of words and beginnings."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(EDGE))))
    starts = F.array_distinct(F.flatten(F.transform(F.col("words"), lambda w: F.filter(F.array(*[F.when(F.length(w) >= k, F.substring(w, 1, k)) for k in BEGINNINGS]), lambda b: b.isNotNull()))))
    whole = F.filter("words", lambda w: F.length(w) > 2)
    named = lambda kind, c: F.transform(c, lambda w: F.struct(F.lit(kind).alias("begun"), w.alias("w")))
    each = sample.select("half", "toxic", words.alias("words")).select("half", "toxic", F.explode(F.concat(named(False, whole), named(True, starts))).alias("x"))
    sums = [F.sum(((F.col("half") == i) & (F.col("toxic") == t)).cast("int")).alias(f"n{i}{t}") for i in (0, 1) for t in (0, 1)]
    counts = each.groupBy("x.begun", "x.w").agg(*sums).where("n01 + n11 >= 3").persist()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        all_t, all_c = (sum(sizes.get((i, t), 0) for i in halves) for t in (1, 0))
        t, c = (sum((F.col(f"n{i}{k}") for i in halves), F.lit(0)) for k in (1, 0))
        ratio = ((t + 0.5) / (all_t + 1)) / ((c + 0.5) / (all_c + 1))
        telling = counts.select("begun", "w", t.alias("t"), F.log(ratio).alias("weight")).where((F.col("t") >= max(3.0, share * all_t)) & (F.col("weight") >= float(np.log(lift))))
        found = [telling.where(F.col("begun") == b).orderBy(F.desc(F.col("weight") * F.sqrt("t")), "w").limit(kept).collect() for b in (False, True)]
        out.append(Lexicon(frozenset(r["w"] for r in found[0]), tuple((r["w"], r["weight"]) for r in found[1])))
    counts.unpersist()
    return out


def score(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``; no shuffle.

    Only the text is read for a score (null counts as empty); repeated rows get equal scores, a
    null id is not held out.
    """

    def make():
        def rows(columns):
            x = np.array([features(t, model.lexicon) for t in columns[2].to_pylist()])
            s = model.score(x)
            yield [columns[0], columns[1], s, (s >= cut).astype(np.int32)]

        return rows

    ddl = "doc_id long, held_out boolean, score double, predicted int"
    return base.mapped(docs.select("doc_id", held_out().alias("held_out"), base.text_or_empty().alias("text")), make, ddl)


def kept(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under ``cut``; no shuffle.  Null texts
    count as empty; rows with equal texts stay or go together, whatever their id."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                s = model.score(np.array([features(t or "", model.lexicon) for t in texts]))
                yield batch.filter(pa.array(s < cut))

    return base.arrow_mapped(docs, run, docs.schema)
