"""Order MinHash fingerprints with DataFrame functions only (operator 5).

The text is a sequence of words, of which those over ``LONGEST`` code points are cut into pieces of
that length (so scripts without white space have k-mers as well); its k-mers are runs of ``WORDS``
of them.  The ``i``-th occurrence of a k-mer is numbered ``i``, so repeats count.  For each of ``size`` hash functions two
occurrence-numbered k-mers are minimal, one in each half of the hash space; they are kept in the
order of the text and their pair is hashed.  Signatures agree where both minima agree and stand
in the same order, so their share falls with edit distance, not only with changed content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattiq import scratch

from . import base

SIZE, WORDS, LONGEST = 32, 3, 12
#: Low bits of a packed value: the place of a k-mer.  A string is under 2 GB, so has fewer places.
BITS = 30
PLACE = (1 << BITS) - 1
STEPS = [1 << s for s in range(BITS - 1, -1, -1)]
#: Buckets of ids for each shuffle partition: enough that partitions come out even.
BUCKETS = 16


def _numbered(text: str) -> Column:
    """Per k-mer of the words of ``text``: a hash of it and its number, and its place, in a long."""
    words = F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]{{1,{LONGEST}}}"), F.lit(0))
    n = F.size("words")
    gram = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WORDS)])
    packed = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))),
        lambda i: gram(i).bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.least(i, F.lit(PLACE)).cast("long")),
    )
    return words, F.when(n > 0, F.sort_array(packed)).otherwise(F.array().cast("array<long>"))


def _occurrence(x: Column, i: Column) -> Column:
    """How many equal k-mers stand before element ``i`` of the sorted array: they are adjacent,
    so their number is found by halving."""
    same = lambda back: F.shiftright(F.get("packed", i - back), BITS) == F.shiftright(x, BITS)
    search = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda n, s: F.when((i >= n + s) & same(n + s), n + s).otherwise(n))
    return F.when((i > 0) & same(F.lit(1)), search).otherwise(F.lit(0))


def signatures(rows: DataFrame, text: str, keys: list[str], size: int = SIZE) -> DataFrame:
    """``keys, signature array<long>`` of ``text``; equal rows of ``keys`` merge."""
    words, packed = _numbered(text)
    numbered = F.transform(
        "packed",
        lambda x, i: F.xxhash64(F.shiftright(x, BITS), _occurrence(x, i)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))),
    )
    flat = rows.select(*keys, words.alias("words")).select(*keys, packed.alias("packed")).select(*keys, F.explode_outer(numbered).alias("x"))
    least = []
    for i in range(size):
        v = F.xxhash64(F.shiftright("x", BITS), F.lit(i)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.col("x").bitwiseAND(F.lit(PLACE)))
        half = F.shiftright(v, BITS).bitwiseAND(F.lit(1))
        least += [F.min(F.when(F.col("x").isNotNull() & (half == b), v)).alias(f"m{i}_{b}") for b in (0, 1)]
    mins = flat.groupBy(*keys).agg(*least)
    place = lambda c: F.col(c).bitwiseAND(F.lit(PLACE))
    kmer = lambda c: F.shiftright(c, BITS)
    pairs = []
    for i in range(size):
        a, b = f"m{i}_0", f"m{i}_1"
        turned = F.coalesce(place(a) > place(b), F.lit(False))
        pairs.append(F.when(turned, F.xxhash64(kmer(b), kmer(a), F.lit(1))).otherwise(F.xxhash64(kmer(a), kmer(b), F.lit(0))))
    return mins.select(*keys, F.array(*pairs).alias("signature"))


def likeness(a: str, b: str) -> Column:
    """Share of equal signatures, 0 to 1."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return equal / F.size(a).cast("double")


def as_text(c: str) -> Column:
    """Signatures as 8 hexadecimal places each."""
    return F.lower(F.array_join(F.transform(c, lambda x: F.substring(F.lpad(F.hex(x), 16, "0"), 1, 8)), ""))


def _bounds(docs: DataFrame, buckets: int) -> list[float]:
    """Where buckets of ids begin, all but the first: about even ranges, at most ``buckets`` numbers."""
    cuts = [i / buckets for i in range(1, buckets)]
    return sorted(set(docs.approxQuantile("doc_id", cuts, 1 / (2 * buckets)))) if cuts else []


def _bucket(bounds: list[float], buckets: int) -> Column:
    """The bucket of an id, found by halving; rows without an id are dealt by their text's hash."""
    steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    at, limits = F.col("doc_id").cast("double"), F.array(*map(F.lit, bounds))
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: F.when(F.get(limits, n + s - 1) <= at, n + s).otherwise(n)) if steps else F.lit(0)
    return F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.col("th"), F.lit(buckets)).cast("int")).otherwise(found)


def compared(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` for each row of ``docs``.  The edited text ends in the start of the next document
    instead of its own last quarter.  Null texts are empty; empty texts share a fingerprint.
    Rows that repeat an id (or none) and its text are one document, and get a row each; rows
    with one id and different texts follow by a hash of the text.  Rows without an id have no
    next document: their last quarter is cut off and ``near_next`` is 0.

    Texts are exchanged once, dealt by buckets of ids.  Within a bucket documents are sorted, so
    the next text, and later the next signature, stand in the following row; what follows a
    bucket's last document is the head of the next bucket, of which there is one a bucket.  The
    minima are aggregated by keys that have the bucket among them, so where the rows lie.
    """
    buckets = BUCKETS * base.partitions(docs)
    rows = docs.select("doc_id", base.text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.withColumn("bucket", _bucket(_bounds(docs.select("doc_id").where("doc_id is not null"), buckets), buckets))
    need = lambda n: F.floor(n / 4).cast("int")

    # one row a bucket: its last document, and the first of the bucket after it
    ends = rows.where("doc_id is not null").select("bucket", "doc_id", "th", F.length("text").alias("n")).groupBy("bucket")
    ends = ends.agg(F.min(F.struct("doc_id", "th")).alias("head"), F.max(F.struct("doc_id", "th", "n"))["n"].alias("n"))
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("head").over(Window.orderBy("bucket")), F.first("head").over(everything))
    ends = ends.select(F.col("bucket").alias("of"), need(F.col("n")).alias("need"), after.alias("head"))
    asked = F.broadcast(ends.select("of", "need", F.col("head.doc_id").alias("doc_id"), F.col("head.th").alias("th")))
    heads = rows.select("doc_id", "th", "text").join(asked, ["doc_id", "th"])
    heads = heads.groupBy(F.col("of").alias("bucket")).agg(F.first(F.expr("substring(text, 1, need)")).alias("head"))

    same = Window.partitionBy("bucket", "doc_id", "th").orderBy("th")
    order = Window.partitionBy("bucket").orderBy("doc_id", "th")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = rows.repartition(base.partitions(docs), "bucket")
    once = dealt.select("*", F.row_number().over(same).alias("i"), F.count("*").over(whole).alias("times")).where("i = 1").drop("i")
    placed = once.withColumn("follows", F.lead("text").over(order)).join(heads, "bucket", "left")
    placed = placed.withColumn("need", need(F.length("text")))
    start = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.coalesce(F.expr("substring(follows, 1, need)"), "head"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - need)"), start)
    both = placed.select("bucket", "doc_id", "th", "times", "text", F.length("text").alias("n_chars"), edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "doc_id", "th", "times", "n_chars", "edited_sha256"]
    pair = F.array(F.struct(F.lit(0).alias("edit"), "text"), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))
    made = signatures(both.select(*keys, F.explode(pair).alias("s")).select(*keys, "s.edit", "s.text"), "text", [*keys, "edit"], size)

    # a document's rows: its own signature, then that of its edited text, then the next document's
    order = Window.partitionBy("bucket").orderBy("doc_id", "th", "edit")
    made = made.select("*", F.lead("signature", 1).over(order).alias("b"), F.lead("signature", 2).over(order).alias("c"), F.lag("edit").over(order).isNull().alias("is_head"))
    made = scratch.written(made.where("edit = 0").withColumnRenamed("signature", "a"), "signatures")
    scratch.released(docs.sparkSession)

    heads = made.where("is_head and doc_id is not null").select("bucket", "a")
    follower = F.coalesce(F.lead("a").over(Window.orderBy("bucket")), F.first("a").over(everything))
    heads = heads.select("bucket", follower.alias("head"))
    last = F.col("c").isNull() & F.col("doc_id").isNotNull()
    ended = made.where(last).drop("c").join(heads, "bucket").withColumnRenamed("head", "c")
    out = made.where(~last).unionByName(ended)
    near_next = F.when(F.col("doc_id").isNotNull(), likeness("a", "c")).otherwise(0.0)
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text("a").alias("fingerprint"),
        as_text("b").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"),
        near_next.alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_"),
    ).drop("_")
