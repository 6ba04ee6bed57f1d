"""Document fingerprints: a threshold-scaled sketch made of built-in functions only.

A text's sketch keeps every distinct shingle hash below a fixed fraction of the hash range, and its
smallest hash in any case, so that no text with words has an empty sketch.  Both rules hold for the
union of two sketches as for the union of two texts: sketches merge exactly, and the share of one
sketch found in another estimates containment, however unequal the texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import id_column, named

WORDS = 5
#: One shingle hash of this many is kept.
SCALE = 8
#: Ids of one bucket share all but these low bits, so that a bucket has a bounded number of ids.
BITS = 10


def threshold(scale: int) -> int:
    """The first signed 64-bit hash that is not kept."""
    return -(1 << 63) + (1 << 64) // scale


def sketch(text: Column, scale: int = SCALE) -> Column:
    """The sorted sketch of a text; null, empty and blank texts have an empty one.

    Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, lower-cased; shingles are five words,
    or all words of a shorter text.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        return F.when(F.size(w) >= WORDS, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(threshold(scale)))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)

    one = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  evaluates `value` once
    return one(one(words, hashes), kept)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x < F.lit(threshold(scale)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Share of the first sketch that the second holds: 1 for two empty ones, 0 if just one is empty."""
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def jaccard(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sketches; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / F.greatest(every, F.lit(1)).cast("double"))


def encode(s: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal digits, ascending, comma-joined."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.hex(x))), ",")


def successors(ids: DataFrame) -> DataFrame:
    """(id, next_id): for each distinct id the next smaller one; for the smallest, the largest.

    Neighbours are found bucket by bucket.  A bucket's last id takes the head of the next bucket that
    has any, which is the same question about buckets, asked again of ever coarser ones; a window
    never holds more than 2**BITS rows, whatever the ids are.
    """
    least, most = ids.agg(F.min("id"), F.max("id")).first()
    within = Window.partitionBy("bucket").orderBy(F.desc("id"))

    def following(level: DataFrame, low: int, high: int) -> DataFrame:
        """`level` has a group's key `id` and its largest id, `head`; adds the head of the next group."""
        placed = level.withColumn("bucket", F.shiftright("id", BITS)).withColumn("following", F.lead("head").over(within))
        if low >> BITS == high >> BITS:
            return placed
        above = following(placed.groupBy(F.col("bucket").alias("id")).agg(F.max("head").alias("head")), low >> BITS, high >> BITS)
        above = above.select(F.col("id").alias("bucket"), F.col("following").alias("beyond"))
        return placed.join(above, "bucket", "left").withColumn("following", F.coalesce("following", "beyond"))

    level = ids.select("id", F.col("id").alias("head")).where("id is not null").distinct()
    if least is None:
        return level.select("id", F.col("id").alias("next_id"))
    return following(level, least, most).select("id", F.coalesce("following", F.lit(most)).alias("next_id"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprint each text, an edited form of it, and the next document in descending order of id.

    The edited text is the text with its last floor(n/3) code points replaced by as many of the next
    document's first ones, or all of them.  Returns id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (containment of the text's sketch in the other one) and
    jaccard_edited, jaccard_next.

    A null text counts as empty; a row with a null id has an empty next document and is nobody's next.
    Rows that repeat an id each give a row of the result; as a next document the one with the
    smallest text hash stands for them.  Ids are whole numbers.  An empty table gives an empty result.
    """
    every = docs.select(id_column(docs, id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    placed = every.where("id is not null")
    base = placed.withColumn("sketch", sketch(F.col("text"), scale))
    needs = placed.groupBy("id").agg(F.max(F.floor(F.char_length("text") / 3)).cast("int").alias("need"))
    links = successors(placed.select("id")).join(needs, "id").select(F.col("id").alias("prior"), "next_id", "need")
    lent = F.struct(F.expr("substring(text, 1, need)").alias("lent"), F.col("sketch").alias("next_sketch"))
    # both joins take `base` by its id, so Spark deals out the texts once and reads that exchange twice
    donors = base.join(links, F.col("id") == F.col("next_id")).select("prior", lent.alias("gift"), F.xxhash64("text").alias("order"))
    donors = donors.groupBy("prior").agg(F.min_by("gift", "order").alias("gift")).select("prior", "gift.*")
    met = base.join(donors, F.col("id") == F.col("prior"), "left").drop("prior")
    lone = every.where("id is null").withColumn("sketch", sketch(F.col("text"), scale))
    met = met.unionByName(lone.withColumn("lent", F.lit("")).withColumn("next_sketch", F.array().cast("array<bigint>")))
    n = F.char_length("text")
    met = met.withColumn("n_chars", n.cast("bigint"))
    met = met.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - floor(n_chars / 3))), substring(lent, 1, int(floor(n_chars / 3))))"))
    met = met.withColumn("edited_sketch", sketch(F.col("edited"), scale))
    return met.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        jaccard(F.col("sketch"), F.col("edited_sketch")).alias("jaccard_edited"),
        jaccard(F.col("sketch"), F.col("next_sketch")).alias("jaccard_next"),
    )
