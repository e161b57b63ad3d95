"""Document fingerprints: a canonical exact digest. DataFrame operations only.

The canonical form of a text is Unicode-normalised (NFKC), case-folded, and has single blanks for white space. Its
fingerprint is a 128-bit xxhash. Where two canonical forms share one, which bytes show, both fingerprints are extended by a
SHA-256; so equal canonical texts have equal fingerprints and different ones have different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import key_bounds, range_of, shuffle_partitions, text_of, written

#: Everything that Unicode calls white space, and the controls that separate fields.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"
#: Ranges of keys for each shuffle partition, so that their hashes spread evenly.
RANGES = 4


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can undo it), white space to single blanks, none at the ends."""
    icu, fold = F.lit("com.ibm.icu.text.Normalizer"), F.lit("com.ibm.icu.lang.UCharacter")
    composed = F.reflect(icu, F.lit("compose"), text, F.lit(True))
    folded = F.reflect(icu, F.lit("compose"), F.reflect(fold, F.lit("foldCase"), composed, F.lit(True)), F.lit(True))
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def digest(form: Column) -> Column:
    """Two 64-bit xxhashes of a canonical form, seeded apart: hi and lo."""
    return F.struct(F.xxhash64(form).alias("hi"), F.xxhash64(F.lit(0x5BF03635), form, F.length(form)).alias("lo"))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once: Spark would repeat an expression that is named twice."""
    return F.transform(F.array(value), use)[0]


def collisions(docs: DataFrame, text: str = "text") -> DataFrame:
    """hi, lo of the digests that different canonical forms share: bytes are compared inside each bucket of equal digests.

    A first pass counts digests. Only texts in buckets of two or more move in the second, and of each such bucket a task
    sends its least and greatest form, however many rows it has.
    """
    whole = docs.select(text_of(text).alias("text"))
    formed = whole.select(canonical(F.col("text")).alias("form"))
    hashes = formed.select(digest(F.col("form")).alias("d")).select("d.*")
    shared = written(hashes.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hi", "lo"), "shared-digests")
    # shared has a known size: Spark broadcasts it while it is small, and else deals both sides by digest
    inside = formed.select("form", digest(F.col("form")).alias("d")).select("form", "d.*").join(shared, ["hi", "lo"], "left_semi")
    return inside.groupBy("hi", "lo").agg(F.min("form").alias("a"), F.max("form").alias("z")).filter(F.col("a").cast("binary") != F.col("z").cast("binary")).select("hi", "lo")


def fingerprint(form: Column, hashes: Column, collides: Column) -> Column:
    """32 hexadecimal digits, and a SHA-256 more where the digest collides."""
    wide = F.lower(F.concat(F.lpad(F.hex(hashes["hi"]), 16, "0"), F.lpad(F.hex(hashes["lo"]), 16, "0")))
    return F.when(collides, F.concat(wide, F.lit("-"), F.sha2(form.cast("binary"), 256))).otherwise(wide)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of each row of docs; a null text counts as empty.

    Rows with equal canonical texts have equal fingerprints, others not. Repeated rows each come back, a null key stays
    null, an empty table gives no rows, other columns aren't read.
    """
    clash = written(collisions(docs, text), "clashes").withColumn("clash", F.lit(True))
    formed = docs.select(F.col(key).alias("key"), canonical(text_of(text)).alias("form"))
    hashed = formed.withColumn("d", digest(F.col("form"))).withColumns({"hi": F.col("d.hi"), "lo": F.col("d.lo")})
    joined = hashed.join(clash, ["hi", "lo"], "left")
    return joined.select(F.col("key").alias(key), fingerprint(F.col("form"), F.col("d"), F.coalesce("clash", F.lit(False))).alias("fingerprint"))


def with_next(docs: DataFrame, key: str, columns: list[str], tie: list[str]) -> DataFrame:
    """Adds next_<column>: of the row next in descending order of key; after the last comes the first.

    Rows are cut into ranges of keys. The first row of each range also goes, as a guest, to the end of the range before
    it in that order, so every range knows its successor and no range is large. Null keys come last; ties are ordered
    by the columns in `tie`, and equal rows may stand in either order.
    """
    bounds = key_bounds(docs, key, RANGES * shuffle_partitions(docs.sparkSession))
    place = range_of(key, bounds)
    own = F.struct(place.alias("at"), F.lit(False).alias("guest"))
    above = F.struct(((place + 1) % max(1, len(bounds))).alias("at"), F.lit(True).alias("guest"))
    first = F.col(key).isin(bounds) if bounds else F.lit(False)
    placed = docs.select("*", F.explode(F.when(first, F.array(own, above)).otherwise(F.array(own))).alias("_to"))
    placed = placed.select(*docs.columns, F.col("_to.at").alias("_at"), F.col("_to.guest").alias("_guest"))
    order = Window.partitionBy("_at").orderBy("_guest", F.col(key).desc_nulls_last(), *tie)
    ahead = placed.select("*", F.lead(F.struct(*columns)).over(order).alias("_next")).filter(~F.col("_guest"))
    # keys that are all null have no bounds: their last row follows itself
    following = F.coalesce(F.col("_next"), F.struct(*columns))
    return ahead.withColumn("_next", following).select(*docs.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in columns])


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of an edited text and of the next document, and whether they are alike.

    The edited text: the last floor(n_chars / 3) code points replaced by as many from the start of the next document.
    near_edited and near_next are 1 where the canonical bytes are equal and else 0, as the digest is exact. A null text
    counts as empty; an empty table gives no rows. Null keys come last; rows of equal keys follow each other by digest and
    text, so each of repeated rows is followed by its like, and each comes back. Other columns aren't read.
    """
    clash = written(collisions(docs, text), "clashes").withColumn("clash", F.lit(True))
    hashed = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    hashed = hashed.withColumn("d", digest(canonical(F.col("text"))))
    rows = with_next(hashed, "key", ["text", "d"], ["d", "text"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - cut), F.left("next_text", cut)))
    rows = rows.withColumn("edited_form", canonical(F.col("edited")))
    rows = rows.withColumn("e", digest(F.col("edited_form")))
    same_bytes = lambda other: F.coalesce(canonical(F.col("text")).cast("binary") == other.cast("binary"), F.lit(False))
    near_edited = F.when(F.col("d") == F.col("e"), same_bytes(F.col("edited_form"))).otherwise(F.lit(False))
    near_next = F.when(F.col("d") == F.col("next_d"), same_bytes(canonical(F.col("next_text")))).otherwise(F.lit(False))
    hits = lambda d, name: clash.select(F.struct("hi", "lo").alias(d), F.col("clash").alias(name))
    rows = rows.join(hits("d", "clash"), "d", "left").join(hits("e", "edited_clash"), "e", "left")
    return rows.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(canonical(F.col("text")), F.col("d"), F.coalesce("clash", F.lit(False))).alias("fingerprint"),
        fingerprint(F.col("edited_form"), F.col("e"), F.coalesce("edited_clash", F.lit(False))).alias("edited_fingerprint"),
        near_edited.cast("double").alias("near_edited"),
        near_next.cast("double").alias("near_next"),
    )
