"""Op 7: document fingerprints as Merkle trees over paragraphs and sections, DataFrame functions only.

Sections are parted by an empty line, paragraphs are lines, leaves are spans of a line: 8 code points each in
its first 64, then 32 each. A node's hash is the digest of its children's digests in order, so equal roots mean
equal texts and a differing branch leads to the edited lines. The fingerprint is one string::

    root(64) / section(16) : paragraph(8) . leaf(6) leaf(6) ... , paragraph ... ; section ...

Likeness of two fingerprints: 1 with equal roots, else the common part of their leaves, as multisets and by length: a
leaf of 32 code points counts as four of 8, a leaf that occurs twice counts twice (weighted Jaccard).

Neighbours by doc_id come from a light table of keys: dealt out by ranges, ordered within each range, with the
first key of the next range across the border. Texts move once by their key, and a quarter of them once more.

Defined results: null text is empty and has a tree without leaves; rows with equal doc_id and text count as one
document among neighbours and get equal results, other rows with one doc_id are ordered by digest; null
doc_ids come first; the only document is its own neighbour; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.session import scratch_path

FINE, FINE_UP_TO, COARSE = 8, 64, 32


def _leaves(line: Column) -> Column:
    fine = F.regexp_extract_all(F.substring(line, 1, FINE_UP_TO), F.lit(f"(?s).{{1,{FINE}}}"), 0)
    coarse = F.regexp_extract_all(F.substring(line, FINE_UP_TO + 1, 2**31 - 1 - FINE_UP_TO), F.lit(f"(?s).{{1,{COARSE}}}"), 0)
    return F.transform(F.concat(fine, coarse), F.md5)


def _paragraph(leaves: Column) -> Column:
    return F.struct(F.sha2(F.array_join(leaves, ""), 256).alias("h"),
                    F.array_join(F.transform(leaves, lambda x: F.substring(x, 1, 6)), "").alias("leaves"))


def _section(paragraphs: Column) -> Column:
    shown = F.transform(paragraphs, lambda p: F.concat_ws(".", F.substring(p["h"], 1, 8), p["leaves"]))
    return F.struct(F.sha2(F.array_join(F.transform(paragraphs, lambda p: p["h"]), ""), 256).alias("h"), F.array_join(shown, ",").alias("shown"))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint of column ``text``; each level is computed once."""
    s, t = f"_{name}_sections", f"_{name}_nodes"
    lines = F.transform(F.split(text, "\n\n", -1), lambda x: F.transform(F.split(x, "\n", -1), lambda line: _paragraph(_leaves(line))))
    df = df.withColumn(s, lines).withColumn(t, F.transform(s, _section))
    root = F.sha2(F.array_join(F.transform(t, lambda x: x["h"]), ""), 256)
    shown = F.array_join(F.transform(t, lambda x: F.concat_ws(":", F.substring(x["h"], 1, 16), x["shown"])), ";")
    return df.withColumn(name, F.concat_ws("/", root, shown)).drop(s, t)


def leaf_hashes(fingerprint: Column) -> tuple[Column, Column]:
    """The fine and the coarse leaf hashes of a fingerprint, in order."""
    shown = F.regexp_extract_all(fingerprint, F.lit(r"\.([0-9a-f]*)"), 1)
    fine = 6 * FINE_UP_TO // FINE
    parts = F.transform(shown, lambda p: F.substring(p, 1, fine)), F.transform(shown, lambda p: F.substring(p, fine + 1, 2**31 - 1 - fine))
    return tuple(F.regexp_extract_all(F.array_join(x, ""), F.lit("[0-9a-f]{6}"), 0) for x in parts)


def _told_apart(leaves: Column) -> Column:
    """The array as a set: the second and later ones of equal hashes get a number. Equal hashes are brought together by
    sorting, and a run of them is one match. Most arrays repeat nothing and stay as they are."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array(leaves), ""), F.lit(r"([0-9a-f]{6})\1*+"), 0)
    numbered = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), (F.length(r) / 6).cast("int")), lambda i: F.concat(
        F.substring(r, 1, 6), F.when(i > 1, i.cast("string")).otherwise("")))))
    return F.when(F.size(F.array_distinct(leaves)) == F.size(leaves), leaves).otherwise(numbered)


def _share(a: Column, b: Column, fine: tuple[Column, Column], coarse: tuple[Column, Column]) -> Column:
    weight = COARSE // FINE
    common = F.size(F.array_intersect(*fine)) + weight * F.size(F.array_intersect(*coarse))
    every = F.size(fine[0]) + F.size(fine[1]) + weight * (F.size(coarse[0]) + F.size(coarse[1]))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(common / F.greatest(every - common, F.lit(1)))


def with_leaves(df: DataFrame, name: str) -> DataFrame:
    """Adds the leaf sets of fingerprint column ``name``; each is made once, in a column of its own."""
    for kind, leaves in zip(("fine", "coarse"), leaf_hashes(F.col(name))):
        df = df.withColumn(f"_{name}_{kind}", leaves)
    for kind in ("fine", "coarse"):
        df = df.withColumn(f"_{name}_{kind}", _told_apart(F.col(f"_{name}_{kind}")))
    return df


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns that :func:`with_leaves` was applied to."""
    sets = [tuple(F.col(f"_{name}_{kind}") for name in (a, b)) for kind in ("fine", "coarse")]
    return _share(F.col(a), F.col(b), *sets)


def paragraph_hashes(fingerprint: Column) -> Column:
    return F.regexp_extract_all(fingerprint, F.lit(r"([0-9a-f]{8})\."), 1)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) of the paragraphs that differ between two fingerprints."""
    pairs = F.arrays_zip(paragraph_hashes(a).alias("a"), paragraph_hashes(b).alias("b"))
    place = F.transform(pairs, lambda p, i: F.when(p["a"].eqNullSafe(p["b"]), F.lit(None)).otherwise(i))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<int>")).otherwise(F.filter(place, lambda i: i.isNotNull()))


def _keyed(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("k", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5("text")))


def neighbours(docs: DataFrame) -> DataFrame:
    """``k, n, next_k`` of every distinct document: key, code points, key of the next one (cyclic)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "order")
    light = _keyed(docs).select("k", "doc_id", F.length("text").cast("long").alias("n")).dropDuplicates(["k"])
    light.repartitionByRange("doc_id", "k").withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    own = F.struct("doc_id", "k")
    # One row per range from here on: its first key, and the first key of the next range.
    firsts = rows.groupBy("part").agg(F.min(own).alias("first"))
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(whole))["k"].alias("after"))
    inside = rows.withColumn("next_k", F.lead("k").over(Window.partitionBy("part").orderBy("doc_id", "k")))
    return inside.join(after, "part").select("k", "n", F.coalesce("next_k", "after").alias("next_k"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses (see ``op7``)."""
    rows = _keyed(docs)
    # From the view of the next document: whom it follows and how many code points that one takes. Fingerprints
    # are made after texts have moved: digests do not compress, a second computation costs less than moving them.
    links = neighbours(docs).select(F.col("next_k").alias("k"), F.col("k").alias("before_k"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    given = with_fingerprint(rows.join(links, "k"), "text", "next_fingerprint").select(
        F.col("before_k").alias("k"), F.substring("text", F.lit(1), F.col("take")).alias("new_end"),
        "next_fingerprint", F.col("doc_id").alias("next_doc_id")).dropDuplicates(["k"])
    n = F.length("text").cast("long")
    both = with_fingerprint(rows.join(given, "k"), "text", "fingerprint").withColumn("n_chars", n)
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.col("new_end")))
    both = with_fingerprint(both, "edited", "edited_fingerprint")
    for name in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        both = with_leaves(both, name)
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                       likeness("fingerprint", "next_fingerprint").alias("near_next"), "next_doc_id")
