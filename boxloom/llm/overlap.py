"""Stills that are in the training split and, under the same or nearly the same name, in an evaluation split.

A name has a fingerprint of 116 bits: 64 bits of a hash of its numbers, camera and shot, which must not differ, and 26 bits
of letter parities for each of its two words. One slip of the keys changes at most two parities, so words with one slip in
each of two names lie within a Hamming radius of four, and names within eight. The 52 parity bits are cut into nine
segments: two names within the radius agree in at least one of them. Names are joined across the splits on the hash, the
segment's number and its bits; a pair that agrees in several segments is taken at the first. Pairs within the radius are
then verified letter by letter. Nothing that one slip a word can do is missed: the join loses no pair within the radius.

Equal names are one class: classes are joined, not stills. Links of a still are counted from the sizes of classes; they
are expanded only where pairs are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.names import SHOT, readings_udf, session_key_udf, slips_udf
from boxloom.plans.shared import Scratch, table

RADIUS = 4  # bits in which the parities of a word may differ: two slips, two bits each
SLIPS = 2  # one in each of the two names
BITS = 52  # of the two words
SEGMENTS = 2 * RADIUS + 1  # at most 2 * RADIUS of them hold a bit that differs


def split_side(split: Column) -> Column:
    """train, or eval for every way of writing valid and test; null otherwise."""
    s = F.regexp_replace(F.lower(split), r"[^a-z]", "")
    return F.when(s.isin("train", "training"), "train").when(s.isin("valid", "val", "validation", "test", "testing"), "eval")


def split_name(split: Column) -> Column:
    s = F.regexp_replace(F.lower(split), r"[^a-z]", "")
    return F.when(s.isin("train", "training"), "train").when(s.isin("valid", "val", "validation"), "valid").when(s.isin("test", "testing"), "test")


def named_stills(images: DataFrame) -> DataFrame:
    """(image_id, side, name parts and codes) of every reading of a name; rows sent again with the same name count once."""
    slim = images.where("id is not null and file_name is not null").select(F.col("id").alias("image_id"), split_side(F.col("source_split")).alias("side"), "file_name")
    once = readings_udf.asNondeterministic()  # else names are read below distinct for the filter, and again above it
    read = slim.where("side is not null").distinct().withColumn("r", once("file_name")).where("r.number is not null")
    first = F.array(F.struct(*[F.col(f"r.{c}") for c in SHOT]))
    each = F.explode(F.when(F.col("r.more").isNull(), first).otherwise(F.concat(first, F.col("r.more")))).alias("s")
    return read.select("image_id", "side", each).select("image_id", "side", "s.*").distinct()


NAME = ["camera", "number", "site", "view"]


def segment(code: Column, i: int) -> Column:
    """The bits of a code in segment i."""
    lo, hi = BITS * i // SEGMENTS, BITS * (i + 1) // SEGMENTS
    return F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint"))


def fingerprints(classes: DataFrame) -> DataFrame:
    """classes with numbers_code, the hash of what must not differ, and words_code, the parities of both words."""
    words = F.shiftleft(F.col("site_code").cast("bigint"), 26).bitwiseOR(F.col("view_code").cast("bigint"))
    return classes.withColumns({"numbers_code": F.xxhash64("camera", "number"), "words_code": words})


def class_pairs(classes: DataFrame) -> DataFrame:
    """(train_class, eval_class) of names that denote the same shot. classes: side, cid, class, the name's parts and codes.

    A train name goes to each of its segments, an evaluation name too; a block is what agrees in the hash and one segment.
    Only codes are shuffled for that; the names come back to the pairs within the radius.
    """
    codes = fingerprints(classes).select("side", "cid", "numbers_code", "words_code")
    blocks = F.posexplode(F.array(*[segment(F.col("words_code"), i) for i in range(SEGMENTS)])).alias("seg", "bits")
    # one hash for the block: should two blocks have the same, the names tell them apart
    side = lambda which, end: codes.where(F.col("side") == which).select("cid", "words_code", "numbers_code", blocks).select(F.xxhash64("numbers_code", "seg", "bits").alias("block"), F.col("seg").cast("tinyint").alias(f"seg{end}"), F.col("cid").alias(f"cid{end}"), F.col("words_code").alias(f"words{end}"))
    j = side("train", "_t").join(side("eval", "_e"), "block")
    differ = F.col("words_t").bitwiseXOR(F.col("words_e"))
    half = (1 << 26) - 1
    apart = lambda bits: F.bit_count(bits) <= RADIUS
    near = apart(F.shiftrightunsigned(differ, 26)) & apart(differ.bitwiseAND(F.lit(half).cast("bigint")))
    # the first segment in which the two agree, so that a pair comes out of one block only
    first = F.lit(SEGMENTS - 1)
    for i in range(SEGMENTS - 2, -1, -1):
        first = F.when(segment(differ, i) == 0, i).otherwise(first)
    near = j.where(near & (F.col("seg_t") == first) & (F.col("seg_e") == first)).select("cid_t", "cid_e")
    of = lambda end: classes.select(*[F.col(c).alias(f"{c}{end}") for c in ("cid", "class", *NAME)])
    near = near.join(of("_t"), "cid_t").join(of("_e"), "cid_e").where((F.col("camera_t") == F.col("camera_e")) & (F.col("number_t") == F.col("number_e")))
    same = (F.col("site_t") == F.col("site_e")) & (F.col("view_t") == F.col("view_e"))
    # letters off by more than the slips allow can't be words off by as much; what passes is looked at with swaps
    rough = (F.levenshtein("site_t", "site_e") <= 2 * SLIPS) & (F.levenshtein("view_t", "view_e") <= 2 * SLIPS)
    near = near.where(same | rough).select("class_t", "class_e", (~F.col("number_t").contains("w")).alias("shot"), *[f"{c}_{e}" for c in ("site", "view") for e in "te"])
    # equal words cost nothing to compare
    near = near.withColumns({w: slips_udf(f"{w}_t", f"{w}_e") for w in ("site", "view")}).where((F.col("site") <= SLIPS) & (F.col("view") <= SLIPS))
    # where there is no site and view, slips that leave no letter of the shorter words make other words
    left = lambda w: F.col(w) < F.greatest(F.lit(1), F.least(F.length(f"{w}_t"), F.length(f"{w}_e")))
    return near.where(F.col("shot") | (left("site") & left("view"))).select(F.col("class_t").alias("train_class"), F.col("class_e").alias("eval_class"))


class Overlap:
    """Written tables of one run: stills (image_id, side, class), classes, and links between classes. A class is a folded name.

    A null name, or one of words that say it isn't known, denotes nothing; one that doesn't read as site, view, camera and
    number stands for itself (names.readings), one of several readings is in several classes; a null or other split is
    neither side. Rows sent again with the same name count once; an id may stand in several classes or on both sides. An
    empty table gives no rows.
    """

    def __init__(self, images: DataFrame) -> None:
        s = Scratch(images.sparkSession, "stills")
        named = s.cut(named_stills(images))  # names parsed once
        named = named.withColumn("class", F.concat_ws("-", *NAME))  # no part has a dash
        self.classes = s.cut(named.groupBy("side", "class", *NAME, "site_code", "view_code").agg(F.min("image_id").alias("class_id")).withColumn("cid", F.monotonically_increasing_id()))
        self.stills = named.select("image_id", "side", "class")
        self.links = s.cut(class_pairs(self.classes))
        self._scratch = s

    def pairs(self) -> DataFrame:
        """(train_id, eval_id) of stills of the same shot; an id that stands in both splits itself is no pair."""
        of = lambda side, name: self.stills.where(F.col("side") == side).select(F.col("image_id").alias(f"{name}_id"), F.col("class").alias(f"{name}_class"))
        both = self.links.join(of("train", "train"), "train_class").join(of("eval", "eval"), "eval_class")
        return both.where("train_id <> eval_id").select("train_id", "eval_id").distinct()

    def linked(self, side: str = "eval") -> DataFrame:
        """(image_id, n_links) of the stills of a side that have any: how many of the other side show the same shot.

        Stills of one class count by its size. Those of several classes, which could count twice, are taken one by one.
        """
        other = "train" if side == "eval" else "eval"
        near = self.links.select(F.col(f"{side}_class").alias("class"), F.col(f"{other}_class").alias("other"))
        s = self._scratch
        stills = s.cut(self.stills)
        mine = s.cut(stills.where(F.col("side") == side).join(near, "class").select("image_id", "other").distinct())
        theirs = stills.where(F.col("side") == other).select(F.col("image_id").alias("there"), F.col("class").alias("other"))
        several = s.cut(theirs.groupBy("there").agg(F.count("*").alias("n")).where("n > 1").select("there"))
        single = theirs.join(several, "there", "left_anti")
        plain = mine.join(single.groupBy("other").agg(F.count("*").alias("n")), "other").groupBy("image_id").agg(F.sum("n").alias("n"))
        more = mine.join(theirs.join(several, "there", "left_semi"), "other").select("image_id", "there").distinct().where("image_id <> there").groupBy("image_id").agg(F.count("*").alias("n"))
        self_ = mine.join(single.select(F.col("there").alias("image_id"), "other"), ["image_id", "other"]).select("image_id", F.lit(-1).cast("bigint").alias("n"))
        return plain.unionByName(more).unionByName(self_).groupBy("image_id").agg(F.sum("n").alias("n_links")).where("n_links > 0")

    def members(self) -> DataFrame:
        """(image_id, side, class_id, n_links) of every still that is in an overlap; class_id: the least id of its name's
        class on its side (of several classes the least)."""
        least = self.stills.join(self.classes.select("side", "class", "class_id"), ["side", "class"]).groupBy("image_id", "side").agg(F.min("class_id").alias("class_id"))
        part = lambda side: least.where(F.col("side") == side).join(self.linked(side), "image_id")
        return part("train").unionByName(part("eval")).select("image_id", "side", "class_id", "n_links")


def cross_split_pairs(images: DataFrame) -> DataFrame:
    return Overlap(images).pairs()


def overlap_report(images: DataFrame) -> DataFrame:
    """Of each evaluation split and session: its stills that are also in train, and the pairs they are in."""
    of = images.where("id is not null").select(F.col("id").alias("image_id"), split_name(F.col("source_split")).alias("split"), F.col("source_group")).where("split in ('valid', 'test')")
    named = of.withColumn("session", session_key_udf("source_group")).groupBy("image_id").agg(F.min("split").alias("split"), F.min("session").alias("session"))
    return named.join(Overlap(images).linked(), "image_id").groupBy(F.col("split").alias("source_split"), F.col("session").alias("source_group")).agg(F.count("*").alias("n_stills"), F.sum("n_links").alias("n_pairs"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    p = cross_split_pairs(table(spark, sf_dir, "images"))
    return p.select(F.least("train_id", "eval_id").alias("image_id_a"), F.greatest("train_id", "eval_id").alias("image_id_b")).distinct()


def p5_report(spark, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "images"))


def p5_classes(spark, sf_dir: str) -> DataFrame:
    return Overlap(table(spark, sf_dir, "images")).members()


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_classes": p5_classes}
