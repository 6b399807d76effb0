"""Splits that keep related records together: a spanning forest by Borůvka's contraction, then systematic dealing.

Records that name the same session or the same source file are related, also by way of others. Every key is stood for
by the smallest id that has it, so an edge joins the representatives of one record's two keys, and a key that a third
of all records share is one vertex, not a clique. In each round every vertex picks its least edge by (hash, ends), a
total order; the picked edges form trees, whose roots are found by pointer jumping, and the graph contracts to the
roots. At least half of the vertices go in each round. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.names import session_key_udf, source_key_udf
from boxloom.operators.deal import dealt
from boxloom.plans.shared import Scratch, table

SPLITS = (("train", 0.75), ("val", 0.15), ("test", 0.10))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge from both ends."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w", "oa", "ob").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "w", "oa", "ob"))


def _simple(a: Column, b: Column, w: Column, oa: Column, ob: Column, df: DataFrame) -> DataFrame:
    """Edges between different ends, of several between the same ends the least."""
    e = df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.struct(w.alias("w"), oa.alias("oa"), ob.alias("ob")).alias("e")).where("a <> b")
    return e.groupBy("a", "b").agg(F.min("e").alias("e")).select("a", "b", "e.w", "e.oa", "e.ob")


def spanning_forest(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None, Scratch]:
    """(forest edges, root of each vertex with an edge, scratch) of the graph with edges (a, b).

    Loops and repeated edges are dropped; null ends are no ends. Without edges both tables are None. The forest and
    the roots are written tables.
    """
    s = Scratch(spark, "forest")
    a, b = F.least("a", "b"), F.greatest("a", "b")
    now = s.cut(_simple(a, b, F.xxhash64(a, b), a, b, edges.where("a is not null and b is not null")))
    parents: list[DataFrame] = []
    forest: list[DataFrame] = []
    while not now.isEmpty():
        pick = _oriented(now).groupBy("u").agg(F.min(F.struct("w", "oa", "ob", "v")).alias("e")).select("u", "e.v", "e.oa", "e.ob")
        best = s.cut(pick)
        forest.append(best.select("oa", "ob"))
        # two vertices that picked the same edge: the smaller one is a root. No other cycles, as edges are totally ordered.
        other = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
        p = s.cut(best.join(other, "v").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p")))
        while True:
            up = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            q = s.cut(p.join(up, "p").join(up.select(F.col("p").alias("pp"), F.col("pp").alias("ppp")), "pp").select("u", F.col("ppp").alias("p"), (F.col("ppp") != F.col("p")).alias("moved")))
            settled = q.where("moved").isEmpty()
            s.drop(p)
            p = q.select("u", "p")
            p._boxloom_path = q._boxloom_path
            if settled:
                break
        parents.append(p)
        ra, rb = p.select(F.col("u").alias("a"), F.col("p").alias("ra")), p.select(F.col("u").alias("b"), F.col("p").alias("rb"))
        nxt = s.cut(_simple(F.col("ra"), F.col("rb"), F.col("w"), F.col("oa"), F.col("ob"), now.join(ra, "a").join(rb, "b")))
        s.drop(now)
        now = nxt
    if not parents:
        return None, None, s
    roots = parents[-1].select(F.col("u").alias("vertex"), F.col("p").alias("root"))
    for p in reversed(parents[:-1]):  # tables double from round to round, so this costs about twice the first join
        up = roots.select(F.col("vertex").alias("p"), "root")
        roots = p.join(up, "p", "left").select(F.col("u").alias("vertex"), F.coalesce("root", "p").alias("root"))
    roots = s.cut(roots)
    tree = forest[0]
    for f in forest[1:]:
        tree = tree.unionByName(f)
    return s.cut(tree.distinct()), roots, s


def related_sets(spark: SparkSession, images: DataFrame, ident: str = "id", session: str = "source_group", source: str = "source_file_name", keep: str | None = None) -> DataFrame:
    """(image_id, first_image_id, set_size) of every id: the smallest id of its related set.

    keep: a folder in which the spanning forest stays, as Parquet: forest (oa, ob), the edges between representatives of
    names that hold the sets together, and roots (vertex, root).

    A null, blank or placeholder name relates nothing, so a record with none is a set of its own. All rows of an id
    count, repeated or contradictory. Null ids are left out; an empty table gives no rows.
    """
    s = Scratch(spark, "related")
    keyed = images.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(session).alias("g"), F.col(source).alias("f")).distinct()
    keyed = s.cut(keyed.select("id", session_key_udf("g").alias("g"), source_key_udf("f").alias("f")).distinct())
    first = lambda k, to: keyed.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias(to))
    # a key's records are skewed, its representative is one row: adaptive execution splits the records' side
    rep = s.cut(keyed.join(first("g", "a"), "g", "left").join(first("f", "b"), "f", "left").select("id", "a", "b"))
    own = rep.select(F.col("id").alias("a"), F.coalesce("a", "b").alias("b"))  # several rows of one id tie it to each
    multi = rep.groupBy("id").agg(F.min(F.coalesce("a", "b", "id")).alias("lo"), F.max(F.coalesce("a", "b", "id")).alias("hi")).where("lo <> hi").select("id")
    edges = rep.select("a", "b").unionByName(own.join(multi.withColumnRenamed("id", "a"), "a", "left_semi"))
    tree, roots, _ = spanning_forest(spark, edges)
    if keep is not None and tree is not None:
        tree.write.mode("overwrite").parquet(f"{keep}/forest")
        roots.write.mode("overwrite").parquet(f"{keep}/roots")
    vertex = F.coalesce("a", "b", "id")
    member = rep.select("id", vertex.alias("vertex"))
    member = member.withColumn("root", F.col("vertex")) if roots is None else member.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    member = s.cut(member.groupBy("id").agg(F.min("root").alias("root")))
    least = member.groupBy("root").agg(F.min("id").alias("first_image_id"), F.count("*").alias("set_size"))
    return member.join(least, "root").select(F.col("id").alias("image_id"), "first_image_id", "set_size")


def assign_splits(spark: SparkSession, images: DataFrame) -> DataFrame:
    """(image_id, first_image_id, split): related images always share a split.

    Sets are stratified by the band of their size and dealt systematically (operators/deal.py), all by one rule.
    """
    member = Scratch(spark, "sets").cut(related_sets(spark, images))
    sets = member.select("first_image_id", "set_size").distinct()
    return member.join(dealt(sets, "first_image_id", "set_size", [], dict(SPLITS)), "first_image_id").select("image_id", "first_image_id", "split")


def forest_edges(spark: SparkSession, images: DataFrame) -> DataFrame:
    """(image_id_a, image_id_b) of the spanning forest, read back from where it is kept: each set's ties, one less than the
    representatives it has. An edge joins images that name the same session or source file as one image does."""
    folder = f"{Scratch(spark, 'kept').root}/tree"
    related_sets(spark, images, keep=folder)
    try:
        tree = spark.read.parquet(f"{folder}/forest")
    except AnalysisException:  # no image is related to another
        return spark.createDataFrame([], "image_id_a bigint, image_id_b bigint")
    return tree.select(F.col("oa").alias("image_id_a"), F.col("ob").alias("image_id_b"))


def p2_forest(spark, sf_dir: str) -> DataFrame:
    return forest_edges(spark, table(spark, sf_dir, "images"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return related_sets(spark, table(spark, sf_dir, "images")).where("image_id <> first_image_id").select("first_image_id", "image_id")


def p2_splits(spark, sf_dir: str) -> DataFrame:
    return assign_splits(spark, table(spark, sf_dir, "images"))


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_forest": p2_forest}
