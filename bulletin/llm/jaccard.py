"""N-gram Jaccard self-join of whole documents by vertical partitioning.

All n-grams have one global order, rare ones first, which is cut into fragments.  The first
fragment of a document is its prefix, among whose n-grams any similar document shares one; it
gives candidate pairs and, from how many of its n-grams others share, an upper bound of their
overlap.  For the pairs that can reach the threshold the overlaps in the fragments of the whole
order are counted separately and summed.

Equal sets are one class from the start.  Copies in large numbers never make all pairs: an
n-gram's list is first joined with one class of it (a star) and what that links is contracted to
one component; pairs are formed only between classes whose components still differ.  The last
round forms all of those, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shingles
from .common import fresh_names, small, stored, table
from .components import components

#: From this frequency class on an n-gram is counted before its rows meet.
FREQUENT = 4 << 60
MAX_STARS = 8


def behind(n: Column, percent: int) -> Column:
    """Number of a class's n-grams that stand after its prefix."""
    return F.floor((percent * n + 99) / 100).cast("int") - 1


def of_first_ending(a: Callable[[str], Column], b: Callable[[str], Column], name: str) -> Column:
    """The value of the class whose prefix ends first in the global order; the larger one where that is open."""
    return F.when(a("last") < b("last"), a(name)).when(a("last") > b("last"), b(name)).otherwise(F.greatest(a(name), b(name)))


def can_link(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Whether two classes with this n-gram as the first that their prefixes share can link.

    Up to where the first ending prefix ends, both prefixes hold all of their sets, so the
    overlap is at most that class's reach: what is live in its prefix from here on and all behind.
    """
    n = a("n") + b("n")
    close = 100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))
    return close & ((100 + percent) * of_first_ending(a, b, "reach") >= percent * n)


def per_token(rows: DataFrame, **aggregates: Column) -> DataFrame:
    """Add aggregates over the rows of each n-gram.

    Rare n-grams, whose lists are short, take a window; those of the frequent classes are
    pre-aggregated and joined, so a list of any length is spread over tasks.
    """
    w = Window.partitionBy("token")
    rare = rows.where(F.col("token") < FREQUENT).withColumns({k: v.over(w) for k, v in aggregates.items()})
    often = rows.where(F.col("token") >= FREQUENT)
    return rare.unionByName(often.join(often.groupBy("token").agg(*(v.alias(k) for k, v in aggregates.items())), "token"))


def live_heads(sets: DataFrame, percent: int) -> DataFrame:
    """The classes that share an n-gram of their prefix with another class's prefix.

    ``set_id``, ``n`` (size), ``last`` (high bits of the prefix's last n-gram) and ``head``, the
    shared n-grams in order.
    """
    full = sets.where("n_shingles > 0")
    rows = per_token(full.select("set_id", F.explode("prefix").alias("token")), lo=F.min("set_id"), hi=F.max("set_id"))
    heads = rows.where("lo < hi").groupBy("set_id").agg(F.array_sort(F.collect_set("token")).alias("head"))
    shapes = full.groupBy("set_id").agg(
        F.max("n_shingles").cast("int").alias("n"), F.max(F.shiftright(F.element_at("prefix", -1), 32)).cast("int").alias("last")
    )
    return heads.join(shapes, "set_id").select("set_id", "n", "last", "head")


POSTING = ["token", "set_id", "n", "last", "reach", "comp"]


def postings(heads: DataFrame, percent: int) -> DataFrame:
    """A row for each shared n-gram of each class; ``reach`` is what is live in its prefix from there on and all behind."""
    rows = heads.select("set_id", "n", "last", F.size("head").alias("held"), F.posexplode("head").alias("place", "token"))
    reach = F.col("held") - F.col("place") + behind(F.col("n"), percent)
    return rows.withColumns({"reach": reach, "comp": F.col("set_id")}).select(POSTING)


def relabelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of the turn before with the components of now.

    Those that a turn left out can link with none in any later one, as components only grow.
    """
    found = small(labels.select(F.col("id").alias("set_id"), "label"))
    return lists.select(POSTING).join(found, "set_id", "left").withColumn("comp", F.coalesce("label", "comp")).select(POSTING)


def open_lists(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Postings of lists that still hold different components, less those that can link with none.

    A class can link with those of at most ``cap`` n-grams where its prefix ends first, so a row
    stays if its cap allows for the list's smallest class or its size for the list's largest cap.
    ``hub`` is the class that a star of this turn has in its middle: in the first turn the one
    that shares most of its n-grams, as an original does, then random ones; ``list_n`` counts rows.
    """
    order = -(F.col("reach") / F.col("n")) if turn == 0 else F.xxhash64("set_id", F.lit(turn)).cast("double")
    cap = F.floor((100 + percent) * F.col("reach") / percent) - F.col("n")
    seen = per_token(
        rows,
        lo=F.min("comp"), hi=F.max("comp"), least_n=F.min("n"), most_cap=F.max(cap), list_n=F.count(F.lit(1)),
        hub=F.min(F.struct(order.alias("o"), F.xxhash64("set_id").alias("r"), "set_id", "n", "last", "reach", "comp")),
    )
    kept = (F.col("lo") < F.col("hi")) & ((cap >= F.col("least_n")) | (F.col("n") <= F.col("most_cap")))
    return seen.where(kept).select(*POSTING, "list_n", "hub")


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each class (``a``) with one hub (``b``) of its lists, of another component, that it can link with."""
    rows = lists.where((F.col("comp") != F.col("hub.comp")) & can_link(F.col, lambda c: F.col(f"hub.{c}"), percent))
    best = rows.groupBy("set_id", "n").agg(F.min("hub").alias("hub"))
    return best.select(F.col("set_id").alias("a"), F.col("hub.set_id").alias("b"), (F.col("n") + F.col("hub.n")).alias("n"))


def rest_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different components that share a list and can link."""
    left = lists.select("token", *(F.col(c).alias(f"l_{c}") for c in POSTING[1:]))
    return (
        left.join(lists.select(POSTING), "token")
        .where((F.col("l_comp") < F.col("comp")) & can_link(F.col, lambda c: F.col(f"l_{c}"), percent))
        .select(F.least("l_set_id", "set_id").alias("a"), F.greatest("l_set_id", "set_id").alias("b"), (F.col("l_n") + F.col("n")).alias("n"))
        .distinct()
    )


def with_prefix_overlap(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs that the overlap of the prefix fragment and all behind the first ending prefix leave possible."""
    side = lambda k: heads.select(F.col("set_id").alias(k), F.struct("last", behind(F.col("n"), percent).alias("behind"), "head").alias(f"h{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    rest = of_first_ending(lambda c: F.col(f"ha.{c}"), lambda c: F.col(f"hb.{c}"), "behind")
    most = F.size(F.array_intersect("ha.head", "hb.head")) + rest
    return both.where((100 + percent) * most >= percent * F.col("n")).select("a", "b", "n")


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, order, size: int, percent: int, fragments: int) -> DataFrame:
    """The pairs that link: overlaps are counted in each fragment and summed per pair.

    The n-grams of ``a`` move once to each of its partners, those of ``b`` once in all.
    """
    partner = "array<struct<b:bigint,n:int>>"
    sent = pairs.groupBy(F.col("a").alias("set_id")).agg(F.collect_list(F.struct("b", "n")).cast(partner).alias("partners"))
    met = pairs.select(F.col("b").alias("set_id")).distinct().withColumn("partners", F.array().cast(partner))

    def keys(wanted: DataFrame, name: str) -> DataFrame:
        wanted = small(stored(wanted.join(classes, "set_id").select("key", "set_id", "partners"), name))
        return shingles.segments(texts.join(wanted, "key"), order, size, fragments)

    a = keys(sent, "jaccard-sent").select(F.col("set_id").alias("a"), F.explode("partners").alias("to"), "fragment", F.col("keys").alias("keys_a"))
    b = keys(met, "jaccard-met").select(F.col("set_id").alias("b"), "fragment", F.col("keys").alias("keys_b"))
    part = F.max(F.size(F.array_intersect("keys_a", "keys_b"))).alias("part")  # repeated rows give equal parts
    return (
        a.select("a", "to.b", "to.n", "fragment", "keys_a")
        .join(b, ["b", "fragment"])
        .groupBy("a", "b", "n", "fragment")
        .agg(part)
        .groupBy("a", "b", "n")
        .agg(F.sum("part").alias("overlap"))
        .where((100 + percent) * F.col("overlap") >= percent * F.col("n"))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, fragments: int = 4
) -> DataFrame:
    """Link documents whose word-shingle sets have a Jaccard similarity of ``percent`` / 100.

    One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that
    links reach.  A null text or one without words has an empty set and links with nothing; a
    text of fewer than ``size`` words has one shingle.  Repeated rows are all returned; rows with
    a null id take part and get their component's smallest non-null id (null if there is none).
    Other columns are ignored; an empty table gives no rows.  Shingles are compared by 60-bit
    hashes and equal sets are found by a 64-bit hash.
    """
    spark = docs.sparkSession
    texts = shingles.texts_of(docs, id_col, text_col)
    order = shingles.frequency_classes(texts, size)
    sets = stored(shingles.prefixes(texts, order, size, percent), "jaccard-sets")
    classes = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("key").alias("key"))
    heads = stored(live_heads(sets, percent), "jaccard-heads")
    links, labels = spark.createDataFrame([], "a long, b long"), None
    most = 3 * (heads.agg(F.sum(F.size("head"))).first()[0] or 0)
    turn, before, rows = 0, None, postings(heads, percent)
    while True:
        lists = stored(open_lists(rows, turn, percent), "jaccard-lists")
        left = (lists.agg(F.sum("list_n")).first()[0] or 0) / 2
        if not left:
            break
        last = turn > 0 and (left <= most or left > 0.8 * before or turn >= MAX_STARS)
        pairs = rest_pairs(lists, percent) if last else star_pairs(lists, percent)
        pairs = stored(with_prefix_overlap(pairs, heads, percent), "jaccard-pairs")
        links = stored(links.union(verified(pairs, texts, classes, order, size, percent, fragments)), "jaccard-links")
        labels = components(links)
        if last:
            break
        turn, before, rows = turn + 1, left, relabelled(lists, labels)
    if labels is None:
        labels = spark.createDataFrame([], "id long, label long")
    rows = sets.select("doc_id", "n_shingles", "set_id").join(labels, sets["set_id"] == labels["id"], "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("label", "set_id").alias("comp"))
    lowest = rows.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return rows.join(small(stored(lowest, "jaccard-lowest")).select("comp", "lowest"), "comp", "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("lowest")), F.col("doc_id")).alias("component_id")
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with the smallest id of each group of near duplicates; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, percent=percent)
    gone_id = fresh_names(docs, "gone_id")[0]
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "jaccard-gone")
    return docs.join(small(gone), docs[id_col].cast("long") == F.col(gone_id), "left_anti")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)),
                        lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM t),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE reach(doc_id, c) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT u.b, reach.c FROM reach JOIN u ON u.a = reach.doc_id WHERE reach.c < u.b)
  SELECT * FROM reach)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, min(r.c)) AS component_id
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""
