"""Keyword retrieval: what a question asks for, and ranked announcements."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.dates import MONTHS, in_window, question_window

# Words that are not search terms, words of recency, and words that name a category.
STOP = [
    "a", "about", "all", "am", "an", "and", "announcement", "announcements", "any", "are", "as", "at", "be", "been", "by", "can", "do", "does",
    "find", "for", "from", "get", "give", "has", "have", "how", "i", "in", "is", "it", "list", "many", "me", "much", "my", "notice", "notices",
    "of", "on", "or", "please", "search", "show", "some", "suchana", "tell", "that", "the", "there", "these", "this", "to", "update", "updates",
    "was", "were", "what", "when", "where", "which", "who", "with", "you", "your",
]
RECENT = ["latest", "newest", "recent", "recently", "new", "current", "today", "now", "upcoming", "this week", "nayaa", "naya"]
CATEGORY_OF = {
    "tender": "TENDER", "tenders": "TENDER", "bid": "TENDER", "bids": "TENDER", "procurement": "TENDER", "bolpatra": "TENDER", "vacancy": "VACANCY",
    "vacancies": "VACANCY", "job": "JOB", "jobs": "JOB", "internship": "INTERNSHIP", "internships": "INTERNSHIP", "circular": "CIRCULAR",
    "circulars": "CIRCULAR", "news": "NEWS",
}


@dataclass
class Intent:
    terms: list[str] = field(default_factory=list)
    recent: bool = False
    category: str | None = None
    window: tuple | None = None


def asked(question: str | Column, now: str | Column) -> Column:
    """(terms, recent, category, window) of a question.

    Words are runs of letters, digits and combining marks.  The first word that names a category
    gives it.  Terms are the distinct words of over two letters that are no stop words, recency
    words or words of that category, and, if the question names days, no names of months.
    """
    text = F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_OF.items() for x in kv])
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "), " "), lambda w: w != "")

    def read(v: Column) -> Column:
        said, w = v["words"], v["window"]
        category = F.get(F.filter(F.transform(said, lambda x: F.try_element_at(table, x)), lambda c: c.isNotNull()), F.lit(0))
        dated = w["as_of"].isNotNull() | w["date_from"].isNotNull() | w["date_to"].isNotNull()
        is_term = lambda x: (
            (F.length(x) > 2) & ~x.isin(STOP) & ~x.isin(RECENT) & ~(dated & x.isin([*MONTHS, "yesterday", "today"])) & ~F.coalesce(F.try_element_at(table, x) == category, F.lit(False))
        )
        terms = F.array_distinct(F.filter(said, is_term))
        return F.struct(terms.alias("terms"), F.exists(said, lambda x: x.isin(RECENT)).alias("recent"), category.alias("category"), w.alias("window"))

    return let(F.struct(words.alias("words"), question_window(text, now).alias("window")), read)


def intent(spark: SparkSession, question: str, now: str) -> Intent:
    """What one question asks for, at hand on the driver for :func:`search`."""
    found = spark.range(1).select(asked(F.lit(question), now).alias("i")).first()["i"]
    days = (found["window"]["date_from"], found["window"]["date_to"])
    return Intent(found["terms"], found["recent"], found["category"], days if any(days) else None)


def _hits(c: str, terms: list[str]) -> Column:
    t = F.lower(F.coalesce(F.col(c), F.lit("")))
    return sum((F.contains(t, F.lit(w)).cast("long") for w in terms), F.lit(0).cast("long"))


def search(rows: DataFrame, asked: Intent, k: int = 10, pool: int = 60) -> DataFrame:
    """Announcements that hold a term, scored 3 a term in the title and 2 in the summary.

    The newest ``pool`` matches are scored, as the search is defined; if any scores, those without
    a score go.  By date first if the question asks for what is recent.  Without terms the newest
    ``k`` come if the question gives recency, a category or days, else nothing.
    """
    newest = [F.desc("effective_at"), F.desc("id")]
    if asked.category:
        rows = rows.where(F.col("category") == asked.category)
    if asked.window:
        start, end = (str(d) if d else None for d in asked.window)
        rows = rows.where(in_window(F.to_date("effective_at"), start, end))
    if not asked.terms:
        some = asked.recent or asked.category or asked.window
        return rows.where(F.lit(bool(some))).orderBy(*newest).limit(k).withColumn("score", F.lit(0).cast("long"))
    any_hit = _hits("title", asked.terms) + _hits("summary", asked.terms) + _hits("content", asked.terms)
    found = rows.where(any_hit > 0).orderBy(*newest).limit(pool)
    scored = found.withColumn("score", 3 * _hits("title", asked.terms) + 2 * _hits("summary", asked.terms))
    best = scored.agg(F.max("score").alias("__best"))
    scored = scored.join(F.broadcast(best)).where((F.col("__best") == 0) | (F.col("score") > 0)).drop("__best")
    order = [*newest[:1], F.desc("score"), *newest[1:]] if asked.recent else [F.desc("score"), *newest]
    return scored.orderBy(*order).limit(k)


def relaxed(rows: DataFrame, asked: Intent, k: int = 10) -> DataFrame:
    """The first of three searches that finds something: as asked, without the category, without the days too."""
    steps = [asked, Intent(asked.terms, asked.recent, None, asked.window), Intent(asked.terms, asked.recent, None, None)]
    tries = None
    for i, step in enumerate(steps):
        part = search(rows, step, k).withColumn("step", F.lit(i).cast("long"))
        tries = part if tries is None else tries.unionByName(part)
    first = tries.agg(F.min("step").alias("__first"))
    return tries.join(F.broadcast(first), F.col("step") == F.col("__first")).drop("__first")
