"""Stored announcements and what hangs on them: files, categories, outcomes, contexts, queues, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .retrieval import FLOOR, dot

# File names that text can be read from.
IMAGES = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff"]
# Words of a title, and of a URL, that refine a category when an item is first stored; the first hit counts.
REFINED = [
    ("TENDER", ["बोलपत्र", "tender", "दरभाउपत्र", "quotation"], ["tender", "bolpatra"]),
    ("VACANCY", ["पदपूर्ति", "कर्मचारी आवश्यकता", "दरखास्त", "vacancy", "recruitment"], ["vacancy"]),
    ("PRESS_RELEASE", ["प्रेस विज्ञप्ति", "press release", "विज्ञप्ति"], ["press-release"]),
    ("CIRCULAR", ["परिपत्र", "निर्देशिका", "कार्यविधि", "circular", "directive"], []),
    ("NEWS", ["समाचार", "news", "बुलेटिन", "bulletin"], []),
]
# Names of the facts in a context and their columns, what is said of files, characters of the text.
FACTS = [("Issuing source", "source_label"), ("Category", "category"), ("Published", "published"), ("Notice page", "url")]
FILES_NOTE = " — these are attached to this notice and downloadable from the notice page:"
CONTEXT_CHARS = 6000


def with_children(items: DataFrame, children: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """Items with the array ``name`` of their children's other columns in order; an empty array where there are none."""
    fields = [c for c in children.columns if c not in (key, position)]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(position, *fields))).alias(name))
    return items.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def extractable(url: Column, mime: Column) -> Column:
    """Whether text can be read from a file: a PDF or an image by its type or by its name."""
    name = F.substring_index(F.substring_index(F.lower(url), "?", 1), "#", 1)
    kind = F.coalesce(mime, F.lit(""))
    by_name = F.exists(F.array(*map(F.lit, [".pdf", *IMAGES])), lambda e: F.endswith(name, e))
    return F.coalesce((url != "") & (F.contains(kind, F.lit("pdf")) | F.startswith(kind, F.lit("image/")) | by_name), F.lit(False))


def extractable_url(attachments: Column, legacy: Column) -> Column:
    """The first attachment (``url``, ``mime``) with text to read, else the single URL of older rows if it names a PDF or an image."""
    first = F.get(F.filter(attachments, lambda a: extractable(a["url"], a["mime"])), F.lit(0))["url"]
    return F.coalesce(first, F.when(extractable(legacy, F.lit(None).cast("string")) | F.contains(legacy, F.lit("pdf")), legacy))


def visible(user: str | int | None) -> Column:
    """Rows that a user may see: the system's and their own; without a user the system's only."""
    own = F.coalesce(F.col("uploaded_by") == F.lit(user), F.lit(False)) if user is not None else F.lit(False)
    return F.coalesce("is_system", F.lit(False)) | own


def clamped(n: str | Column, most: int) -> Column:
    """A limit between 1 and ``most``."""
    return F.least(F.greatest(F.lit(1), F.col(n) if isinstance(n, str) else n), F.lit(most))


def refined_category(category: Column, title: Column, url: Column) -> Column:
    """The category of a new item: OTHER and NOTICE give way to what words of its title or URL say, else NOTICE."""
    title, url = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, url))
    found = F.lit("NOTICE")
    for name, in_title, in_url in reversed(REFINED):
        hits = [F.contains(title, F.lit(w)) for w in in_title] + [F.contains(url, F.lit(w)) for w in in_url]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        found = F.when(any_hit, name).otherwise(found)
    return F.when(category.isin("OTHER", "NOTICE"), found).otherwise(category)


def replaced_children(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Children after an update: all of an item's are replaced where fresh ones came, the others stay."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def batch_outcomes(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of each item of a batch (``url``, ``content_hash``) against the stored rows, and what its queues become.

    new; skipped if the content is the same and both queues are completed; else updated.  Changed
    content starts both queues again; new items start them; others keep theirs.
    """
    old = stored.select(
        "url", F.col("content_hash").alias("__hash"), F.col("summary_status").alias("__summary"), F.col("embedding_status").alias("__embedding"), F.lit(True).alias("__old")
    )
    same = F.col("content_hash").eqNullSafe(F.col("__hash"))
    done = F.coalesce((F.col("__summary") == "completed") & (F.col("__embedding") == "completed"), F.lit(False))
    rows = items.join(old, "url", "left")
    outcome = F.when(F.col("__old").isNull(), "new").when(same & done, "skipped").otherwise("updated")
    queue = lambda c: F.when(F.col("__old") & same, F.col(c)).otherwise("pending")
    return rows.withColumns({"outcome": outcome, "summary_status": queue("__summary"), "embedding_status": queue("__embedding")}).drop("__hash", "__summary", "__embedding", "__old")


def junk(rows: DataFrame) -> DataFrame:
    """Stored rows that would be refused today: no title or one that says ``untitled``, and not storable."""
    return rows.where((F.contains("title", F.lit("untitled")) | (F.col("title") == "")) & ~text.storable_title("title"))


def summary_queue(rows: DataFrame, limit: int = 500) -> DataFrame:
    """The newest rows with content and no summary, at most ``limit`` (1 to 5000)."""
    pending = rows.where("summary IS NULL AND content IS NOT NULL")
    return pending.orderBy(F.desc_nulls_first("effective_at"), "id").limit(min(max(1, limit), 5000))


def notice_context(readable: Column) -> Column:
    """What is known of an announcement as one text: facts, metadata, files, summaries, key points, and its text if ``readable``.

    Columns: source_label, category, published, url, metadata (map), files (array of name, url,
    mime, bytes), summary, summary_ne, key_facts (array), content.  Empty parts are left out, but
    that there is no file is said.
    """
    row = lambda c: F.concat(F.lit("- "), c)
    lines = lambda rows: F.array_join(F.transform(rows, row), "\n")
    part = lambda title, body: F.when(body != "", F.concat(F.lit(f"{title}\n"), body))
    facts = [F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), F.col(c))) for name, c in FACTS]
    told = F.transform(F.filter(F.map_entries("metadata"), lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    given = lambda c: F.when(c != "", c)

    def file(f: Column) -> Column:
        name = F.coalesce(given(f["name"]), given(f["url"]), F.lit("file"))
        size = F.when(f["bytes"] > 0, F.concat(F.bround(f["bytes"] / 1024).cast("long").cast("string"), F.lit(" KB")))
        return F.concat(F.concat_ws(" · ", name, given(f["mime"]), size), F.lit(" ("), F.coalesce(f["url"], F.lit("")), F.lit(")"))

    files = F.concat(F.lit("ATTACHED FILES ("), F.size("files").cast("string"), F.lit(f"){FILES_NOTE}\n"), lines(F.transform("files", file)))
    return F.concat_ws(
        "\n\n", part("NOTICE FACTS:", lines(F.array_compact(F.array(*facts)))), part("STRUCTURED METADATA:", lines(told)),
        F.when(F.size("files") > 0, files).otherwise("ATTACHED FILES: none."),
        part("AI SUMMARY:", F.trim("summary")), part("AI SUMMARY (Nepali):", F.trim("summary_ne")),
        part("KEY POINTS:", lines(F.filter("key_facts", lambda p: F.trim(p) != ""))),
        F.when(readable, part("NOTICE TEXT (extracted, may be imperfect):", F.substring(F.trim("content"), 1, CONTEXT_CHARS))),
    )


def marked_read(feed: DataFrame, user: Column, at: Column) -> DataFrame:
    """A user's unread rows become read at that time; rows read before keep theirs."""
    return feed.withColumn("read_at", F.when(user & F.col("read_at").isNull(), at).otherwise(F.col("read_at")))


def live_tokens(tokens: DataFrame, revoked: DataFrame, now: Column) -> DataFrame:
    """The set of revoked tokens once expired ones are gone and new ones are in; of one token the first entry counts."""
    rows = tokens.select("token", "expires_at", F.lit(0).alias("__n")).unionByName(revoked.select("token", "expires_at", F.lit(1).alias("__n")))
    first = rows.where(F.col("expires_at") > now).groupBy("token").agg(F.min_by("expires_at", F.struct("__n", "expires_at")).alias("expires_at"))
    return first


def progress_shown(ids: DataFrame, live: DataFrame, cached: DataFrame, stored: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """Progress of each document: live, else cached within ``ttl_s``, else 5 % if it is waited for, else nothing.

    ``live`` and ``cached``: id, percent (``cached`` with ``at``); ``stored``: id, status.
    """
    fresh = cached.where(F.col("at") > now - F.make_dt_interval(secs=F.lit(ttl_s))).select("id", F.col("percent").alias("__cached"))
    waited = stored.where(F.col("status").isin("PROCESSING", "PENDING")).select("id", F.lit(5).alias("__first"))
    rows = ids.join(live.select("id", F.col("percent").alias("__live")), "id", "left").join(fresh, "id", "left").join(waited, "id", "left")
    origin = F.when(F.col("__live").isNotNull(), "live").when(F.col("__cached").isNotNull(), "cached").when(F.col("__first").isNotNull(), "first")
    return rows.select(*ids.columns, F.coalesce("__live", "__cached", "__first").alias("percent"), origin.alias("origin"))


def appended(messages: Column, message: Column, n: int = 200) -> Column:
    """The list with one more entry, of which the last ``n`` stay."""
    longer = F.array_append(F.coalesce(messages, F.array().cast("array<string>")), message)
    return F.slice(longer, F.greatest(F.size(longer) - n + 1, F.lit(1)), F.lit(n))


def model_input(c: str | Column, model: str, query: bool) -> Column:
    """A text as the embedding model wants it: models of the E5 family tell questions from passages."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("query: " if query else "passage: "), c) if "e5" in model.lower() else c


def upserted_vectors(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The vector index (``id``, ``title``, ``vector``) once rows are written over it; rows without id, title or vector are refused.

    Ids are deterministic, so a write that is done again changes nothing.  Of equal ids in one
    batch the row with the greatest ``position`` stays.
    """
    good = rows.where("id IS NOT NULL AND trim(title) <> '' AND vector IS NOT NULL")
    last = good.groupBy("id").agg(F.max_by(F.struct("title", "vector"), "position").alias("r")).select("id", "r.*")
    return index.join(last.select("id"), "id", "left_anti").select("id", "title", "vector").unionByName(last)


def rescored(members: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Fused results (``query_id``, ``id``) in the order of their cosine, as ``score`` and ``place`` from 1.

    Fusion decides what belongs to the results only.  Members without a vector keep ``fused``.
    """
    rows = members.join(vectors.select("id", "vector"), "id", "left").join(queries.select("query_id", "query"), "query_id")
    score = F.coalesce(F.round(dot("query", "vector"), 6), F.col("fused"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("score", score).drop("query", "vector").withColumn("place", F.row_number().over(order))


def extracted_answer(sentences: DataFrame, floor: float = FLOOR, most: int = 4, head: int = 60) -> DataFrame:
    """The sentences that answer a question without a model (``question``, ``position``, ``sentence``, ``score``).

    Those that score ``floor`` or more, one of those with an equal lower-case beginning, the best
    ``most``, with their ``place`` in the text's order.  Equal scores go to the later sentence.
    """
    rows = sentences.where(F.col("score") >= floor).withColumn("__head", F.lower(F.substring("sentence", 1, head)))
    best = [F.desc("score"), F.desc("position")]
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("question", "__head").orderBy(*best))).where("__n = 1")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("question").orderBy(*best))).where(F.col("__n") <= most)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("position"))).drop("__head", "__n")
