"""Queries of stored announcements and what hangs on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import records as ops
from ..operators import retrieval
from ..sources.tables import NOTICES_SQL, day_text, notices, table
from .registry import query
from .reports import QUALITY_SQL
from .retrieval import BM25_SQL, DENSE_SQL, TERMS, asked, vectors


@query(
    "items_with_files",
    """WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(parts, '') AS parts FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def items_with_files(spark, path):
    """Orders as items and their lines as files."""
    lines = table(spark, path, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = ops.with_children(table(spark, path, "orders").select("o_orderkey"), lines, "o_orderkey", "l_linenumber", "files")
    told = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["l_partkey"], f["l_suppkey"])), ",")
    return rows.select("o_orderkey", F.size("files").cast("long").alias("n"), told.alias("parts"))


@query(
    "extractable_files",
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN u || '/a.PDF?v=1' WHEN 1 THEN u || '/download' WHEN 2 THEN u || '/pdf/7' WHEN 3 THEN u || '/b.png#x' END AS file FROM p""",
)
def extractable_files(spark, path):
    i, u = F.col("page_id"), F.regexp_replace("url", "[?#].*$", "")
    file = lambda end, mime: F.struct(F.concat(u, F.lit(end)).alias("url"), F.lit(mime).cast("string").alias("mime"))
    files = (
        F.when(i % 5 == 0, F.array(file("/x.docx", None), file("/a.PDF?v=1", None), file("/z.pdf", None)))
        .when(i % 5 == 1, F.array(file("/x", "text/html"), file("/download", "application/pdf")))
        .when(i % 5 == 3, F.array(file("/b.png#x", None)))
    )
    legacy = F.when(i % 5 == 2, F.concat(u, F.lit("/pdf/7"))).when(i % 5 == 4, F.concat(u, F.lit("/x.txt")))
    return table(spark, path, "pages").select("page_id", ops.extractable_url(files, legacy).alias("file"))


@query(
    "visible_documents",
    """SELECT 'anonymous' AS viewer, doc_id FROM documents WHERE source IN ('src0', 'src1') UNION ALL SELECT 'user', doc_id FROM documents WHERE source IN ('src0', 'src1') OR doc_id % 10 = 3""",
)
def visible_documents(spark, path):
    """Two sources are the system's, every document is of one of ten users (some of none)."""
    rows = table(spark, path, "documents").withColumn("is_system", F.when(F.col("source").isin("src0", "src1"), True)).withColumn("uploaded_by", F.nullif(F.col("doc_id") % 10, F.lit(9)))
    seen = [rows.where(ops.visible(user)).select(F.lit(name).alias("viewer"), "doc_id") for name, user in (("anonymous", None), ("user", 3))]
    return seen[0].unionByName(seen[1])


@query("limits_clamped", "SELECT event_id, least(greatest(1, user_id - 500), 300) AS n FROM events")
def limits_clamped(spark, path):
    return table(spark, path, "events").select("event_id", ops.clamped(F.col("user_id") - 500, 300).alias("n"))


ENDINGS = ["", " Tender", " vacancy", " press release", " Circular", " News", " बोलपत्र", " दरखास्त", " विज्ञप्ति", " बुलेटिन"]
ENDINGS_SQL = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "]"
_hit = lambda words, c: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")" if words else "false"
REFINED_SQL = " ".join(f"WHEN {_hit(t, 't')} OR {_hit(u, 'u')} THEN '{name}'" for name, t, u in ops.REFINED)


@query(
    "category_on_insert",
    f"""WITH {NOTICES_SQL}, c AS (SELECT id, category, lower(title || {ENDINGS_SQL}[id % 10 + 1]) AS t, lower('https://h.example/' || CASE WHEN id % 13 = 0 THEN 'Bolpatra/' ELSE '' END || id) AS u FROM notices)
    SELECT id, CASE WHEN category <> 'NOTICE' THEN category {REFINED_SQL} ELSE 'NOTICE' END AS category FROM c""",
)
def category_on_insert(spark, path):
    """The titles with a word of each kind behind them, so that every rule is met."""
    i = F.col("id")
    title = F.concat("title", F.element_at(F.array(*map(F.lit, ENDINGS)), (i % 10 + 1).cast("int")))
    url = F.concat(F.lit("https://h.example/"), F.when(i % 13 == 0, "Bolpatra/").otherwise(""), i.cast("string"))
    return notices(spark, path).select("id", ops.refined_category(F.col("category"), title, url).alias("category"))


@query(
    "files_replaced",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
    UNION ALL SELECT o_orderkey, 100, o_custkey FROM orders WHERE o_orderkey % 3 = 0""",
)
def files_replaced(spark, path):
    stored = table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    fresh = table(spark, path, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(100).alias("l_linenumber"), F.col("o_custkey").alias("l_partkey"))
    return ops.replaced_children(stored, fresh, "l_orderkey")


@query(
    "batch_outcomes",
    """SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 4 <> 0 AND doc_id % 5 <> 0 THEN 'skipped' ELSE 'updated' END AS outcome,
      CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'pending' ELSE 'completed' END AS summary_status,
      CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS embedding_status FROM documents""",
)
def batch_outcomes(spark, path):
    """Whole texts by hash; of the stored rows a quarter held other text and a fifth lacks its vector."""
    i = F.col("doc_id")
    rows = table(spark, path, "documents").select(i, F.concat(F.lit("u"), i.cast("string")).alias("url"), F.sha2("text", 256).alias("content_hash"))
    stored = rows.where("doc_id % 3 <> 0").select("url", F.when(i % 4 != 0, F.col("content_hash")).alias("content_hash"), F.lit("completed").alias("summary_status"), F.when(i % 5 == 0, "failed").otherwise("completed").alias("embedding_status"))
    return ops.batch_outcomes(rows.drop("doc_id"), stored).select("url", "outcome", "summary_status", "embedding_status")


@query("junk_rows", f"WITH {NOTICES_SQL} SELECT id, source_label, CASE WHEN id % 17 = 0 THEN '(untitled)' ELSE '' END AS title FROM notices WHERE id % 17 = 0 OR id % 19 = 0")
def junk_rows(spark, path):
    """Some titles are replaced by what junk looks like; a long title that says ``untitled`` stays."""
    i = F.col("id")
    title = F.when(i % 17 == 0, "(untitled)").when(i % 19 == 0, "").when(i % 23 == 0, F.concat("title", F.lit(" untitled masterwork"))).otherwise(F.col("title"))
    return ops.junk(notices(spark, path).withColumn("title", title)).select("id", "source_label", "title")


@query(
    "summary_backfill",
    f"WITH {NOTICES_SQL} SELECT id, strftime(effective_at, '%Y-%m-%d') AS day FROM notices WHERE id % 3 <> 0 AND content IS NOT NULL ORDER BY effective_at DESC NULLS FIRST, id LIMIT 500",
)
def summary_backfill(spark, path):
    rows = notices(spark, path).withColumn("summary", F.when(F.col("id") % 3 == 0, "s"))
    return ops.summary_queue(rows).select("id", day_text("effective_at").alias("day"))


@query(
    "notice_contexts",
    rf"""WITH {NOTICES_SQL}, {QUALITY_SQL},
    d AS (SELECT id, regexp_replace(substring(content, 1, 2000), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', '', 'g') AS solid2 FROM notices),
    ok AS (SELECT s.*, s.quality >= 0.55 AND (length(solid2) < 20 OR length(regexp_replace(solid2, '[^ऀ-ॿ]', '', 'g')) / length(solid2) >= 0.15
      OR length(regexp_replace(solid2, '\P{{L}}', '', 'g')) / length(solid2) >= 0.5) AS readable FROM scored s JOIN d USING (id))
    SELECT o.id, md5(concat_ws(chr(10) || chr(10),
      'NOTICE FACTS:' || chr(10) || '- Issuing source: ' || n.source_label || chr(10) || '- Category: ' || n.category || CASE WHEN n.published_at IS NULL THEN '' ELSE chr(10) || '- Published: ' || strftime(n.published_at, '%Y-%m-%d') END,
      'STRUCTURED METADATA:' || chr(10) || '- language: ' || n.language,
      CASE WHEN o.id % 2 = 0 THEN 'ATTACHED FILES (1){ops.FILES_NOTE}' || chr(10) || '- f.pdf · application/pdf · ' || (o.id % 7 + 1) || ' KB (https://h/f.pdf)' ELSE 'ATTACHED FILES: none.' END,
      CASE WHEN o.id % 3 = 0 THEN 'AI SUMMARY:' || chr(10) || n.urgency END,
      CASE WHEN o.id % 5 = 0 THEN 'KEY POINTS:' || chr(10) || '- ' || n.urgency || chr(10) || '- ' || n.category END,
      CASE WHEN readable AND trim(n.content, ' ') <> '' THEN 'NOTICE TEXT (extracted, may be imperfect):' || chr(10) || substring(trim(n.content, ' '), 1, 6000) END)) AS context
    FROM ok o JOIN notices n ON n.id = o.id""",
)
def notice_contexts(spark, path):
    i = F.col("id")
    file = F.struct(F.lit("f.pdf").alias("name"), F.lit("https://h/f.pdf").alias("url"), F.lit("application/pdf").alias("mime"), ((i % 7 + 1) * 1024).alias("bytes"))
    rows = notices(spark, path).select(
        "id", "source_label", "category", day_text("published_at").alias("published"), F.lit("").alias("url"), F.create_map(F.lit("language"), "language", F.lit("none"), F.lit("")).alias("metadata"),
        F.when(i % 2 == 0, F.array(file)).alias("files"), F.when(i % 3 == 0, F.concat("urgency", F.lit(" "))).alias("summary"), F.lit(None).cast("string").alias("summary_ne"),
        F.when(i % 5 == 0, F.array("urgency", F.lit(" "), "category")).alias("key_facts"), "content",
    )
    return rows.select("id", F.md5(ops.notice_context(text.readable("content"))).alias("context"))


@query(
    "feed_marked_read",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d') WHEN user_id % 7 = 0 THEN '2024-02-01' END AS read_day FROM events""",
)
def feed_marked_read(spark, path):
    feed = table(spark, path, "events").withColumn("read_at", F.when(F.col("event_type") == "view", F.col("ts")))
    return ops.marked_read(feed, F.col("user_id") % 7 == 0, F.expr("timestamp_ntz'2024-02-01 00:00:00'")).select("event_id", day_text("read_at").alias("read_day"))


@query(
    "tokens_revoked",
    """WITH t AS (SELECT user_id AS token, min(ts) AS expires_at, 0 AS n FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-10' GROUP BY 1
      UNION ALL SELECT user_id, max(ts), 1 FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT token, strftime(arg_min(expires_at, (n, expires_at)), '%Y-%m-%d %H:%M:%S') AS expires FROM t WHERE expires_at > TIMESTAMP '2024-01-10' GROUP BY 1""",
)
def tokens_revoked(spark, path):
    e = table(spark, path, "events").select(F.col("user_id").alias("token"), "ts", "event_type")
    now = F.expr("timestamp_ntz'2024-01-10 00:00:00'")
    stored = e.where((F.col("event_type") == "view") & (F.col("ts") > now)).groupBy("token").agg(F.min("ts").alias("expires_at"))
    new = e.where("event_type = 'purchase'").groupBy("token").agg(F.max("ts").alias("expires_at"))
    return ops.live_tokens(stored, new, now).select("token", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query(
    "progress_shown",
    """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 100 WHEN doc_id % 3 = 0 AND doc_id % 30 < 20 THEN 50 WHEN doc_id % 5 = 0 THEN 5 END AS percent,
      CASE WHEN doc_id % 2 = 0 THEN 'live' WHEN doc_id % 3 = 0 AND doc_id % 30 < 20 THEN 'cached' WHEN doc_id % 5 = 0 THEN 'first' END AS origin FROM documents""",
)
def progress_shown(spark, path):
    i = F.col("id")
    ids = table(spark, path, "documents").select(F.col("doc_id").alias("id"))
    now = F.expr("timestamp_ntz'2024-01-10 00:00:00'")
    cached = ids.where(i % 3 == 0).select("id", F.lit(50).alias("percent"), (now - F.make_dt_interval(secs=i % 30)).alias("at"))
    stored = ids.select("id", F.when(i % 5 == 0, F.when(i % 2 == 0, "PENDING").otherwise("PROCESSING")).otherwise("INDEXED").alias("status"))
    return ops.progress_shown(ids, ids.where(i % 2 == 0).select("id", (i % 100).alias("percent")), cached, stored, now, 20)


@query("messages_bounded", "SELECT doc_id AS id, CASE WHEN doc_id % 205 < 200 THEN 1 ELSE doc_id % 205 - 198 END AS first, least(doc_id % 205 + 1, 200) AS n, text = text AS ends FROM documents")
def messages_bounded(spark, path):
    """Lists of up to 204 entries; the text is the one that is added."""
    k = (F.col("doc_id") % 205).cast("int")
    old = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda x: x.cast("string")))
    rows = table(spark, path, "documents").select(F.col("doc_id").alias("id"), k.alias("k"), "text", ops.appended(old, F.col("text")).alias("m"))
    first = F.when(F.col("k") == 0, 1).otherwise(F.get("m", F.lit(0)).try_cast("int"))
    return rows.select("id", first.cast("long").alias("first"), F.size("m").cast("long").alias("n"), (F.element_at("m", -1) == F.col("text")).alias("ends"))


@query("model_inputs", "SELECT doc_id AS id, md5('passage: ' || text) AS passage, md5('query: ' || text) AS question, md5(text) AS plain FROM documents")
def model_inputs(spark, path):
    made = {"passage": ("multilingual-e5-base", False), "question": ("intfloat/E5-large", True), "plain": ("other-model", True)}
    return table(spark, path, "documents").select(F.col("doc_id").alias("id"), *(F.md5(ops.model_input("text", m, q)).alias(c) for c, (m, q) in made.items()))


@query(
    "vectors_upserted",
    """SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN 'second' WHEN vec_id % 3 = 0 THEN 'first' ELSE 'old' END AS title, round(embedding[1]::DOUBLE, 6) AS head FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 3 = 0""",
)
def vectors_upserted(spark, path):
    """The index lacks a fifth; every third vector is written once or twice, and rows without a title are refused."""
    rows = table(spark, path, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = rows.where("id % 5 <> 0").withColumn("title", F.lit("old"))
    thirds = rows.where("id % 3 = 0")
    made = [thirds.select("*", F.lit("first").alias("title"), F.lit(0).alias("position")), thirds.where("id % 2 = 0").select("*", F.lit("second").alias("title"), F.lit(1).alias("position"))]
    refused = rows.where("id % 5 = 0").select("*", F.lit(" ").alias("title"), F.lit(2).alias("position"))
    done = ops.upserted_vectors(index, made[0].unionByName(made[1]).unionByName(refused))
    return done.select("id", "title", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("head"))


@query(
    "hybrid_rescored",
    f"""WITH {DENSE_SQL}, {BM25_SQL},
    k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20),
    u AS (SELECT query_id, id, rank FROM dense_ranked WHERE rank < 20 UNION ALL SELECT q.vec_id, k.id, k.rank FROM k, embeddings q WHERE q.vec_id % 20 = 0),
    m AS (SELECT query_id, id, round(sum(1 / (60 + rank + 1)), 9) AS fused FROM u GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) <= 10),
    s AS (SELECT m.*, coalesce(d.score, fused) AS score FROM m LEFT JOIN dense d USING (query_id, id))
    SELECT query_id, id, fused, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s""",
)
def hybrid_rescored(spark, path):
    """One question in words with every twentieth vector; the fused members in the order of their cosine."""
    docs = table(spark, path, "documents").select(F.col("doc_id").alias("id"), "text")
    questions = asked(spark, path)
    keyword = retrieval.ranked(retrieval.bm25(docs, TERMS).withColumn("q", F.lit(0)), "q", "score", "id", 20).select("id", "rank")
    dense = retrieval.dense_topk(questions, vectors(spark, path), 20).select("query_id", "id", "rank")
    legs = dense.unionByName(questions.select("query_id").crossJoin(F.broadcast(keyword)))
    fused = legs.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.col("rank") + retrieval.FUSION_K + 1)), 9).alias("fused"))
    members = retrieval.ranked(fused, "query_id", "fused", "id", 10).drop("rank")
    return ops.rescored(members, vectors(spark, path), questions)


@query(
    "extracted_answers",
    """WITH s AS (SELECT v.vec_id // 50 AS question, v.vec_id AS position, d.text AS sentence, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
      FROM embeddings v JOIN embeddings q ON q.vec_id = v.vec_id // 50 * 50 JOIN documents d ON d.doc_id = v.vec_id),
    a AS (SELECT * FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY question, lower(substring(sentence, 1, 60)) ORDER BY score DESC, position DESC) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, position DESC) <= 4)
    SELECT question, position, score, md5(sentence) AS sentence, row_number() OVER (PARTITION BY question ORDER BY position) AS place FROM b""",
)
def extracted_answers(spark, path):
    """Fifty vectors a question, the first being its own; the texts of equal ids are the sentences."""
    v = table(spark, path, "embeddings").select(F.col("vec_id").alias("position"), F.floor(F.col("vec_id") / 50).alias("question"), F.col("embedding").alias("vector"))
    q = v.where("position % 50 = 0").select("question", F.col("vector").alias("query"))
    sentences = table(spark, path, "documents").select(F.col("doc_id").alias("position"), F.col("text").alias("sentence"))
    rows = v.join(q, "question").join(sentences, "position").select("question", "position", "sentence", F.round(retrieval.dot("query", "vector"), 6).alias("score"))
    return ops.extracted_answer(rows, floor=0.1).withColumn("sentence", F.md5("sentence")).select("question", "position", "score", "sentence", "place")
