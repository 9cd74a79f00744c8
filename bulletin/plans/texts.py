"""Queries of text, URL and date functions and of keyword search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import chunking, crawl, keyword
from ..sources.tables import NOTICES_SQL, day_text, notices, table
from .registry import query


def docs(spark, path):
    return table(spark, path, "documents").select(F.col("doc_id").alias("id"), "text")


@query("text_clean", r"SELECT doc_id AS id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS cleaned FROM documents")
def text_clean(spark, path):
    return docs(spark, path).select("id", text.clean("text").alias("cleaned"))


@query(
    "text_normalised",
    r"""SELECT doc_id AS id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\f', chr(10) || chr(10), 'g'),
      '[\x{200B}-\x{200F}\x{FEFF}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
)
def text_normalised(spark, path):
    return docs(spark, path).select("id", F.md5(text.normalised("text")).alias("digest"))


@query(
    "storable_rows",
    f"""WITH {NOTICES_SQL} SELECT source_label, count(*) AS n FROM notices
    WHERE length(title) >= 8 AND lower(trim(title)) <> '(untitled)' AND length(regexp_replace(title, '[^A-Za-zऄ-ॿ]', '', 'g')) >= 5 GROUP BY 1""",
)
def storable_rows(spark, path):
    return notices(spark, path).where(text.storable_title("title")).groupBy("source_label").agg(F.count(F.lit(1)).alias("n"))


SQUEEZED = "array_to_string(list_filter(string_split({c}, ''), lambda x, i: i = 1 OR x <> string_split({c}, '')[i - 1]), '')"


@query(
    "small_talk",
    rf"""WITH q AS (SELECT conv_id, turn, text, trim(regexp_replace(regexp_replace(lower(text), '[^a-zऀ-ॿ\s]+', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'),
    known AS (SELECT {SQUEEZED.format(c="p")} AS p FROM (SELECT unnest([{", ".join(repr(p) for p in text.GREETINGS)}]) AS p))
    SELECT conv_id, turn, length(text) <= 40 AND {SQUEEZED.format(c="t")} IN (SELECT p FROM known) AS small FROM q
    UNION ALL SELECT -1, row_number() OVER (ORDER BY p), true FROM (SELECT unnest([{", ".join(repr(p) for p in text.GREETINGS)}]) AS p)""",
)
def small_talk(spark, path):
    """All questions asked, and the greetings themselves, which the tables do not hold, in capitals and with signs."""
    asked = table(spark, path, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    greetings = spark.createDataFrame([(-1, i + 1, f"{p.upper()}!!") for i, p in enumerate(sorted(text.GREETINGS))], "conv_id long, turn long, text string")
    return asked.unionByName(greetings).select("conv_id", "turn", text.small_talk("text").alias("small"))


@query("slugs", f"WITH {NOTICES_SQL} SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM notices")
def slugs(spark, path):
    return notices(spark, path).select("id", text.ascii_slug("title").alias("slug"))


@query("truncated", "SELECT doc_id AS id, CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END AS short FROM documents")
def truncated(spark, path):
    return docs(spark, path).select("id", text.truncated("text", 80).alias("short"))


@query(
    "trimmed_words",
    """WITH h AS (SELECT doc_id AS id, text, substring(text, 1, 100) AS head FROM documents),
    p AS (SELECT *, instr(reverse(head), ' ') AS r FROM h)
    SELECT id, CASE WHEN length(text) <= 100 THEN text ELSE rtrim(CASE WHEN r > 0 AND 100 - r > 60 THEN substring(head, 1, 100 - r) ELSE head END, ' ') || '…' END AS short FROM p""",
)
def trimmed_words(spark, path):
    return docs(spark, path).select("id", text.trimmed_words("text", 100).alias("short"))


@query(
    "sentence_units",
    r"""WITH d AS (SELECT doc_id AS id, 'Facts of the announcement:' || chr(10) || text || chr(10) || '- fact: ' || text AS text FROM documents),
    l AS (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)))) AS line FROM d),
    s AS (
      SELECT id, regexp_replace(line, '^[-•●▪]\s*', '') AS s FROM l WHERE regexp_matches(line, '^[-•●▪]')
      UNION ALL SELECT id, s FROM (SELECT id, unnest(list_transform(string_split(regexp_replace(line, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' '))) AS s FROM l
        WHERE NOT regexp_matches(line, '^[-•●▪]') AND NOT ends_with(line, ':')) WHERE NOT regexp_matches(s, '^\p{Ll}'))
    SELECT id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM s WHERE length(s) >= 25 GROUP BY 1""",
)
def sentence_units(spark, path):
    """The texts with a heading before them, and once more with a bullet before their first line."""
    whole = F.concat(F.lit("Facts of the announcement:\n"), "text", F.lit("\n- fact: "), "text")
    rows = docs(spark, path).select("id", F.explode(text.sentences(whole)).alias("s"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query(
    "paragraph_dedupe",
    r"""WITH d AS (SELECT doc_id AS id, text || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
    p AS (SELECT id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pos FROM d),
    k AS (SELECT *, trim(regexp_replace(p, '\s+', ' ', 'g')) AS key FROM p),
    f AS (SELECT * FROM k QUALIFY length(key) < 24 OR row_number() OVER (PARTITION BY id, key ORDER BY pos) = 1)
    SELECT id, count(*) AS paragraphs, md5(string_agg(p, chr(10) || chr(10) ORDER BY pos)) AS digest FROM f GROUP BY id""",
)
def paragraph_dedupe(spark, path):
    """The texts hold no blank lines: each is followed by itself with its lines as paragraphs."""
    twice = docs(spark, path).withColumn("text", F.concat("text", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return chunking.deduped_paragraphs(twice, "id", "text").select("id", "paragraphs", F.md5("text").alias("digest"))


@query(
    "keyword_terms",
    r"""WITH t AS (SELECT conv_id, turn, unnest(string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}\s]+', ' ', 'g')), '\s+')) AS w FROM conversations WHERE role = 'user')
    SELECT w AS term, count(*) AS n FROM t WHERE length(w) > 2 GROUP BY 1 ORDER BY n DESC, term LIMIT 100""",
)
def keyword_terms(spark, path):
    asked = table(spark, path, "conversations").where("role = 'user'")
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\p{M}\s]+", " ")), r"\s+")
    rows = asked.select(F.explode(words).alias("term")).where("length(term) > 2")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(100)


URL_SQL = r"""
u AS (
  SELECT page_id, 'HTTPS://WWW.' || upper(regexp_extract(url, '//([^/]+)', 1)) || '/' || regexp_extract(url, '//[^/]+/([^?#]*)', 1) || '/?b=2&a=' || page_id || '#top' AS url FROM pages)
"""


def page_urls(spark, path):
    host, rest = F.regexp_extract("url", "//([^/]+)", 1), F.regexp_extract("url", "//[^/]+/([^?#]*)", 1)
    return table(spark, path, "pages").select(
        "page_id", F.concat(F.lit("HTTPS://WWW."), F.upper(host), F.lit("/"), rest, F.lit("/?b=2&a="), F.col("page_id").cast("string"), F.lit("#top")).alias("url")
    )


@query(
    "url_normalize",
    f"""WITH {URL_SQL} SELECT page_id, 'https://' || lower(regexp_extract(url, '//([^/]+)', 1)) || regexp_replace('/' || regexp_extract(url, '//[^/]+/([^?#]*)', 1), '/+$', '') ||
      '?a=' || page_id || '&b=2' AS url, regexp_replace(lower(regexp_extract(url, '//([^/]+)', 1)), '^www\\.', '') AS host FROM u""",
)
def url_normalize(spark, path):
    return page_urls(spark, path).select("page_id", urls.normalised("url").alias("url"), urls.host("url").alias("host"))


_names = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
BASE = "https://www.example.com/notices"
REASON_SQL = rf"""
u AS (SELECT page_id, url, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS netloc, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
      lower(regexp_extract(url, '//[^/?#]*([^?#]*)', 1)) AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s, regexp_replace(split_part(netloc, ':', 1), '^www\.', '') AS host,
      list_transform(list_filter(string_split(query, '&'), lambda k: k <> ''), lambda k: lower(split_part(k, '=', 1))) AS keys FROM u),
r AS (SELECT *, CASE WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'scheme'
  WHEN len(list_filter({_names(urls.OFFSITE)}, lambda h: contains(netloc, h))) > 0 THEN 'offsite'
  WHEN host <> '' AND NOT (host = 'example.com' OR ends_with(host, '.example.com') OR ends_with('example.com', '.' || host)) THEN 'other host'
  WHEN regexp_replace(split_part(url, '#', 1), '/+$', '') IN ('', '{BASE}') THEN 'listing'
  WHEN len(s) = 0 AND query = '' THEN 'home page' WHEN regexp_matches(path, '{urls.FILES}') THEN 'file'
  WHEN len(s) <= 2 AND s[1] IN {tuple(urls.TAXONOMY)} THEN 'taxonomy' WHEN s[len(s)] IN {tuple(urls.STATIC)} THEN 'static'
  WHEN len(s) = 0 THEN 'query only'
  WHEN len(list_filter(keys, lambda k: starts_with(k, 'search') OR starts_with(k, 'filter') OR k IN {tuple(urls.FILTER_KEYS)})) > 0 THEN 'filter' ELSE 'article' END AS reason FROM s)
"""


@query("article_url_reason", f"WITH {REASON_SQL} SELECT page_id, reason FROM r")
def article_url_reason(spark, path):
    return table(spark, path, "pages").select("page_id", urls.article_reason("url", F.lit(BASE)).alias("reason"))


@query(
    "article_share",
    rf"""WITH u AS (SELECT regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '//[^/?#]*([^?#]*)', 1)) AS path FROM pages)
    SELECT host, count(*) AS pages, round(avg(CASE WHEN regexp_matches(path, '[0-9]{{3}}|{"|".join(crawl.ARTICLE_WORDS)}') THEN 1.0 ELSE 0.0 END), 6) AS share FROM u GROUP BY host""",
)
def article_share(spark, path):
    """Share of each host's addresses that look like articles."""
    rows = table(spark, path, "pages").select(F.regexp_replace(F.lower(F.regexp_extract("url", "//([^/?#]*)", 1)), r"^www\.", "").alias("host"), crawl.article_like("url").alias("like"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(F.col("like").cast("double")), 6).alias("share"))


_exact = "CASE replace(x, '_', '-') " + " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in urls.CATEGORY_WORDS.items()) + " END"
_inside = "CASE WHEN length(x) < 30 THEN CASE " + " ".join(f"WHEN contains(replace(x, '_', '-'), '{w}') THEN '{c}'" for w, c in urls.CATEGORY_WORDS.items()) + " END END"


@query(
    "slug_category",
    rf"""WITH s AS (SELECT list_filter(string_split(lower(regexp_extract(url, '//[^/]+([^?#]*)', 1)), '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '\d+')) AS s FROM pages),
    m AS (SELECT list_filter(list_transform(s, lambda x: coalesce({_exact}, {_inside})), lambda c: c IS NOT NULL)[1] AS category FROM s)
    SELECT coalesce(category, '(none)') AS category, count(*) AS n FROM m GROUP BY 1""",
)
def slug_category(spark, path):
    rows = table(spark, path, "pages").select(F.coalesce(urls.category("url"), F.lit("(none)")).alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "same_origin",
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '//([^/:]+)', 1)), '^www\.', '') = 'site1.example' AS same FROM pages""",
)
def same_origin(spark, path):
    return table(spark, path, "pages").select("page_id", urls.same_origin("url", F.lit("https://www.site1.example/x")).alias("same"))


@query(
    "pager_urls",
    """SELECT page_id, CASE WHEN page_id % 4 <= 1 OR page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || page_id % 4
      ELSE regexp_replace(url, '/+$', '') || '/page/' || page_id % 4 END AS next, CASE WHEN page_id % 4 > 1 AND page_id % 3 <> 0 THEN page_id % 4 END AS number
    FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages)""",
)
def pager_urls(spark, path):
    i = F.col("page_id")
    kind = F.when(i % 3 == 0, "none").when(i % 3 == 1, "query").otherwise("path")
    rows = table(spark, path, "pages").withColumn("url", F.substring_index("url", "?", 1)).select("page_id", urls.paginated("url", kind, i % 4).alias("next"))
    return rows.withColumn("number", urls.page_number("next"))


@query(
    "date_parse_multi",
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
def date_parse_multi(spark, path):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    written = (
        F.when(k % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 1, F.date_format(d, "MMMM d, yyyy")).when(k % 5 == 2, F.date_format(d, "d MMM yyyy"))
        .when(k % 5 == 3, F.translate(F.date_format(d, "yyyy-MM-dd"), "0123456789", dates.DEVANAGARI_DIGITS)).otherwise(F.date_format(d, "  yyyy.MM.dd "))
    )
    return table(spark, path, "orders").select(k.alias("id"), day_text(dates.plausible(dates.parsed(written), "2030-01-01")).alias("day"))


@query(
    "relative_time",
    """WITH t AS (SELECT event_id, ts, floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 1e6)::BIGINT AS s, epoch(TIMESTAMP '2024-01-31')::BIGINT - floor(epoch(ts))::BIGINT AS q FROM events)
    SELECT event_id, CASE WHEN q < 60 THEN 'just now' WHEN q < 3600 THEN q // 60 || 'm ago' WHEN q < 86400 THEN q // 3600 || 'h ago' WHEN q < 604800 THEN q // 86400 || 'd ago'
      ELSE strftime(ts, '%Y-%m-%d') END AS label FROM t""",
)
def relative_time(spark, path):
    return table(spark, path, "events").select("event_id", dates.ago("ts", "2024-01-31 00:00:00").alias("label"))


NOW = "2024-09-01 10:30:00"
SEARCH_SQL = """
SELECT id, category, substring(content, 1, 200) AS summary, title, content, effective_at FROM notices"""


def searchable(spark, path):
    return notices(spark, path).withColumn("summary", F.substring("content", 1, 200))


@query(
    "keyword_search_ranked",
    f"""WITH {NOTICES_SQL}, n AS ({SEARCH_SQL}),
    f AS (SELECT * FROM n WHERE contains(lower(title || ' ' || content), 'tion') OR contains(lower(title || ' ' || content), 'erth') ORDER BY effective_at DESC, id DESC LIMIT 60),
    s AS (SELECT *, 3 * (contains(lower(title), 'tion')::INT + contains(lower(title), 'erth')::INT) + 2 * (contains(lower(summary), 'tion')::INT + contains(lower(summary), 'erth')::INT) AS score FROM f)
    SELECT id, score::BIGINT AS score FROM s WHERE score > 0 OR (SELECT max(score) FROM s) = 0 ORDER BY score DESC, effective_at DESC, id DESC LIMIT 10""",
)
def keyword_search_ranked(spark, path):
    return keyword.search(searchable(spark, path), keyword.intent(spark, "show notices about tion and erth", NOW)).select("id", "score")


@query(
    "keyword_relaxation",
    f"""WITH {NOTICES_SQL} SELECT id, 1::BIGINT AS step FROM notices WHERE effective_at::DATE BETWEEN DATE '2024-08-25' AND DATE '2024-09-01'
      AND contains(lower(content), 'the') AND NOT EXISTS (SELECT 1 FROM notices WHERE category = 'JUDGEMENT')
    ORDER BY effective_at DESC, id DESC LIMIT 10""",
)
def keyword_relaxation(spark, path):
    asked = keyword.Intent(["the"], True, "JUDGEMENT", (dt.date(2024, 8, 25), dt.date(2024, 9, 1)))
    rows = searchable(spark, path).withColumns({"title": F.lit(""), "summary": F.lit("")})
    return keyword.relaxed(rows, asked).select("id", "step")


_listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
#: Words put before the texts, which have none of them, and the days they name on 1 September 2024.
PHRASES = [
    ("latest tender notices", None, None, None), ("news since 2024-02-29", None, "2024-02-29", None), ("jobs after feb 30", None, None, None),
    ("circulars before march 3rd, 2023", None, None, "2023-03-03"), ("bids between 5 may and apr. 7", None, "2024-04-07", "2024-05-05"),
    ("how many came yesterday", "2024-08-31", "2024-08-01", "2024-09-03"), ("upcoming vacancies today", "2024-09-01", "2024-08-02", "2024-09-04"),
    ("job news of the last 12 days", None, "2024-08-20", None), ("past month market decision", None, "2024-08-02", None),
    ("what happened december 20", "2023-12-20", "2023-11-20", "2023-12-23"), ("flood 2 then sept 3", "2024-09-03", "2024-08-04", "2024-09-06"),
    ("procurement until 2024/13/01 in previous week", None, "2024-08-25", None), ("internship may", None, None, None),
]


@query(
    "question_intents",
    rf"""WITH p AS (SELECT unnest({[x[0] for x in PHRASES]}) AS phrase, unnest(range({len(PHRASES)})) AS k,
        unnest({[x[1] or '' for x in PHRASES]}) AS as_of, unnest({[x[2] or '' for x in PHRASES]}) AS date_from, unnest({[x[3] or '' for x in PHRASES]}) AS date_to),
    q AS (SELECT conv_id, turn, phrase || ' ' || text AS question, nullif(as_of, '') AS as_of, nullif(date_from, '') AS date_from, nullif(date_to, '') AS date_to
      FROM conversations JOIN p ON k = (conv_id + turn) % {len(PHRASES)} WHERE role = 'user'),
    w AS (SELECT *, list_filter(string_split(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM q),
    c AS (SELECT *, MAP {keyword.CATEGORY_OF}[list_filter(words, lambda x: list_contains({_listed(keyword.CATEGORY_OF)}, x))[1]] AS category FROM w),
    t AS (SELECT *, list_filter(words, lambda x: length(x) > 2 AND NOT list_contains({_listed(keyword.STOP + keyword.RECENT)}, x)
        AND NOT (coalesce(as_of, date_from, date_to) IS NOT NULL AND list_contains({_listed([*dates.MONTHS, "yesterday", "today"])}, x))
        AND NOT (category IS NOT NULL AND coalesce(MAP {keyword.CATEGORY_OF}[x] = category, false))) AS kept FROM c)
    SELECT conv_id, turn, list_filter(kept, lambda x, i: list_position(kept, x) = i) AS terms, len(list_filter(words, lambda x: list_contains({_listed(keyword.RECENT)}, x))) > 0 AS recent, category,
      as_of, date_from, date_to FROM t""",
)
def question_intents(spark, path):
    """What every question asks for: terms, recency, category and days, with phrases of these put before the texts."""
    turn = (F.col("conv_id") + F.col("turn")) % len(PHRASES)
    phrase = F.element_at(F.array(*[F.lit(x[0]) for x in PHRASES]), (turn + 1).cast("int"))
    questions = table(spark, path, "conversations").where("role = 'user'").withColumn("question", F.concat_ws(" ", phrase, "text"))
    i = questions.select("conv_id", "turn", keyword.asked("question", NOW).alias("i"))
    days = [F.col(f"i.window.{c}").cast("string").alias(c) for c in ("as_of", "date_from", "date_to")]
    return i.select("conv_id", "turn", "i.terms", "i.recent", "i.category", *days)
