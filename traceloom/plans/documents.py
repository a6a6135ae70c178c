"""Queries over documents, pages and quotes."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import documents as dc
from ..operators import gates
from ..session import spread
from .catalog import query
from .lens import duck, frame, table


@query(
    "content_dedup",
    """WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), f AS (SELECT content_hash, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY ALL)
SELECT h.doc_id, h.content_hash, f.first_id, f.copies FROM h JOIN f USING (content_hash)""",
)
def content_dedup(spark, sf):
    return dc.first_by_content(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "duplicate_contents",
    "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_contents(spark, sf):
    return dc.duplicate_contents(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "source_register",
    """SELECT 'src_' || left(sha256(url || '|' || html), 32) AS id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS publisher,
 sha256(html) AS content_hash, 'family_host_' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS source_family_id FROM pages""",
)
def source_register(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.lit(None).cast("string").alias("title"), F.col("html").alias("body"))
    return dc.register_sources(pages).drop("_body", "title")


@query(
    "relevance_gate",
    """SELECT doc_id, contains(lower(text), 'thesh') OR contains(lower(text), 'eauou') OR contains(lower(text), source) AS relevant FROM documents""",
)
def relevance_gate(spark, sf):
    docs = table(spark, sf, "documents")
    names = F.array(F.lit("Thesh"), F.lit("eauou"), F.lit(None).cast("string"), F.col("source"))
    return docs.select("doc_id", gates.relevant("text", names).alias("relevant"))


TERMS = ["thou erest", "qu leaux", "einen"]
WORDS = [w for w in " ".join(TERMS).split() if len(w) > 3]
HITS_SQL = " + ".join(
    f"CAST((length(piece) - length(replace(piece, '{w}', ''))) / {len(w)} AS BIGINT)" for w in WORDS
)


@query(
    "passages",
    f"""WITH w AS (SELECT doc_id, length(text) AS n, lower(text) AS low, unnest(CASE WHEN length(text) > 16000 THEN range(8000, length(text), 6000) ELSE []::BIGINT[] END) AS s FROM documents),
 p AS (SELECT doc_id, s, least(n, s + 6000) AS e, substring(low, s + 1, least(n, s + 6000) - s) AS piece FROM w),
 h AS (SELECT doc_id, s, e, {HITS_SQL} AS hits FROM p), k AS (SELECT * FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, s) <= 2),
 l AS (SELECT doc_id, list(s || '-' || e ORDER BY s) AS spans FROM k GROUP BY ALL)
SELECT d.doc_id, CASE WHEN length(text) <= 16000 THEN '0-' || length(text) ELSE array_to_string(list_concat(['0-8000'], coalesce(l.spans, [])), ',') END AS spans,
 CASE WHEN length(text) <= 16000 THEN length(text) END AS whole_chars FROM documents d LEFT JOIN l USING (doc_id)""",
)
def passages(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return dc.passages(docs, TERMS).select(
        "doc_id",
        F.array_join(F.transform("spans", lambda w: F.concat(w["s"], F.lit("-"), w["e"])), ",").alias("spans"),
        F.when(F.length("body") <= tx.WHOLE_TEXT, F.length("body").cast("long")).alias("whole_chars"),
    )


def quotes_and_docs(spark, sf):
    quotes = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("quote_id"), F.col("text").alias("quote")
    )
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    return quotes, spread(docs)


@query(
    "quote_exact",
    """SELECT b.item_id AS quote_id, d.doc_id, 'chars ' || (strpos(d.text, b.text) - 1) || ':' || (strpos(d.text, b.text) - 1 + length(b.text)) AS locator
FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
)
def quote_exact(spark, sf):
    found = dc.find_quotes(*quotes_and_docs(spark, sf))
    return found.select("quote_id", "doc_id", tx.char_locator("body", "quote").alias("locator"))


@query(
    "quote_window",
    """SELECT b.item_id AS quote_id, d.doc_id, md5(substring(d.text, greatest(1, strpos(d.text, b.text) - 400), strpos(d.text, b.text) + length(b.text) + 400 - greatest(1, strpos(d.text, b.text) - 400))) AS window_hash
FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
)
def quote_window(spark, sf):
    found = dc.find_quotes(*quotes_and_docs(spark, sf))
    return found.select("quote_id", "doc_id", F.md5(tx.quote_window("body", "quote")).alias("window_hash"))


# every document cites the passage it holds with line breaks and quotes retyped
@query(
    "quote_tolerant",
    """SELECT item_id AS quote_id, doc_id, 'chars ' || (pos - 1) || ':' || (pos - 1 + length(quote)) AS locator
FROM (SELECT item_id, doc_id, b.text AS quote, strpos(d.text, b.text) AS pos FROM benchmark b JOIN documents d ON contains(d.text, b.text)) WHERE quote <> ''""",
)
def quote_tolerant(spark, sf):
    quotes, docs = quotes_and_docs(spark, sf)
    cited = dc.find_quotes(quotes, docs).select("doc_id", "quote_id", "quote")
    retyped = cited.withColumn(
        "quote", F.translate(F.regexp_replace("quote", r"\s+", "  "), "-'", "–’")
    )
    return dc.quote_in_document(retyped, docs, "doc_id").select("quote_id", "doc_id", "locator")


@query(
    "span_gate",
    """SELECT d.doc_id, b.item_id AS quote_id, CASE WHEN b.text = '' THEN 'span_empty'
 WHEN NOT contains(d.text, b.text) THEN 'span_not_found' END AS reason FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id % (SELECT count(*) FROM benchmark)""",
)
def span_gate(spark, sf):
    quotes, docs = quotes_and_docs(spark, sf)
    n = quotes.agg(F.count("*").alias("n"))
    dealt = quotes.join(n).withColumn("slot", F.col("quote_id") % F.col("n")).drop("n")
    rows = docs.join(n).withColumn("slot", F.col("doc_id") % F.col("n")).join(dealt, "slot")
    return rows.select("doc_id", "quote_id", gates.span_gate("quote", "body").alias("reason"))


@query(
    "unique_quotes",
    """SELECT doc_id, CASE WHEN strpos(text, q) = 0 OR strpos(substring(text, strpos(text, q) + 1), q) > 0 THEN 'span_not_found' END AS reason
FROM (SELECT doc_id, text, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS q FROM documents) WHERE q <> ' '""",
)
def unique_quotes(spark, sf):
    docs = table(spark, sf, "documents")
    words = F.split("text", " ")
    quote = F.concat(
        F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")),
        F.lit(" "),
        F.coalesce(F.try_element_at(words, F.lit(3)), F.lit("")),
    )
    rows = docs.select("doc_id", "text", quote.alias("q")).where("q <> ' '")
    return rows.select("doc_id", gates.unique_quote_rejection("q", "text").alias("reason"))


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"
# addresses of every kind derived from the page addresses
URLS = """SELECT page_id, 0 AS form, url FROM {pages}
UNION ALL SELECT page_id, 1, replace(url, '://', '://user@') FROM {pages}
UNION ALL SELECT page_id, 2, concat('https://10.0.0.', CAST(page_id % 256 AS STRING), '/p') FROM {pages}
UNION ALL SELECT page_id, 3, replace(replace(url, '.example.com', '.local'), '.example.net', '.reddit.com') FROM {pages}
UNION ALL SELECT page_id, 4, replace(url, 'http', 'ftp') FROM {pages}
UNION ALL SELECT page_id, 5, concat('https://www.youtube.com/watch?v=', CAST(page_id AS STRING)) FROM {pages}
UNION ALL SELECT page_id, 6, concat('https://intranet', CAST(page_id AS STRING), '/') FROM {pages}"""


@query(
    "url_filter",
    f"""SELECT page_id, form, regexp_matches(url, '^https?://') AND contains({HOST_SQL}, '.') AND NOT contains({HOST_SQL}, '@')
 AND NOT regexp_matches({HOST_SQL}, '\\.(localhost|local|internal|test|invalid|example)$') AND NOT regexp_matches({HOST_SQL}, '^[0-9]+(\\.[0-9]+)+$') AS public FROM ({duck(URLS)})""",
)
def url_filter(spark, sf):
    return frame(spark, sf, URLS).select("page_id", "form", urls.public_url("url").alias("public"))


@query(
    "skipped_hosts",
    f"""SELECT page_id, form, regexp_matches('.' || regexp_replace({HOST_SQL}, '^.*@', ''), '\\.(youtube\\.com|youtu\\.be|facebook\\.com|instagram\\.com|tiktok\\.com|x\\.com|twitter\\.com|pinterest\\.com|reddit\\.com|news\\.ycombinator\\.com|quora\\.com|linkedin\\.com)$') AS skipped FROM ({duck(URLS)})""",
)
def skipped_hosts(spark, sf):
    return frame(spark, sf, URLS).select("page_id", "form", urls.skipped_host("url").alias("skipped"))


# one hit per page and query; the query is the page's word of the day
HITS = """SELECT replace(url, '.example.org', '.wikipedia.org') AS url, page_id AS pos, concat('q', CAST(page_id % 7 AS STRING)) AS query FROM {pages}
UNION ALL SELECT replace(url, '.example.org', '.wikipedia.org'), 1000000000 + page_id, concat('q', CAST(page_id % 5 AS STRING)) FROM {pages} WHERE page_id % 3 = 0
UNION ALL SELECT concat('https://www.youtube.com/', CAST(page_id AS STRING)), 2000000000 + page_id, 'video' FROM {pages}"""
RANK_SQL = f"""SELECT url, count(*) AS repeats, min(pos) AS pos, arg_min(query, pos) AS query,
 count(*) + CASE WHEN contains({HOST_SQL}, 'wikipedia.org') THEN 2 ELSE 0 END + CASE WHEN contains(regexp_replace({HOST_SQL}, '[^a-z0-9]', '', 'g'), 'blog') THEN 2 ELSE 0 END AS score
FROM ({duck(HITS)}) WHERE NOT contains(url, 'youtube') GROUP BY url"""


@query("host_rank", RANK_SQL)
def host_rank(spark, sf):
    return dc.rank_hits(frame(spark, sf, HITS), "Blog!")


@query(
    "per_host_cap",
    f"""WITH r AS ({RANK_SQL}), h AS (SELECT url, score, pos, row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY score DESC, pos) AS host_rank FROM r)
SELECT url, score, host_rank FROM h WHERE host_rank <= 2 ORDER BY score DESC, pos LIMIT 60""",
)
def per_host_cap(spark, sf):
    out = dc.cap_per_host(dc.rank_hits(frame(spark, sf, HITS), "Blog!"), budget=60)
    return out.select("url", "score", F.col("host_rank").cast("long").alias("host_rank"))


PAGES = "SELECT page_id AS pos, page_id % 5 AS task, url, coalesce(nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), url) AS title, CASE WHEN page_id % 11 = 0 THEN NULL ELSE html END AS body FROM {pages}"


@query(
    "page_rank",
    f"""WITH p AS ({duck(PAGES)}), s AS (SELECT *, CASE WHEN regexp_matches(lower(url || ' ' || title), 'datasheet|docs\\.|documentation|\\.pdf|product-brief|spec') THEN 3 ELSE 0 END
 + CASE WHEN contains(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '[^a-z0-9]', '', 'g'), 'thther') THEN 2 ELSE 0 END
 + CASE WHEN contains(lower(title), 'the') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(lower(url || ' ' || title), 'shop|buy|cart|price|deals|review|best-|top-|blog|refurbished|/product/|forum') THEN 2 ELSE 0 END
 - CASE WHEN body IS NULL THEN 1 ELSE 0 END AS score FROM p)
SELECT task, url, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 10""",
)
def page_rank(spark, sf):
    out = dc.rank_pages(
        frame(spark, sf, PAGES), ["task"], 10, source_types=["datasheet"], product="The", company="Thther"
    )
    return out.select("task", "url", "score", F.col("rank").cast("long").alias("rank"))


# labels built from part rows: tokens with digits, units and plain words
LABELS = "SELECT p_partkey AS id, concat(p_name, ' mk', CAST(p_size AS STRING), ' of ', CAST(p_size AS STRING), 'gb ', lower(p_type), ' p', CAST(p_partkey AS STRING), 'x') AS label FROM {part}"


@query(
    "part_tokens",
    f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(label, '[a-z0-9]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[0-9]+(gb)?$')))), ',') AS tokens FROM ({duck(LABELS)})""",
)
def part_tokens(spark, sf):
    rows = frame(spark, sf, LABELS)
    return rows.select("id", F.array_join(F.sort_array(tx.part_tokens("label")), ",").alias("tokens"))


@query(
    "word_tokens",
    f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(label, '[a-z0-9]+'), lambda t: t NOT IN ('the','and','for','with','of','a','an','in','on','to')))), ',') AS tokens FROM ({duck(LABELS)})""",
)
def word_tokens(spark, sf):
    rows = frame(spark, sf, LABELS)
    return rows.select("id", F.array_join(F.sort_array(tx.word_tokens("label")), ",").alias("tokens"))


# documents in four languages, folded with full Unicode rules
@query("label_normalize")
def label_normalize(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("label"))
    return tx.with_label_key(docs, "label", "label_key").select("doc_id", "label_key")


CLASS_WORDS = "['screen panel','usb 3 ports','camera lens','driver blob','charger kit','battery cell','frame','modem','pmic chip','plain steel']"


@query(
    "assembly_class",
    f"""WITH l AS (SELECT p_partkey AS id, p_name || ' ' || ({CLASS_WORDS})[CAST(p_partkey % 10 + 1 AS BIGINT)] AS label FROM part)
SELECT id, CASE CAST(id % 10 AS INT) WHEN 0 THEN 'display' WHEN 2 THEN 'camera' WHEN 5 THEN 'battery' WHEN 6 THEN 'enclosure' WHEN 7 THEN 'connectivity' WHEN 8 THEN 'silicon' ELSE 'other' END AS assembly,
 id % 10 = 3 AS software, id % 10 = 1 AS interface, id % 10 = 4 AS accessory FROM l""",
)
def assembly_class(spark, sf):
    words = CLASS_WORDS.replace("[", "array(").replace("]", ")")
    rows = frame(
        spark,
        sf,
        f"SELECT p_partkey AS id, concat(p_name, ' ', element_at({words}, CAST(p_partkey % 10 + 1 AS INT))) AS label FROM {{part}}",
    )
    return rows.select(
        "id",
        tx.assembly_of("label").alias("assembly"),
        tx.software_artifact("label").alias("software"),
        tx.interface_feature("label").alias("interface"),
        tx.accessory("label").alias("accessory"),
    )
