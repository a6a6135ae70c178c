"""Document reuse, quote search, passages and page ranking."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..session import materialize
from .running import HOT_ROWS, first_per_key, spread_totals, top_per_key

SHINGLE = 3


def register_sources(pages: DataFrame) -> DataFrame:
    """Source rows of fetched pages: content hash, publisher family and the private body."""
    publisher = urls.host_of("url")
    return pages.select(
        F.concat(F.lit("src_"), F.left(F.sha2(F.concat_ws("|", "url", "body"), 256), F.lit(32))).alias("id"),
        "url",
        F.coalesce("title", "url").alias("title"),
        publisher.alias("publisher"),
        F.sha2("body", 256).alias("content_hash"),
        F.concat(F.lit("family_host_"), publisher).alias("source_family_id"),
        F.col("body").alias("_body"),
    )


def first_by_content(docs: DataFrame, id_col, body) -> DataFrame:
    """Each document with the first document holding the same body.

    Bodies are hashed before anything is shuffled, and the first id per hash is a combinable
    minimum, so a body copied a billion times costs one row per map task.
    """
    hashed = docs.select(id_col, F.sha2(body, 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(
        F.min(id_col).alias("first_id"), F.count("*").alias("copies")
    )
    return hashed.join(first, "content_hash")


def duplicate_contents(docs: DataFrame, id_col, body) -> DataFrame:
    """Contents stored more than once: the copies and the first id."""
    hashed = docs.select(id_col, F.sha2(body, 256).alias("content_hash"))
    return (
        hashed.groupBy("content_hash")
        .agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"))
        .where("copies > 1")
    )


def reusable_findings(findings: DataFrame, analysed: DataFrame, targets: DataFrame) -> DataFrame:
    """Findings of a body already analysed, re-targeted: the implied object is named after the
    first target and rejected findings are left out.

    `analysed` has content_hash, first_target_label and first_target_kind; `targets` lists the
    further (content_hash, target_id) questions.
    """
    return (
        findings.where("rejection is null")
        .join(analysed, "content_hash")
        .join(targets, "content_hash")
        .withColumn("object_kind", F.when(F.col("object_label").isNull(), F.col("first_target_kind")).otherwise(F.col("object_kind")))
        .withColumn("object_label", F.coalesce("object_label", "first_target_label"))
        .drop("first_target_label", "first_target_kind")
    )


def quote_in_document(quotes: DataFrame, docs: DataFrame, key) -> DataFrame:
    """Quotes that name their document: the verbatim span, exact or tolerant, with its locator."""
    joined = quotes.join(docs, key)
    exact = F.contains(F.col("body"), F.col("quote"))
    # an exact hit needs no normalised copy of the text
    hit = joined.where(exact).withColumn("span", F.col("quote"))
    rest = joined.where(~exact).withColumn("span", tx.locate_quote("body", "quote"))
    rows = hit.unionByName(rest.where("span is not null"))
    return rows.withColumn("locator", tx.char_locator("body", "span")).drop("body")


def _words(text):
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _shingles(words):
    """Hashes of every three consecutive words. `words` must name a column: an expression would be
    evaluated again for every position."""
    words = F.col(words)
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - SHINGLE),
            lambda i: F.xxhash64(*[F.get(words, i + n) for n in range(SHINGLE)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def find_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, doc_id) of every document that contains a quote verbatim, without a cross join.

    A quote's interior words are whole words of any text that contains it, so every such text holds
    each three-word shingle of them. Each quote is looked up by its rarest shingle and every hit is
    verified on the whole text. Quotes with fewer than three interior words are looked up through
    the vocabulary instead: a text that contains the quote has a word that contains its longest
    word.
    """
    split = quotes.select("quote_id", "quote", _words(F.col("quote")).alias("words"))
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    split = split.withColumn("inner", inner)
    keyed = split.select("quote_id", "quote", _shingles("inner").alias("keys"), "words")
    long_keys = keyed.where(F.size("keys") > 0).select("quote_id", F.explode(F.array_distinct("keys")).alias("key"))
    doc_words = docs.select("doc_id", _words(F.col("body")).alias("words"))
    doc_keys = doc_words.select("doc_id", F.explode(F.array_distinct(_shingles("words"))).alias("key"))
    matched = materialize(
        doc_keys.join(long_keys.select("key").distinct(), "key", "left_semi")
    )
    seen_in = matched.groupBy("key").agg(F.count("*").alias("n"))
    rarest = long_keys.join(seen_in, "key", "left").groupBy("quote_id").agg(
        F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key")
    )
    candidates = rarest.join(matched, "key").select("quote_id", "doc_id")
    short = materialize(keyed.where(F.size("keys") == 0).select("quote_id", "quote", "words"))
    if not short.isEmpty():
        candidates = candidates.union(_by_vocabulary(short, docs))
    checked = candidates.join(quotes.select("quote_id", "quote"), "quote_id").join(
        docs.select("doc_id", "body"), "doc_id"
    )
    return checked.where(F.contains("body", F.col("quote")))


def _by_vocabulary(short, docs, q=3):
    """Candidates of short quotes: documents with a word that contains the quote's longest word."""
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    picked = short.where(F.size("words") > 0).select("quote_id", longest.alias("part"))
    tokens = docs.select("doc_id", F.explode(F.array_distinct(_words(F.col("body")))).alias("word"))
    vocabulary = tokens.select("word").distinct()

    def grams(n):
        return vocabulary.where(F.length("word") >= n).select(
            "word",
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(1), F.length("word") - n + 1),
                        lambda i: F.substring("word", i, F.lit(n)),
                    )
                )
            ).alias("gram"),
        )

    table = grams(1)
    for n in range(2, q + 1):
        table = table.union(grams(n))
    picked = picked.withColumn("gram", F.substring("part", F.lit(1), F.least(F.length("part"), F.lit(q))))
    words = picked.join(table, "gram").where(F.contains("word", F.col("part"))).select("quote_id", "word").distinct()
    return words.join(tokens, "word").select("quote_id", "doc_id").distinct()


def passages(docs: DataFrame, terms) -> DataFrame:
    """The passages of each document worth reading for the terms."""
    low = docs.withColumn("__low", F.lower("body"))
    spans = low.withColumn("spans", tx.passage_spans("body", "__low", terms)).drop("__low")
    return spans.withColumn("passages", tx.passage_text("body", F.col("spans")))


def rank_hits(hits: DataFrame, brand=None) -> DataFrame:
    """Search hits folded to one row per address: repeats, preferred hosts and brand host score;
    the first query and position are kept. Ranks come from a global sort on the folded rows."""
    kept = hits.where(~urls.skipped_host("url"))
    folded = kept.groupBy("url").agg(
        F.count("*").alias("repeats"),
        F.min("pos").alias("pos"),
        F.min_by("query", "pos").alias("query"),
    )
    return folded.withColumn("score", F.col("repeats") + urls.hit_bonus("url", brand))


def cap_per_host(ranked: DataFrame, budget, per_host=2, run=(), fetched=None) -> DataFrame:
    """At most `per_host` pages per host and `budget` pages per run, best first."""
    if fetched is not None:
        ranked = ranked.join(fetched.select("url"), "url", "left_anti")
    order = [F.col("score").desc(), "pos"]
    hosted = top_per_key(
        ranked.withColumn("host", urls.host_of("url")), [*run, "host"], order, per_host, "host_rank"
    )
    if run:
        return top_per_key(hosted, list(run), order, budget, "fetch_rank")
    return hosted.orderBy(*order).limit(budget)


def rank_pages(pages: DataFrame, by, k, **wanted) -> DataFrame:
    """The best `k` pages per key by source type, first-party host and product mention."""
    scored = pages.withColumn("score", urls.page_score("url", "title", "body", **wanted))
    return top_per_key(scored, list(by), [F.col("score").desc(), "pos"], k)


def distinct_queries(queries: DataFrame, by, k, key) -> DataFrame:
    """Planned queries before templates, one per normalised text, first `k` per run."""
    keyed = queries.withColumn("query_key", key(F.col("query"))).where("query_key <> ''")
    first = first_per_key(keyed, [*by, "query_key"], ["source_rank", "pos"])
    return top_per_key(first, list(by), ["source_rank", "pos"], k)


def seed_urls(sources: DataFrame, by, k=10) -> DataFrame:
    """The first `k` distinct public addresses an estimate cites, in citation order."""
    public = sources.where(urls.public_url("url"))
    first = public.groupBy(*by, "url").agg(F.min("pos").alias("pos"))
    return top_per_key(first, list(by), ["pos"], k)


def evidence_ids(evidence: DataFrame, by=("run_id",), hot_rows=HOT_ROWS) -> DataFrame:
    """Ids such as E1, E2, S1: a counter per run and prefix in registration order (`pos`)."""
    counted = spread_totals(evidence, [*by, "prefix"], ["pos"], "pos", {"n": F.lit(1)}, hot_rows=hot_rows)
    return counted.withColumn("id", F.concat("prefix", F.col("n").cast("string"))).drop("n")
