"""The operators applied to the driver tables, and SQL for those that SQL can express."""

from ..session import tune
from .common import small_batches, table

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    def register(build):
        def run(spark, sf_dir):
            return build(small_batches(tune(spark)), sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


@query("op8_exact_dedup", oracle=r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM normal WINDOW g AS (PARTITION BY n)""")
def exact_dedup(spark, sf_dir):
    """Exact copies among all documents, by block naming."""
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("key")


@query("op9_source_mix")
def source_mix(spark, sf_dir):
    """The mix of all documents to the target weights of their sources."""
    from .mixing import mix_rows

    return mix_rows(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op7_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 2,048 tokens."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("op2_url_filters")
def url_filters(spark, sf_dir):
    """Verdicts on all pages' urls; the trees learn from the urls that a rule decides."""
    from .url_filters import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


@query("op3_quality_classifier")
def quality_classifier(spark, sf_dir):
    """Scores of all documents, learned from the labels outside the held-out quarter."""
    from .quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_language_id")
def language_id(spark, sf_dir):
    """Languages of all documents, learned from those outside the held-out third."""
    from .language import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard")
def ngram_jaccard(spark, sf_dir):
    """Groups of all documents linked by the Jaccard similarity of their 5-word shingles."""
    from .ngram_join import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents")).drop("set_key")


@query("op10_embedding_dedup")
def embedding_dedup(spark, sf_dir):
    """Links and groups of all embeddings at cosine 0.95."""
    from .embeddings import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


@query("op5_substring_dedup")
def substring_dedup(spark, sf_dir):
    """Bytes of all documents that a repeated string of 100 bytes covers."""
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op1_line_dedup")
def line_dedup(spark, sf_dir):
    """Fuzzy repeated lines of all documents."""
    from .line_dedup import judge_lines

    return judge_lines(table(spark, sf_dir, "documents")).drop("tie")


def _bytes_sql(text):
    """DuckDB: the UTF-8 bytes of a text as a list of integers."""
    hexed = f"hex(encode({text}))"
    return (f"list_transform(range(0, length({hexed}) // 2), "
            f"lambda i: ('0x' || substr({hexed}, CAST(2 * i + 1 AS INT), 2))::BIGINT)")


@query("op11_importance_resampling", oracle=rf"""
WITH steps AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(0, 8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM docs),
gw AS (SELECT unnest(w) AS word FROM goal),
known AS MATERIALIZED (SELECT word, {_bytes_sql('word')} AS b
         FROM (SELECT word FROM dw UNION SELECT word FROM gw)),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, b),
         lambda c, k: xor(t[(xor(c, k) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM known, steps),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM gw JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM gw) AS t_all),
gains AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE
         / ((s.n + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
         FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n
         FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
weighed AS (SELECT doc_id, len(w) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
         FROM docs LEFT JOIN sums USING (r)),
scored AS (SELECT doc_id, n_features, weight,
         weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN n_features >= 20 AND k <= (10 * n) // 100 THEN k END AS rank FROM ranked""")
def importance_resampling(spark, sf_dir):
    """Weights, scores and draw of all documents towards the benchmark's words."""
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_chat_formatting", oracle=r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*(?:/?s>|</?SYS>>|\|))', '<\\\1', 'g'),
                                  '\[(\\*/?INST\])', '[\\\1', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 18 WHEN 'assistant' THEN 5
                        ELSE 17 + coalesce(length(role), -1) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""")
def chat_formatting(spark, sf_dir):
    """All conversations, and one whose texts are control strings, formatted and read back."""
    from .chat import conversation_digests, format_conversations

    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(format_conversations(turns))


def _codes_sql(parts=8, size=8, rounds=6):
    """k-means of the parts as a chain of CTEs, one assignment and one update a round."""
    distance = "+".join(f"(p.v[{i}] - c.v[{i}]) * (p.v[{i}] - c.v[{i}])" for i in range(1, size + 1))
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT p.r, p.part, arg_min(c.e, (d, c.e)) AS e, min(d) AS d FROM (
          SELECT p.r, p.part, c.e, {distance} AS d FROM points p JOIN book{k} c USING (part)) c, points p
          WHERE c.r = p.r AND c.part = p.part GROUP BY ALL)""")
        if k < rounds:
            sums = ", ".join(f"(sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*)"
                             for i in range(1, size + 1))
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM book{k} b LEFT JOIN (
              SELECT part, e, CAST([{sums}] AS BIGINT[]) AS v FROM near{k} JOIN points USING (r, part)
              GROUP BY part, e) n USING (part, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT r, part, v[{size} * part + 1 : {size} * part + {size}] AS v
  FROM kept, (SELECT unnest(range(0, {parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, CAST(r - 1 AS INT) AS e, v FROM points WHERE r <= 16),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS sha FROM book{rounds}),
coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code,
  CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha AS codebooks_sha256
FROM coded JOIN kept USING (r), books"""


@query("op13_vector_codes", oracle=_codes_sql())
def vector_codes(spark, sf_dir):
    """Codes of eight parts for all embeddings, by exact integer k-means."""
    from pyspark.sql import functions as F

    from .vector_codes import books_digest, vector_codes as coded

    codes, books = coded(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books_digest(books)))
