"""Registered queries of this subpackage, with their SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import prepare
from . import alignment, embeddings, fingerprints, html, mixing, near, packing, sharding, spelling, substring, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Per word of a text, whether a window over it starts earlier elsewhere.
OP1_SQL = r"""
WITH words AS (
    SELECT doc_id, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w
    FROM documents
), clean AS (
    SELECT doc_id, CASE WHEN w IS NULL OR w = [''] THEN [] ELSE w END AS w FROM words
), windows AS (
    SELECT doc_id, start, array_to_string(list_slice(w, start, start + 19), ' ') AS t
    FROM clean, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS start)
), repeats AS (
    SELECT doc_id, start FROM windows
    QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, start) > 1
), gone AS (
    SELECT DISTINCT doc_id, start + k AS pos FROM repeats, (SELECT unnest(range(20)) AS k)
), lists AS (
    SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM clean LEFT JOIN lists USING (doc_id)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, 20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# Links from shared shingles of distinct sets, components by walking from every class to larger ones.
OP2_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN w IS NULL OR w = [''] THEN [] WHEN len(w) < 2 THEN w
           ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s
    FROM words
), classes AS (
    SELECT min(doc_id) AS cls, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), elements AS (
    SELECT cls, n, unnest(s) AS e FROM classes
), links AS (
    SELECT a.cls AS a, b.cls AS b FROM elements a JOIN elements b ON a.e = b.e AND a.cls < b.cls
    GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT cls AS node, cls AS least FROM classes
    UNION SELECT ways.b, reached.least FROM reached JOIN ways ON ways.a = reached.node WHERE reached.least < ways.b
), named AS (
    SELECT node, min(least) AS component FROM reached GROUP BY node
)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN named ON named.node = classes.cls
"""


@query("op2_minhash_near_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), n_words=2, percent=80)


@query("op3_consistent_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards, by the law of equal row counts."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=24)


# Poisson counts by the same hash; weights are the square roots of the sources' rows.
OP4_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
    SELECT source, (SELECT sum(n) FROM counts) * sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) / n AS rate FROM counts
), mass AS (
    SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
    FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k)
), cdf AS (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass
), lists AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source
), drawn AS (
    SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0))::INTEGER AS copies
    FROM documents d JOIN lists USING (source)
)
SELECT doc_id, text, lang, source, n_chars, copies, copy::INTEGER AS copy
FROM drawn, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy)
"""


@query("op4_poisson_mixing", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their rows, as many rows as before on average."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.temperature_weights(docs, 0.5), seed=1)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)


# All pairs of the small table's vectors.
OP6_SQL = r"""
WITH RECURSIVE flat AS (
    SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
), usable AS (
    SELECT vec_id, sqrt(sum(x * x)) AS norm FROM flat GROUP BY vec_id HAVING count(*) = count(x) AND bool_and(isfinite(x)) AND sum(x * x) > 0
), vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, norm FROM embeddings JOIN usable USING (vec_id)
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reached AS (
    SELECT vec_id AS node, vec_id AS least FROM embeddings
    UNION SELECT links.b, reached.least FROM reached JOIN links ON links.a = reached.node WHERE reached.least < links.b
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN (SELECT node, min(least) AS component_id FROM reached GROUP BY node) ON node = vec_id
"""


@query("op6_embedding_near_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine 0.95."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")


@query("op8_imatch_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against its edited form and the next document."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

OP9_SQL = r"""
WITH rules(action, host, path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), rest AS (
    SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), hits AS (
    SELECT s.page_id, u.host || u.path AS rule, u.action
    FROM split s JOIN rules u ON (s.host = u.host OR s.host LIKE '%.' || u.host) AND starts_with(s.path, u.path)
    QUALIFY row_number() OVER (PARTITION BY s.page_id ORDER BY length(u.host || u.path) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM split LEFT JOIN hits USING (page_id)
"""


@query("op9_url_filter", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five fixed rules over every page."""
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# The CRC-32 table by its rule, near words by what is left of them without one character.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), each AS (
    SELECT run, doc_id || ':' || run AS s, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), bytes AS (
    SELECT run, n, list_transform(range(0, strlen(s)), lambda k: ('0x' || substr(hex(s), (2 * k + 1)::INTEGER, 2))::BIGINT) AS b FROM each
), hashed AS (
    SELECT run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), spelled AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run) + 2)::INTEGER) ELSE run END AS word, n FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), gaps AS (
    SELECT word, i, substr(word, 1, i::INTEGER) || substr(word, (i + 2)::INTEGER) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), shorter AS (
    SELECT DISTINCT g.word AS a, w.word AS b FROM gaps g JOIN words w ON g.rest = w.word
), near AS (
    SELECT x.word AS a, y.word AS b FROM gaps x JOIN gaps y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
), best AS (
    SELECT near.a AS word, count(*) AS n_near, arg_min(w.word, (-w.n, w.word)) AS best, max(w.n) AS best_n
    FROM near JOIN words w ON w.word = near.b GROUP BY near.a
), forms AS (
    SELECT word, best AS form, best_n AS form_n FROM best JOIN words USING (word) WHERE best_n >= 10 * n
), chains AS (
    SELECT word, word AS reached FROM words
    UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.reached
), roots AS (
    SELECT word, reached AS root FROM chains WHERE reached NOT IN (SELECT word FROM forms)
)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words JOIN roots USING (word) LEFT JOIN best USING (word) LEFT JOIN forms USING (word)
"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 characters or more, forms ten times as frequent."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=7, least_count=2, every=31, ratio=10)


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text by the byte-level vocabulary; more than 512 are over the limit."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level vocabulary against the piece model."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
