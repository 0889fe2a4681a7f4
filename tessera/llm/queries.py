"""The queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, fingerprints, html, language_model, near_duplicates, packing, quality, sharding, substrings, url_filters

#: (host, path, verdict), fixed by the contract of op4.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHARDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(parts: int) -> Column:
    """crc32 of doc_id as text leaves no remainder; a null id counts as an empty text and so is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5)), label="quality")
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_model.score(table(spark, sf_dir, "documents"), train=~held_out(10))
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontamination.phrase_blocks(table(spark, sf_dir, "benchmark"))
    found = decontamination.judged(decontamination.scan(table(spark, sf_dir, "documents"), blocks))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_substrings, op3_fingerprints, op4_url_filters, op5_packing, op6_sharding, op7_quality, op8_language_model, op9_decontamination, op10_near_duplicates)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_substrings": f"""
        WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM docs WHERE len(w) >= 50),
        keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM windows),
        least AS (SELECT k, min(doc_id) AS lo FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM keyed JOIN least USING (k) WHERE lo < doc_id),
        words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM docs),
        kept AS (SELECT words.doc_id, string_agg(w[words.i], ' ' ORDER BY words.i) AS kept FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY 1),
        removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op9_decontamination": f"""
        WITH docs AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("text"))} AS w FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format(_LOWER.format("text"))} AS w FROM benchmark),
        phrases AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
               FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM phrases),
        places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, sizes WHERE len(w) >= n),
        found AS (SELECT doc_id, i, places.n, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM places) places JOIN phrases ON places.n = phrases.n AND places.k = phrases.k),
        hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY 1),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_near_duplicates": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        -- Equal sets are one node, so that copies make no pairs.
        sets AS (SELECT doc_id, n, md5(string_agg(k, chr(10) ORDER BY k)) AS id FROM shingles JOIN sizes USING (doc_id) GROUP BY ALL),
        nodes AS (SELECT id, n, min(doc_id) AS node FROM sets GROUP BY ALL),
        members AS (SELECT doc_id, node FROM sets JOIN nodes USING (id)),
        own AS (SELECT node, n, k FROM nodes JOIN shingles ON node = doc_id),
        links AS (SELECT a.node AS x, b.node AS y FROM own a JOIN own b ON a.k = b.k AND a.node <> b.node GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach(x, y) AS (SELECT node, node FROM nodes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
        least AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY 1)
        SELECT docs.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(component, docs.doc_id) AS component_id, coalesce(component, docs.doc_id) = docs.doc_id AS kept
        FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN members USING (doc_id) LEFT JOIN least USING (node)""",
    "op4_url_filters": r"""
        WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
               ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        hits AS (SELECT page_id, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
               arg_max(verdict, length(rules.host || rules.path)) AS verdict
               FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
               GROUP BY page_id)
        SELECT parts.page_id, parts.host, parts.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict
        FROM parts LEFT JOIN hits ON parts.page_id = hits.page_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
