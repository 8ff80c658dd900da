"""The queries that apply each operator, with production parameters, to its whole table, and the SQL that checks them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import divergence, fingerprint, language_id, media, near_dedup, packing, piece_bpe, secret_scan, sharding, suffix_dedup, surrogates, url_filter, whitening
from tidemark.llm.common import IdFilter, at_most, bounded_batches, checkpointed, documents, has_repeats, tasks_for


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package that knows it is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir)).drop("media")


def surrogate_key(spark: SparkSession) -> bytes:
    """The session's secret: spark.tidemark.surrogates.key, or else one drawn for this session, which nobody can repeat."""
    name = "spark.tidemark.surrogates.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name).encode()


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogates(documents(spark, sf_dir), surrogate_key(spark))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(documents(spark, sf_dir))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    return secret_scan.scan(documents(spark, sf_dir), "text", owner="source", repository="doc_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_sharding, op3_url_filter, op4_suffix_dedup, op5_media, op6_surrogates, op7_packing, op8_near_dedup, op9_sentencepiece, op10_fingerprint, op11_secret_scan, op12_whitening, op13_divergence]
    return {f.__name__: f for f in own}


def _op3_sql() -> str:
    """The reputation of op3 in SQL, level by level."""
    low, high = url_filter.LEAST_STRENGTH, url_filter.MOST_STRENGTH
    strength = lambda level: f"""(SELECT CASE WHEN coalesce(total, 0) = 0 OR p * (1 - p) <= 0 OR total - squares / total - (k - 1) <= 0
        OR spread - total * p * p - p * (1 - p) * (k - 1) <= 0 THEN {high}
        ELSE least({high}, greatest({low}, 1 / ((spread - total * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * (total - squares / total - (k - 1)))) - 1)) END
      FROM (SELECT sum(n)::DOUBLE total, sum(y)::DOUBLE / sum(n) p, sum(n::DOUBLE * n) squares, sum(y::DOUBLE * y / n) spread, count(*) k FROM {level} WHERE n > 0))"""  # noqa: E731
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    upper, lower = url_filter._UPPER, url_filter._LOWER
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), l AS (
  SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS bad FROM labels
), hosts AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS y
  FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) n, sum(y) y FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) n, sum(y) y FROM domains GROUP BY ALL),
k AS (SELECT {strength("suffixes")} AS k_suffix, {strength("domains")} AS k_domain, {strength("hosts")} AS k_host, (SELECT coalesce(sum(y)::DOUBLE / nullif(sum(n), 0), 0) FROM suffixes) AS overall),
s AS (SELECT suffix, (y + k_suffix * overall) / (n + k_suffix) AS m FROM suffixes, k),
d AS (SELECT domain, (y + k_domain * m) / (n + k_domain) AS m FROM domains JOIN s USING (suffix), k),
h AS (SELECT host, n + k_host AS weight, (y + k_host * m) / (n + k_host) AS mean FROM hosts JOIN d USING (domain), k),
low AS (SELECT host, mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM h)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in rules)} END AS rule,
  CASE {" ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in rules)} WHEN bound > {url_filter.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN low USING (host)"""


def _op11_sql() -> str:
    """The candidates, census and spans of op11 in SQL."""
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    patterns = [secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.TOKEN]
    one = lambda k, pattern: f"""SELECT row, doc_id, source, {k} AS kind, generate_subscripts(regexp_extract_all(text, {quoted(pattern)}), 1) AS k,
      unnest(regexp_extract_all(text, {quoted(pattern)})) AS m, unnest(regexp_extract_all(text, {quoted(pattern)}, {2 if k == 0 else 0})) AS v,
      unnest(list_slice(regexp_split_to_array(text, {quoted(pattern)}), 1, len(regexp_extract_all(text, {quoted(pattern)})))) AS gap FROM d"""  # noqa: E731
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
e AS ({" UNION ALL ".join(one(k, p) for k, p in enumerate(patterns))}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY k) AS till, rtrim(v, '.') AS bare FROM e),
spans AS (
  SELECT row, doc_id, source, kind, till - length(m) AS start, CASE WHEN kind = 3 THEN till - length(v) + length(bare) ELSE till END AS stop, sha256(bare) AS digest,
    length(bare) >= {secret_scan.LIVE_LENGTH} AND len(list_distinct(string_split(bare, ''))) >= {secret_scan.LIVE_VARIETY} AND regexp_matches(bare, '[0-9]') AND regexp_matches(bare, '[A-Za-z]')
      AND NOT regexp_matches(bare, '(?i:{secret_scan.PLACEHOLDERS})') AS live,
    length(bare) >= {secret_scan.TOKEN_LENGTH} AND regexp_matches(bare, '[A-Z]') AND regexp_matches(bare, '[a-z]') AS strong
  FROM placed WHERE kind <> 0 OR length(v) >= {secret_scan.ASSIGNED_LENGTH}
), base AS (SELECT * FROM spans WHERE kind < 3),
cand AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM spans t WHERE kind = 3 AND live AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND b.start < t.stop AND t.start < b.stop)
), each AS (SELECT digest, source, doc_id, bool_or(kind < 2) AS named FROM cand GROUP BY ALL),
own AS (SELECT digest, source, count(*) AS repositories, bool_or(named) AS named FROM each GROUP BY digest, source),
census AS (SELECT digest, count(*) AS owners, sum(repositories) AS repositories, bool_or(named) AS named FROM own GROUP BY digest),
judged AS (
  SELECT row, kind, start, stop, owners >= {secret_scan.COPIED_OWNERS} AND repositories >= {secret_scan.COPIED_REPOSITORIES} AS copied, owners = 1 AND live AND (kind < 3 OR named OR strong) AS is_live
  FROM cand JOIN census USING (digest)
), told AS (SELECT *, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM judged WHERE kind < 3 OR is_live),
by_row AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind, stop) AS spans,
    count(*) FILTER (copied) AS n_copied, count(*) FILTER (is_live) AS n_live
  FROM told GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN by_row USING (row)"""


def _op13_sql() -> str:
    """The divergences of op13 in SQL, dense over all terms and sources."""
    p = lambda n, size: f"1 + (1000000000::HUGEINT * ({n} + 1)) // {size}"
    f = "((p - q) * (p - q)) // q"
    upper, lower = url_filter._UPPER, url_filter._LOWER
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS all_n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.LEAST_DOCUMENTS}),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS n FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
sized AS (SELECT g.lang, g.source, coalesce(total, 0) + coalesce(v, 0) AS size FROM groups g LEFT JOIN own USING (lang, source) LEFT JOIN v USING (lang)),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "size")} AS p FROM sized JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
terms AS (SELECT lang, source, term AS item, {f} AS value FROM (SELECT dense.lang, source, dense.term, dense.n, p, {p("all_n", "(v.n + v.v)")} AS q FROM dense JOIN kept USING (lang, term) JOIN v USING (lang)) WHERE n > 0 AND p > q),
sums AS (SELECT lang, source, item, sum({f}) AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.MOST_TERMS}"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _op3_sql(), "op11_secret_scan": _op11_sql(), "op13_divergence": _op13_sql()}


def accept_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    bounded_batches(spark)
    bank = language_id.fit(docs.where(~language_id.held_out()).select("lang", "text"))
    return language_id.accepted(docs, bank)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, with all its different texts; repeated rows become one."""
    bounded_batches(spark)
    found = checkpointed(near_dedup.near_duplicates(docs))
    tasks = tasks_for(spark, found.count(), near_dedup.ROWS_A_TASK)
    gone = checkpointed(found.where("not kept").select("doc_id").distinct().transform(at_most, tasks))
    maybe = IdFilter(gone, tasks)
    kept = maybe.rows(docs, "doc_id", False).unionByName(maybe.rows(docs, "doc_id", True).join(gone, "doc_id", "left_anti").select(docs.columns).transform(at_most, tasks))
    if has_repeats(docs.where("doc_id is not null"), "doc_id"):
        # Repeated rows are one; different texts of an id are one document's and stay or go together.
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_r"))
        kept = one.select(*[F.col("_r")[c].alias(c) if c in rest else F.col(c) for c in docs.columns]).unionByName(kept.where("doc_id is null"))
    return kept


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that occur earlier."""
    bounded_batches(spark)
    return suffix_dedup.rewrite(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    bounded_batches(spark)
    return surrogates.rewrite(docs, surrogate_key(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
