"""The subpackage's queries, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, fingerprint, langid, mixing, near_dedup, packing, pages, pii, quality, sequencer, simhash, suffix_dedup, token_store, url_filter
from .textio import table

LANGUAGES = ("en", "fr", "de", "es")
#: Words whose ids a worker keeps, about 0.2 KB each.
WORDS = 600_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of two-word shingles at 80 of 100."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), near_dedup.Similarity(words=2, percent=80))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), capacity=2048, end_id=0, most_words=WORDS)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL; a page is labelled by the documents whose text it shows."""
    read = pages.read_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.labels_of_pages(read, table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), bad)
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), labelled)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 bytes."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), width=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and risk-controlled thresholds."""
    return quality.judge_quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality"), strata=LANGUAGES)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of weights 1, 2, 3 in turn, at most three times their size."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets, under the session's key."""
    return pii.replace_entities(table(spark, sf_dir, "documents", "doc_id", "text"), key=pii.session_key(spark))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of pages from their text, markup, address and host; the model is fitted on documents."""
    model = langid.train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), languages=LANGUAGES)
    read = pages.read_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    host, path = url_filter.host_and_path(F.col("url"))
    host = F.when(host != "", host)
    found = langid.identify(read, model, accept=LANGUAGES, id_col="page_id", declared=F.col("declared"), host=host, address=langid.address_language(host, path, LANGUAGES))
    return found.select(F.col("doc_id").alias("page_id"), "language", "probability", "text_language", "declared", "address", "host", "kept")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to a store and read back."""
    return token_store.checksums(token_store.store_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), end_id=2, most_words=WORDS))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two differing bits."""
    return simhash.near_documents(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, budget=2)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Lloyd rounds over 16 centroids of all vectors of 64 components."""
    return centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=16, rounds=3, dims=64, scale=64, seed=1)


def op13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of clients in ten batches of days, some late and some lost; waiting ends after eight days."""
    columns = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
    rows = table(spark, sf_dir, "client_changes", *columns).distinct()
    h = F.coalesce(F.crc32(F.col("change_id").cast("string")), F.lit(0))
    day = F.when(h % 11 != 0, F.unix_date(F.col("valid_at").cast("date")) + 5 * (h % 4))
    batch = F.greatest(F.lit(1), F.least(F.lit(10), 1 + F.floor((day - 19723) * 10 / 160)))
    cents = F.when(F.abs("balance") < 9e16, F.floor(F.col("balance") * 100 + 0.5))
    return sequencer.apply_changes(rows.select("change_id", "client_id", "seq", day.alias("day"), batch.alias("batch"), "op", "city", cents.alias("cents")), batches=10, patience=8)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the explicit rules alone say of every page's URL, from the URL filter."""
    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("told"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base figures and base rules, from the quality rules."""
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of all edited texts, from the fingerprints."""
    return op9_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_packing, op3_url_filter, op4_suffix_dedup, op5_quality, op6_mixing, op7_pii, op8_language, op9_fingerprint, op10_token_store, op11_simhash, op12_centroids, op13_changes, url_rules, quality_base, edited_texts)}



def _lloyd_sql(rounds: int, k: int) -> str:
    """Lloyd rounds one after another: the assignment of round r needs the centroids after r - 1 others."""
    steps = [
        "k AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster, v AS c FROM k WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        far = "CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS BIGINT)"
        steps.append(f"d{r} AS (SELECT vec_id, v, cluster, {far} AS distance FROM k CROSS JOIN c{r})")
        steps.append(f"a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if r < rounds:
            steps.append(f"e{r} AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r})")
            steps.append(f"s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM e{r} GROUP BY cluster, i)")
            steps.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster)")
            steps.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)")
    return (
        "WITH " + ", ".join(f"{x[: x.index(' ')]} AS MATERIALIZED{x[x.index(' AS ') + 3 :]}" for x in steps) + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
    )


ORACLES: dict[str, str] = {
    "op1_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, md5(array_to_string(w, ' ')) AS same, list_distinct(CASE WHEN len(w) = 1 THEN list_zip(w, ['']) ELSE list_zip(w[1:len(w) - 1], w[2:]) END) AS shingles FROM d
), c AS (  -- one row for each text
  SELECT same, min(doc_id) AS node, any_value(shingles) AS shingles, len(any_value(shingles)) AS n FROM s WHERE doc_id IS NOT NULL AND len(shingles) > 0 GROUP BY same
), e AS (
  SELECT node, n, unnest(shingles) AS shingle FROM c
), f AS (
  SELECT shingle FROM e GROUP BY shingle HAVING count(*) > 1
), p AS (
  SELECT a.node AS x, b.node AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) WHERE a.shingle IN (SELECT shingle FROM f) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l AS (
  SELECT x, y FROM p UNION SELECT y, x FROM p
), r(node, reached) AS (
  SELECT node, node FROM c UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reached
), m AS (
  SELECT node, min(reached) AS component FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(s.doc_id = coalesce(m.component, s.doc_id), true) AS kept
FROM s LEFT JOIN c ON c.same = s.same AND s.doc_id IS NOT NULL AND len(s.shingles) > 0 LEFT JOIN m ON m.node = c.node
""",
    "op4_suffix_dedup": r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 48)) AS i, h FROM d WHERE doc_id IS NOT NULL AND length(h) >= 100
), s AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM w
), f AS (
  SELECT s, min(doc_id) AS first FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i FROM s JOIN f USING (s) WHERE first < doc_id
), marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 49 AS z FROM numbered GROUP BY doc_id, run
), before AS (
  SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM runs
), cut AS (
  SELECT b.doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * y + 1, 2 * (a - 1 - y)), '' ORDER BY a) AS kept FROM before b JOIN d ON d.doc_id = b.doc_id GROUP BY b.doc_id
)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), q AS (
  SELECT doc_id, source, size,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
    CASE WHEN size > 0 AND length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::DOUBLE / size BETWEEN 3 AND 10 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS w
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, CAST(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS need, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM r
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (weights - coalesce(sum(weight) OVER before, 0)) AS level FROM c
  WINDOW before AS (ORDER BY need, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * weight) AS target FROM l
), e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT q.doc_id, q.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    coalesce(sum(q.size) OVER (PARTITION BY q.source ORDER BY -ln(q.u) / q.w, q.doc_id, q.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN budget > 0 AND before + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
""",
    "url_rules": r"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM r
), p AS (
  SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h
), f AS (
  SELECT p.*, rule, told, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS nth
  FROM p LEFT JOIN (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) AS v(domain, start, rule, told)
  ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
)
SELECT page_id, host, path, rule, told FROM f WHERE nth = 1
""",
    "quality_base": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), c AS (
  SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, s) > 1
), n AS (
  SELECT k, count(DISTINCT i + o) AS repeats FROM c CROSS JOIN (VALUES (0), (1), (2)) AS v(o) GROUP BY k
), l AS (
  SELECT k, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(repeats, 0) > 50 * len(w) AS base_failed
FROM d JOIN l ON l.k = d.k LEFT JOIN n ON n.k = d.k
""",
    "edited_texts": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents
), f AS (
  SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM d
)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(after, 1, n // 2)) AS edited_sha256 FROM f
""",
    "op12_centroids": _lloyd_sql(rounds=3, k=16),
}
