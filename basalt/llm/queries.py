"""The queries of the corpus operators: thin calls of the operators with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import divergence
from .embedding_forest import near_vectors
from .exact_dedup import exact_groups
from .fingerprint import edit_report
from .fixity import audit, warc_records
from .html_text import extract
from .language import language_report
from .mixing import pareto_mix
from .packing import pack, pieces
from .personal_data import BASE, count_of, personal_data
from .personal_data import as_text as spans_as_text
from .phrases import collocations
from .shared import stored, table
from .simhash import near_duplicates
from .toxicity import toxicity_report


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def packed_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per piece of docs: its tokens' checksum and its place in the packed sequences."""
    cut = pieces(docs, tokenizer_file).select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = pareto_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report is written to the shared folder once, so that later filters on it don't sum the lanes again."""
    report = edit_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stored(report.withColumnRenamed("id", "doc_id"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages against a replica with planted damage: by the md5 of the id, one page in 16 has a byte changed, one in 256 is lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ours = warc_records(pages)
    mark = F.md5(F.col("id").cast("string").cast("binary"))
    damaged = F.when(mark.startswith("0"), F.concat(F.expr("left(record, length(record) - 1)"), F.lit("?"))).otherwise(F.col("record"))
    theirs = ours.where(~F.coalesce(mark.startswith("1f"), F.lit(False))).withColumn("record", damaged)
    return audit(ours, theirs).select(F.col("id").alias("page_id"), "status", "digest_a", "length_a", "digest_b", "length_b")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=("url",))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spans_as_text(F.col("base")), 256).alias("base_sha256"), spans_as_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {"op1_mixing": op1_mixing, "op2_packing": op2_packing, "op3_toxicity": op3_toxicity, "op4_exact_dedup": op4_exact_dedup, "op5_warc_fixity": op5_warc_fixity, "op6_simhash": op6_simhash, "op7_html_text": op7_html_text, "op8_fingerprint": op8_fingerprint, "op9_personal_data": op9_personal_data, "op10_language": op10_language, "op11_embedding_dedup": op11_embedding_dedup, "op12_phrases": op12_phrases, "op13_divergence": op13_divergence}

ORACLE = {
    "op5_warc_fixity": """
        WITH r AS (
          SELECT page_id, md5(CAST(page_id AS VARCHAR)) AS mark,
                 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>'
                 || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS record
          FROM pages),
        d AS (
          SELECT *, CASE WHEN mark LIKE '0%' THEN left(record, length(record) - 1) || '?' ELSE record END AS other FROM r WHERE mark LIKE '0%' OR mark LIKE '1f%')
        SELECT page_id, CASE WHEN mark LIKE '1f%' THEN 'missing' ELSE 'changed' END AS status,
               sha256(record) AS digest_a, CAST(strlen(record) + 4 AS BIGINT) AS length_a,
               CASE WHEN mark LIKE '0%' THEN sha256(other) END AS digest_b, CASE WHEN mark LIKE '0%' THEN CAST(strlen(other) + 4 AS BIGINT) END AS length_b
        FROM d""",
    "op4_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t""",
    "op12_phrases": """
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
                 list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w
          FROM documents),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
        grams AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, range(1, 5) t(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
        c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 30),
        cuts AS (SELECT c.*, unnest(range(1, words)) AS k FROM c),
        sides AS (
          SELECT u.lang, u.words, u.phrase, u.a, u.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * u.a) // (x.f + y.f))::BIGINT AS score
          FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.k + 1:], ' ')),
        best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        held AS (
          SELECT DISTINCT p.lang, p.phrase FROM c q JOIN c p ON p.lang = q.lang AND p.words < q.words AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')
          WHERE 100::HUGEINT * q.a >= 80::HUGEINT * p.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
        FROM best JOIN n USING (lang) ANTI JOIN held USING (lang, phrase)
        QUALIFY rank <= 2000""",
    "op13_divergence": """
        WITH d AS (SELECT row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT s.*, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM s JOIN v USING (lang)),
        a AS (SELECT lang, term, sum(n) AS n FROM s GROUP BY ALL),
        q AS (SELECT a.lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM a JOIN v USING (lang)),
        pairs AS (
          SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sum(abs(i.p - j.p)), 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN p i ON i.lang = x.lang AND i.source = x.source LEFT JOIN p j ON j.lang = y.lang AND j.source = y.source AND j.term = i.term GROUP BY ALL),
        terms AS (SELECT p.lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 50""",
    "op11_embedding_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
          WHERE len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT r.a AS vec_id, coalesce(max(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
        FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a""",
}
