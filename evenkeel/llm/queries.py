"""The registered queries of this folder: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.shared import prepare

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
WORD_LEVEL = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(body: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[body.__name__] = body
    return body


def checked(oracle: str):
    """Register a query with its SQL."""
    def register(body: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[body.__name__] = oracle.strip()
        return query(body)

    return register


@query
def op4_elias_fano(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as token files, read back from them."""
    from evenkeel.llm.elias_fano import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, folder, "documents"), BYTE_LEVEL, end_id=0))


@query
def op7_merge_automaton(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded texts of the automaton, as digests."""
    from evenkeel.llm.merge_automaton import digests

    return digests(table(spark, folder, "documents"), WORD_LEVEL)


@query
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    from evenkeel.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), WORD_LEVEL, capacity=2048, end_id=0)


@query
def op9_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from evenkeel.llm.winnowing import fingerprint_documents, shown

    found = fingerprint_documents(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("chosen")).alias("fingerprint"),
        shown(F.col("edited_chosen")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op10_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in forty shards of near equal bytes."""
    from evenkeel.llm.sharding import shard_documents

    return shard_documents(table(spark, folder, "documents"), shards=40)


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A score for each document, by a model that never saw the held-out fifth."""
    from evenkeel.llm.toxicity import fit, score_documents

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = fit(docs, labels, fold != 0)
    return score_documents(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


@query
def op3_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the field's verdict for each document."""
    from evenkeel.llm.line_crf import fit, judge

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return judge(docs, fit(docs, labels))


@query
def op6_count_min(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without the passages of earlier ones."""
    from evenkeel.llm.count_min import remove_repeats

    left = remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose shingle sets are alike by 85 percent."""
    from evenkeel.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85)


@query
def op1_masked_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """The pseudo-likelihood of each document under a network trained on all of them."""
    from evenkeel.llm.masked_lm import pseudo_likelihood

    return pseudo_likelihood(table(spark, folder, "documents"))


@checked(r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k, md5('42:' || doc_id) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT k, sum(size) AS s, [3, 1, 2][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS w,
         (row_number() OVER (ORDER BY k) - 1) % 3 AS turn FROM sized GROUP BY k),
steps AS (
  SELECT *, coalesce(sum(2 * s) OVER lower, 0) AS full_below, sum(w) OVER upper AS w_from, sum(s) OVER () AS total FROM sources
  WINDOW lower AS (ORDER BY 12 * s // w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upper AS (ORDER BY 12 * s // w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
marked AS (SELECT *, (3 * total - 2 * full_below) * w >= 4 * s * w_from AS is_full FROM steps),
level AS (
  SELECT 3 * any_value(total) - 2 * coalesce(sum(2 * s) FILTER (is_full), 0) AS p, 2 * sum(w) FILTER (NOT is_full) AS q FROM marked),
targets AS (
  SELECT k, s, turn, CASE WHEN is_full THEN CAST(2 * s AS DOUBLE) ELSE w * CAST(p AS DOUBLE) / CAST(q AS DOUBLE) END AS target FROM marked, level),
placed AS (
  SELECT doc_id, size, CAST(s AS BIGINT) AS s, turn, target, CAST(round(target) AS BIGINT) AS asked,
         CAST(coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
  FROM sized JOIN targets USING (k))
SELECT doc_id, size, s AS source_size, target,
       greatest(least(size, asked - c), 0) + greatest(least(size, asked - c - s), 0) AS taken,
       CASE WHEN size > 0 AND c < asked THEN round(CASE turn
         WHEN 0 THEN 2 * (c / target) * 3 / (4 + sqrt(16 - 4 * (c / target) * 3))
         WHEN 1 THEN sqrt(c / target) ELSE c / target END, 9) END AS position
FROM placed""")
def op12_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with what the mix takes of each, range-sorted by first position in training."""
    from evenkeel.llm.curriculum import mix

    mixed = mix(table(spark, folder, "documents"))
    first = F.round(F.get("positions", F.lit(0)), 9)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.asc_nulls_last("position"), "doc_id")


@checked(r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
drawn AS (
  SELECT *, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(t[1:least(x, y)], ''), '') AS prefix,
         coalesce(array_to_string(t[least(x, y) + 1:greatest(x, y)], ''), '') AS middle,
         coalesce(array_to_string(t[greatest(x, y) + 1:], ''), '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""")
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut for fill-in-the-middle, and restored from the output."""
    from evenkeel.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@checked(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS at FROM (
    SELECT lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
counted AS (
  SELECT lang, p, count(*) AS f FROM (
    SELECT lang, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
      FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k))
  GROUP BY lang, p HAVING count(*) >= 30),
candidates AS (SELECT lang, p, f AS a FROM counted WHERE len(p) > 1),
cuts AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counted y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(a) AS most FROM (
    SELECT lang, p[1:len(p) - 1] AS p, a FROM candidates UNION ALL SELECT lang, p[2:] AS p, a FROM candidates
    UNION ALL SELECT lang, p[1:2] AS p, a FROM candidates WHERE len(p) = 4 UNION ALL SELECT lang, p[2:3] AS p, a FROM candidates WHERE len(p) = 4
    UNION ALL SELECT lang, p[3:4] AS p, a FROM candidates WHERE len(p) = 4) GROUP BY lang, p),
kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p
  WHERE 100 * coalesce(most, 0) < 80 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN sizes USING (lang)
WHERE rank <= 2000""")
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2000 phrases of each language."""
    from evenkeel.llm.collocations import phrases

    return phrases(table(spark, folder, "documents"), least=30, share=80, top=2000)
