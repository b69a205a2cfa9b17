"""The registered queries of this package, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, collocations, curriculum, fill_middle, html_text, max_plus, packing, quality, sharding, simhash, syncmers, token_ids, toxicity
from .common import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_ids")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written, and described from the files."""
    docs = table(spark, sf_dir, "documents")
    return token_ids.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 ids that hold all documents."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2)


SAME_TEXTS = """
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)"""


@query("op3_exact_dedup", SAME_TEXTS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return chunk_dedup.groups(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.groups(table(spark, sf_dir, "documents"))


@query("op8_syncmers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.neighbours(table(spark, sf_dir, "documents"))


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal counts."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_max_plus")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents, and what they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return max_plus.digests(max_plus.encode(table(spark, sf_dir, "documents"), path), path)


FILLED = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM cut),
parts AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain'
              WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


@query("op11_fill_middle", FILLED)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all documents with a part moved to the end, and of the texts that come back."""
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents")))


MIXED = r"""
WITH base AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents),
weighed AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w FROM base GROUP BY source),
filled AS (
  SELECT *, coalesce(sum(source_size) OVER fuller, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER fuller, 0) AS free,
         sum(source_size) OVER () AS words
  FROM weighed WINDOW fuller AS (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT 3 * words - 4 * held AS num, 2 * free AS den FROM filled
          WHERE 4 * source_size * free > w * (3 * words - 4 * held) ORDER BY source_size / w, rank LIMIT 1),
aims AS (
  SELECT source, rank, rank % 3 AS kind, source_size::BIGINT AS source_size,
         least(2.0::DOUBLE * source_size::DOUBLE, coalesce((w * num)::DOUBLE / den::DOUBLE, 'inf'::DOUBLE)) AS target
  FROM filled LEFT JOIN level ON true),
placed AS (
  SELECT b.row, doc_id, key, size, rank, kind, source_size, target,
         (sum(size) OVER (PARTITION BY rank ORDER BY key, b.row ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM base b JOIN aims a ON b.source IS NOT DISTINCT FROM a.source),
times AS (
  SELECT *, j AS pass, start + j * source_size AS at,
         greatest(least(floor(target + 0.5)::BIGINT - start - j * source_size, size), 0) AS words,
         [6.0, 2.0, 4.0][kind::INT + 1]::DOUBLE / 2 * ((start + j * source_size)::DOUBLE / nullif(target, 0)) AS area,
         [4.5, 0.5, 2.0][kind::INT + 1]::DOUBLE AS w, [-6.0, 2.0, 0.0][kind::INT + 1]::DOUBLE AS slopes
  FROM placed, range(2) AS passes(j)),
taken AS (
  SELECT *, least(2.0::DOUBLE * area / (w + sqrt(greatest(w * w + slopes * area, 0.0::DOUBLE))), 1.0::DOUBLE) AS position
  FROM times WHERE words > 0),
sorted AS (SELECT *, row_number() OVER (ORDER BY position, rank, key, pass) AS place FROM taken)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(sum(s.words), 0)::BIGINT AS taken, count(s.words) AS passes,
       min(s.place) AS first_place, min(s.position) AS first_position
FROM placed p LEFT JOIN sorted s USING (row) GROUP BY p.row, p.doc_id, p.size, p.source_size, p.target"""


@query("op13_curriculum", MIXED)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, what a mix of the sources takes of them, and when."""
    mixed = curriculum.mix(table(spark, sf_dir, "documents"))
    return curriculum.by_document(curriculum.schedule(mixed))


COLLOCATIONS = r"""
WITH cut AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]') AS t FROM documents),
words AS (SELECT doc, lang, place, w FROM (SELECT doc, lang, unnest(t) AS w, generate_subscripts(t, 1) AS place FROM cut)
          WHERE NOT regexp_full_match(w, '[.,;:!?\x0A-\x0D]')),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, w AS p1,
         CASE WHEN lead(place) OVER o = place + 1 THEN lead(w) OVER o END AS w2, CASE WHEN lead(place, 2) OVER o = place + 2 THEN lead(w, 2) OVER o END AS w3,
         CASE WHEN lead(place, 3) OVER o = place + 3 THEN lead(w, 3) OVER o END AS w4, CASE WHEN lead(place, 4) OVER o = place + 4 THEN lead(w, 4) OVER o END AS w5
  FROM words WINDOW o AS (PARTITION BY doc ORDER BY place)),
f AS (
  SELECT lang, phrase, len(string_split(phrase, ' ')) AS k, count(*) AS f FROM (
    SELECT lang, unnest([p1, p1 || ' ' || w2, p1 || ' ' || w2 || ' ' || w3, p1 || ' ' || w2 || ' ' || w3 || ' ' || w4,
                         p1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5]) AS phrase FROM runs)
  WHERE phrase IS NOT NULL GROUP BY lang, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, phrase, string_split(phrase, ' ') AS p, k, f AS a FROM f WHERE k >= 2),
spans AS (SELECT lang, p, k, a, unnest(range(1, k + 1)) AS i FROM candidates),
inside AS (
  SELECT lang, array_to_string(p[i:j], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM spans) WHERE j - i + 1 < k GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase) WHERE i.a IS NULL OR 100 * i.a < 100 * c.a),
cuts AS (SELECT lang, phrase, a, i, array_to_string(p[1:i], ' ') AS x, array_to_string(p[i + 1:], ' ') AS y
         FROM (SELECT *, unnest(range(1, k)) AS i FROM kept)),
valued AS (
  SELECT c.lang, c.phrase, a, i, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000"""


@query("op12_collocations", COLLOCATIONS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.mine(table(spark, sf_dir, "documents"))
