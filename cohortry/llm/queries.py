"""One query for each operator: it applies the operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.llm.bpe import bpe_digests
from cohortry.llm.collocations import collocations
from cohortry.llm.common import held_out
from cohortry.llm.decontaminate import contaminated
from cohortry.llm.exact_dedup import exact_dedup
from cohortry.llm.html_extract import extract_main_text
from cohortry.llm.language import identify_language, train_language_model
from cohortry.llm.licenses import scan_licenses
from cohortry.llm.packing import pack
from cohortry.llm.quality import score_quality, train_quality
from cohortry.llm.registry import ORACLES, QUERIES, query, table
from cohortry.llm.resample import importance_resample
from cohortry.llm.secretscan import scan_secrets
from cohortry.llm.simhash import simhash_components
from cohortry.llm.warc import archive_pages

__all__ = ["ORACLES", "QUERIES"]


@query("op1_quality")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id").alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = train_quality(docs.where("NOT held_out"), labels)
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op2_licenses")
def op2(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_language")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    model = train_language_model(docs.where("NOT held_out"))
    return identify_language(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_packing")
def op7(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op8_html")
def op8(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op9_decontaminate")
def op9(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256
FROM t WINDOW w AS (PARTITION BY s)""")
def op10(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_secrets")
def op4(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op5_warc", """
WITH t AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS m FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < m THEN m END AS refers_to FROM d""")
def op5(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_simhash")
def op6(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)


@query("op13_resample")
def op13(spark, sf_dir):
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_bpe")
def op11(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("op12_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
runs AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) s(m)),
f AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, m, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, p, m, f AS a, string_split(p, ' ') AS w FROM f WHERE m >= 2),
cuts AS (SELECT lang, p, m, a, w, unnest(range(1, m)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, k, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.w[1:k], ' ') AND x.m = k
  JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.w[k + 1:c.m], ' ') AND y.m = c.m - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
parts AS (SELECT lang, w, m, a, s, unnest(range(1, m - s + 2)) AS i FROM cand, (VALUES (2), (3)) z(s) WHERE s < m),
covers AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS p, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covers c USING (lang, p) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""")
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
