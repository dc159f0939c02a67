"""The queries opN_<name>: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import bpe, codes, decontamination, divergence, embeddings, language, lines, packing, quality, secrets, sharding, simhash, substrings
from tickframe.llm.shared import cut, table

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shards(narrow, SHARDS, ["doc_id", "size", "text_crc32"], key=20240501)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.tiled(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = secrets.scanned(docs.select("doc_id", "text"), secrets.learn(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language.identified(docs.select("doc_id", "text"), language.learn(docs))
    return rows.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = codes.with_label_error(rows)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    placed = packing.placed(cut(pieces), ["doc_id", "piece"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding, "op2_decontamination": op2_decontamination, "op3_substrings": op3_substrings, "op4_quality": op4_quality, "op5_embeddings": op5_embeddings, "op6_simhash": op6_simhash, "op7_secrets": op7_secrets, "op8_bpe": op8_bpe, "op9_lines": op9_lines, "op10_language": op10_language, "op11_codes": op11_codes, "op12_packing": op12_packing, "op13_divergence": op13_divergence}

#: SQL of the queries that SQL can state: windows by value, and links with everything they reach.
ORACLE_SQL: dict[str, str] = {
    "op3_substrings": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 k AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
 f AS (SELECT h, min(doc_id) AS least FROM k GROUP BY 1),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN f USING (h) WHERE least < doc_id),
 e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
 t AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.j = e.j WHERE c.j IS NULL GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)""",
    "op5_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum([x * x FOR x IN e]) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
 n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), m AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id, vec_id <= coalesce(m.m, vec_id) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id""",
    "op11_codes": """
WITH v AS MATERIALIZED (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 p AS MATERIALIZED (SELECT vec_id, k, e[k * (len(e) // 16) + 1 : (k + 1) * (len(e) // 16)] AS x FROM v, range(16) t(k)),
 s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
 c0 AS MATERIALIZED (SELECT k, j, x AS c FROM p JOIN s USING (vec_id)),
 a0 AS MATERIALIZED (SELECT vec_id, k, any_value(x) AS x, min((list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j))[2] AS j FROM p JOIN c0 USING (k) GROUP BY 1, 2),
 m1 AS (SELECT k, j, list(m ORDER BY i) AS c FROM (SELECT k, j, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a0, range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 c1 AS MATERIALIZED (SELECT k, j, coalesce(m1.c, c0.c) AS c FROM c0 LEFT JOIN m1 USING (k, j)),
 a1 AS MATERIALIZED (SELECT vec_id, k, any_value(x) AS x, min((list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j))[2] AS j FROM p JOIN c1 USING (k) GROUP BY 1, 2),
 m2 AS (SELECT k, j, list(m ORDER BY i) AS c FROM (SELECT k, j, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a1, range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 c2 AS MATERIALIZED (SELECT k, j, coalesce(m2.c, c1.c) AS c FROM c1 LEFT JOIN m2 USING (k, j)),
 a2 AS MATERIALIZED (SELECT vec_id, k, min((list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), j)) AS b FROM p JOIN c2 USING (k) GROUP BY 1, 2),
 r AS (SELECT vec_id, string_agg(lower(printf('%02x', b[2])), '' ORDER BY k) AS code, sum(b[1])::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, j)) FROM c2) AS codebooks_sha256 FROM r JOIN v USING (vec_id)""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
 w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
 k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
 g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
 c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
 v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY 1),
 t AS (SELECT g.lang, g.source, coalesce(max(v.v), 0) AS v, coalesce(sum(c.n), 0)::BIGINT AS n FROM g LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
 p AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (t.n + 5 * t.v) AS p FROM t JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
 q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 5)::HUGEINT) // (v.n + 5 * v.v) AS q FROM k JOIN v USING (lang)),
 f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
}
