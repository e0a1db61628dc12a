"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bestfit, bpe, caps, centroids, language, licenses, neighbours, packing, phrases, pii, sharding, simhash, substrings
from lodestone.llm.common import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    labels = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*lists))), ",")
    covered = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"] / s["template_words"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        labels("places.label").alias("base_labels"),
        labels("places.label", "spans.label").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(covered).alias("score"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(language.sample(docs, ~language.held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    payload = [(F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    found = sharding.assign(docs, [1.0] * 24, "doc_id", payload)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), TOKENIZER), TOKENIZER)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.described("base"), 256).alias("base_sha256"), pii.described("spans").alias("spans"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"))


def op9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read_table(spark, sf_dir, "documents")).drop("text")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_licenses, op3_language, op4_sharding, op5_packing, op6_bpe, op7_pii, op8_neighbours, op9_caps, op10_substrings, op11_phrases, op12_centroids, op13_bestfit)
}

def _crc_table() -> list[int]:
    """What the remainder becomes for each byte: eight shifts, each with the reversed polynomial where a one falls out."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


def _draw(shard: str) -> str:
    return f"1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || {shard}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"


def _phrase_sql() -> str:
    longest, grams = 4, []
    for k in range(1, longest + 1):
        words = ", ".join(f"w[i + {j}]" for j in range(k))
        grams.append(f"SELECT lang, [{words}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})")
    return rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, p, count(*) AS a FROM ({" UNION ALL ".join(grams)}) GROUP BY lang, p HAVING count(*) >= 30),
        cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
        scored AS (SELECT c.lang, c.p, c.a, c.k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a::HUGEINT + r.a))::BIGINT AS score
            FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        inside AS (SELECT lang, p[i:i + k - 1] AS p, max(a) AS m FROM (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM (SELECT lang, p, a, unnest(range(2, len(p))) AS k FROM f WHERE len(p) > 2)) GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, p) WHERE m IS NULL OR 100 * m::HUGEINT < 80 * b.a::HUGEINT),
        ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def _centroid_sql() -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT 16))",
    ]
    for k in range(4):
        # whole numbers far below 2^53, so the products are exact
        distance = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, y.v) + list_inner_product(y.v, y.v)"
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, d * 16 + c) AS c FROM (SELECT x.n, vec_id, x.v, c, {distance} AS d FROM (SELECT *, row_number() OVER () AS n FROM kept) x CROSS JOIN c{k} y) GROUP BY n, vec_id)")
        if k < 3:
            sums = f"SELECT c, p, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(range(1, 65)) AS p, unnest(v) AS x FROM a{k}) GROUP BY c, p"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (SELECT c, list(x ORDER BY p) AS v FROM ({sums}) GROUP BY c) m USING (c))")
    digest = "sha256(array_to_string(list_transform(c3.v, lambda x: x::BIGINT), ','))"
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, a3.c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a3.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, {digest} AS centroid_sha256
        FROM a3 JOIN c3 USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op11_phrases": _phrase_sql(),
    "op12_centroids": _centroid_sql(),
    "op4_sharding": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        sums AS (SELECT doc_id, octet_length(encode(text)) + 8 AS size, CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, ({_crc_table()})[xor(c & 255, b) + 1])), 4294967295::BIGINT) END AS text_crc32 FROM d),
        draws AS (SELECT doc_id, size, text_crc32, list_transform(range(24), lambda s: {_draw("s")}) AS scores, {_draw("24")} AS more FROM sums),
        placed AS (SELECT doc_id, size, text_crc32, list_position(scores, list_max(scores)) - 1 AS shard, more > list_max(scores) AS grows FROM draws)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CASE WHEN grows THEN 24 ELSE shard END::INT AS grown_shard FROM placed""",
    "op10_substrings": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM starts),
        firsts AS (SELECT x, min(doc_id) AS low FROM windows GROUP BY x),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (x) WHERE low < doc_id),
        words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
