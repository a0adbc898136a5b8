"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvatica.llm import chat, exact_dedup, html_text, learned_partitions, mixing, near_dedup, packing, quality, topk_search, toxicity, vector_codes, warc, whitening
from sylvatica.session import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.withColumn("kept", F.lit(True))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{odd}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.conversation_digests(chat.windows(rows.unionByName(more)))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", taken.alias("taken"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_groups(table(spark, sf_dir, "documents"), near_dedup.Rule(size=3, num=90, den=100))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.usable(table(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, vectors.where(F.col("id") % 100 == 0), k=10)


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.quantise(table(spark, sf_dir, "embeddings"))


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = learned_partitions.usable(table(spark, sf_dir, "embeddings"))
    return learned_partitions.search(vectors, vectors.where(F.col("id") % 100 == 0), k=10)


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = 6) -> str:
    """Product quantisation by plain comparison with every entry: a common table for each round."""
    square = "coalesce(list_sum(list_transform(range(1, len(p.v) + 1), lambda j: (p.v[j] - b.v[j]) * (p.v[j] - b.v[j]))), 0)::HUGEINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.r, p.p, min({square} * 16 + b.i) AS best FROM p JOIN b{i} AS b ON b.p = p.p GROUP BY p.r, p.p)")
        if i < rounds:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT p, i, list(CASE WHEN total < 0 THEN -((n - 1 - total) // n) ELSE total // n END ORDER BY j)::BIGINT[] AS v FROM (
                SELECT p, i, j, sum(x) AS total, count(*)::HUGEINT AS n FROM (
                  SELECT p.p, (a.best % 16)::BIGINT AS i, unnest(p.v) AS x, unnest(range(len(p.v))) AS j FROM p JOIN a{i} AS a ON a.r = p.r AND a.p = p.p) GROUP BY p, i, j) GROUP BY p, i)""")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(s.v, b.v) AS v FROM b{i} AS b LEFT JOIN s{i} AS s ON s.p = b.p AND s.i = b.i)")
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
               FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, p, v[len(v) * p // 8 + 1 : len(v) * (p + 1) // 8] AS v FROM k, range(8) AS t(p)),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS i, v FROM p WHERE r <= 16),
        {", ".join(steps)},
        h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM (SELECT p, i, unnest(v) AS x, unnest(range(len(v))) AS j FROM b{rounds})),
        c AS (SELECT r, string_agg(printf('%02x', (best % 16)::INTEGER), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c ON c.r = k.r CROSS JOIN h
    """


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_main_text": op2_main_text,
    "op3_chat_windows": op3_chat_windows,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pack_binary": op8_pack_binary,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_topk_search": op10_topk_search,
    "op11_annular_codes": op11_annular_codes,
    "op12_learned_partitions": op12_learned_partitions,
    "op13_lanczos_whitening": op13_lanczos_whitening,
}

ORACLES = {
    "op3_chat_windows": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        k AS (SELECT *, CASE role WHEN 'assistant' THEN 'ANS' ELSE 'INST' END AS kind, regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(?:INST|ANS)|/?s>)', '\1\\\2', 'g') AS e FROM c),
        r AS (SELECT *, '[' || kind || ' ' || url_encode(role) || ']' AS head, '[/' || kind || ']' AS tail FROM k),
        n AS (SELECT *, length(head || e || tail) AS len, ceil(octet_length(encode(head || e || tail)) / 4.0)::BIGINT AS n FROM r),
        p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n),
        f AS (SELECT conv_id, start AS system_start, n, text, head, tail, (1024 - octet_length(encode(head || tail)))::BIGINT AS room FROM p WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY start) = 1),
        g AS (SELECT *, regexp_replace(replace(left(text, room), '\', '\\'), '([\[<])(/?(?:INST|ANS)|/?s>)', '\1\\\2', 'g') AS plain FROM f),
        h AS (SELECT *, CASE WHEN n <= 256 THEN text WHEN octet_length(encode(plain)) <= room THEN left(text, room) ELSE left(text, room // 8) END AS shown FROM g),
        y AS (SELECT conv_id, system_start, head || regexp_replace(replace(shown, '\', '\\'), '([\[<])(/?(?:INST|ANS)|/?s>)', '\1\\\2', 'g') || tail AS told FROM h),
        s AS (SELECT conv_id, system_start, length(told) AS system_len, ceil(octet_length(encode(told)) / 4.0)::BIGINT AS system_n FROM y),
        b AS (SELECT p.*, s.system_start, coalesce(s.system_len, 0) AS system_len, 1536 - 256 - 2 - coalesce(s.system_n, 0) AS body FROM p LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
        w AS (SELECT *, 2 * (start // body) + (start + n > (start // body + 1) * body)::BIGINT AS w FROM b),
        x AS (SELECT *, max(start + n) OVER q AS ends, row_number() OVER (q ORDER BY start DESC) AS nth FROM w WINDOW q AS (PARTITION BY conv_id, w)),
        v AS (SELECT conv_id, w, min(start) AS begins, any_value(system_start) AS system_start, any_value(system_len) AS system_len, sum(len) AS len,
                     coalesce(sum(len) FILTER (start >= ends - 256 AND nth <= 2 AND role <> 'system'), 0) AS history FROM x GROUP BY conv_id, w),
        u AS (SELECT *, 7 + len + coalesce(lag(history) OVER (PARTITION BY conv_id ORDER BY w), 0) + CASE WHEN system_start < begins THEN system_len ELSE 0 END AS chars FROM v),
        z AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(*)::INTEGER AS n_windows FROM u GROUP BY conv_id),
        d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY start)) AS turns_sha256,
                     coalesce(string_agg(text, '' ORDER BY start) FILTER (role = 'assistant'), '') AS loss FROM p GROUP BY conv_id)
        SELECT d.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows
        FROM d JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id
    """,
    "op4_mix_sources": r"""
        WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null-' || md5(coalesce(text, ''))) AS name, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
        x AS (SELECT *, 1 + (n - 1) % 3 AS weight FROM w),
        b AS (SELECT *, source_size * 3.0::DOUBLE / weight AS bound FROM x),
        l AS (SELECT *, ((SELECT sum(source_size) FROM b)::DOUBLE
                         - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY bound, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                        / ((SELECT sum(weight) FROM b)
                         - coalesce(sum(weight) OVER (ORDER BY bound, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM b),
        a AS (SELECT level AS lv FROM l WHERE level <= bound ORDER BY bound, n LIMIT 1),
        t AS (SELECT source, source_size, CASE WHEN (SELECT lv FROM a) IS NULL THEN bound * weight ELSE least((SELECT lv FROM a), bound) * weight END AS target FROM l),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
        c AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target,
                     (floor(r.rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || d.name), 1, 8))::BIGINT / 4294967296.0::DOUBLE
                        < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
              FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
    """,
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY h) AS group_size FROM d
              WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, h AS text_sha256 FROM r
    """,
    "op6_warc_round_trip": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS keeper, rank() OVER (PARTITION BY h, n ORDER BY page_id DESC) AS r FROM d)
        SELECT page_id, n AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (5 * (3 - i % 4))::BIGINT) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN r = 1 THEN NULL ELSE keeper END::BIGINT AS refers_to
        FROM g
    """,
    "op10_topk_search": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id,
                     coalesce(list_sum(list_transform(range(1, len(v.c) + 1), lambda i: q.c[i] * v.c[i])), 0)::BIGINT AS score
              FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (
          SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        e AS MATERIALIZED (SELECT row, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.row AS a, b.row AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.row < b.row AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY a.row, b.row),
        l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
        u AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
        r(x, y) AS (SELECT row, row FROM s UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(t.doc_id) FROM r JOIN s AS t ON t.row = r.y WHERE r.x = s.row) AS component_id FROM s
    """,
    "op11_annular_codes": _codes_sql(),
}
