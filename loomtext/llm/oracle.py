"""DuckDB SQL for those queries of this subpackage that SQL can express."""

SQL = {
    "op3_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op6_mtree_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    # The CRC-32 is spelled out: a table by its rule, then a reduction over the bytes of each text.
    "op7_byte_shards": """
        WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
        h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        b AS (SELECT doc_id, length(x) // 2 + 1 AS size, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT)) AS bytes FROM h),
        s AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, e: xor(c // 256, tab[xor(c, e) % 256 + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM b, t),
        p AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id) AS BIGINT) - size AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM s),
        q AS (SELECT *, CAST(least(7, before * 8 // total) AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM q""",
    "op8_minhash_components": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
            FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
              GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (SELECT doc_id AS node, doc_id AS dest FROM s UNION SELECT r.node, u.b FROM r JOIN u ON r.dest = u.a)
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.low AS component_id, s.doc_id = c.low AS kept
        FROM s JOIN (SELECT node, min(dest) AS low FROM r GROUP BY node) c ON c.node = s.doc_id""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10""",
    "op12_filter_audit": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                     || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
              FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        o AS (SELECT '' AS filter_order UNION ALL
              SELECT filter_order || x FROM o JOIN (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) ON NOT contains(filter_order, x)),
        s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS own, substr(filter_order, 1, k - 1) AS before
              FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE length(filter_order) = 5),
        g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        h AS (SELECT *, contains(fails, own) AS hit, translate(fails, before, '') <> fails AS past FROM g, s),
        r AS (SELECT part, filter_order, step, own,
                     coalesce(sum(n) FILTER (WHERE NOT hit AND NOT past), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT past), 0) AS removed,
                     coalesce(sum(n) FILTER (WHERE hit AND past), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails,
                     coalesce(sum(n) FILTER (WHERE hit AND NOT past AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE hit AND NOT past AND toxic), 0) AS toxic_lost
              FROM h GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
}
