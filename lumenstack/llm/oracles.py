"""DuckDB SQL for the queries that SQL can express.

The other operators rest on hashes, searches or models that SQL lacks (XXH64 bit sums, differencing
heaps, byte-pair merging, automata, eigenvectors, rule sweeps); they are tested against brute force.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
             s AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 35], ' ') AS win FROM d, unnest(range(0, len(w) - 34)) AS t(pos)),
             r AS (SELECT win FROM s GROUP BY win HAVING count(*) > 1),
             c AS (SELECT DISTINCT doc_id, pos + k AS p FROM s JOIN r USING (win), range(35) AS o(k)),
             g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM c GROUP BY doc_id),
             x AS (SELECT doc_id, i, w[i + 1] AS word FROM d, unnest(range(len(w))) AS t(i)),
             k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.i WHERE c.p IS NULL GROUP BY x.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op3_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(source, chr(0)) || chr(31) || coalesce(text, chr(0))), 1, 15))::BIGINT AS hash FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
             r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
             v AS (SELECT *, ([5.0, 2.0, 1.0])[rank % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
             o AS (SELECT *, cap / weight AS ratio FROM v),
             f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget, coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                          sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
             l AS (SELECT min_by((budget - capped) / open, (ratio, rank)) AS level FROM f WHERE (budget - capped) / open <= ratio),
             t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM f, l),
             b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
             c AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
                          sum(size) OVER (PARTITION BY d.source ORDER BY hash) AS upto, sum(size) OVER (PARTITION BY d.source, hash) AS own
                   FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (size * (whole + CASE WHEN upto <= rest OR (upto - own <= rest AND (rest - (upto - own)) * 2 >= own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
    """,
    "op6_decontaminate": f"""
        WITH b AS (SELECT item_id::VARCHAR AS item, {PLAIN} AS w FROM benchmark),
             g AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS gram FROM b, unnest(range(0, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
             d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
             h AS (SELECT doc_id, pos, n, item FROM (SELECT doc_id, n, pos, array_to_string(w[pos + 1:pos + n], ' ') AS gram
                   FROM (SELECT doc_id, w, n FROM d, (SELECT DISTINCT n FROM g) AS lengths), unnest(range(0, len(w) - n + 1)) AS t(pos)) JOIN g USING (n, gram)),
             p AS (SELECT doc_id, count(DISTINCT pos + k)::BIGINT AS n_hit FROM h, unnest(range(n)) AS o(k) GROUP BY doc_id),
             i AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
}
