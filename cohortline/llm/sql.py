"""The same results in DuckDB SQL, where SQL can express an operator."""

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS phrase
       FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS phrase
       FROM d, (SELECT DISTINCT k FROM iw), unnest(range(1, len(w) - k + 2)) AS t(s)),
occ AS (SELECT DISTINCT doc_id, s, k, item FROM dw JOIN iw USING (phrase, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(s, s + k)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256
          FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CURRICULUM = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
f AS (SELECT *, CAST(source_size AS DOUBLE) * 2 / weight AS full_at FROM s),
r AS (SELECT full_at, sum(source_size * 2.0::DOUBLE) AS caps, sum(weight) AS weights FROM f GROUP BY full_at),
b AS (SELECT full_at, (SELECT sum(source_size) * 1.5::DOUBLE FROM s)
             - coalesce(sum(caps) OVER (ORDER BY full_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS amount,
             (SELECT sum(weight) FROM s)
             - coalesce(sum(weights) OVER (ORDER BY full_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM r),
o AS (SELECT * FROM b WHERE full_at >= amount / rest ORDER BY full_at LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.full_at >= o.full_at THEN weight * amount / rest
                                       ELSE CAST(source_size AS DOUBLE) * 2 END AS target FROM f LEFT JOIN o ON true),
p AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS whole,
             sum(size) OVER (PARTITION BY d.source ORDER BY hash, size, doc_id) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, whole - start)) + greatest(0, least(size, whole - start - source_size)) AS BIGINT) AS taken
FROM p
"""

_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT item_row, item_id, term FROM (SELECT row_number() OVER () AS item_row, item_id, list_distinct({_TERMS}) AS w FROM benchmark), unnest(w) AS t(term)),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT row, term, count(*) AS tf FROM d, unnest(w) AS t(term) WHERE term IN (SELECT term FROM i) GROUP BY row, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 50 + ((50 * len(w) * n_docs) // n_terms) AS m FROM d, c),
s AS (SELECT item_row, item_id, doc_id, row, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY item_row, item_id, doc_id, row),
r AS (SELECT item_id, doc_id, score,
             CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
