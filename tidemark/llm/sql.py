"""DuckDB SQL for what SQL can express."""

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def words(column: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{CAPITALS}', '{SMALL}'), '{WORD}')"


def shingles(n: int, whole_if_short: bool) -> str:
    """List of the distinct shingles of a list of words ``w``, as lists."""
    short = "CASE WHEN len(w) = 0 THEN [] ELSE [w] END" if whole_if_short else "[]"
    return (f"CASE WHEN len(w) < {n} THEN {short} ELSE "
            f"list_distinct([w[i:i + {n - 1}] for i in range(1, len(w) - {n} + 2)]) END")


OP1 = f"""
WITH RECURSIVE sets AS (
  SELECT doc_id, {shingles(4, True)} AS s FROM (SELECT doc_id, {words()} AS w FROM documents)
), rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sets
"""

OP10 = f"""
WITH docs AS (
  SELECT doc_id, unnest({shingles(5, False)}) AS g FROM (SELECT doc_id, {words()} AS w FROM documents)
), items AS (
  SELECT item_id, len(s) AS n, unnest(s) AS g
  FROM (SELECT item_id, {shingles(5, False)} AS s FROM (SELECT item_id, {words()} AS w FROM benchmark))
)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM docs JOIN items USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""

# Four groups of 40 bits of the digest, eight base-32 digits each.
OP8 = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
  SELECT page_id, payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)
    for i in range(0, 32)], '') AS payload_digest FROM hashed
), latest AS (SELECT payload_digest, max(page_id) AS latest FROM digests GROUP BY ALL)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM digests JOIN latest USING (payload_digest)
"""

OP11 = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM places),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN firsts USING (g), range(13) AS steps(k) WHERE first < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def crc32(column: str, table: str = "crc") -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, by the table of CRC_TABLE; ``column`` holds the bytes as hex."""
    byte = f"[('0x' || substr({column}, 2 * i + 1, 2))::BIGINT for i in range(0, len({column}) // 2)]"
    step = f"lambda c, b: xor({table}.t[1 + xor(c & 255, b)], c >> 8)"
    return f"xor(list_reduce([4294967295::BIGINT] || {byte}, {step}), 4294967295)"


CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT] || [-1 for i in range(0, 8)], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM range(256) AS bytes(b)))"""


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
tampered AS (
  SELECT *, CASE WHEN {crc32("hex(encode(doc_id::VARCHAR))")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents, crc
), leaves AS (
  SELECT doc_id, source, leaf, audited, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("other")} AS audited FROM tampered)
), nodes AS (
  SELECT source, 0 AS level, idx, n AS size, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE size > 1
  GROUP BY source, level, idx // 3, size
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS size
  FROM nodes WHERE size = 1
), above AS (
  SELECT 0 AS level, place AS idx, size, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM above WHERE size > 1
  GROUP BY level, idx // 3, size
), folds AS (
  SELECT source, doc_id, idx AS leaf_idx, 0 AS level, idx, audited AS h, '' AS seen, n AS size FROM leaves
  UNION ALL
  SELECT f.source, f.doc_id, f.leaf_idx, f.level + 1, f.idx // 3,
         sha256(string_agg(CASE WHEN m.idx = f.idx THEN f.h ELSE m.h END, '' ORDER BY m.idx)),
         f.seen || coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (WHERE m.idx <> f.idx), ''), (f.size + 2) // 3
  FROM folds f JOIN nodes m ON m.source IS NOT DISTINCT FROM f.source AND m.level = f.level AND m.idx // 3 = f.idx // 3
  WHERE f.size > 1 GROUP BY f.source, f.doc_id, f.leaf_idx, f.level, f.idx, f.h, f.seen, f.size
), ends AS (
  SELECT f.source, doc_id, leaf_idx, place AS idx, h, seen, s.size, 0 AS level
  FROM folds f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source WHERE f.size = 1
  UNION ALL
  SELECT f.source, f.doc_id, f.leaf_idx, f.idx // 3,
         sha256(string_agg(CASE WHEN m.idx = f.idx THEN f.h ELSE m.h END, '' ORDER BY m.idx)),
         f.seen || coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (WHERE m.idx <> f.idx), ''), (f.size + 2) // 3,
         f.level + 1
  FROM ends f JOIN above m ON m.level = f.level AND m.idx // 3 = f.idx // 3
  WHERE f.size > 1 GROUP BY f.source, f.doc_id, f.leaf_idx, f.level, f.idx, f.h, f.seen, f.size
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(e.seen) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM ends e JOIN leaves l ON l.source IS NOT DISTINCT FROM e.source AND l.idx = e.leaf_idx
JOIN subroots s ON s.source IS NOT DISTINCT FROM e.source, (SELECT h FROM above WHERE size = 1) AS r
WHERE e.size = 1
"""

OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(run, '{CAPITALS}', '{SMALL}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6
), hashed AS (SELECT run, {crc32("hex(encode(doc_id || ':' || run))")} AS h FROM runs, crc),
results AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
), words AS (SELECT word, count(*) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
rests AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form,
         CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.at
  WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ways w USING (word) JOIN forms e ON e.word = w.at AND e.form IS NULL
"""
