"""DuckDB SQL for the rows of operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 10 words are compared as joined strings (a word has no blank).
OP11 = rf"""
WITH item AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT item_id, least(len(w), 10) AS n,
           unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda k: array_to_string(w[k:k + 9], ' '))) AS words
    FROM item WHERE len(w) > 0
), doc AS (
    SELECT doc_id, row_number() OVER () AS row_id,
           regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), place AS (
    SELECT row_id, n, unnest(range(1, len(w) - n + 2)) AS k, w
    FROM doc CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
    SELECT row_id, k, place.n, item_id
    FROM place JOIN windows ON windows.n = place.n AND words = array_to_string(w[k:k + place.n - 1], ' ')
), hit AS (
    SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY row_id
), items AS (
    SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (row_id) LEFT JOIN items USING (row_id)
"""

#: CRC-32 bit by bit: a byte is folded in, then eight steps; prefixes are lists of hashes of their turns.
OP13 = r"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, count(*) AS own, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda a, b: xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1))))) % 4 AS h
    FROM turns GROUP BY c
), taken AS (
    SELECT convs.c, h, convs.c - convs.c % 20 AS base, least(h, coalesce(b.own, 0)) AS from_base
    FROM convs LEFT JOIN (SELECT c AS base, own FROM convs) b ON b.base = convs.c - convs.c % 20
), rebuilt AS (
    SELECT taken.c, place, role, text FROM taken JOIN turns ON turns.c = base WHERE place < h
    UNION ALL
    SELECT taken.c, place - h + from_base, role, text FROM taken JOIN turns ON turns.c = taken.c WHERE place >= h
), paths AS (
    SELECT c, place + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
           list(sha256(role) || sha256(text)) OVER (PARTITION BY c ORDER BY place) AS name
    FROM rebuilt
    UNION ALL
    SELECT c, 0, 0, CAST([] AS VARCHAR[]) FROM convs
), members AS (
    SELECT c, depth, words, name, depth = max(depth) OVER (PARTITION BY c) AS last FROM paths
), nodes AS (
    SELECT name, depth, min(c) AS conv_id, count(*) AS n, max(words) AS words,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
    FROM members GROUP BY name, depth
), children AS (
    SELECT p.name, count(*) AS n FROM nodes p JOIN nodes k ON k.depth = p.depth + 1 AND k.name[1:p.depth] = p.name
    GROUP BY p.name
), below AS (
    SELECT a.name, sum((k.n - 1) * k.words) AS saved, sum(CASE WHEN children.n IS NULL THEN 1 ELSE 0 END) AS leaves
    FROM nodes k JOIN members own ON own.c = k.conv_id AND own.depth <= k.depth JOIN nodes a ON a.name = own.name
    LEFT JOIN children ON children.name = k.name
    GROUP BY a.name
)
SELECT nodes.conv_id, nodes.depth, p.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(children.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN below ON below.name = nodes.name
LEFT JOIN children ON children.name = nodes.name
LEFT JOIN nodes p ON p.depth = nodes.depth - 1 AND p.name = nodes.name[1:nodes.depth - 1]
"""

_COMPONENTS = """reach(a, b) AS (
    SELECT id, id FROM node
    UNION
    SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP6 = f"""
WITH RECURSIVE node AS (
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
           embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
    FROM embeddings
), link AS (
    SELECT p.id AS a, q.id AS b FROM node p JOIN node q
    ON p.usable AND q.usable AND p.id <> q.id AND list_cosine_similarity(p.v, q.v) >= 0.95
), {_COMPONENTS}
SELECT node.id AS vec_id, coalesce(n, 0) AS n_links, component_id, node.id = component_id AS kept
FROM node JOIN component USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM link GROUP BY a) USING (id)
"""

OP10 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), node AS (
    SELECT id, list_distinct(list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 3, 2) END),
                                            lambda k: array_to_string(w[k:k + 4], ' '))) AS s
    FROM words
), shingle AS (
    SELECT id, unnest(s) AS s FROM node
), link AS (
    SELECT a, b FROM (SELECT p.id AS a, q.id AS b, count(*) AS n FROM shingle p JOIN shingle q ON p.s = q.s AND p.id <> q.id GROUP BY ALL)
    JOIN node x ON x.id = a JOIN node y ON y.id = b
    WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), {_COMPONENTS}
SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM node JOIN component USING (id)
"""

#: A turn is its opener, its text with one more backslash before every control string, and its closer.
OP5 = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS i FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 0
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 0
), rendered AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '\\*(?:</?s>|\[/?INST\]|<</?SYS>>|<</?TURN)')) + 3
        + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
               ELSE 17 + coalesce(1 + length(url_encode(role)), 0) END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
"""
