"""DuckDB SQL for the rows of the queries that SQL can express.

The others are held against brute force in tests/llm: archives need base32 digests,
license chains an automaton, shards a greedy map and CRC-32, personal data offsets of
matches, HTML a tree, and mixing an iteration.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES = {
    "op1_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACE_WORDS}) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b, k = x.n AND k = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS doc_id, min(b) AS m FROM l WHERE same GROUP BY 1)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op2_chat_formatting": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 o AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, 'start') AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 e AS (SELECT *, before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS ok,
 length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '|', '\p')) + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '|', '\p')) + 11 AS chars FROM o)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i), '')) AS loss_sha256, CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars, bool_and(ok) AND arg_max(role, i) = 'assistant' AS valid, CAST(coalesce(min(CASE WHEN NOT ok THEN i END), -1) AS INT) AS refused_turn
 FROM e GROUP BY conv_id""",
    "op7_quality_rules": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACE_WORDS}) AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM d WHERE len(w) > 2)),
 often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
 hit AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
 lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 tops AS (SELECT doc_id, max(k) AS top FROM (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(string_split(t, '')) AS c FROM d) GROUP BY 1, 2) GROUP BY 1),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered, len(list_distinct(w)) AS n_distinct, length(t) AS n_chars, coalesce(top, 0) AS n_top_char, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
 FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN tops USING (doc_id)),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_lettered < 40 * n_words OR 100 * n_distinct < 5 * n_words OR 100 * n_top_char > 50 * n_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM f""",
    "op8_benchmark_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS w FROM documents),
 b AS (SELECT item_id, w, least(13, CAST(len(w) AS BIGINT)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS w FROM benchmark) WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM b)),
 dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
 h AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
 hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY 1),
 hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1),
 r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256 FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id))
 SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM r""",
}
