"""Queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_secrets, op02_spotsigs, op03_mixing, op04_pii, op05_quality, op06_language, op07_pieces, op08_minhash, op09_gif, op10_ctw, op11_lines, op12_phrases, op13_merkle

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_links": op01_secrets.op1_secret_links,
        "op2_spotsigs": op02_spotsigs.op2_spotsigs,
        "op3_source_mix": op03_mixing.op3_source_mix,
        "op4_pii_bootstrap": op04_pii.op4_pii_bootstrap,
        "op5_quality": op05_quality.op5_quality,
        "op6_language_id": op06_language.op6_language_id,
        "op7_piece_lattice": op07_pieces.op7_piece_lattice,
        "op8_minmax_neardup": op08_minhash.op8_minmax_neardup,
        "op9_gif_media": op09_gif.op9_gif_media,
        "op10_ctw_scores": op10_ctw.op10_ctw_scores,
        "op11_line_rules": op11_lines.op11_line_rules,
        "op12_collocations": op12_phrases.op12_collocations,
        "op13_merkle_manifest": op13_merkle.op13_merkle_manifest,
        "spotsigs_groups": op02_spotsigs.spotsigs_groups,
    }


#: Links by shared shingles of whole texts, then the smallest id reachable.
OP8_SQL = """WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS total FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (total - c)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept FROM s JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) c ON c.a = s.doc_id"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_sql(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def runs_sql(levels: str, key: str) -> str:
    return f"SELECT level, {key}pos // 8 AS run, list(h ORDER BY pos) AS hs FROM {levels} WHERE n > 1 GROUP BY ALL"


#: What a step upwards makes of a node x at a place of the run hs: its hash, and the proof with the others.
STEP = "sha256(array_to_string(list_transform(hs, lambda h, i: CASE WHEN i = f.pos % 8 + 1 THEN x ELSE h END), '')), f.proof || array_to_string(list_filter(hs, lambda h, i: i <> f.pos % 8 + 1), '')"
CRC = "xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)), lambda c, x: list_reduce(range(8), lambda a, u: xor(a >> 1, (a & 1) * 3988292384), xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295)"
OP13_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, lang, {leaf_sql("text")} AS leaf, {leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered, coalesce({CRC} % 3 = 0, FALSE) AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
a AS (SELECT 0 AS level, lang, pos, n, leaf AS h FROM p UNION ALL SELECT level + 1, lang, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY level, lang, pos // 8),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS level, pos, n, h FROM s UNION ALL SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY level, pos // 8),
ra AS ({runs_sql("a", "lang, ")}), rb AS ({runs_sql("b", "")}),
f AS (SELECT id, 0 AS level, lang, pos, n, CASE WHEN tampered THEN lowered ELSE leaf END AS x, '' AS proof FROM p
UNION ALL SELECT f.id, f.level + 1, f.lang, f.pos // 8, (f.n + 7) // 8, {STEP} FROM f JOIN ra ON ra.level = f.level AND ra.lang IS NOT DISTINCT FROM f.lang AND ra.run = f.pos // 8 WHERE f.n > 1),
g AS (SELECT f.id, 0 AS level, s.pos, s.n, f.x, f.proof FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
UNION ALL SELECT f.id, f.level + 1, f.pos // 8, (f.n + 7) // 8, {STEP} FROM g AS f JOIN rb ON rb.level = f.level AND rb.run = f.pos // 8 WHERE f.n > 1)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.x AS folded_root, g.x = r.h AS verified
FROM d JOIN g ON g.id = d.id AND g.n = 1 JOIN s ON s.lang IS NOT DISTINCT FROM d.lang JOIN b r ON r.n = 1"""


def listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: A line is (whole line, its words, its place among the lines with a word).
OP11_SQL = f"""WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS place FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM g) WHERE c > 1) GROUP BY id),
l AS (SELECT id, line, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v, row_number() OVER (PARTITION BY id, line ORDER BY place) > 1 AS again
FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM w)),
j AS (SELECT id, again, length(array_to_string(v, '')) AS chars, CASE
WHEN right(v[-1], 1) NOT IN ({listed(op11_lines.ENDS)}) OR 10 * length(regexp_replace(line, '[^{op11_lines.SYMBOLS}]', '', 'g')) > length(array_to_string(v, '')) THEN 0
WHEN len(list_filter(v, lambda x: regexp_full_match(x, '[{op11_lines.SEPARATORS}]{{1,8}}') AND strlen(x) <= 8)) >= greatest(2, 0.15 * len(v)) OR 2 * len(list_filter(v, lambda x: translate(x, '{UPPER}', '{LOWER}') IN ({listed(op11_lines.MENU)}))) >= len(v) THEN 1
WHEN again OR (len(v) <= {op11_lines.SHORT} AND regexp_matches(translate(line, '{UPPER}', '{LOWER}'), '{"|".join(op11_lines.PHRASES)}')) THEN 2 END AS rule FROM l WHERE len(v) > 0),
s AS (SELECT id, count(*) AS n_lines, count_if(again) AS n_dup_lines, count_if(rule = 0) AS n_punctuation, count_if(rule = 1) AS n_navigation, count_if(rule = 2) AS n_boilerplate, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost_chars FROM j GROUP BY id),
a AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^{op11_lines.SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(lost_chars, 0) AS lost_chars FROM w LEFT JOIN r USING (id) LEFT JOIN s USING (id))
SELECT doc_id, {", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in op11_lines.NAMES)}, base_failed, NOT base_failed AND 100 * lost_chars <= {op11_lines.MAX_LOST} * word_chars AS kept
FROM (SELECT *, n_words < {op11_lines.MIN_WORDS} OR 100 * n_repeat_words > {op11_lines.MAX_REPEAT} * n_words AS base_failed FROM a)"""


OP12_SQL = f"""WITH w AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, list_transform(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]'), lambda p: list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '')) AS p FROM documents),
v AS (SELECT lang, id, part, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT lang, id, unnest(p) AS v, generate_subscripts(p, 1) AS part FROM w)),
s AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM v WINDOW o AS (PARTITION BY id, part ORDER BY i)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM s UNION ALL SELECT lang, 2, x || ' ' || y FROM s WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM s WHERE z IS NOT NULL),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT *, lang || chr(31) || array_to_string(v[1:cut], ' ') AS lk, lang || chr(31) || array_to_string(v[cut + 1:k], ' ') AS rk FROM (SELECT lang, phrase, v, a, k, unnest(range(1, k)) AS cut FROM c)),
h AS (SELECT lang || chr(31) || phrase AS part, f FROM f WHERE f >= 10),
y AS (SELECT x.lang, x.phrase, x.k, x.a, cut, p.f AS l, q.f AS r, CAST(1000000 AS HUGEINT) * x.a * x.a // (CAST(p.f AS HUGEINT) * q.f) AS score
FROM x JOIN h p ON p.part = lk JOIN h q ON q.part = rk),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(v[place:place + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, v, a, unnest([1, 2]) AS place FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT z.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op8_minmax_neardup": OP8_SQL, "op11_line_rules": OP11_SQL, "op12_collocations": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
