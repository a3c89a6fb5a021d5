"""DuckDB SQL of those operators that SQL can express."""

from __future__ import annotations

from delaycohorts.llm.quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM r"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS k FROM g WHERE w3 IS NOT NULL) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM s, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim,
             len(list_filter(w, lambda z: z IN ({_STOP}))) AS n_stop
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= 0.2 * n_words
       AND n_stop >= 0.04 * n_words AND n_upper <= 0.4 * word_chars AND n_exclaim <= 0.5 * n_words
       AND n_dup_lines <= 0.5 * n_lines AND n_repeat_words <= 0.5 * n_words AS kept
FROM b"""

LINES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
o AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id"""

JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, array_to_string(w[i:i+3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.r)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, t.component_id
FROM (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) t LEFT JOIN n ON n.doc_id = t.doc_id"""


def _tree(name: str, depth: int) -> str:
    """Levels of trees: {name}0 has (tree, r, digest); each next one hashes runs of 16 while more than one node is left."""
    found = []
    for k in range(depth):
        node = "CASE WHEN m = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY r)) END"
        counted = f"(SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {name}{k})"
        found.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, r // 16 AS r, {node} AS digest FROM {counted} GROUP BY tree, r // 16, m)")
    return ",\n".join(found)


def _sides(name: str, depth: int) -> str:
    """Digests left and right of every node of every level within its run."""
    run = "OVER (PARTITION BY tree, r // 16 ORDER BY r ROWS BETWEEN {} AND {})"
    before, after = run.format("UNBOUNDED PRECEDING", "1 PRECEDING"), run.format("1 FOLLOWING", "UNBOUNDED FOLLOWING")
    return ",\n".join(
        f"{name}_s{k} AS MATERIALIZED (SELECT tree, r, coalesce(string_agg(digest, '') {before}, '') AS a, coalesce(string_agg(digest, '') {after}, '') AS z, "
        f"count(*) OVER (PARTITION BY tree) > 1 AS many FROM {name}{k})" for k in range(depth)
    )


def merkle(depth: int = 5, top: int = 3) -> str:
    """Manifest of tables with up to 16^depth rows a source and 16^top sources."""
    folds = []
    for k in range(depth):
        folds.append(f"f{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (pos, fold, proof), f.pos // 16 AS pos, CASE WHEN s.many THEN sha256(s.a || f.fold || s.z) ELSE f.fold END AS fold, f.proof || s.a || s.z AS proof FROM f{k} f JOIN l_s{k} s ON s.tree = f.tree AND s.r = f.pos)")
    folds.append(f"g0 AS MATERIALIZED (SELECT f.* EXCLUDE (pos), u.r AS pos, u.digest AS subroot FROM f{depth} f JOIN u0 u ON u.name = f.tree)")
    for k in range(top):
        folds.append(f"g{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (pos, fold, proof), f.pos // 16 AS pos, CASE WHEN s.many THEN sha256(s.a || f.fold || s.z) ELSE f.fold END AS fold, f.proof || s.a || s.z AS proof FROM g{k} f JOIN u_s{k} s ON s.r = f.pos)")
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, sha256({head} || {field('text')}) AS digest,
                  CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(lowered)}) END AS tampered FROM documents),
l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS r FROM d),
{_tree('l', depth)},
{_sides('l', depth)},
u0 AS MATERIALIZED (SELECT 0 AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS r, digest FROM l{depth}),
{_tree('u', top)},
{_sides('u', top)},
f0 AS MATERIALIZED (SELECT doc_id, tree, digest AS leaf, r AS pos, coalesce(tampered, digest) AS fold, '' AS proof FROM l0),
{(',' + chr(10)).join(folds)}
SELECT doc_id, leaf, subroot, (SELECT digest FROM u{top}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT digest FROM u{top}) AS verified
FROM g{top}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC, "op4_quality_rules": QUALITY, "op7_line_dedup": LINES, "op9_ngram_jaccard": JACCARD, "op11_merkle_manifest": merkle()}
