"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

# levels of 16 siblings the SQL follows within a source and over the sources
SOURCE_LEVELS, TOP_LEVELS = 5, 3


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes: eight shifts a byte, over the reversed polynomial."""
    data = f"hex(encode({text}))"
    taken = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::UBIGINT)"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {taken}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')"


def _leaf(text: str) -> str:
    fields = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(map(_field, fields)) + ")"


def _tree(name: str, nodes: str, levels: int) -> list[str]:
    """CTEs of trees by `k` over nodes (k, pos, d): runs of each level, roots."""
    out, below = [], nodes
    for level in range(levels):
        out.append(
            f"{name}{level} AS (SELECT k, pos // 16 AS pos, string_agg(d, '' ORDER BY pos) AS run, "
            f"any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM {below}) GROUP BY k, pos // 16)")
        # one node is left as it is
        out.append(f"{name}{level}d AS (SELECT k, pos, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS d FROM {name}{level})")
        below = f"{name}{level}d"
    return out


def _merkle() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf('text')} AS d, "
        f"CASE WHEN text IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(low)} END AS changed FROM documents)",
        "nodes AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM leaves)",
        *_tree("s", "nodes", SOURCE_LEVELS),
        f"tops AS (SELECT '' AS k, k AS source, row_number() OVER (ORDER BY encode(k)) - 1 AS pos, d FROM s{SOURCE_LEVELS - 1}d)",
        *_tree("t", "tops", TOP_LEVELS),
    ]
    joins, steps = [], []
    for level in range(SOURCE_LEVELS):
        joins.append(f"JOIN s{level} ON s{level}.k = nodes.k AND s{level}.pos = nodes.pos // {16 ** (level + 1)}")
        steps.append((f"s{level}", f"nodes.pos // {16 ** level} % 16"))
    joins.append("JOIN tops ON tops.source = nodes.k")
    for level in range(TOP_LEVELS):
        joins.append(f"JOIN t{level} ON t{level}.pos = tops.pos // {16 ** (level + 1)}")
        steps.append((f"t{level}", f"tops.pos // {16 ** level} % 16"))
    runs = ", ".join(f"CASE WHEN {t}.n > 1 THEN {t}.run END AS r{i}, {at} AS p{i}" for i, (t, at) in enumerate(steps))
    ctes.append(
        f"paths AS (SELECT nodes.doc_id, nodes.d AS leaf, nodes.changed, tops.d AS subroot, {runs}, "
        f"(SELECT d FROM t{TOP_LEVELS - 1}d) AS root FROM nodes {' '.join(joins)})")
    proof = " || ".join(f"coalesce(substr(r{i}, 1, 64 * p{i}) || substr(r{i}, 64 * p{i} + 65), '')" for i in range(len(steps)))
    folded, below = [], "paths"
    for i in range(len(steps)):
        node = "coalesce(changed, leaf)" if i == 0 else "node"
        folded.append(
            f"f{i} AS (SELECT * {'' if i == 0 else 'EXCLUDE (node)'}, coalesce(sha256(substr(r{i}, 1, 64 * p{i}) || {node} || "
            f"substr(r{i}, 64 * p{i} + 65)), {node}) AS node FROM {below})")
        below = f"f{i}"
    levels = " + ".join(f"(r{i} IS NOT NULL)::INT" for i in range(len(steps)))
    return (
        "WITH " + ",\n".join(ctes + folded) +
        f"\nSELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, node AS folded_root, node = root AS verified, "
        f"({levels})::INT AS n_levels FROM {below}")


def _spelling() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    run = "[a-z\u00C0-\u00FF]+"
    return f"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({low}, '{run}')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, n, {crc32("id || ':' || run")} AS h FROM runs),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cuts c ON c.rest = w.word
  UNION SELECT c.word, c.n, w.word, w.n FROM words w JOIN cuts c ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, any_value(n) AS n, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n
  FROM pairs GROUP BY word),
formed AS (SELECT word, form, form_n FROM best WHERE form_n >= 10 * n),
chain AS (
  SELECT word, form AS root, 1 AS step FROM formed
  UNION ALL SELECT chain.word, formed.form, step + 1 FROM chain JOIN formed ON formed.word = chain.root),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT words.word, formed.form, coalesce(ends.root, words.word) AS root, words.n, coalesce(n_near, 0)::BIGINT AS n_near, formed.form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)"""


_REPEATS = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (
  SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM texts WHERE length(x) >= 400)),
twice AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
again AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens
  FROM strings SEMI JOIN twice USING (h)),
spans AS (SELECT r, min(i) AS b, max(i) + 200 AS e FROM (
  SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM again) GROUP BY r, span),
gaps AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS a FROM spans),
cut AS (
  SELECT r, any_value(x) AS x, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) || substr(any_value(x), 2 * max(e) + 1) AS kept
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, (length(texts.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, texts.x))) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)"""


ORACLES = {"op11_incremental_witnesses": _merkle(), "op12_variable_grams": _spelling(), "op13_bucket_pointers": _REPEATS}
