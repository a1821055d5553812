"""DuckDB SQL of the operators whose results SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"

#: crc32 of a list of bytes, by its table of 256 entries
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i)))"""
_CRC = "xor(list_reduce({}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"

EXACT_DEDUP = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs ``<name>_w0``, ... with the digests before and after each node of a level in its run of
    eight, and ``<name>_top`` with what is left of each tree, from ``leaves`` (tree, pos, n, digest)."""
    out, level = [], leaves
    for k in range(levels):
        run = "PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}_w{k} AS (SELECT *,
  COALESCE(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  COALESCE(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {level})""")
        level = f"{name}_l{k + 1}"
        out.append(f"""{level} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
FROM {name}_w{k} GROUP BY tree, pos // 8, n)""")
    out.append(f"{name}_top AS (SELECT tree, digest FROM {level})")
    return out


def _folded(name: str, first: str, levels: int) -> list[str]:
    """CTEs that carry the rows of ``first`` (tree, pos, sibs, folded) up a tree; the last is
    ``<name>_up``."""
    out, rows = [], first
    for k in range(levels):
        step = f"{name}_p{k}" if k < levels - 1 else f"{name}_up"
        out.append(f"""{step} AS (SELECT p.* REPLACE (sibs || w.b || w.a AS sibs,
  CASE WHEN w.n > 1 THEN sha256(w.b || folded || w.a) ELSE folded END AS folded)
FROM {rows} p JOIN {name}_w{k} w ON p.tree = w.tree AND p.pos // {8 ** k} = w.pos)""")
        rows = step
    return out


def manifest(levels: int = 6, tree_levels: int = 3) -> str:
    """For up to 8^levels documents a language and 8^tree_levels languages."""
    def leaf(text: str) -> str:
        part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
        return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    digits = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))"
    hit = f"COALESCE({_CRC.format(digits)} % 3 = 0, false)"
    ctes = [_CRC_TABLE, f"""m_docs AS (SELECT doc_id, COALESCE('=' || lang, '') AS tree, {leaf('text')} AS digest,
  CASE WHEN {hit} THEN {leaf(_LOWERED.format('text'))} END AS tampered FROM documents, crc)""",
            """m_leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
  count(*) OVER (PARTITION BY tree) AS n FROM m_docs)""",
            *_tree("m", "(SELECT tree, pos, n, digest FROM m_leaves)", levels),
            "t_leaves AS (SELECT 'root' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM m_top)",
            *_tree("t", "t_leaves", tree_levels),
            "m_first AS (SELECT doc_id, digest AS leaf, tree, pos, '' AS sibs, COALESCE(tampered, digest) AS folded FROM m_leaves)",
            *_folded("m", "m_first", levels),
            """t_first AS (SELECT u.doc_id, u.leaf, l.digest AS subroot, l.tree, l.pos, u.sibs, u.folded
FROM m_up u JOIN t_leaves l ON u.tree = l.name)""",
            *_folded("t", "t_first", tree_levels)]
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(sibs) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM t_up, t_top r"""


def importance(percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7) -> str:
    def features(name: str, table: str, key: str) -> str:
        words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
        return f"""{name}_w AS (SELECT {key} AS id, row_number() OVER () AS r, regexp_extract_all({_LOWERED.format("COALESCE(text, '')")}, {words}) AS w FROM {table}),
{name} AS (SELECT id, r, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM {name}_w),
{name}_e AS (SELECT r, unnest(f) AS f FROM {name})"""

    octets = "list_transform(range(0, length(hex(f)) // 2), lambda i: CAST('0x' || substr(hex(f), 2 * i + 1, 2) AS BIGINT))"
    return f"""WITH {_CRC_TABLE}, {features("doc", "documents", "doc_id")}, {features("goal", "benchmark", "item_id")},
known AS (SELECT f, {_CRC.format(octets)} % {buckets} AS bucket FROM (SELECT f FROM doc_e UNION SELECT f FROM goal_e), crc),
s AS (SELECT bucket, count(*) AS c FROM doc_e JOIN known USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS c FROM goal_e JOIN known USING (f) GROUP BY bucket),
total AS (SELECT (SELECT COALESCE(sum(c), 0) FROM s) AS s_all, (SELECT COALESCE(sum(c), 0) FROM t) AS t_all),
gain AS (SELECT s.bucket, floor(1000 * ln((COALESCE(t.c, 0) + 1)::DOUBLE * (s_all + {buckets})::DOUBLE
  / ((s.c + 1)::DOUBLE * (t_all + {buckets})::DOUBLE))) AS g FROM s LEFT JOIN t USING (bucket), total),
mean AS (SELECT r, floor(sum(g) / count(*)) AS weight FROM doc_e JOIN known USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT id, n_words, len(f) AS n_features, CAST(COALESCE(weight, 0) AS BIGINT) AS weight,
  CAST(COALESCE(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || COALESCE(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
    / 4294967296))) AS BIGINT) AS score FROM doc LEFT JOIN mean USING (r)),
placed AS (SELECT *, CASE WHEN n_words >= {min_words} THEN row_number() OVER (PARTITION BY n_words >= {min_words} ORDER BY score DESC, id) END AS place,
  count(*) FILTER (WHERE n_words >= {min_words}) OVER () AS able FROM scored)
SELECT id AS doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {percent} * able // 100 THEN place END AS rank FROM placed"""
