"""SQL of queries whose text is built from a rule."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

RANKED_SEARCH = rf"""
    WITH listed AS (
        SELECT doc_id, row_number() OVER () AS doc,
               unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents),
    counted AS (SELECT doc, doc_id, term, count(*) AS tf FROM listed GROUP BY ALL),
    sizes AS (SELECT doc, sum(tf)::BIGINT AS n FROM counted GROUP BY doc),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
    weighed AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM counted, total GROUP BY term),
    asked AS (
        SELECT item, item_id, term, count(*) AS times
        FROM (SELECT item_id, row_number() OVER () AS item,
                     unnest(regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM benchmark)
        GROUP BY ALL),
    scored AS (
        SELECT item, item_id, doc, doc_id,
               sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
        FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN sizes USING (doc), total
        GROUP BY ALL),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
        FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""


def _encoded(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || ({column}::VARCHAR) END"


def _tree(name: str, source: str, group: str, levels: int) -> str:
    """Nodes of trees over `source` (group, i, d): per level the digests to both sides in the run."""
    ctes = [f"{name}0 AS MATERIALIZED (SELECT {group} AS g, i, d FROM {source})"]
    for k in range(levels):
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        ctes.append(f"""{name}{k}s AS MATERIALIZED (
            SELECT g, i, d, count(*) OVER (PARTITION BY g) AS width,
                   coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name}{k})""")
        ctes.append(f"""{name}{k + 1} AS MATERIALIZED (
            SELECT g, i // 8 AS i, CASE WHEN any_value(width) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
            FROM {name}{k}s GROUP BY g, i // 8)""")
    return ",\n".join(ctes)


def _climb(name: str, source: str, tree: str, group: str, rank: str, levels: int) -> str:
    """Rows of `source` with `f` folded and `p` prolonged by each level of a tree."""
    ctes = [f"{name}0 AS (SELECT * FROM {source})"]
    for k in range(levels):
        ctes.append(f"""{name}{k + 1} AS MATERIALIZED (
            SELECT c.* REPLACE (CASE WHEN width > 1 THEN sha256(l || f || r) ELSE f END AS f,
                                p || CASE WHEN width > 1 THEN l || r ELSE '' END AS p)
            FROM {name}{k} c JOIN {tree}{k}s s ON s.g IS NOT DISTINCT FROM c.{group} AND s.i = c.{rank} // {8**k})""")
    return ",\n".join(ctes)


def merkle_manifest(levels: int = 8, top_levels: int = 4) -> str:
    """SQL for at most 8^levels documents a language and 8^top_levels languages."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = "sha256(" + " || ".join(_encoded(f) for f in fields) + " || {})"
    changed = f"translate(text, {_LOWER})"
    return f"""
    WITH bits AS (
        SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
                    CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) AS r(i)),
    summed AS (
        SELECT documents.*, xor(4294967295::UBIGINT, list_reduce(
                   list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
                   lambda c, x: xor(t[1 + (xor(c, x) & 255)::BIGINT], c >> 8))) AS crc
        FROM documents, bits),
    leaves AS MATERIALIZED (
        SELECT doc_id, lang, {leaf.format(_encoded("text"))} AS d,
               CASE WHEN crc % 3 = 0 THEN {leaf.format(_encoded(changed))} END AS touched
        FROM summed),
    numbered AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM leaves),
    {_tree("n", "numbered", "lang", levels)},
    subroots AS MATERIALIZED (
        SELECT g AS lang, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM n{levels}),
    {_tree("m", "subroots", "0", top_levels)},
    asked AS MATERIALIZED (
        SELECT a.doc_id, a.lang, a.i, a.d AS leaf, s.d AS subroot, s.i AS place, 0 AS zero, coalesce(a.touched, a.d) AS f, '' AS p
        FROM numbered a JOIN subroots s ON s.lang IS NOT DISTINCT FROM a.lang),
    {_climb("u", "asked", "n", "lang", "i", levels)},
    {_climb("v", f"u{levels}", "m", "zero", "place", top_levels)}
    SELECT doc_id, leaf, subroot, root.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = root.d AS verified
    FROM v{top_levels}, m{top_levels} AS root"""
