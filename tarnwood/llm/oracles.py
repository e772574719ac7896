"""DuckDB twins of the queries that SQL can express.

They say the same thing over the whole tables by plain means (all pairs, closures), so they suit
small scale factors only.
"""

from __future__ import annotations

from tarnwood.llm.urlfilter import RULES

_WORD = r"[^\x20\x09-\x0D]+"
_BIG, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(links: str, before: str) -> str:
    """CTEs after ``before``: both directions of ``links`` (a, b), and what each node reaches."""
    return (
        f"WITH RECURSIVE {before}, links AS ({links}), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), "
        "reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a), "
        "least_of AS (SELECT a, LEAST(a, MIN(b)) AS low FROM reach GROUP BY a)"
    )


_VECTORS = (
    "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "good AS (SELECT vec_id, e FROM vecs WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)"
)
_NEAR = "SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9"

_SHINGLES = (
    f"texts AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_BIG}', '{_SMALL}'), '{_WORD}') AS w FROM documents), "
    "placed AS (SELECT doc_id, UNNEST(w) AS x, generate_subscripts(w, 1) AS i FROM texts), "
    "four AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS s FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)), "
    "sets AS (SELECT DISTINCT doc_id, s FROM four WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 3), "
    "sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY 1), "
    "shared AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)"
)
_LINKED = "SELECT shared.a, shared.b FROM shared JOIN sizes p ON p.doc_id = shared.a JOIN sizes q ON q.doc_id = shared.b WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)"

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": f"""{_components(_NEAR, _VECTORS)}
        SELECT v.vec_id, COALESCE(n.n_links, 0) AS n_links, COALESCE(l.low, v.vec_id) AS component_id, v.vec_id = COALESCE(l.low, v.vec_id) AS kept
        FROM vecs v LEFT JOIN (SELECT a, COUNT(*) AS n_links FROM both_ways GROUP BY 1) n ON n.a = v.vec_id LEFT JOIN least_of l ON l.a = v.vec_id""",
    "op3_warc": """SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
        CASE WHEN strlen(h) >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN strlen(h) >= 100 AND page_id <> low THEN low END AS refers_to
        FROM (SELECT page_id, COALESCE(html, '') AS h, MIN(page_id) OVER (PARTITION BY COALESCE(html, '')) AS low FROM pages)""",
    "op5_jaccard_join": f"""{_components(_LINKED, _SHINGLES)}
        SELECT d.doc_id, COALESCE(z.n, 0) AS n_shingles, COALESCE(l.low, d.doc_id) AS component_id
        FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id""",
    "op6_url_filter": f"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        named AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_BIG}', '{_SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules AS (SELECT * FROM (VALUES {_RULES}) t(verdict, h, p))
        SELECT n.page_id, n.host, n.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, COALESCE(arg_max(r.verdict, length(r.h || r.p)), 'allow') AS verdict
        FROM named n LEFT JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p) GROUP BY 1, 2, 3""",
    "op7_quality_rules": f"""WITH texts AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '{_WORD}') AS w FROM documents),
        placed AS (SELECT doc_id, UNNEST(w) AS x, generate_subscripts(w, 1) AS i FROM texts),
        three AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS s FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, s) AS n FROM three WHERE s IS NOT NULL) WHERE n > 1),
        inside AS (SELECT doc_id, COUNT(DISTINCT place) AS n FROM (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS place FROM twice) GROUP BY 1),
        base AS (SELECT texts.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS BIGINT) AS n_dup_lines,
            COALESCE(inside.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS upper_letters, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
            len(regexp_extract_all(t, '!')) AS marks, len(string_split(t, chr(10))) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS with_letter
            FROM texts LEFT JOIN inside ON inside.doc_id = texts.doc_id),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR 10 * n_symbols > 2 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * upper_letters > 3 * letters OR 10 * marks > 2 * n_words
                OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * with_letter < 6 * n_words) AS kept
        FROM judged""",
}
