"""SQL of the queries that SQL can express, over whole tables."""

_QUOTE = "[\"''`‘’“”]*"
_BLANK = r"[\s\p{Z}\p{Cf}]"
_NAME = rf"{_QUOTE}[\p{{L}}_][\p{{L}}\p{{N}}_.\-]*{_QUOTE}{_BLANK}*(?:=>|->|:=|=|:)"
_PART = rf"(?:{_BLANK}|[,;|&])+({_NAME})"


def _bare(c: str) -> str:
    return rf"replace(replace(lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}]+', '', 'g')), 'ς', 'σ'), 'ß', 'ss')"


_LIST = f"""array_to_string(list_sort(list_transform(string_split(regexp_replace(body, '{_PART}', chr(1) || '\\1', 'g'), chr(1)),
    lambda p: {_bare(f"regexp_extract(p, '^({_NAME})', 1)")} || chr(2) || {_bare(f"regexp_replace(p, '^{_NAME}', '')")})), chr(1))"""

_WHOLE = rf"""
        WITH c AS (SELECT id, signature, error_excerpt, {_bare("signature")} AS s, {_bare("error_excerpt")} AS t, regexp_replace(error_excerpt, '^[^\p{{L}}\p{{N}}]+', '') AS body FROM cases),
        l AS (SELECT id, signature, error_excerpt, s, t, CASE WHEN regexp_matches(body, '^{_NAME}') AND regexp_matches(body, '{_PART}') THEN {_LIST} END AS l FROM c),
        w AS (SELECT id, signature, error_excerpt, s, coalesce(chr(3) || min(l) OVER (PARTITION BY s, t), t) AS w FROM l)
"""

ORACLES = {
    "p2_found": f"{_WHOLE}, f AS (SELECT id, min(id) OVER (PARTITION BY s, w) AS first_id FROM w) SELECT first_id, id FROM f WHERE id <> first_id",
    "p2_copies": f"{_WHOLE} SELECT min(id) AS first_id, count(*) AS copies, count(DISTINCT (signature, error_excerpt)) AS spellings FROM w GROUP BY s, w.w",
    "p4_found": r"""
        WITH RECURSIVE r AS (SELECT DISTINCT experience_id AS k, regexp_extract_all(lower(coalesce(goal, '') || ' ' || diagnosis), '[\p{L}\p{N}]+') AS w FROM experiences WHERE diagnosis IS NOT NULL),
        i AS (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM r),
        s AS (SELECT DISTINCT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM i),
        n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 3 * c >= x.n + y.n),
        reach AS (SELECT a AS k, a AS m FROM e UNION SELECT reach.k, e.b FROM reach JOIN e ON e.a = reach.m)
        SELECT min(m) AS first_id, k AS experience_id FROM reach GROUP BY k HAVING min(m) <> k
    """,
    "p7_found": r"""
        WITH h AS (SELECT item_id, regexp_extract_all(lower(diagnosis), '[\p{L}\p{N}]+') AS w FROM holdout WHERE diagnosis IS NOT NULL),
        hw AS (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM h),
        items AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS win FROM hw),
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        dw AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM d),
        wins AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS win FROM dw)
        SELECT DISTINCT doc_id, item_id FROM wins JOIN items USING (win)
    """,
}
