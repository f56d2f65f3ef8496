"""SQL that gives the rows of those operators that SQL can express."""

from framequarry.llm import collocations
from framequarry.llm.quality import Limits
from framequarry.llm.warc import TRACKING

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_L = Limits()

QUALITY = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
    c AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
        FROM d LEFT JOIN cov USING (doc_id)),
    f AS (SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_percent} * n_words AS base_failed,
        CAST(100 * n_symbols > {_L.max_symbols_per_100_words} * n_words AS INTEGER) + CAST(100 * n_dup_lines > {_L.max_dup_line_percent} * n_lines AS INTEGER)
            + CAST(word_chars > {_L.max_word_length} * n_words AS INTEGER) AS soft FROM c),
    h AS (SELECT host, count(*) AS docs, sum(CAST(base_failed OR soft > 0 AS INTEGER)) AS failed FROM f GROUP BY host),
    m AS (SELECT least(greatest(avg(failed / docs), 1e-3), 1 - 1e-3) AS mean, var_pop(failed / docs) AS v, avg(1.0::DOUBLE / docs) AS inv FROM h),
    b AS (SELECT mean, greatest(v - mean * (1 - mean) * inv, 0.0::DOUBLE) AS between_hosts FROM m),
    p AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 2.0::DOUBLE), 1000.0::DOUBLE) ELSE 1000.0::DOUBLE END AS k FROM b),
    r AS (SELECT host, (failed + mean * k) / (docs + k) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR rate >= {_L.block_rate} OR soft >= 2 OR (soft >= 1 AND rate >= {_L.reject_rate})) AS kept
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM d),
    u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach(node, top) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.top FROM reach r JOIN pairs p ON r.node = p.a WHERE r.top < p.b),
    comp AS (SELECT node, min(top) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON doc_id = node"""

NGRAM_JOIN = NEAR_DUPLICATES.replace("85 *", "90 *").replace(", doc_id = component_id AS kept", "")

_STAMP = "strftime(make_timestamp((1700000000 + {}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_AT = "page_id * 60"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www\\.', '')"
_TRACK = ", ".join(f"'{t}'" for t in TRACKING)

REVISITS = rf"""
WITH base AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, page_id % 7 AS kind FROM pages),
    cap AS (
        SELECT page_id, url, 'r' || page_id AS record_id, 'response' AS warc_type, {_STAMP.format(_AT)} AS captured,
            '"' || digest || '"' AS etag, {_STAMP.format(_AT + " - 30")} AS modified, {_STAMP.format(_AT)} AS stamp, 'text/html' AS ctype, NULL AS server FROM base
        UNION ALL
        SELECT page_id, url, 'v' || page_id, 'revisit', {_STAMP.format(f"CASE WHEN kind = 6 THEN {_AT} - 45 ELSE {_AT} + 3600 + kind END")},
            CASE WHEN kind = 3 THEN '"' || reverse(digest) || '"' WHEN kind IN (4, 5) THEN NULL ELSE 'W/"' || digest || '"' END,
            CASE WHEN kind = 4 THEN {_STAMP.format(_AT + " - 30")} END,
            {_STAMP.format(f"CASE WHEN kind = 6 THEN {_AT} - 45 ELSE {_AT} + 3600 + kind END")}, 'text/plain', CASE WHEN kind = 5 THEN 'edge' END FROM base),
    bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM cap),
    parts AS (SELECT *, {_HOST} AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(/index\.html?)?/*$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND lower(string_split(q, '=')[1]) NOT IN ({_TRACK}))) AS q FROM bare),
    keyed AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM parts),
    prior AS (SELECT *, last_value(CASE WHEN warc_type = 'response' THEN {{'id': record_id, 'etag': etag, 'modified': modified, 'stamp': stamp, 'ctype': ctype}} END IGNORE NULLS)
        OVER (PARTITION BY canonical ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM keyed),
    judged AS (SELECT *, CASE WHEN warc_type = 'response' THEN 'full' WHEN p IS NULL THEN 'unresolved'
        WHEN etag IS NOT NULL AND p.etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(p.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
        WHEN modified IS NOT NULL AND p.modified IS NOT NULL THEN CASE WHEN modified = p.modified THEN 'resolved' ELSE 'mismatch' END
        ELSE 'unverified' END AS status FROM prior),
    merged AS (SELECT *, status IN ('resolved', 'unverified') AS taken FROM judged)
SELECT page_id, record_id, warc_type, captured, canonical, status,
    CASE WHEN status = 'full' THEN record_id WHEN taken THEN p.id END AS resolved_id,
    array_to_string(list_filter([
        'content-type=' || CASE WHEN taken THEN p.ctype ELSE ctype END,
        'date=' || stamp,
        'etag=' || CASE WHEN taken THEN coalesce(etag, p.etag) ELSE etag END,
        'last-modified=' || CASE WHEN taken THEN coalesce(modified, p.modified) ELSE modified END,
        'server=' || CASE WHEN taken THEN NULL ELSE server END], lambda x: x IS NOT NULL), ';') AS merged_headers
FROM merged"""

_C = collocations

COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, 5)) AS words)),
    f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
    t AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
    c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {_C.LEAST_COUNT}),
    cut AS (SELECT lang, words, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
    s AS (SELECT cut.*, l.f AS l, r.f AS r, CAST({_C.SCALE}::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score FROM cut
        JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = rest),
    low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_phrase AS (SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, words - n + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS n FROM c WHERE words > 2))),
    around AS (SELECT lang, phrase, max(a) AS most FROM inner_phrase GROUP BY ALL),
    kept AS (SELECT low.* FROM low LEFT JOIN around ON around.lang = low.lang AND around.phrase = low.phrase WHERE most IS NULL OR 100 * most < {_C.COVERED_PERCENT} * low.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN t USING (lang) WHERE rank <= {_C.FIRST}"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": QUALITY, "op5_near_dedup": NEAR_DUPLICATES, "op10_warc": REVISITS, "op11_ngram_join": NGRAM_JOIN, "op12_collocations": COLLOCATIONS}
