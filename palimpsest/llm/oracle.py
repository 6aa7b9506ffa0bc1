"""DuckDB SQL of the opN_ queries that SQL can express.

op5 and op10 fit models and op8 hashes with XXH64, so they have none; tests/llm holds them against brute force.
"""

from __future__ import annotations

from palimpsest.llm import secret_scan

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ascii_case(pattern: str) -> str:
    """Either case of the keyword's letters, spelled out: (?i) would fold more than ASCII here."""
    head, _, tail = pattern.removeprefix("(?i)").partition(")")
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail


def _secrets() -> str:
    kinds = []
    for k, (name, pattern) in enumerate(secret_scan.KINDS):
        p = _ascii_case(pattern) if name == "assign" else pattern
        p = p.replace("'", "''")
        value = f"regexp_extract(hits[i], '{p}', 2)" if name == "assign" else "hits[i]"
        kinds.append(f"""SELECT doc_id, source, {k} AS kind, '{name}' AS name, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
            length(hits[i]) AS n, {value} AS value FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, source, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d))""")
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(kinds)}),
        g AS (SELECT doc_id, source, kind, name, s, s + n AS e, value FROM f WHERE (kind <> 0 OR length(value) >= 6)
            AND (kind <> 4 OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))),
        h AS (SELECT * FROM g WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM g AS b WHERE b.doc_id = g.doc_id AND b.kind < 3 AND b.s < g.e AND g.s < b.e)),
        j AS (SELECT * FROM h WHERE kind < 4 OR NOT EXISTS (SELECT 1 FROM h AS b WHERE b.doc_id = h.doc_id AND b.kind = 3 AND b.s < h.e AND h.s < b.e)),
        q AS (SELECT value, count(DISTINCT coalesce(concat('=', source), '')) AS owners FROM j GROUP BY value),
        z AS (SELECT j.*, owners = 1 AS live, owners > 1 AS copied, concat(name, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)) AS span FROM j JOIN q USING (value))
        SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
            sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
            coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR live), '') AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
        FROM d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id"""


SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
    k AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS first FROM p),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM k WHERE first < doc_id),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    y AS (SELECT x.doc_id, count(*) AS n_words, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS kept FROM x LEFT JOIN c USING (doc_id, i) GROUP BY x.doc_id)
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"""

LINES = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
    k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM x),
    n AS (SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    y AS (SELECT k.*, n.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN n USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM y GROUP BY doc_id"""

RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
    k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM p),
    c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM k WHERE n > 1) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS BIGINT) AS n_upper,
        coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 2 * n_upper > word_chars
        OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 2 * n_dup_lines > n_lines) AS kept FROM b"""

PAGES = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, lower(regexp_replace(coalesce(url, ''), '#.*$', '')) AS u FROM pages),
    f AS (SELECT *, CAST(strlen(h) AS BIGINT) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p),
    k AS (SELECT *, regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/?@]*@)?([^/:?]*)', 1) AS host, regexp_replace(u, '^[a-z][a-z0-9+.-]*://[^/?]*', '') AS rest, n >= 100 AND page_id <> first AS again FROM f)
    SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
        concat(array_to_string(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), ','), ')', rest) AS url_key, 1704067200 + page_id AS captured FROM k"""

LEAKS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
    b AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
    x AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
    n AS (SELECT item_id, count(*) AS n_shingles FROM x GROUP BY item_id),
    y AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
    m AS (SELECT doc_id, item_id, count(*) AS n_found FROM y JOIN x USING (k, s) GROUP BY ALL)
    SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM m JOIN n USING (item_id) WHERE n_found / n_shingles >= 0.8"""

MIX = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(concat('mix:', doc_id)) AS key FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
    a AS (SELECT *, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget, sum(weight) OVER () AS all_weight, cap / weight AS full_at FROM r),
    e AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM a
        WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, full_at < (budget - cap_before) / (all_weight - weight_before) AS full_up FROM e),
    g AS (SELECT *, sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER () AS cap_full, sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER () AS weight_left FROM f),
    t AS (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE weight * (budget - cap_full) / weight_left END AS target FROM g),
    u AS (SELECT d.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d)
    SELECT doc_id, size, source_size, target, CAST(least(size, greatest(0, floor(target) - start)) + least(size, greatest(0, floor(target) - source_size - start)) AS BIGINT) AS taken
    FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source"""


PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
    z AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
    g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM z, (SELECT unnest(range(1, 6)) AS m)),
    f AS (SELECT lang, w[i:i + m - 1] AS path, count(*) AS a FROM g GROUP BY ALL),
    t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM z GROUP BY lang),
    c AS (SELECT * FROM f WHERE len(path) > 1 AND a >= 100),
    k AS (SELECT *, unnest(range(1, len(path))) AS k FROM c),
    s AS (SELECT k.lang, k.path, k.a, k.k, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * k.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
        FROM k JOIN f AS l ON l.lang = k.lang AND l.path = k.path[1:k.k] JOIN f AS r ON r.lang = k.lang AND r.path = k.path[k.k + 1:len(k.path)] JOIN t ON t.lang = k.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, k) = 1),
    i AS (SELECT lang, path, a, unnest(range(1, len(path) + 1)) AS i FROM c),
    j AS (SELECT *, unnest(range(i + 1, len(path) + 1)) AS j FROM i),
    inside AS (SELECT lang, path[i:j] AS part, max(a) AS most FROM j WHERE j - i + 1 < len(path) GROUP BY ALL),
    o AS (SELECT b.*, array_to_string(b.path, ' ') AS phrase FROM b LEFT JOIN inside ON inside.lang = b.lang AND inside.part = b.path WHERE most IS NULL OR 100 * most < 100 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000"""

FILTERS = r"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
    lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (SELECT doc_id, part,
        (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN (doc_id IS NULL AND count(doc_id) OVER same > 0) OR doc_id > min(doc_id) OVER same THEN 16 ELSE 0 END) AS mask
        FROM w WINDOW same AS (PARTITION BY text)),
    m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN lab ON lab.doc_id = f.doc_id GROUP BY part, mask),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
    g AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m, s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": _secrets(),
        "op2_substring_dedup": SUBSTRINGS,
        "op3_line_dedup": LINES,
        "op4_quality_rules": RULES,
        "op6_warc": PAGES,
        "op7_decontamination": LEAKS,
        "op9_mixing": MIX,
        "op12_collocations": PHRASES,
        "op13_filter_audit": FILTERS,
    }
