"""The same results as SQL (DuckDB), where SQL can express them."""

from __future__ import annotations

import math
import string

_WORDS = r"d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"

SUBSTRING_DEDUP = f"""
WITH {_WORDS},
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM places),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM windows JOIN firsts USING (g), range(0, 13) AS r(j) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NGRAM_JOIN = f"""
WITH RECURSIVE {_WORDS},
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5
        THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
keyed AS (SELECT doc_id, s, md5(array_to_string(s, chr(10))) AS node FROM sets),
nodes AS (SELECT node, any_value(s) AS s, count(*) AS copies, min(doc_id) AS least FROM keyed GROUP BY node),
grams AS (SELECT node, len(s) AS n, unnest(s) AS g FROM nodes),
pairs AS (SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
classes AS (SELECT reach.node, min(least) AS class_id FROM reach JOIN nodes ON other = nodes.node GROUP BY reach.node),
links AS (SELECT a AS node, sum(copies) AS n FROM edges JOIN nodes ON b = node GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n, 0) + copies - 1 AS BIGINT) AS n_links, CAST(copies AS BIGINT) AS n_copies
FROM keyed JOIN nodes USING (node) JOIN classes USING (node) LEFT JOIN links USING (node)"""


def url_filter(rules: dict[str, str], damping: float = 0.85, least: float = 1e-14) -> str:
    """Rules and ranks: what moves on, one round after the other, until it is next to nothing at every host."""
    lower = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

    def host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), {lower})"

    fits = " ".join(
        f"WHEN (host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'"
        for r in sorted(rules, key=len, reverse=True))
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules.items())
    return f"""
WITH RECURSIVE split AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {fits} END AS rule FROM split),
judged AS (SELECT *, CASE rule {said} END AS said FROM ruled),
found AS (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM judged),
targets AS (SELECT host AS source, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {host('link')}
    WHEN starts_with(link, '//') THEN {host("('http:' || link)")}
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:|^#') THEN '' ELSE host END AS target FROM found),
links AS (SELECT source, target, count(*) AS n FROM targets WHERE source <> '' AND target <> '' GROUP BY source, target),
edges AS (SELECT 'trust' AS kind, source, target, n FROM links UNION ALL SELECT 'distrust', target, source, n FROM links),
weighted AS MATERIALIZED (SELECT kind, source, target, n / sum(n) OVER (PARTITION BY kind, source) AS w FROM edges),
r0 AS MATERIALIZED (SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, {1 - damping} * count(*) AS p
    FROM judged WHERE said IS NOT NULL AND host <> '' GROUP BY ALL),
moved(kind, host, p) AS (SELECT * FROM r0 UNION ALL
    SELECT e.kind, e.target, sum({damping} * r.p * e.w) FROM moved r JOIN weighted e ON e.kind = r.kind AND e.source = r.host WHERE r.p > {least} GROUP BY ALL),
scores AS (SELECT host, coalesce(sum(p) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(p) FILTER (kind = 'distrust'), 0) AS d
    FROM moved GROUP BY host)
SELECT page_id, host, path, rule,
    coalesce(said, CASE WHEN coalesce(d, 0) - coalesce(t, 0) > 1e-9 * (coalesce(d, 0) + coalesce(t, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)"""


_LEAF = "sha256({} || {})".format(
    " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars")),
    "coalesce(strlen({0}) || ':' || {0}, '-')")
# the checksum of the decimal id, byte by byte and bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END))"""

MERKLE = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {_LEAF.format('text')} AS leaf, CASE WHEN {_CRC} % 2 = 0
        THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format('text')} END AS other FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
low(source, k, pos, n, h) AS (SELECT source, 0, pos, n, leaf FROM placed UNION ALL
    SELECT source, k + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, k, pos // 3, n),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(k, pos, n, h) AS (SELECT 0, pos, n, subroot FROM subroots UNION ALL
    SELECT k + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY k, pos // 3, n),
steps AS (
    SELECT d.doc_id, 0 AS part, k, coalesce(string_agg(h, '' ORDER BY l.pos) FILTER (l.pos < d.pos // CAST(3 ** k AS BIGINT)), '') AS b,
        coalesce(string_agg(h, '' ORDER BY l.pos) FILTER (l.pos > d.pos // CAST(3 ** k AS BIGINT)), '') AS a
    FROM placed d JOIN low l ON l.source IS NOT DISTINCT FROM d.source AND l.n > 1 AND l.pos // 3 = d.pos // CAST(3 ** (k + 1) AS BIGINT) GROUP BY ALL
    UNION ALL
    SELECT d.doc_id, 1, k, coalesce(string_agg(h, '' ORDER BY l.pos) FILTER (l.pos < s.pos // CAST(3 ** k AS BIGINT)), ''),
        coalesce(string_agg(h, '' ORDER BY l.pos) FILTER (l.pos > s.pos // CAST(3 ** k AS BIGINT)), '')
    FROM placed d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
    JOIN high l ON l.n > 1 AND l.pos // 3 = s.pos // CAST(3 ** (k + 1) AS BIGINT) GROUP BY ALL),
ways AS (SELECT doc_id, string_agg(b || a, '' ORDER BY part, k) AS proof, list({{'b': b, 'a': a}} ORDER BY part, k) AS way FROM steps GROUP BY doc_id),
ends AS (SELECT d.doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend({{'b': other, 'a': ''}}, coalesce(way, [])), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
    FROM placed d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN ways w ON w.doc_id = d.doc_id)
SELECT *, folded_root = root AS verified FROM ends"""


COLLOCATIONS = f"""
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 5) AS s(k) WHERE len(w) >= k),
counts AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
numbers AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
inner_ones AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase
    FROM found WHERE k > 2),
longer AS (SELECT lang, phrase, max(a) AS f FROM inner_ones GROUP BY ALL),
alone AS (SELECT f.* FROM found f LEFT JOIN longer l USING (lang, phrase) WHERE l.f IS NULL OR 100 * l.f::HUGEINT < 80 * f.a::HUGEINT),
cuts AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS c FROM alone),
scored AS (SELECT t.lang, t.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM cuts t
    JOIN counts x ON x.lang = t.lang AND x.phrase = array_to_string(t.w[1:t.c], ' ')
    JOIN counts y ON y.lang = t.lang AND y.phrase = array_to_string(t.w[t.c + 1:t.k], ' ')),
best AS (SELECT lang, phrase, a, min({{'score': score, 'c': c, 'l': l, 'r': r}}) AS b FROM scored GROUP BY lang, phrase, a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, b.score AS score FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN numbers USING (lang) WHERE rank <= 2000"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, sha256(bare) AS text_sha256 FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


def quality_rules(measures: dict[str, float], shares: dict[str, float], reach: float, gamma: float, spread: float = 8.0, prior: int = 20) -> str:
    """Base columns; then each group's quantiles from its sorted buckets, limits that lean on wider groups, verdicts."""
    blank = r"[^\x20\x09-\x0D]"
    value = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "mean_word_chars": "word_chars / greatest(n_words, 1)",
             "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_word_share": "n_repeat_words / greatest(n_words, 1)"}
    each = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, {value[m]} AS v FROM based" for m in measures)

    def limit(m: str) -> str:
        if m in shares:
            return f"mid + least({spread} * greatest(high - mid, {measures[m]}), {reach} * ({shares[m]} - mid))"
        return f"mid + {spread} * greatest(mid - low, {measures[m]})"

    def limits(keys: str) -> str:
        quantile = ", ".join(
            f"(CASE WHEN b[k] IS NULL THEN 0 ELSE 2 * pow({gamma!r}, b[k]) / {gamma + 1!r} END) AS {c}".replace("b[k]", f"b[CAST(floor({q} * (n - 1)) AS BIGINT) + 1]")
            for c, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75)))
        chosen = " ".join(f"WHEN '{m}' THEN {limit(m)}" for m in measures)
        return f"""(SELECT {keys}, n, CASE measure {chosen} END AS own FROM (SELECT *, {quantile} FROM (
            SELECT {keys}, count(*) AS n, list(bucket ORDER BY bucket NULLS FIRST) AS b FROM buckets GROUP BY {keys})))"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{blank}+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
places AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM places WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 3) AS r(j) GROUP BY doc_id),
counted AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)),
based AS MATERIALIZED (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
measured AS MATERIALIZED ({each}),
buckets AS MATERIALIZED (SELECT lang, source, measure, CASE WHEN v > 0 THEN ceil(ln(v) / {math.log(gamma)!r}) END AS bucket FROM measured WHERE NOT base_failed),
leaning AS (SELECT g.lang, g.source, g.measure, (g.n * g.own + {prior} * (l.n * l.own + {prior} * a.own) / (l.n + {prior})) / (g.n + {prior}) AS most
    FROM {limits('lang, source, measure')} g JOIN {limits('lang, measure')} l ON l.lang IS NOT DISTINCT FROM g.lang AND l.measure = g.measure
    JOIN {limits('measure')} a ON a.measure = g.measure),
above AS (SELECT DISTINCT doc_id FROM measured m JOIN leaning l ON l.lang IS NOT DISTINCT FROM m.lang AND l.source IS NOT DISTINCT FROM m.source AND l.measure = m.measure WHERE v > most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM above) AS kept FROM based"""


# bytes as blobs; what is left is put together again from its runs
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100),
keyed AS MATERIALIZED (SELECT doc_id, i, md5(b[i:i + 99]) AS k FROM places),
later AS (SELECT doc_id, i FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
begins AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > 100, true) AS fresh FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 99 AS e FROM (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM begins) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER w, 0) + 1 AS s, s - 1 AS e FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY s)
    UNION ALL SELECT d.doc_id, coalesce(max(e), 0) + 1, any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[g.s:g.e]), '' ORDER BY g.s) AS x FROM gaps g JOIN d USING (doc_id) WHERE g.e >= g.s GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(e - s + 1) AS n_removed FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""
