"""DuckDB SQL for the training-data queries that SQL can express on whole tables.

Toxicity, language ID and HTML extraction are trained models, decontamination verifies alignments, and mixing selects by
a seeded hash; these have brute-force and held-out tests instead.
"""

from __future__ import annotations

from engram.llm import licenses, quality, secrets, urls

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _quality() -> str:
    blank = r"[\x20\x09-\x0D]"
    stops = ", ".join(quoted(w) for w in quality.STOP_WORDS)
    metrics = {
        "mean_word_chars": "CASE WHEN n > 0 THEN word_chars::DOUBLE / n ELSE 0 END",
        "symbols_per_word": "CASE WHEN n > 0 THEN n_symbols::DOUBLE / n ELSE 0 END",
        "stop_word_ratio": "CASE WHEN n > 0 THEN n_stop::DOUBLE / n ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN dup::DOUBLE / n_lines ELSE 0 END",
        "capital_ratio": "CASE WHEN word_chars > 0 THEN n_capitals::DOUBLE / word_chars ELSE 0 END",
    }
    bad = [f"{metrics[r.metric]} < {r.low}" for r in quality.RULES if r.low is not None] + [f"{metrics[r.metric]} > {r.high}" for r in quality.RULES if r.high is not None]
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
 g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
 r AS (SELECT doc_id, count(DISTINCT q) AS rep FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 m AS (SELECT d.doc_id, len(w)::BIGINT AS n, length(regexp_replace(t, '{blank}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS dup, coalesce(rep, 0)::BIGINT AS rep,
 len(list_filter(regexp_split_to_array(translate(lower(t), {quoted(quality.EDGE_MARKS)}, ''), '{blank}+'), lambda x: x IN ({stops}))) AS n_stop,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
 SELECT doc_id, n AS n_words, word_chars, n_symbols, dup AS n_dup_lines, rep AS n_repeat_words, n < 50 OR 100 * rep > 50 * n AS base_failed,
 NOT (n < 50 OR 100 * rep > 50 * n OR {' OR '.join(bad)}) AS kept FROM m"""


#: The base patterns as the contract states them. Runs of ``access`` and ``hex`` are maximal, so their least length may stand in
#: the pattern; a short ``assign`` uses up its text and goes afterwards.
BASE_SECRETS = {
    "assign": r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
LEAST_SECRETS = {"assign": 12}


def _spans(kind: secrets.Kind, rank: int) -> str:
    p, least = quoted(BASE_SECRETS.get(kind.name, kind.pattern)), LEAST_SECRETS.get(kind.name, kind.least)
    value = f"regexp_extract(m, {p}, {kind.group})" if kind.group else "m"
    good = f"length({value}) >= {least}" if not kind.mixed else f"regexp_matches({value}, '[0-9]') AND regexp_matches({value}, '[a-z]') AND regexp_matches({value}, '[A-Z]')"
    return f"""SELECT doc_id, source, {quoted(kind.name)} AS kind, {rank} AS rank, s AS start, s + length(m) AS stop, {value} AS value FROM (
 SELECT doc_id, source, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s FROM (
 SELECT doc_id, source, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gaps FROM documents WHERE regexp_matches(text, {p}))) WHERE {good}"""


def _secrets() -> str:
    kinds = [*secrets.BASE, *secrets.WIDE]
    n, most = len(secrets.BASE), secrets.Limits()
    every = " UNION ALL ".join(_spans(k, i) for i, k in enumerate(kinds))
    text = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
    return f"""WITH s AS ({every}), o AS (SELECT sha256(value) AS h, count(DISTINCT coalesce(split_part(source, '/', 1), '')) <= {most.owners} AND count(DISTINCT coalesce(source, '')) <= {most.repos} AS owned FROM s GROUP BY 1),
 x AS (SELECT s.*, o.owned, rank < {n} AS base FROM s JOIN o ON o.h = sha256(value)),
 a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 {text.format(' FILTER (base)')} AS b, {text.format(' FILTER (base OR owned)')} AS sp, count(*) FILTER (owned) AS n_owned, count(*) FILTER (NOT owned) AS n_copied FROM x GROUP BY 1)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(sp, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM documents d LEFT JOIN a USING (doc_id)"""


SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
 g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
 late AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS f FROM g) WHERE f < doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM late),
 words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

NEAR_COPIES = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.CAPITALS}', '{urls.SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 both2 AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM both2 JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, sym.b FROM reach r JOIN sym ON sym.a = r.b),
 comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)"""


def _rule(host: str, path: str, what: str) -> str:
    cases = " ".join(f"WHEN ({host} = {quoted(r.host)} OR ends_with({host}, {quoted('.' + r.host)})) AND starts_with({path}, {quoted(r.path)}) THEN {quoted(getattr(r, what))}" for r in sorted(urls.RULES, key=lambda r: (-len(r.name), -len(r.host), r.name)))
    return f"CASE {cases} END"


def _parts(url: str) -> str:
    tail = f"CASE WHEN contains({url}, '://') THEN split_part(substr({url}, instr({url}, '://') + 3), '#', 1) ELSE '' END"
    return rf"translate(regexp_extract({tail}, '^[^/?]*'), '{urls.CAPITALS}', '{urls.SMALL}') AS host, regexp_replace({tail}, '^[^/?]*', '') AS rest"


def _decoded(target: str) -> str:
    rest = "substr(p, instr(p, ';') + 1)"
    number = "CASE WHEN regexp_matches(p, '^#[0-9]{1,7};') THEN regexp_extract(p, '^#([0-9]+);', 1)::INTEGER WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{1,6};') THEN ('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1))::INTEGER END"
    named = " ".join(f"WHEN starts_with(p, {quoted(n + ';')}) THEN {quoted(c)} || {rest}" for n, c in urls.NAMED.items())
    return f"array_to_string(list_transform(string_split({target}, '&'), lambda p, i: CASE WHEN i = 1 THEN p WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr({number}) || {rest} {named} ELSE '&' || p END), '')"


#: Patterns of their own, beside those of the operator.
UNREAD_HTML = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{x}\b[^>]*>.*?(?:</{x}\b[^>]*>|\z)" for x in ("script", "style", "textarea", "title", "template", "xmp"))
LINK_TAG = r"""(?is)<(?:link|meta)(?:[\s/](?:[^>"']|"[^"]*"|'[^']*')*)?>|<(?:link|meta)(?:[\s/][^>]*)?>"""
ATTRS = "regexp_extract_all(tag[6:], " + quoted(r"""(?s)[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""") + ")"


def _held(name: str) -> str:
    first = f"list_filter(pairs, lambda x: lower(regexp_extract(x, '^[^\\s=]+')) = '{name}')[1]"
    value = f"regexp_replace({first}, '(?s)^[^=]*=\\s*', '')"
    bare = f"""(CASE WHEN left({value}, 1) IN ('"', '''') THEN substr({value}, 2, length({value}) - 2) ELSE {value} END)"""
    return f"regexp_replace({_decoded(bare)}, '^\\s+|\\s+$', '', 'g')"


def _urls() -> str:
    return rf"""WITH RECURSIVE p AS (SELECT page_id, html, {_parts("coalesce(url, '')")} FROM pages), u AS (SELECT *, split_part(rest, '?', 1) AS path, host || rest AS k FROM p),
 seen AS (SELECT host, path, k, regexp_replace(html, {quoted(UNREAD_HTML)}, ' ', 'g') AS h FROM u),
 tags AS (SELECT host, path, k, unnest(regexp_extract_all(h, {quoted(LINK_TAG)})) AS tag FROM seen),
 attrs AS (SELECT host, path, k, lower(tag[2:5]) AS el, {ATTRS} AS pairs FROM tags),
 held AS (SELECT host, path, k, el, {_held("rel")} AS rel, {_held("href")} AS href, {_held("http-equiv")} AS equiv, {_held("content")} AS content FROM attrs),
 goals AS (SELECT host, path, k, CASE WHEN el = 'link' AND list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical') THEN href
 WHEN el = 'meta' AND lower(equiv) = 'refresh' THEN regexp_extract(content, '(?is)^[\s\d.]*[\s;,]\s*url\s*=\s*(.*)$', 1) END AS g, el FROM held),
 t AS (SELECT host, path, k, CASE WHEN el = 'meta' AND g[1] = '"' THEN trim(split_part(g[2:], '"', 1)) WHEN el = 'meta' AND g[1] = '''' THEN trim(split_part(g[2:], '''', 1)) ELSE trim(g) END AS target FROM goals WHERE g <> ''),
 f AS (SELECT k, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN 'http://' || host || target WHEN starts_with(target, '?') THEN 'http://' || host || path || target ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || target END AS url FROM t WHERE target <> ''),
 e AS (SELECT k AS a, host || rest AS b FROM (SELECT k, {_parts("url")} FROM f)), sym AS (SELECT a, b FROM e WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM e WHERE a <> '' AND b <> '' AND a <> b),
 reach AS (SELECT DISTINCT a, a AS b FROM sym UNION SELECT r.a, sym.b FROM reach r JOIN sym ON sym.a = r.b),
 cls AS (SELECT a AS k, min({_rule("split_part(split_part(b, '/', 1), '?', 1)", "split_part(regexp_replace(b, '^[^/?]*', ''), '?', 1)", "verdict")}) AS v FROM reach GROUP BY 1)
 SELECT page_id, host, path, {_rule("host", "path", "name")} AS rule, coalesce({_rule("host", "path", "verdict")}, v, 'allow') AS verdict FROM u LEFT JOIN cls USING (k)"""


def _licenses() -> str:
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"

    def rule(i: int, r: licenses.Rule) -> str:
        p = quoted(r.regex)
        return f"SELECT doc_id, {i} AS rank, {quoted(r.label)} AS label, {r.weight} AS weight, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})"

    phrases = ", ".join(f"({quoted(' ' + p.replace(' ', '  ') + ' ')}, {quoted(label)}, {len(p.split())})" for p, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")))
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.CAPITALS}', '{licenses.SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 d AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS t FROM w),
 b AS (SELECT doc_id, label, len(parts) - 1 AS n, {spaces("parts[1]")} // 2 AS f, n_words - {spaces("parts[len(parts)]")} // 2 - k AS l FROM (SELECT doc_id, n_words, label, k, string_split(t, phrase) AS parts FROM d, (VALUES {phrases}) AS p(phrase, label, k) WHERE contains(t, phrase))),
 base AS (SELECT doc_id, sum(n)::BIGINT AS n_base, min(f)::BIGINT AS first_word, max(l)::BIGINT AS last_word, string_agg(label, ',' ORDER BY label) AS base_labels, list(label) AS ls FROM b GROUP BY 1),
 hits AS ({" UNION ALL ".join(rule(i, r) for i, r in enumerate(licenses.RULES))}),
 m AS (SELECT doc_id, rank, label, weight, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM hits),
 s AS (SELECT doc_id, rank, label, weight, sum({spaces("g")} + {spaces("m")}) OVER (PARTITION BY doc_id, rank ORDER BY i) // 2 AS e, {spaces("m")} // 2 AS n FROM m),
 o AS (SELECT x.*, x.e - x.n AS s FROM s x),
 own AS (SELECT * FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND y.e >= x.e AND (y.s < x.s OR y.e > x.e OR y.rank < x.rank))),
 near AS (SELECT *, coalesce(lag(e) OVER q > s AND lag(rank) OVER q < rank, false) OR coalesce(lead(s) OVER q < e AND lead(rank) OVER q < rank, false) AS loses FROM own WINDOW q AS (PARTITION BY doc_id ORDER BY s)),
 found AS (SELECT doc_id, list(label) AS ls, max(weight) AS score FROM near WHERE NOT loses GROUP BY 1)
 SELECT d.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
 array_to_string(list_sort(list_distinct(coalesce(base.ls, []) || coalesce(found.ls, []))), ',') AS labels, greatest(coalesce(found.score, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
 FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
 total AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
 occ AS (SELECT lang, source, term, count(*) AS c FROM e SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
 grp AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN occ USING (lang, source) GROUP BY 1, 2),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (g.n + v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (t.n + v) AS q FROM grp g JOIN kept k USING (lang) JOIN total t USING (lang) LEFT JOIN occ USING (lang, source, term)),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS i, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) z ON z.lang = a.lang AND s = a.source AND i = b.source),
 terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
 ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
 SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

INFILL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 n AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
 c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
 o AS (SELECT *, '<P>' || t[1:a] AS p, '<S>' || t[b + 1:] AS s, '<M>' || CASE WHEN b > a THEN t[a + 1:b] ELSE '' END AS m FROM c),
 r AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN CASE WHEN a = 0 THEN '<P>' ELSE p END || s || m ELSE s || CASE WHEN a = 0 THEN '<P>' ELSE p END || m END AS output FROM o),
 x AS (SELECT *, string_split_regex(output, '<P>|<S>|<M>') AS parts FROM r)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
 sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN parts[2] || parts[4] || parts[3] ELSE parts[3] || parts[4] || parts[2] END) AS restored_sha256 FROM x"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": _quality(),
    "op4_secret_scan": _secrets(),
    "op8_substring_dedup": SUBSTRINGS,
    "op9_minhash_dedup": NEAR_COPIES,
    "op10_url_filter": _urls(),
    "op11_license_scan": _licenses(),
    "op12_source_divergence": DIVERGENCE,
    "op13_fill_in_middle": INFILL,
}
