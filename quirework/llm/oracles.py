"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from quirework.llm import near_dedup, quality_rules, suffix_dedup

_WORDS = "regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"
_UPPER = "".join(map(chr, range(65, 91)))


def _grams(n: int) -> str:
    """Words inside n-grams that occur twice or more in their text, as CTE g{n}(doc_id, i)."""
    key = " || ' ' || ".join(f"lead(w, {k}) OVER t" if k else "w" for k in range(n))
    return f"""
k{n} AS (SELECT doc_id, i, {key} AS k FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
r{n} AS (SELECT doc_id, i FROM k{n} WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
g{n} AS (SELECT DISTINCT doc_id, i + j AS i FROM r{n}, range(0, {n}) AS s(j))"""


def quality() -> str:
    """op4."""
    lengths = sorted(quality_rules.NGRAM_LIMITS)
    grams = ",".join(_grams(n) for n in (quality_rules.BASE_WINDOW, *lengths))
    counted = ", ".join(f"(SELECT coalesce(sum(length(w)), 0)::BIGINT FROM words x JOIN g{n} y ON y.doc_id = x.doc_id AND y.i = x.i WHERE x.doc_id = d.doc_id) AS dup_{n}gram_chars" for n in lengths)
    shares = " AND ".join(f"dup_{n}gram_chars / greatest(word_chars, 1) <= {quality_rules.NGRAM_LIMITS[n]}::DOUBLE" for n in lengths)
    return f"""
WITH split AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM split),{grams},
lines0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
lines AS (SELECT doc_id, length(array_to_string({_WORDS.format(x="line")}, '')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS nth FROM lines0 WHERE len({_WORDS.format(x="line")}) > 0),
counts AS (
  SELECT d.doc_id, len(s.ws) AS n_words, coalesce((SELECT sum(length(w)) FROM words x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
    (SELECT count(*) FROM lines l WHERE l.doc_id = d.doc_id AND nth > 1) AS n_dup_lines, (SELECT count(*) FROM g{quality_rules.BASE_WINDOW} g WHERE g.doc_id = d.doc_id) AS n_repeat_words,
    (SELECT coalesce(sum(chars), 0)::BIGINT FROM lines l WHERE l.doc_id = d.doc_id AND nth > 1) AS dup_line_chars, {counted}
  FROM documents d JOIN split s ON s.doc_id = d.doc_id),
judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND dup_line_chars / greatest(word_chars, 1) <= {quality_rules.LINE_LIMIT}::DOUBLE AND n_symbols / greatest(word_chars, 1) <= {quality_rules.SYMBOL_LIMIT}::DOUBLE AND {shares} AS kept FROM judged"""


def near(percent: int = 85) -> str:
    """op5: every pair of texts that share a shingle, compared in full."""
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    n = near_dedup.SHINGLE
    key = " || ' ' || ".join(f"lead(w, {k}) OVER t" if k else "w" for k in range(n))
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(x=lower)} AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM split WHERE len(ws) >= {n}),
grams AS (SELECT doc_id, {key} AS k FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, hash(k) AS k FROM grams WHERE k IS NOT NULL UNION ALL SELECT doc_id, hash(array_to_string(ws, ' ')) FROM split WHERE len(ws) BETWEEN 1 AND {n - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= {percent} * (a.n + b.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.component_id = d.doc_id AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.u = d.doc_id"""


def _whole(piece: str) -> str:
    """A piece of UTF-8 in hexadecimal without the parts of characters at its ends."""
    tail = "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$"
    return f"regexp_replace(regexp_replace({piece}, '^(?:[89AB][0-9A-F])+', ''), '{tail}', '')"


def repeats() -> str:
    """op7: every string of the length, by its hash."""
    n = suffix_dedup.LENGTH
    return f"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, {2 * n})) AS k FROM (SELECT doc_id, h, unnest(range(0, n - {n - 1})) AS p FROM raw WHERE n >= {n})),
found AS (SELECT doc_id, p FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {n}, true) AS fresh FROM found),
runs AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS lo, max(p) + {n} AS hi FROM runs GROUP BY doc_id, run),
gaps AS (SELECT s.doc_id, lo, hi, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0))) AS piece FROM spans s JOIN raw USING (doc_id)),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, max(hi) AS last, string_agg(piece, '' ORDER BY lo) AS head, string_agg({_whole("piece")}, '' ORDER BY lo) AS shown FROM gaps GROUP BY doc_id)
SELECT r.doc_id, r.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256,
  decode(unhex(CASE WHEN last IS NULL THEN h ELSE shown || {_whole("substr(h, 2 * last + 1)")} END)) AS text
FROM raw r LEFT JOIN cut c ON c.doc_id = r.doc_id"""
