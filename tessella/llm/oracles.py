"""DuckDB SQL for the rows of queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontaminate import WINDOW
from .ngram_join import PERCENT, SHINGLE
from .quality_rules import DEFAULT_STRENGTH, HOST_REJECT_RATES, MAX_DUP_LINE_SHARE, MAX_REPEAT_PERCENT, MAX_SYMBOLS_PER_WORD, MIN_WORDS, SPREADS
from .suffix_dedup import LENGTH, PASSAGE

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _covered(size: int, name: str) -> str:
    """CTEs that end in ``<name>_spans``: the maximal runs of bytes that repeated strings of ``size`` bytes cover."""
    return f"""
{name}_windows AS (SELECT rid, i, md5(substr(h, 2 * i + 1, {2 * size})) AS k FROM d, unnest(range(0, n - {size} + 1)) t(i) WHERE n >= {size}),
{name}_often AS (SELECT k FROM {name}_windows GROUP BY k HAVING count(*) > 1),
{name}_hits AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM {name}_windows SEMI JOIN {name}_often USING (k)),
{name}_runs AS (SELECT rid, i, sum(CASE WHEN gap <= {size} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS g FROM {name}_hits),
{name}_spans AS (SELECT rid, g, min(i) AS a, max(i) + {size} AS z FROM {name}_runs GROUP BY rid, g)"""


OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{_covered(LENGTH, "long")},
{_covered(PASSAGE, "short")},
cuts AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM long_spans),
kept AS (
  SELECT d.rid, any_value(doc_id) AS doc_id, any_value(n) AS n, coalesce(sum(z - a), 0) AS removed, count(a) AS spans,
    coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(z), 0) + 1) AS rest
  FROM d LEFT JOIN cuts USING (rid) GROUP BY d.rid),
shorter AS (SELECT rid, sum(z - a) AS repeated FROM short_spans GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeated
FROM kept LEFT JOIN shorter USING (rid)
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, i AS item_word, least({WINDOW}, len(w)) AS size, array_to_string(list_slice(w, i + 1, i + least({WINDOW}, len(w))), ' ') AS g
  FROM b, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) t(i) WHERE len(w) > 0),
places AS (
  SELECT rid, i AS place, size, array_to_string(list_slice(w, i + 1, i + size), ' ') AS g
  FROM (SELECT rid, w, size FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size), unnest(range(0, len(w) - size + 1)) t(i)),
found AS (SELECT DISTINCT rid, place, p.size, item, item_word FROM places p JOIN windows v ON p.g = v.g AND p.size = v.size),
hits AS (SELECT rid, count(DISTINCT place + k) AS n_hit FROM found, unnest(range(0, size)) t(k) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid),
steps AS (SELECT *, place - row_number() OVER (PARTITION BY rid, item, place - item_word ORDER BY place) AS island FROM found),
longest AS (SELECT rid, max(n) AS n FROM (SELECT rid, count(*) + max(size) - 1 AS n FROM steps GROUP BY rid, item, place - item_word, island) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid) LEFT JOIN longest USING (rid)
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_TOKENS.format("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (SELECT rid, i, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g FROM d, unnest(range(0, len(w) - 2)) t(i) WHERE len(w) >= 3),
often AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM often, unnest(range(0, 3)) t(k) WHERE c > 1 GROUP BY rid),
counted AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN repeated USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
hosts AS (
  SELECT source, count(*) AS docs, sum(CASE WHEN base_failed OR n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words OR n_dup_lines > {MAX_DUP_LINE_SHARE} * n_lines THEN 1 ELSE 0 END) AS failed FROM judged GROUP BY source),
spread AS (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v FROM hosts),
prior AS (SELECT m, least({HOST_REJECT_RATES[1]}, greatest({HOST_REJECT_RATES[0]}, m + {SPREADS} * sqrt(v))) AS most, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE {DEFAULT_STRENGTH} END, 1.0), 1e6) AS strength FROM spread),
rates AS (SELECT source AS host, (failed + m * strength) / (docs + strength) AS rate, most FROM hosts, prior)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND rate <= most AS kept, round(rate, 6) AS host_rate
FROM judged JOIN rates ON source IS NOT DISTINCT FROM host
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format(_LOWERED)} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + {SHINGLE}), ' ') AS g FROM d, unnest(range(0, greatest(len(w) - {SHINGLE}, 0) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
least_of AS (SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_suffix_dedup": OP2, "op4_decontaminate": OP4, "op7_quality_rules": OP7, "op9_ngram_jaccard_join": OP9}
