"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from terrafold.llm import quality as q


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def quality_with() -> str:
    """Common table expressions up to ``verdict``: one row for each document, with ``kept``."""
    blanks = r"[ \t\n\x0B\f\r]"
    rules = {r.name: " AND ".join([f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)) for r in q.RULES}
    ok = " AND ".join(f"coalesce({x}, true)" for x in rules.values())
    trailing = r"[.,;:!?\"''()]"
    return f"""
d AS (SELECT row_number() OVER () AS uid, *, coalesce(text, '') AS t FROM documents),
a AS (SELECT uid, t, list_filter(string_split_regex(t, '{blanks}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{blanks}', '', 'g') <> '') AS lines,
             regexp_replace(t, '{blanks}', '', 'g') AS bare FROM d),
g AS (SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
gc AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, gram) AS c FROM g),
rep AS (SELECT uid, count(DISTINCT p) AS n FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS p FROM gc WHERE c > 1) GROUP BY uid),
m AS (SELECT a.uid, len(w)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(regexp_replace(x, '{trailing}', '', 'g')) IN ({_quoted(q.STOP_WORDS)}))) AS n_stop_words,
             length(bare) - length(regexp_replace(bare, '\\p{{L}}+', '', 'g')) AS n_letters,
             length(bare) - length(regexp_replace(bare, '\\p{{Lu}}+', '', 'g')) AS n_upper,
             len(lines) AS n_lines,
             len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis,
             len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•‣]'))) AS n_bullet
      FROM a LEFT JOIN rep USING (uid)),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbols_per_word,
             n_stop_words / nullif(n_words, 0) AS stop_word_ratio, n_letters / nullif(word_chars, 0) AS letter_ratio,
             n_upper / nullif(n_letters, 0) AS upper_letter_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
             n_ellipsis / nullif(n_lines, 0) AS ellipsis_line_ratio, n_bullet / nullif(n_lines, 0) AS bullet_line_ratio,
             (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m),
verdict AS (SELECT *, (NOT base_failed AND {ok}) AS kept FROM r)"""


def quality() -> str:
    return f"""WITH {quality_with().strip()}
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict JOIN d USING (uid)"""


def licenses() -> str:
    from terrafold.llm.licenses import LEAST, TEMPLATES

    def words(x: str) -> str:
        return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"

    def grams(w: str) -> str:
        return f"list_distinct(list_transform(list_zip({w}[:-2], {w}[2:]), lambda p: p[1] || ' ' || p[2]))"

    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
tw AS (SELECT i, name, {words("text")} AS w FROM (VALUES {values}) AS v(i, name, text)),
tpl AS (SELECT i, name, {grams("w")} AS g FROM tw),
units AS (SELECT row_number() OVER () AS u, * FROM (
  SELECT uid, 'line' AS unit, unnest(string_split(t, chr(10))) AS x FROM d
  UNION ALL SELECT uid, 'block', unnest(string_split_regex(t, '\\n[ \\t]*\\n')) FROM d WHERE regexp_matches(t, '\\n[ \\t]*\\n')
  UNION ALL SELECT uid, 'whole', t FROM d)),
w AS (SELECT u, uid, unit, {words("x")} AS w FROM units),
g AS (SELECT u, uid, unit, {grams("w")} AS g FROM w),
m AS (SELECT u, uid, unit, name, i, 2 * len(list_intersect(g.g, tpl.g)) / (len(g.g) + len(tpl.g)) AS dice
      FROM g JOIN tpl ON 2 * least(len(g.g), len(tpl.g)) / (len(g.g) + len(tpl.g)) >= {LEAST}
      WHERE len(g.g) > 0 AND list_has_any(g.g, tpl.g)),
hit AS (SELECT u, any_value(uid) AS uid, any_value(unit) AS unit, arg_min(name, (-dice, name, i)) AS name, max(dice) AS dice FROM m WHERE dice >= {LEAST} GROUP BY u),
best AS (SELECT uid, arg_min(name, (-dice, name)) AS license, max(dice) AS dice FROM hit GROUP BY uid),
lines AS (SELECT uid, count(*) AS n FROM hit WHERE unit = 'line' GROUP BY uid),
names AS (SELECT uid, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM hit GROUP BY uid)
SELECT d.doc_id, best.license, round(best.dice, 9) AS dice, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(names.licenses, '') AS licenses
FROM d LEFT JOIN best USING (uid) LEFT JOIN lines USING (uid) LEFT JOIN names USING (uid)"""
