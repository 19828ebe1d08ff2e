"""SQL that cleans scripts and reads their dialogue, for the engine that checks."""

from __future__ import annotations

from catalog.registry import SQL_SPACE

_SPACES = SQL_SPACE[1:-1]
_RUN = rf"[A-Z{_SPACES}\-]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def clean_sql(source: str) -> str:
    """CTE ``cleaned`` (title, text) of the scripts in ``source`` (title, text)."""
    return rf"""
squeezed AS (
  SELECT title, regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'),
    '{SQL_SPACE}{{2,}}', ' ', 'g') AS text FROM {source}),
cut AS (
  SELECT title, string_split_regex(text, '(?m)^(?:[a-zA-Z0-9]|{SQL_SPACE})+\n') AS plain,
    regexp_extract_all(text, '(?m)^(?:[a-zA-Z0-9]|{SQL_SPACE})+\n') AS cues FROM squeezed),
cleaned AS (
  SELECT title, list_aggregate(list_transform(plain,
    lambda part, i: part || coalesce(upper(cues[i]), '')), 'string_agg', '') AS text FROM cut)"""


def dialogue_sql(source: str) -> str:
    """CTE ``spoken`` (title, seq, line_count, character, line) of ``source`` (title, text).

    Goes by places in the text: ``t`` is where a run begins to be a name, ``upto`` its end
    and ``b`` where its speech begins. From the first cue each step goes to the next strong
    one that lies behind the speech's beginning. Needs WITH RECURSIVE.
    """
    return rf"""
cut_runs AS (SELECT title, regexp_extract_all(text, '[^A-Z{_SPACES}\-]*{_RUN}+') AS ps FROM {source}),
pieces AS (
  SELECT title, piece, CAST(sum(length(piece)) OVER (PARTITION BY title ORDER BY i) AS BIGINT) AS upto
  FROM (SELECT title, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM cut_runs)),
run_ends AS (
  SELECT title, upto, run, right(left(piece, length(piece) - length(run)), 1) AS before
  FROM (SELECT *, regexp_extract(piece, '{_RUN}+$') AS run FROM pieces)
  WHERE regexp_matches(run, '[A-Z].')),
tails AS (
  SELECT title, upto, CASE WHEN regexp_matches(before, '[\p{{L}}\p{{N}}_]')
    THEN regexp_replace(run, '^[A-Z]*[{_SPACES}\-]*', '')
    ELSE regexp_replace(run, '^[{_SPACES}\-]*', '') END AS tail FROM run_ends),
asides AS (
  SELECT tails.*, upto - length(tail) + 1 AS t, CASE WHEN substr(text, upto + 1, 1) = '('
    THEN regexp_extract(substr(text, upto + 1), '(?s)^\(.*?\){SQL_SPACE}+') ELSE '' END AS aside
  FROM tails JOIN {source} USING (title) WHERE length(tail) >= 2),
cands AS (
  SELECT title, t, aside <> '' OR regexp_matches(tail, '^[A-Z]{_RUN}+{SQL_SPACE}') AS opens,
    regexp_matches(tail, '^[A-Z]{_RUN}*[A-Z]{SQL_SPACE}') AS strong,
    CASE WHEN aside <> '' THEN upto + 1 + length(aside)
      ELSE t + length(regexp_extract(tail, '^{_RUN}+{SQL_SPACE}')) END AS b,
    CASE WHEN aside <> '' THEN tail ELSE regexp_extract(tail, '^({_RUN}+){SQL_SPACE}', 1) END AS name
  FROM asides),
walk AS (
  SELECT title, min(t) AS t FROM cands WHERE opens GROUP BY title
  UNION ALL
  SELECT w.title, min(n.t) AS t FROM walk w JOIN cands c ON c.title = w.title AND c.t = w.t
  JOIN cands n ON n.title = w.title AND n.strong AND n.t >= c.b GROUP BY w.title),
speeches AS (
  SELECT title, t, name, replace({sql_strip("substr(text, b, upto - b)")}, chr(10), ' ') AS line
  FROM (
    SELECT c.title, c.t, c.b, c.name, text,
      coalesce(lead(c.t) OVER (PARTITION BY c.title ORDER BY c.t), length(text) + 1) AS upto
    FROM walk w JOIN cands c ON c.title = w.title AND c.t = w.t JOIN {source} s ON s.title = w.title)),
spoken AS (
  SELECT title, CAST(row_number() OVER (PARTITION BY title ORDER BY t) - 1 AS INTEGER) AS seq,
    CAST(count(*) OVER (PARTITION BY title) AS INTEGER) AS line_count,
    {sql_strip('name')} AS character, line
  FROM speeches WHERE line <> '')"""
