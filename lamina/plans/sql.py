"""Building blocks of the SQL that gives the same rows as the queries."""

from __future__ import annotations

import re

from lamina import constants as K
from lamina.functions.text import LOSSLESS_TOKEN, SPACE, TOKEN

ABBREVIATION = "|".join(re.escape(a) for a in K.ABBREVIATIONS if " " not in a)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def tokens(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{TOKEN}')), 0)"


def lossless(x: str) -> str:
    return f"regexp_extract_all({x}, '{LOSSLESS_TOKEN}')"


def _filled(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '')"


def sentences(x: str) -> str:
    kept = f"regexp_replace({x}, '\\b({ABBREVIATION})\\.([{SPACE}]+)', '\\1' || chr(2) || '\\2', 'g')"
    parts = f"string_split(regexp_replace({kept}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"
    return _filled(f"list_transform({parts}, lambda s: replace(s, chr(2), '.'))")


def sentences_plain(x: str) -> str:
    parts = f"string_split(regexp_replace({x}, '([.!?])[{SPACE}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter({parts}, lambda s: {strip('s')} <> '')"


def paragraphs(x: str) -> str:
    return _filled(f"regexp_split_to_array({x}, '\\n[{SPACE}]*\\n')")


def parts(source: str, key: str, items: str, name: str = "s") -> str:
    """CTE ``name(key, pos, part, tok)`` of the items of each key."""
    return f"""{name} AS (
  SELECT {key} AS key, unnest(generate_series(0, len(items) - 1)) AS pos, unnest(items) AS part FROM (SELECT {key}, {items} AS items FROM {source}) WHERE len(items) > 0),
{name}t AS (SELECT key, pos, part, {tokens("part")} AS tok FROM {name})"""


def packed(name: str, budget: int, out: str = "p") -> str:
    """CTE ``out(key, pos, part, tok, g)``: greedy groups of ``name`` within a budget."""
    return f"""{out} AS (
  SELECT key, pos, part, tok, tok AS run, 0 AS g FROM {name}t WHERE pos = 0
  UNION ALL
  SELECT n.key, n.pos, n.part, n.tok, CASE WHEN p.run + n.tok > {budget} THEN n.tok ELSE p.run + n.tok END,
         CASE WHEN p.run + n.tok > {budget} THEN p.g + 1 ELSE p.g END
  FROM {out} p JOIN {name}t n ON n.key = p.key AND n.pos = p.pos + 1)"""


def uuid5(x: str) -> str:
    h = f"sha1(unhex('{K.URL_NAMESPACE}') || encode({x}))"
    return (
        f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ((strpos('0123456789abcdef', h[17:17]) - 1) & 3) + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"
    )


def values(rows: list[tuple], columns: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS v({columns})"


def table_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | ')), chr(10))"
