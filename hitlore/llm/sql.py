"""SQL twins, as far as these operators can be written in SQL over whole tables; tests/llm holds the others against brute force."""

from __future__ import annotations

from html.entities import name2codepoint

#: What is taken off a text: comments, references and templates (innermost first, four deep), link targets, tags, quotes; common entities are read.
_TEMPLATE, _LINK = r"\{\{[^{}]*\}\}", r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]"
#: Named entities of Latin letters and signs, dashes and dots; by code point.
_ENTITIES = {f"&{name};": chr(point) for name, point in sorted(name2codepoint.items()) if point < 256 or 0x2000 <= point < 0x2040}
_WIDE = ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _taken_off(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<ref\\b[^<>]*?/>|<ref\\b[^<>]*>.*?</ref\\s*>', ' ', 'g')"
    for _ in range(4):
        x = f"regexp_replace({x}, '{_TEMPLATE}', ' ', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '{_LINK}', '\\1', 'g')"
    x = f"regexp_replace({x}, '\\[(?:https?|ftp)://[^\\s\\[\\]]*([^\\[\\]]*)\\]', '\\1', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(br|p|div|li|ul|ol|td|th|tr|table|hr|blockquote)\\b[^<>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '</?[A-Za-z][A-Za-z0-9]*\\b[^<>]*>', '', 'g')"
    x = f"regexp_replace({x}, '''{{2,}}', '', 'g')"
    for entity, sign in sorted(_ENTITIES.items(), key=lambda e: e[0] == "&amp;"):
        x = f"replace({x}, '{entity}', '{_quoted(sign)}')"
    return x


def _words(x: str) -> str:
    folded = f"regexp_replace(strip_accents(lower(translate({_taken_off(x)}, '{_quoted(_WIDE[0])}', '{_quoted(_WIDE[1])}'))), '[\\p{{Mn}}\\p{{Me}}\\p{{Cf}}]', '', 'g')"
    for seen, meant in {"ß": "ss", "ﬁ": "fi", "ﬂ": "fl"}.items():
        folded = f"replace({folded}, '{seen}', '{meant}')"
    return f"regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}]+')"


#: part: a text, and each comment, reference and template of it by itself; window: the runs of words as long as a passage.
LEAKS = f"""
item AS (SELECT item_id, w, least(len(w), 12) AS n FROM (SELECT item_id, {_words("text")} AS w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) > 0),
passage AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
part AS (
  SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?s)<!--(.*?)-->', 1)) FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?is)<ref\\b[^<>]*[^<>/]>(.*?)</ref\\s*>|<ref>(.*?)</ref\\s*>', 1)) FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?is)<ref>(.*?)</ref\\s*>', 1)) FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\{{\\{{([^{{}}]*)\\}}\\}}', 1)) FROM documents),
read AS (SELECT doc_id, {_words("t")} AS w FROM part),
size AS (SELECT DISTINCT n FROM item),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM read JOIN size ON len(w) >= n),
leak AS (SELECT DISTINCT d.doc_id, p.item_id FROM place d JOIN passage p ON p.n = d.n AND p.p = array_to_string(d.w[d.i:d.i + d.n - 1], ' '))
"""

SQL: dict[str, str] = {
    "p9_found": f"WITH {LEAKS} SELECT doc_id, item_id FROM leak",
    "p9_items": f"""WITH {LEAKS} SELECT e.item_id, e.suite, count(l.doc_id) AS docs FROM eval_items e LEFT JOIN leak l ON l.item_id = e.item_id
        GROUP BY e.item_id, e.suite""",
}
