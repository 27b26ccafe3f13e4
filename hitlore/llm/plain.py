"""The words of a page revision as a reader sees them."""

from __future__ import annotations

import html
import re
import unicodedata

# Markup that stands between words and shows none of its own.
_COMMENT = re.compile(r"<!--(.*?)-->", re.S)
_REFERENCE = re.compile(r"<ref\b([^<>]*?)/>|<ref\b([^<>]*)>(.*?)</ref\s*>", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_WEB_LINK = re.compile(r"\[(?:https?|ftp)://[^\s\[\]]*([^\[\]]*)\]")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*>")
_QUOTES = re.compile(r"'{2,}")
_BREAKING = frozenset(["br", "p", "div", "li", "ul", "ol", "td", "th", "tr", "table", "hr", "blockquote"])
#: Words are runs of letters or digits.
WORD = re.compile(r"[^\W_]+")


class _Shown(dict):
    """Runs of characters beyond ASCII without combining marks and format characters, remembered up to a number of runs."""

    def __missing__(self, run: str) -> str:
        if len(self) > 100_000:
            self.clear()
        value = self[run] = "".join(c for c in run if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
        return value


_SHOWN = _Shown()
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


def _invisible(text: str) -> str:
    """Without combining marks and format characters, after compatibility decomposition and case folding."""
    folded = unicodedata.normalize("NFKD", text).casefold()
    return _BEYOND_ASCII.sub(lambda m: _SHOWN[m[0]], unicodedata.normalize("NFKD", folded))


def fold(text: str) -> str:
    return text.lower() if text.isascii() else _invisible(text)


def shown(text: str, aside: list[str] | None = None) -> str:
    """The shown words of wiki markup: no comments, references, templates and tags; of links the shown words.

    What stands inside the comments, references and templates passed over is added to aside.
    """

    def pass_over(m: re.Match) -> str:
        if aside is not None:
            aside.extend(g for g in m.groups() if g)
        return " "

    if "<" in text:
        text = _REFERENCE.sub(pass_over, _COMMENT.sub(pass_over, text))
    if "{{" in text:
        before = None
        while before != text and "{{" in text:
            before, text = text, _TEMPLATE.sub(pass_over, text)
    if "[" in text:
        if "[[" in text:
            before = None
            while before != text and "[[" in text:
                before, text = text, _LINK.sub(r"\1", text)
        text = _WEB_LINK.sub(r"\1", text)
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m[1].lower() in _BREAKING else "", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return text


def words(text: str | None) -> list[str]:
    """The words of a text: entities decoded; case, accents, compatibility forms, punctuation and markup do not count."""
    return WORD.findall(fold(shown(text))) if text else []


def word_runs(text: str | None) -> list[list[str]]:
    """The words of a text, and those of each part that is passed over in it (a passage may stand inside a template)."""
    if not text:
        return []
    runs, parts = [], [text]
    for part in parts:  # grows by what is passed over in each part
        runs.append(WORD.findall(fold(shown(part, parts))))
    return [r for r in runs if r]
