"""Texts as plain word sequences: what markup, layout and punctuation leave."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|code|tt|mark|sup|sub|font|small|big|abbr|cite|q|kbd|var|del|ins)(?:\s[^<>]{0,300})?/?>", re.IGNORECASE)
_TAG = re.compile(r"<(?:!--.{0,2000}?--|/?[a-zA-Z][a-zA-Z0-9:-]{0,30}(?:\s[^<>]{0,500})?/?)>", re.DOTALL)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtfv0\"'/\\])")
_LINK = re.compile(r"\]\((?:[^()\s]{0,500})\)")
_WRAPPED = re.compile(r"(?<=[^\W\d_])[-‐\u2011]\r?\n[ \t>*#/;%|-]*(?=[^\W\d_A-Z])")
_MARKS = regex.compile(r"[\p{Cf}\p{Mn}]+")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff]")


def _escape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def plain(text: str) -> str:
    """Lower-case text without markup, escapes and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        # Marks on a letter that NFKC couldn't join would cut a word in two.
        text = _MARKS.sub("", text) if not text.isascii() else text
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = _INVISIBLE.sub("", html.unescape(text))
    if "\\" in text:
        text = _ESCAPE.sub(_escape, text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if "-\n" in text or "-\r" in text:
        text = _WRAPPED.sub("", text)
    return text.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))
