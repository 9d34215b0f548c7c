"""Words as a reader sees them."""

from __future__ import annotations

import re
import unicodedata

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL = re.compile(r"\\[nrt]")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
#: A hyphen at the end of a line, within a word.
BROKEN = re.compile(r"(?<=[^\W_])[-\u2010\u2011][ \t]*[\r\n\x0b\x0c\x85\u2028\u2029]\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def readable(text: str) -> str:
    """The text with JSON escapes resolved, invisible characters gone, words joined that a line end had cut, and letters in their plain form and case."""
    if "\\" in text:
        text = _CONTROL.sub("\n", _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text))
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    text = BROKEN.sub("", _INVISIBLE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(readable(text))
