"""Words of speeches as a reader takes them: without interruptions, markup, layout, look-alike characters and scanning errors."""

from __future__ import annotations

import re
import unicodedata

# Characters of other scripts that look like Latin ones.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
_ODD = re.compile(r"[^\t\n\r\x20-\x7e]+")

#: Notes in brackets of any kind (of up to 160 characters), markup, and separate lines: page marks, calls with or without a name.
_NOTE = re.compile(r"\([^()\n]{0,160}\)|\[[^\[\]\n]{0,160}\]|<[^<>\n]{0,160}>|&[a-z]{2,8};", re.I)
_LINE = re.compile(
    r"^[ \t]*(?:[—–-]+[ \t]*(?:\d+|[^\n.]{0,60}[!?])?[ \t]*[—–-]*|\[?(?:page|p\.)[ \t]*\d+\]?|[^\n:.]{2,60}:[^\n:]{0,60}[!?])[ \t]*\r?$",
    re.M | re.I,
)
_CUT = re.compile(r"-[ \t]*\r?\n")
_JOIN = re.compile(r"(?<=[^\W\d])-[ \t]*\r?\n\s*(?=[^\W\d])")
WORD = re.compile(r"[a-z0-9]+")


class Runs(dict):
    """Runs of other characters than printable ASCII, as a reader takes them; forgets all when it has seen very many."""

    def __missing__(self, run: str) -> str:
        if len(self) > 100_000:
            self.clear()
        x = unicodedata.normalize("NFKD", "".join(LOOKALIKE.get(c, c) for c in run))
        x = "".join(c for c in x if not unicodedata.combining(c) and unicodedata.category(c) not in ("Cf", "Cc"))
        if len(run) <= 64:
            self[run] = x
        return x


_LATIN = Runs()


def plain(text: str) -> str:
    """Look-alike and compatibility characters as their Latin ones, marks and invisible characters removed."""
    return _ODD.sub(lambda m: _LATIN[m[0]], text)


def spoken(text: str) -> str:
    """``plain`` text without notes in brackets, markup, page marks and calls on lines of their own; words cut at line ends joined."""
    text = plain(text)
    if "\n" in text:
        text = _LINE.sub(" ", text)
        if _CUT.search(text):
            text = _JOIN.sub("", text)
    return _NOTE.sub(" ", text)


def fold(word: str) -> str:
    """One form for words that scanning confuses: 1 and l, 0 and o, rn and m, c and e; plain numbers stay."""
    if word.isdigit():
        return word
    return word.replace("rn", "m").replace("1", "l").replace("0", "o").replace("c", "e")


def words(text: str | None) -> list[str]:
    """Folded words of ``spoken`` text."""
    return list(map(fold, WORD.findall(spoken(text).lower()))) if text else []
