"""Text folded to what it says: letters and digits only, whatever the case, script forms, spacing and markup."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

# Letters of other scripts, and letters without a decomposition, that are read as Latin ones.
LOOKALIKES = dict(zip("аеорсухіѕјһԁԛԝвкмнтгзпαονρτικυεηβγχøđłıħŧʟɡℓ", "aeopcyxisjhdqwbkmhtrznaovptikuenbyxodlihtlgl", strict=True)) | {"æ": "ae", "œ": "oe", "þ": "th"}
# a tag: its name, then attributes with or without values; or a comment, a declaration, a mark between bars. Of any length.
_MARKUP = re.compile(r"""</?[a-zA-Z][\w:.-]*+(?:\s++[\w:.@-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?)*+\s*+/?>|<!--.*?-->|<![a-zA-Z][^<>]*+>|<\|[^<>|]*+\|>|&#?[0-9a-zA-Z]++;""", re.S)


class _Fold(dict):
    """Folds a code point; computed once for each. For str.translate."""

    def __missing__(self, o: int) -> str | None:
        out = []
        for c in unicodedata.normalize("NFKD", chr(o)).casefold():
            for d in unicodedata.normalize("NFKD", c):
                kind = unicodedata.category(d)
                if kind == "Nd":
                    out.append(str(unicodedata.digit(d)))
                elif kind[0] in "LN" and kind != "Lm":
                    out.append(LOOKALIKES.get(d, d))
        self[o] = "".join(out) or None
        return self[o]


FOLD = _Fold()


def _blank(m: re.Match) -> str:
    """Markup by blanks of the same length, an entity by its character and blanks, so that offsets stay."""
    s = m.group()
    c = html.unescape(s) if s[0] == "&" else ""
    return (c if len(c) < len(s) else s).ljust(len(s)) if s[0] == "&" else "\x01" * len(s)


def unmarked(text: str) -> str:
    return _MARKUP.sub(_blank, text) if "<" in text or "&" in text else text


def squeeze(text: str) -> str:
    return unmarked(text).translate(FOLD)


def squeeze_with_offsets(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(squeezed text, offset in the text of each of its characters, positions in it where a word starts)."""
    out, at, starts, fresh, n = [], [], [], True, 0
    for i, c in enumerate(unmarked(text)):
        f = FOLD[ord(c)]
        if f:
            if fresh:
                starts.append(n)
                fresh = False
            out.append(f)
            at.extend([i] * len(f))
            n += len(f)
        elif c.isspace():
            fresh = True
    return "".join(out), np.array(at, np.int64), np.array(starts, np.int64)


_CODES = np.zeros(128, np.uint8)
_CODES[97:123], _CODES[48:58] = np.arange(1, 27), np.arange(27, 37)
SYMBOLS = 64  # letters 1 to 26, digits 27 to 36, all others share 37 to 62; 0 and 63 stay free


def symbols(squeezed: str) -> np.ndarray:
    """The symbols of a squeezed text; different letters outside a to z may share one."""
    o = np.frombuffer(squeezed.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(o < 128, _CODES[np.minimum(o, 127)], 37 + o % 26).astype(np.uint8)
