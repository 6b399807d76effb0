"""What a file name, a session or a source file denotes, whatever way it is written, stored or exported."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that only say that a name is not known, as written after plain().
UNKNOWN = frozenset("- ? blank default desconhecido empty file image img keine leer missing n-a na nan nil no-name noname none not-available not-known null photo picture sem-nome sin-nombre source tba tbc tbd test tmp todo unbekannt undefined unknown unnamed unspecified untitled video x xx xxx".split())
_EXPORT = re.compile(r"\.rf\.[0-9a-f]+(?=\.[a-z0-9]{2,5}$)")
_EXT = re.compile(r"[._](?:jpe?g|png|webp|bmp|gif|tiff?|heic|mp4|mov|avi|mkv|m4v|webm|mpe?g)$")
_COPY = re.compile(r"(?:[\s._-]*\(\s*\d+\s*\)|[\s._-]+(?:copy|kopie|copia|cópia|edited|edit|final|resized?|thumb|small|orig(?:inal)?)[\s._-]*\d{0,4})$")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
# Ways of storing that only names which don't read as a shot are searched for: further extensions, a copy named in front, a query.
_RARE_EXT = re.compile(r"\.(?:jfif|jpe|jp2|j2k|jxl|avif|hei[fc]s?|dng|raw|cr[23]|nef|arw|orf|rw2|raf|psd|p[npgb]m|exr|tga|json|xml|txt|bak|part)$")
_COPY_OF = re.compile(r"^(?:copy of|kopie von|copie de|copia de)[\s._-]+")
_QUERY = re.compile(r"\?[^?/=]*=[^?]*$")


def plain(s: str) -> str:
    """Compatibility forms, case, accents, invisible characters and the script of the digits are taken away."""
    s = unicodedata.normalize("NFKD", s).casefold()
    out = []
    for c in s:
        kind = unicodedata.category(c)
        if kind == "Nd":
            out.append(str(unicodedata.digit(c)))
        elif kind not in ("Mn", "Cf"):
            out.append(c)
    return "".join(out)


def stem(s: str) -> str:
    """The name without folder, export suffix, extension and marks of a copy."""
    s = unquote(plain(s)).replace("\\", "/").strip().rstrip("/").rpartition("/")[2].strip()
    s = _EXPORT.sub("", s)
    while True:
        t = _COPY.sub("", _EXT.sub("", s)).strip()
        if t == s or not t:
            return s
        s = t


def tokens(s: str) -> list[str]:
    """Runs of letters, and of digits without their leading zeros."""
    return [t.lstrip("0") or "0" if t.isdigit() else t for t in _TOKEN.findall(s)]


def _key(s: str) -> str | None:
    t = "-".join(tokens(s))
    return None if not t or t in UNKNOWN or s.strip() in UNKNOWN else t


def session_key(s: str | None) -> str | None:
    return None if s is None else _key(plain(s))


def source_key(s: str | None) -> str | None:
    return None if s is None or plain(s).strip() in ("n/a", "n.a.", "#n/a") else _key(stem(s))


def shot(s: str | None) -> tuple[str, str, str, str] | None:
    """(site, view, camera, shot number), null unless the name has exactly these parts, in whatever order of the number."""
    return None if s is None else _shot(stem(s))


def _shot(t: str) -> tuple[str, str, str, str] | None:
    cams, nums, words = [], [], []
    parts = tokens(t)
    i = 0
    while i < len(parts):
        t = parts[i]
        if t == "c" and i + 1 < len(parts) and parts[i + 1].isdigit() and not cams:
            cams.append(parts[i + 1])
            i += 1
        elif t.isdigit():
            nums.append(t)
        else:
            words.append(t)
        i += 1
    return (words[0], words[1], cams[0], nums[0]) if (len(words), len(cams), len(nums)) == (2, 1, 1) else None


def _words_of(t: str, spans: list[tuple[int, int]]) -> str | None:
    """Running tokens of t as one word, if at most one key that is no letter has slipped into it; "_" for one that is no digit."""
    text = t[spans[0][0] : spans[-1][1]]
    other = [c for c in text if not c.isalpha()]
    return None if len(other) > 1 or len(other) == len(text) else "".join(c if c.isalnum() else "_" for c in text)


def _slipped(t: str) -> list[tuple[str, str, str, str]]:
    """What t reads as if a key that is no letter, such as a digit or a dash, has slipped into the words for site or view."""
    at = [(*m.span(), m.group()) for m in _TOKEN.finditer(t)]
    number = lambda k: at[k][2].lstrip("0") or "0"
    digits = [k for k in range(len(at)) if at[k][2].isdigit()]
    out = []
    for c in digits:
        if not c or at[c - 1][2] != "c":
            continue
        for n in digits:
            # all but camera and number are parts of the two words, each running
            rest = [k for k in range(len(at)) if k not in (c - 1, c, n)]
            if n == c or not 2 <= len(rest) <= 6:
                continue
            for cut in range(1, len(rest)):
                two = [rest[:cut], rest[cut:]]
                if all(g[-1] - g[0] == len(g) - 1 for g in two):
                    site, view = (_words_of(t, [at[k][:2] for k in g]) for g in two)
                    if site and view:
                        out.append((site, view, number(c), number(n)))
    return list(dict.fromkeys(out))


def readings(s: str | None) -> list[tuple[str, str, str, str]]:
    """(site, view, camera, shot number) of all that a name may denote; none of a null or of words that say it isn't known.

    A name reads as a shot, else as a shot into whose words a key that is no letter has slipped, which may be in several
    ways. One that doesn't read as a shot stands for itself: its numbers and the number of its words, marked by a w, are the
    shot number, its first word the site and the others the view.
    """
    if s is None:
        return []
    if (r := shot(s)) is not None:
        return [r]
    if source_key(s) is None:
        return []
    t = stem(_QUERY.sub("", s))
    while (u := stem(_COPY_OF.sub("", _RARE_EXT.sub("", t)))) and u != t:
        t = u
    if _key(t) is None:
        return []
    # the words that mark a copy may be those for site or view
    whole = _EXT.sub("", unquote(plain(s)).replace("\\", "/").strip().rpartition("/")[2])
    if (r := _shot(t) or _shot(whole)) is not None:
        return [r]
    if out := _slipped(t):
        return out
    words, nums, cam, parts = [], [], "", tokens(t)
    for before, w in zip(["", *parts], parts, strict=False):
        if w.isdigit() and before == "c" and not cam:
            cam = w
            words.pop()
        else:
            (nums if w.isdigit() else words).append(w)
    return [("".join(words[:1]), "_".join(words[1:]), cam, f"{len(words)}w{'_'.join(nums)}")]


def letter_code(word: str) -> int:
    """A bit for each letter of the word: whether it occurs an odd number of times (26 bits, others by remainder).

    A letter put in or left out changes one bit, one put for another two, two letters swapped none.
    """
    code = 0
    for c in word:
        code ^= 1 << (ord(c) % 26)
    return code


def slips(a: str, b: str, most: int) -> int:
    """Letters put in, left out, changed or swapped with their neighbour to get from a to b; most + 1 if more.

    Letters may be put between swapped ones (unrestricted Damerau-Levenshtein): with one slip in each of two names they overlap.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows, seen = [list(range(len(b) + 1))], {}
    for i, x in enumerate(a, 1):
        row, new, same = rows[-1], [i] + [0] * len(b), 0
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            k = seen.get(y, 0)
            if k and same:
                new[j] = min(new[j], rows[k - 1][same - 1] + (i - k) + (j - same - 1))
            if x == y:
                same = j
        seen[x] = i
        if min(new) > most:
            return most + 1
        rows.append(new)
    return min(rows[-1][-1], most + 1)


# types as objects: a text would be parsed by a session, which there may be none of at import
_SHOT = [*[T.StructField(n, T.StringType()) for n in ("site", "view", "camera", "number")], *[T.StructField(n, T.IntegerType()) for n in ("site_code", "view_code")]]
SHOT = [f.name for f in _SHOT]


@F.pandas_udf(T.StringType())
def session_key_udf(s: pd.Series) -> pd.Series:
    return s.map(session_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def source_key_udf(s: pd.Series) -> pd.Series:
    return s.map(source_key, na_action="ignore")


@F.pandas_udf(T.StructType([*_SHOT, T.StructField("more", T.ArrayType(T.StructType(_SHOT)))]))
def readings_udf(s: pd.Series) -> pd.DataFrame:
    """The first reading, null if there is none, and more of them, null if there are no more."""
    coded = lambda r: (*r, letter_code(r[0]), letter_code(r[1]))
    rows = []
    for x in s:
        first, *more = (readings(x) if isinstance(x, str) else None) or [None]
        rows.append((*(coded(first) if first else (None,) * 6), [dict(zip(SHOT, coded(r), strict=True)) for r in more] or None))
    return pd.DataFrame(rows, columns=[*SHOT, "more"]).astype({"site_code": "Int32", "view_code": "Int32"})


@F.pandas_udf(T.IntegerType())
def slips_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([slips(x, y, 2) for x, y in zip(a, b, strict=True)], dtype="int32")
