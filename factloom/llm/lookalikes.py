"""Characters that look like others: the tables of problem 3, also used where look-alikes do not count."""

from __future__ import annotations

import re
import unicodedata

# Letters of other alphabets (and small letter forms) beside the Latin letters they look like.
CONFUSABLE_ROWS = [
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ονϲϳι", "ovcjι"),
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮҺӀ", "ABESIJKMHOPCTYXGQWYhI"), ("аеорсухіјѕԁԛԝһѵүӏ", "aeopcyxijsdqwhvyl"),
    # Armenian, phonetic and other letters
    ("օսհոզց", "ouhnqg"), ("ɡɑɩıȷ", "gaiıȷ"),
    # letters like Kelvin and Angstrom
    ("KÅ", "KÅ"),
]
# Letters drawn like more than one Latin letter; which one is meant, only the word can tell.
AMBIGUOUS_ROWS = [("ІӀΙǀ", "Il"), ("ӏ", "lI"), ("υս", "uv"), ("νѵ", "vu"), ("ո", "nu"), ("ʼ", "'’")]
# Marks of punctuation drawn alike.
PUNCTUATION_ROWS = [("‐‑", "--")]


def _table() -> dict[str, str]:
    out: dict[str, str] = {}
    for rows in (CONFUSABLE_ROWS, PUNCTUATION_ROWS):
        for odd, plain in rows:
            out |= {a: b for a, b in zip(odd, plain) if a != b}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if c in out:
            continue
        kind, decomposition = unicodedata.category(c), unicodedata.decomposition(c)
        if kind in ("Cf",) or c in "͏ᅟᅠㅤ" or 0xFE00 <= code <= 0xFE0F:
            out[c] = ""
        elif kind == "Zs":
            out[c] = " "
        elif decomposition.startswith(("<wide>", "<narrow>")) or 0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F:
            out[c] = unicodedata.normalize("NFKC", c)
    for start in (0x1D400,):  # mathematical alphabets
        for code in range(start, 0x1D800):
            plain = unicodedata.normalize("NFKC", chr(code))
            if plain != chr(code):
                out[chr(code)] = "".join(out.get(x, x) for x in plain)
    return out


#: Every character that is drawn like another text -> that text; ignorable ones -> "".
LOOKS_LIKE = _table()
#: Letters that may stand for several -> those, likeliest first.
AMBIGUOUS: dict[str, tuple[str, ...]] = {c: tuple(plain) for odd, plain in AMBIGUOUS_ROWS for c in odd}
#: All letters of one look -> one of them: words that may read alike have equal skeletons.
SKELETON = str.maketrans({"I": "l", "v": "u", "n": "u", "’": "'"} | {c: {"I": "l", "v": "u", "n": "u", "'": "'"}.get(x[0], x[0]) for c, x in AMBIGUOUS.items()})
NON_ASCII = re.compile(r"[^\x00-\x7f]")
COMBINING = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")


def unmask(text: str) -> str:
    """The text in the characters it seems to have: composed accents, look-alikes and ignorables resolved."""
    if text.isascii():
        return text
    apart = unicodedata.normalize("NFD", text) if COMBINING.search(text) else text
    plain = NON_ASCII.sub(lambda m: LOOKS_LIKE.get(m.group(), m.group()), apart)
    return unicodedata.normalize("NFC", plain)
