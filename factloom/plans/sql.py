"""Pieces of SQL shared by the oracles."""

from __future__ import annotations

import unicodedata


def nfkc_sql(text: str) -> str:
    """Compatibility composition of a text in DuckDB, which composes but does not know compatibility forms.

    Covers symbols, spaces, super- and subscripts, ligatures and full-width forms; forms of several
    letters are replaced one by one (ligatures, small and capital numerals, dots).
    """
    plain = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xA0, 0x2500), *range(0x3000, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFEF)])}
    odd = {c: x for c, x in plain.items() if x != unicodedata.normalize("NFC", c)}
    one = {c: x for c, x in odd.items() if len(x) == 1}
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate(nfc_normalize({text}), {quote(''.join(one))}, {quote(''.join(one.values()))})"
    for c, x in odd.items():
        if len(x) > 1 and ("\u2160" <= c <= "\u217f" or "\ufb00" <= c <= "\ufb06" or c in "\u2026\u2122"):
            out = f"replace({out}, {quote(c)}, {quote(x)})"
    return f"nfc_normalize({out})"
