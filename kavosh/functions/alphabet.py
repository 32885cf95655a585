"""Characters that the text functions treat alike. Fixed values unless a rule builds them."""

from __future__ import annotations

import unicodedata

ZWNJ = "\u200c"
# Arabic letters and their Persian forms.
FOLDS = {"\u064a": "ی", "\u0649": "ی", "\u0643": "ک", "\u06aa": "ک", "\u0629": "ه", "\u06c0": "ه", "\u06c1": "ه", "\u06c2": "ه", "\u0623": "ا", "\u0625": "ا", "\u0671": "ا", "\u0624": "و"}
HAMZA_YEH = {"\u0626": "ی"}
# Code points that are dropped (marks, tatweel, joiners, direction controls).
REMOVED = [*range(0x064B, 0x0660), 0x0670, 0x0640, *range(0x200D, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x061C, 0xFEFF]
DIGITS = {chr(base + d): str(d) for base in (0x06F0, 0x0660) for d in range(10)}
LOWER = {chr(c): chr(c).lower() for c in range(0x41, 0x600) if chr(c).lower() != chr(c) and len(chr(c).lower()) == 1}
PRESENTATION = {chr(c): unicodedata.normalize("NFKC", chr(c)) for r in ((0xFB50, 0xFE00), (0xFE70, 0xFEFF)) for c in range(*r) if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
ARABIC = "[\u0620-\u064a\u066e-\u06d3\u06d5\u06fa-\u06ff]"
PERSIAN_LETTER = "[\u0621-\u063a\u0641-\u064a\u067e\u0686\u0698\u06a9\u06af\u06c0\u06cc]"
WORD = r"[\p{L}\p{N}\p{M}\x{200C}]+"


def tables(hamza_yeh: bool = True) -> tuple[str, str]:
    """FROM and TO of a translate() that folds, lower-cases and drops; characters to drop come last in FROM."""
    pairs = FOLDS | (HAMZA_YEH if hamza_yeh else {}) | DIGITS | LOWER
    return "".join(pairs) + "".join(map(chr, REMOVED)), "".join(pairs.values())
