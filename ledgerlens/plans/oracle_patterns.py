"""Patterns of the DuckDB oracles, written on their own from the definitions and not shared with the queries.

A word character is a letter, a number or ``_``; white space is ASCII white space, the four separators
U+001C-U+001F, U+0085 and the Unicode separators.
"""

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\p{Z}"

WORD = f"[{_WORD}]+"
#: A run of word characters, or any other visible character by itself.
TOKEN = f"[{_WORD}]+|[^{_WORD}{_SPACE}]"
#: A URL (kept), or a run of characters that are neither word nor space (deleted).
CLEAN = rf"(https?://[!\x{{24}}-\x{{5f}}a-z]+)|[^{_WORD}{_SPACE}]+"
