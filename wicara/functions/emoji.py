"""Emoji extraction and removal with Unicode code-point ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wicara.functions.columns import as_col

# Code points with the Unicode Emoji property, without ASCII and flag letters.
EMOJI_RANGES = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697
2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299
1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A
1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD
1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596
1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF
1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0
1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89
1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""


# Blocks around the ranges above; a cheap test that rules out ordinary letters.
EMOJI_BLOCKS = r"\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}"


def _character_class() -> str:
    parts = []
    for item in EMOJI_RANGES.split():
        low, _, high = item.partition("-")
        parts.append(rf"\x{{{low}}}" + (rf"-\x{{{high}}}" if high else ""))
    return "[" + "".join(parts) + "]"


def emoji_pattern(guard: str = "") -> str:
    """Regex for one whole emoji: flags, keycaps, tag flags, skin tones and joined sequences.

    ``guard`` is tried before the long character class.
    """
    base = _character_class()
    modifier = r"[\x{1F3FB}-\x{1F3FF}]?\x{FE0F}?"
    tags = r"(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
    return (
        rf"{guard}(?:[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}"
        rf"|{base}{modifier}{tags}(?:\x{{200D}}{base}{modifier})*)"
        r"|[0-9#*]\x{FE0F}?\x{20E3}"
    )


# The guard is a look-ahead: the character class alone is tested range by range at every letter.
_SCAN = emoji_pattern(f"(?=[{EMOJI_BLOCKS}])")


def extract_emojis(text: Column | str) -> Column:
    """Emojis of the text in order, joined by a space; null reads as no emoji."""
    found = F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(_SCAN), F.lit(0))
    return F.array_join(found, " ")


def remove_emojis(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), F.lit(_SCAN), F.lit(""))
