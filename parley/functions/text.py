"""Column helpers for text: whitespace, tokens, links and emoji.

Whitespace is Unicode-aware everywhere (exports use U+202F and no-break spaces), which Java's
plain ``\\s`` and Spark's ``trim`` are not, so the class is spelled out once and shared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
# Every code point that counts as whitespace in a Unicode-aware strip / split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regex class; valid in Java and RE2.
WS = r"\x09-\x0d\x1c-\x1f\x{85}\p{Z}"
# Punctuation stripped from both ends of a word.
WORD_EDGE = ".,!?;:\"'()[]{}"
# Full URLs, as removed before keyword matching.
FULL_URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"
# Unicode `Emoji` code points without digits, '#', '*' and lone regional indicators.
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697
2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E
1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397
1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570
1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4
1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2
1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A
1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
"""
# Top-level domains accepted for links written without a scheme: the older generic ones, common
# newer ones and countries, as named in the public list of top-level domains.
BARE_DOMAINS = (
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia "
    "app dev xyz shop online site store tech club top blog news live cloud page link world today "
    "email agency digital media social space website design studio work works zone wiki press "
    "ae am ar at au be bg br by ca cc ch cl cn co cz de dk ee eg es eu fi fm fr gg gl gr hk hr hu "
    "id ie il in io ir is it jp ke kr kz lk lt lu lv ly me mx my ng nl no nz np pe ph pk pl pt qa "
    "ro rs ru sa se sg si sk th to tr tv tw ua uk us uy ve vn za ai"
)
# ----------------------------------------------------------------------------------------


def _hex_class(ranges: str) -> str:
    ends = (r.partition("-") for r in ranges.split())
    return "".join(
        rf"\x{{{lo}}}-\x{{{hi}}}" if hi else rf"\x{{{lo}}}" for lo, _, hi in ends
    )


EMOJI = f"[{_hex_class(EMOJI_RANGES)}]"
# --- fixed values: parts of emoji sequences -------------------------------------------------
FLAG = r"[\x{1F1E6}-\x{1F1FF}]{2}"
KEYCAP = r"[0-9#*]\x{FE0F}?\x{20E3}"
# a variation selector, a skin tone, or the tags of a subdivision flag
MODIFIERS = r"\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
JOINER = r"\x{200D}"
# ----------------------------------------------------------------------------------------
# An emoji as it is seen: two regional indicators, a keycap, or emoji with their modifiers, joined or alone.
EMOJI_SEQUENCE = rf"{FLAG}|{KEYCAP}|{EMOJI}{MODIFIERS}(?:{JOINER}{EMOJI}{MODIFIERS}){{0,9}}"
# A link is a full URL or a bare host with a known ending, in any case. Mail addresses are matched
# as well, so that their hosts are not, and left out afterwards. Repeats are possessive or bounded, so that long
# words and long chains of labels cost no more than others.
MAIL = r"[a-z0-9._%+-]{1,64}@[a-z0-9.-]+"
LABEL = r"[\p{L}\p{N}][\p{L}\p{N}-]{0,62}"
HOST = rf"{LABEL}+(?:\.{LABEL}+)++"
LINK = rf"(?i)(?:https?://|www\.)[^{WS}]+|{MAIL}|{HOST}(?:/[^{WS}]*)?"
IS_MAIL = r"^[^/@]+@"
IS_URL = r"(?i)^(?:https?://|www\.)"
#: Endings travel with the plan as a set, so their number is limited; all public ones are far fewer.
MOST_ENDINGS = 20_000


def strip(col: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def split_words(col: Column) -> Column:
    """Whitespace tokens; a blank text gives an empty array."""
    stripped = strip(col)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"[{WS}]+")
    )


def word_count(col: Column) -> Column:
    return F.size(split_words(col))


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, f"[{WS}]+", " ")


def strip_edges(word: Column) -> Column:
    """Remove punctuation from both ends of a word."""
    return F.btrim(word, F.lit(WORD_EDGE))


def clean_words(col: Column) -> Column:
    """Lower-cased tokens without punctuation at the ends; empties dropped."""
    bare = F.transform(split_words(F.lower(col)), strip_edges)
    return F.filter(bare, lambda w: w != "")


def remove_stop_words(col: Column, stop_words: list[str]) -> Column:
    """Cleaned tokens that are no stop words, joined by one space.

    For a short fixed list only; a list of unknown size belongs in an anti-join.
    """
    kept = clean_words(col)
    if stop_words:
        kept = F.filter(kept, lambda w: ~w.isin(stop_words))
    return F.array_join(kept, " ")


def has_ending(host: Column, endings: list[str]) -> Column:
    """Whether any label of a host but the first is one of the endings."""
    labels = F.split(F.lower(host), r"\.")
    return F.exists(F.slice(labels, F.lit(2), F.size(labels)), lambda x: x.isin(endings))


def links(col: Column, endings: list[str] | None = None) -> Column:
    """Links of a text: full URLs, `www.` hosts, and bare hosts with one of the endings.

    `endings` are lower-case labels, see ``sources.endings``; without any the built-in list counts.
    """
    endings = BARE_DOMAINS.split() if endings is None else endings
    if len(endings) > MOST_ENDINGS:
        raise ValueError(f"more than {MOST_ENDINGS} endings")
    found = F.regexp_extract_all(col, F.lit(LINK), F.lit(0))
    return F.filter(
        found,
        lambda x: x.rlike(IS_URL) | (~x.rlike(IS_MAIL) & has_ending(F.substring_index(x, "/", 1), endings)),
    )


def link_count(col: Column, endings: list[str] | None = None) -> Column:
    return F.size(links(col, endings))


def emojis(col: Column, sequences: bool = False) -> Column:
    """Emoji of a text: one element per code point, where sequences come apart, or per sequence as it is seen."""
    return F.regexp_extract_all(col, F.lit(EMOJI_SEQUENCE if sequences else EMOJI), F.lit(0))


def is_media(col: Column) -> Column:
    from ..schema import MEDIA_MESSAGE

    return strip(col) == MEDIA_MESSAGE
