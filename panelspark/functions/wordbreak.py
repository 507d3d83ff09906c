"""Word boundaries of Unicode text (UAX #29, default rules) as a JVM regular expression.

The rules look at classes of code points only and at most one class ahead, past code points
that cling to the one before (``CLING``), so a text's segments are the successive matches of one
pattern; no Python and no array of characters is needed. Each rule WBn is one part:

* WB3, 3a, 3b: a line break (CR LF together) stands alone, and nothing clings to it;
* WB3c: a joiner at the end of a segment binds a pictograph that follows it;
* WB3d: a run of blanks is one segment;
* WB4: every other code point takes with it those that cling to it;
* WB5 to 12: letters and digits with single marks between two letters or two digits, and Hebrew
  letters with a quote (double ones only between two of them);
* WB13 to 13b: kana runs, and connectors that bind them, letters and digits;
* WB15, 16: regional indicators in pairs, from the start of their run.

All repetitions are possessive or begin with a class that nothing else in reach has, so matching
is linear in the text and never backs off. Words are the segments that hold a letter, digit,
kana, ideograph or, if asked for, a pictograph; an ideograph is a word of its own, as the default
rules have no dictionary.

The classes are costly to ask, so two common cases come first: a run of Latin letters, digits and
underscores (``PLAIN``) that ASCII ends beyond doubt (``_ends_plain``) is a segment, and for words,
ASCII blanks and marks to which nothing clings are passed over without being put out.

Defined results: a missing text has missing segments, an empty one has none. Joined together,
the segments are the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.semantics import col

# ---- Fixed values: classes of UAX #29 (Table 3) as members of a regex class
NEWLINE = r"\x0B\x0C\x85\u2028\u2029"
BLANK = r"\x20\u1680\u2000-\u2006\u2008-\u200A\u205F\u3000"
JOINER = r"\u200D"
#: Extend, Format and ZWJ.
CLING = (r"\p{Mn}\p{Me}\p{Mc}\p{Cf}\uFF9E\uFF9F\x{1F3FB}-\x{1F3FF}"
         r"&&[^\u200B\u06DD\u070F\u0890\u0891\u08E2\x{110BD}\x{110CD}\u0600-\u0605]")
HEBREW = r"\p{IsHebrew}&&\p{Lo}"
KANA = r"\p{IsKatakana}\u3031-\u3035\u309B\u309C\u30A0\u30FC\uFF70&&[^\p{M}]"
#: Alphabetic, but for ideographs, kana and scripts written without blanks between words.
LETTER = (r"\p{IsAlphabetic}\u02C2-\u02C5\u02D2-\u02D7\u02DE\u02DF\u02E5-\u02EB\u02ED\u02EF-\u02FF\u055A-\u055C\u055E\u058A"
          r"\u05F3\u070F\uA708-\uA716\uA720\uA721\uA789\uA78A\uAB5B"
          r"&&[^\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}\u30FC\uFF70\u3031-\u3035\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
          r"\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsAhom}\p{M}\p{IsHebrew}]")
DIGIT = r"\p{Nd}\u0600-\u0605\u066B\u06DD\u0890\u0891\u08E2\x{110BD}\x{110CD}&&[^\uFF10-\uFF19]"
DIGIT_WIDE = r"\uFF10-\uFF19"
CONNECTOR = r"\p{Pc}\u202F"
MID_BOTH = r"'.\u2018\u2019\u2024\uFE52\uFF07\uFF0E"
MID_LETTER = r":\u00B7\u0387\u055F\u05F4\u2027\uFE13\uFE55\uFF1A"
MID_DIGIT = r",;\u037E\u0589\u060C\u060D\u066C\u07F8\u2044\uFE10\uFE14\uFE50\uFE54\uFF0C\uFF1B"
REGION = r"\x{1F1E6}-\x{1F1FF}"
#: Extended pictographs.
PICTOGRAPH = (r"\u00A9\u00AE\u203C\u2049\u2122\u2139\u2194-\u2199\u21A9\u21AA\u231A\u231B\u2328\u2388\u23CF\u23E9-\u23F3"
              r"\u23F8-\u23FA\u24C2\u25AA\u25AB\u25B6\u25C0\u25FB-\u25FE\u2600-\u2605\u2607-\u2612\u2614-\u2685\u2690-\u2705"
              r"\u2708-\u2712\u2714\u2716\u271D\u2721\u2728\u2733\u2734\u2744\u2747\u274C\u274E\u2753-\u2755\u2757"
              r"\u2763-\u2767\u2795-\u2797\u27A1\u27B0\u27BF\u2934\u2935\u2B05-\u2B07\u2B1B\u2B1C\u2B50\u2B55\u3030\u303D"
              r"\u3297\u3299\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}"
              r"\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}"
              r"\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}"
              r"\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}"
              r"\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}"
              r"\x{1FC00}-\x{1FFFD}")
#: Latin letters, digits and the underscore: any two of them are bound.
PLAIN = r"0-9A-Z_a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
#: ASCII that binds nothing, but for blanks and line breaks; marks that bind letters or digits.
ALONE, MARK = r"\x00-\x09\x0E-\x1F!-&(-+\-/<-@\[-\^`{-\x7F", r"'.:,;"
# ---- end of fixed values


def _ends_plain() -> str:
    """What ends a run of ``PLAIN`` for certain: ASCII that binds nothing, or a mark with ASCII after
    it that is neither letter nor digit."""
    free = f"[ \\n\\r\\x0B\\x0C{ALONE}]"
    return f"(?={free}|[{MARK}](?:{free}|[_{MARK}]|\\z)|\\z)"


def _pattern() -> str:
    """One segment."""
    cling = f"[{CLING}]*+"
    one = lambda c: f"[{c}]{cling}"
    any_letter = f"(?:[{LETTER}]|[{HEBREW}])"
    any_digit = f"(?:[{DIGIT}]|[{DIGIT_WIDE}])"
    quote = f"'{cling}"
    between_letters = f"(?:[{MID_LETTER}{MID_BOTH}]{cling}(?={any_letter}))?+"
    between_digits = f"(?:[{MID_DIGIT}{MID_BOTH}]{cling}(?={any_digit}))?+"
    # a Hebrew letter whose quote no letter follows ends its word (WB7a), so it is kept for the end
    ends = f"{one(HEBREW)}(?:{quote}(?!{any_letter}))"
    hebrew = f"(?!{ends}){one(HEBREW)}(?:\"{cling}(?=[{HEBREW}])|{between_letters})"
    letter = f"{one(LETTER)}{between_letters}"
    digit = f"{any_digit}{cling}{between_digits}"
    run = f"(?:{letter}|{hebrew}|{digit})"
    kana = f"(?:{one(KANA)})"
    links = f"(?:{one(CONNECTOR)})"
    piece = f"(?:{run}++|{kana}++)"
    word = f"(?:{links}++(?:{piece}{links}++)*+|(?:{piece}{links}++)++)(?:{run}*+{ends}|{piece})?+|{run}*+{ends}|{piece}"
    segment = (f"(?:{word}|[{BLANK}]++{cling}|[{REGION}]{cling}(?:[{REGION}]{cling})?+"
               f"|[^\\r\\n{NEWLINE}]{cling})(?:(?<=[{JOINER}])[{PICTOGRAPH}]{cling})*+")
    return f"[{PLAIN}]++{_ends_plain()}|\\r\\n|[\\r\\n{NEWLINE}]|{segment}"


def _word_pattern() -> str:
    """Blanks and marks that are passed over, then one segment or the end of the text (group 1)."""
    clear = f"(?=[\\x00-\\x7F{PLAIN}]|\\z)"  # what clings to nothing
    passed = f"(?:\\x20++{clear}|[\\n\\r\\x0B\\x0C]|[{ALONE}{MARK}]{clear})*+"
    return f"{passed}({SEGMENT_PATTERN}|\\z)"


SEGMENT_PATTERN = _pattern()
WORD_PATTERN = _word_pattern()
WORD_LIKE = r"[0-9A-Za-z\p{IsAlphabetic}\p{N}\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}]"


def segments(text: str | Column) -> Column:
    """All segments of the text between word boundaries, in order."""
    return F.regexp_extract_all(col(text), F.lit(SEGMENT_PATTERN), F.lit(0))


def words_uax29(text: str | Column, pictographs: bool = False) -> Column:
    """The words of the lower-cased text in order; with ``pictographs``, emoji and flags too."""
    keep = WORD_LIKE if not pictographs else f"{WORD_LIKE}|[{PICTOGRAPH}{REGION}]"
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(WORD_PATTERN), F.lit(1))
    return F.filter(found, lambda w: w.rlike(keep))
