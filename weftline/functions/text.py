r"""Text expressions: white space, sentences, Markdown clean-up, language share. All built-in functions.

Java's classes differ from the ones the rules are written in: WS is every Unicode space with the four ASCII
separators, and (?dm) makes ^ and $ stop at \n alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WS = f"[{_WS}]"
NOT_WORD = r"[^\p{L}\p{N}]"
WORD = r"[\p{L}\p{N}_]"
BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), rf"{WS}+\z", "")


def lines_joined(text: Column) -> Column:
    """Every kind of line break as \\n, without a last empty line."""
    return F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), r"\n\z", "")


def sentences(text: Column) -> Column:
    """C-1: split after . ! ? or the danda where white space follows; trimmed, none empty."""
    return F.filter(F.transform(F.split(strip(text), rf"(?<=[.!?।]){WS}+", -1), strip), lambda s: s != "")


# fixed values: the clean-up passes in their order; (pattern, replacement)
MARKDOWN_PASSES = (
    (rf"\n{WS}*\n{WS}*\n+", "\n\n"),
    (rf"(?dm)^#{{1,6}}{WS}*$", ""),
    (rf"(?dm)^#{{1,6}}{WS}*{NOT_WORD}+{WS}*$", ""),
    (r"[ \t]+", " "),
    (None, "rstrip"),
    (rf"(?dm)^[-=*_]{{3,}}{WS}*$", ""),
    (rf"\[{WS}*\]\([^)]*\)", ""),
    (rf"(?dm)^Click here{WS}*$", ""),
    (rf"(?dm)^View all{WS}*$", ""),
    (r"(?dm)^Read more about .+$", ""),
    (rf"(?dm)^(Read more|और पढ़े){WS}*$", ""),
    (rf"(?dm)^Subscribe to{WS}*$", ""),
    (r"(?d)(Current page|Next page|Last page|Next ›|Last »).*", ""),
    (rf"(?dm)^{WS}*Published Date:{WS}*\p{{Nd}}{{1,2}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}{WS}*$", ""),
    (rf"(?dm)^#{WORD}+({WS}+#{WORD}+)*{WS}*$", ""),
)


def _rstrip_lines(text: Column) -> Column:
    return F.regexp_replace(lines_joined(text), rf"(?dm)[{_WS}&&[^\n]]+$", "")


def clean_markdown(text: Column) -> Column:
    """X-11: the passes above, then no blank lines, trimmed."""
    for pattern, to in MARKDOWN_PASSES:
        text = _rstrip_lines(text) if pattern is None else F.regexp_replace(text, pattern, to)
    kept = F.filter(F.split(lines_joined(text), "\n", -1), lambda x: strip(x) != "")
    return strip(F.array_join(kept, "\n"))


def clean_plaintext(text: Column) -> Column:
    """X-12: for text that was not Markdown."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return strip(_rstrip_lines(text))


def devanagari_share(text: Column) -> Column:
    """G-2: Devanagari characters per character that is not a space; 0 for none."""
    solid = F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(solid > 0, F.regexp_count(text, F.lit("[ऀ-ॿ]")) / solid).otherwise(F.lit(0.0))


def language_of(text: Column) -> Column:
    share = devanagari_share(text)
    return F.when(share > 0.5, "hi").when(share > 0, "mixed").otherwise("en")


def sanitized(name: Column, most: int) -> Column:
    """U-6: for folder names."""
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_\-.]", "_"), 1, most)
