"""Cleaning, word counting, header detection and segmentation as column expressions.

Java and Python disagree on what ``\\s``, ``\\w`` and ``\\d`` mean outside ASCII,
so the classes are spelled out. ``SPACE`` is the set Python strips and splits on.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseweave import settings as S

# Bodies of regex character classes, for patterns that start with (?U).
SPACE = r"\s\x1c-\x1f"
SPACE_IN_LINE = SPACE + r"&&[^\n]"
WORD = r"\p{L}\p{N}_"

# The same whitespace set as a plain string, for trim().
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# A header line, tested on a line that may still carry outer whitespace:
#   ARTICLE 1 / SECTION 2 / CLAUSE 3, "1.1 L", "1. D", or an all-capitals line
#   of five characters or more.
HEADER_LINE = (
    rf"[{SPACE_IN_LINE}]*+(?:"
    rf"(?:ARTICLE|SECTION|CLAUSE)[{SPACE_IN_LINE}]+\p{{Nd}}"
    rf"|\p{{Nd}}+\.\p{{Nd}}*[{SPACE_IN_LINE}]+[A-Z]"
    rf"|(?=[[A-Z][{SPACE_IN_LINE}]]++(?:\n|\z))[A-Z][[A-Z][{SPACE_IN_LINE}]]{{3,}}[A-Z]"
    rf")"
)
HEADER_BREAK = rf"(?U)\n(?={HEADER_LINE})"
# ASCII characters are tested first; the classes as a whole are unchanged by that.
GAP_AND_WORD = rf"[\x20[{SPACE}]]*+[[!-~][^{SPACE}]]++"
WITH_GAP_BEFORE = rf"(?U){GAP_AND_WORD}"
# Two blanks or more, as a class and a loop behind it.
GAPS = r"[ \t][ \t]+"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace from both ends."""
    return F.trim(text, F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text.

    Every word with the gap before it becomes one character, so no array of
    words is built.
    """
    return F.length(F.regexp_replace(strip(text), WITH_GAP_BEFORE, "x"))


def has_words(text: Column, least: int) -> Column:
    """Whether there are ``least`` words or more; what lies behind them is not read."""
    return text.rlike(rf"(?U)\A(?:{GAP_AND_WORD}){{{least}}}")


def is_header(line: Column) -> Column:
    """True when one line reads as a section header."""
    return line.rlike(rf"(?U)\A{HEADER_LINE}")


def clean_extracted(text: Column) -> Column:
    """Clean text taken from a PDF: drop control characters, squeeze gaps."""
    printable = F.regexp_replace(
        text, r"[^\x09\x0A\x0D\x20-\x7E\xA0-\x{FFFF}]", " "
    )
    return _squeeze(printable)


def clean_filing(text: Column) -> Column:
    """Strip markup, entities, rules, page and exhibit marks from a raw filing.

    Tags go first, then entities and rules, then the marks that may straddle a
    removed tag. Patterns for whole document and text blocks are left out: the
    tag rule has already removed what they would look for.
    """
    # The first character is tested before the alternatives are tried.
    text = F.regexp_replace(text, rf"(?=[<&=-])(?:<[^>]+>|&[{WORD}]+;|={{3,}}|-{{3,}})", " ")
    text = F.regexp_replace(
        text,
        r"(?=[PpEe\[])(?iu:Page \p{Nd}+ of \p{Nd}+|EXHIBIT \p{Nd}+[.\p{Nd}]*|\[EDGAR[^\]]*\])",
        " ",
    )
    return _squeeze(text)


def clean_clause(text: Column) -> Column:
    return strip(F.regexp_replace(text, GAPS, " "))


def counted_clauses(pieces: Column) -> Column:
    """Array of (text, n_words): ``clean_clause`` and ``word_count`` of every piece.

    Arrow batches, since the engine's regexes take four times as long for both. Python's
    own blanks are ``SPACE``; null stays null.
    """
    gaps = re.compile(GAPS)

    def count(batch: pa.Array) -> pa.Array:
        out = []
        for own in batch.to_pylist():
            cleaned = None if own is None else [gaps.sub(" ", p).strip() if "  " in p or "\t" in p else p.strip() for p in own]
            out.append(None if cleaned is None else [{"text": c, "n_words": len(c.split())} for c in cleaned])
        return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("n_words", pa.int32())])))

    return F.arrow_udf(count, "array<struct<text: string, n_words: int>>")(pieces)


def strip_omitted(text: Column) -> Column:
    """Replace inline <omitted> tags by one space; other text stays untouched."""
    tag = r"(?iu)<omitted>"
    replaced = F.regexp_replace(F.regexp_replace(text, tag, " "), rf"(?U)[{SPACE}]{{2,}}", " ")
    return F.when(text.rlike(tag), strip(replaced)).otherwise(text)


def header_pieces(text: Column) -> Column:
    """Pieces that each start at a header line."""
    return F.split(text, HEADER_BREAK)


def paragraph_pieces(text: Column) -> Column:
    return F.split(text, "\n\n+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?U)[^{SPACE}]+"), F.lit(0))


def party(text: Column, quoted: list[str], plain: list[str]) -> Column:
    """First quoted party term, else first plain one, else empty."""
    in_quotes = F.regexp_extract(text, '"(' + "|".join(quoted) + ')"', 1)
    bare = F.regexp_extract(text, "(" + "|".join(plain) + ")", 1)
    return F.when(in_quotes != "", in_quotes).otherwise(bare)


def party_a(text: Column) -> Column:
    return party(text, S.PARTY_A_QUOTED, S.PARTY_A_PLAIN)


def party_b(text: Column) -> Column:
    return party(text, S.PARTY_B_QUOTED, S.PARTY_B_PLAIN)


def _squeeze(text: Column) -> Column:
    text = F.regexp_replace(text, GAPS, " ")
    return strip(F.regexp_replace(text, r"\n\n\n+", "\n\n"))
