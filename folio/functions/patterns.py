"""Regular expressions with the string semantics that the text rules are stated in.

The rules assume Unicode ``\\s``, ``\\d`` and ``\\w`` (``\\s`` with U+001C-U+001F, ``\\w``
without combining marks), a dot that stops only at line feeds, and Unicode case
folding. ``java`` turns a rule into the equivalent Java expression.

Rules meet lines of any length, so white space is matched possessively and only
from where it begins: else a run of n of it takes n^2 steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java(rule: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The Java form of a rule; classes keep their brackets, flags go first.

    A word boundary beside a letter needs to look at one side only, and does so
    after that letter, which few places of a text have.
    """
    out, i, inside = [], 0, False
    while i < len(rule):
        two = rule[i : i + 2]
        letter, after = rule[i + 2 : i + 3], rule[i + 3 : i + 4]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\w":
            out.append(WORD if inside else f"[{WORD}]")
        elif two == r"\b" and letter.isalnum() and after not in tuple("*+?{"):
            out.append(f"{letter}(?<![{WORD}]{letter})")
            i += 1
        elif two == r"\b" and rule[i - 1 : i].isalnum() and rule[i - 2 : i - 1] != "\\":
            out.append(f"(?![{WORD}])")
        elif two == r"\b":
            out.append(BOUNDARY)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return f"(?dU{'iu' * ignore_case}{'m' * multiline})" + "".join(out)


def replace(text: Column, rule: str, by: str, ignore_case: bool = False, multiline: bool = False) -> Column:
    return F.regexp_replace(text, F.lit(java(rule, ignore_case, multiline)), F.lit(by))


def matches(text: Column, rule: str, ignore_case: bool = False) -> Column:
    return text.rlike(java(rule, ignore_case))


def any_of(text: Column, rules: list[str], ignore_case: bool = True) -> Column:
    """Whether one of the rules is found; one alternation, so one pass."""
    return text.rlike(java("|".join(f"(?:{r})" for r in rules), ignore_case))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(java(r"^\s++|(?<!\s)\s++\z")), F.lit(""))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(java(r"(?<!\s)\s++\z")), F.lit(""))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(java(r"^\s++")), F.lit(""))


def tokens(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, java(r"\s+")), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{IsLowercase}")


def count_chars(text: Column) -> Column:
    return F.length(text).cast("long")
