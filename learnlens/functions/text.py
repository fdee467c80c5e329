"""Keyword search and word splitting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that show a forum question was resolved.
RESOLUTION_KEYWORDS = (
    "thanks", "thank you", "appreciate", "appreciated", "helpful", "that worked", "works now", "fixed it",
    "problem solved", "issue resolved", "makes sense", "clears it up", "answers my question", "all good now",
    "all set",
)

# Words that show feedback tells a student how to improve.
IMPROVEMENT_KEYWORDS = (
    "improve", "work on", "focus", "strengthen", "revise", "organization", "learning objects", "textbook",
    "materials", "review", "understanding", "explain", "detail", "specific", "example", "evidence", "analysis",
    "accuracy", "correct", "incorrect", "error", "mistake", "missing", "incomplete", "complete", "requirements",
    "instructions", "rubric", "criteria", "grammar", "spelling", "punctuation", "sentence structure",
    "word choice", "proofread", "edit", "citation", "reference", "formatting", "effort", "practice", "study",
    "prepare", "participate", "participation", "time management", "ask for help", "seek assistance", "next time",
    "next step", "try to", "you should", "consider", "recommend", "suggest", "make sure", "remember to",
    "continue working", "keep practicing",
)


# Many keywords are sought together, by their rarest letter.
TOGETHER = 20
_RARE_FIRST = "zqjxkvbpgwyfmculdrhsnioate"  # Fixed values: letters of English text


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """True if `text` holds any keyword as a substring, ASCII case ignored; null or empty text gives false."""
    wanted = [word.lower() for word in keywords]
    # A keyword that holds a shorter one adds nothing.
    wanted = [word for word in wanted if not any(other != word and other in word for other in wanted)]
    if len(wanted) > TOGETHER and all(word and word.isascii() for word in wanted):
        return F.coalesce(F.rlike(text, F.lit(rare_letter_pattern(wanted))), F.lit(False))

    def holds_one(folded: Column) -> Column:
        return reduce(Column.__or__, (F.contains(folded, F.lit(word)) for word in dict.fromkeys(wanted)))

    # Bound as a lambda variable, the folded text is computed once per row instead of once per keyword.
    return F.coalesce(F.exists(F.array(_ascii_lower(text)), holds_one), F.lit(False))


def rare_letter_pattern(keywords: Sequence[str]) -> str:
    """One expression for all of the ASCII `keywords`, ASCII case ignored, in a single pass over a text.

    Each keyword hangs on its rarest letter. So most places of a text fail one test of a character; at the others the rest of
    a keyword is compared first, and then the whole keyword, looking back.
    """
    rarity = lambda letter: _RARE_FIRST.find(letter) if letter != " " else len(_RARE_FIRST)
    by_letter: dict[str, list[str]] = {}
    for word in dict.fromkeys(keywords):
        at = min(range(len(word)), key=lambda i: rarity(word[i].lower()))
        by_letter.setdefault(word[at], []).append(f"{re.escape(word[at + 1:])}(?<={re.escape(word)})")
    here = "|".join(f"{re.escape(letter)}(?:{'|'.join(rests)})" for letter, rests in by_letter.items())
    return f"(?i)(?=[{''.join(map(re.escape, by_letter))}])(?:{here})"


def _ascii_lower(text: Column) -> Column:
    """Lower case in which only ASCII letters can become ASCII letters.

    Plain substring search on it is many times faster than one case-blind regular expression over all keywords.
    """
    # The two other letters whose lower case holds an ASCII letter (Kelvin sign, dotted capital I).
    for letter in ("\u212a", "\u0130"):
        text = F.replace(text, F.lit(letter), F.lit("\ufffd"))
    return F.lower(text)


def words(text: Column) -> Column:
    """Split on single spaces only: case, punctuation and empty words are kept, null counts as ''."""
    return F.split(F.coalesce(text, F.lit("")), " ")
