"""Column functions for text: every one is a JVM expression on a string or array column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split treats as white space. Those below 256 stand one by one, which Java looks
# up in one step; the others are only compared for a character in their range.
SPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)

# Fixed value: the sentence boundary (after . ! ?, before a capital, not inside parentheses).
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+(?=[A-Z]){SPACE}*(?![^()]*\))"
PLAIN_BREAK = rf"(?<=[.!?]){SPACE}+(?=[A-Z])"

# Fixed value: a vectoriser term, two or more word characters.
TERM = r"[\p{L}\p{N}_]{2,}"

# In-band separators.
SENTENCE_MARK = "STB"
SECTION_MARK = "SBA"

# The prompt format.
PROMPT_OPEN = "<startoftext>Sentence: "
PROMPT_ANSWER = "\nResearch Design: "
PROMPT_CLOSE = "<endoftext>"

# Part-of-speech tags removed from prepared text.
REMOVED_TAGS = ["ADV", "PRON", "CCONJ", "PUNCT", "PART", "DET", "ADP", "SPACE", "NUM", "SYM"]


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def empty_brackets(text: Column) -> Column:
    """Drop what stands inside ( ) or [ ] on one line, keep the brackets themselves."""
    return F.regexp_replace(text, r"([(\[])[^\n]*?([)\]])", "$1$2")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, rf"{SPACE}+"), "")


def drop_noise(text: Column, noise: Sequence[str]) -> Column:
    """Without ``noise`` the text is unchanged; with it, short words go as well."""
    if not noise:
        return text
    kept = F.filter(words(text), lambda w: ~w.isin(*noise) & (F.length(w) >= 3))
    return F.array_join(kept, " ")


def normalise(text: Column, brackets: bool = True, noise: Sequence[str] = ()) -> Column:
    text = F.lower(text)
    if brackets:
        text = empty_brackets(text)
    return drop_noise(text, noise)


def drop_stop_words(tokens: Column, stop: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stop)) if stop else tokens


def keep_alphabetic(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: w.rlike(r"^\p{L}+$"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def sentences(text: Column) -> Column:
    """The parenthesis guard looks ahead to the next bracket at every boundary; a text
    without ')' cannot fail it, so it is split without the guard."""
    return F.when(text.contains(")"), F.split(text, SENTENCE_BREAK)).otherwise(F.split(text, PLAIN_BREAK))


def word_chunks(tokens: Column, size: int) -> Column:
    """Arrays of ``size`` words joined by a space; the last one may be short, none if empty."""
    starts = F.sequence(F.lit(1), F.size(tokens), F.lit(size))
    cut = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(F.size(tokens) > 0, cut).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """n neighbouring words joined by a space; ``tokens`` should be a computed column."""
    if n == 1:
        return tokens
    joined = F.transform(
        tokens, lambda w, i: F.concat_ws(" ", w, *(F.get(tokens, i + j) for j in range(1, n)))
    )
    return F.slice(joined, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))


def frame_words(frame: Column) -> Column:
    return strip_space(F.replace(frame, F.lit("_"), F.lit(" ")))


def strip_marks(text: Column, marks: Sequence[str] = (SECTION_MARK, SENTENCE_MARK)) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def render_prompt(text: Column, label: Column) -> Column:
    return F.concat(F.lit(PROMPT_OPEN), text, F.lit(PROMPT_ANSWER), label, F.lit(PROMPT_CLOSE))


def extract_answer(text: Column) -> Column:
    """What follows the last answer marker on its line, up to the end mark, else 'None'."""
    found = F.regexp_extract_all(text, F.lit(PROMPT_ANSWER.strip() + r" ([^\n]*)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.coalesce(F.substring_index(last, PROMPT_CLOSE, 1), F.lit("None"))


def remap(value: Column, mapping: Mapping[str, str]) -> Column:
    if not mapping:
        return value
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)
