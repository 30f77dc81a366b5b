"""What a spoken line asks for: commands by an ordered grammar, and values of fields anchored at the field's name.

Each extractor also says which of its rules fired. Words end where neither letters nor digits follow, in any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules in order. A phrase may stand anywhere, a word stands alone; the first rule that holds gives the command.
COMMANDS: tuple[tuple[str, str, tuple[str, ...], str], ...] = (
    ("menu", "phrase", ("log entry", "log an entry", "add entry", "new entry", "add a log"), "2"),
    ("menu", "phrase", ("create database", "new database", "add database"), "1"),
    ("menu", "phrase", ("analyze data", "analyse data", "show analysis"), "3"),
    ("menu", "phrase", ("link database", "link databases"), "4"),
    ("menu", "phrase", ("start scheduler", "set scheduler"), "5"),
    ("yes", "word", ("yes", "yeah", "yep", "yup", "confirm", "save", "correct"), "yes"),
    ("yes", "phrase", ("looks good", "that's right", "that's correct"), "yes"),
    ("cancel", "word", ("cancel", "discard", "abort", "stop", "no", "nope", "nah", "quit"), "cancel"),
    ("edit", "word", ("edit", "change", "modify", "update", "fix", "wrong", "incorrect", "adjust"), "edit"),
    ("mode", "word", ("foreground", "blocking"), "1"),
    ("mode", "word", ("background", "daemon"), "2"),
    ("mode", "phrase", ("run now",), "3"),
    ("mode", "word", ("immediately",), "3"),
    ("number", "word", ("one", "first", "create"), "1"),
    ("number", "word", ("two", "second", "log"), "2"),
    ("number", "word", ("three", "third", "analyse", "analyze", "analysis"), "3"),
    ("number", "word", ("four", "fourth"), "4"),
    ("number", "word", ("five", "fifth", "schedule", "scheduler"), "5"),
    ("number", "word", ("six", "sixth", "exit", "leave", "bye", "goodbye"), "6"),
    *(("digit", "word", (d,), d) for d in "123456"),
)
# Words for numbers.
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}
# Lines that leave a field out; up to two more words may follow.
SKIPS = ("next", "skip", "pass", "move on", "next field", "next one", "go on", "proceed", "continue", "move", "move to next", "skip that", "skip this", "leave it", "leave blank", "no answer")

EDGE, BLANKS = r"[^\p{L}\p{N}_]", r"[\x20\x09-\x0D]"


def pattern(kind: str, words: tuple[str, ...]) -> str:
    any_ = "|".join(words)
    return f"(?:{any_})" if kind == "phrase" else f"(?:^|{EDGE})(?:{any_})(?:$|{EDGE})"


def command(text: Column) -> Column:
    """Struct (command, rule): the first rule that holds, else unknown and null."""
    low, out = F.lower(text), None
    for rule, kind, words, result in COMMANDS:
        case = (low.rlike(pattern(kind, words)), F.struct(F.lit(result).alias("command"), F.lit(rule).alias("rule")))
        out = F.when(*case) if out is None else out.when(*case)
    return out.otherwise(F.struct(F.lit("unknown").alias("command"), F.lit(None).cast("string").alias("rule")))


def digits(text: Column) -> Column:
    """The text in lower case with words for numbers as digits, where a word is one, but for a mark behind it."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), f"{BLANKS}+", " ")), " ")
    known = F.create_map(*(F.lit(x) for k, v in NUMBERS.items() for x in (k, str(v))))
    plain = lambda w: F.regexp_replace(w, r"[.,!?;:]+$", "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.concat(F.try_element_at(known, plain(w)), F.substring(w, F.length(plain(w)) + 1, F.length(w))), w)), " ")


def anchored(field: str) -> str:
    return rf"{field}{BLANKS}*(?:is|was|:|=|of)?{BLANKS}*(\d+(?:[.,]\d+)?)"


FIRST = rf"(?:^|{EDGE})(\d+(?:\.\d+)?)(?:$|{EDGE})"


def number(text: Column, field: str) -> Column:
    """Struct (value, rule): the number that follows the field's name, else the first number that stands alone."""
    plain = digits(text)
    at, first = F.nullif(F.regexp_extract(plain, anchored(field), 1), F.lit("")), F.nullif(F.regexp_extract(plain, FIRST, 1), F.lit(""))
    rule = F.when(at.isNotNull(), "anchored").when(first.isNotNull(), "first")
    return F.struct(F.coalesce(F.replace(at, F.lit(","), F.lit(".")), first).cast("double").alias("value"), rule.alias("rule"))


def negated(field: str) -> str:
    return rf"(?:not|no|didn't|did not|wasn't){BLANKS}+{field}|{field}{BLANKS}+(?:is|was)?{BLANKS}*(?:not|no|false|off)"


def boolean(text: Column, field: str) -> Column:
    """Whether a field is denied or named; null if it isn't mentioned as a word."""
    low = F.lower(text)
    return F.when(low.rlike(negated(field)), False).when(low.rlike(pattern("word", (field,))), True)


def skip_pattern() -> str:
    """A line that is a skip phrase, with up to two more words behind it."""
    return rf"^(?:{'|'.join(SKIPS)})(?:{BLANKS}*[^\x20\x09-\x0D]+){{0,2}}$"


def skips(text: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), f"^{BLANKS}+|{BLANKS}+$", ""), r"[.,!?]+$", "")
    return F.coalesce(clean.rlike(skip_pattern()), F.lit(False))
