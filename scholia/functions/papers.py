"""Papers as texts: sections of raw texts, kinds of papers, themes, and plans of steps over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that head a section, whatever their case.
HEADERS = r"abstract|introduction|background|method(?:s|ology)?|experimental|materials?\s+and\s+methods?|result(?:s)?(?:\s+and\s+discussion)?|discussion|conclusion(?:s)?|summary|outlook"
# Words that begin a section at the start of a line.
HEADINGS = ("Abstract", "Introduction", "Methods", "Methodology", "Experimental", "Materials", "Results", "Discussion", "Conclusion", "Conclusions", "Acknowledgements", "References", "Supplementary")
# What a review's section names begin with, or hold.
REVIEW_PREFIXES = ("i_", "ii_", "iii_", "iv_", "v_", "vi_", "vii_", "viii_")
REVIEW_PARTS = ("summary_and_outlook", "future_direction", "perspective", "outlook")
# Sections that no facts are taken from, and those that only reviews give facts in.
SKIPPED = (
    "references", "reference", "viii_references", "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "vi_acknowledgements",
    "author_contributions", "author_information", "corresponding_author", "data_availability", "code_availability", "additional_information",
    "supporting_information", "competing_interests", "figure_captions", "notes", "preamble",
)
SKIPPED_UNLESS_REVIEW = ("introduction", "i_introduction")
# Themes in order; a theme holds if all words of one of its alternatives stand in the name. The last is the default.
THEMES = (
    ("ZnO Fundamentals", ("fundamental", "zno")),
    ("ZnSe Fundamentals", ("fundamental",)),
    ("ZnSe vs ZnO Comparative", ("comparative",), (" vs ",)),
    ("ZnSeO Alloy Formation", ("alloy",), ("formation",)),
    ("Thermodynamics & Phase Stability", ("thermodynamic",), ("phase",)),
    ("Oxygen Incorporation", ("oxygen incorpor",)),
    ("Defect Chemistry", ("defect",)),
    ("Bandgap Engineering", ("bandgap",), ("band gap",)),
    ("Optical Properties", ("optical",)),
    ("Charge Transport", ("transport",), ("carrier",)),
    ("Thin Film Synthesis", ("synthesis",), ("thin film",)),
    ("Post-Deposition Treatments", ("anneal",), ("doping",), ("post",)),
    ("Characterization Techniques", ("characterization",)),
    ("Applications", ("application",)),
    ("Challenges & Research Gaps", ("challenge",), ("gap",)),
)
THEME_DEFAULT = "ZnSe Fundamentals"

#: A mark around the headings that are found. What a text has of its first character is written as _OWN meanwhile.
_MARK, _OWN = "\u0001h", "\u0001t"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once: an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at what the pattern's group finds: text, heading, text, heading, text ..."""
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK[0]), F.lit(_OWN)), pattern, f"{_MARK}$1{_MARK}")
    return F.transform(F.split(marked, _MARK, -1), lambda p: F.replace(p, F.lit(_OWN), F.lit(_MARK[0])))


def _last_of_each(sections: Column) -> Column:
    """Of sections of one name the last, as sections are told by name."""
    named = F.transform(sections, lambda s, i: F.struct(s["name"].alias("name"), i.alias("i"), s["content"].alias("content")))

    def last(of: Column) -> Column:
        kept = F.filter(of, lambda s, j: ~F.coalesce(F.get(of, j + 1)["name"] == s["name"], F.lit(False)))
        placed = F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["name"].alias("name"), s["content"].alias("content"))))
        return F.transform(placed, lambda s: F.struct(s["name"].alias("name"), s["content"].alias("content")))

    return _with(F.array_sort(named), last)


def raw_sections(text: Column) -> Column:
    """Array of (name, content): the parts of a text between lines that are headers; the whole text as body if there are none.

    A header right behind another leaves no section; what stands ahead of the first is the body. Texts are split in place, without a shuffle.
    """

    def cut(parts: Column) -> Column:
        body = F.struct(F.lit("body").alias("name"), parts[0].alias("content"))
        # a part between headers ends with the line break ahead of the next one; with nothing else in it, or at the end, it is no section
        holds = lambda i: F.get(parts, i + 1) != F.when(i + 2 == F.size(parts), "").otherwise("\n")
        at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: (i % 2 == 1) & holds(i))
        headed = F.transform(at, lambda i: F.struct(F.regexp_replace(F.lower(F.get(parts, i)), " ", "_").alias("name"), F.get(parts, i + 1).alias("content")))
        every = F.concat(F.filter(F.array(body), lambda s: s["content"] != ""), headed)
        return _last_of_each(F.transform(every, lambda s: F.struct(s["name"].alias("name"), _stripped(s["content"]).alias("content"))))

    whole = F.array(F.struct(F.lit("body").alias("name"), text.alias("content")))
    parts = _parts(text, rf"(?imd)^[^\S\n]*({HEADERS})[^\S\n]*$")
    plain = lambda found: (F.size(found) == 0) | ((F.size(found) == 1) & (F.get(found, F.lit(0))["name"] == "body"))
    return F.when(text.isNotNull(), _with(parts, lambda p: _with(cut(p), lambda found: F.when((F.size(p) == 1) | plain(found), whole).otherwise(found))))


def keyword_sections(text: Column) -> Column:
    """Array of (name, content): what follows each heading word at the start of a line; what stands ahead of the first is left out."""

    def cut(parts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
        headed = F.transform(at, lambda i: F.struct(F.lower(F.get(parts, i)).alias("name"), _stripped(F.get(parts, i + 1)).alias("content")))
        return _last_of_each(F.filter(headed, lambda s: s["content"] != ""))

    return F.when(text.isNotNull(), _with(_parts(text, rf"(?i)(?:^|\n)({'|'.join(HEADINGS)})\b"), cut))


def is_review(names: Column) -> Column:
    """Whether any of a paper's section names is one that only reviews have."""

    def marks(name: Column) -> Column:
        n, found = F.lower(_stripped(name)), F.lit(False)
        for p in REVIEW_PREFIXES:
            found = found | n.startswith(p)
        for p in REVIEW_PARTS:
            found = found | n.contains(p)
        return found

    return F.exists(names, marks)


def selected_sections(sections: Column) -> Column:
    """The sections (name, content) that facts are taken from, by the kind of the paper."""
    review = is_review(F.transform(sections, lambda s: s["name"]))
    low = lambda s: F.lower(_stripped(s["name"]))
    return F.filter(sections, lambda s: ~low(s).isin(*SKIPPED) & (review | ~low(s).isin(*SKIPPED_UNLESS_REVIEW)) & F.coalesce(_stripped(s["content"]) != "", F.lit(False)))


# Fixed value: a year that stands alone.
YEAR = r"\b(19[89]\d|20[012]\d)\b"


def publication_year(text: Column) -> Column:
    """The first number from 1980 to 2029 that stands alone; null if none."""
    return F.nullif(F.regexp_extract(text, YEAR, 1), F.lit("")).cast("int")


def theme(name: Column) -> Column:
    """The theme of a category's name: the first whose words it holds."""
    low, out = F.lower(name), F.lit(THEME_DEFAULT)
    for label, *alternatives in reversed(THEMES):
        holds = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & low.contains(w)
            holds = holds | every
        out = F.when(holds, label).otherwise(out)
    return out


# Plans of steps


def resolved(params: Column, context: Column) -> Column:
    """A map of parameters with each value that is `$key` replaced by the context's value for that key, or null where it has none."""
    return F.transform_values(params, lambda k, v: F.when(v.startswith("$"), F.try_element_at(context, F.substr(v, F.lit(2)))).otherwise(v))


def resolved_list(values: Column, context: Column) -> Column:
    """The same for a list's values."""
    return F.transform(values, lambda v: F.when(v.startswith("$"), F.try_element_at(context, F.substr(v, F.lit(2)))).otherwise(v))


def step_fault(tool: Column, params: Column, skip: Column, required: dict[str, list[str]]) -> Column:
    """What is wrong with a plan's step: a tool that is not allowed, or required parameters that are missing; null if nothing is."""
    needs = F.lit(None).cast("array<string>")
    for name, keys in required.items():
        needs = F.when(tool == name, F.array(*map(F.lit, keys)).cast("array<string>")).otherwise(needs)
    missing = F.filter(needs, lambda k: ~F.coalesce(F.map_contains_key(params, k), F.lit(False)))
    return F.when(needs.isNull(), F.concat(F.lit("disallowed tool: "), F.coalesce(tool, F.lit("")))).when(
        ~F.coalesce(skip, F.lit(False)) & (F.size(missing) > 0), F.concat(F.lit("missing: "), F.array_join(missing, ", "))
    )


def routed(technique: Column, best_guess: Column, parsers: tuple[str, ...]) -> Column:
    """Struct (parser, error): the parser that a detection goes to. An uncertain one goes to its best guess, an unknown one to none."""
    guess = F.when(technique == "Uncertain", best_guess).otherwise(technique)
    parser = F.when((technique != "Unknown") & guess.isin(*parsers), guess)
    error = F.when(technique == "Unknown", F.lit("no technique above the threshold")).when(parser.isNull(), F.concat(F.lit("no parser for "), F.coalesce(guess, F.lit("")))).when(technique == "Uncertain", F.lit("uncertain"))
    return F.struct(parser.alias("parser"), error.alias("error"))
