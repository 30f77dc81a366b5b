r"""Text rules as columns: cleaning, sentences, lexicons, parameters, validity, relevance, coercion.

All of it is built from Spark's functions and stays in generated code, but for `chunks`, whose next cut depends on the last.
Java's \s, \d and \w are ASCII here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import lexicons as L

Pairs = list[tuple[str, str]]


# Filters


def where_all(rows: DataFrame, equal: dict, at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """Keeps rows that meet every condition given; None stands for no condition, a list for any of its values."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    for name, value in (at_least or {}).items():
        rows = rows if value is None else rows.where(F.col(name) >= value)
    for name, value in (at_most or {}).items():
        rows = rows if value is None else rows.where(F.col(name) <= value)
    return rows


def any_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of the words, as they are, whatever the case."""
    low, found = F.lower(text), F.lit(False)
    for w in words:
        found = found | low.contains(w.lower())
    return F.coalesce(found, F.lit(False))


def issues(**faults: Column) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in faults.items())))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


# Cleaning and splitting


# Patterns and what replaces them, in order; i ignores case, s lets a dot stand for line breaks.
CLEANUP = (
    (r"\S+@\S+", " ", ""),
    (r"http\S+", " ", ""),
    (r"Fig\.\s*\d+", " ", ""),
    (r"Figure\s*\d+", " ", ""),
    (r"\[\d+(,\s*\d+)*\]", " ", ""),
    (r"\([A-Za-z]+,\s*\d{4}\)", " ", ""),
    (r"Keywords?:.*?(Introduction|1\.)", " ", "is"),
    (r"References.*", " ", "is"),
    (r"\n\s*\d+\s*\n", "\n", ""),
    (r"\s+", " ", ""),
)


def clean_scientific_text(text: Column) -> Column:
    """Removes e-mails, addresses, figure references, citations, the keyword block, the reference list and page numbers."""
    for pattern, by, flags in CLEANUP:
        text = F.regexp_replace(text, f"(?{flags}){pattern}" if flags else pattern, by)
    return F.trim(F.replace(text, F.lit("- "), F.lit("")))


def sentences(text: Column) -> Column:
    """Splits after . ! or ? and white space; empty pieces go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def first_words(text: Column, n: int = 120) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def chunks(text: Column, size: int = 3500, overlap: int = 200, snap: int = 300) -> Column:
    """Overlapping pieces of at most `size` characters, cut after a sentence if one ends within the last `snap`; blank pieces go."""

    def cut(t: str | None) -> list[str]:
        if t is None or len(t) <= size:
            return [t] if t and t.strip() else []
        out, start = [], 0
        while True:
            if start + size >= len(t):
                out.append(t[start:])
                break
            stop = t.rfind(". ", start + size - snap, start + size)
            end = start + size if stop < 0 else stop + 1
            out.append(t[start:end].strip())
            start = end - overlap
        return [c for c in out if c.strip()]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(cut)

    return run(text)


def section_key(heading: Column) -> Column:
    """A heading as a key: lower case, numbers and marks gone, words joined by underscores."""
    key = F.regexp_replace(F.lower(F.trim(heading)), r"^[\d.\s]+", "")
    return F.regexp_replace(F.regexp_replace(key, r"[^a-z0-9\s]", ""), r"\s+", "_")


def is_noise_section(name: Column) -> Column:
    found = name.isin(L.NOISE_SECTIONS)
    for p in L.NOISE_PREFIXES:
        found = found | name.startswith(p)
    for s in L.NOISE_SUFFIXES:
        found = found | name.endswith(s)
    return found


def section_name(name: Column) -> Column:
    """The canonical name of a section: by exact name, prefix, part; long titles are preamble; others stay."""
    out = None
    when = lambda c, v: F.when(c, F.lit(v)) if out is None else out.when(c, F.lit(v))
    for k, v in L.SECTION_NAMES:
        out = when(name == k, v)
    for k, v in L.SECTION_PREFIXES:
        out = when(name.startswith(k), v)
    for k, v in L.SECTION_PARTS:
        out = when(name.contains(k), v)
    tokens = F.split(name, "_")
    long = (F.size(tokens) > 8) & ~F.arrays_overlap(tokens, F.array(*map(F.lit, L.SECTION_WORDS)))
    return when(long, "preamble").otherwise(name)


# Lexicons


def first_label(text: Column, lexicon: Pairs, low: Column | None = None) -> Column:
    """The label of the first phrase, in the lexicon's order, that the text holds; null if none. `low`: the text in lower case, if at hand."""
    low = F.lower(text) if low is None else low
    return F.get(_hits(low, lexicon), F.lit(0))["v"]


def all_labels(text: Column, lexicon: Pairs) -> Column:
    return F.array_distinct(F.transform(_hits(F.lower(text), lexicon), lambda e: e["v"]))


def _hits(low: Column, lexicon: Pairs) -> Column:
    """The entries whose phrase a text holds. The lexicon is one literal, so long ones don't swell the generated code."""
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in lexicon))
    return F.filter(entries, lambda e: F.contains(low, e["k"]))


def acronym(token: Column) -> Column:
    """Struct (category, label) of an acronym; nulls if it names no method."""
    t = F.regexp_replace(F.upper(token), "[-_]", "")
    renamed = F.create_map(*(F.lit(x) for pair in L.RENAMED_ACRONYMS for x in pair))
    label = F.coalesce(renamed[t], t)
    suffix = F.lit(False)
    for s in L.SYNTHESIS_SUFFIXES:
        suffix = suffix | (t.endswith(s) & (F.length(t) > len(s)))
    known = F.when(t.isin(L.CHARACTERIZATION_ACRONYMS), F.struct(F.lit("characterization").alias("category"), label.alias("label")))
    known = known.when(t.isin(L.SYNTHESIS_ACRONYMS), F.struct(F.lit("synthesis_method").alias("category"), label.alias("label")))
    return known.when(suffix, F.struct(F.lit("synthesis_method").alias("category"), token.alias("label")))


def keywords(text: Column, least: int = 4) -> Column:
    """The words a-z of a lower-cased text that are long enough and no stop words."""
    stop = F.array(*map(F.lit, L.STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


# Facts


# Patterns of addresses and of lists of authors in a sentence.
ADDRESS = (r"\d[A-Z][a-z]", r"Department|Institute|University|College|Laboratory|Lab")
AUTHORS = r"[A-Z][a-z]+\d,\s+[A-Z][a-z]+\d"


def is_noise_sentence(sentence: Column, low: Column | None = None) -> Column:
    low = F.lower(sentence) if low is None else low
    found = F.exists(F.array(*map(F.lit, L.NOISE_PHRASES)), lambda p: F.contains(low, p))
    address = sentence.rlike(ADDRESS[0]) & sentence.rlike(ADDRESS[1])
    authors = sentence.rlike(AUTHORS)
    w, commas = words(sentence), F.length(sentence) - F.length(F.replace(sentence, F.lit(","), F.lit("")))
    alpha, digits = F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}{2,}$"))), F.size(F.filter(w, lambda x: x.rlike(r"\d")))
    lists = (F.size(w) < 20) & (commas >= 3) & (digits >= 2) & (alpha <= F.size(w) * 0.7)
    short = (F.length(F.trim(sentence)) < 40) & sentence.rlike(r"\d") & sentence.rlike(r"[,()]")
    return found | address | authors | lists | short


def is_valid_value(value: Column, query_terms: Column) -> Column:
    v = F.trim(value)
    own = F.transform(F.regexp_extract_all(v, F.lit(r"\w+"), F.lit(0)), F.lower)
    good = v.rlike(r"^[A-Z]{3,5}$") | v.rlike(r"^[A-Za-z]{1,3}_[A-Za-z]{1,3}$") | F.arrays_overlap(own, query_terms)
    good = good | (v.rlike(r"(?:[A-Z][a-z]?\d*){2,}") & v.rlike(r"[a-z]|\d")) | v.rlike(r"\d")
    return F.coalesce((F.length(v) >= 3) & (F.length(v) <= 120) & ~F.lower(v).isin(L.VALUE_BLOCKLIST) & good, F.lit(False))


# The units and forms that values of each category need, and what makes a value of it unfit.
OPTICAL = r"\d\s*(?:eV|nm|cm[⁻\-]1|A\s*W[⁻\-]1|AW[⁻\-]1|meV|μm)"
ELECTRICAL = r"\d\s*(?:ns|μs|ps|ms|cm[⁻\-]?[23]|Ω|ohm|A\s*/\s*W|A/W|Jones|cm2|V\b|nA|μA|mA\b|S\s*cm|S/cm|m\*)|\bJones\b"
ANNEALING, NO_ANNEALING = "\\d+\\s*(?:°C|K\\b)", "not specified|might be|possibly"
DOPING = "\\d\\s*(?:at\\.?%|wt\\.?%|mol%|cm[⁻\\-]3|×10)"
NO_MATERIAL, NO_DEFECT = "not specified|not reported", r"[.]{2,}|equation|table|figure"


def is_valid_fact(category: Column, value: Column) -> Column:
    """Whether a value is fit for its category: its units, its length, and known garbage."""
    v = F.trim(value)
    low, plain = F.lower(v), F.translate(v, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
    formula_and_number = v.rlike(r"^(?:[A-Z][a-z]?\d{0,2}){2,6}\d{3}$")
    short_code = v.rlike(r"^[A-Za-z]{2,4}\d{1,3}$") & (F.length(v) <= 7) & ~v.rlike(r"[a-z][A-Z]")
    material = (F.length(v) <= 40) & ~low.isin(*L.GARBLED_MATERIALS, *L.GENERIC_MATERIALS) & ~short_code & ~formula_and_number & ~low.rlike(NO_MATERIAL)
    label = low.isin(*L.TECHNIQUE_LABELS)
    begins = F.lit(False)
    for t in L.TECHNIQUE_LABELS:
        begins = begins | low.startswith(t)
    optical = ~label & ~begins & plain.rlike(OPTICAL)
    electrical = ~label & plain.rlike(ELECTRICAL)
    annealing = plain.rlike(ANNEALING) & (F.length(v) <= 80) & ~low.rlike(NO_ANNEALING)
    doping = plain.rlike(DOPING)
    defect = (F.length(v) <= 60) & ~low.rlike(NO_DEFECT)
    of = F.when(category == "material", material).when(category == "optical_property", optical).when(category == "electrical_property", electrical)
    of = of.when(category == "annealing_condition", annealing).when(category == "doping_parameter", doping).when(category == "defect_type", defect).otherwise(F.lit(True))
    return F.coalesce((v != "") & of, F.lit(False))


_HEAT = r"(?i)(?:anneal(?:ing|ed)?|temper(?:ing|ed)|heat(?:ed|ing)|sintered?|calcined?|post.?deposition)[\s\w]{0,25}?(\d{2,4})\s*"
# Category, pattern, and the value as a template of its groups.
PARAMETERS: list[tuple[str, str, tuple[int | str, ...]]] = [
    ("doping_parameter", r"(?i)([A-Z][a-z]?)[\s\-]?(?:doped|doping|dopant|content|concentration)?\s*(?:of\s*)?(\d+(?:\.\d+)?(?:\s*[×x]\s*10\^?\d+)?)\s*(at\.?%|mol\.?%|wt\.?%|%)", (1, " ", 2, " ", 3)),
    ("doping_parameter", r"(?i)(?:[A-Z][a-z]?)?\s*(\d+(?:\.\d+)?)\s*[×xX]\s*10\^?(\d+)\s*(cm[⁻\-]?3|cm\^?\-?3)", (1, "×10^", 2, " ", 3)),
    ("annealing_condition", _HEAT + "(°C|°F)", (1, " ", 2)),
    ("annealing_condition", _HEAT + r"([Kk]elvin|K\b)", (1, " ", 2)),
    ("optical_property", r"(?i)(?:band.?gap|E_?g|optical.?gap|energy.?gap)[\s\w]{0,15}?(\d+\.\d+)\s*eV", (1, " eV")),
    ("optical_property", r"(?i)(?:PL|photoluminescence|emission|luminescence)[\s\w]{0,20}?(\d{3,4})\s*nm", ("PL ", 1, " nm")),
    ("electrical_property", r"(?i)(?:carrier\s+)?(?:lifetime|τ|tau|recombination\s+time)[\s\w=~]{0,12}?(\d+(?:\.\d+)?)\s*(ns|μs|us|ps|ms)\b", (1, " ", 2)),
    ("electrical_property", r"(?:resistivity|conductivity)[\s\w=~]{0,12}?(\d+(?:\.\d+)?(?:\s*[×x]\s*10[⁻\-]?\d+)?)\s*(Ω[·.]?cm|S[/.]cm|S\s*cm[⁻\-]1)", (1, " ", 2)),
    ("electrical_property", r"(?i)(?:photocurrent|dark\s+current|photo\s+response|responsivity)[\s\w=~]{0,15}?(\d+(?:\.\d+)?(?:\s*[×x]\s*10[⁻\-]?\d+)?)\s*(μA|mA|nA|A/W|mA/W)", (1, " ", 2)),
]


def parameters(text: Column) -> Column:
    """Array of (category, value): all matches of PARAMETERS, in their order."""

    def found(category: str, pattern: str, template: tuple[int | str, ...]) -> Column:
        groups = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in template if isinstance(g, int)))
        value = lambda x: F.concat(*(x[f"g{p}"] if isinstance(p, int) else F.lit(p) for p in template))
        return F.transform(groups, lambda x: F.struct(F.lit(category).alias("category"), value(x).alias("value")))

    return F.concat(*(found(*p) for p in PARAMETERS))


def sentence_facts(sentence: Column, low: Column | None = None) -> Column:
    """Array of (category, value): the rules' findings in one sentence; none in a noise sentence. All parameters have digits."""
    one = lambda c, v: F.when(v.isNotNull(), F.struct(F.lit(c).alias("category"), v.alias("value")))
    lexicons = {"characterization": L.CHARACTERIZATION, "synthesis_method": L.SYNTHESIS, "defect_type": L.DEFECTS}
    named = F.array_compact(F.array(*(one(c, first_label(sentence, x, low)) for c, x in lexicons.items())))
    none = F.expr("CAST(array() AS array<struct<category:string,value:string>>)")
    found = F.when(sentence.rlike("[0-9]"), F.array_distinct(F.concat(named, parameters(sentence)))).otherwise(named)
    return F.when(is_noise_sentence(sentence, low), none).otherwise(found)


def mentions(sentence: Column, material: Column) -> Column:
    """The relation (material, mentioned_in, sentence cut to 100) where the sentence names the material."""
    return F.when(F.lower(sentence).contains(F.lower(material)), F.struct(material.alias("subject"), F.lit("mentioned_in").alias("relation"), F.substring(sentence, 1, 100).alias("object")))


def quantity(value: Column) -> Column:
    """Struct (number, unit): the first number of a text and what follows it, the unit in its usual form."""
    number = F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1)
    unit = F.trim(F.regexp_extract(value, r"\d+(?:\.\d+)?\s*([^\d\s].*)", 1))
    aliases = F.create_map(*(F.lit(x) for pair in L.UNITS for x in pair))
    return F.when(number != "", F.struct(number.cast("double").alias("number"), F.coalesce(aliases[F.lower(unit)], unit).alias("unit")))


def numbers_with_unit(text: Column, units: str = r"[A-Za-z%°]+") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d+)?)\s*(?:{units})"), F.lit(1)), lambda x: x.cast("double"))


# Relevance


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))


def jaccard(text: Column, terms: Column) -> Column:
    own = F.array_distinct(_terms(text))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, terms)) / F.size(F.array_union(own, terms)))


def density(text: Column, terms: Column, first: int = 1000) -> Column:
    own = F.slice(_terms(text), 1, first)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda w: F.array_contains(terms, w))) / F.size(own))


def overlap(text: Column, terms: Column) -> Column:
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(F.array_distinct(_terms(text)), terms)) / F.size(terms))


def similar_texts(a: Column, b: Column) -> Column:
    """1 for equal texts, else the share of common words among all words of both; 1 without any words, 0 if one has none."""
    x, y = F.array_distinct(_terms(a)), F.array_distinct(_terms(b))
    share = F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return F.when(a.eqNullSafe(b), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(share)


def similar_numbers(a: Column, b: Column) -> Column:
    """1 less the difference over the greater of both and 1; not below 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def relevance(title: Column, sample: Column, terms: Column) -> Column:
    """.4 Jaccard of the title, .35 density of the terms in the sample, .25 share of the terms in the title; 1 at most."""
    return F.least(F.lit(1.0), 0.4 * jaccard(title, terms) + 0.35 * density(sample, terms) + 0.25 * overlap(title, terms))


def ladder(*steps: tuple[Column, float]) -> Column:
    """The score of the first step that holds; 0 if none."""
    out = F.lit(0.0)
    for condition, score in reversed(steps):
        out = F.when(condition, F.lit(score)).otherwise(out)
    return out


def material_score(title: Column, abstract: Column, names: list[str], siblings: list[str] = (), elements: list[str] = (), structures: list[str] = ()) -> Column:
    """1 in the title, .8 in the abstract, .6 for a sibling of its family, .3 for its element, .15 for its structure."""
    plain = lambda c: F.translate(F.lower(F.coalesce(c, F.lit(""))), "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    t, a = plain(title), plain(abstract)
    both = F.concat(t, F.lit(" "), a)
    tight = F.regexp_replace(both, "[ -]", "")
    any_ = lambda c, ws: F.lit(False) if not ws else any_keyword(c, tuple(ws))
    element = F.lit(False)
    for e in elements:
        element = element | both.contains(f" {e.lower()}") | both.startswith(e.lower())
    return ladder((any_(t, names), 1.0), (any_(a, names), 0.8), (any_(tight, siblings), 0.6), (element, 0.3), (any_(both, structures), 0.15))


def synthesis_score(text: Column, methods: list[str], classes: list[str]) -> Column:
    """1 if a method asked for is named, .6 if another of its class is."""
    return ladder((any_keyword(text, tuple(methods)), 1.0), (any_keyword(text, tuple(classes)), 0.6))


def objective_score(title: Column, abstract: Column, terms: list[str]) -> Column:
    """.15 for each of up to three terms in the title, .08 for each of up to five others in the abstract; 1 at most."""
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    in_title = sum((F.when(t.contains(x), 1).otherwise(0) for x in terms), F.lit(0))
    in_abstract = sum((F.when(~t.contains(x) & a.contains(x), 1).otherwise(0) for x in terms), F.lit(0))
    return F.least(F.lit(1.0), 0.15 * F.least(in_title, F.lit(3)) + 0.08 * F.least(in_abstract, F.lit(5)))


def hits_score(text: Column, keywords: list[str], each: float, most: float) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.least(F.lit(most), each * sum((F.when(low.contains(k), 1).otherwise(0) for k in keywords), F.lit(0)))


# Weights of the relevance scores, and the least total that is kept.
WEIGHTS = {"material": 0.40, "objective": 0.25, "synthesis": 0.20, "characterization": 0.10, "application": 0.05}
LEAST_SCORE = 0.12


def final_score(scores: dict[str, Column]) -> Column:
    return F.round(sum((scores[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), 4)


def best_sentences(text: Column, keywords: tuple[str, ...], budget: int) -> Column:
    """The sentences that hold a keyword, joined, as many from the first on as fit into a number of characters."""
    hits = F.filter(sentences(text), lambda s: any_keyword(s, keywords))
    start = F.lit("")

    def step(s: Column, x: Column) -> Column:
        joined = F.when(s == "", x).otherwise(F.concat(s, F.lit(" "), x))
        return F.when(F.length(joined) <= budget, joined).otherwise(s)

    return F.aggregate(hits, start, step)


# Records


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def plain_url(url: Column) -> Column:
    """Without query and fragment; null unless it is http or https."""
    u = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    return F.when(u.rlike(r"^https?://"), u)


def folder_name(text: Column, n: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(text, r"[^\w\s-]", "")), r"[\s-]+", "_"), 1, n)


def from_inverted_index(index: Column) -> Column:
    """A text from a map of words to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def latex(text: Column) -> Column:
    """Escapes what LaTeX reads as commands."""
    text = F.regexp_replace(text, r"\\", "\u0000")
    text = F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")
    for c, by in (("~", r"\\textasciitilde{}"), (r"\^", r"\\textasciicircum{}"), ("\u0000", r"\\textbackslash{}")):
        text = F.regexp_replace(text, c, by)
    return text


def equation_score(text: Column) -> Column:
    """Whether a line looks like an equation: a relation sign, and enough symbols for its words."""
    symbols, count = F.length(F.regexp_replace(text, r"[^=+\-*/^_∑∫√≤≥≈×]", "")), word_count(text)
    return F.coalesce(text.rlike(r"[=≈≤≥]") & (symbols >= 2) & (symbols * 2 >= count), F.lit(False))


def subtypes(text: Column, rules: dict[str, str]) -> Column:
    """The names of all rules whose pattern the text holds as whole words."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(rf"\b(?:{p})\b"), F.lit(n)) for n, p in rules.items())))


def queries(materials: list[str], methods: list[str], topics: list[str], cap: int = 12) -> list[str]:
    """Search queries from combinations, without repeated words or queries, the most specific first."""
    made = [f"{m} {a} {b}" for m in materials for a in methods for b in topics] + [f"{m} {a}" for m in materials for a in methods] + [f"{m} {b}" for m in materials for b in topics]
    out, seen = [], set()
    for q in made:
        q = " ".join(q.split())
        w = q.lower().split()
        if len(set(w)) == len(w) and q.lower() not in seen:
            seen.add(q.lower())
            out.append(q)
    return out[:cap]


def query_plan(materials: Column, methods: Column, topics: Column, cap: int = 12) -> Column:
    """The same for arrays of a row: all combinations of three, then of two, each once whatever its case, up to `cap`."""
    join = lambda *parts: F.concat_ws(" ", *parts)
    each = lambda xs, f: F.flatten(F.transform(xs, f))
    threes = each(materials, lambda m: each(methods, lambda a: F.transform(topics, lambda b: join(m, a, b))))
    pairs = F.concat(each(materials, lambda m: F.transform(methods, lambda a: join(m, a))), each(materials, lambda m: F.transform(topics, lambda b: join(m, b))))
    plain = F.transform(F.concat(threes, pairs), lambda q: F.regexp_replace(F.trim(q), r"\s+", " "))
    own = lambda q: F.split(F.lower(q), " ")
    good = F.filter(plain, lambda q: F.size(F.array_distinct(own(q))) == F.size(own(q)))
    low = F.transform(good, F.lower)
    return F.slice(F.filter(good, lambda q, i: F.array_position(low, F.lower(q)) == i + 1), 1, cap)


_NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")


def digits_for_words(text: Column) -> Column:
    for n, w in enumerate(_NUMBER_WORDS):
        text = F.regexp_replace(text, rf"(?i)\b{w}\b", str(n))
    return text


def to_number(text: Column) -> Column:
    return F.regexp_extract(F.replace(digits_for_words(text), F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def to_boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "y", "1", "done", "checked", "on"), True).when(low.isin("false", "no", "n", "0", "unchecked", "off"), False)


def to_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\s*(?:,|;|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def to_date(text: Column, today: Column | None = None) -> Column:
    """today, yesterday, tomorrow, or the first that fits of ISO, d/m/Y, m/d/Y, d-m-Y and Ymd."""
    t = F.lower(F.trim(text))
    today = F.current_date() if today is None else today
    read = F.coalesce(*(F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyyMMdd")))
    return F.when(t == "today", today).when(t == "yesterday", F.date_sub(today, 1)).when(t == "tomorrow", F.date_add(today, 1)).otherwise(read)


#: Field type -> how a text becomes a value of it.
COERCE = {"number": to_number, "checkbox": to_boolean, "multi_select": to_list, "date": to_date, "title": F.trim, "rich_text": F.trim, "select": F.trim, "url": F.trim, "email": F.trim, "phone_number": F.trim}


def record_faults(fields: dict[str, str], bounds: dict[str, tuple[float, float]] | None = None) -> Column:
    """What is wrong with a record of texts, for fields name -> type: missing titles, values that don't fit, numbers out of bounds."""
    faults = {}
    for name, kind in fields.items():
        c = F.col(name)
        if kind == "title":
            faults[f"{name}: missing"] = F.coalesce(F.trim(c) == "", F.lit(True))
        elif kind in ("number", "checkbox", "date"):
            faults[f"{name}: not a {kind}"] = c.isNotNull() & COERCE[kind](c).isNull()
        if bounds and name in bounds:
            faults[f"{name}: out of bounds"] = F.coalesce(~to_number(c).between(*bounds[name]), F.lit(False))
    return issues(**faults)


def infer_fields(description: str) -> list[dict]:
    """Fields of a table from a free description: one title, then a field for each noun phrase between commas, typed by its words."""
    # Words that tell a type.
    rules = (("date", ("date", "day", "deadline", "when")), ("number", ("number", "count", "score", "rating", "hours", "price", "amount", "age", "temperature")), ("checkbox", ("done", "whether", "is ", "completed")), ("url", ("url", "link", "website")), ("email", ("email", "mail")), ("multi_select", ("tags", "categories", "list of")), ("select", ("status", "category", "type", "priority")))
    out = [{"name": "Name", "type": "title", "options": []}]
    for part in description.replace(" and ", ",").split(","):
        name = part.strip()
        if name and name.lower() not in ("name", "title"):
            kind = next((k for k, ws in rules if any(w in name.lower() for w in ws)), "rich_text")
            out.append({"name": name.title(), "type": kind, "options": []})
    return out
