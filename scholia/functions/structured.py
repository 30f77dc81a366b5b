r"""Parsing of structured outputs: simulation logs, spectra, technique detection, JSON in replies.

One row holds one output as text; every parser is a column of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RY_EV = 13.605693122994  # fixed value: electron volts in a Rydberg


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _one(text: Column, pattern: str, kind: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast(kind)


def seconds(span: Column) -> Column:
    """'2d 3h23m45.6s' and the like; null if it names no unit."""
    parts = [F.coalesce(_one(span, rf"(\d+(?:\.\d+)?)\s*{unit}", "double") * n, F.lit(0.0)) for unit, n in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1))]
    return F.nullif(parts[0] + parts[1] + parts[2] + parts[3], F.lit(0.0))


def _rows(block: Column) -> Column:
    """Lines of numbers as an array of arrays."""
    lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.slice(F.transform(_all(x, r"(-?\d+(?:\.\d+)?)"), lambda v: v.cast("double")), 1, 3))


def pw(text: Column) -> Column:
    """A plane-wave run: type, convergence, energies, forces, stress, final cell and positions, iterations, times, warnings, errors."""
    final = F.try_element_at(_all(text, r"!\s+total energy\s*=\s*(-?[\d.]+)\s*Ry"), F.lit(-1))
    energy = F.coalesce(final, F.try_element_at(_all(text, r"total energy\s*=\s*(-?[\d.]+)\s*Ry"), F.lit(-1))).try_cast("double")
    levels = _all(F.regexp_extract(text, r"(?i)highest occupied(?:, lowest unoccupied)? levels?\s*\(ev\)\s*:\s*([-\d.\s]+)", 1), r"(-?\d+(?:\.\d+)?)")
    level = lambda i: F.try_element_at(levels, F.lit(i)).try_cast("double")
    forces = F.transform(_all(text, r"force\s*=\s*(-?[\d.]+\s+-?[\d.]+\s+-?[\d.]+)"), lambda x: F.transform(F.split(x, r"\s+"), lambda v: v.cast("double")))
    norms = F.transform(forces, lambda f: F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, v: s + v * v)))
    cell = F.try_element_at(_all(text, r"CELL_PARAMETERS\s*\(angstrom\)\s*\n((?:\s*-?[\d.]+[^\n]*\n){3})"), F.lit(-1))
    places = F.try_element_at(_all(text, r"ATOMIC_POSITIONS\s*[({]?angstrom[)}]?\s*\n((?:\s*[A-Z]\w*\s+-?[\d.]+[^\n]*\n?)+)"), F.lit(-1))
    atoms = F.transform(F.filter(F.split(places, "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.regexp_extract(x, r"(\w+)", 1).alias("symbol"), F.transform(F.slice(F.split(F.trim(x), r"\s+"), 2, 3), lambda v: v.try_cast("double")).alias("xyz")))
    return F.struct(
        F.nullif(F.regexp_extract(text, r"calculation\s*=\s*'([^']+)'", 1), F.lit("")).alias("calculation"), (text.contains("convergence has been achieved") | text.contains("SCF Done")).alias("converged"),
        energy.alias("total_energy_ry"), (energy * RY_EV).alias("total_energy_ev"), _one(text, r"(?i)the Fermi energy is\s+(-?[\d.]+)\s*ev", "double").alias("fermi_ev"),
        level(1).alias("homo_ev"), F.round(level(2) - level(1), 4).alias("gap_ev"), _one(text, r"convergence has been achieved in\s+(\d+)\s+iterations", "int").alias("scf_iterations"),
        F.array_max(norms).alias("max_force_ry_au"), _one(text, r"(?s)total\s+stress.*?P=\s*(-?[\d.]+)", "double").alias("pressure_kbar"),
        _rows(F.regexp_extract(text, r"total\s+stress[^\n]*\n((?:\s*-?[\d.]+[^\n]*\n){3})", 1)).alias("stress"), _rows(cell).alias("cell"), atoms.alias("positions"),
        seconds(F.regexp_extract(text, r"(?:PWSCF|PHONON)\s*:.*?CPU\s+([\dhms. d]+?)\s*WALL", 1)).alias("wall_time_s"),
        _all(text, r"(?i)Warning:(.+)").alias("warnings"), _all(text, r"(?i)Error in routine (.+)").alias("errors"),
    )


def scf_history(text: Column) -> Column:
    """Array of (iteration, total_energy_ry, delta_e_ry)."""
    p = r"(?s)iter\s*#\s*(\d+).*?total energy\s*=\s*(-?[\d.]+)\s*Ry\s*delta\s*E\s*=\s*([-\d.eE+]+)\s*Ry"
    z = F.arrays_zip(_all(text, p, 1).alias("a"), _all(text, p, 2).alias("b"), _all(text, p, 3).alias("c"))
    return F.transform(z, lambda x: F.struct(x["a"].cast("int").alias("iteration"), x["b"].cast("double").alias("total_energy_ry"), x["c"].cast("double").alias("delta_e_ry")))


def relax_steps(text: Column) -> Column:
    p = r"(?s)number of scf cycles\s*=\s*(\d+).*?total energy\s*=\s*(-?[\d.]+)\s*Ry.*?convergence has been achieved"
    return F.transform(F.arrays_zip(_all(text, p, 1).alias("a"), _all(text, p, 2).alias("b")), lambda x: F.struct(x["a"].cast("int").alias("step"), x["b"].cast("double").alias("energy_ry")))


def phonons(text: Column) -> Column:
    """Array of (q, modes): each mode's THz and cm-1; a number that overflowed into stars is null and its mode is marked bad."""
    blocks = F.filter(F.split(text, r"(?m)^\s*q\s*=\s*\(?"), lambda b: b.rlike(r"\[THz\]"))
    pattern = r"=\s*([-\d.*]+)\s*\[THz\]\s*=\s*([-\d.*]+)\s*\[cm-1\]"

    def block(b: Column) -> Column:
        q = F.transform(F.slice(_all(F.substring_index(b, "\n", 1), r"(-?\d+\.\d+)"), 1, 3), lambda v: v.cast("double"))
        z = F.arrays_zip(_all(b, pattern, 1).alias("a"), _all(b, pattern, 2).alias("b"))
        modes = F.transform(z, lambda x: F.struct(x["a"].try_cast("double").alias("thz"), x["b"].try_cast("double").alias("cm1"), x["b"].try_cast("double").isNull().alias("bad")))
        return F.struct(q.alias("q"), modes.alias("modes"))

    return F.transform(blocks, block)


def dielectric(text: Column) -> Column:
    return _rows(F.regexp_extract(text, r"Dielectric constant in cartesian axis[^\n]*\n\s*((?:\s*\(?\s*-?[\d.]+[^\n]*\n){3})", 1))


def dos(text: Column) -> Column:
    """A density-of-states table: array of (energy, dos, partial)."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).startswith("#") & F.trim(x).rlike(r"^-?[\d.]"))
    numbers = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.try_cast("double")))
    return F.transform(F.filter(numbers, lambda v: F.size(v) >= 2), lambda v: F.struct(v[0].alias("energy"), v[1].alias("dos"), F.slice(v, 3, 99).alias("partial")))


def bands(text: Column) -> Column:
    """A band file: bands and k-points from its header, then each k-point's numbers after its coordinates."""
    nbnd, nks = _one(text, r"nbnd\s*=\s*(\d+)", "int"), _one(text, r"nks\s*=\s*(\d+)", "int")
    body = F.transform(_all(F.regexp_replace(text, r"^[^\n]*\n", ""), r"(-?\d+\.\d+(?:[eE][-+]?\d+)?)"), lambda v: v.cast("double"))
    per = nbnd + 3
    rows = F.transform(F.sequence(F.lit(0), nks - 1), lambda i: F.struct(F.slice(body, i * per + 1, F.lit(3)).alias("k"), F.slice(body, i * per + 4, nbnd).alias("values")))
    return F.struct(nbnd.alias("nbnd"), nks.alias("nks"), F.when(nks > 0, rows).alias("points"))


def neb(text: Column) -> Column:
    path = F.transform(_all(text, r"image:\s*\d+\s+(-?[\d.]+)\s*eV"), lambda v: v.cast("double"))
    return F.struct(F.lower(text).contains("neb: convergence achieved").alias("converged"), _one(text, r"(?i)activation energy.*?\((-?[\d.]+)\s*eV\)", "double").alias("activation_ev"), path.alias("path"), F.when(F.size(path) >= 2, F.round(F.element_at(path, -1) - path[0], 6)).alias("reaction_ev"))


def success(text: Column) -> Column:
    """Struct (ok, reason) from the first sign that an output gives."""
    say = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), reason.alias("reason"))
    out = F.when(F.coalesce(text, F.lit("")) == "", say(False, F.lit("empty output"))).when(text.contains("JOB DONE"), say(True, F.lit("JOB DONE found")))
    out = out.when(text.contains("convergence has been achieved"), say(True, F.lit("SCF converged")))
    out = out.when(text.contains("Error in routine"), say(False, F.concat(F.lit("QE error: "), F.regexp_extract(text, r"Error in routine (.+)", 1))))
    return out.when(F.lower(text).contains("stopping ..."), say(False, F.lit("QE stopped abnormally"))).otherwise(say(False, F.lit("JOB DONE not found")))


# Spectra and techniques


def linspace(start: Column, stop: Column, n: Column) -> Column:
    return F.when(n == 1, F.array(start.cast("double"))).when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + (stop - start) * i / (n - 1)))


def clean_spectrum(axis: Column, intensity: Column) -> Column:
    """Array of (x, y) in order of x, without points that are not finite or below zero."""
    good = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (p["y"] >= 0) & (p["y"] < float("inf"))
    return F.array_sort(F.filter(F.zip_with(axis, intensity, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), good))


#: Technique -> extensions with their scores, strong and weak words, and the axis range. A parser of one's own is another entry.
TECHNIQUES: dict[str, dict] = {
    "XRD": {"extensions": {".xrdml": 0.5, ".xy": 0.05, ".dat": 0.05, ".asc": 0.05}, "strong": ("2theta", "two-theta", "diffraction"), "weak": ("counts", "angle"), "axis": (0.0, 180.0)},
    "Raman": {"extensions": {".wdf": 0.6}, "strong": ("raman", "raman shift", "wavenumber"), "weak": ("cm-1", "laser"), "axis": (50.0, 4500.0)},
    "UV-Vis": {"extensions": {".sp": 0.4}, "strong": ("absorbance", "transmittance", "wavelength"), "weak": ("nm", "reflectance"), "axis": (180.0, 2600.0)},
    "SEM-EDS": {"extensions": {".spx": 0.6, ".emsa": 0.6, ".msa": 0.5}, "strong": ("weight %", "atomic %", "eds"), "weak": ("kev", "element"), "axis": (0.0, 40.0)},
}


def technique_scores(extension: Column, text: Column, low: Column, high: Column) -> Column:
    """Array of (score, name) of all techniques, in order of registration: words, extension and axis range add up to 1 at most."""
    words, out = F.lower(F.coalesce(text, F.lit(""))), []
    for name, t in TECHNIQUES.items():
        score = F.lit(0.0)
        for e, s in t["extensions"].items():
            score = score + F.when(F.lower(extension) == e, s).otherwise(0.0)
        for ws, s in ((t["strong"], 0.2), (t["weak"], 0.05)):
            for w in ws:
                score = score + F.when(words.contains(w), s).otherwise(0.0)
        score = score + F.when((low >= t["axis"][0]) & (high <= t["axis"][1]), 0.25).otherwise(0.0)
        out.append(F.struct(F.round(F.least(F.lit(1.0), score), 4).alias("score"), F.lit(name).alias("name")))
    return F.array(*out)


def technique(scores: Column, threshold: float = 0.6) -> Column:
    """Struct (technique, confidence): the first of the best, or Uncertain below the threshold, or Unknown at zero."""
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    first = F.filter(scores, lambda s: s["score"] == best)[0]["name"]
    return F.struct(F.when(best >= threshold, first).when(best > 0, "Uncertain").otherwise("Unknown").alias("technique"), best.alias("confidence"))


def delimiter(text: Column) -> Column:
    """The likelier of comma and tab by count; white space if there is neither."""
    commas, tabs = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in (",", "\t"))
    return F.when((commas == 0) & (tabs == 0), " ").when(commas >= tabs, ",").otherwise("\t")


def numeric_table(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows (x, y) of the lines that are numbers between white space, commas or tabs; comments begin with # ! ; or $."""
    cells = F.split(F.trim(F.regexp_replace(text, r"[,\t]+", " ")), r"\s+")
    good = ~F.col(text).rlike(r"^\s*[#!;$]") & (F.size(cells) >= 2)
    out = lines.where(good).select(cells[0].try_cast("double").alias("x"), cells[1].try_cast("double").alias("y"))
    return out.where("x IS NOT NULL AND y IS NOT NULL")


def percent_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, total, is_percent: numeric columns whose sum is between 90 and 110."""
    sums = table.agg(*(F.sum(F.col(c).try_cast("double")).alias(c) for c in columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("total")) for c in columns))).alias("x")).select("x.*", F.coalesce(F.col("x.total").between(90, 110), F.lit(False)).alias("is_percent"))


# Replies


def json_object(text: Column, schema: str) -> Column:
    """The object in a reply that may be fenced; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*", ""), r"(?s)\s*```$", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def first_json_array(text: Column) -> Column:
    """The first complete JSON array in a text, as a string; brackets inside strings don't count. Null if there is none."""

    def find(t: str | None) -> str | None:
        start = (t or "").find("[")
        while start >= 0:
            try:
                value, end = json.JSONDecoder(strict=False).raw_decode(t, start)
                if isinstance(value, list):
                    return t[start:end]
            except ValueError:
                pass
            start = t.find("[", start + 1)
        return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(find)

    return run(text)


def valid_items(items: Column, categories: tuple[str, ...]) -> Column:
    """The parsed (category, value) items of known categories with a value, trimmed."""
    clean = F.transform(items, lambda x: F.struct(F.lower(F.trim(x["category"])).alias("category"), F.trim(x["value"]).alias("value")))
    return F.filter(clean, lambda x: x["category"].isin(*categories) & (x["value"] != ""))


def sanitize_escapes(text: Column) -> Column:
    """Doubles backslashes that begin no JSON escape."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


def default_bands(atoms: Column) -> Column:
    return F.greatest(F.lit(8), F.floor(atoms * 4 * 1.2).cast("int"))


def dense_mesh(mesh: Column) -> Column:
    """Twice the points of a mesh in each direction."""
    return F.transform(mesh, lambda n: n * 2)


# The path Γ-X-M-Γ-R of cubic cells, with the points to the next.
K_PATH = ((0.0, 0.0, 0.0, 20), (0.5, 0.0, 0.0, 20), (0.5, 0.5, 0.0, 20), (0.0, 0.0, 0.0, 20), (0.5, 0.5, 0.5, 1))
