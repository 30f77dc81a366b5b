"""Spectra of many instruments from one scan of a folder: what a file is, by its first bytes and its name, and its axis and intensity.

One row per file: file, kind, axis, intensity, fault. A file that can't be read is a row with a fault, so none is lost and none ends the
job. Files are read whole, each in one task, in Arrow batches; contents do not leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholia.sources.readers import BINARY, binary_spectrum

SCHEMA = "file string, kind string, axis array<double>, intensity array<double>, fault string"
#: Files of a batch that a task holds: few, as they may be large.
ROWS = 64
# What the formats begin with, electron volts of a channel where a file tells none, the bytes ahead of an EDAX file's counts.
XML, EMSA, GALACTIC = (b"<?xml", b"<"), b"#FORMAT", (0x4B, 0x4C, 0x4D)
CHANNEL_EV, EDAX_SKIP, EDAX_MOST = 10.0, 4096, 1e9
_NUMBER = re.compile(r"-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?")


def kind_of(name: str, content: bytes) -> str:
    """The format of a file. First bytes count more than the name; a .spc is told apart by its version byte."""
    extension, head = "." + name.rpartition(".")[2].lower(), content.lstrip()[:64]
    if head.upper().startswith(EMSA):
        return "emsa"
    if content[:4] == b"WDF1":
        return "wdf"
    if head.startswith(XML):
        return "xrdml" if b"xrdMeasurement" in content or extension == ".xrdml" else "spx"
    if extension == ".spc":
        return "spc" if len(content) > 1 and content[1] in GALACTIC else "edax"
    if extension in BINARY and b"\0" in content:
        return extension[1:]
    return "emsa" if extension in (".emsa", ".msa") else "table"


def _tag(text: str, name: str, default: float) -> float:
    found = re.search(rf"(?im)^#{name}[^:\n]*:\s*({_NUMBER.pattern})", text)
    return float(found[1]) if found else default


def _inside(text: str, tag: str) -> str | None:
    found = re.search(rf"(?s)<{tag}\b[^>]*>([^<]*)</{tag}>", text)
    return found[1] if found else None


def _emsa(text: str) -> tuple[np.ndarray, np.ndarray]:
    body = re.split(r"(?im)^#SPECTRUM[^\n]*\n", text, maxsplit=1)[-1]
    lines = [_NUMBER.findall(line) for line in re.split(r"(?im)^#ENDOFDATA", body)[0].splitlines() if not line.lstrip().startswith("#")]
    y = np.array([float(n[-1]) for n in lines if n])
    return (np.arange(len(y)) - _tag(text, "CHOFFSET", 0)) * _tag(text, "EVCHANNEL", CHANNEL_EV) / 1000, y


def _spx(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    counts = _inside(text, "TrueSpectrum") or _inside(text, "Channels")
    if counts is None:
        return None
    y = np.array([float(n) for n in _NUMBER.findall(counts)])
    step = _NUMBER.findall(_inside(text, "CalibLin") or "")
    return np.arange(len(y)) * (float(step[0]) if step else CHANNEL_EV) / 1000, y


def _xrdml(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    counts = _inside(text, "intensities") or _inside(text, "counts")
    axis = re.search(r"(?s)<positions\b[^>]*axis=[\"']2Theta[\"'][^>]*>(.*?)</positions>", text)
    ends = [_NUMBER.findall(_inside(axis[1], t) or "") for t in ("startPosition", "endPosition")] if axis else []
    if counts is None or not ends or not all(ends):
        return None
    y = np.array([float(n) for n in _NUMBER.findall(counts)])
    return np.linspace(float(ends[0][0]), float(ends[1][0]), len(y)), y


def _edax(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    y = np.frombuffer(content[EDAX_SKIP:], "<u4", max(0, len(content) - EDAX_SKIP) // 4).astype(float)
    y = y[y < EDAX_MOST]
    return np.arange(len(y)) * CHANNEL_EV / 1000, y


def _table(text: str) -> tuple[np.ndarray, np.ndarray]:
    rows = [re.split(r"[,\t\s]+", line.strip()) for line in text.splitlines() if not re.match(r"\s*[#!;$]", line)]
    pairs = [(float(r[0]), float(r[1])) for r in rows if len(r) >= 2 and all(_NUMBER.fullmatch(c) for c in r[:2])]
    return tuple(np.array(pairs, float).reshape(-1, 2).T)


def spectrum(name: str, content: bytes | None) -> tuple[str | None, list[float] | None, list[float] | None, str | None]:
    """kind, axis, intensity, fault of one file; points that are not finite or below zero are left out of counts."""
    if not content:
        return None, None, None, "empty file"
    kind = kind_of(name, content)
    try:
        if kind in ("emsa", "spx", "xrdml", "table"):
            text = content.decode("utf-8", "replace")
            found = {"emsa": _emsa, "spx": _spx, "xrdml": _xrdml, "table": _table}[kind](text)
        else:
            found = _edax(content) if kind == "edax" else binary_spectrum(f".{kind}", content)
    except (ValueError, IndexError) as e:
        return kind, None, None, str(e)[:200]
    if found is None or not len(found[1]):
        return kind, None, None, "no numbers"
    x, y = found
    good = np.isfinite(x) & np.isfinite(y)
    if kind in ("emsa", "spx"):
        good &= (x >= 0) & (y >= 0)
    return kind, x[good].tolist(), y[good].tolist(), None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            b = batch.slice(start, ROWS)
            found = [spectrum(n.rsplit("/", 1)[-1], c) for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], ["file", "kind", "axis", "intensity", "fault"])


def spectra(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The spectra of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(_read, SCHEMA)
