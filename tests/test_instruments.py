"""Instrument files written from the embeddings and read back by one scan."""

from __future__ import annotations

import numpy as np
import pytest

from scholia.catalog import load
from scholia.sources import instruments as I
from tests.conftest import SF


def written(path, vectors):
    """Files of all kinds, and what they must give: name -> kind, axis, intensity."""
    want = {}
    for i, v in enumerate(vectors):
        y = np.abs(np.array(v, np.float32)) * 100
        whole = np.floor(y * 10).astype(np.uint32)
        n = len(y)

        def put(name, content, kind, axis, intensity):
            (path / f"part{i}").mkdir(exist_ok=True)
            (path / f"part{i}" / name).write_bytes(content if isinstance(content, bytes) else content.encode())
            want[f"part{i}/{name}"] = (kind, np.round(axis, 6).tolist(), np.round(np.array(intensity, float), 6).tolist())

        put("a.raw", b"\0" * 712 + y.astype("<f4").tobytes(), "raw", np.linspace(10, 80, n), y)
        put("b.wdf", b"WDF1" + b"\0" * 508 + y.astype("<f4").tobytes(), "wdf", np.linspace(100, 3500, n), y)
        put("wdf-by-its-bytes.dat", b"WDF1" + b"\0" * 508 + y.astype("<f4").tobytes(), "wdf", np.linspace(100, 3500, n), y)
        put("c.SP", b"\0" * 4096 + (y / 100).astype("<f4").tobytes(), "sp", np.linspace(800, 200, n), (y / 100).astype("<f4"))
        put("d.spc", bytes([0, 0x4B, 0, 128]) + n.to_bytes(4, "little") + np.array([5.0, 9.0], "<f8").tobytes() + b"\0" * 488 + y.astype("<f4").tobytes(), "spc", np.linspace(5, 9, n), y)
        put("e.spc", b"\0" * 4096 + whole.astype("<u4").tobytes(), "edax", np.arange(n) * 0.01, whole)
        put("f.emsa", "#FORMAT : EMSA\n#EVCHANNEL : 5.0\n#CHOFFSET : 2\n#SPECTRUM\n" + "".join(f"{c},\n" for c in whole) + "#ENDOFDATA\n", "emsa", (np.arange(n) - 2)[2:] * 0.005, whole[2:])
        put("g.spx", f'<?xml version="1.0"?><r><TrueSpectrum a="b">{" ".join(map(str, whole))}</TrueSpectrum><CalibLin>20</CalibLin></r>', "spx", np.arange(n) * 0.02, whole)
        put("h.xrdml", f'<xrdMeasurements><xrdMeasurement><positions axis="2Theta" unit="deg"><startPosition>10</startPosition><endPosition>20</endPosition></positions><intensities>{" ".join(map(str, whole))}</intensities></xrdMeasurement></xrdMeasurements>', "xrdml", np.linspace(10, 20, n), whole)
        put("i.txt", "# header\nangle counts\n" + "".join(f"{k}\t{c}\n" for k, c in enumerate(whole)), "table", np.arange(n), whole)
    return want


def test_files_of_all_kinds_are_read_back(spark, tmp_path):
    vectors = [r[0] for r in load(spark, SF, "embeddings").orderBy("vec_id").select("embedding").limit(8).collect()]
    want = written(tmp_path, vectors)
    got = {"/".join(r["file"].split("/")[-2:]): (r["kind"], [round(x, 6) for x in r["axis"]], [round(y, 6) for y in r["intensity"]]) for r in I.spectra(spark, str(tmp_path)).where("fault IS NULL").collect()}
    assert got == want


def test_faults_are_rows(spark, tmp_path):
    bad = {"a.spx": b"<x/>", "b.wdf": b"WDF1", "c.emsa": b"#FORMAT\n#SPECTRUM\n", "d.xrdml": b"<?xml?><counts>1 2</counts>", "e.spc": b"\0\x4b", "f.txt": b"no numbers here", "g.raw": b"\0" * 800, "h.dat": bytes(range(256))}
    for n, c in bad.items():
        (tmp_path / n).write_bytes(c)
    rows = {r["file"].rsplit("/", 1)[1]: r for r in I.spectra(spark, str(tmp_path)).collect()}
    assert set(rows) == set(bad) and all(r["fault"] for n, r in rows.items() if n != "g.raw") and rows["g.raw"]["intensity"] == [0.0] * 22
    assert I.spectra(spark, str(tmp_path), "*.none").count() == 0
    assert I.spectrum("x", None)[3] == I.spectrum("x", b"")[3] == "empty file"


@pytest.mark.parametrize("name,content,kind", [("a.spc", b"\0\x4b\0", "spc"), ("a.spc", b"\0\0\0", "edax"), ("a.MSA", b"1 2", "emsa"), ("a", b"1 2", "table"), ("a.raw", b"1 2", "table"), ("a.txt", b" #format x", "emsa")])
def test_kinds(name, content, kind):
    assert I.kind_of(name, content) == kind
