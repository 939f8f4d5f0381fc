"""The drawing source and operators against the sample drawings' manifests."""

import pytest

from plumbline.operators import measures, netlist, retrieval, spatial
from plumbline.sources import dxf


def of_kind(samples, kind):
    return {name: m for name, m in samples[1].items() if m["kind"] == kind}


def test_units_and_room_areas(facts, samples):
    units = {r["drawing_id"]: r["units"] for r in facts.sheets.collect()}
    got = {}
    for r in facts.regions.where("layer = 'ROOMS'").collect():
        got.setdefault(r["drawing_id"], {})[r["label"]] = r["area_m2"]
    for name, m in of_kind(samples, "floorplan").items():
        assert units[name] == m["units"]
        assert {x["name"]: round(x["area_m2"], 3) for x in m["rooms"]} == pytest.approx(got[name], abs=0.01)


def test_doors_and_windows(facts, samples):
    doors = {(r["drawing_id"], r["in_region"]): r["scale"] for r in facts.doors.collect()}
    windows = {(r["drawing_id"], r["label"]): r["count"] for r in spatial.count_per_region(facts.entities, facts.sheets, "WINDOWS", "ROOMS").collect()}
    for name, m in of_kind(samples, "floorplan").items():
        for room in m["rooms"]:
            assert doors[(name, room["name"])] == room["door_width"]
            assert windows[(name, room["name"])] == len(room["windows"])


def test_holes_and_plates(facts, samples):
    got = {}
    for r in measures.circles(facts.entities, "HOLES").collect():
        got.setdefault(r["drawing_id"], {})[r["diameter"]] = r["n"]
    areas = {r["drawing_id"]: r["area"] for r in facts.regions.where("layer = 'OUTLINE'").collect()}
    for name, m in of_kind(samples, "part").items():
        sizes = [h["d"] for h in m["holes"]]
        assert got[name] == {d: sizes.count(d) for d in sizes} and areas[name] == m["plate_area_mm2"]


def test_downstream_loads_of_boards(facts, samples):
    got = {(r["drawing_id"], r["tag"]): r["total"] for r in facts.circuits.collect()}
    assert got == {(name, c["tag"]): c["load_w"] for name, m in of_kind(samples, "electrical").items() for c in m["circuits"]}
    below = {}
    for r in facts.below.collect():
        below.setdefault((r["drawing_id"], r["root"]), set()).add(r["tag"])
    for name, m in of_kind(samples, "electrical").items():
        for c in m["circuits"]:
            assert below[(name, c["tag"])] == {c["cable_tag"], *(x["tag"] for x in c["loads"])} | ({c["rcd"]["tag"]} if c["rcd"] else set())


def test_nets_and_neighbours_of_diagrams(facts, samples):
    nets, near = {}, {}
    for r in netlist.nets(facts.attached).collect():
        nets.setdefault(r["drawing_id"], []).append(r["members"])
    for r in measures.component_details(facts.parts, facts.edges).collect():
        near[(r["drawing_id"], r["tag"])] = r["connected_to"]
    for name, m in of_kind(samples, "electronic").items():
        assert sorted(nets[name]) == sorted(m["nets"].values())
        assert {t: near[(name, t)] for t in m["neighbours"]} == m["neighbours"]


def test_kinds_of_drawings(facts, samples):
    says = {"floorplan": "building floor plan", "part": "mechanical part", "electrical": "electrical/electronic schematic", "electronic": "electrical/electronic schematic"}
    assert {r["drawing_id"]: r["domain"] for r in facts.domains.collect()} == {name: says[m["kind"]] for name, m in samples[1].items()}


def test_bad_files(spark, tmp_path):
    good = "0\nSECTION\n2\nENTITIES\nodd\ncode\n0\nLINE\n8\nA\n10\n0\n20\n0\n11\n3\n21\n4\n0\nCIRCLE\n8\nA\n10\nx\n20\n0\n40\n1\n0\nENDSEC\n0\nEOF\n"
    (tmp_path / "a.dxf").write_text(good)
    (tmp_path / "b.dxf").write_text("no drawing\n")
    rows = {r["drawing_id"]: r for r in dxf.read_dxf(spark, str(tmp_path)).collect()}
    assert [e["length"] for e in rows["a"]["entities"]] == [5.0] and len(rows["a"]["warnings"]) == 2 and "1 errors" in rows["a"]["warnings"][0] + rows["a"]["warnings"][1]
    assert rows["b"]["entities"] == [] and rows["b"]["warnings"]
    for name in "ab":
        with pytest.raises((dxf.NotADrawing, ValueError)):
            dxf.parse((tmp_path / f"{name}.dxf").read_text(), strict=True)


def test_not_a_drawing_raises():
    with pytest.raises(dxf.NotADrawing):
        dxf.parse("hello\nworld\n")


def test_structure_chunks_carry_sections_over_pages(spark):
    pages = spark.createDataFrame([("s", 1, "3 Corridors and Circulation\n3.1 First rule\nends here.\n3.2 Width not less than 1100 mm"), ("s", 2, "more of it\n4 Doors\n4.1 Doors")], "source string, page int, text string")
    rows = sorted((r["n"], r["page"], r["text"]) for r in retrieval.structure_chunks(pages).collect())
    assert rows == [
        (0, 1, "[3 Corridors and Circulation] 3.1 First rule ends here."),
        (1, 1, "[3 Corridors and Circulation] 3.2 Width not less than 1100 mm"),
        (2, 2, "[3 Corridors and Circulation] more of it"),
        (3, 2, "[4 Doors] 4.1 Doors"),
    ]
