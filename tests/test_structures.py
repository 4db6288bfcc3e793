"""Structure texts, components, rings and runs: small cases by hand, rings and components against plain searches, round trips through files."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weft.functions import chemistry
from weft.operators import patterns, runs, structures
from weft.sources import files

GOOD = {
    "C": (["C"], []), "CCO": (["C", "C", "O"], [(0, 1, "single"), (1, 2, "single")]), "C(=O)(O)N": (["C", "O", "O", "N"], [(0, 1, "double"), (0, 2, "single"), (0, 3, "single")]),
    "c1ccncc1": (["C", "C", "C", "N", "C", "C"], [(0, 1, "aromatic"), (1, 2, "aromatic"), (2, 3, "aromatic"), (3, 4, "aromatic"), (4, 5, "aromatic"), (0, 5, "aromatic")]),
    "C1=CC1": (["C", "C", "C"], [(0, 1, "double"), (1, 2, "single"), (0, 2, "single")]), "C=1CC=1": (["C", "C", "C"], [(0, 1, "single"), (1, 2, "single"), (0, 2, "double")]),
    "[Fe+2].[O-]C": (["Fe", "O", "C"], [(1, 2, "single")]), "ClC%10CC%10": (["Cl", "C", "C", "C"], [(0, 1, "single"), (1, 2, "single"), (2, 3, "single"), (1, 3, "single")]),
    "[13CH3][C@@H](N)C#N": (["C", "C", "N", "C", "N"], [(0, 1, "single"), (1, 2, "single"), (1, 3, "single"), (3, 4, "triple")]), "C12CC1C2": (["C"] * 4, [(0, 1, "single"), (1, 2, "single"), (0, 2, "single"), (2, 3, "single"), (0, 3, "single")]),
    "F/C=C\\F": (["F", "C", "C", "F"], [(0, 1, "single"), (1, 2, "double"), (2, 3, "single")]), "[se]1cccc1": (["Se", "C", "C", "C", "C"], [(0, 1, "aromatic"), (1, 2, "aromatic"), (2, 3, "aromatic"), (3, 4, "aromatic"), (0, 4, "aromatic")]),
}
BAD = ["", "C(", "C)", "C1CC", "()", "C()", "(C)", "C=", "=C", "C==C", "[Xx]", "[C", "C.", ".C", "C..C", "C11", "C1C1", "X", "C C", "C=1CC#1", "C(.C)", "C(=)C", "1C", "C%1"]


def test_smiles(spark):
    for text, (symbols, bonds) in GOOD.items():
        atoms, found = chemistry.smiles_graph(text)
        assert [a["symbol"] for a in atoms] == symbols and sorted((min(b["a"], b["b"]), max(b["a"], b["b"]), b["bond"]) for b in found) == sorted(bonds), text
    atoms, _ = chemistry.smiles_graph("[NH4+].[Cu--].[13CH2-]")
    assert [(a["charge"], a["hydrogens"]) for a in atoms] == [(1, 4), (-2, 0), (-1, 2)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*GOOD, *BAD, None])], "i int, smiles string").repartition(3)
    found = {r["i"]: r for r in structures.smiles_graphs(rows).collect()}
    n = len(GOOD)
    assert all(found[i]["error"] is None and len(found[i]["atoms"]) == len(s) and len(found[i]["bonds"]) == len(b) for i, (s, b) in enumerate(GOOD.values()))
    assert all(found[i]["atoms"] is None and " at " in found[i]["error"] for i in range(n, n + len(BAD)))
    assert found[n + len(BAD)]["error"] is None and found[n + len(BAD)]["atoms"] is None and structures.smiles_graphs(rows.limit(0)).count() == 0
    deep = "C(" * 30_000 + "C" + ")" * 30_000
    assert len(chemistry.smiles_graph(deep)[0]) == 30_001


def reached(n, bonds, start):
    near = {i: set() for i in range(n)}
    for a, b in bonds:
        near[a].add(b)
        near[b].add(a)
    out, todo = {start}, [start]
    while todo:
        new = near[todo.pop()] - out
        out |= new
        todo += new
    return out


def test_rings_and_components(spark):
    """Against the definition: a bond is on a ring if its ends are joined without it."""
    rng = random.Random(12)
    graphs = []
    for _ in range(150):
        n = rng.randint(1, 12)
        pairs = list(itertools.combinations(range(n), 2))
        bonds = rng.sample(pairs, min(len(pairs), rng.randint(0, n + 2)))
        want = [any(i in e and e[1] in reached(n, [x for x in bonds if x != e], e[0]) for e in bonds) for i in range(n)]
        assert chemistry.ring_atoms(n, bonds) == want
        graphs.append((n, bonds, want))
    line = 50_000
    assert chemistry.ring_atoms(line, [(i, i + 1) for i in range(line - 1)]) == [False] * line
    rows = [(e, [(10 * i, "C") for i in range(n)], [(10 * a, 10 * b, "single") for a, b in bonds] + [(0, 999, "single")]) for e, (n, bonds, _) in enumerate(graphs)]
    entries = spark.createDataFrame([*rows, (-1, [], [])], "entry int, atoms array<struct<ord:int,symbol:string>>, bonds array<struct<a:int,b:int,bond:string>>").repartition(3)
    assert {r["entry"]: r["cyclic"] for r in structures.with_rings(entries).collect()} == {e: w for e, (*_, w) in enumerate(graphs)} | {-1: []}
    found = {}
    for r in structures.components(entries).collect():
        found.setdefault(r["entry"], {})[r["ord"]] = ({a["ord"] // 10 for a in r["atoms"]}, len(r["bonds"]))
    for e, (n, bonds, _) in enumerate(graphs):
        parts = sorted({tuple(sorted(reached(n, bonds, i))) for i in range(n)})
        assert found[e] == {i: (set(p), sum(a in p for a, _ in bonds)) for i, p in enumerate(parts, 1)}
    assert -1 not in found


def test_component_of_interest_from_bonds(spark):
    """A metal bonded to carbon and the greater weight choose the first part of m1; m2's parts are too small; m3 has one."""
    m1 = [(i, s) for i, s in enumerate(["Fe", "C", "C", "O", "O", "H", "H", "H", "H", "H", "H"])]
    rows = [
        ("m1", m1, [(0, 1, "single"), (1, 2, "single"), (2, 3, "single"), (3, 4, "single")] + [(i, i + 1, "single") for i in range(5, 10)]),
        ("m2", [(0, "Fe"), (1, "C"), (2, "O")], [(0, 1, "single")]),
        ("m3", [(i, "C") for i in range(6)], [(i, i + 1, "single") for i in range(5)]),
    ]
    entries = spark.createDataFrame(rows, "entry string, atoms array<struct<ord:int,symbol:string>>, bonds array<struct<a:int,b:int,bond:string>>")
    assert {tuple(r) for r in structures.components_of_interest(entries).collect()} == {("m1", 1), ("m3", 1)}
    facts = {(r["entry"], r["ord"]): (r["organometallic"], r["n_atoms"]) for r in structures.component_facts(entries).collect()}
    assert facts == {("m1", 1): (True, 5), ("m1", 2): (False, 6), ("m2", 1): (True, 2), ("m2", 2): (False, 1), ("m3", 1): (False, 6)}


def test_patterns_of_perceived_rings(spark):
    atoms = spark.createDataFrame([("r", i, s) for i, s in enumerate(["Fe", "C", "C", "C", "O"])], "entry string, ord int, symbol string").withColumns({"metal": F.col("symbol") == "Fe", "nonmetal": F.col("symbol") != "Fe"})
    bonds = spark.createDataFrame([("r", a, b, k) for a, b, k in ((0, 1, "single"), (1, 2, "single"), (0, 2, "single"), (2, 3, "double"), (3, 4, "single"))], "entry string, a int, b int, bond string")
    found = structures.perceived(atoms, bonds, "metal", "nonmetal")
    assert {r["ord"]: r["cyclic"] for r in found.collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}
    named = {k: patterns.library()[k] for k in ("chelating_ligands", "linear_ligands", "saturated_chains")}
    assert patterns.found(found, bonds, named).first().asDict() == {"entry": "r", "chelating_ligands": True, "linear_ligands": False, "saturated_chains": True}


CIF = """#comment
data_one
_cell_length_a 10.0(1)
_cell_length_b 8
_cell_length_c 5
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma {gamma}
_chemical_name 'it''s a "name" # no comment'
_text
;
loop_
_atom_site_label not a loop
;
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
_atom_site_disorder_group
Fe1 Fe 0.1(2) 0.1 0.1 1 .
Mn1 Mn3+ 0.9 0.9 0.9 1 .
C1 C 0.2 0.1 0.1 {share} {group}
'O 1' ? 0.3 0.1 0.1 1 .
H1 H 0.1 0.25 0.1 1 .
loop_
_geom_bond_atom_site_label_1
_geom_bond_atom_site_label_2
_geom_bond_site_symmetry_2
_ccdc_geom_bond_type
Fe1 C1 . pi
C1 'O 1' . S
Fe1 Mn1 {symmetry} S
H1 nowhere . S
data_empty
_cell_length_a 1
"""


def test_cif_folder_to_the_table(spark, tmp_path):
    plain = {"gamma": 90, "share": 1, "group": ".", "symmetry": "."}
    made = {"good": {}, "polymer": {"symmetry": "2_555"}, "half": {"share": 0.5}, "group": {"group": "1"}, "flat": {"gamma": "?"}, "skew": {"gamma": 60}}
    (tmp_path / "deep").mkdir()
    for name, more in made.items():
        (tmp_path / "deep" / f"{name}.cif").write_text(CIF.format(**plain | more))
    (tmp_path / "junk.cif").write_text("no blocks 'here")
    (tmp_path / "nothing.cif").write_text("")
    (tmp_path / "torn.cif").write_text("data_x\nloop_\n_atom_site_label\n_atom_site_fract_x\nFe1 0.5\nC1")
    read = structures.cif_structures(files.structure_texts(spark, f"file://{tmp_path}"))
    entries = structures.placed(read).cache()
    by = {r["path"].rpartition("/")[2]: r for r in entries.collect()}
    assert set(by) == {f"{n}.cif" for n in made} | {"torn.cif"} and len(by["torn.cif"]["atoms"]) == 1
    good = by["good.cif"]
    assert (good["entry"], good["is_3d"], good["disorder"], good["polymeric"]) == ("one", True, False, False)
    assert [(a["symbol"], a["number"]) for a in good["atoms"]] == [("Fe", 26), ("Mn", 25), ("C", 6), ("O", 8), ("H", 1)]
    assert [round(good["atoms"][0][k], 6) for k in "xyz"] == [1.0, 0.8, 0.5]
    skew = by["skew.cif"]["atoms"][0]
    assert [round(skew[k], 6) for k in "xyz"] == [1.4, round(0.8 * math.sin(math.pi / 3), 6), 0.5]
    assert [(b["a"], b["b"], b["bond"]) for b in good["bonds"]] == [(0, 2, "pi"), (2, 3, "S"), (0, 1, "S")]
    assert by["polymer.cif"]["polymeric"] and by["half.cif"]["disorder"] and by["group.cif"]["disorder"] and not by["flat.cif"]["is_3d"]
    table = {r["File Name"].rpartition("/")[2]: r.asDict() for r in structures.structure_table(entries).collect()}
    assert set(table) == {"good.cif", "skew.cif"}
    row = table["good.cif"]
    row.pop("File Name")
    assert row == {"Metals": "Fe(1), Mn(1)", "Component Count": 2, "Components With Metals": "1: Fe(1), Mn(1)", "Polymolecular": True, "Polymetallic": True, "Organometallic": True, "Explicit Hs": True, "Hapticity": True, "N_Atoms": 5, "Connectivity": "Partial", "Metal_Bonds": True, "Overlapping Atoms": False}


def sdf(name, *atoms):
    body = "".join(f"{x:10.4f}{0:10.4f}{0:10.4f} C   0  0\n" for x in atoms)
    return f"{name}\n\n\n{len(atoms):3d}  0\n{body}M  END\n"


def test_a_run_in_one_call(spark, tmp_path):
    """Unique targets, lengths of two-atom records, classes, counters, files read back, and lists of several thresholds."""
    t = [
        (1, "T1", "a", 3, [0.0], sdf("t1", 0, 1, 2)), (2, "T1", "a", 3, [0.0], sdf("copy", 0, 1, 2)), (3, "T1", "b", 2, [5.0], sdf("t3", 0, 1.0)), (4, "T2", "b", 2, [5.0], sdf("t4", 0, 1.5)),
        (5, "T2", "a", 3, [3.0], sdf("t5", 0, 1, 2)), (6, "T2", "nowhere", 3, [0.0], sdf("t6", 0, 1, 2)),
    ]
    p = [(11, "a", 3, [0.0], sdf("p11", 0, 1, 2)), (12, "b", 2, [0.0], sdf("p12", 0, 1.05)), (13, "b", 2, [5.0], sdf("p13", 0, 1.2))]
    targets = spark.createDataFrame(t, "id int, owner string, formula string, n_atoms int, fp array<double>, sdf string")
    population = spark.createDataFrame(p, "id int, formula string, n_atoms int, fp array<double>, sdf string")
    run = runs.compared(targets, population, ["formula", "n_atoms"], 0.99)
    found = {r["target"]: (r["partner"], round(r["score"], 4), r["class"], r["gap"] and round(r["gap"], 4)) for r in run.collect()}
    assert found == {1: (11, 1.0, "matched", None), 3: (12, 0.95, "matched", 0.05), 4: (None, -1.0, "distorted", None), 5: (11, 0.25, "distorted", None), 6: (None, -1.0, "no_match", None)}
    assert {tuple(r) for r in runs.counters(run).collect()} == {("T1", 2, 0, 0, 2), ("T2", 0, 2, 1, 3)}
    runs.write_matches(run, f"{tmp_path}/out")
    records = {}
    for r in files.sdf_records(spark, f"file://{tmp_path}/out/*/*").collect():
        records.setdefault(int(r["path"].split("target=")[1].split("/")[0]), {})[r["pos"]] = r["record"]
    assert {k: len(v) for k, v in records.items()} == {1: 2, 3: 2, 4: 1, 5: 2, 6: 1}
    assert records[3][0].startswith("t3\n") and "<DistanceDifference>\n0.0500\n" in records[3][1] and "Distorted" not in records[3][1]
    assert "<Similarity>\n0.2500\n" in records[5][1] and "<DistortedMatch>\nTrue\n" in records[5][1] and "<Similarity>\n1.0000\n" in records[1][1]
    lists = spark.createDataFrame([("T1", f"e{i}", "C", i / 10) for i in range(10)], "target string, entry_id string, smiles string, similarity double").unionAll(spark.createDataFrame([("T2", "z", "N", 0.45)], "target string, entry_id string, smiles string, similarity double"))
    runs.write_populations(lists.repartition(4), f"{tmp_path}/lists", [0.3, 0.5])
    read = lambda target, at: [x for f in sorted((tmp_path / f"lists/target={target}/threshold={at}").glob("part-*")) for x in f.read_text().splitlines()]
    assert read("T1", "0_3") == ["e2 C 0.2000", "e1 C 0.1000", "e0 C 0.0000"] and len(read("T1", "0_5")) == 5 and read("T2", "0_5") == ["z N 0.4500"]
    assert not (tmp_path / "lists/target=T2/threshold=0_3").exists()


@pytest.mark.parametrize("record", [sdf("x", 0, 1, 2), "junk", "", None])
def test_no_bond_length(spark, record):
    assert spark.createDataFrame([(record,)], "sdf string").select(runs.bond_length(F.col("sdf")).alias("n")).first()["n"] is None


def test_small_tools(spark, tmp_path):
    """A seeded sample, population sizes from logs, and features of keys."""
    from weft.operators import logs, sets, stats

    rows = spark.range(100).coalesce(1)
    one, two = ([r["id"] for r in stats.sampled(rows, 7, 5).collect()] for _ in range(2))
    assert one == two and len(set(one)) == 7 and stats.sampled(rows, 500, 5).count() == 100
    (tmp_path / "pop_0_3.log").write_text("INFO: Number of final molecules for ABC: 12\nnumber of FINAL molecules for D-1: 0\nother\n")
    found = logs.population_sizes(files.whole(spark, f"file://{tmp_path}/pop_0_3.log"))
    assert sorted(map(tuple, found.collect())) == [(0.3, "ABC", 12), (0.3, "D-1", 0)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    marked = sets.features(rows.limit(4), {"a": ids(1, 1, 9), "b": ids()}, "id")
    assert sorted(map(tuple, marked.collect())) == [(0, False, False), (1, True, False), (2, False, False), (3, False, False)]
