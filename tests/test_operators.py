"""Small fixtures for ties, missing values, class edges and greedy order."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft import schemas
from weft.functions import texts, vectors
from weft.operators import logs, match, molecules, patterns, results, sets, stats
from weft.sources import files
from weft.streaming import ingest


def test_greedy_depends_on_order(spark):
    rows = lambda order: spark.createDataFrame([(i, 1, [v]) for i, v in enumerate(order)], "id int, b int, fp array<double>")
    kept = lambda order: sorted(order[r["id"]] for r in match.unique(rows(order), ["b"], "id", 1 / 1.1 - 1e-9).collect())
    assert kept([0.0, 0.1, 0.2]) == [0.0, 0.2]
    assert kept([0.1, 0.0, 0.2]) == [0.1]
    assert kept([0.1, 0.1, 0.1]) == [0.1]


def test_classes_and_ties(spark):
    t = spark.createDataFrame([(1, "a", [0.0]), (2, "b", [0.0]), (3, "c", [0.0])], "id int, block string, fp array<double>")
    p = spark.createDataFrame([(11, "a", [0.0]), (10, "a", [0.0]), (12, "b", [1.0])], "id int, block string, fp array<double>")
    found = {r["target"]: (r["partner"], r["score"], r["class"]) for r in match.best_match(t, p, ["block"], 0.98).collect()}
    assert found == {1: (10, 1.0, "matched"), 2: (12, 0.5, "distorted"), 3: (None, -1.0, "no_match")}


def test_biatomic(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.05), (2, 1.0, 1.1), (3, 1.0, None)], "i int, a double, b double")
    found = [r[0] for r in rows.orderBy("i").select(match.biatomic_score(F.col("a"), F.col("b"))).collect()]
    assert found == [pytest.approx(0.95), -1.0, -1.0]


def test_biatomic_miss_has_no_partner(spark):
    t = spark.createDataFrame([(1, "a", [1.0])], "id int, block string, fp array<double>")
    p = spark.createDataFrame([(9, "a", [1.1])], "id int, block string, fp array<double>")
    score = match.biatomic_score(F.col("target_fp")[0], F.col("partner_fp")[0])
    r = match.best_match(t, p, ["block"], 0.9, score).first()
    assert (r["partner"], r["score"], r["class"]) == (None, -1.0, "distorted")


def test_threshold_is_strict(spark):
    t, p = (spark.createDataFrame([(i, [v])], "id int, fp array<double>") for i, v in ((1, 0.0), (2, 1.0)))
    assert match.below(t, p, 0.5).count() == 0
    assert match.below(t, p, 0.51).count() == 1


def test_component_of_interest(spark):
    rows = [("x", 0, True, 9.0, 4), ("x", 1, False, 1.0, 9), ("y", 0, False, 1.0, 6), ("y", 1, False, 1.0, 6)]
    c = spark.createDataFrame(rows, "entry string, ord int, metal boolean, weight double, atoms int")
    c = molecules.heaviest(molecules.heaviest(c, "weight"), "atoms")
    found = molecules.component_of_interest(c, [F.col("metal"), F.col("top_weight"), F.col("top_atoms")], F.col("atoms"))
    assert [tuple(r) for r in found.collect()] == [("y", 0)]


def test_structure_rules(spark):
    atom = "struct<ord:int,number:int,x:double,y:double,z:double,n_bonds:int>"
    rows = spark.createDataFrame([(1, [(0, 6, 0.0, 0.0, 0.0, 1), (1, 6, 0.3, 0.0, 0.0, 1)]), (2, [(0, 1, None, None, None, 0), (1, 6, 5.0, 0.0, 0.0, 1)]), (3, [])], f"i int, atoms array<{atom}>")
    found = rows.orderBy("i").select(molecules.overlapping(F.col("atoms")), molecules.hydrogens_placed(F.col("atoms")), molecules.connectivity(F.filter("atoms", lambda a: a["n_bonds"] > 0), F.col("atoms"))).collect()
    assert [tuple(r) for r in found] == [(True, True, "Complete"), (False, False, "Partial"), (False, True, "None")]


def test_spread_and_missing(spark):
    rows = spark.createDataFrame([("a", "0.50"), ("a", "N.A."), ("a", "0.70"), ("b", "1")], "k string, t string").withColumn("v", texts.number(F.col("t")))
    found = {r["k"]: (r["v_mean"], r["v_std"]) for r in results.spread(rows, ["k"], ["v"]).collect()}
    assert found["a"] == (pytest.approx(0.6), pytest.approx(0.1414214, abs=1e-6)) and found["b"] == (1.0, None)


def test_natural_order(spark):
    rows = spark.createDataFrame([("1_A",), ("2_C",), ("10_B",)], "t string")
    assert [r[0] for r in rows.orderBy("t").collect()] == ["10_B", "1_A", "2_C"]
    assert [r[0] for r in rows.orderBy(texts.natural_key(F.col("t"))).collect()] == ["1_A", "2_C", "10_B"]


def test_rates_keep_nan_apart(spark):
    rows = spark.createDataFrame([("r", "t", x) for x in (0.0, 0.2, float("nan"), 0.5)], "run string, task string, s double")
    r = results.three_levels(rows, "task", "run", F.col("s") == 0).first()
    assert r["mean_rate"] == r["pooled_rate"] == 0.75


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "k int, fp string, s string") for x in ([(2, None, "y"), (1, "a", "x")], [(2, "b", "yy"), (1, "z", "xx"), (3, None, "n")]))
    found = {tuple(r) for r in molecules.upsert(old, new, ["k"], ["fp"]).collect()}
    assert found == {(2, "b", "yy"), (1, "a", "xx"), (3, None, "n")}


def test_formula_texts(spark):
    r = spark.range(1).select(texts.formula_counts(F.lit("C12H4OC")).alias("c"), texts.counted_map(F.lit("Fe(3), Mn(1)")).alias("m"), vectors.parsed(F.lit("oops")).alias("bad"), vectors.parsed(F.lit("[1, 2.5]")).alias("good"), texts.smiles_elements(F.lit("[Fe+2]CCl")).alias("e")).first()
    assert r["c"] == {"C": 13, "H": 4, "O": 1} and r["m"] == {"Fe": 3, "Mn": 1} and r["bad"] == [] and r["good"] == [1.0, 2.5] and r["e"] == ["C", "Cl", "Fe"]


def test_similarity_properties(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = rows.select(vectors.l1_similarity(a, b), vectors.l1_similarity(b, a), vectors.l1_similarity(a, a), vectors.l2_distance(a, b), vectors.cosine(a, b), vectors.tanimoto(a, b)).first()
    assert tuple(r) == (0.4, 0.4, 1.0, pytest.approx(5**0.5), pytest.approx(1.0), pytest.approx(1 / 3))


def test_match_log(spark):
    lines = ["x INFO: 🔍 Target: ABC", "x INFO: ✅ Unique target CAEs: 5", "x INFO: 📊 Matched 3/5 CAEs", "x INFO: 🟡 1 matched only as Distorted Matches", "x INFO: 🟥 1 had no population CAE", "x INFO: 🔍 Target: DEF", "x INFO: ✅ Unique target CAEs: 2", "x INFO: 📊 Matched 1/2 CAEs"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, value string")
    found = {r["target"]: (r["matched"], r["distorted"], r["no_match"], r["check"]) for r in logs.match_summary(rows).collect()}
    assert found == {"ABC": (3, 1, 1, "OK"), "DEF": (1, 0, 0, "MISMATCH")}


def test_sdf_and_population_files(spark, tmp_path):
    record = lambda n, tags: f"name\n prog\n\n{n:3d}  1  0\nM  END\n{tags}$$$$\n"
    (tmp_path / "sdf").mkdir()
    (tmp_path / "sdf" / "1_ABC_cae0_matches.sdf").write_text(record(2, "") + record(2, "> <Similarity>\n0.91\n\n> <DistortedMatch>\nTrue\n\n"))
    (tmp_path / "sdf" / "2_ABC_cae1_matches.sdf").write_text(record(2, ""))
    found = logs.sdf_report(logs.sdf_files(files.sdf_records(spark, f"{tmp_path}/sdf")), F.regexp_extract("path", r"\d+_(\w+?)_cae", 1)).first()
    assert found.asDict() == {"target": "ABC", "missing": 1, "distorted": 1, "matched": 0, "biatomic_missing": 1, "biatomic_distorted": 1, "files": 2}
    rows = spark.createDataFrame([("b", "CC", 0.25), ("a", "C", 0.5)], "entry_id string, smiles string, similarity double")
    files.write_population(rows, f"{tmp_path}/pop")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/pop").collect()] == ["a C 0.5000", "b CC 0.2500"]
    assert sorted(r[0] for r in files.population_ids(spark, f"{tmp_path}/pop").collect()) == ["a", "b"]


def test_sections_and_runs(spark, tmp_path):
    (tmp_path / "s.txt").write_text("METALS\nFe: 3\nCu: 1\nGEOMETRIES\nplanar: 2\n")
    found = {tuple(r) for r in logs.sections(files.lines(spark, f"{tmp_path}/s.txt")).collect()}
    assert found == {("METALS", "Fe", 3), ("METALS", "Cu", 1), ("GEOMETRIES", "planar", 2)}
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run / "x").mkdir(parents=True)
        (tmp_path / "runs" / run / "x" / "results.csv").write_text("task,3DOpt_Score\n1_A,0.5\n")
    rows = files.run_results(spark, f"{tmp_path}/runs", schema="task string, score double")
    assert sorted((r["run"], r["score"]) for r in rows.collect()) == [("r1", 0.5), ("r2", 0.5)]


def test_rings_and_chains(spark):
    atoms = spark.createDataFrame([("m", i, s, s == "Fe", s != "Fe", True) for i, s in enumerate(["Fe", "C", "C", "O"])], "entry string, ord int, symbol string, metal boolean, nonmetal boolean, cyclic boolean")
    bonds = spark.createDataFrame([("m", 0, 1, "pi"), ("m", 0, 2, "pi"), ("m", 1, 2, "aromatic"), ("m", 2, 3, "double")], "entry string, a int, b int, bond string")
    row = patterns.found(atoms, bonds, patterns.library()).first().asDict()
    links = patterns.edges(atoms, bonds)
    for name, paths in patterns.library().items():  # the joins list the matches that the search only tells of
        assert row[name] == any(patterns.matches(atoms, links, p).count() > 0 for p in paths if len(p.steps) < 4), name
    hit = {n: int(row[n]) for n in ("cyclic_multihapto_ligands", "dative_bonds", "linear_ligands", "aromatic_rings", "saturated_rings", "allenes", "chelating_ligands")}
    assert hit == {"cyclic_multihapto_ligands": 1, "dative_bonds": 1, "linear_ligands": 0, "aromatic_rings": 1, "saturated_rings": 0, "allenes": 0, "chelating_ligands": 1}
    assert len(patterns.library()) == 20


def test_band_and_histogram(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(20)], "k int, v double")
    assert sorted(r["k"] for r in stats.band(rows, "v", "k", 7.2, 2).collect()) == [5, 6, 7, 8, 9]
    assert sum(r["n"] for r in stats.histogram(rows, "v", 4).collect()) == 20


def test_marked(spark):
    rows, ids = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,)], "k int")
    assert sorted(tuple(r) for r in sets.marked(rows, ids, "k", "hit").collect()) == [(1, False), (2, True)]


def test_stream_upserts(spark, tmp_path):
    schema = "k int, fp string, s string, t int"
    for i, rows in enumerate(([(1, "a", "x", 0)], [(1, None, "y", 1), (2, None, "z", 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.keep_table(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck", ["k"], ["fp"], "t").awaitTermination()
        assert ingest.latest(spark, f"{tmp_path}/out").count() == i + 1
    assert {tuple(r)[:3] for r in ingest.latest(spark, f"{tmp_path}/out").collect()} == {(1, "a", "y"), (2, None, "z")}


def test_fingerprints_keep_under_turns(spark):
    """Shifted and turned points have the same fingerprint, other points another; charges add a dimension."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(9, 4))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    moved = points.copy()
    moved[:, :3] = points[:, :3] @ turn + 5
    one, two = vectors.shape(points), vectors.shape(moved)
    assert len(one) == 15 and one == pytest.approx(two, abs=1e-8) and one != pytest.approx(vectors.shape(points * 1.5), abs=1e-3)
    rows = vectors.fingerprinted(spark.createDataFrame([(1, points.tolist()), (2, moved.tolist()), (3, [])], "i int, p array<array<double>>"), {"p": "fp"})
    a, b, c = rows.orderBy("i").collect()
    assert a["fp"] == pytest.approx(one) and b["fp"] == pytest.approx(one, abs=1e-8) and c["fp"] is None


def test_environment_table_from_atoms_to_files(spark, tmp_path):
    """Atoms and bonds to the stored table: fingerprints, the columns of the schema, older values kept, blocks pruned."""
    atoms = spark.createDataFrame([(e, i, s, float(i), float(i * i), 0.5 * i, n, 0.0, f"sdf{e}{i}") for e in ("m1", "m2") for i, (s, n) in enumerate([("Fe", 26), ("C", 6), ("O", 8)])], "entry string, ord int, symbol string, x double, y double, z double, number int, charge double, sdf string")
    bonds = spark.createDataFrame([(e, 0, k, "single") for e in ("m1", "m2") for k in (1, 2)], "entry string, a int, b int, bond string")
    made = molecules.environment_table(atoms, bonds)
    assert made.schema.simpleString() == StructType.fromDDL(schemas.CAES).simpleString()
    rows = {(r["entry_id"], r["cae_idx"]): r for r in made.collect()}
    assert len(rows) == 6 and rows["m1", 0]["formula_str"] == "C1Fe1O1" and rows["m1", 0]["n_atoms"] == 3 and rows["m1", 0]["sdf"] == "sdfm10"
    assert len(rows["m1", 0]["fp_p"]) == 15 and len(rows["m1", 0]["fp_pq"]) == 18 and rows["m1", 0]["fp_p"] == pytest.approx(rows["m2", 0]["fp_p"])
    old = spark.createDataFrame([("m1", 0, [1.0])], "entry_id string, cae_idx int, fp_p array<double>")
    again = {(r["entry_id"], r["cae_idx"]): r for r in molecules.environment_table(atoms, bonds, old).collect()}
    assert again["m1", 0]["fp_p"] == [1.0] and len(again["m1", 0]["fp_pq"]) == 18 and len(again) == 6
    files.write_environments(made, f"{tmp_path}/caes")
    back = files.read_environments(spark, f"{tmp_path}/caes")
    assert sorted(map(str, back.select(made.columns).collect())) == sorted(map(str, made.collect()))
    plan = back.where("central_atom = 'Fe' AND n_atoms = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(central_atom" in plan and "GreaterThan" not in plan and "EqualTo(n_atoms,3)" in plan


def test_a_run_with_its_sdf_files(spark, tmp_path):
    """Targets against a population: classes, counters by owner, and one SDF folder a target with tags, read back."""
    t = spark.createDataFrame([(1, "a", [0.0], "T1"), (2, "b", [0.0], "T2"), (3, "c", [0.0], "T2")], "id int, block string, fp array<double>, owner string")
    p = spark.createDataFrame([(11, "a", [0.0], "name\n p\n\n  2  1\nM  END"), (12, "b", [1.0], "name\n p\n\n  3  1\nM  END")], "id int, block string, fp array<double>, sdf string")
    best = match.with_payload(match.best_match(t, p, ["block"], 0.98), p, ["sdf"]).join(t.select(F.col("id").alias("target"), "owner"), "target")
    assert {r["owner"]: (r["matched"], r["distorted"], r["no_match"], r["total"]) for r in results.class_counts(best, "owner").collect()} == {"T1": (1, 0, 0, 1), "T2": (0, 1, 1, 2)}
    tagged = best.where("partner IS NOT NULL").withColumn("distorted", F.initcap((F.col("class") == "distorted").cast("string")))
    files.write_sdf(tagged, f"{tmp_path}/out", "sdf", {"Similarity": "score", "DistortedMatch": "distorted"}, "target", "partner")
    found = {r["path"].split("target=")[1][0]: r for r in logs.sdf_files(files.sdf_records(spark, f"{tmp_path}/out/*")).collect()}
    assert (found["1"]["similarities"], found["1"]["n_atoms"], found["1"]["first_flag"]) == ([1.0], 2, "False") and (found["2"]["similarities"], found["2"]["first_flag"]) == ([0.5], "True")


def test_shapes_together_are_shapes_alone(spark):
    rng = np.random.default_rng(8)
    sets = [rng.normal(size=(n, d)).tolist() for n, d in [(3, 4), (1, 4), (5, 5), (3, 4), (2, 4), (5, 4), (7, 5)] * 6] + [None, []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "i int, p array<array<double>>").repartition(3)
    for r in vectors.fingerprinted(rows, {"p": "fp"}).collect():
        assert r["fp"] == (pytest.approx(vectors.shape(np.array(sets[r["i"]])), abs=1e-9) if sets[r["i"]] else None)


def test_more_files(spark, tmp_path):
    """Readers and writers of CSV, targets, tasks, scores, generator runs, listings, structures, fragments and metrics."""
    viable = spark.createDataFrame([("A", True, 3, "Complete", False, False, "C"), ("A", True, 3, "Complete", False, False, "C"), (None, True, 3, "None", False, False, None)], schemas.VIABLE)
    files.write_csv(viable, f"{tmp_path}/v")
    assert [r[0] for r in files.viable_ids(spark, f"{tmp_path}/v").collect()] == ["A"]
    files.write_csv(viable.select("Identifier", "N_Atoms"), f"{tmp_path}/tsv", "\t")
    assert files.fragments(spark, f"{tmp_path}/tsv", "x string").count() == 3
    targets = spark.createDataFrame([("T", "CC", [0.5, 1.0])], "entry_id string, smiles string, fp array<double>")
    files.write_targets(targets, f"{tmp_path}/t")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/t").collect()] == ["T CC [0.5,1.0]"]
    configs = results.task_configs(spark.createDataFrame([(1, "ABC")], "index int, target string"), "demo")
    files.write_tasks(configs.drop("file"), f"{tmp_path}/tasks")
    read = files.tasks(spark, f"{tmp_path}/tasks").first()
    assert read["task"] == "1_ABC" and read["scoring_functions"][0]["parameters"]["n_jobs"] == 8 and read["starting_population"][1] == "1_ABC_init_pop.txt" and read["scoring"]["metrics"][0]["weight"] == 1.0
    (tmp_path / "s.csv").write_text("a,X_HSR_score\n1,0.5\n2,N.A.\n")
    assert [tuple(r) for r in files.scores(spark, f"{tmp_path}/s.csv").collect()] == [(0.5, "X"), (None, "X")]
    assert files.scores(spark, f"{tmp_path}/tsv").count() == 0 and files.has_columns(viable, "SMILES") and not files.has_columns(viable, "no")
    (tmp_path / "scores_and_times_7.csv").write_text(",".join(c.split()[0] for c in schemas.GENERATOR_RUN.split(", ")) + "\nT,0.5,1,x,N.A.,2,y,0.1,3,z\n")
    r = files.generator_runs(spark, f"{tmp_path}/scores_and_times_7.csv").first()
    assert (r["Target"], r["rdkit_sim"], r["run"]) == ("T", "N.A.", "7") or r["run"].endswith("7")
    for name in ("x/AAA.cif", "x/y/BBB.cif", "x/z.txt"):
        (tmp_path / "cif" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "cif" / name).write_text(f"data_{name}")
    assert {r["name"]: r["text"] for r in files.structure_texts(spark, f"{tmp_path}/cif").collect()} == {"AAA": "data_x/AAA.cif", "BBB": "data_x/y/BBB.cif"}
    listed = files.listing(spark, f"{tmp_path}/cif", "*.cif")
    assert [r["name"] for r in files.stale(listed, spark.createDataFrame([("AAA",)], "name string"), "name").collect()] == ["BBB"]
    for run, depth in (("r1", "x"), ("r2", "x/y/z")):
        (tmp_path / "deep" / run / depth).mkdir(parents=True)
        (tmp_path / "deep" / run / depth / "results.csv").write_text("task,s\n1_A,0.5\n")
    found = files.results_below(spark, f"{tmp_path}/deep", schema="task string, s double").collect()
    assert len(found) == 2 and {r["run"] for r in found} == {"r1", "y"}
    for n in (1, 2):
        files.append_metrics(results.metrics(spark, seconds=n, rows=10), f"{tmp_path}/metrics")
    assert spark.read.parquet(f"{tmp_path}/metrics").count() == 4
    assert files.entries(spark, f"{tmp_path}/metrics", 3).count() == 3 and files.registered(viable, "v_test") is viable and spark.sql("SELECT count(*) FROM v_test").first()[0] == 3


def test_greedy_unique_of_many_rows(spark):
    """The same as one row after another, for more rows than are kept at once at first."""
    rng = np.random.default_rng(2)
    rows = [(i, 0, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))]
    kept: list[np.ndarray] = []
    want = []
    for i, _, v in rows:
        if all(1 / (1 + np.abs(k - v).mean()) < 0.62 for k in kept):
            kept.append(np.array(v))
            want.append(i)
    found = match.unique(spark.createDataFrame(rows, "id int, b int, fp array<double>"), ["b"], "id", 0.62)
    assert sorted(r["id"] for r in found.collect()) == want and len(want) > 64


def test_targets_in_chunks(spark, monkeypatch):
    """Many targets meet every entry in parts, with the same result and no Cartesian product."""
    rows = spark.createDataFrame([(i, [float(i % 7)]) for i in range(40)], "id int, fp array<double>")
    whole = sorted(map(tuple, match.below(rows, rows, 0.5).collect()))
    monkeypatch.setattr(match, "BROADCAST_ROWS", 8)
    parts = match.below(rows, rows, 0.5)
    assert sorted(map(tuple, parts.collect())) == whole and "CartesianProduct" not in parts._jdf.queryExecution().executedPlan().toString()


def test_first_seen_over_many_keys(spark):
    rows = spark.createDataFrame([(f"k{i % 300}", i) for i in range(2000)], "k string, line long")
    assert {r["k"]: r["order"] for r in results.first_seen(rows, "k", "line").collect()} == {f"k{i}": i + 1 for i in range(300)}


def test_windowed_counts(spark):
    rows = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "a", 1.0) for i in range(6)], "id int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["n"], r["v"]) for r in ingest.windowed_counts(rows).collect()) == [(2, 2.0)] * 3


def test_facts_of_numeric_columns(spark):
    """Texts, flags and arrays are no numbers; NULLs and NaNs count for nothing; a table without numbers gives no row."""
    rows = spark.createDataFrame([(1, "x", float("nan"), True, [1], None), (None, "y", 2.5, None, None, None), (-4, None, -1.0, False, [], None)], "`a b` int, t string, d double, f boolean, l array<int>, e bigint")
    assert {tuple(r) for r in stats.numeric_facts(rows).collect()} == {("a b", 2, -4.0, 1.0), ("d", 2, -1.0, 2.5), ("e", 0, None, None)}
    assert {tuple(r) for r in stats.numeric_facts(rows.limit(0)).collect()} == {("a b", 0, None, None), ("d", 0, None, None), ("e", 0, None, None)}
    assert stats.numeric_facts(rows.select("t", "f")).count() == 0


def test_environments_equal_a_plain_account(spark):
    """Neighbours by bond ends, with bonds to itself, twice over, to atoms that aren't there, entries without bonds, and a long chain."""
    rng = random.Random(4)
    atoms = [(e, i, rng.choice("CHNO")) for e in range(5) for i in range(0, 24, 1 + e % 2)] + [(7, i, "C") for i in range(3000)] + [(8, 1, "H")]
    bonds = [(e, rng.randrange(26), rng.randrange(26), rng.choice("sd")) for e in range(5) for _ in range(30)] + [(7, i, i + 1, "s") for i in range(2999)] + [(9, 1, 2, "s"), (0, 3, 3, "s"), (0, 1, 2, "s"), (0, 1, 2, "s")]
    found = molecules.environments(spark.createDataFrame(atoms, "entry int, ord int, symbol string"), spark.createDataFrame(bonds, "entry int, a int, b int, bond string")).collect()
    symbols = {(e, i): s for e, i, s in atoms}
    want = {key: [] for key in symbols}
    for e, a, b, kind in bonds:
        for at, other in ((a, b), (b, a)):
            if (e, at) in symbols and (e, other) in symbols:
                want[e, at].append((other, symbols[e, other], kind))
    assert len(found) == len(want)
    for r in found:
        near = sorted(want[r["entry"], r["cae_idx"]])
        assert [tuple(x) for x in r["neighbours"]] == near and r["n_atoms"] == len(near) + 1 and r["central_atom"] == symbols[r["entry"], r["cae_idx"]]
        kinds = Counter([s for _, s, _ in near] + [r["central_atom"]])
        assert r["formula_str"] == "".join(f"{s}{n}" for s, n in sorted(kinds.items()))


def test_top_matches_keep_k_before_they_move(spark):
    """Of a hot target a task sends on its k best only."""
    rows = spark.range(200).select("id", F.lit("b").alias("g"), F.array((F.col("id") % 17).cast("double"), F.lit(1.0)).alias("fp")).repartition(4)
    found = match.top_matches(rows.limit(2), rows, ["g"], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and found.count() == 6
