"""From structure texts to atoms, bonds, components and their facts: SMILES and CIF readers, components, ring atoms, the table of structures.

Molecules are small: what is done within one stays within a row, and rows are dealt as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from weft.functions import chemistry, texts
from weft.operators import molecules

GRAPH = "atoms array<struct<ord:int,symbol:string,aromatic:boolean,charge:int,hydrogens:int>>, bonds array<struct<a:int,b:int,bond:string>>, error string"
STRUCTURE = (
    "name string, cell struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>, "
    "atoms array<struct<label:string,symbol:string,u:double,v:double,w:double,occupancy:double,disorder:string>>, bonds array<struct<one:string,two:string,symmetry:string,bond:string>>"
)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def smiles_graphs(rows: DataFrame, text: str = "smiles") -> DataFrame:
    """rows with the atoms and bonds of a SMILES column; where it isn't one, both are NULL and ``error`` says why and where.

    A NULL text has neither atoms nor an error.
    """
    made = _arrow(GRAPH)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(text).to_pylist():
                try:
                    atoms, bonds = (None, None) if x is None else chemistry.smiles_graph(x)
                    out.append((atoms, bonds, None))
                except ValueError as e:
                    out.append((None, None, str(e)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, made, strict=True)]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *made.names])

    return rows.mapInArrow(read, StructType([*rows.schema, *StructType.fromDDL(GRAPH)]))


def cif_structures(files: DataFrame) -> DataFrame:
    """path and the structures in it, a row a block that has atoms, from whole files (path, text)."""
    made = _arrow(STRUCTURE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text"), strict=True):
                found = [chemistry.cif_structure(b) for b in chemistry.cif_blocks(text.as_py() or "")]
                found = [x for x in found if x["atoms"]]
                columns = [pa.array([x[f.name] for x in found], f.type) for f in made]
                yield pa.record_batch([pa.array([path] * len(found), pa.string()), *columns], ["path", *made.names])

    return files.select("path", "text").mapInArrow(read, f"path string, {STRUCTURE}")


def placed(structures: DataFrame) -> DataFrame:
    """Structures as entries: atoms (ord, label, symbol, number, x, y, z, n_bonds) with Cartesian places, bonds (a, b, bond), and
    whether all is there: is_3d, disorder (a group, or a place taken in part) and polymeric (a bond that leaves the
    asymmetric unit for an image of it)."""
    cos = {k: F.cos(F.radians(F.col(f"cell.{k}"))) for k in ("alpha", "beta", "gamma")}
    sin = F.sin(F.radians(F.col("cell.gamma")))
    skew = (cos["alpha"] - cos["beta"] * cos["gamma"]) / sin
    height = F.sqrt(F.greatest(1 - cos["beta"] * cos["beta"] - skew * skew, F.lit(0.0)))
    x = lambda a: F.col("cell.a") * a["u"] + F.col("cell.b") * cos["gamma"] * a["v"] + F.col("cell.c") * cos["beta"] * a["w"]
    y = lambda a: F.col("cell.b") * sin * a["v"] + F.col("cell.c") * skew * a["w"]
    numbers = F.array(*map(F.lit, chemistry.ELEMENTS))
    labels = F.transform("atoms", lambda a: a["label"])
    at = lambda label: F.array_position(labels, label).cast("int") - 1
    inside = F.filter("bonds", lambda b: b["symmetry"].isNull() & F.array_contains(labels, b["one"]) & F.array_contains(labels, b["two"]))
    bonds = F.transform(inside, lambda b: F.struct(at(b["one"]).alias("a"), at(b["two"]).alias("b"), F.coalesce(b["bond"], F.lit("single")).alias("bond")))
    with_bonds = structures.withColumn("_ties", bonds)
    n_bonds = lambda i: F.size(F.filter("_ties", lambda b: (b["a"] == i) | (b["b"] == i)))
    atoms = F.transform("atoms", lambda a, i: F.struct(
        i.alias("ord"), a["label"].alias("label"), a["symbol"].alias("symbol"), F.nullif(F.array_position(numbers, a["symbol"]).cast("int"), F.lit(0)).alias("number"),
        x(a).alias("x"), y(a).alias("y"), (F.col("cell.c") * height * a["w"]).alias("z"), n_bonds(i).alias("n_bonds"),
    ))
    disorder = F.exists("atoms", lambda a: F.coalesce((a["occupancy"] < 1) | a["disorder"].isNotNull(), a["disorder"].isNotNull()))
    polymeric = F.exists("bonds", lambda b: b["symmetry"].isNotNull())
    there = with_bonds.select("path", F.col("name").alias("entry"), atoms.alias("placed"), F.col("_ties").alias("bonds"), disorder.alias("disorder"), polymeric.alias("polymeric"))
    is_3d = F.forall("atoms", lambda a: a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull())
    return there.withColumnRenamed("placed", "atoms").withColumn("is_3d", is_3d)


def component_labels(ords: Column, bonds: Column) -> Column:
    """For each atom the place of the first atom of its component, by a fold over the bonds that joins the labels of their ends."""
    at = lambda end: F.array_position(ords, end).cast("int") - 1
    ties = F.filter(F.transform(bonds, lambda b: F.struct(at(b["a"]).alias("a"), at(b["b"]).alias("b"))), lambda b: (b["a"] >= 0) & (b["b"] >= 0))

    def joined(labels: Column, bond: Column) -> Column:
        a, b = F.get(labels, bond["a"]), F.get(labels, bond["b"])
        return F.when(a == b, labels).otherwise(F.transform(labels, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x)))

    first = F.transform(ords, lambda _, i: i)
    return F.aggregate(ties, first, joined)


def components(entries: DataFrame) -> DataFrame:
    """One row a component of entries (entry, atoms with ord and symbol, bonds): entry, ord (from 1, by first atom), its atoms and bonds.

    Bonds to atoms that aren't there join nothing; an entry without atoms has no component.
    """
    labelled = entries.select("entry", "atoms", "bonds", component_labels(F.transform("atoms", lambda a: a["ord"]), F.col("bonds")).alias("_labels"))
    roots = F.array_sort(F.array_distinct("_labels"))
    each = labelled.select("entry", "atoms", "bonds", "_labels", F.posexplode(roots).alias("_n", "_root"))
    own = F.filter("atoms", lambda a, i: F.get(F.col("_labels"), i) == F.col("_root"))
    members = each.select("entry", (F.col("_n") + 1).alias("ord"), own.alias("atoms"), "bonds")
    ords = F.transform("atoms", lambda a: a["ord"])
    return members.withColumn("bonds", F.filter("bonds", lambda b: F.array_contains(ords, b["a"]) & F.array_contains(ords, b["b"])))


def metal(symbol: Column) -> Column:
    return symbol.isin(*chemistry.METALS)


def organometallic(atoms: Column, bonds: Column) -> Column:
    """Some bond joins a metal and carbon."""
    of = lambda end: F.element_at(F.filter(atoms, lambda a: a["ord"] == end), 1)["symbol"]
    joins = lambda one, two: metal(one) & (two == "C")
    return F.exists(bonds, lambda b: F.coalesce(joins(of(b["a"]), of(b["b"])) | joins(of(b["b"]), of(b["a"])), F.lit(False)))


def component_facts(entries: DataFrame) -> DataFrame:
    """The components of entries with what they are chosen by: weight, n_atoms, organometallic."""
    found = components(entries)
    symbols = found.select("entry", "ord", F.transform("atoms", lambda a: a["symbol"]).alias("symbols"), organometallic(F.col("atoms"), F.col("bonds")).alias("organometallic"))
    facts = molecules.component_facts(symbols)
    return symbols.join(facts, ["entry", "ord"]).select("entry", "ord", "symbols", "organometallic", F.round("weight", 6).alias("weight"), "n_atoms")


def components_of_interest(entries: DataFrame, least_size: int = 5) -> DataFrame:
    """entry and component (its number) for each entry in which one component is two of: organometallic, the heaviest, the largest."""
    facts = molecules.heaviest(molecules.heaviest(component_facts(entries), "weight"), "n_atoms")
    return molecules.component_of_interest(facts, [F.col("organometallic"), F.col("top_weight"), F.col("top_n_atoms")], F.col("n_atoms"), least_size=least_size)


def with_rings(entries: DataFrame) -> DataFrame:
    """entries with ``cyclic``, an array: for each atom whether it lies on a ring, that is on a bond without which its ends were still joined."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for atoms, bonds in zip(batch.column("atoms").to_pylist(), batch.column("bonds").to_pylist(), strict=True):
                at = {a["ord"]: i for i, a in enumerate(atoms or ())}
                ties = {tuple(sorted((at[b["a"]], at[b["b"]]))) for b in bonds or () if b["a"] in at and b["b"] in at}
                out.append(chemistry.ring_atoms(len(at), sorted(ties)))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.bool_()))], [*batch.schema.names, "cyclic"])

    return entries.mapInArrow(mark, StructType([*entries.schema, StructField("cyclic", ArrayType(BooleanType()))]))


def perceived(atoms: DataFrame, bonds: DataFrame, *facts: str) -> DataFrame:
    """The atoms (entry, ord, symbol and the facts) with ``cyclic`` found from the bonds, for ``patterns.found``."""
    names = ["entry", "ord", "symbol", *facts]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in molecules.turns(batches):
            held = molecules.Graphs(rows)
            yield pa.record_batch([*(held.atoms.column(c).combine_chunks() for c in names), pa.array(held.cyclic())], [*names, "cyclic"])

    dealt = molecules.dealt_graphs(atoms, bonds, *facts)
    return dealt.mapInArrow(mark, StructType([*(dealt.schema[c] for c in names), StructField("cyclic", BooleanType())]))


def structure_table(entries: DataFrame) -> DataFrame:
    """The table of structures with metals, in thirteen columns, of entries by ``placed`` that have places and metals and are neither polymeric nor disordered."""
    symbols = F.transform("atoms", lambda a: a["symbol"])
    held = entries.withColumn("metals", F.filter(symbols, lambda s: metal(s)))
    good = molecules.mineral_filter(held)
    counted = lambda x: texts.counted_text(F.map_from_entries(F.transform(F.array_sort(F.array_distinct(x)), lambda e: F.struct(e, F.size(F.filter(x, lambda s: s == e))))))
    parts = components(good.withColumn("entry", F.struct("path", "entry"))).withColumn("metals", F.filter(F.transform("atoms", lambda a: a["symbol"]), lambda s: metal(s)))
    of = parts.groupBy("entry").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.size("metals") > 0, F.struct("ord", F.concat(F.col("ord").cast("string"), F.lit(": "), counted(F.col("metals"))).alias("text"))))).alias("with_metals"),
        F.bool_or(F.size("metals") > 1).alias("polymetallic"),
    )
    has_metal_bond = F.exists("bonds", lambda b: metal(F.get(F.col("atoms"), b["a"])["symbol"]) | metal(F.get(F.col("atoms"), b["b"])["symbol"]))
    facts = good.select(
        F.struct("path", "entry").alias("entry"), counted(F.col("metals")).alias("Metals"), organometallic(F.col("atoms"), F.col("bonds")).alias("Organometallic"),
        molecules.hydrogens_placed(F.col("atoms")).alias("Explicit Hs"), F.exists("bonds", lambda b: b["bond"] == "pi").alias("Hapticity"), F.size("atoms").alias("N_Atoms"),
        molecules.connectivity(F.col("bonds"), F.col("atoms")).alias("Connectivity"), has_metal_bond.alias("Metal_Bonds"), molecules.overlapping(F.col("atoms")).alias("Overlapping Atoms"),
    )
    rows = facts.join(of, "entry")
    return rows.select(
        F.col("entry.path").alias("File Name"), "Metals", F.col("n").cast("int").alias("Component Count"), F.array_join(F.transform("with_metals", lambda x: x["text"]), "; ").alias("Components With Metals"),
        (F.col("n") > 1).alias("Polymolecular"), F.col("polymetallic").alias("Polymetallic"), "Organometallic", "Explicit Hs", "Hapticity", "N_Atoms", "Connectivity", "Metal_Bonds", "Overlapping Atoms",
    )
