"""Entries, components, atoms and bonds: filters, the component of interest, atom environments, upserts."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weft import schemas
from weft.functions import chemistry, vectors


def connectivity(bonds: Column, atoms: Column) -> Column:
    """None without bonds, Partial if some atom has none, else Complete."""
    return F.when(F.size(bonds) == 0, "None").when(F.exists(atoms, lambda a: a["n_bonds"] == 0), "Partial").otherwise("Complete")


def hydrogens_placed(atoms: Column) -> Column:
    """All hydrogens have coordinates; true without hydrogens."""
    return F.forall(F.filter(atoms, lambda a: a["number"] == 1), lambda a: a["x"].isNotNull())


def overlapping(atoms: Column, least: float = 0.4) -> Column:
    """Two atoms of an entry nearer than ``least``; atoms without coordinates are near nothing."""
    gap = lambda a, b: F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in "xyz"), F.lit(0.0)))
    return F.exists(atoms, lambda a: F.exists(atoms, lambda b: F.coalesce((a["ord"] < b["ord"]) & (gap(a, b) < least), F.lit(False))))


def viable(entries: DataFrame) -> DataFrame:
    """The six rules, cheap ones first; the pairwise test reads what the others leave."""
    cheap = entries.where(F.col("is_3d") & ~F.col("polymeric") & hydrogens_placed(F.col("atoms")) & F.col("component").isNotNull() & F.col("smiles").isNotNull())
    return cheap.where(~overlapping(F.col("atoms")))


def component_of_interest(components: DataFrame, votes: Sequence[Column], size: Column, entry: str = "entry", order: str = "ord", least_votes: int = 2, least_size: int = 5) -> DataFrame:
    """The first component by order with enough votes and atoms, a row for each entry that has one."""
    cast = sum((v.cast("int") for v in votes), F.lit(0))
    good = components.where((cast >= least_votes) & (size >= least_size))
    return good.groupBy(entry).agg(F.min(order).alias("component"))


def heaviest(components: DataFrame, measure: str, entry: str = "entry", order: str = "ord") -> DataFrame:
    """Adds whether a component is the first of its entry with the greatest measure."""
    top = W.partitionBy(entry).orderBy(F.desc(measure), order)
    return components.withColumn(f"top_{measure}", F.row_number().over(top) == 1)


def graphs(atoms: DataFrame, bonds: DataFrame, *facts: str) -> DataFrame:
    """One row an entry: its atoms (ord, symbol and the facts) and its bonds (a, b, bond) as arrays; a molecule is small."""
    held = atoms.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("ord", "symbol", *facts))).alias("atoms"))
    tied = bonds.groupBy("entry").agg(F.collect_list(F.struct("a", "b", "bond")).alias("bonds"))
    return held.join(tied, "entry", "left").withColumn("bonds", F.coalesce("bonds", F.array()))


def in_turn(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with ``_n``, their number in the order among those of the same keys, which follow each other in one task: for ``turns``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables in which the rows of a key of ``in_turn`` are whole: each batch, less the last key's rows, which go with the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("_n").to_numpy() == 1)
        cut = int(starts[-1]) if len(starts) else batch.num_rows
        held.append(batch.slice(0, cut))
        if len(starts):
            whole = pa.Table.from_batches(held)
            if whole.num_rows:
                yield whole
            held = [batch.slice(cut)]
    if any(batch.num_rows for batch in held):
        yield pa.Table.from_batches(held)


def dealt_graphs(atoms: DataFrame, bonds: DataFrame, *facts: str) -> DataFrame:
    """Atoms (entry, ord, symbol and the facts) and bonds as rows of entries ``in_turn``: an entry's atoms by ord, then its bonds (ord and other are its ends)."""
    kind = atoms.schema["ord"].dataType
    held = atoms.select("entry", F.lit(False).alias("tie"), "ord", F.lit(None).cast(kind).alias("other"), F.lit(None).cast("string").alias("bond"), "symbol", *facts)
    tied = bonds.where("entry IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").select("entry", F.lit(True).alias("tie"), F.col("a").cast(kind).alias("ord"), F.col("b").cast(kind).alias("other"), "bond")
    return in_turn(held.unionByName(tied, allowMissingColumns=True), ["entry"], ["tie", "ord"])


class Graphs:
    """Whole entries of ``dealt_graphs``: the rows of atoms, each atom's graph, and the bonds between atoms that are there, by their places."""

    def __init__(self, rows: pa.Table):
        tie = rows.column("tie").to_numpy()
        graph = np.cumsum(rows.column("_n").to_numpy() == 1) - 1
        self.atoms = rows.filter(pa.array(~tie))
        self.graph = graph[~tie]
        ords = self.atoms.column("ord")
        known = ords.is_valid().to_numpy()
        a, b = (rows.column(c).filter(pa.array(tie)).to_numpy() for c in ("ord", "other"))
        every = np.unique(np.concatenate((ords.drop_null().to_numpy(), a, b)))
        code = lambda graph, x: graph * len(every) + np.searchsorted(every, x)
        keys, places = code(self.graph[known], ords.drop_null().to_numpy()), np.flatnonzero(known)
        a, b = (code(graph[tie], x) for x in (a, b))
        i, j = (np.searchsorted(keys, x, "right") - 1 for x in (a, b))
        there = (i >= 0) & (j >= 0)
        there[there] = (keys[i[there]] == a[there]) & (keys[j[there]] == b[there])
        self.a, self.b = places[i[there]], places[j[there]]
        self.bonds = rows.column("bond").filter(pa.array(tie)).combine_chunks().filter(pa.array(there))

    def cyclic(self) -> np.ndarray:
        return chemistry.ring_atoms_of_many(self.graph, self.a, self.b)


def environments(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """One row an atom: itself, its neighbours and its bonds; formula and number of atoms.

    atoms (entry, ord, symbol), bonds (entry, a, b, bond). The ends of bonds go to their atoms, first to the one whose symbol
    they need, then to the one whose neighbour it is: work follows the bonds, however many atoms an entry has.
    """
    none = F.lit(None)
    kinds = dict(bonds.dtypes)
    own = atoms.select("entry", F.col("ord").alias("other"), F.col("ord").alias("at"), none.cast(kinds["bond"]).alias("bond"), "symbol", F.lit(True).alias("own"))
    end = lambda at, other: F.struct(F.col(at).alias("at"), F.col(other).alias("other"))
    ends = bonds.select("entry", "bond", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("entry", "x.other", "x.at", "bond", none.cast("string").alias("symbol"), F.lit(False).alias("own"))
    there = W.partitionBy("entry", "other")
    known = own.unionByName(ends).withColumns({"near": F.max(F.when(F.col("own"), F.col("symbol"))).over(there), "known": F.max("own").over(there)}).where("known")
    near = F.when(~F.col("own"), F.struct("other", "near", "bond"))
    rows = known.groupBy("entry", F.col("at").alias("ord")).agg(F.max("own").alias("own"), F.max("symbol").alias("symbol"), F.array_sort(F.collect_list(near)).alias("neighbours")).where("own")
    symbols = F.array_append(F.transform("neighbours", lambda n: n["near"]), F.col("symbol"))
    return rows.select("entry", F.col("ord").alias("cae_idx"), F.col("symbol").alias("central_atom"), (F.size("neighbours") + 1).alias("n_atoms"), signature(symbols).alias("formula_str"), "neighbours")


def environment_table(atoms: DataFrame, bonds: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The table of atom environments in the columns of ``schemas.CAES``, built in one job and merged with an older one.

    atoms (entry, ord, symbol, x, y, z, number, charge, sdf). A fingerprint is of the atom and its neighbours; those that
    an older table holds are kept. The ends of bonds go to the atom whose facts they need, with these to the one whose
    neighbour it is, and a task works out its atoms' environments together.
    """
    facts = atoms.select("entry", F.col("ord").alias("other"), "symbol", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z")), F.sqrt("number").alias("q"), F.col("charge").cast("double").alias("charge"), "sdf")
    own = facts.where("entry IS NOT NULL AND other IS NOT NULL").withColumns({"at": F.col("other"), "own": F.lit(True)})
    end = lambda at, other: F.struct(F.col(at).alias("at"), F.col(other).alias("other"))
    ends = bonds.select("entry", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("entry", "x.at", "x.other").where("at IS NOT NULL")
    known = ends.join(facts.drop("sdf"), ["entry", "other"]).withColumns({"own": F.lit(False), "sdf": F.lit(None).cast("string")})
    dealt = in_turn(own.unionByName(known), ["entry", "at"], ["other", "own"])
    entry, at = dealt.schema["entry"], dealt.schema["at"]
    schema = StructType([StructField("entry_id", entry.dataType), StructField("cae_idx", at.dataType), *StructType.fromDDL("central_atom string, n_atoms int, formula_str string, sdf string, fp_p array<double>, fp_pq array<double>")])
    made = dealt.mapInArrow(_environments, schema)
    whole = conformed(made, schemas.CAES)
    return whole if old is None else upsert(conformed(old, schemas.CAES), whole, ["entry_id", "cae_idx"], ["fp_p", "fp_pq"])


def _environments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The environments of atoms of which each has its own row and those of its neighbours."""
    for rows in turns(batches):
        starts = np.flatnonzero(rows.column("_n").to_numpy() == 1)
        sizes = np.diff(np.append(starts, rows.num_rows))
        own = rows.column("own").to_numpy()
        at = np.repeat(np.arange(len(starts)), sizes)
        centre = np.full(len(starts), -1)
        centre[at[own]] = np.flatnonzero(own)
        there = centre >= 0  # ends at atoms that aren't there are no environment
        placed = functools.reduce(np.logical_and, (rows.column(c).is_valid().to_numpy() for c in "xyz")) & there[at]
        points = np.stack([rows.column(c).to_numpy()[placed] for c in ("x", "y", "z", "q", "charge")], axis=1)
        n = np.bincount(at[placed], minlength=len(starts))[there]
        kept = rows.take(pa.array(centre[there]))
        yield pa.record_batch(
            [*(kept.column(c).combine_chunks() for c in ("entry", "at", "symbol")), pa.array(sizes[there], pa.int32()), _signatures(rows.column("symbol").combine_chunks(), at, len(starts)).filter(pa.array(there)),
             kept.column("sdf").combine_chunks(), vectors.shapes_of_sets(points[:, :4], n), vectors.shapes_of_sets(points, n)],
            ["entry_id", "cae_idx", "central_atom", "n_atoms", "formula_str", "sdf", "fp_p", "fp_pq"],
        )


def _signatures(symbols: pa.Array, group: np.ndarray, n: int) -> pa.Array:
    """``signature`` of the symbols of each of n groups."""
    coded = symbols.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.argsort(order.to_numpy())
    known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    kinds = max(len(order), 1)
    keys, counts = np.unique(group[known] * kinds + rank[coded.indices.drop_null().to_numpy()], return_counts=True)
    parts = pc.binary_join_element_wise(coded.dictionary.take(order).take(pa.array(keys % kinds)), pa.array(counts).cast(pa.string()), "")
    ends = np.searchsorted(keys, np.arange(n + 1) * kinds).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), parts), "")


def conformed(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema, in its order and types; those that are missing are NULL."""
    want = StructType.fromDDL(schema)
    there = set(rows.columns)
    return rows.select(*((F.col(f"`{f.name}`") if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


#: Standard atomic weights.
WEIGHTS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.95, "K": 39.098, "Ca": 40.078,
    "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38,
    "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224,
    "Nb": 92.906, "Mo": 95.95, "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71, "Sb": 121.76,
    "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91, "Hf": 178.49, "Ta": 180.95, "W": 183.84, "Re": 186.21,
    "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59, "Tl": 204.38, "Pb": 207.2, "Bi": 208.98,
}


def component_facts(components: DataFrame) -> DataFrame:
    """weight and n_atoms of components (entry, ord, symbols); an unknown element makes the weight NULL."""
    weights = F.create_map(*(F.lit(x) for pair in sorted(WEIGHTS.items()) for x in pair))
    weight = F.aggregate(F.transform("symbols", lambda e: F.try_element_at(weights, e)), F.lit(0.0), lambda a, w: a + w)
    return components.select("entry", "ord", weight.alias("weight"), F.size("symbols").alias("n_atoms"))


def mineral_filter(entries: DataFrame) -> DataFrame:
    """Entries with coordinates and a metal that are neither polymeric nor disordered."""
    return entries.where(F.col("is_3d") & (F.size("metals") > 0) & ~F.col("polymeric") & ~F.col("disorder"))


def signature(symbols: Column) -> Column:
    """Element counts as text, elements in order: C2H3."""
    kinds = F.array_sort(F.array_distinct(symbols))
    return F.array_join(F.transform(kinds, lambda e: F.concat(e, F.size(F.filter(symbols, lambda s: s == e)).cast("string"))), "")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str]) -> DataFrame:
    """Rows of both; for a key in both, ``keep_old`` columns keep a value that is there, the others become the new."""
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    pick = {c: F.coalesce(f"a.{c}", f"b.{c}") if c in keys or c in keep_old else F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) for c in old.columns}
    return both.select(*(v.alias(c) for c, v in pick.items()))


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def charge_groups(atoms: DataFrame, symbol: str, charges: Sequence[int]) -> dict[int, DataFrame]:
    """Entries with an atom of the element in each charge."""
    return {c: atoms.where((F.col("symbol") == symbol) & (F.col("charge") == c)).select("entry").distinct() for c in charges}


def complexity(n_bonds: Column, n_atoms: Column) -> Column:
    return F.coalesce(F.try_divide(n_bonds, n_atoms), F.lit(0.0))
