"""Path and ring patterns over bonds.

A pattern is a first atom and steps, each a bond test and an atom test; a ring ends with a bond back to the
first atom. Atoms of a match are distinct. ``found`` tells for each entry which patterns it has: atoms and bonds are
dealt by entry once, all patterns are searched in a batch of small graphs, depth first where one may match, and a search ends with its first
match. A ring's path goes no further from its first atom than the steps that are left lead back. ``matches`` lists
every match of one pattern by joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from weft.operators.molecules import Graphs, dealt_graphs, turns

MULTIPLE = ("double", "triple", "quadruple")


@dataclass(frozen=True)
class Atom:
    kind: str | None = None  # metal, nonmetal or an element's symbol
    cyclic: bool | None = None

    def test(self, prefix: str) -> Column:
        out = F.lit(True)
        if self.kind in ("metal", "nonmetal"):
            out &= F.col(f"{prefix}{self.kind}")
        elif self.kind:
            out &= F.col(f"{prefix}symbol") == self.kind
        return out if self.cyclic is None else out & (F.col(f"{prefix}cyclic") == self.cyclic)


@dataclass(frozen=True)
class Path:
    first: Atom
    steps: tuple[tuple[tuple[str, ...] | str | None, Atom], ...]  # "!x" is any bond but x
    ring: tuple[str, ...] | str | None | bool = False  # the closing bond; False for a chain


def bond_test(bonds: tuple[str, ...] | str | None) -> Column:
    if bonds is None:
        return F.lit(True)
    if isinstance(bonds, str):
        return F.col("bond") != bonds[1:] if bonds[0] == "!" else F.col("bond") == bonds
    return F.col("bond").isin(*bonds)


def edges(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds in both directions with the far atom's facts.

    atoms (entry, ord, symbol, metal, nonmetal, cyclic), bonds (entry, a, b, bond).
    """
    both = bonds.select("entry", F.col("a").alias("at"), F.col("b").alias("to"), "bond").union(bonds.select("entry", "b", "a", "bond"))
    return both.join(atoms.select("entry", F.col("ord").alias("to"), *(F.col(c).alias(f"to_{c}") for c in ("symbol", "metal", "nonmetal", "cyclic"))), ["entry", "to"])


def matches(atoms: DataFrame, links: DataFrame, path: Path) -> DataFrame:
    """entry and path (atom numbers) of every match."""
    out = atoms.where(path.first.test("")).select("entry", F.array("ord").alias("path"))
    for bonds, atom in path.steps:
        step = links.where(bond_test(bonds) & atom.test("to_")).select("entry", "at", "to")
        out = out.withColumn("at", F.element_at("path", -1)).join(step, ["entry", "at"]).where(~F.array_contains("path", F.col("to"))).select("entry", F.array_append("path", F.col("to")).alias("path"))
    if path.ring is not False:
        back = links.where(bond_test(path.ring)).select("entry", "at", "to")
        ends = out.withColumns({"at": F.element_at("path", -1), "to": F.col("path")[0]}).where(F.size("path") > 2)
        out = ends.join(back, ["entry", "at", "to"], "left_semi").select("entry", "path")
    return out


def found(atoms: DataFrame, bonds: DataFrame, named: dict[str, Sequence[Path]]) -> DataFrame:
    """entry, and for each named pattern whether the entry has a match of any of its paths.

    atoms (entry, ord, symbol, metal, nonmetal, cyclic), bonds (entry, a, b, bond). Without ``cyclic`` it is found from the bonds.
    """
    given = "cyclic" in atoms.columns
    dealt = dealt_graphs(atoms, bonds, "metal", "nonmetal", *(["cyclic"] if given else []))
    names = list(named)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in turns(batches):
            held = Graphs(rows)
            if held.atoms.num_rows:
                search = _Search(held, held.atoms.column("cyclic").combine_chunks() if given else pa.array(held.cyclic()))
                entries = held.atoms.column("entry").take(pa.array(search.first)).combine_chunks()
                yield pa.record_batch([entries, *(pa.array(search.any_of(named[n])) for n in names)], ["entry", *names])

    schema = StructType([dealt.schema["entry"], *(StructField(n, BooleanType()) for n in names)])
    return dealt.mapInArrow(searched, schema)


def hits(atoms: DataFrame, bonds: DataFrame, paths: Sequence[Path]) -> DataFrame:
    """Entries with a match of any of the paths."""
    return found(atoms, bonds, {"hit": paths}).where("hit").select("entry")


def _bonded(test: tuple[str, ...] | str | None, bond: str | None) -> bool:
    if test is None:
        return True
    if bond is None:
        return False
    if isinstance(test, tuple):
        return bond in test
    return bond != test[1:] if test[0] == "!" else bond == test


class _Search:
    """Which of many graphs have a match of a path.

    A path is first followed in all graphs at once, without asking that its atoms are distinct: where this ends nowhere, there is
    no match. The other graphs are searched one at a time, depth first.
    """

    def __init__(self, held: Graphs, cyclic: pa.Array):
        n = len(held.graph)
        start = np.concatenate((held.a, held.b))
        order = np.argsort(start, kind="stable")
        self.start, self.to = start[order], np.concatenate((held.b, held.a))[order]
        self.bonds, self.which = held.bonds.dictionary_encode(), order % max(len(held.a), 1)
        self.first = np.flatnonzero(np.diff(held.graph, prepend=-1))
        self.sizes = np.diff(np.append(self.first, n))
        self.row = np.repeat(np.arange(len(self.first)), self.sizes)
        self.symbols = held.atoms.column("symbol").combine_chunks()
        flag = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
        self.flags = {k: flag(held.atoms.column(k).combine_chunks()) for k in ("metal", "nonmetal")}
        self.cyclic = {True: flag(cyclic), False: flag(pc.invert(cyclic))}
        self.known: dict[object, np.ndarray] = {}
        self.lists: dict[object, list] = {"to": self.to.tolist(), "ends": np.searchsorted(self.start, np.arange(n + 1)).tolist()}
        self.far: dict[int, dict[int, int]] = {}

    def fits(self, test: Atom) -> np.ndarray:
        """Which atoms pass the test."""
        if test not in self.known:
            out = np.ones(len(self.row), bool)
            if test.kind in self.flags:
                out = self.flags[test.kind]
            elif test.kind:
                out = pc.fill_null(pc.equal(self.symbols, test.kind), False).to_numpy(zero_copy_only=False)
            self.known[test] = out if test.cyclic is None else out & self.cyclic[test.cyclic]
        return self.known[test]

    def bonded(self, test: tuple[str, ...] | str | None) -> np.ndarray:
        """Which bonds, from either of their ends, pass the test."""
        if test not in self.known:
            good = np.array([*(_bonded(test, x) for x in self.bonds.dictionary.to_pylist()), _bonded(test, None)])
            self.known[test] = good[pc.fill_null(self.bonds.indices, len(good) - 1).to_numpy()][self.which]
        return self.known[test]

    def listed(self, key: object, values: np.ndarray) -> list:
        if key not in self.lists:
            self.lists[key] = values.tolist()
        return self.lists[key]

    def any_of(self, paths: Sequence[Path]) -> np.ndarray:
        out = np.zeros(len(self.first), bool)
        for path in paths:
            out |= self.having(path, ~out)
        return out

    def having(self, path: Path, among: np.ndarray) -> np.ndarray:
        """Which graphs of those have a match."""
        at = self.fits(path.first) & (among & (self.sizes > len(path.steps)))[self.row]
        for bonds, atom in path.steps:
            if not at.any():
                break
            go = at[self.start] & self.bonded(bonds) & self.fits(atom)[self.to] & (self.start != self.to)
            at = np.zeros(len(at), bool)
            at[self.to[go]] = True
        out = np.zeros(len(self.first), bool)
        out[self.row[at]] = True
        if len(path.steps) > 1 or path.ring is not False:
            for row in np.flatnonzero(out).tolist():
                out[row] = self.has(path, int(self.first[row]), int(self.sizes[row]))
        return out

    def distances(self, start: int) -> dict[int, int]:
        to, ends = self.lists["to"], self.lists["ends"]
        out, layer = {start: 0}, [start]
        while layer:
            layer = [y for x in layer for y in to[ends[x] : ends[x + 1]] if y not in out and not out.update({y: out[x] + 1})]
        return out

    def has(self, path: Path, first: int, size: int) -> bool:
        """Whether the graph of these atoms has a match."""
        steps, ring = path.steps, path.ring is not False
        to, ends = self.lists["to"], self.lists["ends"]
        tests = [(self.listed(bonds, self.bonded(bonds)), self.listed(atom, self.fits(atom))) for bonds, atom in steps]
        closes = self.listed(path.ring, self.bonded(path.ring)) if ring else []
        starts = self.listed(path.first, self.fits(path.first))
        for start in range(first, first + size):
            if not starts[start]:
                continue
            if ring and start not in self.far:
                self.far[start] = self.distances(start)
            back = self.far[start] if ring else {}
            todo = [(start, 0, (start,))]
            while todo:
                at, n, seen = todo.pop()
                ways = range(ends[at], ends[at + 1])
                if n == len(steps):
                    if not ring or len(seen) > 2 and any(to[e] == start and closes[e] for e in ways):
                        return True
                    continue
                bonded, fits = tests[n]
                for e in ways:
                    y = to[e]
                    if bonded[e] and fits[y] and y not in seen and (not ring or back[y] <= len(steps) - n):
                        todo.append((y, n + 1, (*seen, y)))
        return False


def library(bridge: int = 6, dative: int = 6, saturated: int = 8, unsaturated: int = 12) -> dict[str, list[Path]]:
    """The twenty named patterns; the numbers bound chains and rings. Names, bonds, atoms and bounds."""
    m, x, any_ = Atom("metal"), Atom("nonmetal"), Atom()
    open_, ring = Atom("nonmetal", False), Atom("nonmetal", True)
    chain = lambda n, bond, atom: tuple((bond, atom) for _ in range(n))
    cyclic, acyclic = Atom(None, True), Atom(None, False)
    return {
        "chelating_ligands": [Path(Atom("metal", True), ())],
        "mono_bridged_complexes": [Path(m, (*chain(i, None, open_), (None, m))) for i in range(1, bridge + 1)],
        "multi_bridged_complexes": [Path(Atom("metal", True), (*chain(i, None, ring), (None, Atom("metal", True)))) for i in range(1, bridge + 1)],
        "linear_ligands": [Path(m, ((None, open_),))],
        "metal_allenes": [Path(m, ((MULTIPLE, x), (MULTIPLE, Atom("C"))))],
        "dative_bonds": [Path(m, (("pi", x),))],
        "dative_in_rings": [Path(m, ((None, x), *chain(i, "!pi", x)), "pi") for i in range(1, dative + 1)],
        "dative_in_conjugated_chains": [Path(m, (("pi", any_), (MULTIPLE, acyclic), ("single", acyclic), (MULTIPLE, acyclic)))],
        "dative_in_conjugated_rings": [Path(m, (("pi", cyclic), (MULTIPLE, cyclic), ("single", cyclic), (MULTIPLE, cyclic)))],
        "cyclic_multihapto_ligands": [Path(m, (("pi", cyclic), ("aromatic", cyclic)), "pi")],
        "sigma_bonds": [Path(m, (("pi", Atom("H")),))],
        "sigma_bonds_in_rings": [Path(m, ((None, x), *chain(i - 1, "!pi", x), ("!pi", Atom("H"))), "pi") for i in range(1, dative + 1)],
        "saturated_rings": [Path(x, chain(i, "single", x), "single") for i in range(2, saturated + 1)],
        "unsaturated_rings": [Path(x, ((MULTIPLE, x), *chain(i, None, x)), None) for i in range(1, unsaturated + 1)],
        "unsaturated_conjugated_rings": [Path(x, ((MULTIPLE, x), ("single", x), (MULTIPLE, x), *chain(i - 1, None, x)), None) for i in range(1, unsaturated + 1)],
        "aromatic_rings": [Path(cyclic, (("aromatic", cyclic),))],
        "saturated_chains": [Path(any_, (("single", acyclic),))],
        "unsaturated_chains": [Path(any_, ((MULTIPLE, acyclic), ("single", acyclic)))],
        "unsaturated_conjugated_chains": [Path(any_, ((MULTIPLE, acyclic), ("single", acyclic), (MULTIPLE, any_)))],
        "allenes": [Path(any_, ((MULTIPLE, Atom("C")), (MULTIPLE, any_)))],
    }
