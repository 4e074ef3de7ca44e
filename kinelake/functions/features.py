"""Geometric features of frames: ``x`` holds 3N coordinates, an optional ``box`` the edge lengths of a rectangular cell.

A :class:`Featurizer` lists features and maps frames in one Arrow pass; the atoms (``atom, name, element, mass, residue, resname,
chain``) are a small table on the driver.  Distances and contacts also have a form in column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators.clustering import min_rmsd
from kinelake.operators.moments import _matrix

Array = np.ndarray


def minimum_image(d: Array, box: Array | None) -> Array:
    return d if box is None else d - box[:, None, :] * np.round(d / box[:, None, :])


def displacement(xyz: Array, pairs: Array, box: Array | None = None) -> Array:
    return minimum_image(xyz[:, pairs[:, 1]] - xyz[:, pairs[:, 0]], box)


def distance(xyz: Array, pairs: Array, box: Array | None = None) -> Array:
    return np.sqrt((displacement(xyz, pairs, box) ** 2).sum(-1))


def angle(xyz: Array, triples: Array, box: Array | None = None) -> Array:
    u = displacement(xyz, triples[:, [1, 0]], box)
    v = displacement(xyz, triples[:, [1, 2]], box)
    c = (u * v).sum(-1) / np.sqrt((u**2).sum(-1) * (v**2).sum(-1))
    return np.arccos(np.clip(c, -1, 1))


def dihedral(xyz: Array, quads: Array, box: Array | None = None) -> Array:
    a, b, c = (displacement(xyz, quads[:, [k, k + 1]], box) for k in range(3))
    n, m = np.cross(a, b), np.cross(b, c)
    return np.arctan2((np.sqrt((b**2).sum(-1, keepdims=True)) * a * m).sum(-1), (n * m).sum(-1))


def turned(values: Array, deg: bool, cossin: bool) -> Array:
    if cossin:
        return np.stack([np.cos(values), np.sin(values)], -1).reshape(len(values), -1)
    return np.degrees(values) if deg else values


def superpose(xyz: Array, reference: Array, on: Array | None = None, on_ref: Array | None = None) -> Array:
    """Frames rotated and moved onto a reference by the best fit of chosen atoms."""
    on = np.arange(xyz.shape[1]) if on is None else on
    on_ref = on if on_ref is None else on_ref
    a, b = xyz[:, on], reference[on_ref]
    ca, cb = a.mean(1, keepdims=True), b.mean(0)
    u, _, vt = np.linalg.svd(np.einsum("fni,nj->fij", a - ca, b - cb))
    sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    u[:, :, 2] *= sign[:, None]
    return (xyz - ca) @ (u @ vt) + cb


@dataclass
class Feature:
    """A function of ``(xyz, box)`` with its dimension and labels."""

    f: Callable[[Array, Array | None], Array]
    labels: list[str]
    custom: bool = False

    @property
    def dim(self) -> int:
        return len(self.labels)


@dataclass
class Featurizer:
    atoms: pd.DataFrame
    features: list[Feature] = field(default_factory=list)

    # Selections

    def select(self, query: str) -> Array:
        """Atoms by a pandas query over the atom table, such as ``name == "CA" and residue < 10``."""
        return self.atoms.query(query)["atom"].to_numpy()

    def select_ca(self) -> Array:
        return self.select('name == "CA"')

    def select_backbone(self) -> Array:
        return self.select('name in ["C", "CA", "N"]')

    def select_heavy(self, exclude_symmetric: dict[str, Sequence[str]] | None = None) -> Array:
        """Atoms of mass 2 or more; ``exclude_symmetric`` names interchangeable atoms by residue name."""
        a = self.atoms[self.atoms["mass"] >= 2]
        for resname, names in (exclude_symmetric or {}).items():
            a = a[~((a["resname"] == resname) & a["name"].isin(names))]
        return a["atom"].to_numpy()

    @staticmethod
    def pairs(selection: Sequence[int], excluded_neighbors: int = 0) -> Array:
        s = list(selection)
        return np.array([(s[i], s[j]) for i in range(len(s)) for j in range(i + 1 + excluded_neighbors, len(s))], int).reshape(-1, 2)

    @staticmethod
    def parse_pairs(indices, indices2=None) -> Array:
        """Index pairs as they are, all pairs of one set, or each of one set with each that only the second set has."""
        a = np.asarray(indices, int)
        if indices2 is not None:
            b = np.setdiff1d(np.asarray(indices2, int), a)
            return np.array([(i, j) for i in np.unique(a) for j in b], int).reshape(-1, 2)
        if a.ndim == 2:
            if a.shape[1] != 2:
                raise ValueError("pairs have two indices")
            return a
        return np.array(list(combinations(np.unique(a).tolist(), 2)), int).reshape(-1, 2)

    @staticmethod
    def parse_groups(groups: Sequence[Sequence[int]], pairs="all") -> list[tuple[int, int]]:
        if isinstance(pairs, str):
            if pairs != "all":
                raise ValueError(f"unknown group pairs {pairs}")
            return list(combinations(range(len(groups)), 2))
        if any(not 0 <= k < len(groups) for p in pairs for k in p):
            raise ValueError("a pair names a group that does not exist")
        return [tuple(p) for p in pairs]

    # Features

    def _add(self, f, labels: list[str], custom: bool = False) -> Featurizer:
        self.features.append(Feature(f, labels, custom))
        return self

    def _label(self, i: int) -> str:
        a = self.atoms.iloc[int(i)]
        return f"{a['resname']} {a['residue']} {a['name']} {int(i)}"

    def add_all(self, reference: Array | None = None, atoms=None, ref_atoms=None) -> Featurizer:
        return self.add_selection(self.atoms["atom"].to_numpy(), reference, atoms, ref_atoms)

    def add_selection(self, indexes, reference: Array | None = None, atoms=None, ref_atoms=None) -> Featurizer:
        """Coordinates of atoms, superposed on a reference if given."""
        idx = np.asarray(indexes, int)
        labels = [f"{self._label(i)} {c}" for i in idx for c in "xyz"]
        if reference is None:
            return self._add(lambda x, box: x[:, idx].reshape(len(x), -1), labels)
        ref = np.asarray(reference, float).reshape(-1, 3)
        return self._add(lambda x, box: superpose(x, ref, atoms, ref_atoms)[:, idx].reshape(len(x), -1), labels)

    def add_distances(self, indices, periodic: bool = True, indices2=None) -> Featurizer:
        p = self.parse_pairs(indices, indices2)
        return self._add(lambda x, box: distance(x, p, box if periodic else None), [f"DIST: {self._label(i)} - {self._label(j)}" for i, j in p])

    def add_distances_ca(self, periodic: bool = True, excluded_neighbors: int = 2) -> Featurizer:
        return self.add_distances(self.pairs(self.select_ca(), excluded_neighbors), periodic)

    def add_inverse_distances(self, indices, periodic: bool = True, indices2=None) -> Featurizer:
        p = self.parse_pairs(indices, indices2)
        return self._add(lambda x, box: 1 / distance(x, p, box if periodic else None), [f"INVDIST: {self._label(i)} - {self._label(j)}" for i, j in p])

    def add_contacts(self, indices, indices2=None, threshold: float = 0.3, periodic: bool = True, count_contacts: bool = False) -> Featurizer:
        """1 where a pair is at most ``threshold`` apart, or the number of such pairs."""
        p = self.parse_pairs(indices, indices2)
        one = lambda x, box: (distance(x, p, box if periodic else None) <= threshold).astype(float)
        if count_contacts:
            return self._add(lambda x, box: one(x, box).sum(1, keepdims=True), ["number of contacts"])
        return self._add(one, [f"CONTACT: {self._label(i)} - {self._label(j)}" for i, j in p])

    def _add_mindist(self, sets: list[tuple[Array, Array]], labels, threshold, periodic, count) -> Featurizer:
        lists = [np.array([(i, j) for i in a for j in b], int) for a, b in sets]
        cut = np.cumsum([0, *map(len, lists)])
        flat = np.concatenate(lists)

        def f(x, box):
            d = distance(x, flat, box if periodic else None)
            low = np.minimum.reduceat(d, cut[:-1], axis=1)
            if threshold is None:
                return low
            hit = (low <= threshold).astype(float)
            return hit.sum(1, keepdims=True) if count else hit

        return self._add(f, ["number of contacts"] if count and threshold is not None else labels)

    def add_group_mindist(self, groups, pairs="all", threshold: float | None = None, periodic: bool = True, count_contacts: bool = False) -> Featurizer:
        got = self.parse_groups(groups, pairs)
        return self._add_mindist([(np.asarray(groups[i]), np.asarray(groups[j])) for i, j in got], [f"MINDIST: group {i} - group {j}" for i, j in got], threshold, periodic, count_contacts)

    def add_residue_mindist(self, pairs="all", scheme: str = "closest-heavy", threshold: float | None = None, periodic: bool = True, count_contacts: bool = False) -> Featurizer:
        """The least distance of two residues' atoms: ``ca``, ``closest`` or ``closest-heavy``; ``all`` leaves out neighbours."""
        a = self.atoms
        pick = {"ca": a[a["name"] == "CA"], "closest": a, "closest-heavy": a[a["mass"] >= 2]}[scheme]
        members = {r: g["atom"].to_numpy() for r, g in pick.groupby("residue")}
        res = sorted(members)
        got = [(r, s) for r, s in combinations(res, 2) if s - r > 2] if isinstance(pairs, str) else [tuple(p) for p in pairs]
        return self._add_mindist([(members[r], members[s]) for r, s in got], [f"RES_DIST ({scheme}): {r} - {s}" for r, s in got], threshold, periodic, count_contacts)

    def add_group_com(self, groups, reference: Array | None = None, mass_weighted: bool = True) -> Featurizer:
        mass = self.atoms["mass"].to_numpy(float)
        w = np.zeros((len(groups), len(mass)))
        for k, g in enumerate(groups):
            w[k, list(g)] = mass[list(g)] if mass_weighted else 1
        w /= w.sum(1, keepdims=True)
        ref = None if reference is None else np.asarray(reference, float).reshape(-1, 3)
        return self._add(lambda x, box: np.einsum("gn,fnc->fgc", w, x if ref is None else superpose(x, ref)).reshape(len(x), -1), [f"COM-{c} group {k}" for k in range(len(groups)) for c in "xyz"])

    def add_residue_com(self, residues, scheme: str = "all", reference=None, mass_weighted: bool = True) -> Featurizer:
        a = self.atoms
        ok = {"all": a.index == a.index, "backbone": a["name"].isin(["C", "CA", "N", "O"]), "sidechain": ~a["name"].isin(["C", "CA", "N", "O", "H", "HA"])}[scheme]
        return self.add_group_com([a[ok & (a["residue"] == r)]["atom"].tolist() for r in residues], reference, mass_weighted)

    def _add_turn(self, f, name: str, idx: Array, deg: bool, cossin: bool, periodic: bool, names: list[str] | None = None) -> Featurizer:
        base = names or [f"{name}: " + " - ".join(self._label(i) for i in row) for row in idx]
        labels = [f"{t}({b})" for b in base for t in ("COS", "SIN")] if cossin else base
        return self._add(lambda x, box: turned(f(x, idx, box if periodic else None), deg, cossin), labels)

    def add_angles(self, indexes, deg=False, cossin=False, periodic=True) -> Featurizer:
        return self._add_turn(angle, "ANGLE", np.asarray(indexes, int).reshape(-1, 3), deg, cossin, periodic)

    def add_dihedrals(self, indexes, deg=False, cossin=False, periodic=True) -> Featurizer:
        return self._add_turn(dihedral, "DIH", np.asarray(indexes, int).reshape(-1, 4), deg, cossin, periodic)

    def _atom(self, residue: int, *names: str) -> int | None:
        a = self.atoms[(self.atoms["residue"] == residue) & self.atoms["name"].isin(names)]
        return int(a["atom"].iloc[0]) if len(a) else None

    def _torsion(self, residue: int, parts: Sequence[tuple[int, Sequence[str]]]) -> list[int] | None:
        got = [self._atom(residue + shift, *names) for shift, names in parts]
        return None if any(g is None for g in got) else got

    def _in_chain(self, residue: int, other: int) -> bool:
        c = self.atoms.groupby("residue")["chain"].first()
        return residue in c.index and other in c.index and c[residue] == c[other]

    def add_backbone_torsions(self, residues=None, deg=False, cossin=False, periodic=True) -> Featurizer:
        """phi and psi of each residue that has both, interleaved."""
        rows, names = [], []
        for r in residues if residues is not None else sorted(self.atoms["residue"].unique()):
            phi = self._torsion(r, [(-1, "C"), (0, "N"), (0, ["CA"]), (0, "C")]) if self._in_chain(r, r - 1) else None
            psi = self._torsion(r, [(0, "N"), (0, ["CA"]), (0, "C"), (1, "N")]) if self._in_chain(r, r + 1) else None
            for name, t in (("PHI", phi), ("PSI", psi)):
                if t is not None:
                    rows.append(t)
                    names.append(f"{name} {r}")
        return self._add_turn(dihedral, "TORSION", np.array(rows, int).reshape(-1, 4), deg, cossin, periodic, names)

    #: The fourth atom names of chi1 .. chi5 along the side chain.
    CHI = (("N", "CA", "CB", ("CG", "CG1", "OG", "OG1", "SG")), ("CA", "CB", ("CG", "CG1"), ("CD", "CD1", "OD1", "ND1", "SD")), ("CB", "CG", ("CD", "SD"), ("NE", "CE", "OE1")), ("CG", "CD", ("NE", "CE"), ("CZ", "NZ")), ("CD", "NE", "CZ", "NH1"))

    def add_sidechain_torsions(self, residues=None, which="all", deg=False, cossin=False, periodic=True) -> Featurizer:
        chosen = range(1, 6) if which == "all" else [int(w.removeprefix("chi")) for w in np.atleast_1d(which)]
        rows, names = [], []
        for r in residues if residues is not None else sorted(self.atoms["residue"].unique()):
            for k in chosen:
                t = self._torsion(r, [(0, [n] if isinstance(n, str) else n) for n in self.CHI[k - 1]])
                if t is not None:
                    rows.append(t)
                    names.append(f"CHI{k} {r}")
        if not rows:
            raise ValueError("no side chain has the torsions asked for")
        return self._add_turn(dihedral, "CHI", np.array(rows, int), deg, cossin, periodic, names)

    def add_chi1_torsions(self, residues=None, deg=False, cossin=False, periodic=True) -> Featurizer:
        return self.add_sidechain_torsions(residues, "chi1", deg, cossin, periodic)

    def add_minrmsd_to_ref(self, reference: Array, atoms=None) -> Featurizer:
        ref = np.asarray(reference, float).reshape(-1, 3)
        idx = np.arange(len(ref)) if atoms is None else np.asarray(atoms, int)
        return self._add(lambda x, box: min_rmsd(x[:, idx].reshape(len(x), -1), ref[idx].reshape(1, -1)), ["minRMSD to reference"])

    def add_custom_func(self, f: Callable[..., Array], dim: int, *args, labels: list[str] | None = None, **kwargs) -> Featurizer:
        """A function of the coordinates (frames x atoms x 3) that returns frames x ``dim`` numbers."""

        def checked(x, box):
            y = np.asarray(f(x, *args, **kwargs), float)
            if y.shape != (len(x), dim):
                raise ValueError(f"a custom feature gave {y.shape}, not {(len(x), dim)}")
            return y

        return self._add(checked, labels or [f"{getattr(f, '__name__', 'custom')}[{k}]" for k in range(dim)], True)

    add_custom_feature = add_custom_func

    def remove_all_custom_funcs(self) -> None:
        self.features = [f for f in self.features if not f.custom]

    def describe(self) -> list[str]:
        return [label for f in self.features for label in f.labels]

    @property
    def dimension(self) -> int:
        return sum(f.dim for f in self.features) or 3 * len(self.atoms)

    def compute(self, xyz: Array, box: Array | None = None) -> Array:
        """All features side by side, in 32 bits of precision; without features the coordinates themselves."""
        if not self.features:
            return xyz.reshape(len(xyz), -1)
        return np.hstack([f.f(xyz, box) for f in self.features]).astype(np.float32).astype(float)

    def transform(self, frames: DataFrame) -> DataFrame:
        """Frames whose ``x`` are the features; one Arrow pass."""
        names = ["x", *(["box"] if "box" in frames.columns else [])]
        rest = [c for c in frames.columns if c not in ("x", "box")]
        compute = self.compute

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(len(rest)))
                    box = _matrix(batch.column(len(rest) + 1)) if len(names) > 1 else None
                    y = np.ascontiguousarray(compute(x.reshape(len(x), -1, 3), box))
                    ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
                    yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(rest))], pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=[*rest, "x"])

        schema = ", ".join(f"{n} {t}" for n, t in frames.dtypes if n in rest) + ", x array<double>"
        return frames.select(*rest, *names).mapInArrow(run, schema)


def distance_column(i: int, j: int, box: bool = False) -> Column:
    """The distance of two atoms as a column expression."""
    total = None
    for k in range(3):
        d = F.get("x", F.lit(3 * j + k)) - F.get("x", F.lit(3 * i + k))
        if box:
            edge = F.get("box", F.lit(k))
            d = d - edge * F.round(d / edge)
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def contact_counts(frames: DataFrame, pairs: Sequence[tuple[int, int]], threshold: float) -> DataFrame:
    """``traj_id, t, n``: how many pairs are at most ``threshold`` apart; column expressions only."""
    return frames.select("traj_id", "t", sum((F.when(distance_column(i, j) <= threshold, 1).otherwise(0) for i, j in pairs), F.lit(0)).alias("n"))


def read_atoms(path: str) -> pd.DataFrame:
    """The atom table of a PDB file's first model; masses follow the element."""
    mass = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "S": 32.06, "P": 30.974}
    rows, order = [], {}
    with open(path) as f:
        for line in f:
            if line.startswith("ENDMDL"):
                break
            if line.startswith(("ATOM", "HETATM")):
                name = line[12:16].strip()
                element = (line[76:78].strip() or name.lstrip("0123456789")[:1]).upper()
                key = (line[21], line[22:27])
                rows.append((len(rows), name, element, mass.get(element, 12.0), order.setdefault(key, len(order)), line[17:20].strip(), ord(line[21]) - 65))
    return pd.DataFrame(rows, columns=["atom", "name", "element", "mass", "residue", "resname", "chain"])
