import numpy as np
import pandas as pd
import pytest

from kinelake.functions.features import Featurizer, angle, contact_counts, dihedral, distance, superpose
from kinelake.sources import frames as Fr


@pytest.fixture(scope="module")
def atoms():
    names = ["N", "CA", "C", "O", "CB"]
    rows = [(5 * r + k, n, n[0], {"N": 14.0, "C": 12.0, "O": 16.0}[n[0]], r, "ALA", 0) for r in range(4) for k, n in enumerate(names)]
    return pd.DataFrame(rows, columns=["atom", "name", "element", "mass", "residue", "resname", "chain"])


@pytest.fixture(scope="module")
def xyz():
    return np.random.default_rng(0).random((6, 20, 3)) * 2


def test_geometry(xyz):
    p = np.array([[0, 1], [2, 5]])
    assert np.allclose(distance(xyz, p)[:, 1], np.linalg.norm(xyz[:, 5] - xyz[:, 2], axis=1))
    box = np.full((6, 3), 1.0)
    assert distance(xyz, p, box).max() <= np.sqrt(3) / 2
    right = np.array([[[1.0, 0, 0], [0, 0, 0], [0, 1, 0], [0, 1, 1]]])
    assert np.allclose(np.degrees(angle(right, np.array([[0, 1, 2]]))), 90)
    assert np.allclose(abs(np.degrees(dihedral(right, np.array([[0, 1, 2, 3]])))), 90)
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert np.allclose(superpose(xyz[:1] @ q + 4, xyz[0])[0], xyz[0])


def test_featurizer(spark, atoms, xyz):
    f = Featurizer(atoms)
    assert f.select_ca().tolist() == [1, 6, 11, 16] and len(f.select_backbone()) == 12 and len(f.select_heavy({"ALA": ["CB"]})) == 16
    assert f.pairs([0, 1, 2, 3], 1).tolist() == [[0, 2], [0, 3], [1, 3]]
    f.add_distances_ca(excluded_neighbors=1).add_inverse_distances([[0, 5]]).add_contacts([0, 1, 2], threshold=0.8).add_contacts([0, 1], [6], threshold=0.8, count_contacts=True)
    f.add_angles([[0, 1, 2]], cossin=True).add_dihedrals([[0, 1, 2, 5]], deg=True).add_backbone_torsions().add_group_com([[0, 1], [2, 3]]).add_residue_com([1], "backbone")
    f.add_residue_mindist().add_group_mindist([[0, 1], [5, 6], [10]], threshold=0.5, count_contacts=True).add_minrmsd_to_ref(xyz[0]).add_selection([3])
    f.add_custom_func(lambda x: x[:, 0, :1] * 2, 1)
    got = f.compute(xyz)
    assert got.shape == (6, f.dimension) == (6, len(f.describe()))
    frames = Fr.from_arrays(spark, [xyz.reshape(6, -1)])
    assert np.allclose(Fr.get_output(f.transform(frames))[0], got)
    f.remove_all_custom_funcs()
    assert f.compute(xyz).shape[1] == got.shape[1] - 1
    with pytest.raises(ValueError):
        f.add_chi1_torsions()
    with pytest.raises(ValueError):
        Featurizer(atoms).add_custom_func(lambda x: x[:, 0], 2).compute(xyz)
    assert Featurizer(atoms).compute(xyz).shape == (6, 60)


def test_pairs_of_two_sets():
    assert Featurizer.parse_pairs([0, 1], [1, 2]).tolist() == [[0, 2], [1, 2]]  # atoms of the first set leave the second
    assert Featurizer.parse_pairs([1, 0, 1], [0, 1]).tolist() == []
    assert Featurizer.parse_pairs([2, 0, 1]).tolist() == [[0, 1], [0, 2], [1, 2]]


def test_contacts_sql(spark, xyz):
    frames = Fr.from_arrays(spark, [xyz.reshape(6, -1)])
    pairs = [(0, 1), (3, 7)]
    want = (distance(xyz, np.array(pairs)) <= 0.9).sum(1)
    assert [r.n for r in contact_counts(frames, pairs, 0.9).orderBy("t").collect()] == want.tolist()
