"""Stored models: a folder for each store, in it a manifest and, for each model, JSON fields beside ``.npy`` arrays.

Nothing is ever unpickled.  ``python -m kinelake.sources.models FOLDER`` lists what is stored.
"""

from __future__ import annotations

import dataclasses
import hashlib
import importlib
import json
import os
import shutil
import sys
from typing import Any

import numpy as np

VERSION = 1
#: Classes that may be restored.
KNOWN = {
    "MSM": "kinelake.operators.msm", "HMSM": "kinelake.operators.hmm", "PCA": "kinelake.operators.decomposition", "TICA": "kinelake.operators.decomposition",
    "VAMP": "kinelake.operators.decomposition", "NystroemTICA": "kinelake.operators.decomposition", "KMeans": "kinelake.operators.clustering", "MiniBatchKMeans": "kinelake.operators.clustering",
    "RegularSpace": "kinelake.operators.clustering", "UniformTime": "kinelake.operators.clustering", "AssignCenters": "kinelake.operators.clustering", "Moments": "kinelake.operators.moments",
    "LaggedCovariance": "kinelake.operators.moments", "MultiThermModel": "kinelake.operators.thermo", "StationaryModel": "kinelake.operators.thermo", "TimeUnit": "kinelake.functions.support", "Koopman": "kinelake.operators.decomposition",
}


def _pack(value: Any, arrays: dict[str, np.ndarray]) -> Any:
    if isinstance(value, np.ndarray):
        key = f"a{len(arrays)}"
        arrays[key] = value
        return {"$array": key}
    if isinstance(value, (np.integer, np.floating, np.bool_)):
        return value.item()
    if isinstance(value, (list, tuple)):
        return {"$list": [_pack(v, arrays) for v in value], "tuple": isinstance(value, tuple)}
    if isinstance(value, dict):
        return {"$dict": [[_pack(k, arrays), _pack(v, arrays)] for k, v in value.items()]}
    if type(value).__name__ in KNOWN:
        return {"$class": type(value).__name__, "fields": {k: _pack(v, arrays) for k, v in vars(value).items() if not callable(v) and k != "_spectrum"}}
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"a {type(value).__name__} can't be stored")


def _unpack(value: Any, arrays: dict[str, np.ndarray]) -> Any:
    if not isinstance(value, dict):
        return value
    if "$array" in value:
        return arrays[value["$array"]]
    if "$list" in value:
        out = [_unpack(v, arrays) for v in value["$list"]]
        return tuple(out) if value["tuple"] else out
    if "$dict" in value:
        return {_unpack(k, arrays): _unpack(v, arrays) for k, v in value["$dict"]}
    cls = getattr(importlib.import_module(KNOWN[value["$class"]]), value["$class"])
    out = object.__new__(cls)
    if dataclasses.is_dataclass(cls) and cls.__dataclass_params__.frozen:
        return cls(**{k: _unpack(v, arrays) for k, v in value["fields"].items()})
    out.__dict__.update({k: _unpack(v, arrays) for k, v in value["fields"].items()})
    if value["$class"] in ("MSM", "HMSM"):
        out._spectrum = None
    return out


def _manifest(folder: str) -> dict:
    path = os.path.join(folder, "manifest.json")
    if not os.path.exists(path):
        return {"version": VERSION, "models": {}}
    with open(path) as f:
        return json.load(f)


def _write_manifest(folder: str, m: dict) -> None:
    with open(os.path.join(folder, "manifest.json"), "w") as f:
        json.dump(m, f, indent=1)


def save_model(model: Any, folder: str, name: str = "default", overwrite: bool = False) -> None:
    m = _manifest(folder)
    if name in m["models"] and not overwrite:
        raise FileExistsError(f"{name} is stored already")
    if not name.replace("-", "").replace("_", "").replace(".", "").isalnum() or name.startswith("."):
        raise ValueError("model names are letters, digits, -, _ and .")
    target = os.path.join(folder, name)
    shutil.rmtree(target, True)
    os.makedirs(target)
    arrays: dict[str, np.ndarray] = {}
    text = json.dumps(_pack(model, arrays))
    digest = hashlib.sha256(text.encode())
    for k, a in arrays.items():
        np.save(os.path.join(target, f"{k}.npy"), a, allow_pickle=False)
        digest.update(a.tobytes())
    with open(os.path.join(target, "model.json"), "w") as f:
        f.write(text)
    m["models"][name] = {"class": type(model).__name__, "digest": digest.hexdigest(), "version": VERSION}
    _write_manifest(folder, m)


def load_model(folder: str, name: str = "default") -> Any:
    entry = _manifest(folder)["models"].get(name)
    if entry is None:
        raise KeyError(f"no model {name} in {folder}")
    if entry["version"] > VERSION:
        raise ValueError(f"{name} was stored by a later version")
    target = os.path.join(folder, name)
    arrays = {f[:-4]: np.load(os.path.join(target, f), allow_pickle=False) for f in os.listdir(target) if f.endswith(".npy")}
    with open(os.path.join(target, "model.json")) as f:
        return _unpack(json.load(f), arrays)


def list_models(folder: str) -> dict[str, dict]:
    return _manifest(folder)["models"]


def delete_model(folder: str, name: str) -> None:
    m = _manifest(folder)
    del m["models"][name]
    shutil.rmtree(os.path.join(folder, name))
    _write_manifest(folder, m)


def rename_model(folder: str, old: str, new: str) -> None:
    m = _manifest(folder)
    if new in m["models"]:
        raise FileExistsError(new)
    m["models"][new] = m["models"].pop(old)
    os.rename(os.path.join(folder, old), os.path.join(folder, new))
    _write_manifest(folder, m)


def main(argv: list[str] | None = None) -> int:
    for folder in argv if argv is not None else sys.argv[1:]:
        for name, entry in sorted(list_models(folder).items()):
            print(f"{folder}: {name} ({entry['class']}, {entry['digest'][:12]})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
