"""Index factory strings."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class IndexSpec:
    nlist: int | None = None
    pq: int | None = None
    pca: int | None = None
    flat: bool = False


def parse(key: str) -> IndexSpec:
    """"Flat", "IVF512,Flat", "IVF4096,PQ32", "PQ32", "PCA80,Flat"; anything else is an error."""
    found: dict = {}
    for part in key.split(","):
        if part == "Flat":
            name, value = "flat", True
        elif m := re.fullmatch(r"(IVF|PQ|PCA)(\d+)", part):
            name, value = {"IVF": "nlist", "PQ": "pq", "PCA": "pca"}[m[1]], int(m[2])
        else:
            raise ValueError(f"unknown index part {part!r} in {key!r}")
        if name in found:
            raise ValueError(f"{part!r} occurs again in {key!r}")
        found[name] = value
    spec = IndexSpec(**found)
    if spec.flat == (spec.pq is not None):
        raise ValueError(f"{key!r} needs either Flat or PQ")
    return spec


def build(base, key: str, **how):
    """The index a factory string names: an IvfIndex, for PQ an IvfPqIndex, for PCA a TransformedIndex, or for "Flat" the table itself."""
    from . import pq, transform
    from .ivf import IvfIndex

    spec = parse(key)
    if spec.pca:
        if spec.pq is not None:
            raise ValueError(f"{key!r}: PCA goes with Flat")
        cols = {k: v for k, v in how.items() if k in ("id_col", "vec_col")}
        return transform.TransformedIndex.build(base, transform.pca(base, spec.pca, **cols), spec.nlist, **how)
    if spec.pq is None:
        return IvfIndex.build(base, spec.nlist, **how) if spec.nlist else base
    if spec.nlist:
        return pq.IvfPqIndex.build(base, spec.nlist, spec.pq, **how)
    from vecspan.functions.vectors import dimension

    cols = {k: v for k, v in how.items() if k in ("id_col", "vec_col")}
    dim = dimension(base, how.get("vec_col", "embedding"))
    book = pq.train_codebook(base, spec.pq, dim, **{k: v for k, v in how.items() if k in ("id_col", "vec_col", "codes", "iterations")})
    return pq.flat(base, book, dim, **cols)
