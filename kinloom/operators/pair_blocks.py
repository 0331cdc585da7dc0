"""Sums over sites for all pairs of people, by blocks of people and of sites.

The result has a row for each pair, so its size is quadratic in the people;
what is avoided is a row for each pair and site.  Values are packed for a block
of people and a block of sites; two blocks of people meet once for each block
of sites, and their matrices' products are added up in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinloom.operators.recovery import checkpointed

#: People and sites of a block, on average.
PEOPLE, SITES = 256, 1024

BLOCKS = "vb long, pb long, people array<long>, sites array<long>, codes binary, weights binary"


def _packed(weights: int):
    """Rows (vb, pb, iid, site, code, weights ...) of one block, as a matrix with -1 where a person has no value."""

    def run(group: pa.Table) -> pa.Table:
        iid, site = (group[c].to_numpy() for c in ("iid", "site"))
        people, row = np.unique(iid, return_inverse=True)
        sites, col = np.unique(site, return_inverse=True)
        codes = np.full((len(people), len(sites)), -1, np.int64)
        codes[row, col] = group["code"].to_numpy()
        table = np.zeros((len(sites), weights))
        for k in range(weights):
            table[col, k] = group[f"w{k}"].to_numpy()
        one = lambda x, kind: pa.array([x], kind)
        longs = pa.list_(pa.int64())
        return pa.table({"vb": group["vb"][:1], "pb": group["pb"][:1], "people": one(people, longs), "sites": one(sites, longs), "codes": one(codes.tobytes(), pa.binary()), "weights": one(table.tobytes(), pa.binary())})

    return run


class _Block:
    def __init__(self, people: list, sites: list, codes: bytes, weights: bytes, n_weights: int):
        self.people, self.sites = np.array(people, np.int64), np.array(sites, np.int64)
        self.codes = np.frombuffer(codes, np.int64).reshape(len(people), len(sites))
        self.weights = np.frombuffer(weights).reshape(len(sites), n_weights)


def _summed(kernel: Callable, names: list[str], n_weights: int):
    """Sorted rows (pb1, pb2, two blocks of the same sites) to one row for each pair of people."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums, places = None, None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            left, right = (np.array(sorted(p, key=p.get), np.int64) for p in places)
            pick = (left[:, None] < right[None]) if key[0] == key[1] else left[:, None] != right[None]
            i, j = np.nonzero(pick)
            a, b = left[i], right[j]
            turn = a > b
            ids = [np.where(turn, b, a), np.where(turn, a, b)]
            held = [m[: len(left), : len(right)][i, j] for m in sums]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), *map(pa.array, held)], ["iid1", "iid2", *names])

        def places_of(known: dict, people: np.ndarray) -> np.ndarray:
            return np.array([known.setdefault(p, len(known)) for p in people.tolist()])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                if (row["pb1"], row["pb2"]) != key:
                    yield from flush()
                    key, sums, places = (row["pb1"], row["pb2"]), None, ({}, {})
                one, two = (_Block(*(row[f"{c}{i}"] for c in ("people", "sites", "codes", "weights")), n_weights) for i in (1, 2))
                both, at1, at2 = np.intersect1d(one.sites, two.sites, assume_unique=True, return_indices=True)
                if key[0] == key[1]:
                    rows1 = places_of(places[0], one.people)
                    places[1].update(places[0])
                    rows2 = rows1
                else:
                    rows1, rows2 = (places_of(p, b.people) for p, b in zip(places, (one, two)))
                parts = kernel(one.codes[:, at1], two.codes[:, at2], one.weights[at1])
                if sums is None:
                    sums = [np.zeros((0, 0)) for _ in parts]
                shape = (len(places[0]), len(places[1]))
                for n, part in enumerate(parts):
                    if sums[n].shape[0] < shape[0] or sums[n].shape[1] < shape[1]:
                        wider = np.zeros((max(shape[0], 2 * sums[n].shape[0]), max(shape[1], 2 * sums[n].shape[1])))
                        wider[: sums[n].shape[0], : sums[n].shape[1]] = sums[n]
                        sums[n] = wider
                    sums[n][np.ix_(rows1, rows2)] += part
        yield from flush()

    return run


def pair_sums(values: DataFrame, kernel: Callable, names: list[str], weights: list[str] = (), people: int = PEOPLE, sites: int = SITES) -> DataFrame:
    """(iid1, iid2, sums ...) of all pairs of people that share a block of sites.

    ``values(iid, site, code, ...)`` holds one code of 0 or more for a person
    at a site, and weights of the site; ``kernel`` takes two matrices of codes
    (-1: none) over the same sites and the sites' weights, and gives a matrix
    of pairs for each name.  Blocks are dealt by hashes, so a task holds two
    blocks and their sums, whatever the number of people and sites.
    """
    held = checkpointed(values.select("iid", "site", F.col("code").cast("long").alias("code"), *[F.col(w).cast("double").alias(f"w{k}") for k, w in enumerate(weights)]))
    n = held.agg(F.approx_count_distinct("iid").alias("iid"), F.approx_count_distinct("site").alias("site")).first()
    pbs, vbs = (max(1, -(-n[c] // size)) for c, size in (("iid", people), ("site", sites)))
    dealt = held.withColumns({"vb": F.pmod(F.xxhash64("site"), F.lit(vbs)), "pb": F.pmod(F.xxhash64("iid"), F.lit(pbs))})
    blocks = checkpointed(dealt.groupBy("vb", "pb").applyInArrow(_packed(len(weights)), BLOCKS))
    fields = ("people", "sites", "codes", "weights")
    one, two = (blocks.select("vb", F.col("pb").alias(f"pb{i}"), *[F.col(c).alias(f"{c}{i}") for c in fields]) for i in (1, 2))
    met = one.join(two, "vb").where("pb1 <= pb2").select("pb1", "pb2", *[f"{c}{i}" for i in (1, 2) for c in fields], "vb")
    sorted_ = met.repartition("pb1", "pb2").sortWithinPartitions("pb1", "pb2", "vb")
    return sorted_.mapInArrow(_summed(kernel, list(names), len(weights)), "iid1 long, iid2 long, " + ", ".join(f"{x} double" for x in names))


def same_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At how many sites each two people have the same code."""
    out = np.zeros((len(a), len(b)))
    for code in np.unique(a[a >= 0]):
        out += (a == code).astype(np.float64) @ (b == code).astype(np.float64).T
    return out


def dosage_sums(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Sites known in both, with no, one and two alleles in common, and the sum of each weight over them."""
    here, there = (a >= 0).astype(np.float64), (b >= 0).astype(np.float64)
    n = here @ there.T
    two = same_codes(a, b)
    none = (a == 0).astype(np.float64) @ (b == 2).astype(np.float64).T + (a == 2).astype(np.float64) @ (b == 0).astype(np.float64).T
    return [n, none, n - none - two, two, *[(here * w) @ there.T for w in weights.T]]


def haploid_sums(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Sites of both, those unknown (code 0) in either, and those that differ."""
    here, there = (a >= 0).astype(np.float64), (b >= 0).astype(np.float64)
    known = (a > 0).astype(np.float64) @ (b > 0).astype(np.float64).T
    length = here @ there.T
    return [length, length - known, known - same_codes(np.where(a > 0, a, -1), b)]
