"""Checksums of pairs that are hashed where they meet, against hashlib and against pairs made as rows."""

import hashlib
import random

import numpy as np
import pytest

from provframe import BX, NX
from provframe.functions import digest
from provframe.operators import hashed, intervals
from provframe.sources.annotate import annotate

NAN, INFINITE = float("nan"), float("inf")


def laid_out(texts):
    return digest.padded(np.concatenate(([0], np.cumsum([len(t) for t in texts]))), np.frombuffer(b"".join(texts), np.uint8))


@pytest.mark.parametrize("length", [0, 1, 3, 4, 31, 55, 56, 60, 61, 63, 64, 65, 127, 128, 150])
def test_digests_of_heads_and_tails(length):
    rng = random.Random(length)
    heads = [rng.randbytes(length) for _ in range(4)]
    # Neighbours that begin alike share a block.
    tails = sorted([rng.randbytes(rng.randrange(150)) for _ in range(20)] + [b"alike" * 14 + rng.randbytes(9) for _ in range(9)] + [b""])
    made = digest.Heads(laid_out(heads)[0])
    rows, lengths = laid_out(tails)
    blocks = digest.blocks_of(made, lengths)
    for count in set(blocks.tolist()):
        those = np.flatnonzero(blocks == count)
        ends = digest.Tails(made, rows[those], lengths[those], count)
        i, j = np.repeat(np.arange(4), len(those)), np.tile(np.arange(len(those)), 4)
        found = digest.digests(made, ends, i, j)
        assert found.tolist() == [int(hashlib.md5(heads[a] + tails[those[b]]).hexdigest()[:8], 16) for a, b in zip(i, j)]


def test_pairs_come_in_lanes(monkeypatch):
    monkeypatch.setattr(digest, "LANES", 4)
    parts = [np.arange(k, k + n) for k, n in ((0, 3), (3, 0), (3, 7), (10, 1))]
    out = list(digest.in_lanes((p, -p) for p in parts))
    assert [len(i) for i, _ in out] == [4, 4, 3] and np.concatenate([i for i, _ in out]).tolist() == list(range(11))
    assert all((i == -j).all() for i, j in out)


def sides(spark, semiring, seed, names=("l", "r")):
    """Rows with NULL, NaN and infinite bounds, long and short ids, and rows that share attributes and variable."""
    rng = random.Random(seed)
    number = lambda: rng.choice([None, -0.0, 0.0, NAN, INFINITE, 7.0, *[rng.uniform(-20, 20) for _ in range(9)]])
    ids = lambda n: rng.choice([str(rng.randrange(n)), "é_" * rng.randrange(40), None])

    def rows(n):
        out = []
        for _ in range(n):
            low = number()
            out.append((rng.choice(["p", "q", None]), low, low if low is None else low + rng.choice([0.0, 0.5, 3.0, -1.0]), ids(n)))
        return out + out[:3]

    one = annotate(spark.createDataFrame(rows(90), "a string, low double, high double, i string"), semiring, names[0], ["i"])
    two = annotate(spark.createDataFrame(rows(60), "b string, since double, till double, j string"), semiring, names[1], ["j"])
    return one, two


@pytest.mark.parametrize("semiring", [BX, NX], ids=["B[X]", "N[X]"])
@pytest.mark.parametrize("names", [("l", "r"), ("z", "r")])
def test_overlaps_are_hashed_where_they_meet(spark, semiring, names, monkeypatch):
    monkeypatch.setattr(intervals, "CELL_ROWS", 8)
    one, two = sides(spark, semiring, 5, names)
    frame = one.join(two, overlaps=(("low", "high"), ("since", "till"))).project("b", "a")
    assert hashed.sums(frame) is not None
    plain = frame.where("true")  # no longer only a join
    assert hashed.sums(plain) is None
    key = lambda r: str(r)
    found = sorted(frame.stats(digest=True).collect(), key=key)
    assert found and found == sorted(plain.stats(digest=True).collect(), key=key)
    assert frame.equals(plain)


def test_few_places_and_small_tables(spark, monkeypatch):
    """Sums that leave a task early and often are the same."""
    one, two = sides(spark, BX, 8)
    frame = one.join(two, between=("low", "since", "till")).project("b", "a")
    key = lambda r: str(r)
    want = sorted(frame.where("true").stats(digest=True).collect(), key=key)
    for name, value in (("PLACED", 0), ("SUMMED", 1), ("ROWS_AT_ONCE", 5), ("COMPARED", 3)):
        monkeypatch.setattr(hashed, name, value)
    assert sorted(frame.stats(digest=True).collect(), key=key) == want


def test_overlapping_pairs_are_not_moved(spark):
    """nothing is dealt by (tuple, witness) but the pairs of repeated rows."""
    one = annotate(spark.createDataFrame([("p", 0.0, 2.0, 1)], "a string, low double, high double, i int"), BX, "l", ["i"], unique=True)
    two = annotate(spark.createDataFrame([("q", 1.0, 3.0, 1)], "b string, since double, till double, j int"), BX, "r", ["j"], unique=True)
    frame = one.join(two, overlaps=(("low", "high"), ("since", "till"))).project("b", "a")
    exchanges = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert not any("__w0" in x for x in exchanges(frame.merge().df) + exchanges(frame.stats(digest=True)))
    found = frame.stats(digest=True)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("q", "p", 1, 2, int(hashlib.md5("(l_1 ∧ r_1)".encode()).hexdigest()[:8], 16))]


def test_ranges_are_hashed_where_they_meet(spark):
    """with days and prices, as in join_range_days_bx; a variable of several ids, and one shared by two rows."""
    one = annotate(spark.createDataFrame([("p", k % 5, 2.0 * k, k % 11, k % 2) for k in range(30)], "a string, v int, x double, i int, h int"), BX, "left", ["i", "h"])
    two = annotate(spark.createDataFrame([("q", k % 4, 30.0 - k, k) for k in range(20)], "b string, d int, y double, j int"), BX, "right", ["j"])
    frame = one.join(two, between=("v", "d", "d + 2"), above=("x", "y")).project("a", "b")
    terms = {f"(left_{i % 11}_{i % 2} ∧ right_{j})" for i in range(30) for j in range(20) if j % 4 <= i % 5 <= j % 4 + 2 and 2.0 * i > 30.0 - j}
    total = sum(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in terms)
    found = frame.stats(digest=True)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("p", "q", len(terms), 2 * len(terms), total)]


def test_checksums_that_are_too_large_raise(spark, monkeypatch):
    """in N[X] likewise; a sum beyond a bigint is an error, not a number."""
    one = annotate(spark.createDataFrame([("p", 1, 2.0, 1)], "a string, v int, x double, i int"), NX, "left", ["i"])
    two = annotate(spark.createDataFrame([("q", 0, 1.0, 1)], "b string, d int, y double, j int"), NX, "right", ["j"])
    frame = one.join(two, between=("v", "d", "d + 2"), above=("x", "y")).project("a", "b")
    assert [tuple(r) for r in frame.stats(digest=True).collect()] == [("p", "q", 1, 1, 2, int(hashlib.md5("left_1·right_1".encode()).hexdigest()[:8], 16))]
    large = spark.createDataFrame([("p", "q", 2**31, 2**62)] * 2, f"a string, b string, {hashed.TERMS} long, {hashed.DIGEST} long")
    monkeypatch.setattr(hashed, "sums", lambda frame: (large, []))
    with pytest.raises(Exception, match="OVERFLOW"):
        frame.stats(digest=True).collect()
