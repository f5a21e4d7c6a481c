import numpy as np
import pytest
import xxhash

from provframe.llm import simhash
from provframe.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    left, label = set(range(len(fps))), {}
    values = np.array(fps, dtype=np.uint64)
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            k = queue.pop()
            group.add(k)
            near = [int(j) for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4) if int(j) in left]
            left -= set(near)
            queue += near
        known = [ids[k] for k in group if ids[k] is not None]
        label |= dict.fromkeys(group, min(known) if known else None)
    return [label[k] for k in range(len(fps))]


def check(df):
    rows = df.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    wanted = sorted(zip([str(r.doc_id) for r in rows], [f"{f:016x}" for f in fps], map(str, brute_components(fps, [r.doc_id for r in rows]))))
    found = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_groups(df).collect())
    assert found == wanted


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(request, table):
    check(request.getfixturevalue(table))


def test_given_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("large", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, large):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(map(int, centres))
    for c in centres[:12]:
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= np.uint64(1) << np.uint64(b)
            fps.add(int(x))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df, large=large)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    wanted = brute_components(fps, signed)
    assert [roots.get(s, s) for s in signed] == wanted


def test_only_one_of_each_component_stays(spark, odd_docs):
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {r.component_id for r in simhash.near_groups(odd_docs).collect()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, groups))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)]
    found = connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 40)}
