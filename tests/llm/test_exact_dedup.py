import hashlib
import re

import pytest

from provframe.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (i, t), n in zip(rows, norm):
        groups.setdefault(n, []).append((-len(t or ""), i is None, i or 0, i))
    best = {n: min(g) for n, g in groups.items()}
    seen, out = set(), []
    for (i, t), n in zip(rows, norm):
        kept = (-len(t or ""), i) == (best[n][0], best[n][3]) and n not in seen
        if kept:
            seen.add(n)
        out.append(str((i, best[n][3], len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 24, 32768])
@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(request, table, bits):
    docs = request.getfixturevalue(table)
    found = exact_dedup.exact_groups(docs, digest_all=True, filter_bits=bits).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in found) == brute(rows)


def test_settled_rows_are_not_hashed(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "a b c"), (3, "xyz"), (4, "long enough")], "doc_id long, text string")
    found = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert found[3].text_sha256 is None and found[4].text_sha256 is None
    assert found[1].keep_id == found[2].keep_id == 2 and found[1].text_sha256 == found[2].text_sha256 is not None


def test_rows_that_stay(odd_docs):
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    wanted = [r for r in exact_dedup.exact_groups(odd_docs).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in wanted)
