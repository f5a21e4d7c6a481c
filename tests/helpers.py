from provframe import BX, NX, B, N, from_terms
from provframe.frame import KFrame
from provframe.sources.annotate import annotate

SEMIRINGS = [B, N, BX, NX]
IDS = [s.name for s in SEMIRINGS]


def frame(spark, semiring, schema, rows):
    """rows: [(tuple, {monomial: coefficient})], the model's relations as a KFrame."""
    attrs = [c.split()[0] for c in schema.split(", ")]
    if not semiring.symbolic:
        if semiring.weight is None:
            data = [t for t, p in rows if p]
            return annotate(spark.createDataFrame(data, schema), semiring)
        data = [(*t, sum(p.values())) for t, p in rows]
        return annotate(
            spark.createDataFrame(data, f"{schema}, __w_in bigint"), semiring, weight="__w_in", keep=attrs
        )
    if semiring.weight is None:
        data = [(*t, sorted(set(m))) for t, p in rows for m in p]
        return from_terms(spark.createDataFrame(data, f"{schema}, terms array<string>"), semiring, "terms")
    data = [(*t, list(m), c) for t, p in rows for m, c in p.items()]
    return from_terms(
        spark.createDataFrame(data, f"{schema}, terms array<string>, coef bigint"), semiring, "terms", "coef"
    )


def collected(f: KFrame) -> dict:
    """{tuple: annotation} of a small frame."""
    if not f.semiring.symbolic:
        if f.semiring.weight is None:
            rows = [(tuple(r), True) for r in f.result().collect()]
        else:
            rows = [(tuple(r)[:-1], int(r["n"])) for r in f.result().collect()]
    else:
        rows = []
        for r in f.text().collect():
            assert r["part"] == 0
            rows.append((tuple(r[a] for a in f.attrs), r["annotation"]))
    assert len({t for t, _ in rows}) == len(rows), "a tuple appears twice"
    return dict(rows)
