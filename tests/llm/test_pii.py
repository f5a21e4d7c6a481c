import hashlib
import random
import re

import pytest

from provframe.llm import pii

#: The base patterns of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    text = text or ""
    spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    written = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(written.encode()).hexdigest()), written


def check(docs):
    rows = pii.personal_data(docs).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    found = sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in rows)
    assert found == sorted(str((i, *brute(t)[0])) for i, ts in texts.items() for t in ts)
    return rows, texts


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(request, table):
    check(request.getfixturevalue(table))


def test_given_documents_keep_base_spans_and_add_terms(spark):
    rows, texts = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for r in rows:
        spans = r.spans.split(",") if r.spans else []
        base = ",".join(s for s in spans if not s.startswith("term:"))
        assert base == brute(texts[r.doc_id][0])[1]


def test_generated_texts(spark):
    parts = ["a@b.c", "x", "@", ".", "..", "1.2.3.4", "256.1.1.1", "00300.1.1.1", "4539 1488 0343 6467", "4539148803436467", "1", "-", " ", "  ", "+1 (017) 555-7713", "+", "(", "é", "\x01", "_", "%", "9" * 30, "\n", "b.c-d@e-f.gh.i", "d@e.f"]
    choose = random.Random(3)
    texts = sorted({"".join(choose.choices(parts, k=choose.randint(0, 25))) for _ in range(300)} | {"@".join(["a.b"] * 9), "1 " * 40_000, "1." * 8_000, "a" * 100_000, "a." * 40_000 + "@" + "b." * 40_000 + "c", "+1" + " 2" * 40_000})
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def planted(spark):
    common = [f"plain words number {'abcdefghij'[k % 10]} here" for k in range(400)]
    telling = [f"Reach agent Smith, now: agent{k}@mail.example.com thanks é \U0001f600" for k in range(24)]
    return spark.createDataFrame(list(enumerate(common + telling + ["agent Smith alone"])), "doc_id long, text string")


def test_terms_that_come_with_the_data_only_are_found_where_the_data_is(spark):
    docs = planted(spark)
    found = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    text = docs.where("doc_id = 400").first().text
    terms = [text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in found[400].split(",")) if kind == "term"]
    assert {"agent", "Smith", "Reach"} <= set(terms) and "here" not in terms
    assert found[424] == "" and found[3] == ""


def test_sanitised_texts_have_no_base_span_left_and_others_stay(spark, odd_docs):
    docs = planted(spark)
    after = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert len(after) == len(before)
    assert all(after[k] == before[k] for k in [*range(400), 424])
    assert all("[EMAIL]" in after[k] and "@" not in after[k] and "Smith" not in after[k] for k in range(400, 424))
    assert sorted(map(str, pii.sanitised(odd_docs).collect())) == sorted(map(str, odd_docs.collect()))


def test_main_path_has_no_python(spark):
    plan = pii.personal_data(planted(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def terms_of(row, text):
    spans = [s.split(":") for s in row.spans.split(",")] if row.spans else []
    return {text[int(a) : int(b)] for kind, a, b in spans if kind == "term"}


def test_rare_terms_that_come_with_one_value_are_found(spark):
    """Names in two or three documents, each beside a value of its own; many other documents hold the same kind."""
    fill = [f"plain words number {'abcdefghij'[k % 10]} here" for k in range(600)]
    others = [f"plain words here other{k}@mail.example.com" for k in range(100)]
    ada = ["Ask Adalovely about words here ada@mail.example.com", "plain Adalovely here ADA@mail.example.com"]
    bob = [f"plain Bobhopeful words {n} here" for n in ("+49 171 5557713", "+49 (171) 555-7713", "+49 171 555 7713")]
    texts = fill + others + ada + bob
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: terms_of(r, texts[r.doc_id]) for r in pii.personal_data(docs).collect()}
    assert all(found[k] == {"Adalovely"} for k in (700, 701))
    assert all(found[k] == {"Bobhopeful"} for k in (702, 703, 704))
    assert not any(found[k] for k in range(700))
    after = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert not any("Adalovely" in t or "Bobhopeful" in t for t in after.values())


def test_terms_of_a_single_document_and_chance_company_are_kept(spark):
    texts = ["plain words here"] * 60 + [f"plain words only{c} v{k}@mail.example.com" for k, c in enumerate("abcdefgh")]
    texts += ["chance words a@b.example", "chance words c@d.example"] + ["plain e@f.example words"] * 30
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not any(terms_of(r, texts[r.doc_id]) for r in rows)


def test_terms_are_found_whatever_stands_around_them(spark):
    fill = [f"plain words {'abcdefghij'[k % 10]} here, \u4eca\u5929\u5929\u6c14" for k in range(400)]
    around = ["(Smith", '"Smith"', "Smith\u2019s", "Smith's", "Smith-Jones", "Smith/Jones", "smith_7", "[Smith]", "Smith"] * 3
    telling = [f"plain {w} here Li {'\u4eca\u5929' if k % 2 else ''}\u738b\u5c0f\u660e agent{k}@mail.example.com words" for k, w in enumerate(around)]
    docs = spark.createDataFrame(list(enumerate(fill + telling)), "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.personal_data(docs).where("doc_id >= 400").collect():
        terms = terms_of(r, texts[r.doc_id])
        assert {"smith", "li", "\u738b\u5c0f", "\u5c0f\u660e"} <= {t.lower() for t in terms}
        assert not terms & {"plain", "words", "here", "mail", "example", "com", "agent", "\u4eca\u5929"}
    after = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    for k in range(400, 400 + len(telling)):
        assert "smith" not in after[k].lower() and "Li" not in after[k].split() and not set("\u738b\u5c0f\u660e") & set(after[k])
