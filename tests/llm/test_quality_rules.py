import math
import re

import pytest
from pyspark.sql import functions as F

from provframe.llm import quality_rules

SPACE = "\x20\x09-\x0d"


def brute(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen, covered = {}, set()
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(docs, labels):
    rows = quality_rules.rated(docs, labels).collect()
    found = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        b = brute(r.text)
        wanted.append(str((r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])))
    assert found == sorted(wanted)
    assert all(r.kept == (not r.base_failed and not r.rejected_by) for r in rows)
    return rows


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 1)], "doc_id long, quality int")


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_odd_rows(request, labels, table):
    check(request.getfixturevalue(table), labels)


def test_given_documents_keep_good_ones(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_rules.rated(docs, labels).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in found.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.5


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 10, 300, 500, 200_000, 5_000_000) for k in (0, 1, n // 300, n // 150, n // 101, n // 100, n // 50, n) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01))

    def exact(k, n):
        if k > n * 0.01:
            return 1.0
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.01) + (n - j) * math.log(0.99)) for j in range(k + 1))

    for r in df.collect():
        assert r.p == pytest.approx(exact(r.k, r.n), rel=1e-6, abs=1e-300)


def made(strata, count, rate, seed):
    """Statistics of documents whose symbols and line repeats spread evenly, bad ones with more symbols, and labels for a part of them."""
    import random

    dealt = random.Random(seed)
    rows, labels = [], []
    for s in range(strata):
        for k in range(count):
            key = s * count + k
            good = dealt.random() < 0.9
            rows.append((key, f"s{s}", 100, 500, dealt.randrange(400) if good else dealt.randrange(300, 500), dealt.randrange(60), 0))
            if dealt.random() < rate:
                labels.append((key, int(good)))
    return rows, labels


STATISTICS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def brute_cutoffs(rows, labels, risk, alpha):
    quality = {}
    for key, q in labels:
        quality[key] = max(q, quality.get(key, q))
    steps = quality_rules.STEPS

    def values(r):
        mean = r[3] / max(r[2], 1)
        raw = {"symbols": r[4] / max(r[3], 1), "repeats": r[6] / max(r[2], 1), "lines": r[5] / max(r[2], 1), "long_words": (mean - 4) / 16, "short_words": (8 - mean) / 8}
        return {rule: min(max(math.ceil(v * steps), 0), steps) for rule, v in raw.items()}

    strata = {r[1] for r in rows if quality.get(r[0]) == 1}
    tails = {}
    for stratum in {r[1] for r in rows}:
        unseen = [values(r) for r in rows if r[1] == stratum and r[0] not in quality]
        tails[stratum] = {rule: {c: sum(v[rule] > c for v in unseen) / len(unseen) for c in {v[rule] for v in unseen}} for rule in quality_rules.RULES}
    at, weight = quality_rules.WEIGHED_AT, {}
    for rule in quality_rules.RULES:
        bad = [values(r)[rule] > min(c for c, n in tails[r[1]][rule].items() if n <= at) for r in rows if quality.get(r[0]) == 0]
        weight[rule] = max((sum(bad) / len(bad) / at - 1) / (1 / at - 1), 0)
    found = {}
    for stratum in strata:
        own = [(r[0], values(r)) for r in rows if r[1] == stratum]
        good, above = [v for k, v in own if quality.get(k) == 1], tails[stratum]
        for level in range(quality_rules.LEVELS):
            share = quality_rules.MILDEST * quality_rules.GROWTH**level
            cut = {}
            for rule in quality_rules.RULES:
                cut[rule] = min(c for c, n in above[rule].items() if n <= share * weight[rule]) if weight[rule] else steps
            k, n = sum(any(v[r] > cut[r] for r in cut) for v in good), len(good)
            tail = math.fsum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
            if tail > alpha / len(strata):
                break
            found[stratum] = (level, k, n, cut)
    return found


def test_cutoffs_equal_brute_force(spark):
    rows, labels = made(3, 1500, 0.4, 7)
    statistics, known = spark.createDataFrame(rows, STATISTICS), spark.createDataFrame(labels, "doc_id long, quality int")
    found = {}
    for r in quality_rules.choose_cutoffs(statistics, known, "lang", risk=0.05).collect():
        found.setdefault(r.stratum, (r.level, r.rejected, r.good, {}))[3][r.rule] = r.cutoff
    assert found == brute_cutoffs(rows, labels, 0.05, quality_rules.ALPHA) and len(found) == 3


def test_guarantee_holds_in_simulation(spark):
    """Forty corpora of one stratum: the chosen vectors reject more than the risk of all good documents in few of them."""
    rows, labels = made(40, 1200, 0.5, 11)
    statistics, known = spark.createDataFrame(rows, STATISTICS), spark.createDataFrame(labels, "doc_id long, quality int")
    cuts = {}
    for r in quality_rules.choose_cutoffs(statistics, known, "lang", risk=0.05, alpha=0.05 * 40).collect():  # each stratum at its own 0.05
        cuts.setdefault(r.stratum, {})[r.rule] = r.cutoff / quality_rules.STEPS
    assert len(cuts) == 40
    # Good documents spread as all do: symbols are k / 500 for k < 400, lines k / 100 for k < 60, the other ratios don't vary.
    over = 0
    for cut in cuts.values():
        kept = sum(k / 500 <= cut["symbols"] + 1e-9 for k in range(400)) / 400 * sum(k / 100 <= cut["lines"] + 1e-9 for k in range(60)) / 60
        over += 1 - kept > 0.05
    assert over <= 6  # 2 are expected, more than 6 come with a probability of 0.3 %


def test_every_language_gets_cutoffs(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    statistics = quality_rules.word_statistics(docs, also=("lang",))
    found = {r.stratum for r in quality_rules.choose_cutoffs(statistics, labels, "lang").collect()}
    assert found == {r.lang for r in docs.select("lang").distinct().collect()}


def test_few_labels_choose_no_cutoff(spark):
    docs = spark.createDataFrame([(k, "# " * 5 + "some plain words that say nothing at all here again", "en") for k in range(50)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert all(r.kept for r in quality_rules.rated(docs, labels).collect())


def test_cutoffs_keep_good_documents(spark):
    """Of 5,000 good documents 20 have many symbols, of the bad ones all; half of all have labels."""
    rows = [(k, "word " * 20 + "#" * (8 if k < 20 else 0), "en", 1) for k in range(5000)] + [(k, "word " * 20 + "#" * 60, "en", 0) for k in range(5000, 5100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").withColumn("text", F.concat(F.lit("a b c d e f g h i j "), F.regexp_replace("text", "word ", "")))
    labels = df.select("doc_id", "quality").where("doc_id % 2 = 0")
    found = {r.doc_id: r.kept for r in quality_rules.rated(df.drop("quality"), labels).collect()}
    assert not any(found[k] for k in range(5000, 5100))
    assert sum(not found[k] for k in range(5000)) <= 50


def test_main_path_has_no_python(spark, odd_docs, labels):
    plan = quality_rules.rated(odd_docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
