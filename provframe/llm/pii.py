"""Personal data: exact patterns, and terms of the corpus that give the protected data away.

Base spans are found by patterns. Protected are the kinds of data and every single value (an address, a number). How
strongly a term discloses one of them is estimated from all documents: pointwise mutual information of "the document
holds the term" and "the document holds the protected entity", divided by the information content of the entity. One
means that all documents with the term hold the entity, zero that the two are independent. In documents with the
entity, terms above ``REMOVE_AT`` are removed and those above ``GENERALISE_AT`` are generalised, if chance doesn't explain
that the two meet: Chernoff's bound on the binomial (and hypergeometric) tail must be below ``ALPHA``, divided by the number
of terms, so that in expectation at most ``ALPHA`` terms of an entity are there by accident. Two documents can be enough; a single
one says nothing, as each of its words is as near to the entity as any other. Copies count as documents of their own, so
a corpus is best deduplicated first.

Everything runs as DataFrame expressions inside the JVM. The patterns are written so that Java's matcher neither recurses
over long repetitions nor tries every start within a long run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provframe.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"
GENERALISE_AT, REMOVE_AT, ALPHA = 0.85, 0.95, 0.01

#: Scripts without spaces between words.
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Terms: runs of letters with their marks, whatever stands around them; in scripts without spaces all pairs of neighbours,
#: those at even and at odd places of a run, and characters that stand alone. Each pattern's matches don't overlap.
TERMS = (
    rf"[\p{{L}}&&[^{_DENSE}]][\p{{L}}\p{{M}}&&[^{_DENSE}]]*+",
    rf"[{_DENSE}]{{2}}|(?<![{_DENSE}])[{_DENSE}](?![{_DENSE}])",
    rf"(?<=[{_DENSE}])[{_DENSE}]{{2}}",
)
_HAS_DENSE = rf"[{_DENSE}]"

_LOCAL = r"A-Za-z0-9._%+\x01-"
_LABEL = r"A-Za-z0-9-"


def _matches(text: Column, pattern: str) -> Column:
    """Spans (start, end, match) of all matches: lengths of what lies between and of the matches, added up."""
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        end = start + F.coalesce(F.char_length(p["match"]), F.lit(0))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), p["match"].alias("match")))).alias("spans"))

    # What follows the last match has no match of its own.
    return F.filter(F.aggregate(pieces, state, add, lambda a: a["spans"]), lambda s: s["match"].isNotNull())


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def add(a: Column, k: Column) -> Column:
        digit = F.substring(digits, -k, F.lit(1)).cast("int")
        twice = digit * (2 - k % 2)
        return a + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _kept(text: Column, pattern: str, kind: str, valid) -> Column:
    spans = F.filter(_matches(text, pattern), lambda s: valid(s["match"]))

    def own(match: Column) -> Column:
        """The same for all spellings of a value."""
        return F.xxhash64(F.lit(kind), {"email": F.lower, "ip": lambda m: m}.get(kind, _digits)(match))

    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), own(s["match"]).alias("value")))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind an array of (start, kind number, end, hash of the value) in code points; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:bigint>>")
    # Dots that no label follows are masked, so that a domain is one run; the mask stays part of local names.
    masked = F.regexp_replace(F.translate(text, "\x01", " "), rf"\.(?![{_LABEL}])", "\x01")
    email = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[{_LABEL}]++\.)[{_LABEL}.]++"
    # Separators that don't stand between two digits are masked, so that a number is one run.
    numbers = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")
    byte = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"

    def card(match: Column) -> Column:
        digits = F.regexp_replace(match, r"[\x20-]+", "")
        return F.char_length(digits).between(14, 19) & _luhn(digits)

    found = {
        "email": F.when(F.contains(text, F.lit("@")), _kept(masked, email, "email", lambda m: F.lit(True))),
        "ip": F.when(
            text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _kept(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip", lambda m: m.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        ),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), _kept(numbers, r"[0-9][0-9\x20-]++", "card", card)),
        "phone": F.when(text.rlike(r"\+[0-9]"), _kept(text, r"\+[0-9][\x20().0-9-]+[0-9]", "phone", lambda m: F.char_length(_digits(m)).between(10, 15))),
    }
    return {kind: F.coalesce(found[kind], none).alias(kind) for kind in KINDS}


def _with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), *base_spans(F.col(text_col)).values())
    return rows.withColumn("any", F.size(F.concat(*KINDS)) > 0)


def _outside(text: Column, spans: Column) -> Column:
    """The text with spaces in place of (sorted) spans, so that all other places stay what they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def blank(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] > a["at"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).otherwise(F.lit(""))
        blanks = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(a["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, blanks).alias("out"))

    blanked = F.aggregate(spans, start, blank, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, blanked).otherwise(text)


def _words(text: Column) -> Column:
    """The distinct terms of a text without base spans."""
    spaced, *dense = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in TERMS]
    return F.array_distinct(F.transform(F.when(text.rlike(_HAS_DENSE), F.concat(spaced, *dense)).otherwise(spaced), F.lower))


def _placed(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, text_key, held, term, start, end): the pattern's matches outside base spans."""
    between = F.transform(F.split("text", pattern, -1), F.char_length)
    pairs = F.posexplode(F.arrays_zip(between.alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("word"))).alias("i", "p")
    held = F.array_distinct(F.concat(F.transform(F.concat(*KINDS), lambda s: F.xxhash64(F.get(F.array(*map(F.lit, KINDS)), s["kind"]))), F.transform(F.concat(*KINDS), lambda s: s["value"])))
    placed = docs.select("doc_id", "text_key", "seq", held.alias("held"), pairs)
    placed = placed.select("doc_id", "text_key", "seq", "held", "i", F.col("p.gap").alias("gap"), F.col("p.word").alias("word"), F.coalesce(F.char_length("p.word"), F.lit(0)).alias("size"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("seq").orderBy("i"))
    placed = placed.withColumn("end", end.cast("int")).where("word IS NOT NULL")
    return placed.select("doc_id", "text_key", "held", F.lower("word").alias("term"), (F.col("end") - F.col("size")).alias("start"), "end")


def _entities(docs: DataFrame) -> DataFrame:
    """(seq, entity, size) of documents with base spans: the kinds they hold, and the values that they share with others."""
    kinds = F.filter(F.array(*[F.when(F.size(k) > 0, F.xxhash64(F.lit(k))) for k in KINDS]), lambda k: k.isNotNull())
    sizes = docs.select(F.explode(kinds).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("size"))  # at most one row a kind
    held = docs.select("seq", F.explode(kinds).alias("entity")).join(F.broadcast(sizes), "entity").select("seq", "entity", "size")
    values = docs.select("seq", F.explode(F.array_distinct(F.transform(F.concat(*KINDS), lambda s: s["value"]))).alias("entity"))
    recurring = values.groupBy("entity").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return held.union(values.join(recurring, "entity").select("seq", "entity", "size"))


def disclosing_terms(rows: DataFrame, docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, alpha: float = ALPHA) -> DataFrame:
    """(term, entity, remove): terms that disclose a kind of data or a value, by the hash of either.

    ``rows`` are all documents, ``docs`` those with base spans, numbered; base spans are blank in both. Terms are counted by a pre-aggregated grouping over
    all documents, terms beside entities by one over ``docs``. The latter sees every distinct term of a document with each of its
    kinds and recurring values.
    """
    terms = rows.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = materialize(terms.where("n > 1"), "terms")
    totals = rows.agg(F.count(F.lit(1)).alias("all")).crossJoin(F.broadcast(terms.agg(F.count(F.lit(1)).alias("tests"))))  # one row
    entities = _entities(docs).groupBy("seq").agg(F.collect_list(F.struct("entity", "size")).alias("entities"))  # bounded by a text's spans
    both = docs.select("seq", _words(F.col("text")).alias("terms")).join(entities, "seq").select(F.explode("entities").alias("e"), "terms")
    both = both.select(F.col("e.entity").alias("entity"), F.col("e.size").alias("size"), F.explode("terms").alias("term"))
    both = both.groupBy("term", "entity", "size").agg(F.count(F.lit(1)).alias("both")).where("both > 1")
    known = both.join(terms, "term").crossJoin(F.broadcast(totals))  # one row
    share = F.col("size") / F.col("all")
    disclosure = F.log(F.col("both") / F.col("n") / share) / -F.log(share)
    rest = F.col("n") - F.col("both")
    evidence = F.col("both") * F.log(F.col("both") / F.col("n") / share) + F.when(rest > 0, rest * F.log(rest / F.col("n") / (1 - share))).otherwise(F.lit(0.0))
    scored = known.where(share < 1).select("term", "entity", disclosure.alias("disclosure"), (evidence >= F.log(F.col("tests") / F.lit(alpha))).alias("sure"))
    return scored.where(F.col("sure") & (F.col("disclosure") >= generalise_at)).select("term", "entity", (F.col("disclosure") >= remove_at).alias("remove"))


def _term_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, terms): spans (start, kind number, end, remove) of disclosing terms in documents that hold what they disclose."""
    # The number tells repeated rows apart; it is written with them, so that it is the same for all readers.
    # Words are looked for outside base spans alone.
    rows = rows.withColumn("text", _outside(F.col("text"), F.sort_array(F.concat(*KINDS))))
    docs = rows.where("any").select("doc_id", "text_key", "text", *KINDS).withColumn("seq", F.monotonically_increasing_id())
    docs = materialize(docs, "protected")
    disclosing = disclosing_terms(rows, docs)
    placed = _placed(docs, TERMS[0])
    for pattern in TERMS[1:]:
        placed = placed.union(_placed(docs.where(F.col("text").rlike(_HAS_DENSE)), pattern))
    hits = placed.join(disclosing, "term").where("array_contains(held, entity)")
    hits = hits.groupBy("doc_id", "text_key", "start", "end").agg(F.max("remove").alias("remove"))
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "remove")
    return hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(span)).alias("terms"))  # bounded by a text's words


def _all_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "terms")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_key") == F.col("span_key")), "left")
    base = F.sort_array(F.concat(*KINDS))
    more = F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,remove:boolean>>"))
    base_more = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("remove")))
    return joined.withColumn("base", base).withColumn("spans", F.sort_array(F.concat(base_more, more)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM_KIND)])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row.

    Null and empty texts have no span. Repeated rows are searched each and get the same spans; ids may be null. Spans
    of different kinds may overlap. An empty table gives no row. Other columns aren't read.
    """
    rows = _with_base(docs, id_col, text_col)
    spans = _term_spans(rows)
    found = _all_spans(rows.select("doc_id", "text_key", *KINDS), spans)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with spans replaced by the name of their kind, or by nothing; of overlapping spans the first gives the name."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM_KIND)])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def replace(a: Column, s: Column) -> Column:
        name = F.when(s["remove"], F.lit("")).otherwise(F.get(names, s["kind"]))
        out = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), name)
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], out).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, start, replace, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with base spans and disclosing terms replaced in the text; rows without base spans pass unchanged."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("own_text"))
    text = F.coalesce("own_text", F.lit(""))
    rows = packed.select("row", "doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"), *base_spans(F.col("own_text")).values())
    rows = rows.withColumn("any", F.size(F.concat(*KINDS)) > 0)
    spans = _term_spans(rows)
    changed = _all_spans(rows.where("any").select("row", "doc_id", "text", "text_key", *KINDS), spans)
    changed = changed.select(F.col("row").withField(text_col, _redacted(F.col("text"), F.col("spans"))).alias("row"))
    return rows.where("NOT any").select("row").union(changed).select("row.*")
