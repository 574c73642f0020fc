"""Personal data: patterns, and terms that give protected entities away, in DataFrame operations only.

Base spans are e-mail and IP addresses, card and phone numbers. Their values are the protected entities. A term (a word) discloses an
entity by the information that seeing it gives: PMI(t; e) = log P(e | t) / P(e), estimated from co-occurrence in the documents of the
whole corpus, with P(e | t) = n(t, e) / (n(t) + UNSEEN). Where that reaches a share of the entity's own information, log 1 / P(e), the
term is marked in the documents that hold the entity, too, and sanitising generalises it. However rare an entity is, its terms count:
words that are in its documents and hardly anywhere else.

Entities of the same documents have the same counts, and are one class, so that a text of many entities is looked at once.

The patterns are the plain ones with possessive quantifiers, and with a look-behind where a match that fails would otherwise be tried
again from every character of a long run; matches are the same. Java's matcher never backtracks or recurses through a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BROADCAST_ROWS, cut, drop, split_join

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}  # a text without it has no such span
BYTE = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
TERM = len(KINDS)
WORD = r"[\p{L}\p{N}]++"
UNSEEN = 0.5  # documents that hold the term without the entity, and weren't seen
DISCLOSURE = 0.94  # share of the entity's information; from a thousand documents on, a word that is nowhere else gives that away
AT_ONCE = 128  # matches whose spans are put together by appending


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The digits' check sum holds: every second from the right counts double, less 9 from 10 on."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z")
    digits = F.length(_digits(value))
    if kind == "card":
        return F.when(digits.between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches that ``keep(value, start, end)`` holds for, in code points: matches and the gaps between them alternate."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    every = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("value"))

    def ends(acc: Column, x: Column) -> Column:
        return acc + F.length(x["gap"]) + F.length(x["value"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(keep(x["value"], start, end), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def some(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(pairs) - 1) / AT_ONCE).cast("int"), F.lit(0))), lambda i: F.slice(pairs, i * AT_ONCE + 1, F.lit(AT_ONCE)))

    def begun(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), ends))
        return F.arrays_zip(parts.alias("pairs"), F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))).alias("at"))

    empty = F.array().cast(SPANS)
    # the last place has no pairs
    return F.flatten(F.transform(F.filter(_once(_once(every, some), begun), lambda z: z["pairs"].isNotNull()), lambda z: F.aggregate(z["pairs"], F.struct(z["at"].alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_spans(text: Column) -> Column:
    """All base spans of a text that isn't null, by start and then by kind."""
    each = []
    for i, kind in enumerate(KINDS):
        sign = text.rlike("[0-9]") if NEEDS[kind] is None else F.contains(text, F.lit(NEEDS[kind]))
        found = _located(text, PATTERNS[kind], i, lambda value, start, end, kind=kind: _valid(kind, value))
        each.append(F.when(sign & text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast(SPANS)))
    return F.array_sort(F.concat(*each))


def _entity(span: Column) -> Column:
    """The protected entity of a span: its kind and value, numbers without their signs."""
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]++", -1)), "")


def _between(text: Column, base: Column) -> Column:
    """The text between its base spans."""
    end = lambda i: F.coalesce(F.get(base, i - 1)["end"], F.lit(0))
    start = lambda i: F.coalesce(F.get(base, i)["start"], F.length(text))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(base)), lambda i: F.substring(text, end(i) + 1, F.greatest(start(i) - end(i), F.lit(0)))), " ")


def _information(e: Column, n: int) -> Column:
    return F.ln(F.lit(float(n)) / e)


def _disclosed(et: Column, e: Column, t: Column, n: int, disclosure: float) -> Column:
    """The term's PMI with an entity reaches the share of the entity's information; an entity of every document has none."""
    return (F.ln(et * F.lit(float(n)) / (e * (t + UNSEEN))) >= _information(e, n) * disclosure) & (e < n)


def classes_of(found: DataFrame) -> DataFrame:
    """A stored table (row, class, e): for each row, the classes of its entities, and how many rows hold them. ``found``: stored rows (row, entities)."""
    held = found.where("size(entities) > 0").select("row", F.explode("entities").alias("entity"))
    # the rows of an entity by two hashes of 64 bits
    same = [F.bit_xor(F.xxhash64("row", F.lit(i))).cast("string").alias(f"same{i}") for i in (1, 2)]
    entities = cut(held.groupBy("entity").agg(F.count("*").alias("e"), *same).select("entity", "e", F.concat_ws(":", F.col("e").cast("string"), "same1", "same2").alias("class")))
    return cut(split_join(held, entities, "entity", "row").select("row", "class", "e").distinct())


def disclosing_terms(found: DataFrame, classes: DataFrame, docs: DataFrame, disclosure: float) -> DataFrame:
    """(class, term) over the threshold. ``found``: the stored rows with entities (row, text, base); ``docs``: all documents, for the terms' counts."""
    n = docs.count()
    asked = classes.groupBy("row").agg(F.collect_list(F.struct("class", "e")).alias("classes"))
    both = found.select("row", _between(F.col("text"), F.col("base")).alias("text")).join(asked, "row").select("classes", F.explode(_terms(F.col("text"))).alias("term")).select(F.explode("classes").alias("c"), "term")
    both = both.groupBy("c.class", "c.e", "term").agg(F.count("*").alias("et"))
    both = cut(both.where(_disclosed(F.col("et"), F.col("e"), F.col("et"), n, disclosure)))  # the term would be nowhere else
    terms = cut(both.select("term").distinct())
    counts = docs.where("text is not null").select(F.explode(_terms(F.col("text"))).alias("term"))
    if terms.count() <= BROADCAST_ROWS:
        counts = counts.join(F.broadcast(terms), "term", "left_semi")
    counts = counts.groupBy("term").agg(F.count("*").alias("t"))
    # a term is in a base span's text as well: at least as often as beside them
    told = cut(split_join(both, cut(counts), "term", "class").where(_disclosed(F.col("et"), F.col("e"), F.greatest("t", "et"), n, disclosure)).select("class", "term"))
    drop(both, terms)
    return told


def find_spans(docs: DataFrame, disclosure: float = DISCLOSURE, text: bool = False) -> DataFrame:
    """documents -> one row per row: doc_id, base and all (arrays of start, kind, end, value), and the text if asked for.

    Null and empty texts have no spans, texts of any length are searched whole. Rows that repeat an id or a text are searched, and
    count as documents, each for themselves; an empty table gives no rows, and further columns are ignored.
    """
    base = docs.select("doc_id", "text", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    entities = F.array_distinct(F.transform("base", _entity))
    found = base.withColumns({"entities": entities, "row": F.monotonically_increasing_id()})
    # only texts that hold an entity are needed again
    found = cut(found if text else found.withColumn("text", F.when(F.size("entities") > 0, F.col("text"))))
    classes = classes_of(found)
    told = disclosing_terms(found.where("size(entities) > 0"), classes, docs, disclosure)
    marked = split_join(classes, told.groupBy("class").agg(F.collect_set("term").alias("terms")), "class", "row")
    marked = cut(marked.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))
    shown = ["doc_id", "base", "all"] + ["text"] * text

    def with_terms(terms: Column) -> Column:
        def free(value: Column, start: Column, end: Column) -> Column:
            return F.array_contains(terms, F.lower(value)) & ~F.exists("base", lambda b: (b["start"] < end) & (start < b["end"]))

        return F.array_sort(F.concat("base", _located(F.col("text"), WORD, TERM, free)))

    more = found.where("size(entities) > 0").join(marked, "row").withColumn("all", _once(F.array_intersect(_terms(F.col("text")), "terms"), with_terms))
    rest = found.join(marked.select("row"), "row", "left_anti").withColumn("all", F.col("base"))
    return rest.select(*shown).unionByName(more.select(*shown))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """documents -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: see find_spans; spans are kind:start:end by start, then kind."""
    found = find_spans(docs, disclosure)
    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    extra = (F.size("all") - F.size("base")).cast("long").alias("n_term")
    return found.select("doc_id", *counts, F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("all")).alias("spans"), extra)


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """documents -> doc_id, text with every span replaced by its kind in brackets; of spans that overlap, the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])

    def step(acc: Column, s: Column) -> Column:
        upto = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], upto, F.get(names, s["kind"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("all", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return find_spans(docs, disclosure, text=True).select("doc_id", clean.alias("text"))
