"""Personal data by patterns, and information-theoretic sanitisation.  DataFrame and SQL functions only.

Base spans are four kinds of strings (email, ip, card, phone), found leftmost and without
overlap per kind; offsets are code points, end exclusive.  A text is split at the matches
of a pattern, and the lengths of matches and of the pieces between them give the offsets.
The patterns are written so that none backtracks over more than a run of its own
characters, and no group repeats without bound, so very long texts cost linear time.

The method: every distinct value found is a protected entity, and so is the part of it that
others share (``PARTS``): a mail's domain, the network of an address, a card's issuer, the
exchange of a phone number.  Entities and the terms
around them (``NEAR`` words on either side of a base span) are counted over all distinct texts,
as are the distinct texts that hold each such term.  A term discloses an entity as far as its
pointwise mutual information with it goes; where that reaches ``ALPHA`` times the entity's
own information content, with at least ``SUPPORT`` different contexts behind it, the
term is removed (kind ``term``) wherever it stands in a document that holds the entity.
All counts are of texts, and copies of one text count once in each of them; contexts that are
equal word by word count once towards ``SUPPORT``, so near copies disclose nothing new.

Edge cases: a null text counts as empty and has no spans (the digest is that of the empty
string); repeated rows each get a row; texts without a match keep all terms; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
NEAR = 8
#: What stands for the recurring part of a value of each kind.
PARTS = {"email": "domain", "ip": "network", "card": "issuer", "phone": "exchange"}
ALPHA = 0.8
SUPPORT = 3
#: Elements of an array, or characters of a text, that are gone through together.
RUN, PIECE = 256, 1024
#: Stands for a separator between characters that belong to one match; native ones become ``#`` first, which no pattern takes.
JOIN = "\ue000"

#: The base patterns, each behind a test that the match can start here.
_LOCAL = f"A-Za-z0-9._%+{JOIN}-"
_LABEL = f"A-Za-z0-9{JOIN}-"
EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{JOIN}[{_LABEL}]++"
IP = "(?=[0-9])(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = f"(?=[0-9])(?<![0-9{JOIN}])[0-9][0-9{JOIN}]++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
WORD = "[^\\x20\\x09-\\x0D]+"
LETTERS = "\\p{L}{4,}"


def running(values: Column, merge, zero: Column) -> Column:
    """For each value, all before it merged: in runs of ``RUN``, so that no array grows element by element beyond that."""
    runs = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(values) - 1, F.lit(RUN)).cast("int")), lambda i: F.slice(values, i * RUN + 1, F.lit(RUN)))).otherwise(F.array(F.array().cast("array<int>")))
    grow = lambda xs, start: F.aggregate(
        xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"],
    )
    totals = F.transform(runs, lambda r: F.aggregate(r, zero, merge))
    return F.flatten(F.zip_with(runs, grow(totals, zero), grow))


def spans_of(text: Column, pattern: str | Column) -> Column:
    """``array<struct<s, e, v>>``: code point offsets and text of every match, in order."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.call_function("split", text, pattern, F.lit(-1)), F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m))
    ends = F.zip_with(steps, running(steps, lambda a, x: a + x, F.lit(0)), lambda x, before: before + x)
    empty = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    return F.when(F.size(found) > 0, F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("v")))).otherwise(empty)


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` on (0-based, both within the text), without a walk from the text's beginning."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((start + length) / PIECE).cast("int")
    return F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, length)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubles every second digit from the right; at most 19 digits come here."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, failing matches dropped."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    plain = F.translate(text, JOIN, "#")
    dotted = F.regexp_replace(plain, "(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])", JOIN)
    email = F.when(F.contains(text, F.lit("@")), spans_of(dotted, EMAIL)).otherwise(none)
    email = F.transform(email, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lower(F.translate(m["v"], JOIN, ".")).alias("v")))
    ip = F.when(text.rlike("[0-9]\\.[0-9]"), spans_of(text, IP)).otherwise(none)
    ip = F.filter(ip, lambda m: m["v"].rlike("^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\\.|$)){4}$"))
    joined = F.regexp_replace(plain, "(?<=[0-9])[\\x20-](?=[0-9])", JOIN)
    # 13 digits are needed: texts without a chain of them are not split
    card = F.when(joined.rlike(f"[0-9{JOIN}]{{13}}"), spans_of(joined, CARD)).otherwise(none)
    card = F.transform(card, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.translate(m["v"], JOIN, "").alias("v")))
    card = F.filter(card, lambda m: F.when(F.length(m["v"]).between(13, 19), _luhn(m["v"])).otherwise(False))
    phone = F.when(text.rlike("\\+[0-9]"), spans_of(text, PHONE)).otherwise(none)
    phone = F.transform(phone, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), _digits(m["v"]).alias("v")))
    phone = F.filter(phone, lambda m: F.length(m["v"]).between(9, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["s"].cast("string"), m["e"].cast("string")))


def _part(kind: str, value: Column) -> Column:
    """The domain; the first two of four numbers; the first six digits; all but the last four."""
    return {
        "email": lambda: F.substring_index(value, "@", -1), "ip": lambda: F.substring_index(value, ".", 2),
        "card": lambda: F.substring(value, 1, 6), "phone": lambda: F.substr(value, F.lit(1), F.length(value) - 4),
    }[kind]()


def _entity_spans(kind: str) -> Column:
    """Each span twice: as the value itself, and as its recurring part."""
    entity = lambda m, name, value: F.struct(F.concat(F.lit(name + ":"), value).alias("entity"), m["s"].alias("s"), m["e"].alias("e"))
    return F.flatten(F.transform(kind, lambda m: F.array(entity(m, kind, m["v"]), entity(m, PARTS[kind], _part(kind, m["v"])))))


def term_of(word: Column) -> Column:
    """A term is a word of four letters or more, lower-cased, without marks at its ends."""
    return F.regexp_extract(F.lower(word), "^[^\\p{L}]*([\\p{L}]{4,})[^\\p{L}]*$", 1)


def find_base(docs: DataFrame) -> DataFrame:
    """``doc_id, key, email, ip, card, phone, text``: ``key`` tells texts with one doc_id apart, ``text`` is null where there is no span."""
    text = shared.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    any_ = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    return spans.select("doc_id", F.xxhash64("text").alias("key"), *KINDS, F.when(any_, F.col("text")).alias("text"))


def disclosing_terms(holders: DataFrame, docs: DataFrame, near: int, alpha: float, support: int) -> DataFrame:
    """``entity, term`` above the threshold.  ``holders``: rows of documents with base spans."""
    begin, end = F.col("span.s"), F.col("span.e")
    spans = F.concat(*map(_entity_spans, KINDS))
    size = F.col("length")
    each = holders.select("key", F.length("text").alias("length"), pieces_of(F.col("text")).alias("pieces"), spans.alias("spans")).select("key", "length", "pieces", F.explode("spans").alias("span"))
    tail = lambda words: F.slice(words, F.greatest(F.size(words) - near + 1, F.lit(1)), F.lit(near))
    words = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    before = lambda reach: words(cut(F.col("pieces"), F.greatest(begin - reach, F.lit(0)), F.least(begin, reach)))
    after = lambda reach: words(cut(F.col("pieces"), end, F.least(reach, size - end)))
    # the words, not the characters, are the window: where those nearest do not hold near whole words, more are split, at last the whole text
    reaches = [F.lit(24 * near), F.lit(768 * near), size]
    each = each.select("*", before(reaches[0]).alias("before"), after(reaches[0]).alias("after"))
    for reach, wider in zip(reaches, reaches[1:]):
        each = each.withColumns({
            "before": F.when((F.size("before") > near) | (begin <= reach), F.col("before")).otherwise(before(wider)),
            "after": F.when((F.size("after") > near) | (end + reach >= size), F.col("after")).otherwise(after(wider)),
        })
    context = F.concat(tail(F.col("before")), F.slice("after", F.lit(1), F.lit(near)))
    terms = F.filter(F.array_distinct(F.transform(context, term_of)), lambda t: t != "")
    contexts = each.select(F.col("span.entity").alias("entity"), "key", F.xxhash64(context).alias("context"), terms.alias("terms"))
    contexts = contexts.groupBy("entity", "key", "context").agg(F.first("terms").alias("terms"))
    contexts = shared.materialise(contexts, "pii-contexts")
    pairs = contexts.select("entity", "key", "context", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count_distinct("key").alias("n_both"), F.count_distinct("context").alias("n_contexts"))
    pairs = shared.materialise(pairs.where(F.col("n_contexts") >= support), "entity-terms")
    entities = contexts.groupBy("entity").agg(F.count_distinct("key").alias("n_entity"))
    # all terms of distinct texts are counted and written, with counts combined before they are moved; each text also counts under ""
    texts = docs.select(shared.text_or_empty().alias("text")).distinct()
    seen = texts.select(F.explode(F.array_union(F.transform(words(F.col("text")), term_of), F.array(F.lit("")))).alias("term"))
    counts = shared.materialise(seen.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "term-counts")
    found = counts.where("term = ''").first()
    total = found["n_term"] if found else 0
    information = -F.log2(F.col("n_entity") / F.lit(float(max(total, 1))))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    return pairs.join(entities, "entity").join(counts, "term").where((information > 0) & (pmi >= alpha * information)).select("entity", "term")


def find(docs: DataFrame, near: int = NEAR, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, key`` for every row."""
    found = shared.materialise(find_base(docs), "pii-spans")
    holders = found.where("text is not null")
    risky = disclosing_terms(holders, docs, near, alpha, support)

    entities = F.transform(F.concat(*map(_entity_spans, KINDS)), lambda m: m["entity"])
    # an entity's terms travel as one list, so that a frequent entity makes one row a document
    lists = risky.groupBy("entity").agg(F.collect_set("term").alias("risky"))
    here = holders.select("doc_id", "key", F.explode(F.array_distinct(entities)).alias("entity")).join(lists, "entity")
    terms = here.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("risky"))).alias("terms"))
    marked = terms.join(holders.dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "text"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    # the text's own words that are among the terms, so that each word is looked up in these few
    marked = marked.withColumn("words", spans_of(F.col("text"), LETTERS)).withColumn("terms", F.array_intersect(F.transform("words", lambda m: F.lower(m["v"])), "terms"))
    marked = marked.select("doc_id", "key", _joined("term", F.filter("words", lambda m: F.array_contains("terms", F.lower(m["v"])))).alias("term_spans"))
    marked = shared.materialise(marked, "pii-terms")

    base = F.concat(*[_joined(k, F.col(k)) for k in KINDS])
    rows = found.select("doc_id", "key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"))
    right = marked.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "term_spans")
    out = rows.join(right, rows["doc_id"].eqNullSafe(right["d"]) & (rows["key"] == right["k"]), "left")
    term_spans = F.coalesce("term_spans", F.expr("cast(array() as array<string>)"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join(F.concat("base", term_spans), ",").alias("spans"), F.size(term_spans).cast("long").alias("n_terms"), "key")


def generalise(docs: DataFrame, near: int = NEAR, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``doc_id, text`` with base spans generalised to their kind in brackets and disclosing terms removed.

    Overlapping spans are cut from the left: the first to start stands, the rest of a later one is removed.
    """
    text = shared.text_or_empty()
    spans = find(docs, near, alpha, support).where("spans <> ''").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans").dropDuplicates(["d", "k"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    parts = F.transform(F.split("spans", ","), lambda x: F.split(x, ":"))
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(F.get(p, F.lit(1)).cast("int").alias("s"), F.get(p, F.lit(2)).cast("int").alias("e"), F.get(p, F.lit(0)).alias("k"))))
    rows = rows.withColumn("ordered", ordered).withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces_of(F.col("text"))))
    ends = F.transform("ordered", lambda x: x["e"])
    done = F.zip_with("ordered", running(ends, lambda a, x: F.greatest(a, x), F.lit(0)), lambda x, at: F.concat(
        F.when(x["s"] > at, cut(F.col("pieces"), at, x["s"] - at)).otherwise(""),
        F.when((x["k"] == "term") | (x["s"] < at), "").otherwise(F.concat(F.lit("["), x["k"], F.lit("]"))),
    ))
    last = F.array_max(ends)
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(done, ""), cut(F.col("pieces"), last, F.length("text") - last))).alias("text"))
