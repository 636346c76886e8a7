"""Personal data: patterns with checks, and terms that give a protected value away by what the corpus says of them."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_or_last, save, text_key

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the four kinds. Possessive repeats and look-behinds keep them linear on any text:
# an address is found from its @, and a number that fails from its first digit fails from every later one.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = regex.compile(r"\p{L}{3,}")

#: Words on each side of a protected value that count as its company.
COMPANY = 10
#: A term is company of a value in at least this many different texts before it is judged.
SUPPORT = 3
#: Share of a value's information that a term may give away.
DISCLOSURE = 0.9
#: Terms are broadcast for counting only up to this many; beyond it the join shuffles.
BROADCAST_TERMS = 200_000


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in (2 * int(d) for d in digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points: leftmost and non-overlapping within each kind, in order of kind and start.

    A match that fails its check (ip parts over 255; card without 13 to 19 digits or with a wrong check digit; phone without 9 to
    15 digits) is dropped and not tried again in another way.
    """
    found, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((0, start, m.end()))
                last = m.end()
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _value(text: str, span: tuple[int, int, int]) -> int:
    """Key of a protected value, however it is written."""
    kind, a, z = span
    said = text[a:z].lower() if kind < 2 else _NOT_DIGIT.sub("", text[a:z])
    return xxhash.xxh64_intdigest(f"{kind}:{said}") - 2**63


def _company(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int]]]:
    """(value, term) of the terms within COMPANY terms of each span, however long they are, and (term, start, end) of all occurrences of such terms in the text.

    Terms within spans are none.
    """
    taken = bytearray(len(text))
    for _, a, z in spans:
        taken[a:z] = b"\1" * (z - a)
    terms = [(text[i:j], i, j) for i, j in (m.span() for m in _TERM.finditer(text)) if not any(taken[i:j])]
    starts, near = [t[1] for t in terms], set()
    for span in spans:
        value, (_, a, z) = _value(text, span), span
        before, after = bisect.bisect_left(starts, a), bisect.bisect_left(starts, z)
        near |= {(value, t[0]) for t in terms[max(0, before - COMPANY) : before] + terms[after : after + COMPANY]}
    asked = {t.lower() for _, t in near}
    return sorted(near), [t for t in terms if t[0].lower() in asked]


_SPAN = "array<struct<kind:int,start:int,end:int>>"
_NEAR = "array<struct<value:long,term:string>>"
_PLACES = "array<struct<term:string,start:int,end:int>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, id, k, base, near, places) of each row: base spans, the terms beside them with the values that they stand by, and where in the text those terms are."""
    place = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("id", pa.int64()), ("k", pa.int64()),
        ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
        ("near", pa.list_(pa.struct([("value", pa.int64()), ("term", pa.string())]))), ("places", place),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, near, places = [], [], []
            for text in b.column("text").to_pylist():
                spans = base_spans(text or "")
                base.append([{"kind": k, "start": a, "end": z} for k, a, z in spans])
                company, at = _company(text, spans) if spans else ([], [])
                near.append([{"value": v, "term": t} for v, t in company])
                places.append([{"term": t, "start": a, "end": z} for t, a, z in at])
            found = [pa.array(v, schema.field(n).type) for n, v in (("base", base), ("near", near), ("places", places))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), b.column("k"), *found], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_or_last().alias("id"), text_key().alias("k"), "text")
    return save(rows.mapInArrow(work, f"doc_id long, id long, k long, base {_SPAN}, near {_NEAR}, places {_PLACES}"), "detected")


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(value, term, strength): terms that give a protected value away, by co-occurrence in the whole corpus.

    With n texts, of which n(v) hold value v, n(t) hold term t and n(v, t) hold t beside v, the term says
    log(n n(v,t) / n(v) n(t)) of the log(n / n(v)) that the value is worth; strength is the quotient, 1 for a term that
    appears only beside the value. Terms beside a value in ``support`` texts or more with a strength of ``disclosure`` or more
    are returned. Texts count once however often they are copied, and n(t) counts every text of the corpus.
    """
    beside = found.where(F.size("near") > 0).select("k", F.explode("near").alias("x")).select("k", F.col("x.value").alias("value"), F.lower("x.term").alias("term")).distinct()
    n = found.agg(F.count_distinct("k").alias("n"))
    values = beside.select("k", "value").distinct().groupBy("value").agg(F.count("*").alias("of_value"))
    around = beside.select("k", "term").distinct().groupBy("term").agg(F.count("*").alias("of_term"))
    worth = F.log(F.col("n") / F.col("of_value"))
    said = F.log(F.col("n") * F.col("both") / (F.col("of_value") * F.greatest("of_term", "both")))
    strength = F.when(worth > 0, said / worth)
    counted = beside.groupBy("value", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support).join(values, "value").crossJoin(F.broadcast(n))  # one row
    # A term is in at least as many texts as it is beside values in: most are out by that alone, before the corpus is counted.
    pairs = save(counted.join(around, "term").where(strength >= disclosure).drop("of_term"), "pairs")
    asked = save(pairs.select("term").distinct(), "asked-terms")
    small = asked.count() <= BROADCAST_TERMS
    texts = docs.select(text_key().alias("k"), F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("term")).withColumn("term", F.lower("term"))
    held = texts.join(F.broadcast(asked) if small else asked, "term", "left_semi").distinct()
    terms = save(held.groupBy("term").agg(F.count("*").alias("of_term")), "term-counts")
    joined = pairs.join(terms, "term", "left").withColumn("of_term", F.coalesce("of_term", "both"))
    return save(joined.withColumn("strength", strength).where(F.col("strength") >= disclosure).select("value", "term", "strength"), "disclosing")


def _added(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, k, added) of the documents with telling terms beside their values: every occurrence of such a term in the document."""
    term = F.lower("x.term").alias("term")
    near = found.where(F.size("near") > 0).select("id", "k", F.explode("near").alias("x")).select("id", "k", F.col("x.value").alias("value"), term)
    telling = near.join(terms.select("value", "term"), ["value", "term"]).select("id", "k", "term").distinct()
    places = found.where(F.size("near") > 0).select("id", "k", F.explode("places").alias("x")).select("id", "k", term, F.struct(F.lit(4).alias("kind"), F.col("x.start").alias("start"), F.col("x.end").alias("end")).alias("span"))
    return save(places.join(telling, ["id", "k", "term"]).groupBy("id", "k").agg(F.array_sort(F.collect_set("span")).alias("added")), "added")


def _said(spans: Column) -> Column:
    named = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Base spans are those of base_spans(); to them the method adds a ``term`` span for each word that stands within COMPANY words of a
    protected value which, as disclosing_terms() says, it gives away, and for that word wherever else it stands in the same document. spans has all of them as kind:start:end,
    comma-joined, in order of kind (email, ip, card, phone, term) and start; base_sha256 is taken of the base ones alone.

    Null and empty texts have no spans. Rows without a doc_id keep null; rows of equal doc_id and text share their
    result. An empty table gives none; other columns are not read.
    """
    found = detect(docs)
    added = _added(found, disclosing_terms(docs, found, support, disclosure))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    out = found.join(added, ["id", "k"], "left").withColumn("added", F.coalesce("added", F.array().cast(_SPAN)))
    return out.select(
        "doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(4)], F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_term"),
    )


def _clean(text: str, spans: str) -> str:
    """``text`` with protected values named by kind, and telling terms generalised: a capitalised word to [name], any other removed."""
    cuts = sorted((int(a), -int(z), kind) for kind, a, z in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, z, kind in cuts:
        if -z <= at:
            continue
        a = max(a, at)
        out += [text[at:a], f"[{kind}]" if kind != "term" else "[name]" if text[a:-z][:1].isupper() else ""]
        at = -z
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text, spans) of each row of ``docs``, its text cleaned by personal_data()'s spans; a null text stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else _clean(t, s or "") for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("spans")], ["doc_id", "text", "spans"])

    found = detect(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_or_last().alias("id"), text_key().alias("k"), "text")
    added = _added(found, disclosing_terms(docs, found, support, disclosure))
    marked = found.where(F.size("base") > 0).dropDuplicates(["id", "k"]).join(added, ["id", "k"], "left")
    spans = marked.select("id", "k", _said(F.concat("base", F.coalesce("added", F.array().cast(_SPAN)))).alias("spans"))
    return rows.join(spans, ["id", "k"], "left").select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, text string, spans string")
