"""Information-theoretic sanitisation of personal data.

Protected entities are what fixed patterns find: e-mail addresses, IP addresses,
payment cards and telephone numbers, each by its plain value. Terms near them may
give them away as well. How much a term t tells of an entity e is estimated from
the whole corpus: with D documents, n(t) of them with t, n(e) with e, and n(t, e)
with t within WINDOW words of e,

    IC(e) = log2(D / n(e))              the entity's information
    PMI(t; e) = log2(n(t, e) D / (n(t) n(e)))    what t tells of it

t discloses e if t leaves at most one bit of the entity, IC(e) - PMI(t; e) <= 1,
tells at least one bit, PMI(t; e) >= 1, and they meet in at least SUPPORT
documents of different texts, so that copies alone prove nothing. In whole numbers: 2 n(t, e) >= n(t) and
n(t, e) D >= 2 n(t) n(e). A term that discloses any entity is marked wherever it
stands. ``sanitised`` replaces it by its beginning (BEGINNING letters and a star),
which is counted in the same way as a term of its own, where that discloses
nothing, and else removes it.

1. Entities are counted: a row for each entity and document, summed map-side.
2. Where entities occur in at least SUPPORT documents, the terms near them are
   listed by document and pair, at most 2 WINDOW for each mention.
3. Documents of the terms that pass the support are counted. Tasks pick them by
   a bitmap of fixed size, count them map-side, and a join keeps what it let in
   by chance out.
4. Disclosing terms are marked: from memory while there are no more than
   TERMS_IN_MEMORY, else the places of terms that the bitmap lets through join
   them by term, and documents by a hash of their text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 50  # words to each side
SUPPORT = 3  # documents of different texts
BEGINNING = 4  # letters that a generalised term keeps
TERMS_IN_MEMORY = 1_000_000
BITS = 1 << 24  # of a bitmap that picks terms or entities to look at
COUNTED = 500_000  # distinct terms that a task counts before it passes them on

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(term: str) -> str:
    return term.lower() if term.isascii() else term.translate(ASCII_LOWER)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ so that time stays linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        run = text[done:at]
        start = done + len(run.rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four dotted numbers, left to right; only those whose numbers are at most 255."""
    for chain in DOTTED.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities in a text, in order; kind is its place in KINDS."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        found += [(a, 1, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := only_digits(m.group())) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """The plain value of a mention: letter case, blanks and signs don't matter."""
    return f"{KINDS[kind]}:{lower(value) if kind < 2 else only_digits(value)}"


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the terms that meet no span."""
    whole: list[list[int]] = []  # the spans as intervals apart from each other
    for a, _, b in sorted(spans):
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    k = 0
    for m in TERM.finditer(text):
        while k < len(whole) and whole[k][1] <= m.start():
            k += 1
        if k == len(whole) or m.end() <= whole[k][0]:
            yield m.start(), m.end(), lower(m.group())


def number(name: str) -> int:
    """The hash that stands for a term or an entity, as a signed long."""
    h = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def beginning(term: str) -> str | None:
    """What a term is generalised to; None if it is too short for that."""
    return term[:BEGINNING] + "*" if len(term) > BEGINNING else None


def text_hash(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def bitmap(numbers: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with those of the column ``number`` set, whatever their count."""
    place = F.pmod("number", F.lit(BITS))
    words = numbers.select(F.floor(place / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(number, 64) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(BITS // 64, dtype=np.uint64)
    marks[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return marks


def marked(marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers.astype(np.int64) & (BITS - 1)
    return (marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def texts_of(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run(text) -> rows`` over every text (null: empty), as a table of ``schema``."""
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0):
                rows += run(text.as_py() or "")
                if len(rows) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return docs.select("text").mapInArrow(scan, schema)


def entity_counts(docs: DataFrame) -> DataFrame:
    """(number, n): documents of each entity."""

    def run(text: str) -> list[tuple[int]]:
        return [(number(e),) for e in {entity(k, text[a:b]) for a, k, b in base_spans(text)}]

    return texts_of(docs, run, "number long").groupBy("number").agg(F.count("*").alias("n"))


def near_terms(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(entity, term, text, n): documents by text in which a term, or a beginning, stands within WINDOW words of an entity in ``marks``."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(text: str) -> list[tuple]:
        spans = base_spans(text)
        own = [(a, b, number(entity(k, text[a:b]))) for a, k, b in spans]
        if not own:
            return []
        kept = marked(shared.value, np.array([e for *_, e in own], dtype=np.int64))
        if not kept.any():
            return []
        terms = list(outside(text, spans))
        starts = np.array([t[0] for t in terms])
        numbers = [number(t[2]) for t in terms]
        wide = [number(g) if (g := beginning(t[2])) else None for t in terms]
        pairs: set[tuple[int, int]] = set()
        for (a, _, e), keep in zip(own, kept):
            if keep:
                at = int(np.searchsorted(starts, a))
                lo, hi = max(0, at - WINDOW), at + WINDOW
                pairs.update((e, n) for n in numbers[lo:hi])
                pairs.update((e, n) for n in wide[lo:hi] if n is not None)
        name = text_hash(text)
        return [(e, t, name) for e, t in pairs]

    found = texts_of(docs, run, "entity long, term long, text binary")
    return found.groupBy("entity", "term", "text").agg(F.count("*").alias("n"))


def term_counts(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(term, n): documents of each term or beginning in ``marks``, and by chance of others."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, counts = shared.value, Counter()
        known: dict[str, tuple[int, ...]] = {}  # numbers of a term and its beginning that the bitmap lets through

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                terms = set(TERM.findall(text.as_py() or ""))
                fresh = [t for t in terms if t not in known]
                if fresh:
                    if len(known) > 500_000:
                        known.clear()
                        fresh = list(terms)
                    names = [(number(low := lower(t)), number(g) if (g := beginning(low)) else None) for t in fresh]
                    flat = np.array([n if n is not None else 0 for pair in names for n in pair], dtype=np.int64)
                    for t, pair, keep in zip(fresh, names, marked(marks, flat).reshape(-1, 2).tolist()):
                        known[t] = tuple(n for n, k in zip(pair, keep) if k and n is not None)
                counts.update({n for t in terms for n in known[t]})
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(term): numbers of the terms and beginnings that disclose an entity, written."""
    entities = cut(entity_counts(docs), "pii-entities")
    often = entities.where(F.col("n") >= SUPPORT)
    near = cut(near_terms(docs, bitmap(often)), "pii-near") if often.limit(1).count() else None
    if near is None:
        drop_cut(entities)
        return cut(docs.sparkSession.createDataFrame([], "term long"), "pii-disclosing")
    together = near.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    together = cut(together.join(often.select(F.col("number").alias("entity"), F.col("n").alias("n_entity")), "entity"), "pii-together")
    drop_cut(near)
    counts = term_counts(docs, bitmap(together.select(F.col("term").alias("number"))))
    total = docs.count()
    d = F.lit(total).cast("decimal(20,0)")
    tells = (2 * F.col("both") >= F.col("n")) & (F.col("both") * d >= 2 * F.col("n").cast("decimal(18,0)") * F.col("n_entity"))
    found = cut(together.join(counts, "term").where(tells).select("term").distinct(), "pii-disclosing")
    drop_cut(together)
    drop_cut(entities)
    return found


def spans_digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


BASE = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _base_columns(found: list[list[tuple[int, int, int]]]) -> list[pa.Array]:
    counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
    return [*counts, pa.array([hashlib.sha256(spans_digest(spans).encode()).hexdigest() for spans in found])]


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) per row of ``docs`` (doc_id, text).

    Spans are ``kind:start:end`` in code points, by start and then as kinds are
    listed; base_sha256 is over those of the patterns alone. Terms that disclose
    an entity (see above) have kind ``term``; they never meet a span of a pattern.
    Null texts are empty and have no spans; repeated rows count as documents and
    come out each; an empty table gives no rows; other columns are ignored.
    """
    terms = disclosing(docs)
    number_of_terms = terms.count()
    if number_of_terms <= TERMS_IN_MEMORY:
        return _marked_from_memory(docs, terms)
    return _marked_by_join(docs, terms)


def term_spans(text: str, spans: list[tuple[int, int, int]], known: dict[str, bool], among) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the terms whose numbers ``among`` tells to be wanted; ``known`` remembers its answers."""
    terms = set(TERM.findall(text))
    fresh = [t for t in terms if t not in known]
    if fresh:
        if len(known) > 500_000:
            known.clear()
            fresh = list(terms)
        known.update(zip(fresh, among(np.array([number(lower(t)) for t in fresh], dtype=np.int64)).tolist()))
    if not any(map(known.get, terms)):
        return []
    return [(a, 4, b) for a, b, _ in outside(text, spans) if known[text[a:b]]]


def among_sorted(terms: np.ndarray):
    """A test for membership in a sorted array."""

    def test(numbers: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(terms, numbers), len(terms) - 1)
        return terms[at] == numbers

    return test


def _marked_from_memory(docs: DataFrame, terms: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow().column("term").to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        test = among_sorted(shared.value) if len(shared.value) else None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = [term_spans(t, s, known, test) if test else [] for t, s in zip(texts, base)]
            whole = pa.array([spans_digest(sorted(s + m)) for s, m in zip(base, more)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *_base_columns(base), whole, pa.array([len(m) for m in more], pa.int64())], names=["doc_id", *(f.split()[0] for f in BASE.split(", ")), "n_term"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {BASE}, n_term long")


def _marked_by_join(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The same where terms are too many for a task's memory."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(terms.select(F.col("term").alias("number"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_base_columns(base), pa.array(map(spans_digest, base)), pa.array(map(text_hash, texts), pa.binary())], names=["doc_id", *(f.split()[0] for f in BASE.split(", ")), "hash"])

    def places(text: str) -> list[tuple]:
        found = [(number(t), a, b) for a, b, t in outside(text, base_spans(text))]
        kept = marked(marks.value, np.array([n for n, *_ in found], dtype=np.int64)) if found else []
        return [(text_hash(text), n, a, b) for (n, a, b), keep in zip(found, kept) if keep]

    judged = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {BASE}, hash binary")
    mentions = texts_of(docs, places, "hash binary, term long, start int, end int").distinct().join(terms, "term")
    grouped = mentions.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end"))).alias("more"))
    joined = judged.join(grouped, "hash", "left")
    names = F.array(*map(F.lit, KINDS))
    base = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("start"), (F.array_position(names, F.split_part(x, F.lit(":"), F.lit(1))) - 1).cast("int").alias("kind"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("end")))
    more = F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    whole = F.array_sort(F.concat(base, more))
    text = F.array_join(F.transform(whole, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    columns = [f.split()[0] for f in BASE.split(", ")]
    return joined.withColumns({"spans": text, "n_term": F.size(more).cast("long")}).select("doc_id", *columns, "n_term")


def rewritten(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """``text`` with its entities and ``terms`` (start, end, whether the beginning may stay) replaced."""
    spans = sorted([(a, k, b, False) for a, k, b in base] + [(a, 4, b, wide) for a, b, wide in terms])
    out, at = [], 0
    for a, kind, b, wide in spans:
        if a < at:  # a number that is a card and part of a telephone number, say
            at = max(at, b)
            continue
        out += [text[at:a], f"[{KINDS[kind]}]" if kind < 4 else beginning(lower(text[a:b])) if wide else ""]
        at = b
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with (doc_id, text) made safe: entities become their kind in square brackets, disclosing terms their beginning where that discloses nothing, else nothing.

    A null text stays null; repeated rows come out each; an empty table gives no
    rows; other columns are left out.
    """
    terms = disclosing(docs)
    if terms.count() <= TERMS_IN_MEMORY:
        return _rewritten_from_memory(docs, terms)
    return _rewritten_by_join(docs, terms)


def _rewritten_from_memory(docs: DataFrame, terms: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow().column("term").to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        test = among_sorted(shared.value) if len(shared.value) else None

        def stays(term: str) -> bool:
            wide = beginning(lower(term))
            return wide is not None and not test(np.array([number(wide)]))[0]

        def safe(text: str) -> str:
            base = base_spans(text)
            found = term_spans(text, base, known, test) if test else []
            return rewritten(text, base, [(a, b, stays(text[a:b])) for a, _, b in found])

        for batch in batches:
            texts = [None if t is None else safe(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def _rewritten_by_join(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The same where terms are too many for a task's memory: places join terms, and their beginnings join terms; texts get their places by hash."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(terms.select(F.col("term").alias("number"))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def places(text: str) -> list[tuple]:
        found = [(number(t), number(g) if (g := beginning(t)) else None, a, b) for a, b, t in outside(text, base_spans(text))]
        kept = marked(marks.value, np.array([f[0] for f in found], dtype=np.int64)) if found else []
        return [(text_hash(text), *f) for f, keep in zip(found, kept) if keep]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text_hash(t or "") for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "text", "hash"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else rewritten(t, base_spans(t), [(x["start"], x["end"], x["wide"]) for x in more or ()]) for t, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    found = texts_of(docs, places, "hash binary, term long, beginning long, start int, end int").distinct().join(terms, "term")
    told = found.join(terms.select(F.col("term").alias("beginning"), F.lit(True).alias("tells")), "beginning", "left")
    wide = F.col("beginning").isNotNull() & F.col("tells").isNull()
    grouped = told.groupBy("hash").agg(F.collect_list(F.struct("start", "end", wide.alias("wide"))).alias("more"))
    joined = docs.select("doc_id", "text").mapInArrow(named, f"doc_id {kind}, text string, hash binary").join(grouped, "hash", "left")
    return joined.select("doc_id", "text", "more").mapInArrow(rewrite, f"doc_id {kind}, text string")
