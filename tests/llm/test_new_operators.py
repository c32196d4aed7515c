"""Sanitisation, ranked search and the conversation trie against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradeloom.llm import conversation_trie, lexical_search, sanitiser
from gradeloom.llm import queries as Q

DOC = "doc_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# sanitisation

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return ",".join(f"{sanitiser.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def plain_judgement(docs):
    """By doc: spans of patterns and of disclosing terms."""
    texts = [t or "" for _, t in docs]
    base = [plain_spans(t) for t in texts]
    words = []
    for t, spans in zip(texts, base):
        words.append([(m.start(), m.end(), low(m.group())) for m in TERM.finditer(t) if not any(m.start() < b and a < m.end() for a, _, b in spans)])
    every = [{low(x) for x in TERM.findall(t)} for t in texts]
    every = [ws | {w[:4] + "*" for w in ws if len(w) > 4} for ws in every]
    n = Counter(w for ws in every for w in ws)
    who = lambda k, v: (k, low(v) if k < 2 else re.sub("[^0-9]", "", v))
    entities = Counter(e for t, spans in zip(texts, base) for e in {who(k, t[a:b]) for a, k, b in spans})
    both, kinds = Counter(), defaultdict(set)
    for t, spans, own in zip(texts, base, words):
        pairs = set()
        for a, k, b in spans:
            before = [w for w in own if w[0] < a][-50:]
            after = [w for w in own if w[0] >= a][:50]
            pairs |= {(who(k, t[a:b]), x) for _, _, w in before + after for x in ([w, w[:4] + "*"] if len(w) > 4 else [w])}
        for p in pairs:
            both[p] += 1
            kinds[p].add(t)
    bad = {w for (e, w), c in both.items() if len(kinds[e, w]) >= 3 and 2 * c >= n[w] and c * len(docs) >= 2 * n[w] * entities[e]}
    return [(d, sum(s[1] == 0 for s in b), sum(s[1] == 1 for s in b), sum(s[1] == 2 for s in b), sum(s[1] == 3 for s in b), hashlib.sha256(digest(b).encode()).hexdigest(), digest(sorted(b + [(x, 4, y) for x, y, w in ws if w in bad])), sum(w in bad for *_, w in ws)) for (d, _), b, ws in zip(docs, base, words)], bad


COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def private_docs():
    rng = random.Random(8)
    vocabulary = [f"w{k}x" for k in range(300)]
    docs = []
    for k in range(160):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(5, 160))]
        if k % 4 == 0:
            ws.insert(rng.randint(0, len(ws)), ("Ann.Lee@mail.example.com", "ann.lee@Mail.example.com")[k % 8 == 0])
            ws.insert(rng.randint(0, len(ws)), "Zorblax")
        if k % 10 == 1:
            ws.insert(len(ws) // 2, "+1 (212) 555-0199 grumbling" + ("" if k % 3 else " 4539 1488 0343 6467"))
        if k % 40 == 7:
            ws.append("zorblax")
        docs.append((k, " ".join(ws)))
    return docs + [(500, docs[0][1]), (500, docs[0][1]), (None, docs[1][1]), (501, None), (502, ""), (503, "solo@x.y.org quixotic"), *[(600 + k, "same@x.org copyword") for k in range(5)]]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    alphabet = ["a", "Z", "9", "0", "25", ".", ".", "@", "@", "-", " ", "+", "+1", "(", ")", "255", "256", "é", "_", "%", "٣", "4539148803436467", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
        assert sanitiser.base_spans(text) == plain_spans(text), text
    for text in ("a" * 300_000 + "@", "1" * 300_000 + ".", "1.1" * 100_000, "@a" * 100_000, "+1" + " " * 200_000, "a@b." * 50_000, "1 " * 200_000):  # no time that grows with the square
        sanitiser.base_spans(text)


@pytest.mark.parametrize("in_memory", [10**6, 0])
def test_sanitiser_equals_a_plain_version(spark, monkeypatch, in_memory):
    monkeypatch.setattr(sanitiser, "TERMS_IN_MEMORY", in_memory)
    docs = private_docs()
    want, bad = plain_judgement(docs)
    assert {"zorblax", "grumbling"} <= bad and not {"copyword", "quixotic"} & bad
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], DOC + ", spans string").repartition(3)
    assert rows(sanitiser.judge(df), *COLUMNS) == sorted(want, key=repr)
    assert sanitiser.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("in_memory", [10**6, 0])
def test_sanitised_texts_hold_no_entity(spark, monkeypatch, in_memory):
    monkeypatch.setattr(sanitiser, "TERMS_IN_MEMORY", in_memory)
    docs = [(k, t) for k, t in private_docs() if k is not None]
    _, bad = plain_judgement(private_docs())
    out = dict(map(tuple, sanitiser.sanitised(spark.createDataFrame(private_docs(), DOC)).where("doc_id is not null").collect()))
    assert out[501] is None and out[502] == "" and len(out) == len({k for k, _ in docs})
    for k, text in docs:
        if text:
            assert not plain_spans(out[k])
            assert "zorblax" not in low(out[k]) and "grumbling" not in out[k]
    assert ("zorb*" in bad) == ("zorb*" not in out[0])
    assert "[email]" in out[0] and "[phone]" in out[1]


# ranked search


def plain_search(docs, items, k=50):
    terms = [TERM.findall(low(t or "")) for _, t in docs]
    n, length = sum(1 for t in terms if t), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(x for c in counts for x in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(low(t or "")))
    out = []
    for i, own in asked.items():
        found = []
        for (d, _), c, ts in zip(docs, counts, terms):
            if ts:
                m = 50 + 50 * len(ts) * n // length
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in own if c[x])
                if s > 0:
                    found.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def search_case(seed, n=400):
    rng = random.Random(seed)
    words = [f"t{k}" for k in range(40)] + ["Été", "naïve", "x—y", "A", "a"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(rng.choice([k, k // 2, k]), " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for k in range(n)]
    docs += [(1000 + k, docs[3][1]) for k in range(200)] + [(None, docs[3][1]), (7, None), (8, "..."), (9, "\x00 \x7f"), (2000, "t1 " * 5000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(12)] + [(3, "t1 t2"), (None, "t5 Été"), (None, "T7"), (50, None), (51, "!"), (52, "absent"), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("entries, leaf, pairs", [(3_000_000, 24, 200_000), (150, 2, 20), (1, 1, 1)])
def test_search_equals_a_plain_version(spark, monkeypatch, entries, leaf, pairs):
    for name, value in (("TREE_ENTRIES", entries), ("LEAF", leaf), ("BLOCK_TERMS", max(pairs, 20))):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = search_case(entries, 400 if entries > 1 else 30)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], DOC + ", item_id int, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    assert rows(lexical_search.search(df, asked), "item_id", "rank", "doc_id", "score") == plain_search(docs, items)
    if entries == 1:
        assert lexical_search.search(df.limit(0), asked).count() == 0
        assert lexical_search.search(df, asked.limit(0)).count() == 0


def test_trees_hold_every_vector(monkeypatch):
    rng = random.Random(3)
    for _ in range(40):
        monkeypatch.setattr(lexical_search, "LEAF", rng.choice([1, 2, 5, 24]))
        wide, n = rng.randint(3, 30), rng.randint(1, 300)
        docs = []
        for _ in range(n):
            if docs and rng.random() < 0.3:
                docs.append(rng.choice(docs))
                continue
            r = np.array(sorted(rng.sample(range(wide), rng.randint(1, wide))), dtype=np.int64)
            docs.append((r, np.array([rng.randint(1, 4) for _ in r], dtype=np.int64), rng.randint(50, 200)))
        places = rng.sample(range(n), n)
        tree = lexical_search.Tree([d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], places)
        for _ in range(5):
            weight = np.zeros(wide, dtype=np.int64)
            for x in rng.sample(range(wide), rng.randint(1, min(wide, 6))):
                weight[x] = rng.randint(0, 50)
            best = []
            tree.search(weight, best, 10)
            scores = [(sum(int(weight[a]) * (10**9 * int(b) // (1000 * int(b) + 20 * m)) for a, b in zip(r, f)), -p) for (r, f, m), p in zip(docs, places)]
            assert sorted(best, reverse=True) == sorted((s for s in scores if s[0] > 0), reverse=True)[:10]


# conversation trie


def plain_trie(turns):
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(xs)] for c, xs in convs.items()}
    built = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + xs[h:]
    members = defaultdict(list)
    for c, xs in built.items():
        for d in range(len(xs) + 1):
            members[tuple(xs[:d])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for seq in members:
        if seq:
            children[seq[:-1]] += 1
    for seq, cs in members.items():
        gain = (len(cs) - 1) * len(seq[-1][1].encode()) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += gain
            leaves[seq[:d]] += not children[seq]
    out = []
    for seq, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(seq))))
        out.append((min(cs), len(seq), min(members[seq[:-1]]) if seq else None, len(cs), children[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def trie_case(seed):
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(0, 400), 150):
        same = rng.random() < 0.5
        for t in range(rng.randint(1, 12)):
            turns.append((c, t, rng.choice(["user", "user", None, ""]) if not same else "user", f"é{t}" if same else rng.choice(["a", "b", None, "", "long " * 9])))
    turns += [(500 + k, 0, "user", "é0") for k in range(60)] + [(700, None, "x", "first"), (700, 3, "x", "b"), (700, 3, "x", "a"), (700, 3, "x", "a"), (None, 1, "a", "b"), (-3, 1, "u", "v"), (-7, 1, "u", "v")]
    turns += [(800, t, "user", f"é{t % 7}") for t in range(700)]
    return turns


@pytest.mark.parametrize("block, chunk", [(500_000, 512), (40, 3), (1, 1)])
def test_trie_equals_a_plain_version(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(conversation_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(conversation_trie, "CHUNK_IDS", chunk)
    turns = trie_case(block)
    df = spark.createDataFrame([(*t, 1, "k") for t in turns], TURNS + ", depth int, key string").repartition(3)
    assert rows(conversation_trie.prefix_trie(df), *TRIE) == plain_trie(turns)
    if block == 1:
        assert conversation_trie.prefix_trie(df.limit(0)).count() == 0


def test_parentheses_close_where_they_should():
    rng = random.Random(1)
    for _ in range(300):
        opens, depth, left = [], 0, rng.randint(1, 80)
        while left or depth:
            new = bool(left) and (depth == 0 or rng.random() < 0.5)
            opens.append(new)
            depth += 1 if new else -1
            left -= new
        places = np.flatnonzero(opens)
        for p, q in zip(places.tolist(), conversation_trie.find_close(np.array(opens), places).tolist()):
            excess = np.cumsum(np.where(opens[p:], 1, -1))
            assert q == p + int(np.flatnonzero(excess == 0)[0])


def test_sanitiser_query_equals_a_plain_version(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in Q.table(spark, sf, "documents").collect()]
    assert rows(Q.op11_sanitiser(spark, sf), *COLUMNS) == sorted(plain_judgement(docs)[0], key=repr)
