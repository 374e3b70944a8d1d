"""Spelling variants, token counts and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from talefold.llm import prefix_trie, radix_tree, spelling, token_counts
from talefold.llm.places import tokenizer
from talefold.llm.scratch import cut

from .common import documents, hard_rows


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    met = {a: [b for b in n if near(a, b)] for a in n}
    best = {a: min(bs, key=lambda b: (-n[b], b), default=None) for a, bs in met.items()}
    form = {a: b if b and n[b] >= 10 * n[a] else None for a, b in best.items()}

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return {(a, form[a], root(a), n[a], len(met[a]), n[form[a]] if form[a] else None) for a in n}


def test_near_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(500)})
    q, w = spelling.near_words(words, words[:301], block=100)
    assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words[:301]) if near(a, b)]
    long_ = "ab" * 5000
    q, w = spelling.near_words([long_], [long_, long_[1:], long_ + "b", long_[:700] + "c" + long_[701:], long_[2:], "b" + long_[1:-1]])
    assert w.tolist() == [1, 2, 3]


@pytest.mark.parametrize("sizes", [{}, {"rows": 5}, {"rows": 64}, {"letters": 100}])
def test_variants(spark, sizes):
    rng = random.Random(2)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))): rng.choice([2, 3, 20, 25, 300, 4000]) for _ in range(400)}
    n |= {"x" * k: 10 ** (12 - k) for k in range(7, 12)}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), **sizes).collect()
    assert len(got) == len(n) and set(map(tuple, got)) == brute_variants(n)


def test_vocabulary(spark):
    rows = [*hard_rows(), (30, "Straße ÄRGERNIS Ärgernis ärgernis x" * 40), (31, "y" * 5000 + " " + "y" * 5000), (None, "counted counted"), (None, None)]
    rows += [(i, "mistaken " * 3 + "Wörterbücher×÷Ÿabc") for i in range(100, 140)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r.word: r.n for r in spelling.vocabulary(documents(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert spelling.variants(spelling.vocabulary(documents(spark, []))).collect() == []


def messy(rng, n):
    return "".join(rng.choice(["a", "the ", "it's", "'re", "'", "  ", "\n", " \n ", "12", "é", "漢", "\U0001f600", "<|endoftext|>", "<|endof", "!!", "x" * 40, " " * 30, "-", "ll", "ve "]) for _ in range(n))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer()[0])


@pytest.mark.parametrize(("step", "overlap"), [(64, 24), (200, 50), (32_768, 1_024)])
def test_token_counts(spark, step, overlap):
    """Chunks of a few words, words far longer than an overlap, and special strings on every border."""
    rng = random.Random(3)
    rows = [r for r in hard_rows() if r[0] not in (13, 14) or step > 1000]
    rows += [(100 + i, messy(rng, rng.randint(0, 200))) for i in range(60)]
    rows += [(200, "x" * 3000), (201, " " * 2000), (202, "ab" * 300 + " " + "cd " * 300), (203, "<|endoftext|>" * 100), (204, "z" * 700 + " word " * 200 + "y" * 900), (None, "null id " * 100)]
    plain, want = library(), Counter()
    for i, t in rows:
        n = len(plain.encode(t or "", add_special_tokens=False))
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert Counter(map(tuple, token_counts.token_counts(documents(spark, rows), *tokenizer(), step=step, overlap=overlap).collect())) == want
    assert token_counts.token_counts(documents(spark, []), *tokenizer(), step=step, overlap=overlap).collect() == []


def test_spliced_ids(spark):
    rng = random.Random(4)
    texts = {i: messy(rng, 300) for i in range(20)} | {20: "w" * 999, 21: ""}
    written = cut(token_counts.chunks(documents(spark, list(texts.items())), 64, 24))
    rows = token_counts.spliced(written, tokenizer()[0], 24, True).join(written.where("k = 0").select("text_key", "doc_id"), "text_key").collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.begin):
        assert len(r.ids) == r.n_tokens
        got[r.doc_id] += r.ids
    plain = library()
    assert dict(got) == {i: plain.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_radix_tree():
    rng = random.Random(5)
    keys = sorted({bytes(rng.choice((0, 1, 2, 255) if i % 3 else range(256)) for i in range(rng.randint(0, 9))) for _ in range(3000)})
    keys = list({*keys, *(bytes([7, b]) for b in range(30))})
    rng.shuffle(keys)
    found, layouts = {}, Counter()
    open_ = [(radix_tree.build(keys), b"")]
    while open_:
        node, above = open_.pop()
        here = above + node.shared
        if node.value is not None:
            found[here] = node.value
        kids = list(node)
        layouts[type(node.below).__name__] += 1
        assert len(kids) != 1 or node.value is not None
        open_ += [(kid, here + bytes([b])) for b in range(256) if node.below and (kid := node.below.get(b))]
    assert found == {k: i for i, k in enumerate(keys)}
    assert set(layouts) == {"NoneType", "Sorted", "Indexed", "Full"}


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = (*said.get(c - c % 5, [])[:h], *v[h:])
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if rebuilt[c] == p))) for p, m in members.items()}
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("sizes", [{}, {"most": 300, "least": 100}, {"most": 40, "least": 40}])
def test_trie(spark, sizes, monkeypatch):
    """Nodes inside and across ranges, hot beginnings and copies, conversations without turns and long ones."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rng, rows = random.Random(6), []
    for c in range(100):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["hi", None, "", "ünï"]) if c % 2 else f"same {t}"))
    rows += [(200, None, None, None), (201, 0, "u", "x"), (203, 0, "u", "x"), (300, 0, "u", "x"), (None, 0, "u", "x"), (201, None, "u", "first")]
    rows += [(400 + i, t, "user", f"hot {t}") for i in range(60) for t in range(10)] + [(500, t, "u", f"long {t % 7}") for t in range(300)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    convs = prefix_trie.regrouped(prefix_trie.sequences(table))
    assert Counter(map(tuple, prefix_trie.trie(convs, **sizes).collect())) == brute_trie(rows)
    assert prefix_trie.trie(prefix_trie.regrouped(prefix_trie.sequences(table.limit(0))), **sizes).collect() == []
