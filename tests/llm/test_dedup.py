import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from talefold.llm import minhash, packing
from talefold.llm.components import components
from talefold.llm.exact_dedup import exact_dedup
from talefold.llm.places import tokenizer
from talefold.llm.suffix_dedup import _rows, digests, place
from talefold.llm.suffix_sort import pairwise, sort_strings

from .common import documents, hard_rows, prose


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2] if len(groups[norm]) > 1 else i
        out.append((i, keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def test_exact(spark):
    rows = hard_rows()
    assert Counter(map(tuple, exact_dedup(documents(spark, rows)).collect())) == brute_exact(rows)
    assert exact_dedup(documents(spark, [])).collect() == []


def test_exact_with_collisions(spark):
    rows = hard_rows()
    got = exact_dedup(documents(spark, rows), hash_of=lambda c: F.substring(F.md5(c), 1, 1))
    assert Counter(map(tuple, got.collect())) == brute_exact(rows)


def brute_near(rows):
    sets = defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] |= {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                x = len(sets[a] & sets[b])
                if a != b and x and 100 * x >= 75 * len(sets[a] | sets[b]) and low[a] > low[b]:
                    low[a], changed = low[b], True
    return Counter((i, len(sets[i]) if i is not None else 36, low.get(i), low.get(i) == i) for i, _ in rows)


def test_near(spark):
    rows = hard_rows()
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept if r.doc_id is not None else r.component_id == r.doc_id) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    want = Counter({(i, n, c, k if i is not None else True): m for (i, n, c, k), m in brute_near(rows).items()})
    assert got == want
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def template(i, own=16, shared=80):
    """Documents of one template, of similarity 0.66 or so, which links none of them."""
    return prose(shared, 9) + " " + prose(own, 1000 + i, 5000)


def test_near_template(spark):
    """Crowded buckets: what doesn't link stays apart, and links of what stands among it are found."""
    rows = [(i, template(i)) for i in range(220)]
    for i in range(0, 220, 20):
        words = rows[i][1].split()
        rows.append((1000 + i, " ".join([*words[:40], f"new{i}", *words[41:]])))
    seen = []
    plain = minhash.crowded_pairs
    minhash.crowded_pairs = lambda *a, **k: seen.append(1) or plain(*a, **k)
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    finally:
        minhash.crowded_pairs = plain
    assert seen and got == {i: low for i, _, low, _ in brute_near(rows)}


def test_crowded_pairs(spark):
    """Every linked pair of different components is a candidate, each once, in small blocks too."""
    docs = spark.createDataFrame([(i, template(i)) for i in range(60)] + [(100 + i, template(i) + " more") for i in range(60)], "doc_id long, text string")
    classes = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isin(0, 1, 2), 0).otherwise(F.col("doc_id")).cast("long").alias("component"))
    block, minhash.BLOCK = minhash.BLOCK, 15
    try:
        got = [tuple(r) for r in minhash.crowded_pairs(classes, docs).collect()]
    finally:
        minhash.BLOCK = block
    assert len(got) == len(set(got)) and {(100 + i, i) for i in range(60)} <= set(got)
    assert all(a > b and a > 2 for a, b in got)


def test_crowded_rows_that_meet(spark, monkeypatch):
    """Joins by id take a row per class and place, not one per finer band; blocks are as many as the classes outside the main component need."""
    taken = []
    frame = type(spark.range(1))
    plain = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how=None: taken.append(self.count() if on == "id" else 0) or plain(self, other, on, how))

    def pairs(texts, component):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        taken.clear()
        # The pairs as the tasks hand them on, before a distinct.
        found = minhash.crowded_pairs(docs.select(F.col("doc_id").alias("id"), component.cast("long").alias("component")), docs)
        handed = [tuple(r) for r in found.collect()]
        assert len(handed) == len(set(handed)) and "deduplicate" not in found._jdf.queryExecution().logical().toString().lower()
        return set(handed)

    # Documents that are alike in a quarter share few of the 200 finer buckets.
    assert pairs([template(i, 60, 60) for i in range(60)], F.col("doc_id")) == set()
    assert sum(taken) < 60 * minhash.FINE_BANDS / 4
    # One class outside a component of near copies meets all of them in eight blocks, which hold each copy once.
    monkeypatch.setattr(minhash, "BLOCK", 5)
    assert pairs([f"{prose(80, 9)} end{i}" for i in range(40)], F.when(F.col("doc_id") < 39, 0).otherwise(39)) == {(39, i) for i in range(39)}
    assert sum(taken) <= minhash.FINE_BANDS * (40 + 8) + 2 * 40


def test_near_chain(spark):
    """A chain of small edits is one component though its ends are unlike, and the large hot group has no lost link."""
    words = prose(150, 5).split()
    rows = []
    for i in range(60):
        words = words.copy()
        words[(i * 7) % 150] = f"edit{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(60, 50 + i)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[i] == i for i in range(100, 120))


def test_estimate(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    x, y = (minhash.signature(np.unique(v), 2048, 1, 1)[1].tolist() for v in (a, b))
    got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(minhash.estimate("x", "y", 2048, 1)).first()[0]
    assert abs(got - 800 / 1200) < 0.08


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).collect() == []


def brute_repeats(rows, span=400):
    n = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        n.update(b[p : p + span] for p in range(len(b) - span + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - span + 1):
            if n[b[p : p + span]] > 1:
                gone[p : p + span] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
        spans = int((gone[: len(b)] & ~np.concatenate([[False], gone])[: len(b)]).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeats(spark):
    passage = prose(120, 9)
    rows = [(i, t if i != 13 and i != 14 else (t or "")[:3000]) for i, t in hard_rows()]
    rows += [(20 + i, prose(20 + i, 60 + i) + passage[i : 500 + 3 * i] + prose(10, 80 + i)) for i in range(12)]
    rows += [(40, "ab " * 400), (41, "x" * 1000), (42, "x" * 400), (43, "y" * 399 + "z" + "y" * 399)]
    want = brute_repeats(rows)
    for options in ({}, {"group": 2, "batch": 3}, {"group": 5}):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(documents(spark, rows), **options).collect())
        assert got == want, options
    assert digests(documents(spark, [])).collect() == []


def test_repeats_of_planted_passages(spark):
    """Passages of over 50 words go where they have 400 bytes, other texts stay whole, and n_bytes tells neither."""
    passages = [prose(n, 200 + n) for n in (52, 60, 90, 120, 200)]
    passages += [p.replace("a", "é") for p in passages[:3]]
    planted = {8 * i + j: (j, f"{prose(20 + i, 300 + 8 * i + j)} {p} {prose(40, 500 + 8 * i + j)}") for i in range(4) for j, p in enumerate(passages)}
    clean = [(100 + i, prose(60 + 9 * i, 700 + i)) for i in range(20)]
    rows = [(i, t) for i, (_, t) in planted.items()] + clean
    got = {r.doc_id: r for r in digests(documents(spark, rows)).collect()}
    size = [len(p.encode()) for p in passages]
    assert sum(b >= 400 for b in size) == 4
    for i, (j, _) in planted.items():
        assert (got[i].n_removed >= size[j] and got[i].changed) if size[j] >= 400 else got[i].n_removed == 0, i
    assert all(got[i].n_removed == 0 and not got[i].changed for i, _ in clean)
    assert all(got[i].n_bytes == len(t.encode()) for i, t in rows)


def test_repeats_of_periodic_texts(spark):
    """Runs of equal contexts are one row, whatever stands around them, and count as copies of themselves."""
    rows = [(i, prose(30, i) + unit * (2400 // len(unit)) + prose(60, 50 + i)) for i, unit in enumerate(("x", "xy", "again and ", "é", prose(70, 3), prose(12, 4)))]
    rows += [(10, "x" * 450), (11, "y" * 450 + prose(80, 1)), (None, "xy" * 300)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(documents(spark, rows)).collect())
    assert got == brute_repeats(rows)
    long = documents(spark, [(1, "x" * 1_000_000), (2, "ab " * 300_000 + prose(100, 2))])
    placed = place(_rows(long, "doc_id", "text"), 400, 64)
    assert placed.count() < 40
    assert {r.doc_id: r.n_bytes - r.n_removed for r in digests(long).collect()} == {1: 0, 2: len(prose(100, 2))}


def thue_morse(n, a="a", b="b"):
    """Strings whose polynomial hashes modulo 2**64 are equal for every odd base, from 1024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_repeats_with_one_common_anchor(spark):
    """A passage in many different surroundings is split down to parts that can be sorted, or to single windows."""
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefgh "), 600))
    letters = lambda n: "".join(rng.choice(list("uvwxyz "), n))
    rows = [(i, letters(rng.integers(0, 300)) + passage[rng.integers(0, 120) : rng.integers(490, 601)] + letters(rng.integers(0, 300))) for i in range(120)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(documents(spark, rows), group=4).collect())
    assert got == brute_repeats(rows)
    assert sum(r[2] > 0 for r in got) > 60


def test_repeats_are_equal_bytes(spark):
    one, two = thue_morse(2048)
    rows = [(1, one), (2, two), (3, "x" + one[:1500]), (4, prose(100, 7))]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digests(documents(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_near_links_are_equal_words(spark):
    one, two = thue_morse(2048)
    rows = [(i, f"{w} {w} {w} {w} {w} {prose(1, i)}") for i, w in enumerate((one, two))] + [(2, one), (3, two), (4, one.upper())]
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_near(rows)


def test_near_in_a_mixed_bucket(spark, monkeypatch):
    """Documents of one template that are not alike share buckets; these are compared in blocks and lose no pair."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    template = prose(60, 31).split()
    rows = []
    for i in range(60):
        own = prose(18, 100 + i // 2).split()
        rows.append((i, " ".join([*template, *own, *([f"end{i}"] if i % 2 else [])])))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_near(rows)
    assert 25 <= sum(k for *_, k in got) <= 35


def test_suffix_sort():
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = bytes(rng.choice(list(b"ab"), 50))
        strings = [base[: rng.integers(0, 51)] + bytes(rng.choice(list(b"abc"), rng.integers(0, 3))) for _ in range(rng.integers(1, 10))]
        order, lcp = sort_strings(strings, 0, int(rng.choice([0, 4, 32])))
        assert [strings[i] for i in order] == sorted(strings)
        grid = pairwise(strings)
        for i, a in enumerate(strings):
            for j, b in enumerate(strings):
                same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert i == j or grid[i, j] == same


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [r for r in hard_rows() if r[0] != 14] + [(50 + i, w) for i, w in enumerate(thue_morse(2048))] + [(52, " ".join(thue_morse(1024)))] + [(30, "it's <|endoftext|> they'll\n\n  go 12 ²"), (31, "a" * 5000)]
    out = packing.pack(packing.pieces(documents(spark, rows), *tokenizer()), group_rows=16).collect()
    plain = Tokenizer.from_file(tokenizer()[0])
    import zlib

    want = Counter()
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = packing.cut_points(len(ids), 1024)
        assert all(b - a == 1024 for a, b in zip(at[1:], at[2:], strict=False)) and at[1] <= 1024
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        place = 0
        for o, n in sorted(held):
            assert o == place
            place += n
        assert place <= 1024
    assert len(bins) <= -(-sum(r.length for r in out) // 1024) + 2
    assert packing.pack(packing.pieces(documents(spark, []), *tokenizer())).collect() == []


def test_local_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = rng.integers(1, 1025, 60)
        first = packing.best_fit(n, 1024)
        better = packing.improve(n, first, 1024)
        assert sorted(i for b in better for i in b) == list(range(60))
        assert max(n[b].sum() for b in better) <= 1024 and packing.least_bins(n, 1024) <= len(better) <= len(first)


def test_local_search_tries_all_exchanges():
    n = np.array([5, 5, 6, 9, 9, 11])
    assert len(packing.improve(n, packing.best_fit(n, 24), 24)) == 2
    n = np.array([5, 11, 9, 4, 8, 11, 16, 8])
    assert len(packing.improve(n, packing.best_fit(n, 24), 24)) == 3
    rng = np.random.default_rng(1)
    n = rng.integers(150, 700, 2000)
    assert len(packing.improve(n, packing.best_fit(n, 1024), 1024)) <= packing.least_bins(n, 1024) + 5
