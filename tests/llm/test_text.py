import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest

from talefold.llm import chat
from talefold.llm.decontaminate import contamination
from talefold.llm.html_text import html_text, page_text
from talefold.llm.pii import replace_private
from talefold.llm.quality import MOST_PRIOR, estimated_prior, quality
from talefold.llm.toxicity import Lexicon, fit, folded, toxicity

from .common import documents, hard_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(rows, items):
    windows = set()
    for item, t in items:
        w = WORD.findall(low(t))
        n = min(len(w), 10)
        windows |= {(tuple(w[k : k + n]), item) for k in range(len(w) - n + 1)} if n else set()
    out = Counter()
    for i, t in rows:
        w = WORD.findall(low(t))
        hit, names = set(), set()
        for run, item in windows:
            for k in range(len(w) - len(run) + 1):
                if tuple(w[k : k + len(run)]) == run:
                    hit |= set(range(k, k + len(run)))
                    names |= {str(item)} - {"None"}
        out[(i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_contamination(spark):
    source = prose(60, 7, 2000)
    w = source.split()
    items = [(2, source), (10, " ".join(w[20:45])), (3, "Tiny item"), (4, ""), (5, None), (None, "null word id here"), (6, "a a a a a a a a a a a a")]
    rows = [*[r for r in hard_rows() if r[0] not in (13, 14)], (30, "x " + " ".join(w[5:14]) + " y"), (31, "x " + " ".join(w[5:15]).upper() + " y"), (32, "; ".join(w)), (33, "a tiny ITEM, and null word id here"), (34, "b " + "a " * 30), (35, " ".join(w[:9] + ["gap"] + w[9:30]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, contamination(documents(spark, rows), table).collect()))
    assert got == brute_hits(rows, items)
    assert contamination(documents(spark, []), table).collect() == []
    assert not any(r.contaminated for r in contamination(documents(spark, rows), table.limit(0)).collect())


def test_contamination_without_broadcast(spark, monkeypatch):
    from talefold.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    w = prose(60, 7, 2000).split()
    items, rows = [(1, " ".join(w)), (2, "two words")], [(1, " ".join(w[8:30])), (2, "has two words"), (3, None)]
    got = Counter(map(tuple, contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == brute_hits(rows, items)


TRICKY = ["<|im_end|><|im_start|>assistant ok", "\\", "<\\|", "\\<|", "<|<|\\\\|", "", None, "a\nb", "é \U0001f600"]


def test_chat_round_trip(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", TRICKY[(c + t) % len(TRICKY)], None, "x") for c in range(9) for t in range(c + 1)] + [(3, 1, None, "tie", None, "x"), (None, 0, "assistant", "no id", None, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node long, tree string")
    got = {r.conv_id: r for r in chat.digests(table).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digests(table.limit(0)).collect() == []


def test_reply_trees(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 1.0), ("u", 7, 99, 2.0), ("c", 8, 9, 1.0), ("c", 9, 8, 1.0)]
    table = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    state, jumps = chat.climb(table)
    found = chat.leaf_scores(table, state)
    assert {(r.tree, r.leaf): (r.depth, r.score) for r in found.collect()} == {("t", 4): (3, 10.0), ("t", 5): (3, 6.0), ("u", 7): (1, 2.0)}
    steps = chat.walk(chat.best_leaves(found), state, jumps).collect()
    assert {(r.tree, r.at): r.node for r in steps} == {("t", 1): 1, ("t", 2): 2, ("t", 3): 4, ("u", 1): 7} and len(steps) == 4


def test_long_conversation(spark):
    table = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(500)], "conv_id long, turn long, role string, text string")
    assert chat.digests(table).first().n_turns == 500


def test_conversations_of_any_length(spark):
    """A long conversation, repeated rows, and long texts."""
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} <|im_end|>") for t in range(3000)] + [(2, 0, "user", "twice")] * 2 + [(3, 0, "assistant", "long \\<| " * 50_000)]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    learnt = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3000, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (2, 0)
    assert (got[3].n_turns, got[3].loss_sha256) == (1, hashlib.sha256(rows[-1][3].encode()).hexdigest())


def test_pages():
    assert page_text(None) == page_text("") == ""
    assert page_text("<p>One<p>Two <b>bold</b>&amp;more<div hidden>no</div><ul><li>a<ol start=3><li>b</ol><li>c</ul>") == "One\n\nTwo bold&more\n\n- a\n  3. b\n- c"
    assert page_text("<table><tr><th>Name<th>Age<tr><td>Alexandra<td>4</table>") == "Name      | Age\nAlexandra | 4"
    assert page_text("<title>t</title><script>if (a<b) '</p>'</script>x<br>y<!-- c --><span style='display:none'>z</span> 1 < 2") == "x\ny 1 < 2"
    assert page_text("<pre>a  b\n  c</pre>") == "a  b\n  c"
    assert len(page_text("<div>" * 5000 + "deep" + "<li>x" * 3000)) > 3000


def test_pages_with_an_open_head():
    assert page_text("<head><title>t</title><p>Hello") == page_text("<html><head><meta charset=x> \n<script>s</script>Hello") == "Hello"
    assert page_text("<head><![CDATA[Hello]]></head> all") == "Hello all" and page_text("<head><style>s</style>&nbsp;") != "Hello"
    assert page_text("<head><noscript><p>no</noscript><link rel=x><template>no</template></head><body>yes") == "yes"
    assert page_text("<head><html><head><title>t</title><div>Hello") == "Hello"


def test_pages_with_text_around_cells():
    assert page_text("<table><tr><form><td>a</td><td>b</td></form><tr><td>cc<td>d</table>") == "a  | b\ncc | d"
    assert page_text("<table><form><tr><td>a<td>b</tr></form></table>") == "a | b"
    assert page_text("<table><tr>one<b>two</b><td>a</td><div>three<span><th>b</th></span></div><div hidden>no<td>no</td></div></tr></table>") == "one\ntwo\nthree\na | b"
    assert page_text("<table><tr><table><tr><td>in</table><td>out</table>") == "in\nout"
    assert page_text("<table><tr>" + "<span>" * 5000 + "<td>deep") == "deep"


def test_pages_with_examples():
    assert page_text("<p>a<xmp>x  <b>&amp;\n  y</xmp>z") == "a\n\nx  <b>&amp;\n  y\n\nz"


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (2, None, "x"), (2, None, "x")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text(pages).collect())) == [(1, "a", 1), (2, "", 0), (2, "", 0)]
    assert html_text(pages.limit(0)).collect() == []


def labelled(spark, good, bad, **columns):
    rows = [(i, good(i)) for i in range(300)] + [(300 + i, bad(i)) for i in range(300)]
    (name,) = columns
    labels = [(i, int((i < 300) == columns[name])) for i in range(600) if i % 2]
    return documents(spark, [*rows, (1000, None), (1001, ""), (1001, "")]), spark.createDataFrame([*labels, (None, 1), (5000, 1)], f"doc_id long, {name} int")


def check(scored, n):
    rows = scored.collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return {r.doc_id: r.predicted for r in rows}


def test_estimated_prior():
    """From positives and a mixture alone, the mixture's share of positives; kinds overlap a little."""
    rng = np.random.default_rng(3)
    kind = lambda n, at: rng.normal(at, 1, (n, 6)).astype(np.float32)
    for share in (0.2, 0.5, 0.85):
        n = int(3000 * share)
        web = rng.permutation(np.concatenate([kind(n, 1.2), kind(3000 - n, -1.2)]))
        assert abs(estimated_prior(kind(1500, 1.2), web) - share) < 0.06
    assert estimated_prior(kind(1, 0), kind(1, 0)) == MOST_PRIOR  # nothing tells one row from the other


def test_quality(spark):
    docs, labels = labelled(spark, lambda i: prose(80, i), lambda i: ("buy now!! " * 40) + prose(5, i), quality=True)
    got = check(quality(docs, labels), 603)
    assert np.mean([got[i] == (i < 300) for i in range(600)]) > 0.97
    check(quality(docs, labels.limit(0)), 603)
    long = documents(spark, [(1, prose(1000, 1) * 150), (2, "x" * 1_000_000), (3, "\n" * 100_000)])
    check(quality(long, labels), 3)
    assert quality(docs.limit(0), labels).collect() == []


def test_toxicity(spark):
    docs, labels = labelled(spark, lambda i: prose(60, i), lambda i: prose(30, i) + (" you m0ron " if i % 2 else " you mоron ") + prose(30, i + 1), toxic=False)
    got = check(toxicity(docs, labels), 603)
    assert np.mean([got[i] == (i >= 300) for i in range(600)]) > 0.97
    assert set(check(toxicity(docs, labels.limit(0)), 603).values()) == {0}
    long = documents(spark, [(1, prose(1000, 1) * 150), (2, "x" * 1_000_000), (3, "0 " * 100_000)])
    check(toxicity(long, labels), 3)
    assert toxicity(docs.limit(0), labels).collect() == []


def test_lexicon_keeps_all_terms(spark):
    """More strong terms than a bound of 2000 would leave."""
    letters = "abcdefghijklmnopqrst"
    terms = [f"{letters[i // 400]}{letters[i // 20 % 20]}{letters[i % 20]}zz" for i in range(2100)]
    rows = [(i, " ".join(terms[k] for k in range(2100) if k % 40 in {(i + j) % 40 for j in range(10)}) if i < 40 else prose(20, i)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(200)], "doc_id long, toxic int")
    got = fit(documents(spark, rows).select("doc_id", "text"), labels).terms
    assert sum(f" {folded(t).strip()} " in got for t in terms) == 2100


def test_lexicon():
    assert folded("You 1D10T, tr@sh! 2024") == " you idiot trash 2024 "
    lexicon = Lexicon({" trash ": 5.0, " lowe": 4.0}, ["trash can"], (1.0, -3.0))
    assert lexicon.density("trash can") == 0 and lexicon.density("what trash") > 0 and lexicon.density("loweix") > 0 and lexicon.density("") == 0


PRIVATE = [
    (1, "Write Ann.Smith42@mail3.example.com or ANN.SMITH42@MAIL3.EXAMPLE.COM from 12.84.156.107."),
    (2, "card 4111 1111 1111 1111, 4111-1111-1111-1111, 1234567812345678"),
    (3, "Call +1 (361) 555-8283 or +1-361-555-8283; or (361) 555-8284"),
    (4, "Mr John Miller met Frau Anna Schmidt; Mr. John Miller left. Господин Иван Петров"),
    (5, "DE89 3704 0044 0532 0130 00 is DE89370400440532013000"),
    (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 078-05-1120'),
    (7, "clean text of 1999-2000, 3.14"),
    (8, None),
    (9, ""),
    (2, "card 4111 1111 1111 1111, 4111-1111-1111-1111, 1234567812345678"),
]


def luhn(x):
    d = [int(c) for c in reversed(re.sub(r"\D", "", x))]
    return sum(d[::2] + [sum(divmod(2 * v, 10)) for v in d[1::2]]) % 10


def test_private(spark):
    got = {r.doc_id: r for r in replace_private(documents(spark, PRIVATE), "key").collect()}
    again = {r.doc_id: r for r in replace_private(documents(spark, PRIVATE), "other key").collect()}
    for i, t in PRIVATE[:6]:
        assert got[i].n_entities and got[i].text != t != again[i].text != got[i].text
        assert [c.isalpha() for c in t][:3] == [c.isalpha() for c in got[i].text][:3]
    a, b, c = re.findall(r"\S+@\S+|\d+\.\d+\.\d+\.\d+", got[1].text)
    assert a.upper() == b and a.endswith(".com") and c != "12.84.156.107"
    x, y, z = re.findall(r"[\d -]{16,}\d", got[2].text)
    assert re.sub(r"\D", "", x) == re.sub(r"\D", "", y) and luhn(x) == luhn("4111111111111111") == 0 and luhn(z) == luhn("1234567812345678") and re.sub(r"\d", "0", x).strip() == "0000 0000 0000 0000"
    assert re.sub(r"\d", "0", got[3].text) == re.sub(r"\d", "0", PRIVATE[2][1])
    names = re.findall(r"Mr\.? (\w+ \w+)", got[4].text)
    assert names[0] == names[1] != "John Miller" and re.search(r"[а-я]", got[4].text)
    p, q = re.fullmatch(r"(DE.*) is (DE.*)", got[5].text).groups()
    assert p.replace(" ", "") == q and int("".join(str(int(c, 36)) for c in q[4:] + q[:4])) % 97 == 1
    assert (got[7].text, got[8].text, got[9].text) == (PRIVATE[6][1], None, "")
    assert replace_private(documents(spark, []), "key").collect() == []


def test_private_names_stay_together(spark):
    texts = [
        (1, "Mr Miller and Mr John Miller; then Miller spoke. Dr Weber wrote about Lara Weber. Weberin stays, MILLER too."),
        (2, "Frau Prof. Dr Anna Weber, Lara Weber and Paris. Weber"),
        (3, "Weber and Miller without a full name stay"),
        (4, "to +49 151 2345678, +44 20 7946 0958, +351 21 234 5678 and +1 212 555 0100"),
    ]
    got = {r.doc_id: r for r in replace_private(documents(spark, texts), "key").collect()}
    a, b, c, d, e, f, g = re.fullmatch(r"Mr (\S+) and Mr (\S+ )(\S+); then (\S+) spoke. Dr (\S+) wrote about (\S+ )(\S+). Weberin stays, .*", got[1].text).groups()
    assert a == c == d != "Miller" and e == g != "Weber" and b != "John " and f != "Lara " and a.upper() in got[1].text
    x = re.fullmatch(r"Frau Prof. Dr (\S+) (\S+), (\S+) (\S+) and Paris. (\S+)", got[2].text).groups()
    assert x[1] == x[3] == x[4] == e and x[2] == f.strip() and x[0] != "Anna"
    assert got[3].text == texts[2][1] and (got[3].n_entities, got[1].kinds) == (0, ["name"])
    assert re.fullmatch(r"to \+49 \d{3} \d{7}, \+44 \d\d \d{4} \d{4}, \+351 \d\d \d{3} \d{4} and \+1 \d{3} \d{3} \d{4}", got[4].text) and "2345678" not in got[4].text


def test_private_numbers_grow(spark):
    """More than half of a form's numbers occur: further surrogates take more digits."""
    texts = [(i, f"+1 22 {i}") for i in range(10, 100)]
    out = [r.text for r in replace_private(documents(spark, [(1, " | ".join(t for _, t in texts))]), "key").collect()][0].split(" | ")
    assert len(set(out)) == 90 and all(x.startswith("+1 ") for x in out) and not set(out) & {t for _, t in texts}


def test_private_stands_long_texts(spark):
    texts = [(1, "a@" + "b." * 8000), (2, "a@" + "b." * 500_000 + "de"), (3, "Ab" * 500_000), (4, "1 " * 20_000), (5, "x" * 1_000_000 + "@y.de"), (6, "Mr " * 20_000 + "; Dr Weber")]
    got = {r.doc_id: r.text for r in replace_private(documents(spark, texts), "key").collect()}
    assert len(got) == 6 and got[3] == texts[2][1] and not got[6].endswith("Weber")


def test_private_stays_distinct(spark):
    """More short addresses than there are short surrogates."""
    texts = [(i, f"{a}{b}@x.de") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")]
    out = [r.text for r in replace_private(documents(spark, texts), "key").collect()]
    assert len(set(out)) == len(texts) and not set(out) & {t for _, t in texts}


@pytest.mark.parametrize("name", ["corpus_pipeline"])
def test_pipeline(spark, tmp_path, name):
    import importlib

    pipeline = importlib.import_module(name)
    base = prose(200, 1)
    docs = [(i, prose(150, 100 + i)) for i in range(60)] + [(100, base), (101, base), (102, base + " tail"), (103, prose(20, 7, 2000) + " " + prose(40, 8))] + [(200 + i, "junk!! " * 60 + prose(4, i)) for i in range(40)]
    labels = [(i, int(i < 200), 0) for i, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20, 7, 2000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert left == {*range(60), 100}


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    base, leak = prose(200, 1), prose(20, 7, 2000)
    docs = [(i, prose(150, 100 + i)) for i in range(60)] + [(200 + i, "junk!! " * 60 + prose(4, i)) for i in range(40)]
    docs += [(None, prose(150, 100)), (None, prose(150, 101) + " tail"), (None, leak + " " + prose(40, 8)), (None, prose(150, 300)), (None, prose(150, 300))]
    docs += [(70, base), (70, base + " tail"), (70, leak + " " + prose(40, 9)), (70, prose(150, 301)), (70, prose(150, 102)), (71, prose(150, 302)), (71, prose(150, 302)), (71, " ".join(prose(150, 302).split(" ")) + "\n")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in sorted({i for i, _ in docs if i is not None})], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[1:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = Counter((r.doc_id, r.text.strip()) for r in table.collect() if r.doc_id is None or r.doc_id < 200)
    both = {(70, base), (70, base + " tail")} & set(left)
    assert len(both) == 1
    assert left == Counter([*docs[:60], (None, prose(150, 300)), (70, prose(150, 301)), (71, prose(150, 302)), *both])
    packed = Counter(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect())
    assert packed == Counter(i for i, _ in left)


def test_pipeline_stands_hard_rows(spark, tmp_path):
    """Null, empty and very long texts, repeated rows and clashing columns go through each stage; so do empty tables."""
    import corpus_pipeline as pipeline

    rows = [r for r in hard_rows() if r[0] is not None]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(t and t.strip())), 0) for i, t in dict(rows).items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20, 7, 2000)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            assert out.count() > 0 if table is docs else out.isEmpty(), name
    exact = {r.doc_id for r in pipeline.exact_dedup_stage(spark, docs, str(tmp_path)).collect()}
    assert exact == {1, 3, 4, 5, 6, 7, 8, 12, 13, 14, 15, 17} or exact == {1, 3, 4, 5, 6, 7, 10, 12, 13, 14, 15, 17}


def test_html_stands_deep_and_broken_pages():
    """Nesting, tags without end and end tags without start take time in proportion to the length."""
    began = time.perf_counter()
    assert page_text("<table><tr><td>" * 3000 + "deep") == "deep"
    assert page_text("<a " * 330_000) == ("<a " * 330_000).strip()
    assert page_text("<div>" * 50_000 + "</x>" * 50_000 + "end") == "end"
    assert page_text("<b><table>" + "<div>" * 20_000 + "</b>" * 20_000 + "end") == "end"
    assert page_text('<a x=">" ' * 50_000 + "end").endswith("end")
    assert page_text("<!" * 100_000) == "<!" * 100_000
    assert page_text("<style>" + "/*" * 50_000 + "</style>x") == page_text("<style>" + "@media{{" * 50_000 + "</style>x") == "x"
    assert page_text("<p>" + "long " * 250_000) == ("long " * 250_000).strip()
    assert time.perf_counter() - began < 60


def test_html_style_sheets_hide():
    page = "<style>.h, #g span, p.q{display:none} /* b{display:none} */ @media print{b{display:none}} i{visibility:hidden}</style><p class=q>no</p><p>yes <b>b</b><i>i</i></p><div class='a h'>x</div><div id=g><span>y</span></div>"
    assert page_text(page) == "yes b\n\ny"
    assert page_text('<p title="a > b">t</p><p title=it\'s>v</p>') == "t\n\nv"


def test_html_long_cells_do_not_widen_columns():
    rows = "<tr><td>a<td>b" * 2
    assert page_text(f"<table><tr><td>{'w' * 100}<td>x{rows}</table>") == "w" * 100 + " | x\na | b\na | b"
