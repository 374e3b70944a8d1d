"""Layout of tables, lists and styles; time on hard pages and texts."""

import re
import time

import pytest

from talefold.llm.html_text import page_text
from talefold.llm.pii import replace_private
from talefold.llm.toxicity import Lexicon

from .common import documents


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td colspan=2>head<td>c<tr><td>1<td>2<td>3</table>", "head  | c\n1 | 2 | 3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td>x<td rowspan=3>y<td>z<tr><td colspan=9>wide<td>w<tr><td>1<td>2</table>", "x    | y | z\nwide |   | w\n1    |   | 2"),
        ("<table><tr><td>1<td colspan=2>a long heading<tr><td>1<td>2<td>3</table>", "1 | a long heading\n1 | 2 | 3"),
        ("<table><tr><td><ul><li>one<li>two</ul><td><p>a<p>b</table>", "- one | a\n- two |\n      | b"),
        ("<table><tr><td><p>a<p>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in | ner | out"),
        ("<table><caption>t</caption><tr><td>a</table>", "t\na"),
        ("<ul><li><p>a<p>b<li><ol start=9><li>x<li>y<pre>z\n z</pre></ol></ul>", "- a\n\n  b\n- 9. x\n  10. y\n\n      z\n       z"),
        ("<ul><li><li>a<li><b></b></ul>b", "- a\n\nb"),
    ],
)
def test_layout(page, text):
    assert page_text(page) == text


def test_lists_keep_marks_at_any_depth():
    lines = page_text("<ul>" + "<li>x<ul>" * 60).split("\n")
    assert len(lines) == 60 and all(line.lstrip(" ") == "- x" for line in lines)
    assert [len(line) - 3 for line in lines] == [2 * min(n, 40) for n in range(60)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<style>.a{display:none} .a{display:block}</style><p class=a>yes", "yes"),
        ("<style>.a{display:block} .a{display:none}</style><p class=a>no", ""),
        ("<style>p.a{display:block} .a{display:none}</style><p class=a>yes", "yes"),
        ("<style>.a{display:none!important} #i{display:block}</style><p class=a id=i>no", ""),
        ("<style>.a{display:none}</style><p class=a style='display:block'>yes", "yes"),
        ("<style>*{visibility:hidden} b{visibility:visible}</style>no<b>yes<i>no</i></b>", "yes"),
        ("<style>.h{display:none}</style><p class=h style='visibility:visible'>no<b style='display:block'>no</b>", ""),
        ("<p hidden>no<p style='color:red'>yes", "yes"),
        ("<p style='visibility:hidden'>no<pre>no <b style='visibility:visible'>yes</b></pre>", "no yes"),
        ("<table style='visibility:hidden'>no<tr><td>no<td style='visibility:visible'>yes</table>", " | yes"),
    ],
)
def test_styles(page, text):
    assert page_text(page) == text


def test_one_open_quote_concerns_its_tag_alone():
    assert page_text("<a x='abc>one</a><p title=\"a > b\">text") == "one\n\ntext"
    assert page_text("<a title='x > y'>one</a><b x=\">two</b><i title='u > v'>three") == "onetwothree"


def test_hard_pages_take_time_by_their_length():
    began = time.perf_counter()
    rules = "".join(f".a{i}{{display:none}}" for i in range(20_000))
    assert page_text(f"<style>{rules}</style>" + "".join(f"<p class=a{i}>x" for i in range(20_000)) + "<p>end") == "end"
    assert page_text("<table><tr><td>a" * 20_000).count("a") == 20_000
    assert page_text("<table><tr><td>a<td>b" * 5_000).count("a") == 5_000
    assert page_text("<ul><li>a" * 20_000).count("- a") == 20_000
    assert page_text('<a x=">" ' * 50_000 + "end").endswith("end")
    assert page_text("<table><tr>" + "<td colspan=1000 rowspan=60000>x" * 200 + "<tr><td>y" * 2000).count("y") == 2000
    assert time.perf_counter() - began < 40


def test_many_exceptions_take_time_by_the_length():
    """Hits inside exceptions do not count, however many of both a text holds."""
    lexicon = Lexicon({" bad ": 1.0}, ["bad luck", "too bad luck comes"])
    began = time.perf_counter()
    assert lexicon.density("bad luck " * 120_000) == 0
    assert time.perf_counter() - began < 5
    assert lexicon.density("bad luck bad day too bad luck comes bad") == pytest.approx(2 / 11)


def test_names_in_all_their_forms(spark):
    texts = [
        "Mr J. Smith came. Smith left.",
        "Dr. van der Berg and Mr de Villiers spoke; Berg too",
        "MR JOHN SMITH and John Smith, Mr John R. Smith",
        "Dr Weber spoke about Lara Weber. Lara Weber was here. Lara left",
        "at 2001:db8:0:1:1:1:1:1 or fe80::1 at 12:30:45",
        "call 030 1234567 or +1 212 555 0199",
        "Leon la, iereu 030 12 and van der Waals stay",
    ]
    got = [r.text for r in replace_private(documents(spark, list(enumerate(texts))), "key").orderBy("doc_id").collect()]
    smith = re.fullmatch(r"Mr [A-Z]\. (\w+) came\. (\w+) left\.", got[0]).groups()
    assert smith[0] == smith[1] != "Smith" and not got[0].startswith("Mr J.")
    berg = re.fullmatch(r"Dr\. van der (\w+) and Mr de (\w+) spoke; (\w+) too", got[1]).groups()
    assert berg[0] == berg[2] != "Berg" and berg[1] != "Villiers"
    upper = re.fullmatch(r"MR (\S+) (\w+) and (\S+) (\w+), Mr (\S+) [A-Z]\. (\w+)", got[2]).groups()
    assert upper[0] == upper[2].upper() and upper[1] == smith[0].upper() and upper[2:4] == upper[4:] != ("John", "Smith")
    weber = re.fullmatch(r"Dr (\w+) spoke about (\S+) (\w+)\. (\S+) (\w+) was here\. (\S+) left", got[3]).groups()
    assert weber[0] == weber[2] == weber[4] != "Weber" and weber[1] == weber[3] == weber[5] != "Lara"
    six = re.fullmatch(r"at ([0-9a-f]{4}:[0-9a-f]{3}(?::[0-9a-f]){6}) or ([0-9a-f]{4}::[0-9a-f]) at 12:30:45", got[4]).groups()
    assert six[0] != "2001:db8:0:1:1:1:1:1" and six[1] != "fe80::1"
    assert re.fullmatch(r"call 0\d\d \d{7} or \+1 [2-9]\d\d [2-9]\d\d \d{4}", got[5]) and "1234567" not in got[5]
    assert got[6] == texts[6]
