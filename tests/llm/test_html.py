"""Tables with spans, nested visibility, and pages that must not take more than linear time."""

import time

import pytest

from parley.llm import html_text
from parley.llm.html_text import visible_text


@pytest.mark.parametrize(
    "page, want",
    [
        ("<table><tr><td colspan=2>Both<td>C<tr><td>a<td>b<td>c</table>", "Both  | C\na | b | c"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"),
        ("<table><tr><td>x<td rowspan=0>A<tr><td>c<tr><td>d</table>", "x | A\nc |\nd |"),
        ("<table><tr><td>1<td>2<tr><td colspan=2>a long one<td>z</table>", "1 | 2\na long one | z"),
        ("<table><tr><td rowspan=2 colspan=2>AB<td>c<tr><td>d<tr><td>1<td>2<td>3</table>", "AB    | c\n      | d\n1 | 2 | 3"),
        ("<table><tr><td colspan=0>a<td colspan=x>b<td colspan=-3>c</table>", "a | b | c"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>", "yes"),
        ("<p style='visibility:hidden'>a<img alt=b><textarea>c</textarea></p><p>d", "d"),
        ("<p style='display:none'>a<b style='visibility:visible'>b</b></p>c", "c"),
        ('x <a title="open>y</a> z', "x y z"),
        ("a < b <> c </> d <1> e <a", "a < b <> c d <1> e <a"),
        ("<i><table><tr><td>a</i>b</table>", "ab"),
        ("", ""),
        (None, ""),
    ],
)
def test_layout(page, want):
    assert visible_text(page) == want


PAGES = {
    "open tags without an end": "<a " * 350_000,
    "stray end tags": "<b>" * 120_000 + "</i>" * 150_000,
    "stray end tags in a cell": "<i><table><td>" + "<b>" * 120_000 + "</i>" * 150_000,
    "deep boxes": "<div>" * 120_000 + "<p>" * 100_000 + "x",
    "deep lists": "<ul><li>" * 100_000 + "x",
    "deep tables": "<table><tr><td>" * 60_000 + "x",
    "one long line": "<b>x</b> " * 110_000,
    "quotes that never close": '<a x="' * 150_000 + "<a x='>",
    "quotes without brackets": "<a " * 300_000 + '="><b>x</b>"',
    "open comments": "<!--" * 250_000,
    "raw elements": "<script>" * 120_000,
    "many cells": "<tr><td colspan=1000 rowspan=9>x" * 30_000,
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_a_megabyte_takes_time_in_proportion(name):
    def seconds(page):
        start = time.process_time()
        visible_text(page)
        return time.process_time() - start

    page = PAGES[name]
    small, large = seconds(page[: len(page) // 8]), seconds(page)
    assert large < max(2.0, 24 * small)


def test_nothing_is_left_out_of_deep_pages():
    lists = visible_text("<ul><li>a" * 900 + "</ul>" * 900).splitlines()
    assert len([x for x in lists if x]) == 900 and lists[-1] == "  " * 899 + "- a"
    assert visible_text("<table><tr><td>x" * 2000).count("x") == 2000


def test_rows(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, None), (3, "")]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    got = sorted(map(tuple, html_text.extract(frame).collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "a"), (None, ""), (3, "")], key=repr)
    assert html_text.extract(frame.limit(0)).count() == 0
