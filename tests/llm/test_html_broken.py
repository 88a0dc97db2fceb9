"""Pages that are badly written: raw elements, end tags without a start, and their cost."""

import time

import pytest

from burnish.llm.html_text import Page, signs_of


def texts(source):
    return [t for _, t in Page(source).blocks]


@pytest.mark.parametrize("end", ["</script foo>", "</script\n>", "</SCRIPT/>", "</script >"])
def test_a_raw_element_ends_at_any_form_of_its_end_tag(end):
    assert texts(f"<p>before<script>var a = '</scripty>';{end}<p>behind") == ["before", "behind"]


@pytest.mark.parametrize("start", ["<script src=/js/>", "<script/>", "<style />", "<textarea/ >"])
def test_a_slash_does_not_close_a_raw_element(start):
    name = start[1:].split("/")[0].split()[0].strip(">")
    assert texts(f"<p>before{start}var a=1;</{name}><p>behind") == ["before", "behind"]


def test_a_drawing_may_close_its_title_with_a_slash():
    assert texts("<p>before <svg><title/><path d='x'/></svg> behind") == ["before behind"]


def test_an_end_tag_in_a_page_without_end_takes_the_rest():
    assert texts("<p>before<script>all of this") == ["before"]


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 100_000 + "</p>" * 100_000,
        "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000,
        "<div>" * 50_000 + "<li>" * 50_000,
        "<div>" + "<i>" * 50_000 + "<div></div>" * 50_000,
        "<p><b>" * 50_000,
        "<td>" * 50_000 + "</table>" * 50_000,
    ],
)
def test_the_cost_of_broken_pages_grows_with_their_length(source):
    start = time.perf_counter()
    Page(source + "text")
    assert time.perf_counter() - start < 4


def test_lists_and_tables_without_end_tags():
    page = "<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><th>g</table><dl><dt>h<dd>i</dl><p>j<div>k</div>l"
    assert texts(page) == list("abcdefghijkl")
    assert texts("<li>a<div><li>b</div><li>c<p>d<li>e") == list("abcde")


def test_signs_of_long_values_are_read_and_not_kept():
    long = "x" * 100_000
    assert signs_of(f' class="sidebar {long}" data-x="{long}"') == signs_of(' class="sidebar"') != 0
