"""The block parser on broken, deep and very long pages."""

import time

import pytest

from sparrel.llm import html_blocks, html_extract

SHAPES = {
    "tags without an end": "<a ", "open quotes": '<a x="', "one kind of quote in the other": "<p a=\"'><b c='\">", "deep": "<div>x", "deep, all different": None, "end tags of nothing": "<div></b>x",
    "inline": "<b>x</i>", "comments": "<!--", "declarations": "<!x ", "scripts": "<script></script ", "objects": "<object>x", "noscripts": "<noscript>x", "names": "<p a" + " b" * 50, "spaces": "<p class = ",
    "list items": "<ul><li>x", "table cells": "<table><td>x", "less-than signs": "<<", "references": "&amp", "svg": "<svg><p>x", "equals": "<p ==", "classes": '<div class="a b c d">x', "text": "lorem ipsum ", "slashes": "</ ",
}


def page_of(kind, size):
    if kind == "deep, all different":
        out, k = [], 0
        while size > 0:
            out.append(f'<x{k} class="w{k}">y')
            size -= len(out[-1])
            k += 1
        return "".join(out)
    return SHAPES[kind] * (size // len(SHAPES[kind]))


@pytest.mark.parametrize("kind", SHAPES)
def test_a_megabyte_of(kind):
    model = html_extract.trained()
    took = []
    for size in (1 << 19, 1 << 20):
        page = page_of(kind, size)
        began = time.process_time()
        model.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 5 and took[1] < 3 * took[0] + 0.5, took


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_markup_that_does_not_end_is_no_text():
    assert texts('<p class="x>two</p>') == ["two"]
    assert texts('<p class="x>two</p><p class=\'y>three</p>') == ["two", "three"]
    assert texts("<p>one</p><a href=x") == ["one"]
    assert texts("<p>one</p><!-- two") == ["one"]
    assert texts("<p>one<!---->two<!-->three") == ["onetwothree"]
    assert texts("<p title=it's>one</p><p>isn't</p>") == ["one", "isn't"]
    assert texts("<p title='a>b' alt=\"c>d\">one") == ["one"]
    assert texts('<p a="x" ">one</p>') == ["one"]
    assert texts("<p a=>one</p><p a= >two") == ["one", "two"]
    assert texts("<p>1 < 2, a<b>c</b> </ x>y <?php z?>w") == ["1 < 2, ac y w"]
    assert texts("<script>a</script x>one<style>b</style") == ["one"]
    assert texts("<textarea><p>raw</textarea >end") == ["<p>raw", "end"]


def test_names_and_tags_above():
    got = html_blocks.blocks('<div class="a-b" id=c><p role=\'d\'>x <b class="e">y</b><i class=f>z')
    assert got[0].names == {"a", "b", "c", "d", "f"} and got[0].tags == {"div", "p"} and got[0].above == ("div", "p")
    assert (got[0].tag, got[0].parent) == ("p", "div")
    got = html_blocks.blocks('<div class="a-b" id=c><p>x', (frozenset({"p"}), frozenset({"c"})))
    assert got[0].names == {"c"} and got[0].tags == {"p"} and got[0].above == ("div", "p")


def test_known_words_change_no_score():
    model = html_extract.trained()
    page = '<div class="menu xyzzy"><blink class=content>a b<p>c</p></blink></div><p>The end of it all.</p>'
    assert [model.scores(html_blocks.blocks(page, k)) for k in (None, model.known)][0] == model.scores(html_blocks.blocks(page, model.known))


def test_main_text_of_the_pages_of_the_synthetic_tables():
    """Labelled by hand: of the five shapes of blocks in these pages (menu entries, an advert, headings and
    paragraphs of the article, a footer) the article's are main text.  Read here without the parser."""
    import html
    import re

    import pyarrow.parquet as pq

    model = html_extract.trained()
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    both = got_chars = want_chars = 0
    for page in pages:
        inside = re.search("<article>(.*)</article>", page, re.S)[1]
        parts = [html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))) for p in re.split("</?(?:h1|p)>", inside)]
        want = [" ".join(p.split()) for p in parts if p.strip()]
        got = model.main_text(page).split("\n")
        got_chars += sum(map(len, got))
        want_chars += sum(map(len, want))
        both += sum(len(g) for g in got if g in want)
    assert both == got_chars == want_chars > 0
