"""Main text of pages written by hand."""

from __future__ import annotations

import numpy as np
import pytest

from tallyloom.llm import html_text

A = "The council met on Tuesday evening and agreed, after a long debate, to repair the old bridge before winter."
B = "Work is to begin in May; until then lorries take the road along the river, which is longer but safe."
C = "Nobody in the room doubted that the bridge, built in 1874, would last for another hundred years."
D = "Engineers had found cracks in two of its five arches, none of them deep enough to close it at once."
TALK = "I have crossed that bridge every day of my life and I am glad that they finally do something about it, well done."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = '<footer><p>Copyright 2020. All rights reserved. <a href="/i">Imprint</a></p></footer>'


def paras(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def page(body, nav=NAV, foot=FOOT):
    return f"<!doctype html><html><head><title>Bridge</title><style>p {{}}</style></head><body>{nav}{body}{foot}</body></html>"


STORY = f"<article><h1>Bridge</h1>{paras(A, B, C)}</article>"
PAGES = {
    "an article": (page(STORY), ["Bridge", A, B, C]),
    "comments as articles in a section": (page(f'{STORY}<section id="comments"><article class="comment"><p>{TALK}</p></article><article class="comment"><p>{TALK}</p></article></section>'), ["Bridge", A, B, C]),
    "comments as articles in a div": (page(f'{STORY}<div class="comments"><article><p>{TALK}</p><p>{TALK}</p></article></div>'), ["Bridge", A, B, C]),
    "comments as articles in an aside": (page(f"{STORY}<aside><article><p>{TALK}</p></article></aside>"), ["Bridge", A, B, C]),
    "comments within the article": (page(f'<article><h1>Bridge</h1>{paras(A, B, C)}<div class="comment-list"><article class="comment-body"><p>{TALK}</p></article></div></article>'), ["Bridge", A, B, C]),
    "a short body and a long comment": (page(f'<article><p>{A}</p></article><div id="comments"><article class="comment">{paras(TALK, TALK, TALK)}</article></div>'), [A]),
    "a section on social policy": (page(f'<article>{paras(A)}<section class="social-policy">{paras(B, C)}</section></article>'), [A, B, C]),
    "a section on search engines": (page(f'<article><div class="search-engines">{paras(A, B)}</div>{paras(C)}</article>'), [A, B, C]),
    "a menu of search links": (page(f'<article>{paras(A, B)}<div class="search-results-menu"><ul><li><a href="1">One</a></li><li><a href="2">Two</a></li></ul></div>{paras(C)}</article>'), [A, B, C]),
    "no article element": (page(f"<div><h1>Bridge</h1>{paras(A, B, C, D)}</div>"), ["Bridge", A, B, C, D]),
    "a reference after the story": (page(f'<div>{paras(A, B, C)}<p><a href="/r">Report of the engineers</a></p></div>'), [A, B, C, "Report of the engineers"]),
    "a menu after the story": (page(f'<div>{paras(A, B, C)}<ul><li><a href="/1">More on this</a></li><li><a href="/2">Archive</a></li></ul></div>'), [A, B, C]),
    "cards beside the body": (page(f'<div class="text">{paras(A, B, C, D)}</div><div><article><h3><a href="/x">Other</a></h3><p>Short card.</p></article></div>'), [A, B, C, D]),
    "a story of several articles": (page(f"<main><article>{paras(A, B)}</article><article>{paras(C, D)}</article></main>"), [A, B, C, D]),
    "an unclosed menu": (page(f"<article>{paras(A, B)}</article>", nav='<nav><ul><li><a href="/">Home</a>'), [A, B]),
    "an advert inside": (page(f'<article>{paras(A)}<div class="ad-slot">Buy a new car now at the lowest price of the whole year in town.</div>{paras(B)}</article>'), [A, B]),
    "a cookie notice": (page(f'<div class="cookie-banner"><p>We use cookies to make this site better for all of its many readers.</p></div>{STORY}'), ["Bridge", A, B, C]),
    "a form": (page(f'<article>{paras(A, B)}<form><label>Your mail</label><input name="m"><button>Send</button></form></article>'), [A, B]),
    "character references": (page("<article><p>R&amp;D &lt;now&gt; &#8211; caf&eacute;&nbsp;open</p></article>"), ["R&D <now> – café open"]),
    "a table and a list": (page(f"<article><p>{A}</p><table><tr><th>Arch<td>Cracks</table><ul><li>first<li>second</ul></article>"), [A, "Arch", "Cracks", "first", "second"]),
    "a page cut off in a tag": (f"<html><body><article><p>{A}</p><p>{B}</p><a hre", [A, B]),
    "hidden text": (page(f'<article>{paras(A)}<p hidden>Secret words</p><p style="display: none">More of them</p>{paras(B)}</article>'), [A, B]),
    "nothing but a menu": (page("", foot=""), []),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_page(name):
    html, want = PAGES[name]
    assert html_text.main_text(html).split("\n\n") == (want or [""])


def test_clustering_decides(monkeypatch):
    """With one cluster instead of two, doubtful and unmarked pages come out otherwise."""
    monkeypatch.setattr(html_text, "two_clusters", lambda values: float(np.min(values)) - 1)
    wrong = [name for name, (html, want) in PAGES.items() if html_text.main_text(html).split("\n\n") != (want or [""])]
    assert wrong
