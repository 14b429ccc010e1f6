"""Op 7: classes and ids that only contain a word of what is left out."""

from __future__ import annotations

import pytest

from tessera.llm import html_density

PROSE = "The method was compared with what others have measured before, and the results are given in full below. " * 2
SAID = " ".join(PROSE.split())
OTHER = " ".join(["Those who took part in the study are thanked here for their time, their patience and their questions."] * 6)


@pytest.mark.parametrize("mark", ['id="related-work"', 'id="social-impact"', 'id="alert-levels"', 'class="side-by-side"'])
@pytest.mark.parametrize("around", ["article", "div"])
def test_sections_named_by_their_headings(mark, around):
    page = f'<body><ul class="menu"><li><a href="/">Home</a></ul><{around}><p>{PROSE}</p><section {mark}><h2 id="side-effects">Side effects</h2><p>{PROSE}</p><p>{PROSE}</p></section></{around}></body>'
    assert html_density.extract(page).split("\n") == [SAID, "Side effects", SAID, SAID]


def test_doubtful_lists_of_links_go():
    links = "".join(f'<li><a href="/{k}">Another page {k}</a></li>' for k in range(6))
    for mark in ('id="related-posts"', 'class="social-share"', 'id="comments"', 'class="x comments"', 'role="navigation"'):
        assert html_density.extract(f"<body><article><p>{PROSE}</p><p>{PROSE}</p><div {mark}><ul>{links}</ul></div></article></body>").split("\n") == [SAID, SAID]


@pytest.mark.parametrize(("open_", "close"), [("<ul><li>", "</ul>"), ("<ol><li>", "</ol>"), ("<pre>", "</pre>"), ("<table><tr><td>", "</table>"), ("<dl><dd>", "</dl>"), ("<h3>", "</h3>")])
def test_blocks_beside_the_path(open_, close):
    page = f"<body><div><p>{PROSE * 4}</p><p>{PROSE * 4}</p></div>{open_}{OTHER}{close}<div><a href='/'>Home</a> <a href='/b'>Next</a></div></body>"
    assert OTHER in html_density.extract(page).split("\n")
    assert "Home" not in html_density.extract(page)


def test_a_page_of_doubtful_parts_alone():
    assert html_density.extract(f'<body><div id="related-page"><p>{PROSE}</p></div></body>') == SAID
