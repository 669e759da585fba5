"""Main text of long pages is whole: what belongs to the article stays, whatever its size beside the rest."""

import pytest

from quillon.llm import html

LONG = "<p>" + "Prose that goes on, with commas, for a while, and then some more, to the end of it. " * 4 + "</p>"
MENU = "<ul><li><a href=/a>Menu one</a></li><li><a href=/b>Menu two</a></li><li><a href=/c>Menu three</a></li></ul>"


def words(n):
    return " ".join([LONG[3:-4].strip()] * n)


@pytest.mark.parametrize("n", [1, 8, 60])
@pytest.mark.parametrize(
    ("page", "before", "after"),
    [
        ("<body>{menu}<article><h1>T</h1><div>{long}</div></article></body>", "T ", ""),
        ("<body><article><header><h1>T</h1></header><div>{long}</div><ul><li>one</li></ul></article></body>", "T ", " one"),
        ("<article><section>{long}</section><section><h2>S</h2><p>Short.</p></section></article>", "", " S Short."),
        ("<main><h1>T</h1><pre>code</pre><article><div>{long}</div><blockquote>Q</blockquote></article></main>", "T code ", " Q"),
        ("<body><article><div>{long}</div></article><article><p>Next.</p></article>{menu}</body>", "", " Next."),
        ("<body><div>{menu}</div><div id=c><h1>T</h1><div>{long}</div><table><tr><td>cell</table><div><p>Short.</p></div></div><div>{menu}</div></body>", "T ", " cell Short."),
        ("<body><header>Site</header><h2>T</h2><div>{long}</div><ul><li>one</ul></body>", "T ", " one"),
    ],
)
def test_the_whole_article_stays_at_every_length(page, before, after, n):
    assert html.main_text(page.format(menu=MENU, long=LONG * n)) == before + words(n) + after
