"""Text after malformed declarations is not lost."""

import random

import pytest

from quillon.llm import html


@pytest.mark.parametrize("mark", ["<![ endif ]>", "<![foo[x]]>", "<![0])>", "<![endif]-->", "<![if !IE]>", "<![CDATA[x]]>", "<!doctype>", "<!>", "<![>"])
def test_text_after_a_declaration_stays(mark):
    assert html.main_text(f"<p>before</p>{mark}<p>after</p>" * 3) == " ".join(["before after"] * 3)


@pytest.mark.parametrize("page", ["<p>a<![0]", "a <![", "a <![foo", "<![CDATA[ a"])
def test_unended_declarations(page):
    assert "a" in html.main_text(page)


def test_no_text_stops_the_parser():
    rng = random.Random(5)
    for _ in range(3000):
        html.main_text("".join(rng.choice(["<", "!", "[", "]", ">", "-", "a", " ", "<![", "<!--", "</", "<?", "<p>", "&#", "if", "cdata"]) for _ in range(rng.randint(1, 40))))
