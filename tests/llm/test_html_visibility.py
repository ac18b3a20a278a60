"""Formulas, diagrams and inherited visibility."""

import pytest

from quarry.llm.html_text import visible_text


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2 tex</annotation></semantics></math> holds", "so x=2 holds"),
        ("<math><mtable><mtr><mtd>1<mtd>0</mtr><mtr><mtd>0<mtd>1</mtr></mtable></math>", "1 0\n0 1"),
        ("<svg><title>n</title><desc>n</desc><defs><text>n</text></defs><path d='M0'/><text>in</text><text>out</text></svg>", "in\nout"),
        ("<p>a<svg><title/><defs/><text visibility=hidden>n</text><text>b</text></svg><p>c", "a\nb\n\nc"),
        ("<desc>y</desc>", "y"),
        ("<div style='visibility:hidden'>n<b style='visibility: visible'>y<i>z</i></b>n</div>", "yz"),
        ("<p style='backface-visibility:hidden'>y", "y"),
        ("<ol><li>a<li style='visibility:hidden'>n<li>c</ol>", "1. a\n3. c"),
        ("<table><tr><td>a<td>b<tr style='visibility:collapse'><td>n<td>n</table>", "a | b"),
        ("<table style='visibility:hidden'><tr><td>n<td>n</table><p>y", "y"),
    ],
)
def test_what_shows(page, want):
    assert visible_text(page) == want
