"""Quotes of a few letters find their message."""

from quarry.llm.quotations import link_quotes


def test_short_quotes_link(spark):
    rows = [
        (1, 1, "user", "Thanks"), (1, 2, "user", "Some other line"), (1, 3, "user", "> Thanks\nwelcome"),
        (2, 1, "user", "今天下雨了"), (2, 2, "user", "x"), (2, 3, "user", "> 今天下雨了\n是的"),
        (3, 1, "user", "a longer line of words"), (3, 2, "user", "ok\nyes"), (3, 3, "user", "> ok\n> yes\nfine\n> a longer line of words\nso"),
        (4, 1, "user", "\t"), (4, 2, "user", "> \t\nnone"),
    ]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_quotes, r.n_linked) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 3] == (1, 1, 1) and got[2, 3] == (1, 1, 1)
    assert got[3, 3] == (1, 2, 2)  # the longer match wins
    assert got[4, 2] == (None, 0, 0)
