"""Change events: marks, first change, ranks bumped, carried ranks."""

import pytest

from helpers import day, rows
from pricepanel.operators import changes as C
from pricepanel.operators import panel as P
from pricepanel.plans.clean import change_events

SERIES = (("a", "x", 0, 10, 1), ("a", "x", 1, 10, 4), ("a", "x", 3, 12, 2), ("a", "x", 4, 12, 5), ("a", "x", 9, 9, 3))


@pytest.fixture(scope="module")
def panel(make_panel):
    return P.with_observation_lags(make_panel(*SERIES, ("b", "x", 2, 7, 6), ("b", "x", 3, 7, 6)))


def test_changes_of_a_pair(panel):
    first, second = rows(change_events(panel), "dateacc")
    assert (first["dateacc"], first["price_inc"], first["price_dec"], first["pct_change"]) == (day(3), 1, 0, pytest.approx(0.2))
    assert (second["price_inc"], second["price_dec"], second["price2_change"]) == (0, 1, -3.0)
    assert (first["days_bet_change"], second["days_bet_change"]) == (3, 6)


def test_bumped_ranks_compare_panel_lag_with_the_last_mark(panel):
    first, second = rows(change_events(panel), "dateacc")
    assert (first["rank_prev"], first["rank_last_change"], first["ranks_bumped"]) == (4, 1, 3)
    assert (second["rank_prev"], second["rank_last_change"], second["ranks_bumped"]) == (5, 2, 3)


def test_first_change_is_the_first_true_change(panel):
    first, second = rows(change_events(panel), "dateacc")
    assert (first["first_change"], second["first_change"]) == (1, 0)
    assert (first["days_bet_change2"], second["days_bet_change2"]) == (None, 6)


def test_increase_and_decrease_add_up(panel):
    counts = rows(C.pair_change_counts(change_events(panel)))
    assert counts == [{"seller": "a", "isbn": "x", "num_price_inc": 1, "num_price_dec": 1, "num_price_change": 2}]


def test_last_changed_rank_includes_the_current_row(panel):
    got = rows(C.with_last_changed_rank(panel).filter("seller = 'a'"), "dateacc")
    assert [r["rank_last_change"] for r in got] == [1, 1, 2, 2, 3]
