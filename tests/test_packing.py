from hypothesis import given
from hypothesis import strategies as st

from lamina.operators.packing import pack, pack_overlapping, pack_paragraphs

SIZES = st.lists(st.integers(0, 50), max_size=60)


def groups(ranges):
    return [k for k, (_, n, _) in enumerate(ranges) for _ in range(n)]


def test_strict_limit_and_oversize_item():
    assert groups(pack([100, 200, 1, 400, 10], 300)) == [0, 0, 1, 2, 3]


def test_non_empty_counts_items_not_tokens():
    assert groups(pack([0, 301], 300)) == [0, 1]


def test_two_budgets():
    assert groups(pack([200_000, 60_000, 1], 250_000, 500)) == [0, 1, 1]
    assert [n for _, n, _ in pack([1] * 501, 250_000, 500)] == [500, 1]


def test_overlap():
    assert [(a, a + n - 1) for a, n, _ in pack_overlapping([100] * 4, 300, 2)] == [(0, 2), (1, 3)]


def test_overlap_keeps_all_of_a_short_range():
    assert [(a, n) for a, n, _ in pack_overlapping([400, 10], 300, 2)] == [(0, 1), (0, 2)]


def test_oversize_paragraph_stands_alone():
    assert [(a, n) for a, n, _ in pack_paragraphs([10, 400, 20, 30], 300)] == [(0, 1), (1, 1), (2, 2)]


@given(SIZES, st.integers(1, 80))
def test_ranges_cover_items_in_order(sizes, budget):
    ranges = pack(sizes, budget)
    assert [i for a, n, _ in ranges for i in range(a, a + n)] == list(range(len(sizes)))
    assert all(t == sum(sizes[a : a + n]) and (t <= budget or n == 1 or sum(sizes[a : a + n - 1]) <= budget) for a, n, t in ranges)
    assert all(t <= budget or n == 1 for _, n, t in ranges)


@given(SIZES, st.integers(1, 80))
def test_overlapping_matches_a_plain_loop(sizes, budget):
    now, out = [], []
    for i, s in enumerate(sizes):
        if now and sum(sizes[j] for j in now) + s > budget:
            out.append((now[0], len(now)))
            now = now[-2:] if len(now) >= 2 else now[:]
        now.append(i)
    if now:
        out.append((now[0], len(now)))
    assert [(a, n) for a, n, _ in pack_overlapping(sizes, budget, 2)] == out
