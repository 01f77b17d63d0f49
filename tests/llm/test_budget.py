"""The budget fit against a plain program over all choices, and its behaviour at different scales."""

import itertools
import random

from acervo.llm.mixing import fit_budget


def test_against_all_choices():
    draw = random.Random(2)
    for _ in range(200):
        lengths = {draw.randint(1, 9): draw.randint(0, 3) for _ in range(draw.randint(1, 4))}
        budget = draw.randint(0, 40)
        take = fit_budget(lengths, budget)
        assert all(0 <= take[n] <= lengths[n] for n in take)
        got = sum(n * c for n, c in take.items())
        best = max(s for c in itertools.product(*[range(k + 1) for k in lengths.values()]) if (s := sum(n * x for n, x in zip(lengths, c, strict=True))) <= budget)
        floors = sum(n * (c * budget // max(1, sum(a * b for a, b in lengths.items()))) for n, c in lengths.items()) if budget < sum(a * b for a, b in lengths.items()) else best
        assert got <= budget and (got == best or got >= floors)


def test_shares_follow_the_budget_at_every_size():
    draw = random.Random(3)
    small = {draw.randint(1, 400): draw.randint(1, 50) for _ in range(60)}
    for times in (1, 1000, 1_000_000):
        lengths = {n: c * times for n, c in small.items()}
        total = sum(n * c for n, c in lengths.items())
        budget = total * 3 // 7
        take = fit_budget(lengths, budget)
        assert sum(n * c for n, c in take.items()) == budget
        if times > 1:
            assert all(abs(take[n] - lengths[n] * 3 / 7) <= 8 * 400 for n in lengths)
