"""Rounds that look at new pieces only against rounds that look at all that is held."""

import random
import time

import pytest

from turnloom.operators import fold


def rounds(seed, n, sizes, hashes, routes):
    r = random.Random(seed)
    out, number = [], 0
    for i in range(1, n + 1):
        new = []
        for _ in range(r.randrange(5)):
            number += 1
            new.append(fold.Piece(f"p{number:06d}", f"s{number if r.random() < 0.9 else 1}", r.choice(["user", "assistant", "tool"]), r.choice(sizes), f"h{r.randrange(hashes)}", chars=r.randrange(9)))
        r.shuffle(new)
        out.append((i, new, r.choice(routes)))
    return out


def run(session, plan):
    rows = []
    for i, new, told in plan:
        session.round, session.told, session.new = i, told, list(new)
        rows.append(session.end_round())
    return rows, fold._packed(session.state(), session.processed)


@pytest.mark.parametrize("name", sorted(fold.BY_PIECE))
def test_both_ways_are_the_same(name, monkeypatch):
    quick = 0
    for seed in range(120):
        limits = (180_000, 996_000) if seed % 3 else (900, 1500)
        for k, v in zip(("BATCH_TOKENS", "SINGLE_TOKENS"), limits, strict=True):
            monkeypatch.setattr(fold, k, v)
        monkeypatch.setattr(fold.step, "__defaults__", limits)
        monkeypatch.setattr(fold.batches, "__defaults__", limits)
        plan = rounds(seed, 40, [0, 5, 90, 700, 2500], random.Random(seed).choice([3, 30, 10_000]), ["same", "same", "same", "new", "revive:-1", None, "more,revive:-2"] if seed % 2 else ["same"])
        fast, slow = (fold._Session(("s", name), fold.policy(name), k) for k in (fold.BY_PIECE[name], None))
        found = []
        only_new = fast.only_new
        fast.only_new = lambda only_new=only_new, found=found: found.append(only_new()) or found[-1]
        assert run(fast, plan) == run(slow, plan)
        quick += sum(f is not None for f in found)
    assert quick > 1500


def test_a_long_session_costs_what_its_pieces_do():
    """Four times the rounds take about four times as long; looking at all that is held would take sixteen times."""
    plan = [(i, [fold.Piece(f"p{i:06d}{k}", f"s{i}{k}", "user" if k == 0 else "assistant", 40, f"{i}-{k}") for k in range(3)], "same") for i in range(1, 8001)]

    def seconds(n):
        session = fold._Session(("s", "retain-all"), fold.policy("retain-all"), fold.BY_PIECE["retain-all"])
        t = time.process_time()
        run(session, plan[:n])
        return time.process_time() - t

    took = [min(seconds(n) for _ in range(3)) for n in (2000, 8000)]
    assert took[1] < 9 * max(took[0], 0.02)
