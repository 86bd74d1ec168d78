"""Loose candidates of personal data around base spans."""

import random

from tallyframe.llm import private_data


def test_candidate_nested_in_a_refused_one():
    base, long, short = (50, 0, 60, True), (10, 3, 60, False), (20, 2, 30, False)
    assert private_data.candidates("x" * 80, [base, long, short]) == [base, short]


def test_entropy_of_the_whole_span(monkeypatch):
    """A uniform start of 200 signs does not decide on a long secret."""
    seen = []
    whole = private_data.entropy
    monkeypatch.setattr(private_data, "entropy", lambda span: seen.append(whole(span)) or seen[-1])
    rng = random.Random(1)
    secret = "ab01" * 50 + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=4000))
    private_data.code_of(secret, 0, 4, len(secret), False)
    assert seen[0] > 3
