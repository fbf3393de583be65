"""Names that stand for many literals, for long ones, and long names: nothing is left out."""

import random
import time

import pytest

from tracelake.llm import secrets


def literals(text):
    return [text[a:b] for a, b, k in secrets.spans(text) if k == "literal"]


@pytest.mark.parametrize("n", [64, 65, 500])
def test_every_literal_of_a_sum(n):
    parts = [f"x{i:03}" for i in range(n)]
    named = "".join(f'p{i} = "{x}"\n' for i, x in enumerate(parts))
    assert literals(named + "pwd = " + " + ".join(f"p{i}" for i in range(n))) == parts
    assert literals(named + "pwd := " + "+".join(f"p{i}" for i in range(n))) == parts
    assert literals("pwd = " + " + ".join(f'"{x}"' for x in parts)) == parts
    assert literals('part = ""\n' + "".join(f'part = part + "{x}"\n' for x in parts) + "other = part\npwd = other\n") == parts


def test_long_values_and_long_names():
    long = "xy1" * 2000
    assert literals(f'pwd = "{long}" + "Zq9!"') == [long, "Zq9!"]
    assert literals(f'pwd = "{long}" + " or so"') == []  # white space behind the first 4,096 characters
    assert literals("x" * 300 + '_pwd = "hunter2abc"') == ["hunter2abc"]


def test_a_look_at_parts_is_one_at_the_whole():
    rng = random.Random(7)
    for _ in range(3000):
        pool = rng.choice(["xX", "a1 ", "<a>\n", "$ \n", "%a", "aB1!", ".*", " ", "é字1"])
        parts = ["".join(rng.choices(pool, k=rng.choice([0, 1, 2, 7, 40, 90]))) for _ in range(rng.randint(1, 5))]
        whole, made = "".join(parts), secrets.joined_look(list(map(secrets.look, parts)))
        assert made == secrets.look(whole) and list(made.counts) == list(secrets.look(whole).counts), parts
        if not made.gap:
            assert made.is_placeholder(len(whole)) == bool(secrets.PLACEHOLDER.match(whole)), parts


SUMS = [
    'pwd = "x1y2z3"\n' + "pwd = pwd + pwd\n" * 30_000,
    'k = "abcdefghijklmnopqrstuvwxyz0123456789"\npwd=' + "k+" * 450_000 + "k",
    "".join(f'k{i} = "b2"\npwd{i} = k{i} + pwd{i - 1}\n' for i in range(25_000)),
    'part = "a1"\n' + 'part = part + "b2"\n' * 50_000 + "pwd = part\n" * 1000,
]


@pytest.mark.parametrize("text", SUMS, ids=range(len(SUMS)))
def test_long_sums_take_seconds(text):
    began = time.process_time()
    secrets.spans(text)
    assert time.process_time() - began < 6  # about two; the margin is for slow machines
