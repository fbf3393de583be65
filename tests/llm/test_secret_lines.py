"""Unquoted literals of configuration lines, and statements over several lines."""

import time

import pytest

from tracelake.llm import secrets

KEY = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY"
CASES = [
    ("DB_PWD=SuperSecretValue", ["SuperSecretValue"]),
    (f"[default]\naws_secret_access_key = {KEY}\nregion = x\n", [KEY]),
    ("pwd: P4ss!word9\n", ["P4ss!word9"]),
    ("db:\n  pwd: a<b>c#d9  # the old one\n", ["a<b>c#d9"]),
    ("export DB_PWD=abc==def+ghi9=\n", ["abc==def+ghi9="]),
    ('client_credentials =\n  "aZ81kkd0PqLm"\n', ["aZ81kkd0PqLm"]),
    ('private_key = (\n  "MIIEvQIBADANBg"\n  "kqhkiG9w0BAQEF"\n)\n', ["MIIEvQIBADANBg", "kqhkiG9w0BAQEF"]),
    ('pwd = "hunter2" +\n  "X9z!"\nuser = "bob"', ["hunter2", "X9z!"]),
    ("PART=hunter2abc\ndb_pwd = PART\n", ["hunter2abc"]),
    ("db_pwd=hunterabc", ["hunterabc"]),
    ("pwd: correcthorse\n", ["correcthorse"]),
    ('authKey("k9s8d7f6")\ngetPassword("user_1")', ["k9s8d7f6"]),
    ('client.setPwd("Tr0ub4dor&3", true);', ["Tr0ub4dor&3"]),
    ("os.environ['DB_PWD'] = 'hunter2abc'", ["hunter2abc"]),
    ('private_key = """\nMIIEvQIBADANBg\n"""\n', ["\nMIIEvQIBADANBg\n"]),
    ("it isn't so, but pwd = 'hunter2abc'", ["hunter2abc"]),
    ("pwd: str = 'hunter2abc'", ["hunter2abc"]),
    ("pwd: string\ndb_pwd = get_pwd()\npwd = self.pwd\n", []),
]


Q3, DQ = chr(39) * 3, chr(34)


@pytest.mark.parametrize("text,want", CASES)
def test_literals(text, want):
    assert [text[a:b] for a, b, k in secrets.spans(text) if k == "literal"] == want


def test_long_open_statement_is_linear():
    assert secrets.spans("note: (\n" + "word\n" * 50_000) == []


@pytest.mark.parametrize("text", ['\\"' * 500_000, "a : " * 250_000, "key : " * 170_000, "a : 1 : b1 : b1 " * 60_000, Q3 + DQ * 900_000, "pwd" + "(" * 900_000, "pwd=" + "a+" * 450_000, 'pwd = "' + "x" * 900_000, ("pwd=" + Q3) * 140_000])
def test_a_megabyte_takes_a_second_or_so(text):
    began = time.process_time()
    secrets.spans(text)
    assert time.process_time() - began < 3  # about one; the margin is for slow machines


def test_doublings_and_long_sums_are_bounded():
    text = 'pwd = "x1y2z3"\n' + "pwd = pwd + pwd\n" * 60
    assert [text[a:b] for a, b, _ in secrets.spans(text)] == ["x1y2z3"]
    text = 'part = "a1"\n' + 'part = part + "b2"\n' * 20_000 + "pwd = part\n"
    began = time.process_time()
    secrets.spans(text)
    assert time.process_time() - began < 3
