"""Values in the wider shapes: timestamps, grouped phone numbers, IBANs before words, other scripts."""

import re

import pytest

from tracelake.llm import pii

VALUES = [("date", "2024/01/15"), ("date", "15-01-2024"), ("phone", "+44 20 7946 0958"), ("phone", "+33 1 23 45 67 89"), ("phone", "+49 30 901820"), ("phone", "555 123 4567"), ("iban", "BE68 5390 0754 7034"), ("email", "иван.петров@example.com"), ("email", "łukasz@пример.рф"), ("email", "山田@example.jp"), ("email", "__@example.com"), ("email", "a@example.com"), ("date", "March 3, 1980"), ("date", "12 december 1999"), ("date", "MAY 30 2001"), ("date", "1/5/2024"), ("date", "2/28/2024")]


@pytest.mark.parametrize("after", [", please.", " OK", "."])
@pytest.mark.parametrize("kind,value", VALUES)
def test_found_and_undone(kind, value, after):
    made, undo = pii.Pseudonyms("k"), pii.Pseudonyms("k", undo=True)
    assert pii.find(f"See {value}{after}") == [(4, 4 + len(value), kind)]
    new = getattr(made, kind)(value)
    assert new != value and pii.find(f"See {new}{after}") == [(4, 4 + len(new), kind)]
    assert getattr(undo, kind)(new) == value
    if kind == "email":
        assert not set(new.partition("@")[0]) & set(".") ^ set(value.partition("@")[0]) & set(".")
    if value[0] == "+":
        assert new.split()[0] == value.split()[0]


def test_dates_in_timestamps_stay_linked():
    made = pii.Pseudonyms("k")
    assert pii.pseudonymised("at 2024-01-15T10:30:00Z", made)[0] == f"at {made.date('2024-01-15')}T10:30:00Z"
    assert made.date("2024/01/15").replace("/", "-") == made.date("2024-01-15")
    assert made.date("15-01-2024").split("-")[::-1] == made.date("2024-01-15").split("-")


def test_values_behind_a_failed_start():
    assert pii.find("AB12 DE89 3704 0044 0532 0130 00") == [(5, 32, "iban")]
    assert pii.find("+999 12 34 56 78") == []


def test_every_slash_date_has_a_pseudonym_of_its_own():
    made, undo = pii.Pseudonyms("k"), pii.Pseudonyms("k", undo=True)
    days = [f"{a:02d}/{b:02d}/{y}" for a in range(1, 32) for b in range(1, 32) for y in (1999, 2000, 2024) if pii.date_parts(f"{a:02d}/{b:02d}/{y}")]
    days += [f"{a}/{b}/2024" for a in range(1, 10) for b in range(1, 32) if pii.date_parts(f"{a}/{b}/2024")]
    new = [made.date(d) for d in days]
    assert len(set(new)) == len(set(days)) and [undo.date(d) for d in new] == days
    assert not set(zip(days, new)) & {(d, d) for d in days}


def test_no_short_local_part_stays():
    made = pii.Pseudonyms("k")
    for c in "abcdefghijklmnopqrstuvwxyzAZ09éж":
        assert made.email(f"{c}@example.com").partition("@")[0] != c
    assert made.email("a@example.com").partition("@")[2] == made.email("bob@example.com").partition("@")[2] != "example.com"


def test_ten_digits_behind_a_word():
    assert [k for *_, k in pii.find("Call 5552345678, tel: 5552345679; order 5552345678")] == ["phone", "phone"]


def test_key(spark):
    own = pii.session_key(spark)
    assert own == pii.session_key(spark) and len(own) == 64
    spark.conf.set(pii.KEY_SETTING, "given")
    try:
        assert pii.session_key(spark) == "given"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    with pytest.raises(ValueError):
        pii.Pseudonyms("")


# A second, plain reading of the kinds that the test tables hold: every candidate word by word.


def brute_values(text):
    found = []
    for m in re.finditer(r"[^\s<>()|,;%#!]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", text):
        found.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?<![0-9])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9])", text):
        a = m.start()
        while a and text[a - 1] in "+1 " and re.match(r"\+[0-9]{1,3} ?$", text[max(0, a - 5) : a].lstrip()):
            a -= 1
        found.append((a, m.end(), "phone"))
    for m in re.finditer(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", text):
        found.append((m.start(), m.end(), "ssn"))
    for m in re.finditer(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.])", text):
        if all(int(x) < 256 for x in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"(?<!\w)[0-9](?:[ -]?[0-9]){12,18}(?!\w)", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        twice = [d if i % 2 == len(digits) % 2 - 1 or i % 2 == (len(digits) - 1) % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)]
        if sum(twice) % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    return found


def test_op9_on_a_whole_table(spark, sf):
    from tracelake.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    to, back = {}, {}
    for r in rows:
        spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert len(spans) == r.n_values
        for a, b, k in brute_values(docs[r.doc_id] or ""):
            assert any(x <= a and b <= y for x, y, _ in spans), (docs[r.doc_id][a - 20 : b + 20], k)
        # text between the values stays; equal values have equal pseudonyms, different ones different
        last, rest = 0, r.text
        for i, (a, b, k) in enumerate(spans):
            gap = docs[r.doc_id][last:a]
            assert rest.startswith(gap)
            rest, last = rest[len(gap) :], b
            upto = docs[r.doc_id][b : spans[i + 1][0] if i + 1 < len(spans) else None]
            n = rest.index(upto) if upto else len(rest)
            n = b - a if k != "ip" and rest[b - a :].startswith(upto) else n
            new, rest = rest[:n], rest[n:]
            assert to.setdefault((k, docs[r.doc_id][a:b]), new) == new and back.setdefault((k, new), docs[r.doc_id][a:b]) == docs[r.doc_id][a:b]
            assert new != docs[r.doc_id][a:b] and pii.find(f" {new} ") == [(1, 1 + len(new), k)]
        assert rest == docs[r.doc_id][last:]
