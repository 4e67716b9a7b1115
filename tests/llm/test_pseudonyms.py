"""Forms of personal data and credentials: found, turned back, linked across ways of writing; prose left alone."""

import pytest

from parlance.llm import pii

F = pii.Feistel(b"k")

CLEAR = [
    ("_jane@x.org", "jane"), ("jörg@müller.de", "jörg"), ("o'brien@x.com", "brien"), ("'anna@x.com'", "anna"), ("李明@example.cn", "李明"),
    ("+(44) 20 7946 0958", "7946"), ("2001:db8::ff00:42:8329", "8329"), ("Bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0", "eyJhbGci"),
    ("ghp_16C7e42F292c6912E7710c838347Ae178B4a", "16C7e42F"), ("https://u5er:secretpw@host/x", "secretpw"),
    ("-----BEGIN RSA PRIVATE KEY-----\nMIIEow" + "IBAAKCAQEA7bq9" * 40 + "\n-----END RSA PRIVATE KEY-----", "MIIEow"),
    ("password: hunter2hunter", "hunter2"), ("password=happiness", "happiness"),
]


@pytest.mark.parametrize("text, hidden", CLEAR)
def test_values_are_found_and_turned_back(text, hidden):
    whole = f"see {text} here"
    new, kinds = pii.pseudonymise(whole, F)
    assert len(kinds) == 1 and hidden not in new
    assert pii.pseudonymise(new, F, back=True) == (whole, kinds)
    assert len(new) == len(whole) or kinds == ["ip6"]


@pytest.mark.parametrize("text", ["The secret: happiness", "version 1.2.3.4", "std::vector", "at 12:30:45 and a::b or ::", "x@y", "a+b=c", "://x"])
def test_prose_is_left_alone(text):
    assert pii.pseudonymise(text, F) == (text, [])


def test_a_date_has_one_pseudonym_however_it_is_written():
    for y, m, d in [(2020, 2, 1), (1999, 12, 31), (2024, 2, 29), (2001, 10, 11), (1950, 9, 9)]:
        iso = pii.pseudonymise(f"{y}-{m:02d}-{d:02d}", F)[0]
        year, month, day = map(int, iso.split("-"))
        assert (year, month, day) != (y, m, d)
        assert pii.pseudonymise(f"{d:02d}.{m:02d}.{y}", F)[0] == f"{day:02d}.{month:02d}.{year}"
        assert pii.pseudonymise(f"{d}.{m}.{y}", F)[0] == f"{day}.{month}.{year}"
        assert pii.pseudonymise(f"{m}/{d}/{y}", F)[0] == f"{month}/{day}/{year}"
        assert pii.pseudonymise(iso, F, back=True)[0] == f"{y}-{m:02d}-{d:02d}"
    days = [pii.pseudonymise(f"2020-{m:02d}-{d:02d}", F)[0] for m in range(1, 13) for d in range(1, 29)]
    assert len(set(days)) == len(days)


def test_long_secrets_change_throughout():
    value = "A" * 600
    new = pii.pseudonymise(f"token = {value}", F)[0][8:]
    assert all(new[i : i + 20] != value[:20] for i in range(0, 600, 20))
