"""Personal data: rows of signs, used-up forms, names of all shapes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from assay.llm import pii
from tests.llm.test_text_operators import docs


def test_signs_are_no_secret(spark):
    texts = ["Password: __________", "API Token\n==========\nabc", "key sk-________________ end", "Password: ____x7____ end"]
    got = [r.text for r in pii.pseudonymise(docs(spark, texts), "key").orderBy("doc_id").collect()]
    assert got[:3] == texts[:3]
    assert re.fullmatch(r"Password: ____[a-z]\d____ end", got[3]) and got[3] != texts[3]


USED_UP = [
    *[("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"],
    *[("secret", f"{c}_______") for c in "abcdefghijklmnopqrstuvwxyz"],
    *[("secret", f"_______{c}") for c in "AB"],
    *[("phone", f"{i:02}") for i in range(60)],
    *[("phone", "4565552186"), ("phone", "4565552187"), ("key", "sk-A________________"), ("iban", "DE89370400440532013000")],
    *[("card", "4539148803436467"), ("card", "4539148803436468"), ("ip", "10.0.0.0"), ("ip", "10.0.0.1"), ("name", "anna smith"), ("name", "анна петрова")],
]


@pytest.mark.parametrize("rounds", [0, 2])
def test_used_up_forms_are_assigned(spark, monkeypatch, rounds):
    """Forms with fewer free values than entities: all get their own value, none a real one."""
    monkeypatch.setattr(pii, "ROUNDS", rounds)
    if not rounds:  # nothing but the assignment: all draws are real
        draw = pii.surrogates
        monkeypatch.setattr(pii, "surrogates", lambda e, k: draw(e, k).withColumn("surrogate", F.col("canon")))
    e = spark.createDataFrame([(k, c, "u") for k, c in USED_UP], "kind string, canon string, gender string")
    got = pii.distinct_surrogates(e, "k").collect()
    assert {(r.kind, r.canon) for r in got} == set(USED_UP)
    made = {(r.kind, r.surrogate) for r in got}
    assert len(made) == len(USED_UP) and not made & set(USED_UP)
    for r in got:
        if r.kind == "card":
            luhn = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(r.surrogate))) % 10
            assert len(r.surrogate) == 16 and r.surrogate[0] == "4" and (luhn == 0) == (r.canon[-1] == "7")
        if r.kind == "ip":
            assert r.surrogate.startswith("10.")
    # and the words in a text stay distinct, with the digits that a form lacked
    texts = [f"+{i // 10}........{i % 10}" for i in range(60)]
    if rounds:
        words = [r.text for r in pii.pseudonymise(docs(spark, texts), "key").collect()]
        assert len(set(words)) == 60 and not set(words) & set(texts)


def test_phones_leave_555_when_it_is_full(spark):
    e = spark.createDataFrame([("phone", "4565552186", "u", a) for a in range(9)], "kind string, canon string, gender string, attempt int")
    got = {r.attempt: r.surrogate for r in pii.surrogates(e, "k").collect()}
    assert all(re.fullmatch(r"[2-9]\d\d555\d{4}" if a < 3 else r"[2-9]\d\d[2-9]\d{6}", v) for a, v in got.items())
    assert any(got[a][3:6] != "555" for a in range(3, 9))


NAMES = {
    "John McDonald": "{}", "Anna Łukasik": "{}", "Mr Dvořák": "Mr {}", "Mr Dvořák": "Mr {}", "Mr. O'Brien": "Mr. {}", "Mr. O’Brien": "Mr. {}",
    "Mrs. Anna-Maria Smith": "Mrs. {}", "Anna-Maria Smith": "{}", "John Kowalski-Nowak": "{}", "Juan Carlos García": "{}", "Herr Ludwig van Beethoven": "Herr {}",
    "John F. Kennedy": "{}", "Prof. Dr. Hans Müller": "Prof. Dr. {}", "Mr Γιώργος Παπαδόπουλος": "Mr {}", "Ольга Ґонта-Їжак": "{}", "Frau von der Leyen": "Frau {}", "Mme d'Arc": "Mme {}", "John SMITH": "{}",
}


def test_names_go_whole(spark):
    texts = [f"so {n}, went (with {n}'s dog)" for n in NAMES]
    got = [(r.text, r.pii.n_entities) for r in pii.pseudonymise(docs(spark, texts), "key").orderBy("doc_id").collect()]
    for (name, shape), (text, n) in zip(NAMES.items(), got, strict=True):
        a, b = re.fullmatch(r"so (.*), went \(with (.*)'s dog\)", text).groups()
        bare = re.sub(r"^((Mrs?|Herr|Frau|Mme|Prof|Dr)\.? )*", "", a)
        assert n == 2 and a == b == shape.format(bare), name
        assert re.fullmatch(r"[^\W\d_]+( [^\W\d_]+)?", bare) and not set(bare.split()) & set(re.split(r"[ '’-]", name)[-1:]), (name, text)
    none = ["Johnson went", "John went home", "the doctor Dr. and Mr who", "Mark the page"]
    assert [r.text for r in pii.pseudonymise(docs(spark, none), "key").orderBy("doc_id").collect()] == none
