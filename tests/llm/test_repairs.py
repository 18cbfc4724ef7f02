"""Appending archives, signs of personal data, forms of addresses and numbers, pipelines side by side."""

from __future__ import annotations

import random
import re
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import pii, warc


def test_archives_are_appended(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    for k in range(2):
        pages = spark.createDataFrame([(2 * k, f"u{k}", f"<p>{k}"), (2 * k + 1, "v", None)], "page_id bigint, url string, html string")
        warc.write_warc(pages, path)
    got = warc.read_warc(spark, path)
    assert sorted(r.record_id for r in got.collect()) == [f"urn:page:{i}" for i in range(4)]


def made_by(kind: str, rng: random.Random) -> str:
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    digits, alnum = string.digits, string.ascii_letters + string.digits
    return {
        "email": lambda: pick(alnum + "._-ü", rng.randrange(1, 12)) + "x@" + pick(alnum + "ä-", 4) + ".de",
        "secret": lambda: rng.choice(["password", "API_KEY", "token", "access-key"]) + rng.choice(["=", ": ", " = '"]) + "_." * rng.randrange(2) + pick(alnum, 9),
        "key": lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + digits, 16) if rng.random() < 0.5 else rng.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk-"]) + pick("_-", rng.randrange(4)) + pick(alnum, 1) + pick(alnum + "_-", 18),
        "iban": lambda: "DE" + pick(digits, 2) + "".join(" " + pick(string.ascii_uppercase + digits, 4) for _ in range(4)) if rng.random() < 0.5 else "GB" + pick(digits, 2) + pick(string.ascii_uppercase, 4) + pick(digits, 14),
        "ssn": lambda: f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}",
        "card": lambda: rng.choice(["", " ", "-"]).join(pick(digits, 4) for _ in range(4)),
        "phone": lambda: rng.choice([f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", f"+{pick(digits, 2)} {pick(digits, 9)}", f"{rng.choice('23456789')}05{rng.choice('23456789')}{pick('0456789', 2)}{pick(digits, 4)}", f"1-415.{pick(digits, 3)} {pick(digits, 4)}"]),
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "ip6": lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.5 else f"2{pick('0123456789abcdef', 3)}:DB8::{rng.randrange(1, 65536):x}",
        "name": lambda: rng.choice(["Mr. ", "Dr ", "Señora ", "Herr Prof. "]) + rng.choice(["Smith", "O'Brien", "van der Berg", "Петров"]) if rng.random() < 0.5 else rng.choice(["John", "Иван", "Jean-Luc"]) + " " + rng.choice(["Smith", "Петров", "F. Kennedy"]),
    }[kind]()


@pytest.mark.parametrize("kind", list(pii.PATTERNS))
def test_every_match_is_hinted_and_replaced(spark, kind):
    rng = random.Random(kind)
    texts = [(i, made_by(kind, rng)) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, m string").select("doc_id", "m", F.concat(F.lit("so "), "m", F.lit(" end")).alias("text"))
    marked = df.select("m", F.col("text").rlike(pii.PATTERNS[kind]).alias("match"), F.col("text").rlike(pii.HINT).alias("hint")).collect()
    assert [r.m for r in marked if not r.match] == [] and [r.m for r in marked if not r.hint] == []
    got = pii.pseudonymise(df.select("doc_id", "text"), "k").collect()
    original = dict(texts)
    assert [original[r.doc_id] for r in got if r.pii.n_entities < 1 or original[r.doc_id] in r.text] == []


def test_forms(spark):
    rows = ["a 4155551234 b", "a (415) 555-1234 b", "x 2001:db8::1 y", "x 2001:0DB8:0:0:0:0:0:1 y", "to müller.hans@firma.de.", "std::vector 12:30:45 a::b", "ids 1700000000 0123456789 9115551234"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), "k").orderBy("doc_id").collect()]
    digits = lambda t: re.sub("[^0-9]", "", t)
    assert digits(got[0]) == digits(got[1]) != digits(rows[0])  # one number in two notations
    assert got[2] == got[3] and re.fullmatch("x (?:[0-9a-f]{4}:){7}[0-9a-f]{4} y", got[2])
    assert re.fullmatch(r"to [^@ ]{6}\.[a-z]{4}@mx[0-9a-f]{8}\.example\.com\.", got[4]) and "müller" not in got[4] and "ü" not in got[4]
    assert got[5:] == rows[5:]


def test_two_pipelines_side_by_side(spark, tmp_path):
    """A stage's tables stay until its own result is written and read, whatever other stages begin between."""
    rng = random.Random(2)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou")
    docs = []
    for k in range(2):
        rows = [(i, " ".join(word() for _ in range(80)), "en", "s", 1) for i in range(20)]
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / f"in{k}"))
        docs.append(spark.read.parquet(str(tmp_path / f"in{k}")))
    stages = [f for _, f in corpus_pipeline.STAGES[:3]]
    for n, stage in enumerate(stages):
        results = [stage(spark, d, "") for d in docs]  # both are begun before either is written
        for k in (1, 0):
            results[k].write.parquet(str(tmp_path / f"out{n}{k}"))
        docs = [spark.read.parquet(str(tmp_path / f"out{n}{k}")) for k in range(2)]
    assert [d.count() for d in docs] == [20, 20]
    unwritten = stages[1](spark, stages[0](spark, docs[0], ""), "")
    assert unwritten.count() == 20


def test_texts_that_share_nothing_lose_nothing(spark):
    from assay.llm.suffixes import remove_repeats

    docs = [(i, "".join(random.Random(i).choices(string.ascii_letters, k=200))) for i in range(5)]
    assert [r.dedup.n_removed for r in remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()] == [0] * 5
