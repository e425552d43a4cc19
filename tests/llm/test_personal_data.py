import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import personal_data as P
from cohortlens.llm.text_queries import op13_personal_data


def luhn(d):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def only_digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m)) <= 15)]


def base_spans(text):
    return [(kind, m.start(), m.end()) for kind, pattern, ok in BASE for m in re.finditer(pattern, text or "") if ok(m.group())]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def checked(df, texts):
    """One row per document with the base spans of the definition; all of them are among the spans."""
    rows = df.collect()
    assert len(rows) == len(texts)
    want = sorted((i is not None, i or 0, hashlib.sha256(joined(base_spans(t)).encode()).hexdigest()) for i, t in texts)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["base_sha256"]) for r in rows) == want
    for r in rows:
        base = [x for x in r["spans"].split(",") if x.split(":")[0] in ("email", "ip", "card", "phone")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k + ":") for x in base) for k in ("email", "ip", "card", "phone")]
    return {r["doc_id"]: r["spans"] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_base_kinds_on_random_texts(spark, docs_dir, seed):
    rng = random.Random(seed)
    parts = ["a", "B", "@", ".", "-", "_", "%", "+", " ", "1", "23", "255", "256", "0", "(", ")", "ü", "\U0001f600", "\n", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "1.2.3.4", "x@y.z", "+1 (974) 555-3436", "000127.0.0.1", "9" * 30, "@a.b.c.d"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))), "en", "s") for i in range(400)]
    checked(op13_personal_data(spark, docs_dir(docs)), [d[:2] for d in docs])


def test_odd_rows(spark, odd, docs_dir, extra_columns):
    checked(op13_personal_data(spark, docs_dir(odd, extra_columns)), [d[:2] for d in odd])
    assert op13_personal_data(spark, docs_dir([])).count() == 0


def test_a_very_long_text_of_nothing_but_spans(spark, docs_dir):
    texts = [(1, " ".join(f"u{k}@mail.example.org 10.0.{k % 300}.7" for k in range(20_000))), (2, "9" * 3_000), (3, "a@" * 30_000), (4, "1." * 30_000)]
    checked(op13_personal_data(spark, docs_dir([(*t, "en", "s") for t in texts])), texts)


def test_totals_before_crosses_blocks(spark):
    for n in (0, 1, 255, 256, 257, 700, 70_000):
        got = spark.range(1).select(P.totals_before(F.expr(f"transform(slice(sequence(1, {max(n, 1)}), 1, {n}), x -> bigint(x))")).alias("t")).first()["t"]
        assert got == [k * (k + 1) // 2 for k in range(n)]


@pytest.fixture(scope="module")
def kinds_of(spark):
    column = P.personal_data(F.col("text")).alias("s")  # many small expressions: built once

    def run(text):
        spans = spark.createDataFrame([(text,)], "text string").select(column).first()["s"]
        return [(s["kind"], text[s["start"]:s["end"]], round(s["score"], 2)) for s in spans]

    return run


def test_iban_needs_its_checksum_its_length_and_no_neighbours(kinds_of):
    assert kinds_of("ü pay to DE89 3704 0044 0532 0130 00 BANK") == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)]
    assert kinds_of("GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432", 0.7)]
    for text in ("GB82WEST12345698765433", "xGB82WEST12345698765432", "GB82WEST12345698765432A", "ZZ82WEST12345698765432",
                 "order GB82WEST12345698765432"):  # no checksum, touched, touched, no country, a misleading word
        assert kinds_of(text) == []


def test_context_decides_on_local_phones(kinds_of):
    assert kinds_of("tel 0171 555 77 13, ok") == [("local_phone", "0171 555 77 13", 0.6)]
    assert kinds_of("(017) 555-7713 by fax") == [("local_phone", "(017) 555-7713", 0.6)]
    assert kinds_of("score 0171 555 77 13") == []
    assert kinds_of("tel of order 0171 555 77 13") == []
    assert kinds_of("tel +49 171 555 77 13") == [("phone", "+49 171 555 77 13", 1.0)]  # the base span is never touched


def test_spelled_email(kinds_of):
    assert kinds_of("name [at] mail [dot] org and x(at)y") == [("spelled_email", "name [at] mail [dot] org", 0.6)]


def test_base_spans_keep_their_place_whatever_their_score(kinds_of):
    assert kinds_of("version 1.2.3.4") == [("ip", "1.2.3.4", 0.3)]
    assert kinds_of("login 1.2.3.4") == [("ip", "1.2.3.4", 1.0)]


def test_redacted_texts(spark):
    texts = ["\U0001f600 a@b.c, tel +1 (974) 555-3436!", "nothing", None, "", "1.2.3.4"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = P.find_personal_data(df).orderBy("k").select(P.redacted(F.col("text"), F.col("__spans"))).collect()
    assert [r[0] for r in got] == ["\U0001f600 [email], tel [phone]!", "nothing", None, "", "[ip]"]


def test_nothing_is_shuffled_and_no_python_runs(spark):
    plan = op13_personal_data(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("regexp_extract_all") == len(P.KINDS)  # each pattern once
