import hashlib
import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d if i % 2 == 0 else 2 * d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_by_hand(text):
    only = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", PHONE, lambda m: 8 <= len(only(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, rx, ok in rules for m in re.finditer(rx, text) if ok(m[0])]


def told(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.report(pii.find_personal_data(rows)).collect()}
    return [out[i] for i in range(len(texts))]


def same_base(spark, texts):
    for text, r in zip(texts, told(spark, texts), strict=True):
        base = base_by_hand(text or "")
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(base)] == base, (text, spans, base)
        assert not {s.split(":")[0] for s in spans[len(base) :]} & set(pii.BASE)
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b.startswith(k + ":") for b in base) for k in pii.BASE]


CASES = [
    None,
    "",
    "a@b.c_d@e.f a@b@c.d x@y x@.y .@a.b %a+b@c-d.e-f.g@h.i",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.00001.0.0 1.2.3 11.22.33.44x 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111",
    "+49 (30) 901820 +1-202-555-0100 + 12345678 +1 +12345678901234567 +4 +490301234567.",
    "naïve 𝒳 a@b.co und 😀 192.168.0.1 é +33 1 23 45 67 89",
]


def test_base_spans_equal_brute_force(spark):
    same_base(spark, CASES)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123459.-+@ ()ab_%é😀", max_size=60), min_size=100, max_size=150))
def test_base_spans_of_random_texts(spark, texts):
    same_base(spark, texts)


def test_many_proposals_in_one_text(spark):
    rng = random.Random(5)
    same_base(spark, [" ".join(rng.choice(["a@b.cc", "7", "10.0.0.1", "x", "+4930123456", "4111 1111 1111 1111,"]) for _ in range(3000))])


def test_whole_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    same_base(spark, [r["text"] for r in rows])


def test_long_runs_take_linear_time(spark):
    n = 200_000
    texts = ["a" * n + "@", "a." * n, "a@" + "b." * n, "1" * n, "1 " * n, "1." * (4 * n // 4), "+1" + "(" * n, "+1" * n, "AB12" * n]
    began = time.time()
    out = told(spark, texts)
    assert time.time() - began < 60
    # The plain patterns would take quadratic time here, so what they find is said in words.
    ips = ",".join(f"ip:{8 * k}:{8 * k + 7}" for k in range(n // 4))
    assert [r["spans"] for r in out] == ["", "", f"email:0:{2 * n + 1}", "", "", ips, "", "", ""]


def test_checksums_and_words_near_add_spans(spark):
    texts = [
        "bank account DE89 3704 0044 0532 0130 00, paid",
        "bank account DE88 3704 0044 0532 0130 00, paid",
        "her social security number is 123-45-6789.",
        "part 123-45-6789.",
        "please call 202-555-0143 now",
        "code 202-555-0143 now",
        "amex card 3782 822463 10005 on file",
        "tracking 3782 822463 10005 on file",
        "call +1 202-555-0143",
    ]
    kinds = [[s.split(":")[0] for s in r["spans"].split(",") if s] for r in told(spark, texts)]
    assert kinds == [["iban"], [], ["ssn"], [], ["localphone"], [], ["shortcard"], [], ["phone"]]


def test_scores_follow_the_words_before(spark):
    near, far, against = told(spark, ["the server address 10.1.2.3", "see 10.1.2.3", "release version 10.1.2.3"])
    assert int(near["scores"]) > int(far["scores"]) > int(against["scores"])


def test_redact(spark):
    rows = [(1, "mail a@b.cc or +49 30 1234567!", 5), (2, None, 6), (3, "", 7), (4, "iban DE89 3704 0044 0532 0130 00.", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __body0 int")
    out = {r["doc_id"]: (r["text"], r["__body0"]) for r in pii.redact(docs).collect()}
    assert out == {1: ("mail [EMAIL] or [PHONE]!", 5), 2: (None, 6), 3: ("", 7), 4: ("iban [IBAN].", 8)}
    assert pii.redact(docs).columns == docs.columns


def test_empty_table_repeats_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.report(pii.find_personal_data(empty)).collect() == []
    rows = spark.createDataFrame([(None, "a@b.cc", 1, 2, 3)] * 3, "doc_id bigint, text string, body int, id int, spans int")
    assert [r["spans"] for r in pii.report(pii.find_personal_data(rows)).collect()] == ["email:0:6"] * 3


def test_no_python_in_the_plan(spark, docs):
    plan = pii.report(pii.find_personal_data(docs([(1, "a@b.cc")])))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
