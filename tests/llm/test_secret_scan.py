import base64
import hashlib
import random
import re
import string

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm.secret_scan import TokenEfficiency, dense_spans, find_secrets, is_known_or_identifier, report

BASE = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}


@pytest.fixture(scope="module")
def efficiency():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    return TokenEfficiency({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, public_tokenizers.PATTERN)


def brute(text):
    spans = []
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    said = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))
    return [sum(s[3] == kind for s in spans) for kind in BASE], hashlib.sha256(said.encode()).hexdigest()


def made_up(seed):
    pick = random.Random(seed)
    parts = ["password", "PASSWD", "Secret", "toKen", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "é", "\n", "🎉", "deadbeef", "0123456789abcdef", "AKIAAKIA", "x" * 12]
    parts += ["".join(pick.choices(string.ascii_letters + string.digits + "+/_.=-", k=pick.randint(1, 24))) for _ in range(6)]
    return "".join(pick.choice(parts) for _ in range(pick.randint(0, 60)))


def test_base_spans_against_brute_force(docs, efficiency):
    rows = [(i, made_up(i)) for i in range(300)] + [(900, None), (901, ""), (902, "secret: password: abcdefghijkl"), (902, "secret: password: abcdefghijkl"), (None, "a" * 100_000)]
    table = docs(rows).withColumn("spans", F.lit("clash")).withColumn("id", F.lit(1))
    got = report(find_secrets(table, efficiency)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *brute(t)[0], brute(t)[1]) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def test_random_strings_are_dense_and_words_are_not(docs, efficiency):
    pick = random.Random(7)
    keys = ["".join(pick.choices(string.ascii_letters + string.digits, k=40)) for _ in range(50)]
    plain = ["internationalisation of documentation", "some_function_name_2024_final_version", "https/www/example/com/index", hashlib.md5(b"x").hexdigest(), "550e8400-e29b-41d4-a716-446655440000", "1234567890123456789012345"]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, f"see {p} here") for i, p in enumerate(plain)]
    got = {r.doc_id: r for r in find_secrets(docs(rows), efficiency).collect()}
    dense = {i: [s for s in r.spans if s.kind == "dense"] for i, r in got.items()}
    assert sum(len(dense[i]) == 1 and dense[i][0].value == k and dense[i][0].start == 4 for i, k in enumerate(keys)) >= 48
    assert not any(dense[100 + i] for i in range(len(plain)))
    assert is_known_or_identifier("a" * 40) and not is_known_or_identifier("a1b2c3d4e5f6g7h8")


def test_random_letters_and_short_numbers_are_dense(efficiency):
    pick = random.Random(11)

    def some(signs, k):
        return "".join(pick.choices(signs, k=k))

    letters, digits = string.ascii_letters, string.digits
    kinds = {
        "letters": lambda: some(letters, 32),
        "lower case": lambda: some(string.ascii_lowercase, 40),
        "letters and a number": lambda: some(letters, 28) + some(digits, 4),
        "letters, number, letters": lambda: f"{some(letters, 14)}-{some(digits, 4)}-{some(letters, 14)}",
        "base62": lambda: some(letters + digits, 20),
        "base64": lambda: some(letters + digits + "+/", 24),
    }
    for kind, make in kinds.items():
        keys = [make() for _ in range(200)]
        assert sum(dense_spans(f"see {k} here", efficiency, 2.2) == [(4, 4 + len(k), "dense")] for k in keys) >= 198, kind
    for signs in (letters, string.ascii_lowercase, letters + digits, letters + digits + "+/"):
        keys = ["".join(pick.choices(signs, k=k)) for k in range(16, 41) for _ in range(40)]
        assert sum(dense_spans(f"see {k} here", efficiency, 2.2) == [(4, 4 + len(k), "dense")] for k in keys) >= 0.97 * len(keys)
        short = [k for k in keys if len(k) < 20]
        assert sum(bool(dense_spans(k, efficiency, 2.2)) for k in short) >= 0.9 * len(short)
    words = ["internationalization", "Schpfgegebeunger", "responsibilities", "misunderstanding", "Wirtschaftswunder", "INTERNATIONALLY1", "antidisestablishmentarianism", "getUserNameFromDatabaseConnection", "i_j_k_l_m_n_o_p_x1_y2", "LD_LIBRARY_PATH_OVERRIDE_X86", "_" * 40, "=" * 20 + "-" * 20, "x" * 40]
    assert not any(dense_spans(w, efficiency, 2.2) for w in words)


def test_empty_table(docs, efficiency):
    assert report(find_secrets(docs([]), efficiency)).count() == 0
