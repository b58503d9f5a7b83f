"""Personal data: the base against Python's patterns, added spans on planted cases, odd texts."""

import hashlib
import random
import re

import pytest

from kinpanel.llm import pii

SCHEMA = "doc_id long, text string, row int, kind string, base string, spans string, start int"
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if passes(k, m.group())]


def detected(spark, pairs, **options):
    df = spark.createDataFrame([(*p, 1, "k", "b", "s", 0) for p in pairs], SCHEMA)
    return sorted(pii.detect(df, **options).collect(), key=str)


def check_base(pairs, got):
    def told(spans):
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = sorted((str(i), *[sum(s[0] == k for s in base(t)) for k in pii.KINDS], hashlib.sha256(told(base(t)).encode()).hexdigest())
                  for i, t in pairs)
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if luhn(head + c))


def phone(rng):
    return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(4)
    parts = ["a.b@c.d", "@", "_x@y.z.w", "+", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567",
             "+1", " ", "-", ".", "(", ")", "é", "😀", "12", "7", "word", "%", "\n", "\x01", "\x02", "a@b", "a@b.", "a@b..c", "9" * 30, "0" * 16]
    pairs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(1500)]
    check_base(pairs, detected(spark, pairs, trees=2))


def test_numbers_run_together_are_added_and_clean_text_is_left_alone(spark):
    rng = random.Random(6)
    words = [f"w{'abcdefgh'[i % 8] * (1 + i % 5)}" for i in range(40)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs, want = [], {}
    for i in range(400):
        item = [f"{rng.choice(words)}.{i}@mail{i % 7}.example.com", f"10.{i % 256}.3.{i % 200}", card(rng), phone(rng)][i % 4]
        pairs.append((i, f"{prose(12)} {item} {prose(12)}"))
    for i in range(400, 600):  # numbers that are nothing
        pairs.append((i, f"{prose(8)} {rng.choice(['1.2.3.999', '4111111111111112', 'x' + str(rng.randrange(10 ** 9)) + 'f', '+12', '2021-03-04'])} {prose(8)}"))
    for i in range(600, 640):  # neither a phone nor a card to the base patterns
        one, two = phone(rng), card(rng)
        text = f"{prose(5)} {one} {two} {prose(5)}"
        want[i] = {("phone", text.index(one), text.index(one) + len(one)), ("card", text.index(two), text.index(two) + len(two))}
        pairs.append((i, text))
    pairs += [(i, prose(20)) for i in range(640, 700)]
    got = {r["doc_id"]: r for r in detected(spark, pairs)}
    check_base(pairs, got.values())
    hit = sum({(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[i]["spans"].split(","))} >= w for i, w in want.items())
    assert hit >= 36
    assert all(got[i]["n_added"] == 0 for i in [*range(400), *range(640, 700)])
    assert sum(got[i]["n_added"] > 0 for i in range(400, 600)) <= 5
    for i, text in pairs:  # base spans stay, all spans are ordered
        spans = [s.split(":") for s in got[i]["spans"].split(",") if s]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert set(base(text)) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert len(spans) == len(base(text)) + got[i]["n_added"]


def test_odd_texts(spark):
    pairs = [(None, None), (1, ""), (2, "no numbers"), (2, "no numbers"), (None, "x@y.z"), (3, "\x01\x02 a@b.c \x02\x01 1.2.3.4"),
             (4, "7" * 6_000), (5, "a" * 6_000), (6, "1 " * 3_000), (7, "a@b" + ".c" * 30_000), (8, "+1" + "(" * 60_000), (9, "+1" * 20_000),
             (10, "1." * 3_000), (11, " at " * 20_000), (12, "a@b.c " * 5_000)]
    check_base(pairs, detected(spark, pairs, trees=2))
    assert detected(spark, []) == []
    # the plain patterns above would take minutes on these
    long = detected(spark, [(1, "7" * 200_000), (2, "a" * 200_000), (3, "1." * 100_000), (4, "7 " * 100_000)], trees=2)
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in long] == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 25_000, 0, 0), (0, 0, 0, 0)]


@pytest.mark.parametrize("digits, ok", [("4111111111111111", True), ("4111111111111112", False), ("0" * 13, True), ("1" * 20, False), ("", False)])
def test_check_sum(spark, digits, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii._luhn(F.lit(digits))).first()[0] is ok
