from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clauseweave.llm.pii import KINDS, NOTHING, Selector, base_spans, candidates, fit, personal_data, redacted, rewritten, span_text

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def bases(df, selector=NOTHING):
    rows = personal_data(df, selector).select("doc_id", "text", span_text(F.col("base")).alias("s"), *[F.size(f"base_{k}").alias(k) for k in KINDS]).collect()
    return [(r.text, r.s, tuple(r[k] for k in KINDS)) for r in rows]


def check(df):
    found = bases(df)
    assert len(found) == df.count()
    for text, spans, counts in found:
        expected = brute(text)
        assert spans == ",".join(f"{k}:{a}:{b}" for k, a, b in expected), text[:200]
        assert counts == tuple(sum(k == kind for k, _, _ in expected) for kind in KINDS)


def test_any_text(frame):
    rng = random.Random(12)
    pieces = ["a@b.c", "a.b%@x-y.com.", "@", ".", "+1 (017) 555-7713", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "300.1.1.1", "001.2.3.255.7", "ü€😀", " ", "\n", "-", "(", ")", "7", "12345678901234567890", "x@y", "a@b.c%d@e.f", "..", "\t", "+49.30.1234567"]
    check(frame(["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(400)]))


def test_many_and_long_matches(frame):
    check(frame(["a@b.co " * 700, "9" * 20_000, "a" * 50_000 + "@", "1." * 6000, "+" + "1 " * 4000 + "2", "a@" * 3000 + "b.c", "-" * 3000 + "1.2.3.4 😀" * 300]))


@pytest.fixture(scope="module")
def mixed(frame, words_of):
    rng = random.Random(5)
    texts = []
    for k in range(300):
        body = words_of(60, k)
        body[10] = f"{body[1]}.{k}@mail{k % 9}.example.com"
        body[20] = rng.choice(["+1 (017) 555-77%02d" % (k % 100), "(017) 555-77%02d" % (k % 100)])
        body[30] = f"{rng.randrange(400)}.{rng.randrange(300)}.{k % 256}.7"
        body[40] = str(rng.randrange(10**15, 10**16))
        texts.append(" ".join(body))
    return frame(texts)


def test_trees_keep_every_base_span(mixed):
    selector = fit(mixed, texts=200)
    assert selector != NOTHING
    rows = personal_data(mixed, selector).select("text", "base", "added").collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute(r.text)
        for s in r.added:
            assert not any(b.start < s.end and s.start < b.end for b in r.base)
        ends = sorted((s.start, s.end) for s in r.added)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    # With a threshold that everything passes, the candidates themselves are added.
    loose = type(selector)(selector.score, 0.0)
    assert any(r.added for r in personal_data(mixed, loose).select("added").collect())


def test_overlaps_as_by_brute_force(frame):
    rng = random.Random(3)
    pieces = ["a@b.c", "x [at] y [dot] com", "+1 (017) 555-7713", "(017) 555-7713", "4111.1111.1111.1111", "1.2.3.4", "300 . 1 . 1 . 1", "12:34:56:78", "fe80::1:2:3", " ", " ", "-", ".", "7", "2021-03-04"]
    df = frame(["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(200)] + [None, ""])
    rows = {r.doc_id: r for r in candidates(base_spans(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))).select("doc_id", "base", "candidates").collect()}
    selector = Selector("(c.digits % 5) / 5D", 0.2)
    for r in personal_data(df, selector).collect():
        found = rows[r.doc_id]
        for c in found.candidates:
            hit = {b.kind for b in found.base if b.start < c.end and c.start < b.end}
            assert c.taken == bool(hit) and c.right == (c.name in hit)
        scored = sorted((-(c.digits % 5) / 5, c.order, c.start, c.end, c.name) for c in found.candidates if not c.taken and c.digits % 5 >= 1)
        clear = [s for i, s in enumerate(scored) if not any(t[2] < s[3] and s[2] < t[3] for t in scored[:i])]
        assert [(a.kind, a.start, a.end) for a in r.added] == [(s[4], s[2], s[3]) for s in clear]


def test_fifty_thousand_candidates_in_one_text(frame):
    import time

    text = "(017) 555-7713 x, " * 50_000
    started = time.perf_counter()
    row = personal_data(frame([text]), Selector("c.length / 100", 0.0)).select(F.size("added").alias("n"), F.element_at("added", -1)["end"].alias("e")).first()
    assert row.n >= 50_000 and row.e == len(text) - 4
    assert time.perf_counter() - started < 60


def test_redaction(frame):
    df = frame(["mail a.b@c.de or +49 30 123456 now", None, "ü 1.2.3.4"])
    out = {r.doc_id: r.text for r in redacted(personal_data(df)).collect()}
    assert out == {0: "mail [email] or [phone] now", 1: "", 2: "ü [ip]"}


def test_odd_rows(odd, nothing):
    check(odd)
    assert personal_data(nothing).collect() == []
    assert fit(nothing) == NOTHING


def test_digest(frame):
    text = "x a@b.co y 1.2.3.4"
    row = personal_data(frame([text])).select(F.sha2(span_text(F.col("base")), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"email:2:8,ip:11:18").hexdigest()


def test_other_forms_are_added(frame, words_of):
    rng = random.Random(9)

    def card():
        body = str(rng.randrange(10**14, 10**15))
        return next(body + c for c in "0123456789" if luhn(body + c))

    texts = []
    for k in range(400):
        body = words_of(40, k)
        body[5] = f"{body[1]}.{k}@mail{k % 9}.example.com"
        body[12] = "+%d (%03d) 555-%04d" % (rng.randrange(1, 99), rng.randrange(1000), rng.randrange(10000))
        body[20] = f"{rng.randrange(256)}.{rng.randrange(256)}.{k % 256}.7"
        body[30] = card()
        texts.append(" ".join(body))
    selector = fit(frame(texts), texts=400)
    c = card()
    other = {
        "email": "word jane.doe [at] mail3 [dot] example [dot] com word",
        "ip": "word 2001:0db8:85a3:08d3:1319:8a2e:0370:7344 word",
        "card": f"word {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} word",
        "phone": "word 1 (017) 555-7713 word",
    }
    rows = personal_data(frame(list(other.values())), selector).select("doc_id", "text", "base", "added").collect()
    for kind, r in zip(other, sorted(rows, key=lambda r: r.doc_id), strict=True):
        assert r.base == [] and [(s.kind, s.start, s.end) for s in r.added] == [(kind, 5, len(r.text) - 5)]
    broken = ["word 2021-03-04 word", "word 12:30:45:10 word", "word 300 . 1 . 1 . 1 word", "word %s.%s word" % (c[:4], ".".join(("0001", "0002", "0004"))), "word a [at] b.7 word"]
    assert all(r.added == [] for r in personal_data(frame(broken), selector).select("added").collect())


def test_every_base_span_is_learned_from(frame):
    """All spans of all texts, each in its own surroundings, not the first eight of a sample."""
    import inspect

    text = " ".join(f"ü😀{'w' * k} user{k}@mail.example.com" for k in range(40))
    rows = rewritten(base_spans(frame([text, "none"]))).filter("good").collect()
    assert len(rows) == 40 * 3 and inspect.signature(fit).parameters["texts"].default is None
    wanted = {text[max(0, a - 40) : a] + text[a:b].replace("@", "(at)") + text[b : b + 40] for _, a, b in brute(text)}
    assert wanted <= {r.text for r in rows} and len(wanted) == 40
    assert all("at" in r.text[r["at"] : r.to] for r in rows)
