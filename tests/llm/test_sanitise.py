"""Personal data: base spans against the plain patterns, disclosure against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st

from waymark.llm.sanitise import (GENERALISE, SUPPORT, base_spans, personal_data,
                                  personal_data_report, replace_spans, sanitised, words_near)

SCHEMA = "doc_id long, text string, spans string"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def expected_spans(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and luhn(digits)
                    or kind == 3 and 9 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


ODD = ["", "a@b@c.de", "x.y@z.w.v@q.r", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1",
       "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (523) 555-1055, +49 30 1234567",
       "+1234567", "é a.b+c@d-e.f g@h.i", "9" * 30000, "1." * 5000, "+1" * 3000, "a@" * 4000]


def test_odd_texts():
    for text in ODD:
        assert base_spans(text) == expected_spans(text)


@settings(max_examples=400, deadline=None)
@given(st.text("ab.@-+ 0123459()é_%", max_size=60))
def test_any_text(text):
    assert base_spans(text) == expected_spans(text)


def corpus():
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(300):
        body = [pick.choice(words) for _ in range(40)]
        if i < 12:  # the same person in different texts, always with the same rare word
            body[10:10] = ["nightingale", "mail", "flo@example.com", "often"]
        elif i < 60:
            body[5:5] = ["often", "mail", f"user{i}@example.org"]
        elif i < 80:
            body[3:3] = ["often", "mail"]
        rows.append((i, " ".join(body), "x"))
    copied = "quetzal owner bob@example.net quetzal"
    return rows + [(400 + i, copied, None) for i in range(20)] + [
        (500, None, "x"), (501, "", "x"), (None, "call +1 (523) 555-1055 é", "x"), rows[3]]


def test_report(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    report = personal_data_report(docs).collect()
    names = ("email", "ip", "card", "phone")
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"],
                   r["base_sha256"]) for r in report)
    expected = Counter()
    for doc_id, text, _ in rows:
        spans = expected_spans(text or "")
        line = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)
        counts = Counter(k for k, _, _ in spans)
        expected[(doc_id, *(counts[k] for k in range(4)),
                  hashlib.sha256(line.encode()).hexdigest())] += 1
    assert got == expected
    assert personal_data_report(docs.limit(0)).collect() == []


def test_disclosure_equals_brute_force(spark):
    rows = corpus()
    near, places = defaultdict(set), defaultdict(list)
    general, owners = Counter(), defaultdict(set)
    for i, (_, text, _) in enumerate(rows):
        text = text or ""
        general.update(set(re.findall(r"[^\W\d_]{4,}", text.lower())))
        for entity, word, a, b in words_near(text, base_spans(text)):
            near[entity, word].add(i)
            owners[entity].add(i)
            places[i].append((entity, word, a, b))
    telling = {}
    for (entity, word), own in near.items():
        if len({rows[i][1] for i in own}) >= SUPPORT:
            n, e, w = len(rows), len(owners[entity]), max(general[word], len(own))
            telling[entity, word] = math.log(len(own) * n / (e * w)) / math.log(n / e)
    expected = Counter()
    for i, (doc_id, _, _) in enumerate(rows):
        expected[(doc_id, tuple(sorted({(a, b) for e, w, a, b in places[i]
                                        if telling.get((e, w), 0) > GENERALISE})))] += 1
    found = personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    got = Counter((r["doc_id"], tuple((t["start"], t["end"]) for t in r["terms"] or ()))
                  for r in found)
    assert got == expected
    words = {w for (e, w), d in telling.items() if d > GENERALISE}
    assert "nightingale" in words and not words & {"often", "mail", "quetzal", "owner"}


def test_sanitised_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("spans", "_spans")
    clean = sanitised(docs)
    assert clean.columns == docs.columns
    found = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.count() == len(rows)
    assert "nightingale" not in found[0] and "[EMAIL]" in found[0] and "often" in found[0]
    assert found[500] is None and found[501] == "" and found[100] == rows[100][1]
    assert found[None] == "call [PHONE] é"


def test_few_texts_lower_the_disclosure(spark):
    rows = corpus()
    for i, n in enumerate([1, 2, 2, 3, 3, 3]):  # words that come with an entity n times only
        rows.append((600 + i, f"text {i} from {'abc'[n - 1] * 5} mail p{n}@example.com", None))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r["text"] for r in sanitised(docs).collect()}
    assert "aaaaa" in found[600]
    assert all("[WORD]" in found[i] and "bbbbb" not in found[i] for i in (601, 602))
    assert all("[WORD]" in found[i] and "ccccc" not in found[i] for i in (603, 604, 605))
    assert all("nightingale" not in found[i] and "[WORD]" not in found[i] for i in range(12))


def test_terms_in_all_documents_and_at_any_distance(spark):
    filler = " ".join(["often mail"] * 60)
    rows = corpus() + [(700 + i, f"Ng{'' if i % 2 else ' ' + filler} {i} li@example.com {filler} "
                        "Okonkwo", None) for i in range(6)]
    rows += [(710, "met ng and OKONKWO again", None), (None, "okonkwo's", None),
             (712, "no name here", None)]
    found = {r["doc_id"]: r for r in personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
             if r["doc_id"] is None or r["doc_id"] >= 700}
    for doc_id, text, _ in rows[-9:]:
        expected = {m.span() for m in re.finditer(r"\b(ng|okonkwo)\b", text, re.I)}
        if doc_id is not None:
            terms = found[doc_id]["terms"]
            assert {(t["start"], t["end"]) for t in terms or ()} == expected, doc_id
    clean = {r["text"] for r in sanitised(spark.createDataFrame(rows[-9:] + corpus(), SCHEMA))
             .collect()}
    assert not any(re.search(r"\b(ng|okonkwo)\b", t or "", re.I) for t in clean)
    assert "no name here" in clean


def test_overlapping_spans():
    spans = [{"kind": 1, "start": 2, "end": 9}, {"kind": 2, "start": 4, "end": 12}]
    assert replace_spans("a 1.2.3.4 567 b", spans, None) == "a [IP]7 b"
