import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binsight.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(t):
    """The base rules as the contract words them."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


TEXTS = ["", None, "write to a.b%c@mail.example.com, or x@y@z.org or a@b.c_d@e.f-%%g@h.i a@b é@ü.de",
         "ip 1.2.3.4 and 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.003.255 999999999999.1.1.1 1.2.3", "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111 79927398713 0000000000000000",
         "+1 (017) 555-7713 +49.30.123456 +1 2 +1234567890123456 ++1234567890 +1 (", "é" * 40 + "+1 (017) 555-7713\u0001a@b.c\u0001" + "漢" * 3 + "8.8.8.8",
         "1" * 5000 + " " + "1 " * 3000, "a" * 30_000 + "@", "a@b." * 500 + "c " + "1." * 2000, "call (030) 555-7713 or 030-555-7713, mail: joe [at] example [dot] com",
         "1@2.3.4.5.6 +1.2.3.4.5.6.7.8.9"]
WEIGHTS = {}


def spans(found):
    return ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in found)


def held_against(out, rows):
    assert len(out) == len(rows)
    for r, (i, t, *_) in zip(out, rows):
        want = plain(t or "")
        assert r.doc_id == i and r.base_sha256 == hashlib.sha256(spans(want).encode()).hexdigest(), (i, t[:80], spans(want), r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)]
        assert set(spans(want).split(",")) - {""} <= set(r.spans.split(","))


def test_base_spans_are_those_of_the_contract(spark):
    rows = [(i, t, "b") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "b"), (2, TEXTS[2], "b")]
    held_against(pii.personal(spark.createDataFrame(rows, "doc_id long, text string, base string").coalesce(1)).collect(), rows)


def test_random_texts(spark):
    import random

    rng = random.Random(4)
    bits = ["1", "22", "333", "@", ".", "+", "-", " ", "a", "b.c", "(", ")", "4111111111111111", "255", "é", "\n", "a@b.c", "1.2.3.4"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(3000)]
    held_against(pii.personal(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), rows)


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    held_against(sorted(pii.personal(docs).collect()), rows)


def test_nothing(spark):
    assert pii.personal(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def row(no, rule, form, gazetteer, context, border, n, length=3, parted=0):
    return dict(no=no, rule=rule, form=form, gazetteer=gazetteer, context=context, border=border, n=n, length=length, parted=parted)


def test_estimation_learns_which_labelers_to_trust():
    # context votes at random; form and gazetteer agree with each other and the rule
    counts = [row(0, 1, 1, 1, c, 1, 400) for c in (-1, 1)] + [row(0, 0, -1, 0, c, -1, 400) for c in (-1, 1)]
    counts += [row(0, 0, 1, 1, -1, 1, 30), row(0, 0, -1, 0, 1, -1, 30)]
    post = pii.estimated(counts)
    assert min(post[:2]) > 0.9 and max(post[2:4]) < 0.1 and post[4] > 0.9 and post[5] < 0.1
    weights = pii.fitted(counts, post)
    score = [sum(weights[x] for x in pii._features("email", r)) for r in counts]
    assert score[4] > 0 > score[5]


def test_candidates_beyond_the_base_rules(spark):
    good = [f"call us by phone: (03{i}) 555-77{i}3 today" for i in range(10)] + [f"phone +1 (03{i}) 555-77{i}3 now" for i in range(10)]
    bad = [f"order no x(03{i}) 5559-77{i}3" for i in range(4)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    out = {r.doc_id: r for r in pii.personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[i].n_added for i in range(10)) >= 8 and all(out[i].n_phone == 1 for i in range(10, 20))


def test_redaction(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _parts string").coalesce(1)
    out = pii.redacted(docs, WEIGHTS).collect()
    assert out[0].text == "" and out[1].text is None and out[0]._text == "x"
    assert out[5].text == "[PHONE] [PHONE] +1 2 +1234567890123456 +[PHONE] +1 ("
    assert out[6].text == "é" * 40 + "[PHONE]\u0002[EMAIL]\u0002" + "漢" * 3 + "[IP]"
    assert all(not plain(r.text or "") for r in out[:7])


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for df in (pii.candidates(docs), pii.redacted(docs, {"email": 1.0})):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1@.-_% ", max_size=30))
def test_spared_work_spares_no_match(t):
    """Java's possessive patterns, emulated: the same matches as the plain ones."""
    import regex

    for kind, p in pii.BASE.items():
        fast = regex.compile(p.replace(r"\G", r"\G"), regex.V0)
        slow = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
                "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
        assert [m.span() for m in fast.finditer(t)] == [m.span() for m in re.finditer(slow, t)], kind


def test_upper_case_addresses_are_tried(spark):
    rows = [(1, "MAX (AT) HOST.COM"), (2, "MAX[AT]HOST [DOT] ORG"), (3, "max (at) host.com"), (4, "NOT AT ALL"), (5, None)]
    out = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.loose] for r in out} == {1: [(0, 17)], 2: [(0, 21)], 3: [(0, 17)], 4: [], 5: []}


def test_a_very_long_word_takes_linear_time(spark):
    import time

    rows = [(1, "a" * 1_000_000 + " (at) x.com"), (2, "a" * 1_000_000 + " x (at) y.org"),
            (3, "p" * 500_000 + "(at)example.com.q%r(at)example.org")]
    t = time.time()
    out = {r.doc_id: [(s.start, s.end) for s in r.loose if s.no == 0]
           for r in pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - t < 20
    n = 1_000_000
    assert out == {1: [(0, n + 11)], 2: [(n + 1, n + 13)], 3: [(0, 500_017), (500_017, 500_034)]}
