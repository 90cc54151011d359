from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quern.llm import pii
from quern.llm.common import documents
from quern.llm.pii import KINDS, all_spans, base_spans, found, luhn
from tests.llm.rough import no_documents, rough_documents

FOLDER = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def reference(text: str) -> list[tuple[int, int, int]]:
    """By the patterns as they are stated."""
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


ITEM = st.sampled_from(
    "4111111111111111 5500005555555559 +1 (212) 555-0187 10.0.0.1 256.1.1.1 0001.002.3.4 a.b@c.d x@y @ . - + ( ) é 🙂 0 12 a%b".split()
    + [" ", "\n", "a@b@c.de", "a@b..c", "a@-.x"]
)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(ITEM, st.text("a1.@+- ()%é", max_size=4)), max_size=14).map("".join))
def test_base_patterns(text):
    assert sorted(base_spans(text)) == sorted(reference(text))


def test_long_runs_take_no_longer():
    for unit in ("a", "1", "1.", "1 ", "a@", "@", "+1", "(", "a.", "+", "0-"):
        base_spans(unit * (1_000_000 // len(unit)))


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(documents(spark, FOLDER))


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


@pytest.mark.parametrize(
    "text, added",
    [
        ("call +1 (017) 555-7713 4111111111111111 raie and on", ["+1 (017) 555-7713", "4111111111111111"]),
        ("So it was +1 (017) 555-7713 4111111111111111 10.20.30.40 then", ["+1 (017) 555-7713", "4111111111111111"]),
        ("no more 4111111111111111 5500005555555559 en el", ["4111111111111111", "5500005555555559"]),
        ("write to jan.mill [at] orchard [dot] org today", ["jan.mill [at] orchard [dot] org"]),
        ("In 1999 there were 3.4 or 2024-01-31 of 12345678 left, at home dot. Or", []),
        ("1234567890123456 is no card and 999.1.1.1 nothing", []),
    ],
)
def test_added_spans(model, text, added):
    spans = all_spans(model, [text])[0]
    assert sorted(text[s:e] for _, s, e, base in spans if not base) == sorted(added)
    assert [(k, s, e) for k, s, e, base in spans if base] == sorted(reference(text))


def test_held_out_items(spark, model):
    """Items in contexts that training has not seen: nearly all found, little else."""
    texts = [t for t in pii.contexts_of(documents(spark, "/root/testdata/sf0.1")) if t]
    maker = pii.Maker(4242)
    pairs = [pii.labelled_context(t, maker) for t in texts[:1000]]
    right = extra = missed = 0
    for (text, spans), got in zip(pairs, all_spans(model, [p[0] for p in pairs])):
        wanted = {(k, s, e) for s, e, k in spans if pii._added_holds(k, text[s:e])}
        ours = {(k, s, e) for k, s, e, _ in got}
        right += len(wanted & ours)
        missed += len(wanted - ours)
        extra += len({o for o in ours - wanted if o not in reference(text)})
    assert right / (right + missed) > 0.93 and right / (right + extra) > 0.97


def test_labelled_contexts_hold_their_items():
    maker = pii.Maker(5)
    rough = ["", " ", "one", "die Straße +49 (030) 555-0101 und so weiter und so fort", "a 4111111111111111 b x@y.zz c 3.1 d"]
    for context in rough * 40:
        text, spans = pii.labelled_context(context, maker)
        assert all(0 <= s < e <= len(text) for s, e, _ in spans)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for s, e, k in spans:
            assert text[s] not in " \n" and text[e - 1] not in " \n,"
            assert k == 0 or any(c.isdigit() for c in text[s:e])


def test_rough_rows(spark, model):
    rows = [
        (30, "a@b.cc 10.0.0.1 +1 (212) 555-0187 4111111111111111"),
        (31, "🙂 é x.y@z.org"),
        (32, "x" * 5000 + "@" + "y" * 5000 + ".com"),
        (33, "4111 1111 1111 1111 " * 300),
    ]
    docs = rough_documents(spark).unionByName(
        spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True
    )
    got = found(docs, model).collect()
    assert len(got) == docs.count()
    by_key = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in got:
        spans = [tuple(s) for s in r.spans]
        if r.doc_id is not None:
            base = [(KINDS.index(k), s, e) for k, s, e, b in spans if b]
            assert base == sorted(reference(by_key[r.doc_id]))
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
        added = [s[1:3] for s in spans if not s[3]]
        assert all(e <= a or b <= s for s, e in added for a, b in (x[1:3] for x in spans) if (s, e) != (a, b))


def test_empty_table_and_nothing_to_learn_from(spark):
    empty = no_documents(spark)
    assert pii.contexts_of(empty) == [] and pii.contexts_of(spark.createDataFrame([(1, None)], "doc_id long, text string")) == []
    texts, spans = pii.training_set([])
    assert len(texts) == len(spans) == pii.MADE


def test_contexts_repeat_no_text(spark):
    docs = spark.createDataFrame([(i, "the same text " * 20) for i in range(500)] + [(999, "another")], "doc_id long, text string")
    assert len(pii.contexts_of(docs, sample=10)) == 2


def test_query_columns(spark, monkeypatch, model):
    monkeypatch.setattr(pii, "fit", lambda docs: model)
    texts = {r.doc_id: r.text or "" for r in documents(spark, FOLDER).collect()}
    rows = pii.op12_personal_data(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = reference(texts[r.doc_id])
        told = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        assert set(told) <= set(r.spans.split(",")) if told else True
    assert any(r.n_email for r in rows)
