import math
import random
import re

import pytest

from scorelark.llm import privacy

SCHEMA = "doc_id long, text string, k1 string, base string"


def plain(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else (2 * int(x) if x < "5" else 2 * int(x) - 9) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@pytest.mark.parametrize("alphabet", ["ab@.c-_%", "0123456789.", "0123456789 -", "+12 ().-a", "a@1.+ -é"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
        assert privacy.joined(privacy.base_spans(text)) == privacy.joined(plain(text)), repr(text)


def test_card_ip_phone_examples():
    text = "Ring +1 (843) 555-7672 or 4111 1111 1111 1111 from 10.0.0.255 but 10.0.0.256, wh.24@mail4.example.com"
    assert privacy.joined(privacy.base_spans(text)) == privacy.joined(plain(text))
    assert {k for k, _, _ in privacy.base_spans(text)} == set(privacy.KINDS)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "@" * 200_000):
        privacy.base_spans(text)


def rows():
    out = [(i, f"note {i} word{i} and more text here number{i}", None, None) for i in range(60)]
    # always beside the address, and nowhere else: it gives it away
    out += [(100 + i, f"Filler{i} speak with captain Zanzibar jim@ship.example.com about cargo{i} today", None, None) for i in range(5)]
    # beside the address, but common
    out += [(200 + i, f"captain speak today with others{i}", None, None) for i in range(30)]
    # one text copied: no evidence
    out += [(300 + i, "Write to the unique Quetzal ann@bird.example.com now", None, None) for i in range(9)]
    return out + [(400, None, "x", "y"), (401, "", None, None), (None, "mail bob@a.example.com", None, None)]


def test_terms_that_disclose(spark):
    given = rows()
    got = {r.doc_id: r for r in privacy.scan(spark.createDataFrame(given, SCHEMA)).collect()}
    assert len(got) == len(given)
    texts = {i: t or "" for i, t, _, _ in given}
    for i, r in got.items():
        base = privacy.base_spans(texts[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in privacy.KINDS]
        terms = [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in privacy.TERMS]
        assert ("Zanzibar" in terms) == (i is not None and 100 <= i < 105)
        assert "Quetzal" not in terms and "captain" not in terms
        assert all(f"{k}:{a}:{b}" in r.spans.split(",") for k, a, b in base)


def test_sanitise_keeps_rows_and_columns(spark):
    given = rows()
    frame = spark.createDataFrame(given, SCHEMA)
    got = privacy.sanitise(frame)
    assert got.columns == frame.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert len(texts) == len(given) and texts[400] is None and texts[401] == ""
    assert texts[None] == "mail [EMAIL]" and "Zanzibar" not in texts[100] and "[EMAIL]" in texts[100]
    assert texts[0] == given[0][1]


def test_empty(spark):
    assert privacy.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert privacy.sanitise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rewrite_leaves_no_character_of_any_span():
    for text in ("from 10.0.0.4 111 1111 1111 1111", "a@b.com-4111 1111 1111 1111"):
        spans = privacy.base_spans(text)
        assert len({k for k, _, _ in spans}) >= 2 and "1111" not in privacy.rewrite(text, [(a, b, k) for k, a, b in spans])
    rng = random.Random(5)
    for _ in range(1000):
        text = "".join(chr(0x4E00 + i) for i in range(30))
        spans = [(a, a + rng.randint(1, 12), rng.choice(list(privacy.PUT))) for a in rng.sample(range(18), rng.randint(0, 5))]
        left = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b, _ in spans))
        assert re.sub(r"\[[A-Z]+\]", "", privacy.rewrite(text, spans)) == left


def test_terms_disclose_from_afar_and_go_everywhere(spark, monkeypatch):
    far = "the cold dark northern sea by the old grey stone harbour wall " * 4
    given = [(i, f"note {i} word{i} and more text here number{i} {far}", None, None) for i in range(60)]
    given += [(100 + i, f"Filler{i} met Zanzibar and Bo there. {far} wrote to jim@ship.example.com on day{i}. {far} Zanzibar left", None, None) for i in range(5)]
    given += [(200, "Zanzibar alone, without an address", None, None), (201, "nobody", None, None)]
    frame = spark.createDataFrame(given, SCHEMA)
    for held in (1 << 18, 2):
        monkeypatch.setattr(privacy, "TERMS_SENT", held)
        texts = {r.doc_id: r.text for r in privacy.sanitise(frame).collect()}
        assert len(texts) == len(given) and all(texts[i] == given[i][1] for i in range(60))
        for i in (*range(100, 105), 200):
            assert "Zanzibar" not in texts[i] and "Bo " not in texts[i]
        assert "northern sea" in texts[100] and texts[100].count("[REMOVED]") >= 3
        spans = {r.doc_id: r.spans for r in privacy.scan(frame).collect()}
        assert spans[200].split(",")[0].endswith(":0:8") and spans[201] == ""


def test_disclosing_terms_are_those_of_the_counts(spark):
    rng = random.Random(7)
    given = []
    for i in range(300):
        words = [rng.choice(["a", "of", *(f"w{k}" for k in range(200))]) for _ in range(rng.randint(0, 25))]
        words += [x for v in range(6) if rng.random() < 0.03 for x in (f"m{v}@x.example.com", *(f"n{v}{k}" for k in range(3) if rng.random() < 0.9))]
        rng.shuffle(words)
        given += [(i, " ".join(words), None, None)] * rng.choice([1, 1, 1, 3])
    texts = [t for _, t, _, _ in given]
    base = {t: privacy.base_spans(t) for t in texts}
    values = {t: {privacy.value_key(k, t[a:b]) for k, a, b in base[t]} for t in texts}
    outside = {t: {w for w, _, _ in privacy.words_outside(t, base[t])} for t in texts}
    every = {t: {w.lower() for w in re.findall("[0-9A-Za-z]+", t)} for t in texts}
    want, n = {}, len(texts)
    for v in set().union(*values.values()):
        holders = [t for t in texts if v in values[t]]
        for w in set().union(*(outside[t] for t in holders)):
            both = [t for t in holders if w in outside[t]]
            share = math.log2(len(both) * n / (len(holders) * sum(w in every[t] for t in texts))) / math.log2(n / len(holders))
            if len(set(both)) >= privacy.SUPPORT and share >= privacy.GENERALISE:
                want[w] = max(want.get(w, 0), share)
    got = {r.term: r.kind for r in privacy.disclosing(spark.createDataFrame(given, SCHEMA)).collect()}
    assert got == {w: "term" if share >= privacy.REMOVE else "hint" for w, share in want.items()} and len(got) > 5


def test_repeated_rows_and_what_narrows_down(spark):
    rows = [(1, "mail jo@a.example.com now", "a", "b")] * 3 + [(2, None, "a", "b")] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [(r.doc_id, r.n_email) for r in privacy.scan(frame).orderBy("doc_id").collect()] == [(1, 1)] * 3 + [(2, 0)] * 2
    assert sorted(str(r.text) for r in privacy.sanitise(frame).collect()) == ["None"] * 2 + ["mail [EMAIL] now"] * 3
    assert [privacy.general(w) for w in ("1984", "Zanzibar", "harbour")] == ["[NUMBER]", "[NAME]", "[WORD]"]
    assert privacy.rewrite("met Zanzibar", [(4, 12, "hint")]) == "met [NAME]"
