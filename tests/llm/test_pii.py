import re

from hypothesis import given, settings
from hypothesis import strategies as st
from rollcheck.llm import pii

A = pii._automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PIECES = st.sampled_from(["a@b.c", "x.y@", "@", ".d.e", "1.2.3.4", "255.", "300.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (017) 555-7713", "+", " ", "-", "0", "12", "é", "token = \"", "://", "u:p@h.io", ".", "account 12345678", "(", "9"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_patterns(text):
    got = [s for s in pii.find_spans(text, A) if s[0] in pii.BASE]
    assert got == brute(text)


def test_added_spans():
    t = 'see https://bob:pw@host.org/x and Account no: 12345678, token = "04dbebab91ab85687d33" IBAN DE89 3704 0044 0532 0130 00 end; the token is gone'
    got = {(k, t[s:e]) for k, s, e in pii.find_spans(t, A) if k not in pii.BASE}
    assert got == {("login", "https://bob:pw@host.org"), ("account", "12345678"), ("account", "04dbebab91ab85687d33"), ("account", "DE89 3704 0044 0532 0130 00")}


def test_rows(spark):
    rows = [(1, "mail é a@b.co"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "mail é a@b.co"), (4, "9" * 3_000 + "a@b" * 2_000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, spans int")
    got = pii.personal_data(df).collect()
    assert sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in got) == sorted((str(d), brute(t or "")) for d, t in rows)
    assert pii.personal_data(df.limit(0)).count() == 0


def test_whole_schemes_and_any_case():
    def added(t):
        return {(k, t[s:e]) for k, s, e in pii.find_spans(t, A) if k not in pii.BASE}

    t = "é soap+verylongschemename.abcdefgh://user:pw@host.org PassWord: hunter2222x, 1+9x://a:b@c.d"
    assert added(t) == {("login", "soap+verylongschemename.abcdefgh://user:pw@host.org"), ("account", "hunter2222x"), ("login", "x://a:b@c.d")}
    own = pii._automaton(("Kundennummer",))
    assert [(k, s) for k, s, _ in pii.find_spans("KUNDENnummer: ab123456; token: 99887766x", own)] == [("account", 14)]
    assert pii.folded("ÀİA") == "Àİa" and len(pii.folded("İ" * 9)) == 9
    assert len(pii.find_spans("a" * 200_000 + "://" * 50_000, A)) == 0
