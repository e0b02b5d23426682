import hashlib
import random
import re

import pytest

from streamwatch.llm import pii

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            x, d = m.group(0), re.sub("[^0-9]", "", m.group(0))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else True, "phone": 10 <= len(d) <= 15,
                  "card": 14 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0}[kind]
            if ok:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def check(df):
    got = {}
    for r in pii.scan_documents(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in df.select("doc_id", "text").collect():
        spans = brute(r.text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        g = got[r.doc_id].pop() if r.doc_id is None or len(got[r.doc_id]) > 1 else got[r.doc_id][0]
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (r, g, line)
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[2] == k for s in spans) for k, _ in BASE]


def test_documents_against_brute_force(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert pii.scan_documents(none).count() == 0


def test_random_runs_of_the_patterns_own_characters(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "@", ".", "..", "1.2.3.4", "300.1.1.1", "+1", "+12 (345) 678-90", "4532015112830366", "4532 0151 1283 0366", "-", " ", "é", "\U0001f600", "x_y%", "007.0.0.255", "a@b", "5" * 21]
    check(spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(400)], "doc_id long, text string"))


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88 3704 0044 0532 0130 00 no"), (3, "social security 123-45-6789."), (4, "part 123-45-6789.")]
    out = {r.doc_id: r for r in pii.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:5:32" in out[1].spans and "iban" not in out[2].spans
    assert out[3].n_more == 1 and "national_id:16:27" in out[3].spans and out[4].n_more == 0


def test_account_numbers_end_where_their_country_says(spark):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19", "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606"]
    after = ["", " Please pay", " PLEASE PAY", " BIC COBADEFF", ". AND", " 1234 5678", ", ok", "\nNEXT LINE"]
    rows = [(i, f"{b}{n}{a}", len(b), len(b) + len(n)) for i, (n, a, b) in enumerate((n, a, b) for n in numbers for a in after for b in ("", "IBAN ", "PAY TO "))]
    out = {r.doc_id: r.spans for r in pii.scan_documents(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, _, s, e in rows:
        assert f"iban:{s}:{e}" in out[i].split(","), rows[i]
    wrong = ["DE89370400440532013001", "DE8937040044053201300", "XX89370400440532013000", "DE89370400440532013000X", "xDE89370400440532013000"]
    assert not any("iban" in r.spans for r in pii.scan_documents(spark.createDataFrame(list(enumerate(wrong)), "doc_id long, text string")).collect())


@pytest.mark.parametrize("n", [1, 255, 256, 257, 3000])
def test_many_matches_in_a_text(spark, n):
    check(spark.createDataFrame([(1, "é 10.0.0.1," * n)], "doc_id long, text string"))


def test_long_runs_stay_linear(spark):
    check(spark.createDataFrame([(1, "a" * 60000 + "@"), (2, "1" * 60000), (3, "+1" + "(" * 60000)], "doc_id long, text string"))


def test_redaction(odd):
    out = {r.doc_id: r for r in pii.redact(odd).collect()}
    assert out[8].text == "Mail me: [EMAIL] or [PHONE], card [CARD], ip [IP]." and out[8].n_chars == len(out[8].text)
    assert out[1].text is None and out[4].text == "a b c d" and pii.redact(odd).columns == odd.columns
