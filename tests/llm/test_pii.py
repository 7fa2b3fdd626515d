import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii
from tessera.llm.queries import op10_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab.@-1205+() %é٣\n")), max_size=60))
def test_base_equals_patterns(text):
    found = pii.spans(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "+1 (555) 010-9999", "a@b.co", "@", ".", " ", "x", "5", "0000000000000000"]), max_size=8))
def test_base_on_pieces(pieces):
    text = "".join(pieces)
    found = pii.spans(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


def test_added_kinds_and_redaction():
    text = 'see ftp://user:pw@host.example/x?y or token = "deadbeef01" and a@b.co'
    found = pii.spans(text)
    assert [text[a:b] for a, b in found["url"]] == ["ftp://user:pw@host.example/x?y"]
    assert [text[a:b] for a, b in found["account"]] == ["deadbeef01"]
    assert pii.redact(text) == 'see <url> or token = "<account>" and <email>'
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("plain") == "plain"


def test_long_texts_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1.2." * 50_000, "+1" * 50_000, "1 " * 100_000, "a@" * 100_000, ":// " * 50_000, "://a:" * 40_000):
        pii.spans(text)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op10_pii(spark, sf_dir).collect():
        expected = brute(docs[r.doc_id] or "")
        assert [len(expected[k]) for k in pii.BASE] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a@b.co", 3), (1, "a@b.co", 3)], "doc_id long, text string, spans long")
    rows = pii.detect(df).collect()
    assert sorted(r.spans for r in rows) == ["", "", "email:0:6", "email:0:6"]
    assert [r.text for r in pii.redacted(df).orderBy("spans").collect()] == [None, "", "<email>", "<email>"]
    assert pii.detect(df.limit(0)).count() == 0


def test_cues_in_any_case():
    for cue, value in (
        ("API Key: ", "a1b2c3d4"), ("Access Key = ", "a1b2c3d4"), ("Tax ID: ", "12-3456789"), ("Api_Key=", "a1b2c3d4"), ("apiKey: ", "a1b2c3d4"), ("TOKEN=", "a1b2c3d4"),
        ("token = ", "a1b2c3d4"), ("\u0130\u00c9 \u212aSSN: ", "123-45-6789"), ("ACCOUNT No. : ", "A1234567"), ("Iban ", None), ("dbPassword=", "a1b2c3d4"), ('"api_key": "', "a1b2c3d4"),
    ):
        text = f"see {cue}{value} there"
        assert [text[a:b] for a, b in pii.spans(text)["account"]] == [value] * (value is not None), cue
        if value:
            assert pii.redact(text) == f"see {cue}<account> there"


def test_values_are_validated():
    good = (
        "IBAN: GB82 WEST 1234 5698 7654 32", "iban=DE89370400440532013000", "Account: GB82WEST12345698765432", "ssn: 123-45-6789", "Social Security Number: 123 45 6789",
        "passport no: X1234567", "acct # 0012 3456 789", "VAT number: DE123456789", "tax id = 12-3456789",
    )
    for text in good:
        start = re.search("[:=#] ?", text).end()
        assert [text[a:b] for a, b in pii.spans(text + " or so")["account"]] == [text[start:]], text
    for text in ("IBAN: XX00abc111", "IBAN: GB83 WEST 1234 5698 7654 32", "ssn: 000-12-3456", "ssn: 912-12-3456", "ssn: 123-00-6789", "passport: renewed", "account: my own", "account: abc123", "protein: 123456789", "token: none", "tax id: 12"):
        assert pii.spans(text)["account"] == [], text


def test_whole_scheme_and_many_spans():
    scheme = "a" * 23
    text = f"1+ {scheme}+x://u:p@h.example z"
    assert [text[a:b] for a, b in pii.spans(text)["url"]] == [f"{scheme}+x://u:p@h.example"]
    assert pii.spans("9://u:p@h.example")["url"] == []
    many = "a@b.co token=abcdef1 1.2.3.4 " * 20_000
    found = pii.spans(many)
    assert len(found["account"]) == len(found["email"]) == len(found["ip"]) == 20_000
    assert pii.spans("iban: " + "gb82 " * 50_000)["account"] == [] and pii.spans("account: " + "1 " * 100_000)["account"]
