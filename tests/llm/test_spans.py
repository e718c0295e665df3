import hashlib
import random
import re
import time

import pytest

from mailsieve.llm import pii, secret_scan

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(MAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]


def base_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.ORDER[s[0]]))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def noise(parts, n, seed):
    random.seed(seed)
    return ["".join(random.choice(parts) for _ in range(n)) for _ in range(400)]


PII_TEXTS = ["", None, "write to a.b@c.de or call +1 (555) 123-4567", "4111 1111 1111 1111 and 10.0.0.300, 10.0.0.255", "é😀 x@y.z",
             "9" * 3000, "1." * 3000, "a@" * 2000, "+1((((" * 500] + noise(["a", "b@", "@", "x.y", ".", "1", "23", "255", "+", " ", "-", "(", "4111 1111 1111 1111", "é"], 50, 1)
SECRET_TEXTS = ["", None, "token: abcdefgh", "ſecret=abcdefgh1"] + noise(
    ["token", "PASSWORD", " ", "=", ":", '"', "'", "abcd1234", "e3b0c442", "AKIA", "ABCDEFGH", "api", "_", "key", "\n", "+", "0" * 9], 40, 2)


def test_base_spans_stay():
    for t in PII_TEXTS:
        assert [tuple(s[:3]) for s in pii.find(t or "") if s.kind in pii.BASE] == base_pii(t or "")
    for t in SECRET_TEXTS:
        assert [tuple(s[:3]) for s in secret_scan.find(t or "") if s.kind in secret_scan.BASE] == base_secrets(t or "")


def test_check_sums_and_context():
    kinds = lambda t: [s.kind for s in pii.find(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("IBAN GB82 WEST 1234 5698 7654 33") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("please call (555) 123-4567") == ["local_phone"] and kinds("row (555) 123-4567") == []
    card = [pii.find(t)[0].score for t in ("visa card 4111111111111111", "number 4111111111111111", "order 4111111111111111")]
    assert card[0] > card[1] > card[2]


def test_mask_joins_overlaps():
    text = "a 10.0.0.1 b x@y.de"
    assert pii.mask(text, pii.find(text)) == "a [IP] b [EMAIL]"
    assert pii.mask("abcdef", [pii.Span("x", 1, 4, 1), pii.Span("y", 2, 5, 1)]) == "a[X]f"


def test_constants_reach_sensitive_names():
    text = 'k = "Zx81kPq02LmN"\napi_secret_v2 = "pre" + k\nplain = "Zx81kPq02Lmm"\ndb.pwd: hunter2hunter\ntoken_hint = "change_me_please"'
    found = [(s.kind, text[s.start:s.end]) for s in secret_scan.find(text)]
    assert found == [("literal", "Zx81kPq02LmN"), ("literal", "hunter2hunter")]
    assert secret_scan.find("k = " * 3000) == []


def test_a_constant_keeps_all_its_literals():
    parts = [f"Zx{i:02d}kPq7LmNw" for i in range(12)]
    split = " + ".join(f'"{p}"' for p in parts)
    values = lambda t: [t[s.start:s.end] for s in secret_scan.find(t)]
    assert values(f"private_key = {split}") == values(f"k = {split}\nprivate_key = k") == parts
    lines = "\n".join(f'k = k + "{p}"' for p in parts)
    assert values(f'k = ""\n{lines}\nj = k\nprivate_key = j\napi_secret = k') == parts
    # neither doubling nor long chains under many names grow beyond the text
    assert values(f'k = "{parts[0]}"\n' + "k = k + k\n" * 3000 + "private_key = k") == parts[:1]
    chain = "".join(f'k = k + "{p}"\nsecret_{i} = k\n' for i in range(250) for p in parts)
    assert values(chain) == parts * 250


def test_no_sensitive_name_is_skipped():
    value = "Zx81kPq02LmN"
    parts = list(secret_scan._NAME_PARTS)
    halves = [p[:i] + "_" + p[i:] for p in parts for i in range(1, len(p))]
    names = parts + halves + [f"{a}{c}{b}" for a in parts for b in parts for c in ("_", "-", ".")]
    names = [n for n in names if secret_scan.name_score(n) >= 0.4]
    assert {"private_signing", "private_access", "api_access", "signing_encryption", "tok_en"} <= set(names)
    for n in names:
        assert [s.kind for s in secret_scan.find(f"{n}: '{value}'")] in (["literal"], ["assign"]), n
    assert secret_scan.find(f"author: '{value}'") == []


def test_queries(spark, documents, folder):
    sf = folder(documents=documents(PII_TEXTS[:60]))
    got = {r["doc_id"]: r for r in pii.op2_pii_checked_spans(spark, sf).collect()}
    for i, t in enumerate(PII_TEXTS[:60]):
        base = base_pii(t or "")
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert got[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert got[i]["spans"] == joined(s[:3] for s in pii.find(t or ""))
    sf = folder(documents=documents(SECRET_TEXTS[:60]))
    got = {r["doc_id"]: r for r in secret_scan.op6_assignment_secrets(spark, sf).collect()}
    for i, t in enumerate(SECRET_TEXTS[:60]):
        base = base_secrets(t or "")
        assert [got[i][f"n_{k}"] for k in secret_scan.BASE] == [sum(s[0] == k for s in base) for k in secret_scan.BASE]
        assert got[i]["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert got[i]["spans"] == joined(s[:3] for s in secret_scan.find(t or ""))


def test_frames(documents):
    docs = documents([(1, "x@y.de and more"), (None, None), (1, "")])
    out = pii.redact(docs)
    assert out.schema == docs.schema
    rows = sorted(out.collect(), key=lambda r: (r["text"] is None, r["text"] or ""))
    assert [(r["doc_id"], r["text"], r["n_chars"], r["spans"]) for r in rows] == [(1, "", 0, 7), (1, "[EMAIL] and more", 16, 7), (None, None, None, 7)]
    assert [len(r["spans"]) for r in secret_scan.find_documents(documents(["token=abcdefgh"])).collect()] == [1]
    assert pii.find_documents(documents([])).collect() == [] and pii.redact(documents([])).collect() == []


@pytest.mark.parametrize("text", ["x=1 password " + "a" * 1_000_000, "password " + "= " * 300_000, "api_key " + "'" * 300_000, "token:\t" * 100_000,
                                  "x=1 token " + "a1_." * 250_000, "k = 'hunter2-hunter2'\npassword: 'Zx81+q9Lm2='\n" * 20_000])
def test_secret_scan_is_linear_in_long_runs(text):
    began = time.process_time()
    secret_scan.find(text)
    assert time.process_time() - began < 10


def test_secret_names_are_read_back_from_the_marks():
    literal = "Zx81+q9Lm2/pT="
    for before in ("private_key = ", '"private_key": ', "--private-key=", "a::b private_key := ", "x == y; private_key=", "5private_key\t=>"):
        assert [s.kind for s in secret_scan._literals(f'{before}"{literal}"')] == ["literal"], before
    for before in ("private_key == ", "private_key://", '"private_key = ', "'private_key\" = "):
        assert not [s for s in secret_scan._literals(f'{before}"{literal}"')] or before.startswith('"'), before
