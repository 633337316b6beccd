import hashlib
import random
import re

from plumbline.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out, n = [], []
    for kind, p in PATTERNS.items():
        k = 0
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                k += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        n.append(k)
    return n, out


def test_against_plain_python(docs):
    rng = random.Random(9)
    bits = ["a@b.co", "a.b+c@d-e.f.g", "@", "x@y", ".", "1.2.3.4", "256.1.1.1", "01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4041894974608795", "+1 (555) 555-1234", "+44", "+", "-", "(", "é", "\U0001f600", "_", "12", " ", "\n", "DE89370400440532013000"]
    texts = [None, "", "a@b.com_x@y.com", "1.2.3.4.5.6.7.8", "+1+12345678901", "x@a" + ".a" * 30_000, "9" * 60_000, "a" * 60_000, "1 " * 30_000 + "2", "+1" + " " * 60_000 + "2", "1.1.1." * 5_000]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = {r["doc_id"]: r for r in pii.spans(pii.find(docs(list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        n, out = brute(t)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n, (t or "")[:80]
        assert r["base_sha256"] == hashlib.sha256(",".join(out).encode()).hexdigest()
        assert set(out) <= set(filter(None, r["spans"].split(",")))


def test_cards_spelt_digit_by_digit(docs):
    texts = [sep.join("4111111111111111") for sep in (" ", "-")] + ["x 4 1-1 1-1 1-1 1-1 1-1 1-1 1-1 1 y", " ".join("4111111111111112"), "1 2"]
    got = {r["doc_id"]: r for r in pii.spans(pii.find(docs(list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        n, out = brute(t)
        assert n[2] == (i < 3)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == n
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(out).encode()).hexdigest()


def spans(docs, text):
    return pii.spans(pii.find(docs([(1, text), (1, text)]))).collect()


def test_added_spans(docs):
    a, b = spans(docs, "call +1 (269) 555-3296 4524132264652876 or iban DE89 3704 0044 0532 0130 00.")
    assert a == b and a["spans"] == "card:23:39,phone:5:22,iban:48:75"
    assert spans(docs, "order 4524132264652876")[0]["spans"] == "card:6:22"  # base spans need no score
    assert spans(docs, "1 4524132264652876")[0]["spans"] == "card:2:18"
    assert spans(docs, "serial 1 4524132264652876")[0]["spans"] == ""  # a word of other numbers speaks against it
    assert spans(docs, "DE89370400440532013001 nothing here 12345")[0]["spans"] == ""
    assert pii.spans(pii.find(docs([]))).count() == 0


def test_prefilters_lose_nothing(docs):
    rng = random.Random(4)
    good = {"card": "4111111111111111", "long": "6304000000000000", "short": "4222222222222"}
    texts = []
    for _ in range(250):
        digits = rng.choice(list(good.values()))
        texts.append(rng.choice(["", "x ", "9", "- "]) + "".join(d + rng.choice(["", " ", "-", " "]) for d in digits) + rng.choice(["", "y", " 1", "."]))
        texts.append("".join(rng.choice("1.2+@a-( )") for _ in range(rng.randrange(40))))
    texts += ["+1 2 3 4 5 6 7 8 9", "+(1) 2-3-4-5-6-7-8-9", "1.1.1.1", "a@b.c", "a@-.-", "%@1.1"]
    got = {r["doc_id"]: r for r in pii.spans(pii.find(docs(list(enumerate(texts))))).collect()}
    for i, t in enumerate(texts):
        n, out = brute(t)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == n, t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(out).encode()).hexdigest()


def test_recall_by_kind(docs):
    """Every planted item of a kind is found, whatever stands around it."""
    rng = random.Random(7)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return "DE" + f"{98 - int(body + '131400') % 97:02d}" + body

    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    make = {
        "email": lambda: f"ann.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
        "iban": iban,
        "secret": lambda: hexes(40),
    }
    lead = {"iban": ["bank ", "IBAN: "], "secret": ['token = "', "api_key=", "password: "]}
    rows, want = [], {}
    for kind, item in make.items():
        for _ in range(60):
            before = "some words, " * rng.randrange(3) + rng.choice(lead.get(kind, ["", "and ", "at ", "é "]))
            x = item()
            want[len(rows)] = f"{kind}:{len(before)}:{len(before) + len(x)}"
            rows.append((len(rows), before + x + rng.choice([" end", ". And", '"', ""] if kind in lead else [" end", "", " é"])))
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.spans(pii.find(docs(rows))).collect()}
    assert [rows[i][1] for i in want if want[i] not in got[i]] == []


def test_secrets_need_a_known_form_or_words(docs):
    assert spans(docs, "commit " + "0a" * 20)[0]["spans"] == ""
    assert spans(docs, "x AKIA" + "A1" * 8)[0]["spans"] == "secret:2:22"
    r = spans(docs, 'token = "' + "0a" * 20 + '"')[0]
    assert (r["spans"], r["n_spans"]) == ("secret:9:49", 1)
