import hashlib
import math
import random
import re

from binfall.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind, m[0]) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "", re.ASCII) if valid(kind, m[0])]
    return sorted(found)


def listing(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind, _ in spans)


def check_base(rows, got):
    assert len(got) == len(rows)
    for r in got:
        want = brute(dict(rows)[r.doc_id])
        counts = [sum(x[3] == k for x in want) for k in BASE]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (r, want)
        assert r.base_sha256 == hashlib.sha256(listing(want).encode()).hexdigest(), (r, want)
        assert set(filter(None, listing(want).split(","))) <= set(r.spans.split(","))


CARD = "4539 1488 0343 6467"
FIXED = [
    None,
    "",
    "mail a.b@c.de, a@b.c_d@e.f and x@y. or z@-.-1; @@ a@b..c",
    "ip 1.2.3.4.5.6.7.8 999.1.2.3.4 0001.2.3.255 1.2.3.256 12.34.56",
    f"card {CARD} {CARD.replace(' ', '-')}, {CARD} 1; 4539148803436467x 4111111111111111 0000000000000000",
    "phone +49 (30) 1234-5678. +1 2 +1234567890123456 ++44 20 7946 0958) +1-800-555-0199-",
    "both +1 4539 1488 0343 6467 and 10.0.0.1@mail.example.com \U0001f600 été a@b.co",
    "7" * 30_000 + " " + "a" * 30_000 + " " + "1." * 20_000 + " " + "+1 " * 10_000,
    ("u@h.org 10.1.2.3 " + CARD + " +4930123456 ") * 700,
]


def rows_of(rng):
    alphabet = "01234567890123456789  --..++@@()aZ_é\U0001f600\n"
    return list(enumerate(FIXED + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(300)]))


def test_base_spans(spark, documents):
    rows = rows_of(random.Random(11))
    df = documents([(i, t, "s") for i, t in rows])
    check_base(rows, pii.report(df.select("doc_id", "text")).collect())


def corpus(prose):
    rows = []
    for k in range(4):
        w = prose(40)
        w[20:20] = ["Zanzibar", "secret@corp.example", "common"]
        rows.append(" ".join(w))
    rows += [rows[0], rows[0]]
    rows += [" ".join([*prose(10), "common", *prose(5), "zanzibar" if k == 0 else "word"]) for k in range(30)]
    rows += [" ".join([*prose(8), "Lonely", "once@corp.example"])]
    return list(enumerate(rows))


def brute_terms(rows, reach=64, support=2, generalise=0.75, remove=0.95):
    term = re.compile(r"(?<![^\W_])[^\W\d_][^\W_]{3,}")
    near, n_t, n_c = {}, {}, {}
    for i, text in rows:
        for t in {m[0].lower() for m in term.finditer(text)}:
            n_t[t] = n_t.get(t, 0) + 1
        base = brute(text)
        pairs = []
        for a, _, b, kind, v in base:
            e = (kind, re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower())
            for m in term.finditer(text):
                inside = max(0, a - reach) <= m.start() and m.end() <= a or b <= m.start() and m.end() <= min(len(text), b + reach)
                edge = m.start() == a - reach and a > reach or m.end() == b + reach and len(text) > b + reach
                if inside and not edge:
                    pairs.append((e, m[0].lower(), m.start(), m.end()))
        near[i] = pairs
        for e in {p[0] for p in pairs} or ():
            n_c[e] = n_c.get(e, 0) + 1
    together = {}
    for i, pairs in near.items():
        for e, t, *_ in pairs:
            together.setdefault((e, t), set()).add(i)
    out = {}
    for i, text in rows:
        best = {}
        for e, t, a, b in near[i]:
            docs = together[e, t]
            if len({rows[j][1] for j in docs}) < support:
                continue
            content = math.log2(len(rows) / n_c[e])
            d = math.log2(len(rows) * len(docs) / (n_t[t] * n_c[e])) / content if content > 0 else 0
            kind = "remove" if d >= remove else "generalise" if d >= generalise else None
            if kind:
                best[a, b] = max(best.get((a, b), ""), kind)
        spans = [(a, pii.KINDS.index(k), b, k, "") for (a, b), k in best.items() if not any(a < y and x < b for x, _, y, _, _ in brute(text))]
        out[i] = listing(sorted(brute(text) + spans))
    return out


def test_terms_that_reveal(spark, documents, prose):
    rows = corpus(prose)
    got = {r.doc_id: r.spans for r in pii.report(documents([(i, t, "s") for i, t in rows]).select("doc_id", "text"), reach=64).collect()}
    want = brute_terms(rows)
    assert got == want
    assert "remove" in got[0] or "generalise" in got[0]
    assert "Lonely" in rows[-1][1] and got[len(rows) - 1].count(",") == 0


def test_sanitised_texts(spark, documents, prose):
    rows = corpus(prose) + [(100, "to a@b.co, +49 30 12345678; 10.0.0.1!", "s"), (101, None, "s")]
    df = documents([(i, t, "s") for i, t, *_ in rows])
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).columns == df.columns and len(out) == len(rows)
    assert out[100].text == "to [EMAIL], [PHONE]; [IP]!" and out[100].n_chars == len(out[100].text)
    assert out[101].text is None
    assert "secret@" not in out[0].text and "[EMAIL]" in out[0].text and "zanzibar" not in out[0].text.lower()
    assert out[10].text == rows[10][1]


def test_native_plan(spark, documents, prose):
    plan = pii.report(documents([(i, t, "s") for i, t in corpus(prose)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table_and_clashing_columns(spark, documents):
    assert pii.report(documents([])).count() == 0
    odd = spark.createDataFrame([(1, "x a@b.co", "k", 3, "m")], "doc_id long, text string, key string, base int, more string")
    assert pii.sanitise(odd).columns == odd.columns
    assert pii.sanitise(odd).first().text == "x [EMAIL]"


def brute_whole(rows, generalise=0.75, remove=0.95):
    word = re.compile(r"(?<![^\W_])[^\W\d_][^\W_]*")
    terms = [{m[0].lower() for m in word.finditer(t)} for _, t in rows]
    held = [{(k, re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower()) for *_, k, v in brute(t)} for _, t in rows]
    out = {}
    for k, (i, text) in enumerate(rows):
        kinds = {}
        for e in held[k]:
            with_e = [j for j in range(len(rows)) if e in held[j]]
            p = len(with_e) / len(rows)
            for t in terms[k]:
                both = [j for j in with_e if t in terms[j]]
                own = len(both) / len({rows[j][1] for j in both})
                given = (len(both) - own + p) / (sum(t in x for x in terms) - own + 1)
                d = math.log2(given / p) / -math.log2(p) if p < 1 else 0
                kinds[t] = max(kinds.get(t, ""), "remove" if d >= remove else "generalise" if d >= generalise else "")
        spans = [(m.start(), 0, m.end(), kinds[m[0].lower()], "") for m in word.finditer(text) if kinds.get(m[0].lower())]
        out[i] = listing(sorted(brute(text) + [(a, pii.KINDS.index(k), b, k, v) for a, _, b, k, v in spans if not any(a < y and x < b for x, _, y, _, _ in brute(text))]))
    return out


def test_terms_anywhere_in_the_text(spark, documents, prose):
    far = [(200 + k, " ".join(["Bo", *prose(60), "far@corp.example", "Bo", *prose(60), "Mirabel"])) for k in range(6)]
    rows = corpus(prose) + far + [(300 + k, " ".join(prose(20))) for k in range(60)]
    df = documents([(i, t, "s") for i, t in rows])
    want = brute_whole(rows)
    assert {r.doc_id: r.spans for r in pii.report(df.select("doc_id", "text")).collect()} == want
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i, _ in far:
        assert not re.search("Bo|Mirabel|far@", out[i]) and want[i].count("generalise") + want[i].count("remove") >= 3
    assert "Lonely" in out[len(corpus(prose)) - 1]
