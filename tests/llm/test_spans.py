from __future__ import annotations

import hashlib
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from textquarry.llm.pii import CODES, FAMILIES, KINDS, LABELERS, OPINIONS, VOTES, SpanModel, added, candidates, classifier, decoded, fit, fitted, personal_data, redact, reliabilities
from textquarry.llm.secrets import PLACEHOLDERS, secrets

SF = "/root/testdata/sf0.001"

DIGITS = re.compile("[^0-9]+")


def luhn(v):
    total = 0
    for i, c in enumerate(reversed(v)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def n(m):
    return DIGITS.sub("", m[0])


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(n(m)) <= 19 and luhn(n(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(n(m)) <= 15),
]
_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
SECRET = [
    ("assign", rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PARTS = ["1", "2", "4", "9", "0", ".", " ", "-", "+", "(", ")", "@", "a", "b.", "x@y.co", "_", "%", "é", "🙂", "10.0.0.1", "300.1.1.1", "4111111111111111", "+1 202 555 0100", "\n", "token", "=", '"', ":", "PASSWORD", "AKIA", "ABCD1234EFGH", "deadbeef", "API_key", "Abc1xyz", "/"]


def texts(seed, count):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(count)]


def brute(rules, text):
    # Python's search is quadratic on a long run without an @, which can hold no address
    tried = [(k, p, ok) for k, (name, p, ok) in enumerate(rules) if name != "email" or "@" in text]
    found = sorted((m.start(), k, m.end()) for k, p, ok in tried for m in re.finditer(p, text) if ok(m))
    return [sum(x[1] == k for x in found) for k in range(len(rules))], ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in found)


def test_base_spans(spark, odd):
    rows = spark.createDataFrame([(1000 + i, t, "s", "en") for i, t in enumerate(texts(3, 600))], "doc_id long, text string, source string, lang string")
    df = odd.select("doc_id", "text", "source", "lang").unionByName(rows)
    for op, rules in ((personal_data, PERSONAL), (secrets, SECRET)):
        want = sorted(((r.doc_id, *brute(rules, r.text or "")[0], hashlib.sha256(brute(rules, r.text or "")[1].encode()).hexdigest()) for r in df.collect()), key=repr)
        made = op(df).collect()
        assert sorted(((r.doc_id, *[r[f"n_{k}"] for k, _, _ in rules], r.base_sha256) for r in made), key=repr) == want
        for r in made:
            base = [x for x in r.spans.split(",") if x.split(":")[0] in [k for k, _, _ in rules]]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_long_runs_are_linear(spark):
    rows = [(1, "1" * 300_000), (2, "a" * 300_000 + "@b.c"), (3, "4 " * 100_000), (4, "+1" + " 2" * 100_000), (5, "1.2." * 50_000), (6, "token" + " " * 200_000), (7, "f" * 300_000)]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in personal_data(df).collect()}
    assert got[2].n_email == 1 and got[5].n_ip == 25_000 and got[3].n_card == 0
    assert {r.doc_id: r.n_hex for r in secrets(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}


def test_no_python_in_the_plans(odd):
    for op in (personal_data, secrets, redact):
        assert not re.search("Python|Arrow|Pandas", op(odd)._jdf.queryExecution().executedPlan().toString())


def code(*votes):
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def test_model_tells_reliable_from_random():
    """Labelers that agree and one that votes by chance."""
    rnd, counts = random.Random(2), {}
    for _ in range(4000):
        y = 1 if rnd.random() < 0.4 else -1
        votes = [y if rnd.random() < 0.9 else -y, y if rnd.random() < 0.85 else 0, y if rnd.random() < 0.8 else -y, rnd.choice([-1, 0, 1]), 0]
        counts[5, code(*votes)] = counts.get((5, code(*votes)), 0) + 1
    model = fitted(counts)
    yes, no = model.reliability[5]["form"]
    assert yes[1] > 0.8 > 0.3 > no[1]
    yes, no = model.reliability[5]["before"]
    assert abs(yes[1] - no[1]) < 0.2
    assert model.score(5, code(1, 1, 1, 0, 0)) > 0.5 > model.score(5, code(-1, -1, -1, 0, 0))
    assert fitted({}).score(4, 0) == 0.5


def test_em_equals_span_by_span():
    """The same expectation-maximisation without any grouping, over single spans."""
    rnd = random.Random(5)
    spans = [[rnd.choice([-1, 0, 1]) for _ in LABELERS] for _ in range(300)]
    counts = {}
    for v in spans:
        counts[code(*v)] = counts.get(code(*v), 0) + 1
    prior, table, post = reliabilities(counts, 7)
    odds, n = list(OPINIONS.values()), len(spans)
    believed = [1 / (1 + math.exp(-sum(x * math.log(o) for x, o in zip(v, odds, strict=True)))) for v in spans]
    for _ in range(7):
        share = (sum(believed) + 1) / (n + 2)
        right = []
        for j, o in enumerate(odds):
            each = []
            for truth in (1, -1):
                p = [b if truth > 0 else 1 - b for b in believed]
                opinion = (1 + sum(p) / 10) / (o + 1)
                mass = {v: sum(x for x, s in zip(p, spans, strict=True) if s[j] == v) + opinion * (o if v == truth else 1) for v in (1, -1)}
                each.append({v: m / sum(mass.values()) for v, m in mass.items()})
            right.append(each)
        believed = []
        for s in spans:
            yes, no = share, 1 - share
            for j, v in enumerate(s):
                if v:
                    yes, no = yes * right[j][0][v], no * right[j][1][v]
            believed.append(yes / (yes + no))
    assert abs(prior - share) < 1e-9
    assert all(abs(post[code(*s)] - b) < 1e-9 for s, b in zip(spans, believed, strict=True))
    assert all(abs(table[LABELERS[j]][0][1] - right[j][0][1]) < 1e-9 for j in range(len(LABELERS)))


def test_classifier_as_an_expression(spark):
    rnd = random.Random(8)
    rows = {(rnd.randrange(len(FAMILIES)), rnd.randrange(CODES)): rnd.randrange(1, 50) for _ in range(300)}
    model = fitted(rows)
    df = spark.createDataFrame([(f, c) for f, c in rows], "family int, code int")
    got = df.select("family", "code", model.score_of(F.struct("family", "code")).alias("p")).collect()
    assert all(abs(r.p - model.score(r.family, r.code)) < 1e-9 for r in got)
    # the classifier reproduces probabilities that votes alone decide, and features can tip them
    bias, weights = classifier([(code(*[v] * 5), 10.0, float(v > 0)) for v in (-1, 1)] * 5)
    own = SpanModel({}, {}, {0: bias}, {0: weights})
    assert own.score(0, code(1, 1, 1, 1, 1)) > 0.9 and own.score(0, code(-1, -1, -1, -1, -1)) < 0.1
    assert decoded(code(1, 0, -1, 0, 1) + VOTES * 17) == [1, 0, -1, 0, 1]


def test_numbers_that_the_rules_drop(spark):
    """A run of two numbers fails the rules as a whole; the labelers, taught by those that stand alone, find its parts."""
    cards = ["4539578763621486", "4929123456789012", "4556737586899855", "4024007103939509", "4485275742308327"]
    good = [c for c in cards if luhn(c)]
    rows = [f"see {c} or +1 (212) 555-01{i:02d} soon" for i, c in enumerate(good * 10)]
    rows += [f"batch 9{i}13579246801{i % 10}45 done" for i in range(10, 40)]  # no checksum, no issuer
    run = f"call +1 (269) 555-3296 {good[0]} now and 7000000000000000 {good[1]} then"
    df = spark.createDataFrame(list(enumerate([*rows, run])), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(df).collect()}
    last = got[len(rows)]
    assert (last.n_phone, last.n_card) == (0, 0)
    want = [f"number:{run.index(x)}:{run.index(x) + len(x)}" for x in ("+1 (269) 555-3296", good[0], good[1])]
    assert last.spans.split(",") == want and last.n_number == 3
    assert all(r.spans == "" for r in got.values() if 0 <= r.doc_id - len(good) * 10 < 30)
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[len(rows)] == "call [NUMBER] [NUMBER] now and 7000000000000000 [NUMBER] then"


def test_votes(spark):
    texts = {
        "email noreply@b.de": [1, 1, -1, 1, 0], "version 10.0.0.1 beta": [1, 1, -1, -1, -1], "card 4539 5787 6362 1486, exp": [1, 1, 1, 1, 1], "tel +1 (112) 555-0100": [1, 1, -1, 1, 0],
        "isbn 9790000000000000 items": [0, -1, -1, -1, -1], "Dear Peter Street and": [1, -1, 1, 1, 0], "order 000-12-3456": [1, -1, 0, -1, 0], "iban DE89 3704 0044 0532 0130 01.": [1, -1, 1, 1, 0],
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: [(KINDS[v.kind], FAMILIES[v.family], decoded(v.code)) for v in r.votes] for r in candidates(df, [F.col("text")], "text").collect()}
    assert {t: v[0][2] for t, v in got.items()} == texts and all(len(v) == 1 for v in got.values())
    assert [v[0][:2] for v in got.values()] == [("email", "email"), ("ip", "ip"), ("card", "cards"), ("phone", "phones"), ("number", "cards"), ("name", "names"), ("number", "others"), ("number", "accounts")]
    voted = candidates(df, [F.col("text")], "text")
    assert voted.select(F.explode(added(fit(voted)))).count() <= 4


def test_many_spans_are_linear(spark):
    n = 100_000
    text = " ".join(f"u{i}@b.de" for i in range(n))
    df = spark.createDataFrame([(1, text, "s", "en"), (2, "token = abc123 " * n, "s", "en")], "doc_id long, text string, source string, lang string")
    assert {r.doc_id: r.n_email for r in personal_data(df).collect()} == {1: n, 2: 0}
    assert {r.doc_id: r.n_assign for r in secrets(df).collect()} == {1: 0, 2: n}
    assert redact(df).filter("doc_id = 1").first().text == " ".join(["[EMAIL]"] * n)


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "🙂 mail a.b@c.de or +49 30 1234567, 10.1.2.3.", 0), (2, None, 5), (3, "nothing", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in redact(df, length="n_chars").collect()}
    assert got[1].text == "🙂 mail [EMAIL] or [PHONE], [IP]." and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "nothing"
    assert redact(odd, length="n_chars").columns == odd.columns
    assert KINDS[:4] == ["email", "ip", "card", "phone"]


def test_ownership(spark):
    live, copied = "Zx9Kq2LmP0aTy7RbWc3E", "Qw8Er5Ty2Ui9Op3As6Df"
    rows = [(1, f"key {live} here", "o1"), (2, f"again {live}", "o1")] + [(10 + i, f"sample {copied} x", f"o{i}") for i in range(4)]
    df = spark.createDataFrame([(i, t, s, "en") for i, t, s in rows], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secrets(df).collect()}
    assert got[1].spans == "live:4:24" and got[2].n_live == 1
    assert got[10].spans == "" and got[10].n_copied == 1


def test_every_candidate_is_live_copied_or_plain(spark):
    """A key in two sources stays; three owners of one shared repository are one place; a placeholder is never live."""
    two, shared, copied = "Zx9Kq2LmP0aTy7RbWc3E", "Qw8Er5Ty2Ui9Op3As6Df", "Hg4Jk7Lz1Xc3Vb9Nm2Qa"
    rows = [(1, f"key {two} here", "o1", "r1"), (2, f"key {two} here", "o2", "r2"), (3, "token = changeme1 password: hunter2x", "o1", "r1")]
    rows += [(10 + i, f"key {shared} here", f"o{i}", "fork") for i in range(3)] + [(20 + i, f"key {copied} here", f"o{i}", f"r{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secrets(df, repository=F.col("repo"), owner=F.col("owner")).collect()}
    assert all(r.n_live + r.n_copied + r.n_plain == (2 if r.doc_id == 3 else 1) for r in got.values())
    assert got[1].spans == got[2].spans == got[10].spans == "live:4:24" and got[20].spans == ""
    assert (got[1].ownership, got[10].ownership, got[20].ownership) == ("4:24:2:2", "4:24:3:1", "4:24:3:3")
    assert (got[3].spans, got[3].n_live, got[3].n_plain) == ("assign:0:17,assign:18:36,live:28:36", 1, 1)


def owned(rows):
    """Live and copied values of (id, text, owner, repository) by plain counting."""
    found = []
    for i, text, owner, repo in rows:
        places = {(m.end() - len(m[2]), m.end()) for m in re.finditer(SECRET[0][1], text or "") if SECRET[0][2](m)}
        places |= {m.span() for _, p, ok in SECRET[1:] for m in re.finditer(p, text or "") if ok(m)}
        base = [m.span() for _, p, ok in SECRET for m in re.finditer(p, text or "") if ok(m)]
        bare = {m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", text or "")}
        bare = {s for s in bare if not any(a < s[1] and s[0] < b for a, b in base) and all(re.search(x, text[slice(*s)]) for x in ("[0-9]", "[A-Z]", "[a-z]")) and len(set(text[slice(*s)])) >= 10}
        found += [(i, s, text[slice(*s)], s in bare, owner, repo) for s in places | bare]
    holders = {}
    for _, _, v, _, owner, repo in found:
        holders.setdefault(v, (set(), set()))
        holders[v][0].add(owner)
        holders[v][1].add(repo)
    out = {i: [set(), 0] for i, *_ in rows}
    for i, s, v, bare, _, _ in found:
        looks = bare or (re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not re.search(PLACEHOLDERS[4:], v, re.I) and len(set(v)) >= 6)
        if min(map(len, holders[v])) >= 3:
            out[i][1] += 1
        elif looks:
            out[i][0].add(s)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_ownership_decides_on_the_driver_s_documents(spark):
    """Keys planted in its documents: some of one source, one in all sources, and a copied assignment."""
    rows = [(r.doc_id, r.text or "", r.source, f"{r.source}/{r.lang}") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rnd = random.Random(7)
    keys = {s: "aA9" + "".join(rnd.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(30)) for s in sorted({r[2] for r in rows})}
    rows = [(i, f"{t} {keys[s]}" if i % 3 == 0 else f"{t} Qw8Er5Ty2Ui9Op3As6Df" if i % 3 == 1 else f'{t} api_key = "k3y{s}zq9"', s, r) for i, t, s, r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    want = owned(rows)
    got = secrets(df, repository=F.col("repo"), owner=F.col("source")).collect()
    for r in got:
        live = {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("live")}
        assert (live, r.n_copied) == (want[r.doc_id][0], want[r.doc_id][1]), r.doc_id
    assert sum(r.n_live for r in got) > 50 and sum(r.n_copied for r in got) > 50


def test_context_proposes_and_the_gazetteer_votes(spark, odd):
    personal = {"Herr {} kam.": "Xaver Maier", "Dear {}, hi": "Ms Okafor", "Dr. {} said": "von O'Neill", "Hallo Peter {}": None, "IBAN {} now": "DE89 3704 0044 0532 0130 00", "passport number: {}.": "C01X00T47", "Konto {},": "AB 1234567"}
    texts = [(t.format(v), v.removeprefix("Ms ")) for t, v in personal.items() if v]
    many = [(f"Peter Maier mailed a{i}@b.de, 555-12-345{i % 10}; order 1234567{i % 10}, Saint Peter Town. Dear Sir and Dear Customers", "") for i in range(40)]
    rows = [(i, t) for i, (t, _) in enumerate(texts * 3 + many)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in personal_data(df).collect()}
    for i, (t, v) in enumerate(texts):
        kind = "number" if any(c.isdigit() for c in v) else "name"
        assert f"{kind}:{t.index(v)}:{t.index(v) + len(v)}" in got[i], (t, got[i])
    (t, _), spans = many[0], got[len(texts) * 3]
    assert not any(x.startswith(f"name:{t.index(w)}:") for x in spans for w in ("Sir", "Customers"))
    long = spark.createDataFrame([(1, "Dear " + "A" * 300_000), (2, "Herr " + "Ab " * 100_000), (3, "DE89 " + "1234 " * 60_000), (4, "Dr. " * 75_000)], "doc_id long, text string")
    assert personal_data(long).count() == 4


def test_long_bare_keys_are_candidates(spark):
    rnd = random.Random(4)
    for size in (200, 201, 5_000):
        key = "aZ9" + "".join(rnd.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(size - 3))
        df = spark.createDataFrame([(1, f"key {key} here", "o1", "en")], "doc_id long, text string, source string, lang string")
        (row,) = secrets(df).collect()
        assert row.spans == f"live:4:{4 + size}" and row.n_live == 1


def test_empty(none):
    assert personal_data(none).count() == 0 and secrets(none).count() == 0
