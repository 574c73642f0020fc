import hashlib
import math
import random
import re

from strata.llm import pii

SCHEMA = "doc_id long, text string, base string, row int"


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
]


def spans(text):
    found = [(m.start(), k, m.end()) for k, (_, rule, ok) in enumerate(RULES) for m in re.finditer(rule, text or "") if ok(m[0])]
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(7)
    pieces = ["a@b.co", "a@b.co_x@y.zz", "é", "😀", "1.2.3.4", "001.2.3.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "4465758382889437", "+1 (663) 555-6869", "+1", "+", "12", "-", " ", ".", "@", "_", "%x@h-.a", "0", "x@y", "+49 30 1234567 89", "\n", "9 9  9"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    slow = [None, "", "a" * 200_000, "1" * 100_000, "1 " * 50_000, "1." * 50_000, "+1" + "-" * 100_000, "a@" * 50_000, "a.b@c.d " * 20_000, "%" * 100_000 + "@x.y"]
    texts += [t and t[: len(t) // 100] for t in slow] + ["é a.b@c.d " * 1000, "4111 1111 1111 1111, " * 300]
    assert pii.personal_data(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(slow)], SCHEMA)).count() == len(slow)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, "a@b.cd", "x", 1), (None, "a@b.cd", "x", 1)]
    found = pii.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(8), disclosure=1.1).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.spans) for r in found) == sorted((d is None, d or 0, spans(t)) for d, t, *_ in rows)
    for r in found:
        said = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() and r.n_term == 0
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in said) for k, *_ in RULES]


def words(text):
    return [(m.start(), m[0].lower(), m.end()) for m in re.finditer(r"[^\W_]+", text)]


def brute_terms(rows):
    """For each row, the places of the terms whose PMI with one of its entities reaches the share; counted pair by pair."""
    n = len(rows)
    beside, anywhere, held = [], [], []
    for _, t, *_ in rows:
        own, bare, at = set(), "", 0
        for k, (_, rule, ok) in enumerate(RULES):
            own |= {f"{k}:{m[0].lower() if k < 2 else digits(m[0])}" for m in re.finditer(rule, t or "") if ok(m[0])}
        for s in spans(t).split(",") if spans(t) else []:
            _, a, b = s.split(":")
            bare, at = f"{bare} {t[at : int(a)]}", int(b)
        bare += f" {(t or '')[at:]}"
        held.append(own)
        beside.append({w for _, w, _ in words(bare)})
        anywhere.append({w for _, w, _ in words(t or "")})
    out = []
    for (_, t, *_), own in zip(rows, held):
        marked, base = set(), [(int(a), int(b)) for _, a, b in (s.split(":") for s in spans(t).split(",") if s)]
        for e in own:
            has = [i for i in range(n) if e in held[i]]
            for w in {w for _, w, _ in words(t or "")}:
                et = sum(w in beside[i] for i in has)
                t_n = max(et, sum(w in a for a in anywhere))
                if et and len(has) < n and math.log(et * n / (len(has) * (t_n + pii.UNSEEN))) >= pii.DISCLOSURE * math.log(n / len(has)):
                    marked |= {(a, b) for a, x, b in words(t) if x == w and not any(p < b and a < q for p, q in base)}
        out.append(marked)
    return out


def test_disclosing_terms_equal_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        text = [rnd.choice([f"w{j}" for j in range(40)]) for _ in range(20)] + [f"only{i}", f"two{i // 2}"]
        if i < 12:
            text += ["Zebra", "bob@corp.com", "zebra"] + (["often"] if i < 8 else [])
        elif i < 30:
            text += ["often"]
        elif i < 34:
            text += [f"a{i}@x.org", f"b{i}@x.org", "10.0.0.7", "zoo"]
        rows.append((i, " ".join(text), "x", 1))
    rows += [(0, rows[0][1], "x", 1), (None, "kim rare 10.0.0.7 corp Kim", "x", 1), (400, None, "x", 1), (401, "", "x", 1), (401, "10.0.0.7", "x", 1), (402, " ".join(f"v{j}" for j in range(3000)) + " x@y.zz", "x", 1)]
    rows += [(1000 + i, f"plain text {i}", "x", 1) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    found = sorted(((r.doc_id, r.spans) for r in pii.personal_data(df).collect()), key=key)
    want = []
    for (d, t, *_), terms in zip(rows, brute_terms(rows)):
        every = sorted([(int(a), k, int(b)) for k, a, b in (s.split(":") for s in spans(t).split(",") if s)] + [(a, "term", b) for a, b in terms])
        want.append((d, ",".join(f"{k}:{a}:{b}" for a, k, b in every)))
    assert found == sorted(want, key=key)
    assert sum(s.count("term") for _, s in found) > 3000
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[TERM] [EMAIL]" in clean[3] and "ebra" not in clean[3] and clean[150] == rows[150][1] and "only31" not in clean[31] and "two15" not in clean[31]


def test_no_python_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.personal_data(empty).count() == 0 and pii.sanitise(empty).count() == 0
    plan = pii.find_spans(spark.createDataFrame([(1, "a@b.cd", "", 0)], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
