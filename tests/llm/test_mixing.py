import hashlib

import pytest

from vantage.llm import mixing


def h(*parts):
    return int(hashlib.md5("\x1f".join(parts).encode()).hexdigest()[:15], 16)


def fill(children, budget):
    """children: name -> (cap, weight). Whole tokens, by repeated saturation."""
    got, open_ = {}, {k: v for k, v in children.items() if v[1] > 0}
    left = budget
    while open_:
        w = sum(v[1] for v in open_.values())
        full = {k for k, v in open_.items() if v[0] * w <= left * v[1]}
        if not full:
            got |= {k: min(v[0], left * v[1] // w) for k, v in open_.items()}
            break
        for k in full:
            got[k] = open_.pop(k)[0]
            left -= got[k]
    return got


def brute(rows, weights, budget, epochs, seed):
    def domain(s):
        digits = ""
        while s and s[-1].isdigit() and s[-1].isascii():
            digits, s = s[-1] + digits, s[:-1]
        return "other" if not digits else f"domain{int(digits[-9:]) % 4}"

    docs = [(d, t, domain(s or ""), x or "-", s or "-", len((t or "").split())) for d, t, x, s in rows]
    caps = {}
    for _, _, *leaf, n in docs:
        caps[tuple(leaf)] = caps.get(tuple(leaf), 0) + n

    def weight(level, *path):
        own = sum(v for k, v in caps.items() if k[: len(path)] == path)
        return weights[level].get(path[-1], 1) if weights.get(level) else own

    total = sum(caps.values()) if budget is None else budget
    cap = lambda *p: sum(v for k, v in caps.items() if k[: len(p)] == p) * epochs
    got = {}
    for d, b in fill({k: (cap(k), weight("domain", k)) for k in {k[0] for k in caps}}, total).items():
        for x, c in fill({k: (cap(d, k), weight("language", d, k)) for k in {k[1] for k in caps if k[0] == d}}, b).items():
            for s, e in fill({k: (cap(d, x, k), weight("source", d, x, k)) for k in {k[2] for k in caps if k[:2] == (d, x)}}, c).items():
                got[d, x, s] = e
    out = []
    for leaf, t in caps.items():
        b = got.get(leaf, 0)
        whole, rest = (b // t, b % t) if t else (0, b)
        own = [(h(str(seed), str(whole), "" if d is None else str(d)), h(text or ""), d, n) for d, text, *k, n in docs if tuple(k) == leaf]
        for key, tie, d, _ in own:
            used = sum(n for a, b, _, n in own if (a, b) <= (key, tie))
            out += [(str(d), e) for e in range(whole + (used <= rest))]
    return sorted(out)


@pytest.mark.parametrize("weights", [mixing.WEIGHTS, {"source": {"web": 3, "src1": 0}}])
@pytest.mark.parametrize("budget,epochs", [(None, 4), (300, 2), (10**6, 3), (0, 1), (2500, 1)])
def test_against_brute_force(spark, budget, epochs, weights, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    rows = [(i, "tok " * (i * 7 % 23), ["en", "de", "fr", None][i % 4], [f"src{i % 9}", "web", None][i % 3 if i % 5 else 0]) for i in range(160)]
    rows += [(3, "tok tok", "en", "src1"), (3, "tok tok", "en", "src1"), (None, "x y z", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.narrow(docs, "doc_id", "text", "lang", "source").cache()
    chosen = mixing.select(got, mixing.plan(got, weights, budget, epochs, 9), 9)
    assert sorted((str(r.doc_id), r.epoch) for r in chosen.collect()) == brute(rows, weights, budget, epochs, 9)


def test_rows_and_columns_stay_whole(spark, odd, empty):
    frame, rows = odd
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    wide = brute([(r[0], r[1], r[2], r[3]) for r in rows], mixing.WEIGHTS, None, mixing.MAX_EPOCHS, mixing.SEED)
    assert sorted(str(r.doc_id) for r in mixed.collect()) == sorted(d for d, _ in wide)
    assert mixing.mix(empty).count() == 0
