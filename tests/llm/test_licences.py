import random
import time

from hyperloom.llm import licences as lic


def brute(text):
    w = lic.words(text)
    out = []
    for phrase, label in lic.PHRASES.items():
        p = lic.words(phrase)
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def summary(df):
    return {r["doc_id"]: r for r in lic.summary(lic.scan(df)).collect()}


def test_phrases_against_brute_force(docs):
    rng = random.Random(0)
    pool = "gnu general public license apache mit cc by the version 2 0 licensed under x".split()
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(150)]
    got = summary(docs(rows))
    for i, t in rows:
        n, places = brute(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({b for _, b in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_matching_statistics_against_brute_force():
    rng = random.Random(1)
    texts = {f"t{i}": " ".join(rng.choice("abcd") for _ in range(30)) for i in range(4)}
    a = lic.build(texts, {})
    whole = [lic.words(t) for t in texts.values()]
    runs = {tuple(w[i:j]) for w in whole for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    stream = [rng.choice("abcd") for _ in range(300)]
    for i, (s, n) in enumerate(a.stream([a.vocabulary[c] for c in stream])):
        best = max(k for k in range(31) if k == 0 or (k <= i + 1 and tuple(stream[i + 1 - k : i + 1]) in runs))
        assert n == best
        if n:
            own = tuple(stream[i + 1 - n : i + 1])
            places = sorted((t, e) for t, w in enumerate(whole) for e in range(n, len(w) + 1) if tuple(w[e - n : e]) == own)
            assert a.ends[s] == places


def test_templates(docs):
    apache = "some words before " + lic.TEMPLATES["apache-2.0-notice"].upper() + " and after"
    changed = lic.TEMPLATES["mit-text"].replace("associated documentation", "related notes")
    got = summary(docs([(1, apache), (2, changed), (3, "Licensed under CC BY-NC 4.0."), (4, "permission is a word and so is software")]))
    assert "apache-2.0-notice" in got[1]["labels"].split(",") and got[1]["base_labels"] == "apache"
    assert got[2]["labels"] == "mit-grant,mit-text" and 0.6 <= got[2]["score"] < 1 and got[2]["n_base"] == 0
    assert got[3]["labels"] == "cc-by,cc-by-nc" and got[4]["labels"] == "" and got[4]["score"] == 0
    span = lic.scan(docs([(1, apache)])).first()["spans"][0]
    assert span["first"] == 3


def test_templates_inside_others_have_spans():
    a = lic.build(lic.TEMPLATES, lic.PHRASES)
    spans = {t: (c, f, e) for t, c, f, e in lic.scan_text(a, len(lic.PHRASES), "x y " + lic.TEMPLATES["apache-2.0-notice"])[2]}
    assert spans["apache-2.0"] == (1.0, 2, 9) and spans["apache-2.0-notice"][0] == 1.0
    inner = lic.build({"long": "a b c d e f g h", "short": "c d e f z"}, {})
    assert {t: c for t, c, _, _ in lic.scan_text(inner, 0, "a b c d e f z")[2]} == {"long": 0.75, "short": 1.0}


def brute_spans(template, text):
    """Covered spans of one template: all maximal common runs by comparison, the best chain of them, then the same before and after it."""
    t, w = template.split(), text.split()
    runs = []
    for i in range(len(w)):
        for j in range(len(t)):
            if w[i] == t[j] and not (i and j and w[i - 1] == t[j - 1]):
                n = 0
                while i + n < len(w) and j + n < len(t) and w[i + n] == t[j + n]:
                    n += 1
                if n >= lic.LEAST_RUN:
                    runs.append((i, j, n))

    def covered(part):
        best = {}
        for k, (i, j, n) in enumerate(sorted(part)):
            best[i, j, n] = (n, i, i + n - 1)
            for a, p, m in sorted(part)[:k][::-1]:  # the nearest of equal ones
                over = max(0, a + m - i, p + m - j)
                if a < i and p < j and over < n and i - (a + m) <= 2 * n + 16 and best[a, p, m][0] + n - over > best[i, j, n][0]:
                    best[i, j, n] = (best[a, p, m][0] + n - over, best[a, p, m][1], i + n - 1)
        top, first, last = max(best.values(), key=lambda b: (b[0], -b[1]))
        if top / len(t) < lic.LEAST_COVER:
            return []
        rest = [[r for r in part if r[0] + r[2] <= first], [r for r in part if r[0] > last]]
        return [(top / len(t), first, last)] + [x for r in rest if r for x in covered(r)]

    return sorted(covered(runs)) if runs else []


def test_spans_against_brute_force():
    rng = random.Random(6)
    found = 0
    for _ in range(60):
        texts = {f"t{k}": " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6, 24))) for k in range(3)}
        a = lic.build(texts, {})
        pieces = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(list(texts.values())).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("abcdefghz")
            pieces.append(" ".join(w[rng.randrange(3) :]) + " z" * rng.randrange(3))
        text = " ".join(pieces)
        got = lic.scan_text(a, 0, text)[2]
        for name, template in texts.items():
            want = brute_spans(template, text)
            assert sorted((c, f, e) for t, c, f, e in got if t == name) == want, (template, text)
            found += len(want)
    assert found > 60


def test_every_covered_span_is_returned():
    a = lic.build({"t": "a b c d e f g h"}, {})
    spans = lic.scan_text(a, 0, "a b c d e f g h x a b c d e f g h " + "y " * 50 + "a b c d e f")[2]
    assert sorted((f, e, c) for _, c, f, e in spans) == [(0, 7, 1.0), (9, 16, 1.0), (67, 72, 0.75)]


def test_many_copies_in_linear_time():
    t = " ".join(f"w{k}" for k in range(80))
    half = " ".join(f"w{k}" for k in range(60))
    a = lic.build({"t": t}, {})
    begun = time.monotonic()
    spans = lic.scan_text(a, 0, " ".join([t, half] * 4_000))[2]
    assert time.monotonic() - begun < 60
    assert sorted((f, e, c) for _, c, f, e in spans) == sorted(x for k in range(4_000) for x in ((140 * k, 140 * k + 79, 1.0), (140 * k + 80, 140 * k + 139, 0.75)))


def test_edges(docs, clashing):
    long = "word " * 60_000 + "mit license " * 3
    got = summary(clashing(docs([(1, None), (2, ""), (3, long), (3, long), (None, "MIT-License"), (4, "mitlicense"), (5, "mit é license")])))
    assert got[1]["n_words"] == 0 and got[2]["labels"] == "" and got[3]["n_base"] == 3 and got[3]["first_word"] == 60_000
    assert got[None]["base_labels"] == "mit" and got[4]["n_base"] == 0 and got[5]["n_base"] == 0
    assert lic.scan(docs([(1, "x")]).limit(0)).count() == 0
