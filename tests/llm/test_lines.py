import math
import random
import re

import pytest

from hyperloom.llm import lines


def run(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup(df).collect()}


BODY = ["alpha beta gamma delta {0}{0}", "one two three four {0}{0} five", "other words here for {0}{0} only"]


def words(i):
    return "".join(chr(97 + int(c)) for c in str(1000 + i))


def body(i):
    return "\n".join(f"{words(i * 7 + k)} {words(i * 11 + k)} {words(i * 13 + k)} {words(i * 17 + k)} end" for k in range(3))


def test_recurring_lines_and_fields(docs):
    rows = [(i, f"{body(i)}\nPage {i} of 90 printed on 2024-01-{i:02d} by robot\nterms and conditions always do apply") for i in range(1, 6)]
    got = run(docs(rows))
    assert got[1] == (rows[0][1], 5, 0)
    for i in range(2, 6):
        assert got[i] == (body(i), 5, 2)


def test_variable_words_are_fields(docs):
    rows = [(i, f"{body(i)}\nthe user called {words(i)} has logged in to the main system again today") for i in range(1, 7)]
    got = run(docs(rows))
    assert got[1][2] == 0 and all(got[i][2] == 1 and got[i][0] == body(i) for i in range(2, 7))


def test_lines_of_few_documents_stay(docs):
    three = [(i, f"{body(i)}\nthis line stands in three documents") for i in range(3)]
    assert all(n == 0 for _, _, n in run(docs(three)).values())


def test_short_lines(docs):
    """Three tokens recur by themselves, one or two with a neighbour."""
    three = [(i, f"{body(i)}\nread more here") for i in range(8)]
    menu = [(10 + i, f"Home\n\nAbout us\n{body(10 + i)}") for i in range(8)]
    alone = [(20 + i, f"{body(20 + i)}\nYes.\n{body(40 + i)}\nNo.") for i in range(8)]
    got = run(docs(three + menu + alone))
    assert [got[i][2] for i in range(8)] == [0] + [1] * 7
    assert [got[10 + i][2] for i in range(8)] == [0] + [2] * 7 and got[11][0] == "\n" + body(11)
    assert all(got[20 + i][2] == 0 for i in range(8))


def test_characters_of_unspaced_scripts_are_tokens(docs):
    shared = "この行はすべての文書に現れる同じ文です"
    rows = [(i, f"{body(i)}\n{shared}") for i in range(5)]
    got = run(docs(rows))
    assert [got[i][2] for i in range(5)] == [0, 1, 1, 1, 1]
    assert tokens("ab 本c\u0e01d") == ["ab", "本", "c", "\u0e01", "d"]


def test_copies_count_once_and_are_treated_alike(docs):
    copies = [(i, f"{body(1)}\nshared line of all the copies") for i in range(6)]
    assert all(n == 0 for _, _, n in run(docs(copies)).values())
    others = [(10 + i, f"{body(20 + i)}\nshared line of all the copies") for i in range(4)]
    got = run(docs(copies + others))
    assert [got[i][2] for i in range(6)] == [0] * 6 and [got[10 + i][2] for i in range(4)] == [1] * 4


def test_edges(docs, clashing, spark):
    long = " ".join(words(i) for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "a b c d e"), (3, long), (3, long), (4, "\n\n")]
    df = clashing(docs(rows))
    out = lines.dedup(df)
    assert out.columns == [c for c in df.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, None, None, None), (2, "", 1, 0), (None, "a b c d e", 1, 0), (3, long, 1, 0), (3, long, 1, 0), (4, "\n\n", 3, 0)], key=repr)
    assert lines.dedup(df.limit(0)).count() == 0


def test_large_leaves_are_split_and_merged(docs, monkeypatch):
    monkeypatch.setattr(lines, "LEAF_LINES", 5)
    rows = [(i, f"{body(i)}\nthe user called {words(i)} has logged in to the main system again today") for i in range(40)]
    got = run(docs(rows))
    assert sum(n for _, _, n in got.values()) == 39


def test_long_lines_are_compared_at_all_positions(docs):
    """Lines of 200 tokens that agree at fixed places only are different lines."""
    keep = {int(k * 197 / 24) + 3 for k in range(24)} | {0, 1, 2}
    rows = [(i, " ".join(words(p * 7) if p in keep else words(i * 400 + p) + "x" for p in range(200))) for i in range(5)]
    assert all(n == 0 for _, _, n in run(docs(rows)).values())


def test_texts_of_very_many_lines(docs):
    """Many dropped lines in one text: work in proportion."""
    many = "\n".join(f"{words(k)}{words(k * 3)} stands here again" for k in range(40_000))
    got = run(docs([(i, f"{words(i)}\n{many}") for i in range(4)]))
    assert [got[i][2] for i in range(4)] == [0] + [40_000] * 3 and got[2][0] == words(2)


def test_user_columns_of_any_name_stay(docs):
    from pyspark.sql import functions as F

    names = ["doc", "copy", "drop", "doc_", "__copy", "__drop", "line", "rows", "a.b"]
    df = docs([(i, f"{body(i)}\nread more here") for i in range(5)]).withColumns({n: F.lit(n) for n in names})
    out = lines.dedup(df, "lines here", "gone")
    assert out.columns == [*df.columns, "lines here", "gone"]
    assert all(r[n] == n for r in out.collect() for n in names) and out.agg(F.sum("gone")).first()[0] == 4


WIDE = re.compile(r"([\u3000-\u9fff\u0e00-\u0eff])")


def tokens(line):
    return WIDE.sub(r" \1 ", line).split()


def brute(rows):
    """doc_id -> numbers of the dropped lines, by comparing every line with every leader of its leaf."""
    texts = {}
    for i, t in sorted(rows):
        texts.setdefault(t, i)
    units = []  # (doc_id, line_no, masked unit, tokens, leaf)
    for t, i in texts.items():
        own = [(k, ["<*>" if re.search("[0-9]", x) else x for x in tokens(v)]) for k, v in enumerate(t.split("\n")) if v.split()]
        for at, (k, w) in enumerate(own):
            if len(w) >= 3:
                units.append((i, k, tuple(w), tuple(w), (len(w), *w[:3])))
                continue
            for other, kind in ((at + 1, "next"), (at - 1, "last")):
                if 0 <= other < len(own):
                    unit = (kind, tuple(w), tuple(own[other][1]))
                    units.append((i, k, unit, (), unit))
    holders = {}
    for i, k, unit, w, leaf in units:
        holders.setdefault((leaf, unit, w), {}).setdefault(i, k)
    order = sorted(holders, key=lambda x: (-len(holders[x]), number(x)))
    template, lead = {}, {}
    for key in order:
        leaf, unit, w = key
        for other in lead.get(leaf, []):
            n = len(w) - 3
            if n > 0 and sum(a == b for a, b in zip(w[3:], other[2][3:])) >= math.ceil(0.75 * n):
                template[key] = other
                break
        else:
            lead.setdefault(leaf, []).append(key)
            template[key] = key
    found = {}
    for key, docs_ in holders.items():
        found.setdefault(template[key], []).extend(docs_.items())
    wide = {t: min(v) for t, v in found.items() if len({i for i, _ in v}) >= 4}
    drops = {}
    for i, k, unit, w, leaf in units:
        first = wide.get(template[leaf, unit, w])
        if first and first != (i, k):
            drops.setdefault(i, set()).add(k)
    for (leaf, unit, w), docs_ in holders.items():
        if len(w) >= 50 and 2 <= len(docs_) < 4:
            first, *later = sorted(docs_)
            for b in later:
                if not versions(units, first, b):
                    drops.setdefault(b, set()).update(k for i, k, u, *_ in units if i == b and u == unit)
    by_text = {t: drops.get(i, set()) for t, i in texts.items()}
    return {i: by_text[t] for i, t in rows}


def versions(units, a, b):
    one, two = ({u: (w[:3], len(w)) for i, _, u, w, _ in units if i == x and w} for x in (a, b))
    heads = {h for h, _ in one.values()}
    shared = [n for h, n in two.values() if h in heads]
    half = [2 * len(shared) >= max(len(one), len(two)), 2 * sum(shared) >= max(sum(n for _, n in x.values()) for x in (one, two))]
    return all(half)


def number(key):
    """The order of lines of equally many texts: by the operator's own hash."""
    import pyarrow as pa

    leaf, unit, w = key
    return int(lines.parse(pa.array([" ".join(w)]))[4][0]) if w else 0


def corpus(seed):
    """Texts with templates of one and more variable words, near templates, short lines, passages, copies and versions."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        own = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.choice([1, 2, 3, 4, 9]))) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 3)):
            w = "the log entry of one user has been seen here once again".split()
            for p in rng.sample(range(3, 12), rng.randint(0, 3)):
                w[p] = rng.choice("pqrstuvwxyz") * 2
            own.insert(rng.randint(0, len(own)), " ".join(w))
        for _ in range(rng.randint(0, 2)):
            own.insert(0, "log log log " + " ".join(rng.choice("ab") for _ in range(rng.choice([3, 4, 6, 9]))))
        if rng.random() < 0.3:
            own.append(f"page {rng.randint(1, 99)} of {rng.randint(100, 999)} at last")
        if rng.random() < 0.3:
            own.append(long_line(rng.randint(0, 12)))
        rows.append((i, "\n".join(own)))
        if rng.random() < 0.1:
            rows.append((1000 + i, rows[-1][1]))
        if rng.random() < 0.1:
            rows.append((2000 + i, rows[-1][1] + "\none more line"))
    return rows


@pytest.mark.parametrize("leaf_lines", [2000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(docs, monkeypatch, leaf_lines, seed):
    """Leaves of any size give what comparing every line with every leader gives."""
    monkeypatch.setattr(lines, "LEAF_LINES", leaf_lines)
    rows = corpus(seed)
    wanted = brute(rows)
    got = run(docs(rows))
    assert sum(map(len, wanted.values())) > 100
    for i, t in rows:
        assert got[i] == ("\n".join(v for k, v in enumerate(t.split("\n")) if k not in wanted[i]), t.count("\n") + 1, len(wanted[i])), i


def long_line(i):
    return " ".join(words((i * 31 + k * 7) % 9000) + words(k * 13 % 9000) for k in range(60))


def test_passages_of_two_documents(docs):
    rows = [(1, f"{body(1)}\n{long_line(1)}"), (2, f"{body(2)}\n{long_line(1)}\nand an own line stands here"), (3, f"{body(3)}\nshort line of two documents only"), (4, f"{body(4)}\nshort line of two documents only")]
    got = run(docs(rows))
    assert [got[i][2] for i in (1, 2, 3, 4)] == [0, 1, 0, 0] and long_line(1) not in got[2][0] and got[2][0].endswith("here")


def test_versions_of_a_document_keep_their_passages(docs):
    shared = "\n".join(long_line(i) for i in range(4))
    got = run(docs([(1, f"{body(1)}\n{shared}"), (2, f"{body(2)}\n{shared}"), (3, f"{long_line(9)}\none more own line here"), (4, f"{long_line(9)}\nyet another own line here")]))
    assert all(n == 0 for _, _, n in got.values())


def test_tokens_of_lines_that_stand_alone_do_not_move(spark, docs):
    from hyperloom.llm import lines

    alike = [f"request served from cache in the region of {w} today" for w in ("north", "south", "east", "west", "centre")]
    table = docs(alike + [" ".join(f"w{i}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(12)) for i in range(400)])
    rows = lines.stored(lines.parsed(table), "test-parsed")
    distinct = lines.stored(lines.distinct_lines(lines.by_text(rows.drop("compared"))), "test-distinct")
    found = lines.crowded(distinct, rows)
    assert found.count() == len(alike)
    moved = lines.maybe_of(rows.select("line", "compared"), found)
    assert len(alike) <= moved.count() < 60 and moved.join(found, "line", "left_semi").count() == len(alike)
