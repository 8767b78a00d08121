"""The source divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict

from rankloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def plain(rows, most=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(SMALL))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, counts, groups = Counter(), defaultdict(Counter), set()
        for of, source, words in docs:
            if of == lang:
                df.update(set(words))
                counts[source].update(words)
                groups.add(source)
        kept = {w for w, n in df.items() if n >= 3}
        v = len(kept)
        n = {s: sum(counts[s][w] for w in kept) for s in groups}

        def p(c, total, v=v):
            return 1 + 10**9 * (c + 1) // (total + v)

        def f(a, b):
            return (a - b) ** 2 // b

        for s in groups:
            pairs = [(-sum(f(p(counts[s][w], n[s]), p(counts[o][w], n[o])) for w in kept), o) for o in groups if o != s]
            out |= {(lang, s, "pair", o, -x, i) for i, (x, o) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)}
            whole = {w: p(sum(counts[o][w] for o in groups), sum(n.values())) for w in kept}
            terms = [(-f(p(counts[s][w], n[s]), whole[w]), w) for w in kept if counts[s][w] and p(counts[s][w], n[s]) > whole[w]]
            out |= {(lang, s, "term", w, -x, i) for i, (x, w) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most], 1)}
    return out


def test_audit_equals_plain_python(spark):
    rng = random.Random(12)
    words = ["the", "Über", "naïve", "ABC", "x1y", "a_b", "日本", "🙂", "zz", "É", "é"] + [f"w{a}{b}" for a in "abcdef" for b in "ghijk"]
    rows = []
    for _ in range(300):
        text = " ".join(rng.choice(words[: rng.choice((5, 20, 41))]) for _ in range(rng.randrange(0, 40)))
        rows.append((text, rng.choice(("en", "de", None, "")), rng.choice(("a", "b", "b", "b", "ß", None, "c"))))
    rows += [(None, "en", "only"), ("", "xx", "a"), ("one two", "xx", "b"), ("alone", "yy", "z"), ("\x00\x7f12", "xx", None)]
    rows += [rows[0]] * 5 + [("long " * 60_000, "en", "a")] * 3
    docs = spark.createDataFrame([(i % 7 or None, *r, i, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, cells string")
    for most in (200, 3):
        got = [tuple(r) for r in divergence.audit(docs, most_terms=most).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, most)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_many_groups_are_joined_without_a_broadcast(spark, monkeypatch):
    rows = [(f"a{i % 3} b{i % 5} c", "en", f"s{i % 11}") for i in range(200)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    got = {tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain(rows)
