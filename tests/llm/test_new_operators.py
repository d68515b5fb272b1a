"""Filter audit, phrase automata and benchmark windows against brute force, and their odd cases."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tessera.llm import benchmark_windows, filter_audit, phrase_automata
from tessera.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string"
NEW = ["op11_filter_audit", "op12_phrase_automata", "op13_benchmark_windows"]


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", NEW)
def test_odd_and_empty_tables(spark, odd_docs, no_docs, folder, name):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f"), (None, "word"), (2, None), (2, "WORD")], "item_id long, text string")
    assert QUERIES[name](spark, folder(documents=no_docs, labels=labels, benchmark=items)).count() == 0
    rows = QUERIES[name](spark, folder(documents=odd_docs, labels=labels.where("false"), benchmark=items.where("false"))).count()
    assert rows == {"op11_filter_audit": 1200, "op12_phrase_automata": 8, "op13_benchmark_windows": odd_docs.count()}[name]


def audit_by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    above = lambda d: math.inf if d is None else d
    least = {}
    for d, text, _, _ in rows:
        least[text or ""] = min(least.get(text or "", math.inf), above(d))
    failed = []
    for d, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": above(d) > least[text],
        }
        failed.append((source or "", d, {k for k, v in fails.items() if v}))
    out = {}
    for part in {s for s, _, _ in failed}:
        own = [(d, f) for s, d, f in failed if s == part]
        lost = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                here = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                lost[letter] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), sum(letter in f for _, f in own) - len(here), sum(f == {letter} for _, f in own),
                    sum(d in good for d, _ in here), sum(d in toxic for d, _ in here), letter]
        for key, row in out.items():
            if key[0] == part and isinstance(row[-1], str):
                row[-1] = lost[row[-1]]
    return out


def test_audit_by_hand(spark, folder):
    """Runs of equal texts over many ranges, ties of doc_id, nulls."""
    rng = random.Random(3)
    long = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (200, 250, 199)]
    texts = [*long, long[0] + " #", "X" + long[1], None, "", "few words", " ".join(f"w{i}" for i in range(300))]
    rows = [(rng.choice([None, *range(400)]), rng.choice(texts), None, rng.choice(["s", "t", None])) for _ in range(300)]
    rows += [(i, long[0], None, "s") for i in range(1000, 1400)] + [(7, long[1], None, "s")] * 40
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1200, 3)] + [(3, 1, 1)]
    where = folder(documents=spark.createDataFrame(rows, DOCS), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    expected = audit_by_hand(rows, labels)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 23):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = filter_audit.op11_filter_audit(spark, where).collect()
            assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def phrases_by_hand(rows, least, top, depth=5):
    counts, total = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, depth + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, f in counts.items():
        found = []
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def test_phrases_by_hand(spark):
    """Small shards, phrases within others, overlaps, breaks, languages and nulls."""
    rng = random.Random(5)
    some = ["the old", "The old man", "a a a a", "é中 \x1c x", "in the old", "of", "b", "c\td", "never ever again my friend now", ". ", "! ", "\n", ",", "Ä-b"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "..", " \t "]
    rows = [(i, t, rng.choice(["en", "de", None, "und"]), None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for least, top, size in ((2, 2000, 100), (7, 20, 1 << 20)):
        got = phrase_automata.collocations(docs, least=least, top=top, size=size)
        expected = phrases_by_hand(rows, least, top)
        assert len(expected) > 40 and {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == expected
    for depth in (2, 3):
        got = phrase_automata.collocations(docs, depth=depth, least=5, size=500)
        assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == phrases_by_hand(rows, 5, 2000, depth)


def test_scores_beyond_64_bits(spark, monkeypatch):
    """1000 * a * n and l * r are exact where they pass 64 bits."""
    big = 3 * 10**12 + 7
    runs = [("x", "", 5 * big + 1), ("x", "p", 4 * big), ("x", "q", 2 * big + 1), ("x", "p q", big)]
    monkeypatch.setattr(phrase_automata, "count_runs", lambda *_: spark.createDataFrame(runs, "lang string, phrase string, c long"))
    row = phrase_automata.collocations(spark.range(1)).first()
    assert row["score"] == 1000 * big * (5 * big + 1) // (4 * big * (2 * big + 1))


def test_automaton():
    """Counts of all runs; states are chains of suffixes that end at the same places."""
    ids = np.array([-1, 0, 1, 0, 1, 2, -1, 0, 1, 2, 2, 2, -1, 3])
    made = phrase_automata.SuffixAutomaton(ids, np.arange(4).astype(np.uint64))
    for _ in range(3):
        made.deepen()
    got = {}
    for longest, shortest, place, count in made.states():
        for s, at, c in zip(shortest.tolist(), place.tolist(), count.tolist(), strict=True):
            for m in range(s, longest + 1):
                run = tuple(ids[at - m + 1 : at + 1].tolist())
                assert run not in got
                got[run] = c
    expected = Counter(tuple(ids[i : i + m].tolist()) for m in range(1, 5) for i in range(len(ids) - m + 1) if -1 not in ids[i : i + m])
    assert got == expected
    assert sum(len(place) for _, _, place, _ in made.states()) < len(expected)


def test_filter_finds_all():
    rng = np.random.default_rng(1)
    held, other = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(0, 2**63, 3000).astype(np.uint64)
    words = np.zeros(1 << 10, np.uint64)
    np.bitwise_or.at(words, ((held & np.uint64(2**16 - 1)) >> np.uint64(6)).astype(int), np.uint64(1) << (held & np.uint64(63)))
    only = phrase_automata.Filter(words)
    assert only.holds(held).all() and only.holds(other).mean() < 0.1


def windows_by_hand(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wanted = {}
    for item, text in items:
        w = split(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w and item is not None else 0):
            wanted.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text, _, _ in docs:
        w, hit, found = split(text), set(), set()
        for i in range(len(w)):
            for k in range(1, window + 1):
                own = wanted.get(tuple(w[i : i + k])) if i + k <= len(w) else None
                if own:
                    hit.update(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [benchmark_windows.SMALL, 0])
def test_windows_by_hand(spark, small):
    """Items of all lengths, passages that many documents share, overlaps, copies, both kinds of join."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "aébZ中" for b in "xy0"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "-"]) for _ in range(n))
    shared = text(40)
    items = [(i, text(n)) for i, n in enumerate([1, 2, 4, 5, 7, 9, 10, 11, 30, 30])] + [(20, shared), (21, shared), (22, " ".join(shared.split()[5:20])), (20, "once more"), (None, "ax"), (23, None), (24, "..")]
    docs = [(i, text(rng.randint(0, 60)), None, None) for i in range(30)]
    docs += [(100 + i, f"{text(3)} {shared.upper() if i % 2 else shared} {text(2)}", None, None) for i in range(20)]
    docs += [(200 + i, f"{items[i % 10][1]} {items[i % 10][1]}", None, None) for i in range(20)]
    docs += [(300, " ".join(shared.split()[:12]), None, None), (300, shared, None, None), (300, shared, None, None), (None, shared, None, None), (301, None, None, None), (302, "Once-MORE", None, None)]
    for other in (items[:3], items[6:], items):
        found = benchmark_windows.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(other, "item_id long, text string"), small=small)
        got = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("s"), F.col("n_hit") > 0).collect()
        assert sorted((tuple(r) for r in got), key=repr) == windows_by_hand(docs, other)
    with pytest.raises(ValueError, match="window"):
        benchmark_windows.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), window=12)
