"""What the findings of round 3 were about."""

import random

import numpy as np


def test_a_text_is_encoded_in_one_call_and_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.token_ids import Encoder

    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain, asked = own.plain, []
    own.plain = lambda text: asked.append(text) or plain(text)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, parts = random.Random(3), [" ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "B", "é", "中", "😀", "'s", "'LL", "12", ".", "́", "\x85", "​", "İ", "_"]
    texts = ["one two  three\n four", *("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000))]
    for text in texts:
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert asked == texts  # not word by word


def test_members_of_a_hot_signature_that_meet_in_a_bucket_come_with_their_first(spark):
    from tessera.llm import partenum_join as p

    passage = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{passage} {' '.join(f'own{i}_{k}' for k in range(30))}") for i in range(20)], "doc_id long, text string")
    rows = [r for r in p.match(p.bucketed_signatures(docs.repartition(5), 1), 1).collect() if r["kind"] == 1]
    members = {}
    for r in rows:
        members.setdefault(r["a"], []).append(r)
    assert any(len(own) == 20 for own in members.values())
    assert all(r["first"] == min(x["b"] for x in own) for own in members.values() for r in own)


def test_words_of_two_languages_have_numbers_of_their_own():
    from tessera.llm.phrase_automata import Shard

    shard = Shard()
    shard.add([b"de x en", b"en x de"], ["en", "de"])
    assert len(set(shard.automaton().word_hashes.tolist())) == len(shard.words) == 6


def test_runs_are_counted_in_one_reading_and_again_if_numbers_clash(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    from tessera.llm import phrase_automata as p

    texts = ["a b c d e f", "x a b c d", "a b c d e", "b c b c b c", "q"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(2)
    plain, longer, seeds, lengths = p._words_and_pairs, p._longer, [], []

    def clash(docs, depth, least, size, seed):
        seeds.append(seed)
        out = plain(docs, depth, least, size, seed)
        return out.withColumn("a", F.when(F.col("b").isNull(), F.lit(7).cast("long")).otherwise(F.col("a"))) if seed == 0 else out

    def spied(*args):
        out = longer(*args)
        lengths.append({len(r["ids"]) for r in out.collect()})
        return out

    monkeypatch.setattr(p, "_words_and_pairs", clash)
    monkeypatch.setattr(p, "_longer", spied)
    got = {r["phrase"]: r["c"] for r in p.count_runs(docs, least=2, size=4).collect()}
    words = [t.split() for t in texts]
    expected = Counter(" ".join(w[i : i + m]) for w in words for m in range(1, 6) for i in range(len(w) - m + 1))
    assert got == {k: c for k, c in expected.items() if c >= 2} | {"": sum(map(len, words))}
    assert seeds == [0, 1] and lengths == [{3}, {4, 5}]


def test_rare_runs_of_frequent_pairs_are_not_reported(spark, monkeypatch):
    """All pairs are frequent and hardly a triple is: what shards report follows the frequent runs, not the triples there are."""
    from collections import Counter

    from pyspark.sql import functions as F

    from tessera.llm import phrase_automata as p

    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(400)) + " ." + " one two three four" * (i % 2) for i in range(60)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)
    frame, rows = type(docs), []
    plain = frame.mapInArrow

    def spied(self, f, schema, *more, **named):
        out = plain(self, f, schema, *more, **named)
        if schema.startswith("ids "):
            rows.append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInArrow", spied)
    got = {r["phrase"]: r["c"] for r in p.count_runs(docs, least=25, size=2000).where(F.col("phrase") != "").collect()}
    words = [[piece.split() for piece in t.split(".")] for t in texts]
    expected = Counter(" ".join(w[i : i + m]) for t in words for w in t for m in range(1, 6) for i in range(len(w) - m + 1))
    assert got == {k: c for k, c in expected.items() if c >= 25}
    long = [k for k in got if k.count(" ") > 1]
    assert long and sum(k.count(" ") == 2 for k in expected) > 7000
    assert sum(rows) <= 2 * 3 * len(long)  # each of three tasks reports a frequent run once, and few others
