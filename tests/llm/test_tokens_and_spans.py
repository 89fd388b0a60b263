"""Encoding against two libraries, the transducer, mixing shares, shared spans against brute force."""

import collections
import itertools
import os
import random

import numpy as np
import pytest

from tracelode.llm import encode, mixing, spans, transducer

DOCS = "doc_id bigint, text string, source string, ids string, node int, pos int"
ODD = [None, "", " ", "Hello  world\r\n\r\n", "don't I'LL we've", "<|endoftext|> x", "日本語のテキスト、混在 text", "é​﻿ 　x", "a" * 3000, "👩‍👩‍👧 ok", "\x1c\x1d\x85 tab\t", "１２３ ½ ²", "word " * 5000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1, 2) for i, t, s in rows], DOCS)


@pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no vocabulary files")
def test_encoding_is_exact(spark):
    from tokenizers import Tokenizer

    random.seed(2)
    texts = ODD + ["".join(random.choice(" abcde\n.,'é数0") for _ in range(200)) for _ in range(40)]
    tok = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in encode.encode_documents(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3), "doc_id").collect()}
    enc = encode.vocabulary(encode.TOKENIZERS, "byte_bpe_50k")
    for i, t in enumerate(texts):
        assert got[i] == (tok.encode(t, add_special_tokens=False).ids if t else []), repr(t)
        assert enc.decode(got[i]) == (t or "")
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", "text")).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode.encode_documents(docs(spark, []), "doc_id").count() == 0


def test_transducer_round_trip(tmp_path):
    random.seed(5)
    words = {"".join(random.choice("abc") for _ in range(random.randint(1, 7))).encode(): [random.randint(0, 9) for _ in range(random.randint(1, 4))] for _ in range(500)}
    words["ação".encode()] = [7]
    path = tmp_path / "x.bin"
    path.write_bytes(transducer.compile_lexicon(words))
    lex = transducer.Lexicon(path)
    asked = [*words, b"", b"zz", b"abcabcabcabc", b"a\xff"]
    places = lex.find(asked)
    for w, p in zip(asked, places):
        assert (p >= 0) == (w in words) and (p < 0 or list(lex.output(p)) == words[w])
    assert len(lex.final) < sum(map(len, words))  # shared suffixes
    path.write_bytes(transducer.compile_lexicon({}))
    assert list(transducer.Lexicon(path).find([b"a"])) == [-1]


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "b", "c", None, "A "][k], int(rng.integers(5, 60))) for i, k in enumerate(rng.choice(5, 6000, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]
    tokens = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id bigint, source string, n_tokens bigint, copies string, rate double")
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.1, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.mix_report(tokens, targets, "doc_id").collect()}
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(got[s].actual_share - share) < 0.02 and got[s].most_repeats <= got[s].max_repeats
    assert got["none"].mixed_tokens == 0 and got[""].mixed_tokens == 0 and max(r.rate for r in got.values()) == 3.0
    copies = collections.Counter(r.doc_id for r in mixing.mix(tokens, targets, "doc_id").collect())
    assert sum(copies.values()) == sum(r.mixed_documents for r in got.values()) and max(copies.values()) == 3
    assert mixing.mix(tokens.limit(0), targets, "doc_id").count() == 0
    assert mixing.mix_report(tokens, targets.limit(0), "doc_id").agg({"mixed_tokens": "sum"}).first()[0] == 0


def brute_pairs(rows, span):
    where = collections.defaultdict(set)
    for i, t, _ in rows:
        for k in range(len(t or "") - span + 1):
            where[t[k : k + span]].add(i)
    return where, {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}


@pytest.mark.parametrize("span", [8, 40])
def test_spans_equal_brute_force(spark, span):
    random.seed(span)
    make = lambda n: "".join(random.choice("ab é數") for _ in range(n))
    shared = [make(span + random.randint(-3, 30)) for _ in range(6)]
    rows = [(i, make(random.randint(0, 60)) + random.choice(shared) + make(random.randint(0, 60)), "s") for i in range(1, 60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, rows[0][1], "s"), (103, "x" * 500, "s"), (104, "y" + "x" * 300, "s"), (105, "x" * 500, "s")]
    where, want = brute_pairs(rows, span)
    got = [tuple(r) for r in spans.shared_span_pairs(docs(spark, rows).repartition(3), "doc_id", "text", span).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    extent = {r.id: r.shared_chars for r in spans.shared_extent(docs(spark, rows), "doc_id", "text", span).collect()}
    for i, t, _ in rows:
        hit = set()
        for k in range(len(t or "") - span + 1):
            if len(where[t[k : k + span]]) > 1:
                hit |= set(range(k, k + span))
        assert extent[i] == len(hit)


def test_no_documents(spark):
    assert spans.shared_span_pairs(docs(spark, []), "doc_id", "text", 300).count() == 0
    assert spans.shared_extent(docs(spark, []), "doc_id", "text", 300).count() == 0


def test_chosen_places_cover_every_stretch():
    rng = np.random.default_rng(3)
    for n, every, top in ((300, 20, 1000), (300, 40, 3), (90, 90, 1), (10, 20, 5), (50, 1, 9)):
        h = rng.integers(0, top, n).astype(np.uint64)
        at = set(spans.chosen(h, every).tolist())
        for i in range(n - every + 1):
            low = h[i : i + every].min()
            assert any(p in at for p in range(i, i + every) if h[p] == low)
