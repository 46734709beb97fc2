import random
import re

import pytest
from pyspark.sql import functions as F

try:
    import public_tokenizers as P
except ImportError:
    P = None

from bookweave.llm import leakage, residue, tokenize  # noqa: E402

ODD = [
    None, "", " ", "\n\n\n", "   x", "x   ", "<|endoftext|>", "it's we'll I'd", "don''t 'S", "a b c　d\u0085e\u001cf", "naïve Ωmega 数量板 สมาน กนก", "👩‍💻🏳️‍🌈 é", "𝕮𝟘𝔅 ｆｗ－ｄ",
    "aaaaaaaaaaaaaaaaaaaaaaaa", "======" * 50, "\t\t  \r\n \r", "0123456789" * 30, "x" * 3000, "def f(x):\n    return x+1\n" * 400, "\x00\x01�﻿", "ab" * 700 + " " * 900,
]


tokenizers_only = pytest.mark.skipif(P is None, reason="no tokenizer files")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    pool = [*map(chr, range(32, 127)), *"\n\t éßñжλ数日กא🌈𝟙½²٣", "the ", "return ", "self.", "  "]
    return ODD + ["".join(rng.choices(pool, k=rng.randrange(1, 200))) for _ in range(150)]


@tokenizers_only
def test_ids_equal_both_libraries_and_decode_back(spark, texts):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    enc = tokenize.Encoder()
    rows = {r.doc_id: r for r in tokenize.with_ids(df).withColumn("back", enc.decode(F.col("ids"))).collect()}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tt = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, x in enumerate(texts):
        assert rows[i].ids == t.encode(x or "", add_special_tokens=False).ids == tt.encode_ordinary(x or "")
        assert rows[i].back == (x or "")


@tokenizers_only
def test_every_entry_encodes_to_itself(spark):
    enc = tokenize.Encoder()
    words = [(i, e.decode()) for e, i in enc.entries.items() if e.decode("utf-8", "replace").encode() == e]
    df = spark.createDataFrame(words, "id int, w string").repartition(8)
    assert df.where(enc.fold(F.col("w")) != F.array(F.col("id").cast("bigint"))).count() == 0


@tokenizers_only
def test_longer_texts_than_a_stretch(spark, monkeypatch):
    text = " ".join(f"word{i % 50} qzx{i % 7}" for i in range(400))
    a = spark.createDataFrame([(text,)], "text string")
    whole = tokenize.with_ids(a).first().ids
    monkeypatch.setattr(tokenize, "STRETCH", 16)
    assert tokenize.with_ids(a).first().ids == whole
    assert tokenize.with_ids(a.limit(0)).count() == 0


def brute(docs, items, n=12):
    w = lambda t: re.findall(r"[a-z0-9]+", re.sub(r"[^\x00-\x7f]", " ", t or "").lower())
    grams = {(i, tuple(x[k : k + n])) for i, *sides in items for s in sides for x in [w(s)] for k in range(len(x) - n + 1)}
    by = {}
    for i, g in grams:
        by.setdefault(g, set()).add(i)
    return {(d, i) for d, t in docs for x in [w(t)] for k in range(len(x) - n + 1) for i in by.get(tuple(x[k : k + n]), ())}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=40)), " ".join(rng.choices(vocab, k=rng.choice([5, 30])))) for i in range(30)]
    docs = []
    for d in range(80):
        words = rng.choices(vocab, k=100)
        if d % 2:
            src = rng.choice(items)[1].split()
            a = rng.randrange(25)
            words[50:50] = src[a : a + rng.choice([11, 12, 13])]
        docs.append((d, "".join(x.upper() + rng.choice([" ", "\n", "--", "é", ", "]) for x in words)))
    return docs + [(100, None), (101, ""), (102, " \n"), (103, "w1 " * 5)], items + [(90, None, None), (91, "", "short"), (92, items[0][1], None)]


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    return d.unionByName(d.limit(3)), spark.createDataFrame(items, "item_id long, prompt string, solution string").withColumn("text", F.lit("clash"))


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = corpus(1)
    d, b = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 10
    assert sorted(map(tuple, leakage.leaks(d, b).collect())) == sorted(want)
    assert sorted(map(tuple, leakage.leaks(d, b, block_bytes=200_000).collect())) == sorted(want)
    assert leakage.leaks(d.limit(0), b).count() == leakage.leaks(d, b.limit(0)).count() == 0


def test_very_long_texts_are_cut_without_loss(monkeypatch):
    import pyarrow as pa

    docs, items = corpus(2)
    text = " ".join(t or "" for _, t in docs)
    monkeypatch.setattr(leakage, "PIECE", 300)
    block = leakage.Block(items, [leakage.Walk(12, 36, 7)], 12)
    got = set()
    for buf, cuts, doc in leakage._pieces(pa.array([text, None, "", "z" * 2000 + " " + text]), 12):
        got |= block.found(buf, cuts, doc, 0)
    assert got == {(d, i) for _, i in brute([(0, text)], items) for d in (0, 3)}


@pytest.mark.parametrize("size", [12, 30, 60])
@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_edited_passages_are_found_with_the_target_recall(kind, size):
    """One edit inside a passage as long as the item, defaults planned from the recall; every kind of edit on its own."""
    import numpy as np

    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(2000)]
    bits, repeats = leakage.plan(size, 1)
    assert repeats > 1
    items = [(i, " ".join(rng.choices(vocab, k=size)), None) for i in range(100)]
    block = leakage.Block(items, [leakage.Walk(size, bits, 7 + r, 1) for r in range(repeats)], size)
    hits = 0
    for i, p, _ in items:
        w = p.split()
        at = rng.randrange(1, size - 1)
        w[at : at + (kind != "insert")] = [] if kind == "delete" else ["edit"]
        text = " ".join(rng.choices(vocab, k=20) + w + rng.choices(vocab, k=20)).encode()
        found = block.found(np.frombuffer(text, np.uint8), np.array([0]), np.array([i]), 1)
        assert found <= {(i, i)}
        hits += bool(found)
    assert hits >= 90


def test_edits_in_whole_tables(spark):
    docs, items = corpus(3)
    d, b = frames(spark, docs, items)
    got = {tuple(r) for r in leakage.leaks(d, b, edits=1).collect()}
    assert brute(docs, items) <= got


REAL = "import os\n\ndef load_names(path, limit):\n    with open(path) as handle:\n        return [line.strip() for line in handle][:limit]\n\nTABLE = load_names('names.txt', 40)\n"


def test_residue(spark):
    bad = [
        "404: Not Found", '{"message": "Forbidden", "status": "403"}', "<html><head><style>.a{margin:1px} .b{gap:2px}</style></head><body><p>The link you followed has run out.</p></body></html>",
        "// SPDX-License-Identifier: MIT\n// Copyright 2019 the x authors\n// {{ title }}\n\n// __VERSION__: <your module>\n", "# My Project\n\n## About\n\nSay who should use it and why.\n",
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit.\nSed do eiusmod tempor incididunt ut labore.\n", "<noscript>Please turn on JavaScript and reload the page.</noscript><div id=\"root\"></div>", "foo bar baz foo bar baz foo bar baz", "sample text sample text sample text sample text\n",
        "fatal: could not read blob 535633da02 from katu.example\nerror: fetch stopped after 50 s\n",
        "Traceback (most recent call last):\r\n  File \"/srv/a.py\", line 3, in run\r\nTimeoutError: no answer\r\n",
    ]
    good = [
        None, "", " \n\t", REAL, REAL + "# TODO: handle 404 Not Found\n", REAL + 'PAGE = "<noscript>Please turn on JavaScript</noscript>"\n', REAL + 'WORDS = "lorem ipsum dolor".split()\n',
        "{{- range $k, $v := .Values.index }}\n  - name: {{ $k | quote }}\n    value of this entry: {{ $v.key }}\n{{- end }}\nports for the inner service: 80 and more\nreplicas kept by this chart: 3\n",
        "#!/bin/sh\n# writes the starter files\nsed -e \"s/__NAME__/${NAME}/g\" skeleton/README.in > README.md\nfor f in skeleton/*.in; do\n  expand_one_file \"$f\" into the target folder\ndone\ncp -r templates/all of/the/files target\n", "x " * 30000,
    ]
    rows = [(i, t, "r" if i % 2 else None) for i, t in enumerate(bad)] + [(100 + i, t, "r") for i, t in enumerate(good)]
    d = spark.createDataFrame(rows, "doc_id long, text string, repo string").withColumn("h", F.lit("clash")).withColumn("host", F.lit(1))
    got = [r.doc_id for r in residue.residue(d.unionByName(d.where("doc_id = 0"))).collect()]
    assert sorted(got) == list(range(len(bad)))
    assert residue.without_residue(d).count() == len(good)
    assert residue.residue(d.limit(0)).count() == 0


def test_boilerplate_is_what_different_documents_share(spark):
    head = "// shared banner of this house\n"
    docs = [(i, head + f"unique line number {'x' * i} of a file\nand its own end {'y' * i}\n", "r") for i in range(12)]
    docs += [(50 + i, "copied line of one file\nagain the same line here\n", "r") for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string, repo string")
    assert residue.boilerplate(d).count() == 1


@tokenizers_only
def test_both_forms_of_the_tokenizer_agree(spark, texts, monkeypatch):
    """``with_ids`` against the column expressions, whatever the pieces and the words kept, rows repeated and other columns kept."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts + texts[:9])], "doc_id int, text string").repartition(3)
    want = {r.doc_id: r.ids for r in df.select("doc_id", tokenize.Encoder().encode(F.col("text")).alias("ids")).collect()}
    for piece, known in ((tokenize.PIECE, tokenize.KNOWN), (7, 3)):
        monkeypatch.setattr(tokenize, "PIECE", piece)
        monkeypatch.setattr(tokenize, "KNOWN", known)
        assert {r.doc_id: r.ids for r in tokenize.with_ids(df).collect()} == want
    assert tokenize.with_ids(df).dtypes == [("doc_id", "int"), ("text", "string"), ("ids", "array<int>")]


@tokenizers_only
def test_a_word_is_folded_once_and_in_time():
    """Fails where every word of a text is folded anew, or a long word takes the square of its length."""
    import time

    import pyarrow as pa

    folder, folded = tokenize.Folder(*tokenize.vocabulary(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")), []
    fold = folder.fold
    folder.fold = lambda w: folded.append(w) or fold(w)
    words = pa.array([[" qzxv", "the"] * 5000, [], [" qzxv"] * 5], pa.list_(pa.string()))
    got = folder.encode(words).to_pylist()
    assert folder.encode(words.slice(1)).to_pylist() == got[1:] == [[], fold(b" qzxv") * 5]
    assert folded == [b" qzxv"]
    began = time.process_time()
    assert len(fold(b"qz" * 100_000)) > 1
    assert time.process_time() - began < 20


@tokenizers_only
def test_every_entry_folds_to_itself_in_batches():
    folder = tokenize.Folder(*tokenize.vocabulary(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json"))
    merged = [(e, i) for e, i in folder.entries.items() if i in {*folder.of_byte, *folder.pairs.values()}]
    assert [e for e, i in merged if folder.fold(e) != [i]] == []


@tokenizers_only
def test_batches_need_no_package_on_the_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    folder = tokenize.Folder(*tokenize.vocabulary(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json"))
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(lambda words: folder.encode(words)))
    code = "import pickle, pyarrow as pa; print(pickle.load(open('sent', 'rb'))(pa.array([[' the', 'qzxv']])).to_pylist())"
    run = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.stdout.strip() == str([folder.ids(b" the") + folder.fold(b"qzxv")]), run.stderr
