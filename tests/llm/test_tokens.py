import random
import time
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F

from orfweave.llm import packing, token_counts
from orfweave.llm import vocabulary as vocabulary_module

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*" \n\t 'sStrevmld1!éa-. x\0ß漢\x1c՘", "<|endoftext|>", " the", "ation"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [None, "", "<|endoftext|>", "l'état's  'station", "long " * 3000, "x" * 5000, *made, *made[:20]]


def test_counts(spark, tokenizer, texts):
    docs = spark.createDataFrame([(k, t, 7, "n") for k, t in enumerate(texts)], "doc_id bigint, text string, id int, n_tokens string")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, PATH).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (want, len((text or "").encode()), want > 512)
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_packing(spark, tokenizer, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    pieces = packing.pack(docs, PATH).withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for k, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.crc == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    # small partitions are packed together: less than a sequence is lost in all
    assert len(by_sequence) * 1024 - sum(p.length for p in pieces) < 1024
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_place_prefers_cheap_sequences():
    got = packing.place(np.array([600, 600, 300, 300]))
    assert sorted((k, j) for k, _, _, j, _ in got) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_binary_junk_is_linear(tokenizer):
    """Pieces that hold the separator, alone and beside others, as fast as the rest."""
    vocabulary = vocabulary_module.Vocabulary.read(PATH)
    encoder = vocabulary_module.Encoder.of(vocabulary)
    texts = ["\0" + "-" * 200_000, "\0\0\0" + "=-" * 1000 + "\0", "plain words", "\0", "a\0b", "\0" * 5000, "x" * 3000 + "\0"]
    began = time.time()
    counts, _, ids = encoder.encode(texts)
    took = time.time() - began
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert took < 5
    assert vocabulary_module.Encoder.of(vocabulary) is encoder


def test_ids_out_of_merge_order(tmp_path):
    import json

    model = json.load(open(PATH, encoding="utf-8"))
    model["model"]["merges"][10:12] = model["model"]["merges"][11:9:-1]
    (tmp_path / "v.json").write_text(json.dumps(model))
    with pytest.raises(ValueError, match="order"):
        vocabulary_module.Vocabulary(str(tmp_path / "v.json"))


def test_packing_odd_rows(spark, tokenizer):
    """Repeated rows, null ids and clashing names; one very long text."""
    rows = [(1, "same text", 5)] * 40 + [(None, "no id", 6)] * 3 + [(2, "word " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id int").selectExpr("*", "1 AS ids", "2 AS offset", "3 AS start")
    pieces = packing.pack(docs, PATH).collect()
    total = {t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows}
    assert sum(p.length for p in pieces) == sum(total[t] for _, t, _ in rows)
    assert sum(p.length for p in pieces if p.doc_id == 1) == 40 * total["same text"] and sum(p.length for p in pieces if p.doc_id is None) == 3 * total["no id"]
    used = {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in used.values():
        ends = [0] + [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


def test_whole_tokens_need_no_merging(monkeypatch):
    """Each proved token has a home that other pieces don't take, and pieces whose slot is a token's are kept all the same."""
    vocabulary = vocabulary_module.Vocabulary.read(PATH)
    encoder = vocabulary_module.Encoder(vocabulary)
    merged = []
    plain, one = encoder._merge, encoder._merge_one
    monkeypatch.setattr(encoder, "_merge", lambda s: merged.append(s) or plain(s))
    monkeypatch.setattr(encoder, "_merge_one", lambda s: merged.append(s) or one(s))
    strange = [f" qzx{k}" for k in range(3000)]
    encoder.encode(strange)
    merged.clear()
    counts, whole, ids = encoder.encode(list(vocabulary.whole))
    assert ids.tolist() == list(vocabulary.whole.values()) and (counts == 1).all() and (whole == 1).all()
    assert not any(merged)
    encoder.encode(strange)
    again = sum(len(m.split("\0")) for m in merged if m)
    assert again < 30


def test_vocabulary_is_read_in_little_memory():
    """A driver reads a vocabulary late in a program: the peak, in a process of its own."""
    import os
    import subprocess
    import sys

    code = "import resource, public_tokenizers, pyspark.sql; from orfweave.llm.vocabulary import Vocabulary; peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; before = peak(); Vocabulary.read(public_tokenizers.path('byte_bpe_50k.json')); print(peak() - before >> 10)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])}
    assert int(subprocess.run([sys.executable, "-c", code], env=env, check=True, capture_output=True, text=True).stdout) < 200
