"""Secrets, licences, mixing, sharding and exact dedup against plain Python."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

from orfweave.llm import exact_dedup, license_scan, mixing, secret_scan, sharding
from orfweave.llm.common import Scratch

TEXTS = [None, "", " a  b ", "a b", "a\t\nb", "PassWord = 'hunter22' token=ab secret: x", "api_key=secret=abcdefgh AKIA" + "A1" * 9, "é token : f0f0f0f0f0f0f0f0f0f0f0f0f0", "0123456789abcdef" * 3 + " AKIAXX", "word " * 4000]


def frame(spark, rows=None):
    rows = [(k, t, f"s{k % 3}" if k % 4 else None, "x") for k, t in enumerate(TEXTS)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, id string")


def brute_spans(text):
    rules = (("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24))
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(rules) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_secrets(spark):
    ledger = secret_scan.Ledger(spark, Scratch(spark, "test").path("ledger"))
    docs = frame(spark)
    got = {r.doc_id: r.s for r in secret_scan.scan(docs, ledger).withColumn("s", secret_scan.listed("spans")).collect()}
    assert got == {k: brute_spans(t) for k, t in enumerate(TEXTS)}
    own = secret_scan.rule_version(secret_scan.RULES)
    before = ledger.read(own).count()
    assert before == len({t or "" for t in TEXTS})
    # nothing is scanned again; a new rule version scans all
    assert secret_scan.scan(docs, ledger).count() == len(TEXTS) and ledger.read(own).count() == before
    secret_scan.scan(docs, ledger, version="2")
    assert ledger.read("2").count() == before
    # rows that two runs have both written count once; edited rules have another version
    ledger.append(ledger.read("2"), "2")
    assert secret_scan.scan(docs, ledger, version="2").count() == len(TEXTS)
    assert secret_scan.rule_version(secret_scan.RULES[:2]) != own
    empty = secret_scan.Ledger(spark, Scratch(spark, "test").path("ledger"))
    assert secret_scan.scan(docs.limit(0), empty).count() == 0


def test_secrets_read_unseen_texts_only(spark, monkeypatch):
    """A second run scans nothing and moves no text; an increment finds its texts without moving the others. Null and repeated
    ids keep their rows."""
    ledger = secret_scan.Ledger(spark, Scratch(spark, "test").path("ledger"))
    rows = [(k, t, None, None) for k, t in enumerate(TEXTS)] + [(None, "token=abcdef", None, None), (None, None, None, None), (3, "token=abcdef", None, None), (3, "token=abcdef", None, None)]
    plans, texts_of = [], secret_scan._texts

    def spy(addressed, unseen):
        found = texts_of(addressed, unseen)
        plans.append((unseen.count(), found._jdf.queryExecution().optimizedPlan().toString()))
        return found

    monkeypatch.setattr(secret_scan, "_texts", spy)
    docs = frame(spark, rows)
    for _ in range(2):
        got = sorted(((r.doc_id, r.s) for r in secret_scan.scan(docs, ledger).withColumn("s", secret_scan.listed("spans")).collect()), key=str)
        assert got == sorted(((k, brute_spans(t)) for k, t, *_ in rows), key=str)
    more = frame(spark, [*rows, (99, "secret = 'abcdef'", None, None)])
    assert {r.doc_id: r.s for r in secret_scan.scan(more, ledger).withColumn("s", secret_scan.listed("spans")).collect()}[99] == "assign:0:16"
    assert [n for n, _ in plans] == [len({t or "" for _, t, *_ in rows}), 0, 1]
    assert "LocalRelation <empty>" in plans[1][1] or "Limit 0" in plans[1][1]
    assert "LeftSemi" in plans[2][1] and "broadcast" in plans[2][1]


def test_exact_dedup(spark):
    rows = [(k, t, None, None) for k, t in enumerate(TEXTS)] + [(3, "a b", None, None), (None, "a b", None, None), (None, "alone", None, None)]
    docs = frame(spark, rows)
    index = exact_dedup.new_index(spark)
    got = exact_dedup.deduplicate(docs, index, "1").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[norm(t)].append(k)
    assert len(got) == len(rows)
    for r in got:
        members = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [m for m in members if m is not None]
        assert r.keep_id == (min(known) if known else None) and r.group_size == len(members)
    assert sum(r.kept for r in got) == len(groups)
    # an index that knows a text keeps none of its copies
    again = exact_dedup.deduplicate(frame(spark, [(90, "a  b", None, None), (91, "new", None, None)]), index, "2").collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(90, 3, False), (91, 91, True)} or {(r.doc_id, r.keep_id, r.kept) for r in again} == {(90, 2, False), (91, 91, True)}
    kept = exact_dedup.kept_documents(docs, exact_dedup.new_index(spark)).collect()
    assert len(kept) == len(groups) and kept[0].__fields__ == docs.columns
    assert exact_dedup.deduplicate(docs.limit(0), exact_dedup.new_index(spark)).count() == 0


def test_sharding(spark):
    rows = [(k * 7 % 50, "t" * (k * k % 97), None, None) for k in range(200)] + [(None, None, None, None)] * 3
    got = sharding.shard_by_bytes(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    total, by_shard = sum(r.size for r in got), defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
        assert r.text_crc32 in {zlib.crc32((t or "").encode()) for _, t, *_ in rows}
    last = -1
    for s in range(8):
        part = sorted(by_shard[s], key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 8) <= 97
        keys = [1 << 60 if r.doc_id is None else r.doc_id for r in part]
        assert keys == sorted(keys) and keys[0] >= last
        last = keys[-1]
    assert sharding.shard_by_bytes(frame(spark, rows).limit(0)).count() == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in fixed}
        rest = total - sum(fixed.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = {s: 3 * sizes[s] for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mixing(spark):
    rows = [(k, "w " * ((k * 37) % 90 + 1), ("a", "b", "c", None)[min(3, k % 11 % 4)], None) for k in range(400)] + [(900, "w " * 900, "tiny", None), (901, None, "a", None)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 450 if s == "tiny" else 0)
    key = lambda rows: sorted((r.doc_id, r.copies) for r in rows)
    assert key(got) == key(mixing.mix(docs.repartition(5)).collect())
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)
    # every document has the rate of its own size
    for s in sizes:
        rates = {}
        for r in got:
            if r.source == s and r.size:
                assert rates.setdefault(r.size, r.rate) == r.rate
        assert all(0 <= x <= 3 for x in rates.values())
        assert s == "tiny" or abs(sum(r.rate * r.size for r in got if r.source == s) - want[s]) < 1e-5 * want[s]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_license(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/c/x.py", "# Licensed under the Apache License, Version 2.0.\ncode " + "word " * 50),
        ("a/b/y.py", "plain text with mit in it"),
        ("a/b/y.py", "plain text with mit in it"),
        ("ab/z.py", None),
        ("top.py", ""),
        (None, "Licensed under CC BY-NC 4.0."),
        (None, "nothing"),
    ]
    got = Counter((r.path, r.license, r.from_dir) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect())
    assert got == Counter([("a/LICENSE", "MIT", None), ("a/b/c/x.py", "Apache-2.0", None), ("a/b/y.py", "MIT", "a"), ("a/b/y.py", "MIT", "a"), ("ab/z.py", None, None), ("top.py", None, None), (None, "CC-BY-NC-4.0", None), (None, None, None)])
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_exact_dedup_merges(spark, monkeypatch):
    """The index is joined by sort-merge, however small, and isn't shuffled."""
    plans, write = [], exact_dedup.Scratch.write

    def spy(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(exact_dedup.Scratch, "write", spy)
    index = exact_dedup.new_index(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    exact_dedup.deduplicate(docs, index, "0").count()
    again = exact_dedup.deduplicate(docs.union(spark.createDataFrame([(4, "c")], docs.schema)), index, "1").collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in again) == [(1, 1, False), (2, 1, False), (3, 3, False), (4, 4, True)]
    found = [plan for name, plan in plans if name in ("new", "old")]
    assert len(found) == 4 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in found)
    assert all(p.count("Exchange hashpartitioning") <= 1 for p in found)


def test_mixed_documents_with_repeats(spark):
    """Rows that repeat id, source and text come out as often as planned; clashing names and null ids do no harm."""
    rows = [(7, "w " * 9, "a", "x")] * 50 + [(k, "w " * (k % 40 + 1), "ab"[k % 2], "x") for k in range(98)] + [(None, "n " * 5, "a", "y"), (None, "m " * 5, "a", "y"), (None, None, None, "z")]
    docs = frame(spark, rows).withColumnRenamed("id", "copies").selectExpr("*", "1 AS to_id", "2 AS own_key", "3 AS again", "4 AS key_rows")
    plan, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.size] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert (r.copies in "xyz", r.to_id, r.own_key, r.again, r.key_rows) == (True, 1, 2, 3, 4)
        got[r.doc_id, len((r.text or "").split())] += 1
    assert got == Counter({k: n for k, n in plan.items() if n})


def test_mixing_at_every_bound(spark):
    """A single source and sources whose targets are all at three times their sizes."""
    rows = [(k, "w " * (k + 1), "only", None) for k in range(20)]
    assert sum(r.copies * r.size for r in mixing.mix(frame(spark, rows)).collect()) == sum(range(1, 21))
    assert {r.copies for r in mixing.mix(frame(spark, [(1, None, "a", None), (2, "", "b", None)])).collect()} == {1}


def test_exact_dedup_again(spark):
    """A batch that is run again, as after a lost job, gives the same answer; drop() takes the files away."""
    docs = frame(spark, [(k, t, None, None) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], None, None)])
    index = exact_dedup.new_index(spark)
    answers = []
    for _ in range(2):
        rows = exact_dedup.deduplicate(docs, index, "first").collect()
        answers.append(sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows))
    assert answers[0] == answers[1] and sum(a[3] for a in answers[0]) == index.read().count()
    later = exact_dedup.kept_documents(docs.union(frame(spark, [(77, "brand new", None, None)])), index, "second").collect()
    assert [r.doc_id for r in later] == [77]
    # of two batches with one text the smaller name has it
    index.append(index.read().limit(1).selectExpr("digest", "CAST(500 AS BIGINT) AS keep_id", "'early' AS batch"))
    third = exact_dedup.deduplicate(docs, index, "third")
    assert third.count() == len(answers[0]) and third.where("keep_id = 500").count() >= 1
    index.drop()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.path)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_kept_documents_with_clashing_names(spark):
    rows = [(1, "a b", None, "x"), (1, "a  b", None, "y"), (None, "a b", None, "z"), (None, "c", None, "u"), (None, "c", None, "v"), (1, "d", None, "w")]
    docs = frame(spark, rows).selectExpr("*", "1 AS own_digest", "2 AS stay_digest", "3 AS stay_id", "4 AS Digest")
    got = exact_dedup.kept_documents(docs, exact_dedup.new_index(spark))
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text.replace("  ", " "), r.stay_digest) for r in got.collect()) == [(0, "c", 2), (1, "a b", 2), (1, "d", 2)]


def test_sharding_odd_rows(spark):
    """One text larger than a shard, repeated rows, clashing names, null ids."""
    rows = [(5, "t" * 100_000, None, None)] + [(5, "same", None, None)] * 30 + [(None, None, None, None)] * 5
    docs = frame(spark, rows).selectExpr("*", "1 AS size", "2 AS shard", "3 AS part", "4 AS crc")
    got = sharding.shard_by_bytes(docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len(t or "") + 1 for _, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_license_texts_and_headers(spark):
    """Whole licence texts, headers of several lines and wrapped statements; what they give to the files below them."""
    from orfweave.llm.license_texts import TEMPLATES

    mit, apache, bsd = TEMPLATES["MIT"][4], TEMPLATES["Apache-2.0"][2], TEMPLATES["BSD-3-Clause"][2]
    wrap = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(" ".join(text.split()), 70))
    code = "\n\nimport os\n" + "value = compute(value)\n" * 60
    files = [
        ("a/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrap(mit)),
        ("a/x.py", "import os\n"),
        ("b/COPYING.txt", "Copyright 2019 The Authors. All rights reserved.\n\n" + wrap(bsd)),
        ("b/deep/er/y.c", "/* Copyright 2019\n   " + wrap(apache).replace("\n", "\n   ") + "\n*/" + code),
        ("b/deep/z.go", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file." + code),
        ("b/deep/q.sh", "#!/bin/sh\n#\n# Licensed under the Apache\n# License, Version 2.0." + code),
        # a header that is a quarter of its file and more speaks for the directory
        ("b/deep/w.py", "# Copyright 2020\n#\n" + wrap(apache, "# ") + code),
        ("b/deep/none.py", code),
        ("b/none.py", code),
        ("c/long.txt", "word " * 60_000 + "\n" + "Released under the MIT License.\n" * 2 + "word " * 60_000),
        ("c/other.txt", "words about a license and other conditions of use, distributed at large"),
        ("d/LICENSE", "Distributed under the MIT license\n"),
        (None, "Released under the MIT License"),
    ]
    found = {}
    frame_ = spark.createDataFrame([(k if p else None, p, t) for k, (p, t) in enumerate(files)], "doc_id bigint, path string, text string")
    docs = frame_.selectExpr("*", "1 AS license", "2 AS dir", "3 AS file", "4 AS cosine", "5 AS id")
    out = license_scan.scan(docs, id_column="doc_id")
    assert out.columns == ["doc_id", "license", "cosine", "line", "span", "from_dir"]
    for r in out.collect():
        found[files[r.doc_id][0] if r.doc_id is not None else None] = (r.license, r.from_dir)
    assert found == {
        "a/LICENSE": ("MIT", None),
        "a/x.py": ("MIT", "a"),
        "b/COPYING.txt": ("BSD-3-Clause", None),
        "b/deep/er/y.c": ("Apache-2.0", None),
        "b/deep/z.go": ("BSD-3-Clause", None),
        "b/deep/q.sh": ("Apache-2.0", None),
        "b/deep/w.py": ("Apache-2.0", None),
        "b/none.py": ("BSD-3-Clause", "b"),
        "b/deep/none.py": ("Apache-2.0", "b/deep"),
        "c/long.txt": ("MIT", None),
        "c/other.txt": (None, None),
        "d/LICENSE": ("MIT", None),
        None: ("MIT", None),
    }


def test_license_ties_and_model(spark):
    """Of equal cosines the first line, then the shortest run, then the first name; every template holds an anchor and none
    can be matched without one."""
    two = {"B": "alpha beta gamma", "A": "alpha beta gamma", "C": "other words here"}
    files = spark.createDataFrame([(1, "x\nalpha beta gamma\nalpha beta gamma"), (1, "alpha\nbeta gamma"), (2, None), (None, "other words here")], "id bigint, text string")
    got = [(r.id, r.license, r.line, r.span, r.cosine) for r in license_scan.scan(files.selectExpr("*", "CAST(NULL AS STRING) AS path"), two, id_column="id").collect()]
    assert Counter(got) == Counter([(1, "A", 1, 1, 1.0), (1, "A", 0, 2, 1.0), (2, None, None, None, None), (None, "C", 0, 1, 1.0)])
    model = license_scan.Model()
    anchors = set(model.anchors(0.8))
    for k in {t[0] for t in model.terms}:
        assert sum(x * x for n, _, w, x in model.terms if n == k and w not in anchors) <= 0.64


def test_license_scores_every_unit(spark):
    """The words that units must hold drop no match: brute force over all units gives the same."""
    rng = random.Random(3)
    model = license_scan.Model()
    lines = [line for texts in license_scan.TEMPLATES.values() for text in texts for line in text.split("\n")]
    texts = ["\n".join(" ".join(w for w in rng.choice(lines).split() if rng.random() < 0.9) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    got = {r.doc_id: (r.license, r.cosine) for r in license_scan.scan(frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]).withColumnRenamed("source", "path"), id_column="doc_id").collect()}
    weight = {}
    for k, name, w, x in model.terms:
        weight.setdefault((k, name), {})[w] = x
    for d, text in enumerate(texts):
        rows, best = text.split("\n"), (0.0, None)
        for a in range(len(rows)):
            for b in [*range(a + 1, min(len(rows), a + 3) + 1), *([len(rows)] if a == 0 else [])]:
                c = Counter(w for w in re.split("[^a-z0-9]+", " ".join(rows[a:b]).lower()) if w)
                own = {w: (1 + math.log(n)) * model.rarity.get(w, model.unknown) for w, n in c.items()}
                norm = math.sqrt(sum(x * x for x in own.values())) or 1.0
                for (k, name), terms in weight.items():
                    cosine = sum(x * terms.get(w, 0.0) for w, x in own.items()) / norm
                    best = max(best, (round(cosine, 6), name), key=lambda x: x[0])
        if best[0] >= 0.8:
            assert abs(got[d][1] - best[0]) < 2e-6
        else:
            assert got[d] == (None, None)


def test_mixing_solves_all_sources_at_once(spark):
    """The dual by distributed rounds against bisection of each source alone, from far off and near the bounds."""
    sizes = {"near": [(5, 40), (90, 3)], "far": [(1, 1000), (20_000, 1)], "even": [(7, 9)], None: [(3, 5), (4, 5), (300, 2)], "empty": [(0, 4)], "full": [(2, 6)]}
    share = {"near": 2.999, "far": 0.001, "even": 1.0, None: 1.7, "empty": 0.0, "full": 3.0}
    strata = spark.createDataFrame([(s, z, n, z * n) for s, rows in sizes.items() for z, n in rows], "source string, size long, n long, words long")
    total = {s: sum(z * n for z, n in rows) for s, rows in sizes.items()}
    targets = spark.createDataFrame([(s, total[s], share[s] * total[s]) for s in sizes], "source string, source_size long, target double")
    found = {r.source: r for r in mixing.solve(strata, targets, mixing.Scratch(spark, "test")).collect()}
    assert set(found) == set(sizes)
    assert [s for s in sizes if found[s].bound] == ["empty", "full"] and found["even"].tilt == 0.0
    for s in ("near", "far", "even", None):
        scale = total[s] / sum(n for _, n in sizes[s])
        assert abs(found[s].scale - scale) < 1e-12 * scale
        taken = lambda tilt: sum(z * n * 3 / (1 + 2 * math.exp(-max(-700.0, min(700.0, tilt * z / scale)))) for z, n in sizes[s])
        low, high = -1e6, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if taken(mid) < share[s] * total[s] else (low, mid)
        assert abs(taken(found[s].tilt) - share[s] * total[s]) <= 1e-8 * max(1.0, share[s] * total[s])
        assert abs(found[s].tilt - low) <= 1e-5 * max(1.0, abs(low))
