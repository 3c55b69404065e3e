"""Language model, quality, toxicity and licences."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import LONG, alnum_words, documents, labels, no_documents, space_words
from pyspark.sql import functions as F

from kerbside.llm import brown, licenses, quality, toxicity
from kerbside.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
HERE = "true"  # a train condition that every row meets


def base_scores(texts, train):
    """n_tokens, n_known and the unigram score of every text, as the contract words them."""
    split = {i: [*space_words(t), None] for i, t in texts}
    counts = Counter(w for i, t in texts if train(i) for w in [*space_words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    return total, {i: (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)) for i, w in split.items()}


def test_language_model_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    total, expected = base_scores(texts, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    rows = QUERIES["op1_brown"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_far_words_meet_their_counts_by_a_join(spark, monkeypatch):
    """With almost no words carried along, known counts and base scores stay the same."""
    monkeypatch.setattr(brown, "NEAR", 5)
    monkeypatch.setattr(brown, "OWN", 3)
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    train = F.col("doc_id") != 1
    total, expected = base_scores(texts, lambda i: i != 1)
    rows = brown.score(docs, brown.fit(docs, train), keep=["doc_id"]).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {i: (n, k, total) for i, (n, k, _) in expected.items()}
    assert all(r.base_score == pytest.approx(expected[r.doc_id][2]) for r in rows)


def test_probabilities_sum_to_one(spark):
    """Over all known words, the unseen event of each type and the end, after any class."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m, table = brown.fit(docs, F.expr(HERE))
    assert np.allclose((10**m.step).sum(axis=1), 1)
    edge = m.own + brown.ENDINGS
    by_class = np.bincount(m.classes[:edge], weights=10 ** m.emit[:edge], minlength=brown.CLASSES)
    assert np.allclose(by_class[by_class > 0], 1)
    near = set(m.near.view(np.int64)[: m.own].tolist())
    mass = np.zeros(brown.ENDINGS)
    for r in table.collect():
        if r.h not in near:
            mass[r.ending] += (r.n - m.discount) / m.type_tokens[r.ending]
    seen = m.type_tokens > 0
    assert np.allclose(mass[seen] + m.discount * m.type_words[seen] / m.type_tokens[seen], 1)


def test_unseen_words_share_the_mass_of_their_type(spark):
    """Of two new words in the place of a known one, each has the type's left mass over the estimated unseen words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m, table = brown.fit(docs, F.expr(HERE))
    per = {}
    for r in table.collect():
        per.setdefault(r.ending, []).append(r.n)
    counted = [n for ns in per.values() for n in ns]
    once, twice = counted.count(1), counted.count(2)
    word = "qqzz" + next(w for r in docs.collect() if r.text for w in space_words(r.text) if brown.ending(w.encode()) in per)[-3:]
    e = brown.ending(word.encode())
    unseen = max(once * (once - 1) / (2 * (twice + 1)) * per.get(e, []).count(1) / once, 1)
    left = m.discount * m.type_words[e] / m.type_tokens[e] if m.type_tokens[e] else 1
    t, edge = m.own + e, m.own + brown.ENDINGS
    c = [m.classes[edge], m.classes[t], m.classes[edge]]
    expected = m.step[c[0], c[1]] + m.step[c[1], c[2]] + m.emit[t] + math.log10(left / unseen)
    one = spark.createDataFrame([(1, word)], "doc_id bigint, text string")
    assert brown.score(one, (m, table)).first().score == pytest.approx(expected)


def test_exchange_finds_alternating_classes(spark):
    random.seed(2)
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    texts = [(i, " ".join(random.choice(a if k % 2 else b) for k in range(200))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    v = brown.count_words(docs, F.expr(HERE))
    classes, table = brown.exchange(brown.count_pairs(docs, F.expr(HERE), v), v.own, np.concatenate([v.counts[: v.own], v.type_tokens]))
    hashes = {brown.xxhash.xxh64_intdigest(w.encode()): w[0] for w in a + b}
    kinds = {}
    for place, h in enumerate(v.near.tolist()):
        kinds.setdefault(classes[place], set()).add(hashes[h])
    assert all(len(k) == 1 for k in kinds.values())
    assert table.sum() == 60 * 201


def test_language_model_edge_cases(spark):
    docs = documents(spark)
    rows = brown.score(docs, brown.fit(docs, F.expr(HERE))).collect()
    assert len(rows) == 15 and set(docs.columns) <= set(rows[0].asDict())
    assert {(r.n_tokens, r.n_known) for r in rows if not space_words(r.text)} == {(1, 1)}
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in rows)
    untrained = brown.score(docs, brown.fit(docs, F.lit(False)), keep=["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in untrained)
    assert brown.score(no_documents(spark), brown.fit(docs, F.expr(HERE))).count() == 0


def test_quality_query(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = QUERIES["op7_resample"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.selected for r in rows if marks.get(r.doc_id) == 1)
    assert not any(r.selected for r in rows if marks.get(r.doc_id) == 0)


def plain_grams(text):
    """Buckets of words, word pairs, shapes and shape pairs, one by one."""
    top = (1 << 64) - 1
    mixed = lambda x, bits: (x * 0x9E3779B97F4A7C15 & top) >> 64 - bits
    words = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text)]
    names = [zlib.crc32(bytes(c + 32 if 65 <= c <= 90 else c for c in w)) for w in words]
    shapes = [zlib.crc32(quality.shape(w.decode()).encode()) % 65536 for w in words]
    keys = list(zip(names, shapes))
    shapes = [s + 65536 * (i > 0 and keys[i] == keys[i - 1]) for i, s in enumerate(shapes)]
    out = [mixed(n, 16) for n in names] + [mixed(((a * 0x9E3779B97F4A7C15 & top ^ b) + 2**40) & top, 16) for a, b in zip(names, names[1:])]
    return out + [65536 + mixed(s, 14) for s in shapes] + [65536 + mixed((a << 17 | b) + 2**34, 14) for a, b in zip(shapes, shapes[1:])]


def test_log_ratios_by_brute_force(spark):
    texts = ["good words here", "more good words", "BAD!! BAD!! BAD!!", "X## Y##", "plain text", "words", "Good WORDS good", "z@@ z@@"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = [(0, 1), (1, 1), (2, 0), (3, 0), (6, 1), (7, 0)]
    held = {r.id for r in spark.range(8).where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    sides = {(y, i in held) for i, y in marks}
    apart = {(1, False), (1, True), (0, True)} <= sides
    model = quality.fit(docs, labels(spark, [(i, y, 0, "") for i, y in marks]))
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(plain_grams(t))
        if (i, 1) in marks and not (apart and i in held):
            target.update(plain_grams(t))
    ratio = {}
    for kind in (range(65536), range(65536, 65536 + 16384)):
        total, n = sum(raw[b] + 1 for b in kind), sum(target[b] for b in kind)
        weight = {b: (raw[b] + 1) / total * (target[b] + 10) / (n * (raw[b] + 1) / total + 10) for b in kind}
        mass = sum(weight.values())
        ratio |= {b: math.log(weight[b] / mass) - math.log((raw[b] + 1) / total) for b in kind}
    assert np.allclose(model.ratio, [ratio[b] for b in range(len(ratio))])
    rows = {r.doc_id: r for r in quality.resample(docs, model).collect()}
    assert all(r.log_ratio == pytest.approx(sum(ratio[b] for b in plain_grams(r.text))) for r in rows.values())
    assert min(rows[i].log_ratio for i in (0, 1, 6)) > max(rows[i].log_ratio for i in (2, 3, 7))
    assert sum(r.selected for r in rows.values()) == sum(r.log_ratio >= model.cut for r in rows.values())
    top = quality.resample(docs, model, k=2).collect()
    assert sorted(r.sample_key for r in top if r.selected) == sorted(r.sample_key for r in top)[-2:]


def test_words_decide_where_shapes_are_equal(spark):
    """Texts of one shape that differ by their words only; accuracy on labelled texts that no model or cut has seen."""
    random.seed(5)
    draw = lambda kind: " ".join(random.choice([f"{kind}{random.choice('abcdefgh')}{random.choice('klmno')}"] * 2 + ["the", "of"]) for _ in range(40))
    texts = [(i, draw("fin" if i % 2 else "spa")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = quality.fit(docs, labels(spark, [(i, i % 2, 0, "") for i in range(200)]))
    unseen = quality.weigh(docs.where("doc_id >= 200"), model).collect()
    assert sum((r.log_ratio >= model.cut) == bool(r.doc_id % 2) for r in unseen) >= 195


def test_quality_accuracy_on_held_out_labels(spark):
    """Models and cut from two thirds of the labels; the others are classified."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    away = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.fit(docs, marks.where(~away))
    judged = quality.weigh(docs, model, keep=["doc_id"]).join(marks.where(away).where("quality is not null"), "doc_id").collect()
    assert len(judged) > 100 and sum((r.log_ratio >= model.cut) == (r.quality == 1) for r in judged) >= 0.98 * len(judged)


def test_grams():
    grams = quality.Grams()
    assert [quality.shape(w) for w in ("Word", "WORD!!", "éA12.5", "I", "x%%%")] == ["Aa", "A!!", "aA0.0", "Aa", "a%%%"]
    for text in ("a b c", "  ", "Ab ab ab AB, é", "x"):
        assert sorted(grams.of(text.encode()).tolist()) == sorted(plain_grams(text))
    assert grams.of(b"THE")[0] == grams.of(b"the")[0] and grams.of(b"THE")[1] != grams.of(b"the")[1]


def test_gumbel_noise(spark):
    values = [r.g for r in spark.range(20_000).select(quality.gumbel("id").alias("g")).collect()]
    assert np.mean(values) == pytest.approx(0.5772, abs=0.03) and np.std(values) == pytest.approx(math.pi / 6**0.5, abs=0.04)


def test_quality_edge_cases(spark):
    docs = documents(spark)
    for marks in (labels(spark), labels(spark, [(1, 1, 0, ""), (None, 0, 1, ""), (7, None, None, "")]), labels(spark, [(1, 1, 0, ""), (1, 0, 1, ""), (10, 0, 0, "")])):
        rows = quality.resample(docs, quality.fit(docs, marks)).collect()
        assert len(rows) == 15 and all(r.log_ratio == 0 for r in rows if not space_words(r.text))
        assert len({r.selected for r in rows if r.doc_id == 1}) == 1
    assert all(r.selected for r in quality.resample(docs, quality.fit(docs, labels(spark))).collect())
    assert quality.resample(no_documents(spark), quality.fit(no_documents(spark), labels(spark))).count() == 0


def poisoned(n, seed=0):
    """Texts of invented words, a tenth with words of a list, and their ids."""
    random.seed(seed)
    plain, bad = [f"w{i}" for i in range(400)], ["grottyx", "vilezz", "nastyq"]
    return [(i, " ".join(random.choices(plain, k=60) + (random.choices(bad, k=3) if i % 10 == 0 else []))) for i in range(n)]


def test_toxicity_is_learned_from_positives_and_unlabelled(spark):
    rows = poisoned(2000)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = labels(spark, [(i, 1, int(i % 10 == 0), "") for i in range(2000) if i // 10 % 2])
    found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, marks, toxicity.third)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((found[i] >= 0.7) == (i % 10 == 0) for i in held)
    # labels of held-out rows change nothing
    other = labels(spark, [(i, 1, int(i % 10 == 0), "") if zlib.crc32(str(i).encode()) % 3 != 1 else (i, 0, 1, "") for i in range(2000) if i // 10 % 2])
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, other, toxicity.third)).collect()}
    assert again == found


def test_toxicity_query(spark):
    rows = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01").collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted for r in held if marks.get(r.doc_id) == 1]) > 0.6
    assert np.mean([r.predicted for r in rows if marks.get(r.doc_id) == 0]) < 0.01


def test_toxicity_edge_cases(spark):
    docs = documents(spark)
    for marks in (labels(spark), labels(spark, [(1, 0, 1, ""), (1, 1, 0, ""), (None, None, 1, ""), (6, 1, None, "")])):
        rows = toxicity.score(docs, toxicity.train(docs, marks, toxicity.third)).collect()
        assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.train(no_documents(spark), labels(spark), toxicity.third)
    assert toxicity.score(no_documents(spark), nothing).count() == 0
    assert all(r.score < 1e-9 for r in toxicity.score(docs, nothing).collect())


def slow_license(text, df, passages, threshold):
    """Best template by plain dictionaries."""
    vocabulary = {w for t in licenses.TEMPLATES.values() for w in alnum_words(t)}
    weight = lambda w: math.log((passages + 1) / ((df[w] if w in vocabulary else 0) + 1)) + 1
    vector = lambda words: {w: n * weight(w) for w, n in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    lines = [w for line in (text or "").split("\n") if (w := alnum_words(line))]
    best = 0.0, None
    for p in lines + ([sum(lines, [])] if len(lines) > 1 else []):
        for name, t in sorted(licenses.TEMPLATES.items()):
            u, v = vector(p), vector(alnum_words(t))
            cosine = sum(x * v.get(w, 0) for w, x in u.items()) / norm(u) / norm(v)
            if cosine >= threshold and cosine > best[0] + 1e-12:
                best = cosine, name
    return best[1]


def test_license_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    df, total = Counter(), 0
    for r in docs:
        lines = [w for line in r.text.split("\n") if (w := alnum_words(line))]
        for p in lines + ([sum(lines, [])] if len(lines) > 1 else []):
            df.update(set(p))
            total += 1
    rows = {r.doc_id: r for r in QUERIES["op6_licenses"](spark, SF).collect()}
    own = {r.doc_id: slow_license(r.text, df, total, licenses.THRESHOLD) for r in docs}
    assert {i: r.own_license for i, r in rows.items()} == own and any(own.values())


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    files = [
        ("/r/LICENSE", mit), ("/r/a.c", "int x"), ("/r/sub/b.c", "int y"), ("/r/sub/deep/COPYING.txt", apache + "\nfiller"), ("/r/sub/deep/er/c.c", "z"),
        ("/r/sub/deep/d.c", f"// {mit}\ncode"), ("/other/e.c", "q"), (None, mit), ("/r/null.c", None), ("/r/empty.c", ""), ("/r/NOTICE", "nothing of note"), ("top.c", "x"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("mine"))
    found = {r.path: (r.own_license, r.inherited_license, r.license_dir) for r in licenses.scan(df, keep=["path"]).collect()}
    assert found["/r/a.c"] == (None, "MIT", "/r") and found["/r/sub/b.c"] == (None, "MIT", "/r")
    assert found["/r/sub/deep/er/c.c"] == (None, "Apache-2.0", "/r/sub/deep")
    assert found["/r/sub/deep/d.c"] == ("MIT", "Apache-2.0", "/r/sub/deep")
    assert found["/other/e.c"] == found["top.c"] == (None, None, None) and found[None] == ("MIT", None, None)
    assert found["/r/null.c"] == found["/r/empty.c"] == found["/r/NOTICE"] == (None, "MIT", "/r")
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(documents(spark).withColumn("path", F.lit("/x/LICENSE"))).count() == 15


def test_licence_texts_and_headers_are_found(spark):
    texts, heads = dict(licenses.TEXTS), licenses.HEADERS
    words = lambda name, t: " ".join(t.split())
    wrapped = lambda t, n: "\n".join(" * " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    files = [(f"/{n}/LICENSE", f"Copyright (c) 2020 Some Body\nAll rights reserved.\n\n{t}") for n, t in texts.items()]
    files += [(f"/{n}/src/a.c", f"int {n[:3]}_x;") for n in texts]
    files += [(f"/head{i}/{n}", f"/*\n * a.c - does things\n * Copyright 2020 Some Body\n{wrapped(t, 7)}\n */\n" + "int main(void) { return 0; }\n" * 40) for i, (n, t) in enumerate(heads)]
    files += [("/line/MIT", words("MIT", texts["MIT"]) + "\ncode"), ("/both/Apache-2.0", texts["Apache-2.0"] + "\n\nBundled:\n" + texts["MIT"])]
    files += [("/prose/None", "The software is provided to any person. You may copy this file, see the notice.\n" * 20), ("/short/proprietary", "x\nAll rights reserved.\ny")]
    rows = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for n in texts:
        assert rows[f"/{n}/LICENSE"].own_license == rows[f"/{n}/src/a.c"].license == n
    for path, r in rows.items():
        if path.split("/")[1].startswith(("head", "line", "both", "prose", "short")):
            assert str(r.own_license) == path.split("/")[2], path


def test_long_texts_are_read_whole(spark):
    docs = spark.createDataFrame([(1, LONG + "\nLicensed under CC BY 4.0.", "/a/b")], "doc_id bigint, text string, path string")
    assert licenses.scan(docs).first().own_license == "CC-BY-4.0"


def test_coded_words_are_the_words(spark):
    texts = [(r.text or "").encode() for r in documents(spark).collect()] + [b" a  b\t\x0b\x0cC ", "À\x85É\x1c  É É".encode(), b""]
    lengths, codes, words = brown.coded_space_words(texts)
    assert lengths.tolist() == [len(space_words(t.decode())) for t in texts]
    assert [words[c].decode() for c in codes] == [w for t in texts for w in space_words(t.decode())] and len(set(words)) == len(words)
