import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from undula.llm import bpe, decontamination, fingerprints, language, language_model, licenses, lines, neardups, personal, toxicity
from undula.llm.common import text_array

SCHEMA = "doc_id bigint, text string, id string, key string, content string, n int"
_WORDS = [f"w{i}x" for i in range(400)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in texts], SCHEMA)


def odd(spark):
    """Nulls, empty, blank, long, repeated and equal rows, with further columns of clashing names."""
    long = " ".join(_WORDS * 40)
    return table(spark, [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t"), (None, "one two three four five six"), (5, long), (6, "x" * 5000), (6, "other text")])


def none(spark):
    return table(spark, [])


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints(spark):
    docs = {i: " ".join(random.Random(i).choices(_WORDS, k=30 * i)) for i in range(1, 8)}
    got = {r.doc_id: r for r in fingerprints.with_next(table(spark, docs.items())).collect()}
    for i, t in docs.items():
        k = len(t) // 3
        edited = t[: len(t) - k] + docs[i - 1 if i > 1 else 7][:k]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_next < 0.1 <= got[i].near_edited or i < 3
    assert fingerprints.with_next(odd(spark)).count() == 9 and fingerprints.with_next(none(spark)).count() == 0


def test_line_dedup(spark):
    long = "A line that is long enough to count"
    docs = [(1, f"{long}\nshort"), (2, f"  {long.upper()} \nown"), (3, f"{long}\n{long}"), (4, None)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(table(spark, docs)).collect()}
    assert got == {1: (2, 1, "short"), 2: (2, 1, "own"), 3: (2, 0, f"{long}\n{long}"), 4: (1, 0, None)}
    assert lines.dedup_lines(odd(spark)).count() == 9 and lines.dedup_lines(none(spark)).count() == 0


@pytest.mark.parametrize("small", [512, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    rng, docs = random.Random(5), {}
    for family in range(4):
        base = rng.choices(_WORDS, k=80)
        for c in range(6):
            w = list(base)
            for _ in range(c % 3):
                w[rng.randrange(80)] = "changed"
            docs[family * 10 + c] = " ".join(w)
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = root[b], root[a]
                root = {k: min(old, new) if v in (old, new) else v for k, v in root.items()}
    original = neardups.linked_components
    monkeypatch.setattr(neardups, "linked_components", lambda t, r, s, tables: original(t, r, s, small, 10**6 if small > 2 else 200, tables))
    got = {r.doc_id: r.class_id for r in neardups.near_duplicates(table(spark, docs.items())).collect()}
    assert got == root


def test_leaders_link_a_member_once_to_each_other_component():
    at = lambda a, b: np.arange(a, b, dtype=np.int64)
    block = neardups._Leaders([(b"p", b"p", at(0, 100)), (b"q", b"q", at(5, 105)), (b"r", b"r", at(50, 150)), (b"s", b"s", at(500, 600))], 0.8)
    assert block.alike(b"x", b"x", at(2, 102)) == [b"p", b"q"]
    assert block.alike(b"y", b"y", at(2, 102)) == [b"p"]  # p and q are one by now
    assert block.alike(b"z", b"x", at(2, 102)) == [] and block.alike(b"w", b"w", at(900, 950)) == []


def test_near_duplicates_of_odd_rows(spark):
    got = neardups.near_duplicates(odd(spark)).collect()
    assert len(got) == 9 and {r.class_id for r in got if r.doc_id == 1 or r.doc_id is None} == {1}
    assert neardups.near_duplicates(none(spark)).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)))
    s = neardups.signatures(np.concatenate((a, b)), np.array([0, 400, 800]), 512)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08


def test_near_duplicates_of_repeated_texts_equal_brute_force(spark):
    rng, docs = random.Random(6), {}
    for i in range(0, 90, 3):
        text = " ".join(rng.choices(_WORDS, k=100))
        docs |= {i: text, i + 1: f"{text} {text}", i + 2: " ".join([text] * 4)}
    sets = {i: shingle_set(t) for i, t in docs.items()}
    assert all(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for i in range(0, 90, 3) for j in (i + 1, i + 2))
    got = {r.doc_id: r.class_id for r in neardups.near_duplicates(table(spark, docs.items())).collect()}
    assert got == {i: i - i % 3 for i in docs}


def test_toxicity_tolerates_inserted_letters(spark):
    rng = random.Random(2)
    text = lambda bad: " ".join(rng.choices(_WORDS[:60], k=20) + ([rng.choice(["grumpf", "blastard"])] if bad else []))
    docs = [(i, text(i % 3 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    machine = toxicity.fit(table(spark, docs), toxicity.learnable(labels))
    scored = {r.doc_id: r.score for r in toxicity.score(table(spark, docs), machine).collect()}
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scored[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95
    near = machine.probability(machine.best(text_array(pa.array(["g.r.u.m.p.f", "g r u m p f", "gruxmpf", "w1x"]))))
    assert min(near[:2]) > 0.3 > near[3] and near[2] > near[3]
    assert toxicity.score(odd(spark), machine).count() == 9 and toxicity.score(none(spark), machine).count() == 0


def test_personal_data(spark):
    text = "mail é a.b@c.org or jo (at) site (dot) com, ip 10.0.0.1 bad 300.1.1.1, card 4111 1111 1111 1111, call +1 (702) 555-0742."
    row = personal.find_personal(table(spark, [(1, text)])).select(personal.spans_text("base").alias("b"), personal.spans_text("spans").alias("s")).first()
    at = lambda x: f"{text.index(x)}:{text.index(x) + len(x)}"
    assert row.b == ",".join([f"email:{at('a.b@c.org')}", f"ip:{at('10.0.0.1')}", f"card:{at('4111 1111 1111 1111')}", f"phone:{at('+1 (702) 555-0742')}"])
    assert f"email:{at('jo (at) site (dot) com')}" in row.s.split(",")
    assert personal.find_personal(odd(spark)).count() == 9 and personal.find_personal(none(spark)).count() == 0


def test_language(spark):
    rng = random.Random(3)
    kinds = {"aa": ["kala", "maka", "lama"], "bb": ["oridu", "studor", "redon"], "cc": ["xzqy", "qyxx", "zzyx"]}
    docs = spark.createDataFrame([(i, " ".join(rng.choices(kinds[k], k=8)), k) for i, k in enumerate(list(kinds) * 40)], "doc_id bigint, text string, lang string")
    model = language.fit(language.learnable(docs))
    got = language.identify(docs, model, keep=("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert {r.lang_pred for r in language.identify(table(spark, [(1, None), (2, "12 !"), (3, "")]), model).collect()} == {"und"}
    assert language.identify(odd(spark), model).count() == 9 and language.identify(none(spark), model).count() == 0


def test_decontamination_and_blocks(spark):
    rng = random.Random(4)
    items = {i: " ".join(rng.choices(_WORDS, k=12 + i)) for i in range(6)}
    docs = {i: " ".join(rng.choices(_WORDS, k=600)) + (" " + items[i] + " end" if i < 4 else "") for i in range(8)}
    bench = spark.createDataFrame([*items.items(), (9, None)], "item_id bigint, text string")
    for chars in (10**6, 60):
        got = {(r.doc_id, r.item_id) for r in decontamination.search_items(table(spark, docs.items()), bench, block_chars=chars).collect()}
        assert got == {(i, i) for i in range(4)}
    assert decontamination.search_items(odd(spark), bench).count() == 0 and decontamination.search_items(none(spark), bench).count() == 0


def test_licenses(spark):
    docs = [(1, "before " * 9 + "Released under the MIT License. after"), (2, "nothing here at all to see"), (3, licenses.TEMPLATES[6][1])]
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(table(spark, docs)).collect()}
    assert got == {(1, "MIT"), (3, "GPL-3.0")}
    assert licenses.scan_licenses(odd(spark)).count() == 0 and licenses.scan_licenses(none(spark)).count() == 0


def test_licenses_of_shared_wording(spark):
    gnu = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
    eclipse = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which is available here"
    texts = {
        "GPL-2.0": gnu.format(";", "", ";", "2"),
        "GPL-3.0": gnu.format(":", "", ",", "3"),
        "LGPL-2.1": gnu.format(";", "Lesser ", ";", "2.1"),
        "LGPL-3.0": gnu.format(":", "Lesser ", ",", "3"),
        "AGPL-3.0": gnu.format(":", "Affero ", ",", "3"),
        "EPL-1.0": eclipse.format("v1.0"),
        "EPL-2.0": eclipse.format("2.0"),
    }
    names = dict(enumerate(texts))
    got = sorted((names[r.doc_id], r.license) for r in licenses.scan_licenses(table(spark, enumerate(texts.values()))).collect())
    assert got == sorted((n, n) for n in texts)
    other = licenses.scan_licenses(table(spark, [(1, "This work is licensed under the GNU General Public License, version 2."), (2, "This work is licensed under the GNU Lesser General Public License, version 3.")]))
    assert other.count() == 0


@pytest.mark.parametrize("leaf", [1, 5, bpe.LEAF])
def test_bpe_tree_equals_encoding_in_one_go(spark, leaf):
    coder = bpe.Coder(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), leaf)
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices("aab  \n\t'ste12é世.!\x1c\x85\U0001f600", k=rng.randint(0, 400)))
        ids = coder.encode(text)
        assert ids == coder.base.encode_ordinary(text) and coder.decode(ids).decode() == text
    rows = bpe.encode_texts(odd(spark))
    assert {r.n_tokens for r in rows.where("doc_id IN (2, 3)").collect()} == {0}
    back = bpe.decode_ids(rows).where("doc_id = 1").collect()
    assert {r.text for r in back} == {"one two three four five six"} and bpe.encode_texts(none(spark)).count() == 0


def test_language_model_base_and_odd_rows(spark):
    docs = [(i, " ".join(random.Random(i).choices(_WORDS[:50], k=40))) for i in range(60)]
    got = {r.doc_id: r for r in language_model.score_texts(table(spark, docs), language_model.learnable()).collect()}
    crc = __import__("zlib").crc32
    counts = Counter(w for i, t in docs if crc(str(i).encode()) % 7 != 2 for w in [*t.split(), None])
    whole = sum(counts.values()) + len(counts) + 1
    for i, t in docs:
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / whole) for w in [*t.split(), None]))
        assert got[i].n_tokens == 41 and got[i].train_tokens == sum(counts.values())
    out = language_model.score_texts(odd(spark), language_model.learnable()).collect()
    assert len(out) == 9 and len({r.base_score for r in out if r.doc_id == 1}) == 1
    assert language_model.score_texts(none(spark), language_model.learnable()).count() == 0


def test_language_model_trains_on_all_texts(spark):
    long = {i: " ".join(_WORDS[(i + j) % 20] for j in range(9000)) for i in range(8)}
    assert min(map(len, long.values())) > 20_000
    for r in language_model.score_texts(table(spark, long.items()), language_model.learnable()).collect():
        assert r.score > r.base_score / 4  # the next word follows from the last one
    texts = table(spark, [*long.items(), *((100 + i, f"{_WORDS[i % 400]} end") for i in range(1000)), (2000, None)]).selectExpr("doc_id AS id", "coalesce(text, '') AS text")
    stats = language_model.gather(language_model.count_words(texts), texts.count())
    sent = spark.sparkContext.broadcast(stats)
    batches = list(language_model._pieces(sent)(texts.toArrow().to_batches()))
    assert max(len(x) for b in batches for x in b.column("ids").to_pylist()) <= 2 * language_model.PIECE
    blocks = list(language_model._blocks(batches))
    assert sum(len(y) for y, _, _ in blocks) == stats.total == language_model.Network(stats).train(blocks, 0.01)
    assert sum((x == language_model.START_ID).sum() for _, x, _ in blocks) == stats.docs


def test_contaminated_rows_without_id_are_dropped(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(_WORDS[:20])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [(None, f"so {item}"), (None, "a clean text of six words"), (1, f"so {item}"), (2, "another clean text of six words"), (None, None)])
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, "a clean text of six words"), (2, "another clean text of six words")]


def plain_lines(docs):
    """Texts by id without repeated lines."""
    blank = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blank).translate(low)
    held = defaultdict(set)
    for i, t in docs.items():
        for line in t.split("\n"):
            held[key(line)].add(i)
    lost = lambda i, k: len(k) >= 20 and len(held[k]) >= 3 and max(held[k]) != i
    return {i: "\n".join(x for x in t.split("\n") if not lost(i, key(x))) for i, t in docs.items()}


def plain_firsts(docs):
    """The least id of each class of near duplicates, by comparing all pairs."""
    sets, root = {i: shingle_set(t) for i, t in docs.items()}, {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and (docs[a] == docs[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return set(root.values())


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    item = " ".join(rng.choices(_WORDS, k=20))
    own = {i: " ".join(rng.choices(_WORDS, k=60)) for i in range(40)}
    own |= {41: own[0], 42: own[1] + " " + item, 43: own[2] + " grumpf", 44: own[3] + " more", 45: ""}
    rows = [(i, f"{t}\nThis line stands in every document\n a line \n", "en", 1.0, len(t)) for i, t in own.items()]
    rows += [(100 + i, " ".join(rng.choices(_WORDS, k=30)) + " grumpf", "en", 2.0, 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, class_id string, score double, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100 or i == 43)) for i, *_ in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = plain_lines({i: t for i, t, *_ in rows if "grumpf" not in t})
    left = {i: left[i] for i in plain_firsts(left)}
    left = {i: t for i, t in left.items() if not shingle_set(item) <= shingle_set(t)}
    coder = bpe.Coder(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: coder.base.encode_ordinary(t) for i, t in left.items()}


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(_WORDS[:20]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("score", "kept", "n_lines", "class_id", "is_first", "mark", "holds_item", "column_0", "id")
    for rows in (odd(spark), none(spark)):
        docs = rows.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(names)])
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == docs.count()
    twice = table(spark, [(1, "t u v"), (1, "t u v"), (None, "u v w"), (None, "u v w"), (None, "u v w")])
    assert sorted(r.text for r in corpus_pipeline.drop_near_duplicates(spark, twice, "").collect()) == ["t u v", "u v w"]


def test_kept_columns_that_clash_and_ids_that_are_no_numbers(spark):
    docs = odd(spark).withColumn("SCORE", F.lit(1)).withColumn("n_tokens", F.lit(2)).withColumn("a.b", F.lit(3))
    assert toxicity.score(docs, toxicity.Machine(), keep=("doc_id", "SCORE", "a.b")).columns == ["doc_id", "SCORE_kept", "a.b", "score"]
    assert bpe.encode_texts(docs, keep=("n_tokens",), with_ids=False).columns[:2] == ["n_tokens_kept", "n_tokens"]
    for call in (fingerprints.with_next, lines.dedup_lines, neardups.near_duplicates, licenses.scan_licenses):
        with pytest.raises(ValueError):
            call(docs.withColumn("doc_id", F.lit("x")))


def test_lines_of_rows_without_id_and_repeated_ids(spark):
    long = ["Line number one that is long", "Line number two that is long"]
    docs = [(i, "\n".join(long)) for i in range(3)] + [(None, f"a\n{long[0]}\nb"), (None, f"{long[1]}\nc"), (1, f"{long[0]}\nd\n{long[0]}"), (1, f"{long[0]}\nd\n{long[0]}")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_dropped, r.kept) for r in lines.dedup_lines(table(spark, docs)).collect())
    assert got == [(-1, 1, "a\nb"), (-1, 1, "c"), (0, 2, ""), (1, 2, ""), (1, 2, "d"), (1, 2, "d"), (2, 0, "\n".join(long))]


def test_items_with_a_common_stem_make_no_candidates():
    rng = random.Random(9)
    stem = " ".join(rng.choices(_WORDS, k=30))
    items = [stem + " " + " ".join(rng.choices(_WORDS, k=40)) for _ in range(300)]
    index = decontamination.ItemIndex(items)
    docs = [stem + " " + " ".join(rng.choices(_WORDS, k=500)) for _ in range(30)] + [items[7] + " and " + items[8], " ".join(items[9].split()[:64])]
    seen = []
    index._containment, plain = lambda v, o, r, i: seen.append(len(r)) or plain(v, o, r, i), index._containment
    rows, found, share = index.search(text_array(pa.array(docs)))
    assert sorted(zip(rows, found)) == [(30, 7), (30, 8), (31, 9)] and seen[0] < 10
    sets = [shingle_set(t) for t in items]
    for r, i, s in zip(rows, found, share):
        assert s == pytest.approx(len(sets[i] & shingle_set(docs[r])) / len(sets[i]))


def plain_kernel(a, b):
    """The gap-weighted kernel by listing all pairs of subsequences."""
    from itertools import combinations

    def listed(x):
        out = defaultdict(float)
        for i, j, k in combinations(range(len(x)), 3):
            out[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    dot = lambda x, y: sum(w * y[k] for k, w in x.items())
    x, y = listed(a), listed(b)
    return dot(x, y) / math.sqrt(max(dot(x, x) * dot(y, y), 1e-12))


def test_kernel_equals_all_subsequences_listed():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcде世", k=n)) for n in (1, 2, 4, 9, 10, 17, 39, 40, 45, 60)]
    some, _, at = toxicity.units(text_array(pa.array(texts)))
    whole = some.take(at[:-1])
    assert [b - a for a, b in zip(whole.first, whole.last)] == [len(t) + 1 for t in texts]
    got = toxicity.kernel(whole, whole)
    cut = [tuple(whole.symbol[a:b]) for a, b in zip(whole.first, whole.last)]
    for i, a in enumerate(cut):
        for j, b in enumerate(cut):
            assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=2e-5)
    machine = toxicity.Machine()
    code = np.random.default_rng(1).normal(size=toxicity.SYMBOLS**3).astype(np.float32)
    machine.table = code
    for value, a in zip(machine.rate(whole), cut):
        dense = toxicity.whole_features(np.array(a))
        assert value == pytest.approx(-1 + (dense @ code) / max(np.linalg.norm(dense), 1e-6), abs=1e-3)


def small_network():
    counts = np.arange(3000, 0, -1)
    own = np.where(np.arange(3000) < language_model.OWN, np.arange(3000), -1)
    return language_model.Network(language_model.Statistics(10**6, 3000, 50, np.arange(3000), counts, own, counts[: language_model.OWN], np.full(language_model.SUFFIX_CLASSES, 90.0)))


def test_language_model_gradients_equal_differences():
    net, rng = small_network(), np.random.default_rng(2)
    net.load(net.flat().astype(np.float64))
    x, y = rng.integers(0, language_model.START_ID + 1, (6, 3)), rng.integers(0, language_model.END_ID + 1, (6, 3))
    y[5, 2], fresh, state = -1, rng.random((6, 3)) < 0.2, rng.normal(size=(3, language_model.HIDDEN))
    flat = net.flat()
    slope = np.zeros_like(flat)
    net.window(x, y, fresh, state, net._views(slope))
    net.load(flat)
    spare = net._views(np.zeros_like(flat))
    for at in rng.choice(np.flatnonzero(np.abs(slope) > 1e-4), 40, replace=False):
        both = []
        for step in (1e-5, -1e-5):
            flat[at] += step
            both.append(net.window(x, y, fresh, state, spare)[1])
            flat[at] -= step
        assert slope[at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_language_model_scores_equal_one_plain_loop():
    net, rng = small_network(), np.random.default_rng(3)
    net.ready()
    texts = [rng.integers(0, language_model.END_ID + 1, n) for n in (200, 1, 65, 64, 63)]
    got = net.score(np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for text, value in zip(texts, got):
        state, before, total = np.zeros(language_model.HIDDEN), language_model.START_ID, 0.0
        for i in text:
            gate = 1 / (1 + np.exp(-p["gate"][before]))
            state, before = gate * state + (1 - gate) * np.tanh(p["new"][before]), i
            kinds = softmax(state @ p["wc"] + p["bc"])
            assert kinds.sum() == pytest.approx(1)
            total += np.log10(kinds[net.target_class(np.array(i))])
            if i < language_model.OWN:
                k = i // language_model.SIZE
                total += np.log10(softmax(p["wo"][k] @ state + p["bo"][k])[i % language_model.SIZE])
        assert value == pytest.approx(total, rel=1e-4)


def plain_base(text):
    """Base spans by Python's own patterns."""
    import re

    def luhn(digits):
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in twice) % 10 == 0

    digits = lambda x: [c for c in x if c in "0123456789"]
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    out = [(m.start(), n, k, m.end()) for n, (k, p, good) in enumerate(kinds) for m in re.finditer(p, text) if good(m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(12)
    bits = ["a", "é", "@", ".", "-", " ", "+1", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1", "1", "22", "x.y@z.org", "(555)", "0742", "4242-4242-4242-4242", "\U0001f600"]
    texts = {i: "".join(rng.choices(bits, k=rng.randint(0, 30))) for i in range(400)}
    got = personal.find_personal(table(spark, texts.items())).select("doc_id", personal.spans_text("base").alias("base"), personal.spans_text("spans").alias("spans")).collect()
    for r in got:
        assert r.base == plain_base(texts[r.doc_id])
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_sketches_estimate_containment_and_merge(spark):
    rng = random.Random(13)
    long = rng.choices(_WORDS, k=6000)
    pairs = [(" ".join(long[:n]), " ".join(long)) for n in (600, 3000)] + [("", ""), ("", "a b"), ("a b", "a b"), (None, " ")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    f = df.select("i", fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"), fingerprints.sketch(F.concat_ws(" ", "a", "b")).alias("both"))
    rows = f.select("*", fingerprints.containment(F.col("x"), F.col("y")).alias("c"), fingerprints.jaccard(F.col("x"), F.col("y")).alias("j"), fingerprints.merge(F.col("x"), F.col("y")).alias("m")).orderBy("i").collect()
    for r, (a, b) in zip(rows, pairs):
        sets = [shingle_set(a or ""), shingle_set(b or "")]
        if sets[0] and sets[1]:
            assert r.c == pytest.approx(len(sets[0] & sets[1]) / len(sets[0]), abs=0.02)
            assert r.j == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), abs=0.08)
        if r.i < 2:  # the sketch keeps its share of all hashes, and merges to that of both texts
            assert len(r.x) == pytest.approx(len(sets[0]) / fingerprints.SCALE, rel=0.35)
            assert set(r.m) == set(r.x) | set(r.y) and len(set(r.both) - set(r.m)) <= 2
    assert [r.c for r in rows[2:]] == [1, 0, 1, 1]


def test_code_words_are_decoded_by_least_weighted_loss():
    rng = random.Random(14)
    kinds = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[2 * k : 2 * k + 9], k=6)) for _ in range(30)] for k in range(9)}  # more than seven: random codes
    texts, langs = zip(*[(" ".join(rng.choices(kinds[k], k=12)), k) for k in kinds for _ in range(40)])
    model = language.Classifier(list(texts), list(langs))
    asked = text_array(pa.array([" ".join(rng.choices(kinds[k], k=12)) for k in kinds for _ in range(5)]))
    best, score, _ = model.predict(asked)
    rows = np.concatenate(list(language.features(asked)))
    for x, b, s in zip(rows, best, score):
        margin = np.clip(x @ model.weights + model.bias, -8, 8)
        loss = [sum(t * math.log1p(math.exp(-c * m)) for c, m, t in zip(code, margin, trust)) for code, trust in zip(model.code, model.trust)]
        assert b == int(np.argmin(loss)) and 0 <= s <= 1
    assert np.mean([model.langs[b] == k for b, k in zip(best, [k for k in kinds for _ in range(5)])]) > 0.9
    code = model.code
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 4
