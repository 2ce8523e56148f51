"""The corpus operators against brute-force versions on a small table with nulls, empty, long and repeated texts, ties and clashing columns."""

import hashlib
import importlib.util
import math
import os
import random
import resource
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallium.llm import common, fuzzyhash, hmm, licenses, mixing, ngramjoin, packing, quality, substrings, tokencount, toxicity
from recallium.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, node long, size long"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


PASSAGE, LONG = prose(110), prose(9000)
NEAR = prose(300).split()
TEXTS = [None, "", " \n", "one", "two words", prose(60), prose(500), LONG, LONG, f"{prose(50)} {PASSAGE} {prose(40)}", f"{PASSAGE} {prose(80)}", " ".join(NEAR), " ".join(NEAR[:290] + ["x", "y"] + NEAR[290:]), " ".join(NEAR[5:])]
TEXTS += ["ß€😀 " * 150, "a" * 900, prose(200) + "\nLicensed under the Apache License, Version 2.0.\n", "line again here\n" * 80, prose(120), prose(120) + " <|endoftext|> <s> e\u0301 caf\u00c9! don't \u0130x _a.", f"{prose(30).upper()} É É é Straße STRASSE {prose(30).title()}"]
ROWS = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), "r", 1, 2, 3) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], (None, TEXTS[5], None, "a", None, None, None, None, None), (6, "other text of a repeated id", None, "b", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/t"
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def data(row):
    return (row[1] or "").encode()


def test_substrings_against_brute_force(docs, empty):
    counts = Counter(d[i : i + 400] for d in map(data, ROWS) for i in range(len(d) - 399))
    want = []
    for r in ROWS:
        d, mask = data(r), np.zeros(len(data(r)) + 1, int)
        for i in range(len(d) - 399):
            if counts[d[i : i + 400]] > 1:
                mask[i : i + 400] = 1
        kept = bytes(b for b, m in zip(d, mask, strict=False) if not m)
        want.append((r[0], len(d), int(mask.sum()), int((np.diff(np.concatenate(([0], mask))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for options in ({}, {"most": 2}, {"filtered": -1}):  # in memory, on disk, and with a join in place of the bit field
        assert sorted((tuple(r)[:5] for r in substrings.digests(docs, **options).collect()), key=str) == sorted(want, key=str)
    assert substrings.digests(empty).count() == 0
    left = substrings.remove(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)


def test_planted_passages(spark):
    """Passages of 51 to 70 words shared by many documents are found and cut, those of 30 words and unique texts are left alone."""
    shared = [prose(rng.randint(51, 70)) for _ in range(6)]
    short = prose(30)
    rows = [(i, f"{prose(80)}\n{shared[i % 6]}\n{prose(90)}", shared[i % 6]) for i in range(90)]
    rows += [(100 + i, f"{prose(70)}\n{short}\n{prose(70)}", None) for i in range(20)] + [(200 + i, prose(150), None) for i in range(20)]
    rows += [(300 + i, f"{prose(40)} {PASSAGE} {prose(40)}", PASSAGE) for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, passage string")
    out = {r["doc_id"]: r for r in substrings.digests(table, most=20).collect()}
    left = {r["doc_id"]: r["text"] for r in substrings.remove(table, 200, 50).collect()}
    for i, text, passage in rows:
        data = text.encode()
        got = out[i]["passages"]
        assert (len(got) == 1 and passage in data[got[0]["start"] : got[0]["end"]].decode()) if passage else not got
        assert out[i]["n_passages"] == len(got) and out[i]["passage_bytes"] == sum(r["end"] - r["start"] for r in got)
        assert out[i]["n_removed"] == sum(r["end"] - r["start"] for r in out[i]["removed"])
        n = len((passage or "").encode())
        assert out[i]["n_removed"] >= n if n >= 400 else out[i]["n_removed"] == 0 or n > 380  # at 400 bytes, some of what stands beside it may be shared too
        assert left[i] == text if passage is None else passage not in left[i] and len(left[i]) < len(text)


def test_induction_in_memory_and_on_disk():
    gen = np.random.default_rng(1)
    for trial in range(30):
        texts = list(dict.fromkeys(bytes(gen.choice(list(b"ab" if trial % 2 else b"abcd"), gen.integers(0, 60)).tolist()) for _ in range(12)))
        texts += [texts[0] + texts[1] + texts[0]]
        counts = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 11) if counts[t[i : i + 12]] > 1}
        occurrences = []
        for k, t in enumerate(texts):
            for h, p, lo, hi in zip(*(x.tolist() for x in substrings.anchors(t, 12, 4)), strict=True):
                occurrences.append(((h, p - hi, p - lo, t[lo:p], t[p : hi + 12]), k, p))
        n = Counter(o[0] for o in occurrences)
        rows = sorted(n, key=lambda c: (c[0], c[4], c))
        r, a, b = substrings.induce(np.array([c[0] for c in rows]), [c[3] for c in rows], [c[4] for c in rows], np.array([c[1] for c in rows]), np.array([c[2] for c in rows]), 12)
        memory = sorted((rows[i], x, y) for i, x, y in zip(r.tolist(), a.tolist(), b.tolist(), strict=True))
        disk = sorted(x for h in {c[0] for c in rows} for x in substrings.induce_on_disk(iter([(c, c[3], c[4], c[1], c[2]) for c in rows if c[0] == h]), 12, 3))
        assert memory == disk
        have = {(k, p - d) for c, k, p in occurrences for x, y in ([(c[1], c[2])] if n[c] > 1 else [m[1:] for m in memory if m[0] == c]) for d in range(x, y + 1)}
        assert have == want


def test_the_disk_queue_opens_few_files_and_keeps_order(tmp_path, monkeypatch):
    """Thousands of runs under a limit of 150 open files, in bounded memory; nothing stays on disk."""
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    queue, rng, want = substrings.ExternalQueue(1000), random.Random(2), []
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(150 + len(os.listdir("/proc/self/fd")), before[0]), before[1]))
    try:
        for i in range(30_000):
            item = (rng.randrange(500), i, rng.randbytes(8))
            queue.push(item)
            want.append(item)
            assert queue.held <= 1300
        assert len(os.listdir(queue.folder.name)) <= 3 * queue.FAN
        assert list(queue.drain()) == sorted(want)
        assert not os.listdir(tmp_path)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)


@pytest.mark.parametrize("n", [2, 63, 64, 65, 64 * 64 + 5])
def test_the_disk_queue_for_any_number_of_runs(n):
    queue = substrings.ExternalQueue(1)
    for i in range(n):
        queue.push((-i, b"x"))
    assert list(queue.drain()) == [(-i, b"x") for i in reversed(range(n))] and list(queue.drain()) == []


def test_hidden_markov_scores(docs, empty):
    out = hmm.score(docs, hmm.fold(7, 2), hmm.Settings(states=3, frequent=20)).collect()
    training = [r for r in ROWS if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 != 2]
    lowered = lambda r: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode().split(), b"\n"]
    counts = Counter(w for r in training for w in lowered(r))
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for r in ROWS:
        words = lowered(r)
        want.append((r[0], len(words), sum(w in counts for w in words), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), 6)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) for r in out)
    assert hmm.score(empty, hmm.fold(7, 2)).count() == 0


def test_words_of_a_class_sum_to_one(spark):
    at: dict[int, list[str]] = {}
    for i in range(4000):
        at.setdefault(hmm.class_of(f"w{i}".encode()), []).append(f"w{i}")
    a, b, unseen = next(x for x in at.values() if len(x) > 2)[:3]
    texts = [(1, f"{a} {a} {b} other"), (2, f"{a} more"), (3, a), (4, b), (5, unseen), (6, "")]
    docs, held_out = spark.createDataFrame(texts, "doc_id long, text string"), F.col("doc_id") > 2
    s = hmm.Settings(states=2)
    m = hmm.train(docs.where(~held_out), s)[0]
    scores = {r["doc_id"]: r["score"] for r in hmm.score(docs, held_out, s).collect()}
    c = hmm.class_of(a.encode())
    classes = hmm.forward(m, np.array([c, 0]), np.array([2]))[0] / math.log(10)
    shares = [10 ** (scores[i] - classes) for i in (3, 4, 5)]
    assert shares == pytest.approx([4 / 7, 2 / 7, 1 / 7]) and sum(shares) == pytest.approx(1)
    assert scores[6] == pytest.approx(hmm.forward(m, np.array([0]), np.array([1]))[0] / math.log(10))


def test_forward_recursion_sums_over_paths():
    m = hmm.fresh(3)
    classes = np.array([5, 9, 5, 0])
    total = 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = m.start[path[0]] * m.emit[classes[0], path[0]]
        for t in range(1, 4):
            p *= m.moves[path[t - 1], path[t]] * m.emit[classes[t], path[t]]
        total += p
    assert hmm.forward(m, classes, np.array([4]))[0] == pytest.approx(math.log(total))


def test_expected_counts_against_enumeration():
    m = hmm.updated(*hmm.expected(hmm.fresh(2), np.array([5, 9, 5, 0, 9, 0, 7]), np.array([4, 2, 1]))[:3])
    sequences, begins = [[5, 9, 5, 0], [9, 5], [7]], [True, False, True]
    firsts, moves, emit, loglik = np.zeros(2), np.zeros((2, 2)), Counter(), 0.0
    for x, begin in zip(sequences, begins, strict=True):
        weight = {}
        for path in np.ndindex(*[2] * len(x)):
            p = (m.start if begin else m.share)[path[0]] * m.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= m.moves[path[t - 1], path[t]] * m.emit[x[t], path[t]]
            weight[path] = p
        z = sum(weight.values())
        loglik += math.log(z)
        for path, p in weight.items():
            if begin:
                firsts[path[0]] += p / z
            for t, s in enumerate(path):
                emit[x[t], s] += p / z
                if t:
                    moves[path[t - 1], s] += p / z
    got = hmm.expected(m, np.array(sum(sequences, [])), np.array([4, 2, 1]), np.array(begins))
    assert got[0] == pytest.approx(firsts, rel=1e-4) and got[1] == pytest.approx(moves, rel=1e-4) and got[3] == pytest.approx(loglik, rel=1e-5)
    assert {k: got[2][k] for k in emit} == pytest.approx(dict(emit), rel=1e-4) and got[2].sum() == pytest.approx(7, rel=1e-5)


def test_baum_welch_raises_the_likelihood(docs):
    assert (lambda h: h[1] > h[0])(hmm.train(docs.select("text"))[1])


def test_training_goes_on_until_the_likelihood_settles(docs):
    h = hmm.train(docs.select("text"))[1]
    gains = [(b - a) / abs(a) for a, b in zip(h, h[1:], strict=False)]
    assert gains[-1] <= 1e-4 and all(x > 1e-4 for x in gains[:-1])


def test_packing_is_gapless_and_tight(docs, empty):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    for r in {x[0]: x for x in ROWS if x[0] != 6}.values():
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 1]
        mine = sorted((x for x in rows if x["doc_id"] == r[0]), key=lambda x: x["piece"])
        assert [x["start"] for x in mine] == list(range(0, len(ids), 4096)) and sum(x["length"] for x in mine) == len(ids)
        assert all(x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes()) for x in mine)
    bins = {}
    for x in sorted(rows, key=lambda x: x["offset"]):
        assert bins.get(x["sequence_id"], 0) == x["offset"]
        bins[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(bins.values()) <= 4096 and len(bins) == -(-sum(x["length"] for x in rows) // 4096)
    assert packing.pack(empty, path).count() == 0


def test_local_search_empties_bins():
    bins = Counter({(6, 2): 1, (5, 3): 1, (5, 4): 1, (1,): 1})
    after = packing.improve(bins, 10)
    assert sorted(x for b, n in after.items() for x in b * n) == [1, 2, 3, 4, 5, 5, 6] and sum(after.values()) == 3
    assert sum(packing.best_fit({7: 100, 3: 100}, 10).values()) == 100


def test_local_search_has_no_limits():
    pieces = lambda bins: sum((Counter({x: n * b.count(x) for x in set(b)}) for b, n in bins.items()), Counter())
    many = Counter({(6, 3): 50_000, (4, 3): 50_000, (1,): 50_000})
    out = packing.improve(many, 10)
    assert sum(out.values()) == 87_500 and pieces(out) == pieces(many)
    # the only bin with room for the piece of 30 lies behind more than a hundred fuller ones
    fuller = Counter({(1000 - f - i, i): 1 for f in range(1, 29) for i in (40, 41, 42, 43)} | {(30,): 1, (970,): 1})
    out = packing.improve(fuller, 1000)
    assert any(30 in b and len(b) > 1 for b in out) and sum(out.values()) <= 113 and pieces(out) == pieces(fuller)


def test_token_counts_equal_the_library(docs, empty):
    path = vocabulary("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((r[0], len(data(r)), len(model.encode(r[1] or ""))) for r in ROWS), key=str)
    for chunk in (1 << 16, 50):
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(docs, path, chunk=chunk).collect()), key=str) == want
    odd = ["  a  b ", "\t\n", "▁▁ x", "日本語 текст 👍🏽", "x" * 300, " " * 40 + "y", "a\x00b"]
    assert [tokencount.transducer(path).count(x) for x in odd] == [len(model.encode(x)) for x in odd]
    assert tokencount.token_counts(empty, path).count() == 0


def test_token_counts_of_strings_with_the_models_own_space(spark):
    """U+2581 stands for a space in the model; runs of it, mixed with spaces, controls and special strings, count as the library counts."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, t, rng = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.transducer(path), random.Random(7)
    parts = [" ", "\u2581", "  ", "\u2581\u2581", "a", "the", " of", "\t", "\n", "\u00a0", "\u3000", "\x00", "\u0301", "<s>", "</s>", "<unk>", "<0x0A>", "\ufb01", "\u4e2d", "."]
    for text in ["a\u2581 ", "\u2581 ", *("".join(rng.choice(parts) for _ in range(rng.randrange(24))) for _ in range(1500))]:
        assert {t.count(text, chunk) for chunk in (3, 8, 4096)} == {len(model.encode(text))}, repr(text)


def test_toxicity_learns_marked_words(spark):
    bad = ["grumz", "vexlor", "blatch"]
    rows = [(i, prose(60) + (f" {bad[i % 3]}{rng.choice(['', 'en', 'er'])} {prose(5)}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)] + [(None, None, None), (700, "", 0), (701, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = toxicity.fold(5)
    model = toxicity.train(docs, docs.select("doc_id", "toxic"), held)
    out = toxicity.score(docs, model, held).collect()
    truth = {r[0]: r[2] for r in rows}
    tested = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]][s["start"] : s["end"]].startswith(tuple(bad)) for r in tested for s in r["spans"])
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.reject(docs, model).count() == sum(not r["predicted"] for r in out)
    blank = toxicity.train(docs.limit(0), docs.select("doc_id", "toxic"), held)
    assert {r["score"] for r in toxicity.score(docs, blank, held).collect()} == {0.5}


def test_lexicon_finds_rare_marks_behind_many_common_features(spark):
    gen = random.Random(3)
    common = " ".join("".join(gen.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(12_000))
    rows = [(f"{common} {'grumzlet' if i < 6 else ''}", 1) for i in range(8)] + [(common, 0)] * 30
    assert "w:grumzlet" in toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"), toxicity.Settings())


def test_lexicon_keeps_every_mark(spark):
    gen = random.Random(4)
    bad = ["".join(gen.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1000)]
    rows = [(" ".join(bad), 1)] * 8 + [("plain words", 0)] * 30
    marks = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"), toxicity.Settings())
    assert set(marks) == {f for w in bad for f in toxicity.features(w)} and len(marks) > 4000


def test_marginals_against_enumeration():
    odds, moves = np.array([0.3, -1.0, 2.0]), np.array([[0.5, -0.2], [0.1, 0.7]])
    weight = {}
    for path in np.ndindex(2, 2, 2):
        weight[path] = math.exp(sum(o * y for o, y in zip(odds, path, strict=True)) + moves[path[0], path[1]] + moves[path[1], path[2]])
    z = sum(weight.values())
    want = [sum(w for p, w in weight.items() if p[t]) / z for t in range(3)]
    assert toxicity.marginals(odds, np.array([3]), moves) == pytest.approx(want)


@pytest.mark.parametrize("share", [common.HOT_SHARE, 12, 0])
def test_ngram_join_against_brute_force(docs, empty, share, monkeypatch):
    """share: the default, at which all keys of so few rows are hot, one at which only the larger groups are, and one at which none is."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    sets = []
    for r in ROWS:
        w = data(r).split()
        n = min(5, len(w))
        sets.append({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links = [[j for j in range(len(ROWS)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(ROWS))]
    label = list(range(len(ROWS)))
    for _ in ROWS:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(ROWS))]
    least = {}
    for i, k in enumerate(label):
        if ROWS[i][0] is not None:
            least[k] = min(least.get(k, ROWS[i][0]), ROWS[i][0])
    want = sorted(((ROWS[i][0], least.get(label[i]), label.count(label[i]), len(links[i])) for i in range(len(ROWS))), key=str)
    for options in ({}, {"block": 1}) if share else ({},):
        assert sorted(map(tuple, ngramjoin.classes(docs, **options).collect()), key=str) == want
    kept = ngramjoin.dedup(docs)
    want_ids = Counter(min(((r[0] is None, r[0]) for r, k in zip(ROWS, label, strict=True) if k == one), key=str)[1] for one in set(label))
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == want_ids
    assert ngramjoin.classes(empty).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_looked_up_splits_hot_keys(spark, how):
    held = [1] * 900 + [2] * 60 + [3] * 39 + [4, None]
    rows = spark.createDataFrame(list(enumerate(held)), "i long, k long")
    table = spark.createDataFrame([(1, 900, "a"), (2, 60, "b"), (3, 39, "c"), (9, 1, "d")], "k long, weight long, v string")
    names = {1: "a", 2: "b", 3: "c"}
    want = [(i, k, names.get(k)) for i, k in enumerate(held) if how == "left" or k in names]
    found = [(r["i"], r["k"], r["v"]) for r in common.looked_up(rows, table, "k", len(held), how).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7)], "a long, b long")
    out = {r["a"]: r["b"] for r in components(edges).df.collect()}
    assert out == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_mixing_meets_targets(spark, docs, empty):
    rows = [(i, prose(rng.randint(1, 80)), f"s{i % 7}" if i % 11 else None) for i in range(800)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {r[0]: r[2] for r in rows}
    sizes, targets, taken = Counter(), {}, Counter()
    for r in out:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["copies"] <= 3
        sizes[source[r["doc_id"]]] += r["size"]
        targets[source[r["doc_id"]]] = r["target"]
        taken[source[r["doc_id"]]] += r["size"] * r["copies"]
    names = sorted(x for x in sizes if x is not None) + [None]
    weights, caps, want, free = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], [3.0 * sizes[n] for n in names], {}, sum(sizes.values())
    while len(want) < len(names):  # cap, share again
        share = free / sum(w for w, n in zip(weights, names, strict=True) if n not in want)
        over = [n for w, c, n in zip(weights, caps, names, strict=True) if n not in want and share * w > c]
        for w, c, n in zip(weights, caps, names, strict=True):
            if n not in want and (n in over or not over):
                want[n] = c if over else share * w
        free -= sum(want[n] for n in over)
    assert all(targets[n] == pytest.approx(want[n]) for n in names)
    assert all(abs(taken[n] - want[n]) <= 0.05 * want[n] + 80 for n in names)
    copies = Counter({r[0]: r[1] for r in mixing.mix(docs).groupBy("doc_id").sum("copies").collect()})
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and Counter(r["doc_id"] for r in emitted.collect()) == +copies
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


def test_mixing_draws_are_systematic(spark):
    """Against the definition: places by size and hashed number, one start a source; the copies of a source are exact within one, its words near
    the target though it has few, long documents; about the fraction of all documents is copied."""
    sizes = [(i, rng.choice([1, 1, 1, 2, 3, 5, 40, 900, 1500]), f"s{i % 5}" if i % 17 else None) for i in range(600)] + [(i, 4000 + i, "few") for i in range(600, 606)] + [(None, 3, "s1"), (7000, 0, "none")]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, n, s in sizes], "doc_id long, text string, source string")
    number = lambda *of: int(hashlib.sha256(":".join(["mix", *of]).encode()).hexdigest()[:15], 16)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    for source in {s for _, _, s in sizes}:
        own = sorted((n, number("" if i is None else str(i)), i) for i, n, s in sizes if s == source)
        total, target = sum(n for n, _, _ in own), got[own[0][2]]["target"]
        rate = target / total if total else 0.0
        part, start = rate - math.floor(rate), number("start", source or "", str(source is None).lower()) / 2**60
        for place, (n, _, i) in enumerate(own):
            extra = math.floor(start + (place + 1) * part) - math.floor(start + place * part)
            # places are by size first, so within a size the first ones by number are those that are copied
            assert got[i]["copies"] - math.floor(rate) in (0, 1) and got[i]["size"] == n and extra in (0, 1)
        for size in {n for n, _, _ in own}:
            first = next(p for p, o in enumerate(own) if o[0] == size)
            some = [o for o in own if o[0] == size]
            take = math.floor(start + (first + len(some)) * part) - math.floor(start + first * part)
            assert [got[i]["copies"] - math.floor(rate) for _, _, i in some] == [1] * take + [0] * (len(some) - take)
        taken = sum(got[i]["copies"] * n for n, _, i in own)
        assert abs(taken - target) <= own[-1][0] + 1


def test_fingerprints(docs, empty):
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for x, y in zip(order, order[1:] + order[:1], strict=True):
        a, b = x[1] or "", y[1] or ""
        k = len(a) // 4
        want.append((x[0], len(a), hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()))
    for n in (1, 5):
        out = fuzzyhash.fingerprints(docs, partitions=n).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=str) == sorted(want, key=str)
    prints = {r["doc_id"]: r["fingerprint"] for r in out}
    assert prints[7] == prints[8] and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert all(r["near_edited"] > 0.5 for r in out if r["n_chars"] > 600 and r["doc_id"] not in (14, 15, 17))
    assert fuzzyhash.fingerprints(empty).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    words = ["".join(rng.choice("ABC") for _ in range(rng.randint(0, 64))).encode() for _ in range(60)] + [b"", b"A" * 64]
    assert fuzzyhash.edit_distances(words, words[::-1]).tolist() == [plain(a, b) for a, b in zip(words, words[::-1], strict=True)]


def test_quality_rules(docs, empty):
    out = {(r["doc_id"], r["n_bytes"]): r for r in quality.quality_rules(docs).collect()}
    for r in ROWS:
        text, words = r[1] or "", data(r).split()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 2000 else None
        got, lines = out[r[0], len(data(r))], [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (got["n_words"], got["word_chars"], got["n_dup_lines"]) == (len(words), sum(len(w.decode()) for w in words), len(lines) - len(set(lines)))
        if repeated is not None:
            assert got["n_repeat_words"] == len(repeated) and got["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (got["base_failed"] and got["kept"])
    bands = quality.Bands()
    assert bands.judge(("spam and eggs " * 200).encode())[3] == "repetitive" and bands.judge(np.random.default_rng(1).integers(0, 256, 4000, dtype=np.uint8).tobytes())[3] == "incompressible"
    assert quality.quality_rules(empty).count() == 0


def test_license_scans(spark, docs, empty):
    found = [(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect() if r["n_matches"]]
    assert found == [(16, "Apache-2.0 notice")]
    full = licenses.TEMPLATES["BSD redistribution"]
    rows = [(1, "x y " + full.replace("binary", "object") + " z"), (2, full.upper()), (3, "licensed under nothing"), (4, None), (5, f"{full}\n{prose(30)}\n{full}")]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["n_matches"] for i in range(1, 6)] == [1, 1, 0, 0, 2]
    m = out[1]["matches"][0]
    assert rows[0][1][m["start"] : m["end"]].startswith("Redistribution") and 0.9 < m["coverage"] < 1
    assert licenses.scan(empty).count() == 0


def test_alignment_against_a_plain_table():
    def plain_score(template, words, low, high):
        best, table = 0, {}
        for i, t in enumerate(template):
            for j, w in enumerate(words):
                if low <= j - i <= high:
                    table[i, j] = max(0, table.get((i - 1, j - 1), 0) + (2 if t == w else -1), table.get((i - 1, j), 0) - 1, table.get((i, j - 1), 0) - 1)
                    best = max(best, table[i, j])
        return best

    gen = random.Random(8)
    for _ in range(200):
        template, words = [gen.randint(1, 4) for _ in range(gen.randint(1, 12))], [gen.randint(1, 4) for _ in range(gen.randint(0, 20))]
        low = gen.randint(-8, 8)
        high = low + gen.randint(0, 9)
        pairs = licenses.align(template, words, low, high)
        score = plain_score(template, words, low, high)
        assert all(template[i] == words[j] and low <= j - i <= high for i, j in pairs) and pairs == sorted(set(pairs))
        if pairs:  # what lies between two matches costs one for each step, a mismatch pairs two words
            gaps = sum(max(a[0] - b[0] - 1, a[1] - b[1] - 1) for a, b in zip(pairs[1:], pairs, strict=False))
            assert 2 * len(pairs) - gaps == score
        else:
            assert score == 0


def test_license_texts_in_full_and_overlaps(spark):
    t = licenses.TEMPLATES
    rows = [(1, t["MIT"].replace("Software", "Program")), (2, f"{prose(20)}\n{t['Zlib']}\n{prose(9)}\n{t['ISC']}"), (3, t["MIT"].upper() * 3), (4, "one two"), (5, " ".join(["Licensed under CC BY 4.0."] * 40))]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[m["license"] for m in out[i]["matches"]] for i in (2, 4)] == [["Zlib", "ISC"], []]
    assert "MIT" in [m["license"] for m in out[1]["matches"]] or out[1]["license"] == "MIT permission"
    assert len(out[3]["matches"]) >= 3 and out[5]["n_matches"] == 40
    for r in out.values():
        assert all(a["end"] <= b["start"] for a, b in zip(r["matches"], r["matches"][1:], strict=False))
    short = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"short": "One two"}).collect()
    assert {r["doc_id"]: r["n_matches"] for r in short} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="needs the pipeline")
def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


@pytest.mark.parametrize("most", [250_000, 3])
def test_forms_give_the_ids_of_the_library(most):
    tokenizer = packing.WordTokenizer(vocabulary("word_bpe_49k.json"), most, joined=4)
    texts = ["", "<|ENDOFTEXT|> a<|endoftext|>b", "don't DON'T É'LL'S İx, ΑΣ Σ, café! CAFÉ! e!́ ×, ÷! ß, ẞ.", "≮a a≮ ﬁ! \x1cq a\x1f! it'sx 'sa a'", PASSAGE, PASSAGE.upper() + ","]
    for _ in range(2):
        forms = tokenizer.forms([t.encode() for t in texts])
        tokenizer.learn(forms)
        for text, f in zip(texts, forms, strict=True):
            assert np.frombuffer(tokenizer.ids(f), "<u4").tolist() == tokenizer.model.encode(text, add_special_tokens=False).ids
    assert packing.WordTokenizer.forms([]) == []
