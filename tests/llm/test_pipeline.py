"""The pipeline's stages one by one over a small table with nulls, ties, copies, long texts and clashing columns, against plain Python."""

import importlib.util
import random
from collections import Counter

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="needs the pipeline")

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
BAD = ["grumzlet", "vexlorab", "blatchen"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, node long, size long, class long, tid string, key string, toxic int, held_out boolean, copies long, rate double"


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


SHARED = [prose(60) for _ in range(3)]
COPY, NEAR = prose(150), prose(200).split()


def tables():
    texts = [None, "", "  \n ", "one", COPY, COPY, COPY, " ".join(NEAR), " ".join([*NEAR[:100], "extra", *NEAR[100:]]), prose(9000), "ß€😀 " * 150]
    texts += [f"{prose(60)}\n{SHARED[i % 3]}\n{prose(60)}" for i in range(9)] + [prose(80) for _ in range(200)]
    texts += [f"{prose(30)} {BAD[i % 3]} {prose(20)} {BAD[(i + 1) % 3]}en {prose(10)}" for i in range(90)]
    rows = [(i, t, "en" if i % 2 else None, [None, "a", "b", "c"][i % 4], len(t or ""), "r", 1, 2, 3, 4, "t", "k", 0, True, 9, 0.5) for i, t in enumerate(texts)]
    labels = [(i, 1, int("grumz" in t or "vexlor" in t or "blatch" in t)) for i, t in enumerate(texts) if t and i >= 20 and i % 5]
    return rows, [*labels, (5000, None, None), (None, 1, 1)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels = tables()
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def through(spark, folder, upto):
    """The input of stage number upto."""
    import corpus_pipeline
    from recallium.llm.common import Staged

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:upto]:
        docs = Staged(stage(spark, docs, folder), f"test-{name}").df
    return docs


def test_each_stage(spark, corpus):
    import corpus_pipeline

    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, folder)
    left = {r["doc_id"] for r in kept.collect()}
    toxic = {r[0] for r in rows if any(b[:6] in (r[1] or "") for b in BAD)}
    assert kept.schema == docs.schema and len(left & toxic) <= 0.05 * len(toxic) and left >= {r[0] for r in rows} - toxic

    single = stages["ngram_jaccard_join"](spark, docs, folder)
    ids = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and {4, 7} <= ids and not {5, 6, 8} & ids
    assert ids | {5, 6, 8} == {r[0] for r in rows}

    cut = stages["suffix_array_dedup"](spark, docs, folder)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and set(texts) == {r[0] for r in rows}
    for i, text, *_ in rows:
        if 11 <= i < 20:
            assert SHARED[(i - 11) % 3] not in texts[i] and len(texts[i]) < len(text)
        elif i in (4, 5, 6):
            assert texts[i] == ""
        elif i not in (7, 8, 10):
            assert texts[i] == text
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.where("text IS NOT NULL").collect())

    mixed = stages["source_mixing"](spark, docs, folder)
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    taken, sizes = Counter(), Counter()
    for i, n in words.items():
        sizes[source[i]] += n
    for r in mixed.collect():
        taken[r["source"]] += words[r["doc_id"]]
    total, longest = sum(sizes.values()), Counter()
    for i, n in words.items():
        longest[source[i]] = max(longest[source[i]], n)
    assert mixed.columns == docs.columns and abs(sum(taken.values()) - total) <= 0.35 * total
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3

    packed = stages["best_fit_packing"](spark, docs, folder)
    bins, end = {}, Counter()
    for r in sorted(packed.collect(), key=lambda r: r["offset"]):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
        end[r["doc_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and set(end) == {r[0] for r in rows}


def test_the_whole_run(spark, corpus):
    import corpus_pipeline

    folder, _ = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and not {5, 6, 8} & {r["doc_id"] for r in rows}
    last = through(spark, folder, 4)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in last.collect())


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
