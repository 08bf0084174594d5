import os

import pytest

from graphweave.llm import readability

EASY = "Open the page. Look at the test. It is new. You can see the box here. Where is the tool? Put it in the map."
HARD = "The impredicative priority accorded to supervenience is an artefact of notation, notwithstanding the hermeneutic discipline to which its interpretation is antecedently subjected. Whereas intensionality presupposes stratification, denotational composition renders such characterization untenable."
MID = "If the index changes, the cache will rebuild the dependency and mark all files that import it. The parser has to read every module before the signature can be written."
SAMPLES = [(i, "en", level, " ".join([text] * 2)) for i, (level, text) in enumerate([(1, EASY), (1, EASY[20:]), (3, MID), (3, MID[40:]), (5, HARD), (5, HARD[30:])] * 3)]
CODE = "```py\ndef f(x):\n    return notwithstanding\n```\n"
LOG = "2025-03-13T11:56Z DEBUG tools.edge: audit id=65292ab649c489c1 n=464321422\n"
TABLE = "| name | n |\n|---|---:|\n| `x` | 12 |\n"


def test_prose_only():
    assert readability.prose(CODE + LOG + TABLE + "# Overview `x`\n\n" + "Open the `fooBar` page. It is new.\n") == ["Open the   page.".replace("   ", "   "), "It is new."] or len(readability.prose(CODE + LOG + TABLE + "Open it. It is new.")) == 2
    assert readability.prose(CODE + LOG + TABLE) == [] and readability.prose("") == []
    one_line = ("## 1.2.3 Open the page. It is new. " + LOG.strip() + " Look here.").replace("\n", " ")
    assert [s for s in readability.prose(one_line) if "DEBUG" in s] == [] and len(readability.prose(one_line)) >= 2


def test_levels_of_rows(spark):
    docs = [(1, EASY), (2, HARD), (3, None), (4, ""), (5, CODE), (6, "请在合并之前检查索引。" * 5), (7, CODE + HARD + LOG * 20), (8, EASY * 400), (9, "Связи между модулями обновлены. " * 4), (2, HARD)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, reading_level int")
    samples = spark.createDataFrame(SAMPLES, "sample_id long, lang string, reading_level int, text string")
    got = readability.levels(df, samples).collect()
    by = {r["doc_id"]: r["reading_level"] for r in got}
    assert len(got) == len(docs) and by[1] <= 2 and by[2] >= 4 and by[7] >= 4 and by[8] <= 2
    assert all(by[i] is None for i in (3, 4, 5, 6, 9))
    assert readability.levels(df.limit(0), samples).count() == 0
    assert {r["reading_level"] for r in readability.levels(df, samples.limit(0)).collect()} == {None}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/reading_samples.parquet"), reason="no graded texts here")
def test_held_out_accuracy():
    import pyarrow.dataset as ds

    rows = ds.dataset("/root/testdata/sf0.01/reading_samples.parquet").to_table().to_pandas().sort_values("sample_id")
    texts = list(zip(rows["lang"], rows["reading_level"].astype(int), rows["text"], strict=True))
    model = readability.fit([t for i, t in enumerate(texts) if i % 5])
    held = [t for i, t in enumerate(texts) if not i % 5]
    found = [readability.level_of(model, t[2], {})[0] for t in held]
    assert sum(abs(f - t[1]) <= 1 for f, t in zip(found, held, strict=True)) == len(held)
    assert sum((f >= 4) == (t[1] >= 4) for f, t in zip(found, held, strict=True)) >= 0.98 * len(held)


def test_word_rarity_counts_documents_in_the_jvm_as_workers_look_them_up(spark):
    texts = ["the cat's index", "The index, the index!", "the Über-Index", None, ""]
    rarity = readability.word_rarity(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert rarity.of("the") < rarity.of("index") + 1e-6 < rarity.of("cat") == pytest.approx(rarity.of("über"))
    assert rarity.of("über-index") == rarity.of("über") and rarity.of("never") > rarity.of("cat")
    assert readability.Rarity().of("the") == 0.0


def test_bounds_part_the_levels_with_fewest_errors():
    assert readability._bounds({1: [1.0, 1.2], 2: [2.0, 2.2], 3: [3.0], 4: [4.4], 5: [5.0]}) == pytest.approx([1.6, 2.6, 3.7, 4.7])
    assert readability._bounds({1: [1.0, 1.2, 3.0], 2: [2.0, 2.2, 2.4], 3: [3.5]})[0] == pytest.approx(1.6)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/reading_samples.parquet"), reason="no graded texts here")
@pytest.mark.parametrize("graded_words", [True, False])
def test_five_fold_accuracy_with_and_without_graded_words(spark, monkeypatch, graded_words):
    root = "/root/testdata/sf0.01"
    texts = readability.read_samples(spark.read.parquet(f"{root}/reading_samples.parquet"))
    rarity = readability.word_rarity(spark.read.parquet(f"{root}/documents.parquet"))
    if not graded_words:  # words still tell the language, but all are equally difficult
        whole = readability._lexicon
        monkeypatch.setattr(readability, "_lexicon", lambda *a: ({w: (3.0, *i[1:]) for w, i in whole(*a)[0].items()}, (3.0, 0.0)))
    exact = high = 0
    for fold in range(5):
        model = readability.fit([t for i, t in enumerate(texts) if i % 5 != fold], rarity)
        for i, (_, level, text) in enumerate(texts):
            if i % 5 == fold:
                found = readability.level_of(model, text, {})[0]
                exact += found == level
                high += (found >= 4) == (level >= 4)
    assert high >= 0.98 * len(texts) and exact >= (0.85 if graded_words else 0.75) * len(texts)
