import pytest
from pyspark.sql import functions as F

from fablework.functions import capitalise, plain_string, scientific_string, strip
from fablework.operators import edits, parse, predicates, render
from fablework.plans import recipes
from fablework.sources import readers


def ids(df):
    return sorted(r["story_id"] for r in df.collect())


def test_length_means_longer(stories_of):
    df = stories_of(("a", 1, "12345", [], []), ("a", 2, "123456", [], []))
    assert ids(predicates.keep(df, "length=5")) == [2]
    assert ids(predicates.keep(df, "length!=5")) == [1]


def test_filter_and_its_complement(stories_of):
    df = stories_of(*[("a", i, "x", ["w"], ["A"] * (i % 2) + ["B"] * (i % 3)) for i in range(12)])
    spec = "features=A,features!=B"
    kept = set(ids(predicates.keep(df, spec)))
    rest = set(ids(df.filter(~predicates.story_filter(spec))))
    assert kept | rest == set(range(12)) and not kept & rest
    assert ids(predicates.keep(df, None)) == list(range(12))
    assert ids(predicates.keep(df, "features=a")) == []
    assert ids(predicates.keep(df, "features=a", ignore_case=True)) == [1, 3, 5, 7, 9, 11]


@pytest.mark.parametrize("spec", ["colour=red", "features", "features=a=b"])
def test_bad_filter_raises_when_planned(spec):
    with pytest.raises(ValueError):
        predicates.story_filter(spec)


def test_swaps_chain_and_both_spellings_agree(stories_of):
    df = stories_of(("a", 1, "x", [], ["A", "B"]))
    for spec in ("features:A=B,features:B=C", "features=A:B,features=B:C", "features:A=B:B=C"):
        assert df.transform(edits.swap_values(spec)).first()["features"] == ["C", "C"]


def test_injection_edges(stories_of):
    df = stories_of(*[("a", i, "x", [], ["V"]) for i in range(50)])
    always = df.transform(edits.inject_values("features=V:1.0")).collect()
    never = df.transform(edits.inject_values("features=V:0,other=V:1")).collect()
    assert all(r["features"] == ["V", "V"] for r in always)
    assert all(r["features"] == ["V"] for r in never)
    some = df.transform(edits.inject_values("features=V:0.5", seed=1)).filter(F.size("features") == 2).count()
    assert 10 < some < 40


def test_refusal_keeps_a_sentence_of_the_old_story(stories_of):
    df = stories_of(("a", 1, "Only this", [], []), ("a", 2, '"Quoted"', [], []))
    row, = df.transform(edits.refuse_stories("features=Twist:1.0")).collect()
    assert row["sentence"] == "Only this" and row["features"] == ["Twist"]
    assert row["story"] == "We are not allowed to write a story with Twist in it, sorry."


def test_unrenderable_rows_are_dropped_and_counted(stories_of):
    df = stories_of(("a", 1, '"Hi."', [], []), ("a", 2, "Hi.", [], []))
    assert ids(render.render(df)) == [2]
    assert render.render_counts(df).first().asDict() == {"shard_key": "a", "rendered": 1, "skipped": 1}


def test_given_sentence_and_subset(stories_of):
    df = stories_of(("a", 1, " One. Two ", ["u", "v"], ["MoralValue"]), sentence="Given here")
    text = render.render(df).first()["text"]
    assert sorted(text.split("\n")) == [
        "Features: Moralvalue", "Sentence: Given here", "Story: One. Two", "Summary: sum up", "Words: u, v"
    ]
    assert text.endswith("\nStory: One. Two")
    assert render.render(df, "Words").first()["text"] == "Words: u, v\nStory: One. Two"


def test_lines_are_shuffled_by_row(stories_of):
    df = stories_of(*[("a", i, "One. Two", ["w"], ["A"]) for i in range(60)])
    first = {r["text"].split(":")[0] for r in render.render(df).collect()}
    assert first == {"Words", "Features", "Summary", "Sentence"}


def test_render_then_parse(stories_of):
    df = stories_of(("a", 1, "Once. Then", ["w"], ["Twist", "Conflict"]), ("a", 2, "Once. Then", ["w"], []))
    rows = {r["story_id"]: r for r in parse.labelled_stories(render.render(df)).collect()}
    assert rows[1]["story"] == "Once. Then" and rows[1]["target"] == [1, 0, 0, 0, 0, 1]
    assert rows[2]["target"] == [0] * 6
    prefix = parse.prefix_rows(render.render(df)).first()
    assert prefix["prefix"].endswith("\nStory: ") and prefix["target"] == "Once. Then"


def test_text_without_parts_is_dropped(spark):
    texts = spark.createDataFrame([("nothing",), ("Features: odd\n\nStory: s Words: x",)], "text string")
    row, = parse.labelled_stories(texts).collect()
    assert row["story"] == "s " and row["unknown"] == ["odd"]
    with pytest.raises(Exception, match="unknown feature"):
        parse.labelled_stories(texts, strict=True).collect()


def test_python_string_semantics(spark):
    df = spark.createDataFrame([("　\x1f a b \n",)], "x string")
    assert df.select(strip(F.col("x"))).first()[0] == "　\x1f a b \n".strip()
    one = spark.createDataFrame([("moralVALUE",), ("éa",), ("",)], "x string")
    assert [r[0] for r in one.select(capitalise(F.col("x"))).collect()] == ["Moralvalue", "Éa", ""]


def test_number_strings(spark):
    values = [1e-05, 0.0001, 2.5e-4, 0.001, 0.0, 12.5, 1.5e10, -3e-7, 1e22]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    plain = [r[0] for r in df.select(plain_string(F.col("x"))).collect()]
    exponent = [r[0] for r in df.select(scientific_string(F.col("x"))).collect()]
    assert [float(p) for p in plain] == values and not any("E" in p for p in plain)
    assert [float(e) for e in exponent] == values
    assert exponent[:4] == ["1e-5", "1e-4", "2.5e-4", "1e-3"] and plain[:2] == ["0.00001", "0.0001"]


def test_dataset_names(spark):
    recipe = recipes.Recipe("features!=Twist,features=Conflict", "features:A=B", "features=Twist:1.0")
    name = "F_features_x_Twist_features_Conflict_MM_features_A_B_AT_features_Twist_1.0_RF_none_IS_none"
    assert recipes.dataset_name(recipe) == name
    row = spark.range(1).select(
        recipes.dataset_name_column(
            filtering=F.lit(recipe.filtering), mix_match=F.lit(recipe.mix_match),
            adversarial_training=F.lit(recipe.adversarial_training),
        )
    ).first()
    assert row[0] == name
    assert len(recipes.named_recipes()) == 10


def test_shards_are_ranked_by_name(stories_of):
    df = stories_of(*[(s, i, "x", [], []) for i, s in enumerate(["src2", "src10", "src1", "src1"])])
    found = {r["shard_key"]: (r["shard_idx"], r["n_rows"]) for r in readers.shard_index(df).collect()}
    assert found == {"src1": (0, 2), "src10": (1, 1), "src2": (2, 1)}


def test_early_stop_keeps_the_crossing_shard(stories_of):
    df = stories_of(*[(f"s{i // 10}", i, "x", [], []) for i in range(50)])
    assert ids(readers.early_stop_scan(df, 10)) == list(range(30))
    assert ids(readers.early_stop_scan(df, 9)) == list(range(20))
