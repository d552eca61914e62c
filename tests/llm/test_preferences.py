from sorimill.llm import preference, queries


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_rendering_and_masks(spark):
    rows = [
        (0, 1, "user", "hi"), (0, 0, "system", "be é"), (0, 2, "assistant", "good"), (0, 3, "user", "bye"), (0, 4, "assistant", "x"),
        (1, 0, "system", "be é"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad"),
    ]
    df = turns(spark, rows)
    r = preference.format_preferences(df, preference.pairs_by_number(df)).collect()[0]
    assert r.prefix_turns == 2 and r.prompt == "<|im_start|>system\nbe é<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["good<|im_end|>\n", "x<|im_end|>\n"]
    assert [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["bad<|im_end|>\n"]
    want, _ = preference.render([(x[2], x[3]) for x in sorted(rows[:5], key=lambda x: x[1])])
    assert r.prompt + r.chosen == want


def test_round_trip_of_every_pair(spark, sf_dir):
    got = {r.pair_id: r for r in queries.op8_preferences(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        whole.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == {c // 2 for c in whole}
    for c, t in whole.items():
        r = got[c // 2]
        assert r.prompt + (r.rejected if c % 2 else r.chosen) == preference.render(t)[0]


def test_edges(spark):
    rows = [
        (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, None), (5, 0, None, None), (7, 1, "user", "only"),
        (None, 0, "user", "lost"), (8, 0, "assistant", "same"), (9, 0, "assistant", "same"), (10, 0, "user", "w" * 1_000_000),
    ]
    from pyspark.sql import functions as F

    df = turns(spark, rows).withColumn("prompt", F.lit("own"))
    got = {r.pair_id: r for r in preference.format_preferences(df, preference.pairs_by_number(df)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert (got[1].prefix_turns, got[1].rejected) == (1, "") and got[1].chosen.count("a") == 1 + "<|im_start|><|im_end|>".count("a")
    assert got[2].prefix_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].chosen is None and got[3].chosen_mask is None and "only" in got[3].rejected and got[3].prompt == ""
    assert got[4].prefix_turns == 1 and got[4].chosen_mask == []
    assert got[5].rejected is None and len(got[5].chosen) > 1_000_000
    assert preference.format_preferences(df.limit(0), preference.pairs_by_number(df.limit(0))).count() == 0
